"""Mixing sources to target weights by hierarchical budgeting.

A tree of domain, language and source carries integer weights. The total goes down from the root: at each node it is
shared among the children by weight; a child whose subtree holds less than its share gets all it holds, and what
it can't use goes to its siblings by their weights; only what a whole subtree can't hold reaches the siblings above. That
is one closed form a level: with children ordered by capacity over weight, those that are full are a prefix of the order.

A leaf's budget is spent in epochs. Epochs that fit whole take every document; the last takes a prefix of the tokens
in the order of a seeded hash of identifier and text, the last document in part. The prefix is found step by step: tokens are summed
in RANGES ranges of the hash, then in ranges of the one in which the budget ends, STEPS times, and only what shares the last of them
is put in order. So no leaf, however large, is sorted, and no window holds more than RANGES rows of a leaf.

Defined cases: null text has no tokens, and very long texts are counted whole; null or unknown domains, languages and sources are nodes
of their own with the default weight; a weight of 0 gives nothing; null and equal identifiers are told apart by their texts, rows of
one hash (ties) come in the order of their tokens, and equal rows are interchangeable; columns pass through whatever their names, but for
those with the name of an output column of choose, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, documents, words_column

LEVELS = ("domain", "lang", "source")
#: The last number of a source's name, by which it belongs to a domain.
DOMAIN_SQL = "CASE WHEN source IS NULL OR NOT {match} THEN 'other' WHEN CAST({number} AS INT) < 8 THEN 'web' WHEN CAST({number} AS INT) < 14 THEN 'forum' ELSE 'reference' END"
WEIGHTS = {"domain": {"web": 50, "forum": 30, "reference": 20}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {}}
DEFAULT_WEIGHT = 10
#: Budget of all leaves in hundredths of the tokens there are, and how often a document may be taken.
PERCENT, EPOCHS, SEED = 90, 2, 17
#: Bits of the hash that are used, ranges a step, and steps.
BITS, RANGES, STEPS = 60, 256, 3
MADE = ("_domain", "_lang", "_source", "_tokens", "_copies", "_taken")


def spark_domain() -> Column:
    return F.expr(DOMAIN_SQL.format(match="regexp_like(source, '^[a-z]+[0-9]{1,6}$')", number="regexp_extract(source, '([0-9]+)$', 1)"))


def weight_sql(level: str) -> str:
    known = "".join(f" WHEN {level} = '{k}' THEN {w}" for k, w in WEIGHTS[level].items())
    return f"CASE{known} ELSE {DEFAULT_WEIGHT} END" if known else str(DEFAULT_WEIGHT)


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent, name, cap, weight, amount of the parent) with their own amount: floor of what the closed form gives."""
    w = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name) if parent else Window.orderBy(F.col("cap") / F.col("weight"), name)
    before = F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing))
    df = nodes.filter("weight > 0").withColumns({"_before": before, "_after": after})
    df = df.withColumn("_full", F.col("cap") * F.col("_after") <= (F.col("amount") - F.col("_before")) * F.col("weight"))
    all_ = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    df = df.withColumns({"_left": F.col("amount") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(all_), F.lit(0)), "_open": F.sum(F.when(~F.col("_full"), F.col("weight"))).over(all_)})
    own = F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("_left * weight div _open"))
    return df.withColumn("amount", own.cast("bigint")).drop("_before", "_after", "_full", "_left", "_open")


def budgets(leaves: DataFrame, percent: int, epochs: int) -> DataFrame:
    """domain, lang, source, tokens -> with budget. One row for each leaf; windows run over the nodes of the tree only."""
    leaves = leaves.withColumns({f"w_{x}": F.expr(weight_sql(x)).cast("bigint") for x in LEVELS})
    cap = F.when(F.least(*[F.col(f"w_{x}") for x in LEVELS]) > 0, F.col("tokens") * epochs).otherwise(F.lit(0)).cast("bigint")
    leaves = leaves.withColumn("cap", cap)
    total = leaves.agg(F.least(F.expr(f"coalesce(sum(tokens), 0) * {percent} div 100"), F.coalesce(F.sum("cap"), F.lit(0))).cast("bigint").alias("amount"))
    level1 = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.max("w_domain").alias("weight"))
    a1 = share(level1.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one").drop("one"), [], "domain").select("domain", "amount")
    level2 = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.max("w_lang").alias("weight"))
    a2 = share(level2.join(a1, "domain"), ["domain"], "lang").select("domain", "lang", "amount")
    a3 = share(leaves.withColumn("weight", F.col("w_source")).join(a2, ["domain", "lang"]), ["domain", "lang"], "source")
    return leaves.join(a3.select(*LEVELS, F.col("amount").alias("budget")), list(LEVELS), "left").select(*LEVELS, "tokens", F.coalesce("budget", F.lit(0)).alias("budget"))


def _chosen(docs: DataFrame, key: str, text: str, lang: str, percent: int, epochs: int, seed: int) -> DataFrame:
    """r (the row of docs), domain, lang, source, tokens, copies and taken."""
    leaf = list(LEVELS)
    rows = docs.select(
        F.struct(*docs.columns).alias("r"), spark_domain().alias("domain"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.size(words_column(F.col(text))).cast("bigint").alias("tokens"), F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("name"),
    )
    leaves = cut(rows.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")), "op8-leaves")
    plan = budgets(leaves, percent, epochs).select(*leaf, F.expr("if(tokens > 0, budget div tokens, 0)").alias("whole"), F.expr("if(tokens > 0, budget % tokens, 0)").alias("rest"))
    plan = cut(plan, "op8-plan")  # a row for each leaf; written, so that Spark sees its size before it plans the join
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("name")))
    rows = rows.join(plan, leaf).withColumn("place", F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")).drop("name")

    # numbers alone: what the steps read again and again
    light = cut(rows.filter("rest > 0").select(*leaf, "rest", "place", "tokens"), "op8-places")
    ends = cut(plan.filter("rest > 0").select(*leaf, F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("before")), "op8-ends")
    width, step = BITS, RANGES.bit_length() - 1
    for _ in range(STEPS):
        inside = light.join(ends, leaf).filter(F.shiftright("place", width) == F.col("end"))
        width -= step
        sums = inside.groupBy(*leaf, "rest", "before", F.shiftright("place", width).alias("range")).agg(F.sum("tokens").alias("n"))
        w = Window.partitionBy(*leaf).orderBy("range")
        so_far = sums.withColumn("so", F.col("before") + F.sum("n").over(w) - F.col("n"))
        # a row for each leaf
        ends = cut(so_far.filter("so < rest AND so + n >= rest").select(*leaf, F.col("range").alias("end"), F.col("so").alias("before")), "op8-ends")
    rows = rows.join(ends, leaf, "left")
    own = F.shiftright("place", width)
    inside, at_end = F.coalesce(own < F.col("end"), F.lit(False)), F.coalesce(own == F.col("end"), F.lit(False))
    settled = rows.filter(~at_end).withColumns({"part": F.when(inside, F.col("tokens")).otherwise(F.lit(0)).cast("bigint"), "in": inside})
    w = Window.partitionBy(*leaf).orderBy("place", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter(at_end).withColumn("so", F.col("before") + F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    last = last.withColumns({"part": F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - F.col("so"))).cast("bigint"), "in": F.col("so") < F.col("rest")}).drop("so")
    out = settled.unionByName(last)
    return out.select("r", *leaf, "tokens", (F.col("whole") + F.col("in").cast("bigint")).alias("copies"), (F.col("whole") * F.col("tokens") + F.col("part")).alias("taken"))


def choose(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with _domain, _lang, _source, _tokens, _copies (epochs that take the document, in part or whole) and _taken (tokens taken in all)."""
    out = _chosen(docs, key, text, lang, percent, epochs, seed)
    return out.select(*[F.col("r").getField(c).alias(c) for c in docs.columns if c not in MADE], *[F.col(c[1:]).alias(c) for c in MADE])


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with each document as often as its leaf's epochs take it; one taken in part stays whole. Columns are those of docs."""
    chosen = _chosen(docs, key, text, lang, percent, epochs, seed).filter("copies > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = choose(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_copies").alias("copies"), F.col("_taken").alias("tokens_taken"))


def _share_sql(name: str, source: str, parent: str, key: str) -> str:
    part = f"PARTITION BY {parent} " if parent else ""
    return f"""
{name}_a AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b4, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS aft
  FROM {source} WHERE weight > 0 WINDOW w AS ({part}ORDER BY cap::DOUBLE / weight, {key})),
{name}_b AS (SELECT *, cap * aft <= (amount - b4) * weight AS full_ FROM {name}_a),
{name}_c AS (SELECT *, amount - coalesce(sum(CASE WHEN full_ THEN cap END) OVER ({part.strip()}), 0) AS lft, sum(CASE WHEN NOT full_ THEN weight END) OVER ({part.strip()}) AS opn FROM {name}_b),
{name} AS (SELECT * REPLACE ((CASE WHEN full_ THEN cap ELSE (lft * weight) // opn END)::BIGINT AS amount) FROM {name}_c)"""


_DOMAIN = DOMAIN_SQL.format(match="regexp_matches(source, '^[a-z]+[0-9]{1,6}$')", number="regexp_extract(source, '([0-9]+)$', 1)")
ORACLE = rf"""
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS digest, {_DOMAIN} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
l AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {EPOCHS})::BIGINT AS cap, {weight_sql("domain")} AS w_domain, {weight_sql("lang")} AS w_lang, {weight_sql("source")} AS w_source FROM d GROUP BY domain, lang, source),
t AS (SELECT least(sum(tokens) * {PERCENT} // 100, sum(cap)) AS amount FROM l),
n1 AS (SELECT domain, sum(cap) AS cap, max(w_domain) AS weight, any_value(t.amount) AS amount FROM l CROSS JOIN t GROUP BY domain),
{_share_sql("s1", "n1", "", "domain")},
n2 AS (SELECT l.domain, l.lang, sum(l.cap) AS cap, max(w_lang) AS weight, any_value(s1.amount) AS amount FROM l JOIN s1 USING (domain) GROUP BY ALL),
{_share_sql("s2", "n2", "domain", "lang")},
n3 AS (SELECT l.domain, l.lang, l.source, l.tokens, l.cap, l.w_source AS weight, s2.amount FROM l JOIN s2 USING (domain, lang)),
{_share_sql("s3", "n3", "domain, lang", "source")},
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN amount // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN amount % tokens ELSE 0 END AS rest FROM s3),
o AS (SELECT d.*, p.whole, p.rest, left(md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '') || ':' || digest), 15) AS h FROM d JOIN p USING (domain, lang, source)),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b4 FROM o)
SELECT doc_id, domain, lang, source, n_tokens, (whole + (b4 < rest)::INT)::BIGINT AS copies, (whole * n_tokens + greatest(0, least(n_tokens, rest - b4)))::BIGINT AS tokens_taken FROM c
"""
