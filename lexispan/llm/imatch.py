"""I-Match fingerprints with randomised lexicons, with DataFrame functions only.

The lexicon holds the terms whose share of documents lies in a band (that is, whose inverse document frequency does). It is split
at random, by hashing, into subsets at three densities: 1/32, 1/256 and 1/2048 of the lexicon each, 32 subsets of each density. For
each subset a document's distinct terms in it are sorted and hashed; the subsets that hold a term of the document, with
their hashes, are its fingerprint. Two texts agree in a subset if they have the same terms in it.

Likeness is the share of subsets that agree, among those that hold a term of either, at the sparsest density at which
at least MIN_SUBSETS do (the densest, if none): small subsets tell long texts apart by degrees, large ones short texts.

The lexicon's size is bounded whatever the corpus: each of its terms is in at least MIN_SHARE of the documents, so it has at
most (distinct terms a document) / MIN_SHARE terms. It is broadcast if it also has at most MAX_BROADCAST_TERMS, else joined.

Neighbours in the order of ids come from a window over ranges of (id, hash of the text): quantiles of the ids give the ranges, an
id that fills several quantiles is split by the hash, and each range also gets the first row of the next. Texts are shuffled once,
by range; terms never are, except as counts for the lexicon.

Defined cases: null text counts as empty; very long texts are read whole; a text without lexicon terms has an empty fingerprint, and two
such have likeness 1 if their texts are equal, else 0; null ids come first in the order; rows with equal ids (ties) are ordered by the
hash of their text, and equal rows are interchangeable and stand side by side; a single row is its own next; columns other than id and
text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bind, cut, documents, partitions

MIN_SHARE, MAX_SHARE = 1 / 1000, 1 / 10
DENSITIES = (32, 256, 2048)
SUBSETS = 32
MIN_SUBSETS = 10
MAX_BROADCAST_TERMS = 2_000_000
_LEAST = -(1 << 63)


def terms(text: Column) -> Column:
    """Distinct terms: runs of letters and digits, in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, text: str, min_share: float, max_share: float) -> DataFrame:
    """term (64-bit hash) and subset, a row for each subset that the term is in."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("t")).groupBy(F.xxhash64("t").alias("term")).agg(F.count("*").alias("df"))
    inside = counts.filter((F.col("df") >= max(2.0, min_share * n)) & (F.col("df") <= max(2.0, max_share * n)))
    of = [F.pmod(F.xxhash64("term", F.lit(k)), F.lit(d)) + k * SUBSETS for k, d in enumerate(DENSITIES)]
    held = F.filter(F.array(*[F.when(s < (k + 1) * SUBSETS, s.cast("int")) for k, s in enumerate(of)]), lambda s: s.isNotNull())
    return cut(inside.select("term", F.explode(held).alias("subset")), "op3-lexicon")


def range_of(value: Column, bounds: list[int], below: bool = False) -> Column:
    """How many bounds are at or below value (with below set, below it), by bisection; bounds are ascending."""
    steps = [1 << s for s in reversed(range(len(bounds).bit_length()))]
    if not bounds:
        return F.lit(0)
    limits, n = F.lit(bounds).cast("array<bigint>"), len(bounds)
    fits = lambda x: x < value if below else x <= value
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when((at + s <= n) & fits(F.get(limits, at + s - 1)), at + s).otherwise(at))


def with_neighbours(docs: DataFrame, key: str, text: str) -> DataFrame:
    """part, place (its rank within part), key, text, next text; the first row of the next part stands last in each part, as guest."""
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumns({"k": F.coalesce("key", F.lit(_LEAST)), "h": F.xxhash64("text")})
    n = 4 * partitions(docs.sparkSession)
    # one row with n numbers
    bounds = sorted(rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10_000).alias("b")).first().b or [])
    # an id that is a bound m times is dealt to m + 1 parts, by the upper half of the hash as a number from 0 on
    low, high = range_of(F.col("k"), bounds, below=True), range_of(F.col("k"), bounds)
    share = F.expr("cast(shiftright((shiftright(h, 32) + 2147483648L) * (_high - _low + 1), 32) as int)")
    rows = rows.withColumns({"_low": low, "_high": high}).withColumn("part", F.col("_low") + share).drop("_low", "_high")
    least = cut(rows.groupBy("part").agg(F.min(F.struct("k", "h")).alias("f")).select("part", "f.*"), "op3-parts")  # a row for each part, n at most
    order = Window.orderBy("part")
    least = least.withColumn("to", F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy(F.lit(0)))))
    guests = rows.join(F.broadcast(least), ["part", "k", "h"]).groupBy("part", "to").agg(F.min(F.struct("k", "h", "key", "text")).alias("r"))
    guests = cut(guests.select(F.col("to").alias("part"), "r.key", "r.k", "r.h", "r.text", F.lit(True).alias("guest")), "op3-guests")
    every = rows.select("part", "key", "k", "h", "text", F.lit(False).alias("guest")).unionByName(guests)
    w = Window.partitionBy("part").orderBy("guest", "k", "h")
    return every.select("part", "key", "text", "guest", F.lead("text").over(w).alias("next"), F.row_number().over(w).alias("place"))


def entries(listed: Column) -> Column:
    """Fingerprints of two texts from the sorted (version, subset, term) rows of both: each subset's terms hashed in order; an entry is subset and 16 bits of the hash."""
    entry = lambda s, h: s * 65536 + h.bitwiseAND(F.lit(65535)).cast("int")
    state = lambda s, h, o: F.struct(s.alias("s"), h.alias("h"), o.alias("o"))
    closed = lambda a: F.when(a["s"] >= 0, F.concat(a["o"], F.array(entry(a["s"], a["h"])))).otherwise(a["o"])
    start = state(F.lit(-1), F.lit(0).cast("bigint"), F.array().cast("array<int>"))
    step = lambda a, x: F.when(a["s"] == x["s"], state(a["s"], F.xxhash64(a["h"], x["t"]), a["o"])).otherwise(state(x["s"], F.xxhash64(x["t"]), closed(a)))
    return F.aggregate(listed, start, step, closed)


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of entries; null if neither has any."""
    subsets = lambda x: F.transform(x, lambda e: F.shiftright(e, 16))
    at = lambda x, k: F.size(F.filter(x, lambda s: (s >= k * SUBSETS) & (s < (k + 1) * SUBSETS)))

    def ratio(s: Column) -> Column:
        out = F.when(at(s["any"], 0) > 0, at(s["same"], 0) / at(s["any"], 0))
        for k in range(1, len(DENSITIES)):
            out = F.when(at(s["any"], k) >= MIN_SUBSETS, at(s["same"], k) / at(s["any"], k)).otherwise(out)
        return out

    return bind(F.struct(F.array_union(subsets(a), subsets(b)).alias("any"), subsets(F.array_intersect(a, b)).alias("same")), ratio)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    lex = lexicon(docs, text, min_share, max_share)
    if lex.count() <= MAX_BROADCAST_TERMS:
        lex = F.broadcast(lex)
    rows = with_neighbours(docs, key, text).withColumn("n", F.length("text"))
    quarter = F.floor(F.col("n") / 4).cast("int")
    rows = rows.withColumn("edited", F.when(~F.col("guest"), F.concat(F.expr("left(text, n - cast(floor(n / 4) as int))"), F.coalesce(F.col("next").substr(F.lit(1), quarter), F.lit("")))))
    about = F.struct("key", F.col("n").cast("bigint").alias("n"), F.sha2("edited", 256).alias("sha"), "guest", F.sha2("text", 256).alias("own"))
    # a row for what is known of the document, and one for each term of either text
    item = lambda v, t, a: F.struct(F.lit(v).alias("v"), t.alias("term"), a.alias("about"))
    nothing = F.lit(None).cast("struct<key:bigint,n:bigint,sha:string,guest:boolean,own:string>")
    listed = lambda v, c: F.transform(terms(F.coalesce(F.col(c), F.lit(""))), lambda t: item(v, F.xxhash64(t), nothing))
    flat = rows.select("part", "place", F.explode(F.concat(F.array(item(0, F.lit(None).cast("bigint"), about)), listed(0, "text"), listed(1, "edited"))).alias("i")).select("part", "place", "i.*")
    held = flat.join(lex, "term", "left").filter("subset IS NOT NULL OR about IS NOT NULL")
    n = len(DENSITIES) * SUBSETS
    own = F.when(F.col("subset").isNotNull(), F.struct((F.col("v") * n + F.col("subset")).alias("s"), F.col("term").alias("t")))
    # part is what the rows are dealt out by, so this takes no further shuffle
    grouped = held.groupBy("part", "place").agg(F.collect_list(own).alias("l"), F.first("about", ignorenulls=True).alias("a"))
    both = grouped.select("part", "place", "a.*", entries(F.sort_array("l")).alias("e"))
    both = both.withColumns({"f": F.filter("e", lambda x: x < n * 65536), "g": F.transform(F.filter("e", lambda x: x >= n * 65536), lambda x: x - n * 65536)})
    w = Window.partitionBy("part").orderBy("place")
    both = both.withColumns({"next": F.lead("f").over(w), "next_own": F.lead("own").over(w)}).filter("NOT guest")
    text_of = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")
    same = lambda a, b: F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))
    return both.select(
        "key", F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), text_of("f").alias("fingerprint"), text_of("g").alias("edited_fingerprint"),
        F.coalesce(likeness(F.col("f"), F.col("g")), same(F.col("own"), F.col("sha"))).alias("near_edited"), F.coalesce(likeness(F.col("f"), F.col("next")), same(F.col("own"), F.col("next_own"))).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir)).withColumnRenamed("key", "doc_id")
