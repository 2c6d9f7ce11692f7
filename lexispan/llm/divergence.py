"""Quality rules by distribution divergence, with DataFrame functions only.

Each document's histograms of character classes and of its language's commonest words are held against
references of that language by Jensen-Shannon distance (base 2, so 0 to 1). References are sums over all documents that are judged, each
document's own share included, unless fitted ones are given. A histogram is judged only from a minimum length on.

Defined cases: null text counts as empty (no words, base_failed); very long texts are read whole; null or rare languages (fewer than
min_reference_words words in all) use the reference of the whole corpus; words of one count (ties) are ranked by their letters; repeated
rows give one row each; an empty table gives an empty result; other columns of the input are carried through whatever their names,
unless they clash with an output column, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, bind, cut, documents, words_column

WINDOW_WORDS = 8
#: Character classes, each without what those before it hold; what is left is the last class.
BLANKS = r"[\x20]+"
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", BLANKS, r"[\x09-\x0D]+", r"\p{L}+", "[.,;:!?'\"()-]+")
N_COMMON = 24
MIN_CHARS = 200
MIN_WORDS = 50
MIN_REFERENCE_WORDS = 1000
MAX_CLASS_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.5


def repeated_words(words: Column) -> Column:
    """Words that lie in 8-word windows found twice or more: sort window hashes with their places, keep those with an equal neighbour, add up the covered lengths."""
    w, size = WINDOW_WORDS, F.size(words)
    # Hashes of pairs, of pairs of pairs, then of eight words: three passes instead of a slice for each window.
    pairs = lambda c, k: F.zip_with(c, F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    eight = lambda h: bind(pairs(h, 1), lambda a: bind(pairs(a, 2), lambda b: F.slice(pairs(b, 4), 1, F.greatest(F.size(b) - (w - 1), F.lit(0)))))
    hashes = F.when(size >= w, bind(F.transform(words, lambda x: F.xxhash64(x)), eight)).otherwise(F.array().cast("array<bigint>"))

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, k: F.coalesce(F.least(F.get(places, k + 1) - p, F.lit(w)), F.lit(w))), F.lit(0).cast("bigint"), lambda a, x: a + x)

    def equal_places(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, F.when(k > 0, F.get(s, k - 1))) | same(x, F.get(s, k + 1))), lambda x: x["i"]))

    def count(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(bind(by_hash, lambda s: bind(equal_places(s), covered)))

    return bind(hashes, count)


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _words and the base measures, from whole texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"_words": words_column(F.col(text)), "_lines": lines})
    df = df.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": repeated_words(F.col("_words")),
    }).drop("_lines")
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def with_classes(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds _classes, the number of characters in each class: classes are taken out in turn, so later ones read little.

    Small letters and blanks go in one pass, since together they come in long runs; blanks are counted by themselves."""
    small, *others = (c for c in CLASSES if c != BLANKS)
    df = df.withColumns({"_r": F.coalesce(F.col(text), F.lit(""))})
    df = df.withColumns({"_blanks": F.length("_r") - F.length(F.replace("_r", F.lit(" "), F.lit(""))), "_r0": F.regexp_replace("_r", small.replace("]", r"\x20]"), "")})
    for k, c in enumerate(others):
        df = df.withColumn(f"_r{k + 1}", F.regexp_replace(f"_r{k}", c, ""))
    n = [F.length(f"_r{k}") for k in range(len(others) + 1)]
    counts = dict(zip(others, [a - b for a, b in zip(n[:-1], n[1:], strict=True)], strict=True)) | {small: F.length("_r") - n[0] - F.col("_blanks"), BLANKS: F.col("_blanks")}
    return df.withColumn("_classes", F.array(*[counts[c].cast("bigint") for c in CLASSES], n[-1].cast("bigint"))).drop("_r", "_blanks", *[f"_r{k}" for k in range(len(others) + 1)])


def references(docs: DataFrame, text: str = "text", lang: str = "lang", n_common: int = N_COMMON, min_reference_words: int = MIN_REFERENCE_WORDS) -> DataFrame:
    """One row per language of enough words, and one for the corpus (key '*'): class counts, commonest words and the length of the longest, counts of those and of the rest.

    Counts are pre-aggregated before each shuffle; the commonest words are cut to n_common a language by a ranked
    window whose limit Spark applies before the exchange."""
    keyed = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.col(text))
    classes = with_classes(keyed, text).groupBy("_lang").agg(*[F.sum(F.col("_classes")[k]).alias(f"c{k}") for k in range(len(CLASSES) + 1)])
    classes = cut(classes, "op5-classes")
    counts = cut(keyed.select("_lang", F.explode(words_column(F.col(text))).alias("word")).withColumn("word", F.lower("word")).groupBy("_lang", "word").agg(F.count("*").alias("n")), "op5-words")
    both = lambda df, *by: df.unionByName(df.withColumn("_lang", F.lit("*"))).groupBy("_lang", *by)
    totals = both(counts).agg(F.sum("n").alias("total"))
    ranked = both(counts, "word").agg(F.sum("n").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "word"))).filter(F.col("r") <= n_common)
    common = ranked.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("r", "word", "n"))).alias("s"))
    classes = both(classes).agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(CLASSES) + 1)])
    out = totals.join(common, "_lang").join(classes, "_lang").filter((F.col("total") >= min_reference_words) | (F.col("_lang") == "*"))
    kept = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    longest = F.array_max(F.transform(F.col("s")["word"], lambda x: F.length(x)))
    return out.select("_lang", F.col("s")["word"].alias("_common"), longest.alias("_longest"), F.concat(F.col("s")["n"], F.array(F.col("total") - kept)).alias("_ref_words"), F.array(*[F.col(f"c{k}") for k in range(len(CLASSES) + 1)]).alias("_ref_classes"))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of one length, to 9 decimals; null if either has no counts."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: s + v).cast("double")
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def distance(t: Column) -> Column:
        terms = F.zip_with(a, b, lambda x, y: bind(F.struct((x / t["a"]).alias("p"), (y / t["b"]).alias("q")), lambda s: part(s["p"], (s["p"] + s["q"]) / 2) + part(s["q"], (s["p"] + s["q"]) / 2)))
        return F.round(F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2, F.lit(0.0))), 9)

    return bind(F.struct(total(a).alias("a"), total(b).alias("b")), lambda t: F.when((t["a"] > 0) & (t["b"] > 0), distance(t)))


MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def _judge(docs: DataFrame, text: str, lang: str, fitted: DataFrame | None, min_chars: int, min_words: int, max_class_distance: float, max_word_distance: float, n_common: int, min_reference_words: int) -> DataFrame:
    """docs, none of whose columns has a name of MADE or of a helper, with the columns of MADE."""
    # a few rows; written, so that Spark sees its size before it plans the join
    refs = fitted if fitted is not None else cut(references(docs, text, lang, n_common, min_reference_words), "op5-references")
    whole = refs.filter("_lang = '*'").select(*[F.col(c).alias(f"{c}_all") for c in refs.columns if c != "_lang"])
    df = with_classes(with_base(docs, text), text).withColumn("_lang", F.coalesce(F.col(lang), F.lit("")))
    df = df.withColumn("_all", F.lit("*")).join(refs.filter("_lang != '*'"), "_lang", "left").join(whole.withColumn("_all", F.lit("*")), "_all", "left")
    for c in ("_common", "_longest", "_ref_words", "_ref_classes"):
        df = df.withColumn(c, F.coalesce(F.col(c), F.col(f"{c}_all")))
    df = df.withColumn("_hits", F.filter(F.transform(F.filter("_words", lambda w: F.length(w) <= F.col("_longest")), F.lower), lambda w: F.array_contains(F.col("_common"), w)))  # lower case never makes a word shorter
    counts = F.transform("_common", lambda c: (F.size("_hits") - F.size(F.array_remove(F.col("_hits"), c))).cast("bigint"))
    df = df.withColumn("_counts", F.concat(counts, F.array(F.col("n_words") - F.size("_hits"))))
    df = df.withColumns({
        "class_distance": F.when(F.length(text) >= min_chars, js_distance(F.col("_classes"), F.col("_ref_classes"))),
        "word_distance": F.when(F.col("n_words") >= min_words, js_distance(F.col("_counts"), F.col("_ref_words"))),
    })
    bad = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    return df.withColumn("kept", ~F.col("base_failed") & ~bad).select(*docs.columns, *MADE)


def _own(c: str) -> str:
    return f"_own_{c}"


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", fitted: DataFrame | None = None, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, n_common: int = N_COMMON, min_reference_words: int = MIN_REFERENCE_WORDS) -> DataFrame:
    """The documents with the base measures, class_distance, word_distance (null below the guards), and kept. fitted: references made from other documents."""
    named = docs.withColumnsRenamed({c: _own(c) for c in docs.columns})
    out = _judge(named, _own(text), _own(lang), fitted, min_chars, min_words, max_class_distance, max_word_distance, n_common, min_reference_words)
    return out.select(*[F.col(_own(c)).alias(c) for c in docs.columns if c not in MADE], *MADE)


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", fitted: DataFrame | None = None, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, n_common: int = N_COMMON, min_reference_words: int = MIN_REFERENCE_WORDS) -> DataFrame:
    """The documents that are kept, with their own columns."""
    named = docs.withColumnsRenamed({c: _own(c) for c in docs.columns})
    judged = _judge(named, _own(text), _own(lang), fitted, min_chars, min_words, max_class_distance, max_word_distance, n_common, min_reference_words)
    # The row number keeps the optimizer from pushing the verdict down: as a predicate it would be computed anew wherever a measure is used.
    judged = judged.withColumn("_row", F.monotonically_increasing_id())
    return judged.filter((F.col("_row") >= 0) & F.col("kept")).select(*[F.col(_own(c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


_N = len(CLASSES)
_TAKEN = "".join(f", r{k + 1} AS (SELECT *, regexp_replace(t{k}, '{c.replace(chr(39), chr(39) * 2)}', '', 'g') AS t{k + 1} FROM r{k})" for k, c in enumerate(CLASSES))
_COUNTS = ", ".join(f"length(t{k}) - " + (f"length(t{k + 1})" if k < _N else "0") + f" AS c{k}" for k in range(_N + 1))


def _js(a: str, b: str) -> str:
    p, q = f"({a}[k] / list_sum({a})::DOUBLE)", f"({b}[k] / list_sum({b})::DOUBLE)"
    term = lambda x: f"(CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0.0 END)"
    return f"round(sqrt(greatest(list_sum(list_transform(range(1, len({a}) + 1), lambda k: {term(p)} + {term(q)})) / 2, 0.0)), 9)"


ORACLE = rf"""
WITH base AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{SPACES}+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM base),
win AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(n - i, 8)))::BIGINT AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM again) GROUP BY doc_id),
r0 AS (SELECT doc_id, lang, text AS t0 FROM base){_TAKEN},
cls AS (SELECT doc_id, lang, {_COUNTS} FROM r{_N}),
clsall AS (SELECT lang, {", ".join(f"c{k}" for k in range(_N + 1))} FROM cls UNION ALL SELECT '*', {", ".join(f"c{k}" for k in range(_N + 1))} FROM cls),
refc AS (SELECT lang, [{", ".join(f"sum(c{k})" for k in range(_N + 1))}] AS rc FROM clsall GROUP BY lang),
tok AS (SELECT lang, unnest(list_transform(words, lambda x: lower(x))) AS word FROM w),
tokall AS (SELECT lang, word, count(*) AS n FROM tok GROUP BY ALL UNION ALL SELECT '*', word, count(*) AS n FROM tok GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r, sum(n) OVER (PARTITION BY lang) AS total FROM tokall) WHERE r <= {N_COMMON}),
refw AS (SELECT lang, list(word ORDER BY r) AS common, list_append(list(n ORDER BY r), (any_value(total) - sum(n))::BIGINT) AS rw, any_value(total) AS total FROM top GROUP BY lang),
refs AS (SELECT * FROM refw JOIN refc USING (lang) WHERE total >= {MIN_REFERENCE_WORDS} OR lang = '*'),
d AS (SELECT w.doc_id, w.text, len(w.words)::BIGINT AS n_words, length(array_to_string(w.words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(w.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(w.lines) - len(list_distinct(w.lines)))::BIGINT AS n_dup_lines,
        coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words,
        [{", ".join(f"cls.c{k}" for k in range(_N + 1))}] AS c, coalesce(a.rc, z.rc) AS rc, coalesce(a.rw, z.rw) AS rw,
        coalesce(a.common, z.common) AS common, list_transform(w.words, lambda x: lower(x)) AS lw
      FROM w JOIN cls USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN (SELECT * FROM refs WHERE lang <> '*') a ON w.lang = a.lang CROSS JOIN (SELECT * FROM refs WHERE lang = '*') z),
e AS (SELECT *, list_transform(common, lambda x: len(list_filter(lw, lambda y: y = x))) AS hits FROM d),
f AS (SELECT *, list_append(hits, n_words - list_sum(hits)::BIGINT) AS wc, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM e),
g AS (SELECT *, CASE WHEN length(text) >= {MIN_CHARS} THEN {_js("c", "rc")} END AS class_distance, CASE WHEN n_words >= {MIN_WORDS} THEN {_js("wc", "rw")} END AS word_distance FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(class_distance, 0) <= {MAX_CLASS_DISTANCE} AND coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} AS kept, class_distance, word_distance FROM g
"""
