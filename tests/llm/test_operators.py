"""Each operator against a brute-force version, SQL or the library itself, with the awkward cases."""

import base64
import collections
import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispan.llm import common, dartminhash, divergence, encoders, fmindex, imatch, mixing, packing, registry, secrets, sstable, transducer, warc
from lexispan.llm.common import documents, new_path, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string"


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def rows(duck):
    """Documents of the smallest scale with nulls, empty, very long, repeated and tied ones."""
    own = [r for r in duck.sql("SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 60").fetchall()]
    long = " ".join(r[1] for r in own[:20])
    more = [(1000, None, "en", "src0", None), (1001, "", None, None, 0), (1002, " \n\t ", "xx", "odd", 3), (1003, long * 3, "en", "src0", 1), (1004, "a b c", "de", "src1", 5), (1005, own[5][1], "en", "src0", 1), (1005, own[5][1], "en", "src0", 1), (1006, "x " * 300, "en", "src0", 600)]
    return [(*r, "k", "s") for r in own + more]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(name, spark, sf_dir, same):
    same(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name])


# 1

def test_table_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    manifest = sstable.write_table(docs, new_path(spark, "t"))
    want = sorted((r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows)
    got = sstable.read_table(manifest).orderBy("start").collect()
    assert [(r.key, np.frombuffer(r.ids, "<u2").tolist()) for r in got] == want
    assert [r.start for r in got] == list(np.cumsum([0] + [len(x) for _, x in want[:-1]]))
    found = sstable.lookup(manifest, spark.createDataFrame([(1003,), (77_777,), (1005,)], "key long")).collect()
    assert sorted(r.key for r in found) == [1003, 1005, 1005]


def test_table_of_nothing(spark, empty):
    assert sstable.read_table(sstable.write_table(empty, new_path(spark, "t"))).count() == 0


def test_shard_blocks(tmp_path):
    values = [(k, bytes([k % 251]) * (2 * (k % 40))) for k in range(-500, 3000)]
    uri = f"file://{tmp_path}/a.sst"
    sstable.write_shard(uri, values)
    s = sstable.Shard(uri)
    assert [(sstable.key_value(k), v) for k, v in s] == values and len(s.places) > 1
    assert all(s.get(sstable.key_bytes(k)) == [v] for k, v in values[::37])
    assert sum(s.may_hold(sstable.key_bytes(k)) for k in range(10_000, 12_000)) < 100
    assert sstable.key_bytes(None) < sstable.key_bytes(-(1 << 63)) < sstable.key_bytes(-1) < sstable.key_bytes(0)


# 3

def test_imatch(spark, docs, rows):
    got = imatch.fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: r[0])
    by = collections.defaultdict(list)
    for r in got:
        by[r.key].append(r)
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        if r[0] != 1005:
            (g,) = by[r[0]]
            assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    assert len(by[1005]) == 2 and by[1005][0].fingerprint == by[1005][1].fingerprint == by[5][0].fingerprint
    assert sum(g.near_edited for g in got) > 3 * sum(g.near_next for g in got)


def brute_fingerprints(rows, min_share, max_share):
    """(id, n_chars, sha, fingerprint, edited fingerprint, near_edited, near_next) of (id, text) rows, from the definition."""
    import struct

    import regex
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of_text = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    of_long = lambda v, seed=42: signed(xxhash.xxh64_intdigest(struct.pack("<q", v), seed & 0xFFFFFFFFFFFFFFFF))
    terms = lambda t: {of_text(x) for x in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if x}
    df = collections.Counter(x for _, t in rows for x in terms(t or ""))
    inside = {t for t, n in df.items() if max(2, min_share * len(rows)) <= n <= max(2, max_share * len(rows))}
    subsets = collections.defaultdict(list)
    for t in inside:
        for k, d in enumerate(imatch.DENSITIES):
            s = signed(xxhash.xxh64_intdigest(struct.pack("<i", k), of_long(t) & 0xFFFFFFFFFFFFFFFF)) % d
            if s < imatch.SUBSETS:
                subsets[t].append(s + k * imatch.SUBSETS)

    def fingerprint(text):
        held = collections.defaultdict(list)
        for t in terms(text):
            for s in subsets.get(t, ()):
                held[s].append(t)
        out = {}
        for s, ts in sorted(held.items()):
            h = None
            for t in sorted(ts):
                h = of_long(t) if h is None else of_long(t, of_long(h))
            out[s] = h & 65535
        return out

    def likeness(a, b, equal):
        x = None
        for k in range(len(imatch.DENSITIES)):
            either = [s for s in {*a, *b} if s // imatch.SUBSETS == k]
            if either and (k == 0 or len(either) >= imatch.MIN_SUBSETS):
                x = sum(a.get(s) == b.get(s) for s in either) / len(either)
        return float(equal) if x is None else x

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, of_text(r[1] or "")))
    text = lambda f: "".join(f"{s * 65536 + h:06x}" for s, h in f.items())
    out = []
    for i, (key, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        f, g, n = fingerprint(t), fingerprint(edited), fingerprint(after)
        out.append((key, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(f), text(g), round(likeness(f, g, t == edited), 9), round(likeness(f, n, t == after), 9)))
    return out


@pytest.mark.parametrize("bound", [(1 / 1000, 1 / 10), (1 / 50, 1 / 2)])
def test_imatch_by_brute_force(spark, rows, bound):
    """With null ids, a third of the rows under one id, and texts without terms of the lexicon."""
    more = [(None, rows[k][1], *rows[k][2:]) for k in (3, 9)] + [(7, " ".join(rows[k % 40][1].split()[k : 3 * k + 5]), *rows[0][2:]) for k in range(40)]
    every = rows + more
    got = imatch.fingerprints(spark.createDataFrame(every, SCHEMA).repartition(4), min_share=bound[0], max_share=bound[1]).collect()
    want = brute_fingerprints([r[:2] for r in every], *bound)
    assert collections.Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == collections.Counter(want)
    assert len({w[3] for w in want}) > 50 and any(0 < w[5] < 1 for w in want)


def test_hot_id_is_split(spark, rows):
    df = spark.createDataFrame([(5, f"text {k}", *rows[0][2:]) for k in range(300)] + [(k, "x", *rows[0][2:]) for k in range(100)], SCHEMA)
    sizes = {r[0]: r[1] for r in imatch.with_neighbours(df, "doc_id", "text").filter("NOT guest").groupBy("part").count().collect()}
    assert len(sizes) > 8 and max(sizes.values()) < 80


def test_imatch_of_nothing(empty):
    assert imatch.fingerprints(empty).count() == 0


def test_range_of(spark):
    bounds = [3, 7, 7, 20]
    got = [r[0] for r in spark.range(25).orderBy("id").select(imatch.range_of(F.col("id"), bounds)).collect()]
    assert got == [sum(b <= i for b in bounds) for i in range(25)]


# 4

def shingle_sets(text):
    w = (text or "").encode().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute_classes(rows):
    s, parent = [shingle_sets(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, total = sum((s[i] & s[j]).values()), sum((s[i] | s[j]).values())
            if (not total and (rows[i][1] or "").split() == (rows[j][1] or "").split()) or (total and both >= 0.8 * total):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)].append(r[0])
    return sorted((r[0], min(least[root(i)])) for i, r in enumerate(rows))


@pytest.mark.parametrize("hot", [1024, 3])
def test_near_duplicates(spark, rows, monkeypatch, hot):
    import random

    r, more = random.Random(1), []
    for n, base in enumerate([x for x in rows if 100 < len((x[1] or "").split()) < 400][:2]):
        for k in range(25):
            w = base[1].split()
            for _ in range(r.randint(1, 9)):
                w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
            more.append((5000 + 100 * n + k, " ".join(w), "en", "src0", 1, "k", "s"))
    every = rows + more
    df = spark.createDataFrame(every, SCHEMA).repartition(3).withColumns({"_k": F.lit("a"), "_h": F.lit("b"), "r": F.lit("c"), "k": F.lit("d")})
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    assert sorted(tuple(x) for x in dartminhash.classes(df).collect()) == brute_classes(every)
    one = dartminhash.one_of_each(df)
    assert one.columns == df.columns and {(x._k, x._h, x.r, x.k) for x in one.collect()} == {("a", "b", "c", "d")}
    assert sorted(x.doc_id for x in one.collect()) == sorted({c for _, c in brute_classes(every)})


def test_near_duplicates_without_ids(spark, rows):
    """Null ids: kept, and a class's id only where there is no other; one id with several texts is several documents."""
    text = rows[3][1]
    made = [(None, text), (7, text + " more"), (None, "other words that stand alone here"), (9, "first text of one id"), (9, "second words under the same number")]
    df = spark.createDataFrame([(k, t, *rows[0][2:]) for k, t in made], SCHEMA)
    assert sorted((str(k), str(c)) for k, c in dartminhash.classes(df).collect()) == [("7", "7"), ("9", "9"), ("9", "9"), ("None", "7"), ("None", "None")]
    one = collections.Counter(r.text for r in dartminhash.one_of_each(df).collect())
    assert one == collections.Counter([t for _, t in made[1:]])


def test_recall_against_all_pairs(spark):
    """Every pair of 0.8 or more among the thousand documents of the next scale, found by an inverted index of shingles."""
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()]
    sets, holders = [shingle_sets(t) for _, t in rows], collections.defaultdict(list)
    for i, x in enumerate(sets):
        for e in x:
            holders[e].append(i)
    shared = collections.Counter((i, j) for h in holders.values() if len(h) > 1 for j in h for i in h if i < j)
    size = [sum(x.values()) for x in sets]
    pairs = [(i, j) for i, j in shared if (both := sum((sets[i] & sets[j]).values())) >= 0.8 * (size[i] + size[j] - both)]
    of = {r.key: r.class_id for r in dartminhash.classes(spark.read.parquet(path)).collect()}
    found = sum(of[rows[i][0]] == of[rows[j][0]] for i, j in pairs)
    assert len(pairs) > 50 and found >= 0.99 * len(pairs)


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    left = spark.createDataFrame([(1, k) for k in range(500)] + [(k, 0) for k in range(2, 40)] + [(None, 3)], "k int, v int")
    right = spark.createDataFrame([(k, k * 10) for k in range(30)], "k int, w int")
    sizes = left.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got, want = common.spread_join(left, right, "k", ["v"], sizes, how), left.join(right, "k", how)
        assert got.columns == want.columns and collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want.collect()))


def test_near_duplicates_of_nothing(empty):
    assert dartminhash.classes(empty).count() == 0


def test_weighted_signatures():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 60).astype(np.uint64)
    a = rng.uniform(0.2, 3, 60)
    b = a * rng.uniform(0.4, 1.6, 60)
    s = dartminhash.signatures(np.repeat([0, 1], 60), np.concatenate([e, e]), np.concatenate([a, b]), 2, k=3000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


# 5

def test_quality_rules(spark, docs, rows, empty):
    got = collections.defaultdict(list)
    clashing = docs.withColumns({"_words": F.lit("own"), "n_words": F.lit("gone"), "_lang": F.lit(7)})
    judged = divergence.judge(clashing)
    assert judged.columns == [c for c in clashing.columns if c not in divergence.MADE] + list(divergence.MADE)
    for r in judged.collect():
        got[r.doc_id].append(r)
    assert {(r._words, r._lang) for x in got.values() for r in x} == {("own", 7)}
    assert len(got) == len({r[0] for r in rows}) and len(got[1005]) == 2
    for i, text, *_ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[i][0]
        assert (g.n_words, g.word_chars, g.n_repeat_words, g.n_dup_lines) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
        assert g.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
    assert not any(r.kept for r in got[1006])
    kept = divergence.accepted(clashing)
    assert kept.columns == clashing.columns and kept.count() > 30 and {r.n_words for r in kept.collect()} == {"gone"}
    fitted = divergence.references(docs.filter("lang = 'en'")).cache()
    alone = {r.doc_id: r.class_distance for r in divergence.judge(docs.filter("lang = 'en'")).collect()}
    assert all(r.class_distance == alone[r.doc_id] for r in divergence.judge(docs.filter("lang = 'en' AND doc_id < 30"), fitted=fitted).collect())
    assert divergence.accepted(empty).count() == 0


# 6

@pytest.mark.parametrize("size", [400, 1 << 19])
def test_repeats(docs, rows, size, monkeypatch):
    monkeypatch.setattr(fmindex, "INDEX_WORDS", size)
    got = fmindex.without_repeats(docs).select("key", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    want = fmindex.brute([r[:2] for k, r in enumerate(rows) if k == 0 or rows[k - 1] != r])
    assert sorted({tuple(r) for r in got}) == sorted(want)
    assert len(got) == len(rows)


def test_repeats_of_nothing(empty):
    assert fmindex.without_repeats(empty).count() == 0


def test_index_finds_all():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 5, 3000)
    bounds = np.array([0, 1000, 1700, 3000])
    index = fmindex.FMIndex(codes, bounds)
    seqs = [codes[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for length in (1, 3, 6):
        low, high, matched = index.search(np.arange(19, 1000), length)
        for k in range(0, len(low), 97):
            p = codes[19 + k - length + 1 : 19 + k + 1].tolist()
            places = [int(bounds[q]) + q + i for q, s in enumerate(seqs) for i in range(len(s) - length + 1) if s[i : i + length] == p]
            if len(places) > 1:
                assert matched[k] == length and sorted(index.locate(np.arange(low[k], high[k])).tolist()) == places
            else:
                assert matched[k] < length and high[k] - low[k] == 1


def test_hot_minimizer_is_split(spark, monkeypatch):
    """One 6-gram in thousands of contexts, some of them alike: no more than an index's words under one key, and the right answer."""
    import random

    monkeypatch.setattr(fmindex, "INDEX_WORDS", 4000)
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    grams = [[word() for _ in range(6)] for _ in range(40)]
    lowest = min(grams, key=lambda g: int(fmindex.Segments([" ".join(["x"] * 14 + g + ["x"] * 14)]).minimizer.min()))
    made, texts = [], []
    for _ in range(3000):
        if made and r.random() < 0.2:
            left, right = r.choice(made)
            left, right = ([word() for _ in range(20)], right) if r.random() < 0.5 else (left, [word() for _ in range(20)])
        else:
            left, right = ([word() for _ in range(20)] for _ in range(2))
        made.append((left, right))
        texts.append(" ".join([*left, *lowest, *right]))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = df.selectExpr("doc_id AS k", "xxhash64(text) AS h", "text")
    marks = fmindex.mark_repeated(keyed)
    most = fmindex.sent_segments(keyed, *marks).dropDuplicates(["m", "c"]).groupBy("m").agg(F.sum(F.length("codes") / fmindex.CODE_BYTES).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 4000
    got = fmindex.without_repeats(df).select("key", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    want = fmindex.brute(rows)
    assert sorted(map(tuple, got)) == sorted(want) and sum(w[2] > 0 for w in want) > 300


# 7

def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = collections.Counter((r[0], p, a, tuple((t.encode(r[1] or "", add_special_tokens=False).ids + [0])[a : a + 2048])) for r in rows for p, a in enumerate(range(0, len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1, 2048)))
    got = packing.pack(docs).collect()
    assert collections.Counter((r.key, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u2").tolist())) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= sum(r.length for r in got) // 2048 + 2
    assert packing.pack(empty).count() == 0


def test_plan_uses_every_piece():
    h = collections.Counter({700: 10, 690: 3, 650: 5, 50: 7, 2048: 2, 1: 1})
    plan, used = packing.make_plan(h), collections.Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 2048
        used.update({n: pattern.count(n) * times for n in set(pattern)})
    assert used == h
    assert sum(packing.fullest({5: 2, 3: 4}, 11)) == 11


# 8

def test_shares_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 10), ("web", "de", "b", 1000), ("forum", "en", "c", 1000), ("reference", "en", "d", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.budgets(leaves, 50, 1).collect()}
    assert got["a"] == 10  # all that it has; the rest of its domain's share goes to b
    assert got["b"] == 752 - 10 and got["c"] == 451 and got["d"] == 301


def test_mixing(docs, empty):
    got = mixing.choose(docs).collect()
    assert all(r._taken <= r._copies * r._tokens for r in got)
    total = sum(r._tokens for r in got)
    assert sum(r._taken for r in got) <= total * 90 // 100
    assert sum(r._taken for r in got) > total * 70 // 100
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.choose(empty).count() == 0


@pytest.mark.parametrize("percent", [7, 90, 130])
def test_prefixes_by_brute_force(spark, rows, percent):
    """Null ids, one id for many texts, equal rows, and columns named as the operator's own."""
    more = [(None, f"null {k} " * (k % 4), "en", "src0", 1, "k", "s") for k in range(9)] + [(7, f"same {k} " * k, "en", "src0", 1, "k", "s") for k in range(40)] + [(8, "equal row", "en", "src0", 1, "k", "s")] * 5
    every = rows + more
    df = spark.createDataFrame(every, SCHEMA).repartition(3).withColumns({"_order": F.lit("o"), "_tokens": F.lit("t"), "r": F.lit(1), "place": F.lit(2), "rest": F.lit(3)})
    got = mixing.choose(df, percent=percent)
    assert got.columns == [c for c in df.columns if c != "_tokens"] + list(mixing.MADE)
    got = got.collect()
    assert {(r._order, r.r, r.place, r.rest) for r in got} == {("o", 1, 2, 3)} and len(got) == len(every)
    by = collections.defaultdict(list)
    for r in got:
        by[r._domain, r._lang, r._source].append(r)
    for leaf in by.values():
        total = sum(r._tokens for r in leaf)
        budget = sum(r._taken for r in leaf)
        if not total:
            continue
        whole, rest = divmod(budget, total)
        name = lambda r: hashlib.md5(f"{mixing.SEED}:{whole}:{'' if r.doc_id is None else r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()[:15]  # noqa: B023, E731
        so, want = 0, collections.Counter()
        for r in sorted(leaf, key=lambda r: (name(r), r._tokens)):
            want[r.doc_id, r.text, whole + (so < rest), whole * r._tokens + max(0, min(r._tokens, rest - so))] += 1
            so += r._tokens
        assert collections.Counter((r.doc_id, r.text, r._copies, r._taken) for r in leaf) == want
    taken = mixing.mixed(df, percent=percent)
    assert taken.columns == df.columns and taken.count() == sum(r._copies for r in got)


# 9

def der(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def test_secret_structures():
    key = der(0x30, b"".join(der(2, b"\x01" * n) for n in (1, 64, 3, 64)))
    b64 = base64.b64encode(key).decode()
    ssh = base64.b64encode(b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"k" * 32))).decode()
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.c2ln"
    kinds = lambda t: [k for *_, k in secrets.scan(t)]
    assert "der" in kinds(f"key {b64} end") and "ssh" in kinds(f"ssh-ed25519 {ssh} me") and "jwt" in kinds(f"token {jwt}") and "der" in kinds(key.hex())
    blank = base64.urlsafe_b64encode(b'{ "alg": "ES256" }').decode().rstrip("=")
    lines = base64.urlsafe_b64encode(b'{\n"alg": "ES256"}').decode().rstrip("=")
    assert all("jwt" in kinds(f"x {h}.{part({'sub': 1})}.c2ln y") for h in (blank, lines))
    field = lambda x: len(x).to_bytes(4, "big") + x
    public = b"".join(map(field, (b"ssh-ed25519", b"k" * 32)))
    private = lambda cipher, kdf, options, secret, n=1: b"openssh-key-v1\0" + b"".join(map(field, (cipher, kdf, options))) + n.to_bytes(4, "big") + field(public) + field(secret)
    good = [private(b"none", b"none", b"", b"abcdabcd" + b"s" * 40), private(b"aes256-ctr", b"bcrypt", b"o" * 24, b"s" * 48)]
    bad = [b"openssh-key-v1\0garbage that is no key at all", private(b"none", b"none", b"", b"abcdabce" + b"s" * 40), private(b"none", b"bcrypt", b"o", b"abcdabcd"), private(b"none", b"none", b"", b"abcdabcd", 2), good[0] + b"\0", good[0][:-1], private(b"none", b"none", b"", b"abcdabcd" + b"s" * 41)]
    assert all(secrets.is_ssh_key(x) for x in good) and not any(secrets.is_ssh_key(x) for x in bad)
    assert kinds(base64.b64encode(good[0]).decode()) == ["ssh"] and not kinds(base64.b64encode(bad[0]).decode())
    armour = base64.encodebytes(good[1]).decode()
    assert kinds(f"-----BEGIN OPENSSH PRIVATE KEY-----\n{armour}-----END OPENSSH PRIVATE KEY-----") == ["pem"]
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{b64[:64]}\n{b64[64:]}\n-----END RSA PRIVATE KEY-----"
    assert kinds(pem)[0] == "pem"
    broken = base64.b64encode(key[:-3]).decode()
    assert not {"der", "pem", "jwt", "ssh"} & set(kinds(f"{broken} eyJhbGciOi.eyJ.x {'A' * 60} {'ab' * 40}"))


def test_secret_spans(docs, rows, empty):
    got = collections.defaultdict(list)
    for r in secrets.with_spans(docs).collect():
        got[r.doc_id].append([(s.start, s.end, s.kind) for s in r.spans])
    for i, text, *_ in rows:
        want = []
        for kind, p, ok, flags in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12, re.I | re.A), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18, 0), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16, 0)):
            want += [(m.start(), m.end(), kind) for m in re.finditer(p, text or "", flags) if ok(m)]
        assert [s for s in got[i][0] if s[2] in secrets.KINDS[:3]] == sorted(want, key=lambda s: (s[0], secrets.KINDS.index(s[2])))
    assert secrets.with_spans(docs).columns == [c for c in docs.columns if c != "spans"] + ["spans"]
    assert secrets.masked(docs).columns == docs.columns and secrets.masked(empty).count() == 0


# 10

def test_token_counts(docs, rows, empty):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(transducer.MODEL))
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in transducer.with_counts(docs).collect())
    assert got == collections.Counter((r[0], len((r[1] or "").encode()), len(m.encode(r[1] or ""))) for r in rows)
    assert transducer.with_counts(empty).count() == 0


@pytest.mark.parametrize(("chunk", "trace"), [(13, 4096), (13, 3), (200, 150), (1 << 16, 4096)])
def test_chunks_compose(rows, monkeypatch, chunk, trace):
    import random

    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(transducer.MODEL))
    monkeypatch.setattr(transducer, "CHUNK", chunk)
    monkeypatch.setattr(transducer, "TRACE", trace)
    t, r = transducer.Transducer.load(transducer.MODEL), random.Random(8)
    odd = ["".join(r.choice([*"aetinsr .\n\t\0▁日é", "  ", " the", "ing"]) for _ in range(r.randint(0, 90))) for _ in range(300)]
    for text in ["a" * 100, "   x    y ", "▁▁ a", "日本語 text <0x0A> </s>", "é\n\n\tü", rows[3][1][:2000], "".join(r.choice("abcdeinrst") for _ in range(3000)), *odd]:
        assert t.count(text) == len(m.encode(text))


def test_pairs_by_merging():
    import random

    t, r = transducer.Transducer.load(transducer.MODEL), random.Random(2)
    pieces = [p for p in t.score if len(p) < 7]
    short = [p for p in pieces if len(p) < 3 and p.isascii()]
    for a, b in [(r.choice(short), r.choice(short)) for _ in range(2000)] + [(r.choice(pieces), r.choice(pieces)) for _ in range(2000)]:
        assert t.may_follow(a, b) == (t.merged(a + b) == [a, b])


def test_chunk_maps_meet_soon():
    """Without any cut a chunk entered in another state is run for a few characters only."""
    t = transducer.Transducer.load(transducer.MODEL)
    text = "".join(chr(97 + k * k % 19) for k in range(4000))
    later, steps = t.chunk(text[2000:]), []
    run = t.run
    t.run = lambda state, x: steps.append(len(x)) or run(state, x)
    assert later(t.chunk(text[:2000]).exit[0])[1] > 100
    assert 2000 < sum(steps) < 2000 + 100  # the first chunk's own run, and the second's until the states agree


def test_memory_is_bounded_in_bytes():
    import pyarrow as pa

    e = encoders.CachedEncoder("byte_bpe_50k.json")
    e.words.most = 1 << 20
    texts = ["".join(chr(97 + (k * 7 + j * j) % 26) for j in range(20_000)) for k in range(40)] + [" ".join(f"w{k}x{j}" for j in range(400)) for k in range(60)]
    assert sum(map(len, e.encode(pa.array(texts)))) > 0
    assert max(map(len, [*e.words.young, *e.words.older])) <= encoders.LONG_WORD
    kept = sum(encoders.ENTRY_BYTES + 2 * len(k) + len(v) for d in (e.words.young, e.words.older) for k, v in d.items())
    assert kept < 3 * e.words.most + (encoders.ENTRY_BYTES + 40) * (1 << 14)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name, rows):
    e = encoders.CachedEncoder(name)
    odd = ["a  b\n\n c", "\0 a\0b", "İstanbul, ǅ. ʼn;", "\ta b", "x  y", "<|endoftext|> a <|endoftext|>", "", " ", "\n", " a ", "é ́x", "\x1c a", "a\r\n b", "it's  'S don't　 x1234 ", "Don'T Éa ſ K"]
    texts = odd + [r[1] or "" for r in rows]
    assert e.ids(texts) == [np.array(x.ids, "<u2").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_null_ids_and_clashing_names(spark, rows):
    """Every operator keeps rows without an id, and columns named as its own helpers."""
    names = ("key", "ids", "start", "piece", "length", "local", "task", "h", "k", "m", "c", "n_bytes", "starts", "masks", "part", "place", "kept")
    made = [(None, rows[4][1]), (None, None), (None, rows[4][1]), (3, "some words"), (3, rows[9][1])]
    df = spark.createDataFrame([(*x, *rows[0][2:5]) for x in made], "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(f"own {n}") for n in names}).repartition(2)
    count = collections.Counter(k for k, _ in made)
    assert collections.Counter(r.key for r in sstable.read_table(sstable.write_table(df, new_path(spark, "t"))).collect()) == count
    assert len(sstable.lookup(sstable.write_table(df, new_path(spark, "t")), spark.createDataFrame([(None,), (3,), (4,)], "key long")).collect()) == 5
    assert collections.Counter(r.key for r in imatch.fingerprints(df).collect()) == count
    assert collections.Counter(r.key for r in dartminhash.classes(df).collect()) == count
    assert collections.Counter(r.key for r in fmindex.without_repeats(df).collect()) == count
    assert collections.Counter(r.key for r in packing.pack(df).filter("piece = 0").collect()) == count
    for out, new in ((divergence.judge(df), divergence.MADE), (mixing.choose(df), mixing.MADE), (secrets.with_spans(df), ("spans",)), (transducer.with_counts(df), ("n_bytes", "n_tokens"))):
        got = out.collect()
        assert collections.Counter(r.doc_id for r in got) == count
        assert all(r[n] == f"own {n}" for r in got for n in names if n not in new)
        assert set(out.columns) == {*df.columns, *new}


def test_documents_reader(spark, sf_dir):
    assert documents(spark, sf_dir).columns[:2] == ["doc_id", "text"]


# 2

RECORDS = "record_id string, type string, url string, date long, status int, headers array<struct<name:string,value:string>>, verdict string, part int, u string"


def brute_revisits(rows):
    """What resolve() must say of (id, type, key, date, status, headers)."""
    head = lambda h, n: next((v for k, v in h or () if k.lower() == n), None)
    out = []
    for i, kind, key, date, status, h in rows:
        if kind == "response" and status == 200:
            out.append((i, "full", None, h or []))
            continue
        if kind != "revisit":
            out.append((i, "other", None, None))
            continue
        before = [r for r in rows if r[1] == "response" and r[4] == 200 and key and r[2] == key and None not in (date, r[3]) and r[3] < date]
        if not before:
            out.append((i, "no_earlier_response", None, None))
            continue
        t = max(before, key=lambda r: (r[3], r[0]))
        agree = None
        if head(h, "etag") and head(t[5], "etag"):
            agree = head(h, "etag").removeprefix("W/") == head(t[5], "etag").removeprefix("W/")
        elif head(h, "last-modified") and head(t[5], "last-modified"):
            agree = head(h, "last-modified") == head(t[5], "last-modified")
        new = [x for x in h or () if x[0].lower() in warc.PERMITTED]
        merged = [x for x in t[5] or () if x[0].lower() not in {k.lower() for k, _ in new}] + new
        out.append((i, "unverified", t[0], None) if agree is None else (i, "resolved", t[0], merged) if agree else (i, "validator_mismatch", None, None))
    return out


def test_revisits(spark):
    import random

    r, rows = random.Random(4), []
    keys = ["hot.org/x", "a.org", None]
    for n in range(400):
        key = r.choices(keys, [6, 2, 1])[0]
        kind, status = r.choice([("response", 200), ("revisit", 304), ("revisit", 304), ("response", 404), ("request", None)])
        h = r.choice([None, [("ETag", f'"{r.randint(0, 1)}"'), ("Content-Length", "9"), ("Date", str(n))], [("etag", f'W/"{r.randint(0, 1)}"'), ("Last-Modified", "m")], [("Last-Modified", r.choice("mn")), ("Set-Cookie", "c"), ("Vary", "a"), ("vary", "b")]])
        rows.append((f"i{n:03d}", kind, key, r.choice([None, *range(30)]), status, h))
    spelt = {"hot.org/x": ["http://www.HOT.org/x/", "https://hot.org:443/x?utm_a=1#q", "hot.org/x"], "a.org": ["http://u:p@a.org", "https://A.org/"], None: [None, "", "/only/path"]}
    made = [(i, k, r.choice(spelt[u]), d, s, h, "v", 1, "u") for i, k, u, d, s, h in rows]
    df = spark.createDataFrame(made, RECORDS).repartition(5)
    got = warc.resolve(df)
    assert got.columns == [c for c in df.columns if c != "verdict"] + ["canonical_url", "verdict", "target_id", "target_date", "merged_headers"]
    found = {x.record_id: (x.record_id, x.verdict, x.target_id, None if x.merged_headers is None else [tuple(h) for h in x.merged_headers]) for x in got.collect()}
    want = brute_revisits(rows)
    assert len(found) == len(want) and {v for _, v, *_ in want} == {"full", "other", "no_earlier_response", "unverified", "resolved", "validator_mismatch"}
    assert [found[w[0]] for w in want] == want
    assert {(x.part, x.u) for x in got.collect()} == {(1, "u")}
    twice = warc.resolve(df.unionByName(df)).filter("verdict = 'resolved'").count()
    assert twice == 2 * sum(w[1] == "resolved" for w in want)
    assert warc.resolve(df.limit(0)).count() == 0


def test_canonical_urls(spark):
    cases = {"HTTP://WWW2.Example.com:80/A/b//?b=2&utm_source=x&a=1#f": "example.com/A/b?a=1&b=2", "https://x.org:8443/p;jsessionid=1?sid=3": "x.org:8443/p", "ftp://x.org./": "x.org", "mailto": "mailto", "": None, "?q": None}
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.c for r in df.withColumn("c", warc.canonical(F.col("url"))).collect()} == cases


def test_warc_files(spark, tmp_path):
    import gzip

    records = [
        {"record_id": "<urn:1>", "type": "response", "url": "http://a.org/", "date": "2024-01-01T00:00:00Z", "profile": None, "status": 200, "headers": [("ETag", '"x"'), ("Date", "d1")], "payload": b"body \r\n\r\n WARC/1.1 \0"},
        {"record_id": "<urn:2>", "type": "revisit", "url": "https://www.a.org", "date": "2024-01-01T00:00:00.5Z", "profile": "http://netpreserve.org/warc/1.1/revisit/server-not-modified", "status": 304, "headers": [("ETag", 'W/"x"'), ("Date", "d2")], "payload": b""},
        {"record_id": "<urn:3>", "type": "metadata", "url": None, "date": "2024-01-02T00:00:00Z", "profile": None, "status": None, "headers": [], "payload": b"m"},
        {"record_id": "<urn:4>", "type": "revisit", "url": "http://a.org/", "date": "2024-01-03T00:00:00Z", "profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "status": 200, "headers": [], "payload": b""},
    ]
    with open(tmp_path / "a.warc.gz", "wb") as f:
        for r in records:
            with gzip.GzipFile(fileobj=f, mode="wb") as z:
                warc.write(z, [r])
    with open(tmp_path / "b.warc", "wb") as f:
        f.write(b"\r\n")
        warc.write(f, records)
        f.write(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort")
    for name in ("a.warc.gz", "b.warc"):
        df = warc.read(spark, spark.createDataFrame([(f"file://{tmp_path}/{name}",)], "uri string")).cache()
        got = df.collect()
        assert [(r.record_id, r.type, r.url, r.status, [tuple(h) for h in r.headers], bytes(r.payload)) for r in got] == [(r["record_id"], r["type"], r["url"], r["status"], r["headers"], r["payload"]) for r in records]
        done = {r.record_id: r for r in warc.with_payload(warc.resolve(df.drop("payload")), df).collect()}
        assert [done[r["record_id"]].verdict for r in records] == ["full", "resolved", "other", "other"]
        assert bytes(done["<urn:2>"].payload) == records[0]["payload"] and [tuple(h) for h in done["<urn:2>"].merged_headers] == [("ETag", 'W/"x"'), ("Date", "d2")]
