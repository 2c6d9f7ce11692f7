"""Near-duplicates by DartMinHash.

A document is the multiset of its five-word shingles, a shingle's count being its weight. Darts are thrown, by hashing, at
each element's region (weight by rank); those within the weight count. Each dart belongs to one coordinate of the
signature, which keeps its dart of the lowest rank, so two documents agree in a coordinate with the probability of their
weighted Jaccard similarity. Ranks are cut into layers of doubling size, and a document throws layers until about
k ln k + 2k darts have come and every coordinate has one: work is k log k and the number of elements, not their product.

Documents with equal words are one node. Nodes whose signatures agree in a band share a bucket. In each bucket all nodes are
held against its most connected one (a star, not all pairs); exact similarity decides. Buckets that still hold several
components are then searched block by block for pairs of different components whose signatures agree enough, and
those are decided exactly as well. Components of the links are the classes. Joins on nodes, buckets, centres and components deal out the
rows of a key that has many (common.spread_join); everything else about a key is an aggregate that is combined before the shuffle.

Defined cases: null text counts as empty; texts without words are copies of one another; texts of one to four words have the
one shingle of all their words; very long texts are read whole; repeated rows give one row each; null ids are kept and never become a
class's id unless all its ids are null. Of copies (ties) the least id stays, of one id the least hash of the text, of equal rows any one.
Columns other than id and text pass through one_of_each whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, joined_words, mix, slices, spread_join
from .graph import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 26, 5
K = BANDS * ROWS
#: Agreement of signatures from which on a pair is decided exactly: 0.8 less 5 standard deviations.
ESTIMATE = 0.62
BLOCK, BLOCK_ELEMENTS = 512, 1 << 20
_LAYER = 2.0**-5


def shingles(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the distinct shingles of several texts, sorted by document and hash."""
    words, at = joined_words(texts)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(texts)), n)
    index = np.arange(len(words)) - np.repeat(at[:-1], n)
    h = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            w = np.zeros(len(words), np.uint64)
            w[: len(words) - j] = words[j:] if j else words
            # words beyond the document's end count as absent: only texts of fewer words have such a shingle
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(index + j < n[doc], w, np.uint64(0)) + np.uint64(j + 1))
    keep = (index + width <= n[doc]) | ((index == 0) & (n[doc] < width))
    doc, h = doc[keep], h[keep]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.empty(0, np.int64)
    return doc[first], h[first], np.diff(np.concatenate((first, [len(h)])))


_cdf: dict[float, np.ndarray] = {}


def poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson numbers of a mean by inversion of uniform ones."""
    if mean not in _cdf:
        n = int(mean + 12 * math.sqrt(mean) + 12)
        logs = np.arange(n) * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in range(n)])
        _cdf[mean] = np.cumsum(np.exp(logs))
    return np.searchsorted(_cdf[mean], u, "right")


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """n_docs x k signatures of weighted sets given as (document, element hash, weight > 0) rows; those of empty sets are 0."""
    out = np.zeros((n_docs, k), np.uint64)
    cells = np.ceil(weight).astype(np.int64)
    row = np.repeat(np.arange(len(doc)), cells)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
    with np.errstate(over="ignore"):
        cell = mix(element[row] + turn.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        room = weight[row] - turn  # of the unit cell's weight; below 1 only in an element's last cell
        owner = doc[row]
        total = np.bincount(doc, weight, n_docs)
        darts = k * math.log(k) + 2 * k
        layers = np.where(total > 0, 1 + np.ceil(np.log2(np.maximum(1.0, darts / np.maximum(total, 1e-9) / _LAYER))), 0).astype(np.int64)
        filled = np.zeros((n_docs, k), bool)
        packed, s = [], 0
        active = total > 0
        while active.any():
            mine = active[owner] if not active.all() else slice(None)
            c, who, space = cell[mine], owner[mine], room[mine]
            mean = _LAYER if s == 0 else _LAYER * 2.0 ** (s - 1)
            seed = mix(c ^ np.uint64((s + 1) * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF))
            n = poisson((seed >> np.uint64(11)).astype(np.float64) * 2.0**-53, mean)
            at = np.repeat(np.arange(len(c)), n)
            number = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix(seed[at] + (number + 1).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
            if (space < 1).any():
                high = mix(dart ^ np.uint64(0x589965CC75374CC3)) >> np.uint64(11)
                hit = high.astype(np.float64) * 2.0**-53 < space[at]
                dart, at = dart[hit], at[hit]
            coordinate = ((dart & np.uint64(0x3FFFFF)) * np.uint64(k)) >> np.uint64(22)
            d = who[at]
            filled[d, coordinate.astype(np.int64)] = True
            packed.append(((d.astype(np.uint64) * np.uint64(k) + coordinate) << np.uint64(40)) | (np.uint64(min(s, 31)) << np.uint64(35)) | (dart >> np.uint64(29)))
            s += 1
            active = (total > 0) & ((s < layers) | ~filled.all(axis=1))
        if packed:
            p = np.sort(np.concatenate(packed))
            key = (p >> np.uint64(40)).astype(np.int64)
            first = np.concatenate(([True], key[1:] != key[:-1]))
            out.reshape(-1)[key[first]] = p[first] & np.uint64((1 << 40) - 1)
    return out


def sketch(texts: list[str]) -> tuple[list[bytes], list[np.ndarray], list[bytes]]:
    """For each text: 16 bytes that name its words, its band hashes (none without words), its signature in 16-bit pieces."""
    import xxhash

    nodes, bands, sigs = [], [], []
    for a, b in slices([len(t) for t in texts], 1 << 19):
        part = texts[a:b]
        doc, h, n = shingles(part)
        sig = signatures(doc, h, n.astype(np.float64), len(part))
        with np.errstate(over="ignore"):
            band = np.zeros((len(part), BANDS), np.uint64)
            for r in range(ROWS):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64)[None, :])
        has = np.bincount(doc, minlength=len(part)) > 0
        nodes += [xxhash.xxh3_128_digest(b" ".join(t.encode("utf-8", "surrogatepass").split())) for t in part]
        bands += [x if y else x[:0] for x, y in zip(band.view(np.int64), has, strict=True)]
        small = mix(sig).astype("<u2")
        sigs += [x.tobytes() for x in small]
    return nodes, bands, sigs


def sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for x, y in slices([1] * b.num_rows, 2000):
                part = b.slice(x, y - x)
                nodes, bands, sigs = sketch([t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["key", "h", "node", "bands", "signature"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("h"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key bigint, h bigint, node binary, bands array<bigint>, signature binary")


def element_arrays(rows: DataFrame) -> DataFrame:
    """node and elements (shingle and occurrence, hashed) from node and text: sets whose Jaccard similarity is the weighted one of the shingles."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for x, y in slices([len(t or "") for t in b.column(1).to_pylist()], 1 << 19):
                part = b.slice(x, y - x)
                doc, h, n = shingles([t or "" for t in part.column(1).to_pylist()])
                turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                with np.errstate(over="ignore"):
                    e = mix(np.repeat(h, n) + turn.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)).view(np.int64)
                at = np.concatenate(([0], np.cumsum(np.bincount(np.repeat(doc, n), minlength=part.num_rows))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(e))], names=["node", "elements"])

    return rows.select("node", "text").mapInArrow(run, "node binary, elements array<bigint>")


def verified(pairs: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose elements' Jaccard similarity is at least threshold."""
    x = elements.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    y = elements.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    shared = F.size(F.array_intersect("ea", "eb"))
    # the sizes alone rule out many
    near = F.least(F.size("ea"), F.size("eb")) >= threshold * F.greatest(F.size("ea"), F.size("eb"))
    sizes = cut(pairs.groupBy("b").agg(F.count("*").alias("n")), "op4-centres")
    joined = spread_join(pairs.join(x, "a"), y, "b", ["a"], sizes).filter(near)
    return joined.withColumn("s", shared).filter(F.col("s") >= threshold * (F.size("ea") + F.size("eb") - F.col("s"))).select("a", "b")


def block_links(rows: DataFrame, threshold: float, estimate: float) -> DataFrame:
    """Links (a, b) between nodes of one bucket and different components.

    rows: key, band, node, component, bands, signature, elements, size and weight (nodes and elements of the bucket). A bucket is dealt out
    as pairs of blocks of at most about BLOCK nodes and BLOCK_ELEMENTS elements, so a task's work is bounded whatever the bucket. A
    pair is taken up in the first band whose hash it shares, if its signatures agree enough, and decided exactly there: only links leave the task."""
    import pandas as pd

    n = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_ELEMENTS)).cast("int")
    own = rows.withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("node"), "n").cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def run(pdf):
        sig = np.frombuffer(b"".join(pdf["signature"]), "<u2").reshape(len(pdf), -1)
        bands = np.stack(pdf["bands"].to_numpy())
        parts, block, band = pd.factorize(pdf["component"])[0], pdf["block"].to_numpy(), pdf["band"].iloc[0]
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        elements = [np.asarray(e) for e in pdf["elements"]]
        size = np.array([len(e) for e in elements])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b, need = [], [], estimate * sig.shape[1]
        for x in left:
            other = right[(parts[right] != parts[x]) & ((right > x) | (i != j))]
            other = other[np.minimum(size[other], size[x]) >= threshold * np.maximum(size[other], size[x])]
            if not len(other):
                continue
            keep = ((bands[other] == bands[x]).argmax(axis=1) == band) & ((sig[other] == sig[x]).sum(axis=1) >= need)
            for y in other[keep]:
                shared = len(np.intersect1d(elements[x], elements[y], assume_unique=True))
                if shared >= threshold * (size[x] + size[y] - shared):
                    a.append(x)
                    b.append(y)
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"a": node[a] if a else [], "b": node[b] if b else []}, dtype=object)

    return dealt.select("key", "band", "i", "j", "block", "node", "component", "bands", "signature", "elements").groupBy("key", "i", "j").applyInPandas(run, "a binary, b binary")


def labelled_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, h (hash of the text) and component for every row of docs, written."""
    found = cut(sketched(docs, key, text), "op4-sketches")
    members = found.select("key", "h", "node")
    # a row for each node: its rows, and the one whose text is read for it
    copies = cut(members.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("key", F.lit(-(1 << 63))).alias("k"), "h")).alias("r")).select("node", "n", "r.*"), "op4-nodes")
    nodes = found.groupBy("node").agg(F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    banded = nodes.select("node", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("key"), "band", "node")
    shared = cut(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "op4-shared")
    # nodes that share no bucket are done
    buckets = cut(spread_join(banded, shared.withColumn("size", F.col("n")).drop("n"), "key", ["node"], shared), "op4-buckets")

    weight = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    centre = cut(buckets.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("b")), "op4-centre")
    star = spread_join(buckets, centre, "key", ["node"], shared).filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    star = cut(star, "op4-star")

    # one text for each node that shares a bucket
    chosen = copies.join(weight.select("node"), "node", "left_semi").select("node", "k", "h")
    texts = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    texts = texts.join(chosen, ["k", "h"]).select("node", "text")
    elements = cut(element_arrays(texts).dropDuplicates(["node"]), "op4-elements")
    links = cut(verified(star, elements, threshold), "op4-links")

    part = cut(components(links), "op4-components")
    labelled = buckets.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = labelled.join(elements.select("node", F.size("elements").alias("n_elements")), "node")
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.sum("n_elements").alias("weight"), F.count("*").alias("n")).filter("x <> y").select("key", "weight", "n")
    open_keys = cut(open_keys, "op4-open")
    rest = spread_join(labelled, open_keys.drop("n"), "key", ["node"], open_keys)
    rest = rest.join(nodes, "node").join(elements, "node")
    more = cut(block_links(rest, threshold, ESTIMATE), "op4-more")
    part = cut(components(links.unionByName(more)), "op4-classes")

    out = spread_join(members, part, "node", ["key", "h"], copies.select("node", "n"), "left")
    return cut(out.select("key", "h", F.coalesce("component", "node").alias("component")), "op4-labelled")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key and class_id (the least key of its class) for every row of docs."""
    rows = labelled_rows(docs, key, text, threshold)
    least = cut(rows.groupBy("component").agg(F.min("key").alias("class_id"), F.count("*").alias("n")), "op4-least")
    return spread_join(rows, least.drop("n"), "component", ["key", "h"], least).select("key", "class_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: that of the least id (null last), and of the least text hash if ids repeat."""
    rows = labelled_rows(docs, key, text, threshold)
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "h")).alias("r")
    chosen = cut(rows.groupBy("component").agg(first).select(F.coalesce("r.key", F.lit(-(1 << 63))).alias("k"), F.col("r.h").alias("h")).distinct(), "op4-chosen")
    named = docs.select(F.struct(*docs.columns).alias("r"), F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("h"))
    # dropDuplicates needs what the join has dealt out already
    return named.join(chosen, ["k", "h"], "left_semi").dropDuplicates(["k", "h"]).select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select(F.col("key").alias("doc_id"), "class_id")
