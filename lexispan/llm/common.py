"""What the operators of this subpackage share: the shared folder, written cuts, words and hashes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+`` as a Java and RE2 class.
SPACES = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where none is set and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexispan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """pyarrow file system and path of a URI, for the operators that write files of their own format."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


#: Rows of one key from which on a join deals them out, and the number of such keys that there can be at most.
HOT_ROWS, HOT_KEYS = 1024, 8192


def spread_join(left: DataFrame, right: DataFrame, key: str, by: list[str], sizes: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row at most for each key; sizes (key, n), written already, has the rows of left by key.

    Rows of a key that has more than its share are dealt out by a hash of `by`, and right's row goes along to each of these parts. Keys
    with over total / HOT_KEYS rows are fewer than HOT_KEYS, so their list may be broadcast whatever the input."""
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    limit = max(HOT_ROWS, total // HOT_KEYS)
    if most <= limit:
        return left.join(right, key, how)
    hot = F.broadcast(sizes.filter(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("_parts")))
    dealt = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [key, "_part"], how).drop("_part")


def words_column(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, null giving none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")


def bind(value: Column, body) -> Column:
    """body(value) with value computed once: lambda variables are never inlined by the optimizer."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; names with a slash are paths already."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, wrapping)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, b in enumerate((_BASE, _INVERSE)):
                t = np.full(n, b, np.uint64)
                t[0] = 1
                _powers[k] = np.multiply.accumulate(t)
    return _powers[0][:n], _powers[1][:n]


_SPAN_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of a UTF-8 buffer, words being runs of other than ASCII white space.

    Long buffers are taken in stretches cut at white space, so that memory follows the stretch, not the text."""
    out, at = [], 0
    while at < len(data):
        cut_at = _SPACE.search(data, at + _SPAN_BYTES)
        to = cut_at.end() if cut_at else len(data)
        s, e, h = _word_spans(data[at:to])
        out.append((s + at, e + at, h))
        at = to
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, end, np.empty(0, np.uint64)
    up, down = _power_tables(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        return start, end, mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def joined_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of several texts, one text after another, and where each text's words begin (one place more at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    start, _, h = word_spans(b" ".join(raw))
    bounds = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw])))
    return h, np.searchsorted(start, bounds[: len(texts) + 1])


def slices(sizes: list[int], most: int):
    """(from, to) of runs of items whose sizes add up to about `most`."""
    at = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            yield at, k + 1
            at, total = k + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def crc32_ids(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()) & 0xFFFFFFFF


def with_computed(df: DataFrame, inputs: list[str], fields: dict[str, str], make, arrow: bool = False) -> DataFrame:
    """df with columns that make(*lists of input values) returns as a list of lists or arrays, batch by batch in Python.

    With arrow set, make gets Arrow arrays instead of lists. All other columns pass through as Arrow data; a column of df that has the name of a new one is replaced."""
    import pyarrow as pa
    from pyspark.sql import types as T

    base = df.select([c for c in df.columns if c not in fields or c in inputs])
    kept = [c for c in base.columns if c not in fields]
    extra = T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in fields.items()))
    schema = T.StructType([base.schema[c] for c in kept] + extra.fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in extra]
        for b in batches:
            given = [b.column(b.schema.get_field_index(c)) for c in inputs]
            made = make(*(given if arrow else [c.to_pylist() for c in given]))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in kept] + [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(made, types, strict=True)], names=schema.names)

    return base.mapInArrow(run, schema)
