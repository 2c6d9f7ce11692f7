"""Best-fit packing by minimum bin slack.

Documents become pieces of at most `capacity` tokens; only longer ones are cut. Bins depend on lengths alone, and there
are at most `capacity` lengths, so the plan is made from a histogram: for a bin that opens with the longest length left,
subset sums over the lengths left (a bitset, every length with its count) give the fullest combination that fits; the
combination is taken out as often as the counts allow, and so on. The plan lists, for each length, ranges of ranks and the bins that they
go to. A piece's rank among those of its length is its place within its write task plus what the tasks before it
hold of that length. So tokens are never shuffled, no group of pieces meets in one task, and the plan's size is bounded by
the square of the capacity, whatever the number of documents.

Defined cases: null text counts as empty (one piece of the end id alone); very long texts are encoded in stretches cut at
white space and give many pieces; null, equal and repeated ids are kept, each row's pieces numbered for itself, and repeated rows
are packed each for itself; pieces of one length (ties) are interchangeable; columns other than id and text are not read, whatever
their names; an empty table gives no pieces.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc32_ids, cut, documents, filesystem, new_path
from .encoders import encoder

VOCABULARY, END_ID, CAPACITY = "word_bpe_49k.json", 0, 2048


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """A combination of lengths with the greatest sum within room, each length at most as often as counted; the longest lengths are preferred."""
    lengths = sorted((n for n in counts if n <= room and counts[n] > 0), reverse=True)
    full, reach, layers, mask = 1 << room, 1, [], (1 << room + 1) - 1
    for n in lengths:
        before = reach
        left, size = min(counts[n], room // n), 1
        while left > 0:  # a bounded number of copies, by powers of two
            step = min(size, left)
            reach |= reach << n * step & mask
            left, size = left - step, size * 2
        layers.append((n, before))
        if reach & full:
            break
    total, out = reach.bit_length() - 1, []
    for n, before in reversed(layers):
        # as many copies as are needed to come down to a sum that the lengths before reach
        while total and not before >> total & 1:
            out.append(n)
            total -= n
    return out


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many such bins), by minimum bin slack with the longest length left as each bin's first."""
    left = Counter({n: c for n, c in histogram.items() if c > 0})
    plan: list[tuple[list[int], int]] = []
    while left:
        first = max(left)
        left[first] -= 1
        pattern = [first, *fullest(left, capacity - first)]
        left[first] += 1
        uses = Counter(pattern)
        times = min(left[n] // u for n, u in uses.items())
        plan.append((sorted(pattern, reverse=True), times))
        for n, u in uses.items():
            left[n] -= u * times
            if not left[n]:
                del left[n]
    return plan


def places(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, arrays (first rank, copies a bin, first bin, offset of the first copy): rank r of a range lies in bin first + (r - start) // copies."""
    ranges, bins, used = defaultdict(list), 0, Counter()
    for pattern, times in plan:
        at = 0
        for n in dict.fromkeys(pattern):
            u = pattern.count(n)
            ranges[n].append((used[n], u, bins, at))
            used[n] += u * times
            at += u * n
        bins += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in ranges.items()}


def read_offsets(uri: str, capacity: int) -> np.ndarray:
    """Pieces of each length in the tasks before one, from that task's file."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = filesystem(uri)
    out = np.zeros(capacity + 1, np.int64)
    for f in system.get_file_info(fs.FileSelector(path)):
        if f.path.endswith(".parquet"):
            with system.open_input_file(f.path) as file:
                t = pq.read_table(file)
            out[t.column("length").to_numpy()] = t.column("before").to_numpy()
    return out


def pieces(docs: DataFrame, key: str, text: str, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """key, piece, start, length, ids (unsigned 16-bit), ids_crc32 and the place (task, local) of a piece among those of its length."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, seen, e = TaskContext.get().partitionId(), Counter(), encoder(vocabulary)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        schema = pa.schema(list(zip(("key", "piece", "start", "length", "ids", "ids_crc32", "local", "task"), types, strict=True)))
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for i, ids in zip(b.column(0).to_pylist(), e.encode(b.column(1), end), strict=True):
                for p, at in enumerate(range(0, len(ids), 2 * capacity)):
                    own = ids[at : at + 2 * capacity]
                    n = len(own) // 2
                    rows.append((i, p, at // 2, n, own, crc32_ids(np.frombuffer(own, "<u2")), seen[n], task))
                    seen[n] += 1
                size += len(ids)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key bigint, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, local bigint, task int")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: key, piece, start, length, ids, ids_crc32, sequence_id, offset."""
    done = cut(pieces(docs, key, text, vocabulary, end_id, capacity), "op7-pieces")
    counts = cut(done.groupBy("length", "task").agg(F.count("*").alias("n")), "op7-counts")
    # at most `capacity` rows
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    where = places(make_plan(histogram, capacity))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # One small file for each write task, of at most `capacity` rows; a reader opens only those of the tasks that it reads.
    offsets = new_path(docs.sparkSession, "op7-offsets")
    before.select("task", "length", "before").repartition("task").write.partitionBy("task").parquet(offsets)

    def run(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        for b in columns:
            length, local, task = (c.to_numpy() for c in b)
            rank = local.copy()
            for k in np.unique(task):
                if k not in known:
                    known[k] = read_offsets(f"{offsets}/task={k}", capacity)
                rank[task == k] += known[k][length[task == k]]
            bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                start, copies, first, place = where[int(n)]
                k = np.searchsorted(start, rank[at], "right") - 1
                turn = rank[at] - start[k]
                bins[at], offset[at] = first[k] + turn // copies[k], place[k] + turn % copies[k] * n
            yield pd.DataFrame({"sequence_id": bins, "offset": offset})

    # only lengths and ranks go to Python here; ids stay where they are, and aren't read where they aren't asked for
    place = F.pandas_udf(run, "sequence_id bigint, offset bigint")
    return done.withColumn("_p", place("length", "local", "task")).select("key", "piece", "start", "length", "ids", "ids_crc32", "_p.sequence_id", "_p.offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).drop("ids").withColumnRenamed("key", "doc_id")
