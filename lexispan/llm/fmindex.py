"""Repeated passages by compressed FM-indexes.

A window is WINDOW consecutive words. Each window belongs to its minimizer, the 6-gram of least hash in it, so
equal windows have equal minimizers; consecutive windows with one minimizer are a segment of at most 15 windows. Segments are
dealt to shards by their minimizer, which brings together every two windows that can be equal, and nothing is held against every shard.

A minimizer that is found once in the corpus rules its windows out. Those found again are marked in a bitmap in the shared
folder, of 16 bits for each and BITMAP_BITS at most; what it lets through wrongly costs work, not correctness. Of segments with
equal words only the earliest goes into a shard (each task leaves out those that it has sent earlier), so copies, however
many, never meet in a task. A second bitmap marks hot minimizers, found so often that their segments could fill an index: those segments
go out window by window, each dealt by the hash of its own 20 words, so the different contexts of one common 6-gram spread over all shards
and no index holds much more than INDEX_WORDS.

Each index is an FM-index: the Burrows-Wheeler transform of a shard's segments in a wavelet matrix of packed bits with block counts,
and every SAMPLE-th place of the suffix array; the suffix array itself is dropped once it is built. The segments are streamed
against it: each window is searched backwards, a word at a time, until it is found whole or only its own place is left; the words found by
then are its matching statistic. A window whose statistic reaches the threshold has an interval of suffixes; the places of each distinct
interval are located by walking to sampled ones, and the earliest document and start among them decide whether the window repeats an
earlier one. A segment whose earliest copy is elsewhere repeats it throughout.

Defined cases: null text has no words; texts shorter than a window keep all; very long texts are read whole; rows of one id are ordered
by the hash of their text, and equal rows (ties) get the same result, neither being earlier than the other; null ids come first; columns
other than id and text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _power_tables, cut, documents, filesystem, joined_words, mix, new_path, slices

WINDOW, GRAM = 20, 6
SPAN = WINDOW - GRAM + 1
#: Words of an index, at which a shard's next index begins.
INDEX_WORDS = 1 << 19
BITMAP_BITS = 1 << 30
#: Segments that a task remembers to have sent.
SENT = 1 << 20
#: Segments of one minimizer from which on they go out window by window.
HOT_SEGMENTS = 4096
CODE_BYTES = 5
#: Places of the suffix array that are kept: one in so many.
SAMPLE = 8
_LEAST = -(1 << 63)
_bitmaps: dict[str, np.ndarray] = {}


class Segments:
    """Segments of some texts: text, start and number of windows of each, minimizer and content hashes; words are those of all texts, text by text."""

    def __init__(self, texts: list[str]):
        self.words, self.at = joined_words(texts)
        n = np.diff(self.at)
        h, count = self.words, len(self.words) - WINDOW + 1
        empty = np.empty(0, np.int64)
        self.text = self.first = self.n = empty
        self.minimizer = self.content = empty.astype(np.uint64)
        if count < 1:
            return
        with np.errstate(over="ignore"):
            low = np.zeros(len(h) - GRAM + 1, np.uint64)
            for j in range(GRAM):
                low = mix(low * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(low)])
            grams, place, size = low, np.arange(len(low)), 1
            while size < SPAN:  # leftmost least of windows of doubling size
                step = min(size, SPAN - size)
                take = low[step:] < low[: len(low) - step]
                low, place = np.where(take, low[step:], low[: len(low) - step]), np.where(take, place[step:], place[: len(place) - step])
                size += step
            owner = np.repeat(np.arange(len(texts)), n)
            inside = owner[:count] == owner[WINDOW - 1 :]
            begins = inside & np.concatenate(([True], (place[1:] != place[:-1]) | ~inside[:-1]))
            self.first = np.flatnonzero(begins)
            total = np.concatenate(([0], np.cumsum(inside)))
            self.n = total[np.append(self.first[1:], count)] - total[self.first] if len(self.first) else empty
            self.text = owner[self.first]
            self.minimizer = grams[place[self.first]]
            up, down = _power_tables(len(h) + 1)
            sums = np.concatenate(([np.uint64(0)], np.cumsum(h * up[: len(h)], dtype=np.uint64)))
            self.contents = lambda first, n: mix((sums[first + n + WINDOW - 1] - sums[first]) * down[first] + n.astype(np.uint64))
            self.content = self.contents(self.first, self.n)


class WaveletMatrix:
    """Rank over a sequence of small integers, in packed bits a level with a count for each 64."""

    def __init__(self, values: np.ndarray, largest: int):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        v = values
        for shift in reversed(range(max(1, int(largest).bit_length()))):
            bit = (v >> shift & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            blocks = np.frombuffer(packed.tobytes() + b"\0" * (16 - len(packed) % 8), "<u8")
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(blocks)))).astype(np.int64)
            zeros = len(v) - int(counts[-1])
            self.levels.append((shift, blocks, counts, zeros))
            v = np.concatenate((v[~bit], v[bit]))

    @staticmethod
    def _ones(level: tuple, i: np.ndarray) -> np.ndarray:
        _, blocks, counts, _ = level
        b = i >> 6
        return counts[b] + np.bitwise_count(blocks[b] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many of each symbol stand before each place."""
        begin, end = np.zeros(len(place), np.int64), place
        for level in self.levels:
            one = (symbol >> level[0] & 1).astype(bool)
            x, y = self._ones(level, begin), self._ones(level, end)
            begin, end = np.where(one, level[3] + x, begin - x), np.where(one, level[3] + y, end - y)
        return end - begin

    def access(self, place: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        symbol = np.zeros(len(place), np.int64)
        for level in self.levels:
            one = (level[1][place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            x = self._ones(level, place)
            place = np.where(one, level[3] + x, place - x)
            symbol |= one.astype(np.int64) << level[0]
        return symbol


class FMIndex:
    """A compressed index over several sequences of words (as integers of any size)."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        """codes: all sequences one after another; bounds: where each begins, and the end."""
        self.alphabet, symbols = np.unique(codes, return_inverse=True)
        n_seq = len(bounds) - 1
        # a separator (0) stands after each sequence
        text = np.zeros(len(codes) + n_seq, np.int64)
        self.place = np.arange(len(codes)) + np.repeat(np.arange(n_seq), np.diff(bounds))  # of each code in the text
        text[self.place] = symbols + 1
        self.size, self.symbols = len(text), symbols + 1
        suffixes = self._sorted(text, int(np.diff(bounds).max(initial=0)))
        self.starts = np.searchsorted(text[suffixes], np.arange(len(self.alphabet) + 2))
        self.matrix = WaveletMatrix(text[suffixes - 1], len(self.alphabet))
        # places that are known: each SAMPLE-th, and where sequences begin, so that no walk leaves its sequence
        known = np.arange(len(text)) % SAMPLE == 0
        known[bounds[:-1] + np.arange(n_seq)] = True
        self.known = WaveletMatrix(known[suffixes].astype(np.int64), 1)
        self.sampled = suffixes[known[suffixes]].astype(np.int32)

    @staticmethod
    def _sorted(text: np.ndarray, longest: int) -> np.ndarray:
        """The suffixes in order, by doubling; each separator is a symbol of its own, so what follows a sequence doesn't count."""
        ends = text == 0
        rank = np.where(ends, np.cumsum(ends), text + ends.sum())
        size = 1
        while size <= longest:
            later = np.concatenate((rank[size:], np.full(min(size, len(rank)), -1))) + 1
            rank = np.unique(rank * (len(rank) + len(text) + 2) + later, return_inverse=True)[1]
            size *= 2
        return np.argsort(rank, kind="stable")

    def search(self, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the `length` words that end with each given code of the sequences: intervals of suffixes, and the matching statistic: words matched before only one place was left."""
        low, high = np.zeros(len(last), np.int64), np.full(len(last), self.size, np.int64)
        matched = np.zeros(len(last), np.int64)
        live = np.arange(len(last))
        for k in range(length):
            symbol = self.symbols[last[live] - k]
            low[live] = self.starts[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.starts[symbol] + self.matrix.rank(symbol, high[live])
            live = live[high[live] - low[live] > 1]
            matched[live] = k + 1
            if not len(live):
                break
        return low, high, matched

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes given by their order: each walks back until it meets a known place."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows
        while len(live):
            there = self.known.access(at).astype(bool)
            out[live[there]] = self.sampled[self.known.rank(np.ones(int(there.sum()), np.int64), at[there])]
            live, at = live[~there], at[~there]
            steps[live] += 1
            symbol = self.matrix.access(at)
            at = self.starts[symbol] + self.matrix.rank(symbol, at)
        return out + steps


def repeated(codes: np.ndarray, bounds: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, window, matching statistic) of the windows of segments that have an equal one of a lower order elsewhere. order: a number for each code's place."""
    index = FMIndex(codes, bounds)
    n = np.diff(bounds) - WINDOW + 1
    segment = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    first = bounds[:-1][segment] + window
    low, high, matched = index.search(first + WINDOW - 1, WINDOW)
    hit = np.flatnonzero(matched == WINDOW)
    # patterns of one length have intervals that are equal or apart, so each place is located once
    begin, which = np.unique(low[hit], return_inverse=True)
    end = np.zeros(len(begin), np.int64)
    end[which] = high[hit]
    size = end - begin
    if not len(size):
        return segment[hit], window[hit], matched[hit]
    rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    of_text = np.full(index.size, np.iinfo(np.int64).max)
    of_text[index.place] = order
    least = np.minimum.reduceat(of_text[index.locate(rows)], np.cumsum(size) - size)
    hit = hit[least[which] < order[first[hit]]]
    return segment[hit], window[hit], matched[hit]


def bitmap(uri: str, bits: int) -> np.ndarray:
    """The bitmap's 64-bit words; each Python worker reads it once."""
    if uri not in _bitmaps:
        import pyarrow.parquet as pq
        from pyarrow import fs

        while len(_bitmaps) > 1:  # those of one run
            _bitmaps.pop(next(iter(_bitmaps)))
        system, path = filesystem(uri)
        out = np.zeros(bits >> 6, np.uint64)
        for f in system.get_file_info(fs.FileSelector(path)):
            if f.path.endswith(".parquet"):
                with system.open_input_file(f.path) as file:
                    for b in pq.ParquetFile(file).iter_batches():
                        out[b.column(0).to_numpy()] = b.column(1).to_numpy().view(np.uint64)
        _bitmaps[uri] = out
    return _bitmaps[uri]


def marked(minimizer: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    i = minimizer & np.uint64(bits - 1)
    return (words[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63)) & np.uint64(1)).astype(bool)


def batches_of(batches, names: tuple[str, ...], text: str = "text"):
    """(columns, texts) of slices of about half a million characters."""
    for b in batches:
        texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
        for x, y in slices([len(t) + 100 for t in texts], 1 << 19):
            yield [b.column(b.schema.get_field_index(c)).slice(x, y - x) for c in names], texts[x:y]


def write_bitmap(values: DataFrame, name: str) -> tuple[str, int]:
    """Writes a bitmap that holds the values m, each at its low bits; its place and size in bits."""
    bits = min(BITMAP_BITS, max(1 << 16, 1 << (16 * values.count()).bit_length()))
    i = F.col("m").bitwiseAND(F.lit(bits - 1))
    words = values.select(F.shiftright(i, 6).alias("word"), F.expr(f"shiftleft(1L, cast((m & {bits - 1}L) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    uri = new_path(values.sparkSession, name)
    words.write.parquet(uri)
    return uri, bits


def mark_repeated(rows: DataFrame) -> tuple[tuple[str, int], tuple[str, int]]:
    """Bitmaps of the minimizers found twice or more, and of those found so often that their segments could fill an index."""

    def run(batches):
        import pyarrow as pa

        for _, texts in batches_of(batches, ()):
            m, n = np.unique(Segments(texts).minimizer, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(n.astype(np.int64))], names=["m", "n"])

    again = cut(rows.select("text").mapInArrow(run, "m bigint, n bigint").groupBy("m").agg(F.sum("n").alias("n")).filter("n > 1"), "op6-minimizers")
    return write_bitmap(again, "op6-bitmap"), write_bitmap(again.filter(F.col("n") > min(HOT_SEGMENTS, INDEX_WORDS // (WINDOW + SPAN))), "op6-hot")


def sent_segments(rows: DataFrame, repeats: tuple[str, int], hots: tuple[str, int]) -> DataFrame:
    """m, c (what the segment is dealt by, and its content), k, h, start, codes: segments with marked minimizers, and single windows of those with
    hot ones, without what the task has already sent from an earlier place."""

    def run(batches):
        import pyarrow as pa

        words, often, sent = bitmap(*repeats), bitmap(*hots), {}
        for (k, h), texts in batches_of(batches, ("k", "h")):
            s = Segments(texts)
            keep = marked(s.minimizer, words, repeats[1])
            hot = keep & marked(s.minimizer, often, hots[1])
            whole = np.flatnonzero(keep & ~hot)
            single = np.repeat(np.flatnonzero(hot), s.n[hot])
            turn = np.arange(len(single)) - np.repeat(np.cumsum(s.n[hot]) - s.n[hot], s.n[hot])
            owner = np.concatenate((whole, single))
            first, n = np.concatenate((s.first[whole], s.first[single] + turn)), np.concatenate((s.n[whole], np.ones(len(single), np.int64)))
            text = s.text[owner]
            c = s.contents(first, n).view(np.int64) if len(first) else np.empty(0, np.int64)
            m = np.concatenate((s.minimizer[whole].view(np.int64), c[len(whole) :]))
            kk, hh, start = k.to_numpy()[text], h.to_numpy()[text], first - s.at[text]
            if len(sent) > SENT:
                sent.clear()
            use = []
            for i, (name, place) in enumerate(zip(zip(m.tolist(), c.tolist(), strict=True), zip(kk.tolist(), hh.tolist(), start.tolist(), strict=True), strict=True)):
                before = sent.get(name)
                if before is None or place < before:
                    sent[name] = place
                    use.append(i)
            raw = np.ascontiguousarray(s.words, "<u8").view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES]
            size = n[use] + WINDOW - 1
            index = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[use], size)
            ends = np.concatenate(([0], np.cumsum(size))) * CODE_BYTES
            codes = pa.Array.from_buffers(pa.binary(), len(use), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[index]))])
            yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (m, c, kk, hh)] + [pa.array(start[use].astype(np.int32)), codes], names=["m", "c", "k", "h", "start", "codes"])

    return rows.mapInArrow(run, "m bigint, c bigint, k bigint, h bigint, start int, codes binary")


def found_in_shards(segments: DataFrame) -> DataFrame:
    """k, h, start, mask (bit j: window j of the segment, or the single window, repeats an earlier one) of each one's earliest copy."""
    # dealt out by m alone, so the minimum needs no further shuffle; its output is sorted by m
    first = segments.repartition("m").groupBy("m", "c").agg(F.min(F.struct("k", "h", "start", "codes")).alias("s")).select("m", "s.*").sortWithinPartitions("m")

    def index(parts: list):
        import pyarrow as pa

        t = pa.Table.from_batches(parts).combine_chunks()
        k, h, start = (t.column(c).to_numpy() for c in ("k", "h", "start"))
        data = t.column("codes").to_pylist()
        size = np.array([len(x) for x in data]) // CODE_BYTES
        wide = np.zeros((int(size.sum()), 8), np.uint8)
        wide[:, :CODE_BYTES] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, CODE_BYTES)
        bounds = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size) + np.repeat(start, size)
        rank = np.empty(bounds[-1], np.int64)
        kk, hh = np.repeat(k, size), np.repeat(h, size)
        by = np.lexsort((place, hh, kk))
        # equal places (windows of one document in overlapping segments) get equal numbers
        new = np.concatenate(([True], (kk[by][1:] != kk[by][:-1]) | (hh[by][1:] != hh[by][:-1]) | (place[by][1:] != place[by][:-1])))
        rank[by] = np.cumsum(new)
        seg, win, _ = repeated(wide.view("<u8").reshape(-1), bounds, rank)
        mask = np.zeros(len(size), np.int64)
        np.bitwise_or.at(mask, seg, 1 << win)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(h), pa.array(start), pa.array(mask.astype(np.int32))], names=["k", "h", "start", "mask"])

    def run(batches):
        held, words, last = [], 0, None
        for b in batches:
            m = b.column(0).to_numpy()
            at = 0
            # a new index begins only where the minimizer changes
            edges = [*(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), len(m)] if len(m) else []
            if len(m) and last is not None and m[0] != last and words >= INDEX_WORDS:
                yield index(held)
                held, words = [], 0
            per = b.column(b.schema.get_field_index("codes")).nbytes // max(1, len(m)) // CODE_BYTES + 1
            for e in edges:
                if words + (e - at) * per >= INDEX_WORDS and e < len(m):
                    held.append(b.slice(at, e - at))
                    yield index(held)
                    held, words, at = [], 0, e
            if at < len(m):
                held.append(b.slice(at))
                words += (len(m) - at) * per
            last = m[-1] if len(m) else last
        if held:
            yield index(held)

    return first.mapInArrow(run, "k bigint, h bigint, start int, mask int")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept (the words that stay, joined by one blank), removed (word intervals) of every row."""
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).withColumns({"k": F.coalesce("key", F.lit(_LEAST)), "h": F.xxhash64(F.coalesce("text", F.lit("")))})
    repeats, hots = mark_repeated(rows)
    found = cut(found_in_shards(sent_segments(rows.select("k", "h", "text"), repeats, hots)), "op6-found")
    own = found.groupBy("k", "h").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks"))

    def run(batches):
        import pyarrow as pa

        words, often = bitmap(*repeats), bitmap(*hots)
        for (k, starts, masks), texts in batches_of(batches, ("key", "starts", "masks")):
            s = Segments(texts)
            use = marked(s.minimizer, words, repeats[1])
            mask = np.where(use, (1 << s.n) - 1, 0)  # a copy of an earlier segment, unless it is found below
            own_starts, own_masks = starts.to_pylist(), masks.to_pylist()
            n_own = np.array([len(x or ()) for x in own_starts])
            if n_own.sum():
                at = np.repeat(s.at[:-1], n_own) + np.fromiter((v for x in own_starts for v in x or ()), np.int64)
                seen, owner = np.fromiter((v for x in own_masks for v in x or ()), np.int64), np.searchsorted(s.first, at, "right") - 1
                single = marked(s.minimizer[owner], often, hots[1])
                mask[owner[~single]] = seen[~single]
                first = single & (seen == 0)  # of a hot minimizer's windows, those that are the earliest of their words
                np.bitwise_and.at(mask, owner[first], ~(1 << (at[first] - s.first[owner[first]])))
            change = np.zeros(len(s.words) + 1, np.int64)
            for j in range(SPAN):
                hit = s.first[(mask >> j & 1).astype(bool)] + j
                np.add.at(change, hit, 1)
                np.add.at(change, hit + WINDOW, -1)
            gone = np.cumsum(change[:-1]) > 0
            n, removed, kept, spans = np.diff(s.at), [], [], []
            for i, t in enumerate(texts):
                g, w = gone[s.at[i] : s.at[i + 1]], t.encode("utf-8", "surrogatepass").split()
                removed.append(int(g.sum()))
                kept.append(b" ".join(compress(w, ~g) if removed[-1] else w))
                edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0])))) if removed[-1] else np.empty(0, np.int64)
                spans.append(edge.tolist())
            yield pa.RecordBatch.from_arrays([k, pa.array(n.astype(np.int64)), pa.array(removed, pa.int64()), pa.array([x.decode() for x in kept], pa.string()), pa.array(spans, pa.list_(pa.int64()))], names=["key", "n_words", "n_removed", "kept", "removed"])

    joined = rows.join(own, ["k", "h"], "left").select("key", "text", "starts", "masks")
    return joined.mapInArrow(run, "key bigint, n_words bigint, n_removed bigint, kept string, removed array<bigint>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int, str]]:
    """What query() must return, for tests: every window in a dictionary of the earliest."""
    words = [((t or "").encode().split(), i) for i, t in rows]
    order = sorted(range(len(rows)), key=lambda x: rows[x][0])
    seen: set[tuple] = set()
    out = []
    for x in order:
        w, i = words[x]
        gone = [False] * len(w)
        for j in range(len(w) - WINDOW + 1):
            key = tuple(w[j : j + WINDOW])
            if key in seen:
                gone[j : j + WINDOW] = [True] * WINDOW
            seen.add(key)
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(y for y, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out
