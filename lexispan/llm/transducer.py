"""Token counts by a compiled finite-state transducer.

A byte-pair vocabulary with byte fallback is compiled, state by state as texts need it, into a deterministic transducer whose
transitions carry the tokens that a character adds (none or fewer, where it joins what came before). A state holds what
can still matter: the longest suffix that starts some piece, and for each place within that suffix the last token of the
encoding up to there and its count relative to the present. Whether a pair of tokens may stand side by side is decided
from the merges that build the two. The counts are those of the library, for the encoding of a text is the only
sequence of tokens all of whose neighbours may stand side by side.

No piece has a word mark after another character, so every word mark after something else takes any state to one and the
same: a text is cut there, and what stands between cuts counts the same wherever it stands. Arrow brings equal stretches
together, and short ones are remembered with their counts (a transition over a whole word), within a bound in bytes.

A long text is taken in chunks. A chunk's state map is made without knowing the state that it will be entered in: the chunk is run from
the start state, and the states and counts on the way to its first cut are kept. Entered in another state, it is run only until the
states agree, which they do at the cut at the latest and without a cut after a few tokens; from there on the counts differ by a
constant. Maps compose associatively: a long text's count is the composition of its chunks' maps, taken as a balanced prefix scan.

Defined cases: null and empty texts count 0; texts of any length are read whole; control strings and zero characters inside
a text are ordinary characters; equal texts (ties) and repeated rows give one row each; other columns pass through, but for those named
n_bytes or n_tokens, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices, tokenizer_path, with_computed
from .encoders import SLICE_BYTES, Generations, units

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
MARK = "▁"
CHUNK = 1 << 16
#: States on the way into a chunk that its map keeps.
TRACE = 1 << 12
#: Compiled states and pairs; at that many, compilation starts anew with the next text, so memory is bounded.
COMPILED = 250_000
_transducers: dict[str, Transducer] = {}
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Transducer:
    def __init__(self, pieces: dict[str, float]):
        """pieces: text and score of every piece that merging can make."""
        self.score = pieces
        self.longest = max(map(len, pieces))
        self.prefixes = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        for p in pieces:
            if MARK in p.lstrip(MARK):
                raise ValueError("a piece has a word mark after another character: texts can't be cut there")
        #: Characters, then the other pieces in the order in which merging prefers them.
        self.order = {p: k for k, p in enumerate(sorted(pieces, key=lambda p: (len(p) > 1, -pieces[p])))}
        self.split: dict[str, tuple[str, str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self._reset()
        self.words = Generations()

    @classmethod
    def load(cls, name: str) -> Transducer:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        odd = [m.is_control, m.is_unknown, m.is_byte, m.is_unused]
        if m.normalize("  aé①\t ") != f"{MARK * 3}aé①\t{MARK}":
            raise ValueError(f"{name}: a normaliser other than the identity with a leading mark")
        return cls({m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not any(f(i) for f in odd)})

    def merged(self, text: str, down_to: int = 1) -> list[str]:
        """The encoding of a short text by repeated merging, best score first, then leftmost; merging ends at down_to parts."""
        parts = list(text)
        while len(parts) > down_to:
            best = max(((self.score[parts[k] + parts[k + 1]], -k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.score), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge gives a piece; none for a single character."""
        if (got := self.split.get(piece)) is None and len(piece) > 1:
            parts = self.merged(piece, 2)
            if len(parts) > 2:
                raise ValueError(f"merging does not make the piece {piece!r}")
            got = self.split[piece] = tuple(parts)
        return got

    def may_follow(self, a: str | None, b: str) -> bool:
        """Whether the encoding of a's and b's text is these two tokens (of b's alone, where a is None).

        It is unless, while the two are being built, a merge across their border comes before the merges that complete them: the
        later-built of the two is taken apart step by step, and at each step the border's pair is held against what is still to come."""
        if a is None:
            return True
        if (got := self.pairs.get((a, b))) is None:
            got = self.pairs[a, b] = self._may_follow(a, b)
        return got

    def _may_follow(self, a: str, b: str) -> bool:
        order, limit = self.order, len(self.order) + 1
        while True:
            if order.get(a + b, limit) < limit:
                return False
            x, y = order[a], order[b]
            if x > y:
                limit, half = x, self.halves(a)
                if half is None:
                    limit, half = y + 1, self.halves(b)
                    if half is None:
                        return True
                    b = half[0]
                else:
                    a = half[1]
            else:
                limit, half = y + 1, self.halves(b)
                if half is None:
                    limit, half = x, self.halves(a)
                    if half is None:
                        return True
                    a = half[1]
                else:
                    b = half[0]

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        self.start = self._state(("", ((None, 0),)))

    def _state(self, config: tuple) -> int:
        if config not in self.ids:
            self.ids[config] = len(self.states)
            self.states.append(config)
            self.next.append({})
        return self.ids[config]

    def _step(self, state: int, c: str) -> tuple[int, int]:
        """The transition from a state by a character: (state, tokens added)."""
        suffix, places = self.states[state]
        if c not in self.score:  # spelt out in bytes, or unknown; nothing merges with it
            out = (self.start, len(c.encode()))
        else:
            text = suffix + c
            # places[j]: last token and relative count of the encoding that ends j characters before this one's start
            for n in range(min(len(text), self.longest), 0, -1):
                piece = text[-n:]
                if piece in self.score and self.may_follow(places[n - 1][0], piece):
                    token, count = piece, places[n - 1][1] + 1
                    break
            else:
                raise AssertionError(f"no token ends {text!r}")
            while text not in self.prefixes:
                text = text[1:]
            moved = ((token, 0), *[(t, k - count) for t, k in places[: len(text)]])
            out = (self._state((text, moved)), count)
        self.next[state][c] = out
        return out

    def run(self, state: int, text: str) -> tuple[int, int]:
        """State and tokens added after reading text."""
        total, table = 0, self.next
        for c in text:
            state, n = table[state].get(c) or self._step(state, c)
            total += n
        return state, total

    def of_stretches(self, new: list[str]) -> list[int]:
        """Tokens of stretches that begin at a cut."""
        return [self.run(self.start, x.replace(" ", MARK))[1] for x in new]

    def of_units(self, stretches: list[str]) -> int:
        """Tokens of some of a text's stretches, each of which begins at a cut."""
        distinct = list(dict.fromkeys(stretches))
        known = dict(zip(distinct, self.words.values(distinct, self.of_stretches), strict=True))
        return sum(map(known.__getitem__, stretches))

    def chunk(self, text: str) -> ChunkMap:
        """A chunk's state map; marks at its start may go on a run of marks before it, so its first cut comes after its first stretch."""
        head, *stretches = _UNIT.findall(text) or [""]
        if not stretches:
            return ChunkMap(self, head, None)
        state, n = self.run(self.start, stretches[-1])
        return ChunkMap(self, head, (state, n + self.of_units([x.replace(MARK, " ") for x in stretches[:-1]])))

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        import pyarrow as pa

        return int(self.counts(pa.array([text], pa.string()))[0])

    def counts(self, texts) -> np.ndarray:
        """Tokens of each text of an Arrow string array without nulls; equal stretches of the texts are run once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.states) > COMPILED:
            self._reset()
        if len(self.pairs) > COMPILED:
            self.pairs.clear()
        length = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        apart = (length > CHUNK) | pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        part = pc.if_else(pa.array(apart | (length == 0)), "", pc.binary_join_element_wise(" ", texts, ""))
        index, at, distinct = units(pc.replace_substring(part, MARK, " "), " ", True)
        values = np.array([*self.words.values(distinct.to_pylist(), self.of_stretches), 0], np.int64)
        total = np.concatenate(([0], np.cumsum(values[index])))
        out = total[at[1:]] - total[at[:-1]]
        for i in np.flatnonzero(apart):
            out[i] = self._long(MARK + texts[int(i)].as_py().replace(" ", MARK))
        return out

    def _long(self, text: str) -> int:
        maps = [self.chunk(text[k : k + CHUNK]) for k in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # the up-sweep of a prefix scan; only the whole is asked for
            maps = [maps[k].then(maps[k + 1]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0](self.start)[1]


class ChunkMap:
    """What a chunk, or several one after another, do to any state: the state after them, and the tokens added."""

    def __init__(self, by: Transducer, head: str, after: tuple[int, int] | None):
        """head: what comes before the chunk's first cut; after: the state at its end and the tokens from that cut on, None without a cut."""
        self.by, self.head, self.after, self.rest = by, head, after, None
        self.states, self.counts = [], []
        state, n = by.start, 0
        for c in head[:TRACE]:
            state, m = by.run(state, c)
            n += m
            self.states.append(state)
            self.counts.append(n)
        state, m = by.run(state, head[TRACE:])
        self.through = n + m  # tokens of the head, entered at the start
        #: after the chunk entered at the start, and those that follow it
        self.exit = (state, self.through) if after is None else (after[0], self.through + after[1])

    def __call__(self, state: int) -> tuple[int, int]:
        if state == self.by.start:
            return self.exit
        n = 0
        for c, known, counted in zip(self.head, self.states, self.counts, strict=False):
            state, m = self.by.run(state, c)
            n += m
            if state == known:  # from here on as if entered at the start
                return self.exit[0], self.exit[1] - counted + n
        state, m = self.by.run(state, self.head[len(self.states) :])
        n += m
        if self.after is not None:
            return self.exit[0], self.exit[1] - self.through + n
        if self.rest is None:
            return state, n
        state, m = self.rest(state)
        return state, n + m

    def then(self, other: ChunkMap) -> ChunkMap:
        out = object.__new__(ChunkMap)
        out.__dict__.update(self.__dict__)
        state, n = other(self.exit[0])
        out.exit, out.rest = (state, self.exit[1] + n), other if self.rest is None else self.rest.then(other)
        return out


def transducer(name: str) -> Transducer:
    """This process's transducer for a model; it outlives a task where Python workers are reused."""
    if name not in _transducers:
        _transducers[name] = Transducer.load(name)
    return _transducers[name]


def counter(name: str = MODEL) -> Callable:
    def make(texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        t, texts = transducer(name), pc.fill_null(texts, "")
        size = pc.binary_length(texts)
        gc.disable()  # states hold no cycles, and there are many to walk over
        try:
            counts = [t.counts(texts.slice(a, b - a)) for a, b in slices(size.to_pylist(), SLICE_BYTES)]
        finally:
            gc.enable()
        return [size.cast(pa.int64()), pa.array(np.concatenate(counts) if counts else [], pa.int64())]

    return make


def with_counts(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """docs with n_bytes and n_tokens of each whole text."""
    return with_computed(docs, [text], {"n_bytes": "bigint", "n_tokens": "bigint"}, counter(model), arrow=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_counts(documents(spark, sf_dir).select("doc_id", "text"))
    return df.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {TOKEN_LIMIT} AS over_limit")
