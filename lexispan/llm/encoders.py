"""Token ids of whole texts by the tokenizers library, with a bounded memory of words.

Both public vocabularies cut texts at white space before they merge anything, so a text's ids are those of its
units, one after another. Arrow finds the units and brings equal ones within a slice of texts together, normalises the distinct
ones and cuts them into words as the vocabulary's pre-tokenizer does; the library's model encodes each distinct word once.
Words are remembered, within a bound in bytes; what is longer than LONG_WORD is never remembered.
What might be cut otherwise goes to the library as it stands: a text with white space other than blank and line feed, with a
zero character or with the mark of a special token, and a unit with letters beyond Latin ones.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np

from .common import slices, tokenizer_path

#: White space, by any engine's notion, other than blank and line feed; and what special tokens begin with.
_ODD = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|"
#: Letters beyond Latin ones, and the one Latin letter whose lower case is two characters.
_FOREIGN = r"[^\x{00}-\x{24f}]|İ"
#: The byte-level pre-tokenizer's own pattern; it is fixed by the vocabulary.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of each of two generations of a memory, and the length from which on nothing is remembered.
REMEMBERED_BYTES = 32 << 20
LONG_WORD = 64
#: About the bytes that an entry takes besides its characters.
ENTRY_BYTES = 200
#: Bytes of text taken together, and the length at which one text is taken in stretches.
SLICE_BYTES = 4 << 20
_encoders: dict[str, CachedEncoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones as they are, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class Generations:
    """A memory bounded in bytes: a dict, and the generation before it. What is met again moves on to the younger one."""

    def __init__(self, most: int | None = None):
        self.most = REMEMBERED_BYTES if most is None else most
        self.young: dict = {}
        self.older: dict = {}
        self.size = 0

    def put(self, keys: Iterable[str], values: Iterable, size: int) -> None:
        """Remembers values that take `size` bytes together."""
        self.young.update(zip(keys, values, strict=True))
        self.size += size
        if self.size > self.most:
            self.older, self.young, self.size = self.young, {}, 0

    def values(self, keys: list[str], learn: Callable[[list[str]], Iterable]) -> list:
        """The value of each of some distinct keys; learn gives those of the keys that aren't known, in order."""
        out = list(map(self.young.get, keys))
        new = [i for i, v in enumerate(out) if v is None]
        if not new:
            return out
        older, unknown = self.older.get, []
        for i in new:
            if (v := older(keys[i])) is None:
                unknown.append(i)
            else:
                out[i] = v
        for i, v in zip(unknown, learn([keys[i] for i in unknown]), strict=True):
            out[i] = v
        new = [i for i in new if len(keys[i]) <= LONG_WORD]
        for k in range(0, len(new), 1 << 14):  # few at a time, so that the bound holds within a slice
            names = [keys[i] for i in new[k : k + (1 << 14)]]
            values = [out[i] for i in new[k : k + (1 << 14)]]
            self.put(names, values, ENTRY_BYTES * len(names) + 2 * len("".join(names)) + (len(b"".join(values)) if isinstance(values[0], bytes) else 0))
        return out


def distinct_parts(parts):
    """(index of each part, first part of each list and the end, distinct parts as an Arrow array) of an Arrow array of lists."""
    import pyarrow.compute as pc

    found = parts.flatten().dictionary_encode()
    at = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))))
    return found.indices.to_numpy(zero_copy_only=False), at, found.dictionary


def units(col, spaces: str, keep: bool):
    """distinct_parts of texts without zero characters.

    A unit is a run of the given white space and what follows up to the next run; with keep unset it is what stands between runs
    alone, and empty units may come up, which have no ids."""
    import pyarrow as pa
    import pyarrow.compute as pc

    x = col.cast(pa.large_string())
    if keep:
        for c in spaces:
            x = pc.replace_substring(x, c, "\0" + c)
        for c in spaces:
            x = pc.replace_substring(x, c + "\0", c)  # within a run
        return distinct_parts(pc.split_pattern(x, "\0"))
    for c in spaces[1:]:
        x = pc.replace_substring(x, c, spaces[0])
    return distinct_parts(pc.split_pattern(x, spaces[0]))


def stretches(text: str, most: int) -> list[str]:
    """A long text in stretches, each of which but the first begins with a run of white space."""
    out, at, edge = [], 0, re.compile(r"(?<=[^ \n])[ \n]")
    while m := edge.search(text, at + most):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def joined(values, index: np.ndarray, ends: np.ndarray):
    """(data, offsets): the chosen binary values one after another, and where those before each of `ends` end."""
    import pyarrow as pa

    out = values.take(pa.array(index))
    offsets = np.frombuffer(out.buffers()[1], np.int64, len(out) + 1, out.offset * 8)
    return out.buffers()[2] or pa.py_buffer(b""), offsets[ends]


class CachedEncoder:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        t.no_truncation()
        t.no_padding()
        if t.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError(f"{name}: ids beyond 16 bits")
        made = json.loads(t.to_str())
        steps = (made["pre_tokenizer"] or {}).get("pretokenizers", [made["pre_tokenizer"]])
        level, normal = steps[-1], (made["normalizer"] or {}).get("normalizers", [])
        if level["type"] != "ByteLevel" or level["add_prefix_space"] or len(steps) > 2 or any(not x["content"].startswith("<|") for x in made["added_tokens"]):
            raise ValueError(f"{name}: not a byte-level vocabulary of the known kind")
        if [x["type"] for x in normal] not in ([], ["NFC", "Replace", "Lowercase"]) or bool(normal) != (len(steps) == 2):
            raise ValueError(f"{name}: not a normaliser of the known kind")
        self.keeps_space = len(steps) == 1
        # white space comes at a unit's start only, and all of a run but its last character is set apart beforehand
        pattern = steps[0]["pattern"]["Regex"] if len(steps) == 2 else _BYTE_LEVEL.replace(r"|\s+(?!\S)|\s+", r"|[ \n]+").replace(r"[^\s", r"[^\s\x00")
        self.pattern = f"({pattern})"
        self.letters, self.model = _byte_letters(), t.model
        self.words = Generations()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, words: list[str]) -> Iterator[bytes]:
        letters, tokenize = self.letters, self.model.tokenize
        for w in words:
            # printable ASCII stands for itself, but for the blank
            mapped = w.replace(" ", letters[32]) if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letters)
            yield array("H", [t.id for t in tokenize(mapped)]).tobytes()

    def _cut(self, units):
        """Units of Latin letters with a zero character between their words."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.keeps_space:
            units = pc.utf8_lower(units)
        bare = pc.ascii_ltrim(units, " ") if self.keeps_space else units
        body = pc.ascii_rtrim(bare, ".,;:!?")
        # letters alone, perhaps after a blank and before one mark, need no pattern
        length = lambda x: pc.utf8_length(x).to_numpy(zero_copy_only=False)
        whole, trimmed, inner = (length(x) for x in (units, bare, body))
        plain = pc.utf8_is_alpha(body).to_numpy(zero_copy_only=False) & (whole - trimmed <= 1) & (trimmed - inner <= 1)
        marked = plain & (trimmed > inner)
        rest = pc.if_else(pa.array(plain), "", units)
        if self.keeps_space:
            rest = pc.replace_substring_regex(rest, r"^([ \n]+)([ \n])([^ \n])", "\\1\0\\2\\3")
        rest = pc.replace_substring_regex(rest, self.pattern, "\\1\0")
        two = pc.binary_join_element_wise(pc.utf8_slice_codeunits(units, 0, -1), pc.utf8_slice_codeunits(units, -1), pa.scalar("\0", units.type))
        return pc.if_else(pa.array(marked), two, pc.if_else(pa.array(plain), units, rest))

    def _of_units(self, units):
        """Ids of units of Latin letters, as an Arrow array."""
        import pyarrow as pa
        import pyarrow.compute as pc

        index, at, distinct = distinct_parts(pc.split_pattern(self._cut(units), "\0"))
        values = pa.array(self.words.values(distinct.to_pylist(), self._of_words), pa.large_binary())
        data, offsets = joined(values, index, at)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(units), [None, pa.py_buffer(np.ascontiguousarray(offsets)), data])

    def encode(self, col, end: bytes = b"") -> Iterator[bytes]:
        """For each text of an Arrow string array its ids as little-endian unsigned 16-bit bytes, and end; null counts as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        col = pc.fill_null(col, "")
        for a, b in slices(pc.binary_length(col).to_pylist(), SLICE_BYTES):
            part = col.slice(a, b - a)
            long = pc.greater(pc.binary_length(part), SLICE_BYTES).to_pylist()
            if long[-1] and not pc.match_substring_regex(part[b - a - 1 :], f"{_ODD}|\\x00")[0].as_py():  # only a slice's last text can be as long
                yield from self._slice(part[: b - a - 1], end) if b - a > 1 else ()
                yield b"".join([*chain.from_iterable(self._slice(pa.array([x]), b"") for x in stretches(part[b - a - 1].as_py(), SLICE_BYTES)), end])
            else:
                yield from self._slice(part, end)
            pa.default_memory_pool().release_unused()

    def _slice(self, col, end: bytes) -> Iterator[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        true = lambda x: x.to_numpy(zero_copy_only=False)
        whole = true(pc.match_substring(col, "\0"))
        index, at, distinct = units(pc.if_else(pa.array(whole), "", col) if whole.any() else col, " \n", self.keeps_space)
        odd, foreign = (true(pc.match_substring_regex(distinct, p)) for p in (_ODD, _FOREIGN))
        apart = odd | foreign
        own = self._of_units(pc.if_else(pa.array(apart), "", distinct) if apart.any() else distinct)
        more: list[bytes] = []
        if apart.any():
            rows = np.flatnonzero(foreign & ~odd)
            more += self._library(distinct.take(pa.array(rows)).to_pylist())
            place = np.arange(len(distinct))
            place[rows] = len(distinct) + np.arange(len(rows))
            whole = whole | (np.diff(np.concatenate(([0], np.cumsum(odd[index])))[at]) > 0)
            index = place[index]
        # after each text's units comes one entry more: end, or for a text that the library takes as a whole, all its ids
        tail, count = np.full(len(col), len(own) + len(more)), np.diff(at)
        more.append(end)
        if whole.any():
            rows = np.flatnonzero(whole)
            tail[rows] = len(own) + len(more) + np.arange(len(rows))
            more += [x + end for x in self._library(col.take(pa.array(rows)).to_pylist())]
            index, count = index[np.repeat(~whole, count)], np.where(whole, 0, count)
        ends = np.cumsum(count)
        data, marks = joined(pa.concat_arrays([own, pa.array(more, pa.large_binary())]), np.insert(index.astype(np.int64), ends, tail), np.concatenate(([0], ends + np.arange(1, len(col) + 1))))
        view, marks = memoryview(data), marks.tolist()
        for x, y in zip(marks[:-1], marks[1:], strict=True):
            yield bytes(view[x:y])

    def ids(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa

        return list(self.encode(pa.array(texts, pa.string())))


def encoder(name: str) -> CachedEncoder:
    """This process's encoder for a vocabulary; it outlives a task where Python workers are reused."""
    if name not in _encoders:
        _encoders[name] = CachedEncoder(name)
    return _encoders[name]
