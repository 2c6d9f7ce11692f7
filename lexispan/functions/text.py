"""Text predicates with the index's rules: case-insensitive LIKE, GLOB, full-text phrases, lines."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def like(col: Column, pattern: str) -> Column:
    """LIKE that ignores the case of ASCII letters only; the pattern's % and _ are wildcards, and a backslash is itself."""
    ascii_lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    p = "".join(c.lower() if c.isascii() else c for c in pattern).replace("\\", "\\\\")
    return ascii_lower(col).like(p)


def contains_ci(col: Column, text: str) -> Column:
    return F.contains(F.lower(col), F.lit(text.lower()))


def glob(col: Column, pattern: str) -> Column:
    """GLOB: case-sensitive; *, ? and character classes."""
    out = ""
    for part in re.findall(r"\[[^\]]*\]|\*|\?|.", pattern, re.S):
        out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(part) or (part.replace("[^", "[^") if len(part) > 1 else re.escape(part))
    return col.rlike(f"^(?:{out})$")


def text_lines(text: Column) -> Column:
    """Lines without ends: no empty piece after a final line feed, no carriage return before one."""
    pieces = F.split(text, "\n")
    whole = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))).otherwise(pieces)
    return F.transform(whole, lambda x: F.regexp_replace(x, "\r$", ""))


def cut_to(col: Column, n: int) -> Column:
    return F.substring(F.trim(col), 1, n)


#: Letters that lose a mark: accented ones of Latin scripts to their base, by Unicode decomposition.
_MARKED = [(c, b) for c in map(chr, range(0xC0, 0x250)) if len(b := "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))) == 1 and b != c]


def plain(col: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.translate(col, "".join(c for c, _ in _MARKED), "".join(b for _, b in _MARKED)))


def tokens(col: Column) -> Column:
    """Runs of letters and digits, folded; a name in mixed case is one token."""
    return F.filter(F.split(plain(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def parse_search(query: str) -> tuple[list[str], bool]:
    """(phrase tokens, whether the last is a prefix) of a search text; nothing for a blank one."""
    q = query.strip()
    prefix = q.endswith("*")
    if prefix:
        q = q[:-1]
    folded = "".join(c for c in unicodedata.normalize("NFD", q) if not unicodedata.combining(c)).lower()
    return [t for t in re.split(r"[^\w]|_", folded) if t], prefix


def quoted_search(query: str) -> str:
    """The search text as a quoted phrase: quotes doubled, a final star outside."""
    q = query.strip()
    if not q:
        return ""
    star = "*" if q.endswith("*") else ""
    return '"' + q[: len(q) - len(star)].replace('"', '""') + '"' + star


def phrase_match(col: Column, phrase: list[str], prefix: bool) -> Column:
    """Whether the tokens of one column hold the phrase, its last token as a prefix if asked for."""
    if not phrase:
        return F.lit(False)
    tk, n = tokens(col), len(phrase)

    def at(i: Column) -> Column:
        same = F.lit(True)
        for k, p in enumerate(phrase):
            x = F.get(tk, i + k)
            same = same & (F.startswith(x, F.lit(p)) if prefix and k == n - 1 else x == p)
        return F.coalesce(same, F.lit(False))

    return F.exists(F.sequence(F.lit(0), F.greatest(F.size(tk) - n, F.lit(0))), at)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)
