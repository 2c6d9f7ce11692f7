"""Secret scans: base patterns, and structural confirmation of encoded candidates.

A candidate is reported only if it parses: base64 and hex text is decoded and must be one DER value whose nested
lengths fill it exactly and that looks like a key (integers, or an algorithm identifier), or an SSH key blob of
length-prefixed fields; PEM blocks must hold such a body; signed tokens must have a JSON header with "alg" and a JSON payload.

Defined cases: null text counts as empty (no spans) and stays null when masked; very long texts are scanned whole; spans of one
start (ties) come in the order of KINDS, then by their end; equal texts and repeated rows give one row each; columns pass through unless
they have the name of an output column, which replaces them; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, with_computed

#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Every access, hex, token, base64 and SSH candidate lies within such a run.
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_ANYHEX = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])")
_B64 = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
#: A brace and a quotation mark or white space after it, encoded, begin a token's header.
_JWT = re.compile(r"e[wy][A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{3,40})-----([A-Za-z0-9+/=\s:,-]*?)-----END \1-----")


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(place of the content, its length) of the DER value at `at`, if its length lies within data."""
    if at + 2 > len(data):
        return None
    n, body = data[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or body + k > len(data) or data[body] == 0:
            return None
        n, body = int.from_bytes(data[body : body + k], "big"), body + k
        if n < 0x80:
            return None
    return (body, n) if body + n <= len(data) else None


def der_children(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the values that fill data exactly; None if they don't."""
    at, out = 0, []
    while at < len(data):
        if not (x := der_length(data, at)):
            return None
        out.append((data[at], data[x[0] : x[0] + x[1]]))
        at = x[0] + x[1]
    return out


def is_der_key(data: bytes) -> bool:
    """Whether data is one DER sequence whose nested lengths agree and whose fields are those of a key or a certificate."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    top = der_children(data)
    if not top or len(top) != 1:
        return False
    fields = der_children(top[0][1])
    if not fields or len(fields) < 2:
        return False

    def algorithm(x: tuple[int, bytes]) -> bool:
        return x[0] == 0x30 and bool(y := der_children(x[1])) and y[0][0] == 0x06

    def integers() -> bool:
        return all(t == 0x02 and 1 <= len(v) <= 2049 for t, v in fields)

    tags = [t for t, _ in fields]
    return (
        integers() and max(len(v) for _, v in fields) >= 16  # PKCS#1 keys, DSA numbers
        or algorithm(fields[0]) and tags[1] == 0x03  # SubjectPublicKeyInfo
        or tags[0] == 0x02 and algorithm(fields[1]) and tags[2:3] == [0x04]  # PKCS#8
        or tags[0] == 0x02 and tags[1] == 0x04 and len(fields[1][1]) >= 16  # SEC1
        or algorithm(fields[0]) and tags[1] == 0x04  # encrypted PKCS#8
        or tags[0] == 0x30 and algorithm(fields[1]) and tags[2:3] == [0x03]  # certificate
    )


def length_prefixed(data: bytes, at: int, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Fields, each after its length in four bytes, from `at` on (at most so many) and where they end; None if one runs over the end."""
    fields: list[bytes] = []
    while at < len(data) and (most is None or len(fields) < most):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return fields, at


_SSH_NAME = re.compile(rb"(ssh-|ecdsa-sha2-|sk-)[a-z0-9@.-]+")


def is_ssh_public(data: bytes) -> bool:
    """Whether data is an SSH public key blob: length-prefixed fields that fill it, a key type's name the first."""
    found = length_prefixed(data, 0)
    return bool(found) and len(found[0]) >= 2 and bool(_SSH_NAME.fullmatch(found[0][0]))


def is_ssh_private(data: bytes) -> bool:
    """Whether data is an OpenSSH private key: cipher, key derivation and its options, the number of keys, that many public keys,
    and a private section in whole cipher blocks that ends the data, which without a cipher begins with a number written twice."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic) or not (found := length_prefixed(data, len(magic), 3)) or len(found[0]) < 3:
        return False
    (cipher, derivation, options), at = found
    if not re.fullmatch(rb"[a-z0-9@.-]+", cipher) or (cipher == b"none") != (derivation == b"none") or derivation == b"none" and options:
        return False
    n = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= n <= 16 or not (found := length_prefixed(data, at + 4, n + 1)) or len(found[0]) != n + 1 or found[1] != len(data):
        return False
    *public, private = found[0]
    if not all(map(is_ssh_public, public)) or len(private) < 8 or len(private) % 8:
        return False
    return cipher != b"none" or private[:4] == private[4:8]


def is_ssh_key(data: bytes) -> bool:
    return is_ssh_public(data) or is_ssh_private(data)


def decode64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """Whether the header decodes to JSON that names an algorithm, and the payload to a JSON object."""
    parts = [decode64(x) for x in text.split(".")[:2]]
    try:
        head, body = (json.loads(x) for x in parts if x is not None)
    except ValueError:
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def key_kind(data: bytes | None) -> str | None:
    return None if not data else "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind) in code points, by start and then by the kinds' order."""
    out: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    pem: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            if key_kind(decode64(re.sub(r"\s|^[A-Za-z-]+:.*$", "", m[2], flags=re.M))):
                out.append((m.start(), m.end(), "pem"))
                pem.append(m.span())
    for r in _RUN.finditer(text):
        run, at = r[0], r.start()
        if "AKIA" in run:
            out += [(at + m.start(), at + m.end(), "access") for m in _ACCESS.finditer(run) if m.end() - m.start() >= 18]
        out += [(at + m.start(), at + m.end(), "hex") for m in _HEX.finditer(run) if m.end() - m.start() >= 16]
        if len(run) < 24 or any(a <= at < b for a, b in pem):
            continue
        found = [(m.start(), m.end(), "jwt") for m in _JWT.finditer(run) if is_signed_token(m[0])] if "." in run and ("ey" in run or "ew" in run) else []
        for m in _ANYHEX.finditer(run):
            if len(m[0]) % 2 == 0 and (k := key_kind(bytes.fromhex(m[0]))):
                found.append((*m.span(), k))
        for m in _B64.finditer(run):
            # DER keys start with 0x30 and SSH blobs with a zero length byte or "o", which fixes the first letters.
            if m[0][0] in "MAb" and not any(a < m.end() and m.start() < b for a, b, _ in found) and (k := key_kind(decode64(m[0]))):
                found.append((*m.span(), k))
        out += [(at + a, at + b, k) for a, b, k in found]
    return sorted(out, key=lambda x: (x[0], _ORDER[x[2]], x[1]))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with spans: array<struct<kind, start, end>>, in order."""
    make = lambda texts: [[[{"kind": k, "start": a, "end": b} for a, b, k in scan(t or "")] for t in texts]]
    return with_computed(docs, [text], {"spans": "array<struct<kind:string,start:bigint,end:bigint>>"}, make)


def masked(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each merged span of secrets replaced by mask; null texts stay null."""

    def one(t: str | None) -> str | None:
        if t is None or not (spans := scan(t)):
            return t
        out, at = [], 0
        for a, b, _ in spans:
            if a >= at:
                out += [t[at:a], mask]
            at = max(at, b)
        return "".join([*out, t[at:]])

    return with_computed(docs, [text], {text: "string"}, lambda texts: [[one(t) for t in texts]]).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = KINDS[:3]
    part = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    listed = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*base)), part), ",")
    df = with_spans(documents(spark, sf_dir).select("doc_id", "text"))
    return df.select("doc_id", *[count(k) for k in base], F.sha2(listed, 256).alias("base_sha256"), F.array_join(F.transform("spans", part), ",").alias("spans"))


def base_digest(text: str) -> str:
    """sha256 of the base spans of a text, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in scan(text) if k in KINDS[:3]).encode()).hexdigest()
