"""Secret scans: keyword automaton, anchored expressions at its hits, checksums inside the tokens.

One Aho-Corasick pass over the lower-cased bytes of a block finds every keyword; an expression is tried
only at a hit, anchored there, so the cost of a pattern does not grow with the text. Runs of hex digits
are found by their length without any expression. Token formats that carry a checksum count only if it
is right.

Null or empty texts have no spans. Repeated rows are scanned one by one. An empty table gives an empty
result. Other columns are ignored. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trajspark.llm import spans
from trajspark.llm.text import LEAD, LOWER, batch, blocks, texts

#: Order of the kinds at equal starts; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
BASE = KINDS[:3]
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
}
_PATTERNS = {
    "assign": re.compile(
        rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
    ),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]+"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]+"),
    "xprv": re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]+"),
}
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def crc_digits(body: bytes) -> bytes:
    """CRC-32 in six base-62 digits, as package and code hosts append it to their tokens."""
    value, out = zlib.crc32(body), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _BASE62[digit] + out
    return out.encode()


def _prefixed(found: bytes) -> bool:
    body = found[4:]
    return len(body) == 36 and crc_digits(body[:30]) == body[30:]


def _extended_key(found: bytes) -> bool:
    """111 base-58 digits: 78 bytes and the first four of their double SHA-256."""
    if len(found) != 111:
        return False
    value = 0
    for c in found.decode():
        value = value * 58 + _BASE58.index(c)
    raw = value.to_bytes(max(82, (value.bit_length() + 7) // 8), "big")
    return len(raw) == 82 and hashlib.sha256(hashlib.sha256(raw[:78]).digest()).digest()[:4] == raw[78:]


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= MIN_VALUE
    if kind == "access":
        return len(m[0]) >= MIN_ACCESS
    return _extended_key(m[0]) if kind == "xprv" else _prefixed(m[0])


def _automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for kind, keys in _KEYWORDS.items():
        for key in keys:
            words.add_word(key, (kind, len(key)))
    words.make_automaton()
    return words


def scan(column: pa.Array, words: ahocorasick.Automaton) -> list[list[tuple[str, int, int, bool]]]:
    out: list[list] = [[] for _ in range(len(column))]
    for b in blocks(column):
        found = []
        hits = defaultdict(list)
        # one character per byte: every keyword is ASCII, so hits are byte positions
        for end, (kind, size) in words.iter(LOWER[b.data].tobytes().decode("latin-1")):
            hits[kind].append(end - size + 1)
        if hits:
            raw = b.data.tobytes()
            for kind, at in hits.items():
                free = 0
                for start in sorted(at):
                    if start >= free and (m := _PATTERNS[kind].match(raw, start)):
                        free = m.end()
                        if _valid(kind, m):
                            found.append((start, KINDS.index(kind), free))
        change = np.diff(_HEX[b.data].view(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        long = end - start >= MIN_HEX
        found += [(s, KINDS.index("hex"), e) for s, e in zip(start[long].tolist(), end[long].tolist())]
        if not found:
            continue
        found.sort()
        chars = b.prefix(LEAD)
        at = np.array(found)
        owner = b.owner(at[:, 0])
        origin = chars[b.start[owner]]
        for text, kind, s, e in zip(
            owner.tolist(), at[:, 1].tolist(), (chars[at[:, 0]] - origin).tolist(), (chars[at[:, 2]] - origin).tolist()
        ):
            out[b.first + text].append((KINDS[kind], s, e, KINDS[kind] in BASE))
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _automaton()
    schema = pa.schema([("doc_id", pa.int64()), ("spans", spans.ARROW)])
    for rows in batches:
        if rows.num_rows:
            yield batch(schema, [rows.column(0), spans.column(scan(rows.column(1), words))])


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans, ordered by start, then kind."""
    rows = texts(docs)
    return rows.select(rows.doc_id.cast("long"), "text").mapInArrow(_run, f"doc_id long, spans {spans.TYPE}")
