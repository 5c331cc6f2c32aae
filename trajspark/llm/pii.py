"""Personal data: identifiers as written and in disguise, with spans in the text as it was given.

Identifiers written plainly are found on the bytes of a block: numpy finds the runs and the signs that
start them, anchored expressions the rest, in time linear in the text. Texts with a trace of disguise
(look-alike letters and digits, invisible characters, digits in words, at and dot in words or brackets; the
traces are what every match of a transducer holds, so a text without any stays as it is) pass through transducers that rewrite them piece by piece and keep, for every character they write, the
source characters it stands for; what is found in the rewritten text is mapped back through that record.
Spans as written stay, and a disguised one is added unless it lies inside one of them: a fragment that is
written plainly does not hide the whole.

Null or empty texts have no spans and stay as they are. Repeated rows are scanned one by one. An empty
table gives an empty result. Other columns are ignored, or passed on by ``masked``. Offsets are code
points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm import spans
from trajspark.llm.text import LEAD, LOWER, SEP, SPACES, batch, blocks, free, texts

KINDS = ("email", "ip", "card", "phone")
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
#: Shortest run of digit words that is read as digits.
MIN_DIGIT_WORDS = 3

_LOCAL = np.zeros(256, bool)
_LOCAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(rb"[^0-9]+")

#: Letters of other scripts by the Latin letter they look like.
LOOKALIKES = {
    "a": "аα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "k": "κ",
    "l": "ӏ", "m": "м", "n": "ո", "o": "оο", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "u": "υ", "v": "ν",
    "w": "ԝ", "x": "х", "y": "у", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν",
    "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_SINGLE = {ord(c): latin for latin, group in LOOKALIKES.items() for c in group}
_SINGLE |= {0xFF01 + k: chr(0x21 + k) for k in range(94)}  # full-width forms
_SINGLE |= {first + k: str(k % 10) for first in (0x0660, 0x06F0, 0x0966) for k in range(10)}
_SINGLE |= {0x1D7CE + k: str(k % 10) for k in range(50)}  # mathematical digits
_SINGLE |= {0x2460 + k: str(k + 1) for k in range(9)} | {0x24EA: "0"}  # digits in circles
_SINGLE |= {0x2024: ".", 0x3002: ".", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x00A0: " ", 0xFE6B: "@"}
_SINGLE |= {ord(c): "" for c in INVISIBLE}
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in _SINGLE) + "]")

_WORD = "|".join(DIGITS + ("oh",))
_SPELLED = re.compile(
    rf"\b(?:{_WORD})(?:(?:\s{{1,3}}|-)(?:{_WORD})){{{MIN_DIGIT_WORDS - 1},}}\b", re.IGNORECASE | re.ASCII
)
_ONE_WORD = re.compile(rf"{_WORD}", re.IGNORECASE | re.ASCII)
_JOINED_DIGITS = re.compile(r"\bplus\s{1,3}(?=[0-9])", re.IGNORECASE | re.ASCII)
_AT = re.compile(r"\s{0,3}[\[({<]\s{0,3}at\s{0,3}[\])}>]\s{0,3}", re.IGNORECASE | re.ASCII)
_DOT = re.compile(r"\s{0,3}[\[({<]\s{0,3}dot\s{0,3}[\])}>]\s{0,3}", re.IGNORECASE | re.ASCII)
#: Last labels of a host behind a bare "at"; those that are English words too are left out, as prose with
#: a missing blank after a full stop ("at home.It was") is no address.
TOP = (
    "com org net edu gov mil int info biz io dev app test example localhost eu uk de fr es nl se dk fi pl cz ch pt gr ie hu ro ru ua "
    "tr il cn jp kr tw hk sg au nz ca mx br ar cl co za ng ke ae sa pk bd vn th ph"
).split()
#: What may stand behind a bare "at": a spelled dot, labels that end in one of TOP, or an address of four numbers; but not
#: what is itself the local part of an address.
_HOST = (
    r"(?=[A-Za-z0-9-]{1,64}(?:\s{1,3}dot\s{1,3}[A-Za-z0-9-]|(?:\.[A-Za-z0-9-]{1,64}){0,8}\.(?:"
    + "|".join(TOP)
    + r")(?![A-Za-z0-9-]|\.[A-Za-z0-9]))"
    r"|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]))"
    r"(?![A-Za-z0-9._%+-]{1,64}@)"
    r"(?![A-Za-z0-9-]{1,64}(?:(?:\s{1,3}dot\s{1,3}|\.)[A-Za-z0-9-]{1,64}){1,4}\s{1,3}at\s{1,3}[A-Za-z0-9-]{1,64}(?:\s{1,3}dot\s|\.[A-Za-z]))"
)
_BARE = re.compile(r"(?<=[A-Za-z0-9])(\s{1,3}at\s{1,3})" + _HOST, re.IGNORECASE | re.ASCII)
_BARE_DOT = re.compile(r"(?<=[A-Za-z0-9])\s{1,3}dot\s{1,3}(?=[A-Za-z0-9])", re.IGNORECASE | re.ASCII)

#: Bytes as the traces spell them: letters in lower case, each white space of a text a blank.
_FLAT = LOWER.copy()
_FLAT[list(SPACES)] = 0x20
_BARE_KEY = " at "
_BARE_HOST = re.compile(rb" {1,3}" + _HOST.encode(), re.IGNORECASE)


def luhn(digits: bytes) -> bool:
    values = [b - 48 for b in digits[::-1]]
    return sum(values[::2] + [v * 2 - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def _emails(data: np.ndarray, raw: bytes) -> Iterator[tuple[int, int]]:
    at = np.flatnonzero(data == ord("@"))
    if not len(at):
        return
    other = np.flatnonzero(~_LOCAL[data])
    before = np.searchsorted(other, at) - 1
    begin = np.where(before >= 0, other[before] + 1, 0)
    free = 0
    for start, sign in zip(begin.tolist(), at.tolist()):
        start = max(start, free)
        if start < sign and (m := _DOMAIN.match(raw, sign + 1)):
            free = m.end()
            yield start, free


def _numbers(data: np.ndarray, raw: bytes) -> Iterator[tuple[str, int, int]]:
    digit = ((data >= 48) & (data <= 57)).view(np.int8)
    change = np.diff(digit, prepend=np.int8(0))
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    if not len(start):
        return
    between = data[end[:-1]]
    close = start[1:] - end[:-1] == 1
    dots = close & (between == ord("."))
    if len(dots) >= 3:
        free = 0
        for k in np.flatnonzero(dots[:-2] & dots[1:-1] & dots[2:]).tolist():
            if k >= free:
                free = k + 4
                parts = [raw[s:e].lstrip(b"0") for s, e in zip(start[k : k + 4].tolist(), end[k : k + 4].tolist())]
                if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
                    yield "ip", int(start[k]), int(end[k + 3])
    head = np.concatenate([[True], ~(close & ((between == 0x20) | (between == ord("-"))))])
    first = np.flatnonzero(head)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    size = np.add.reduceat(end - start, first)
    for k in np.flatnonzero((size >= 16) & (size <= 19)).tolist():
        s, e = int(start[first[k]]), int(end[last[k]])
        if luhn(_NOT_DIGIT.sub(b"", raw[s:e])):
            yield "card", s, e


def _phones(data: np.ndarray, raw: bytes) -> Iterator[tuple[int, int]]:
    free = 0
    for at in np.flatnonzero(data == ord("+")).tolist():
        if at >= free and (m := _PHONE.match(raw, at)):
            free = m.end()
            if 8 <= len(_NOT_DIGIT.sub(b"", m[0])) <= 15:
                yield at, free


def plain(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in bytes, ordered; ``data`` ends with the separator byte."""
    raw = data.tobytes()
    found = [(0, s, e) for s, e in _emails(data, raw)]
    found += [(KINDS.index(kind), s, e) for kind, s, e in _numbers(data, raw)]
    found += [(3, s, e) for s, e in _phones(data, raw)]
    return sorted(found)


class Traced:
    """A text and, for every character of it, the source characters it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1

    def rewrite(self, pattern: re.Pattern, pieces: Callable[[re.Match], list[tuple[str, int, int]]]) -> None:
        """Replaces matches by pieces, each given as (text, first and end character it stands for)."""
        out, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            out.append(self.text[at : m.start()])
            start.append(self.start[at : m.start()])
            end.append(self.end[at : m.start()])
            for text, s, e in pieces(m):
                out.append(text)
                start.append(np.full(len(text), self.start[s]))
                end.append(np.full(len(text), self.end[e - 1]))
            at = m.end()
        if out:
            self.text = "".join(out) + self.text[at:]
            self.start = np.concatenate([*start, self.start[at:]])
            self.end = np.concatenate([*end, self.end[at:]])


def _whole(text: str):
    return lambda m: [(text, m.start(), m.end())]


def _digits(m: re.Match) -> list[tuple[str, int, int]]:
    return [
        (str(DIGITS.index(w)) if (w := d[0].lower()) != "oh" else "0", m.start() + d.start(), m.start() + d.end())
        for d in _ONE_WORD.finditer(m[0])
    ]


def deobfuscate(text: str) -> Traced:
    """The transducers in order: look-alikes, digit words, at and dot."""
    t = Traced(text)
    t.rewrite(_ODD, lambda m: [(_SINGLE[ord(m[0])], m.start(), m.end())])
    t.rewrite(_SPELLED, _digits)
    t.rewrite(_JOINED_DIGITS, _whole("+"))
    t.rewrite(_DOT, _whole("."))
    t.rewrite(_AT, _whole("@"))
    t.rewrite(_BARE, _whole("@"))
    t.rewrite(_BARE_DOT, _whole("."))
    return t


def _disguised(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end) in characters that only the rewritten text shows."""
    t = deobfuscate(text)
    if t.text == text:
        return []
    data = np.frombuffer(t.text.encode() + bytes([SEP]), np.uint8)
    char = np.cumsum(LEAD[data]) - 1
    out = []
    for kind, s, e in plain(data):
        a, z = int(t.start[char[s]]), int(t.end[char[e - 1]])
        if not any(x <= a and z <= y for _, x, y in known + out):
            out.append((kind, a, z))
    return out


def _automaton() -> ahocorasick.Automaton:
    """What every match of a transducer holds, in lower case and with each white space as a blank."""
    traces = ahocorasick.Automaton()
    blank = [" " * k for k in range(4)]
    keys = [f"{o}{x}{w}{y}{c}" for o in "[({<" for c in "])}>" for w in ("at", "dot") for x in blank for y in blank]
    keys += [" dot ", _BARE_KEY]
    keys += [f"{a}{s}{b}" for a in DIGITS + ("oh",) for b in DIGITS + ("oh",) for s in ("-", *blank[1:])]
    keys += [f"plus{s}{d}" for s in blank[1:] for d in range(10)]
    keys += [chr(c).encode().decode("latin-1") for c in _SINGLE]
    for key in keys:
        traces.add_word(key, key)
    traces.make_automaton()
    return traces


def _traces(data: np.ndarray, traces: ahocorasick.Automaton) -> np.ndarray:
    """Where a transducer may match; a bare "at" counts only before what can be a host."""
    raw = _FLAT[data].tobytes()
    hits = traces.iter(raw.decode("latin-1"))
    return np.fromiter((end for end, key in hits if key != _BARE_KEY or _BARE_HOST.match(raw, end)), np.int64)


def find(column: pa.Array, traces: ahocorasick.Automaton) -> list[list[tuple[str, int, int, bool]]]:
    """The spans of each text, ordered by kind, then start."""
    out: list[list] = [[] for _ in range(len(column))]
    for b in blocks(column):
        found: dict[int, list] = {}
        hits = plain(b.data)
        if hits:
            chars = b.prefix(LEAD)
            at = np.array(hits)
            owner = b.owner(at[:, 1])
            origin = chars[b.start[owner]]
            for text, kind, s, e in zip(
                owner.tolist(), at[:, 0].tolist(), (chars[at[:, 1]] - origin).tolist(), (chars[at[:, 2]] - origin).tolist()
            ):
                found.setdefault(text, []).append((kind, s, e))
        trace = _traces(b.data, traces)
        added: dict[int, list] = {}
        for text in np.unique(b.owner(trace)).tolist():
            source = b.data[b.start[text] : b.end[text]].tobytes().decode("utf-8", "replace")
            if more := _disguised(source, found.get(text, [])):
                added[text] = more
        for text in sorted({*found, *added}):
            rows = [(k, s, e, True) for k, s, e in found.get(text, [])] + [(k, s, e, False) for k, s, e in added.get(text, [])]
            out[b.first + text] = [(KINDS[k], s, e, base) for k, s, e, base in sorted(rows)]
    return out


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans, ordered by kind, then start."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", spans.ARROW)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        traces = _automaton()
        for rows in batches:
            if rows.num_rows:
                yield batch(schema, [rows.column(0), spans.column(find(rows.column(1), traces))])

    rows = texts(docs)
    return rows.select(rows.doc_id.cast("long"), "text").mapInArrow(run, f"doc_id long, spans {spans.TYPE}")


def mask(text: str, found: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span replaced by its kind; spans that overlap are replaced as one."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e, _ in found):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with personal data replaced in ``text`` and ``length`` counted anew where it changed."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        traces = _automaton()
        for column in batches:
            found = find(column, traces)
            if any(found):
                at = [k for k, f in enumerate(found) if f]
                values = column.take(pa.array(at)).to_pylist()
                new = dict(zip(at, (mask(v, found[k]) for k, v in zip(at, values))))
                yield pa.array([new.get(k) for k in range(len(column))], pa.string())
            else:
                yield pa.nulls(len(column), pa.string())

    new = free(docs, "masked")
    out = docs.withColumn(new, F.arrow_udf(run, "string")(F.col(text).cast("string")))
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.col(new).isNotNull(), F.length(new).cast("long")).otherwise(F.col(length)))
    return out.withColumn(text, F.coalesce(new, text)).drop(new)
