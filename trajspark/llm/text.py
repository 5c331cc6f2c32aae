"""Words, lines and hashes of many texts at once: numpy on the bytes of an Arrow string column.

A batch is cut into blocks of about a megabyte of whole texts, so temporary arrays stay small however
large the batch is; a longer text is a block of its own. Byte 0xFF, which UTF-8 never holds, ends every
text of a block and counts as white space, so no word or pattern reaches into the next text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEP = 0xFF
BLOCK_BYTES = 1 << 20
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

SPACE = np.zeros(256, bool)
SPACE[list(SPACES) + [SEP]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: True where a code point begins
LEAD = np.array([b & 0xC0 != 0x80 and b != SEP for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A hash value for each byte, the radix of the rolling hash and its inverse modulo 2**64.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
RADIX = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(RADIX), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        seq = np.full(max(n, 1 << 20), base, np.uint64)
        seq[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(seq)
    return have[:n]


class Rolling:
    """Hash of any slice of a sequence of 64-bit values from one pass of prefix sums."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(RADIX, len(values)), out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * powers(INVERSE, len(self.sums))[start])


class Block:
    """Texts ``first`` .. ``first + n`` of a batch: their bytes, and where each starts and ends."""

    def __init__(self, first: int, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.first, self.data, self.start, self.end = first, data, start, end
        self.n = len(start)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text that each byte position lies in."""
        return np.searchsorted(self.start, at, "right") - 1

    def words(self, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every run of bytes outside ``space``, in order."""
        change = np.diff(space[self.data].view(np.int8), prepend=np.int8(1))
        return np.flatnonzero(change == -1), np.flatnonzero(change == 1)

    def prefix(self, table: np.ndarray) -> np.ndarray:
        """How many bytes before each position have a true entry in ``table``."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(table[self.data], out=out[1:])
        return out


def firsts(owner: np.ndarray, n: int) -> np.ndarray:
    """n + 1 bounds of the runs of an ascending owner array."""
    return np.searchsorted(owner, np.arange(n + 1))


def totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each run."""
    if values.dtype.kind == "f":  # summed run by run, so that one text's sum does not depend on its neighbours
        out = np.zeros(len(bounds) - 1)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            out[full] = np.add.reduceat(values, bounds[:-1][full])
        return out
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    length = np.diff(at)
    if column.null_count:
        length[column.is_null().to_numpy(zero_copy_only=False)] = 0
    ends = np.cumsum(length + 1)
    lo = 0
    while lo < n:
        base = ends[lo] - length[lo] - 1
        hi = max(lo + 1, int(np.searchsorted(ends, base + size, "right")))
        data = np.full(int(ends[hi - 1] - base), SEP, np.uint8)
        start = ends[lo:hi] - length[lo:hi] - 1 - base
        for s, a, k in zip(start.tolist(), at[lo:hi].tolist(), length[lo:hi].tolist()):
            data[s : s + k] = raw[a : a + k]
        yield Block(lo, data, start, start + length[lo:hi])
        lo = hi


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for keys that occur twice or more."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def later(keys: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Of the repeated keys, True for all but the first occurrence."""
    out = np.zeros(len(keys), bool)
    at = np.flatnonzero(twice)
    if len(at):
        order = at[np.argsort(keys[at], kind="stable")]
        out[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return out


def lookup(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, or the table's length where it has none."""
    at = np.searchsorted(table, keys)
    found = at < len(table)
    found[found] = table[at[found]] == keys[found]
    return np.where(found, at, len(table))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads; columns of any other name are left behind."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *more)


def free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )
