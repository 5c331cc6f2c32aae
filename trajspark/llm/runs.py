"""Periodic runs: maximal stretches of words that repeat with one period at least three times.

Seed and extend on diagonals. A run of period q and length max(24, 3q) or more matches itself q words on over
at least max(24 - q, 2q) words, so k-grams of k = 16 words meet every run with q up to 16, k = 32 those up to
32, and so on in doublings. With k >= q the next occurrence of such a k-gram inside its run lies exactly q on
(a nearer one would give the run a smaller period), so of all occurrence pairs only those of neighbours whose
lag belongs to that k are seeds; none else can be a run of that class. A seed is extended both ways to the
whole matching diagonal, unless the furthest end that its lag has covered already lies beyond it. k-grams are
named exactly, from the names of their halves, and positions whose k-gram is unique leave early.

A null or empty text has no words and no run. Rows are taken one by one, so repeated rows give repeated
results; a null doc_id is never altered by ``planted``. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.text import batch, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3
#: Words of the shortest seed: any run of period q overlaps itself by this much at least.
SEED = 16
OUT_CHARS = 1 << 22

Run = tuple[int, int, int]

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        end = min(at + step, n)
        other = np.flatnonzero(a[at:end] != b[at:end])
        if len(other):
            return at + int(other[0])
        at, step = end, 2 * step
    return n


def _extended(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The largest stretch round ``at`` in which words ``lag`` apart are equal, both copies included."""
    right = at + _same(ids[at : len(ids) - lag], ids[at + lag :])
    left = at - _same(ids[:at][::-1], ids[lag : at + lag][::-1])
    return left, right + lag


def _renamed(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense names of the keys that occur twice or more, and where those are."""
    _, name, count = np.unique(key, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(count[name] > 1)
    return np.unique(name[keep], return_inverse=True)[1], keep


def runs(ids: np.ndarray) -> list[Run]:
    """(start, length, period) of every run of a sequence of word numbers, by start, then period."""
    n = len(ids)
    found: list[Run] = []
    if n < LEAST:
        return found
    name, at = _renamed(ids)
    k = 1
    full = np.full(n, -1, np.int64)
    covered: dict[int, int] = {}
    while len(at) and k + 1 <= n:
        if k >= SEED:
            least = 1 if k == SEED else k // 2 + 1
            if TIMES * least > n:
                break
            order = np.lexsort((at, name))
            here, lag = at[order][:-1], np.diff(at[order])
            seed = (np.diff(name[order]) == 0) & (lag >= least) & (lag <= k)
            here, lag = here[seed], lag[seed]
            order = np.lexsort((here, lag))
            here, lag = here[order], lag[order]
            # seeds that follow one another on a diagonal extend to the same stretch
            head = np.ones(len(here), bool)
            head[1:] = (lag[1:] != lag[:-1]) | (here[1:] != here[:-1] + 1)
            for i, q in zip(here[head].tolist(), lag[head].tolist()):
                if i + q < covered.get(q, -1):
                    continue
                lo, hi = _extended(ids, i, q)
                covered[q] = hi
                if hi - lo >= max(LEAST, TIMES * q):
                    found.append((lo, hi - lo, q))
        # names of 2k-grams from those of their halves
        full[:] = -1
        full[at] = name
        both = at + k < n
        both[both] = full[at[both] + k] >= 0
        first, at = name[both], at[both]
        name, keep = _renamed(first * np.int64(n) + full[at + k])
        at, k = at[keep], 2 * k
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def numbers(words: list[str]) -> np.ndarray:
    """A number per word, equal for equal words."""
    return pd.factorize(np.array(words, object))[0].astype(np.int64) if words else np.zeros(0, np.int64)


def collapse(words: list[str], found: list[Run]) -> list[str]:
    """The words without those that a run repeats: of each run its first period stays."""
    if not found:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The words as the query's contract wants them: one document in ten ends in a repeated stretch."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * whole + words[a : a + rest]


def periodic_runs(docs: DataFrame, change=None) -> DataFrame:
    """doc_id, runs (start, length, period in words) and ``collapsed``, the text without the repeats of its runs.

    ``change`` may replace the words of a document: a function of doc_id and words.
    """

    def one(doc, text):
        words = words_of(text)
        if change is not None:
            words = change(doc, words)
        found = runs(numbers(words))
        return doc, [dict(zip(("start", "length", "period"), r)) for r in found], " ".join(collapse(words, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                out.append(one(doc, text.as_py()))
                held += len(out[-1][2]) + 64
                if held > OUT_CHARS:
                    yield batch(_SCHEMA, list(zip(*out)))
                    out, held = [], 0
        if out:
            yield batch(_SCHEMA, list(zip(*out)))

    rows = texts(docs)
    return rows.select(rows.doc_id.cast("long"), "text").mapInArrow(
        run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )


def digest(docs: DataFrame, change=planted) -> DataFrame:
    """One row per document: its number of runs, the strongest, and hashes of all runs and of the collapsed text.

    The strongest run has the greatest exact length / period; ties go to the smallest start, then period.
    """

    def weaker(a, b):
        more = a["length"] * b["period"] - b["length"] * a["period"]  # exact: no quotient is rounded
        return F.coalesce(*[F.when(d != 0, F.signum(d).cast("int")) for d in (-more, a["start"] - b["start"], a["period"] - b["period"])], F.lit(0))

    found = periodic_runs(docs, change).withColumn("best", F.get(F.array_sort("runs", weaker), 0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda r: F.concat(r, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
