"""Quality by co-training: a view of the text and a view of its metadata teach each other.

The text view sees how a text is written (word lengths, symbols, case, repeats, lines), the metadata view
only lang, source and n_chars. Both start from a bounded sample of labelled documents. In every round each
view labels the pool documents it is surest of, in the classes' proportions, for the other view to learn
from. Each view's margin is then calibrated on labelled documents that neither was trained on, and a
logistic combination of the calibrated views scores every document. Rejected are documents that are at
least four times likelier bad than good, so that clean ones stay.

Labels are learned from rows whose crc32(doc_id as text) mod 3 is not 1; the others are for measurement.
Repeated labels of one document count once, the largest. With no label, or only one class, every score is
the labels' mean (one half with none). Null or empty texts are scored like any other (zero counts). A null
lang or source is a value of its own, a null n_chars counts as zero. Repeated rows are scored one by one.
An empty table gives an empty result. Columns of other names are left behind, or passed on by ``kept``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm.logistic import fit, margin, sigmoid
from trajspark.llm.text import BYTE, LEAD, LOWER, SEP, Rolling, batch, blocks, firsts, later, mix, repeated, texts, totals

#: Labelled documents to learn from, and unlabelled ones to exchange, at most.
LABELLED = 16_000
POOL = 16_000
ROUNDS = 4
#: Pool documents a view labels in a round, and how sure it must be.
EXCHANGED = 1_000
SURE = 0.95
KEEP = 0.2
_BINS = 8
_LANGS, _SOURCES = 16, 64

_TABLES = {
    "symbol": b"#*$%&|<>{}[]~^=\\",
    "loud": b"!?",
    "stop": b".,;:",
    "digit": b"0123456789",
    "upper": bytes(range(65, 91)),
    "letter": bytes(range(65, 91)) + bytes(range(97, 123)),
    "high": bytes(range(0xC2, 0xF5)),
}
_FLAGS = {k: np.isin(np.arange(256), list(v)) for k, v in _TABLES.items()}


def text_view(column: pa.Array) -> np.ndarray:
    """One row of measurements per text."""
    parts = []
    for b in blocks(column):
        start, end = b.words()
        owner = b.owner(start)
        bounds = firsts(owner, b.n)
        words = np.diff(bounds).astype(float)
        some = np.maximum(words, 1)
        chars = b.prefix(LEAD)
        size = chars[end] - chars[start]
        inside = totals(size, bounds)
        length = np.maximum(inside, 1)
        flags = {k: b.prefix(t) for k, t in _FLAGS.items()}
        has = {k: (p[b.end] - p[b.start]).astype(float) for k, p in flags.items()}
        hashes = Rolling(BYTE[LOWER[b.data]]).slices(start, end)
        key = mix(hashes ^ mix(owner))
        order = np.argsort(key)
        head = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
        runs = np.diff(np.append(head, len(order)))
        distinct = np.bincount(owner[order[head]], minlength=b.n)
        most = np.zeros(b.n)
        np.maximum.at(most, owner[order[head]], runs)
        grams = Rolling(hashes)
        at = np.arange(max(len(start) - 2, 0))
        at = at[owner[at] == owner[at + 2]]
        key = mix(grams.slices(at, at + 3) ^ mix(owner[at]))
        triples = np.bincount(owner[at[later(key, repeated(key))]], minlength=b.n)
        line = np.flatnonzero((b.data == 10) | (b.data == SEP))
        lines = np.bincount(b.owner(line), minlength=b.n)
        tail = b.data[np.maximum(end - 1, 0)]
        odd = np.bincount(owner[_FLAGS["symbol"][tail] | _FLAGS["loud"][tail]], minlength=b.n)
        short = np.bincount(owner[size <= 1], minlength=b.n)
        parts.append(
            np.column_stack(
                [
                    np.log1p(words), inside / some, has["symbol"] / some, has["loud"] / some, has["stop"] / some,
                    has["digit"] / length, has["upper"] / np.maximum(has["letter"], 1), has["high"] / length,
                    distinct / some, most / some, triples / some, words / lines, odd / some, short / some,
                ]
            )
        )
    return np.concatenate(parts)


def _slot(values: pd.Series, size: int) -> np.ndarray:
    """Place of each value among ``size`` slots; nulls have the last to themselves."""
    codes, names = pd.factorize(values)
    return np.array([zlib.crc32(v.encode()) % (size - 1) for v in names] + [size - 1])[codes]


def meta_view(lang: pd.Series, source: pd.Series, n_chars: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lang), _LANGS + _SOURCES + 2))
    rows = np.arange(len(lang))
    out[rows, _slot(lang, _LANGS)] = 1
    out[rows, _LANGS + _slot(source, _SOURCES)] = 1
    size = np.log1p(np.maximum(n_chars, 0))
    out[:, -2], out[:, -1] = size / 10, (size / 10) ** 2
    return out


@dataclass
class Model:
    edges: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    scales: np.ndarray
    both: np.ndarray
    constant: float | None = None

    def binned(self, x: np.ndarray) -> np.ndarray:
        """One indicator per measurement and bin."""
        cells = np.column_stack([np.searchsorted(e, c) for e, c in zip(self.edges, x.T)])
        out = np.zeros((len(x), x.shape[1], _BINS))
        np.put_along_axis(out, cells[:, :, None], 1.0, axis=2)
        return out.reshape(len(x), -1)

    def views(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Calibrated margins of the text and the metadata view."""
        raw = np.column_stack([margin(self.binned(x), self.text), margin(m, self.meta)])
        return raw * self.scales[:, 0] + self.scales[:, 1]

    def score(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.constant is not None:
            return (np.full(len(x), self.constant),) * 3
        v = self.views(x, m)
        return sigmoid(v[:, 0]), sigmoid(v[:, 1]), sigmoid(margin(v, self.both))


def _edges(values: np.ndarray) -> np.ndarray:
    """Upper bounds of all bins but the last: the smallest value has a bin to itself (most texts have no
    symbol, no digit, no repeat), the others share the rest evenly."""
    low = values.min()
    rest = values[values > low] if (values > low).any() else values
    return np.concatenate([[low], np.quantile(rest, np.linspace(0, 1, _BINS)[1:-1])])


def cotrain(x: np.ndarray, m: np.ndarray, y: np.ndarray, held: np.ndarray) -> Model:
    """x, m: the two views; y: 1, 0, or -1 in the pool; held: labelled rows kept for calibration."""
    known = y >= 0
    if not known.any() or len(np.unique(y[known & ~held])) < 2 or len(np.unique(y[known & held])) < 2:
        mean = float(y[known].mean()) if known.any() else 0.5
        return Model(np.zeros((x.shape[1], _BINS - 1)), *(np.zeros(0),) * 4, constant=mean)
    model = Model(np.array([_edges(c) for c in x.T]), *(np.zeros(0),) * 4)
    views = [model.binned(x), m]
    labels = [np.where(held, -1, y) for _ in views]
    pool = ~known
    base = y[known].mean()
    for round_ in range(ROUNDS + 1):
        weights = [fit(v[t >= 0], t[t >= 0].astype(float)) for v, t in zip(views, labels)]
        if round_ == ROUNDS:
            break
        for k in (0, 1):
            p = sigmoid(margin(views[k], weights[k]))
            free = pool & (labels[1 - k] < 0)
            for cls, sure, share in ((1, p, base), (0, 1 - p, 1 - base)):
                at = np.flatnonzero(free & (sure >= SURE))
                at = at[np.argsort(-sure[at], kind="stable")][: max(1, round(EXCHANGED * share))]
                labels[1 - k][at] = cls
    model.text, model.meta = weights
    raw = np.column_stack([margin(v, w) for v, w in zip(views, weights)])[held & known]
    target = y[held & known].astype(float)
    model.scales = np.array([fit(raw[:, [k]], target, ridge=1e-3) for k in (0, 1)])
    model.both = fit(raw * model.scales[:, 0] + model.scales[:, 1], target, ridge=1e-3)
    return model


_INPUTS = ["text", "lang", "source", "n_chars"]


def _views(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    at = {name: rows.column(rows.schema.get_field_index(name)) for name in _INPUTS}
    n_chars = np.asarray(at["n_chars"].fill_null(0).to_numpy(zero_copy_only=False), float)
    return text_view(at["text"]), meta_view(at["lang"].to_pandas(), at["source"].to_pandas(), n_chars)


def _inputs(docs: DataFrame) -> DataFrame:
    return texts(docs, *[F.col(c).cast("string").alias(c) for c in ("lang", "source")], F.col("n_chars").cast("long").alias("n_chars"))


def _held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most LABELLED labelled and POOL unlabelled documents, chosen by a hash of doc_id."""
    order = F.xxhash64("doc_id")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = known.where(~_held_out()).orderBy(order, "doc_id").limit(LABELLED)
    pool = docs.select("doc_id").where("doc_id is not null").distinct().join(known, "doc_id", "left_anti").orderBy(order, "doc_id").limit(POOL)
    picked = chosen.select("doc_id", F.col("y").cast("int").alias("y")).unionByName(pool.select("doc_id", F.lit(-1).alias("y")))
    rows = _inputs(docs).join(F.broadcast(picked), "doc_id")  # LABELLED + POOL rows of two numbers
    fields = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64())), ("m", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, m = _views(b)
                yield batch(fields, [b.column(0), b.column(b.schema.get_field_index("y")), list(x), list(m)])

    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *_INPUTS, "y").mapInArrow(
        run, "doc_id long, y int, x array<double>, m array<double>"
    )
    # repeated rows of a document may number more than the sample: one of each
    found = found.groupBy("doc_id").agg(F.min_by(F.struct("y", "x", "m"), F.xxhash64("x", "m")).alias("r")).select("doc_id", "r.*")
    table = found.toArrow()
    if not table.num_rows:
        return cotrain(np.zeros((0, 14)), np.zeros((0, 1)), np.zeros(0, int), np.zeros(0, bool))
    ids = table.column("doc_id").to_numpy()
    order = np.argsort(ids)
    wide = {c: np.array(table.column(c).to_pylist(), float)[order] for c in ("x", "m")}
    y = table.column("y").to_numpy()[order]
    held = mix(ids[order].astype(np.uint64)) % np.uint64(4) == 0
    return cotrain(wide["x"], wide["m"], y, held)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score and kept for every document."""
    fields = pa.schema([("doc_id", pa.int64())] + [(c, pa.float64()) for c in ("text_score", "meta_score", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield batch(fields, [b.column(0), *model.score(*_views(b))])

    rows = _inputs(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *_INPUTS)
    out = rows.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")
    return out.select(
        "doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "text_score", "meta_score", "score",
        (F.col("score") >= KEEP).alias("kept"),
    )


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model keeps, all columns as they were."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, lang, source, n_chars in columns:
            rows = pa.RecordBatch.from_arrays([text, lang, source, n_chars], names=_INPUTS)
            yield pa.array(model.score(*_views(rows))[2] if len(text) else [], pa.float64())

    value = F.arrow_udf(run, "double")(*[F.col(c).cast("string") for c in _INPUTS[:3]], F.col("n_chars").cast("long"))
    return docs.where(value >= KEEP)
