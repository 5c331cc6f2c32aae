"""Toxicity: two Kneser-Ney models, one per class, compared on length-normalised likelihoods.

The models spell words letter by letter, the letters since a beginning being the history of the next one, so
one inflected or compounded form tells about the others. The history slides: a word longer than ORDER bytes is
spelled anew from each of its letters, ORDER bytes at a time, and of scripts without blanks (code points from
U+0800 on) every letter begins a spelling of SCRIPT letters. So all of a text is read, however long its words.
Both models are counted on equally many toxic and ordinary
documents. A class's counts are discounted and backed off to counts that both classes share: in how many
classes a beginning occurs, the continuation count of a model whose context is the class. With a discount
of one, an expression seen once has no mass of its own: rare expressions get the shared counts and speak
for neither class.

Letters that follow a beginning too rare to have mass of its own get the same even share of 256 in both models.
``toxic_ll`` and ``ordinary_ll`` are a text's mean log-likelihoods per letter spelled (null without letters).

A document's evidence is the mean log-likelihood difference per spelling, over the whole text, over its most
toxic passage of a fixed number of words, and over its most toxic words. They are turned into a probability
by a logistic fit on labelled documents that the models were not counted on, weighted to the classes' true
proportions.

Labels are learned from rows whose crc32(doc_id as text) mod 3 is not 1. Only the text is an input of a
score. Repeated labels of one document count once, the largest. With one class or none in the labels every
score is their mean (zero with none). Null or empty texts score as texts without evidence. Repeated rows
are scored one by one. An empty table gives an empty result. Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm.logistic import fit, margin, sigmoid
from trajspark.llm.text import BYTE, LEAD, LOWER, SEP, Block, Rolling, batch, blocks, firsts, lookup, texts, totals
from trajspark.plans.scratch import cut_lineage

#: Labelled documents of each class to learn from, at most; a quarter of them calibrate.
PER_CLASS = 8_000
#: Words of the most toxic passage.
PASSAGE = 12
DISCOUNT = 1.0
#: Log ratio from which a word counts as marked.
MARKED = 1.0
TOXIC = 0.7
#: Minus the log probability of a letter after a rare beginning, in both models.
EVEN = np.log(256)

#: Bytes of the longest history with the letter that follows it, the end of a word counting as a letter.
ORDER = 24
#: Letters of a spelling in scripts without blanks; at most ORDER bytes.
SCRIPT = 4

#: Everything but letters and digits; bytes of non-ASCII characters belong to words.
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[0x80:0xFF] = False
#: Lower case; every gap is the same end of a word.
_SPELLED = np.where(_GAP, 0, LOWER)


def _unspaced(b: Block) -> np.ndarray:
    """True for the bytes of code points from U+0800 on."""
    wide = (b.data >= 0xE0) & (b.data != SEP)
    if wide.any():
        lead = np.maximum.accumulate(np.where((b.data & 0xC0) != 0x80, np.arange(len(b.data)), 0))
        wide = wide[lead]
    return wide


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    change = np.diff(inside.view(np.int8), prepend=np.int8(0))  # every block ends in a separator
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def _spellings(b: Block) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray]:
    """Start, size in bytes and text of every spelling, in order, and the hashes of the letters."""
    wide = _unspaced(b)
    start, end = _runs(~_GAP[b.data] & ~wide)
    size = end - start + _GAP[b.data[end]]  # with the end of the word, unless another script follows
    parts = [(start, np.minimum(size, ORDER))]
    long = size > ORDER
    if long.any():
        # every letter of a long word after its first
        n = (end - start - 1)[long]
        at = np.repeat(start[long] + 1 - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        left = np.repeat((start + size)[long], n) - at
        letter = LEAD[b.data[at]]
        parts.append((at[letter], np.minimum(left[letter], ORDER)))
    if wide.any():
        _, ends = _runs(wide)
        at = np.flatnonzero(wide & LEAD[b.data])
        later = np.append(at, np.full(SCRIPT, len(b.data)))[SCRIPT:]
        parts.append((at, np.minimum(later, ends[np.searchsorted(ends, at, "right")]) - at))
    if len(parts) > 1:
        start, size = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(start, kind="stable")
        parts = [(start[order], size[order])]
    start, size = parts[0]
    return Rolling(BYTE[_SPELLED[b.data]]), start, size, b.owner(start)


@dataclass
class Model:
    """Log-likelihood of each counted beginning under either class, and their difference."""

    beginnings: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    ratio: np.ndarray = field(default_factory=lambda: np.zeros(1))  # one more, for none
    ordinary: np.ndarray = field(default_factory=lambda: np.zeros(1))
    length: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(7))
    constant: float | None = None

    def places(self, spelled: Rolling, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The place of each spelling's longest counted beginning; all shorter ones are counted too."""
        whole = spelled.slices(start, start + size)
        _, first, back = np.unique(whole, return_index=True, return_inverse=True)
        start, size = start[first], size[first]
        low, at = np.zeros(len(first), np.int64), np.full(len(first), len(self.beginnings))
        high = size.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            place = lookup(spelled.slices(start[open_], start[open_] + middle), self.beginnings)
            found = place < len(self.beginnings)
            low[open_[found]], at[open_[found]] = middle[found], place[found]
            high[open_[~found]] = middle[~found] - 1
        return at[back]

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Mean log ratio of the text and of its most toxic passage, its most toxic spellings, and its length;
        then the mean log-likelihoods per letter, toxic and ordinary."""
        out = []
        for b in blocks(column):
            spelled, start, size, owner = _spellings(b)
            at = self.places(spelled, start, size)
            ratio = self.ratio[at]
            bounds = firsts(owner, b.n)
            n = np.diff(bounds)
            sums = np.zeros(len(ratio) + 1)
            np.cumsum(ratio, out=sums[1:])
            last = np.minimum(np.arange(len(ratio)) + PASSAGE, bounds[1:][owner])
            passage = (sums[last] - sums[:-1]) / PASSAGE
            full = np.flatnonzero(n)
            most = np.zeros(b.n)
            if len(full):
                most[full] = np.maximum.reduceat(passage, bounds[:-1][full])
            marked = np.flatnonzero(ratio > MARKED)
            excess = np.bincount(owner[marked], weights=ratio[marked] - MARKED, minlength=b.n)
            marked = marked[np.lexsort((-ratio[marked], owner[marked]))]
            place = np.arange(len(marked)) - np.searchsorted(owner[marked], owner[marked])
            top = [np.bincount(owner[marked[place < k]], weights=ratio[marked[place < k]], minlength=b.n) for k in (1, 3)]
            some = np.maximum(n, 1)
            mean = totals(ratio, bounds) / some
            letters = totals(size, bounds)
            ordinary = self.ordinary[at] - (size - self.length[at]) * EVEN
            with np.errstate(invalid="ignore", divide="ignore"):
                likelihoods = [totals(x, bounds) / letters for x in (ordinary + ratio, ordinary)]
            out.append(np.column_stack([mean, most, *top, excess / np.sqrt(some), np.log1p(n), *likelihoods]))
        return np.concatenate(out)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(evidence), self.constant)
        return sigmoid(margin(evidence[:, :6], self.weights))


def _held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of every beginning of a spelling by class, with the beginning one letter shorter."""
    fields = pa.schema([("node", pa.int64()), ("parent", pa.int64()), ("size", pa.int32()), ("c0", pa.int64()), ("c1", pa.int64())])
    for rows in batches:
        toxic = rows.column(1).to_numpy(zero_copy_only=False) == 1
        for b in blocks(rows.column(0)):
            spelled, start, size, owner = _spellings(b)
            cls = toxic[b.first + owner]
            for k in range(1, ORDER + 1):
                long = size >= k
                start, size, cls = start[long], size[long], cls[long]
                node, first, back = np.unique(spelled.slices(start, start + k), return_index=True, return_inverse=True)
                counts = [np.bincount(back, weights=x, minlength=len(node)).astype(np.int64) for x in (~cls, cls)]
                parent = spelled.slices(start[first], start[first] + k - 1)
                yield batch(fields, [node.view(np.int64), parent.view(np.int64), np.full(len(node), k, np.int32), *counts])


def _steps(counted: DataFrame) -> DataFrame:
    """node, parent, size and, for the last letter of each beginning, step (its log ratio) and plain (its log
    probability in the ordinary model)."""
    nodes = cut_lineage(
        counted.groupBy("node", "parent").agg(F.first("size").alias("size"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    )
    seen = [F.when(F.col(c) > 0, 1.0).otherwise(0.0) for c in ("c0", "c1")]
    heads = nodes.groupBy("parent").agg(
        *[F.sum(f"c{k}").alias(f"n{k}") for k in (0, 1)], *[F.sum(seen[k]).alias(f"types{k}") for k in (0, 1)]
    )
    shared = (seen[0] + seen[1]) / (F.col("types0") + F.col("types1"))

    def p(k):
        own = F.greatest(F.col(f"c{k}") - DISCOUNT, F.lit(0.0))
        return F.when(F.col(f"n{k}") > 0, (own + DISCOUNT * F.col(f"types{k}") * shared) / F.col(f"n{k}")).otherwise(shared)

    own = nodes.where((F.col("c0") > DISCOUNT) | (F.col("c1") > DISCOUNT))  # a beginning's own beginnings pass as well
    return own.join(heads, "parent").select("node", "parent", "size", F.log(p(1) / p(0)).alias("step"), F.log(p(0)).alias("plain"))


def counted(rows: DataFrame) -> Model:
    """The two models of rows of text and y."""
    found = rows.select("text", "y").mapInArrow(_beginnings, "node long, parent long, size int, c0 long, c1 long")
    got = _steps(found).toArrow()
    node, parent = (got.column(c).to_numpy().view(np.uint64) for c in ("node", "parent"))
    size, step, plain = (got.column(c).to_numpy() for c in ("size", "step", "plain"))
    rank = np.argsort(node)
    size = size[rank].astype(np.int64)
    model = Model(node[rank], np.append(step[rank], 0.0), np.append(plain[rank], 0.0), np.append(size, 0))
    above = lookup(parent[rank], model.beginnings)
    for k in range(2, ORDER + 1):  # a beginning's likelihood is the sum over its letters
        level = np.flatnonzero(size == k)
        for sums in (model.ratio, model.ordinary):
            sums[level] += sums[above[level]]
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts and calibrates on at most PER_CLASS documents of each class, chosen by a hash of doc_id."""
    order = F.xxhash64("doc_id")
    known = (
        labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).where(~_held_out())
    )
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    mean = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    if not sizes.get(0) or not sizes.get(1):
        return Model(constant=mean)
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(PER_CLASS)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.select("doc_id", "y", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).alias("tuned"))
    rows = cut_lineage(texts(docs).join(F.broadcast(picked), "doc_id"))  # 2 x PER_CLASS rows of three numbers
    model = counted(rows.where("not tuned"))

    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("e", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield batch(fields, [b.column(0), b.column(2), list(shared.value.evidence(b.column(1)))])

    tuned = rows.where("tuned").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y").mapInArrow(run, "doc_id long, y int, e array<double>")
    # repeated rows of a document may number more than the sample: one of each
    found = tuned.groupBy("doc_id").agg(F.max(F.struct("y", "e")).alias("r")).select("doc_id", "r.*").toArrow()
    y = found.column("y").to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return Model(constant=mean)
    e = np.array(found.column("e").to_pylist())
    weight = np.where(y == 1, mean / max(y.mean(), 1e-9), (1 - mean) / max(1 - y.mean(), 1e-9))
    model.weights = fit(e[:, :6], y, weight, ridge=1e-2)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, toxic_ll, ordinary_ll, score and predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # grows with PER_CLASS, not with the corpus
    fields = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("toxic_ll", pa.float64()), ("ordinary_ll", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = shared.value
                e = m.evidence(b.column(1))
                yield batch(fields, [b.column(0), m.score(e), *(pa.array(x, from_pandas=True) for x in e[:, 6:].T)])

    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, toxic_ll double, ordinary_ll double").select(
        "doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "toxic_ll", "ordinary_ll", "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )
