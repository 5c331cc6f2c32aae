"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Tokens are the lower-cased words of a text and one end token. A token's probability is that of its outcome, and
within the outcome that of the word. The most frequent words of the training texts are outcomes of their own, all
other words have a class by their last two bytes. The two tokens before predict a vector, an element-wise mix of their
context vectors; an outcome's score is its vector's product with that, plus a bias that starts at its log frequency.
The training texts are dealt into parts by a hash of their rows, as many as the number of training tokens asks for;
each part trains with AdaGrad against noise drawn from the outcome frequencies, and the parts' weights are averaged in
groups of bounded size, in a fixed order, after every round. A round takes a slice of every part's texts, so that all
rounds together read each text once; a table of fewer tokens than rounds times PART has fewer slices than rounds and
is read again. Scoring normalises over all outcomes.

Within a class every word found RARE times or more has a vector of its own, so their number grows with the corpus: the
word's score is that vector's product with the (standardised) context vector of the token before, plus the log of its
add-one share of the class's counts; the class keeps room for one unseen word. With the context vectors fixed, and
noise words drawn from the class's shares, the expected noise-contrastive objective of one word depends on no other
word's vector: words are solved in shards, from how often each context came before them, and stay a table. A table of
normalisers (contexts by classes) is summed over the shards, so a class's probabilities add up to one as well.

Counts cover all training texts (crc32(doc_id as text) mod 7 is not 2). The commonest words' counts and vectors go to
the tasks as a table of bounded size, the others of a text are sent to their shards, where a task holds one shard's words
at a time and reads the texts' words as a stream, so no word is hot. Words are told apart by 64-bit hashes. Words equally frequent at the last place among the outcomes are chosen by hash.

Null or empty texts have the end token alone. A null doc_id counts as training text. Repeated rows count
and are scored each for itself. Without training texts counts are zero and the model has its starting
weights. An empty table gives an empty result. Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm.text import BYTE, LOWER, Block, Rolling, batch, blocks, firsts, lookup, mix, texts, totals
from trajspark.plans.scratch import cut_lineage, scratch_path

#: Words that are outcomes of their own, classes of other words, and length of the vectors.
OUTCOMES, CLASSES, DIM = 1024, 64, 24
#: Words whose counts are sent to all tasks.
COMMON = 1 << 18
#: Noise samples shared by a batch of tokens.
NOISE, BATCH = 128, 4096
#: Step of the first round; later ones divide it by the root of their number.
RATE = 0.1
#: Weights or normalisers added up by one task.
FAN_IN = 64
#: Training tokens of a part, rounds of training, and tokens that are shuffled together.
PART, ROUNDS, CHUNK = 1 << 20, 4, 1 << 17
#: Least occurrences of a word with a vector of its own inside its class; words solved together.
RARE, SHARD, SHARD_TOKENS = 2, 1 << 15, 1 << 21
#: Occurrences from which a word's contexts are counted as its shard gathers them.
HEAVY = 1 << 12
#: Least occurrences of words that share rows, one for each shard, and how many a shard's row has on average.
PACK, ROW = 1 << 20, 1 << 8
#: Noise of each word's objective per occurrence, its ridge, steps, and the largest product of two vectors.
TAIL_NOISE, TAIL_RIDGE, TAIL_STEPS, TAIL_TOP = 8.0, 4.0, 4, 8.0

_END = np.uint64(0x5EED0FE2D)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def _tokens(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, class of the ending and text of every token, ends included."""
    start, end = b.words()
    low = LOWER[b.data]
    word = Rolling(BYTE[low]).slices(start, end)
    last = low[end - 1].astype(np.uint64)
    before = np.where(end - start > 1, low[end - 2], 0).astype(np.uint64)
    ending = (mix(last * np.uint64(256) + before) % np.uint64(CLASSES)).astype(np.int64)
    owner = b.owner(start)
    size = len(word) + b.n
    ends = np.cumsum(np.diff(firsts(owner, b.n)) + 1) - 1
    hashes, classes, whose = np.full(size, _END, np.uint64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = np.arange(len(word)) + owner
    hashes[at], classes[at], whose[at] = word, ending, owner
    whose[ends] = np.arange(b.n)
    return hashes, classes, whose


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = pa.schema([("word", pa.int64()), ("class", pa.int32()), ("n", pa.int64())])

    def counted(some: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        word, classes = (np.concatenate(x) for x in zip(*some))
        order = np.argsort(word)
        word = word[order]
        head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        return batch(fields, [word[head].view(np.int64), classes[order[head]].astype(np.int32), np.diff(np.append(head, len(word)))])

    some, size = [], 0
    for rows in batches:
        for b in blocks(rows.column(0)):
            hashes, classes, _ = _tokens(b)
            some.append((hashes, classes.astype(np.uint8)))
            size += len(hashes)
            if size >= 2 * PACK:
                yield counted(some)
                some, size = [], 0
    if size:
        yield counted(some)


class Places:
    """Places of hashes in a sorted table, found from the bucket of their leading bits."""

    def __init__(self, table: np.ndarray):
        bits = len(table).bit_length() + 1
        self.size, self.shift = len(table), np.uint64(64 - bits)
        self.first = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.table = np.append(table, np.uint64(2**64 - 1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The table's length where it does not have the key."""
        at = self.first[keys >> self.shift]
        here = self.table[at]
        late = np.flatnonzero(here < keys)
        while len(late):
            at[late] += 1
            here[late] = self.table[at[late]]
            late = late[here[late] < keys[late]]
        return np.where(here == keys, at, self.size)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the common words
    counts: np.ndarray
    outcome: np.ndarray  # outcome of each common word, or -1
    noise: np.ndarray  # outcome frequencies
    log_rest: np.ndarray  # of each class, log10 of its counts with one for each word and an unseen one
    total: int
    vocabulary: int
    head: int = OUTCOMES  # words that are outcomes of their own
    weights: np.ndarray | None = None
    vectors: np.ndarray | None = None  # inside the class, of each common word
    classes: np.ndarray | None = None  # counts and number of words of each class
    inside: np.ndarray | None = None  # log of each class's sum over its words, per token before

    @property
    def size(self) -> int:
        return self.head + CLASSES

    @property
    def shards(self) -> int:
        """Groups of words inside classes, by ranges of their hashes, that are solved together."""
        return max(1, -(-int(self.classes[:, 1].sum()) // SHARD), -(-int(self.classes[:, 0].sum()) // SHARD_TOKENS))

    @property
    def pack(self) -> int:
        """Occurrences that share rows: more for more shards, so rows grow with the occurrences alone."""
        return max(PACK, ROW * self.shards)

    def slim(self) -> Model:
        """Without the common words: all that codes of outcomes need."""
        end = self.words == _END
        return replace(self, words=self.words[end], counts=self.counts[end], outcome=self.outcome[end])

    def split(self, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Context vectors, target vectors, mixing vectors of the two places, biases."""
        k, d = self.size, DIM
        return w[: k * d].reshape(k, d), w[k * d : 2 * k * d].reshape(k, d), w[2 * k * d : 2 * (k + 1) * d].reshape(2, d), w[2 * (k + 1) * d :]

    def start(self) -> np.ndarray:
        """Small vectors, even mixing, and biases at the log frequencies."""
        k, d = self.size, DIM
        raw = mix(np.arange(2 * k * d, dtype=np.uint64)).astype(np.float64) / 2**64 - 0.5
        return np.concatenate([0.2 * raw, np.full(2 * d, 1.0), np.log(self.noise)]).astype(np.float32)

    def outcomes(self, hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outcome of every token, and its place among the common words."""
        at = self.places.find(hashes)
        own = np.append(self.outcome, -1)[at]
        return np.where(own >= 0, own, self.head + classes), at

    def contexts(self, outcome: np.ndarray, whose: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The two tokens before each; a text begins as if after two ends."""
        one = np.concatenate([[end], outcome[:-1]])
        two = np.concatenate([[end, end], outcome[:-2]])[: len(outcome)]
        two[np.flatnonzero(np.diff(whose, prepend=-1))] = end
        return one, two

    def before(self) -> np.ndarray:
        """Context vectors of the token before, standardised by frequency, for the words inside a class."""
        q = self.split(self.weights)[0].astype(np.float64)
        q = q - self.noise @ q
        return (q / np.maximum(np.sqrt(self.noise @ (q * q)), 1e-6)).clip(-4, 4).astype(np.float32)

    @property
    def end(self) -> int:
        at = int(lookup(np.array([_END]), self.words)[0])
        own = int(self.outcome[at]) if at < len(self.words) else -1
        return own if own >= 0 else self.head

    @cached_property
    def places(self) -> Places:
        return Places(self.words)

    @cached_property
    def scorer(self) -> Scorer:
        """Kept with a broadcast model, so the tasks of a worker share its normalisers."""
        return Scorer(self)


def learn(model: Model, stream: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], w: np.ndarray, seed: int, rate: float = RATE) -> tuple[np.ndarray, int]:
    """One pass of noise-contrastive estimation over batches of (outcome, one before, two before)."""
    w = w.copy()
    square = np.full(len(w), 1e-2, np.float32)
    q, r, c, bias = model.split(w)
    sq, sr, sc, sb = model.split(square)
    rng = np.random.default_rng(seed)
    draw = np.cumsum(model.noise)
    log_noise = np.log(NOISE * model.noise).astype(np.float32)
    seen, size = 0, model.size
    room = np.empty((BATCH, NOISE), np.float32)

    def scatter(at, values):
        """Sums of the rows of values by place."""
        flat = (at[:, None] * DIM + np.arange(DIM)).ravel()
        return np.bincount(flat, weights=values.ravel(), minlength=size * DIM).reshape(size, DIM)

    for target, one, two in stream:
        seen += len(target)
        noise = np.minimum(np.searchsorted(draw, rng.random(NOISE) * draw[-1]), size - 1)
        q1, q2 = q[one], q[two]
        h = c[0] * q1 + c[1] * q2
        own = r[target]
        good = np.einsum("ij,ij->i", h, own) + bias[target] - log_noise[target]
        down = np.matmul(h, -r[noise].T, out=room[: len(h)] if len(h) <= BATCH else None)
        down += log_noise[noise] - bias[noise]
        up = 1 / (1 + np.exp(np.clip(good, -30, 30)))
        np.exp(np.minimum(down, 30, out=down), out=down)
        down += 1
        np.divide(-1, down, out=down)
        gr = scatter(target, up[:, None] * h) + scatter(noise, down.T @ h)
        gb = np.bincount(target, weights=up, minlength=size)
        np.add.at(gb, noise, down.sum(0))
        own *= up[:, None]
        gh = np.add(own, down @ r[noise], out=own)
        gq = scatter(one, gh) * c[0] + scatter(two, gh) * c[1]
        gc = np.stack([np.einsum("ij,ij->j", gh, q1), np.einsum("ij,ij->j", gh, q2)])
        for value, acc, g in ((q, sq, gq), (r, sr, gr), (c, sc, gc), (bias, sb, gb)):
            g = g.astype(np.float32) / np.float32(np.sqrt(len(target)))
            acc += g * g
            value += rate * g / np.sqrt(acc)
    return w, seen


_WEIGHTS = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("w", pa.list_(pa.float64()))])
_WEIGHTS_SQL = "part int, n long, w array<double>"


def _total(parts: DataFrame, groups: int, fan_in: int) -> tuple[int, np.ndarray | None]:
    """Sums of n and w over the parts, added in the parts' order; no task holds more than fan_in of them."""

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        w = np.asarray(table.column("w").combine_chunks().flatten()).reshape(table.num_rows, -1)
        n = int(table.column("n").to_numpy().sum())
        return pa.table([table.column("group")[:1].cast(pa.int32()), [n], pa.array([w.sum(0)], _WEIGHTS.field("w").type)], schema=_WEIGHTS)

    while groups > 1:
        groups = -(-groups // fan_in)
        parts = cut_lineage(parts.withColumn("group", F.floor(F.col("part") / fan_in).cast("int")).groupBy("group").applyInArrow(fold, _WEIGHTS_SQL))
    rows = parts.toArrow()
    return (rows.column("n")[0].as_py(), np.asarray(rows.column("w")[0].values)) if rows.num_rows else (0, None)


def counts(docs: DataFrame) -> DataFrame:
    """word (hash), class and n over all training texts."""
    rows = texts(docs).where(~held_out()).select("text")
    found = rows.mapInArrow(_counts, "word long, class int, n long")
    return cut_lineage(found.groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n")))


def train(
    docs: DataFrame, table: DataFrame, outcomes: int = OUTCOMES, common: int = COMMON, fan_in: int = FAN_IN, part: int = PART, rounds: int = ROUNDS
) -> tuple[Model, DataFrame]:
    """The model but for the words inside classes, and the table of tokens they are learned from."""
    spark = docs.sparkSession
    classes = np.zeros((CLASSES, 2))
    totals_ = table.agg(F.sum("n"), F.count("*")).first()
    most = table.orderBy(F.desc("n"), "word").limit(common).toArrow()
    hashes = most.column("word").to_numpy().view(np.uint64)
    number = most.column("n").to_numpy()
    own = np.where(np.arange(len(hashes)) < outcomes, np.arange(len(hashes)), -1)
    head = hashes[:outcomes].view(np.int64)
    named = spark.createDataFrame(pa.table({"word": pa.array(head, pa.int64())})) if len(head) else None
    rest = table.join(F.broadcast(named), "word", "left_anti") if named is not None else table  # as many rows as outcomes
    for r in rest.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        classes[r["class"]] = r["n"], r["v"]
    noise = np.concatenate([np.zeros(outcomes), classes[:, 0] + 1])
    noise[: len(head)] = number[: len(head)]
    noise = np.maximum(noise, 1e-3)
    rank = np.argsort(hashes)
    model = Model(
        hashes[rank], number[rank], own[rank], noise / noise.sum(), np.log10(classes.sum(1) + 1), totals_[0] or 0, totals_[1] or 0, outcomes, classes=classes
    )
    model.weights = model.start()
    parts = max(1, -(-model.total // part))
    tokens = _token_table(docs, model)
    slices = min(max(1, model.total // part), rounds)
    for k in range(rounds):
        done = _round(_sequences(tokens, parts, slices, k), model, RATE / (k + 1) ** 0.5, 17 + k * parts)
        n, sums = _total(done, parts, fan_in)
        if n:
            model.weights = (sums / n).astype(np.float32)
    return model, tokens


_TOKENS = pa.schema(
    [("key", pa.int64()), ("class", pa.int32()), ("codes", pa.binary()), ("n", pa.int64())]
    + [(name, pa.binary()) for name in ("words", "classes", "times")]
)


def _cut(values: np.ndarray, bounds: list[int]) -> list[bytes]:
    """The bytes of each stretch of an array."""
    return [values[x:y].tobytes() for x, y in zip(bounds, bounds[1:])]


def _by_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the hashes, and the shard of each in that order; a shard holds a range of hashes."""
    order = np.argsort(hashes)
    return order, ((hashes[order] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _token_table(docs: DataFrame, model: Model) -> DataFrame:
    """The training texts' tokens, read once for all that follows.

    A text has a hash as its key, its outcomes as codes of two bytes, and their number as n. The words inside classes of
    about PACK occurrences have one row for each shard, its key, with -1 as class: their hashes, classes and times, and as
    codes the outcomes before them, word by word."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # as many words as common

    def packed(m: Model, some: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        hashes, c, o = (np.concatenate(x) for x in zip(*some))
        order, shard = _by_shard(hashes, m.shards)
        w, c, o = hashes[order], c[order], o[order]
        head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        new = np.flatnonzero(np.append(True, np.diff(shard[head]) != 0))  # the first word of each shard
        heads, codes = np.append(new, len(head)).tolist(), np.append(head[new], len(w)).tolist()
        times = np.diff(np.append(head, len(w))).astype(np.uint32)
        packed = [_cut(w[head], heads), _cut(c[head], heads), _cut(times, heads)]
        return batch(_TOKENS, [shard[head[new]], np.full(len(new), -1, np.int32), _cut(o, codes), pa.nulls(len(new), pa.int64()), *packed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        number = np.append(m.counts, RARE)
        some, size = [], 0
        for rows in batches:
            key = rows.column(0)
            for b in blocks(rows.column(1)):
                hashes, classes, whose = _tokens(b)
                outcome, at = m.outcomes(hashes, classes)
                ends = firsts(whose, b.n)
                none = [pa.nulls(b.n, pa.binary())] * 3
                yield batch(_TOKENS, [key.slice(b.first, b.n), pa.nulls(b.n, pa.int32()), _cut(outcome.astype(np.uint16), ends.tolist()), np.diff(ends), *none])
                inside = np.flatnonzero((outcome >= m.head) & (number[at] >= RARE))
                one = m.contexts(outcome, whose, m.end)[0][inside]
                some.append((hashes[inside], (outcome[inside] - m.head).astype(np.uint8), one.astype(np.uint16)))
                size += len(inside)
                if size >= m.pack:
                    yield packed(m, some)
                    some, size = [], 0
        if size:
            yield packed(m, some)

    rows = texts(docs).where(~held_out()).select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key"), "text")
    path = scratch_path(spark, "tokens")
    kinds = "key long, class int, codes binary, n long, words binary, classes binary, times binary"
    rows.mapInArrow(run, kinds).write.option("compression", "zstd").parquet(path)
    shared.destroy()  # every executor holds a copy on disk
    return spark.read.parquet(path)


def _sequences(tokens: DataFrame, parts: int, slices: int, k: int) -> DataFrame:
    """part and codes of a slice of the training texts, rows of a part together and in a fixed order."""
    rows = tokens.where(F.col("class").isNull() & (F.pmod(F.shiftright("key", 20), F.lit(slices)) == k % slices))
    dealt = rows.select(F.pmod("key", F.lit(parts)).cast("int").alias("part"), "key", "codes")
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "key", "codes").select("part", "codes")


def _round(sequences: DataFrame, model: Model, rate: float, seed: int) -> DataFrame:
    """Each part's tokens and its weights, times their number, after one pass from the model's weights."""
    shared = sequences.sparkSession.sparkContext.broadcast(model.slim())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        texts_ = ((p, o) for rows in batches for p, o in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
        for at, group in groupby(texts_, lambda r: r[0]):
            w, n = learn(m, _shuffled(m, (np.frombuffer(o, np.uint16).astype(np.int64) for _, o in group)), m.weights, seed + at, rate)
            yield batch(_WEIGHTS, [[at], [n], [w.astype(np.float64) * n]])

    done = cut_lineage(sequences.mapInArrow(run, _WEIGHTS_SQL))
    shared.destroy()  # every executor holds a copy on disk
    return done


def _shuffled(m: Model, sequences: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of (outcome, one before, two before); texts are taken in turn until they make a chunk."""
    some, size = [], 0
    for s in chain(sequences, [None]):
        if s is not None:
            some.append(s)
            size += len(s)
        if some and (s is None or size >= CHUNK):
            outcome = np.concatenate(some)
            one, two = m.contexts(outcome, np.repeat(np.arange(len(some)), [len(x) for x in some]), m.end)
            order = np.random.default_rng(len(outcome)).permutation(len(outcome))
            for k in range(0, len(order), BATCH):
                at = order[k : k + BATCH]
                yield outcome[at], one[at], two[at]
            some, size = [], 0


def _befores(tokens: DataFrame, model: Model, fan_in: int) -> np.ndarray:
    """How often each outcome came before each class: classes by outcomes."""
    head, size, end = model.head, model.size, model.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(CLASSES * size, np.int64), None
        for rows in batches:
            for p, codes in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                part = p if part is None else part
                own = np.frombuffer(codes, np.uint16).astype(np.int64)
                one = np.append(end, own[:-1])
                at = own >= head
                np.add.at(seen, (own[at] - head) * size + one[at], 1)
        if part is not None:
            yield batch(_WEIGHTS, [[part], [1], [seen.astype(np.float64)]])

    rows = tokens.where("class is null").select(F.spark_partition_id().alias("part"), "codes")
    found = cut_lineage(rows.mapInArrow(run, _WEIGHTS_SQL))
    last = found.agg(F.max("part")).first()[0]
    sums = _total(found, (last or 0) + 1, fan_in)[1]
    return sums.reshape(CLASSES, size) if sums is not None else np.zeros((CLASSES, size))


def solve(n: np.ndarray, share: np.ndarray, seen: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Vectors of words of one class: n, times of each word after each context; share, of each word in its class;
    seen, times of the class after each context. Maximises n log s(x) + k share seen log s(-x), x = product - log k,
    less a ridge, by steps under a bound of its curvature."""
    k = TAIL_NOISE
    total = max(seen.sum(), 1.0)
    spread = (before * (seen / total)[:, None]).T @ before
    value, turn = np.linalg.eigh(spread + 1e-9 * np.eye(DIM))
    weight = n.sum(1) + k * share * total
    scale = (1 / (0.25 * weight[:, None] * np.maximum(value, 0) + TAIL_RIDGE)).astype(np.float32)
    n, before, turn, k = n.astype(np.float32), before.astype(np.float32), turn.astype(np.float32), np.float32(k)
    both, r = np.multiply.outer((TAIL_NOISE * share).astype(np.float32), seen.astype(np.float32)), np.zeros((len(n), DIM), np.float32)
    both += n
    p, away = np.empty_like(both), np.ascontiguousarray(-before.T)
    for step in range(TAIL_STEPS):
        if step:
            np.matmul(r, away, out=p)
            np.exp(np.clip(p, -np.float32(TAIL_TOP), np.float32(TAIL_TOP), out=p), out=p)
            p *= k
            p += 1
            np.divide(both, p, out=p)
        else:  # all products are zero
            np.divide(both, 1 + k, out=p)
        np.subtract(n, p, out=p)
        g = p @ before - np.float32(TAIL_RIDGE) * r
        r += (g @ turn * scale) @ turn.T
    return r


class _Contexts:
    """Occurrences of a shard's words by the outcome before them, with times; equal ones of words found HEAVY times or
    more are counted once they fill twice a shard's room, so a shard's memory does not grow with its words' occurrences."""

    def __init__(self):
        self.words, self.classes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.parts, self.size = [], 0

    def add(self, rows: pa.RecordBatch) -> None:
        def joined(column, kind):
            return np.frombuffer(b"".join(rows.column(column).to_pylist()), kind)

        word, times, code = joined("words", np.uint64), joined("times", np.uint32).astype(np.int64), joined("codes", np.uint16)
        self.parts.append((word, joined("classes", np.uint8).astype(np.int64), times, code, np.ones(len(code), np.uint32)))
        self.size += len(code)
        if self.size > 2 * SHARD_TOKENS:
            self.count()
            whose, one, n = self.rows
            total = np.bincount(whose, minlength=len(self.words))
            many = total[whose] >= HEAVY
            if many.any():
                pair, place = np.unique(whose[many] << 16 | one[many], return_inverse=True)
                n = np.concatenate([n[~many], np.bincount(place, weights=n[many]).astype(n.dtype)])
                whose, one = np.concatenate([whose[~many], pair >> 16]), np.concatenate([one[~many], pair & 0xFFFF])
                order = np.argsort(whose, kind="stable")
                whose, one, n = whose[order], one[order], n[order]
            times = np.bincount(whose, minlength=len(self.words))
            self.parts, self.size = [(self.words, self.classes, times, one, n)], len(one)

    def count(self) -> None:
        """Words in order, their classes, and rows of (place of the word, outcome before, times)."""
        word, cls, times, one, n = (np.concatenate(x) for x in zip(*self.parts))
        self.words, first, place = np.unique(word, return_index=True, return_inverse=True)
        self.classes = cls[first]
        self.rows = np.repeat(place, times), one.astype(np.int64), n.astype(np.int64)


_SOLVED = pa.schema([("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("vectors", pa.binary()), ("w", pa.list_(pa.float64()))])


def _unpacked(words: bytes, counts: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of a shard's words, their counts, and vectors of those found RARE times or more."""
    return np.frombuffer(words, np.uint64), np.frombuffer(counts, np.int64), np.frombuffer(vectors, np.float32).reshape(-1, DIM)


def shards(tokens: DataFrame, model: Model, fan_in: int = FAN_IN) -> DataFrame:
    """A row for each shard of the words inside classes: hashes, counts and vectors as bytes; sets the model's
    normalisers and the common words' vectors. Words found once have no vector; common ones among them are left out."""
    spark, classes = tokens.sparkSession, model.classes
    seen = _befores(tokens, model, fan_in)
    room = classes.sum(1) + 1
    known = spark.sparkContext.broadcast((model.before().astype(np.float64), seen, room, model.size))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen, room, size = known.value
        narrow = before.astype(np.float32)
        found, part = _Contexts(), None
        for rows in batches:
            part = rows.column("part")[0].as_py()
            found.add(rows)
        found.count()
        names, cls_of, (whose, one, n) = found.words, found.classes, found.rows
        count = np.bincount(whose, weights=n, minlength=len(names)).astype(np.int64)
        kept = np.flatnonzero(count >= RARE)
        mine = kept[np.argsort(cls_of[kept], kind="stable")]  # by class
        place = np.full(len(names), -1)
        place[mine] = np.arange(len(mine))
        whose = place[whose]
        order = np.argsort(whose, kind="stable")
        whose, one, n = whose[order], one[order], n[order]
        out, sums = np.zeros((len(names), DIM), np.float32), np.zeros((CLASSES, size))
        bounds = np.searchsorted(cls_of[mine], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            for k in range(bounds[c], bounds[c + 1], 256):
                some = mine[k : min(k + 256, bounds[c + 1])]
                at = slice(*np.searchsorted(whose, [k, k + len(some)]))
                times = np.bincount((whose[at] - k) * size + one[at], weights=n[at], minlength=len(some) * size).reshape(-1, size)
                share = (count[some] + 1) / room[c]
                r = solve(times, share, seen[c], before)
                x = r @ narrow.T
                np.exp(np.clip(x, -np.float32(TAIL_TOP), np.float32(TAIL_TOP), out=x), out=x)
                x -= 1
                sums[c] += share.astype(np.float32) @ x
                out[some] = r
        yield batch(_SOLVED, [[part], [names.tobytes()], [count.tobytes()], [out[kept].tobytes()], [sums.ravel()]])

    dealt = tokens.where("class < 0").select(F.col("key").cast("int").alias("part"), "codes", "words", "classes", "times")
    path = scratch_path(spark, "vectors")
    solved = dealt.groupBy("part").applyInArrow(fold, "part int, words binary, counts binary, vectors binary, w array<double>")
    solved.write.option("compression", "zstd").parquet(path)
    known.destroy()  # every executor holds a copy on disk
    solved = spark.read.parquet(path)
    sums = _total(solved.select("part", F.lit(0).cast("long").alias("n"), "w"), model.shards, fan_in)[1]
    model.inside = np.log1p(sums.reshape(CLASSES, model.size).T if sums is not None else np.zeros((model.size, CLASSES))).astype(np.float32)
    solved = solved.drop("w")
    names = spark.sparkContext.broadcast(model.words)
    some = _vectors(solved, names).toArrow()  # as many words as common
    names.destroy()
    model.vectors = np.zeros((len(model.words), DIM), np.float32)
    if some.num_rows:
        at = lookup(some.column("word").to_numpy().view(np.uint64), model.words)
        model.vectors[at] = np.frombuffer(b"".join(some.column("vector").to_pylist()), np.float32).reshape(-1, DIM)
    return solved


def _vectors(solved: DataFrame, names: Broadcast | None = None) -> DataFrame:
    """word and vector (floats, as bytes) of the shards' words, or of those among the sorted names."""
    fields = pa.schema([("word", pa.int64()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for packed in zip(*(rows.column(k).to_pylist() for k in range(3))):
                words, count, vectors = _unpacked(*packed)
                words = words[count >= RARE]
                if names is not None:
                    some = lookup(words, names.value) < len(names.value)
                    words, vectors = words[some], vectors[some]
                yield batch(fields, [words.view(np.int64), [v.tobytes() for v in vectors]])

    return solved.select("words", "counts", "vectors").mapInArrow(run, "word long, vector binary")


def tail(tokens: DataFrame, model: Model, fan_in: int = FAN_IN) -> DataFrame:
    """word and vector (floats, as bytes) of the words inside classes; sets what ``shards`` sets."""
    return _vectors(shards(tokens, model, fan_in))


class Scorer:
    """Log10 probabilities of outcomes, with the normaliser of each context kept once it is known."""

    def __init__(self, model: Model):
        self.model = model
        self.q, self.r, self.c, self.bias = model.split(model.weights)
        self.norm = np.full((model.size, model.size), np.nan, np.float32)
        self.number = np.append(np.log10(model.counts + 1.0), 0.0)
        self.end = model.end
        self.before = model.before()
        self.vectors = np.vstack([model.vectors, np.zeros((1, DIM), np.float32)])

    def normalisers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        flat = self.norm.ravel()
        key = one * self.model.size + two
        new = np.unique(key[np.isnan(flat[key])])
        for k in range(0, len(new), 2048):
            part = new[k : k + 2048]
            h = self.c[0] * self.q[part // self.model.size] + self.c[1] * self.q[part % self.model.size]
            s = h @ self.r.T + self.bias
            top = s.max(1)
            flat[part] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return flat[key]

    def score(self, b: Block) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known ones, sum of log10(c + 1), model score without the rarest words' shares;
        per rare token: its text, hash and the token before."""
        m = self.model
        hashes, classes, whose = _tokens(b)
        outcome, at = m.outcomes(hashes, classes)
        one, two = m.contexts(outcome, whose, self.end)
        norm = self.normalisers(one, two)
        p = np.empty(len(outcome))
        for k in range(0, len(outcome), 1 << 13):
            s = slice(k, k + (1 << 13))
            h = self.c[0] * self.q[one[s]] + self.c[1] * self.q[two[s]]
            p[s] = np.einsum("ij,ij->i", h, self.r[outcome[s]]) + self.bias[outcome[s]] - norm[s]
        p /= np.log(10)
        share = self.number[at]
        classed = outcome >= m.head
        own = outcome[classed] - m.head
        p[classed] += share[classed] - m.log_rest[own]
        inside = np.einsum("ij,ij->i", self.vectors[at[classed]], self.before[one[classed]]).clip(-TAIL_TOP, TAIL_TOP)
        p[classed] += (inside - m.inside[one[classed], own]) / np.log(10)
        known = at < len(m.words)
        bounds = firsts(whose, b.n)
        return np.diff(bounds), totals(known, bounds), totals(share, bounds), totals(p, bounds), whose[~known], hashes[~known], one[~known]


_PIECES = pa.schema(
    [("block", pa.int64()), ("part", pa.int32())]
    + [(name, pa.list_(kind)) for name, kind in (("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("share", pa.float64()), ("p", pa.float64()))]
    + [(name, pa.binary()) for name in ("texts", "words", "seen")]
)
_PIECES_SQL = (
    "block long, part int, doc_id array<long>, n_tokens array<long>, n_known array<long>, share array<double>, p array<double>, "
    "texts binary, words binary, seen binary"
)
_MET = pa.schema(list(_PIECES)[:7] + [(name, pa.binary()) for name in ("texts", "known", "rare", "product")])
_MET_SQL = _PIECES_SQL.replace("words binary, seen binary", "known binary, rare binary, product binary")


def _pieces(m: Model, some: list[tuple]) -> Iterator[pa.RecordBatch]:
    """A row of a block of texts, with what is known of each, and a row for each shard of their rarer words."""
    row, doc, n, known, share, p, whose, hashes, one = zip(*some)
    block, size = int(row[0][0]), sum(map(len, n))
    first = np.cumsum([0, *map(len, n)])
    listed = [pa.ListArray.from_arrays([0, size], v) for v in (pa.concat_arrays(doc), *(pa.array(np.concatenate(v)) for v in (n, known, share, p)))]
    yield batch(_PIECES, [[block], [block % m.shards], *listed, *[pa.nulls(1, pa.binary())] * 3])
    hashes, one = np.concatenate(hashes), np.concatenate(one).astype(np.uint16)
    whose = np.concatenate([w + k for w, k in zip(whose, first)]).astype(np.uint32)
    if len(hashes):
        order, shard = _by_shard(hashes, m.shards)
        new = np.flatnonzero(np.append(True, np.diff(shard) != 0))
        bounds = np.append(new, len(order)).tolist()
        packed = [_cut(v[order], bounds) for v in (whose, hashes, one)]
        none = [pa.nulls(len(new), f.type) for f in list(_PIECES)[2:7]]
        yield batch(_PIECES, [np.full(len(new), block), shard[new].astype(np.int32), *none, *packed])


def _met(before: np.ndarray, shard: tuple[np.ndarray, ...], whose: bytes, words: bytes, seen: bytes) -> list[bytes] | None:
    """Of a block's words in a shard, summed by text: known ones, log10 of count + 1, log10 of the part of the score that
    is their vectors' products with the tokens before."""
    names, count, place, vectors = shard
    at = lookup(np.frombuffer(words, np.uint64), names)
    found = np.flatnonzero(at < len(names))
    if not len(found):
        return None
    whose = np.frombuffer(whose, np.uint32)[found]
    order = np.argsort(whose, kind="stable")
    found, whose = found[order], whose[order]
    at, one = at[found], np.frombuffer(seen, np.uint16)[found]
    head = np.flatnonzero(np.append(True, whose[1:] != whose[:-1]))
    product, own = np.zeros(len(at)), count[at] >= RARE
    product[own] = np.einsum("ij,ij->i", vectors[place[at[own]]], before[one[own]]).clip(-TAIL_TOP, TAIL_TOP) / np.log(10)
    known = np.diff(np.append(head, len(at)))
    sums = [np.add.reduceat(v, head) for v in (np.log10(count[at] + 1.0), product)]
    return [v.tobytes() for v in (whose[head], known, *sums)]


def _gathered(table: pa.Table) -> pa.Table:
    """The rows of a block's texts, with the sums of their rarer words, shard by shard."""
    table = table.sort_by("part")
    own = table.filter(pc.is_valid(table.column("doc_id")))
    doc, n, known, share, p = (own.column(k).combine_chunks().flatten() for k in ("doc_id", "n_tokens", "n_known", "share", "p"))
    rest = table.filter(pc.is_valid(table.column("texts")))
    kinds = {"texts": np.uint32, "known": np.int64, "rare": np.float64, "product": np.float64}
    whose, more, rare, product = (np.frombuffer(b"".join(rest.column(k).to_pylist()), kind) for k, kind in kinds.items())
    more, rare, product = (np.bincount(whose, weights=v, minlength=len(n)) for v in (more, rare, product))
    known = known.to_numpy() + more.astype(np.int64)
    return pa.table({"doc_id": doc, "n_tokens": n, "n_known": known, "share": share.to_numpy() + rare, "p": p.to_numpy() + rare + product})


def score(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Common words are scored with their text. The others of about PACK occurrences travel as one row for each shard to the
    shard's words, counts and vectors, which come first in their task, and the texts' sums travel back to their block."""
    spark = docs.sparkSession
    table = counts(docs)
    model, tokens = train(docs, table, **options)
    solved = shards(tokens, model, options.get("fan_in", FAN_IN))
    shared = spark.sparkContext.broadcast(model)  # bounded as in train
    total, vocabulary = model.total, model.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        some, size = [], 0
        for rows in batches:
            row, doc = rows.column(0).to_numpy(), rows.column(1)
            for b in blocks(rows.column(2)):
                *found, whose, hashes, one = m.scorer.score(b)
                if not total:  # no word is known
                    whose, hashes, one = whose[:0], hashes[:0], one[:0]
                some.append((row[b.first : b.first + b.n], doc.slice(b.first, b.n), *found, whose, hashes, one))
                size += len(hashes) + 8 * b.n
                if size >= m.pack:
                    yield from _pieces(m, some)
                    some, size = [], 0
        if some:
            yield from _pieces(m, some)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, none = shared.value.before(), np.zeros(0, np.int64)
        part, shard = None, (none.view(np.uint64), none, none, np.zeros((0, DIM), np.float32))
        for rows in batches:
            own = rows.filter(pc.is_valid(rows.column("doc_id")))
            yield batch(_MET, [*own.columns[:7], *[pa.nulls(own.num_rows, pa.binary())] * 4])
            out = []
            rest = rows.filter(pc.is_null(rows.column("doc_id"))).select(["block", "part", "texts", "words", "seen", "counts", "vectors"])
            for block, at, whose, words, seen, count, vectors in zip(*(c.to_pylist() for c in rest.columns)):
                if block is None:
                    names, count, vectors = _unpacked(words, count, vectors)
                    part, shard = at, (names, count, np.cumsum(count >= RARE) - 1, vectors)
                elif at == part and (sums := _met(before, shard, whose, words, seen)):
                    out.append((block, at, *sums))
            if out:
                block, at, *sums = zip(*out)
                yield batch(_MET, [block, at, *[pa.nulls(len(out), f.type) for f in list(_MET)[2:7]], *sums])

    rows = texts(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = rows.mapInArrow(run, _PIECES_SQL).unionByName(solved, allowMissingColumns=True)
    dealt = pieces.repartition(model.shards, "part").sortWithinPartitions("part", F.col("block").asc_nulls_first())
    met = dealt.mapInArrow(meet, _MET_SQL)
    out = met.groupBy("block").applyInArrow(_gathered, "doc_id long, n_tokens long, n_known long, share double, p double")
    base = float(np.log10(total + vocabulary + 1))
    return out.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("share") - F.col("n_tokens") * F.lit(base)).alias("base_score"), F.col("p").alias("score"),
    )
