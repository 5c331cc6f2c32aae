"""Ranked lexical search: an index of document shards, searched by Block-Max MaxScore.

Index. Each task cuts its documents into shards of bounded size and turns a shard into one row: sorted term
hashes, and for each term a list of blocks of up to BLOCK postings. A block's postings (document ordinal
gaps and term counts) are packed as variable-length bytes. Beside them lie its last ordinal and what bounds
its scores whatever the corpus: the shortest document holding the term once, the shortest holding it more
often, and its largest count. So the index needs no corpus statistics and may grow by further shards.

Search. The number and length of documents come from the shards' columns, document frequencies from their
list lengths. In a shard the lists of an item are taken by falling bound. As long as the bounds that remain
could together reach the item's 50th score so far, lists are essential and are read whole; the rest are not:
their blocks' bounds first reject candidates, and only blocks that a surviving candidate lies in are unpacked.
A task carries one heap per item through all its shards, so its later shards prune more; the heaps are then
merged, first within parts, then in all.

A null or empty text has no terms: such documents are never found and do not count, items without terms have
no rows. Rows sharing an item_id form one item with the terms of all; rows of documents are ranked one by one
even where doc_ids repeat. Null doc_ids come last among equal scores. Empty tables give an empty result. Other
columns are ignored. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.llm.text import BYTE, LOWER, SEP, Rolling, batch, blocks, firsts, texts
from trajspark.plans.scratch import cut_lineage, scratch_path

TOP = 50
BLOCK = 64
#: Documents and (document, term) pairs that close a shard.
SHARD_DOCS, SHARD_PAIRS = 1 << 13, 1 << 20
#: Items searched at a time: their terms are sent to every task.
ITEMS = 4096
#: Parts in which task heaps are merged first.
MERGE = 64
FAR = np.int64(2**31 - 1)

#: Bytes that no term holds: ASCII but for digits and letters, and the mark between texts.
GAP = np.array([b < 0x80 and not chr(b).isalnum() or b == SEP for b in range(256)])

_SHARD = pa.schema(
    [("docs", pa.int64()), ("terms", pa.int64())]
    + [(c, pa.binary()) for c in ("doc_id", "known", "size", "term", "df", "block", "last", "once", "more", "most", "at", "payload")]
)


def _pairs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(document, term hash) occurrences of blocks of texts: owner, hash, terms of each text, first text, texts."""
    for b in blocks(column):
        start, end = b.words(GAP)
        owner = b.owner(start)
        yield owner, Rolling(BYTE[LOWER[b.data]]).slices(start, end), np.bincount(owner, minlength=b.n), b.first, b.n


def _hashed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The hashes of each text's terms."""
    for column in columns:
        lists = [[]] * len(column)
        for owner, key, _, first, n in _pairs(column):
            bounds = firsts(owner, n)
            lists[first : first + n] = [key[a:b].view(np.int64).tolist() for a, b in zip(bounds, bounds[1:])]
        yield pa.array(lists, pa.list_(pa.int64()))


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of numbers below 2**35, and how many bytes each takes."""
    width = 1 + sum((values >> (7 * k) > 0).astype(np.int64) for k in range(1, 5))
    out = np.zeros(int(width.sum()), np.uint8)
    first = np.cumsum(width) - width
    for k in range(5):
        has = width > k
        out[first[has] + k] = (values[has] >> (7 * k) & 127) | np.where(width[has] > k + 1, 128, 0)
    return out, width


def unpack(data: np.ndarray) -> np.ndarray:
    stop = np.flatnonzero(data < 128)
    first = np.concatenate([[0], stop[:-1] + 1])
    value = np.zeros(len(stop), np.int64)
    for k in range(5):
        has = first + k <= stop
        value[has] |= (data[first[has] + k].astype(np.int64) & 127) << (7 * k)
    return value


def _shard(doc_id: list, size: np.ndarray, owner: np.ndarray, key: np.ndarray, count: np.ndarray) -> tuple:
    """The row of one shard, from its (document, term, count) triples."""
    order = np.lexsort((owner, key))
    owner, key, count = owner[order], key[order], count[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    df = np.diff(np.append(head, len(key)))
    per = -(-df // BLOCK)
    block = np.concatenate([[0], np.cumsum(per)])
    nth = np.arange(block[-1]) - np.repeat(block[:-1], per)
    lo = np.repeat(head, per) + nth * BLOCK
    hi = np.append(lo[1:], len(key))
    gap = np.diff(owner, prepend=-1)
    gap[lo] = owner[lo]  # a block's first ordinal stands whole
    data, width = pack(np.stack([gap, count], 1).ravel())
    ends = np.concatenate([[0], np.cumsum(width)])
    n, many = size[owner], count > 1
    once = np.minimum.reduceat(np.where(many, FAR, n), lo) if len(lo) else lo
    more = np.minimum.reduceat(np.where(many, n, FAR), lo) if len(lo) else lo
    most = np.maximum.reduceat(count, lo) if len(lo) else lo
    last = owner[hi - 1] if len(lo) else lo
    at = ends[2 * np.append(lo, len(key))]
    known = np.array([d is not None for d in doc_id], bool)
    ids = np.array([0 if d is None else d for d in doc_id], np.int64)
    as_int = [x.astype(np.int32) for x in (size, df, block, last, once, more, most)]
    size, df, block, last, once, more, most = [x.tobytes() for x in as_int]
    return (
        int((n_ := as_int[0] > 0).sum()), int(as_int[0][n_].sum(dtype=np.int64)), ids.tobytes(), known.tobytes(), size,
        key[head].tobytes(), df, block, last, once, more, most, at.astype(np.int64).tobytes(), data.tobytes(),
    )


def index(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """One row per shard of documents. No shuffle: a task indexes the rows it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, parts, pairs = [], [], [], 0

        def row():
            size = np.concatenate(sizes)
            owner, key, count = (np.concatenate(x) for x in zip(*parts))
            return batch(_SHARD, [[c] for c in _shard(ids, size, owner, key, count)])

        for rows in batches:
            doc_id = rows.column(0).to_pylist()
            for owner, key, size, first, n in _pairs(rows.column(1)):
                order = np.lexsort((key, owner))
                owner, key = owner[order], key[order]
                head = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
                parts.append((owner[head] + len(ids), key[head], np.diff(np.append(head, len(key)))))
                ids += doc_id[first : first + n]
                sizes.append(size)
                pairs += len(head)
                if len(ids) >= shard_docs or pairs >= shard_pairs:
                    yield row()
                    ids, sizes, parts, pairs = [], [], [], 0
        if ids:
            yield row()

    rows = texts(docs)
    return rows.select(rows.doc_id.cast("long"), "text").mapInArrow(
        run, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in _SHARD)
    )


class Scorer:
    """The contract's integer scores, for a corpus of ``n`` documents and ``total`` terms."""

    def __init__(self, n: int, total: int):
        self.n, self.total = n, total

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n + 2) / (2 * df + 1)))

    def norm(self, size: np.ndarray) -> np.ndarray:
        wide = len(size) and 50 * int(size.max()) * self.n >= 1 << 63  # then in numbers of any length
        return (50 + (50 * size.astype(object if wide else np.int64) * self.n) // self.total).astype(np.int64)

    @staticmethod
    def impact(count: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * count // (1000 * count + 20 * norm)


class Shard:
    """One shard's columns, and the search for one item in it."""

    def __init__(self, row: dict, scorer: Scorer):
        for name, kind in [
            ("doc_id", np.int64), ("known", bool), ("size", np.int32), ("term", np.uint64), ("df", np.int32), ("block", np.int32),
            ("last", np.int32), ("once", np.int32), ("more", np.int32), ("most", np.int32), ("at", np.int64), ("payload", np.uint8),
        ]:
            setattr(self, name, np.frombuffer(row[name], kind))
        self.scorer = scorer
        self.norm = scorer.norm(self.size)
        held_once, most = self.once < FAR, self.most.astype(np.int64)
        single = scorer.impact(np.ones_like(most), scorer.norm(np.where(held_once, self.once, 0)))
        several = scorer.impact(most, scorer.norm(np.where(most > 1, self.more, 0)))
        #: No posting of a block scores more: impacts grow with the count and fall with the length.
        self.bound = np.maximum(np.where(held_once, single, 0), np.where(most > 1, several, 0))
        self.whole = np.maximum.reduceat(self.bound, self.block[:-1]) if len(self.term) else self.bound
        self.unpacked = 0

    def postings(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ordinals and impacts in the chosen blocks (ascending, of one list)."""
        self.unpacked += len(chosen)
        lo, hi = self.at[chosen], self.at[chosen + 1]
        data = np.concatenate([self.payload[a:b] for a, b in zip(lo.tolist(), hi.tolist())])
        pair = unpack(data).reshape(-1, 2)
        gap, count = pair[:, 0], pair[:, 1]
        # gaps add up to ordinals; every block starts anew
        ends = np.cumsum(np.add.reduceat((data < 128).astype(np.int64), np.cumsum(hi - lo) - (hi - lo))) // 2
        begin = np.concatenate([[0], ends[:-1]])
        summed = np.cumsum(gap)
        before = np.where(begin > 0, summed[begin - 1], 0)
        ordinal = summed - np.repeat(before, ends - begin)
        return ordinal, self.scorer.impact(count, self.norm[ordinal])

    def search(self, terms: np.ndarray, weights: np.ndarray, floor: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Ordinals and scores that may belong to an item's best, given that scores below ``floor`` do not."""
        place = np.searchsorted(self.term, terms)
        here = place < len(self.term)
        here[here] = self.term[place[here]] == terms[here]
        place, weights = place[here], weights[here]
        bound = weights * self.whole[place]
        order = np.argsort(-bound, kind="stable")
        place, weights, bound = place[order], weights[order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)
        score = np.zeros(len(self.size), np.int64)
        k = 0
        while k < len(place) and rest[k] >= floor:  # essential: a document only in these lists could still win
            t = place[k]
            ordinal, impact = self.postings(np.arange(self.block[t], self.block[t + 1]))
            score[ordinal] += weights[k] * impact
            k += 1
            floor = max(floor, _kth(score[score > 0], top))
        alive = np.flatnonzero((score > 0) & (score + rest[k] >= floor))
        for k in range(k, len(place)):
            if not len(alive):
                break
            lo, hi = self.block[place[k]], self.block[place[k] + 1]
            at = lo + np.searchsorted(self.last[lo:hi], alive)
            in_list = at < hi
            most = np.zeros(len(alive), np.int64)
            most[in_list] = weights[k] * self.bound[at[in_list]]
            keep = score[alive] + most + rest[k + 1] >= floor
            alive, chosen = alive[keep], np.unique(at[keep & in_list])
            if len(chosen):
                ordinal, impact = self.postings(chosen)
                score[ordinal] += weights[k] * impact
            floor = max(floor, _kth(score[alive], top))
        alive = alive[score[alive] >= floor]
        return alive, score[alive]


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest score, which k documents reach for certain, or 1 if there are fewer."""
    return max(int(np.partition(scores, len(scores) - k)[len(scores) - k]), 1) if len(scores) >= k else 1


def _best(doc: np.ndarray, known: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    return np.lexsort((doc, ~known, -score))[:top]


def _frequencies(shards: DataFrame, asked: np.ndarray) -> DataFrame:
    """term, df: in how many documents each of the asked terms occurs."""
    schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for rows in batches:
            for term, df in zip(rows.column(0), rows.column(1)):
                term, df = np.frombuffer(term.as_py(), np.uint64), np.frombuffer(df.as_py(), np.int32)
                at = np.searchsorted(term, asked)
                here = at < len(term)
                here[here] = term[at[here]] == asked[here]
                total[here] += df[at[here]]
        seen = total > 0
        yield batch(schema, [asked[seen].view(np.int64), total[seen]])

    return shards.select("term", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def search(shards: DataFrame, items: DataFrame, top: int = TOP, at_a_time: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score of each item's best documents.

    Items are taken in blocks of about ``at_a_time``: their terms and weights are what a task is sent, so that
    stays small however many items there are; every block reads the index once.
    """
    spark = shards.sparkSession
    stats = shards.agg(F.sum("docs"), F.sum("terms")).first()
    if not stats[1]:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    asked = items.select("item_id", F.explode(F.arrow_udf(_hashed, "array<long>")(F.col("text").cast("string"))).alias("term"))
    asked = asked.distinct()
    groups = max(1, -(-items.count() // at_a_time))
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for g in range(groups):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        found = _searched(shards, part, kind, Scorer(*stats), top)
        out = found if out is None else out.unionByName(found)
    return out


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """A shard is a row of megabytes, so tasks are handed a few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _searched(shards: DataFrame, asked: DataFrame, kind: str, scorer: Scorer, top: int) -> DataFrame:
    rows = asked.groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()  # one block of the query set
    names = [r.item_id for r in rows]
    terms = np.unique(np.array([t for r in rows for t in r.terms], np.int64).view(np.uint64))
    with _few_rows(shards.sparkSession):
        df = {r["term"]: r["df"] for r in _frequencies(shards, terms).collect()}
    queries = []
    for r in rows:
        held = [t for t in r.terms if t in df]
        weight = np.array([scorer.weight(df[t]) for t in held], np.int64)
        queries.append((np.array(held, np.int64).view(np.uint64)[weight > 0], weight[weight > 0]))
    schema = pa.schema([("part", pa.int32()), ("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
    columns = [f.name for f in _SHARD][2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.int64)
        heaps = [(nothing, nothing.astype(bool), nothing)] * len(queries)
        for got in batches:
            for i in range(got.num_rows):
                shard = Shard({c: got.column(k)[i].as_py() for k, c in enumerate(columns)}, scorer)
                for q, (term, weight) in enumerate(queries):
                    doc, known, score = heaps[q]
                    ordinal, more = shard.search(term, weight, _kth(score, top), top)
                    if len(ordinal):
                        doc, known = np.append(doc, shard.doc_id[ordinal]), np.append(known, shard.known[ordinal])
                        score = np.append(score, more)
                        keep = _best(doc, known, score, top)
                        heaps[q] = doc[keep], known[keep], score[keep]
        part = TaskContext.get().partitionId() % MERGE
        for q, (doc, known, score) in enumerate(heaps):
            if len(doc):
                n = len(doc)
                yield batch(schema, [np.full(n, part, np.int32), np.full(n, q, np.int32), pa.array(doc, mask=~known), score])

    with _few_rows(shards.sparkSession):
        heaps = cut_lineage(shards.select(*columns).mapInArrow(run, "part int, item int, doc_id long, score long"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    merged = heaps.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = merged.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    named = shards.sparkSession.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}")
    return best.join(named, "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The best documents of each item: the index is written to the shared folder, then searched."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    index(docs).write.option("parquet.block.size", 1 << 25).parquet(path)
    return search(spark.read.parquet(path), items, top)


SQL = """
WITH t AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}') AS ws FROM documents),
d AS (SELECT row, doc_id, len(ws)::BIGINT AS n FROM t WHERE len(ws) > 0),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
p AS (SELECT row, w, count(*)::BIGINT AS tf FROM (SELECT row, unnest(ws) AS w FROM t) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')) AS w FROM benchmark),
f AS (SELECT w, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s
      WHERE w IN (SELECT w FROM q) GROUP BY w, nn),
r AS (SELECT item_id, doc_id, row, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * nn) // ll)))))::BIGINT AS score
      FROM q JOIN f USING (w) JOIN p USING (w) JOIN d USING (row), s GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM r WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 50
""".replace("{term}", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
