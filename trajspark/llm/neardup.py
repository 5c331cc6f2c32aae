"""Near duplicates by shared five-word shingles: SimHash tiles for candidates, exact similarity to decide.

Texts whose shingle sets have a Jaccard similarity of 0.8 differ in about ten of 64 SimHash bits, too many for
bands of those bits to meet in. So tiles are formed inside buckets of another kind: the hashes of ROWS minima of
the shingle set, BANDS times over, agree in at least one band for 0.995 of such pairs. A bucket with no more than
a tile's fingerprints shares one unit of work with others; a larger one is cut into tiles by population count,
and pairs of tiles whose counts differ beyond the radius are never formed. A unit compares its fingerprints by
exclusive-or and bit counts and returns a shortest spanning forest of the links within the radius, which is
linear in the unit. Only the forest's links are then confirmed, by the exact similarity of the two shingle sets.
As the forest prefers near links, two similar texts stay joined by links at least as near as their own.

Equal fingerprints are one node, so thousands of exact copies cost one comparison. A null or empty text has
no shingles and fingerprint zero; such texts are copies of one another. Texts of fewer than five words have
one shingle, the whole. A null doc_id is kept only if its whole group has none. Rows whose doc_id is null or
occurs again are told apart by their fingerprints; of several in a group the one with the smallest hash of its
text stays. An empty table gives an empty result; all columns of the kept rows stay as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.components import components
from trajspark.llm.text import BYTE, LOWER, Rolling, batch, blocks, firsts, free, mix, texts
from trajspark.plans.scratch import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits up to which two fingerprints are candidates: mean 9.7, deviation 2.9 at a similarity of 0.8.
RADIUS = 15
BANDS, ROWS = 10, 4
#: Fingerprints of a tile.
TILE = 2048

_ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("bits", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _shingles(column: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of texts: shingle hashes in text order, and the n + 1 bounds of each text's shingles."""
    for b in blocks(column):
        start, end = b.words()
        bounds = firsts(b.owner(start), b.n)
        words = Rolling(Rolling(BYTE[LOWER[b.data]]).slices(start, end))
        n = np.diff(bounds)
        count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
        ends = np.concatenate([[0], np.cumsum(count)])
        first = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], count)
        last = np.minimum(first + shingle, np.repeat(bounds[1:], count))
        yield words.slices(first, last), ends


def _prints(column: pa.Array, shingle: int) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is one if it is set in over half of the shingles' hashes."""
    out = []
    for hashes, ends in _shingles(column, shingle):
        votes = np.zeros((len(ends) - 1, 64), np.int64)
        whose = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        for k in range(0, len(hashes), 1 << 16):
            part, own = hashes[k : k + (1 << 16)], whose[k : k + (1 << 16)]
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            votes[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        over = (2 * votes > np.diff(ends)[:, None]).astype(np.uint8)
        out.append(np.packbits(over, axis=1, bitorder="little").view("<u8").ravel().view(np.int64))
    return np.concatenate(out)


def _keys(column: pa.Array, shingle: int) -> np.ndarray:
    """BANDS bucket numbers of each text, from the least shingle hashes under as many orders as needed."""
    out = []
    for hashes, ends in _shingles(column, shingle):
        least = np.zeros((len(ends) - 1, len(_ODD)), np.uint64)
        full = np.flatnonzero(np.diff(ends))
        for k, odd in enumerate(_ODD if len(full) else []):
            least[full, k] = np.minimum.reduceat(hashes * odd, ends[:-1][full])
        key = np.zeros((len(least), BANDS), np.uint64)
        for r in range(ROWS):
            key = mix(key ^ least[:, r::ROWS])
        out.append(key.view(np.int64))
    return np.concatenate(out)


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, bits (fingerprint as a signed long) and keys (a bucket number per band) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                keys = _keys(rows.column(1), shingle)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                yield batch(_SCHEMA, [rows.column(0), _prints(rows.column(1), shingle), lists])

    rows = texts(docs)
    return rows.select(rows.doc_id.cast("long"), "text").mapInArrow(run, "doc_id long, bits long, keys array<long>")


def _forest(bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a shortest spanning forest of the links within ``radius``: Prim's method, a row at a time."""
    n = len(bits)
    near, by = np.full(n, 255, np.int16), np.zeros(n, np.int64)
    free_ = np.ones(n, bool)
    left, right, at = [], [], 0
    for _ in range(n - 1):
        free_[at] = False
        apart = np.bitwise_count(bits ^ bits[at]).astype(np.int16)
        closer = free_ & (apart < near)
        near[closer], by[closer] = apart[closer], at
        near[at] = 1000
        at = int(near.argmin())
        if near[at] <= radius:
            left.append(int(by[at]))
            right.append(at)
    return np.array(left, np.int64), np.array(right, np.int64)


def _unit(radius: int):
    def run(table: pa.Table) -> pa.Table:
        bits = np.unique(table.column("bits").to_numpy())
        i, j = _forest(bits.view(np.uint64), radius)
        return pa.table({"a": bits[i], "b": bits[j]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def candidates(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: fingerprints joined by the forests of all units, for rows (bits, keys)."""
    rows = prints.select("bits", F.bit_count("bits").alias("pop"), F.posexplode("keys").alias("band", "value"))
    rows = cut_lineage(rows.distinct())
    sizes = rows.groupBy("band", "value", "pop").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("band", "value").agg(F.sum("n").alias("total")).where("total > 1")
    small, large = (whole.where(c).select("band", "value", "total") for c in (F.col("total") <= tile, F.col("total") > tile))
    work = small.agg(F.sum("total")).first()[0] or 0
    units = max(1, -(-work // tile))
    few = rows.join(small, ["band", "value"]).select(
        F.lit(-1).alias("band"), F.pmod(F.xxhash64("band", "value"), F.lit(units)).alias("value"), *[F.lit(0).alias(c) for c in "piqj"], "bits"
    )
    cut = sizes.join(large.select("band", "value"), ["band", "value"]).withColumn("slices", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
    tiles = cut.select("band", "value", F.col("pop").alias("p"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("i"))
    pairs = tiles.join(tiles.withColumnsRenamed({"p": "q", "i": "j"}), ["band", "value"]).where(
        (F.col("q") - F.col("p")).between(0, radius) & ((F.col("q") > F.col("p")) | (F.col("j") >= F.col("i")))
    )
    ends = F.array_distinct(F.array(*[F.struct(F.col(p).alias("pop"), F.col(i).alias("slice")) for p, i in ("pi", "qj")]))
    sides = pairs.withColumn("end", F.explode(ends)).select("band", "value", *"piqj", "end.pop", "end.slice")
    many = (
        rows.join(cut.select("band", "value", "pop", "slices"), ["band", "value", "pop"])
        .withColumn("slice", F.pmod(F.xxhash64("bits"), F.col("slices")).cast("int"))
        .join(sides.hint("merge"), ["band", "value", "pop", "slice"])  # unfolded pairs, larger than planned
        .select("band", "value", *"piqj", "bits")
    )
    work = few if large.isEmpty() else few.unionByName(many)
    return work.groupBy("band", "value", *"piqj").applyInArrow(_unit(radius), "a long, b long").distinct()


def _sets(shingle: int):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for hashes, ends in _shingles(column, shingle):
                out += [np.unique(hashes[a:b]).tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist())]
            yield pa.array(out, pa.binary())

    return run


def _jaccard(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in columns:
        out = []
        for a, b in zip(left, right):
            a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (a, b))
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both / max(len(a) + len(b) - both, 1))
        yield pa.array(out, pa.float64())


def confirmed(edges: DataFrame, shown: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The edges (a, b) whose texts, one for each fingerprint in ``shown`` (bits, text), are similar enough."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("bits")).distinct()
    sets = shown.join(ends, "bits", "left_semi").select("bits", F.arrow_udf(_sets(shingle), "binary")("text").alias("set"))
    sets = cut_lineage(sets)
    both = edges.join(sets.select(F.col("bits").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("bits").alias("b"), F.col("set").alias("y")), "b"
    )
    return both.where(F.arrow_udf(_jaccard, "double")("x", "y") >= similarity).select("a", "b")


def groups(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, tile: int = TILE
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, bits) of every row, and (bits, root, component_id) of every fingerprint."""
    rows = cut_lineage(sketches(docs, shingle))
    prints = cut_lineage(rows.groupBy("bits").agg(F.min("doc_id").alias("least"), F.min_by("keys", F.xxhash64("keys")).alias("keys")))
    edges = cut_lineage(candidates(prints, radius, tile))
    # one text for each fingerprint that has a link: that of its least doc_id, of rows without one any
    ends = edges.select(F.explode(F.array("a", "b")).alias("bits")).distinct()
    wanted = prints.join(ends, "bits", "left_semi").select("bits", "least")
    plain = docs.select(F.col("doc_id").cast("long").alias("least"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = plain.join(wanted, plain.least.eqNullSafe(wanted.least), "left_semi")

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in columns:
            yield pa.array(_prints(text, shingle) if len(text) else [], pa.int64())

    named = named.select("text", F.arrow_udf(run, "long")("text").alias("bits")).join(wanted.select("bits"), "bits", "left_semi")
    shown = named.groupBy("bits").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    joined = components(confirmed(edges, shown, shingle, similarity))
    all_ = prints.select("bits", "least").join(joined.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    least = all_.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "bits"), all_.join(least, "root").select("bits", "root", "component_id")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id and component_id: the smallest doc_id reachable over links between similar texts."""
    rows, names = groups(docs, **options)
    return rows.join(names, "bits").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, **options) -> DataFrame:
    """One document of each group, the one with the smallest doc_id."""
    rows, names = groups(docs, shingle, **options)
    names = cut_lineage(names)
    id_, bits, root, first, nth = (free(docs, c) for c in ("id_", "bits_", "root_", "first_", "nth_"))
    unclear = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias(id_))
    unclear = cut_lineage(unclear)
    kept = names.where("component_id is not null").select(F.col("component_id").alias(id_)).distinct()
    own = F.col("doc_id").cast("long")
    clear = docs.join(kept.join(unclear.where(F.col(id_).isNotNull()), id_, "left_anti"), own == F.col(id_), "left_semi")
    if unclear.isEmpty():
        return clear

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in columns:
            yield pa.array(_prints(text, shingle) if len(text) else [], pa.int64())

    rest = docs.join(unclear, own.eqNullSafe(F.col(id_)), "left_semi")
    rest = rest.withColumn(bits, F.arrow_udf(run, "long")(F.col("text").cast("string")))
    mine = names.select(F.col("bits").alias(bits), F.col("root").alias(root), F.col("component_id").alias(first))
    rest = rest.join(mine, bits).where(own.eqNullSafe(F.col(first)))
    rest = rest.withColumn(nth, F.row_number().over(Window.partitionBy(root).orderBy(F.xxhash64("text"))))
    return clear.unionByName(rest.where(F.col(nth) == 1).select(*docs.columns))
