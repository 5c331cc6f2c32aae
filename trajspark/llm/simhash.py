"""SimHash near-duplicates: fingerprints of word shingles, linked at a few differing bits, in groups.

Equal fingerprints collapse to one row first, so thousands of exact copies cost one comparison. Two
fingerprints that differ in at most r bits agree exactly on one of r + 1 bands, so comparing within bands
loses no link. A band's fingerprints are cut into tiles by population count; a pair of tiles is one task's
work, compared exactly with exclusive-or and bit counts, and pairs whose counts differ beyond the radius
are never formed. A tile pair returns a spanning forest of its links, not the links, which the component
search needs and which is linear in the tile.

Null or empty texts have fingerprint zero and link like any other. A null doc_id never becomes a
component's name unless its whole component has none. Repeated rows keep one result row each. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.components import components
from trajspark.llm.text import LOWER, batch, blocks, firsts, free, texts
from trajspark.plans.scratch import cut_lineage

SHINGLE = 3
RADIUS = 2
#: Fingerprints of a tile; a band's value with no more of them is a single tile.
TILE = 2048
#: Rows compared at a time inside a unit of work.
STRIP = 256

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("bits", pa.int64())])


def _fingerprints(column: pa.Array, shingle: int) -> np.ndarray:
    out = []
    for b in blocks(column):
        start, end = b.words()
        owner = b.owner(start)
        bounds = firsts(owner, b.n)
        size = end - start
        # words of the block with one blank after each
        at = np.cumsum(size + 1) - size - 1
        packed = np.full(int(size.sum() + len(size)), 0x20, np.uint8)
        where = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
        packed[where] = LOWER[b.data[np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)]]
        raw = packed.tobytes()
        n = np.diff(bounds)
        count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
        whose = np.repeat(np.arange(b.n), count)
        first = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[:-1], count)
        last = np.minimum(first + shingle, bounds[1:][whose]) - 1
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(raw[s:e], 42) for s, e in zip(at[first].tolist(), (at[last] + size[last]).tolist())], np.uint64
        )
        votes = np.zeros((b.n, 64), np.int64)
        for k in range(0, len(hashes), 1 << 16):
            part, own = hashes[k : k + (1 << 16)], whose[k : k + (1 << 16)]
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            votes[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        over = (2 * votes > count[:, None]).astype(np.uint8)
        out.append(np.packbits(over, axis=1, bitorder="little").view("<u8").ravel().view(np.int64))
    return np.concatenate(out)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and bits: the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                yield batch(_SCHEMA, [rows.column(0), _fingerprints(rows.column(1), shingle)])

    rows = texts(docs)
    return rows.select(rows.doc_id.cast("long"), "text").mapInArrow(run, "doc_id long, bits long")


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join all links inside a (b None) or between a and b into trees.

    Both sides are ordered by population count; a strip of rows meets only the columns whose counts lie
    within the radius of its own.
    """
    rows = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    pop_a, pop_b = np.bitwise_count(a).astype(np.int64), np.bitwise_count(other).astype(np.int64)
    group = list(range(len(rows)))
    left, right = [], []

    def root(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for lo in range(0, len(a), STRIP):
        strip, pops = a[lo : lo + STRIP], pop_a[lo : lo + STRIP]
        start = lo + 1 if b is None else np.searchsorted(pop_b, pops[0] - radius)
        stop = np.searchsorted(pop_b, pops[-1] + radius, "right")
        for at in range(start, stop, 1 << 13):
            part = other[at : min(at + (1 << 13), stop)]
            i, j = np.nonzero(np.bitwise_count(strip[:, None] ^ part[None, :]) <= radius)
            i, j = i + lo, j + at
            if b is None:
                i, j = i[i < j], j[i < j]
            for x, y in zip(i.tolist(), (j + shift).tolist()):
                p, q = root(x), root(y)
                if p != q:
                    group[max(p, q)] = min(p, q)
                    left.append(x)
                    right.append(y)
    return np.array(left, np.int64), np.array(right, np.int64)


def _compare(radius: int):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        node, bits = table.column("node").to_numpy(), table.column("bits").to_numpy().view(np.uint64)
        order = np.lexsort((np.bitwise_count(bits), side))
        node, bits, n = node[order], bits[order], int((side == 0).sum())
        i, j = _forest(bits[:n], bits[n:] if n < len(bits) else None, radius)
        return pa.table({"a": node[i], "b": node[j]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: a spanning forest of the links of every unit of work, over rows of ``prints`` (node, bits)."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    bands = [
        F.struct(
            F.lit(k).alias("band"),
            F.shiftrightunsigned("bits", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"),
        )
        for k, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ]
    rows = prints.select("node", "bits", F.bit_count("bits").alias("pop"), F.explode(F.array(*bands)).alias("at")).select(
        "node", "bits", "pop", "at.band", "at.value"
    )
    sizes = rows.groupBy("band", "value", "pop").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("band", "value").agg(F.sum("n").alias("total")).where("total > 1")

    # values with few fingerprints: many of them make one unit, of about a tile in all
    units = max(1, len(bands) * prints.count() // tile)
    few = rows.join(whole.where(F.col("total") <= tile), ["band", "value"], "left_semi").select(
        F.lit(-1).alias("band"),
        F.pmod(F.xxhash64("band", "value"), F.lit(units)).alias("value"),
        *[F.lit(0).alias(c) for c in ("p", "i", "q", "j", "side")],
        "node",
        "bits",
    )
    # values with many: tiles of one population count, and the pairs of tiles within the radius
    cut = sizes.join(whole.where(F.col("total") > tile).select("band", "value"), ["band", "value"]).withColumn(
        "slices", F.ceil(F.col("n") / F.lit(tile)).cast("int")
    )
    tiles = cut.select("band", "value", F.col("pop").alias("p"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("i"))
    pairs = tiles.join(tiles.withColumnsRenamed({"p": "q", "i": "j"}), ["band", "value"]).where(
        (F.col("q") - F.col("p")).between(0, radius) & ((F.col("q") > F.col("p")) | (F.col("j") >= F.col("i")))
    )
    ends = [F.struct(F.lit(k).alias("side"), F.col(p).alias("pop"), F.col(i).alias("slice")) for k, (p, i) in enumerate(["pi", "qj"])]
    alone = (F.col("p") == F.col("q")) & (F.col("i") == F.col("j"))
    sides = pairs.withColumn("end", F.explode(F.when(alone, F.array(ends[0])).otherwise(F.array(*ends)))).select(
        "band", "value", "p", "i", "q", "j", "end.side", "end.pop", "end.slice"
    )
    many = (
        rows.join(cut.select("band", "value", "pop", "slices"), ["band", "value", "pop"])
        .withColumn("slice", F.pmod(F.xxhash64("bits"), F.col("slices")).cast("int"))
        .join(sides.hint("merge"), ["band", "value", "pop", "slice"])  # unfolded pairs, larger than planned
        .select("band", "value", "p", "i", "q", "j", "side", "node", "bits")
    )
    return few.unionByName(many).groupBy("band", "value", "p", "i", "q", "j").applyInArrow(_compare(radius), "a long, b long")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, bits) of every row, and (bits, root, component_id) of every fingerprint."""
    rows = cut_lineage(fingerprints(docs, shingle))
    prints = cut_lineage(rows.groupBy("bits").agg(F.min("doc_id").alias("least")))
    # a fingerprint is its own node: it is a long already and needs no numbering
    joined = components(links(prints.withColumn("node", F.col("bits")), radius, tile))
    named = prints.join(joined.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, named.join(least, "root").select("bits", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id: the smallest doc_id reachable over links."""
    rows, names = groups(docs, shingle, radius, tile)
    return rows.join(names, "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, all columns as they were.

    Rows whose doc_id is null or occurs again are told apart by their fingerprints, and of several in one
    group the one with the smallest hash of its text stays.
    """
    rows, names = groups(docs, shingle, radius, tile)
    names = cut_lineage(names)
    id_, bits, root, first, nth = (free(docs, c) for c in ("id_", "bits_", "root_", "first_", "nth_"))
    copies = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    unclear = copies.where("n > 1 or doc_id is null").select(F.col("doc_id").alias(id_))
    named = names.where("component_id is not null").select(F.col("component_id").alias(id_)).distinct()
    plain = named.join(unclear.where(F.col(id_).isNotNull()), id_, "left_anti")
    own = F.col("doc_id").cast("long")
    kept = docs.join(plain, own == F.col(id_), "left_semi")
    if unclear.isEmpty():
        return kept

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in columns:
            yield pa.array(_fingerprints(text, shingle) if len(text) else [], pa.int64())

    rest = docs.join(unclear, own.eqNullSafe(F.col(id_)), "left_semi")
    rest = rest.withColumn(bits, F.arrow_udf(run, "long")(F.col("text").cast("string")))
    mine = names.select(F.col("bits").alias(bits), F.col("root").alias(root), F.col("component_id").alias(first))
    rest = rest.join(mine, bits).where(own.eqNullSafe(F.col(first)))
    rest = rest.withColumn(nth, F.row_number().over(Window.partitionBy(root).orderBy(F.xxhash64("text"))))
    return kept.unionByName(rest.where(F.col(nth) == 1).select(*docs.columns))
