"""Mixing sources to target weights: words packed into blocks, slots of output shards joined to them by index.

The documents of a source, laid end to end, are packed into blocks of a fixed number of words. Targets are
filled up by weight, none above its cap, and become whole passes over a source's blocks and one partial
pass. The slots of all sources together are dealt over output shards by one pseudorandom permutation: a
shard's counts by source are a multinomial draw given the sources' totals, so that totals hold exactly and no block is
taken more often than its cap allows (independent draws would break both). A source's slots map to its
blocks by a permutation of its own for every pass, with its last, short block at the end, and slots meet
blocks in a join on (source, block), in which no key is hot. Texts move twice: to the bucket in which their place is
counted, and to their blocks; the join uses the blocks' partitioning.

Places in a source come from sums per (source, bucket) and running sums inside a bucket, so no task
ever holds a source. Slots are unfolded from ranges, chunk by chunk. All of it is DataFrame functions.

Null texts have no words and are never taken. A null source is a source of its own, last in order. Rows without doc_id
are spread over the buckets by their text and placed first in them; repeated rows follow each other and are taken each
for itself. With no words at all targets are zero. An empty table gives an empty result. Columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.plans.scratch import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Words of all targets to words of all sources, and most passes over a source.
SHARE, CAP = 1.5, 2
BLOCK = 512
SHARD_SLOTS = 4096
#: Parts of a source that are added up on their own; a prime, so that regular ids spread.
BUCKETS = 4093
_CHUNK = 1 << 14
#: Odd multipliers and offsets of the permutation's rounds.
_ROUNDS = ((48271, 7919), (69621, 104729), (39373, 1299709))


def permuted(rows: DataFrame, x: str, n: str, seed: Column) -> DataFrame:
    """Maps column x by a pseudorandom bijection of 0 .. n-1: rotate it, then scramble what lies below the
    largest power of two in n, thrice. Each step is a projection of its own, so that none is computed twice."""
    rows = rows.withColumn("_seed", seed + 1).withColumn("_bits", F.length(F.bin(n)) - 1)
    rows = rows.withColumn("_m", F.expr("shiftleft(1L, _bits)"))
    for multiplier, offset in _ROUNDS:
        rows = rows.withColumn(x, (F.col(x) + F.pmod(F.col("_seed") * offset, F.col(n))) % F.col(n))
        rows = rows.withColumn("_y", (F.col(x) * multiplier).bitwiseAND(F.col("_m") - 1))
        rows = rows.withColumn("_y", F.col("_y").bitwiseXOR(F.expr("shiftright(_y, greatest(_bits div 2, 1L)::int)")))
        rows = rows.withColumn(x, F.when(F.col(x) < F.col("_m"), F.col("_y")).otherwise(F.col(x)))
    return rows.drop("_seed", "_bits", "_m", "_y")


def _targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """key, rank, source_size and target of every source: one row per source, so global windows are small."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).withColumn("weight", w)
    rows = rows.withColumn("most", F.col("source_size") * cap)
    fill = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("all", F.sum("source_size").over(Window.partitionBy(F.lit(0))))
    rows = rows.withColumn("level", (F.col("all") * share - before) / left).withColumn("at", F.row_number().over(fill))
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("at", "level"))
    level = F.min(fits).over(Window.partitionBy(F.lit(0)))["level"]
    return rows.withColumn("target", F.least(F.col("most").cast("double"), level * F.col("weight"))).select(
        "key", "rank", "source_size", "target"
    )


def _plan(targets: DataFrame, block: int) -> DataFrame:
    """Adds the passes over each source, its slots, and where they begin among all slots."""
    words, size = F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size")
    rows = targets.where("source_size > 0").select(
        "*",
        F.expr(f"source_size div {block}").alias("full"),
        F.ceil(size / block).cast("long").alias("blocks"),
        words.alias("words"),
    )
    rows = rows.withColumn("passes", F.expr("words div source_size")).withColumn("rest", F.col("words") % size)
    rows = rows.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    order = Window.orderBy("rank")
    return rows.withColumn("first", F.sum("slots").over(order) - F.col("slots")).withColumn(
        "all", F.sum("slots").over(Window.partitionBy(F.lit(0)))
    )


def _slots(plan: DataFrame, block: int, shard: int) -> DataFrame:
    """key, block, shard, slot (place in the shard) and take (words from the block's start) of every slot."""
    chunks = plan.where("slots > 0").withColumn("chunk", F.explode(F.expr(f"sequence(0L, (slots - 1) div {_CHUNK})")))
    rows = chunks.repartition("key", "chunk").withColumn(
        "j", F.explode(F.expr(f"sequence(chunk * {_CHUNK}, least(slots, (chunk + 1) * {_CHUNK}) - 1)"))
    )
    rows = rows.withColumn("turn", F.expr("j div blocks")).withColumn("p", F.col("j") % F.col("blocks"))
    whole = F.col("p") < F.col("full")
    rows = rows.withColumn("n", F.when(whole, F.col("full")).otherwise(F.lit(1).cast("long")))
    rows = rows.withColumn("x", F.when(whole, F.col("p")).otherwise(F.lit(0).cast("long")))
    rows = permuted(rows, "x", "n", F.col("rank") * 7 + F.col("turn"))
    rows = permuted(rows.withColumn("place", F.col("first") + F.col("j")), "place", "all", F.lit(11).cast("long"))
    held = F.when(whole, F.lit(block)).otherwise(F.col("source_size") - F.col("full") * block)
    take = F.when(F.col("turn") < F.col("passes"), held).otherwise(F.least(held, F.col("rest") - F.col("p") * block))
    # never null, so that the join's null filter is not pushed down and written out through all the steps
    index = F.coalesce(F.when(whole, F.col("x")).otherwise(F.col("full")), F.lit(0).cast("long"))
    return rows.select(
        "key", index.alias("block"),
        F.expr(f"place div {shard}").alias("shard"), (F.col("place") % shard).alias("slot"), take.alias("take"),
    )


def _rows(docs: DataFrame) -> DataFrame:
    """key, source, bucket, doc_id, size and text of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    unnamed = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("key"),
        F.col("source").cast("string").alias("source"),
        F.pmod(F.coalesce(F.col("doc_id").cast("long"), unnamed), F.lit(BUCKETS)).cast("long").alias("bucket"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        text.alias("text"),
    )


def _pieces(rows: DataFrame, sums: DataFrame, block: int) -> DataFrame:
    """Every document cut where blocks end: key, row, doc_id, size and, per piece, block, at (its place there), first (its
    first word in the document) and text (its words, joined by blanks). An empty document has one piece without block."""
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("key", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("key", "bucket").orderBy("doc_id", "size")
    placed = rows.select(
        "key", "bucket", "doc_id", "size", "text", F.row_number().over(inside).alias("nth"),
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).alias("run"),
    ).join(offsets, ["key", "bucket"])
    start = F.col("offset") + F.col("run")

    def piece(words, b):
        first = F.greatest(b * block - start, F.lit(0).cast("long"))
        held = F.slice(words, (first + 1).cast("int"), (F.least((b + 1) * block - start, F.col("size")) - first).cast("int"))
        return F.struct(b.alias("block"), (start + first - b * block).alias("at"), first.alias("first"), F.array_join(held, " ").alias("text"))

    blocks = F.sequence(F.expr(f"(offset + run) div {block}"), F.expr(f"(offset + run + size - 1) div {block}"))
    # the words are an element of an array, so that they are split once and not for every block
    cut = F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), lambda w: F.transform(blocks, lambda b: piece(w, b)))
    return placed.select(
        "key", F.struct("bucket", "nth").alias("row"), "doc_id", "size", F.explode_outer(F.when(F.col("size") > 0, F.get(cut, 0))).alias("p")
    ).select("key", "row", "doc_id", "size", "p.*")


def _packed(pieces: DataFrame) -> DataFrame:
    """The block table: key, block and its pieces in order. A block holds no more pieces than words."""
    piece = F.struct("at", "row", "doc_id", "size", "first", "text")
    return pieces.where("block is not null").groupBy("key", "block").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))


def _joined(docs: DataFrame, block: int, shard: int, weights=WEIGHTS, share=SHARE, cap=CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks at their slots (key, shard, slot, pieces with their words; no shard where a block has no slot), targets, and rows."""
    rows = _rows(docs)
    sums = cut_lineage(rows.groupBy("key", "source", "bucket").agg(F.sum("size").alias("words")))
    sources = sums.groupBy("key", "source").agg(F.sum("words").alias("source_size"))
    targets = cut_lineage(_targets(sources, weights, share, cap))
    # what the slots unfold from is small, they are not: without the hint the planner would broadcast them
    slots = _slots(_plan(targets, block), block, shard).hint("merge")
    met = _packed(_pieces(rows, sums, block)).join(slots, ["key", "block"], "left")

    def taken(p):
        left = F.greatest(F.coalesce("take", F.lit(0)) - p["at"], F.lit(0)).cast("int")
        words = F.slice(F.split(p["text"], " "), 1, left)
        return F.struct(p["row"].alias("row"), p["doc_id"].alias("doc_id"), p["size"].alias("size"), p["first"].alias("first"), words.alias("words"))

    return met.select("key", "shard", "slot", F.transform("pieces", taken).alias("pieces")), targets, rows


def mixture(docs: DataFrame, block: int = BLOCK, shard: int = SHARD_SLOTS, **options) -> DataFrame:
    """The mix, one row per slot: shard, slot, source, text (the words of the block, joined by blanks) and pieces (doc_id,
    first word in the document and number of words, in the order of the text)."""
    met, _, _ = _joined(docs, block, shard, **options)
    some = F.filter("pieces", lambda p: F.size(p["words"]) > 0)
    return met.where("shard is not null").select(
        "shard", "slot", F.when(F.col("key") != "n", F.substr("key", F.lit(2))).alias("source"),
        F.array_join(F.flatten(F.transform("pieces", lambda p: p["words"])), " ").alias("text"),
        F.transform(some, lambda p: F.struct(p["doc_id"].alias("doc_id"), p["first"].alias("first"), F.size(p["words"]).alias("words"))).alias("pieces"),
    )


def taken(docs: DataFrame, block: int = BLOCK, shard: int = SHARD_SLOTS, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, counted in the blocks joined to the slots."""
    met, targets, rows = _joined(docs, block, shard, **options)
    counts = met.select("key", F.explode("pieces").alias("p")).select("key", "p.row", "p.doc_id", "p.size", F.size("p.words").alias("words"))
    full = counts.groupBy("key", "row").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum("words").alias("taken"))
    empty = rows.where("size = 0").select("key", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    out = full.drop("row").unionByName(empty).join(targets.select("key", "source_size", "target"), "key")
    return out.select("doc_id", "size", "source_size", "target", "taken")


def sql(block: int = BLOCK) -> str:
    rounds = []
    for k, (multiplier, offset) in enumerate(_ROUNDS):
        rounds.append(
            f"r{k} AS (SELECT * EXCLUDE (x), (x + ((seed + 1) * {offset}) % n) % n AS x FROM {'start' if k == 0 else f's{k - 1}'}),"
            f" s{k} AS (SELECT * EXCLUDE (x), CASE WHEN x < m THEN xor((x * {multiplier}) & (m - 1),"
            f" ((x * {multiplier}) & (m - 1)) >> greatest(bits // 2, 1)) ELSE x END AS x FROM r{k})"
        )
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT AS unnamed FROM documents),
s0_ AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
s1_ AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s0_),
s2_ AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS most FROM s1_),
s3_ AS (SELECT *, row_number() OVER f AS nth, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(most) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
    FROM s2_ WINDOW f AS (ORDER BY most::DOUBLE / weight, rank)),
s4_ AS (SELECT *, (SELECT arg_min(level, nth) FROM s3_ WHERE level <= most::DOUBLE / weight) AS fill FROM s3_),
t AS (SELECT source, rank, source_size, least(most::DOUBLE, fill * weight) AS target FROM s4_),
p0 AS (SELECT *, source_size // {block} AS full_, (source_size + {block - 1}) // {block} AS blocks,
    floor(target + 0.5)::BIGINT AS words FROM t WHERE source_size > 0),
p AS (SELECT *, words // source_size AS passes, words % source_size AS rest,
    (words // source_size) * blocks + (words % source_size + {block - 1}) // {block} AS slots FROM p0),
j0 AS (SELECT *, unnest(range(slots)) AS j FROM p),
j AS (SELECT *, j // blocks AS turn, j % blocks AS p FROM j0),
start AS (SELECT *, full_ AS n, rank * 7 + turn AS seed, length(bin(full_)) - 1 AS bits,
    1::BIGINT << (length(bin(full_)) - 1) AS m, p AS x FROM j WHERE p < full_),
{", ".join(rounds)},
slots AS (SELECT source, x AS block, CASE WHEN turn < passes THEN {block} ELSE least({block}, rest - p * {block}) END AS take
    FROM s{len(_ROUNDS) - 1}
  UNION ALL
  SELECT source, full_, CASE WHEN turn < passes THEN source_size - full_ * {block}
    ELSE least(source_size - full_ * {block}, rest - p * {block}) END FROM j WHERE p >= full_),
places AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY bucket, doc_id NULLS FIRST, size
    ROWS UNBOUNDED PRECEDING) - size AS start_, row_number() OVER () AS row_
    FROM (SELECT *, ((coalesce(doc_id, unnamed) % {BUCKETS}) + {BUCKETS}) % {BUCKETS} AS bucket FROM d)),
pieces AS (SELECT *, unnest(range((start_ // {block})::BIGINT, ((start_ + size - 1) // {block} + 1)::BIGINT)) AS block
    FROM places WHERE size > 0),
got AS (SELECT row_, sum(greatest(least(start_ + size, k.block * {block} + take) - greatest(start_, k.block * {block}), 0)) AS taken
    FROM pieces k JOIN slots s ON k.block = s.block AND k.source IS NOT DISTINCT FROM s.source GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM places LEFT JOIN got USING (row_) JOIN t ON places.source IS NOT DISTINCT FROM t.source
"""


SQL = sql()
