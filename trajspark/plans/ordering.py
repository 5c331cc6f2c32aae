"""Ordered computation that stays balanced when one key holds most of the rows.

``dense_step`` numbers the rows of each key. Keys below the group limit use a plain window; larger
keys are range-partitioned on (key, order), so one key spreads over many tasks. Once ``step`` exists
every ordered operator works on fixed-length segments ``(key, step div size)``: neighbour frames get
the few boundary rows they need copied in (``with_halo``), running totals add the totals of earlier
segments (``running_sum``). No task ever holds more than a segment plus its halo.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.plans.scratch import cut_lineage

GROUP_ROWS = 1 << 20
SEGMENT_ROWS = 1 << 14
BROADCAST_ROWS = 1 << 20
BROADCAST_BYTES = 1 << 26
#: Rows that a task of numbered keys holds; later columns and windows widen them a hundredfold.
TASK_ROWS = 1 << 17
#: Metadata of a step column: no key of the table had more rows than this.
KEY_ROWS = "trajspark.key_rows"


def group_limit(spark: SparkSession) -> int:
    """Most rows one task may hold for a single key (session setting, or the default)."""
    return int(spark.conf.get("spark.trajspark.groupRows", str(GROUP_ROWS)))


def segment_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.trajspark.segmentRows", str(SEGMENT_ROWS)))


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows; there are at most rows/limit of them."""
    return df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)


def broadcast_checked(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only after measuring; past ``rows`` or ``size`` bytes the planner picks a shuffle join."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).first()
    return F.broadcast(df) if seen["n"] <= rows and (seen["bytes"] or 0) <= size else df


def split_hot(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys or None)."""
    hot = hot_keys(df, keys, group_limit(df.sparkSession))
    if hot.isEmpty():
        return df, None
    hot = broadcast_checked(cut_lineage(hot))
    return df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key over enough tasks for the table: the planner sizes tasks by the narrow rows it shuffles here.

    Tables of fewer rows than the cores can hold at once are left to it.
    """
    parts = -(-df.count() // TASK_ROWS)
    return df.repartition(parts, key) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def dense_step(
    df: DataFrame, key: str, order: Sequence[Column | str], out: str = "step"
) -> DataFrame:
    """Zero-based row number inside each key, in ``order`` (which must be a total order)."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    cold, hot = split_hot(df, [key])
    plain = Window.partitionBy(key).orderBy(*order)
    numbered = _spread(cold, key).withColumn(out, (F.row_number().over(plain) - 1).cast("bigint"))
    if hot is None:
        return numbered.withMetadata(out, {KEY_ROWS: group_limit(df.sparkSession), "key": key})
    return numbered.unionByName(_range_step(hot, key, order, out))


def _range_step(df: DataFrame, key: str, order: Sequence[Column], out: str) -> DataFrame:
    spark = df.sparkSession
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        -(-df.count() // group_limit(spark)),
    )
    # The slice id depends on sampled bounds, so it is fixed by a checkpoint before it is used twice.
    sliced = cut_lineage(
        df.repartitionByRange(parts, F.col(key), *order).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(key, "_slice")
        .count()
        .select(key, "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    local = Window.partitionBy(key, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_rank", F.row_number().over(local))
        .join(broadcast_checked(offsets), [key, "_slice"])
        .withColumn(out, (F.col("_rank") - 1 + F.col("_offset")).cast("bigint"))
        .drop("_slice", "_rank", "_offset")
    )


def fits_one_task(df: DataFrame, key: str, step: str = "step") -> bool:
    """Whether ``dense_step`` found every key within the group limit: the step column's metadata says so.

    A whole key then fits one window, which reuses the exchange of the numbering. Rows added since only cost spill.
    """
    meta = next((f.metadata for f in df.schema if f.name == step), {})
    return meta.get("key") == key and meta.get(KEY_ROWS, float("inf")) <= group_limit(df.sparkSession)


def with_halo(
    df: DataFrame, key: str, before: int, after: int, step: str = "step", size: int | None = None
) -> DataFrame:
    """Adds ``seg`` and ``own``: each row appears in its own segment and in those whose frame needs it."""
    size = max(size or segment_rows(df.sparkSession), before + after + 1)
    return df.selectExpr(
        "*",
        f"explode(sequence(greatest(floor(({step} - {after}) / {size}), 0L), floor(({step} + {before}) / {size}))) AS seg",
    ).selectExpr("*", f"seg = floor({step} / {size}) AS own")


def segment_window(key: str, step: str = "step") -> Window:
    return Window.partitionBy(key, "seg").orderBy(step)


def earlier_segments(key: str) -> Window:
    """Frame over one row per segment: all segments before this one."""
    return Window.partitionBy(key).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(
    df: DataFrame, key: str, value: Column, out: str, step: str = "step", inclusive: bool = True
) -> DataFrame:
    """Running total of ``value`` in step order; segment totals are summed on a table size/n as long."""
    size = segment_rows(df.sparkSession)
    base = df.withColumns({"seg": F.floor(F.col(step) / size), "_v": value})
    frame = segment_window(key, step).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1
    )
    local = base.withColumn("_local", F.coalesce(F.sum("_v").over(frame), F.lit(0)))
    offsets = (
        base.groupBy(key, "seg")
        .agg(F.sum("_v").alias("_t"))
        .withColumn("_offset", F.sum("_t").over(earlier_segments(key)))
        .where(F.col("seg") > 0)
        .select(key, "seg", "_offset")
    )
    return (
        local.join(offsets, [key, "seg"], "left")
        .withColumn(out, F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0)))
        .drop("seg", "_v", "_local", "_offset")
    )


def hash_rank(df: DataFrame, key: Column, out: str) -> DataFrame:
    """Zero-based rank of every row in md5 order of a unique ``key``, without a global sort.

    The digest's first 16 bits pick one of 65,536 even buckets; bucket counts give the offsets.
    """
    hashed = df.withColumn("_h", F.md5(key.cast("string"))).withColumn(
        "_b", F.substring("_h", 1, 4)
    )
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy("_b")
        .count()
        .select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    local = Window.partitionBy("_b").orderBy("_h")
    return (
        hashed.withColumn("_local", F.row_number().over(local))
        .join(F.broadcast(offsets), "_b")  # at most 65,536 rows
        .withColumn(out, (F.col("_local") - 1 + F.col("_offset")).cast("bigint"))
        .drop("_h", "_b", "_local", "_offset")
    )
