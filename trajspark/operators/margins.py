"""Boundary-margin statistics: labels, summaries, sweeps, per-trajectory tables and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.vectors import is_finite, norm, parts
from trajspark.plans.quantiles import quantiles
from trajspark.plans.scratch import cut_lineage
from trajspark.schema import MARGIN_PERCENTILES, SLACK_THRESHOLDS, SystemParams


def label_slack(df: DataFrame, threshold: float, margin: str = "tension_margin") -> DataFrame:
    """Adds ``near_slack`` (strictly below the threshold), ``regime`` 0/1 and the threshold used."""
    near = (F.col(margin) < threshold) & ~F.isnan(margin)
    return df.withColumns(
        {
            "near_slack": near,
            "regime": near.cast("tinyint"),
            "slack_threshold": F.lit(float(threshold)),
        }
    )


def base_rate(near: Column) -> Column:
    """Share of labelled rows; NaN for an empty table."""
    return F.coalesce(F.avg(near.cast("double")), F.lit(float("nan")))


def percentile_name(p: float) -> str:
    return f"p{p:g}".replace(".", "_")


def margin_summary(
    df: DataFrame, margin: str = "tension_margin", percentiles: Sequence[float] = MARGIN_PERCENTILES
) -> DataFrame:
    """One row: finite count, non-finite count, moments (population std) and percentiles."""
    x = F.col(margin)
    good = F.when(is_finite(x), x)
    stats = df.agg(
        F.count(good).alias("n"),
        F.count_if(~is_finite(x)).alias("n_nonfinite"),
        F.min(good).alias("min"),
        F.max(good).alias("max"),
        F.avg(good).alias("mean"),
        F.stddev_pop(good).alias("std"),
    )
    stats = stats.withColumn(
        "n",
        F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no finite samples"))),
    )
    q = quantiles(df, [], {margin: {percentile_name(p): p / 100 for p in percentiles}})
    return stats.withColumn("_k", F.lit(0)).join(q.withColumn("_k", F.lit(0)), "_k").drop("_k")


def threshold_sweep(
    df: DataFrame, margin: str = "tension_margin", thresholds: Sequence[float] = SLACK_THRESHOLDS
) -> DataFrame:
    """Count and share of finite samples strictly below each threshold, from one pass."""
    x = F.col(margin)
    rows = df.where(is_finite(x)).agg(
        F.count("*").alias("n"),
        F.array(
            *[
                F.struct(F.lit(float(t)).alias("threshold"), F.count_if(x < t).alias("count"))
                for t in thresholds
            ]
        ).alias("_rows"),
    )
    return rows.select("n", F.inline("_rows")).select(
        "threshold",
        "count",
        F.when(F.col("n") > 0, F.col("count") / F.col("n"))
        .otherwise(F.lit(float("nan")))
        .alias("base_rate"),
    )


def per_trajectory_margins(
    df: DataFrame,
    key: str = "stem",
    group: str = "group",
    margin: str = "tension_margin",
    a_z: str = "a_z",
    dt: str = "dt_row",
) -> DataFrame:
    """Row count, median spacing, min, p1, median and max margin, and lowest a_z per trajectory.

    ``dt`` is the spacing to the previous row (NULL on the first).
    """
    base = df.groupBy(key, group).agg(
        F.count("*").alias("n"),
        F.min(margin).alias("min"),
        F.max(margin).alias("max"),
        F.min(a_z).alias("min_az"),
    )
    q = quantiles(df, [key], {margin: {"p1": 0.01, "median": 0.5}, dt: {"dt": 0.5}})
    return (
        base.join(q, key, "left")
        .select(
            F.col(key).alias("name"), group, "n",
            F.coalesce("dt", F.lit(float("nan"))).alias("dt"),
            "min", "p1", "median", "max", "min_az",
        )
    )


def group_rollup(per_traj: DataFrame, group: str = "group") -> DataFrame:
    base = per_traj.groupBy(group).agg(
        F.count("*").alias("files"), F.sum("n").alias("steps"), F.min("min").alias("min_margin")
    )
    return base.join(quantiles(per_traj, [group], {"dt": {"median_dt": 0.5}}), group, "left")


def closest(per_traj: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` trajectories nearest the boundary (ties by name)."""
    return per_traj.orderBy("min", "name").limit(k)


def acceleration_report(
    df: DataFrame, a: str = "a", gravity: float = SystemParams.gravity
) -> DataFrame:
    """How far accelerations stay from free fall: a_z and lateral distribution, closest approach."""
    x = parts(a)
    rows = df.select(
        x[2].alias("az"),
        norm(x[:2]).alias("lateral"),
        norm([x[0], x[1], x[2] + gravity]).alias("gap"),
    )
    only = lambda c: F.when(is_finite(F.col(c)), F.col(c))
    base = rows.agg(
        F.min(only("az")).alias("az_min"),
        F.max(only("az")).alias("az_max"),
        F.max(only("lateral")).alias("lateral_max"),
        F.min(only("gap")).alias("closest_approach"),
    )
    q = quantiles(
        rows,
        [],
        {
            "az": {"az_p1": 0.01, "az_median": 0.5},
            "lateral": {"lateral_median": 0.5, "lateral_p99": 0.99},
        },
    )
    return base.withColumn("_k", F.lit(0)).join(q.withColumn("_k", F.lit(0)), "_k").drop("_k")


def histogram(
    df: DataFrame, value: str, bins: int, lo: float | None = None, hi: float | None = None
) -> DataFrame:
    """Equal-width counts, last bin closed on the right; the range defaults to the data's own.

    Empty bins are listed with a zero. A constant column gets a unit-wide range around it.
    """
    x = F.col(value)
    rows = df.where(is_finite(x)).select(x.alias("_x"))
    if lo is None or hi is None:
        found = rows.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
        lo, hi = found["lo"], found["hi"]
        if lo is None:
            lo, hi = 0.0, 1.0
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    counts = (
        rows.where((F.col("_x") >= lo) & (F.col("_x") <= hi))
        .select(
            F.least(F.floor((F.col("_x") - lo) / (hi - lo) * bins), F.lit(bins - 1))
            .cast("int")
            .alias("bin")
        )
        .groupBy("bin")
        .agg(F.count("*").alias("count"))
    )
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("lower"),
        (lo + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def low_tail_histogram(df: DataFrame, margin: str, bins: int) -> DataFrame:
    return histogram(df.where(F.col(margin) < 0.6), margin, max(20, bins // 2), 0.0, 0.6)


def minima_histogram(per_traj: DataFrame) -> DataFrame:
    rows = cut_lineage(per_traj.select("min"))  # one number per trajectory, read three times
    return histogram(rows, "min", min(40, max(5, rows.count() // 2)))


def viability(
    df: DataFrame, margin: str = "tension_margin", thresholds: Sequence[float] = SLACK_THRESHOLDS
) -> DataFrame:
    """Global minimum, how many samples fall below the loosest threshold, and the verdict."""
    tau = max(thresholds)
    x = F.col(margin)
    good = df.where(is_finite(x))
    return good.agg(
        F.min(x).alias("min_margin"), F.count_if(x < tau).alias("n_below"), F.count("*").alias("n")
    ).select(
        "min_margin",
        "n_below",
        (F.col("n_below") / F.col("n")).alias("base_rate"),
        F.when(F.col("n_below") == 0, "not supported").otherwise("supported").alias("verdict"),
    )
