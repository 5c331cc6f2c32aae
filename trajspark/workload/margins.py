"""Boundary-margin queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions.flatmap import tension_margin
from trajspark.functions.vectors import parts
from trajspark.operators import margins
from trajspark.operators.kinematics import row_delta
from trajspark.workload.registry import q6, query, r6
from trajspark.workload.views import PHYS, phys_steps

MARGIN = (
    PHYS
    + """,
mar AS (SELECT stem, step, time, grp, a0, a1, a2, sqrt(a0*a0 + a1*a1 + (a2 + 981e-2)**2) / 981e-2 AS m,
   time - lag(time) OVER (PARTITION BY stem ORDER BY step) AS gap FROM ph)"""
)

PER = (
    MARGIN
    + """,
per AS (SELECT stem AS name, grp, count(*) AS n, median(gap) AS dt, min(m) AS min, quantile_cont(m, 1e-2) AS p1,
   median(m) AS median, max(m) AS max, min(a2) AS min_az FROM mar GROUP BY stem, grp)"""
)


def steps_margin(spark, sf):
    steps = phys_steps(spark, sf)
    return steps.select(
        "stem", "step", "time", F.col("grp").alias("group"), "a", F.col("a")[2].alias("a_z"),
        tension_margin(parts("a")).alias("tension_margin"),
    )


def _per(spark, sf):
    return margins.per_trajectory_margins(row_delta(steps_margin(spark, sf), "time", "dt_row"))


@query(
    "slack_labels",
    f"""WITH {MARGIN} SELECT stem, step, m < 0.3 AS near_slack, (m < 0.3)::INT AS regime FROM mar""",
)
def slack_labels(spark, sf):
    rows = margins.label_slack(steps_margin(spark, sf), 0.3)
    return rows.select("stem", "step", "near_slack", F.col("regime").cast("int").alias("regime"))


@query(
    "base_rate",
    f"""WITH {MARGIN} SELECT grp, {q6("avg((m < 0.3)::INT)")} AS base_rate FROM mar GROUP BY grp""",
)
def base_rate(spark, sf):
    rows = margins.label_slack(steps_margin(spark, sf), 0.3)
    return rows.groupBy(F.col("group").alias("grp")).agg(
        r6(margins.base_rate(F.col("near_slack"))).alias("base_rate")
    )


PCT = {"p0": 0.0, "p0_01": 0.0001, "p0_1": 0.001, "p1": 0.01, "p5": 0.05, "p10": 0.1, "p25": 0.25,
       "p50": 0.5, "p75": 0.75, "p95": 0.95, "p100": 1.0}


@query(
    "margin_summary",
    f"""WITH {MARGIN} SELECT count(*) FILTER (isfinite(m)) AS n, count(*) FILTER (NOT isfinite(m)) AS n_nonfinite,
  {q6("min(m)")} AS min, {q6("max(m)")} AS max, {q6("avg(m)")} AS mean, {q6("stddev_pop(m)")} AS std,
  {", ".join(f"{q6(f'quantile_cont(m, {p!r})')} AS {c}" for c, p in PCT.items())} FROM mar""",
)
def margin_summary(spark, sf):
    s = margins.margin_summary(steps_margin(spark, sf))
    return s.select(
        "n", "n_nonfinite", *[r6(c).alias(c) for c in s.columns if c not in ("n", "n_nonfinite")]
    )


@query(
    "threshold_sweep",
    f"""WITH {MARGIN}, t(threshold) AS (VALUES (5e-1), (3e-1), (2e-1), (1e-1), (5e-2), (2e-2), (1e-2))
SELECT threshold, count(*) FILTER (m < threshold) AS count, {q6("count(*) FILTER (m < threshold) / count(*)")} AS base_rate
FROM mar, t WHERE isfinite(m) GROUP BY threshold""",
)
def threshold_sweep(spark, sf):
    s = margins.threshold_sweep(steps_margin(spark, sf))
    return s.withColumn("base_rate", r6("base_rate"))


_STATS = ("dt", "min", "p1", "median", "max", "min_az")


@query(
    "per_traj_margin",
    f"WITH {PER} SELECT name, grp, n, {', '.join(f'{q6(c)} AS {c}' for c in _STATS)} FROM per",
)
def per_traj_margin(spark, sf):
    return _per(spark, sf).select(
        "name", F.col("group").alias("grp"), "n", *[r6(c).alias(c) for c in _STATS]
    )


@query(
    "group_rollup",
    f"""WITH {PER} SELECT grp, count(*) AS files, sum(n)::BIGINT AS steps, {q6("min(min)")} AS min_margin,
  {q6("median(dt)")} AS median_dt FROM per GROUP BY grp""",
)
def group_rollup(spark, sf):
    g = margins.group_rollup(_per(spark, sf))
    return g.select(
        F.col("group").alias("grp"), "files", "steps", r6("min_margin").alias("min_margin"),
        r6("median_dt").alias("median_dt"),
    )


@query(
    "topk_closest",
    f"""WITH {PER} SELECT name, {q6("min")} AS min, {q6("min_az")} AS min_az FROM per ORDER BY per.min, name LIMIT 15""",
)
def topk_closest(spark, sf):
    return margins.closest(_per(spark, sf)).select(
        "name", r6("min").alias("min"), r6("min_az").alias("min_az")
    )


@query(
    "accel_report",
    f"""WITH {MARGIN}, r AS (SELECT a2 AS az, sqrt(a0*a0 + a1*a1) AS lat, m * 981e-2 AS gap FROM mar)
SELECT {q6("min(az)")} AS az_min, {q6("max(az)")} AS az_max, {q6("max(lat)")} AS lateral_max, {q6("min(gap)")} AS closest_approach,
  {q6("quantile_cont(az, 1e-2)")} AS az_p1, {q6("median(az)")} AS az_median, {q6("median(lat)")} AS lateral_median,
  {q6("quantile_cont(lat, 99e-2)")} AS lateral_p99 FROM r""",
)
def accel_report(spark, sf):
    a = margins.acceleration_report(steps_margin(spark, sf))
    return a.select(*[r6(c).alias(c) for c in a.columns])


def _hist_sql(source: str, x: str, bins: str, lo: str, hi: str) -> str:
    return f"""rg AS (SELECT {lo} AS lo, {hi} AS hi, {bins} AS bins FROM {source}),
hb AS (SELECT least(floor(({x} - lo) / (hi - lo) * bins), bins - 1)::INT AS bin, count(*) AS n
   FROM {source}, rg WHERE isfinite({x}) AND {x} >= lo AND {x} <= hi GROUP BY 1),
gb AS (SELECT unnest(range(bins))::INT AS bin, lo, hi, bins FROM rg)
SELECT bin, {q6("lo + bin * (hi - lo) / bins")} AS lower, {q6("lo + (bin + 1) * (hi - lo) / bins")} AS upper,
  coalesce(n, 0)::BIGINT AS count FROM gb LEFT JOIN hb USING (bin)"""


def _rounded(h):
    return h.select("bin", r6("lower").alias("lower"), r6("upper").alias("upper"), "count")


@query("histogram", f"WITH {MARGIN}, " + _hist_sql("mar", "m", "60", "min(m)", "max(m)"))
def histogram(spark, sf):
    return _rounded(margins.histogram(steps_margin(spark, sf), "tension_margin", 60))


@query(
    "low_tail_histogram",
    f"WITH {MARGIN}, low AS (SELECT m FROM mar WHERE m < 0.6), "
    + _hist_sql("low", "m", "30", "min(0e0)", "max(6e-1)"),
)
def low_tail_histogram(spark, sf):
    return _rounded(margins.low_tail_histogram(steps_margin(spark, sf), "tension_margin", 60))


@query(
    "minima_histogram",
    f"WITH {PER}, "
    + _hist_sql("per", "per.min", "least(40, greatest(5, count(*) // 2))", "min(per.min)", "max(per.min)"),
)
def minima_histogram(spark, sf):
    return _rounded(margins.minima_histogram(_per(spark, sf)))


@query(
    "viability",
    f"""WITH {MARGIN} SELECT {q6("min(m)")} AS min_margin, count(*) FILTER (m < 0.5) AS n_below,
  {q6("count(*) FILTER (m < 0.5) / count(*)")} AS base_rate,
  CASE WHEN count(*) FILTER (m < 0.5) = 0 THEN 'not supported' ELSE 'supported' END AS verdict FROM mar WHERE isfinite(m)""",
)
def viability(spark, sf):
    v = margins.viability(steps_margin(spark, sf))
    return v.select(
        r6("min_margin").alias("min_margin"), "n_below", r6("base_rate").alias("base_rate"), "verdict"
    )
