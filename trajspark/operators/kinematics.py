"""Ordered and row-wise kinematics: continuity, derivatives, consistency and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.flatmap import flat_map, with_quaternion
from trajspark.functions.vectors import array_sub, is_finite, parts
from trajspark.plans.ordering import earlier_segments, fits_one_task, segment_window, with_halo
from trajspark.schema import SystemParams

GUARD_FLAGS = ["guard_free_fall", "guard_force", "guard_degenerate_cross", "guard_nonfinite_input"]


def continuous_quaternion(
    df: DataFrame, quat: str, key: str = "stem", step: str = "step", out: str = "quat"
) -> DataFrame:
    """Flip each quaternion into its predecessor's hemisphere, then make the first finite w >= 0.

    Flip parity is local to a segment; one small row per segment carries the parity of the segments
    before it and the key's global sign, so a long trajectory is never gathered in one task. Where all
    keys are known to be short, each is one window and nothing is joined.
    """
    turn = " + ".join(f"{quat}[{i}] * _prev[{i}]" for i in range(4))
    finite = " AND ".join(f"abs({quat}[{i}]) < double('Infinity')" for i in range(4))
    if fits_one_task(df, key, step):
        w = Window.partitionBy(key).orderBy(step)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return (
            df.withColumn("_prev", F.lag(quat).over(w))
            .withColumn("_flip", F.expr(f"IF({turn} < 0, 1, 0)"))
            .withColumn("_odd", F.sum("_flip").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) % 2)
            .withColumn("_head", F.expr(f"IF({finite}, IF(_odd = 1, -{quat}[3], {quat}[3]), NULL)"))
            .withColumn("_start", F.first("_head", ignorenulls=True).over(whole))
            .withColumn(out, F.expr(f"transform({quat}, q -> IF(coalesce(_start < 0, false) = (_odd = 0), -q, q))"))
            .drop("_prev", "_flip", "_odd", "_head", "_start")
        )
    seg = with_halo(df, key, before=1, after=0, step=step)
    w = segment_window(key, step)
    flipped = (
        seg.withColumn("_prev", F.lag(quat).over(w))
        .selectExpr("*", f"{turn} AS _turn")
        .selectExpr("*", "IF(own AND _turn < 0 AND NOT isnan(_turn), 1, 0) AS _flip")
        .drop("_prev", "_turn")
    )
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    signed = flipped.withColumn("_odd", F.sum("_flip").over(frame) % 2).where("own")
    segments = signed.groupBy(key, "seg").agg(
        F.sum("_flip").alias("_n"),
        F.expr(f"min_by(IF(_odd = 1, -{quat}[3], {quat}[3]), IF({finite}, {step}, NULL)) AS _w"),
    )
    earlier = earlier_segments(key)
    segments = segments.withColumn("_carry", F.sum("_n").over(earlier)).selectExpr(
        key, "seg", "coalesce(_carry, 0) % 2 AS _carry", "IF(coalesce(_carry, 0) % 2 = 1, -_w, _w) AS _head"
    )
    whole = earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    segments = segments.withColumn(
        "_start", F.first("_head", ignorenulls=True).over(whole)
    ).selectExpr(key, "seg", "IF(_start < 0, 1, 0) + _carry AS _turns")
    return (
        signed.join(segments, [key, "seg"])
        .selectExpr("*", "IF((_odd + _turns) % 2 = 1, -1D, 1D) AS _sign")
        .withColumn(out, F.expr(f"transform({quat}, q -> q * _sign)"))
        .drop("_flip", "_odd", "_turns", "_sign", "seg", "own")
    )


def flat_outputs(
    df: DataFrame,
    params: SystemParams = SystemParams(),
    key: str = "stem",
    step: str = "step",
    **kwargs,
) -> DataFrame:
    """``flat_map`` plus a sign-continuous attitude quaternion ``quat_quad``."""
    mapped = with_quaternion(flat_map(df, params, **kwargs), "R_quad", "_raw_quat")
    return continuous_quaternion(mapped, "_raw_quat", key, step, "quat_quad").drop("_raw_quat")


def guard_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    aggs = [F.count_if(F.col(f)).alias(f.removeprefix("guard_")) for f in GUARD_FLAGS]
    return df.groupBy(*(by or [])).agg(*aggs, F.count_if(~F.col("valid")).alias("invalid_total"))


def row_delta(
    df: DataFrame, col: str, out: str, key: str = "stem", step: str = "step"
) -> DataFrame:
    """``out`` = value at this step minus value one step earlier; NULL on the first row."""
    seg = with_halo(df, key, before=1, after=0, step=step)
    delta = F.col(col) - F.lag(col).over(segment_window(key, step))
    return seg.withColumn(out, delta).where("own").drop("seg", "own")


def gradient(
    df: DataFrame,
    values: list[str],
    time: str = "time",
    key: str = "stem",
    step: str = "step",
    suffix: str = "_grad",
) -> DataFrame:
    """Second-order derivative on uneven spacing, one-sided three-point formulas at both ends.

    Keys with fewer than three rows get NULL, and so do rows whose formula spans two equal times.
    """
    seg = with_halo(df, key, before=2, after=2, step=step)
    w = segment_window(key, step)
    cols = [time, *values]
    near = {}
    for c in cols:
        for k in (1, 2):
            near[f"_m{k}_{c}"] = F.lag(c, k).over(w)
            near[f"_p{k}_{c}"] = F.lead(c, k).over(w)
    seg = seg.withColumns(near).where("own")
    t0 = F.col(time)
    m1, m2, p1, p2 = (F.col(f"_{s}_{time}") for s in ("m1", "m2", "p1", "p2"))
    hs, hd = t0 - m1, p1 - t0
    d1, d2 = p1 - t0, p2 - p1
    e1, e2 = t0 - m1, m1 - m2
    over, out = F.try_divide, {}
    for v in values:
        f0 = F.col(v)
        fm1, fm2, fp1, fp2 = (F.col(f"_{s}_{v}") for s in ("m1", "m2", "p1", "p2"))
        inner = over(hs * hs * fp1 + (hd * hd - hs * hs) * f0 - hd * hd * fm1, hs * hd * (hs + hd))
        first = (
            over(-(2 * d1 + d2), d1 * (d1 + d2)) * f0
            + over(d1 + d2, d1 * d2) * fp1
            - over(d1, d2 * (d1 + d2)) * fp2
        )
        last = (
            over(e1, e2 * (e1 + e2)) * fm2
            - over(e1 + e2, e1 * e2) * fm1
            + over(2 * e1 + e2, e1 * (e1 + e2)) * f0
        )
        out[v + suffix] = (
            F.when(m1.isNull() & p2.isNotNull(), first)
            .when(p1.isNull() & m2.isNotNull(), last)
            .when(m1.isNotNull() & p1.isNotNull(), inner)
        )
    return seg.withColumns(out).drop(*near, "seg", "own")


def jerk_discrepancy(
    df: DataFrame,
    recorded: list[str],
    numeric: list[str],
    n: str = "n",
    step: str = "step",
    by: list[str] | None = None,
) -> DataFrame:
    """Norms of recorded minus numeric jerk; interior statistics skip the end rows when n > 2.

    ``n`` is the row count of the row's trajectory. ``rms_rel`` is NaN where all recorded jerk is zero.
    """
    diff = F.sqrt(sum((F.col(a) - F.col(b)) ** 2 for a, b in zip(recorded, numeric)))
    size = F.sqrt(sum(F.col(a) ** 2 for a in recorded))
    inside = (F.col(n) <= 2) | F.col(step).between(1, F.col(n) - 2)
    rows = df.select(*(by or []), diff.alias("d"), size.alias("s"), inside.alias("i"))
    interior = F.when(F.col("i"), F.col("d"))
    return rows.groupBy(*(by or [])).agg(
        F.max("d").alias("max"),
        F.avg("d").alias("mean"),
        F.max(interior).alias("interior_max"),
        F.avg(interior).alias("interior_mean"),
        F.avg("s").alias("mean_jerk_norm"),
        F.when(F.avg("s") == 0, F.lit(float("nan")))
        .otherwise(F.try_divide(F.sqrt(F.avg(interior * interior)), F.avg("s")))
        .alias("rms_rel"),
    )


def self_consistency(
    df: DataFrame, dt: Column, key: str = "stem", step: str = "step", by: list[str] | None = None
) -> DataFrame:
    """Mean absolute one-step mismatch of p from v, v from a and a from j under constant jerk."""
    seg = with_halo(df, key, before=0, after=1, step=step)
    w = segment_window(key, step)
    nxt = {f"_n{k}": F.lead(k).over(w) for k in "pva"}
    seg = seg.withColumns(nxt | {"_dt": dt}).where("own").where(F.col("_np").isNotNull())
    h = F.col("_dt")
    gaps = {"p": [], "v": [], "a": []}
    for i in range(3):
        p, v, a, j = (F.col(k)[i] for k in "pvaj")
        gaps["p"].append(
            F.abs(F.col("_np")[i] - (p + v * h + a * h * h / 2 + j * h * h * h / 6))
        )
        gaps["v"].append(F.abs(F.col("_nv")[i] - (v + a * h + j * h * h / 2)))
        gaps["a"].append(F.abs(F.col("_na")[i] - (a + j * h)))
    cols = {k: sum(v[1:], v[0]) / 3 for k, v in gaps.items()}
    return seg.groupBy(*(by or [])).agg(
        *[
            F.avg(F.when(is_finite(c), c)).alias(f"{k}_mismatch")
            for k, c in cols.items()
        ]
    )


def attitude_reconciliation(
    df: DataFrame, recorded: str, analytic: str, by: list[str] | None = None
) -> DataFrame:
    """How far recorded·analyticᵀ is from a pure z rotation, and the largest yaw gap (row-major arrays)."""
    r, s = parts(recorded, 9), parts(analytic, 9)
    rel = [
        r[3 * i] * s[3 * k] + r[3 * i + 1] * s[3 * k + 1] + r[3 * i + 2] * s[3 * k + 2]
        for i in range(3)
        for k in range(3)
    ]
    rows = df.select(*(by or []), F.array(*rel).alias("q")).where(is_finite(F.col("q")[0]))
    q = parts("q", 9)
    off = F.greatest(
        F.abs(q[2]), F.abs(q[5]), F.abs(q[6]), F.abs(q[7]), F.abs(q[8] - 1.0)
    )
    return rows.groupBy(*(by or [])).agg(
        F.max(off).alias("residual"), F.max(F.abs(F.atan2(q[3], q[0]))).alias("max_abs_yaw")
    )


def agreement(
    df: DataFrame, pairs: dict[str, tuple[str, str, float]], by: list[str] | None = None
) -> DataFrame:
    """Largest absolute difference of each (analytic, recorded, tolerance) array pair, and a verdict."""
    gap = lambda x, y: F.array_max(F.transform(array_sub(F.col(x), F.col(y)), F.abs))
    worst = df.groupBy(*(by or [])).agg(
        *[F.max(gap(x, y)).alias(f"{k}_max_abs") for k, (x, y, _) in pairs.items()]
    )
    return worst.withColumns(
        {f"{k}_agrees": F.col(f"{k}_max_abs") <= tol for k, (_, _, tol) in pairs.items()}
    )


def check_vectors(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Fails the job when an array column has the wrong width."""
    checked = {
        c: F.when(F.size(c) == n, F.col(c)).otherwise(
            F.raise_error(F.concat(F.lit(f"{c} must have {n} entries, got "), F.size(c)))
        )
        for c, n in widths.items()
    }
    return df.withColumns(checked)

