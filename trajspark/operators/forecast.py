"""Baseline rollouts over window arrays and masked horizon errors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.arrow import matrix
from trajspark.operators.linalg import collect_parts, summed_parts
from trajspark.operators.windows import WindowConfig, WindowStarts, window_rows
from trajspark.plans.ordering import segment_window, with_halo


def constant_jerk_rollout(
    state: Column, jerk: Column, dt: Column | float, exact: bool = True
) -> Column:
    """Nine-number states (p, v, a) for each jerk entry, integrated from ``state``.

    ``exact`` uses the closed form for constant jerk over a step, otherwise forward Euler.
    """
    h = dt if isinstance(dt, Column) else F.lit(float(dt))

    def advance(s: Column, u: Column) -> Column:
        p, v, a = ([s[3 * k + i] for i in range(3)] for k in range(3))
        j = [u[i] for i in range(3)]
        if exact:
            p1 = [p[i] + v[i] * h + a[i] * h * h / 2 + j[i] * h * h * h / 6 for i in range(3)]
            v1 = [v[i] + a[i] * h + j[i] * h * h / 2 for i in range(3)]
        else:
            p1 = [p[i] + v[i] * h for i in range(3)]
            v1 = [v[i] + a[i] * h for i in range(3)]
        a1 = [a[i] + j[i] * h for i in range(3)]
        return F.array(*p1, *v1, *a1)

    start = F.array(state)
    # The one-element transform binds the last state once instead of repeating its lookup per entry.
    step = lambda acc, u: F.transform(F.slice(acc, -1, 1), lambda s: advance(s, u))
    path = F.aggregate(jerk, start, lambda acc, u: F.concat(acc, step(acc, u)))
    return F.slice(path, F.lit(2), F.size(jerk))


def rollout_error(
    df: DataFrame,
    dt: float,
    hist: str = "state_hist",
    action: str = "action_future",
    actual: str = "state_future",
    exact: bool = True,
) -> DataFrame:
    """Per-step error of the constant-jerk rollout, without building the predicted arrays.

    Equals ``horizon_error`` of ``constant_jerk_rollout``; each task integrates its batches as cumulative
    sums and keeps one total per step.
    """

    def reduce_batch(batch):
        start, jerk, truth = matrix(batch, "_start"), matrix(batch, action), matrix(batch, actual)
        p0, v0, a0 = (start[:, None, 3 * k : 3 * k + 3] for k in range(3))
        a = a0 + np.cumsum(jerk * dt, axis=1)
        a_old = a - jerk * dt
        dv = a_old * dt + (jerk * dt**2 / 2 if exact else 0.0)
        v = v0 + np.cumsum(dv, axis=1)
        v_old = v - dv
        dp = v_old * dt + (a_old * dt**2 / 2 + jerk * dt**3 / 6 if exact else 0.0)
        p = p0 + np.cumsum(dp, axis=1)
        gap = np.concatenate([p, v, a], axis=2) - truth
        return {"sq": (gap**2).sum(axis=(0, 2)), "n": np.array([float(len(gap))])}

    rows = df.select(F.element_at(hist, -1).alias("_start"), action, actual)
    return _per_step(df, collect_parts(summed_parts(rows, ["_start", action, actual], reduce_batch)))


def _per_step(df: DataFrame, sums: dict[str, np.ndarray]) -> DataFrame:
    n = float(sums["n"][0]) if sums else 0.0
    table = [(k + 1, float(e), n, float(e) / max(n, 1.0)) for k, e in enumerate(sums.get("sq", []))]
    return df.sparkSession.createDataFrame(
        table, "horizon_step int, squared_error double, weight double, mse double"
    )


def rollout_error_ahead(
    df: DataFrame,
    config: WindowConfig,
    dt: float,
    exact: bool = True,
    key: str = "stem",
    step: str = "step",
    valid: str | None = "valid",
    action: str = "j",
) -> DataFrame:
    """``rollout_error`` of the windows of rows with p, v, a and ``action``, without building windows.

    Every anchor's state moves on step by step beside the rows that lie that far ahead, for all anchors of a
    batch at once; a task keeps one total per step.
    """

    def per_task():
        stream = WindowStarts(config, ["p", "v", "a", action])

        def reduce(batch):
            data, first = stream(batch)
            if not len(first):
                return {}
            at = first + (config.history - 1) * config.stride
            p, v, a = (data[c][at] for c in "pva")
            errors = []
            for _ in range(config.horizon):
                at = at + config.stride
                j = data[action][at]
                if exact:
                    p = p + v * dt + a * dt**2 / 2 + j * dt**3 / 6
                    v = v + a * dt + j * dt**2 / 2
                else:
                    p, v = p + v * dt, v + a * dt
                a = a + j * dt
                errors.append(sum(((x - data[c][at]) ** 2).sum() for x, c in ((p, "p"), (v, "v"), (a, "a"))))
            return {"sq": np.array(errors), "n": np.array([float(len(first))])}

        return reduce

    rows = window_rows(df, config, ["p", "v", "a", action], key, step, valid)
    return _per_step(df, collect_parts(summed_parts(rows, rows.columns, per_task, per_task=True)))


def hold_last(hist: Column | str, horizon: int) -> Column:
    return F.array_repeat(F.element_at(hist, -1), horizon)


def last_state(hist: Column | str) -> Column:
    return F.element_at(hist, -1)


def horizon_error(
    df: DataFrame, actual: str, predicted: str, mask: str | None = None, by: list[str] | None = None
) -> DataFrame:
    """Mean squared L2 error per horizon step; masked-out steps do not count.

    ``mask`` is an array of 0/1 per step. Denominators are at least one, as for an all-masked step.
    """
    by = by or []
    flags = F.col(mask) if mask else F.transform(F.col(actual), lambda _: F.lit(1.0))
    sq = F.zip_with(
        F.col(actual),
        F.col(predicted),
        lambda x, y: F.aggregate(
            F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v
        ),
    )
    rows = df.select(*by, F.posexplode(F.arrays_zip(sq.alias("e"), flags.alias("m"))).alias("h", "z"))
    m = F.col("z.m").cast("double")
    return rows.groupBy(*by, (F.col("h") + 1).alias("horizon_step")).agg(
        F.sum(F.when(m != 0, F.col("z.e") * m).otherwise(0.0)).alias("squared_error"),
        F.sum(m).alias("weight"),
    ).withColumn("mse", F.col("squared_error") / F.greatest("weight", F.lit(1.0)))


def hold_last_error(
    df: DataFrame,
    config: WindowConfig,
    fields: dict[str, Column],
    mask: Callable[[Column], Column] | None = None,
    by: list[str] | None = None,
    key: str = "stem",
    step: str = "step",
    valid: str = "valid",
) -> DataFrame:
    """``horizon_error`` of holding each window's last observed ``fields``, without building windows.

    A window is known by its first row: its frame must be full and without an invalid row, its anchor and
    its future are rows a fixed distance ahead. ``mask`` says from a step whether it counts.
    """
    by = by or []
    slim = df.select(key, step, *by, F.when(F.col(valid), 0).otherwise(1).alias("_bad"), *[c.alias(f"_f{i}") for i, c in enumerate(fields.values())])
    seg = with_halo(slim, key, before=0, after=config.reach, step=step)
    row = segment_window(key, step)
    frame = row.rowsBetween(0, config.reach)
    strided = [F.lead("_bad", k * config.stride).over(row) for k in range(1, config.span)] if config.stride > 1 else []
    bad = sum(strided, F.col("_bad")) if strided else F.sum("_bad").over(frame)
    anchor = (config.history - 1) * config.stride
    gaps = {}
    for h in range(1, config.horizon + 1):
        at = anchor + h * config.stride
        gaps[f"_e{h}"] = sum(
            (F.lead(f"_f{i}", at).over(row) - F.lead(f"_f{i}", anchor).over(row)) ** 2 for i in range(len(fields))
        )
    ahead = seg.withColumns({"_n": F.count("*").over(frame), "_bad": bad, **gaps})
    kept = ahead.where(f"own AND _n = {config.reach + 1} AND _bad = 0")
    weights = {h: mask(F.col(step) + anchor + h * config.stride).cast("double") if mask else F.lit(1.0) for h in range(1, config.horizon + 1)}
    sums = kept.groupBy(*by).agg(
        *[F.sum(F.when(w != 0, F.col(f"_e{h}") * w).otherwise(0.0)).alias(f"_s{h}") for h, w in weights.items()],
        *[F.sum(w).alias(f"_w{h}") for h, w in weights.items()],
    )
    steps = F.array(*[F.struct(F.lit(h).alias("horizon_step"), F.col(f"_s{h}").alias("squared_error"), F.col(f"_w{h}").alias("weight")) for h in weights])
    rows = sums.select(*by, F.inline(steps)).where("weight IS NOT NULL")  # no window at all
    return rows.withColumn("mse", F.col("squared_error") / F.greatest("weight", F.lit(1.0)))


def overall_error(per_step: DataFrame, by: list[str] | None = None) -> DataFrame:
    return per_step.groupBy(*(by or [])).agg(
        (F.sum("squared_error") / F.greatest(F.sum("weight"), F.lit(1.0))).alias("mse")
    )
