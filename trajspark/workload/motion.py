"""Flat map, kinematics, window and dataset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions.flatmap import (
    acceleration_quad_position,
    flat_map,
    rotation_of,
    with_quaternion,
)
from trajspark.functions.vectors import array_sub, parts
from trajspark.operators import dataset, forecast, kinematics, windows
from trajspark.operators.windows import WindowConfig
from trajspark.workload.registry import q6, query, r6
from trajspark.workload.views import EV, FLAT, PHYS, ev_steps, phys_steps

SMALL = WindowConfig(history=4, horizon=3)


@query(
    "tension_margin",
    f"""WITH {PHYS}, m AS (SELECT stem, step, sqrt(a0*a0 + a1*a1 + (a2 + 981e-2)**2) AS pull FROM ph)
SELECT stem, step, {q6("163e-3 * pull")} AS tension, {q6("pull / 981e-2")} AS margin FROM m""",
)
def tension_margin(spark, sf):
    return flat_map(phys_steps(spark, sf)).select(
        "stem", "step", r6("tension").alias("tension"), r6("tension_margin").alias("margin")
    )


@query(
    "flat_map",
    f"""WITH {FLAT} SELECT stem, step, valid, {", ".join(f"{q6(c)} AS {c}" for c in
      ("z0", "z1", "z2", "b10", "b12", "b20", "b21", "b22", "pq0", "pq1", "pq2"))},
      {", ".join(f"{q6(c, 3)} AS {c}" for c in ("vq0", "vq1", "vq2"))} FROM flat""",
)
def flat_outputs(spark, sf):
    f = flat_map(phys_steps(spark, sf))
    cols = {"z0": ("cable_dir", 0), "z1": ("cable_dir", 1), "z2": ("cable_dir", 2)}
    cols |= {"b10": ("R_quad", 0), "b12": ("R_quad", 6)}
    cols |= {"b20": ("R_quad", 1), "b21": ("R_quad", 4), "b22": ("R_quad", 7)}
    cols |= {f"pq{i}": ("p_quad", i) for i in range(3)}
    rates = {f"vq{i}": ("v_quad", i) for i in range(3)}
    return f.select(
        "stem", "step", "valid",
        *[r6(F.col(a)[i]).alias(c) for c, (a, i) in cols.items()],
        *[r6(F.col(a)[i], 3).alias(c) for c, (a, i) in rates.items()],
    )


@query(
    "guard_counts",
    f"""WITH {FLAT} SELECT stem, count(*) FILTER (g_ff) AS free_fall, count(*) FILTER (g_force) AS force,
  count(*) FILTER (g_cross) AS degenerate_cross, count(*) FILTER (bad) AS nonfinite_input,
  count(*) FILTER (NOT valid) AS invalid_total FROM flat GROUP BY stem""",
)
def guard_counts(spark, sf):
    return kinematics.guard_counts(flat_map(phys_steps(spark, sf)), ["stem"])


QUAT = (
    FLAT
    + """,
q0 AS (SELECT stem, step, valid, b10 AS m0, b20 AS m1, z0 AS m2, b11 AS m3, b21 AS m4, z1 AS m5, b12 AS m6, b22 AS m7, z2 AS m8 FROM flat),
q1 AS (SELECT *, m0 + m4 + m8 AS tr, greatest(m0, m4, m8, m0 + m4 + m8) AS top FROM q0),
q2 AS (SELECT stem, step, valid,
   CASE WHEN NOT valid THEN NULL
     WHEN m0 = top THEN [1 - tr + 2*m0, m3 + m1, m6 + m2, m7 - m5]
     WHEN m4 = top THEN [m3 + m1, 1 - tr + 2*m4, m7 + m5, m2 - m6]
     WHEN m8 = top THEN [m6 + m2, m7 + m5, 1 - tr + 2*m8, m3 - m1]
     ELSE [m7 - m5, m2 - m6, m3 - m1, 1 + tr] END AS r FROM q1),
q3 AS (SELECT stem, step, valid, r, sqrt(r[1]*r[1] + r[2]*r[2] + r[3]*r[3] + r[4]*r[4]) AS len FROM q2),
q4 AS (SELECT stem, step, valid, r[1]/len AS x, r[2]/len AS y, r[3]/len AS z, r[4]/len AS w FROM q3),
q5 AS (SELECT *, CASE WHEN x*lag(x) OVER o + y*lag(y) OVER o + z*lag(z) OVER o + w*lag(w) OVER o < 0 THEN 1 ELSE 0 END AS flip
   FROM q4 WINDOW o AS (PARTITION BY stem ORDER BY step)),
q6 AS (SELECT *, sum(flip) OVER (PARTITION BY stem ORDER BY step) % 2 AS odd FROM q5),
q7 AS (SELECT *, CASE WHEN odd = 1 THEN -1e0 ELSE 1e0 END AS sg FROM q6),
q8 AS (SELECT stem, arg_min(sg * w, step) FILTER (valid) AS head FROM q7 GROUP BY stem),
quat AS (SELECT stem, step, valid, sg * CASE WHEN head < 0 THEN -1e0 ELSE 1e0 END AS g, x, y, z, w FROM q7 JOIN q8 USING (stem))"""
)


@query(
    "quaternion_continuity",
    f"""WITH {QUAT} SELECT stem, step, {q6("g*x", 5)} AS qx, {q6("g*y", 5)} AS qy, {q6("g*z", 5)} AS qz,
  {q6("g*w", 5)} AS qw FROM quat""",
)
def quaternion_continuity(spark, sf):
    f = kinematics.flat_outputs(phys_steps(spark, sf))
    return f.select(
        "stem", "step",
        *[r6(F.col("quat_quad")[i], 5).alias(c) for i, c in enumerate(("qx", "qy", "qz", "qw"))],
    )


@query(
    "quaternion_roundtrip",
    f"""WITH {FLAT} SELECT stem, count(*) FILTER (valid) AS n, 0e0 AS max_gap FROM flat
GROUP BY stem HAVING count(*) FILTER (valid) > 0""",
)
def quaternion_roundtrip(spark, sf):
    """Rotation -> quaternion -> rotation must be the identity up to rounding."""
    f = flat_map(phys_steps(spark, sf)).where("valid").select("stem", "R_quad")
    f = with_quaternion(f, "R_quad", "q").withColumn("back", rotation_of(F.col("q")))
    gap = F.array_max(F.transform(array_sub(F.col("R_quad"), F.col("back")), F.abs))
    return f.groupBy("stem").agg(F.count("*").alias("n"), r6(F.max(gap)).alias("max_gap"))


@query(
    "reconcile_attitude",
    f"""WITH {FLAT} SELECT stem, 0e0 AS residual, {q6("max(abs(sin(time + stem % 5)))", 5)} AS max_abs_yaw
FROM flat WHERE valid GROUP BY stem""",
)
def reconcile_attitude(spark, sf):
    """Attitudes rotated by a known yaw must reconcile exactly and return that yaw."""
    f = flat_map(phys_steps(spark, sf)).select("stem", "time", "R_quad")
    yaw = F.sin(F.col("time") + F.col("stem") % 5)
    c, s = F.cos(yaw), F.sin(yaw)
    r = parts("R_quad", 9)
    turned = [c * r[k] - s * r[3 + k] for k in range(3)]
    turned += [s * r[k] + c * r[3 + k] for k in range(3)] + r[6:]
    rows = f.withColumn("recorded", F.array(*turned))
    out = kinematics.attitude_reconciliation(rows, "recorded", "R_quad", ["stem"])
    return out.select(
        "stem", r6("residual").alias("residual"), r6("max_abs_yaw", 5).alias("max_abs_yaw")
    )


@query(
    "kinematics_agreement",
    f"""WITH {FLAT},
d AS (SELECT stem, sqrt(a0*a0 + a1*a1 + (a2 + 981e-2)**2) AS n, * EXCLUDE (stem) FROM flat WHERE valid),
g AS (SELECT stem, greatest(abs(pq0 - (p0 + 567e-3*a0/n)), abs(pq1 - (p1 + 567e-3*a1/n)),
   abs(pq2 - (p2 + 567e-3*(a2 + 981e-2)/n))) AS gap FROM d)
SELECT stem, {q6("max(gap)")} AS quad_p_max_abs, max(gap) <= 1e-9 AS quad_p_agrees FROM g GROUP BY stem""",
)
def kinematics_agreement(spark, sf):
    """The acceleration-only vehicle position against the force-based one."""
    f = flat_map(phys_steps(spark, sf)).where("valid")
    f = f.withColumn("p_acc", F.array(*acceleration_quad_position(parts("p"), parts("a"))))
    out = kinematics.agreement(f, {"quad_p": ("p_quad", "p_acc", 1e-9)}, ["stem"])
    return out.withColumn("quad_p_max_abs", r6("quad_p_max_abs"))


GRAD = (
    PHYS
    + """,
g0 AS (SELECT *, lag(time) OVER o AS tm, lead(time) OVER o AS tp, lag(time, 2) OVER o AS tmm, lead(time, 2) OVER o AS tpp,
   count(*) OVER (PARTITION BY stem) AS n"""
    + "".join(
        f", lag(a{i}) OVER o AS am{i}, lead(a{i}) OVER o AS ap{i}, lag(a{i}, 2) OVER o AS amm{i}, lead(a{i}, 2) OVER o AS app{i}"
        for i in range(3)
    )
    + """ FROM ph WINDOW o AS (PARTITION BY stem ORDER BY step)),
g1 AS (SELECT *, time - tm AS hs, tp - time AS hd, tpp - tp AS d2, tm - tmm AS e2 FROM g0),
gr AS (SELECT *"""
    + "".join(
        f""", CASE WHEN tm IS NULL AND tpp IS NOT NULL THEN
     -(2*hd + d2)/(hd*(hd + d2))*a{i} + (hd + d2)/(hd*d2)*ap{i} - hd/(d2*(hd + d2))*app{i}
   WHEN tp IS NULL AND tmm IS NOT NULL THEN
     hs/(e2*(hs + e2))*amm{i} - (hs + e2)/(hs*e2)*am{i} + (2*hs + e2)/(hs*(hs + e2))*a{i}
   WHEN tm IS NOT NULL AND tp IS NOT NULL THEN
     (hs*hs*ap{i} + (hd*hd - hs*hs)*a{i} - hd*hd*am{i})/(hs*hd*(hs + hd)) END AS gj{i}"""
        for i in range(3)
    )
    + " FROM g1)"
)


def _numeric_jerk(spark, sf):
    steps = phys_steps(spark, sf).select(
        "stem", "step", "time",
        *[F.col("a")[i].alias(f"a{i}") for i in range(3)],
        *[F.col("j")[i].alias(f"j{i}") for i in range(3)],
    )
    return kinematics.gradient(steps, ["a0", "a1", "a2"])


@query(
    "gradient_edge2",
    f"WITH {GRAD} SELECT stem, step, {q6('gj0')} AS gj0, {q6('gj1')} AS gj1, {q6('gj2')} AS gj2 FROM gr",
)
def gradient_edge2(spark, sf):
    g = _numeric_jerk(spark, sf)
    return g.select("stem", "step", *[r6(f"a{i}_grad").alias(f"gj{i}") for i in range(3)])


@query(
    "jerk_discrepancy",
    f"""WITH {GRAD},
d AS (SELECT stem, step, n, sqrt((j0-gj0)**2 + (j1-gj1)**2 + (j2-gj2)**2) AS d, sqrt(j0*j0 + j1*j1 + j2*j2) AS s,
   n <= 2 OR step BETWEEN 1 AND n - 2 AS inside FROM gr WHERE isfinite(j0))
SELECT stem, {q6("max(d)")} AS max, {q6("avg(d)")} AS mean, {q6("max(d) FILTER (inside)")} AS interior_max,
  {q6("avg(d) FILTER (inside)")} AS interior_mean,
  {q6("avg(s)")} AS mean_jerk_norm, {q6("CASE WHEN avg(s) > 0 THEN sqrt(avg(d*d) FILTER (inside)) / avg(s) END")} AS rms_rel FROM d GROUP BY stem""",
)
def jerk_discrepancy(spark, sf):
    g = _numeric_jerk(spark, sf)
    n = g.groupBy("stem").agg(F.count("*").alias("n"))
    rows = g.where(~F.isnan("j0")).join(n, "stem")
    out = kinematics.jerk_discrepancy(
        rows, ["j0", "j1", "j2"], ["a0_grad", "a1_grad", "a2_grad"], by=["stem"]
    )
    return out.select(
        "stem",
        *[r6(c).alias(c) for c in ("max", "mean", "interior_max", "interior_mean", "mean_jerk_norm", "rms_rel")],
    )


def _zoh(axis: int) -> str:
    i, h = axis, "1e-1"
    return (
        f"abs(lead(p{i}) OVER o - (p{i} + v{i}*{h} + a{i}*{h}*{h}/2 + j{i}*{h}*{h}*{h}/6)) AS gp{i}, "
        f"abs(lead(v{i}) OVER o - (v{i} + a{i}*{h} + j{i}*{h}*{h}/2)) AS gv{i}, "
        f"abs(lead(a{i}) OVER o - (a{i} + j{i}*{h})) AS ga{i}"
    )


@query(
    "self_consistency",
    f"""WITH {PHYS},
z AS (SELECT stem, {_zoh(0)}, {_zoh(1)}, {_zoh(2)} FROM ph WINDOW o AS (PARTITION BY stem ORDER BY step)),
y AS (SELECT stem, (gp0 + gp1 + gp2)/3 AS gp, (gv0 + gv1 + gv2)/3 AS gv, (ga0 + ga1 + ga2)/3 AS ga FROM z)
SELECT stem, {q6("avg(gp) FILTER (isfinite(gp))")} AS p_mismatch, {q6("avg(gv) FILTER (isfinite(gv))")} AS v_mismatch,
  {q6("avg(ga) FILTER (isfinite(ga))")} AS a_mismatch FROM y GROUP BY stem""",
)
def self_consistency(spark, sf):
    out = kinematics.self_consistency(phys_steps(spark, sf), F.lit(0.1), by=["stem"])
    return out.select("stem", *[r6(f"{k}_mismatch").alias(f"{k}_mismatch") for k in "pva"])


# -- windows --------------------------------------------------------------------------------------


@query(
    "sliding_windows",
    f"""WITH {EV}, w AS (SELECT stem, step + 9 AS anchor_index, count(*) OVER f AS c, first_value(value) OVER f AS first,
   last_value(value) OVER f AS last, sum(value) OVER f AS total FROM ev
   WINDOW f AS (PARTITION BY stem ORDER BY step ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING))
SELECT stem, anchor_index, first, last, {q6("total", 4)} AS total FROM w WHERE c = 30""",
)
def sliding_windows(spark, sf):
    w = windows.raw_windows(ev_steps(spark, sf), ["value"], WindowConfig())
    reads = F.col("reads")
    total = F.aggregate(reads, F.lit(0.0), lambda acc, r: acc + r["value"])
    return w.select(
        "stem", "anchor_index", reads[0]["value"].alias("first"),
        F.element_at(reads, -1)["value"].alias("last"), r6(total, 4).alias("total"),
    )


@query(
    "strided_windows",
    f"""WITH {EV}, s AS (SELECT stem, step, value, lead(value, 24) OVER (PARTITION BY stem ORDER BY step) AS last FROM ev),
w AS (SELECT a.stem, a.step, any_value(a.value) AS first, any_value(a.last) AS last, sum(b.value) AS total
  FROM s a JOIN ev b ON b.stem = a.stem AND b.step BETWEEN a.step AND a.step + 24 AND (b.step - a.step) % 3 = 0
  WHERE a.last IS NOT NULL GROUP BY a.stem, a.step)
SELECT stem, step + 9 AS anchor_index, first, last, {q6("total", 4)} AS total FROM w""",
)
def strided_windows(spark, sf):
    w = windows.raw_windows(ev_steps(spark, sf), ["value"], WindowConfig(4, 5, 3))
    reads = F.col("reads")
    total = F.aggregate(reads, F.lit(0.0), lambda acc, r: acc + r["value"])
    return w.select(
        "stem", "anchor_index", reads[0]["value"].alias("first"),
        F.element_at(reads, -1)["value"].alias("last"), r6(total, 4).alias("total"),
    )


@query("strided_rows", f"WITH {EV} SELECT stem, step, value FROM ev WHERE step % 4 = 0")
def strided_rows(spark, sf):
    return windows.strided(ev_steps(spark, sf), 4).select("stem", "step", "value")


# Valid windows of the default shape, and their rows by offset.
WIN = (
    FLAT
    + """,
wc AS (SELECT stem, step AS s0, split, count(*) OVER f AS c, count(*) FILTER (NOT valid) OVER f AS b FROM flat
   WINDOW f AS (PARTITION BY stem ORDER BY step ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
wv AS (SELECT stem, s0, s0 + 9 AS anchor_index, split FROM wc WHERE c = 30 AND b = 0),
wr AS (SELECT v.stem, v.anchor_index, v.split, f.step - v.s0 AS k, f.p0 - o.p0 AS x0, f.p1 - o.p1 AS x1, f.p2 - o.p2 AS x2,
   f.v0, f.v1, f.v2, f.a0, f.a1, f.a2, f.j0, f.j1, f.j2
   FROM wv v JOIN flat f ON f.stem = v.stem AND f.step BETWEEN v.s0 AND v.s0 + 29
   JOIN flat o ON o.stem = v.stem AND o.step = v.anchor_index)"""
)


def _windows(spark, sf, targets=False):
    return windows.extract_windows(
        flat_map(phys_steps(spark, sf)), WindowConfig(), targets=targets, carry=["split"]
    )


@query(
    "valid_windows",
    f"WITH {WIN} SELECT stem, anchor_index, split FROM wv",
)
def valid_windows(spark, sf):
    return _windows(spark, sf).select("stem", "anchor_index", "split")


@query(
    "anchor_relative",
    f"""WITH {WIN} SELECT stem, anchor_index, {q6("sum(x0) FILTER (k < 10)")} AS hist_x, {q6("sum(x2) FILTER (k < 10)")} AS hist_z,
  {q6("sum(x1) FILTER (k >= 10)")} AS future_y, {q6("sum(v2) FILTER (k >= 10)")} AS future_vz,
  {q6("sum(j2) FILTER (k < 10)")} AS action_hist_z, {q6("sum(j0) FILTER (k >= 10)")} AS action_future_x
FROM wr GROUP BY stem, anchor_index""",
)
def anchor_relative(spark, sf):
    w = _windows(spark, sf)
    total = lambda c, i: r6(F.aggregate(c, F.lit(0.0), lambda acc, r: acc + r[i]))
    return w.select(
        "stem", "anchor_index",
        total("state_hist", 0).alias("hist_x"), total("state_hist", 2).alias("hist_z"),
        total("state_future", 1).alias("future_y"), total("state_future", 5).alias("future_vz"),
        total("action_hist", 2).alias("action_hist_z"), total("action_future", 0).alias("action_future_x"),
    )


TARGETS_SQL = (
    WIN
    + """,
tg AS (SELECT v.stem, v.anchor_index, v.split, [f.v0, f.v1, f.v2, f.a0, f.a1, f.a2, f.j0, f.j1, f.j2, f.z0, f.z1, f.z2,
   f.b10, f.b20, f.b11, f.b21, f.b12, f.b22, f.pq0 - f.p0, f.pq1 - f.p1, f.pq2 - f.p2, f.margin] AS y
   FROM wv v JOIN flat f ON f.stem = v.stem AND f.step = v.anchor_index)"""
)


@query(
    "target_pack",
    f"WITH {TARGETS_SQL} SELECT stem, anchor_index, "
    + ", ".join(f"{q6(f'y[{i + 1}]')} AS y{i:02d}" for i in range(22))
    + " FROM tg",
)
def target_pack(spark, sf):
    w = _windows(spark, sf, targets=True)
    return w.select(
        "stem", "anchor_index", *[r6(F.col("targets")[i]).alias(f"y{i:02d}") for i in range(22)]
    )


@query(
    "target_slices",
    f"""WITH {TARGETS_SQL}, s(target, kind, lo, width) AS (VALUES ('v','linear_trivial',0,3),('a','linear_trivial',3,3),
  ('j','linear_trivial',6,3),('cable_dir','nonlinear',9,3),('R_quad_cols','nonlinear',12,6),('p_quad','nonlinear',18,3),
  ('tension_margin','nonlinear',21,1))
SELECT target, kind, count(*) AS n, {q6("avg(list_sum(y[lo + 1:lo + width]))")} AS mean_sum FROM tg, s GROUP BY target, kind""",
)
def target_slices(spark, sf):
    w = _windows(spark, sf, targets=True)
    layout = windows.target_table(spark)
    names = list(windows.target_slices())
    long = w.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("target"), windows.target_of("targets", n).alias("y")) for n in names])
        ).alias("s")
    ).select("s.*")
    total = F.aggregate("y", F.lit(0.0), lambda acc, v: acc + v)
    return (
        long.groupBy("target")
        .agg(F.count("*").alias("n"), r6(F.avg(total)).alias("mean_sum"))
        .join(F.broadcast(layout), "target")  # seven rows
        .select("target", "kind", "n", "mean_sum")
    )


@query(
    "target_windows",
    f"""WITH {EV}, w AS (SELECT stem, step FROM ev QUALIFY count(*) OVER (PARTITION BY stem ORDER BY step
    ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) = 7),
n AS (SELECT stem, step, unnest([1, 2, 3]) AS k FROM w)
SELECT n.stem, n.step + 3 AS anchor_index, n.k, {q6("sum(e.value)", 4)} AS total, arg_min(e.value, e.step) AS first,
  arg_max(e.value, e.step) AS last
FROM n JOIN ev e ON e.stem = n.stem AND e.step BETWEEN n.step + n.k AND n.step + n.k + 3 GROUP BY ALL""",
)
def target_windows(spark, sf):
    w = windows.raw_windows(ev_steps(spark, sf), ["value"], SMALL)
    values = F.transform("reads", lambda r: r["value"])
    nested = windows.nested_target_windows(F.slice(values, 1, 4), F.slice(values, 5, 3), 4, 3)
    rows = w.select("stem", "anchor_index", F.posexplode(nested).alias("k", "t"))
    total = F.aggregate("t", F.lit(0.0), lambda acc, v: acc + v)
    return rows.select(
        "stem", "anchor_index", (F.col("k") + 1).alias("k"), r6(total, 4).alias("total"),
        F.col("t")[0].alias("first"), F.element_at("t", -1).alias("last"),
    )


# -- dataset --------------------------------------------------------------------------------------

STATS = (
    TARGETS_SQL
    + """,
ch AS (
  SELECT split, CASE WHEN k < 10 THEN 'state_hist' ELSE 'state_future' END AS array_name, unnest(range(9)) AS channel,
     unnest([x0, x1, x2, v0, v1, v2, a0, a1, a2]) AS v FROM wr
  UNION ALL SELECT split, CASE WHEN k < 10 THEN 'action_hist' ELSE 'action_future' END, unnest(range(3)), unnest([j0, j1, j2]) FROM wr
  UNION ALL SELECT split, 'targets', unnest(range(22)), unnest(y) FROM tg),
stats AS (
  SELECT array_name, channel::INT AS channel, avg(v) AS mean,
     CASE WHEN stddev_pop(v) < 1e-6 THEN 1e0 ELSE stddev_pop(v) END AS std, count(*) AS n_samples
  FROM ch WHERE split = 'train' GROUP BY array_name, channel)"""
)


@query(
    "norm_stats",
    f"WITH {STATS} SELECT array_name, channel, {q6('mean')} AS mean, {q6('std')} AS std, n_samples FROM stats",
)
def norm_stats(spark, sf):
    s = dataset.row_norm_stats(flat_map(phys_steps(spark, sf)))
    return s.select(
        "array_name", "channel", r6("mean").alias("mean"), r6("std").alias("std"), "n_samples"
    )


@query(
    "normalised_windows",
    f"""WITH {STATS}, z AS (SELECT split, c.array_name, c.channel, (v - mean) / std AS z FROM ch c
   JOIN stats s ON s.array_name = c.array_name AND s.channel = c.channel)
SELECT split, array_name, channel::INT AS channel, {q6("avg(z)", 5)} AS mean, {q6("stddev_pop(z)", 5)} AS std, count(*) AS n
FROM z GROUP BY ALL""",
)
def normalised_windows(spark, sf):
    w = _windows(spark, sf, targets=True)
    scaled = dataset.normalise(w, dataset.stats_row(dataset.row_norm_stats(flat_map(phys_steps(spark, sf)))))
    rows = dataset.channel_moments(scaled, dataset.ARRAYS, by="split")
    return rows.select(
        "split", "array_name", "channel", r6("mean", 5).alias("mean"),
        r6(F.sqrt(F.col("m2") / F.col("n")), 5).alias("std"), F.col("n").cast("bigint").alias("n"),
    )


@query(
    "denorm_roundtrip",
    f"WITH {WIN} SELECT split, count(*) AS n_windows, 0e0 AS max_gap FROM wv GROUP BY split",
)
def denorm_roundtrip(spark, sf):
    """Normalise, denormalise, and compare every state entry with the original."""
    w = _windows(spark, sf, targets=True)
    stats = dataset.stats_row(dataset.row_norm_stats(flat_map(phys_steps(spark, sf))))
    w = w.withColumn("original", F.col("state_future"))
    back = dataset.denormalise(dataset.normalise(w, stats), stats)
    gap = F.array_max(
        F.transform(
            F.zip_with("original", "state_future", lambda a, b: F.zip_with(a, b, lambda x, y: F.abs(x - y))),
            F.array_max,
        )
    )
    return back.groupBy("split").agg(F.count("*").alias("n_windows"), r6(F.max(gap)).alias("max_gap"))


AUDIT = (
    WIN
    + """,
au0 AS (SELECT stem, split, count(*) AS n, greatest(count(*) - 29, 0) AS n_candidate FROM flat GROUP BY stem, split),
au1 AS (SELECT stem, time - lag(time) OVER (PARTITION BY stem ORDER BY step) AS gap FROM flat),
au2 AS (SELECT stem, median(gap) AS dt FROM au1 GROUP BY stem),
au3 AS (SELECT stem, count(*) AS k FROM wv GROUP BY stem),
au AS (SELECT a.*, coalesce(k, 0) AS n_windows, CASE WHEN n_candidate = 0 THEN 'too_short' WHEN coalesce(k, 0) = 0
   THEN 'all_invalid' ELSE 'used' END AS outcome, CASE WHEN n_candidate > 0 THEN round_even(1 / dt, 0)::BIGINT END AS hz
   FROM au0 a JOIN au2 USING (stem) LEFT JOIN au3 USING (stem))"""
)


@query(
    "trajectory_audit",
    f"WITH {AUDIT} SELECT stem, split, n, n_candidate, n_windows, outcome, hz FROM au",
)
def trajectory_audit(spark, sf):
    return dataset.trajectory_audit(flat_map(phys_steps(spark, sf)))


@query(
    "build_report",
    f"""WITH {AUDIT} SELECT 'windows' AS section, split AS name, sum(n_windows)::BIGINT AS n FROM au GROUP BY split
UNION ALL SELECT 'trajectories', split, count(*) FILTER (outcome = 'used') FROM au GROUP BY split
UNION ALL SELECT 'skipped', outcome, count(*) FROM au WHERE outcome <> 'used' GROUP BY outcome
UNION ALL SELECT 'dropped', 'invalid_windows', sum(n_candidate - n_windows)::BIGINT FROM au
UNION ALL SELECT 'sample_rate_hz', hz::VARCHAR, count(*) FROM au WHERE hz IS NOT NULL GROUP BY hz""",
)
def build_report(spark, sf):
    return dataset.build_report(dataset.trajectory_audit(flat_map(phys_steps(spark, sf))))


# -- forecasts ------------------------------------------------------------------------------------

ROLL = (
    WIN
    + """,
r0 AS (SELECT stem, anchor_index, k - 9 AS h, x0, x1, x2, v0, v1, v2, a0, a1, a2, j0, j1, j2 FROM wr WHERE k >= 9),
st AS (SELECT stem, anchor_index, v0 AS w0, v1 AS w1, v2 AS w2, a0 AS c0, a1 AS c1, a2 AS c2 FROM r0 WHERE h = 0),
r1 AS (SELECT r.*, """
    + ", ".join(
        f"w{i}, c{i}, c{i} + 1e-1 * sum(j{i}) OVER o AS e{i}" for i in range(3)
    )
    + """ FROM r0 r JOIN st USING (stem, anchor_index) WHERE h > 0
   WINDOW o AS (PARTITION BY stem, anchor_index ORDER BY h)),
r2 AS (SELECT *, """
    + ", ".join(
        f"w{i} + sum((e{i} - 1e-1*j{i}) * 1e-1 + j{i} * 5e-3) OVER o AS d{i}" for i in range(3)
    )
    + """ FROM r1 WINDOW o AS (PARTITION BY stem, anchor_index ORDER BY h)),
r3 AS (SELECT *, """
    + ", ".join(
        f"sum((d{i} - (e{i} - 1e-1*j{i}) * 1e-1 - j{i} * 5e-3) * 1e-1 + (e{i} - 1e-1*j{i}) * 5e-3 + j{i} * 1e-3 / 6) OVER o AS y{i}"
        for i in range(3)
    )
    + """ FROM r2 WINDOW o AS (PARTITION BY stem, anchor_index ORDER BY h))"""
)


@query(
    "rollout_forecast",
    f"""WITH {ROLL} SELECT h::INT AS horizon_step,
  {q6("avg((x0-y0)**2 + (x1-y1)**2 + (x2-y2)**2 + (v0-d0)**2 + (v1-d1)**2 + (v2-d2)**2 + (a0-e0)**2 + (a1-e1)**2 + (a2-e2)**2)")} AS mse
FROM r3 GROUP BY h""",
)
def rollout_forecast(spark, sf):
    errors = forecast.rollout_error_ahead(flat_map(phys_steps(spark, sf)), WindowConfig(), 0.1)
    return errors.select("horizon_step", r6("mse").alias("mse"))


def _vectors(*names):
    return {f"{n}{i}": F.col(n)[i] for n in names for i in range(3)}


@query(
    "hold_last",
    f"""WITH {WIN}, l AS (SELECT stem, anchor_index, x0 AS y0, x1 AS y1, x2 AS y2, v0 AS u0, v1 AS u1, v2 AS u2, a0 AS b0, a1 AS b1, a2 AS b2
   FROM wr WHERE k = 9)
SELECT (k - 9)::INT AS horizon_step, {q6("avg((x0-y0)**2 + (x1-y1)**2 + (x2-y2)**2 + (v0-u0)**2 + (v1-u1)**2 + (v2-u2)**2 + (a0-b0)**2 + (a1-b1)**2 + (a2-b2)**2)")} AS mse
FROM wr JOIN l USING (stem, anchor_index) WHERE k >= 10 GROUP BY k""",
)
def hold_last(spark, sf):
    e = forecast.hold_last_error(flat_map(phys_steps(spark, sf)), WindowConfig(), _vectors("p", "v", "a"))
    return e.select("horizon_step", r6("mse").alias("mse"))


@query(
    "horizon_error",
    f"""WITH {WIN}, l AS (SELECT stem, anchor_index, x0 AS y0, x1 AS y1, x2 AS y2 FROM wr WHERE k = 9),
e AS (SELECT split, k - 9 AS h, (x0-y0)**2 + (x1-y1)**2 + (x2-y2)**2 AS sq, (anchor_index + k) % 3 <> 0 AS m
   FROM wr JOIN l USING (stem, anchor_index) WHERE k >= 10)
SELECT split, h::INT AS horizon_step, {q6("coalesce(sum(sq) FILTER (m), 0) / greatest(count(*) FILTER (m), 1)")} AS mse,
  count(*) FILTER (m)::DOUBLE AS weight FROM e GROUP BY split, h""",
)
def horizon_error(spark, sf):
    """Masked position error of holding the last position."""
    e = forecast.hold_last_error(
        flat_map(phys_steps(spark, sf)), WindowConfig(), _vectors("p"), lambda at: (at + 9) % 3 != 0, ["split"]
    )
    return e.select("split", "horizon_step", r6("mse").alias("mse"), "weight")


@query(
    "overall_error",
    f"""WITH {WIN}, l AS (SELECT stem, anchor_index, x0 AS y0, x1 AS y1, x2 AS y2 FROM wr WHERE k = 9)
SELECT split, {q6("avg((x0-y0)**2 + (x1-y1)**2 + (x2-y2)**2)")} AS mse
FROM wr JOIN l USING (stem, anchor_index) WHERE k >= 10 GROUP BY split""",
)
def overall_error(spark, sf):
    e = forecast.hold_last_error(flat_map(phys_steps(spark, sf)), WindowConfig(), _vectors("p"), by=["split"])
    return forecast.overall_error(e, ["split"]).select("split", r6("mse").alias("mse"))


@query(
    "build_windows",
    f"""WITH {WIN} SELECT split, count(*) AS n_windows, count(DISTINCT stem) AS n_files, {q6("sum(anchor_index)")} AS anchors
FROM wv WHERE stem % 7 <> 0 AND stem % 11 <> 0 GROUP BY split""",
)
def build_windows(spark, sf):
    """Windows of a manifest that holds some files out and gives some no split."""
    steps = phys_steps(spark, sf).withColumn("csv_path", F.concat(F.lit("csv/"), F.col("stem").cast("string")))
    split = F.when(F.col("stem") % 7 == 0, F.lit("heldout")).when(F.col("stem") % 11 != 0, F.col("split"))
    manifest = steps.select("csv_path", split.alias("split")).distinct()
    w = dataset.build_windows(steps.drop("split"), manifest)
    return w.groupBy("split").agg(
        F.count("*").alias("n_windows"), F.count_distinct("csv_path").alias("n_files"),
        r6(F.sum("anchor_index").cast("double")).alias("anchors"),
    )
