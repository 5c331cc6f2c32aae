"""The driver tables seen as trajectories, manifests, features, runs and logs.

Each view exists twice: as a DataFrame and as SQL common table expressions for the comparison run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.functions.hashing import split_of, unit_md5
from trajspark.plans.ordering import dense_step

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def utc_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of a timestamp column; zone-less values count as UTC."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(name))
        return F.unix_micros(local.cast("timestamp"))
    return F.unix_micros(name)


# -- events as trajectories: one per user, rows in time order ------------------------------------

EV = """ev AS (
  SELECT user_id AS stem, event_id, ts, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step
  FROM events)"""


def ev_steps(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    cols = ["event_id", "ts", "value", *extra]
    ev = table(spark, sf, "events").select(F.col("user_id").alias("stem"), *dict.fromkeys(cols))
    return dense_step(ev, "stem", ["ts", "event_id"])


# -- closed-form motion per event row, with faults where the measured value is extreme ------------

SPLIT_SQL = """CASE WHEN {u} < 0.8 THEN 'train' WHEN {u} < 0.9 THEN 'val' ELSE 'test' END"""


def unit_sql(key: str, seed: int = 0) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT / 4294967296e0)"


PHYS = (
    EV
    + f""",
ph0 AS (
  SELECT stem, step, value, 1e-1 * step AS t, (stem % 100)::DOUBLE AS f, (1 + stem % 5)::DOUBLE AS amp,
         1e0 + 25e-2 * (stem % 4) AS w
  FROM ev),
ph AS (
  SELECT stem, step, t AS time, 'g' || (stem % 7) AS grp,
         {SPLIT_SQL.format(u=unit_sql("stem"))} AS split,
         sin(t + f) AS p0, cos(7e-1 * t) AS p1, 2 + amp * sin(w * t) AS p2,
         cos(t + f) AS v0, -7e-1 * sin(7e-1 * t) AS v1, amp * w * cos(w * t) AS v2,
         CASE WHEN value > 260 AND value <= 300 THEN 0e0 ELSE -sin(t + f) END AS a0,
         CASE WHEN value > 280 AND value <= 300 THEN 0e0 WHEN value > 260 AND value <= 280 THEN 5e0
              ELSE -49e-2 * cos(7e-1 * t) END AS a1,
         CASE WHEN value > 260 AND value <= 300 THEN -981e-2 ELSE -amp * w * w * sin(w * t) END AS a2,
         CASE WHEN value > 300 THEN 'NaN'::DOUBLE WHEN value > 260 AND value <= 280 THEN 0e0
              ELSE -cos(t + f) END AS j0,
         CASE WHEN value > 260 AND value <= 280 THEN 0e0 ELSE 343e-3 * sin(7e-1 * t) END AS j1,
         CASE WHEN value > 260 AND value <= 280 THEN 0e0 ELSE -amp * w * w * w * cos(w * t) END AS j2
  FROM ph0)"""
)


def phys_steps(spark: SparkSession, sf: str) -> DataFrame:
    ev = ev_steps(spark, sf).selectExpr(
        "stem",
        "step",
        "step * 0.1D AS t",
        "CAST(stem % 100 AS double) AS f",
        "CAST(1 + stem % 5 AS double) AS amp",
        "1D + 0.25D * (stem % 4) AS w",
        "value > 300 AS nonfinite",
        "value > 280 AND value <= 300 AS fall",
        "value > 260 AND value <= 280 AS cross_",
    )
    waves = ev.selectExpr(
        "*",
        "sin(t + f) AS s0", "cos(t + f) AS c0", "sin(0.7D * t) AS s1", "cos(0.7D * t) AS c1",
        "amp * sin(w * t) AS s2", "amp * cos(w * t) AS c2",
    )
    return waves.select(
        "stem",
        "step",
        F.col("t").alias("time"),
        F.expr("concat('g', CAST(stem % 7 AS string)) AS grp"),
        split_of(unit_md5(F.col("stem"), 0)).alias("split"),
        F.expr("array(s0, c1, 2D + s2) AS p"),
        F.expr("array(c0, -0.7D * s1, w * c2) AS v"),
        F.expr(
            "array(IF(fall OR cross_, 0D, -s0), CASE WHEN fall THEN 0D WHEN cross_ THEN 5D "
            "ELSE -0.49D * c1 END, IF(fall OR cross_, -9.81D, -w * w * s2)) AS a"
        ),
        F.expr(
            "array(CASE WHEN nonfinite THEN double('NaN') WHEN cross_ THEN 0D ELSE -c0 END, "
            "IF(cross_, 0D, 0.343D * s1), IF(cross_, 0D, -w * w * w * c2)) AS j"
        ),
    )


# The flat map over the same rows, in the same evaluation order.
FLAT = (
    PHYS
    + """,
f1 AS (
  SELECT *, NOT (isfinite(p0) AND isfinite(p1) AND isfinite(p2) AND isfinite(v0) AND isfinite(v1)
     AND isfinite(v2) AND isfinite(a0) AND isfinite(a1) AND isfinite(a2) AND isfinite(j0)
     AND isfinite(j1) AND isfinite(j2)) AS bad FROM ph),
f2 AS (
  SELECT *, CASE WHEN bad THEN 0e0 ELSE a0 END AS c0, CASE WHEN bad THEN 0e0 ELSE a1 END AS c1,
     CASE WHEN bad THEN 981e-2 ELSE a2 + 981e-2 END AS c2, CASE WHEN bad THEN 0e0 ELSE j0 END AS k0,
     CASE WHEN bad THEN 0e0 ELSE j1 END AS k1, CASE WHEN bad THEN 0e0 ELSE j2 END AS k2 FROM f1),
f3 AS (
  SELECT *, sqrt(c0*c0 + c1*c1 + c2*c2) AS n, c0*k0 + c1*k1 + c2*k2 AS s, k0*k0 + k1*k1 + k2*k2 AS q FROM f2),
f4 AS (SELECT *, n < 1e-3 AS ff, 1e0 / CASE WHEN n < 1e-3 THEN 1e0 ELSE n END AS i FROM f3),
f5 AS (SELECT *, s*i AS nd, q*i - s*s*(i*i*i) AS ndd FROM f4),
f6 AS (SELECT *, nd*i*i AS w1, ndd*i*i AS w2, nd*nd*i*i*i AS w3 FROM f5),
f7 AS (
  SELECT *, -c0*i AS h0, -c1*i AS h1, -c2*i AS h2,
     w1*c0 - k0*i AS hd0, w1*c1 - k1*i AS hd1, w1*c2 - k2*i AS hd2,
     2e0*w1*k0 + w2*c0 - 2e0*w3*c0 AS hdd0, 2e0*w1*k1 + w2*c1 - 2e0*w3*c1 AS hdd1,
     2e0*w1*k2 + w2*c2 - 2e0*w3*c2 AS hdd2 FROM f6),
f8 AS (
  SELECT *, 878e-3*c0 - 405405e-6*hdd0 AS g0, 878e-3*c1 - 405405e-6*hdd1 AS g1,
     878e-3*c2 - 405405e-6*hdd2 AS g2 FROM f7),
f9 AS (SELECT *, sqrt(g0*g0 + g1*g1 + g2*g2) AS gn FROM f8),
f10 AS (
  SELECT *, gn < 1e-9 AS fbad, g0 / CASE WHEN gn < 1e-9 THEN 1e0 ELSE gn END AS z0,
     g1 / CASE WHEN gn < 1e-9 THEN 1e0 ELSE gn END AS z1,
     g2 / CASE WHEN gn < 1e-9 THEN 1e0 ELSE gn END AS z2 FROM f9),
f11 AS (SELECT *, z2 AS x0, 0e0 AS x1, -z0 AS x2, sqrt(z2*z2 + z0*z0) AS xn FROM f10),
f12 AS (
  SELECT *, xn < 1e-9 AS xbad, x0 / CASE WHEN xn < 1e-9 THEN 1e0 ELSE xn END AS b10,
     0e0 AS b11, x2 / CASE WHEN xn < 1e-9 THEN 1e0 ELSE xn END AS b12 FROM f11),
f13 AS (
  SELECT *, z1*b12 - z2*b11 AS b20, z2*b10 - z0*b12 AS b21, z0*b11 - z1*b10 AS b22,
     NOT (bad OR ff OR fbad OR xbad) AS valid, ff AND NOT bad AS g_ff,
     fbad AND NOT bad AND NOT ff AS g_force, xbad AND NOT bad AND NOT ff AND NOT fbad AS g_cross,
     sqrt(a0*a0 + a1*a1 + (a2 + 981e-2)*(a2 + 981e-2)) / 981e-2 AS margin FROM f12),
flat AS (
  SELECT stem, step, time, grp, split, p0, p1, p2, v0, v1, v2, a0, a1, a2, j0, j1, j2,
     valid, bad, g_ff, g_force, g_cross, margin,
     CASE WHEN valid THEN z0 END AS z0, CASE WHEN valid THEN z1 END AS z1, CASE WHEN valid THEN z2 END AS z2,
     CASE WHEN valid THEN b10 END AS b10, CASE WHEN valid THEN b11 END AS b11, CASE WHEN valid THEN b12 END AS b12,
     CASE WHEN valid THEN b20 END AS b20, CASE WHEN valid THEN b21 END AS b21, CASE WHEN valid THEN b22 END AS b22,
     CASE WHEN valid THEN p0 + 567e-3*z0 END AS pq0, CASE WHEN valid THEN p1 + 567e-3*z1 END AS pq1,
     CASE WHEN valid THEN p2 + 567e-3*z2 END AS pq2,
     CASE WHEN valid THEN v0 - 567e-3*hd0 END AS vq0, CASE WHEN valid THEN v1 - 567e-3*hd1 END AS vq1,
     CASE WHEN valid THEN v2 - 567e-3*hd2 END AS vq2,
     CASE WHEN valid THEN a0 - 567e-3*hdd0 END AS aq0, CASE WHEN valid THEN a1 - 567e-3*hdd1 END AS aq1,
     CASE WHEN valid THEN a2 - 567e-3*hdd2 END AS aq2
  FROM f13)"""
)


# -- manifest rows aggregated from the same trajectories ------------------------------------------

MANIFEST_SQL = (
    EV
    + """,
mv AS (SELECT *, value - lag(value) OVER (PARTITION BY stem ORDER BY step) AS dv FROM ev),
mg AS (
  SELECT stem AS uid, count(*) AS n_timesteps, sum(abs(dv)) AS hop, max(value) AS top,
     (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 3600 * 14e-1 AS hours,
     arg_max(event_type, step) AS last_type, arg_max(value, step) AS last_value
  FROM mv GROUP BY stem),
ms AS (
  SELECT *, CASE WHEN uid % 17 = 0 THEN 'maze_' || uid WHEN uid % 19 = 0 THEN 'other_' || uid
     ELSE 'forest_' || lpad(uid::VARCHAR, 3, '0') || '_f' || (uid % 3) || '_g15_0_0_m0p5_v0_0_0_s' || (uid // 4)
     END AS stem FROM mg),
man AS (
  SELECT uid, stem, CASE WHEN top > 330 THEN NULL ELSE 'csv/' || uid END AS csv_path,
     CASE WHEN uid % 17 = 0 THEN 'maze' WHEN uid % 19 = 0 THEN 'other' ELSE 'forest' END AS source,
     CASE WHEN uid % 17 = 0 OR uid % 19 = 0 THEN stem
          ELSE 'forest_f' || (uid % 3) || '_s' || (uid // 4) END AS env_id,
     CASE WHEN uid % 17 <> 0 AND uid % 19 <> 0 THEN uid % 3 END AS forest_type,
     CASE WHEN uid % 17 <> 0 AND uid % 19 <> 0 THEN uid // 4 END AS env_seed,
     CASE last_type WHEN 'purchase' THEN 'Solve_Succeeded' WHEN 'view' THEN 'Solved_To_Acceptable_Level'
          WHEN 'error' THEN 'Maximum_Iterations_Exceeded' WHEN 'signup' THEN 'Solver_Failed' END AS solver_status,
     CASE WHEN last_type = 'click' THEN 'unknown' ELSE 'solver_log' END AS status_source,
     CASE WHEN last_value > 150 THEN 99999 ELSE floor(last_value)::BIGINT END AS iterations,
     CASE WHEN last_type = 'signup' THEN 999e0 WHEN last_value < 1 THEN 0e0 ELSE hop END AS path_length_m,
     hours AS total_time_s, n_timesteps, hours / (n_timesteps - 1) AS dt_s,
     (n_timesteps - 1) / hours AS sample_rate_hz
  FROM ms)"""
)


def manifest_view(spark: SparkSession, sf: str) -> DataFrame:
    from trajspark.operators.kinematics import row_delta
    from trajspark.operators.manifest import with_identity

    ev = row_delta(ev_steps(spark, sf, "event_type"), "value", "dv")
    ev = ev.withColumn("us", utc_micros(ev, "ts"))
    per = ev.groupBy(F.col("stem").alias("uid")).agg(
        F.count("*").alias("n_timesteps"),
        F.sum(F.abs("dv")).alias("hop"),
        F.max("value").alias("top"),
        ((F.max("us") - F.min("us")) / 1e6 / 3600 * 1.4).alias("hours"),
        F.max_by("event_type", "step").alias("last_type"),
        F.max_by("value", "step").alias("last_value"),
    )
    uid, kind = F.col("uid"), F.col("last_type")
    text = uid.cast("string")
    per = per.withColumn(
        "stem",
        F.when(uid % 17 == 0, F.concat(F.lit("maze_"), text))
        .when(uid % 19 == 0, F.concat(F.lit("other_"), text))
        .otherwise(
            F.concat(
                F.lit("forest_"), F.lpad(text, 3, "0"), F.lit("_f"), (uid % 3).cast("string"),
                F.lit("_g15_0_0_m0p5_v0_0_0_s"), F.floor(uid / 4).cast("string"),
            )
        ),
    )
    return with_identity(per).select(
        "uid",
        "stem",
        F.when(F.col("top") <= 330, F.concat(F.lit("csv/"), text)).alias("csv_path"),
        "source",
        "env_id",
        "forest_type",
        "env_seed",
        F.when(kind == "purchase", "Solve_Succeeded")
        .when(kind == "view", "Solved_To_Acceptable_Level")
        .when(kind == "error", "Maximum_Iterations_Exceeded")
        .when(kind == "signup", "Solver_Failed")
        .alias("solver_status"),
        F.when(kind == "click", "unknown").otherwise("solver_log").alias("status_source"),
        F.when(F.col("last_value") > 150, 99999)
        .otherwise(F.floor("last_value"))
        .cast("bigint")
        .alias("iterations"),
        F.when(kind == "signup", 999.0)
        .when(F.col("last_value") < 1, 0.0)
        .otherwise(F.col("hop"))
        .alias("path_length_m"),
        F.col("hours").alias("total_time_s"),
        "n_timesteps",
        (F.col("hours") / (F.col("n_timesteps") - 1)).alias("dt_s"),
        ((F.col("n_timesteps") - 1) / F.col("hours")).alias("sample_rate_hz"),
    )


# -- embeddings as a feature table ----------------------------------------------------------------


def latents(spark: SparkSession, sf: str) -> DataFrame:
    vec = F.col("embedding")
    half = lambda lo: F.sqrt(
        F.aggregate(F.slice(vec, lo, 32), F.lit(0.0), lambda acc, v: acc + v * v)
    )
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("window_id"),
        "label",
        split_of(unit_md5(F.col("vec_id"), 3), [0.6, 0.2, 0.2]).alias("split"),
        vec.cast("array<double>").alias("x"),
        F.array(
            vec[0].cast("double"), vec[1].cast("double"), vec[2].cast("double"),
            vec[0].cast("double") * vec[1], half(1), F.lit(1.0),
        ).alias("y"),
    )


LATENTS = f"""lat AS (
  SELECT vec_id AS window_id, label,
     CASE WHEN {unit_sql("vec_id", 3)} < 0.6 THEN 'train' WHEN {unit_sql("vec_id", 3)} < 0.8 THEN 'val'
          ELSE 'test' END AS split,
     embedding::DOUBLE[] AS x
  FROM embeddings),
cells AS (SELECT window_id, label, split, unnest(range(1, len(x) + 1)) AS d, unnest(x) AS v FROM lat)"""


# -- orders as finished runs ----------------------------------------------------------------------

TARGET_NAMES = ["v", "a", "j", "cable_dir", "R_quad_cols", "p_quad", "tension_margin"]
ARM_NAMES = ["trained", "random_init", "raw_window", "shuffled_labels"]


def run_results(spark: SparkSession, sf: str) -> DataFrame:
    """Nested result rows (maps of maps), one run per order."""
    price = F.col("o_totalprice")
    base = F.pmod(price, F.lit(1000.0)) / 1000.0
    r2 = lambda i, k: base * (1.0 - 0.05 * i) - 0.1 * k
    recovery = F.create_map(
        *[
            x
            for i, t in enumerate(TARGET_NAMES)
            for x in (
                F.lit(t),
                F.create_map(
                    *[
                        y
                        for k, arm in enumerate(ARM_NAMES)
                        for y in (F.lit(arm), F.struct(r2(i, k).alias("r2")))
                    ]
                ),
            )
        ]
    )
    dims = F.create_map(
        *[
            x
            for k, arm in enumerate(ARM_NAMES[:2])
            for x in (
                F.lit(arm),
                F.struct(
                    (1.0 + base * 4 + k).alias("participation_ratio"),
                    (1.5 + base * 5 + k).alias("effective_rank"),
                    (2 + F.col("o_custkey") % 5).cast("int").alias("n_components_90pct"),
                    (4 + F.col("o_custkey") % 7).cast("int").alias("n_components_99pct"),
                ),
            )
        ]
    )
    pick = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf, "orders").select(
        F.when(pick == 1, 0.0).when(pick == 2, 0.01).when(pick == 3, 0.1).when(pick == 4, 1.0)
        .otherwise(10.0).alias("lambda_sig"),
        F.when(F.col("o_orderkey") % 3 == 0, 8).when(F.col("o_orderkey") % 3 == 1, 24).otherwise(96)
        .alias("latent_dim"),
        F.col("o_orderkey").alias("seed"),
        recovery.alias("recovery"),
        dims.alias("dimensionality"),
        (price / 1e6).alias("final_val_pred"),
        (F.col("o_orderstatus") == "F").alias("collapsed"),
    )


RUNS = """runs AS (
  SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0e0 WHEN '2' THEN 1e-2 WHEN '3' THEN 1e-1
              WHEN '4' THEN 1e0 ELSE 1e1 END AS lambda_sig,
     CASE o_orderkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 24 ELSE 96 END AS latent_dim, o_orderkey AS seed,
     (o_totalprice % 1e3) / 1e3 AS base, o_custkey, o_totalprice / 1e6 AS final_val_pred,
     o_orderstatus = 'F' AS collapsed
  FROM orders),
targets(i, target) AS (VALUES (0,'v'),(1,'a'),(2,'j'),(3,'cable_dir'),(4,'R_quad_cols'),(5,'p_quad'),(6,'tension_margin')),
arms(k, arm) AS (VALUES (0,'trained'),(1,'random_init'),(2,'raw_window'),(3,'shuffled_labels')),
long AS (
  SELECT lambda_sig, latent_dim, seed, target, arm, base * (1e0 - 5e-2 * i) - 1e-1 * k AS r2
  FROM runs, targets, arms),
dims AS (
  SELECT lambda_sig, latent_dim, seed, final_val_pred, collapsed, arm, 1e0 + base * 4 + k AS participation_ratio,
     15e-1 + base * 5 + k AS effective_rank, 2 + o_custkey % 5 AS n_components_90pct,
     4 + o_custkey % 7 AS n_components_99pct
  FROM runs, arms WHERE k < 2)"""


# -- events as epoch logs -------------------------------------------------------------------------


def epoch_log(spark: SparkSession, sf: str) -> DataFrame:
    ev = ev_steps(spark, sf, "event_type")
    value = F.col("value")
    return ev.select(
        F.col("stem").alias("run"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), 1).otherwise(2).alias("stage"),
        F.col("step").alias("epoch"),
        F.struct(
            value.alias("loss"), (value * 0.75).alias("loss_pred"), (value * 0.25).alias("loss_sigreg")
        ).alias("val"),
        F.struct((value < 2.0).alias("triggered")).alias("collapse_alarm"),
        (value / 10).alias("prober_loss"),
        (value / 100).alias("residual_abs_mean"),
        F.col("event_id").alias("batch_size"),
    )


EPOCHS = (
    EV
    + """,
log AS (
  SELECT stem AS run, CASE WHEN event_type IN ('view','click','purchase') THEN 1 ELSE 2 END AS stage,
     step AS epoch, value AS loss, value * 75e-2 AS loss_pred, value * 25e-2 AS loss_sigreg,
     value < 2 AS triggered, value / 10 AS prober_loss, value / 100 AS residual_abs_mean, event_id AS batch_size
  FROM ev)"""
)
