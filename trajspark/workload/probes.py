"""Feature-table queries: moments, probes, geometry, normality and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trajspark.functions.flatmap import flat_map
from trajspark.operators import diagnostics, encode, linalg, probes
from trajspark.operators.windows import WindowConfig, extract_windows
from trajspark.workload.registry import q6, query, r6
from trajspark.workload.views import LATENTS, latents, phys_steps

SLICES = {"linear": (0, 3), "product": (3, 1), "half_norm": (4, 1), "constant": (5, 1)}


@query(
    "gram_matrix",
    f"""WITH {LATENTS} SELECT (a.d - 1)::INT AS i, (b.d - 1)::INT AS j, {q6("sum(a.v * b.v)", 5)} AS v
FROM cells a JOIN cells b ON a.window_id = b.window_id AND a.d <= b.d GROUP BY a.d, b.d""",
)
def gram_matrix(spark, sf):
    return linalg.gram(latents(spark, sf), "x").withColumn("v", r6("v", 5))


@query(
    "covariance_long",
    f"""WITH {LATENTS}, m AS (SELECT d, avg(v) AS mu FROM cells GROUP BY d),
c AS (SELECT window_id, d, v - mu AS v FROM cells JOIN m USING (d))
SELECT (a.d - 1)::INT AS i, (b.d - 1)::INT AS j, {q6("sum(a.v * b.v) / (count(*) - 1)", 7)} AS v
FROM c a JOIN c b ON a.window_id = b.window_id AND a.d <= b.d GROUP BY a.d, b.d""",
)
def covariance_long(spark, sf):
    cells, _ = linalg.covariance(latents(spark, sf), "x")
    return cells.withColumn("v", r6("v", 7))


@query(
    "r2_given_weights",
    f"""WITH {LATENTS},
g AS (SELECT window_id, split, sum(v * cos(d)) AS p0, sum(v / (d + 1)) + 1e-2 AS p1 FROM cells GROUP BY window_id, split),
f AS (SELECT g.split, unnest([0, 1, 2]) AS channel, unnest([x[1], x[2], 1e0]) AS y, unnest([p0, p1, 1e0]) AS p
   FROM g JOIN lat USING (window_id)),
s AS (SELECT split, channel, sum((y - p)**2) AS res, var_pop(y) * count(*) AS tot FROM f GROUP BY split, channel)
SELECT split, channel::INT AS channel, CASE WHEN tot > 1e-12 THEN round(1 - res / tot, 6) + 0.0 END AS r2 FROM s""",
)
def r2_given_weights(spark, sf):
    d = np.arange(1, 65)
    w = np.column_stack([np.cos(d), 1 / (d + 1), np.zeros(64)])
    rows = latents(spark, sf).withColumns(
        {
            "truth": F.array(F.col("x")[0], F.col("x")[1], F.lit(1.0)),
            "guess": linalg.apply_linear("x", w, np.array([0.0, 0.01, 1.0])),
        }
    )
    return linalg.r2_per_channel(rows, "truth", "guess", ["split"]).withColumn("r2", r6("r2"))


# Ridge on all coordinates: centred moments, then one elimination step per coordinate for every alpha.
RIDGE = (
    LATENTS
    + """,
tv AS (SELECT window_id, split, d, v FROM cells UNION ALL
  SELECT window_id, split, 65, x[4] + x[1] * x[2] FROM lat),
mu AS (SELECT d, avg(v) AS m FROM tv WHERE split = 'train' GROUP BY d),
c AS (SELECT window_id, split, d, v - m AS v FROM tv JOIN mu USING (d)),
gr AS (SELECT a.d AS i, b.d AS j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.window_id = b.window_id
   WHERE a.split = 'train' AND a.d <= 64 GROUP BY a.d, b.d),
al(alpha) AS (VALUES (1e-4), (1e-3), (1e-2), (1e-1), (1e0), (1e1), (1e2)),
st AS (SELECT alpha, i, list(v + CASE WHEN i = j THEN alpha ELSE 0 END ORDER BY j) AS r FROM gr, al GROUP BY alpha, i),
el AS (SELECT 0 AS k, alpha, i, r FROM st
  UNION ALL
  SELECT k + 1, alpha, i, CASE WHEN i = k + 1 THEN list_transform(r, lambda e: e / p[k + 1])
     ELSE list_transform(r, lambda e, q: e - r[k + 1] / p[k + 1] * p[q]) END
  FROM (SELECT *, max(CASE WHEN i = k + 1 THEN r END) OVER (PARTITION BY alpha) AS p FROM el WHERE k < 64)),
w AS (SELECT alpha, i AS d, r[65] AS w FROM el WHERE k = 64),
pr AS (SELECT window_id, alpha, sum(v * w) AS p FROM c JOIN w USING (d) WHERE split IN ('val', 'test') GROUP BY 1, 2),
sc AS (SELECT split, alpha, sum((v - p)**2) AS res, var_pop(v) * count(*) AS tot
   FROM pr JOIN c USING (window_id) WHERE d = 65 GROUP BY split, alpha),
r AS (SELECT split, alpha, 1 - res / tot AS r2 FROM sc),
best AS (SELECT alpha, r2 FROM r WHERE split = 'val' ORDER BY r2 DESC, alpha LIMIT 1)"""
)


@query(
    "ridge_probe",
    f"""WITH RECURSIVE {RIDGE} SELECT round(t.r2, 6) + 0.0 AS r2, best.alpha, round(best.r2, 6) + 0.0 AS val_r2
FROM best JOIN r t ON t.split = 'test' AND t.alpha = best.alpha""",
)
def ridge_probe(spark, sf):
    rows = latents(spark, sf).select(
        "window_id", "split", F.col("x").alias("f"),
        F.array(F.col("x")[3] + F.col("x")[0] * F.col("x")[1]).alias("t"),
    )
    out = probes.ridge_probe(rows, "f", "t", 1, F.col("window_id"))
    return out.select(r6("r2").alias("r2"), "alpha", r6("val_r2").alias("val_r2"))


def _probe_rows(spark, sf):
    return latents(spark, sf).withColumn("half", F.slice("x", 1, 32))


@query("recovery_controls")
def recovery_controls(spark, sf):
    """Every target from the full and half feature arms, with the shuffled-label floor."""
    out = probes.recovery(
        _probe_rows(spark, sf), {"trained": "x", "half": "half"}, "y", SLICES, F.col("window_id")
    )
    return out.select("target", "arm", "r2", "alpha", "val_r2", "n_constant_channels")


@query(
    "label_permutation",
    f"""WITH {LATENTS}, t AS (SELECT window_id, label FROM lat WHERE split = 'train'),
a AS (SELECT window_id, row_number() OVER (ORDER BY md5('11|to|' || window_id)) AS k FROM t),
b AS (SELECT label, row_number() OVER (ORDER BY md5('11|from|' || window_id)) AS k FROM t)
SELECT window_id, label AS shuffled FROM a JOIN b USING (k)
UNION ALL SELECT window_id, label FROM lat WHERE split <> 'train'""",
)
def label_permutation(spark, sf):
    rows = latents(spark, sf).select("window_id", "split", "label")
    out = probes.permute_labels(rows, F.col("window_id"), "label", 11, "shuffled")
    return out.select("window_id", "shuffled")


@query("linear_audit")
def linear_audit(spark, sf):
    w = extract_windows(
        flat_map(phys_steps(spark, sf)), WindowConfig(), targets=True, carry=["split"]
    )
    return probes.linear_audit(w)


@query("effective_dim")
def effective_dim(spark, sf):
    return diagnostics.effective_dimensionality(latents(spark, sf)).drop("eigenvalues")


COV = (
    LATENTS
    + """,
mu AS (SELECT d, avg(v) AS m FROM cells GROUP BY d),
cc AS (SELECT window_id, d, v - m AS v FROM cells JOIN mu USING (d)),
cv AS (SELECT a.d AS i, b.d AS j, sum(a.v * b.v) / (count(*) - 1) AS v FROM cc a JOIN cc b ON a.window_id = b.window_id GROUP BY a.d, b.d),
pv AS (SELECT var_samp(v) AS s FROM cells GROUP BY d),
nm AS (SELECT count(*) AS n, avg(sqrt(list_sum(list_transform(x, lambda e: e * e)))) AS norm FROM lat)"""
)


@query(
    "participation_ratio",
    f"""WITH {COV} SELECT {q6("sum(v) FILTER (i = j) ** 2 / sum(v * v)", 4)} AS participation_ratio, 64 AS allocated_dim FROM cv""",
)
def participation_ratio(spark, sf):
    d = diagnostics.effective_dimensionality(latents(spark, sf))
    return d.select(r6("participation_ratio", 4).alias("participation_ratio"), "allocated_dim")


@query("latent_diagnostics")
def latent_diagnostics(spark, sf):
    d = diagnostics.latent_diagnostics(latents(spark, sf))
    return d.drop("per_dim_variance", "eigenvalues", "explained_variance_ratio")


@query(
    "latent_spread",
    f"""WITH {COV},
sq AS (SELECT 2 * (count(*) * sum(v * v) - sum(v) ** 2) / (count(*) * (count(*) - 1.0)) AS r FROM cells GROUP BY d)
SELECT (SELECT n FROM nm) AS num_samples, (SELECT {q6("avg(s)")} FROM pv) AS variance_mean, (SELECT {q6("min(s)")} FROM pv) AS variance_min,
  (SELECT {q6("max(s)")} FROM pv) AS variance_max, (SELECT {q6("sum(s)", 5)} FROM pv) AS total_variance,
  (SELECT {q6("sum(v) FILTER (i = j) ** 2 / sum(v * v)", 4)} FROM cv) AS participation_ratio,
  (SELECT {q6("sqrt(sum(r))", 5)} FROM sq) AS pairwise_rms,
  (SELECT {q6("norm", 5)} FROM nm) AS norm_mean""",
)
def latent_spread(spark, sf):
    d = diagnostics.latent_diagnostics(latents(spark, sf))
    return d.select(
        "num_samples",
        *[r6(c).alias(c) for c in ("variance_mean", "variance_min", "variance_max")],
        r6("total_variance", 5).alias("total_variance"),
        r6("participation_ratio", 4).alias("participation_ratio"),
        r6("pairwise_rms", 5).alias("pairwise_rms"),
        r6("latent_norm_mean", 5).alias("norm_mean"),
    )


@query("collapse_alarm")
def collapse_alarm(spark, sf):
    """Alarm on the features as they are and on copies squeezed towards a point."""
    base, out = latents(spark, sf), None
    for name, scale in (("as_is", 1.0), ("squeezed", 1e-4), ("collapsed", 0.0)):
        factor = F.lit(scale)
        x = F.transform("x", lambda v: v * factor)  # noqa: B023 - built at once
        d = diagnostics.latent_diagnostics(base.select(x.alias("x")))
        row = diagnostics.collapse_alarm(d, min_rank_fraction=0.1).select(
            F.lit(name).alias("case"), "triggered", F.array_join("reasons", ",").alias("reasons")
        )
        out = row if out is None else out.unionByName(row)
    return out


EP = """ kn AS (SELECT unnest(range(17)) AS k),
kt AS (SELECT k, -5 + k * 625e-3 AS t FROM kn),
ec AS (SELECT dir, t, avg(cos(t * v)) AS re, avg(sin(t * v)) AS im FROM pr, kt GROUP BY dir, t),
ig AS (SELECT dir, t, ((re - exp(-t*t/2))**2 + im*im) * exp(-t*t/2) AS y FROM ec),
ep AS (SELECT dir, sum(y * CASE WHEN abs(t) > 499e-2 THEN 5e-1 ELSE 1e0 END) * 625e-3 AS stat FROM ig GROUP BY dir)"""


@query(
    "epps_pulley_axes",
    f"""WITH {LATENTS}, pr AS (SELECT d - 1 AS dir, v FROM cells),{EP}
SELECT dir::INT AS direction, {q6("stat")} AS statistic FROM ep""",
)
def epps_pulley_axes(spark, sf):
    out = diagnostics.epps_pulley(latents(spark, sf), "x", np.eye(64))
    return out.withColumn("statistic", r6("statistic"))


@query(
    "normality_fixed_directions",
    f"""WITH {LATENTS}, dr AS (SELECT m, d, cos(1 + d * (m + 1)) AS c FROM (SELECT unnest(range(24)) AS m), (SELECT unnest(range(1, 65)) AS d)),
dn AS (SELECT m, d, c / sqrt(sum(c*c) OVER (PARTITION BY m)) AS c FROM dr),
pr AS (SELECT m AS dir, window_id, sum(v * 8 * c) AS v FROM cells JOIN dn USING (d) GROUP BY m, window_id),{EP}
SELECT {q6("avg(stat)")} AS score, 24 AS slices FROM ep""",
)
def normality_fixed_directions(spark, sf):
    d, m = np.meshgrid(np.arange(1, 65), np.arange(24), indexing="ij")
    raw = np.cos(1 + d * (m + 1))
    dirs = raw / np.linalg.norm(raw, axis=0, keepdims=True)
    rows = latents(spark, sf).select(F.transform("x", lambda v: v * 8).alias("x"))
    out = diagnostics.sketched_normality(rows, "x", 64, directions=dirs)
    return out.withColumn("score", r6("score"))


@query("sketched_normality")
def sketched_normality(spark, sf):
    return diagnostics.sketched_normality(latents(spark, sf), "x", 64)


@query("rank_sweep")
def rank_sweep(spark, sf):
    """Score and participation ratio of the features cut down to a known rank (x8: near unit variance)."""
    x, dim = F.col("x"), 64
    wave = lambda r, k: float(np.cos(1.0 + (r + 1) * (k + 1)))

    def mixed(rank):
        return F.array(*[sum(x[r] * (8 * wave(r, k)) for r in range(rank)) for k in range(dim)])

    cases = {
        "full": F.transform(x, lambda v: v * 8),
        "constant": F.transform(x, lambda v: v * 0),
        "rank_1": mixed(1),
        "rank_2": mixed(2),
        "rank_9": mixed(9),
    }
    return diagnostics.rank_sweep(latents(spark, sf), cases, dim)


@query(
    "score_windows",
    f"""WITH {LATENTS} SELECT window_id, {q6("sum(v * cos(d))")} AS z0, {q6("sum(v * sin(d))")} AS z1 FROM cells GROUP BY window_id""",
)
def score_windows(spark, sf):
    """A caller's encoder (here a fixed linear map) over the vectors as histories of eight steps."""
    d = np.arange(1, 65)
    w = np.column_stack([np.cos(d), np.sin(d)])
    hist = F.array(*[F.slice("x", 8 * k + 1, 8) for k in range(8)])
    rows = latents(spark, sf).select("window_id", hist.alias("state_hist"))
    z = encode.score_windows(rows, lambda h: h.reshape(len(h), -1) @ w)
    return z.select("window_id", r6(F.col("x")[0]).alias("z0"), r6(F.col("x")[1]).alias("z1"))
