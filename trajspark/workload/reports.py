"""Run-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.operators import report
from trajspark.operators.windows import WindowConfig, raw_windows
from trajspark.workload.registry import q6, query, r6
from trajspark.workload.views import ARM_NAMES, EPOCHS, EV, RUNS, epoch_log, ev_steps, run_results, table


@query(
    "results_long",
    f"""WITH {RUNS} SELECT lambda_sig, latent_dim::INT AS latent_dim, target, arm, count(*) AS n, {q6("avg(r2)", 5)} AS r2
FROM long GROUP BY ALL""",
)
def results_long(spark, sf):
    long = report.recovery_long(run_results(spark, sf))
    return long.groupBy("lambda_sig", "latent_dim", "target", "arm").agg(
        F.count("*").alias("n"), r6(F.avg("r2"), 5).alias("r2")
    )


@query(
    "seed_spread",
    f"""WITH {RUNS}, m AS (SELECT target, arm, avg(r2) AS mu, stddev_pop(r2) AS sd FROM long
   WHERE lambda_sig = 1 AND latent_dim = 24 GROUP BY target, arm)
SELECT target, {", ".join(f"{q6(f'''max(mu) FILTER (arm = '{a}')''', 5)} AS {a}_r2_mean, {q6(f'''max(sd) FILTER (arm = '{a}')''', 5)} AS {a}_r2_std" for a in ARM_NAMES)},
  {q6("max(mu) FILTER (arm = 'trained') - max(mu) FILTER (arm = 'random_init')", 5)} AS trained_minus_random
FROM m GROUP BY target""",
)
def seed_spread(spark, sf):
    t = report.seed_spread(report.recovery_long(run_results(spark, sf)), 1.0, 24)
    return t.select("target", *[r6(c, 5).alias(c) for c in t.columns if c != "target"])


@query(
    "width_table",
    f"""WITH {RUNS}, t AS (SELECT *, arm = 'trained' AS tr FROM dims WHERE lambda_sig = 1)
SELECT latent_dim::INT AS latent_dim, {q6("avg(participation_ratio) FILTER (tr)", 5)} AS pr_mean,
  {q6("stddev_pop(participation_ratio) FILTER (tr)", 5)} AS pr_std, {q6("avg(effective_rank) FILTER (tr)", 5)} AS er_mean,
  {q6("stddev_pop(effective_rank) FILTER (tr)", 5)} AS er_std, {q6("avg(n_components_90pct) FILTER (tr)", 5)} AS c90_mean,
  {q6("avg(n_components_99pct) FILTER (tr)", 5)} AS c99_mean,
  {q6("avg(participation_ratio) FILTER (arm = 'random_init')", 5)} AS random_pr_mean FROM t GROUP BY latent_dim""",
)
def width_table(spark, sf):
    t = report.width_table(report.dimensionality_long(run_results(spark, sf)), 1.0)
    return t.select("latent_dim", *[r6(c, 5).alias(c) for c in t.columns if c != "latent_dim"])


LAMBDA = (
    RUNS
    + """,
pr AS (SELECT lambda_sig, seed, avg(r2) AS rec FROM long WHERE latent_dim = 24 AND arm = 'trained'
   AND target IN ('cable_dir', 'R_quad_cols', 'p_quad', 'tension_margin') GROUP BY lambda_sig, seed),
lt AS (SELECT lambda_sig, avg(final_val_pred) AS pred_mean, stddev_pop(final_val_pred) AS pred_std,
   avg(participation_ratio) AS pr_mean, stddev_pop(participation_ratio) AS pr_std, avg(rec) AS recovery_mean,
   stddev_pop(rec) AS recovery_std, count(*) FILTER (collapsed) AS n_collapsed, count(*) AS n_runs
   FROM dims JOIN pr USING (lambda_sig, seed) WHERE latent_dim = 24 AND arm = 'trained' GROUP BY lambda_sig)"""
)
_LT = ("pred_mean", "pred_std", "pr_mean", "pr_std", "recovery_mean", "recovery_std")


def _lambda(spark, sf):
    return report.lambda_table(run_results(spark, sf), 24)


@query(
    "lambda_table",
    f"WITH {LAMBDA} SELECT lambda_sig, {', '.join(f'{q6(c, 5)} AS {c}' for c in _LT)}, n_collapsed, n_runs FROM lt",
)
def lambda_table(spark, sf):
    return _lambda(spark, sf).select(
        "lambda_sig", *[r6(c, 5).alias(c) for c in _LT], "n_collapsed", "n_runs"
    )


@query(
    "dissociation",
    f"""WITH {LAMBDA}, b AS (SELECT (SELECT lambda_sig FROM lt ORDER BY pred_mean, lambda_sig LIMIT 1) AS p,
  (SELECT lambda_sig FROM lt ORDER BY recovery_mean DESC, lambda_sig LIMIT 1) AS r)
SELECT p AS best_pred_lambda, r AS best_recovery_lambda, p <> r AS dissociated FROM b""",
)
def dissociation(spark, sf):
    return report.dissociation(_lambda(spark, sf))


@query(
    "scaling_table",
    f"""SELECT (1 + o_orderkey % 4) / 4e0 AS fraction, {q6("avg(o_totalprice / 1e6)", 5)} AS val_pred,
  {q6("avg((o_totalprice % 1e3) / 1e3)", 5)} AS trained_r2, {q6("avg((o_totalprice % 1e3) / 1e3 - (o_totalprice % 1e2) / 1e2)", 5)} AS delta,
  count(*) AS n_runs FROM orders GROUP BY 1""",
)
def scaling_table(spark, sf):
    price = F.col("o_totalprice")
    rows = table(spark, sf, "orders").select(
        ((1 + F.col("o_orderkey") % 4) / 4.0).alias("fraction"),
        (price / 1e6).alias("val_pred"),
        (price % 1000.0 / 1000.0).alias("trained_r2"),
        (price % 1000.0 / 1000.0 - price % 100.0 / 100.0).alias("delta"),
    )
    t = report.scaling_table(rows)
    return t.select(
        "fraction", *[r6(c, 5).alias(c) for c in ("val_pred", "trained_r2", "delta")], "n_runs"
    )


@query(
    "run_summary",
    f"""WITH {EPOCHS} SELECT run, arg_max(loss, epoch) FILTER (stage = 1) AS final_val_loss,
  {q6("arg_max(loss_pred, epoch) FILTER (stage = 1)")} AS final_val_pred, {q6("arg_max(loss_sigreg, epoch) FILTER (stage = 1)")} AS final_sigreg,
  coalesce(arg_max(triggered, epoch) FILTER (stage = 1), false) AS collapsed, count(*) FILTER (stage = 1) AS epochs_ran,
  {q6("arg_max(residual_abs_mean, epoch) FILTER (stage = 2)")} AS prober_residual,
  {q6("arg_max(prober_loss, epoch) FILTER (stage = 2)")} AS prober_loss FROM log GROUP BY run""",
)
def run_summary(spark, sf):
    s = report.run_summary(epoch_log(spark, sf))
    rounded = ("final_val_pred", "final_sigreg", "prober_residual", "prober_loss")
    return s.withColumns({c: r6(c) for c in rounded})


@query(
    "best_epoch",
    f"""WITH {EPOCHS} SELECT DISTINCT ON (run) run, epoch AS best_epoch, loss AS best_val_loss FROM log WHERE stage = 1
ORDER BY run, loss, epoch""",
)
def best_epoch(spark, sf):
    return report.best_epoch(epoch_log(spark, sf))


@query(
    "weighted_metrics",
    f"""WITH {EPOCHS} SELECT run, stage, {q6("sum(loss_pred * batch_size) / sum(batch_size)", 5)} AS loss_pred,
  {q6("sum(prober_loss * batch_size) / sum(batch_size)", 5)} AS prober_loss FROM log GROUP BY run, stage""",
)
def weighted_metrics(spark, sf):
    log = epoch_log(spark, sf).withColumn("loss_pred", F.col("val.loss_pred"))
    m = report.weighted_metrics(log, ["loss_pred", "prober_loss"], "batch_size", ["run", "stage"])
    return m.select("run", "stage", r6("loss_pred", 5).alias("loss_pred"), r6("prober_loss", 5).alias("prober_loss"))


@query(
    "block_subsample",
    f"""WITH {EV}, w AS (SELECT stem, step + 9 AS anchor_index FROM ev
   QUALIFY count(*) OVER (PARTITION BY stem ORDER BY step ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) = 30),
r AS (SELECT *, row_number() OVER (ORDER BY stem, anchor_index) AS k, count(*) OVER () AS n FROM w)
SELECT stem, anchor_index FROM r WHERE k <= greatest(64, floor(n * 25e-2)::BIGINT)""",
)
def block_subsample(spark, sf):
    w = raw_windows(ev_steps(spark, sf), ["value"], WindowConfig()).select("stem", "anchor_index")
    return report.block_subsample(w, 0.25, 64)
