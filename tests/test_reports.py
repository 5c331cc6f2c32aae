import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import forecast, report
from trajspark.sources import manifests


def test_rollouts(spark):
    p, v, a, h = [1.0, 2.0, 3.0], [0.5, -1.0, 0.0], [0.1, 0.2, -0.3], 0.1
    jerk = np.random.default_rng(0).normal(size=(6, 3))
    df = spark.createDataFrame([(p + v + a, jerk.tolist(), [[0.0] * 3] * 6)], "s array<double>, j array<array<double>>, z array<array<double>>")
    r = df.select(
        forecast.constant_jerk_rollout(F.col("s"), F.col("j"), h).alias("exact"),
        forecast.constant_jerk_rollout(F.col("s"), F.col("j"), h, exact=False).alias("euler"),
        forecast.constant_jerk_rollout(F.col("s"), F.col("z"), h).alias("coast"),
    ).first()
    for name, exact in (("exact", True), ("euler", False)):
        s = [np.array(x) for x in (p, v, a)]
        for u, got in zip(jerk, r[name]):
            if exact:
                s = [s[0] + s[1] * h + s[2] * h**2 / 2 + u * h**3 / 6, s[1] + s[2] * h + u * h**2 / 2, s[2] + u * h]
            else:
                s = [s[0] + s[1] * h, s[1] + s[2] * h, s[2] + u * h]
            assert np.allclose(got, np.concatenate(s), atol=1e-12)
    t = 0.6
    assert np.allclose(r["coast"][5][:3], np.array(p) + np.array(v) * t + np.array(a) * t * t / 2)


@pytest.mark.parametrize("exact", [True, False])
def test_rollout_error_equals_the_explicit_rollout(spark, exact):
    rng = np.random.default_rng(1)
    rows = [tuple(rng.normal(size=s).tolist() for s in ((3, 9), (5, 3), (5, 9))) for _ in range(40)]
    kind = "array<array<double>>"
    df = spark.createDataFrame(rows, f"state_hist {kind}, action_future {kind}, state_future {kind}").repartition(3)
    start = forecast.last_state("state_hist")
    pred = df.withColumn("f", forecast.constant_jerk_rollout(start, F.col("action_future"), 0.2, exact))
    want = forecast.horizon_error(pred, "state_future", "f").orderBy("horizon_step").collect()
    got = forecast.rollout_error(df, 0.2, exact=exact).orderBy("horizon_step").collect()
    assert np.allclose([r["mse"] for r in got], [r["mse"] for r in want])
    assert [r["weight"] for r in got] == [40.0] * 5


def test_masked_horizon_error(spark):
    df = spark.createDataFrame(
        [([[1.0, 1.0]] * 3, [[0.0, 0.0]] * 3, [1.0, 1.0, 0.0]), ([[3.0, 0.0]] * 3, [[0.0, 0.0]] * 3, [1.0, 0.0, 0.0])],
        "y array<array<double>>, f array<array<double>>, m array<double>",
    )
    out = forecast.horizon_error(df, "y", "f", "m").orderBy("horizon_step")
    assert [r["mse"] for r in out.collect()] == [5.5, 2.0, 0.0]
    assert forecast.overall_error(out).first()["mse"] == pytest.approx(13 / 3)
    assert [r["mse"] for r in forecast.horizon_error(df, "y", "f").collect()] == [5.5] * 3
    held = df.select(forecast.hold_last("y", 2).alias("h")).first()["h"]
    assert held == [[1.0, 1.0]] * 2


def run(lam, width, seed, r2, pred, collapsed=False):
    arms = {"trained": r2, "random_init": r2 - 0.1, "raw_window": 1.0, "shuffled_labels": None}
    names = ["v", "a", "j", "cable_dir", "R_quad_cols", "p_quad", "tension_margin"]
    dims = {"participation_ratio": r2 * 10, "effective_rank": 3.0, "n_components_90pct": 2, "n_components_99pct": 4}
    return {
        "lambda_sig": lam, "latent_dim": width, "seed": seed, "final_val_pred": pred, "collapsed": collapsed,
        "recovery": {t: {k: {"r2": x} for k, x in arms.items()} for t in names},
        "dimensionality": {"trained": dims, "random_init": dims | {"participation_ratio": 1.0}},
    }


def test_tables_from_result_json(spark, tmp_path):
    runs = [run(1.0, 24, 0, 0.4, 0.2), run(1.0, 24, 1, 0.6, 0.4), run(0.1, 24, 0, 0.3, 0.1, True), run(1.0, 8, 0, 0.2, 0.9)]
    (tmp_path / "results.json").write_text(json.dumps(runs))
    results = manifests.read_results(spark, str(tmp_path / "results.json"))
    long, dims = report.recovery_long(results), report.dimensionality_long(results)
    e1 = {r["target"]: r for r in report.seed_spread(long, 1.0, 24).collect()}
    assert len(e1) == 7 and e1["v"]["trained_r2_mean"] == pytest.approx(0.5)
    assert e1["v"]["trained_r2_std"] == pytest.approx(0.1) and e1["v"]["trained_minus_random"] == pytest.approx(0.1)
    assert e1["v"]["shuffled_labels_r2_mean"] is None
    e2 = {r["latent_dim"]: r for r in report.width_table(dims, 1.0).collect()}
    assert e2[24]["pr_mean"] == pytest.approx(5.0) and e2[8]["random_pr_mean"] == 1.0
    table = report.lambda_table(results, 24)
    e3 = {r["lambda_sig"]: r for r in table.collect()}
    assert e3[1.0]["recovery_mean"] == pytest.approx(0.5) and e3[0.1]["n_collapsed"] == 1 and e3[1.0]["n_runs"] == 2
    d = report.dissociation(table).first()
    assert (d["best_pred_lambda"], d["best_recovery_lambda"], d["dissociated"]) == (0.1, 1.0, True)
    text = report.markdown(report.width_table(dims, 1.0).orderBy("latent_dim"))
    assert text.splitlines()[2].startswith("| 8 | 2.000 |")


def test_epoch_logs(spark, tmp_path):
    rows = [
        {"run": "a", "stage": 1, "epoch": 0, "val": {"loss": 3.0, "loss_pred": 2.0, "loss_sigreg": 1.0}},
        {"run": "a", "stage": 1, "epoch": 1, "val": {"loss": 1.0, "loss_pred": 0.5, "loss_sigreg": 0.5}},
        {"run": "a", "stage": 1, "epoch": 2, "val": {"loss": 1.0, "loss_pred": 0.6, "loss_sigreg": 0.4}, "collapse_alarm": {"triggered": True, "reasons": ["x"]}},
        {"run": "a", "stage": 2, "epoch": 0, "prober_loss": 0.3, "residual_abs_mean": 0.02},
        {"run": "b", "stage": 2, "epoch": 0, "prober_loss": 0.1, "residual_abs_mean": 0.01},
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(["", *map(json.dumps, rows), ""]))
    log = manifests.read_epoch_log(spark, str(tmp_path / "log.jsonl")).where("stage is not null")
    s = {r["run"]: r for r in report.run_summary(log).collect()}
    assert (s["a"]["final_val_pred"], s["a"]["collapsed"], s["a"]["epochs_ran"], s["a"]["prober_loss"]) == (0.6, True, 3, 0.3)
    assert (s["b"]["final_val_loss"], s["b"]["collapsed"], s["b"]["epochs_ran"]) == (None, False, 0)
    assert report.best_epoch(log).first()["best_epoch"] == 1
    m = report.weighted_metrics(spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1)], "run string, x double, n int"), ["x"], "n", ["run"])
    assert m.first()["x"] == 2.0


@pytest.mark.parametrize("fraction,at_least", [(0.25, 1), (0.001, 64), (1.0, 1), (0.5, 1)])
def test_block_subsample(tiny, fraction, at_least):
    rows = [(f"s{k:02d}", i) for k, n in enumerate([30, 100, 7, 63]) for i in range(n)]
    df = tiny.createDataFrame(rows, "stem string, anchor_index bigint").repartition(5)
    got = sorted(map(tuple, report.block_subsample(df, fraction, at_least).collect()))
    assert got == sorted(rows)[: max(at_least, int(200 * fraction))]


def test_result_arrays_are_bounded(spark, tmp_path):
    """A file's array is parsed whole, so its length must not grow with the table."""
    runs = spark.range(0, 25, 1, 2).select(
        F.lit(0.1).alias("lambda_sig"), F.lit(24).alias("latent_dim"), F.col("id").alias("seed"),
        F.expr("map('v', map('trained', named_struct('r2', id / 4D)))").alias("recovery"),
    )
    path = str(tmp_path / "arrays")
    manifests.write_result_arrays(runs, path, runs=10)
    sizes = [len(json.loads(f.read_text())) for f in (tmp_path / "arrays").glob("part-*")]
    assert sorted(sizes) == [2, 3, 10, 10]
    back = report.recovery_long(manifests.read_results(spark, path)).collect()
    assert sorted((r["seed"], r["target"], r["arm"], r["r2"]) for r in back) == [(i, "v", "trained", i / 4) for i in range(25)]
