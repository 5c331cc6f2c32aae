import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import margins
from trajspark.operators.kinematics import row_delta


def frame(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "tension_margin double")


def test_summary_skips_nonfinite(spark):
    r = margins.margin_summary(frame(spark, [1, 2, float("nan"), 3, float("inf")])).first()
    assert (r["n"], r["n_nonfinite"], r["min"], r["max"], r["p50"]) == (3, 2, 1, 3, 2)
    assert r["std"] == pytest.approx(np.std([1, 2, 3]))


def test_summary_of_nothing_fails(spark):
    with pytest.raises(Exception, match="no finite"):
        margins.margin_summary(frame(spark, [float("nan")])).collect()


def test_labels_and_base_rate(spark):
    df = margins.label_slack(frame(spark, [1, 0.5, 0.2, 0.05, 0]), 0.1)
    assert [r["near_slack"] for r in df.collect()] == [False, False, False, True, True]
    assert df.agg(margins.base_rate(F.col("near_slack")).alias("b")).first()["b"] == pytest.approx(0.4)
    assert np.isnan(df.where("false").agg(margins.base_rate(F.col("near_slack")).alias("b")).first()["b"])


def test_sweep_is_strict_and_monotone(spark):
    rows = margins.threshold_sweep(frame(spark, np.linspace(0, 1, 1001))).orderBy("threshold").collect()
    counts = [r["count"] for r in rows]
    assert counts == sorted(counts) and counts[-1] == 500


@pytest.mark.parametrize("xs", [np.random.default_rng(1).normal(size=500), [2.0] * 9])
def test_histogram_matches_numpy(spark, xs):
    got = margins.histogram(frame(spark, xs), "tension_margin", 10).orderBy("bin").collect()
    counts, edges = np.histogram(xs, 10)
    assert [r["count"] for r in got] == list(counts)
    assert np.allclose([r["lower"] for r in got], edges[:-1])


def test_per_trajectory_and_rollup(tiny):
    rng = np.random.default_rng(4)
    data, want = [], {}
    for k, n in enumerate([10, 60, 3]):
        m = rng.uniform(0.2, 1.5, n)
        want[f"t{k}"] = (n, m.min(), np.percentile(m, 1), np.median(m), m.max())
        data += [(f"t{k}", "g", i, 0.1 * i, float(x), float(-x)) for i, x in enumerate(m)]
    df = tiny.createDataFrame(data, "stem string, group string, step bigint, time double, tension_margin double, a_z double")
    per = margins.per_trajectory_margins(row_delta(df, "time", "dt_row"))
    for r in per.collect():
        n, lo, p1, med, hi = want[r["name"]]
        assert r["n"] == n and np.allclose([r["min"], r["p1"], r["median"], r["max"]], [lo, p1, med, hi])
        assert r["dt"] == pytest.approx(0.1) and r["min_az"] == pytest.approx(-hi)
    roll = margins.group_rollup(per).first()
    assert (roll["files"], roll["steps"]) == (3, 73)
    assert [r["name"] for r in margins.closest(per, 2).collect()] == sorted(want, key=lambda k: want[k][1])[:2]


def test_viability(spark):
    assert margins.viability(frame(spark, [0.9, 0.8])).first()["verdict"] == "not supported"
    assert margins.viability(frame(spark, [0.9, 0.1])).first()["verdict"] == "supported"
