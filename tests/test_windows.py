import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions.flatmap import flat_map
from trajspark.operators.windows import (
    WindowConfig,
    extract_windows,
    nested_target_windows,
    resampled_length,
    target_of,
    target_slices,
    total_width,
    window_count,
)


@pytest.mark.parametrize("n,want", [(60, 31), (30, 1), (29, 0)])
def test_window_counts(tiny, smooth, n, want):
    steps = smooth(n, ("s0", "s1"))
    got = extract_windows(steps, WindowConfig(), valid=None).groupBy("stem").count().collect()
    assert [r["count"] for r in got] == [want] * 2 * (want > 0)
    assert steps.select(window_count(F.lit(n), WindowConfig()).alias("c")).first()["c"] == want


@pytest.mark.parametrize("n,want", [(15, 0), (16, 1), (18, 3)])
def test_stride(tiny, smooth, n, want):
    w = extract_windows(smooth(n), WindowConfig(2, 2, 5), valid=None)
    assert w.count() == want
    assert sorted(r["anchor_index"] for r in w.collect()) == [5 + i for i in range(want)]


@pytest.mark.parametrize("n", range(1, 70, 7))
@pytest.mark.parametrize("stride", [1, 2, 3])
def test_manifest_rule_agrees_with_window_count(spark, n, stride):
    c = WindowConfig(4, 6, stride)
    r = spark.range(1).select(
        (resampled_length(F.lit(n), stride) < 10).alias("short"), (window_count(F.lit(n), c) == 0).alias("none")
    ).first()
    assert r["short"] == r["none"]


def test_one_invalid_step_removes_a_span_of_windows(tiny, smooth):
    steps = smooth(100).withColumn("valid", F.col("step") != 50)
    w = extract_windows(steps, WindowConfig())
    assert w.count() == 71 - 30
    free = extract_windows(steps, WindowConfig(require_valid=False))
    assert free.count() == 71


def test_unread_invalid_step_keeps_strided_window(tiny, smooth):
    steps = smooth(16).withColumn("valid", F.col("step") != 3)
    assert extract_windows(steps, WindowConfig(2, 2, 5)).count() == 1


def test_contents_against_slices(tiny, smooth):
    steps = smooth(40)
    rows = steps.orderBy("step").collect()
    p, v, j = (np.array([r[k] for r in rows]) for k in "pvj")
    c = WindowConfig(4, 3, 2, observed=("payload_pos", "payload_vel"))
    for w in extract_windows(steps.repartition(6), c, valid=None).collect():
        at = w["anchor_index"]
        idx = at + 2 * np.arange(-3, 4)
        obs = np.concatenate([p[idx] - p[at], v[idx]], axis=1)
        assert np.allclose(w["anchor_origin"], p[at])
        assert np.allclose(w["state_hist"], obs[:4]) and np.allclose(w["state_future"], obs[4:])
        assert np.allclose(w["action_hist"], j[idx][:4]) and np.allclose(w["action_future"], j[idx][4:])
    assert c.obs_dim == 6 and c.channel_names() == ["p_x", "p_y", "p_z", "v_x", "v_y", "v_z"]


def test_translation_does_not_change_windows_or_targets(tiny, smooth):
    base = smooth(40)
    moved = base.withColumn("p", F.transform("p", lambda x: x + 100.0))
    a, b = (
        extract_windows(flat_map(d), WindowConfig(), targets=True).orderBy("anchor_index").collect()
        for d in (base, moved)
    )
    for x, y in zip(a, b):
        assert np.allclose(x["state_hist"], y["state_hist"], atol=1e-10)
        assert np.allclose(x["targets"], y["targets"], atol=1e-10)


def test_targets_layout(tiny, smooth):
    assert total_width() == 22 and target_slices()["p_quad"] == (18, 3)
    w = extract_windows(flat_map(smooth(40)), WindowConfig(), targets=True)
    r = w.select(
        target_of("targets", "v").alias("v"), target_of("targets", "cable_dir").alias("b3"),
        target_of("targets", "p_quad").alias("pq"), F.col("state_hist")[9].alias("last"),
    ).first()
    assert r["v"] == r["last"][3:6] and np.allclose(r["last"][:3], 0)
    assert np.allclose(r["pq"], 0.567 * np.array(r["b3"]))
    with pytest.raises(KeyError):
        target_of("targets", "nope")


def test_nested_target_windows(spark):
    df = spark.createDataFrame([([0, 1, 2, 3], [4, 5, 6])], "h array<int>, f array<int>")
    assert df.select(nested_target_windows("h", "f", 4, 3).alias("t")).first()["t"] == [[1, 2, 3, 4], [2, 3, 4, 5], [3, 4, 5, 6]]


@pytest.mark.parametrize("kw", [{"history": 0}, {"horizon": 0}, {"stride": 0}, {"observed": ()}, {"observed": ("x",)}])
def test_bad_configs(kw):
    with pytest.raises(ValueError):
        WindowConfig(**kw)


@pytest.mark.parametrize("stride", [1, 3])
def test_hold_last_error_needs_no_windows(tiny, smooth, stride):
    from trajspark.operators import forecast
    from trajspark.operators.windows import extract_windows

    config = WindowConfig(4, 3, stride)
    rows = smooth(60, ("a", "b", "c")).withColumn("valid", ~((F.col("stem") == "b") & F.col("step").isin(11, 30)))
    w = extract_windows(rows, config).withColumn("pred", forecast.hold_last("state_hist", 3))
    want = {r["horizon_step"]: r for r in forecast.horizon_error(w, "state_future", "pred").collect()}
    fields = {f"{n}{i}": F.col(n)[i] for n in "pva" for i in range(3)}
    got = {r["horizon_step"]: r for r in forecast.hold_last_error(rows, config, fields).collect()}
    assert got.keys() == want.keys()
    for h, r in want.items():
        assert got[h]["weight"] == r["weight"] and got[h]["mse"] == pytest.approx(r["mse"])
    assert forecast.hold_last_error(rows.where("step < 2"), config, fields).count() == 0
