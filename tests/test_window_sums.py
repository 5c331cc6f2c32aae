"""Statistics and forecasts of windows, taken from rows, against those of the windows themselves."""

import pytest
from pyspark.sql import functions as F

from trajspark.functions.flatmap import flat_map
from trajspark.operators import dataset, forecast
from trajspark.operators.windows import WindowConfig, extract_windows


@pytest.fixture
def rows(smooth):
    steps = smooth(90, ("a", "b", "c")).unionByName(smooth(6, ("short",)))
    mapped = flat_map(steps.drop("k")).withColumn("split", F.when(F.col("stem") == "c", "val").otherwise("train"))
    bad = ((F.col("stem") == "a") & F.col("step").isin(13, 14, 40, 61)) | ((F.col("stem") == "b") & (F.col("step") == 0))
    mapped = mapped.withColumn("valid", F.col("valid") & ~bad)
    # what an invalid row holds must not matter
    return mapped.withColumns({c: F.when(~bad, F.col(c)) for c in "pvaj"})


def table(stats):
    return {(r["array_name"], r["channel"]): (r["n"], r["mean"], r["m2"]) for r in stats.collect()}


@pytest.mark.parametrize("config", [WindowConfig(4, 3), WindowConfig(3, 4, 3), WindowConfig(1, 1, 2), WindowConfig(5, 2, 1, ("payload_vel", "payload_pos"))])
def test_moments_equal_those_of_the_windows(tiny, rows, config):
    got = table(dataset.window_moments(rows, config))
    windows = extract_windows(rows, config, targets=True)
    want = table(dataset.channel_moments(windows, dataset.ARRAYS))
    assert got.keys() == want.keys() and windows.count() > 50
    for at, (n, mean, m2) in want.items():
        assert got[at][0] == n and got[at][1] == pytest.approx(mean, abs=1e-9) and got[at][2] == pytest.approx(m2, rel=1e-9, abs=1e-9)


def test_moments_across_arrow_batches(tiny, rows):
    want = table(dataset.window_moments(rows))
    tiny.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = table(dataset.window_moments(rows))
    finally:
        tiny.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for at, (n, mean, m2) in want.items():
        assert got[at] == (n, pytest.approx(mean, abs=1e-9), pytest.approx(m2, rel=1e-9, abs=1e-9))


def test_far_from_the_origin_nothing_cancels(tiny, smooth):
    """A hover far away: every relative position is zero, so its scale is one."""
    zero = F.col("step") * 0.0
    p = F.array(zero + 1e7 / 3, zero - 2e7 / 7, zero + 1e7)
    still = smooth(60).drop("k").withColumn("p", p).withColumns({c: F.array(zero, zero, zero) for c in "vaj"})
    stats = dataset.row_norm_stats(flat_map(still).withColumn("split", F.lit("train")), WindowConfig(4, 3))
    hist = stats.where("array_name = 'state_hist'").collect()
    assert len(hist) == 9 and all(r["std"] == 1.0 and r["mean"] == 0.0 for r in hist)


def test_row_stats_come_from_one_split_and_feed_the_dataset(tiny, rows, tmp_path):
    config = WindowConfig(4, 3)
    windows = extract_windows(rows, config, targets=True, carry=["split"])
    stats = dataset.row_norm_stats(rows, config)
    want = {(r["array_name"], r["channel"]): r for r in dataset.norm_stats(windows).collect()}
    for r in stats.collect():
        other = want.pop((r["array_name"], r["channel"]))
        assert r["n_samples"] == other["n_samples"] and r["std"] == pytest.approx(other["std"], rel=1e-9)
    assert not want
    dataset.write_dataset(windows, str(tmp_path / "d"), config, stats=stats)
    back = dataset.WindowedDataset(tiny, str(tmp_path / "d"), "val")
    assert len(back) == windows.where("split = 'val'").count()


def test_no_window_no_moments(tiny, rows):
    assert dataset.window_moments(rows.where("stem = 'short'")).count() == 0
    assert forecast.rollout_error_ahead(rows.where("stem = 'short'"), WindowConfig(), 0.1).count() == 0


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("config", [WindowConfig(4, 5), WindowConfig(3, 4, 3), WindowConfig(1, 1), WindowConfig(2, 6, 2)])
def test_rollout_ahead_equals_rollout_of_windows(tiny, rows, config, exact):
    got = {r["horizon_step"]: r for r in forecast.rollout_error_ahead(rows, config, 0.1, exact).collect()}
    windows = extract_windows(rows, config)
    state = forecast.last_state("state_hist")
    guess = windows.withColumn("guess", forecast.constant_jerk_rollout(state, F.col("action_future"), 0.1, exact))
    want = forecast.horizon_error(guess, "state_future", "guess").collect()
    assert len(got) == len(want) == config.horizon
    for r in want:
        assert got[r["horizon_step"]]["weight"] == r["weight"] and got[r["horizon_step"]]["mse"] == pytest.approx(r["mse"], rel=1e-8, abs=1e-12)
