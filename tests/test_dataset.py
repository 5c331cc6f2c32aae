import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions.flatmap import flat_map
from trajspark.operators import dataset as d
from trajspark.operators.windows import WindowConfig


@pytest.fixture
def corpus(tiny, smooth):
    steps = smooth(60, tuple(f"s{k}" for k in range(6)))
    k = F.substring("stem", 2, 1).cast("int")
    manifest = steps.select("stem").distinct().withColumn(
        "split", F.when(k < 3, "train").when(k == 3, "val").when(k == 4, "test").otherwise("heldout")
    )
    return steps, manifest


def test_moments_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal([1, -5, 100], [0.5, 2, 10], (500, 4, 3))
    x[..., 2] = 7.0
    df = spark.createDataFrame([(r.tolist(), "train") for r in x], "x array<array<double>>, split string").repartition(7)
    s = d.norm_stats(df, ["x"]).orderBy("channel").collect()
    flat = x.reshape(-1, 3)
    assert np.allclose([r["mean"] for r in s], flat.mean(axis=0))
    assert np.allclose([r["std"] for r in s], [*flat.std(axis=0)[:2], 1.0]) and s[2]["std"] == 1.0
    assert s[0]["n_samples"] == 2000
    out = d.normalise(df, d.stats_row(d.norm_stats(df, ["x"])))
    z = np.array([r["x"] for r in out.collect()]).reshape(-1, 3)
    assert np.allclose(z.mean(axis=0), 0, atol=1e-9) and np.allclose(z[:, :2].std(axis=0), 1)


def test_build_write_read(corpus, tiny, tmp_path):
    steps, manifest = corpus
    w = d.build_windows(steps, manifest, key="stem")
    assert {r["split"]: r["count"] for r in w.groupBy("split").count().collect()} == {"train": 93, "val": 31, "test": 31}
    audit = d.trajectory_audit(flat_map(steps.join(manifest, "stem")))
    path = str(tmp_path / "ds")
    d.write_dataset(w, path, audit=audit, extra_metadata={"note": "hi"})
    train = d.WindowedDataset(tiny, path, "train")
    assert len(train) == 93
    meta = train.metadata
    assert meta["splits"] == {"train": 93, "val": 31, "test": 31} and meta["normalized"] and meta["note"] == "hi"
    assert meta["window"]["channel_names"][0] == "p_x" and meta["targets"]["slices"]["tension_margin"] == [21, 22]
    assert meta["sample_rates_hz"] == {"10": 5}
    assert dict(train.windows.dtypes)["state_hist"] == "array<array<float>>"
    x = np.array([r["x"] for r in train.flat_inputs().collect()])
    assert x.shape == (93, 90) and abs(x.reshape(-1, 9).mean(axis=0)).max() < 1e-5
    raw = {(r["stem"], r["anchor_index"]): np.array(r["state_future"]) for r in w.collect()}
    for r in d.WindowedDataset(tiny, path, "test").denormalised().collect():
        assert np.allclose(r["state_future"], raw[r["stem"], r["anchor_index"]], atol=1e-4)
    with pytest.raises(KeyError):
        train.target("nope")
    with pytest.raises(FileNotFoundError):
        d.WindowedDataset(tiny, path, "nope")


def test_unnormalised_build_is_left_alone(corpus, tiny, tmp_path):
    steps, manifest = corpus
    w = d.build_windows(steps, manifest, key="stem")
    d.write_dataset(w, str(tmp_path / "raw"), normalize=False)
    val = d.WindowedDataset(tiny, str(tmp_path / "raw"), "val")
    assert val.denormalised().exceptAll(val.windows).isEmpty()


def test_refuses_empty_train(corpus, tmp_path):
    steps, manifest = corpus
    w = d.build_windows(steps, manifest.where("split <> 'train'"), key="stem")
    with pytest.raises(ValueError, match="training split"):
        d.write_dataset(w, str(tmp_path / "x"))


def test_stats_ignore_other_splits(corpus):
    steps, manifest = corpus
    w = d.build_windows(steps, manifest, key="stem")
    a = d.norm_stats(w, ["state_hist"])
    b = d.norm_stats(w.where("split = 'train'"), ["state_hist"])
    x = {r["channel"]: r["mean"] for r in a.collect()}
    y = {r["channel"]: r["mean"] for r in b.collect()}
    assert x == pytest.approx(y, abs=1e-12)


@pytest.mark.parametrize("stride", [1, 3])
def test_audit_counts_match_windows(tiny, smooth, stride):
    from trajspark.operators.windows import extract_windows

    c = WindowConfig(4, 3, stride)
    steps = smooth(50, ("a", "b")).unionByName(smooth(5, ("short",)))
    steps = steps.withColumns(
        {
            "split": F.lit("train"),
            "valid": (F.col("stem") != "b") & ~F.col("step").isin(13, 14, 33),
        }
    )
    audit = {r["stem"]: r for r in d.trajectory_audit(steps, c).collect()}
    real = {r["stem"]: r["count"] for r in extract_windows(steps, c).groupBy("stem").count().collect()}
    assert {k: r["outcome"] for k, r in audit.items()} == {"a": "used", "b": "all_invalid", "short": "too_short"}
    assert audit["a"]["n_windows"] == real["a"] and audit["a"]["n_candidate"] == 50 - 6 * stride
    assert audit["a"]["hz"] == 10 and audit["short"]["hz"] is None
    report = {(r["section"], r["name"]): r["n"] for r in d.build_report(d.trajectory_audit(steps, c)).collect()}
    assert report["skipped", "too_short"] == 1 and report["windows", "train"] == real["a"]
    assert d.rate_mode(d.trajectory_audit(steps, c)).first()["hz"] == 10
