import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import diagnostics as dg
from trajspark.operators import encode, linalg, probes
from trajspark.operators.dataset import channel_moments
from trajspark.schema import RIDGE_ALPHAS


def table(spark, **arrays):
    names = list(arrays)
    rows = [
        (i, *[v[i].tolist() if hasattr(v[i], "tolist") else v[i] for v in arrays.values()])
        for i in range(len(next(iter(arrays.values()))))
    ]
    types = ", ".join(f"{n} {'string' if isinstance(arrays[n][0], str) else 'array<double>'}" for n in names)
    return spark.createDataFrame(rows, f"id bigint, {types}")


def brute_ridge(x, y, alpha):
    xb = np.c_[x, np.ones(len(x))]
    penalty = alpha * np.eye(xb.shape[1])
    penalty[-1, -1] = 0
    return np.linalg.solve(xb.T @ xb + penalty, xb.T @ y)


def brute_r2(y, f):
    tot = ((y - y.mean(0)) ** 2).sum(0)
    return np.where(tot > 1e-12, 1 - ((y - f) ** 2).sum(0) / np.where(tot > 1e-12, tot, 1), np.nan)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.normal(3, 1, (300, 6))
    y = np.c_[x @ rng.normal(size=(6, 2)) + rng.normal(0, 0.5, (300, 2)), np.tanh(x[:, 0] * x[:, 1]), np.full(300, 2.0)]
    split = np.array([["train", "val", "test"][k] for k in rng.choice(3, 300, p=[0.6, 0.2, 0.2])])
    return x, y, split


@pytest.mark.parametrize("parts", [1, 5])
def test_recovery_against_brute_force(spark, data, parts):
    x, y, split = data
    df = table(spark, split=list(split), x=x, half=x[:, :3], y=y).repartition(parts)
    slices = {"lin": (0, 2), "mixed": (2, 2)}
    out = {
        (r["target"], r["arm"]): r
        for r in probes.recovery(df, {"trained": "x", "half": "half"}, "y", slices, F.col("id")).collect()
    }
    tr, va, te = (split == s for s in ("train", "val", "test"))
    for target, (at, width) in slices.items():
        for arm, feats in (("trained", x), ("half", x[:, :3])):
            t = y[:, at : at + width]
            best = None
            for a in RIDGE_ALPHAS:
                w = brute_ridge(feats[tr], t[tr], a)
                pred = lambda m: np.c_[feats[m], np.ones(m.sum())] @ w  # noqa: E731, B023
                score = np.nanmean(brute_r2(t[va], pred(va)))
                if best is None or score > best[0]:
                    best = (score, a, brute_r2(t[te], pred(te)))
            r = out[target, arm]
            assert r["alpha"] == best[1] and r["val_r2"] == pytest.approx(best[0], abs=1e-8)
            assert r["r2"] == pytest.approx(np.nanmean(best[2]), abs=1e-8)
            assert r["n_constant_channels"] == np.isnan(best[2]).sum()
            assert [c is None for c in r["r2_per_channel"]] == list(np.isnan(best[2]))
    assert out["lin", "trained"]["r2"] > 0.8 and out["lin", probes.SHUFFLED]["r2"] < 0.2


def test_permutation_is_complete_and_stable(spark):
    df = spark.range(200).select("id", F.when(F.col("id") < 150, "train").otherwise("val").alias("split"), F.col("id").alias("y"))
    a = probes.permute_labels(df, F.col("id"), "y", 1, "z")
    b = probes.permute_labels(df.repartition(11), F.col("id"), "y", 1, "z")
    assert a.exceptAll(b).isEmpty()
    train = a.where("split = 'train'").collect()
    assert sorted(r["z"] for r in train) == list(range(150)) and sum(r["z"] == r["id"] for r in train) < 10
    assert a.where("split = 'val' and z <> id").isEmpty()


def test_linear_audit_counts_constants_as_zero(spark):
    rng = np.random.default_rng(1)
    hist = rng.normal(size=(200, 2, 3))
    flat = hist.reshape(200, 6)
    y = rng.normal(size=(200, 22))
    y[:, 0:3] = flat[:, :3] @ rng.normal(size=(3, 3))
    y[:, 14] = 1.0
    split = ["train" if i < 140 else "test" for i in range(200)]
    rows = [(h.tolist(), t.tolist(), s) for h, t, s in zip(hist, y, split)]
    df = spark.createDataFrame(rows, "state_hist array<array<double>>, targets array<double>, split string").repartition(4)
    out = {r["target"]: r for r in probes.linear_audit(df).collect()}
    w = brute_ridge(flat[:140], y[:140], 1e-3)
    r2 = np.nan_to_num(brute_r2(y[140:], np.c_[flat[140:], np.ones(60)] @ w), nan=0.0)
    assert out["v"]["r2_raw_window"] == pytest.approx(r2[:3].mean()) and out["v"]["disqualified"] and not out["v"]["surprise"]
    assert out["R_quad_cols"]["r2_raw_window"] == pytest.approx(r2[12:18].mean())
    assert out["a"]["surprise"]


def test_r2_in_the_jvm(spark, data):
    x, y, _ = data
    f = y + 0.1 * x[:, :4]
    out = linalg.r2_per_channel(table(spark, y=y, f=f), "y", "f").orderBy("channel").collect()
    assert np.allclose([r["r2"] for r in out], brute_r2(y, f), equal_nan=True)


@pytest.mark.parametrize("parts", [1, 6])
def test_diagnostics_against_numpy(spark, parts):
    rng = np.random.default_rng(2)
    x = rng.normal(5, 1, (400, 3)) @ rng.normal(size=(3, 8))
    df = table(spark, x=x).repartition(parts)
    d = dg.latent_diagnostics(df).first()
    c = x - x.mean(0)
    s = np.linalg.svd(c, compute_uv=False)
    eig = s**2 / 399
    assert d["numerical_rank"] == 3 and d["num_samples"] == 400 and d["latent_dim"] == 8
    assert np.allclose(d["eigenvalues"], eig, atol=1e-10)
    assert np.allclose(d["per_dim_variance"], x.var(0, ddof=1))
    assert d["participation_ratio"] == pytest.approx(eig.sum() ** 2 / (eig**2).sum())
    p = np.maximum(eig / eig.sum(), 1e-12)
    assert d["effective_rank"] == pytest.approx(np.exp(-(eig / eig.sum() * np.log(p)).sum()))
    assert d["stable_rank"] == pytest.approx(eig.sum() / eig[0])
    i, j = np.triu_indices(400, 1)
    dist = np.linalg.norm(x[i] - x[j], axis=1)
    assert d["pairwise_rms"] == pytest.approx(np.sqrt((dist**2).mean()))
    assert np.allclose(d["explained_variance_ratio"], eig / eig.sum())
    assert d["latent_norm_mean"] == pytest.approx(np.linalg.norm(x, axis=1).mean())
    e = dg.effective_dimensionality(df).first()
    assert e["n_components_99pct"] <= 3 and np.allclose(e["eigenvalues"], eig, atol=1e-9)
    assert e["allocated_dim"] == 8


def test_constant_features_raise_the_alarm(spark):
    df = table(spark, x=np.full((50, 4), 0.7))
    d = dg.collapse_alarm(dg.latent_diagnostics(df)).first()
    assert d["triggered"] and d["reasons"] == ["effective_rank", "variance_mean", "pairwise_rms"]
    assert dg.effective_dimensionality(df).first()["participation_ratio"] == 0.0
    healthy = table(spark, x=np.random.default_rng(0).normal(size=(300, 8)))
    h = dg.collapse_alarm(dg.latent_diagnostics(healthy), min_rank_fraction=0.5).first()
    assert not h["triggered"]
    with pytest.raises(ValueError):
        dg.latent_diagnostics(df.limit(1))


def brute_epps(z, knots=17, t_max=5.0):
    t = np.linspace(-t_max, t_max, knots)
    phi = np.exp(-(t**2) / 2)
    arg = z[:, :, None] * t
    y = ((np.cos(arg).mean(0) - phi) ** 2 + np.sin(arg).mean(0) ** 2) * phi
    return np.trapezoid(y, t, axis=-1)


@pytest.mark.parametrize("knots", [2, 16, 17])
def test_epps_pulley_against_numpy(spark, knots):
    x = np.random.default_rng(3).normal(0.3, 1.2, (250, 5))
    dirs = dg.unit_directions(5, 7, seed=1)
    assert np.allclose(np.linalg.norm(dirs, axis=0), 1)
    df = table(spark, x=x).repartition(3)
    got = dg.epps_pulley(df, "x", dirs, knots=knots).orderBy("direction").collect()
    want = brute_epps(x @ dirs, knots)
    assert np.allclose([r["statistic"] for r in got], want)
    score = dg.sketched_normality(df, "x", directions=dirs, knots=knots, scale_by_rows=True).first()
    assert score["score"] == pytest.approx(want.mean() * 250)


def test_normality_score_detects_collapse_shift_and_scale(spark):
    z = np.random.default_rng(4).normal(size=(2000, 6))
    score = lambda a: dg.sketched_normality(table(spark, x=a), "x", 6, slices=32).first()["score"]
    base = score(z)
    assert base < 5e-3
    assert score(z * 0) == pytest.approx(0.408921, abs=1e-6)
    assert min(score(z + 2), score(z * 5), score(z * 0.05)) > 0.1
    with pytest.raises(ValueError):
        dg.epps_pulley(table(spark, x=z[:1]), "x", np.eye(6))


def test_spread_uses_every_row(spark):
    x = np.random.default_rng(5).normal(size=(2000, 4))
    y = x.copy()
    y[512:] *= 3
    one, two = (dg.latent_diagnostics(table(spark, x=a)).first()["pairwise_rms"] for a in (x, y))
    assert two > 2 * one


def test_rank_sweep_against_single_cases(spark):
    x = np.random.default_rng(6).normal(size=(300, 5))
    df = table(spark, x=x).repartition(3)
    cases = {"full": F.col("x"), "none": F.transform("x", lambda v: v * 0)}
    got = {r["case"]: r for r in dg.rank_sweep(df, cases, 5, slices=16).collect()}
    for name, col in cases.items():
        case = df.select(col.alias("x"))
        assert got[name]["score"] == pytest.approx(dg.sketched_normality(case, "x", 5, slices=16).first()["score"])
        assert got[name]["participation_ratio"] == pytest.approx(dg.effective_dimensionality(case).first()["participation_ratio"])


@pytest.mark.parametrize("parts", [1, 4, 300])
def test_sums_do_not_depend_on_the_number_of_tasks(spark, parts):
    x = np.random.default_rng(7).normal(3, 2, size=(500, 6))
    df = table(spark, x=x).repartition(parts)
    assert np.allclose(linalg.symmetric(linalg.gram(df, "x")), x.T @ x)
    m = {r["channel"]: r for r in channel_moments(df, ["x"]).collect()}
    assert np.allclose([m[c]["mean"] for c in range(6)], x.mean(0))
    assert np.allclose([m[c]["m2"] for c in range(6)], ((x - x.mean(0)) ** 2).sum(0))


@pytest.mark.parametrize("bad", ["NULL", "array(1D, NULL)", "array(1D, 2D, 3D)"])
def test_vectors_that_do_not_fit_are_errors(spark, bad):
    df = spark.sql(f"SELECT array(1D, 2D) AS x UNION ALL SELECT {bad}").coalesce(1)
    with pytest.raises(Exception, match="NULL|widths"):
        linalg.gram(df, "x").collect()


def test_constant_target_keeps_its_row(spark, data):
    x, y, split = data
    flat = np.column_stack([y, np.ones(len(y))])
    df = table(spark, x=x, y=flat, split=split)
    out = {r["target"]: r for r in probes.recovery(df, {"a": "x"}, "y", {"t": (0, 2), "flat": (y.shape[1], 1)}, F.col("id"), control=False).collect()}
    assert out["t"]["r2"] is not None and out["flat"]["r2"] is None and out["flat"]["n_constant_channels"] == 1
    with pytest.raises(ValueError, match="no rows in split"):
        probes.recovery(df.where("split <> 'val'"), {"a": "x"}, "y", {"t": (0, 2)}, F.col("id"), control=False)


def test_score_windows_appends_the_encoding(spark):
    h = np.random.default_rng(0).normal(size=(40, 20, 3))
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(h)], "id bigint, state_hist array<array<double>>")
    got = encode.score_windows(df.repartition(3), lambda a: a.sum(axis=1)).orderBy("id").collect()
    assert np.allclose([r["x"] for r in got], h.sum(1))
