import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions.flatmap import flat_map, rotation_of, with_quaternion
from trajspark.operators.kinematics import (
    attitude_reconciliation,
    continuous_quaternion,
    flat_outputs,
    gradient,
    guard_counts,
    jerk_discrepancy,
    self_consistency,
)
from trajspark.plans.ordering import dense_step
from trajspark.schema import SystemParams

G = 9.81
NAN, INF = float("nan"), float("inf")


def rows(spark, acc, jerk=None):
    jerk = [[0.1, 0.2, 0.3]] * len(acc) if jerk is None else jerk
    data = [
        ("s", i, [1.0, 2.0, 3.0], [0.1, 0.2, 0.3], list(map(float, a)), list(map(float, j)))
        for i, (a, j) in enumerate(zip(acc, jerk))
    ]
    return spark.createDataFrame(
        data, "stem string, step bigint, p array<double>, v array<double>, a array<double>, j array<double>"
    )


def oracle(p, v, a, j, q=SystemParams()):
    """One row of the closed form, straight from its definition."""
    c = a + np.array([0, 0, q.gravity])
    n = np.linalg.norm(c)
    nd = c @ j / n
    ndd = j @ j / n - (c @ j) ** 2 / n**3
    hd = -j / n + nd / n**2 * c
    hdd = 2 * nd / n**2 * j + ndd / n**2 * c - 2 * nd**2 / n**3 * c
    f = (q.mass_quad + q.mass_load) * c - q.mass_quad * q.cable_length * hdd
    b3 = f / np.linalg.norm(f)
    b1 = np.cross([0, 1, 0], b3)
    b1 /= np.linalg.norm(b1)
    r = np.stack([b1, np.cross(b3, b1), b3], axis=1)
    return p + q.cable_length * b3, v - q.cable_length * hd, a - q.cable_length * hdd, r


def test_matches_definition(spark):
    rng = np.random.default_rng(0)
    acc, jerk = rng.normal(0, 1.5, (20, 3)), rng.normal(0, 3, (20, 3))
    out = flat_map(rows(spark, acc, jerk)).orderBy("step").collect()
    for r, a, j in zip(out, acc, jerk):
        p, v, aq, rot = oracle(np.array(r["p"]), np.array(r["v"]), a, j)
        assert r["valid"]
        for got, want in ((r["p_quad"], p), (r["v_quad"], v), (r["a_quad"], aq), (r["R_quad"], rot.reshape(-1))):
            assert np.allclose(got, want, rtol=0, atol=1e-12)
        assert np.allclose(r["cable_dir"], rot[:, 2], atol=1e-12)


def test_hover_freefall_and_lateral_margin(spark):
    out = flat_map(rows(spark, [[0, 0, 0], [0, 0, -G], [3, 4, 0]])).orderBy("step").collect()
    assert out[0]["tension_margin"] == pytest.approx(1.0, abs=1e-12)
    assert out[0]["tension"] == pytest.approx(1.59903)
    assert out[1]["tension_margin"] == 0 and out[1]["guard_free_fall"] and not out[1]["valid"]
    assert all(math.isnan(x) for x in out[1]["p_quad"]) and out[1]["z_flat"][8] == -G
    assert out[2]["tension_margin"] == pytest.approx(math.sqrt(25 + G * G) / G)


def test_guards_are_exclusive(spark):
    acc = [[0.1, 0.2, 0.3]] * 12
    jerk = [[1.0, 2.0, 3.0]] * 12
    acc[2] = [0, 0, -G]
    acc[5], jerk[5] = [0, 5, -G], [0, 0, 0]
    jerk[8] = [NAN, 0, 0]
    r = guard_counts(flat_map(rows(spark, acc, jerk))).first()
    assert (r["free_fall"], r["force"], r["degenerate_cross"], r["nonfinite_input"], r["invalid_total"]) == (1, 0, 1, 1, 3)


@pytest.mark.parametrize("acc,yaw,flag", [([0, -5, -G], 0.0, True), ([5, 0, -G], math.pi / 2, True), ([5, 0, -G], 0.0, False)])
def test_degenerate_cross_depends_on_yaw(spark, acc, yaw, flag):
    r = flat_map(rows(spark, [acc], [[0, 0, 0]]), yaw=yaw).first()
    assert r["guard_degenerate_cross"] == flag and r["valid"] != flag


def test_null_and_infinite_inputs_are_nonfinite(spark):
    df = rows(spark, [[INF, 0, 0], [0, 0, 0]]).withColumn(
        "v", F.when(F.col("step") == 1, F.array(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0))).otherwise(F.col("v"))
    )
    assert [r["guard_nonfinite_input"] for r in flat_map(df).collect()] == [True, True]


def continuity(q):
    """Row-by-row statement of the sign rule."""
    out, sign = [], 1.0
    for i, row in enumerate(q):
        if i and row @ q[i - 1] < 0:
            sign = -sign
        out.append(sign * row)
    first = next((r for r in out if np.isfinite(r).all()), None)
    return [-r for r in out] if first is not None and first[3] < 0 else out


@pytest.mark.parametrize("parts", [1, 6])
def test_quaternion_sign_rule(tiny, parts):
    rng = np.random.default_rng(5)
    q = rng.normal(size=(90, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    q[[0, 1, 40]] = np.nan
    data = [(s, i, [float(x) for x in r]) for s in ("a", "b") for i, r in enumerate(q if s == "a" else -q)]
    df = tiny.createDataFrame(data, "stem string, step bigint, raw array<double>").repartition(parts)
    out = continuous_quaternion(df, "raw").orderBy("stem", "step").collect()
    for stem, source in (("a", q), ("b", -q)):
        got = np.array([r["quat"] for r in out if r["stem"] == stem])
        assert np.allclose(got, np.array(continuity(source)), equal_nan=True)


def test_quaternion_sign_rule_of_short_keys(spark):
    """Keys that the numbering found short: one exchange, no join, the same signs."""
    rng = np.random.default_rng(6)
    q = rng.normal(size=(40, 4))
    q[[0, 7]] = np.nan
    data = [(s, i, [float(x) for x in r]) for s in ("a", "b", "c") for i, r in enumerate({"a": q, "b": -q, "c": q * np.nan}[s])]
    df = dense_step(spark.createDataFrame(data, "stem string, t bigint, raw array<double>").repartition(5), "stem", ["t"])
    turned = continuous_quaternion(df, "raw")
    plan = turned._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    out = turned.orderBy("stem", "step").collect()
    for stem, source in (("a", q), ("b", -q), ("c", q * np.nan)):
        got = np.array([r["quat"] for r in out if r["stem"] == stem])
        assert np.allclose(got, np.array(continuity(source)), equal_nan=True)


def test_quaternion_reproduces_rotation_and_is_smooth(tiny, smooth):
    f = flat_outputs(smooth(60, ("s0", "s1"))).withColumn("back", rotation_of(F.col("quat_quad")))
    gap = f.agg(F.max(F.array_max(F.zip_with("R_quad", "back", lambda a, b: F.abs(a - b)))).alias("g")).first()["g"]
    assert gap < 1e-12
    for stem in ("s0", "s1"):
        q = np.array([r["quat_quad"] for r in f.where(F.col("stem") == stem).orderBy("step").collect()])
        assert q[0, 3] >= 0 and (np.sum(q[1:] * q[:-1], axis=1) > 0).all()


def test_quaternion_branches(spark):
    # Half turns about each axis exercise the three non-scalar branches.
    mats = [[1, 0, 0, 0, -1, 0, 0, 0, -1], [-1, 0, 0, 0, 1, 0, 0, 0, -1], [-1, 0, 0, 0, -1, 0, 0, 0, 1], [1, 0, 0, 0, 1, 0, 0, 0, 1]]
    df = spark.createDataFrame([([float(x) for x in m],) for m in mats], "r array<double>")
    got = [r["q"] for r in with_quaternion(df, "r", "q").collect()]
    assert got == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]


def test_gradient_matches_numpy(tiny):
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.uniform(0.05, 0.2, 50))
    x = np.sin(3 * t)
    df = tiny.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x))], "stem string, step bigint, time double, x double")
    got = [r["x_grad"] for r in gradient(df.repartition(5), ["x"]).orderBy("step").collect()]
    assert np.allclose(got, np.gradient(x, t, edge_order=2), rtol=1e-9)
    assert gradient(df.where("step < 2"), ["x"]).first()["x_grad"] is None


def test_jerk_discrepancy_interior(spark):
    df = spark.createDataFrame([(i, 4, float(i), 0.0) for i in range(4)], "step bigint, n bigint, r double, g double")
    r = jerk_discrepancy(df, ["r"], ["g"]).first()
    assert (r["max"], r["mean"], r["interior_max"], r["interior_mean"]) == (3.0, 1.5, 2.0, 1.5)
    assert r["rms_rel"] == pytest.approx(math.sqrt(2.5) / 1.5)


def test_self_consistency_is_zero_for_exact_integration(tiny):
    h, s = 0.1, np.zeros(9)
    data = []
    for i in range(40):
        u = np.array([math.sin(i), 1.0, -0.5])
        data.append(("s", i, *[s[k : k + 3].tolist() for k in (0, 3, 6)], u.tolist()))
        p, v, a = s[:3], s[3:6], s[6:]
        s = np.concatenate([p + v * h + a * h**2 / 2 + u * h**3 / 6, v + a * h + u * h**2 / 2, a + u * h])
    df = tiny.createDataFrame(data, "stem string, step bigint, p array<double>, v array<double>, a array<double>, j array<double>")
    r = self_consistency(df, F.lit(h)).first()
    assert max(r) < 1e-12


def test_reconciliation_reports_yaw(spark):
    c, s = math.cos(0.4), math.sin(0.4)
    df = spark.createDataFrame([([c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "rec array<double>, ana array<double>")
    r = attitude_reconciliation(df, "rec", "ana").first()
    assert r["residual"] == 0 and r["max_abs_yaw"] == pytest.approx(0.4)
