import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions.hashing import environment_seed, split_of, unit_blake2b, unit_md5
from trajspark.functions.text import file_name_stem, stem_identity, tag
from trajspark.operators import manifest as m
from trajspark.schema import MANIFEST

GOOD = {
    "stem": "forest_000_f0_g15_0_0_m0p5_v0_0_0_s123", "csv_path": "x.csv", "subdir": "f", "source": "forest",
    "env_id": "forest_f0_s123", "solver_status": "Solve_Succeeded", "status_source": "solver_log",
    "iterations": 120, "solve_time_s": 6.4, "path_length_m": 16.0, "total_time_s": 5.6, "n_timesteps": 57,
    "dt_s": 0.1, "sample_rate_hz": 10.0, "split": "train", "forest_type": 0, "env_seed": 123, "manifest_version": 1,
}


def record(spark, **kw):
    row = {f.name: None for f in MANIFEST.fields} | GOOD | kw
    return spark.createDataFrame([tuple(row[f.name] for f in MANIFEST.fields)], MANIFEST)


NAN = float("nan")


@pytest.mark.parametrize(
    "kw,rules,want",
    [
        ({}, {}, []),
        ({"csv_path": None}, {}, ["missing_csv"]),
        ({"n_timesteps": None}, {}, ["missing_csv"]),
        ({"n_timesteps": None, "path_length_m": None, "total_time_s": None}, {}, ["missing_csv"]),
        ({"solver_status": None}, {}, []),
        ({"solver_status": None}, {"allow_unknown_status": False}, ["unknown_solver_status"]),
        ({"solver_status": "Maximum_Iterations_Exceeded"}, {}, ["solver_status"]),
        ({"solver_status": "Solved_To_Acceptable_Level"}, {}, []),
        ({"iterations": 99999}, {}, ["solver_iteration_sentinel"]),
        ({"path_length_m": None}, {}, ["missing_path_length"]),
        ({"path_length_m": 999.0}, {}, ["path_length_sentinel"]),
        ({"path_length_m": 0.001}, {}, ["degenerate_path"]),
        ({"path_length_m": NAN}, {}, []),
        ({"total_time_s": None}, {}, ["missing_total_time"]),
        ({"total_time_s": 1000.0}, {}, ["total_time_sentinel"]),
        ({"total_time_s": 0.0}, {}, ["degenerate_duration"]),
        ({"total_time_s": NAN}, {}, []),
        ({"n_timesteps": 29}, {}, ["too_short_for_window"]),
        ({}, {"stride": 25}, ["too_short_for_window"]),
        ({"n_timesteps": 1962}, {"stride": 25}, []),
        (
            {"solver_status": "Solver_Failed", "iterations": 99999, "path_length_m": 999.0, "total_time_s": 1000.0},
            {},
            ["solver_status", "solver_iteration_sentinel", "path_length_sentinel", "total_time_sentinel"],
        ),
    ],
)
def test_quality_rules(spark, kw, rules, want):
    got = record(spark, **kw).select(m.quality_issues(**rules).alias("i")).first()["i"]
    assert got == want


def test_stem_identity(spark):
    cases = {
        GOOD["stem"]: ("forest", "forest_f0_s123", 0, 123),
        "forest_003_f2_g15_n3_0_m0p5_v1_0_0_s1390851128": ("forest", "forest_f2_s1390851128", 2, 1390851128),
        "maze_3_slow": ("maze", "maze_3", None, None),
        "forest_bad": ("other", "forest_bad", None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "stem string")
    for r in df.withColumns(stem_identity(F.col("stem"))).collect():
        assert (r["source"], r["env_id"], r["forest_type"], r["env_seed"]) == cases[r["stem"]]


def test_names_and_tags(spark):
    r = spark.range(1).select(
        file_name_stem(F.lit("a/b/maze_3.yaml")).alias("a"), file_name_stem(F.lit("maze_3")).alias("b"),
        tag(F.lit(-0.5)).alias("c"),
    ).first()
    assert tuple(r) == ("maze_3", "maze_3", "n0p5")


def test_unit_hashes(spark):
    df = spark.createDataFrame([("forest_f0_s1390851128",), ("forest_f0_s0",), ("forest_f2_s999",)], "e string")
    rows = df.select("e", unit_blake2b(F.col("e"), 0).alias("b"), unit_md5(F.col("e"), 0).alias("m")).collect()
    assert [r["b"] for r in rows] == [0.7648092910290204, 0.7614785750816404, 0.6042327633848582]
    for r in rows:
        assert r["m"] == int(hashlib.md5(f"0|{r['e']}".encode()).hexdigest()[:8], 16) / 2**32


def test_environment_seed(spark):
    df = spark.createDataFrame([(7,), (123,)], "s bigint")
    got = [r[0] for r in df.select(environment_seed(F.col("s"))).collect()]
    assert got == [1390851128, random.Random(123).getrandbits(32)]


def envs(spark, n):
    return spark.range(n).select(F.concat(F.lit("forest_f0_s"), F.col("id")).alias("env_id"))


def test_shuffle_counts_are_exact_and_order_free(spark):
    a = m.environment_splits(envs(spark, 500), 3, method="shuffle")
    counts = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert counts == {"train": 400, "val": 50, "test": 50}
    b = m.environment_splits(envs(spark, 500).repartition(9), 3, method="shuffle")
    assert a.exceptAll(b).isEmpty()
    odd = m.environment_splits(envs(spark, 13), 3, method="shuffle")
    assert {r["split"]: r["count"] for r in odd.groupBy("split").count().collect()} == {"train": 11, "val": 1, "test": 1}


@pytest.mark.parametrize("hash_fn", ["blake2b", "md5"])
def test_hash_split_is_stable_under_growth(spark, hash_fn):
    small = m.environment_splits(envs(spark, 50), 0, hash_fn=hash_fn)
    large = m.environment_splits(envs(spark, 5000), 0, hash_fn=hash_fn)
    assert small.exceptAll(large).isEmpty()
    share = large.where("split = 'train'").count() / 5000
    assert abs(share - 0.8) < 0.03


def test_fractions_are_checked():
    for bad in ([0.5, 0.4, 0.2], [1.2, -0.1, -0.1], [1.0]):
        with pytest.raises(ValueError):
            split_of(F.lit(0.1), bad)


@pytest.mark.parametrize("method", ["hash", "shuffle"])
def test_no_environment_leaks(spark, method):
    df = spark.range(540).select(
        F.concat(F.lit("e"), F.col("id") % 60).alias("env_id"),
        F.when(F.col("id") == 7, "maze").otherwise("forest").alias("source"),
        F.col("id").alias("stem"),
    )
    out = m.apply_splits(df, 1, method=method)
    assert out.count() == 540 and m.split_leaks(out).isEmpty()
    held = out.where("split = 'heldout'").select("env_id").distinct().collect()
    assert [r[0] for r in held] == ["e7"]
    assert out.where("split is null").isEmpty()


def test_measurements(tiny):
    steps = tiny.range(51).select(
        F.lit("s").alias("stem"), F.col("id").alias("step"), (F.col("id") * 0.1).alias("time"),
        F.array(F.col("id") * 0.3, F.lit(0.0), F.lit(0.0)).alias("p"),
    )
    r = m.measure(steps).first()
    assert r["n_timesteps"] == 51
    assert (r["total_time_s"], r["sample_rate_hz"], r["path_length_m"]) == pytest.approx((5.0, 10.0, 15.0))
    one = m.measure(steps.where("step = 0")).first()
    assert (one["total_time_s"], one["dt_s"], one["sample_rate_hz"], one["path_length_m"]) == (0.0, None, None, 0.0)


def test_latest_wins_and_solve_info_join(spark):
    info = spark.createDataFrame(
        [("x", "failed", 0), ("x", "ok", 1), ("y", "ok", 1), (None, "z", 2), ("", "z", 3)], "stem string, solver_status string, seq int"
    )
    out = {r["stem"]: r["solver_status"] for r in m.latest_wins(info, "stem", ["seq"]).collect()}
    assert out == {"x": "ok", "y": "ok"}


def test_grid_and_coverage(spark):
    seeds = spark.createDataFrame([(1390851128, 0), (5, 1)], "env_seed bigint, forest_type int")
    grid = m.expected_grid(seeds)
    first = [r["stem"] for r in grid.where("env_seed = 1390851128").orderBy("idx").collect()]
    assert len(first) == 9 and first[0] == "forest_000_f0_g15_0_0_m0p5_v0_0_0_s1390851128"
    assert first[3] == "forest_003_f0_g15_n3_0_m0p5_v1_0_0_s1390851128"
    assert first[8] == "forest_008_f0_g15_3_0_m0p6_v0_0_0_s1390851128"
    made = grid.where("env_seed = 5 or idx < 2").select("stem", F.when(F.col("idx") == 1, 0).otherwise(9).alias("length"))
    out = {r["env_seed"]: tuple(r)[1:] for r in m.coverage(grid, made, "env_seed").collect()}
    assert out == {1390851128: (9, 2, 7, False), 5: (9, 9, 0, False)}
    assert m.missing_stems(grid, made).count() == 7 and m.produced_stems(grid, made).count() == 11


def test_generation_accounting(spark):
    jobs = spark.createDataFrame(
        [("a", 0, False, False), ("b", 1, False, False), ("c", 0, True, False), ("d", 0, False, False), ("e", 0, False, True)],
        "job string, returncode int, timed_out boolean, skipped boolean",
    )
    stems = spark.createDataFrame(
        [("a", "s1", True), ("a", "s2", False), ("b", "s3", True), ("c", "s4", True), ("d", "s5", False), ("e", "s6", True)],
        "job string, stem string, produced boolean",
    )
    r = m.generation_accounting(jobs, stems).first()
    assert tuple(r) == (5, 4, 3, 3, 2)


def test_timestep_check(spark):
    df = spark.createDataFrame([(0.1,), (0.0,), (NAN,), (0.7,), (0.2,)], "dt double")
    got = [r[0] for r in df.select(m.timestep_check(F.col("dt"), F.lit(10.0), F.lit(1.0))).collect()]
    assert got == [[], ["dt_not_positive"], ["dt_not_positive"], ["dt_out_of_bounds", "dt_mismatch"], ["dt_mismatch"]]
    with pytest.raises(ValueError):
        m.timestep_check(F.col("dt"), F.lit(10.0))


def test_summary(spark):
    df = record(spark).unionByName(record(spark, stem="b", solver_status="Solver_Failed", split=None))
    got = {(r["section"], r["value"]): r["n"] for r in m.summary_counts(df).collect()}
    assert got["totals", "n_pass"] == 1 and got["totals", "n_environments"] == 1
    assert got["rejection_reasons", "solver_status"] == 1 and got["splits_trajectories", "train"] == 1
    assert got["sample_rate_hz", "10.0"] == 2
    q = m.summary_quantiles(spark.createDataFrame([(float(i),) for i in range(6)], "v double"), "v").first()
    assert (q["min"], q["p25"], q["median"], q["p75"], q["max"], q["mean"]) == (0, 1, 2, 4, 5, 2.5)


@pytest.mark.parametrize("n", [0, 1, 7, 10, 99])
def test_exact_split_counts(n):
    got = np.diff([0, *m._exact_bounds(n, (0.8, 0.1, 0.1))])
    assert got.sum() == n and all(abs(c - n * f) <= 1 for c, f in zip(got, (0.8, 0.1, 0.1)))
    assert list(np.diff([0, *m._exact_bounds(2, (0.4, 0.4, 0.2))])) == [1, 1, 0]
