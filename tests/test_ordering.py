import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.plans import ordering
from trajspark.plans.ordering import dense_step, hash_rank, running_sum, segment_window, with_halo
from trajspark.plans.quantiles import quantiles


def skewed(spark, n=400):
    """One key holds three quarters of the rows; order values are shuffled by a hash."""
    return spark.range(n).select(
        F.when(F.col("id") % 4 < 3, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"),
        F.pmod(F.xxhash64("id"), F.lit(50)).alias("a"),
        F.col("id").alias("b"),
    )


def numbered(df):
    return {(r["key"], r["b"]): r["step"] for r in df.collect()}


def expected_steps(df):
    rows = sorted((r["key"], r["a"], r["b"]) for r in df.collect())
    out, seen = {}, {}
    for key, _, b in rows:
        out[key, b] = seen.get(key, 0)
        seen[key] = out[key, b] + 1
    return out


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_step_is_the_same_for_hot_and_plain_keys(tiny, parts):
    df = skewed(tiny)
    assert numbered(dense_step(df.repartition(parts), "key", ["a", "b"])) == expected_steps(df)


def test_halo_gives_every_row_its_full_frame(tiny):
    df = tiny.range(100).select(F.lit("x").alias("key"), F.col("id").alias("step"))
    seg = with_halo(df, "key", before=2, after=3)
    w = segment_window("key").rowsBetween(-2, 3)
    out = seg.withColumn("n", F.count("*").over(w)).where("own").orderBy("step").collect()
    want = [min(i, 2) + 1 + min(99 - i, 3) for i in range(100)]
    assert [r["n"] for r in out] == want


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum_crosses_segments(tiny, inclusive):
    df = tiny.range(100).select(F.lit("x").alias("key"), F.col("id").alias("step"))
    out = running_sum(df, "key", F.col("step"), "s", inclusive=inclusive).orderBy("step").collect()
    total = np.cumsum(np.arange(100))
    assert [r["s"] for r in out] == list(total if inclusive else total - np.arange(100))


def test_hash_rank_is_a_dense_permutation(spark):
    df = spark.range(500)
    a = hash_rank(df, F.col("id"), "r").collect()
    b = hash_rank(df.repartition(7), F.col("id"), "r").collect()
    assert sorted(r["r"] for r in a) == list(range(500))
    assert {r["id"]: r["r"] for r in a} == {r["id"]: r["r"] for r in b}


CASES = {
    "uniform": lambda rng: rng.uniform(0, 1, 600),
    "heavy_tail": lambda rng: np.concatenate([rng.normal(0, 1, 599), [1e300]]),
    "mixed_sign": lambda rng: rng.normal(0, 1, 600) * 10.0 ** rng.integers(-200, 200, 600),
    "ties": lambda rng: rng.integers(0, 3, 600).astype(float),
    "constant": lambda rng: np.full(600, 7.5),
    "close_cluster": lambda rng: 1.0 + rng.uniform(0, 1e-12, 600),
}


@pytest.mark.parametrize("name", list(CASES))
def test_large_group_quantiles_are_exact(tiny, name):
    x = CASES[name](np.random.default_rng(3))
    df = tiny.createDataFrame([(float(v),) for v in x], "x double")
    probs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.99, "e": 1.0}
    got = quantiles(df, [], {"x": probs}).first()
    with np.errstate(over="ignore"):
        want = np.percentile(x, [100 * p for p in probs.values()])
    assert np.allclose([got[k] for k in probs], want, rtol=1e-12, atol=0)
    near = quantiles(df, [], {"x": probs}, "nearest").first()
    s = np.sort(x)
    assert [near[k] for k in probs] == [s[round(p * 599)] for p in probs.values()]


def test_quantiles_mix_hot_and_small_groups_and_skip_nonfinite(tiny):
    rows = [("hot", float(i)) for i in range(200)] + [("s", float(i)) for i in range(9)]
    rows += [("s", float("nan")), ("s", float("inf")), ("none", float("nan"))]
    df = tiny.createDataFrame(rows, "k string, x double").repartition(5)
    out = {r["k"]: r["m"] for r in quantiles(df, ["k"], {"x": {"m": 0.5}}).collect()}
    assert out == {"hot": 99.5, "s": 4.0, "none": None}


def test_quantiles_read_their_input_once(tiny, tmp_path):
    path = str(tmp_path / "v")
    tiny.range(200).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b")).write.parquet(path)
    out = quantiles(tiny.read.parquet(path), ["k"], {"a": {"a50": 0.5}, "b": {"b10": 0.1, "b90": 0.9}})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Scan parquet" not in plan
    assert out.count() == 3


def test_dense_step_deals_large_tables_over_more_tasks(spark, monkeypatch):
    """A task's rows are bounded by their number, however little of a row is shuffled."""
    monkeypatch.setattr(ordering, "TASK_ROWS", 10)
    out = ordering.dense_step(spark.range(300).select((F.col("id") % 50).alias("k"), "id"), "k", ["id"])
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 15 and max(sizes) <= 36
    assert out.where("step <> id div 50").isEmpty()
