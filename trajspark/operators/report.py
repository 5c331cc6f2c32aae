"""Multi-run report tables over result and epoch-log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.operators.windows import targets_of_kind
from trajspark.plans.ordering import broadcast_checked, group_limit
from trajspark.plans.scratch import cut_lineage

# Fixed probe arms, in display order.
ARMS = ["trained", "random_init", "raw_window", "shuffled_labels"]


def recovery_long(results: DataFrame) -> DataFrame:
    """Nested results -> one row per (run, target, arm)."""
    run = ["lambda_sig", "latent_dim", "seed"]
    by_target = results.select(*run, F.explode("recovery").alias("target", "_arms"))
    return by_target.select(*run, "target", F.explode("_arms").alias("arm", "_s")).select(
        *run, "target", "arm", F.col("_s.r2").alias("r2")
    )


def dimensionality_long(results: DataFrame) -> DataFrame:
    return results.select(
        "lambda_sig", "latent_dim", "seed", "final_val_pred", "collapsed",
        F.explode("dimensionality").alias("arm", "_d"),
    ).select("lambda_sig", "latent_dim", "seed", "final_val_pred", "collapsed", "arm", "_d.*")


def mean_std(col: str, name: str) -> list[Column]:
    """Mean and population std; NULLs are skipped."""
    return [F.avg(col).alias(f"{name}_mean"), F.stddev_pop(col).alias(f"{name}_std")]


def seed_spread(long: DataFrame, base_lambda: float, base_width: int) -> DataFrame:
    """Per target: mean and std over seeds for each arm, and trained minus random."""
    rows = long.where((F.col("lambda_sig") == base_lambda) & (F.col("latent_dim") == base_width))
    wide = rows.groupBy("target").pivot("arm", ARMS).agg(*mean_std("r2", "r2"))
    return wide.withColumn(
        "trained_minus_random", F.col("trained_r2_mean") - F.col("random_init_r2_mean")
    )


def width_table(dims: DataFrame, base_lambda: float) -> DataFrame:
    """Allocated width against measured dimensionality, over seeds."""
    trained = F.col("arm") == "trained"
    only = lambda c: F.when(trained, F.col(c))
    return (
        dims.where(F.col("lambda_sig") == base_lambda)
        .groupBy("latent_dim")
        .agg(
            F.avg(only("participation_ratio")).alias("pr_mean"),
            F.stddev_pop(only("participation_ratio")).alias("pr_std"),
            F.avg(only("effective_rank")).alias("er_mean"),
            F.stddev_pop(only("effective_rank")).alias("er_std"),
            F.avg(only("n_components_90pct")).alias("c90_mean"),
            F.avg(only("n_components_99pct")).alias("c99_mean"),
            F.avg(F.when(F.col("arm") == "random_init", F.col("participation_ratio"))).alias(
                "random_pr_mean"
            ),
        )
    )


def lambda_table(results: DataFrame, base_width: int) -> DataFrame:
    """Per λ at one width: prediction loss, participation ratio, nonlinear recovery and collapses.

    A run's scores lie in its own row's maps, so each run is one row from the scan to the only exchange.
    Runs without a trained arm's shape or scores do not count.
    """
    # every map is named once: an expression that names it again builds it again
    arms = F.map_values(F.map_filter("recovery", lambda t, _: t.isin(targets_of_kind("nonlinear"))))
    mean = F.aggregate(
        F.transform(arms, lambda arm: F.try_element_at(arm, F.lit("trained"))["r2"]),
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda acc, v: F.struct((acc["s"] + F.coalesce(v, F.lit(0.0))).alias("s"), (acc["n"] + v.isNotNull().cast("int")).alias("n")),
        lambda acc: F.try_divide(acc["s"], acc["n"]),
    )
    runs = results.where(F.col("latent_dim") == base_width).select(
        "lambda_sig", "final_val_pred", "collapsed",
        F.try_element_at("dimensionality", F.lit("trained"))["participation_ratio"].alias("participation_ratio"),
        mean.alias("recovery"),
    )
    return (
        runs.where("recovery IS NOT NULL AND participation_ratio IS NOT NULL")
        .groupBy("lambda_sig")
        .agg(
            *mean_std("final_val_pred", "pred"),
            *mean_std("participation_ratio", "pr"),
            *mean_std("recovery", "recovery"),
            F.count_if("collapsed").alias("n_collapsed"),
            F.count("*").alias("n_runs"),
        )
    )


def dissociation(table: DataFrame) -> DataFrame:
    """λ with the best prediction against λ with the best recovery (smallest λ on ties)."""
    best = table.agg(
        F.min_by("lambda_sig", F.struct("pred_mean", "lambda_sig")).alias("best_pred_lambda"),
        F.max_by("lambda_sig", F.struct("recovery_mean", -F.col("lambda_sig"))).alias(
            "best_recovery_lambda"
        ),
    )
    return best.withColumn(
        "dissociated", F.col("best_pred_lambda") != F.col("best_recovery_lambda")
    )


def scaling_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fraction").agg(
        F.avg("val_pred").alias("val_pred"),
        F.avg("trained_r2").alias("trained_r2"),
        F.avg("delta").alias("delta"),
        F.count("*").alias("n_runs"),
    )


def weighted_metrics(batches: DataFrame, metrics: list[str], weight: str, by: list[str]) -> DataFrame:
    """Batch metrics averaged by batch size; NULL where the batches' sizes add up to zero."""
    return batches.groupBy(*by).agg(
        *[F.try_divide(F.sum(F.col(m) * F.col(weight)), F.sum(weight)).alias(m) for m in metrics]
    )


def run_summary(log: DataFrame, run: str = "run") -> DataFrame:
    """Last values of each stage per run; the collapsed flag is the last stage-1 record's alarm."""
    one, two = F.col("stage") == 1, F.col("stage") == 2
    last = lambda c, on: F.max_by(F.col(c), F.when(on, F.col("epoch")))
    return log.groupBy(run).agg(
        last("val.loss", one).alias("final_val_loss"),
        last("val.loss_pred", one).alias("final_val_pred"),
        last("val.loss_sigreg", one).alias("final_sigreg"),
        F.coalesce(last("collapse_alarm.triggered", one), F.lit(False)).alias("collapsed"),
        F.count_if(one).alias("epochs_ran"),
        last("residual_abs_mean", two).alias("prober_residual"),
        last("prober_loss", two).alias("prober_loss"),
    )


def best_epoch(log: DataFrame, run: str = "run") -> DataFrame:
    """Epoch of the lowest validation loss, the first on ties."""
    ok = (F.col("stage") == 1) & F.col("val.loss").isNotNull() & ~F.isnan("val.loss")
    return (
        log.where(ok)
        .groupBy(run)
        .agg(
            F.min_by("epoch", F.struct("val.loss", "epoch")).alias("best_epoch"),
            F.min("val.loss").alias("best_val_loss"),
        )
    )


def block_subsample(
    windows: DataFrame, fraction: float, at_least: int, key: str = "stem", index: str = "anchor_index"
) -> DataFrame:
    """The first max(at_least, int(N * fraction)) windows in (trajectory, index) order.

    Trajectories are cut by cumulative window counts; only the one that straddles the limit is trimmed,
    and its rows are ranked within range slices rather than in one task.
    """
    from pyspark.sql import Window

    counts = windows.groupBy(key).agg(F.count("*").alias("_n"))
    parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut_lineage(
        counts.repartitionByRange(parts, key).withColumn("_slice", F.spark_partition_id())
    )
    total = sliced.agg(F.sum("_n")).first()[0] or 0
    want = max(at_least, int(total * fraction))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    offsets = (
        sliced.groupBy("_slice")
        .agg(F.sum("_n").alias("_s"))
        .select("_slice", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_slice").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.join(F.broadcast(offsets), "_slice").select(
        key, "_n", (F.col("_offset") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_at")
    )
    whole = placed.where(F.col("_at") + F.col("_n") <= want).select(key)
    cut = placed.where((F.col("_at") < want) & (F.col("_at") + F.col("_n") > want)).first()
    out = windows.join(broadcast_checked(whole), key, "left_semi")
    if cut is None:
        return out
    straddling = windows.where(F.col(key) == cut[key])
    need = want - cut["_at"]
    if cut["_n"] <= group_limit(windows.sparkSession):
        edge = straddling.orderBy(index).limit(need)
    else:
        from trajspark.plans.ordering import dense_step

        edge = dense_step(straddling, key, [index], "_r").where(F.col("_r") < need).drop("_r")
    return out.unionByName(edge)


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A small report table (one row per target, width or λ) as Markdown text."""
    cols = df.columns
    lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    for row in df.collect():
        cells = [f"{v:.{digits}f}" if isinstance(v, float) else str(v) for v in row]
        lines.append("| " + " | ".join(cells) + " |")
    return "\n".join(lines)
