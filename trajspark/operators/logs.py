"""Solver-log parsing: lines between two anchors form one solve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.text import file_name_stem, log_line_fields, solve_succeeded
from trajspark.plans.ordering import running_sum

FIELDS = ["f_solve_time", "f_status", "f_iterations", "f_total_time"]


def segment_by_anchor(
    df: DataFrame, key: str, is_anchor: Column, step: str = "step", out: str = "block"
) -> DataFrame:
    """Block number of each row: how many anchors lie strictly before it (an anchor closes its block)."""
    return running_sum(df, key, F.when(is_anchor, 1).otherwise(0), out, step, inclusive=False)


def closed_blocks(
    df: DataFrame, key: str, is_anchor: Column, fields: dict[str, Column], step: str = "step", size: str | None = None
) -> DataFrame:
    """One row per closed block with the last non-NULL value of every field, and its row count as ``size``."""
    blocks = segment_by_anchor(df.withColumn("_anchor", is_anchor), key, F.col("_anchor"), step)
    return (
        blocks.groupBy(key, "block")
        .agg(
            F.bool_or("_anchor").alias("_closed"),
            *([F.count("*").alias(size)] if size else []),
            *[
                F.max_by(v, F.when(v.isNotNull(), F.col(step))).alias(name)
                for name, v in fields.items()
            ],
        )
        .where("_closed")
        .drop("_closed")
    )


def parse_solver_log(lines: DataFrame, key: str = "log", step: str = "line_no", text: str = "line") -> DataFrame:
    """Solve records (log, block, stem, status, iterations, times, succeeded) of log lines."""
    typed = lines.select(key, step, text).withColumns(log_line_fields(F.col(text)))
    names = [*FIELDS, "f_anchor", "f_anchor_path"]
    solves = closed_blocks(
        typed, key, F.col("f_anchor").isNotNull(), {c: F.col(c) for c in names}, step
    )
    return solves.select(
        key,
        "block",
        file_name_stem(F.col("f_anchor_path")).alias("stem"),
        F.col("f_status").alias("solver_status"),
        F.col("f_iterations").alias("iterations"),
        F.col("f_solve_time").alias("solve_time_s"),
        F.col("f_total_time").alias("total_time_s"),
        solve_succeeded(F.col("f_anchor"), F.col("f_status")).alias("succeeded"),
        F.lit("solver_log").alias("status_source"),
    )
