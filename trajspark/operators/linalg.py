"""Distributed second moments, ridge fits and R² scores over array columns.

Tasks reduce their Arrow batches to one small matrix each; matrices are summed by (row, column) key in
the JVM, so no task receives all partials. Only d x d results reach the driver, where NumPy solves them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.arrow import matrix, strings

#: Tasks whose partial matrices one group adds up.
FAN_IN = 32
_PARTIAL = pa.schema([("task", pa.int64()), ("part", pa.string()), ("cells", pa.list_(pa.float64()))])


def _partial(task: int, parts: dict[str, np.ndarray]) -> pa.RecordBatch:
    cells = [v.reshape(-1) for v in parts.values()]
    ends = pa.array(np.cumsum([0, *map(len, cells)]), pa.int32())
    flat = pa.array(np.concatenate(cells) if cells else np.zeros(0), pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array([task] * len(cells), pa.int64()), pa.array(list(parts), pa.string()), pa.ListArray.from_arrays(ends, flat)],
        schema=_PARTIAL,
    )


_KIND = "task bigint, part string, cells array<double>"


def folded_parts(
    df: DataFrame, columns: Sequence[str], reduce_batch, combine, levels: int = 2, per_task: bool = False
) -> DataFrame:
    """Partial arrays (task, part, cells): ``reduce_batch(batch) -> {name: array}``, combined two by two.

    With ``per_task`` each task calls ``reduce_batch()`` once for a function that may keep rows between its
    batches. A task combines its own batches; tasks then fold by FAN_IN, ``levels`` times, so one array is left per
    FAN_IN**levels tasks and no group holds more than FAN_IN.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        acc: dict[str, np.ndarray] = {}
        reduce = reduce_batch() if per_task else reduce_batch
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for name, value in reduce(batch).items():
                value = np.asarray(value, dtype=np.float64)
                acc[name] = combine(acc[name], value) if name in acc else value
        yield _partial(TaskContext.get().partitionId(), acc)

    partials = df.select(*columns).mapInArrow(task, _KIND)
    for _ in range(levels):
        partials = fold_parts(partials.withColumn("task", F.expr(f"task div {FAN_IN}")), combine)
    return partials


def fold_parts(partials: DataFrame, combine) -> DataFrame:
    """Combines the arrays of equal (task, part), in a fixed order."""

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        arrays = sorted((np.asarray(row.values) for row in table.column("cells")), key=lambda x: x.tobytes())
        total = arrays[0]
        for more in arrays[1:]:
            total = combine(total, more)
        return pa.Table.from_batches([_partial(key[0].as_py(), {key[1].as_py(): total})])

    return partials.groupBy("task", "part").applyInArrow(fold, _KIND)


def summed_parts(df: DataFrame, columns: Sequence[str], reduce_batch, per_task: bool = False) -> DataFrame:
    """(part, pos, v): sums of the arrays that ``reduce_batch`` makes of every batch."""
    partials = folded_parts(df, columns, reduce_batch, np.add, per_task=per_task)
    cells = partials.select("part", F.posexplode("cells").alias("pos", "v"))
    return cells.groupBy("part", "pos").agg(F.sum("v").alias("v"))


def collect_parts(parts: DataFrame) -> dict[str, np.ndarray]:
    """Summed matrices on the driver: one entry per matrix cell, independent of the row count."""
    table = parts.toArrow()
    names = table.column("part").to_numpy(zero_copy_only=False)
    pos, v = table.column("pos").to_numpy(), table.column("v").to_numpy()
    out = {}
    for name in dict.fromkeys(names):
        pick = names == name
        flat = np.zeros(int(pos[pick].max()) + 1)
        flat[pos[pick]] = v[pick]
        out[name] = flat
    return out


def split_means(df: DataFrame, arrays: Sequence[str], split: str) -> dict[str, dict[str, np.ndarray]]:
    """{split: {array: mean vector, "n": [rows]}} for a handful of splits."""

    def reduce_batch(batch):
        labels, out = strings(batch, split), {}
        data = {a: matrix(batch, a) for a in arrays}
        for s in set(labels):
            pick = labels == s
            out[f"{s}|n"] = np.array([pick.sum()], dtype=float)
            for a, x in data.items():
                out[f"{s}|{a}"] = x[pick].sum(axis=0)
        return out

    sums = collect_parts(summed_parts(df, [split, *arrays], reduce_batch))
    means: dict[str, dict[str, np.ndarray]] = {}
    for name, value in sums.items():
        s, a = name.split("|", 1)
        means.setdefault(s, {})[a] = value if a == "n" else value / sums[f"{s}|n"][0]
    return means


def gram(df: DataFrame, x: str, centre: np.ndarray | None = None) -> DataFrame:
    """Long-form (i, j, v) of the sum of outer products, upper triangle, optionally centred."""

    def reduce_batch(batch):
        data = matrix(batch, x)
        data = data if centre is None else data - centre
        return {f"{data.shape[1]}": data.T @ data}

    cells = summed_parts(df, [x], reduce_batch)
    d = F.col("part").cast("int")
    return cells.select(
        F.floor(F.col("pos") / d).cast("int").alias("i"), (F.col("pos") % d).cast("int").alias("j"), "v"
    ).where(F.col("i") <= F.col("j"))


def symmetric(cells: DataFrame) -> np.ndarray:
    """d x d matrix on the driver from its upper-triangle cells."""
    t = cells.toArrow()
    i, j, v = (t.column(c).to_numpy() for c in ("i", "j", "v"))
    d = int(max(i.max(), j.max())) + 1
    out = np.zeros((d, d))
    out[i, j] = v
    out[j, i] = v
    return out


def covariance(df: DataFrame, x: str) -> tuple[DataFrame, int]:
    """Sample covariance cells (i <= j) and the row count; two passes, so no cancellation."""
    mean = split_means(df.withColumn("_s", F.lit("all")), [x], "_s")
    n = int(mean["all"]["n"][0])
    return gram(df, x, mean["all"][x]).withColumn("v", F.col("v") / max(n - 1, 1)), n


def ridge_solve(xx: np.ndarray, xy: np.ndarray, alpha: float) -> np.ndarray:
    """Slopes of centred ridge; the intercept is unpenalised and follows from the means."""
    return np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)


def r2_from_sums(ss_res: np.ndarray, ss_tot: np.ndarray, constant: float) -> np.ndarray:
    """Per-channel R²; channels without variance get ``constant`` (NaN or 0)."""
    live = ss_tot > 1e-12
    return np.where(live, 1.0 - ss_res / np.where(live, ss_tot, 1.0), constant)


def r2_per_channel(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """R² per channel of two array columns, entirely in the JVM; NaN for constant channels."""
    rows = df.select(
        *by, F.posexplode(F.arrays_zip(F.col(actual).alias("y"), F.col(predicted).alias("f"))).alias("channel", "c")
    ).select(*by, "channel", F.col("c.y").cast("double").alias("y"), F.col("c.f").cast("double").alias("f"))
    gap = F.col("y") - F.col("f")
    sums = rows.groupBy(*by, "channel").agg(
        F.sum(gap * gap).alias("ss_res"), (F.var_pop("y") * F.count("*")).alias("ss_tot")
    )
    return sums.select(
        *by,
        "channel",
        F.when(F.col("ss_tot") > 1e-12, 1.0 - F.col("ss_res") / F.col("ss_tot"))
        .otherwise(F.lit(float("nan")))
        .alias("r2"),
    )


def apply_linear(x: Column | str, weights: np.ndarray, bias: np.ndarray) -> Column:
    """x @ weights + bias as a JVM array expression (for small weight matrices)."""
    x = F.col(x) if isinstance(x, str) else x
    outs = []
    for k in range(weights.shape[1]):
        w = F.array(*[F.lit(float(v)) for v in weights[:, k]])
        outs.append(
            F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(bias[k])), lambda acc, v: acc + v)
        )
    return F.array(*outs)


def centred_r_factor(df: DataFrame, x: str, mean: np.ndarray, fan_in: int = 256) -> np.ndarray:
    """Triangular factor of the centred rows, by tall-skinny QR.

    Every task folds its batches into one d x d factor. Groups of ``fan_in`` factors fold again on the
    executors, twice, so the driver sees one factor per ``fan_in``² input tasks.
    """
    d = len(mean)
    schema = "part bigint, r array<double>"

    def fold(blocks: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, d))
        for block in blocks:
            r = np.linalg.qr(np.concatenate([r, block]), mode="r")
        return r

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = fold(matrix(b, x) - mean for b in batches if b.num_rows)
        yield _factor(TaskContext.get().partitionId(), r)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        rows = np.array(table.column("r").to_pylist(), dtype=np.float64).reshape(-1, d)
        return pa.Table.from_batches([_factor(key[0].as_py(), fold(iter([rows])))])

    factors = df.select(x).mapInArrow(task, schema)
    for _ in range(2):
        grouped = factors.withColumn("part", F.expr(f"part div {fan_in}")).groupBy("part")
        factors = grouped.applyInArrow(merge, schema)
    rows = factors.select("r").toArrow().column("r").to_pylist()
    return fold(iter([np.array(rows, dtype=np.float64).reshape(-1, d)]))


def _factor(part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * len(r), pa.int64()),
            pa.array([row.tolist() for row in r], pa.list_(pa.float64())),
        ],
        names=["part", "r"],
    )
