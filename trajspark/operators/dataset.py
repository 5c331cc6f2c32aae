"""Windowed dataset: training-only statistics, normalisation, build audit, write and read."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.functions.arrow import matrix, strings
from trajspark.functions.flatmap import flat_map
from trajspark.operators.kinematics import check_vectors, row_delta
from trajspark.operators.linalg import fold_parts, folded_parts
from trajspark.operators.windows import (
    FIELDS,
    POSITION_FIELDS,
    WindowConfig,
    WindowStarts,
    extract_windows,
    flat_history,
    pack_targets,
    target_of,
    target_slices,
    total_width,
    window_count,
    window_rows,
)
from trajspark.plans.ordering import with_halo
from trajspark.plans.quantiles import quantiles
from trajspark.plans.scratch import cut_lineage
from trajspark.schema import SPLIT_NAMES, TARGETS, SystemParams

ARRAYS = ["state_hist", "action_hist", "action_future", "state_future", "targets"]


def channel_moments(df: DataFrame, arrays: Sequence[str], by: str | None = None) -> DataFrame:
    """count, mean and summed squared deviation of every channel (last axis) of every array.

    Each task keeps one small accumulator per array (and value of ``by``, a column with few values); the
    accumulators fold in groups of bounded size, so nothing grows with the number of tasks.
    """
    group = by or "_group"

    def reduce_batch(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        labels = strings(batch, by) if by else np.full(batch.num_rows, "all", dtype=object)
        out = {}
        for name in arrays:
            data = matrix(batch, name)
            for label in set(labels):
                x = data if by is None else data[labels == label]
                out[f"{name}|{label}"] = _moments(x.reshape(-1, x.shape[-1]))
        return out

    partials = folded_parts(df, [*arrays, *([by] if by else [])], reduce_batch, _merge_moments)
    return _moment_rows(partials, by)


def _moment_rows(partials: DataFrame, by: str | None = None) -> DataFrame:
    group = by or "_group"
    whole = fold_parts(partials.withColumn("task", F.lit(0).cast("bigint")), _merge_moments)
    size = F.expr("(size(cells) - 1) div 2").cast("int")
    rows = whole.select(
        F.substring_index("part", "|", 1).alias("array_name"),
        F.expr("substring(part, instr(part, '|') + 1)").alias(group),
        F.get("cells", F.lit(0)).alias("n"),
        F.posexplode(F.arrays_zip(F.slice("cells", 2, size).alias("mean"), F.slice("cells", size + 2, size).alias("m2"))).alias("channel", "s"),
    )
    return rows.select(*([by] if by else []), "array_name", "channel", "n", "s.mean", "s.m2")


def _moments(x: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Row count, channel means and summed squared deviations in one array; rows count ``weight`` times."""
    weight = np.ones(len(x)) if weight is None else weight
    total = weight.sum()
    mean = weight @ x / total
    return np.concatenate([[total], mean, weight @ (x - mean) ** 2])


def _merge_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n, total = a[0], a[0] + b[0]
    (mean_a, m2_a), (mean_b, m2_b) = (x[1:].reshape(2, -1) for x in (a, b))
    gap = mean_b - mean_a
    return np.concatenate([[total], mean_a + gap * (b[0] / total), m2_a + m2_b + gap**2 * (n * b[0] / total)])


def window_moments(
    rows: DataFrame,
    config: WindowConfig = WindowConfig(),
    key: str = "stem",
    step: str = "step",
    valid: str | None = "valid",
    action: str = "j",
    targets: bool = True,
) -> DataFrame:
    """``channel_moments`` of the windows of ``rows``, without building a window.

    Trajectories flow through each task in order of (key, segment, step). A window is a first row whose frame
    stays in its segment and holds no invalid row. How many windows read a row in their past, and how many in
    their future, are two counts made from the starts; they weigh the row's channels. Positions are relative
    to the anchor, so they are taken slot by slot as differences of two rows. A task holds a batch and one
    frame of rows.
    """
    fields = [FIELDS[f][0] for f in config.observed]
    vectors = ["p", *fields, action]
    if targets:
        rows, vectors = rows.withColumn("_target", pack_targets()), [*vectors, "_target"]
    position = [f in POSITION_FIELDS for f in config.observed]
    at, width = target_slices()["p_quad"]
    gap = config.stride

    def per_task():
        stream = WindowStarts(config, vectors)

        def reduce(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            data, first = stream(batch)
            n = len(data["p"])
            if not len(first):
                return {}
            out = {}
            anchor = first + (config.history - 1) * gap
            origin = data["p"][anchor]
            for part, slots in (("hist", range(config.history)), ("future", range(config.history, config.span))):
                times = sum(np.bincount(first + k * gap, minlength=n) for k in slots).astype(float)
                read = times > 0
                pieces = []
                for field, relative in zip(fields, position):
                    if not relative:
                        pieces.append(_moments(data[field][read], times[read]))
                        continue
                    moved = [_moments(data[field][first + k * gap] - origin) for k in slots]
                    pieces.append(functools.reduce(_merge_moments, moved))
                mean, m2 = (np.concatenate([x[1:].reshape(2, -1)[i] for x in pieces]) for i in (0, 1))
                out[f"state_{part}|all"] = np.concatenate([pieces[0][:1], mean, m2])
                out[f"action_{part}|all"] = _moments(data[action][read], times[read])
            if targets:
                packed = data["_target"][anchor]
                packed[:, at : at + width] -= origin
                out["targets|all"] = _moments(packed)
            return out

        return reduce

    ordered = window_rows(rows, config, vectors, key, step, valid)
    return _moment_rows(folded_parts(ordered, ordered.columns, per_task, _merge_moments, per_task=True))


def row_norm_stats(
    rows: DataFrame,
    config: WindowConfig = WindowConfig(),
    key: str = "stem",
    source_split: str = "train",
    eps: float = 1e-6,
    split: str = "split",
    **options,
) -> DataFrame:
    """``norm_stats`` of the windows of flat-mapped ``rows``, from the rows of the source split alone."""
    return _scales(window_moments(rows.where(F.col(split) == source_split), config, key, **options), source_split, eps)


def norm_stats(
    windows: DataFrame,
    arrays: Sequence[str] = ARRAYS,
    source_split: str = "train",
    eps: float = 1e-6,
    split: str = "split",
) -> DataFrame:
    """Per-channel mean and population std of the source split; near-constant channels get std 1."""
    return _scales(channel_moments(windows.where(F.col(split) == source_split), arrays), source_split, eps)


def _scales(m: DataFrame, source_split: str, eps: float) -> DataFrame:
    std = F.sqrt(F.col("m2") / F.col("n"))
    return m.select(
        "array_name",
        "channel",
        "mean",
        F.when(std < eps, 1.0).otherwise(std).alias("std"),
        F.lit(source_split).alias("source_split"),
        F.col("n").cast("bigint").alias("n_samples"),
    )


def stats_row(stats: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Small stats table (channels of a few arrays) as {array: (means, stds)}."""
    out: dict[str, dict[int, tuple[float, float]]] = {}
    for r in stats.select("array_name", "channel", "mean", "std").collect():
        out.setdefault(r["array_name"], {})[r["channel"]] = (r["mean"], r["std"])
    return {
        name: ([ch[i][0] for i in sorted(ch)], [ch[i][1] for i in sorted(ch)])
        for name, ch in out.items()
    }


def _literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _per_channel(df: DataFrame, name: str, vector: Callable[[Column], Column]) -> Column:
    """Applies ``vector`` to the array itself, or to each row of a nested array."""
    nested = df.schema[name].dataType.simpleString().count("array<") == 2
    return F.transform(name, vector) if nested else vector(F.col(name))


def _scale(mean: Sequence[float], std: Sequence[float]) -> Callable[[Column], Column]:
    return lambda v: F.zip_with(
        F.zip_with(v, _literal(mean), lambda a, b: a - b), _literal(std), lambda a, b: a / b
    )


def _unscale(mean: Sequence[float], std: Sequence[float]) -> Callable[[Column], Column]:
    return lambda v: F.zip_with(
        F.zip_with(v, _literal(std), lambda a, b: a * b), _literal(mean), lambda a, b: a + b
    )


def normalise(df: DataFrame, stats: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """(x - mean) / std per channel for every array that has statistics."""
    return df.withColumns({k: _per_channel(df, k, _scale(*ms)) for k, ms in stats.items()})


def denormalise(
    df: DataFrame, stats: dict[str, tuple[list[float], list[float]]], normalised: bool = True
) -> DataFrame:
    """Inverse of ``normalise``; identity for a dataset that was stored unnormalised."""
    if not normalised:
        return df
    return df.withColumns({k: _per_channel(df, k, _unscale(*ms)) for k, ms in stats.items()})


def trajectory_audit(
    steps: DataFrame,
    config: WindowConfig = WindowConfig(),
    key: str = "stem",
    step: str = "step",
    time: str = "time",
    split: str = "split",
    valid: str = "valid",
) -> DataFrame:
    """Per trajectory: candidate and surviving windows, outcome and sampling rate (Hz).

    Surviving windows are counted from run lengths of valid rows, so no window is built. Only records
    with a train, val or test split count.
    """
    rows = steps.where(F.col(split).isin(SPLIT_NAMES)).select(key, split, step, time, valid)
    spaced = row_delta(rows, time, "_gap", key, step)
    base = rows.groupBy(key, split).agg(F.count("*").alias("n"))
    dt = quantiles(spaced, [key], {"_gap": {"dt": 0.5}})
    alive = surviving_windows(rows, config, key, step, valid)
    hz = F.when(
        F.col("dt").isNotNull() & ~F.isnan("dt") & (F.col("dt") > 0), F.bround(1.0 / F.col("dt"), 0)
    ).otherwise(0.0)
    n_windows = F.coalesce("n_valid", F.lit(0)) if config.require_valid else F.col("n_candidate")
    return (
        base.join(dt, key, "left")
        .join(alive, key, "left")
        .withColumn("n_candidate", window_count(F.col("n"), config))
        .withColumn("n_windows", n_windows)
        .select(
            key,
            split,
            "n",
            "n_candidate",
            "n_windows",
            F.when(F.col("n_candidate") == 0, "too_short")
            .when(F.col("n_windows") == 0, "all_invalid")
            .otherwise("used")
            .alias("outcome"),
            F.when(F.col("n_candidate") > 0, hz.cast("bigint")).alias("hz"),
        )
    )


def surviving_windows(
    rows: DataFrame, config: WindowConfig, key: str, step: str, valid: str
) -> DataFrame:
    """Windows per trajectory whose strided reads are all valid."""
    reach, k = config.reach, config.stride
    flags = rows.select(key, step, F.when(F.col(valid), 0).otherwise(1).alias("_bad"))
    seg = with_halo(flags, key, before=0, after=reach, step=step)
    # Reads of one window share step mod stride, so count bad rows along that residue.
    w = (
        Window.partitionBy(key, "seg", F.col(step) % k)
        .orderBy(step)
        .rowsBetween(0, config.span - 1)
    )
    counted = seg.withColumns({"_b": F.sum("_bad").over(w), "_c": F.count("*").over(w)})
    return (
        counted.where(F.col("own") & (F.col("_c") == config.span) & (F.col("_b") == 0))
        .groupBy(key)
        .agg(F.count("*").alias("n_valid"))
    )


def build_report(audit: DataFrame, load_errors: DataFrame | None = None) -> DataFrame:
    """(section, name, n) rows: windows and trajectories per split, skips, drops and sample rates."""
    used = F.col("outcome") == "used"
    entry = lambda section, name, n: F.struct(
        F.lit(section).alias("section"), name.cast("string").alias("name"), n.cast("bigint").alias("n")
    )
    one = F.lit(1)
    entries = F.array(
        entry("windows", F.col("split"), F.col("n_windows")),
        entry("trajectories", F.col("split"), F.when(used, 1).otherwise(0)),
        F.when(~used, entry("skipped", F.col("outcome"), one)),
        entry("dropped", F.lit("invalid_windows"), F.col("n_candidate") - F.col("n_windows")),
        F.when(F.col("hz").isNotNull(), entry("sample_rate_hz", F.col("hz"), one)),
    )
    rows = audit.select(F.inline(F.array_compact(entries)))
    if load_errors is not None:
        rows = rows.unionByName(
            load_errors.select(F.inline(F.array(entry("skipped", F.lit("load_error"), one))))
        )
    return rows.groupBy("section", "name").agg(F.sum("n").alias("n"))


def rate_mode(audit: DataFrame, default: int = 10) -> DataFrame:
    """Most frequent sampling rate (lowest on ties), or the default for an empty audit."""
    counts = audit.where(F.col("hz").isNotNull()).groupBy("hz").agg(F.count("*").alias("n"))
    return counts.agg(
        F.coalesce(F.max_by("hz", F.struct("n", -F.col("hz"))), F.lit(default)).alias("hz")
    )


def build_windows(
    steps: DataFrame,
    manifest: DataFrame,
    config: WindowConfig = WindowConfig(),
    params: SystemParams = SystemParams(),
    key: str = "csv_path",
    step: str = "step",
) -> DataFrame:
    """Steps of records with a known split -> windows with packed targets, carrying ``split``.

    A trajectory is its file: stems may repeat in other folders.
    """
    known = manifest.where(F.col("split").isin(SPLIT_NAMES)).select(key, "split")
    steps = check_vectors(steps, dict.fromkeys(["p", "v", "a", "j"], 3))
    mapped = flat_map(steps.join(known, key), params)
    names = ["stem"] if key != "stem" and "stem" in steps.columns else []
    return extract_windows(mapped, config, key, step, targets=True, carry=["split", *names])


@contextmanager
def _writers(spark: SparkSession, count: int) -> Iterator[None]:
    """Partitioned writes keep up to ``count`` files open in a task instead of sorting its wide rows by partition."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(count))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_dataset(
    windows: DataFrame,
    path: str,
    config: WindowConfig = WindowConfig(),
    params: SystemParams = SystemParams(),
    normalize: bool = True,
    audit: DataFrame | None = None,
    extra_metadata: dict | None = None,
    stats: DataFrame | None = None,
) -> None:
    """Float32 windows partitioned by split, statistics, metadata and the build report.

    ``stats`` are those of ``row_norm_stats`` where the rows are at hand, otherwise they are taken from the
    windows. Refuses when the training split is empty: there would be nothing to normalise by.
    """
    spark = windows.sparkSession
    stats = cut_lineage(norm_stats(windows) if stats is None else stats)
    if stats.isEmpty():
        raise ValueError("training split has no windows; check splits and trajectory lengths")
    stats.write.mode("overwrite").json(f"{path}/normalization")
    scaled = normalise(windows, stats_row(stats)) if normalize else windows
    stored = scaled.withColumns(
        {
            name: F.col(name).cast("array<float>" if name == "targets" else "array<array<float>>")
            for name in ARRAYS
        }
    )
    with _writers(spark, len(SPLIT_NAMES) + 1):
        stored.write.mode("overwrite").partitionBy("split").parquet(f"{path}/windows")
    counts = {
        r["split"]: r["n"]
        for r in spark.read.parquet(f"{path}/windows")
        .groupBy("split")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    meta = {
        "window": {
            "history": config.history,
            "horizon": config.horizon,
            "stride": config.stride,
            "observed_fields": list(config.observed),
            "obs_dim": config.obs_dim,
            "channel_names": config.channel_names(),
            "require_valid": config.require_valid,
        },
        "targets": {
            "names": [t[0] for t in TARGETS],
            "total_dim": total_width(),
            "slices": {k: [at, at + w] for k, (at, w) in target_slices().items()},
        },
        "system_params": vars(params),
        "normalized": normalize,
        "splits": {s: counts.get(s, 0) for s in SPLIT_NAMES},
    }
    if audit is not None:
        report = build_report(audit)
        report.write.mode("overwrite").json(f"{path}/build_report")
        rows = [r for r in report.collect()]  # a few dozen counters
        meta["trajectories"] = {r["name"]: r["n"] for r in rows if r["section"] == "trajectories"}
        meta["sample_rates_hz"] = {r["name"]: r["n"] for r in rows if r["section"] == "sample_rate_hz"}
    meta.update(extra_metadata or {})
    one = spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string")
    one.coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


class WindowedDataset:
    """Read access to one split of a written dataset (partition-pruned Parquet)."""

    def __init__(self, spark: SparkSession, path: str, split: str):
        table = spark.read.parquet(f"{path}/windows")
        self.windows = table.where(F.col("split") == split)
        if self.windows.isEmpty():
            known = [r["split"] for r in table.select("split").distinct().collect()]
            if split not in known and split not in SPLIT_NAMES:
                raise FileNotFoundError(f"no split {split!r}; found {sorted(known)}")
        self.metadata = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
        self.stats = spark.read.json(f"{path}/normalization")

    def __len__(self) -> int:
        return self.windows.count()

    def target(self, name: str) -> DataFrame:
        return self.windows.select("stem", "anchor_index", target_of("targets", name).alias(name))

    def flat_inputs(self) -> DataFrame:
        return self.windows.select("stem", "anchor_index", flat_history("state_hist").alias("x"))

    def denormalised(self) -> DataFrame:
        return denormalise(self.windows, stats_row(self.stats), self.metadata["normalized"])
