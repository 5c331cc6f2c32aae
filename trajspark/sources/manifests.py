"""Manifest, solver-record, log and result files, and the manifest build itself."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators.logs import parse_solver_log
from trajspark.operators.manifest import (
    apply_splits,
    latest_wins,
    measure,
    with_identity,
    with_solve_info,
)
from trajspark.plans.scratch import cut_lineage
from trajspark.schema import EPOCH_LOG, MANIFEST, RESULTS, SOLVE_INFO, SystemParams
from trajspark.sources.corpus import Scan, discover, headers, params_listing, scan_csv, to_steps

MANIFEST_VERSION = 1
#: Folder of one append to a sidecar, followed by its number.
APPEND_SEQ = "append_seq"
#: Run results in one file of ``write_result_arrays``.
RUNS_PER_FILE = 4096
MEASURED = ["time", "sol_x_0", "sol_x_1", "sol_x_2"]


def build_manifest(
    spark: SparkSession,
    csv_root: str,
    params_root: str | None = None,
    subdirs: Sequence[str] | None = None,
    solve_info: DataFrame | None = None,
    seed: int | None = None,
    **split_options,
) -> DataFrame:
    """One record per ``csv_root/<subdir>/*.csv``, measured, identified and (with a seed) split.

    Unreadable files stay in the manifest with ``extra.csv_read_error`` and no measurements.
    """
    roots = [csv_root] if subdirs is None else [f"{csv_root.rstrip('/')}/{s}" for s in subdirs]
    listing = cut_lineage(discover(spark, roots))
    files = listing.select(
        "csv_path",
        F.element_at(F.split("csv_path", "/"), -2).alias("subdir"),
        F.regexp_extract("csv_path", r"([^/]+)\.[^./]+$", 1).alias("stem"),
    )
    depth = len(csv_root.rstrip("/").split("/"))
    files = files.where(
        F.element_at(F.split("csv_path", "/"), -3) == F.lit(csv_root.rstrip("/").split("/")[depth - 1])
    )
    scan: Scan = scan_csv(spark, roots, MEASURED, heads=headers(spark, roots, listing=listing))
    measured = measure(to_steps(scan.rows), "csv_path")
    manifest = (
        with_identity(files)
        .join(measured, "csv_path", "left")
        .join(scan.bad_files, "csv_path", "left")
        .withColumn(
            "n_timesteps",
            F.when(F.col("error").isNull(), F.coalesce("n_timesteps", F.lit(0))),  # header only
        )
        .withColumn(
            "extra",
            F.when(
                F.col("error").isNotNull(), F.create_map(F.lit("csv_read_error"), F.col("error"))
            ).otherwise(F.create_map().cast("map<string,string>")),
        )
        .drop("error")
    )
    if params_root is not None:
        manifest = manifest.join(params_listing(spark, params_root), ["subdir", "stem"], "left")
    else:
        manifest = manifest.withColumn("yaml_path", F.lit(None).cast("string"))
    if solve_info is not None:
        # An unreadable file is returned before its solver record is looked up.
        manifest = with_solve_info(manifest, solve_info)
        for c in ("solver_status", "iterations", "solve_time_s"):
            manifest = manifest.withColumn(c, F.when(F.col("n_timesteps").isNotNull(), F.col(c)))
        manifest = manifest.withColumn(
            "status_source",
            F.when(F.col("n_timesteps").isNotNull(), F.col("status_source")).otherwise("unknown"),
        )
    else:
        manifest = manifest.withColumns(
            {
                "solver_status": F.lit(None).cast("string"),
                "iterations": F.lit(None).cast("bigint"),
                "solve_time_s": F.lit(None).cast("double"),
                "status_source": F.lit("unknown"),
            }
        )
    manifest = manifest.withColumn("manifest_version", F.lit(MANIFEST_VERSION))
    if seed is None:
        manifest = manifest.withColumn("split", F.lit(None).cast("string"))
    else:
        manifest = apply_splits(manifest, seed, **split_options)
    return manifest.select(*[f.name for f in MANIFEST.fields], "extra")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; Spark's commit publishes the folder only when every task is done."""
    columns = sorted(manifest.columns)
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    manifest.select(text.alias("value")).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows; blank lines are skipped and unknown keys folded under the recorded ``extra``."""
    known = [f.name for f in MANIFEST.fields] + ["extra"]
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(
        F.from_json("value", MANIFEST).alias("r"),
        F.from_json("value", "map<string,string>").alias("all"),
        F.from_json(F.get_json_object("value", "$.extra"), "map<string,string>").alias("extra"),
    )
    empty = F.create_map().cast("map<string,string>")
    extra = F.coalesce("extra", empty)
    unknown = F.map_filter("all", lambda k, _: ~k.isin(known) & ~F.array_contains(F.map_keys(extra), k))
    return parsed.select(
        "r.*", F.map_concat(extra, F.coalesce(unknown, empty)).alias("extra")
    ).withColumns(
        {
            "status_source": F.coalesce("status_source", F.lit("unknown")),
            "manifest_version": F.coalesce("manifest_version", F.lit(MANIFEST_VERSION)),
        }
    )


def read_solve_info(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Latest solver record per stem; absent paths are skipped.

    Later paths win over earlier ones, within a path the later append (its ``append_seq`` folder), then the
    file written later, then the later line.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    present = []
    for path in paths:
        p = hadoop.Path(path)
        if p.getFileSystem(conf).exists(p):
            present.append(path)
    out = None
    for ordinal, path in enumerate(present):
        source = F.col("_metadata.file_path")
        lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
            F.lit(ordinal).alias("_file"),
            F.regexp_extract(source, f"/{APPEND_SEQ}=([0-9]+)/", 1).try_cast("bigint").alias("_seq"),
            F.col("_metadata.file_modification_time").alias("_time"),
            source.alias("_path"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line"),
            F.from_json("value", SOLVE_INFO).alias("r"),
        )
        out = lines if out is None else out.unionByName(lines)
    if out is None:
        return spark.createDataFrame([], SOLVE_INFO)
    order = ["_file", "_seq", "_time", "_path", "_block", "_line"]
    flat = out.select("r.*", *order)
    return latest_wins(flat, "stem", order).drop(*order)


def _claim(spark: SparkSession, folder: str) -> int:
    """The next number of ``folder`` that no other writer holds: its marker is created exclusively, or the next tried."""
    jvm = spark._jvm
    claims = jvm.org.apache.hadoop.fs.Path(f"{folder}/_claims")
    store = claims.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(claims)
    names = [f.getPath().getName() for p in (claims, claims.getParent()) for f in store.listStatus(p)]
    number = max((int(n.removeprefix(f"{APPEND_SEQ}=")) for n in names if n.removeprefix(f"{APPEND_SEQ}=").isdigit()), default=0) + 1
    while True:
        marker = jvm.org.apache.hadoop.fs.Path(claims, f"{number:06d}")
        try:
            if store.getUri().getScheme() == "file":  # only the operating system creates exclusively there
                local = jvm.java.nio.file.Paths.get(marker.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createFile(local, spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
            else:
                store.create(marker, False).close()
            return number
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            number += 1


def append_solve_info(info: DataFrame, path: str) -> int:
    """Adds records in a folder of their own and returns its number; any number of writers may append at once.

    The records are written under a hidden name first. The writer then claims the next number and renames its
    folder to it, so readers see whole appends in the order of their claims. A writer that dies leaves a
    hidden folder or an unused number, which nobody reads.
    """
    spark = info.sparkSession
    pending = f"{path}/_pending-{uuid.uuid4().hex}"
    info.write.json(pending)
    number = _claim(spark, path)
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (pending, f"{path}/{APPEND_SEQ}={number:06d}"))
    store = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.rename(source, target):
        raise OSError(f"cannot rename {pending} to {target}")
    return number


def read_solver_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines (log, line_no, line) in file order, without holding a whole log in one row."""
    from trajspark.plans.ordering import dense_step

    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("log"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    return dense_step(lines, "log", ["_block", "_id"], "line_no").drop("_block", "_id")


def solve_info_from_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_solver_log(read_solver_logs(spark, path))


def read_epoch_log(spark: SparkSession, path: str, stage: int | None = None) -> DataFrame:
    log = spark.read.schema(EPOCH_LOG).json(path)
    return log if stage is None else log.where(F.col("stage") == stage)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Run results: a JSON array (or one object) per file, unpacked by its suffix (``.gz``)."""
    return spark.read.schema(RESULTS).option("multiLine", "true").json(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_result_arrays(df: DataFrame, path: str, runs: int = RUNS_PER_FILE, compression: str = "none") -> None:
    """Files of one JSON array each, of at most ``runs`` rows, so that no task holds more than that as text.

    The keys repeat in every run: ``gzip`` makes the text about eight times smaller.
    """
    texts = df.select(F.to_json(F.struct(*df.columns)).alias("value"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, runs):
                rows = batch.column(0).slice(at, runs).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([f"[{','.join(rows)}]"])], names=["value"])

    packed = texts.mapInArrow(pack, "value string")
    packed.write.option("maxRecordsPerFile", 1).option("compression", compression).text(path)


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_params(spark: SparkSession, path: str) -> SystemParams:
    """Constants from top-level ``key: number`` YAML lines; other keys are ignored, gravity has a default."""
    line = r"^([A-Za-z_]\w*)\s*:\s*([-+.\deE]+)\s*(?:#.*)?$"
    names = list(SystemParams.__dataclass_fields__)
    key = F.regexp_extract("value", line, 1)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    pairs = spark.read.text(path).withColumn("at", place).where(key.isin(names))
    last = pairs.groupBy(key.alias("k")).agg(
        F.max_by(F.regexp_extract("value", line, 2).try_cast("double"), "at").alias("v")
    )
    return params_from({r["k"]: r["v"] for r in last.collect()}, optional=("gravity",))  # a row per constant


def params_from(values: dict, optional: Sequence[str] = ()) -> SystemParams:
    """Constants by name; all must be present (unless optional) and positive."""
    names = list(SystemParams.__dataclass_fields__)
    missing = [n for n in names if values.get(n) is None and n not in optional]
    if missing:
        raise KeyError(f"missing physical constants: {missing}")
    return SystemParams(**{n: float(values[n]) for n in names if values.get(n) is not None})

