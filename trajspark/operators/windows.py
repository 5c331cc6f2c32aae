"""History/future windows over trajectory rows, packed targets and nested target windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.arrow import matrix
from trajspark.functions.vectors import array_sub, first_two_columns
from trajspark.plans.ordering import segment_window, with_halo
from trajspark.schema import TARGETS

# Observable field -> (source array column, channel name stem); position is anchor-relative.
FIELDS = {"payload_pos": ("p", "p"), "payload_vel": ("v", "v"), "payload_acc": ("a", "a")}
POSITION_FIELDS = ["payload_pos"]


@dataclass(frozen=True)
class WindowConfig:
    history: int = 10
    horizon: int = 20
    stride: int = 1
    observed: tuple[str, ...] = ("payload_pos", "payload_vel", "payload_acc")
    require_valid: bool = True

    def __post_init__(self):
        for name in ("history", "horizon", "stride"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if not self.observed:
            raise ValueError("at least one observed field is needed")
        unknown = [f for f in self.observed if f not in FIELDS]
        if unknown:
            raise ValueError(f"unknown observed fields {unknown}; known: {list(FIELDS)}")

    @property
    def span(self) -> int:
        return self.history + self.horizon

    @property
    def reach(self) -> int:
        return (self.span - 1) * self.stride

    @property
    def obs_dim(self) -> int:
        return 3 * len(self.observed)

    def channel_names(self) -> list[str]:
        return [f"{FIELDS[f][1]}_{axis}" for f in self.observed for axis in "xyz"]


def window_count(n: Column, config: WindowConfig) -> Column:
    return F.greatest(n - config.reach, F.lit(0))


def resampled_length(n: Column, stride: int = 1) -> Column:
    if stride < 1:
        raise ValueError("stride must be at least 1")
    return F.ceil(n / stride).cast("bigint")


def strided(df: DataFrame, stride: int, step: str = "step") -> DataFrame:
    """Every ``stride``-th row of each trajectory, starting with the first."""
    if stride < 1:
        raise ValueError("stride must be at least 1")
    return df.where(F.col(step) % stride == 0)


def raw_windows(
    df: DataFrame,
    read: list[str],
    config: WindowConfig,
    key: str = "stem",
    step: str = "step",
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per window start that fits its trajectory: ``reads``, the span rows it touches.

    ``carry`` columns are constant per trajectory and ride along. Rows are cut per segment with a
    forward halo, so windows cross segment edges but a task holds one segment at most.
    """
    carry = carry or []
    slim = df.select(key, step, *carry, *[c for c in read if c not in (key, step)])
    seg = with_halo(slim, key, before=0, after=config.reach, step=step)
    frame = segment_window(key, step).rowsBetween(0, config.reach)
    entry = F.struct(F.col(step).alias("step"), *[c for c in read if c != step])
    rows = seg.withColumn("_w", F.collect_list(entry).over(frame)).where(
        f"own AND size(_w) = {config.reach + 1}"
    )
    strided_reads = f"transform(sequence(0, {config.span - 1}), i -> _w[i * {config.stride}])"
    return rows.selectExpr(
        key,
        *carry,
        f"{step} AS start",
        f"{'_w' if config.stride == 1 else strided_reads} AS reads",
        f"_w[{(config.history - 1) * config.stride}] AS anchor",
        f"{step} + {(config.history - 1) * config.stride} AS anchor_index",
    )


def extract_windows(
    df: DataFrame,
    config: WindowConfig = WindowConfig(),
    key: str = "stem",
    step: str = "step",
    valid: str | None = "valid",
    action: str = "j",
    targets: bool = False,
    carry: list[str] | None = None,
) -> DataFrame:
    """History and future arrays per window, anchor-relative, with invalid windows dropped.

    ``targets`` also packs the probe targets of the anchor row (the flat-map columns must be present).
    """
    fields = [FIELDS[f][0] for f in config.observed]
    gate = valid if (valid and config.require_valid) else None
    read = list(dict.fromkeys(["p", *fields, action] + ([gate] if gate else [])))
    if targets:
        df = df.withColumn("_target", pack_targets())
        read.append("_target")
    rows = raw_windows(df, read, config, key, step, carry)
    if gate:
        rows = rows.where(f"forall(reads, r -> r.{gate})")
    relative = "zip_with(r.{}, anchor.p, (x, o) -> x - o)"
    observed = ", ".join(
        relative.format(FIELDS[f][0]) if f in POSITION_FIELDS else f"r.{FIELDS[f][0]}"
        for f in config.observed
    )
    past = f"slice(reads, 1, {config.history})"
    future = f"slice(reads, {config.history + 1}, {config.horizon})"
    columns = [
        key,
        *(carry or []),
        "anchor_index",
        "anchor.p AS anchor_origin",
        f"transform({past}, r -> concat({observed})) AS state_hist",
        f"transform({past}, r -> r.{action}) AS action_hist",
        f"transform({future}, r -> r.{action}) AS action_future",
        f"transform({future}, r -> concat({observed})) AS state_future",
    ]
    if targets:
        at, width = target_slices()["p_quad"]
        rest = total_width() - at - width
        columns.append(
            f"concat(slice(anchor._target, 1, {at}), "
            f"zip_with(slice(anchor._target, {at + 1}, {width}), anchor.p, (x, o) -> x - o), "
            f"slice(anchor._target, {at + width + 1}, {rest})) AS targets"
        )
    return rows.selectExpr(*columns)


def window_rows(
    rows: DataFrame, config: WindowConfig, vectors: list[str], key: str = "stem", step: str = "step", valid: str | None = "valid"
) -> DataFrame:
    """Rows in order of (key, segment, step) for ``WindowStarts``, each segment with the rows its windows reach."""
    gate = valid if (valid and config.require_valid) else None
    vectors = list(dict.fromkeys(vectors))
    slim = rows.select(key, step, *([gate] if gate else []), *vectors)
    seg = with_halo(slim, key, before=0, after=config.reach, step=step)
    ok = F.coalesce(gate, F.lit(False)) if gate else F.lit(True)
    width = lambda c: total_width() if c == "_target" else 3
    return seg.select(
        F.row_number().over(segment_window(key, step)).alias("_nth"),  # asks Spark for this order
        "own", ok.alias("_ok"),
        # an invalid row is in no window, whatever it holds
        *[F.when(ok, F.col(c)).otherwise(F.array_repeat(F.lit(float("nan")), width(c))).alias(c) for c in vectors],
    )


class WindowStarts:
    """Finds windows in a task's stream of ``window_rows`` batches; keeps one frame of rows between batches."""

    def __init__(self, config: WindowConfig, vectors: list[str]):
        self.config, self.vectors = config, list(dict.fromkeys(vectors))
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The rows at hand, and the first row of every window whose last row has arrived with this batch."""
        flat = ("_nth", "own", "_ok")
        data = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in flat}
        data |= {c: matrix(batch, c) for c in self.vectors}
        if self.kept:
            data = {c: np.concatenate([self.kept[c], x]) for c, x in data.items()}
        reach, n = self.config.reach, len(data["_nth"])
        self.kept = {c: x[max(n - reach, 0) :] for c, x in data.items()}
        starts = max(n - reach, 0)
        # a frame of one segment: numbers of its first and last row differ by its length
        whole = data["_nth"][n - starts :] == data["_nth"][:starts] + reach
        first = np.flatnonzero(data["own"][:starts].astype(bool) & whole)
        bad = np.zeros(len(first), bool)
        for k in range(self.config.span):
            bad |= ~data["_ok"][first + k * self.config.stride].astype(bool)
        return data, first[~bad]


def total_width() -> int:
    return sum(width for _, width, _, _ in TARGETS)


def target_slices() -> dict[str, tuple[int, int]]:
    """Target name -> (offset, width) in the packed array."""
    out, at = {}, 0
    for name, width, _, _ in TARGETS:
        out[name] = (at, width)
        at += width
    return out


def targets_of_kind(kind: str) -> list[str]:
    return [name for name, _, k, _ in TARGETS if k == kind]


def target_table(spark) -> DataFrame:
    """Packed-target layout as a lookup table."""
    rows = [
        (name, kind, target_slices()[name][0], width, text) for name, width, kind, text in TARGETS
    ]
    return spark.createDataFrame(rows, "target string, kind string, offset int, width int, description string")


def pack_targets(origin: Column | None = None) -> Column:
    """All probe targets of a flat-mapped row as one array; position-like entries minus ``origin``."""
    p_quad = F.col("p_quad") if origin is None else array_sub(F.col("p_quad"), origin)
    sources = {
        "v": F.col("v"),
        "a": F.col("a"),
        "j": F.col("j"),
        "cable_dir": F.col("cable_dir"),
        "R_quad_cols": first_two_columns(F.col("R_quad")),
        "p_quad": p_quad,
        "tension_margin": F.array("tension_margin"),
    }
    return F.concat(*[sources[name] for name, _, _, _ in TARGETS])


def target_of(packed: Column | str, name: str) -> Column:
    slices = target_slices()
    if name not in slices:
        raise KeyError(f"unknown target {name!r}; known: {list(slices)}")
    at, width = slices[name]
    return F.slice(packed, at + 1, width)


def nested_target_windows(hist: Column | str, future: Column | str, history: int, horizon: int) -> Column:
    """The ``history``-long windows ending 1..horizon steps after the anchor."""
    joined = F.concat(hist, future)
    return F.transform(
        F.sequence(F.lit(1), F.lit(horizon)), lambda k: F.slice(joined, k + 1, history)
    )


def flat_history(hist: Column | str) -> Column:
    return F.flatten(hist)
