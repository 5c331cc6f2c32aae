"""Spans found in texts: the column form that detectors return, and what queries read from it."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<kind: string, start: long, end: long, base: boolean>>"
ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
)


def count(kind: str, spans: str = "spans") -> Column:
    """Base spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def joined(spans: Column | str = "spans", base_only: bool = False) -> Column:
    """kind:start:end of each span, comma-joined in the order the detector gave."""
    found = F.filter(spans, lambda s: s["base"]) if base_only else F.col(spans)
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digest(spans: str = "spans") -> Column:
    return F.sha2(joined(spans, base_only=True), 256)


def column(rows: Sequence[Sequence[tuple[str, int, int, bool]]]) -> pa.Array:
    """Arrow column of one list of (kind, start, end, base) per text."""
    flat = [s for row in rows for s in row]
    offsets, n = [0], 0
    for row in rows:
        n += len(row)
        offsets.append(n)
    values = pa.StructArray.from_arrays(
        [
            pa.array([s[0] for s in flat], pa.string()),
            pa.array([s[1] for s in flat], pa.int64()),
            pa.array([s[2] for s in flat], pa.int64()),
            pa.array([s[3] for s in flat], pa.bool_()),
        ],
        fields=list(ARROW.value_type),
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=ARROW)
