"""Batch scoring of windows with a caller's encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trajspark.functions.arrow import matrix

BATCH_ROWS = 4096


def score_windows(
    df: DataFrame,
    encoder: Callable[[np.ndarray], np.ndarray],
    hist: str = "state_hist",
    out: str = "x",
) -> DataFrame:
    """Appends ``encoder(batch of H x D histories) -> (rows, latent)`` as an array column."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                z = np.ascontiguousarray(encoder(matrix(part, hist)), dtype=np.float64)
                ends = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
                col = pa.ListArray.from_arrays(ends, pa.array(z.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, col], names=[*part.schema.names, out]
                )

    return df.mapInArrow(task, schema)
