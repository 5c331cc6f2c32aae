"""Arrow batches as NumPy matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A fixed-width array column (possibly nested) as float64 of shape (rows, ...).

    NULL rows, NULL entries and rows of different widths are errors: left out, they would shift the rest.
    """
    col = batch.column(batch.schema.get_field_index(name))
    shape = [len(col)]
    while pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
        if col.null_count:
            raise ValueError(f"{name} has {col.null_count} NULL vectors")
        widths = np.unique(np.diff(np.asarray(col.offsets)))
        if len(widths) > 1:
            raise ValueError(f"{name} has rows of different widths: {widths.tolist()}")
        shape.append(int(widths[0]) if len(widths) else 0)
        col = col.flatten()
    if col.null_count:
        raise ValueError(f"{name} has {col.null_count} NULL entries")
    return np.asarray(col.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(shape)


def strings(batch: pa.RecordBatch, name: str) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return np.array(col.to_pylist(), dtype=object)
