"""Zero-copy conversions between Arrow ``list<double>`` columns and 2-D NumPy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def list_to_matrix(col: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """``list<double>`` (equal lengths) -> float64 array of shape (rows, width)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, width or 0))
    if col.null_count:
        raise ValueError("features must not be null")
    offsets = col.offsets.to_numpy()
    start, stop = int(offsets[0]), int(offsets[-1])
    flat = col.values.slice(start, stop - start)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    d = (stop - start) // n
    if d * n != stop - start or not np.all(np.diff(offsets) == d):
        raise ValueError("ragged features: every row needs the same number of features")
    if width is not None and d != width:
        raise ValueError(f"expected {width} features, found {d}")
    return values.reshape(n, d)


def matrix_to_list(m: np.ndarray) -> pa.ListArray:
    m = np.ascontiguousarray(m, dtype=np.float64)
    n, d = m.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32) if n else np.zeros(1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(m.reshape(-1)))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
