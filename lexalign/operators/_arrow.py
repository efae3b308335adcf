"""Small Arrow <-> numpy helpers used inside ``mapInArrow`` / ``applyInPandas`` tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def list_to_matrix(col: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """A ``list<double|float>`` column of equally long lists as an ``(n, d)`` float64 matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, dim or 0), dtype=np.float64)
    if col.null_count:
        raise ValueError("null vector in a vector column")
    lengths = np.diff(col.offsets.to_numpy())
    d = int(lengths[0]) if dim is None else dim
    if not np.all(lengths == d):
        raise ValueError(f"vectors of unequal length (expected {d})")
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, d)


def matrix_to_list(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    offsets = pa.array(np.arange(0, n * d + 1, d, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m, dtype=np.float64).ravel()))
