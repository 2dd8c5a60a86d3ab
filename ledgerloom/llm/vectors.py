"""Vector columns of Arrow batches as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, float64 matrix) for each length of vector in a list column.

    Vectors that are null, empty or hold a null or a non-finite component are left out.
    """
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        values = flat[begin[rows][:, None] + np.arange(d)]
        good = np.isfinite(values).all(1)
        if good.any():
            yield rows[good], values[good]


def packed(rows: np.ndarray) -> pa.Array:
    """A binary column with the bytes of each row of a matrix."""
    data = np.ascontiguousarray(rows)
    width = data.dtype.itemsize * data.shape[1]
    at = np.arange(len(data) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def unpacked(column: list[bytes], kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)
