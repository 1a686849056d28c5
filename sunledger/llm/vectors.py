"""What the vector operators share: integer components, exactly, from Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this magnitude a component's integer fits a long.
LARGEST = 2.0**62


def takes_part(vector: Column, scale: int) -> Column:
    """True if a vector is there and no component is null, not finite or beyond a long once scaled (NaN is above every number)."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(LARGEST / scale))), F.lit(False))


def integers(column: pa.Array, scale: int, width: int | None = None) -> np.ndarray:
    """floor(scale * x) of every component as a matrix of int64; shorter vectors end in zeros. `column` holds vectors that take part."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64)
    lengths = np.asarray(column.value_lengths(), dtype=np.int64)
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def as_long(values: np.ndarray) -> pa.Array:
    """Exact integers as longs, null where a long can't hold one."""
    if values.dtype != object:
        return pa.array(values.astype(np.int64), pa.int64())
    return pa.array([int(v) if -(2**63) <= v < 2**63 else None for v in values], pa.int64())
