"""Vectors in tasks: list columns of Arrow batches as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for a vector that is there and has neither null nor non-finite entries; never null."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as doubles; vectors shorter than ``width`` end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def scaled(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * entry), kept within +-2**62 so that it fits a long."""
    return np.clip(np.floor(rows * scale), -(2.0**62), 2.0**62)
