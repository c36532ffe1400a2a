"""Whitening of embeddings from the singular values of the centred rows.

Exact integer sums give the means. Every task turns its centred rows, block by block, into one triangle R by QR;
the triangles of the tasks are stacked and reduced in groups of 16 until one is left, so no covariance is formed and no task sees
more than 16 of them. What is left has the size of the dimension alone, whatever the number of rows: it is made
bidiagonal, and its singular values and vectors (see ``bidiagonal``) give the directions. A last pass projects the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.bidiagonal import EPS, leading
from vitrine.llm.vectors import matrix, scaled, usable
from vitrine.session import landed

FAN_IN = 16
BLOCK = 4096
_LONG = 2**63 - 1
_RESULT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


class Grid:
    """How entries become longs: floor(scale * entry) + offset."""

    def __init__(self, width: int, scale: int = 1024, offset: int = 100_000):
        self.width, self.scale, self.offset = width, scale, offset

    def longs(self, lists: pa.Array) -> np.ndarray:
        return scaled(matrix(lists, self.width), self.scale).astype(np.int64) + self.offset


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """Centred rows, and per row the exact sum of (n*x - S)^2; None where that does not fit a long."""
    d = x.shape[1]
    most = max((abs(int(v)) for v in (x.max(initial=0), x.min(initial=0))), default=0) * n + max(map(abs, sums), default=0)
    if most**2 * max(d, 1) < _LONG:
        off = x * n - np.array(sums, np.int64)
        return off / n, (off * off).sum(axis=1).tolist()
    off = np.array([[n * int(v) - s for v, s in zip(row, sums, strict=True)] for row in x], object).reshape(x.shape)
    squares = [sum(v * v for v in row) for row in off]
    return (off / n).astype(np.float64), [s if s <= _LONG else None for s in squares]


def triangle(stack: np.ndarray) -> np.ndarray:
    """R of a QR factorisation, always as tall as wide."""
    d = stack.shape[1]
    r = np.linalg.qr(stack, mode="r")
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def column_sums(rows: DataFrame, grid: Grid) -> tuple[int, list[int]]:
    """Number of rows and exact sum per dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * grid.width
        for batch in batches:
            x = grid.longs(batch["vector"])
            n += len(x)
            wide = len(x) and float(np.abs(x).max(initial=0)) * len(x) >= 2.0**62
            more = x.astype(object).sum(axis=0) if wide else x.sum(axis=0)
            sums = [a + int(b) for a, b in zip(sums, more, strict=True)]
        if n:
            yield pa.RecordBatch.from_pylist([{"dim": -1, "total": str(n)}] + [{"dim": i, "total": str(s)} for i, s in enumerate(sums)])

    found = rows.select("vector").mapInArrow(partial, "dim bigint, total string").groupBy("dim")
    totals = found.agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))
    got = {r["dim"]: int(r["total"]) for r in totals.collect()}  # one row per dimension
    return got.get(-1, 0), [got.get(i, 0) for i in range(grid.width)]


def joint_triangle(rows: DataFrame, grid: Grid, n: int, sums: list[int]) -> np.ndarray:
    """R of all centred rows: blocks in a task, then the tasks' triangles in a tree."""
    d = grid.width

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            centred, _ = deviations(grid.longs(batch["vector"]), n, sums)
            for at in range(0, len(centred), BLOCK):
                block = centred[at : at + BLOCK]
                r = triangle(block if r is None else np.vstack([r, block]))
        if r is not None:
            yield pa.RecordBatch.from_pylist([{"place": TaskContext.get().partitionId(), "r": r.ravel().tolist()}], schema)

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")  # the order of the stack, and so the last bits, do not depend on the shuffle
        r = triangle(np.vstack([matrix(group["r"], d * d).reshape(-1, d)]))
        return pa.Table.from_pylist([{"place": group["place"][0].as_py() // FAN_IN, "r": r.ravel().tolist()}], schema)

    schema = pa.schema([("place", pa.int64()), ("r", pa.list_(pa.float64()))])
    triangles = landed(rows.select("vector").mapInArrow(of_task, "place bigint, r array<double>"), "triangles")
    width = (triangles.agg(F.max("place")).first()[0] or 0) + 1
    while width > 1:
        triangles = triangles.groupBy(F.floor(F.col("place") / FAN_IN)).applyInArrow(merge, "place bigint, r array<double>")
        width = -(-width // FAN_IN)
    return np.array(triangles.first()["r"]).reshape(d, d)


def whiten(
    rows: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, offset: int = 100_000
) -> DataFrame:
    """Per row and component up to ``k``: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry are dropped; all others are fitted and projected.
    Entries become floor(scale * entry) + offset. Vectors shorter than the longest are read as ending in zeros. With
    fewer than ``k`` dimensions there are as many components. A component without variance (equal rows, constant or
    dependent dimensions, fewer rows than dimensions) has a null ``whitened`` and counts neither in the error; its
    ``explained`` is 0. ``deviation`` is null where the exact sum does not fit a long. Rows that repeat an id, or have none, are
    kept as they are. Other columns are not read, whatever their names; an empty table, or one of empty vectors, gives
    an empty result.
    """
    spark = rows.sparkSession
    kept = rows.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).where(usable("vector"))
    width = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    if width == 0:
        return spark.createDataFrame([], _RESULT)
    grid = Grid(width, scale, offset)
    n, sums = column_sums(kept, grid)
    r = joint_triangle(kept, grid, n, sums)
    squares, directions = leading(r, min(k, width))
    total = float((r * r).sum())
    explained = [float(s / total) if total else 0.0 for s in squares]
    there = squares > (width * EPS) ** 2 * max(float(squares[0]), np.finfo(float).tiny)
    there &= squares > width * EPS * total
    deviation_scale = np.sqrt(np.where(there, squares, 1.0) / n)
    onto = directions / deviation_scale
    c = len(squares)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                centred, exact = deviations(grid.longs(batch["vector"]), n, sums)
                flat = pa.array((centred @ onto).ravel())
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * c)
                values = pa.ListArray.from_arrays(offsets, flat)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], pa.array(exact, pa.int64()), values], ["vec_id", "deviation", "values"]
                )

    projected = landed(kept.mapInArrow(project, "vec_id bigint, deviation bigint, values array<double>"), "whitened")
    error = identity_error(projected, c, np.flatnonzero(there))
    facts = F.array(
        *[
            F.struct(F.lit(i + 1).alias("component"), F.lit(bool(there[i])).alias("there"), F.lit(explained[i]).alias("explained"))
            for i in range(c)
        ]
    )
    one = projected.select("vec_id", "deviation", F.explode(F.arrays_zip(F.col("values").alias("value"), facts.alias("fact"))).alias("x"))
    return one.select(
        "vec_id",
        F.col("x.fact.component").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        F.when(F.col("x.fact.there"), F.col("x.value")).alias("whitened"),
        F.col("x.fact.explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def identity_error(projected: DataFrame, c: int, there: np.ndarray) -> float | None:
    """Largest entry of the measured covariance of the projected values minus the identity; None without components."""
    if not len(there):
        return None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, outer = 0, np.zeros(c), np.zeros((c, c))
        for batch in batches:
            if batch.num_rows:
                w = matrix(batch["values"], c)
                n, sums, outer = n + len(w), sums + w.sum(axis=0), outer + w.T @ w
        if n:
            flat = np.concatenate([[n], sums, outer.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "total"])

    found = projected.select("values").mapInArrow(partial, "place bigint, total double").groupBy("place")
    # 1 + c + c*c numbers
    flat = np.array([r["total"] for r in found.agg(F.sum("total").alias("total")).orderBy("place").collect()])
    n, sums, outer = flat[0], flat[1 : c + 1] / flat[0], flat[c + 1 :].reshape(c, c) / flat[0]
    return float(np.abs((outer - np.outer(sums, sums) - np.eye(c))[np.ix_(there, there)]).max())
