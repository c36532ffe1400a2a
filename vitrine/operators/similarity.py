"""Visual similarity of images from small signatures."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions.text import let
from vitrine.operators.ranking import top_n
from vitrine.session import landed, shuffle_width

GRID = 16
GRAY_CELLS = 64
COLOR_CELLS = 48
COLOR_WEIGHT = 1.5
# Bases that travel inside the plan, rows of one cell, and distances held at once by a task; results do not depend on them.
BASE_BLOCK = 1024
CELL_ROWS = 65_536
SCORES = 4_000_000


def image_signature(pixels: Column) -> Column:
    """struct<gray, color> of 16 x 16 RGB pixels given as 768 numbers, row by row.

    gray: 8 x 8 mean luminance, centred and divided by its standard deviation.
    color: 4 x 4 mean red, green, blue.
    """
    return let(pixels, _signature)


def _signature(pixels: Column) -> Column:
    def channel(cell_row: Column, cell_col: Column, side: int, c: Column) -> list[Column]:
        return [
            F.get(pixels, (((cell_row * side + dy) * GRID) + cell_col * side + dx) * 3 + c).cast("double")
            for dy in range(side)
            for dx in range(side)
        ]

    def luminance(cell: Column) -> Column:
        row, col = F.floor(cell / 8).cast("int"), cell % 8
        red, green, blue = (sum(channel(row, col, 2, F.lit(c)), F.lit(0.0)) for c in range(3))
        return (0.299 * red + 0.587 * green + 0.114 * blue) / 4

    def mean_color(cell: Column) -> Column:
        block, c = F.floor(cell / 3).cast("int"), cell % 3
        return sum(channel(F.floor(block / 4).cast("int"), block % 4, 4, c), F.lit(0.0)) / 16

    def standardize(gray: Column) -> Column:
        mean = F.aggregate(gray, F.lit(0.0), lambda acc, v: acc + v) / GRAY_CELLS
        centred = let(mean, lambda m: F.transform(gray, lambda v: v - m))
        return let(centred, scale)

    def scale(centred: Column) -> Column:
        spread = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda acc, v: acc + v * v) / GRAY_CELLS)
        # a flat image keeps its zeros
        return let(F.when(spread == 0, F.lit(1.0)).otherwise(spread), lambda s: F.transform(centred, lambda v: v / s))

    cells = F.sequence(F.lit(0), F.lit(GRAY_CELLS - 1))
    colors = F.sequence(F.lit(0), F.lit(COLOR_CELLS - 1))
    gray = let(F.transform(cells, luminance), standardize)
    return F.struct(gray.alias("gray"), F.transform(colors, mean_color).alias("color"))


def _square_sum(a: Column, b: Column, scale: float) -> Column:
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) / scale)
    return F.aggregate(diffs, F.lit(0.0), lambda acc, d: acc + d * d)


def signature_distance(gray_a: Column, color_a: Column, gray_b: Column, color_b: Column) -> Column:
    gray = F.sqrt(_square_sum(gray_a, gray_b, 1.0) / GRAY_CELLS)
    color = F.sqrt(_square_sum(color_a, color_b, 255.0) / COLOR_CELLS)
    return gray + COLOR_WEIGHT * color


def rank_similar(signatures: DataFrame, base_id, k: int, key: str = "id") -> DataFrame:
    """The ``k`` nearest items of one item. Its signature (112 numbers) travels inside the plan.

    Items without a signature are skipped; an unknown or unsigned base gives no rows.
    """
    base = signatures.filter((F.col(key) == base_id) & F.col("gray").isNotNull() & F.col("color").isNotNull()).select("gray", "color").first()
    pool = signatures.filter((F.col(key) != base_id) & F.col("gray").isNotNull() & F.col("color").isNotNull())
    if base is None:
        return pool.limit(0).withColumn("d", F.lit(0.0))
    gray, color = (F.array(*[F.lit(float(v)) for v in part]) for part in (base.gray, base.color))
    scored = pool.withColumn("d", signature_distance(F.col("gray"), F.col("color"), gray, color))
    return scored.orderBy("d", key).limit(k)


class _Block:
    """Bases of one block and the ``k`` nearest rows met so far for each, all as arrays."""

    def __init__(self, names: np.ndarray, gray: np.ndarray, color: np.ndarray, k: int):
        order = np.argsort(names, kind="stable")
        self.names, self.gray, self.color, self.k = names[order], gray[order], color[order] / 255.0, k
        self.base, self.name, self.d = np.empty(0, np.int64), names[:0], np.empty(0)

    def meet(self, names: np.ndarray, gray: np.ndarray, color: np.ndarray) -> None:
        """Compare rows with all bases by matrix products, and work out the distances of what can be near exactly."""
        color = color / 255.0
        step = max(1, SCORES // max(1, len(self.names)))
        for at in range(0, len(names), step):
            self._meet(names[at : at + step], gray[at : at + step], color[at : at + step])

    def _meet(self, names: np.ndarray, gray: np.ndarray, color: np.ndarray) -> None:
        def about(x: np.ndarray, y: np.ndarray, cells: int) -> np.ndarray:
            squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
            return np.sqrt(np.maximum(squares, 0.0) / cells)

        d = about(self.gray, gray, GRAY_CELLS) + COLOR_WEIGHT * about(self.color, color, COLOR_CELLS)
        if d.shape[1] > self.k:
            most = np.partition(d, self.k, axis=1)[:, self.k]
            # a base may meet itself, and products lose the last digits
            size = np.sqrt((self.gray**2).sum(1).max() + (gray**2).sum(1).max() + 2.0 * COLOR_CELLS)
            near = d <= (most + 1e-6 * (1.0 + size))[:, None]
        else:
            near = np.ones(d.shape, bool)
        base, row = np.nonzero(near)
        other = self.names[base] != names[row]
        base, row = base[other], row[other]
        exact = np.sqrt(((self.gray[base] - gray[row]) ** 2).sum(1) / GRAY_CELLS) + COLOR_WEIGHT * np.sqrt(
            ((self.color[base] - color[row]) ** 2).sum(1) / COLOR_CELLS
        )
        self._keep(np.concatenate([self.base, base]), np.concatenate([self.name, names[row]]), np.concatenate([self.d, exact]))

    def _keep(self, base: np.ndarray, name: np.ndarray, d: np.ndarray) -> None:
        by_name = np.argsort(name, kind="stable")
        base, name, d = base[by_name], name[by_name], d[by_name]
        order = np.lexsort((d, base))  # stable: of equal distances the smaller name
        base, name, d = base[order], name[order], d[order]
        place = np.arange(len(base)) - np.searchsorted(base, base, side="left")
        kept = place < self.k
        self.base, self.name, self.d = base[kept], name[kept], d[kept]

    def found(self, key: str) -> pd.DataFrame:
        return pd.DataFrame({"base": self.names[self.base], key: self.name, "d": self.d})


def _arrays(pdf: pd.DataFrame, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pdf[key].to_numpy(), np.stack(pdf["gray"].to_numpy()).astype(np.float64), np.stack(pdf["color"].to_numpy()).astype(np.float64)


def rank_similar_many(signatures: DataFrame, bases: DataFrame | Sequence, k: int, key: str = "id") -> DataFrame:
    """The ``k`` nearest items of each base: base, key, d, rank. ``bases`` is a list, or a table with the column ``key``.

    Blocks of bases meet blocks of rows in matrix products, and every task passes on only its own k best per base. Up to
    ``BASE_BLOCK`` bases (112 numbers each) travel to the rows, which are not moved; more are a table that is dealt in
    blocks, and each block of rows meets each block of bases in a task of its own. There is no limit to their number.
    Bases without a signature, or unknown ones, give no rows; repeated bases count once.
    """
    spark = signatures.sparkSession
    key_type = signatures.schema[key].dataType.simpleString()
    schema = f"base {key_type}, {key} {key_type}, d double"
    usable = signatures.filter(F.col("gray").isNotNull() & F.col("color").isNotNull()).select(key, "gray", "color")
    if isinstance(bases, DataFrame):
        wanted = bases.select(F.col(key).cast(key_type)).distinct()
    else:
        wanted = spark.createDataFrame([(b,) for b in dict.fromkeys(bases)], f"{key} {key_type}")
    own = landed(usable.join(wanted, key, "left_semi"), "bases")
    n = own.count()

    if n <= BASE_BLOCK:
        block = own.toPandas()  # at most BASE_BLOCK rows

        def nearest(batches):
            best = _Block(*_arrays(block, key), k) if len(block) else None
            for pdf in batches:
                if best is not None and len(pdf):
                    best.meet(*_arrays(pdf, key))
            if best is not None and len(best.base):
                yield best.found(key)

        scored = usable.mapInPandas(nearest, schema)
    else:
        blocks, rows = -(-n // BASE_BLOCK), landed(usable, "signatures")
        cells = max(shuffle_width(spark), -(-rows.count() // CELL_ROWS))
        # by place in the landed table, so that no key, however frequent, fills one block
        place = F.monotonically_increasing_id()

        def dealt(df: DataFrame, own_cells: int, own_name: str, other_cells: int, other_name: str) -> DataFrame:
            mine = df.withColumn(own_name, F.pmod(place, F.lit(own_cells)).cast("int"))
            return mine.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.lit(other_cells - 1))))

        def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"base": [], key: [], "d": []})
            best = _Block(*_arrays(left, key), k)
            best.meet(*_arrays(right, key))
            return best.found(key)

        left = dealt(own, blocks, "_a", cells, "_r").groupBy("_a", "_r")
        right = dealt(rows, cells, "_r", blocks, "_a").groupBy("_a", "_r")
        scored = left.cogroup(right).applyInPandas(cell, schema)
    return top_n(scored, ["base"], [F.col("d").asc(), F.col(key).asc()], k, salt_by=[key], rank="rank")
