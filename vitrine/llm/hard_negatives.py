"""Hard negatives by a secondary sort.

Anchors meet all rows in cells: blocks of anchors against blocks of rows, each cell one cogrouped task that
multiplies two integer matrices. A score leaves its cell as a packed key (anchor, descending score, role, id) of
25 bytes whose byte order is the order wanted. The keys are repartitioned by anchor and sorted within the
partitions, and an iterator reads them in that order: a positive opens a window of scores, a row of another label
is written for every open window it lies in, and a window closes when it is full or passed. The iterator holds the
open windows of one anchor and nothing else.

Two such passes are made, the first for the positives alone. Then every cell knows the windows of its anchors and
passes on, per window, its own first rows only: any row of the result is among the first rows of its cell, so
nothing is lost, and the keys shuffled grow with the number of cells instead of the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import parts
from vitrine.llm.vectors import matrix, scaled, usable
from vitrine.session import landed

POSITIVE, NEGATIVE = 0, 1
KEY_BYTES = 25
_SIGN = np.uint64(1 << 63)
_LONG = 2**63 - 1
_KEYS = "anchor_id bigint, key binary"


@dataclass(frozen=True)
class HardNegativeRules:
    """How many positives and negatives are taken, and the window a positive opens.

    A negative lies in the window when ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    ``scale`` makes integers of the components. The last two numbers are the sizes of a cell and bound the memory of
    a task; results do not depend on them.
    """

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    cell_anchors: int = 8192
    cell_rows: int = 65_536

    def window(self, score: int) -> tuple[int, int]:
        return -(-self.low * score // 100), self.high * score // 100


def _ordered(numbers: np.ndarray) -> np.ndarray:
    """Longs as unsigned numbers of the same order."""
    return numbers.astype(np.int64).view(np.uint64) ^ _SIGN


def pack(anchor: int, scores: np.ndarray, role: int, ids: np.ndarray) -> np.ndarray:
    """Keys of one anchor, one row of 25 bytes each; bytes compare as (anchor, falling score, role, id)."""
    out = np.empty((len(ids), KEY_BYTES), np.uint8)
    head = _ordered(np.array([anchor], np.int64)).astype(">u8").view(np.uint8)
    out[:, 0:8] = head
    out[:, 8:16] = (~_ordered(scores)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 16] = role
    out[:, 17:25] = _ordered(ids).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out


def unpack(keys: list[bytes]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Anchors, scores, roles and ids of packed keys."""
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY_BYTES)

    def long(at: int) -> np.ndarray:
        return np.ascontiguousarray(raw[:, at : at + 8]).view(">u8").ravel().astype(np.uint64)

    anchors = (long(0) ^ _SIGN).view(np.int64).tolist()
    scores = (~long(8) ^ _SIGN).view(np.int64).tolist()
    return anchors, scores, raw[:, 16].tolist(), (long(17) ^ _SIGN).view(np.int64).tolist()


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of integer rows as longs; one that does not fit a long becomes the nearest that does."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    most = float(np.abs(left).max()) * float(np.abs(right).max()) * left.shape[1]
    if most < 2.0**53:  # every partial sum is an exact double
        return (left @ right.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in left], object)
    other = np.array([[int(x) for x in row] for row in right], object)
    return np.array([[min(max(x, -_LONG), _LONG) for x in row] for row in whole @ other.T], np.int64)


def first_rows(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` rows in ``among`` by falling score; of equal scores, those that come first."""
    if len(among) > k:
        values = scores[among]
        limit = np.partition(values, len(values) - k)[len(values) - k]
        among = among[values >= limit]
    return among[np.argsort(-scores[among], kind="stable")[:k]]


def _cell(anchors: pa.Table, rows: pa.Table, rules: HardNegativeRules, width: int, second: bool) -> Iterator[pa.Table]:
    order = np.argsort(rows["id"].to_numpy(), kind="stable")  # ties then go to the smaller id by place
    ids, labels = rows["id"].to_numpy()[order], rows["label"].to_numpy()[order]
    values = scaled(matrix(rows["vector"], width), rules.scale)[order]
    own, own_labels = anchors["id"].to_numpy(), anchors["label"].to_numpy()
    own_values = scaled(matrix(anchors["vector"], width), rules.scale)
    windows = anchors["positives"].to_pylist() if second else []
    step = max(1, 4_000_000 // max(1, len(ids)))  # scores held at once
    for at in range(0, len(own), step):
        keys, owners = [], []
        for i, scores in enumerate(products(own_values[at : at + step], values), at):
            anchor = int(own[i])
            same = labels == own_labels[i]
            if second:
                found = np.array([], np.int64)
                for score in {p["score"] for p in windows[i]}:
                    low, high = rules.window(score)
                    if low <= high:
                        inside = np.flatnonzero(~same & (scores >= low) & (scores <= high))
                        found = np.union1d(found, first_rows(scores, inside, rules.negatives))
            else:
                found = first_rows(scores, np.flatnonzero(same & (ids != anchor)), rules.positives)
            if len(found):
                found = found.astype(np.int64)
                keys.append(pack(anchor, scores[found], NEGATIVE if second else POSITIVE, ids[found]))
                owners.append(np.full(len(found), anchor, np.int64))
        if keys:
            packed = np.concatenate(keys)
            raw = pa.Array.from_buffers(pa.binary(KEY_BYTES), len(packed), [None, pa.py_buffer(packed.tobytes())])
            yield pa.table({"anchor_id": np.concatenate(owners), "key": raw.cast(pa.binary())})


def _cells(anchors: DataFrame, rows: DataFrame, rules: HardNegativeRules, width: int, second: bool) -> DataFrame:
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(_cell(left, right, rules, width, second)) if left.num_rows and right.num_rows else []
        if not found:
            return pa.table({"anchor_id": pa.array([], pa.int64()), "key": pa.array([], pa.binary())})
        return pa.concat_tables(found)

    return anchors.groupBy("a", "r").cogroup(rows.groupBy("a", "r")).applyInArrow(work, _KEYS)


def _sorted(keys: DataFrame) -> DataFrame:
    """The secondary sort: all keys of an anchor in one partition, in the order of their bytes."""
    return keys.repartition(parts(keys.sparkSession), "anchor_id").select("key").sortWithinPartitions("key")


def _first_positives(keys: DataFrame, most: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = None, 0
        for batch in batches:
            out = []
            for anchor, score, _, i in zip(*unpack(batch["key"].to_pylist()), strict=True):
                now, taken = (now, taken) if anchor == now else (anchor, 0)
                if taken < most:
                    taken += 1
                    out.append({"anchor_id": anchor, "score": score, "id": i})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([(c, pa.int64()) for c in ("anchor_id", "score", "id")]))

    return _sorted(keys).mapInArrow(read, "anchor_id bigint, score bigint, id bigint")


_RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def windowed(rows: Iterator[tuple[int, int, int, int]], rules: HardNegativeRules) -> Iterator[tuple]:
    """Result rows of keys (anchor, score, role, id) that come in order; one anchor's open windows are held."""
    now, open_ = None, []
    for anchor, score, role, i in rows:
        if anchor != now:
            now, open_ = anchor, []
        if role == POSITIVE:
            low, high = rules.window(score)
            if low <= high:
                open_.append([i, score, low, high, 0])
            continue
        full = False
        for window in open_:
            positive, positive_score, low, high, n = window
            if low <= score <= high:
                window[4] = n + 1
                yield anchor, positive, n + 1, i, positive_score, score
            full |= score < low or window[4] >= rules.negatives
        if full:
            open_ = [w for w in open_ if score >= w[2] and w[4] < rules.negatives]


def _emitted(keys: DataFrame, rules: HardNegativeRules) -> DataFrame:
    names = [x.split()[0] for x in _RESULT.split(", ")]
    types = [pa.int32() if x.endswith(" int") else pa.int64() for x in _RESULT.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, int, int]]:
            for batch in batches:
                if batch.num_rows:
                    yield from zip(*unpack(batch["key"].to_pylist()), strict=True)

        out: list[tuple] = []
        for row in windowed(rows(), rules):
            out.append(row)
            if len(out) == 10_000:
                yield _batch(out, names, types)
                out = []
        if out:
            yield _batch(out, names, types)

    return _sorted(keys).mapInArrow(read, _RESULT)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    rules: HardNegativeRules | None = None,
    id_col: str = "vec_id",
    label: str | Column = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """Per anchor and positive the first negatives of its window: anchor_id, positive_id, rank, negative_id and scores.

    ``is_anchor`` marks anchors by ``id_col``. A row without id or label, without a vector, or with a null or
    non-finite entry takes no part. Vectors shorter than the longest are read as ending in zeros, an empty one as
    zeros alone. Scores are inner products of floor(scale * entry); ties go to the smaller id. Of anchors that repeat
    an id the one of the smallest (label, vector) counts; other repeated rows each count as a row, but never as a
    positive of an anchor of their own id. An anchor without positives, or a positive without rows in its window, gives
    no row; a positive with a negative score has an empty window. Other columns are not read, whatever their names;
    an empty table gives an empty result.
    """
    rules = rules or HardNegativeRules()
    kept = rows.select(
        F.col(id_col).cast("bigint").alias("id"),
        (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        is_anchor.alias("is_anchor"),
    )
    kept = landed(kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector")), "vectors")
    spark = kept.sparkSession
    n, width = kept.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    first = F.min(F.struct("label", "vector")).alias("first")
    anchors = landed(kept.where("is_anchor").groupBy("id").agg(first).select("id", "first.*"), "anchors")
    n_anchors = anchors.count()
    blocks = max(1, -(-n_anchors // rules.cell_anchors))
    # no fewer cells than keep the cluster busy, unless they would be small
    cells = max(1, -(-n // rules.cell_rows), min(parts(spark), n // 2048))

    def placed(df: DataFrame) -> DataFrame:
        """Anchors with the block they are in, once for each block of rows."""
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("a")
        return df.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("r"))

    # by place in the landed table, so that no id or vector, however frequent, fills one block
    block_of_row = F.pmod(F.monotonically_increasing_id(), F.lit(cells)).cast("int").alias("r")
    each = kept.select("id", "label", "vector", block_of_row)
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("a"))
    found = landed(_first_positives(_cells(placed(anchors), each, rules, width, False), rules.positives), "positives")
    # at most rules.positives structs an anchor
    windows = found.groupBy("anchor_id").agg(F.collect_list(F.struct("score", "id")).alias("positives"))
    with_windows = anchors.join(windows, anchors["id"] == windows["anchor_id"]).drop("anchor_id")
    negatives = _cells(placed(with_windows), each, rules, width, True)
    return _emitted(_packed_positives(found).unionByName(negatives), rules)


def _packed_positives(found: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, scores, ids = (batch[c].to_numpy() for c in ("anchor_id", "score", "id"))
            keys = [
                pack(int(a), scores[j : j + 1], POSITIVE, ids[j : j + 1]).tobytes() for j, a in enumerate(anchors.tolist())
            ]
            yield pa.RecordBatch.from_arrays([batch["anchor_id"], pa.array(keys, pa.binary())], ["anchor_id", "key"])

    return found.mapInArrow(work, _KEYS)
