"""Helpers that several corpus operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of all contracts: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: keys up to which a frame of them is broadcast whole
BROADCAST_KEYS = 200_000
#: words of 64 bits that a filter of keys has at most, so that it can be broadcast at any size
FILTER_WORDS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """The text of a row, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a landed frame has at most ``rows`` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast where the landed frame is within ``rows``; the plan for a larger one is a shuffle."""
    return F.broadcast(df) if small_enough(df, rows) else df


def sifted(df: DataFrame, keys: DataFrame, column: str, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``column`` may be one of landed ``keys``, or with ``left_anti`` all others; none is moved.

    A Bloom filter with one hash and sixteen bits a key, fewer beyond ``FILTER_WORDS``, is broadcast: it lets
    through every key and some other rows, so a join with the keys has to follow.
    """
    bits = 64 * max(1, min(FILTER_WORDS, keys.count() // 4))

    def place(value: Column) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(value.cast(keys.schema[key].dataType)), F.lit(bits))
        return F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")

    word, bit = place(keys[key])
    # F.shiftleft takes no column as its second argument
    marks = keys.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bit"))
    marks = marks.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    word, bit = place(df[column])
    return df.join(F.broadcast(marks), (word == marks["word"]) & (F.getbit(marks["bits"], bit) == 1), how)


def _same(df: DataFrame, keys: DataFrame, on: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [df[c].eqNullSafe(keys[k]) for c, k in on.items()])


def among(df: DataFrame, keys: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``df`` whose columns equal those of a row of landed ``keys``; nulls are equal.

    The wide rows are not shuffled: with few keys none is, else those that a filter on the first column lets
    through.
    """
    if small_enough(keys, BROADCAST_KEYS):
        return df.join(F.broadcast(keys), _same(df, keys, on), "left_semi")
    some = sifted(df, keys, *next(iter(on.items())))
    return some.join(keys, _same(some, keys, on), "left_semi")


def without(df: DataFrame, keys: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``df`` that ``among`` leaves out, by the same means."""
    if small_enough(keys, BROADCAST_KEYS):
        return df.join(F.broadcast(keys), _same(df, keys, on), "left_anti")
    first = next(iter(on.items()))
    some = sifted(df, keys, *first)
    return sifted(df, keys, *first, "left_anti").union(some.join(keys, _same(some, keys, on), "left_anti"))


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
