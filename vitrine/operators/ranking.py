"""Per-group ranks that hold up when one group is a third of the table.

A plain ``row_number() over (partition by g order by ...)`` sends a whole group to
one task. The operators here split a group first:

* ``top_n``: rank inside (group, salt), keep n, then rank the few survivors.
* ``bucket_rank``: cut a group into buckets that follow the order, count rows per
  bucket, turn the counts into offsets, and rank only inside a bucket.

Both give the same numbers as the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.session import shuffle_width

BUCKET_ROWS = 1 << 20


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    salt_by: Sequence[str],
    rank: str | None = None,
) -> DataFrame:
    """First ``n`` rows of each group in a total order; ``rank`` names the 1-based position."""
    out = rank or "_rank"
    if n > 1:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_by]), F.lit(shuffle_width(df.sparkSession)))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_part", F.row_number().over(first))
            .filter(F.col("_part") <= n)
            .drop("_salt", "_part")
        )
    # for n = 1 the group limit Spark pushes below the exchange already leaves
    # one row per group and map task
    last = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(out, F.row_number().over(last)).filter(F.col(out) <= n)
    return ranked if rank else ranked.drop(out)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return top_n(df, keys, order, 1, salt_by=keys)


def seq_bucket(seq: Column, width: int = BUCKET_ROWS) -> Column:
    """Bucket of a unique arrival number: at most ``width`` rows fall in one bucket."""
    return F.floor(seq / F.lit(width)).cast("bigint")


def bucket_rank(
    df: DataFrame,
    keys: Sequence[str],
    buckets: Sequence[Column],
    order: Sequence[Column],
    rank: str = "rank",
    limit: int | str | None = None,
) -> DataFrame:
    """Exact row number per group, one task per (group, bucket).

    ``buckets`` must not decrease along ``order`` and must tell apart enough rows that
    one bucket fits a task. With ``limit`` (a number or a column that is constant within
    a group) buckets beyond it are dropped before they are sorted.
    """
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    place = F.struct(*[b.alias(f"b{i}") for i, b in enumerate(buckets)])
    rows = df.withColumn("_group", group).withColumn("_bucket", place)
    # as many rows here as there are buckets, whatever the size of the group
    before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = F.count(F.lit(1)).alias("_n")
    if isinstance(limit, str):
        counts = rows.groupBy("_group", "_bucket").agg(counted, F.first(limit).alias("_limit"))
    else:
        counts = rows.groupBy("_group", "_bucket").agg(counted)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    bound = None
    if limit is not None:
        bound = F.col("_limit") if isinstance(limit, str) else F.lit(limit)
        starts = starts.filter(F.col("_start") < bound)
    inside = Window.partitionBy("_group", "_bucket").orderBy(*order)
    starts = starts.select("_group", "_bucket", "_start")
    ranked = (
        rows.join(starts, ["_group", "_bucket"])
        .withColumn(rank, F.col("_start") + F.row_number().over(inside))
        .drop("_group", "_bucket", "_start")
    )
    if limit is not None:
        ranked = ranked.filter(F.col(rank) <= (F.col(limit) if isinstance(limit, str) else F.lit(limit)))
    return ranked


def with_seq(df: DataFrame, order: Sequence[Column], buckets: Sequence[Column], name: str = "seq") -> DataFrame:
    """Dense arrival number starting at 1, for inputs that only carry an ordering."""
    return bucket_rank(df, [], buckets, order, rank=name)
