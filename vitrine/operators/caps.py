"""Caps, first-wins dedupe, quotas and other row-number operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.operators.merge import shuffle_hash
from vitrine.operators.ranking import bucket_rank, first_per_key, seq_bucket, top_n
from vitrine.session import landed

# Catalog caps per feed.
FEED_CAPS = {
    "europeana": 400000, "rijks": 240000, "si": 210000, "met": 260000, "aic": 60000,
    "nga": 65000, "cma": 45000, "wellcome": 80000, "nih3d": 25000, "metwiki": 260000,
}
# Aggregator themes with their cap and cap per provider.
THEME_CAPS = {
    "art": (160000, 15000), "photography": (80000, 12000), "archaeology": (45000, 10000),
    "industrial": (40000, 10000), "fashion": (40000, 10000), "music": (20000, 6000), "manuscript": (15000, 6000),
}
# Museum units with their image caps.
UNIT_CAPS = {
    "chndm": 80000, "saam": 40000, "npm": 30000, "fsg": 30000, "nasm": 20000, "hmsg": 10000, "nmafa": 10000,
    "npg": 20000, "nmaahc": 15000, "nmah": 70000, "nmai": 25000, "ocio_dpo3d": 5000,
}
DEFAULT_UNIT_CAP = 20000
# Photo accounts with a cap of their own, and the cap of all others.
ACCOUNT_CAPS = {
    "126377022@N07": 150000, "12403504@N02": 40000, "8623220@N02": 40000, "44494372@N05": 20000, "61021753@N02": 60000,
}
DEFAULT_ACCOUNT_CAP = 10000
HASH_BUCKETS = 16384
NO_CAP = 1 << 62


def cap_column(key: Column, caps: Mapping[str, int], default: int = NO_CAP) -> Column:
    """Cap of a key as a column; the table is small and ships with the plan."""
    if not caps:
        return F.lit(default).cast("bigint")
    table = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key).cast("bigint"), F.lit(default).cast("bigint"))


def cap_per_source(
    df: DataFrame, caps: Mapping[str, int], key: str = "source", seq: str = "rid", tie: str = "source_id", default: int = NO_CAP
) -> DataFrame:
    """Highlights first, then a stable pseudo-random subset, up to the cap of each source.

    The hash cuts a source into even buckets, so even a source that is a third of the
    catalog is ranked by many tasks, and buckets beyond the cap are never sorted.
    """
    mixed = shuffle_hash(F.col(seq), 0)
    width = -(-1000003 // HASH_BUCKETS)
    buckets = [-F.col("boost"), F.floor(mixed / F.lit(width))]
    order = [F.col("boost").desc(), mixed.asc(), F.col(tie).asc(), F.col(seq).asc()]
    capped = df.withColumn("_cap", cap_column(F.col(key), caps, default))
    return bucket_rank(capped, [key], buckets, order, rank="_rank", limit="_cap").drop("_rank", "_cap")


def dedupe_priority(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by source priority."""
    return first_per_key(df, [key], order)


def latest_by_key(df: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """The last write per key."""
    return first_per_key(df, keys, newest)


def capped(df: DataFrame, keys: Sequence[str], seq: str, cap: Column | int, width: int = 1 << 20, rank: str = "_rank") -> DataFrame:
    """First ``cap`` rows of each group by arrival; adds the arrival rank."""
    rows = df.withColumn("_cap", (F.lit(cap) if isinstance(cap, int) else cap).cast("bigint"))
    return bucket_rank(rows, keys, [seq_bucket(F.col(seq), width)], [F.col(seq).asc()], rank=rank, limit="_cap").drop("_cap")


def double_cap(df: DataFrame, outer: str, inner: str, seq: str, outer_cap: Column | int, inner_cap: Column | int, width: int = 1 << 20) -> DataFrame:
    """Skip rows of an inner group that is full, stop an outer group at its cap."""
    # a split ranking reads its input twice, so two in a row would compute the first one twice
    first = landed(capped(df, [outer, inner], seq, inner_cap, width).drop("_rank"), "inner-cap")
    return capped(first, [outer], seq, outer_cap, width).drop("_rank")


def capped_with_exempt(df: DataFrame, key: str, seq: str, cap: Column | int, exempt: Column, width: int = 1 << 20) -> DataFrame:
    """First ``cap`` rows per group plus all exempt rows; exempt rows are counted too."""
    rows = df.withColumn("_cap", (F.lit(cap) if isinstance(cap, int) else cap).cast("bigint"))
    ranked = bucket_rank(rows, [key], [seq_bucket(F.col(seq), width)], [F.col(seq).asc()], rank="_rank")
    return ranked.filter(exempt | (F.col("_rank") <= F.col("_cap"))).drop("_rank", "_cap")


def account_cap(df: DataFrame, account: str, seq: str, caps: Mapping[str, int] | None = None, default: int = NO_CAP, width: int = 1 << 20) -> DataFrame:
    """First rows of each account; the published numbers are ``ACCOUNT_CAPS`` and ``DEFAULT_ACCOUNT_CAP``."""
    return capped(df, [account], seq, cap_column(F.col(account), caps or {}, default), width).drop("_rank")


def unique_names(df: DataFrame, name: str, seq: str, out: str = "unique_name", width: int = 1 << 20) -> DataFrame:
    """Second and later uses of a file name get ``-2``, ``-3`` before the extension."""
    ranked = bucket_rank(df, [name], [seq_bucket(F.col(seq), width)], [F.col(seq).asc()], rank="_use")
    numbered = F.regexp_replace(F.col(name), F.lit(r"(\.[A-Za-z0-9]+)$"), F.concat(F.lit("-"), F.col("_use").cast("string"), F.lit("$1")))
    return ranked.withColumn(out, F.when(F.col("_use") > 1, numbered).otherwise(F.col(name))).drop("_use")


def keep_newest(df: DataFrame, key: str, ts: str, n: int) -> DataFrame:
    return top_n(df, [key], [F.col(ts).desc()], n, salt_by=[ts])


def daily_quota(df: DataFrame, key: str, ts: str, tie: str, cap: int) -> DataFrame:
    """Running use per key and UTC day; uses beyond the cap are refused."""
    rows = df.withColumn("day", F.to_date(ts))
    ranked = bucket_rank(
        rows, [key, "day"], [F.date_trunc("minute", F.col(ts))], [F.col(ts).asc(), F.col(tie).asc()], rank="used"
    )
    return ranked.withColumn("allowed", F.col("used") <= cap)
