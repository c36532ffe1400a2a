"""Orderings that mix sources, pages, and their set operations.

Candidates carry ``rid`` (unique integer), ``source`` and, where needed, ``score`` and
``year_start``. Earlier sources win ties; ``source_order`` gives the columns that order them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.operators.ranking import bucket_rank, first_per_key, top_n

# The diversity discount per item already shown, the shuffle hash, the page size.
PENALTY = 0.06
HASH_FACTOR = 2654435761
HASH_PRIME = 1000003
DEFAULT_SEED = 7
DEFAULT_LIMIT = 250
# Page bounds of a public site, for callers that want them.
SITE_PAGES = {"max_limit": 500, "max_candidates": 1500}


def shuffle_hash(rid: Column, seed: int = DEFAULT_SEED) -> Column:
    """Seeded pseudo-random order key below ``HASH_PRIME``.

    Reducing ``rid`` first gives the same remainder and cannot overflow a bigint.
    """
    return F.pmod(F.pmod(rid.cast("bigint"), F.lit(HASH_PRIME)) * F.lit(HASH_FACTOR) + F.lit(seed), F.lit(HASH_PRIME))


def clamp_seed(seed: float | None) -> int:
    if seed is None or seed != seed or seed in (float("inf"), float("-inf")):
        return DEFAULT_SEED
    return abs(int(seed)) % HASH_PRIME


def clamp_page(
    limit: int | None, offset: int | None, max_limit: int | None = None, max_candidates: int | None = None
) -> tuple[int, int]:
    """Limit and offset of a page. Every page can be reached unless the caller sets bounds, as in ``SITE_PAGES``."""
    limit = max(1, limit or DEFAULT_LIMIT)
    offset = max(0, offset or 0)
    if max_limit is not None:
        limit = min(max_limit, limit)
    if max_candidates is not None:
        offset = max(0, min(offset, max_candidates - limit))
    return limit, offset


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int, pos: str | None = None) -> DataFrame:
    """One page of a global order. Spark keeps the top rows per task, so nothing is fully sorted."""
    cut = df.orderBy(*order).offset(offset).limit(limit)
    if pos:
        # the input of this window is the page itself, at most ``limit`` rows
        cut = cut.withColumn(pos, F.row_number().over(Window.orderBy(*order)) + F.lit(offset))
    return cut


def order_oldest() -> list[Column]:
    return [F.col("year_start").asc(), F.col("rid").asc()]


def order_newest() -> list[Column]:
    return [F.col("year_start").desc(), F.col("rid").asc()]


def order_random(seed: int = DEFAULT_SEED) -> list[Column]:
    return [shuffle_hash(F.col("rid"), seed).asc(), F.col("rid").asc()]


def order_browse(seed: int = DEFAULT_SEED) -> list[Column]:
    """Highlights first, then the seeded shuffle."""
    return [F.col("boost").desc(), *order_random(seed)]


def order_score() -> list[Column]:
    return [F.col("score").desc(), F.col("rid").asc()]


def top_per_source(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return top_n(df, ["source"], order, n, salt_by=["rid"])


def candidates_needed(offset: int, limit: int, max_candidates: int | None = None) -> int:
    need = offset + limit + 50
    return need if max_candidates is None else min(max_candidates, need)


def diverse_order(df: DataFrame, source_order: Sequence[Column], rank: str = "rank", penalty: float = PENALTY) -> tuple[DataFrame, list[Column]]:
    """Add the discounted value of each candidate and return it with the merged order.

    ``rank`` is the 1-based rank of a candidate in its source by score. A candidate is
    always offered after exactly the better ones of its source, so the greedy choice is
    a plain sort by ``score / (1 + penalty * (rank - 1))`` as long as scores are not
    negative, which BM25 with a floored idf and a non-negative boost guarantees.
    """
    valued = df.withColumn("value", F.col("score") / (1 + F.lit(penalty) * (F.col(rank) - 1)))
    return valued, [F.col("value").desc(), *source_order, F.col(rank).asc()]


def diverse_order_signed(df: DataFrame, source_order: Sequence[Column], rank: str = "rank", penalty: float = PENALTY) -> tuple[DataFrame, list[Column]]:
    """The same for scores that may be negative: a candidate cannot pass an earlier, lower one.

    For candidate lists already cut per source (``top_per_source``), so that a source is
    at most that many rows.
    """
    valued, _ = diverse_order(df, source_order, rank, penalty)
    running = Window.partitionBy("source").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return valued.withColumn("value", F.min("value").over(running)), [
        F.col("value").desc(), *source_order, F.col(rank).asc()
    ]


def diverse_page(
    df: DataFrame, source_order: Sequence[Column], offset: int, limit: int, pos: str | None = "pos", penalty: float = PENALTY
) -> DataFrame:
    """Page of the diversity merge. No source can hold more than ``offset + limit`` of its rows."""
    ranked = top_n(df, ["source"], order_score(), offset + limit, salt_by=["rid"], rank="rank")
    valued, order = diverse_order(ranked, source_order, penalty=penalty)
    return page(valued, order, offset, limit, pos)


def round_robin_page(
    df: DataFrame, inner: Sequence[Column], source_order: Sequence[Column], offset: int, limit: int, pos: str | None = "pos"
) -> DataFrame:
    """Page of the i-th candidate of every source in turn."""
    ranked = top_n(df, ["source"], inner, offset + limit, salt_by=["rid"], rank="rank")
    return page(ranked, [F.col("rank").asc(), *source_order], offset, limit, pos)


def round_robin_queue(pending: DataFrame, group: str, buckets: Sequence[Column], limit: int | None = None) -> DataFrame:
    """Work queue: highlights first, then one item of each group in turn.

    Columns: ``highlight`` (0/1), ``id`` and the group. Inside a group items run by
    highlight, ``id % 97``, id; a group's place is that of its first item. Rows get the
    three sort keys ``q_tier, q_round, q_group``; ``limit`` cuts the queue.
    """
    spread = F.pmod(F.col("id"), F.lit(97))
    inner = [F.col("highlight").desc(), spread.asc(), F.col("id").asc()]
    ranked = bucket_rank(
        pending, [group], [-F.col("highlight"), spread, *buckets], inner, rank="q_round", limit=limit
    )
    firsts = pending.groupBy(group).agg(
        F.min(F.struct((-F.col("highlight")).alias("h"), spread.alias("s"), F.col(group).alias("g"), F.col("id").alias("i"))).alias("q_group")
    )
    queue = ranked.join(firsts, [group]).withColumn("q_tier", F.lit(1) - F.col("highlight"))
    return queue.orderBy("q_tier", "q_round", "q_group").limit(limit) if limit is not None else queue


# set operations -----------------------------------------------------------


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def distinct_ids(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """First occurrence of each id."""
    return first_per_key(df, ["id"], order)


def merge_candidates(frames: Sequence[DataFrame], source_order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Union of scored candidate lists, first list wins on a repeated id, merged again."""
    tagged = [df.withColumn("_list", F.lit(i)) for i, df in enumerate(frames)]
    once = distinct_ids(union_sources(tagged), [F.col("_list").asc(), F.col("score").desc(), F.col("rid").asc()])
    return diverse_page(once.drop("_list"), source_order, offset, limit)


def append_page(shown: DataFrame, more: DataFrame) -> DataFrame:
    """Shown items followed by the unseen ones of the next page (``pos`` orders both)."""
    fresh = more.join(shown.select("id"), "id", "left_anti")
    return shown.withColumn("page", F.lit(0)).unionByName(fresh.withColumn("page", F.lit(1)))


def difference(df: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(removed.select(*keys), list(keys), "left_anti")


def lookup_items(items: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Items by id in request order; misses are left out.

    A list ships with the plan. Many ids come as a DataFrame of ``id`` and ``pos`` and are joined.
    """
    if isinstance(ids, DataFrame):
        return items.join(ids.select("id", "pos"), "id")
    wanted = {}
    for i, item_id in enumerate(ids):
        wanted.setdefault(item_id, []).append(i)
    hits = items.filter(F.col("id").isin(list(wanted)))
    places = F.map_from_entries(
        F.array(*[F.struct(F.lit(k), F.array(*[F.lit(p) for p in v])) for k, v in wanted.items()])
    )
    return hits.withColumn("pos", F.explode(F.element_at(places, F.col("id"))))
