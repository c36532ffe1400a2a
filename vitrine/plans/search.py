"""Search over a catalog: facets, weighted BM25, backfill, and a merge that mixes sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.functions.text import tokenize_query
from vitrine.operators import filters as P
from vitrine.operators.aggregates import shown_total
from vitrine.operators.merge import (
    candidates_needed, clamp_page, clamp_seed, diverse_order, order_browse, order_newest,
    order_oldest, order_random, order_score, page, top_per_source,
)
from vitrine.operators.ranking import top_n
from vitrine.plans.text_index import TextIndex, bm25_matches, boosted_score, build_index, look_up, read_index, write_index
from vitrine.session import scratch_path, shuffle_width

# Pages up to this many narrow rows are broadcast or read by literal row numbers; longer ones are joined.
BROADCAST_ROWS = 2000
# Rows of one source that may meet in a task before the last ranking; beyond that they are ranked in parts first.
RANKED_ROWS = 2_000_000
# Filters by a part of a text: no posting carries these columns, the catalog is asked for the matching rows.
TEXT_FACETS = ("object_type", "medium", "creator", "place")
SORTS = ("relevance", "oldest", "newest", "random")


@dataclass(frozen=True)
class SearchParams:
    q: str = ""
    limit: int | None = None
    offset: int | None = None
    sources: Sequence[str] = field(default_factory=tuple)
    year_from: int | None = None
    year_to: int | None = None
    content: str | None = None
    public_domain_only: bool = False
    object_type: str | None = None
    medium: str | None = None
    creator: str | None = None
    place: str | None = None
    sort: str | None = None
    seed: float | None = None


@dataclass
class SearchResult:
    page: DataFrame  # items of the page with score, value and pos
    per_source: DataFrame  # source, hits
    candidates: DataFrame
    hits: DataFrame  # the page without the wide columns: rid, source, score, value, pos
    short: bool = True  # at most BROADCAST_ROWS rows were asked for

    def fetch(self, items: DataFrame) -> DataFrame:
        """The page read by its row numbers, which are as many as the limit asked for.

        They become literals in the plan, so a stored catalog is read in the folders of their
        sources instead of as a whole. A long page is joined without passing the driver.
        """
        if not self.short:
            return items.join(self.hits.drop("source"), "rid")
        found = self.hits.collect()
        hits = items.sparkSession.createDataFrame(found, self.hits.schema)
        near = items.filter(F.col("source").isin(sorted({r.source for r in found})) & F.col("rid").isin([r.rid for r in found]))
        return near.join(F.broadcast(hits.drop("source")), "rid")

    @property
    def total(self) -> DataFrame:
        return self.per_source.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("total"))


def carried_filter(params: SearchParams, sort: str, pd_default: Column) -> Column:
    """The filters on facets that the postings carry."""
    cond = P.source_in(params.sources) & P.content_is(params.content) & P.year_within(params.year_from, params.year_to)
    if params.public_domain_only:
        cond = cond & P.public_domain_only(pd_default)
    if sort in ("oldest", "newest"):
        cond = cond & P.dated_only()
    return cond


def text_filter(params: SearchParams) -> Column | None:
    """The filters by a part of a text, or None where none is asked for."""
    if not any((getattr(params, c) or "").strip() for c in TEXT_FACETS):
        return None
    return (
        P.contains_ci("object_type", params.object_type)
        & P.contains_ci("medium", params.medium)
        & P.contains_ci("creator", params.creator)
        & P.place_or_culture(params.place)
    )


def _inner_order(sort: str, seed: int, browse: bool) -> list[Column]:
    if sort == "oldest":
        return order_oldest()
    if sort == "newest":
        return order_newest()
    if browse:
        return order_browse(seed)
    return order_random(seed) if sort == "random" else order_score()


def search(
    items: DataFrame,
    params: SearchParams,
    index: TextIndex | None = None,
    pd_default: Column | None = None,
    summary: DataFrame | None = None,
    stemmed: bool = False,
    bounds: Mapping[str, int] | None = None,
) -> SearchResult:
    """One plan per answer.

    ``items`` needs ``rid`` and the item columns. ``index`` is a prebuilt text index; without
    one the query's own words are indexed first. ``pd_default`` is the source's default
    public-domain flag as a Column of ``source``, ``summary`` a prebuilt (source, count) table; the index has
    one of its own. ``bounds`` limits the page and the candidates per source (``SITE_PAGES``); without it any
    page can be reached. A search for words is answered from the index alone: of the catalog only the rows of the
    page are read, and with a filter by a part of a text (``TEXT_FACETS``) the filtered columns.
    """
    bounds = bounds or {}
    limit, offset = clamp_page(params.limit, params.offset, **bounds)
    need = offset + limit
    words = tokenize_query(params.q)
    sort = params.sort if params.sort in SORTS else ("relevance" if words else "random")
    seed = clamp_seed(params.seed)
    keep = carried_filter(params, sort, F.lit(False) if pd_default is None else pd_default)
    contains = text_filter(params)
    inner = _inner_order(sort, seed, browse=not words)
    most = candidates_needed(offset, limit, bounds.get("max_candidates"))
    if words and index is None:
        # only the query's words, written once because the plan reads them several times
        wanted = sorted(set(TextIndex(None, None, stemmed).query_terms(words)))
        path = scratch_path(items.sparkSession, "query-index")
        write_index(build_index(items, stemmed=stemmed, terms=wanted, land=False), path)
        index = read_index(items.sparkSession, path, stemmed)
    if summary is None:
        known = index.sources if index is not None else None
        summary = known if known is not None else items.groupBy("source").agg(F.count(F.lit(1)).alias("count"))
    sizes = summary.select("source", F.col("count").alias("source_count"))
    if words:
        cands, per_source = _text_candidates(items, keep, contains, words, index, inner, most, need)
    else:
        narrow = items.filter(keep if contains is None else keep & contains).select(
            "rid", "source", "year_start", F.coalesce("boost", F.lit(0)).alias("boost")
        )
        cands = top_per_source(narrow.withColumn("score", F.col("boost").cast("double")), inner, most).withColumn(
            "tier", F.lit(0)
        )
        per_source = narrow.groupBy("source").agg(F.count(F.lit(1)).alias("hits"))
    # from here on a source has at most twice the rows up to the end of the page
    placed = cands.join(sizes, "source")
    by_source = Window.partitionBy("source")
    placed = placed.withColumn("first_tier", F.min("tier").over(by_source))
    source_order = [F.col("first_tier").asc(), F.col("source_count").desc(), F.col("source").asc()]
    if sort in ("oldest", "newest"):
        year = F.col("year_start").asc() if sort == "oldest" else F.col("year_start").desc()
        valued = placed.withColumn("value", F.col("score"))
        order = [year, F.col("tier").asc(), F.col("source_count").desc(), F.col("source").asc(), F.col("rid").asc()]
    elif sort == "random":
        listed = Window.partitionBy("source").orderBy(F.col("tier").asc(), *inner)
        valued = placed.withColumn("rank", F.row_number().over(listed)).withColumn("value", F.col("score"))
        order = [F.col("rank").asc(), *source_order]
    else:
        ranked = placed.withColumn(
            "rank",
            F.row_number().over(by_source.orderBy(F.col("score").desc(), F.col("tier").asc(), *inner)),
        )
        # with a single source the discount keeps its order, so no case of its own
        valued, order = diverse_order(ranked, source_order)
    hits = page(valued, order, offset, limit, pos="pos").select("rid", "source", "score", "value", "pos")
    # the page has no more rows than asked for: joined to the wide rows last
    short = limit <= BROADCAST_ROWS
    narrow_page = hits.drop("source")
    wide = items.filter(P.source_in(params.sources)).join(F.broadcast(narrow_page) if short else narrow_page, "rid")
    return SearchResult(wide, per_source, cands, hits, short)


def _first_per_source(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    """First ``n`` rows of each group with their rank. Every task keeps its own first rows before they are brought
    together; where even those could be too many for a task, they are ranked in parts once more."""
    if n * shuffle_width(df.sparkSession) > RANKED_ROWS:
        return top_n(df, keys, order, n, salt_by=["rid"], rank=rank)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def _text_candidates(items, keep, contains, words, index, inner, most, need):
    terms = index.query_terms(words)
    distinct = len(set(terms))
    carried = index.has_facets
    known = look_up(index, terms)
    matched = bm25_matches(index, terms, keep if carried else None, known)
    if not carried:
        narrow = items.filter(keep if contains is None else keep & contains).select("rid", "source", "year_start", "boost")
        matched = matched.join(narrow, "rid")
    elif contains is not None:
        matched = matched.join(items.filter(keep & contains).select("rid"), "rid", "left_semi")
    matched = matched.select(
        "rid", "source", "year_start", F.coalesce("boost", F.lit(0)).alias("boost"),
        boosted_score(F.col("bm25"), F.col("boost")).alias("score"),
        F.when(F.col("n_terms") == distinct, F.lit(0)).otherwise(F.lit(1)).alias("tier"),
    )
    if len(words) == 1:
        cands = _first_per_source(matched, ["source"], inner, most, "or_rank").drop("or_rank")
        return cands, matched.groupBy("source").agg(shown_total(F.count(F.lit(1))).alias("hits"))
    # no more documents can have all words than have the rarest; only beyond that they need counting
    rarest = min((known[t]["df"] if t in known else 0 for t in terms), default=0)
    have = F.lit(rarest) if rarest < need else matched.agg(F.count_if(F.col("tier") == 0)).scalar()
    # enough for both passes: the best rows of either tier, then the second pass ranks both together
    both = _first_per_source(matched, ["source", "tier"], inner, most, "tier_rank")
    either = Window.partitionBy("source").orderBy(*inner)
    both = both.withColumn("or_rank", F.row_number().over(either)).withColumn("thin", have < need)
    cands = both.filter((F.col("tier") == 0) | (F.col("thin") & (F.col("or_rank") <= most)))
    # the second pass counts whole, not only as far as it is listed
    counts = matched.groupBy("source").agg(
        F.count_if(F.col("tier") == 0).alias("n_all"), F.count_if(F.col("tier") == 1).alias("n_rest")
    )
    hits = F.col("n_all") + F.when(have < need, F.col("n_rest")).otherwise(F.lit(0))
    return cands, counts.select("source", shown_total(hits).alias("hits")).filter(F.col("hits") > 0)
