"""Summaries of a catalog, an index and a search."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from vitrine.operators.ranking import first_per_key


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def source_summary(items: DataFrame, pd_default: Column) -> DataFrame:
    """Items, images, models and public-domain items per source."""
    return items.groupBy("source").agg(
        F.count(F.lit(1)).alias("count"),
        count_if(F.col("content_type") == "image").alias("images"),
        count_if(F.col("content_type") == "3d").alias("models"),
        count_if(F.coalesce(F.col("public_domain"), pd_default)).alias("pd"),
    )


def catalog_status(summaries: DataFrame, display: DataFrame | None = None) -> DataFrame:
    """Largest summary per source with its display data; order by ``count desc`` to show."""
    best = first_per_key(
        summaries, ["source"], [F.col("count").desc(), F.col("images").desc(), F.col("models").desc(), F.col("pd").desc()]
    )
    kinds = F.array_compact(
        F.array(F.when(F.col("images") > 0, F.lit("image")), F.when(F.col("models") > 0, F.lit("3d")))
    )
    out = best.select("source", "count", kinds.alias("content_types"))
    if display is not None:
        out = out.join(display, "source", "left").withColumns(
            {
                "name": F.coalesce("name", "source"),
                "homepage": F.coalesce("homepage", F.lit("")),
                "license": F.coalesce("license", F.lit("")),
            }
        )
    return out


def grand_total(summary: DataFrame) -> DataFrame:
    return summary.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def shown_total(count: Column, count_cap: int | None = None) -> Column:
    """Hits a source reports: the exact count, or no more than ``count_cap`` where one is given."""
    return count if count_cap is None else F.least(count, F.lit(count_cap).cast("bigint"))


def per_source_totals(matches: DataFrame, count_cap: int | None = None) -> DataFrame:
    return matches.groupBy("source").agg(shown_total(F.count(F.lit(1)), count_cap).alias("hits"))


def merge_totals(parts: DataFrame) -> DataFrame:
    """Largest count per source over several answers."""
    return parts.groupBy("source").agg(F.max("hits").alias("hits"))


def count_source(items: DataFrame, source: str | None = None) -> DataFrame:
    rows = items.filter(F.col("source") == source) if source else items
    return rows.agg(F.count(F.lit(1)).alias("n"))


def primary_image(images: DataFrame, key: str) -> DataFrame:
    """One image per object: primary view first, then the lowest sequence, then the URL."""
    other = (F.col("viewtype") != "primary").cast("int")
    fields = [c for c in images.columns if c != key]
    rank = F.struct(other.alias("o"), F.col("sequence").try_cast("double").alias("s"), F.col("iiifurl").alias("u"))
    best = images.groupBy(key).agg(F.min_by(F.struct(*fields), rank).alias("_best"))
    return best.select(key, "_best.*")


def terms_by_object(terms: DataFrame, key: str, kinds: Sequence[str], order: str, excluded: Sequence[str] = ()) -> DataFrame:
    """Distinct terms of the wanted kinds per object, in the order they were first seen."""
    wanted = terms.filter(F.col("termtype").isin(list(kinds)) & (F.coalesce("term", F.lit("")) != ""))
    if excluded:
        wanted = wanted.filter(~F.col("term").isin(list(excluded)))
    # repeats of a term collapse before the list is built, so a list is at most the vocabulary
    once = wanted.groupBy(key, "term").agg(F.min(order).alias("_at"))
    listed = once.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", "term"))).alias("_t"))
    return listed.select(key, F.transform("_t", lambda t: t["term"]).alias("terms"))


class IngestReport:
    """Rows seen, kept and stored with a compact image key, per source, counted while the catalog is written.

    ``seen``, ``kept`` and ``stored`` mark the steps of one plan; the counts come with its write as observed metrics, so
    there is no job for them. The sources of an ingest are known by name; rows of any other count under null.
    """

    STEPS = ("seen", "kept", "stored", "compacted")

    def __init__(self, sources: Sequence[str]):
        self.sources = sorted(set(sources))
        self._marked: list[Observation] = []

    def _counts(self, step: str, cond: Column) -> list[Column]:
        named = F.col("source").isin(self.sources)
        each = [count_if(cond & (F.col("source") == s)).alias(f"{step}_{i}") for i, s in enumerate(self.sources)]
        return [*each, count_if(cond & ~F.coalesce(named, F.lit(False))).alias(f"{step}_other")]

    def _mark(self, df: DataFrame, counts: list[Column]) -> DataFrame:
        self._marked.append(Observation(f"ingest-{uuid.uuid4().hex}"))
        return df.observe(self._marked[-1], *counts)

    def seen(self, df: DataFrame) -> DataFrame:
        return self._mark(df, self._counts("seen", F.lit(True)))

    def kept(self, df: DataFrame) -> DataFrame:
        return self._mark(df, self._counts("kept", F.lit(True)))

    def stored(self, df: DataFrame) -> DataFrame:
        return self._mark(df, self._counts("stored", F.lit(True)) + self._counts("compacted", F.col("img").isNotNull()))

    def rows(self, spark: SparkSession) -> DataFrame:
        """The report, once the marked plan has been written (it waits for that); steps that were not marked count 0."""
        got: dict[str, int] = {}
        for step in self._marked:
            got |= step.get
        places = [*((str(i), s) for i, s in enumerate(self.sources)), ("other", None)]
        out = [(s, *(int(got.get(f"{step}_{i}", 0)) for step in self.STEPS)) for i, s in places]
        return spark.createDataFrame([r for r in out if any(r[1:])], "source string, " + ", ".join(f"{x} bigint" for x in self.STEPS))


def ingest_report(raw: DataFrame, kept: DataFrame, catalog: DataFrame) -> DataFrame:
    """The same counts from stored tables, where no write of theirs can be observed."""
    seen = raw.groupBy("source").agg(F.count(F.lit(1)).alias("seen"))
    keep = kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    compacted = catalog.groupBy("source").agg(
        F.count(F.lit(1)).alias("stored"), count_if(F.col("img").isNotNull()).alias("compacted")
    )
    joined = seen.join(keep, "source", "full_outer").join(compacted, "source", "full_outer")
    return joined.select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("seen", "kept", "stored", "compacted")])
