"""Facet filters over catalog items. Each returns a boolean Column unless noted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions.rights import UNCLEAR
from vitrine.schema import no_files

# Hosts and paths whose files may be fetched by a raw URL.
ALLOWED_HOSTS = ["patentimages.storage.googleapis.com"]
ALLOWED_HOST_SUFFIX = ".public.blob.vercel-storage.com"
ALLOWED_BUCKET_HOST = "storage.googleapis.com"
ALLOWED_BUCKET_PATHS = ["/patentimages/", "/download/storage/v1/b/patentimages/"]


def validate_items(df: DataFrame) -> DataFrame:
    """Keep rows with id, source and title (images also need a thumbnail) and fill the defaults."""
    kind = F.coalesce(F.nullif("content_type", F.lit("")), F.lit("image"))
    present = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("id", "source", "title")]
    shown = (kind != "image") | (F.coalesce(F.col("thumb_url"), F.lit("")) != "")
    return df.filter(present[0] & present[1] & present[2] & shown).withColumns(
        {
            "source_id": F.coalesce(F.col("source_id"), F.regexp_replace("id", "^[^:]*:?", "")),
            "content_type": kind,
            "rights_label": F.coalesce(F.col("rights_label"), F.lit(UNCLEAR.label)),
            "boost": F.coalesce(F.col("boost"), F.lit(0)),
            "files": F.coalesce(F.col("files"), no_files()),
        }
    )


def titled_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("title").isNotNull() & (F.col("title") != ""))


def source_in(sources: Sequence[str] | None) -> Column:
    """Requested sources; no request means all. Prunes partitions of a catalog written by source."""
    return F.col("source").isin(list(sources)) if sources else F.lit(True)


def content_is(content: str | None) -> Column:
    return F.col("content_type") == content if content in ("image", "3d") else F.lit(True)


def public_domain_only(default: Column) -> Column:
    """True flag, or no flag in a source that is public domain by default."""
    return F.coalesce(F.col("public_domain"), default, F.lit(False))


def year_within(year_from: int | None, year_to: int | None) -> Column:
    """The item's years lie inside the bounds; undated items never match a bound."""
    cond = F.lit(True)
    if year_from is not None:
        cond = cond & (F.col("year_start").isNotNull() & (F.col("year_start") >= year_from))
    if year_to is not None:
        cond = cond & (F.col("year_end").isNotNull() & (F.col("year_end") <= year_to))
    return cond


def contains_ci(col: Column | str, value: str | None) -> Column:
    """Case-insensitive substring; a blank value matches all."""
    value = (value or "").strip()
    if not value:
        return F.lit(True)
    col = F.col(col) if isinstance(col, str) else col
    for special in ("\\", "%", "_"):
        value = value.replace(special, "\\" + special)
    return col.ilike(f"%{value}%")


def place_or_culture(value: str | None) -> Column:
    if not (value or "").strip():
        return F.lit(True)
    # either side may be null: null OR true is still true
    return contains_ci("place", value) | contains_ci("culture", value)


def dated_only() -> Column:
    return F.col("year_start").isNotNull()


def exclude_providers(df: DataFrame, col: str, names: Sequence[str]) -> DataFrame:
    """Drop named providers; rows without a provider stay."""
    return df.filter(~F.coalesce(F.col(col).isin(list(names)), F.lit(False)))


def drop_redundant_files(files: Column, original_url: Column) -> Column:
    """Remove files that repeat the original image."""
    return F.filter(files, lambda f: ~f["url"].eqNullSafe(original_url))


def allowed_url(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    host = F.lower(F.try_parse_url(col, F.lit("HOST")))
    path = F.try_parse_url(col, F.lit("PATH"))
    bucket = F.lit(False)
    for prefix in ALLOWED_BUCKET_PATHS:
        bucket = bucket | path.startswith(prefix)
    ok = (F.lower(F.try_parse_url(col, F.lit("PROTOCOL"))) == "https") & (
        host.isin(ALLOWED_HOSTS) | host.endswith(ALLOWED_HOST_SUFFIX) | ((host == ALLOWED_BUCKET_HOST) & bucket)
    )
    return F.coalesce(ok, F.lit(False))
