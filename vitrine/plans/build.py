"""Catalog build: validate, cap, dedupe, compact, write."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrine.functions.text import ext_of, trim_to
from vitrine.functions.rights import UNCLEAR
from vitrine.functions.urls import (
    URL_RULES, compact_images, default_record_url, elide_record_url, expand_images, restore_record_url,
)
from vitrine.operators.caps import cap_per_source, dedupe_priority
from vitrine.operators.filters import drop_redundant_files, titled_only, validate_items
from vitrine.operators.ranking import BUCKET_ROWS, bucket_rank, seq_bucket
from vitrine.schema import FILES, file_struct, no_files
from vitrine.session import landed

# Optional budgets of display text per column. The build keeps whole texts unless asked.
DISPLAY_BUDGET = {"creator": 140, "object_type": 100, "medium": 160, "culture": 100, "place": 100}
# Optional budgets of indexed free text. The build indexes whole texts unless asked.
TEXT_BUDGETS = {"flickr": 120, "europeana": 150, "nypl": 60}
DEFAULT_TEXT_BUDGET = 260


def source_defaults(spark: SparkSession, extra: Mapping[str, tuple] | None = None) -> DataFrame:
    """Default rights per source: source, default_pd, default_label, default_license."""
    rows = [
        (s, r.rights.public_domain, r.rights.label, r.rights.license_url) for s, r in URL_RULES.items() if r.rights
    ]
    rows += [(s, *v) for s, v in (extra or {}).items()]
    return spark.createDataFrame(rows, "source string, default_pd boolean, default_label string, default_license string")


def with_defaults(items: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """Attach the source defaults: the fixed table of this module, or one of the caller's."""
    if defaults is None:
        return items.join(F.broadcast(source_defaults(items.sparkSession)), "source", "left")
    return items.join(defaults, "source", "left")


def elide_rights(items: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """Null the three rights columns when they equal the source default."""
    df = with_defaults(items, defaults)
    same = (
        F.col("default_label").isNotNull()
        & F.col("default_pd").eqNullSafe(F.col("public_domain"))
        & F.col("default_label").eqNullSafe(F.col("rights_label"))
        & F.col("default_license").eqNullSafe(F.col("license_url"))
    )
    flags = {c: F.when(~same, F.col(c)) for c in ("public_domain", "rights_label", "license_url")}
    return df.withColumns(flags).drop("default_pd", "default_label", "default_license")


def restore_rights(items: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """Inverse of :func:`elide_rights`: a null label stands for the source default."""
    df = with_defaults(items, defaults)
    own = F.col("rights_label").isNotNull()
    return df.withColumns(
        {
            "public_domain": F.when(own | F.col("default_label").isNull(), F.col("public_domain")).otherwise(F.col("default_pd")),
            "license_url": F.when(own, F.col("license_url")).otherwise(F.coalesce("default_license", "license_url")),
            "rights_label": F.coalesce("rights_label", "default_label", F.lit(UNCLEAR.label)),
        }
    ).drop("default_pd", "default_label", "default_license")


def trim_display(items: DataFrame, budgets: Mapping[str, int] = DISPLAY_BUDGET) -> DataFrame:
    return items.withColumns({c: trim_to(c, n) for c, n in budgets.items() if c in items.columns})


def trim_text(items: DataFrame, budgets: Mapping[str, int] = TEXT_BUDGETS, default: int = DEFAULT_TEXT_BUDGET) -> DataFrame:
    """Cut the indexed free text to the source's budget."""
    text = F.col("text")
    out = None
    for source, n in budgets.items():
        cond = F.col("source") == source
        out = F.when(cond, trim_to(text, n)) if out is None else out.when(cond, trim_to(text, n))
    cut = trim_to(text, default)
    return items.withColumn("text", cut if out is None else out.otherwise(cut))


def compact(items: DataFrame) -> DataFrame:
    """Replace the three image URLs and the record URL by a key where they can be rebuilt."""
    df = items.withColumn("img", compact_images(F.col("source"), F.col("thumb_url"), F.col("image_url"), F.col("original_url")))
    # a step of its own: a column named inside a lambda would pick up the new value of that column
    df = df.withColumn("files", drop_redundant_files(F.coalesce("files", no_files()), F.col("original_url")))
    kept = {c: F.when(F.col("img").isNull(), F.col(c)) for c in ("thumb_url", "image_url", "original_url")}
    record = default_record_url(F.col("source"), F.col("source_id"), F.col("img"))
    return df.withColumns({**kept, "source_url": elide_record_url(F.col("source_url"), record)})


def build_catalog(
    staged: DataFrame,
    feed_order: Sequence[str],
    caps: Mapping[str, int] | None = None,
    defaults: DataFrame | None = None,
    text_budgets: Mapping[str, int] | None = None,
    display_budgets: Mapping[str, int] | None = None,
) -> DataFrame:
    """Catalog rows from staged items.

    ``staged`` has the item columns plus ``feed`` (which ingest a row came from) and ``seq``
    (unique arrival number). Caps count per feed and before the dedupe; on a repeated id the
    feed named first in ``feed_order`` wins. Nothing is capped or cut by default: the published
    numbers are ``caps=FEED_CAPS``, ``text_budgets=TEXT_BUDGETS``, ``display_budgets=DISPLAY_BUDGET``.
    An index over uncut texts is built before the display texts are cut.
    """
    place = F.coalesce(F.array_position(F.lit(list(feed_order)), F.col("feed")), F.lit(0))
    place = F.when(place == 0, len(feed_order) + 1).otherwise(place)
    valid = titled_only(validate_items(staged))
    kept = cap_per_source(valid, caps, key="feed", seq="seq") if caps else valid
    # without the feed name, feeds outside the list would have no order among themselves
    once = dedupe_priority(kept, "id", [place.asc(), F.col("feed").asc(), F.col("seq").asc()])
    if text_budgets is not None:
        once = trim_text(once, text_budgets)
    stored = compact(once)
    if display_budgets is not None:
        stored = trim_display(stored, display_budgets)
    return elide_rights(stored, defaults).drop("feed")


def number_rows(catalog: DataFrame, seq: str = "seq") -> DataFrame:
    """Dense row number ``rid`` by arrival. The built catalog is landed first: the ranking reads it twice."""
    return bucket_rank(landed(catalog, "catalog"), [], [seq_bucket(F.col(seq), BUCKET_ROWS)], [F.col(seq).asc()], rank="rid")


def write_catalog(catalog: DataFrame, path: str, built_at: str | None = None) -> None:
    """Write by source, and within a source by row number, so that a page is read from the row groups that hold it.

    A search for words filters in its index and asks the catalog for row numbers alone. Rows without numbers are
    clustered by content type and year instead. Ranges cut a large source over many tasks, the hash splits rows that
    are equal otherwise.
    """
    stamp = built_at or datetime.now(timezone.utc).isoformat()
    out = catalog.withColumn("built_at", F.lit(stamp))
    cluster = ["source", "rid"] if "rid" in out.columns else ["source", "content_type", "year_start"]
    spread = out.repartitionByRange(*cluster, F.xxhash64("id")).sortWithinPartitions(*cluster)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("source").parquet(path)


def read_catalog(spark: SparkSession, path: str, sources: Sequence[str] | None = None) -> DataFrame:
    """Read a catalog; with ``sources`` only their folders are listed and read."""
    df = spark.read.parquet(path)
    # folder names are read back as their own type (a source called "7" would become a number)
    df = df.withColumn("source", F.col("source").cast("string"))
    return df.filter(F.col("source").isin(list(sources))) if sources else df


def parse_files(text: Column) -> Column:
    """Files from JSON text; unreadable text gives no files."""
    return F.coalesce(F.from_json(text, FILES), no_files())


def row_to_item(catalog: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """Public item of a catalog row: image fallbacks, restored rights and record URL, original file first."""
    df = restore_rights(catalog, defaults)
    df = df.withColumn("_img", F.when(
        F.col("img").isNotNull(), expand_images(F.col("source"), F.col("img"))
    ).otherwise(F.struct(F.col("thumb_url").alias("thumb"), F.col("image_url").alias("image"), F.col("original_url").alias("original"))))
    original, image = F.col("_img.original"), F.col("_img.image")
    files = F.coalesce("files", no_files())
    is_cma = F.col("source") == "cma"
    first = file_struct(
        F.coalesce(ext_of(original), F.lit("jpg")), original,
        F.when(is_cma, F.lit("Full resolution TIFF")).otherwise(F.lit("Original")),
    )
    second = F.when(is_cma & image.isNotNull(), F.array(file_struct("jpg", image, "Print (~3400px)"))).otherwise(no_files())
    missing = (F.col("content_type") == "image") & (F.coalesce(original, F.lit("")) != "") & ~F.exists(files, lambda f: f["url"] == original)
    record = default_record_url(F.col("source"), F.col("source_id"), F.col("img"))
    return df.withColumns(
        {
            "files": F.when(F.coalesce(missing, F.lit(False)), F.concat(F.array(first), second, files)).otherwise(files),
            "source_url": restore_record_url(F.col("source_url"), record),
            "thumb_url": F.col("_img.thumb"),
            "image_url": F.coalesce(image, F.col("_img.thumb")),
            "original_url": F.coalesce(original, image, F.col("_img.thumb")),
        }
    ).drop("_img")


def item_urls(df: DataFrame) -> Column:
    """All URLs of an item, images first."""
    return F.filter(
        F.concat(F.array("thumb_url", "image_url", "original_url"), F.transform(F.coalesce("files", no_files()), lambda f: f["url"])),
        lambda u: u.isNotNull() & (u != ""),
    )


def rendition_order(size: str = "orig") -> Column:
    """Distinct image URLs in the order a download tries them."""
    names = ["image_url", "original_url", "thumb_url"] if size == "view" else ["original_url", "image_url", "thumb_url"]
    return F.array_distinct(F.array_compact(F.array(*[F.nullif(n, F.lit("")) for n in names])))


# Display data per source.
SOURCE_DISPLAY = {
    "met": ("The Met", "https://www.metmuseum.org/art/collection", "CC0 (Open Access)"),
    "aic": ("Art Institute of Chicago", "https://www.artic.edu/collection", "CC0 (public domain works)"),
    "cma": ("Cleveland Museum of Art", "https://www.clevelandart.org/art/collection/search", "CC0 (Open Access)"),
    "nga": ("National Gallery of Art", "https://www.nga.gov/collection", "CC0 (Open Access)"),
    "rijks": ("Rijksmuseum", "https://www.rijksmuseum.nl/en/collection", "Public domain works"),
    "si": ("Smithsonian", "https://www.si.edu/openaccess", "CC0 (Open Access)"),
    "nasa3d": ("NASA 3D Resources", "https://science.nasa.gov/3d-resources/", "Public domain (NASA)"),
    "nih3d": ("NIH 3D", "https://3d.nih.gov/", "Per model (PD / CC BY)"),
    "harvard": ("Harvard Art Museums", "https://harvardartmuseums.org/collections", "Verify per object"),
    "smk": ("SMK (Denmark)", "https://open.smk.dk/en/", "Public domain / CC0"),
    "nypl": ("NYPL Digital Collections", "https://digitalcollections.nypl.org/", "Public domain"),
    "flickr": ("Flickr Commons", "https://www.flickr.com/commons", "No known restrictions / CC0"),
    "europeana": ("Europeana", "https://www.europeana.eu/en/collections", "PD / CC0 / CC BY (per record)"),
    "wellcome": ("Wellcome Collection", "https://wellcomecollection.org/collections", "PD / CC BY"),
}


def source_display(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(k, *v) for k, v in SOURCE_DISPLAY.items()], "source string, name string, homepage string, license string"
    )


def with_source_name(items: DataFrame, display: DataFrame | None = None) -> DataFrame:
    """Display name of the source, or its key."""
    table = F.broadcast(source_display(items.sparkSession)) if display is None else display
    named = items.join(table.select("source", F.col("name").alias("_name")), "source", "left")
    return named.withColumn("source_name", F.coalesce("_name", "source")).drop("_name")
