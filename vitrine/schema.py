"""Schemas of the normalized data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FILE = T.StructType(
    [
        T.StructField("format", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("label", T.StringType()),
    ]
)
FILES = T.ArrayType(FILE)

ITEM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("creator", T.StringType()),
        T.StructField("date_display", T.StringType()),
        T.StructField("year_start", T.IntegerType()),
        T.StructField("year_end", T.IntegerType()),
        T.StructField("object_type", T.StringType()),
        T.StructField("medium", T.StringType()),
        T.StructField("culture", T.StringType()),
        T.StructField("place", T.StringType()),
        T.StructField("public_domain", T.BooleanType()),
        T.StructField("rights_label", T.StringType()),
        T.StructField("license_url", T.StringType()),
        T.StructField("thumb_url", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("original_url", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("files", FILES),
        T.StructField("source_url", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("boost", T.IntegerType()),
        T.StructField("updated_at", T.LongType()),
    ]
)
ITEM_COLUMNS = [f.name for f in ITEM.fields]

# searchable columns, in index order
TEXT_COLUMNS = ["title", "creator", "object_type", "medium", "culture", "place", "text"]


def file_struct(
    format: Column | str,
    url: Column,
    label: Column | str | None = None,
    filename: Column | None = None,
    size: Column | None = None,
) -> Column:
    def col(value, dtype):
        if value is None:
            return F.lit(None).cast(dtype)
        return (F.lit(value) if isinstance(value, str) else value).cast(dtype)

    return F.struct(
        col(format, "string").alias("format"),
        url.cast("string").alias("url"),
        col(filename, "string").alias("filename"),
        col(size, "bigint").alias("size"),
        col(label, "string").alias("label"),
    )


def no_files() -> Column:
    return F.array().cast(FILES)


def conform(df: DataFrame, **extra: Column) -> DataFrame:
    """Project ``df`` onto the item schema; absent columns become nulls, other columns are kept last."""
    have = set(df.columns)
    cols = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in ITEM.fields
    ]
    rest = [F.col(c) for c in df.columns if c not in set(ITEM_COLUMNS)]
    return df.select(*cols, *rest, *[c.alias(n) for n, c in extra.items()])
