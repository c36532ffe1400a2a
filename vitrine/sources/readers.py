"""Readers of landed raw files. Schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vitrine.functions.text import nonblank
from vitrine.sources.aggregators import PATENT_SCHEMA
from vitrine.sources.museums import OAI_RECORD

CORRUPT = "_corrupt_record"


def read_csv_records(spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """CSV with quoted fields and embedded newlines, every column a string; missing cells are ''.

    The header decides the positions, so files may order or extend the columns freely.
    ``multi_line=False`` lets Spark split one large file when no field holds a newline.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
        .option("inferSchema", False)
        .csv(path)
    )
    # header cells may carry blanks and a byte order mark
    names = {c.replace("﻿", "").strip(): c for c in raw.columns}
    picked = [
        F.coalesce(F.col(f"`{names[c]}`"), F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in columns
    ]
    return raw.select(*picked)


def read_ndjson_records(spark: SparkSession, path: str, schema: str, glob: str | None = None, partitions: int | None = None) -> DataFrame:
    """One JSON object per line, gzip or plain; blank and malformed lines are dropped.

    A gzip file is one task: ``partitions`` spreads its rows before the heavy projection.
    """
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.json(path)
    return df.repartition(partitions) if partitions else df


def read_with_rejects(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good records, and the text of the lines that could not be parsed."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    tagged = T.StructType.fromDDL(schema).add(CORRUPT, T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.withColumn("v", F.from_json("value", tagged, options))
    broken = F.col(f"v.{CORRUPT}").isNotNull()
    good = parsed.filter(~broken).select("v.*").drop(CORRUPT)
    return good, parsed.filter(broken).select(F.col("value").alias("line"))


def read_oai_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of OAI-PMH ListRecords pages; entities are decoded by the reader."""
    return spark.read.format("xml").option("rowTag", "record").schema(OAI_RECORD).load(path)


def read_json_pages(spark: SparkSession, path: str, array_path: str, record_schema: str) -> DataFrame:
    """Landed API pages, one JSON document per file: explode the row array at ``array_path``.

    An empty path means the document itself is the array.
    """
    if not array_path:
        schema = T.StructType.fromDDL(record_schema)
        return spark.read.schema(schema).option("multiLine", True).json(path)
    dtype: T.DataType = T.ArrayType(T.StructType.fromDDL(record_schema))
    for name in reversed(array_path.split(".")):
        dtype = T.StructType([T.StructField(name, dtype)])
    pages = spark.read.schema(dtype).option("multiLine", True).json(path)
    return pages.select(F.explode(array_path).alias("r")).select("r.*")


def read_patent_pages(spark: SparkSession, path: str) -> DataFrame:
    """Patent search answers as text files: either result clusters or a flat result list."""
    pages = spark.read.option("wholetext", True).text(path)
    return parse_patent_pages(pages, F.col("value"))


def parse_patent_pages(pages: DataFrame, text: Column) -> DataFrame:
    """The answer may hide in a ``content`` field that is an object or JSON text, after a prefix."""
    body = f"results struct<cluster:array<struct<result:array<struct<patent:struct<{_ddl(PATENT_SCHEMA)}>>>>>>"
    flat = f"organic_results array<struct<{_ddl(PATENT_SCHEMA)}>>"
    # text before the first brace is a guard prefix
    outer = F.regexp_replace(text, r"(?s)^[^{]*", "")
    content = F.get_json_object(outer, "$.content")
    inner = F.regexp_replace(F.coalesce(nonblank(content), outer), r"(?s)^[^{]*", "")
    answer = pages.select(F.from_json(inner, f"{body}, {flat}").alias("a"))
    clustered = F.flatten(F.transform("a.results.cluster", lambda c: F.coalesce(c["result"], F.array().cast(f"array<struct<patent:struct<{_ddl(PATENT_SCHEMA)}>>>"))))
    records = F.coalesce(F.transform(clustered, lambda r: r["patent"]), F.col("a.organic_results"))
    return answer.select(F.explode(records).alias("p")).select("p.*")


def _ddl(columns: str) -> str:
    """``name type`` list in the colon form used inside struct<>."""
    return T.StructType.fromDDL(columns).simpleString()[len("struct<") : -1]


def read_dictionary(spark: SparkSession, path: str, max_words: int = 20000) -> dict[str, str]:
    """Two-column tab-separated word list (term, english). Its size is checked before it is collected."""
    rows = spark.read.schema("term string, english string").option("sep", "\t").csv(path).filter("english <> ''")
    found = rows.limit(max_words + 1).collect()
    if len(found) > max_words:
        raise ValueError(f"more than {max_words} words: pass the DataFrame to translate_terms")
    return {r.term.lower(): r.english for r in found}


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _pixels(content: pd.Series) -> pd.Series:
    import io

    from PIL import Image

    def grid(data: bytes):
        try:
            img = Image.open(io.BytesIO(data)).convert("RGB").resize((16, 16))
        except Exception:  # an unreadable image has no signature
            return None
        return np.asarray(img, dtype=np.int32).reshape(-1).tolist()

    return content.map(grid)


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Image files as 16 x 16 RGB pixel lists (768 integers). Needs Pillow on the executors."""
    try:
        import PIL  # noqa: F401
    except ImportError as e:
        raise ImportError("read_images needs Pillow; pass a table with a pixels column instead") from e
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", _pixels("content").alias("pixels")).filter("pixels IS NOT NULL")
