"""Catalog views over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrine.plans.text_index import TextIndex, build_index, read_index, write_index
from vitrine.schema import conform
from vitrine.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ITEMS_PART = """
SELECT p_partkey AS rid, p_brand AS source, p_brand || ':' || p_partkey AS id,
  CAST(p_partkey AS VARCHAR(20)) AS source_id, p_name AS title,
  'Workshop ' || p_size AS creator, p_type AS object_type,
  split_part(p_name, ' ', 2) AS medium,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS culture,
  split_part(p_name, ' ', 1) AS place,
  CASE WHEN p_partkey % 3 = 0 THEN TRUE WHEN p_partkey % 3 = 1 THEN FALSE END AS public_domain,
  CASE WHEN p_partkey % 3 = 0 THEN 'CC0' WHEN p_partkey % 3 = 1 THEN 'CC BY 4.0' END AS rights_label,
  CAST(1500 + p_partkey % 500 AS INT) AS year_start,
  CAST(1500 + p_partkey % 500 + p_size AS INT) AS year_end,
  CASE WHEN p_partkey % 97 = 0 THEN 2 ELSE 0 END AS boost,
  CASE WHEN p_partkey % 10 = 0 THEN '3d' ELSE 'image' END AS content_type,
  'https://img.example.org/' || p_partkey || '.jpg' AS thumb_url
FROM part
"""

ITEMS_DOC = """
SELECT doc_id AS rid, source, source || ':' || doc_id AS id, split_part(text, chr(10), 1) AS title,
  lang AS object_type, text, coalesce(quality, 0) AS boost,
  CAST(1500 + doc_id % 500 AS INT) AS year_start, CAST(1520 + doc_id % 500 AS INT) AS year_end,
  CASE WHEN doc_id % 10 = 0 THEN '3d' ELSE 'image' END AS content_type,
  CASE WHEN doc_id % 3 = 0 THEN TRUE WHEN doc_id % 3 = 1 THEN FALSE END AS public_domain
FROM documents LEFT JOIN labels USING (doc_id)
"""

PD_DEFAULT_SQL = "regexp_matches(source, '[02468]$')"


def pd_default() -> Column:
    return F.col("source").rlike("[02468]$")


def items_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return conform(spark.sql(ITEMS_PART))


def items_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    table(spark, sf_dir, "labels").createOrReplaceTempView("labels")
    return conform(spark.sql(ITEMS_DOC))


_INDEXES: dict[tuple, str] = {}


def doc_index(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> TextIndex:
    """Text index of all documents, built once per session and read by every search."""
    key = (spark.sparkContext.applicationId, sf_dir, stemmed)
    if key not in _INDEXES:
        path = scratch_path(spark, "text-index")
        write_index(build_index(items_doc(spark, sf_dir), stemmed=stemmed, land=False), path)
        _INDEXES[key] = path
    return read_index(spark, _INDEXES[key], stemmed)


def with_items(sql: str) -> str:
    return f"WITH items AS ({ITEMS_PART}) {sql}"


def with_docs(sql: str) -> str:
    return f"WITH items AS ({ITEMS_DOC}) {sql}"
