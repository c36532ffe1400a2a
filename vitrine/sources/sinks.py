"""Staging table, source reload and the download manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vitrine.operators.ranking import first_per_key
from vitrine.session import landed

STAGING_BUCKETS = 64
MAX_LISTED_FOLDERS = 4096
# what a table remembers of its first write; readers pass over names with this first letter
LAYOUT = "_layout"


def staging_bucket(key: Column, buckets: int = STAGING_BUCKETS) -> Column:
    """Part of a source an id belongs to, so that a write rewrites parts and not a whole source."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def last_writes(rows: DataFrame) -> DataFrame:
    """Newest version of every id (``updated_at``, then ``seq`` where the table has one)."""
    order = [F.col("updated_at").desc_nulls_last()]
    if "seq" in rows.columns:
        order.append(F.col("seq").desc_nulls_last())
    return first_per_key(rows, ["id"], order)


def read_staging(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([f for f in schema.fields if f.name not in ("source", "bucket")])
    full = full.add("source", T.StringType()).add("bucket", T.IntegerType())
    return spark.read.schema(full).parquet(path)


def upsert_staging(batch: DataFrame, path: str, buckets: int = STAGING_BUCKETS, newest: bool = False) -> None:
    """Insert or replace rows by id. Only (source, bucket) folders that hold or get one of the ids are rewritten.

    The batch wins over stored rows, or with ``newest`` the row with the later ``updated_at``,
    for batches that may arrive out of order. Within the batch the newest row wins. An id has one bucket whatever its
    source, so an id that moves to another source is looked for in its bucket alone, by a scan of ids, and its old
    row goes. The number of buckets is that of the table's first write; a later ``buckets`` is not used.
    The write goes to a staging folder and is renamed at commit, so a failed job leaves the table as it was; folders
    that lost their last row are removed after it, and repeating the batch ends what a failure in between left.
    """
    spark = batch.sparkSession
    there = _exists(spark, path)
    if there:
        buckets = _stored_buckets(spark, path) or buckets
    fresh = last_writes(batch).withColumn("bucket", staging_bucket(F.col("id"), buckets))
    layout = [*[c for c in fresh.columns if c not in ("source", "bucket")], "source", "bucket"]
    fresh = fresh.select(*layout)
    emptied = []
    if there:
        # read several times below
        fresh = landed(fresh, "upsert")
        table = read_staging(spark, path, fresh.schema)
        moved = _moved(table, fresh)
        stored = _touched_rows(table, fresh.select("source", "bucket").unionByName(moved).distinct()).select(*layout)
        if newest:
            fresh = last_writes(stored.unionByName(fresh))
        else:
            fresh = stored.join(fresh.select("id"), "id", "left_anti").select(*layout).unionByName(fresh)
        if not moved.isEmpty():
            fresh = landed(fresh, "upserted")
            emptied = moved.join(fresh, ["source", "bucket"], "left_anti").collect()  # at most one row a folder
    (
        fresh.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source", "bucket")
        .parquet(path)
    )
    for folder in emptied:
        fs, target = _file_system(spark, f"{_source_folder(spark, path, folder.source)}/bucket={folder.bucket}")
        fs.delete(target, True)
    if not there:
        spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").json(f"{path}/{LAYOUT}")


def _stored_buckets(spark: SparkSession, path: str) -> int | None:
    if not _exists(spark, f"{path}/{LAYOUT}"):
        return None
    found = spark.read.schema("buckets int").json(f"{path}/{LAYOUT}").first()
    return found and found.buckets


def _moved(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """Folders that hold an id of the batch under another source: source, bucket."""
    mine = fresh.select("id", F.col("source").alias("_to"), "bucket")
    held = table.select("id", "source", "bucket").join(mine, ["bucket", "id"]).filter(~F.col("source").eqNullSafe(F.col("_to")))
    return landed(held.select("source", "bucket").distinct(), "moved")


def _touched_rows(stored: DataFrame, touched: DataFrame) -> DataFrame:
    """Stored rows in the named folders."""
    listed = touched.limit(MAX_LISTED_FOLDERS + 1).collect()
    if len(listed) > MAX_LISTED_FOLDERS:
        return stored.join(touched, ["source", "bucket"], "left_semi")
    # few folders: name them in the plan, so that the others are not even listed
    folder = F.concat_ws("/", F.col("source"), F.col("bucket").cast("string"))
    return stored.filter(
        F.col("source").isin(sorted({r.source for r in listed}))
        & F.col("bucket").isin(sorted({r.bucket for r in listed}))
        & folder.isin([f"{r.source}/{r.bucket}" for r in listed])
    )


def _source_folder(spark: SparkSession, path: str, source: str) -> str:
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return f"{path}/source={utils.escapePathName(source)}"


def drop_source(spark: SparkSession, path: str, source: str) -> None:
    """Remove a source's rows before a fresh load: its folder goes, no other file is touched."""
    fs, target = _file_system(spark, _source_folder(spark, path, source))
    fs.delete(target, True)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


MANIFEST = ["title", "source", "creator", "date", "rights", "record url", "file"]


def manifest(items: DataFrame, file: str = "file") -> DataFrame:
    """Manifest rows of downloaded items; whitespace inside a cell becomes one space."""
    cells = ["title", "source_name", "creator", "date_display", "rights_label", "source_url", file]
    return items.select(
        *[F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\s\p{Z}\x{FEFF}]+", " ").alias(n) for c, n in zip(cells, MANIFEST)]
    )


def write_manifest_tsv(items: DataFrame, path: str, file: str = "file") -> None:
    manifest(items, file).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option(
        "emptyValue", ""
    ).csv(path)
