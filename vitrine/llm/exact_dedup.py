"""Exact duplicates with a heavy-hitter split, in DataFrame functions only.

A frequent-items sketch of the Misra-Gries family (``approx_top_k``: per-task counters that are decremented
together and merged) names digests that may be frequent. Each named digest is then counted exactly, and the
winners, at most ``tracked`` rows, are broadcast, so rows of frequent digests are settled where they were
read. All other digests go through one ordinary shuffle; the sketch's error bound limits their group size to
about ``rows / tracked``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import SPACE, among, text_of, without
from vitrine.session import landed

#: counters of the sketch, and so the largest number of rows that are ever broadcast
TRACKED = 1024


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row (doc_id, text_sha256) per document; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(text_col), 256).alias("text_sha256"))


def frequent(rows: DataFrame, key: str, tracked: int = TRACKED) -> list[str]:
    """Keys that a frequent-items sketch still holds at the end: at most ``tracked``.

    Partitions are sketched in 64 groups; the groups' summaries, ``tracked`` counters each, are merged by
    adding up the counters of equal keys.
    """
    some = rows.groupBy((F.spark_partition_id() % 64).alias("g")).agg(
        F.expr(f"approx_top_k({key}, {tracked}, {tracked})").alias("tops")
    )
    found = (
        some.select(F.explode("tops").alias("top"))
        .groupBy("top.item")
        .agg(F.sum("top.count").alias("n"))
        .where("item IS NOT NULL AND n > 1")
        .orderBy(F.desc("n"), "item")
        .limit(tracked)
    )
    return [x["item"] for x in found.collect()]


def _judged(docs: DataFrame, id_col: str, text_col: str, tracked: int) -> DataFrame:
    """Landed digests with the winner of their group: a struct (no_id, doc_id, rid) whose smallest wins."""
    rows = landed(digests(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "digests")
    named = F.col("text_sha256").isin(frequent(rows, "text_sha256", tracked))
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("rid"))
    group = (F.min(me).alias("first"), F.count(F.lit(1)).alias("group_size"))
    winners = rows.where(named).groupBy("text_sha256").agg(*group)
    winners = landed(winners, "winners")  # verified: exact counts of at most ``tracked`` digests
    settled = rows.join(F.broadcast(winners), "text_sha256", "inner")
    same = Window.partitionBy("text_sha256")
    rest = rows.where(~named).select(
        "text_sha256",
        "doc_id",
        "rid",
        F.min(me).over(same).alias("first"),
        F.count(F.lit(1)).over(same).alias("group_size"),
    )
    return settled.select(*rest.columns).unionByName(rest)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED
) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space is one space. The row with the smallest id
    of a group stays; of rows that repeat that id, one. Rows without an id come after all others, so keep_id
    is null only in a group that has no id at all. Empty and null texts form one group. Other columns are not
    read; an empty table gives an empty result.
    """
    return _judged(docs, id_col, text_col, tracked).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The columns travel in one struct, so none of their names can clash with a name used here. Dropped rows are
    found again by id and digest. Rows that repeat both the id and the text of the row that stays are made
    distinct on these two; only they are shuffled whole for that.
    """
    judged = exact_duplicates(docs, id_col, text_col)
    gone = landed(
        judged.where(~F.col("kept"))
        .select("doc_id", "text_sha256", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again"))
        .distinct(),
        "dropped",
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    wide = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.sha2(normalised(text_col), 256).alias("sha"))
    on = {"id": "doc_id", "sha": "text_sha256"}
    out = without(wide, gone.select("doc_id", "text_sha256"), on)
    again = gone.where("again").select("doc_id", "text_sha256")
    if not again.isEmpty():
        out = out.unionByName(among(wide, again, on).dropDuplicates(["id", "sha"]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
