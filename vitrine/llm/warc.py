"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Reading splits archives anywhere. Every place where the magic stands is a candidate record; its header gives
the offset of its successor. A record is real if it can be reached from the start of its file: pointer jumping
doubles the reach of each round. A magic inside a payload, even with a whole record after it, is not reached
and stays payload.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import broadcast_if, text_of
from vitrine.session import landed, scratch_path

# Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: eight groups of 20 bits, four digits each."""
    groups = [
        F.translate(
            F.lpad(F.lower(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32)), 4, "0"),
            "0123456789abcdefghijklmnopqrstuv",
            "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
        )
        for i in range(8)
    ]
    return F.concat(*groups)


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.coalesce(page_id.cast("string"), F.lit("none")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per row of ``pages`` (page_id, url, html) in archives below ``path``.

    Of equal payloads the largest page_id is the response (also each row that repeats that id), the others
    are revisits. Rows without an id are revisits, unless no row of the group has one. A null html is an
    empty payload; a null url is left out, line breaks in one are percent-encoded.
    """
    text = text_of("html")
    digests = landed(pages.select("page_id", F.sha1(text).alias("digest")), "payloads")
    first = digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    first = landed(first.where("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to"), "shared")
    again = digests.join(broadcast_if(first, 500_000), "digest").where("NOT (page_id <=> refers_to)").distinct()
    again = landed(again.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to"),
                   "revisits")
    rows = pages.select("page_id", "url", text.alias("payload"), F.sha1(text).alias("digest"))
    rows = rows.join(
        broadcast_if(again, 500_000),
        F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")),
        "left",
    )
    revisit = F.col("r_digest").isNotNull()
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    address = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", address), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        F.when(
            revisit,
            F.concat(line("WARC-Refers-To", _record_id(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE))),
        ).otherwise(F.lit("")),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    # a record ends with two line breaks, so a text file with that line separator is an archive
    rows.select(F.concat(header, block).alias("value")).write.option("lineSep", END).text(path)


_CANDIDATES = (
    "file string, block long, start long, end long, size long, type string, record_id string, refers string, "
    "page_id long, said string, digest string, bytes long, whole boolean"
)


def _header(data: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields and the offset of the block behind them."""
    at = data.find(b"\r\n\r\n")
    if at < 0:
        return None
    fields = {}
    for x in data[:at].split(b"\r\n"):
        name, _, value = x.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return (fields, at + 4) if fields.get("content-length", "").isdecimal() else None


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _payload(block: bytes) -> bytes:
    """What is behind the HTTP header of a block."""
    return block.partition(b"\r\n\r\n")[2]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Archives cut at every magic: (file, block, value), in file order within a block."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").cast("binary").alias("value"),
        )
    )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches with the start of each piece relative to the first piece of its block."""
    now, at = None, 0
    for batch in batches:
        starts = []
        files, blocks, values = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for i, key in enumerate(zip(files, blocks, strict=True)):
            if key != now:
                now, at = key, 0
            starts.append(at)
            at += len(values[i].as_buffer()) + len(MAGIC)
        yield batch, starts


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Landed candidate records: file, offset, successor, header fields, and the payload's digest and size where
    no magic is inside (``whole``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _placed(batches):
            rows = []
            for i, start in enumerate(starts):
                data = batch.column(2)[i].as_py()
                head = _header(data)
                row = [start, start + len(data) + len(MAGIC), None, None, None, None, None, None, None, None, False]
                if head:
                    fields, at = head
                    size = int(fields["content-length"])
                    page = fields.get("x-page-id", "")
                    row[2:8] = [
                        at + size + 4,
                        fields.get("warc-type"),
                        fields.get("warc-record-id"),
                        fields.get("warc-refers-to"),
                        int(page) if page.lstrip("-").isdecimal() else None,
                        fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                    ]
                    if len(data) == at + size + 4 and data.endswith(b"\r\n\r\n"):
                        payload = _payload(data[at:-4])
                        row[8:] = [_digest(payload), len(payload), True]
                rows.append(row)
            columns = list(zip(*rows, strict=True)) or [[]] * 11
            kinds = (*[pa.int64()] * 3, *[pa.string()] * 3, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            names = [x.split()[0] for x in _CANDIDATES.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                names=names,
            )

    found = landed(_pieces(spark, path).mapInArrow(run, _CANDIDATES), "candidates")
    magic = len(MAGIC)
    placed = found.join(F.broadcast(_bases(found)), ["file", "block"])
    return landed(
        placed.withColumn("offset", F.col("base") + F.col("start") - magic)
        .withColumn("next", F.col("offset") + magic + F.col("size"))
        .where("offset >= 0")
        .drop("base", "start", "end", "block"),
        "candidates",
    )


def _bases(found: DataFrame) -> DataFrame:
    """(file, block, base): where the first piece of each block starts; one row per block read."""
    ends = found.groupBy("file", "block").agg(F.max("end").alias("length"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("file", "block", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("base"))


def reachable(found: DataFrame) -> DataFrame:
    """(file, offset) of the candidates that the chain from the start of their file meets.

    After round k everything up to 2^k - 1 steps away is known, and ``jump`` leads 2^k steps ahead.
    """
    jump = found.where("next IS NOT NULL").select("file", "offset", "next")
    there = found.select("file", "offset")
    reach = landed(there.where("offset = 0").distinct(), "reach")
    known = reach.count()
    while True:
        ahead = reach.join(jump, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        reach = landed(reach.unionByName(ahead.join(there, ["file", "offset"], "left_semi")).distinct(), "reach")
        now = reach.count()
        if now == known:
            return reach
        known = now
        further = jump.select("file", F.col("offset").alias("next"), F.col("next").alias("beyond"))
        jump = landed(
            jump.join(further, ["file", "next"]).select("file", "offset", F.col("beyond").alias("next")), "jump"
        )


def _assembled(spark: SparkSession, path: str, found: DataFrame, real: DataFrame) -> DataFrame:
    """(file, offset, digest, bytes) of real records with a magic inside: their pieces are read again and joined."""
    flagged = found.select("file", "offset", "whole").join(
        real.withColumn("real", F.lit(True)), ["file", "offset"], "left"
    )
    upto = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("real"), F.struct("offset", "whole")), ignorenulls=True).over(upto)
    parts = flagged.select("file", "offset", owner.alias("owner")).where("NOT owner.whole")
    parts = landed(parts.select("file", "offset", F.col("owner.offset").alias("owner")), "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _placed(batches):
            ends = [s + len(v.as_buffer()) + len(MAGIC) for s, v in zip(starts, batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()),
                 batch.column(2)],
                names=["file", "block", "start", "end", "value"],
            )

    again = _pieces(spark, path).mapInArrow(run, "file string, block long, start long, end long, value binary")
    bases = landed(_bases(again), "bases")
    placed = again.join(F.broadcast(bases), ["file", "block"]).select(
        "file", (F.col("base") + F.col("start") - len(MAGIC)).alias("offset"), "value"
    )
    texts = placed.join(broadcast_if(parts, 100_000), ["file", "offset"])
    records = texts.groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("pieces")
    )

    @F.arrow_udf("struct<digest:string,bytes:bigint>")
    def digest(column: pa.Array) -> pa.Array:
        out = []
        for pieces in column.to_pylist():
            data = MAGIC.encode().join(x["value"] for x in pieces)
            head = _header(data)
            payload = _payload(data[head[1] : head[1] + int(head[0]["content-length"])]) if head else b""
            out.append({"digest": _digest(payload), "bytes": len(payload)})
        return pa.array(out, pa.struct([("digest", pa.string()), ("bytes", pa.int64())]))

    joined = records.select("file", F.col("owner").alias("offset"), digest("pieces").alias("d"))
    return joined.select("file", "offset", F.col("d.digest").alias("digest2"), F.col("d.bytes").alias("bytes2"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per real record: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    Sizes and digests are those of the payload read; a revisit has those of the response it refers to.
    ``verified`` tells whether the digest is the one its header names. Archives without records give none.
    """
    found = candidates(spark, path)
    real = reachable(found)
    records = found.join(real, ["file", "offset"])
    if not records.where("NOT whole").isEmpty():
        more = landed(_assembled(spark, path, found, real), "assembled")
        records = records.join(more, ["file", "offset"], "left").withColumns(
            {"digest": F.coalesce("digest2", "digest"), "bytes": F.coalesce("bytes2", "bytes")}
        )
    records = landed(
        records.select("page_id", "type", "record_id", "refers", "said", "digest", "bytes"), "records"
    )
    responses = records.where("type = 'response'")
    origin = responses.groupBy(F.col("record_id").alias("refers")).agg(
        F.max("page_id").alias("refers_to"), F.max("digest").alias("o_digest"), F.max("bytes").alias("o_bytes")
    )
    plain = responses.select(
        "page_id",
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.lit(None).cast("bigint").alias("refers_to"),
        (F.col("digest") == F.col("said")).alias("verified"),
    )
    linked = records.where("type = 'revisit'").join(landed(origin, "responses"), "refers", "left")
    return plain.unionByName(
        linked.select(
            "page_id",
            F.col("o_bytes").alias("payload_bytes"),
            F.col("o_digest").alias("payload_digest"),
            F.col("type").alias("record_type"),
            "refers_to",
            F.coalesce(F.col("o_digest") == F.col("said"), F.lit(False)).alias("verified"),
        )
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new shared folder and read the archives back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path)
