"""Incremental queries: the events table read as a stream, checked against the same work in one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.checks import query
from vitrine.checks.views import table
from vitrine.operators.throttle import fixed_window_throttle
from vitrine.session import scratch_path
from vitrine.sources import aggregators as G, sinks as K
from vitrine.streaming import jobs as J


def event_stream(spark, sf):
    return J.read_stream(spark, sf, table(spark, sf, "events").schema, glob="events.parquet")


WINDOW_MS = 43_200_000
THROTTLE_SQL = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events),
w(user_id, o) AS (SELECT user_id, min(ms) FROM e GROUP BY user_id UNION ALL
  SELECT w.user_id, min(e.ms) FROM w JOIN e ON e.user_id = w.user_id AND e.ms > w.o + {WINDOW_MS} GROUP BY w.user_id, w.o),
p AS (SELECT e.user_id, event_id, ms, max(o) AS window_start FROM e JOIN w ON w.user_id = e.user_id AND w.o <= ms GROUP BY e.user_id, event_id, ms),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY ms, event_id) AS used FROM p)
SELECT user_id, event_id, CAST(window_start AS BIGINT) AS window_start, used, used <= 2 AS allowed FROM r"""


@query("q_fixed_window_throttle", THROTTLE_SQL)
def throttle(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    out = fixed_window_throttle(events, "user_id", "ts", "event_id", max_uses=2, window_ms=WINDOW_MS)
    return out.select("user_id", "event_id", "window_start", "used", "allowed")


@query("q_stream_throttle", THROTTLE_SQL)
def stream_throttle(spark, sf):
    previous = spark.conf.get(J.STATE_PROVIDER)
    path = scratch_path(spark, "throttle")
    try:
        judged = J.stream_throttle(event_stream(spark, sf), "user_id", "ts", "event_id", max_uses=2, window_ms=WINDOW_MS)
        J.append_to(judged, f"{path}/out", f"{path}/checkpoint")
    finally:
        spark.conf.set(J.STATE_PROVIDER, previous)
    out = spark.read.parquet(f"{path}/out")
    return out.select(F.col("key").alias("user_id"), F.col("tie").alias("event_id"), "window_start", "used", "allowed")


@query("q_stream_throttle_batches", THROTTLE_SQL)
def stream_throttle_batches(spark, sf):
    """The events in three landings, each judged with the windows the one before left open."""
    path = scratch_path(spark, "throttle")
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    ends = ["2024-01-09", "2024-01-20", "2025-01-01"]
    for start, end in zip(["2000-01-01", *ends], ends):
        events.filter((F.col("ts") >= start) & (F.col("ts") < end)).write.mode("append").parquet(f"{path}/landing")
        stream = J.read_stream(spark, f"{path}/landing", events.schema)
        J.stream_throttle_batches(stream, "user_id", "ts", "event_id", path, f"{path}/checkpoint", max_uses=2, window_ms=WINDOW_MS)
    return spark.read.parquet(f"{path}/judged").select("user_id", "event_id", "window_start", "used", "allowed")


@query("q_stream_daily_quota", """
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS used, greatest(count(*) - 3, 0) AS refused FROM events GROUP BY 1, 2""")
def stream_quota(spark, sf):
    """Sums of the verdicts given event by event."""
    out = quota_verdicts(spark, sf)
    day = F.col("day").cast("string").alias("day")
    sums = out.groupBy(F.col("key").alias("user_id"), day).agg(F.count(F.lit(1)).alias("used"), F.count_if(~F.col("allowed")).alias("refused"))
    return sums.select("user_id", "day", "used", "refused")


@query("q_stream_quota_verdicts", """
SELECT user_id, event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, used, used <= 3 AS allowed
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY epoch_us(ts) // 1000, event_id) AS used FROM events)""")
def stream_quota_verdicts(spark, sf):
    out = quota_verdicts(spark, sf)
    return out.select(F.col("key").alias("user_id"), F.col("tie").alias("event_id"), F.col("day").cast("string").alias("day"), "used", "allowed")


def quota_verdicts(spark, sf):
    previous = spark.conf.get(J.STATE_PROVIDER)
    path = scratch_path(spark, "quota")
    try:
        J.append_to(J.stream_quota_verdicts(event_stream(spark, sf), "user_id", "ts", "event_id", 3), f"{path}/out", f"{path}/checkpoint")
    finally:
        spark.conf.set(J.STATE_PROVIDER, previous)
    return spark.read.parquet(f"{path}/out")


@query("q_stream_dedupe", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, epoch_us(ts) // 60000000 AS minute FROM events) GROUP BY user_id")
def stream_dedupe(spark, sf):
    path = scratch_path(spark, "dedupe")
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000)
    stream = event_stream(spark, sf).withColumns({"ts": F.col("ts").cast("timestamp"), "id": F.concat_ws(":", "user_id", "event_type", minute)})
    J.append_to(J.stream_dedupe(stream, ["id"], "ts", "31 days").select("user_id", "id"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("q_stream_upsert", """
SELECT 'u' || user_id || ':' || event_type AS id, arg_max(event_id, row(epoch_us(ts), event_id)) AS event_id FROM events GROUP BY user_id, event_type""")
def stream_upsert(spark, sf):
    """The events in three landings; the table keeps the newest row per id."""
    path = scratch_path(spark, "upsert")
    events = table(spark, sf, "events")
    rows = events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("id"), F.col("event_type").alias("source"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_at"), "event_id", F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("landing"),
    )
    rows.repartition(3, "landing").write.parquet(f"{path}/landing")
    stream = J.read_stream(spark, f"{path}/landing", rows.schema, files_per_trigger=1).drop("landing")
    # the landings are picked up in any order
    J.stream_upsert(stream, f"{path}/table", f"{path}/checkpoint", buckets=2, newest=True)
    return K.read_staging(spark, f"{path}/table", rows.drop("landing").schema).select("id", "event_id")


@query("q_stream_ingest", """
SELECT 'nypl:o' || o_orderkey AS id, o_orderpriority || ', ' || (1800 + o_custkey % 150) AS title, CAST(1800 + o_custkey % 150 AS INT) AS year_start, 'ok' AS kind FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT 'line ' || o_orderkey, NULL, NULL, 'rejected' FROM orders WHERE o_orderkey % 50 = 0""")
def stream_ingest(spark, sf):
    """Two landings picked up by two runs of the same job; broken lines are set aside."""
    path = scratch_path(spark, "ingest")
    orders = table(spark, sf, "orders")
    rec = F.to_json(F.struct(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("uuid"), F.concat("o_orderpriority", F.lit(", "), (1800 + F.col("o_custkey") % 150).cast("string")).alias("title"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey").cast("string")).alias("imageID"),
    ))
    broken = F.concat(F.lit('{"line '), F.col("o_orderkey").cast("string"))
    lines = orders.select((F.col("o_orderkey") % 2).alias("half"), rec.alias("value")).unionByName(
        orders.filter("o_orderkey % 50 = 0").select((F.col("o_orderkey") % 4 == 0).cast("bigint").alias("half"), broken.alias("value"))
    )
    for half in (0, 1):
        lines.filter(F.col("half") == half).select("value").write.mode("append").text(f"{path}/landing")
        J.stream_ingest(spark, f"{path}/landing", G.NYPL.schema, G.NYPL.apply, f"{path}/items", f"{path}/checkpoint", f"{path}/rejects", glob="*.txt")
    items = spark.read.parquet(f"{path}/items").select("id", "title", "year_start", F.lit("ok").alias("kind"))
    rejects = spark.read.parquet(f"{path}/rejects").select(F.substring("value", 3, 100).alias("id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("year_start"), F.lit("rejected").alias("kind"))
    return items.unionByName(rejects)


@query("q_windowed_harvest", """
SELECT CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'before' WHEN ts >= TIMESTAMP '2024-01-13' THEN 'after' ELSE strftime(ts, '%Y-%m-%dT%H') END AS harvest_window, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1""")
def windowed_harvest(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    split = J.windowed_harvest(events, "ts", "2024-01-10", "2024-01-13", scratch_path(spark, "harvest"))
    return split.groupBy(F.col("harvest_window").cast("string").alias("harvest_window")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
