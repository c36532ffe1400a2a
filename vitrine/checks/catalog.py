"""Catalog queries: filters, caps, dedupe, merges, pages, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.checks import query
from vitrine.checks.views import PD_DEFAULT_SQL, items_part, pd_default, table, with_items
from vitrine.operators import aggregates as A, caps as C, filters as P, merge as M
from vitrine.operators.ranking import with_seq
from vitrine.plans.search import SearchParams, search
from vitrine.schema import conform
from vitrine.session import landed

SOURCE_COUNTS = "SELECT source, count(*) AS source_count FROM items GROUP BY source"
HASH = "((rid % 1000003) * 2654435761 + {seed}) % 1000003"


def sized(items):
    """Items with the size of their source, which orders sources in a merge."""
    sizes = items.groupBy("source").agg(F.count(F.lit(1)).alias("source_count"))
    return items.join(sizes, "source")




def source_order():
    return [F.col("source_count").desc(), F.col("source").asc()]


@query("q_source_summary", with_items(f"""
SELECT source, count(*) AS count, count(*) FILTER (content_type = 'image') AS images,
  count(*) FILTER (content_type = '3d') AS models,
  count(*) FILTER (coalesce(public_domain, {PD_DEFAULT_SQL})) AS pd
FROM items GROUP BY source"""))
def source_summary(spark, sf):
    return A.source_summary(items_part(spark, sf), pd_default())


@query("q_status", with_items(f"""
, shards AS (
  SELECT 0 AS shard, source, count(*) AS count, count(*) FILTER (content_type = 'image') AS images, count(*) FILTER (content_type = '3d') AS models
  FROM items GROUP BY source
  UNION ALL
  SELECT 1, source, count(*), count(*) FILTER (content_type = 'image'), count(*) FILTER (content_type = '3d')
  FROM items WHERE year_start >= 1600 GROUP BY source
), best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY count DESC, images DESC, models DESC) AS rn FROM shards)
SELECT source, count, (SELECT CAST(sum(count) AS BIGINT) FROM best WHERE rn = 1) AS total,
  concat_ws(',', CASE WHEN images > 0 THEN 'image' END, CASE WHEN models > 0 THEN '3d' END) AS kinds,
  CASE WHEN source = 'Brand#1' THEN 'First brand' ELSE source END AS name,
  CASE WHEN source = 'Brand#1' THEN 'https://brand.example.org' ELSE '' END AS homepage
FROM best WHERE rn = 1"""))
def status(spark, sf):
    items = items_part(spark, sf)
    display = spark.createDataFrame(
        [("Brand#1", "First brand", "https://brand.example.org", "CC0")],
        "source string, name string, homepage string, license string",
    )
    shards = A.source_summary(items, pd_default()).unionByName(
        A.source_summary(items.filter("year_start >= 1600"), pd_default())
    )
    out = A.catalog_status(shards, display)
    total = A.grand_total(A.catalog_status(shards)).scalar()
    return out.select("source", "count", total.alias("total"), F.array_join("content_types", ",").alias("kinds"), "name", "homepage")


@query("q_merge_totals", with_items("""
, parts AS (SELECT source, least(count(*), 40) AS hits FROM items WHERE content_type = 'image' GROUP BY source
  UNION ALL SELECT source, count(*) FROM items WHERE year_start < 1700 GROUP BY source)
SELECT source, max(hits) AS hits FROM parts GROUP BY source"""))
def merge_totals(spark, sf):
    items = items_part(spark, sf)
    images = items.filter("content_type = 'image'").groupBy("source").agg(F.least(F.count(F.lit(1)), F.lit(40)).alias("hits"))
    early = items.filter("year_start < 1700").groupBy("source").agg(F.count(F.lit(1)).alias("hits"))
    return A.merge_totals(images.unionByName(early))


@query("q_count_source", with_items("""
SELECT (SELECT count(*) FROM items) AS n_all, (SELECT count(*) FROM items WHERE source = 'Brand#7') AS n_one"""))
def count_source(spark, sf):
    items = items_part(spark, sf)
    one = A.count_source(items, "Brand#7").scalar()
    return A.count_source(items).select(F.col("n").alias("n_all"), one.alias("n_one"))


@query("q_per_source_totals", with_items("""
SELECT source, count(*) AS hits
FROM items WHERE content_type = 'image' GROUP BY source"""))
def per_source_totals(spark, sf):
    return A.per_source_totals(items_part(spark, sf).filter(P.content_is("image")))


@query("q_filter_facets", with_items(f"""
SELECT rid, source IN ('Brand#3', 'Brand#12') AS in_source, content_type = '3d' AS is_3d,
  coalesce(public_domain, {PD_DEFAULT_SQL}, FALSE) AS is_pd,
  year_start >= 1600 AND year_end <= 1750 AS in_years, year_start >= 1900 AS from_1900, year_end <= 1550 AS to_1550,
  object_type ILIKE '%oMo%' AS like_type, creator ILIKE '%shop 1%' AS like_creator, medium ILIKE '%\\%%' ESCAPE '\\' AS like_percent,
  coalesce(place ILIKE '%o%' OR culture ILIKE '%o%', FALSE) AS near_o, year_start IS NOT NULL AS dated
FROM items"""))
def filter_facets(spark, sf):
    return items_part(spark, sf).select(
        "rid",
        P.source_in(["Brand#3", "Brand#12"]).alias("in_source"),
        P.content_is("3d").alias("is_3d"),
        P.public_domain_only(pd_default()).alias("is_pd"),
        P.year_within(1600, 1750).alias("in_years"),
        P.year_within(1900, None).alias("from_1900"),
        P.year_within(None, 1550).alias("to_1550"),
        P.contains_ci("object_type", " oMo ").alias("like_type"),
        P.contains_ci("creator", "shop 1").alias("like_creator"),
        P.contains_ci("medium", "%").alias("like_percent"),
        F.coalesce(P.place_or_culture("o"), F.lit(False)).alias("near_o"),
        P.dated_only().alias("dated"),
    )


@query("q_filtered_items", with_items(f"""
SELECT rid, id, title FROM items
WHERE source <> 'Brand#9' AND content_type = 'image' AND coalesce(public_domain, {PD_DEFAULT_SQL}, FALSE)
  AND year_start >= 1550 AND year_end <= 1900 AND object_type ILIKE '%a%' AND (place ILIKE '%o%' OR culture ILIKE '%o%')"""))
def filtered_items(spark, sf):
    kept = items_part(spark, sf).filter(
        P.content_is("image") & P.public_domain_only(pd_default()) & P.year_within(1550, 1900)
        & P.contains_ci("object_type", "a") & P.place_or_culture("o")
    )
    return P.exclude_providers(kept, "source", ["Brand#9"]).select("rid", "id", "title")


@query("q_validate_items", """
WITH raw AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS title,
  CASE WHEN c_custkey % 5 = 0 THEN '3d' WHEN c_custkey % 5 = 1 THEN 'image' END AS kind,
  CASE WHEN c_custkey % 3 = 0 THEN 'https://t.example.org/' || c_custkey END AS thumb FROM customer)
SELECT 'shop:' || c_custkey AS id, CAST(c_custkey AS VARCHAR) AS source_id, coalesce(kind, 'image') AS content_type,
  'Rights unclear — check source' AS rights_label, CAST(0 AS INT) AS boost, CAST(0 AS INT) AS n_files
FROM raw WHERE title IS NOT NULL AND title <> '' AND (coalesce(kind, 'image') <> 'image' OR thumb IS NOT NULL)""")
def validate_items(spark, sf):
    raw = table(spark, sf, "customer").selectExpr(
        "concat('shop:', c_custkey) id", "'shop' source", "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END title",
        "CASE WHEN c_custkey % 5 = 0 THEN '3d' WHEN c_custkey % 5 = 1 THEN 'image' END content_type",
        "CASE WHEN c_custkey % 3 = 0 THEN concat('https://t.example.org/', c_custkey) END thumb_url",
    )
    kept = P.titled_only(P.validate_items(conform(raw)))
    return kept.select("id", "source_id", "content_type", "rights_label", "boost", F.size("files").alias("n_files"))



@query("q_cap_per_source", with_items(f"""
SELECT rid, source FROM (SELECT rid, source, row_number() OVER (PARTITION BY source
  ORDER BY boost DESC, {HASH.format(seed=0)}, source_id, rid) AS rn FROM items)
WHERE rn <= CASE source WHEN 'Brand#1' THEN 10 WHEN 'Brand#2' THEN 25 ELSE 40 END"""))
def cap_per_source(spark, sf):
    kept = C.cap_per_source(items_part(spark, sf), {"Brand#1": 10, "Brand#2": 25}, default=40)
    return kept.select("rid", "source")


@query("q_cap_lines", f"""
WITH lines AS (SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS rid, l_returnflag AS source,
  CASE WHEN l_quantity >= 49 THEN 2 ELSE 0 END AS boost, l_orderkey, l_partkey, l_extendedprice, l_suppkey, l_shipdate FROM lineitem)
SELECT source, count(*) AS n, CAST(sum(boost) AS BIGINT) AS boosts, CAST(sum(rid) AS BIGINT) AS rids FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY boost DESC, {HASH.format(seed=0)}, rid) AS rn FROM
  (SELECT source, boost, row_number() OVER (ORDER BY rid, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rid FROM lines))
WHERE rn <= 9000 GROUP BY source""")
def cap_lines(spark, sf):
    """A few huge sources: the cap leaves most buckets unsorted."""
    lines = table(spark, sf, "lineitem").selectExpr(
        "CAST(l_orderkey * 8 + l_linenumber AS BIGINT) k", "l_returnflag source", "CASE WHEN l_quantity >= 49 THEN 2 ELSE 0 END boost",
        "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
    )
    order = [F.col(c).asc() for c in ("k", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")]
    numbered = landed(with_seq(lines, order, [F.floor(F.col("k") / 65536)], "rid"), "lines").withColumn("source_id", F.col("rid"))
    kept = C.cap_per_source(numbered, {}, default=9000)
    return kept.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("boost").alias("boosts"), F.sum("rid").alias("rids")
    )


@query("q_dedupe_priority", """
SELECT doc_id, source, copies FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY
  CASE source WHEN 'src3' THEN 0 WHEN 'src0' THEN 1 ELSE 2 END, source, doc_id) AS rn, count(*) OVER (PARTITION BY md5(text)) AS copies
  FROM documents) WHERE rn = 1""")
def dedupe_priority(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("hash"))
    rank = F.when(F.col("source") == "src3", 0).when(F.col("source") == "src0", 1).otherwise(2)
    copies = docs.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"))
    kept = C.dedupe_priority(docs, "hash", [rank.asc(), F.col("source").asc(), F.col("doc_id").asc()])
    return kept.join(copies, "hash").select("doc_id", "source", "copies")


@query("q_latest", """
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1""")
def latest(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    last = C.latest_by_key(events, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    return last.select("user_id", "event_type", "event_id")


@query("q_browse_diverse", with_items(f"""
, sizes AS ({SOURCE_COUNTS}), ranked AS (SELECT rid, source, year_end - year_start AS score,
  row_number() OVER (PARTITION BY source ORDER BY year_end - year_start DESC, rid) AS rank FROM items)
SELECT rid, source, round(value, 6) AS value, pos FROM (
  SELECT rid, source, value, row_number() OVER (ORDER BY value DESC, source_count DESC, source, rank) AS pos FROM (
    SELECT rid, source, rank, source_count, CAST(score AS DOUBLE) / (1 + CAST(0.06 AS DOUBLE) * (rank - 1)) AS value FROM ranked JOIN sizes USING (source)))
WHERE pos > 50 AND pos <= 350"""))
def browse_diverse(spark, sf):
    scored = sized(items_part(spark, sf)).withColumn("score", (F.col("year_end") - F.col("year_start")).cast("double"))
    page = M.diverse_page(scored, source_order(), offset=50, limit=300)
    return page.select("rid", "source", F.round("value", 6).alias("value"), F.col("pos").cast("bigint").alias("pos"))


@query("q_diverse_signed", with_items(f"""
, sizes AS ({SOURCE_COUNTS}), ranked AS (SELECT rid, source, CAST(25 - (year_end - year_start) AS DOUBLE) AS score,
  row_number() OVER (PARTITION BY source ORDER BY 25 - (year_end - year_start) DESC, rid) AS rank FROM items),
vals AS (SELECT *, min(score / (1 + CAST(0.06 AS DOUBLE) * (rank - 1))) OVER (PARTITION BY source ORDER BY rank) AS value
  FROM ranked JOIN sizes USING (source) WHERE rank <= 200)
SELECT rid, source, round(value, 6) AS value, pos FROM (SELECT *, row_number() OVER (ORDER BY value DESC, source_count DESC, source, rank) AS pos FROM vals)
WHERE pos <= 200"""))
def diverse_signed(spark, sf):
    from vitrine.operators.ranking import top_n

    scored = sized(items_part(spark, sf)).withColumn("score", (25 - (F.col("year_end") - F.col("year_start"))).cast("double"))
    ranked = top_n(scored, ["source"], M.order_score(), 200, salt_by=["rid"], rank="rank")
    valued, order = M.diverse_order_signed(ranked, source_order())
    page = M.page(valued, order, 0, 200, "pos")
    return page.select("rid", "source", F.round("value", 6).alias("value"), F.col("pos").cast("bigint").alias("pos"))


@query("q_round_robin", with_items(f"""
, sizes AS ({SOURCE_COUNTS}), ranked AS (SELECT rid, source, row_number() OVER (PARTITION BY source ORDER BY {HASH.format(seed=11)}, rid) AS rank FROM items)
SELECT rid, source, pos FROM (SELECT *, row_number() OVER (ORDER BY rank, source_count DESC, source) AS pos FROM ranked JOIN sizes USING (source)) WHERE pos <= 400"""))
def round_robin(spark, sf):
    page = M.round_robin_page(sized(items_part(spark, sf)), M.order_random(11), source_order(), 0, 400)
    return page.select("rid", "source", F.col("pos").cast("bigint").alias("pos"))


def _page(items, order, offset, limit):
    out = M.page(items.select("rid", "source", "year_start", "boost"), order, offset, limit, "pos")
    return out.select("rid", "source", F.col("pos").cast("bigint").alias("pos"))


PAGE_SQL = "SELECT rid, source, pos FROM (SELECT rid, source, row_number() OVER (ORDER BY {order}) AS pos FROM items) WHERE pos > {lo} AND pos <= {hi}"


@query("q_oldest", with_items(PAGE_SQL.format(order="year_start, rid", lo=100, hi=350)))
def oldest(spark, sf):
    return _page(items_part(spark, sf), M.order_oldest(), 100, 250)


@query("q_newest", with_items(PAGE_SQL.format(order="year_start DESC, rid", lo=0, hi=250)))
def newest(spark, sf):
    return _page(items_part(spark, sf), M.order_newest(), 0, 250)


@query("q_random", with_items(PAGE_SQL.format(order=HASH.format(seed=7) + ", rid", lo=0, hi=500)))
def random_order(spark, sf):
    return _page(items_part(spark, sf), M.order_random(), 0, 500)


@query("q_browse_order", with_items(PAGE_SQL.format(order="boost DESC, " + HASH.format(seed=42) + ", rid", lo=0, hi=250)))
def browse_order(spark, sf):
    return _page(items_part(spark, sf), M.order_browse(42), 0, 250)


@query("q_top_per_source", with_items(f"""
SELECT rid, source FROM (SELECT rid, source, row_number() OVER (PARTITION BY source ORDER BY boost DESC, {HASH.format(seed=7)}, rid) AS rn FROM items)
WHERE rn <= {min(1500, 0 + 20 + 50)}"""))
def top_per_source(spark, sf):
    return M.top_per_source(items_part(spark, sf), M.order_browse(), M.candidates_needed(0, 20)).select("rid", "source")


@query("q_browse_search", with_items(f"""
, kept AS (SELECT * FROM items WHERE content_type = 'image' AND coalesce(public_domain, {PD_DEFAULT_SQL}, FALSE)),
sizes AS ({SOURCE_COUNTS}),
ranked AS (SELECT rid, source, boost, row_number() OVER (PARTITION BY source ORDER BY boost DESC, {HASH.format(seed=7)}, rid) AS rank FROM kept)
SELECT rid, source, CAST(boost AS DOUBLE) AS score, pos FROM (
  SELECT *, row_number() OVER (ORDER BY rank, source_count DESC, source) AS pos FROM ranked JOIN sizes USING (source) WHERE rank <= 300)
WHERE pos <= 250"""))
def browse_search(spark, sf):
    found = search(items_part(spark, sf), SearchParams(content="image", public_domain_only=True), pd_default=pd_default())
    return found.page.select("rid", "source", "score", F.col("pos").cast("bigint").alias("pos"))


DEEP_ITEMS = """
SELECT CAST(o_orderkey AS BIGINT) AS rid, 'orders' AS source, CAST(year(o_orderdate) AS INT) AS year_start, CAST(o_orderkey % 89 = 0 AS INT) AS boost FROM orders
UNION ALL SELECT CAST(10000000 + c_custkey AS BIGINT), 'customers', CAST(1900 + c_nationkey AS INT), 0 FROM customer"""


def deep_items(spark, sf) -> DataFrame:
    """Two sources of which one holds nearly all rows."""
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    return conform(spark.sql(DEEP_ITEMS))


@query("q_search_deep_page", f"""
WITH items AS ({DEEP_ITEMS}), sizes AS (SELECT source, count(*) AS source_count FROM items GROUP BY source)
SELECT rid, source, pos FROM (SELECT *, row_number() OVER (ORDER BY year_start DESC, source_count DESC, source, rid) AS pos FROM items JOIN sizes USING (source) WHERE year_start IS NOT NULL)
WHERE pos > 1200 AND pos <= 2100""")
def search_deep_page(spark, sf):
    """A long page far down the list, in rows that one source supplies."""
    found = search(deep_items(spark, sf), SearchParams(sort="newest", offset=1200, limit=900))
    return found.page.select("rid", "source", F.col("pos").cast("bigint").alias("pos"))


@query("q_browse_deep_page", f"""
WITH items AS ({DEEP_ITEMS}), sizes AS (SELECT source, count(*) AS source_count FROM items GROUP BY source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY boost DESC, {HASH.format(seed=7)}, rid) AS rank FROM items JOIN sizes USING (source))
SELECT rid, source, count AS hits FROM (SELECT rid, source, row_number() OVER (ORDER BY rank, source_count DESC, source) AS pos FROM ranked)
JOIN (SELECT source, count(*) AS count FROM items GROUP BY source) USING (source) WHERE pos > 1300 AND pos <= 1480""")
def browse_deep_page(spark, sf):
    """Random order beyond the smaller source, with the exact totals of both."""
    found = search(deep_items(spark, sf), SearchParams(offset=1300, limit=180))
    return found.page.select("rid", "source").join(found.per_source, "source").select("rid", "source", "hits")


@query("q_browse_relevance", with_items(f"""
, sizes AS ({SOURCE_COUNTS}),
ranked AS (SELECT rid, source, boost, row_number() OVER (PARTITION BY source ORDER BY boost DESC, {HASH.format(seed=3)}, rid) AS rank FROM items WHERE year_start >= 1600)
SELECT rid, source, round(value, 6) AS value, pos FROM (SELECT *, row_number() OVER (ORDER BY value DESC, source_count DESC, source, rank) AS pos FROM (
  SELECT *, CAST(boost AS DOUBLE) / (1 + CAST(0.06 AS DOUBLE) * (rank - 1)) AS value FROM ranked JOIN sizes USING (source) WHERE rank <= 250))
WHERE pos > 100 AND pos <= 200"""))
def browse_relevance(spark, sf):
    found = search(items_part(spark, sf), SearchParams(sort="relevance", seed=-3.7, year_from=1600, offset=100, limit=100))
    return found.page.select("rid", "source", F.round("value", 6).alias("value"), F.col("pos").cast("bigint").alias("pos"))


@query("q_queue_round_robin", """
WITH pending AS (SELECT c_custkey AS id, c_nationkey AS dept, CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END AS highlight
  FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dept ORDER BY highlight DESC, id % 97, id) AS rn,
  first_value(row(-highlight, id % 97, dept, id)) OVER (PARTITION BY dept ORDER BY highlight DESC, id % 97, id) AS f FROM pending)
SELECT id, dept, row_number() OVER (ORDER BY highlight DESC, rn, f) AS pos FROM ranked
ORDER BY pos LIMIT 300""")
def queue_round_robin(spark, sf):
    from pyspark.sql import Window

    customer = table(spark, sf, "customer").selectExpr(
        "c_custkey id", "c_nationkey dept", "CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END highlight"
    )
    done = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    pending = M.difference(customer, done, ["id"])
    queue = M.round_robin_queue(pending, "dept", [F.floor(F.col("id") / 65536)], limit=300)
    place = Window.orderBy("q_tier", "q_round", "q_group")
    return queue.select("id", "dept", F.row_number().over(place).cast("bigint").alias("pos"))


LINES = """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS seq,
  l_returnflag AS theme, l_suppkey AS provider, l_linestatus AS status FROM lineitem"""


def lines(spark, sf):
    cols = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    raw = table(spark, sf, "lineitem").select(*cols, F.col("l_returnflag").alias("theme"), F.col("l_suppkey").alias("provider"), F.col("l_linestatus").alias("status"))
    numbered = with_seq(raw, [F.col(c).asc() for c in cols], [F.floor(F.col("l_orderkey") / 8192)])
    return landed(numbered.select("seq", "theme", "provider", "status"), "lines")


@query("q_double_cap", f"""
WITH lines AS ({LINES}), one AS (SELECT *, row_number() OVER (PARTITION BY theme, provider ORDER BY seq) AS a FROM lines),
two AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY seq) AS b FROM one WHERE a <= 60)
SELECT seq, theme, provider FROM two WHERE b <= CASE theme WHEN 'A' THEN 900 ELSE 5000 END""")
def double_cap(spark, sf):
    cap = C.cap_column(F.col("theme"), {"A": 900}, 5000)
    return C.double_cap(lines(spark, sf), "theme", "provider", "seq", cap, 60, width=4096).select("seq", "theme", "provider")


@query("q_exempt_cap", f"""
WITH lines AS ({LINES}), r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY seq) AS n FROM lines)
SELECT seq, theme FROM r WHERE n <= 2000 OR provider % 50 = 0""")
def exempt_cap(spark, sf):
    kept = C.capped_with_exempt(lines(spark, sf), "theme", "seq", 2000, F.col("provider") % 50 == 0, width=4096)
    return kept.select("seq", "theme")


@query("q_account_cap", f"""
WITH lines AS ({LINES}), r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY seq) AS n FROM lines)
SELECT seq, provider FROM r WHERE n <= CASE provider WHEN 3 THEN 150 WHEN 5 THEN 10 ELSE 80 END""")
def account_cap(spark, sf):
    rows = lines(spark, sf).withColumn("account", F.col("provider").cast("string"))
    return C.account_cap(rows, "account", "seq", {"3": 150, "5": 10}, 80, width=4096).select("seq", "provider")


@query("q_lookup", with_items("""
, wanted(pos, id) AS (VALUES (0, 'Brand#2:0'), (1, (SELECT max(id) FROM items)), (2, 'nothing:1'), (3, (SELECT min(id) FROM items)), (4, (SELECT max(id) FROM items)))
SELECT CAST(pos AS INT) AS pos, id, title FROM wanted JOIN items USING (id)"""))
def lookup(spark, sf):
    items = items_part(spark, sf)
    ends = items.agg(F.max("id").alias("hi"), F.min("id").alias("lo")).first()
    found = M.lookup_items(items, ["Brand#2:0", ends.hi, "nothing:1", ends.lo, ends.hi])
    return found.select("pos", "id", "title")


@query("q_lookup_many", with_items("SELECT CAST(o_orderkey AS INT) AS pos, id, title FROM orders JOIN items ON items.rid = o_custkey"))
def lookup_many(spark, sf):
    """As many ids as there are orders, repeats and misses included."""
    items = items_part(spark, sf)
    ids = items.select("rid", "id").join(table(spark, sf, "orders"), F.col("rid") == F.col("o_custkey"))
    return M.lookup_items(items, ids.select("id", F.col("o_orderkey").cast("int").alias("pos"))).select("pos", "id", "title")


@query("q_append_page", with_items("""
, o AS (SELECT rid, id, row_number() OVER (ORDER BY year_start, rid) AS pos FROM items)
SELECT id, CASE WHEN pos <= 250 THEN 0 ELSE 1 END AS page FROM o WHERE pos <= 400"""))
def append_page(spark, sf):
    items = items_part(spark, sf).select("rid", "id", "year_start")
    shown = M.page(items, M.order_oldest(), 0, 250)
    more = M.page(items, M.order_oldest(), 200, 200)
    return M.append_page(shown, more).select("id", "page")


@query("q_distinct_ids", """
SELECT c_mktsegment AS id, c_custkey AS rid FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn = 1""")
def distinct_ids(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_mktsegment id", "c_custkey rid", "c_acctbal")
    return M.distinct_ids(rows, [F.col("c_acctbal").desc(), F.col("rid").asc()]).select("id", "rid")


@query("q_merge_candidates", with_items(f"""
, sizes AS ({SOURCE_COUNTS}), lists AS (
  SELECT 0 AS l, rid, id, source, CAST(year_end - year_start AS DOUBLE) AS score FROM items WHERE year_start < 1800
  UNION ALL SELECT 1, rid, id, source, CAST(2 * (year_end - year_start) AS DOUBLE) FROM items WHERE year_start >= 1600),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l, score DESC, rid) AS rn FROM lists) WHERE rn = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, rid) AS rank FROM once JOIN sizes USING (source))
SELECT rid, round(value, 6) AS value, pos FROM (SELECT rid, value, row_number() OVER (ORDER BY value DESC, source_count DESC, source, rank) AS pos
  FROM (SELECT *, score / (1 + CAST(0.06 AS DOUBLE) * (rank - 1)) AS value FROM ranked)) WHERE pos <= 200"""))
def merge_candidates(spark, sf):
    items = sized(items_part(spark, sf)).select("rid", "id", "source", "source_count", "year_start", "year_end")
    span = (F.col("year_end") - F.col("year_start")).cast("double")
    a = items.filter("year_start < 1800").withColumn("score", span)
    b = items.filter("year_start >= 1600").withColumn("score", span * 2)
    page = M.merge_candidates([a, b], source_order(), 0, 200)
    return page.select("rid", F.round("value", 6).alias("value"), F.col("pos").cast("bigint").alias("pos"))


@query("q_union_sources", """
SELECT 'customer' AS source, 'customer:' || c_custkey AS id, c_name AS title FROM customer
UNION ALL SELECT 'supplier', 'supplier:' || s_suppkey, s_name FROM supplier
UNION ALL SELECT 'part', 'part:' || p_partkey, p_name FROM part""")
def union_sources(spark, sf):
    def part_of(name, key, title):
        return conform(table(spark, sf, name).select(
            F.lit(name).alias("source"), F.concat(F.lit(f"{name}:"), key).alias("id"), F.col(title).alias("title")
        ))

    frames = [part_of("customer", "c_custkey", "c_name"), part_of("supplier", "s_suppkey", "s_name"), part_of("part", "p_partkey", "p_name")]
    return M.union_sources(frames).select("source", "id", "title")


@query("q_unique_names", with_items("""
, n AS (SELECT rid, replace(title, ' ', '-') || '.jpg' AS name, row_number() OVER (PARTITION BY title ORDER BY rid) AS k FROM items)
SELECT rid, CASE WHEN k = 1 THEN name ELSE regexp_replace(name, '\\.jpg$', '-' || k || '.jpg') END AS unique_name FROM n"""))
def unique_names(spark, sf):
    named = items_part(spark, sf).select("rid", F.concat(F.replace("title", F.lit(" "), F.lit("-")), F.lit(".jpg")).alias("name"))
    return C.unique_names(named, "name", "rid", width=256).select("rid", "unique_name")


@query("q_snapshots", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 4""")
def snapshots(spark, sf):
    return C.keep_newest(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", 4)


@query("q_daily_quota", """
SELECT event_id, used, used <= 2 AS allowed FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS used FROM events)""")
def daily_quota(spark, sf):
    used = C.daily_quota(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 2)
    return used.select("event_id", "used", "allowed")


IMAGES = """SELECT p_partkey % 500 AS objectid, CASE WHEN p_size % 4 = 0 THEN 'primary' ELSE 'alternate' END AS viewtype,
  CAST(p_size AS VARCHAR(9)) AS sequence, 'https://iiif.example.org/' || p_partkey AS iiifurl FROM part"""


@query("q_primary_image", f"""
SELECT objectid, viewtype, iiifurl FROM (SELECT *, row_number() OVER (PARTITION BY objectid
  ORDER BY viewtype <> 'primary', CAST(sequence AS DOUBLE), iiifurl) AS rn FROM ({IMAGES})) WHERE rn = 1""")
def primary_image(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    return A.primary_image(spark.sql(IMAGES), "objectid").select("objectid", "viewtype", "iiifurl")


@query("q_terms_by_object", """
WITH t AS (SELECT o_custkey AS objectid, o_orderpriority AS term, CASE o_orderstatus WHEN 'O' THEN 'Keyword' WHEN 'F' THEN 'Style' ELSE 'Other' END AS termtype, o_orderkey AS seq FROM orders),
k AS (SELECT objectid, term, min(seq) AS seen FROM t WHERE termtype IN ('Keyword', 'Style') AND term <> '5-LOW' GROUP BY objectid, term)
SELECT objectid, string_agg(term, '; ' ORDER BY seen) AS terms FROM k GROUP BY objectid""")
def terms_by_object(spark, sf):
    terms = table(spark, sf, "orders").selectExpr(
        "o_custkey objectid", "o_orderpriority term", "CASE o_orderstatus WHEN 'O' THEN 'Keyword' WHEN 'F' THEN 'Style' ELSE 'Other' END termtype", "o_orderkey seq"
    )
    listed = A.terms_by_object(terms, "objectid", ["Keyword", "Style"], "seq", ["5-LOW"])
    return listed.select("objectid", F.array_join("terms", "; ").alias("terms"))
