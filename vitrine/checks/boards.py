"""Board, snapshot, canvas and patent queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.checks import query
from vitrine.checks.views import table
from vitrine.operators import boards as B, patents as P
from vitrine.operators.merge import page
from vitrine.sources.aggregators import patent_items

# conversations as boards: side a holds even turns, side b odd turns and every turn of each third board
SIDE = {
    "a": "turn % 2 = 0",
    "b": "(turn % 2 = 1 OR conv_id % 3 = 0)",
}
BOARD_SQL = """SELECT CASE WHEN conv_id = 7 THEN 'favorites' ELSE 'b' || conv_id END AS board_id, '{side}' || conv_id AS name,
  CAST(CASE WHEN conv_id % 4 = 0 AND '{side}' = 'a' THEN 0 ELSE 1000 + conv_id + {shift} END AS BIGINT) AS created_at,
  CAST(2000 + (conv_id * {mul}) % 37 AS BIGINT) AS updated_at FROM conversations WHERE {cond} GROUP BY conv_id"""
BOARD_ITEM_SQL = """SELECT CASE WHEN conv_id = 7 THEN 'favorites' ELSE 'b' || conv_id END AS board_id, CAST(turn AS BIGINT) AS pos,
  role || ':' || (turn % 5) AS item_id FROM conversations WHERE {cond}"""


def board_sql(side: str) -> str:
    return BOARD_SQL.format(side=side, cond=SIDE[side], shift=5 if side == "a" else 0, mul=7 if side == "a" else 11)


def side(spark, sf, name: str) -> B.Boards:
    table(spark, sf, "conversations").createOrReplaceTempView("conversations")
    return B.Boards(spark.sql(board_sql(name)), spark.sql(BOARD_ITEM_SQL.format(cond=SIDE[name])))


@query("q_board_merge", f"""
WITH a AS ({board_sql('a')}), b AS ({board_sql('b')})
SELECT board_id, CASE WHEN board_id = 'favorites' THEN 'Favorites' WHEN a.updated_at IS NULL OR b.updated_at > a.updated_at THEN b.name ELSE a.name END AS name,
  CASE WHEN a.board_id IS NULL THEN b.created_at WHEN b.board_id IS NULL THEN a.created_at WHEN a.created_at = 0 THEN b.created_at ELSE least(a.created_at, b.created_at) END AS created_at,
  greatest(a.updated_at, b.updated_at) AS updated_at
FROM a FULL JOIN b USING (board_id)""")
def board_merge(spark, sf):
    return B.merge_boards(side(spark, sf, "a"), side(spark, sf, "b")).boards


@query("q_board_merge_items", f"""
WITH u AS (SELECT 0 AS side, * FROM ({BOARD_ITEM_SQL.format(cond=SIDE['a'])}) UNION ALL SELECT 1, * FROM ({BOARD_ITEM_SQL.format(cond=SIDE['b'])})),
f AS (SELECT *, row_number() OVER (PARTITION BY board_id, item_id ORDER BY side, pos) AS rn FROM u)
SELECT board_id, item_id, row_number() OVER (PARTITION BY board_id ORDER BY side, pos) - 1 AS pos FROM f WHERE rn = 1""")
def board_merge_items(spark, sf):
    return B.merge_boards(side(spark, sf, "a"), side(spark, sf, "b")).items


@query("q_board_order", f"""
SELECT board_id, pos FROM (SELECT board_id, row_number() OVER (ORDER BY board_id = 'favorites' DESC, updated_at DESC, board_id) AS pos FROM ({board_sql('a')})) WHERE pos <= 50""")
def board_order(spark, sf):
    top = page(side(spark, sf, "a").boards, B.order_boards(), 0, 50, "pos")
    return top.select("board_id", F.col("pos").cast("bigint").alias("pos"))


@query("q_board_counts", f"""
WITH b AS ({board_sql('b')}), i AS ({BOARD_ITEM_SQL.format(cond=SIDE['a'])})
SELECT board_id, (SELECT count(*) FROM i WHERE i.board_id = b.board_id) AS n_items FROM b""")
def board_counts(spark, sf):
    return B.board_counts(side(spark, sf, "b").boards, side(spark, sf, "a").items).select("board_id", "n_items")


@query("q_favorite_items", """
SELECT DISTINCT role || ':' || turn AS id FROM conversations WHERE role || ':' || turn IN (SELECT role || ':' || (turn % 5) FROM conversations WHERE conv_id = 7 AND turn % 2 = 0)""")
def favorite_items(spark, sf):
    items = table(spark, sf, "conversations").selectExpr("concat(role, ':', turn) id").distinct()
    return B.favorite_items(items, side(spark, sf, "a").items)


@query("q_board_add", f"""
WITH o AS ({BOARD_ITEM_SQL.format(cond=SIDE['a'])}), n AS ({BOARD_ITEM_SQL.format(cond=SIDE['b'])}),
f AS (SELECT board_id, item_id, min(pos) AS pos FROM n GROUP BY board_id, item_id), e AS (SELECT board_id, max(pos) + 1 AS e FROM o GROUP BY board_id)
SELECT board_id, item_id, pos, FALSE AS added FROM o
UNION ALL SELECT f.board_id, f.item_id, f.pos + coalesce(e, 0), TRUE FROM f LEFT JOIN e USING (board_id) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.board_id = f.board_id AND o.item_id = f.item_id)""")
def board_add(spark, sf):
    return B.add_items(side(spark, sf, "a").items, side(spark, sf, "b").items).select("board_id", "item_id", "pos", "added")


PAYLOAD = """SELECT conv_id AS board_id, CAST(min(turn) AS BIGINT) AS pos, role || ':' || (turn % 3) AS item_id, CAST(max(length(text)) AS BIGINT) AS size FROM conversations WHERE {cond} GROUP BY conv_id, role || ':' || (turn % 3)"""


@query("q_board_upsert", f"""
WITH o AS ({PAYLOAD.format(cond='turn < 3')}), n AS ({PAYLOAD.format(cond='turn >= 2')}), e AS (SELECT board_id, max(pos) + 1 AS e FROM o GROUP BY board_id)
SELECT board_id, item_id, coalesce(o.pos, n.pos + coalesce(e, 0)) AS pos, coalesce(n.size, o.size) AS size,
  CASE WHEN o.pos IS NOT NULL AND n.pos IS NOT NULL THEN 'updated' WHEN n.pos IS NOT NULL THEN 'added' ELSE 'kept' END AS mode
FROM o FULL JOIN n USING (board_id, item_id) LEFT JOIN e USING (board_id)""")
def board_upsert(spark, sf):
    table(spark, sf, "conversations").createOrReplaceTempView("conversations")
    old, new = (spark.sql(PAYLOAD.format(cond=c)) for c in ("turn < 3", "turn >= 2"))
    return B.upsert_items(old, new, ["size"]).select("board_id", "item_id", "pos", "size", "mode")


@query("q_board_remove", f"""
SELECT board_id, item_id, pos FROM ({BOARD_ITEM_SQL.format(cond=SIDE['b'])}) o
WHERE NOT EXISTS (SELECT 1 FROM ({BOARD_ITEM_SQL.format(cond=SIDE['a'])}) r WHERE r.board_id = o.board_id AND r.item_id = o.item_id)""")
def board_remove(spark, sf):
    return B.remove_items(side(spark, sf, "b").items, side(spark, sf, "a").items).select("board_id", "item_id", "pos")


@query("q_favorites", """
SELECT user_id, item, last_id FROM (SELECT user_id, event_type AS item, count(*) AS n, max_by(event_id, row(ts, event_id)) AS last_id FROM events GROUP BY user_id, event_type) WHERE n % 2 = 1""")
def favorites(spark, sf):
    log = table(spark, sf, "events").select("user_id", F.col("event_type").alias("item"), "ts", "event_id")
    return B.toggle_favorites(log, "user_id", "item", "ts", "event_id").select("user_id", "item", F.col("tie").alias("last_id"))


OPS = """SELECT event_id AS seq, CAST(event_id * 10 AS BIGINT) AS ts,
  CASE WHEN k < 8 THEN 'create' WHEN k < 14 THEN 'rename' WHEN k < 18 THEN 'remove' WHEN k < 70 THEN 'add' WHEN k < 85 THEN 'remove_item' ELSE 'upsert_item' END AS op,
  CASE WHEN user_id % 11 = 0 THEN 'favorites' ELSE 'b' || (user_id % 23) END AS board_id,
  CASE WHEN event_id % 6 = 0 THEN '  ' ELSE ' name ' || event_id || ' ' END AS name, event_type || (event_id % 4) AS item_id
FROM (SELECT *, CAST(event_id * 7919 % 100 AS INT) AS k FROM events)"""
OPS_SQL = f"""
WITH ops AS ({OPS}), f AS (SELECT * FROM ops WHERE NOT (op = 'remove' AND board_id = 'favorites')),
r AS (SELECT board_id, coalesce(max(seq) FILTER (op = 'remove'), -1) AS r FROM f GROUP BY board_id),
alive AS (SELECT f.* FROM f JOIN r USING (board_id) WHERE seq > r),
born AS (SELECT board_id, CASE WHEN board_id = 'favorites' THEN -1 ELSE min(seq) FILTER (op = 'create') END AS born FROM alive GROUP BY board_id),
live AS (SELECT alive.*, born FROM alive JOIN born USING (board_id) WHERE born IS NOT NULL AND seq > born),
d AS (SELECT board_id, item_id, coalesce(max(seq) FILTER (op = 'remove_item'), -1) AS d FROM live WHERE op IN ('add', 'upsert_item', 'remove_item') GROUP BY board_id, item_id),
items AS (SELECT board_id, item_id, min(seq) AS pos FROM live JOIN d USING (board_id, item_id) WHERE op IN ('add', 'upsert_item') AND seq > d GROUP BY board_id, item_id)
"""


def board_ops(spark, sf) -> B.Boards:
    table(spark, sf, "events").createOrReplaceTempView("events")
    return B.apply_board_ops(spark.sql(OPS))


@query("q_board_ops_items", OPS_SQL + "SELECT board_id, item_id, pos FROM items")
def board_ops_items(spark, sf):
    return board_ops(spark, sf).items


@query("q_board_ops", OPS_SQL + """
SELECT board_id, coalesce((SELECT arg_max(trim(name), seq) FROM live l WHERE l.board_id = born.board_id AND op = 'rename' AND trim(name) <> ''),
    CASE WHEN board_id = 'favorites' THEN 'Favorites' ELSE (SELECT coalesce(nullif(trim(name), ''), 'Untitled board') FROM ops WHERE ops.seq = born.born) END) AS name,
  CAST(CASE WHEN board_id = 'favorites' THEN 0 ELSE born * 10 END AS BIGINT) AS created_at,
  CAST(greatest(CASE WHEN board_id = 'favorites' THEN 0 ELSE born * 10 END,
    (SELECT max(ts) FROM live l WHERE l.board_id = born.board_id AND op IN ('rename', 'remove_item', 'upsert_item')),
    (SELECT max(pos) * 10 FROM items i WHERE i.board_id = born.board_id)) AS BIGINT) AS updated_at
FROM born WHERE born IS NOT NULL""")
def board_ops_boards(spark, sf):
    return board_ops(spark, sf).boards


@query("q_canvas_latest", """
WITH u AS (SELECT 0 AS side, c_custkey AS id, CAST(floor(c_acctbal) AS BIGINT) AS updated_at, c_custkey AS doc FROM customer
  UNION ALL SELECT 1, s_suppkey, CAST(floor(s_acctbal) AS BIGINT), -s_suppkey - 1 FROM supplier)
SELECT id, updated_at, doc FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, side) AS rn FROM u) WHERE rn = 1""")
def canvas_latest(spark, sf):
    """All customers and suppliers as the canvases of two devices; equal numbers are the same canvas."""
    def side_of(name, key, bal, doc):
        return table(spark, sf, name).select(F.col(key).alias("id"), F.floor(bal).alias("updated_at"), F.expr(doc).alias("doc"))

    return B.merge_canvases(side_of("customer", "c_custkey", "c_acctbal", "c_custkey"), side_of("supplier", "s_suppkey", "s_acctbal", "-s_suppkey - 1"))


@query("q_latest_snapshot", """
SELECT user_id AS "user", CAST(max(epoch_us(ts) // 1000) AS BIGINT) AS updated_at FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def latest_snapshot(spark, sf):
    name = F.when(F.col("event_type") != "error", F.concat(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("string"), F.lit(".json"))).otherwise("notes.txt")
    files = table(spark, sf, "events").select(F.col("user_id").alias("user"), F.concat_ws("/", F.lit("userdata"), F.col("user_id").cast("string"), name).alias("path"))
    return B.latest_snapshot(files).select("user", "updated_at")


PATENT_ROWS = """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'USD' WHEN 2 THEN 'EP' ELSE 'JP' END || o_orderkey AS publication_number,
  o_orderpriority || ' device ' || o_orderstatus AS title, 'Inventor ' || o_custkey AS inventor, CASE WHEN o_custkey % 3 = 0 THEN 'Acme Corp' ELSE 'Shop ' || (o_custkey % 9) END AS assignee,
  {d0} AS priority_date, {d1} AS filing_date, CASE WHEN o_orderstatus = 'F' THEN {d2} END AS grant_date, CASE WHEN o_orderkey % 10 <> 0 THEN {d3} END AS publication_date,
  o_orderkey % 7 AS k FROM orders"""
SPARK_ROWS = PATENT_ROWS.format(**{f"d{i}": f"date_format(date_add(o_orderdate, {n}), 'yyyy-MM-dd')" for i, n in enumerate((0, 200, 900, 500))})
DUCK_ROWS = PATENT_ROWS.format(**{f"d{i}": f"strftime(o_orderdate + INTERVAL {n} DAY, '%Y-%m-%d')" for i, n in enumerate((0, 200, 900, 500))})


def patents(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql(SPARK_ROWS)


@query("q_patent_filter", f"""
SELECT publication_number, publication_date FROM ({DUCK_ROWS}) WHERE publication_date >= '1997-01-01' AND publication_date <= '1999-12-31'
  AND inventor ILIKE '%r 1%' AND assignee ILIKE '%acme%' AND substring(publication_number, 1, 2) IN ('US', 'EP') AND coalesce(grant_date, '') <> '' AND title ILIKE '%urgent%' AND title ILIKE '%device%'""")
def patent_filter(spark, sf):
    q = P.PatentQuery(q=" urgent  device", after="1997", before="1999", inventor="R 1", assignee='"acme"', country="us, ep!", status="GRANT")
    rows = patents(spark, sf)
    return rows.filter(P.patent_filter(q, rows.columns)).select("publication_number", "publication_date")


@query("q_patent_page", f"""
SELECT publication_number, pos FROM (SELECT publication_number, row_number() OVER (ORDER BY filing_date, publication_number) AS pos FROM ({DUCK_ROWS})
  WHERE filing_date >= '1996-02-10' AND publication_number LIKE 'USD%' AND coalesce(grant_date, '') = '') WHERE pos > 100 AND pos <= 150""")
def patent_page(spark, sf):
    q = P.PatentQuery(num=50, page=2, sort="old", after="1996-02-10", before="90", date_type="filing", status="APPLICATION", type="DESIGN")
    return P.search_patents(patents(spark, sf), q).select("publication_number", F.col("pos").cast("bigint").alias("pos"))


@query("q_patent_date_op", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN make_date(year(o_orderdate), 1, 1) WHEN 1 THEN CAST(o_orderdate AS DATE) END::VARCHAR AS after_date,
  CASE o_orderkey % 3 WHEN 0 THEN make_date(year(o_orderdate), 12, 31) WHEN 1 THEN CAST(o_orderdate AS DATE) END::VARCHAR AS before_date FROM orders""")
def patent_date_op(spark, sf):
    orders = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.substring(day, 1, 4))).when(F.col("o_orderkey") % 3 == 1, day).otherwise(F.substring(day, 3, 2))
    return orders.select("o_orderkey", *[P.patent_date_op(k, text).cast("string").alias(f"{k}_date") for k in ("after", "before")])


@query("q_map_patents", f"""
SELECT 'patents:' || publication_number AS id, title, inventor || ' · ' || assignee AS creator,
  'priority ' || priority_date || ' · published ' || coalesce(publication_date, grant_date, filing_date) AS date_display,
  CAST(substring(coalesce(publication_date, grant_date, filing_date), 1, 4) AS INT) AS year_start,
  CASE WHEN publication_number LIKE 'USD%' THEN 'Design patent' ELSE 'Patent' END AS object_type, substring(publication_number, 1, 2) AS place,
  CASE WHEN publication_number LIKE 'US%' THEN TRUE END AS public_domain, CAST(CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END AS INT) AS n_files,
  CASE WHEN k % 2 = 0 THEN 'https://patentimages.storage.googleapis.com/f/' || publication_number || '.png' ELSE 'https://x.example.org/t.png' END AS thumb_url
FROM ({DUCK_ROWS}) WHERE k <> 3""")
def map_patents(spark, sf):
    number = F.col("publication_number")
    sheet = F.struct(F.lit("t.png").alias("thumbnail"), F.concat(F.lit("f/"), number, F.lit(".png")).alias("full"))
    small = F.struct(F.lit("https://x.example.org/s.png").alias("thumbnail"), F.lit(None).cast("string").alias("full"))
    blank = F.struct(F.lit(None).cast("string").alias("thumbnail"), F.lit("").alias("full"))
    k = F.col("k")
    raw = patents(spark, sf).select(
        number, "title", "inventor", "assignee", "priority_date", "filing_date", "grant_date", "publication_date",
        F.when(k % 2 == 0, F.array(sheet, blank, small)).alias("figures"), F.when(k != 3, F.lit("d.pdf")).alias("pdf"),
        F.when((k % 2 == 1) & (k != 3), F.lit("https://x.example.org/t.png")).alias("thumbnail"),
    )
    items = patent_items(raw)
    return items.select("id", "title", "creator", "date_display", "year_start", "object_type", "place", "public_domain", F.size("files").alias("n_files"), "thumb_url")
