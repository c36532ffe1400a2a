"""Reader, mapping and sink queries. Raw records are derived from the driver's tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.checks import ORACLES, QUERIES, query
from vitrine.checks.scalars import FORMS, IMAGE_ROWS
from vitrine.checks.views import items_part, table, with_items
from vitrine.operators import aggregates as A
from vitrine.operators.ranking import with_seq
from vitrine.plans import build as B
from vitrine.schema import conform
from vitrine.session import scratch_path, shuffle_width
from vitrine.sources import aggregators as G, museums as M, readers as R, sinks as K
from vitrine.sources.mapping import SITE_FIELDS


def raw(spark, sf, name: str, json_sql: str, schema: str) -> DataFrame:
    """Rows of a table as JSON lines of raw records, landed and read back with the declared schema."""
    table(spark, sf, name).createOrReplaceTempView(name)
    return landed_json(spark, sf, f"SELECT to_json({json_sql}) AS value FROM {name}", schema)


_LANDED: dict[tuple, str] = {}


def landed_once(spark, sf, sql: str, write) -> str:
    """Folder with the raw files a statement describes; landed once per session, like a downloaded snapshot."""
    key = (spark.sparkContext.applicationId, sf, sql)
    if key not in _LANDED:
        path = scratch_path(spark, "raw")
        write(spark.sql(sql), path)
        _LANDED[key] = path
    return _LANDED[key]


def landed_json(spark, sf, sql: str, schema: str) -> DataFrame:
    """JSON lines written as raw files and read by the reader the mappings are meant for."""
    # the small test tables are one file each; landed raw files come in many parts
    path = landed_once(spark, sf, sql, lambda lines, to: lines.repartition(shuffle_width(spark)).write.text(to))
    return R.read_ndjson_records(spark, path, schema)


def raw_json(spark, sf, name: str, template: str, values: dict[str, str], schema: str) -> DataFrame:
    """The same from a JSON template; ``$name`` stands for the SQL expression of that name."""
    table(spark, sf, name).createOrReplaceTempView(name)
    text = "r'" + " ".join(template.split()) + "'"
    for key, expr in values.items():
        text = f"replace({text}, '${key}', CAST({expr} AS STRING))"
    return landed_json(spark, sf, f"SELECT {text} AS value FROM {name}", schema)


COLUMNS = ["id", "title", "creator", "date_display", "year_start", "year_end", "object_type", "medium", "culture", "place",
           "public_domain", "rights_label", "license_url", "thumb_url", "image_url", "original_url", "content_type", "source_url", "text", "boost"]


def shown(items: DataFrame) -> DataFrame:
    files = F.array_join(F.transform("files", lambda f: F.concat_ws("=", f["format"], f["label"])), ";")
    return items.select(*COLUMNS, files.alias("files"))


def expect(columns: dict[str, str], body: str) -> str:
    """SQL with all compared columns; the ones not named are null."""
    kinds = {"year_start": "INT", "year_end": "INT", "public_domain": "BOOLEAN", "boost": "INT"}
    full = {**{c: "NULL" for c in COLUMNS}, "content_type": "'image'", "boost": "0", "files": "''", **columns}
    cols = ", ".join(f"CAST({e} AS {kinds.get(c, 'VARCHAR')}) AS {c}" for c, e in full.items())
    return f"SELECT {cols} {body}"


ZERO = "'https://creativecommons.org/publicdomain/zero/1.0/'"
MARK = "'https://creativecommons.org/publicdomain/mark/1.0/'"
CC0 = {"public_domain": "TRUE", "rights_label": "'CC0'", "license_url": ZERO}
PD = {"public_domain": "TRUE", "rights_label": "'Public domain'", "license_url": MARK}


# CSV sources -----------------------------------------------------------------

MET_CSV_SQL = """SELECT CAST(p_partkey AS STRING) `Object ID`, CASE WHEN p_partkey % 97 = 0 THEN 'True' ELSE 'False' END `Is Highlight`,
  CASE WHEN p_partkey % 4 <> 3 THEN 'True' ELSE 'False' END `Is Public Domain`, p_brand `Department`, p_type `Object Name`,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('The "', p_name, '",\\nsecond line') END `Title`, p_type `Culture`, lower(p_type) `Period`,
  CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('Maker ', p_size) END `Artist Display Name`, CASE WHEN p_size % 2 = 0 THEN 'French' ELSE '' END `Artist Display Bio`,
  concat(1700 + p_size, 's') `Object Date`, CASE WHEN p_size % 2 = 0 THEN '0' ELSE CAST(1700 + p_size AS STRING) END `Object Begin Date`,
  CASE WHEN p_size % 2 = 0 THEN '' ELSE CAST(1705 + p_size AS STRING) END `Object End Date`, 'Oil' `Medium`, 'France' `Country`, 'Paris' `City`,
  'Paintings' `Classification`, 'Men|Boats' `Tags`, CAST(p_partkey AS STRING) `Object Number` FROM part"""


def met_csv(spark, sf) -> DataFrame:
    """Written as CSV with quotes and line breaks, read back with the reader."""
    table(spark, sf, "part").createOrReplaceTempView("part")
    def write(rows: DataFrame, path: str) -> None:
        spaced = rows.repartition(shuffle_width(spark)).withColumnRenamed("Medium", " Medium ")
        spaced.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)

    return R.read_csv_records(spark, landed_once(spark, sf, MET_CSV_SQL, write), M.MET_CSV)


@query("q_read_csv", """
SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'The "' || p_name || '",' || chr(10) || 'second line' END AS title,
  'Oil' AS medium, CASE WHEN p_size % 2 = 0 THEN '' ELSE CAST(1705 + p_size AS VARCHAR) END AS end_date FROM part""")
def read_csv(spark, sf):
    return met_csv(spark, sf).select(
        F.col("Object ID").alias("id"), F.col("Title").alias("title"), F.col("Medium").alias("medium"), F.col("Object End Date").alias("end_date")
    )


MET_BASE = {
    "id": "'met:' || p_partkey",
    "title": "CASE WHEN p_size % 5 = 0 THEN p_type ELSE 'The \"' || p_name || '\", second line' END",
    "date_display": "(1700 + p_size) || 's'",
    "object_type": "p_type", "medium": "'Oil'", "culture": "p_type", "place": "'Paris; France'", **CC0,
    "boost": "CASE WHEN p_partkey % 97 = 0 THEN 2 ELSE 0 END",
}
MET_CREATOR = "CASE WHEN p_size % 3 <> 0 THEN 'Maker ' || p_size || CASE WHEN p_size % 2 = 0 THEN ' (French)' ELSE '' END END"
# a display text such as 1712s names a year and no decade
MET_BASE["year_start"] = "1700 + p_size"
MET_BASE["year_end"] = "CASE WHEN p_size % 2 <> 0 THEN 1705 + p_size WHEN p_size % 10 = 0 THEN 1709 + p_size ELSE 1700 + p_size END"


@query("q_map_met", expect({
    **MET_BASE, "creator": "CASE WHEN p_partkey % 2 = 0 THEN 'API Artist' || CASE WHEN p_size % 2 = 0 THEN ' (French)' ELSE '' END ELSE " + MET_CREATOR + " END",
    "thumb_url": "CASE WHEN p_partkey % 5 = 0 THEN 'https://i.example.org/big' || p_partkey ELSE 'https://i.example.org/small' || p_partkey END",
    "image_url": "CASE WHEN p_partkey % 5 = 0 THEN 'https://i.example.org/big' || p_partkey ELSE 'https://i.example.org/small' || p_partkey END",
    "original_url": "'https://i.example.org/big' || p_partkey",
    "source_url": "'https://www.metmuseum.org/art/collection/search/' || p_partkey",
    "text": "p_brand || ' | Paintings | ' || CASE WHEN p_partkey % 3 = 0 THEN 'Sea Sky' ELSE 'Men Boats' END",
    "files": "'jpg=Original' || repeat(';jpg=Additional view', CAST(least(p_size % 12, 8) AS INT))",
}, "FROM part WHERE p_partkey % 4 <> 3 AND p_partkey % 7 <> 0"))
def map_met(spark, sf, limits=SITE_FIELDS):
    objects = raw(spark, sf, "part", """named_struct('objectID', p_partkey, 'primaryImage', CASE WHEN p_partkey % 7 <> 0 THEN concat('https://i.example.org/big', p_partkey) ELSE '' END,
      'primaryImageSmall', CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN concat('https://i.example.org/small', p_partkey) ELSE '' END,
      'additionalImages', transform(slice(sequence(1, 12), 1, p_size % 12), i -> concat('https://i.example.org/v', i)),
      'artistDisplayName', CASE WHEN p_partkey % 2 = 0 THEN 'API Artist' END,
      'tags', CASE WHEN p_partkey % 3 = 0 THEN array(named_struct('term', 'Sea'), named_struct('term', 'Sky')) END)""", M.MET_OBJECT)
    return shown(M.met_items(met_csv(spark, sf), objects, limits))


@query("q_map_metwiki", expect({
    **MET_BASE, "creator": MET_CREATOR,
    **{c: f"'https://commons.wikimedia.org/wiki/Special:FilePath/Pic%20{{}}%2B.{{}}{s}'".replace("{}%2B", "' || p_partkey || '%2B").replace(".{}", ".' || CASE WHEN p_partkey % 3 = 0 THEN 'PNG' ELSE 'jpg' END || '")
       for c, s in (("thumb_url", "?width=600"), ("image_url", "?width=1600"), ("original_url", ""))},
    "source_url": "'https://www.metmuseum.org/art/collection/search/' || p_partkey",
    "text": "p_brand || ' | Paintings | Men Boats'",
    "files": "CASE WHEN p_partkey % 3 = 0 THEN 'png' ELSE 'jpg' END || '=Original (Wikimedia Commons)'",
}, "FROM part WHERE p_partkey % 4 <> 3 AND p_partkey % 5 NOT IN (0, 1) AND p_partkey % 6 <> 5"))
def map_metwiki(spark, sf):
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    name = F.when(k % 6 == 5, F.lit(".svg")).when(k % 3 == 0, F.lit(".PNG")).otherwise(F.lit(".jpg"))
    pairs = part.select(
        F.when(k % 5 == 0, F.concat(F.lit("Q"), k.cast("string"))).otherwise(F.concat(F.lit(" "), k.cast("string"))).alias("metId"),
        F.concat(F.lit("http://commons.wikimedia.org/wiki/Special:FilePath/Pic%20"), k.cast("string"), F.lit("%2B"), name).alias("image"),
    )
    crawled = part.filter("p_partkey % 5 = 1").select(k.alias("met_id"))
    return shown(M.metwiki_items(pairs, met_csv(spark, sf), crawled, SITE_FIELDS))


@query("q_pending_crawl", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def pending_crawl(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return M.pending_rows(table(spark, sf, "customer"), done, "c_custkey").select("c_custkey")


@query("q_map_nga", """
WITH img AS (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY p_size % 4 <> 0, p_size, 'https://api.nga.gov/iiif/' || p_partkey) AS rn FROM (SELECT *, p_partkey // 3 AS oid FROM part WHERE p_partkey % 5 <> 0)),
terms AS (SELECT o_orderkey // 4 AS oid, o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'Place Executed' WHEN 1 THEN 'Keyword' WHEN 2 THEN 'Style' ELSE 'Other' END AS kind,
  CASE WHEN o_orderkey % 4 = 1 AND o_custkey % 5 = 0 THEN 'Keywords' WHEN o_orderkey % 4 = 0 THEN 'Town ' || (o_custkey % 50) ELSE o_orderpriority END AS term FROM orders),
words AS (SELECT oid, string_agg(term, ' ' ORDER BY seq) AS w FROM (SELECT oid, term, min(seq) AS seq FROM terms WHERE kind IN ('Keyword', 'Style') AND term <> 'Keywords' GROUP BY oid, term) GROUP BY oid),
places AS (SELECT oid, string_agg(term, '; ' ORDER BY seq) AS w FROM terms WHERE kind = 'Place Executed' GROUP BY oid)
SELECT 'nga:' || oid AS id, CASE WHEN p_partkey % 6 = 0 THEN 'Untitled' ELSE p_name END AS title, places.w AS place,
  concat_ws(' | ', 'Sub', p_brand, words.w) AS text, 'https://api.nga.gov/iiif/' || p_partkey || '/full/!600,600/0/default.jpg' AS thumb_url,
  CAST(p_size * 100 AS INT) AS width, CAST(1600 + p_size AS INT) AS year_start, CAST(1601 + p_size AS INT) AS year_end
FROM img LEFT JOIN words USING (oid) LEFT JOIN places USING (oid) WHERE rn = 1 AND oid % 8 <> 7""")
def map_nga(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    images = spark.sql("""SELECT CAST(p_partkey DIV 3 AS STRING) depictstmsobjectid, CASE WHEN p_partkey % 5 <> 0 THEN '1' ELSE '0' END openaccess,
      CASE WHEN p_size % 4 = 0 THEN 'primary' ELSE 'alternate' END viewtype, CAST(p_size AS STRING) sequence,
      concat('https://api.nga.gov/iiif/', p_partkey) iiifurl, CAST(p_size * 100 AS STRING) width, '' height, '' maxpixels, p_partkey, p_name, p_brand FROM part""")
    terms = spark.sql("""SELECT CAST(o_orderkey DIV 4 AS STRING) objectid, o_orderkey seq, CASE o_orderkey % 4 WHEN 0 THEN 'Place Executed' WHEN 1 THEN 'Keyword' WHEN 2 THEN 'Style' ELSE 'Other' END termtype,
      CASE WHEN o_orderkey % 4 = 1 AND o_custkey % 5 = 0 THEN 'Keywords' WHEN o_orderkey % 4 = 0 THEN concat('Town ', o_custkey % 50) ELSE o_orderpriority END term FROM orders""")
    # the object row carries the values of its primary image's part
    best = A.primary_image(images.filter("openaccess = '1'").withColumnRenamed("depictstmsobjectid", "objectid"), "objectid")
    objects = best.selectExpr(
        "objectid", "CASE WHEN objectid % 8 = 7 THEN '1' ELSE '0' END isvirtual", "CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_name END title", "'Anon' attribution",
        "'' displaydate", "CAST(1600 + sequence AS INT) beginyear", "CAST(1601 + sequence AS INT) endyear", "'Print' classification", "'Ink' medium",
        "'Sub' subclassification", "p_brand departmentabbr", "'' portfolio", "'' series",
    )
    items = M.nga_items(images.drop("p_partkey", "p_name", "p_brand"), terms, objects)
    return items.select("id", "title", "place", "text", "thumb_url", "width", "year_start", "year_end")


# JSON sources ----------------------------------------------------------------


@query("q_map_cma", expect({
    "id": "'cma:' || p_partkey", "title": "p_name", "creator": "p_brand || ' (Dutch); Maker ' || p_size", "date_display": "'c. ' || (1600 + p_size)",
    "year_start": "CASE WHEN p_partkey % 2 = 0 THEN 1600 + p_size ELSE 1595 + p_size END", "year_end": "CASE WHEN p_partkey % 2 = 0 THEN 1610 + p_size ELSE 1605 + p_size END",
    "object_type": "p_type", "medium": "'oil & wax'", "culture": "'Holland; ' || p_type", **CC0,
    "thumb_url": "'https://w.example.org/' || p_partkey", "image_url": "CASE WHEN p_size % 2 = 0 THEN 'https://p.example.org/' || p_partkey ELSE 'https://w.example.org/' || p_partkey END",
    "original_url": "CASE WHEN p_size % 3 = 0 THEN 'https://f.example.org/' || p_partkey WHEN p_size % 2 = 0 THEN 'https://p.example.org/' || p_partkey ELSE 'https://w.example.org/' || p_partkey END",
    "source_url": "'https://clevelandart.org/art/A' || p_partkey", "text": "'Dept | ' || p_brand || ' | a b'",
    "files": "CASE WHEN p_size % 6 = 0 THEN 'jpg=Print (~3400px);tif=Full resolution TIFF' WHEN p_size % 2 = 0 THEN 'jpg=Print (~3400px)' WHEN p_size % 3 = 0 THEN 'tif=Full resolution TIFF' ELSE 'jpg=Web' END",
}, "FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0"))
def map_cma(spark, sf):
    rows = raw(spark, sf, "part", """named_struct('id', p_partkey, 'title', concat('<i>', p_name, '</i>'), 'share_license_status', CASE WHEN p_partkey % 7 = 0 THEN 'Copyrighted' ELSE 'CC0' END,
      'accession_number', concat('A', p_partkey), 'images', named_struct('web', named_struct('url', CASE WHEN p_partkey % 5 <> 0 THEN concat('https://w.example.org/', p_partkey) END),
      'print', CASE WHEN p_size % 2 = 0 THEN named_struct('url', concat('https://p.example.org/', p_partkey)) END, 'full', CASE WHEN p_size % 3 = 0 THEN named_struct('url', concat('https://f.example.org/', p_partkey)) END),
      'creators', array(named_struct('description', concat(p_brand, ' (Dutch)'), 'name', 'x'), named_struct('description', '', 'name', concat('Maker ', p_size))),
      'culture', array('Holland', 'holland', p_type), 'creation_date', concat('c. ', 1600 + p_size), 'creation_date_earliest', CASE WHEN p_partkey % 2 = 0 THEN 1600 + p_size END,
      'creation_date_latest', CASE WHEN p_partkey % 2 = 0 THEN 1610 + p_size END, 'technique', 'oil &amp; wax', 'type', p_type, 'department', 'Dept', 'tombstone', p_brand, 'artists_tags', array('a', 'b'))""", M.CMA.schema)
    return shown(M.CMA.apply(rows, limits=SITE_FIELDS))


@query("q_map_aic", expect({
    "id": "'aic:' || p_partkey", "title": "CASE WHEN p_size % 4 = 0 THEN 'Untitled' ELSE p_name END", "creator": "'Maker ' || p_size", "date_display": "'' || (1800 + p_size)",
    "year_start": "1800 + p_size", "year_end": "1800 + p_size", "object_type": "CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_type || ' / ' || p_brand END", "medium": "'Ink'", "place": "'Japan'", **CC0,
    **{c: f"'https://www.artic.edu/iiif/2/im' || p_partkey || '/full/{w},/0/default.jpg'" for c, w in (("thumb_url", 600), ("image_url", 1686), ("original_url", 3000))},
    "source_url": "'https://www.artic.edu/artworks/' || p_partkey", "text": "'Asian Art | t1 t2 | c1'", "boost": "CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END", "files": "'jpg=Largest (3000px)'",
}, "FROM part WHERE p_partkey % 5 <> 0 AND p_size % 7 <> 0"))
def map_aic(spark, sf):
    rows = raw(spark, sf, "part", r"""named_struct('id', p_partkey, 'title', CASE WHEN p_size % 4 <> 0 THEN p_name END, 'artist_display', concat('Maker ', p_size, '\nFrench, born 1800'), 'date_display', CAST(1800 + p_size AS STRING),
      'date_start', 1800 + p_size, 'artwork_type_title', p_type, 'classification_title', CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END, 'medium_display', 'Ink', 'place_of_origin', 'Japan',
      'is_public_domain', p_size % 7 <> 0, 'image_id', CASE WHEN p_partkey % 5 <> 0 THEN concat('im', p_partkey) END, 'thumbnail', named_struct('width', 10, 'height', 20), 'department_title', 'Asian Art',
      'term_titles', array('t1', 't2'), 'category_titles', array('c1'), 'is_boosted', p_partkey % 3 = 0, 'has_not_been_viewed_much', CASE WHEN p_partkey % 3 = 1 THEN false WHEN p_partkey % 3 = 2 THEN true END)""", M.AIC.schema)
    return shown(M.AIC.apply(rows))


@query("q_map_si", expect({
    "id": "'si:e' || p_partkey", "title": "p_name", "creator": "'Made by ' || p_brand", "date_display": "CASE WHEN p_size % 3 <> 0 THEN 'about ' || (1850 + p_size) END",
    "year_start": "CASE WHEN p_size % 3 <> 0 THEN 1845 + p_size ELSE 1820 END", "year_end": "CASE WHEN p_size % 3 <> 0 THEN 1855 + p_size ELSE 1849 END",
    "object_type": "CASE WHEN p_size % 2 = 0 THEN 'Medal' ELSE p_type END", "medium": "'Bronze'", "culture": "'American'", "place": "CASE WHEN p_size % 2 = 0 THEN 'Ohio' ELSE 'Earth; Asia' END", **CC0,
    **{c: f"CASE WHEN p_partkey % 6 = 0 THEN {m} ELSE 'https://ids.si.edu/ids/deliveryService?id=ID-' || p_partkey || '{s}' END" for c, m, s in (
        ("thumb_url", "'https://t.example.org/scene-image-thumb.jpg'", "&max=600"), ("image_url", "'https://t.example.org/scene-image-medium.jpg'", "&max=1600"), ("original_url", "NULL", ""))},
    "content_type": "CASE WHEN p_partkey % 6 = 0 THEN '3d' ELSE 'image' END", "source_url": "'https://n2t.net/ark:/' || p_partkey",
    "text": "'Postal Museum | DS | topic a | ' || p_brand || ' | note one | note two' || CASE WHEN p_partkey % 6 = 0 THEN ' | 3D model' ELSE '' END",
    "boost": "CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END",
    "files": "CASE WHEN p_partkey % 6 = 0 THEN 'obj=Low · Model;stl=;glb=' ELSE 'jpg=Full size JPEG;tif=High-resolution TIFF' END",
}, "FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0"))
def map_si(spark, sf, limits=SITE_FIELDS):
    rows = raw_json(spark, sf, "part", """{"type": "$type", "title": "$title", "unit_name": "Postal Museum", "content": {
      "descriptiveNonRepeating": {"metadata_usage": {"access": "$access"}, "record_ID": "e$k", "guid": "http://n2t.net/ark:/$k", "data_source": "DS", "online_media": {"media": [
        {"type": "Images", "idsId": "closed", "usage": {"access": "Restricted"}},
        {"type": "Images", "idsId": "$ids", "usage": {"access": "CC0"}, "resources": [{"label": "Screen Image", "width": 5}, {"label": "High-resolution TIFF", "url": "https://h.example.org/x.tif"}]},
        {"type": "$model", "thumbnail": "https://t.example.org/scene-image-thumb.jpg", "resources": [
          {"url": "https://m.example.org/a-obj_std.zip", "category": "Low", "title": "Model"}, {"url": "https://m.example.org/b.zip", "filename": "print_ready.zip"}, {"category": "no url"},
          {"url": "https://m.example.org/c.bin", "attributes": [{"MODEL_FILE_TYPE": "Draco Compressed GLB"}, {"FILE_SIZE": "12"}]}]}]}},
      "freetext": {$texts "name": [{"label": "Maker", "content": "Made by $brand"}], "notes": [{"content": "note one"}, {"content": "note <b>two</b>"}, {"content": "three"}],
        "physicalDescription": [{"label": "Medium", "content": "Bronze"}, {"label": "Dimensions", "content": "1 cm"}]},
      "indexedStructured": {"date": ["1840s", "1820s", "n.d."], "culture": ["American"], "topic": ["topic", "a"], "name": ["$brand"], "object_type": ["$kind"], "geoLocation": [{"L1": {"content": "Earth"}}, {"L2": {"content": "Asia"}}]}}}""",
        {"type": "CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE 'edanmdm' END", "title": "p_name", "access": "CASE WHEN p_partkey % 7 = 0 THEN 'Usage conditions apply' ELSE 'CC0' END",
         "ids": "CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat('ID-', p_partkey) END", "model": "CASE WHEN p_partkey % 6 = 0 AND p_partkey % 11 <> 0 THEN '3d_voyager' ELSE 'none' END",
         "texts": """concat(CASE WHEN p_size % 3 <> 0 THEN concat('"date": [{"content": "about ', 1850 + p_size, '"}], ') ELSE '' END, CASE WHEN p_size % 2 = 0 THEN '"place": [{"content": "Ohio"}], "objectType": [{"content": "Medal"}], ' ELSE '' END)""",
         "brand": "p_brand", "kind": "p_type", "k": "p_partkey"}, M.SI.schema)
    return shown(M.SI.apply(rows, limits=limits))


DUTCH = {"prent": "print", "schilderij": "painting", "stoel": "chair", "foto's": "photographs", "papier": "paper", "ring": "ring jewel", "rood": "red"}
XML_ROW = """concat('<record><header><identifier>https://id.rijksmuseum.nl/', CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE '' END, p_partkey, '</identifier><datestamp>2026-06-0', 1 + p_partkey % 9, 'T00:00:00Z</datestamp></header>',
  '<metadata><oai_dc:dc xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier>https://id.example.org/', p_partkey, '</dc:identifier><dc:identifier>', CASE WHEN p_size % 2 = 0 THEN concat('SK-A-', p_partkey) ELSE concat('nr', p_partkey) END, '</dc:identifier>',
  '<dc:title>', split_part(p_name, ' ', 1), ' &amp; ', split_part(p_name, ' ', 2), '</dc:title><dc:creator>Anoniem</dc:creator><dc:creator>', p_brand, '</dc:creator><dc:date>ca. ', 1600 + p_size, '</dc:date>',
  '<dc:type>Prent</dc:type><dc:type>', p_type, '</dc:type><dc:format>papier (materiaal)</dc:format><dc:description>Een stoel, foto', chr(39), 's</dc:description><dc:coverage>Delft</dc:coverage><dc:subject>zee</dc:subject>',
  '<dc:rights>https://creativecommons.org/publicdomain/', CASE p_partkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'zero' ELSE 'mark' END, '/1.0/</dc:rights><dc:relation>https://iiif.micr.io/k', p_partkey, '/full/max/0/default.jpg</dc:relation></oai_dc:dc></metadata></record>')"""


def oai_pages(spark, sf) -> DataFrame:
    table(spark, sf, "part").createOrReplaceTempView("part")
    path = scratch_path(spark, "oai")
    records = spark.sql(f"SELECT p_partkey DIV 100 AS page, {XML_ROW} AS x FROM part")
    # answers of 100 records each
    body = records.groupBy("page").agg(F.array_join(F.collect_list("x"), "").alias("x"))
    body.select(F.concat(F.lit("<OAI-PMH><ListRecords>"), "x", F.lit("</ListRecords></OAI-PMH>")).alias("value"), "page").write.partitionBy("page").text(path)
    return R.read_oai_records(spark, f"{path}/page=*")


@query("q_read_xml", """
SELECT 'https://id.rijksmuseum.nl/' || CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE '' END || p_partkey AS oai_id, replace(p_name, ' ', ' & ') AS title, CAST(2 AS INT) AS n_types, CAST(1 AS INT) AS n_dates FROM part""")
def read_xml(spark, sf):
    flat = M.dc_record(oai_pages(spark, sf))
    return flat.select("oai_id", F.get("title", F.lit(0)).alias("title"), F.size("type").alias("n_types"), F.size("date").alias("n_dates"))


RIJKS_ID = "CASE WHEN p_size % 2 = 0 THEN 'SK-A-' || p_partkey ELSE 'https://id.example.org/' || p_partkey END"


@query("q_map_rijks", expect({
    "id": f"'rijks:' || {RIJKS_ID}", "title": "replace(p_name, ' ', ' & ')", "creator": "p_brand", "date_display": "'ca. ' || (1600 + p_size)",
    "year_start": "1595 + p_size", "year_end": "1605 + p_size", "object_type": "'print; ' || p_type", "medium": "'papier'", "place": "'Delft'",
    "public_domain": "TRUE", "rights_label": "CASE WHEN p_partkey % 5 = 1 THEN 'CC0' ELSE 'Public domain' END", "license_url": f"CASE WHEN p_partkey % 5 = 1 THEN {ZERO} ELSE {MARK} END",
    **{c: f"'https://iiif.micr.io/k' || p_partkey || '/full/{w}/0/default.jpg'" for c, w in (("thumb_url", "500,"), ("image_url", "1600,"), ("original_url", "max"))},
    "source_url": "'https://www.rijksmuseum.nl/en/collection/' || CASE WHEN p_size % 2 = 0 THEN 'SK-A-' || p_partkey ELSE 'https%3A%2F%2Fid.example.org%2F' || p_partkey END",
    "text": "CASE WHEN p_name LIKE '% ring' THEN 'ring jewel ' ELSE '' END || 'print paper chair photographs | zee | Een stoel, foto''s'",
}, "FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 5 <> 0"))
def map_rijks(spark, sf):
    return shown(M.rijks_items(oai_pages(spark, sf), DUTCH, SITE_FIELDS))


@query("q_map_harvard", expect({
    "id": "'harvard:' || p_partkey", "title": "p_name", "creator": "CASE WHEN p_size % 2 = 0 THEN 'Painter ' || p_size || '; Shop' ELSE 'Shop' END", "date_display": "'19th century'",
    "year_start": "CASE WHEN p_partkey % 2 = 0 THEN 1600 + p_size ELSE 1801 END", "year_end": "CASE WHEN p_partkey % 2 = 0 THEN 1610 + p_size ELSE 1900 END", "object_type": "p_type || '; drawing'", "medium": "'etching'", "culture": "'Dutch'",
    "place": "'Rome'", "rights_label": "'Harvard Art Museums — verify rights before reuse'", "license_url": "'https://harvardartmuseums.org/collections/api'",
    **{c: f"'https://nrs.harvard.edu/urn-3:HUAM:B' || p_partkey || '{s}'" for c, s in (("thumb_url", "?width=600"), ("image_url", "?width=1600"), ("original_url", ""))},
    "source_url": "'https://www.harvardartmuseums.org/collections/object/' || p_partkey", "text": "'Div | 19th century'", "files": "'jpg=Full size'",
}, "FROM part WHERE p_partkey % 5 <> 0"))
def map_harvard(spark, sf):
    rows = raw_json(spark, sf, "part", """{"objectid": $k, "title": "$title", "people": [{"role": "Previous owner", "name": "x"}, {"role": "$role", "name": "Painter $size"}, {"role": "Maker", "displayname": "Shop"}],
      "dated": "", "century": "19th century", "datebegin": $from, "dateend": $to, "classification": "$kind", "culture": "Dutch", "technique": "etching", "division": "Div",
      "images": [{"baseimageurl": "https://nrs.harvard.edu/urn-3:HUAM:A", "displayorder": 0}, {"displayorder": 1}, {"baseimageurl": "https://nrs.harvard.edu/urn-3:HUAM:B$k", "displayorder": 2}],
      "imagepermissionlevel": $level, "worktypes": [{"worktype": "drawing"}, {"worktype": "$small"}], "places": [{"displayname": "Rome"}]}""",
        {"title": "p_name", "role": "CASE WHEN p_size % 2 = 0 THEN 'Painter' ELSE 'Donor' END", "size": "p_size", "from": "CASE WHEN p_partkey % 2 = 0 THEN 1600 + p_size ELSE 0 END", "to": "CASE WHEN p_partkey % 2 = 0 THEN 1610 + p_size ELSE 0 END",
         "kind": "p_type", "level": "CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END", "small": "lower(p_type)", "k": "p_partkey"}, M.HARVARD.schema)
    return shown(M.HARVARD.apply(rows, limits=SITE_FIELDS))


@query("q_map_smk", expect({
    "id": "'smk:KMS' || p_partkey", "title": "'Portræt af ' || p_name", "creator": "'Maker ' || p_size", "date_display": "'1850-1855'",
    "year_start": "1850", "year_end": "1855", "object_type": "'painting; ' || p_type", "medium": "'Olie; Lærred'",
    "public_domain": "TRUE", "rights_label": "CASE WHEN p_size % 2 = 0 THEN 'CC0' ELSE 'Public domain' END", "license_url": f"CASE WHEN p_size % 2 = 0 THEN {ZERO} ELSE {MARK} END",
    **{c: f"CASE WHEN p_partkey % 6 = 0 THEN {p} ELSE 'https://iip-thumb.smk.dk/iiif/jp2/im' || p_partkey || '/full/{w}/0/default.jpg' END" for c, w, p in (
        ("thumb_url", "!600,600", "'https://api.smk.dk/api/v1/thumbnail/' || p_partkey"), ("image_url", "!1600,1600", "'https://api.smk.dk/api/v1/thumbnail/' || p_partkey"), ("original_url", "max", "'https://n.example.org/' || p_partkey"))},
    "source_url": "'https://open.smk.dk/en/artwork/image/KMS' || p_partkey", "text": "'portrait painting oil | Denmark Danish'", "files": "'jpg=Full resolution (SMK download)'",
}, "FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0"))
def map_smk(spark, sf):
    rows = raw(spark, sf, "part", """named_struct('object_number', concat('KMS', p_partkey), 'public_domain', p_partkey % 5 <> 0, 'image_thumbnail', CASE WHEN p_partkey % 7 = 0 THEN 'https://else.example.org/x' WHEN p_partkey % 6 = 0 THEN concat('https://api.smk.dk/api/v1/thumbnail/', p_partkey)
        ELSE concat('https://iip-thumb.smk.dk/iiif/jp2/im', p_partkey, '/full/!1024,/0/default.jpg') END, 'image_native', concat('https://n.example.org/', p_partkey),
      'titles', array(named_struct('title', concat('Portræt af ', p_name))), 'production_date', array(named_struct('start', '1850-01-01T00:00:00Z', 'end', '1855-12-31T00:00:00Z', 'period', '1850-1855')),
      'production', array(named_struct('creator', 'Ubekendt kunstner'), named_struct('creator', concat('Maker ', p_size))), 'object_names', array(named_struct('name', 'Maleri'), named_struct('name', p_type)),
      'techniques', array('Olie'), 'materials', array('Lærred'), 'rights', CASE WHEN p_size % 2 = 0 THEN 'https://creativecommons.org/publicdomain/zero/1.0/' ELSE 'https://creativecommons.org/share-your-work/public-domain/pdm' END)""", M.SMK.schema)
    return shown(M.SMK.apply(rows, limits=SITE_FIELDS))


@query("q_map_europeana", expect({
    "id": "'europeana:9/' || p_partkey", "title": "CASE WHEN p_size % 2 = 0 THEN 'English ' || p_name ELSE p_name END", "creator": "'Maker A; Maker B'",
    "date_display": "CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN '' || (1700 + p_size) ELSE (1700 + p_size) || '–' || (1710 + p_size) END",
    "year_start": "CASE WHEN p_size % 3 > 0 THEN 1700 + p_size END", "year_end": "CASE p_size % 3 WHEN 1 THEN 1700 + p_size WHEN 2 THEN 1710 + p_size END", "place": "'Italy; Spain'",
    "public_domain": "p_partkey % 5 < 2", "rights_label": "CASE p_partkey % 5 WHEN 0 THEN 'Public domain' WHEN 1 THEN 'CC0' WHEN 2 THEN 'CC BY 4.0' ELSE 'CC BY-SA 4.0' END || ' · Library ' || p_brand",
    "license_url": "'http://creativecommons.org/' || CASE p_partkey % 5 WHEN 0 THEN 'publicdomain/mark/1.0/' WHEN 1 THEN 'publicdomain/zero/1.0/' WHEN 2 THEN 'licenses/by/4.0/' ELSE 'licenses/by-sa/4.0/' END",
    "thumb_url": "'https://api.europeana.eu/thumbnail/v2/url.json?uri=https%3A%2F%2Fi.example.org%2Fa%20b%3Fn%3D' || p_partkey || '&type=IMAGE&size=w400'",
    "image_url": "'https://i.example.org/a b?n=' || p_partkey", "original_url": "'https://i.example.org/a b?n=' || p_partkey",
    "source_url": "'https://www.europeana.eu/en/item/9/' || p_partkey", "text": "'art | Library ' || p_brand || ' | About ' || p_name",
}, "FROM part WHERE p_partkey % 5 <> 4 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0"))
def map_europeana(spark, sf, limits=SITE_FIELDS):
    rows = raw(spark, sf, "part", """named_struct('id', concat('/9/', p_partkey), 'theme', 'art', 'rights', array(concat('http://creativecommons.org/', CASE p_partkey % 5 WHEN 0 THEN 'publicdomain/mark/1.0/' WHEN 1 THEN 'publicdomain/zero/1.0/' WHEN 2 THEN 'licenses/by/4.0/' WHEN 3 THEN 'licenses/by-sa/4.0/' ELSE 'licenses/by-nc/4.0/' END)),
      'edmIsShownBy', array(concat(CASE WHEN p_partkey % 7 = 0 THEN 'ftp' ELSE 'https' END, '://i.example.org/a b?n=', p_partkey)), 'title', array(CASE WHEN p_partkey % 11 = 0 THEN '[Zonder titel]' ELSE p_name END),
      'dcTitleLangAware', CASE WHEN p_size % 2 = 0 AND p_partkey % 11 <> 0 THEN named_struct('en', array(concat('English ', p_name))) END, 'dcCreator', array('Maker A', 'maker a', 'Maker B', 'Maker C'),
      'year', CASE p_size % 3 WHEN 0 THEN array('x', '3000') WHEN 1 THEN array(CAST(1700 + p_size AS STRING)) ELSE array(CAST(1710 + p_size AS STRING), CAST(1700 + p_size AS STRING)) END,
      'dataProvider', array(concat('Library ', p_brand)), 'country', array('Italy', 'Spain', 'France'), 'dcDescription', array(concat('About ', p_name)))""", G.EUROPEANA.schema)
    return shown(G.EUROPEANA.apply(rows, limits=limits))


# "from page 11 ... (1838)" reads as 1838 and later; page numbers of three or four digits pass for years
FLICKR_START = "coalesce(CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_partkey NOT BETWEEN 100 AND 2100 THEN 1800 + p_size WHEN abs(1800 + p_size - p_partkey) <= 1200 THEN least(p_partkey, 1800 + p_size) END END, CASE WHEN p_size % 3 <> 0 THEN 1900 END)"
FLICKR_END = "coalesce(CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_partkey NOT BETWEEN 100 AND 2100 THEN 1830 + p_size WHEN abs(1800 + p_size - p_partkey) <= 1200 THEN greatest(p_partkey, 1800 + p_size) END END, CASE WHEN p_size % 3 <> 0 THEN 1900 END)"


@query("q_map_flickr", expect({
    "id": "'flickr:' || p_partkey", "title": "CASE WHEN p_size % 2 = 0 THEN p_name || ' (' || (1800 + p_size) || ') — p. ' || p_partkey ELSE p_name END", "creator": "'Owner ' || p_brand",
    "date_display": f"'' || {FLICKR_START}", "year_start": FLICKR_START, "year_end": FLICKR_END,
    "object_type": "CASE WHEN p_size % 2 = 0 THEN 'Book illustration' ELSE 'Photograph' END", "public_domain": "TRUE",
    "rights_label": "CASE p_partkey % 5 WHEN 0 THEN 'No known copyright restrictions' WHEN 1 THEN 'CC0' ELSE 'Public domain' END",
    "license_url": f"CASE p_partkey % 5 WHEN 0 THEN 'https://www.flickr.com/commons/usage/' WHEN 1 THEN {ZERO} ELSE {MARK} END",
    "thumb_url": "'https://live.staticflickr.com/' || p_partkey || '.jpg'", "image_url": "'https://live.staticflickr.com/' || p_partkey || CASE WHEN p_size % 4 = 0 THEN '_b.jpg' ELSE '.jpg' END",
    "original_url": "'https://live.staticflickr.com/' || p_partkey || CASE WHEN p_size % 4 = 0 THEN '_b.jpg' ELSE '.jpg' END", "source_url": "'https://www.flickr.com/photos/o1/' || p_partkey",
    "text": "CASE WHEN p_size % 2 = 0 THEN 'book illustration engraving plate' ELSE 'photograph archive' END || ' | about it'",
}, "FROM part WHERE p_partkey % 5 < 3"))
def map_flickr(spark, sf):
    rows = raw(spark, sf, "part", """named_struct('id', CAST(p_partkey AS STRING), 'owner', 'o1', 'account', CASE WHEN p_size % 2 = 0 THEN '126377022@N07' ELSE 'x' END, 'account_name', concat('Owner ', p_brand),
      'title', CASE WHEN p_size % 2 = 0 THEN concat('Image from page ', p_partkey, ' of "', p_name, '" (', 1800 + p_size, ')') ELSE p_name END,
      'license', CASE p_partkey % 5 WHEN 0 THEN '7' WHEN 1 THEN '9' WHEN 2 THEN '10' ELSE '4' END, 'url_m', concat('https://live.staticflickr.com/', p_partkey, '.jpg'), 'url_l', CASE WHEN p_size % 4 = 0 THEN concat('https://live.staticflickr.com/', p_partkey, '_b.jpg') END,
      'datetaken', CASE WHEN p_size % 3 = 0 THEN '0000-00-00' ELSE '1900-01-01 00:00:00' END, 'description', named_struct('_content', '<p>about it</p>'))""", G.FLICKR.schema)
    return shown(G.FLICKR.apply(rows, limits=SITE_FIELDS))


@query("q_map_wellcome", expect({
    "id": "'wellcome:w' || p_partkey", "title": "p_name", "creator": "p_brand", "date_display": "'17th century'", "year_start": "1601", "year_end": "1700", "object_type": "'Etching; Print; Pictures'", "place": "'London; Paris'",
    "public_domain": "p_partkey % 4 < 2", "rights_label": "CASE p_partkey % 4 WHEN 0 THEN 'Public domain' WHEN 1 THEN 'CC0' ELSE 'CC BY 4.0' END",
    "license_url": f"CASE p_partkey % 4 WHEN 0 THEN {MARK} WHEN 1 THEN {ZERO} ELSE 'https://creativecommons.org/licenses/by/4.0/' END",
    **{c: f"'https://iiif.wellcomecollection.org/thumbs/V' || p_partkey || '/full/!{w}/0/default.jpg'" for c, w in (("thumb_url", "600,600"), ("image_url", "1024,1024"), ("original_url", "1024,1024"))},
    "source_url": "'https://wellcomecollection.org/works/w' || p_partkey", "text": "'s1 s2 s3 s4 s5 s6 s7 s8 | physical'",
}, "FROM part WHERE p_partkey % 4 < 3 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0"))
def map_wellcome(spark, sf, limits=SITE_FIELDS):
    rows = raw(spark, sf, "part", """named_struct('id', concat('w', p_partkey), 'type', CASE WHEN p_partkey % 5 = 0 THEN 'Concept' ELSE 'Work' END, 'title', p_name, 'physicalDescription', 'physical',
      'items', array(named_struct('locations', array(named_struct('locationType', named_struct('id', 'closed-stores'), 'url', 'https://no.example.org', 'license', named_struct('id', 'pdm')))),
        named_struct('locations', array(named_struct('locationType', named_struct('id', 'iiif-image'), 'url', concat('https://iiif.wellcomecollection.org/image/V', p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '/info.json' END), 'license', named_struct('id', CASE p_partkey % 4 WHEN 0 THEN 'pdm' WHEN 1 THEN 'cc0' WHEN 2 THEN 'cc-by' ELSE 'inc' END)),
          named_struct('locationType', named_struct('id', 'iiif-image'), 'url', 'https://iiif.wellcomecollection.org/image/Z/info.json', 'license', named_struct('id', 'pdm'))))),
      'production', array(named_struct('dates', array(named_struct('label', '17th century')), 'places', array(named_struct('label', 'London'))), named_struct('dates', array(named_struct('label', '1999')), 'places', array(named_struct('label', 'Paris')))),
      'contributors', array(named_struct('agent', named_struct('label', p_brand))), 'subjects', transform(sequence(1, 10), i -> named_struct('label', concat('s', i))), 'genres', array(named_struct('label', 'Etching'), named_struct('label', 'Print'), named_struct('label', 'Third')), 'workType', named_struct('label', 'Pictures'))""", G.WELLCOME.schema)
    return shown(G.WELLCOME.apply(rows, limits=limits))


@query("q_map_nypl", expect({
    "id": "'nypl:u' || p_partkey", "title": "p_name || ', ' || (1850 + p_size)", "year_start": "1850 + p_size", "year_end": "1850 + p_size", **PD, "rights_label": "'Public domain (NYPL)'",
    **{c: f"'https://images.nypl.org/index.php?id=' || p_partkey || '&t={t}'" for c, t in (("thumb_url", "r"), ("image_url", "q"), ("original_url", "g"))},
    "source_url": "CASE WHEN p_size % 2 = 0 THEN 'https://link.example.org' ELSE 'https://digitalcollections.nypl.org/items/u' || p_partkey END", "text": "'New York Public Library'",
}, "FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0"))
def map_nypl(spark, sf):
    rows = raw(spark, sf, "part", """named_struct('uuid', concat('u', p_partkey), 'title', concat(p_name, ', ', 1850 + p_size), 'imageID', CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey AS STRING) END,
      'typeOfResource', CASE WHEN p_partkey % 7 = 0 THEN 'text' WHEN p_partkey % 3 = 0 THEN 'still image' END, 'itemLink', CASE WHEN p_size % 2 = 0 THEN 'https://link.example.org' END)""", G.NYPL.schema)
    return shown(G.NYPL.apply(rows, limits=SITE_FIELDS))


@query("q_map_nasa3d", expect({
    "id": "'nasa3d:' || p_partkey", "title": "p_name || ' & co'", "creator": "'NASA'", "object_type": "'3D model'", "medium": "CASE WHEN p_size % 2 = 0 THEN 'FBX, STL, GLB' ELSE 'STL, GLB' END",
    "public_domain": "TRUE", "rights_label": "'Public domain (NASA)'", "license_url": "'https://www.nasa.gov/nasa-brand-center/images-and-media/'",
    "thumb_url": "'https://p.example.org/x.jpg?w=600&fit=clip'", "image_url": "'https://p.example.org/x.jpg?w=1600&fit=clip'", "original_url": "'https://p.example.org/x.jpg'", "content_type": "'3d'",
    "source_url": "'https://l.example.org/' || p_partkey", "text": "'spacecraft space science 3D model | About ' || p_name", "boost": "1",
    "files": "CASE WHEN p_size % 2 = 0 THEN 'fbx=model fbx.zip;' ELSE '' END || 'stl=a' || p_partkey || '.stl;glb=b.glb'",
}, "FROM part WHERE p_partkey % 5 <> 0"))
def map_nasa3d(spark, sf):
    rows = raw(spark, sf, "part", r"""named_struct('id', p_partkey, 'link', concat('https://l.example.org/', p_partkey), 'title', named_struct('rendered', concat(p_name, ' &amp; co')), 'excerpt', named_struct('rendered', concat('<p>About ', p_name, '</p>')),
      'featured_image_url', 'https://p.example.org/x.jpg?w=9', 'content', named_struct('rendered', CASE WHEN p_partkey % 5 = 0 THEN '<p>none</p>' ELSE concat('<a href="https://assets.science.nasa.gov/content/dam/x/b.glb?emrc=1">b</a>',
        '<img src="https://assets.science.nasa.gov/content/dam/resources/image/c.stl">', '<a href="https://assets.science.nasa.gov/content/dam/x/a', p_partkey, '.stl">a</a><a href="https://assets.science.nasa.gov/content/dam/x/a', p_partkey, '.stl?v=2">again</a>',
        '<a href="https://assets.science.nasa.gov/content/dam/x/page.html">p</a>', CASE WHEN p_size % 2 = 0 THEN '<a href="https://assets.science.nasa.gov/content/dam/x/model%20fbx.zip">z</a>' ELSE '' END) END))""", G.NASA3D.schema)
    return shown(G.NASA3D.apply(rows, limits=SITE_FIELDS))


@query("q_html_links", r"""
WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="(/[^"]+)"', 1) AS paths FROM pages),
g AS (SELECT page_id, list_filter(list_transform(paths, lambda p: regexp_replace(p, '[^A-Za-z0-9/]', '', 'g')), lambda p: p <> '/') AS good FROM h)
SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(good, lambda p: 'https://assets.science.nasa.gov/content/dam' || p || '.stl'))), ' ') AS urls, CAST(len(list_distinct(good)) AS INT) AS n FROM g""")
def html_links(spark, sf):
    """Whole pages, their navigation links turned into model links."""
    pages = table(spark, sf, "pages")
    paths = F.transform(F.regexp_extract_all("html", F.lit('href="(/[^"]+)"'), F.lit(1)), lambda p: F.regexp_replace(p, "[^A-Za-z0-9/]", ""))
    links = F.array_join(F.transform(paths, lambda p: F.concat(F.lit('<a href="https://assets.science.nasa.gov/content/dam'), p, F.lit('.stl?x=1">'))), "")
    whole = pages.select("page_id", F.concat("html", links).alias("h"))
    urls = G.html_model_urls(F.col("h"))
    return whole.select("page_id", F.array_join(F.array_sort(urls), " ").alias("urls"), F.size(urls).alias("n"))


@query("q_map_nih3d", expect({
    "id": "'nih3d:3DPX-' || p_partkey", "title": "CASE WHEN p_size % 4 = 0 THEN 'NIH 3D 3DPX-' || p_partkey ELSE p_name END", "creator": "'Lab'", "date_display": "'2020-05-01'", "year_start": "2020", "year_end": "2020",
    "object_type": "p_type", "medium": "'STL, GLB'", "public_domain": "p_partkey % 4 = 0", "rights_label": "CASE p_partkey % 4 WHEN 0 THEN 'Public domain' WHEN 1 THEN 'CC BY 4.0' ELSE 'CC BY-SA 4.0' END",
    "license_url": f"CASE p_partkey % 4 WHEN 0 THEN {MARK} WHEN 1 THEN 'https://creativecommons.org/licenses/by/4.0/' ELSE 'https://creativecommons.org/licenses/by-sa/4.0/' END",
    "thumb_url": "'https://3d.nih.gov/api/submissions/s2/runs/r/output-files/t'", "image_url": "'https://3d.nih.gov/api/submissions/s2/runs/r/output-files/t'", "content_type": "'3d'",
    "source_url": "'https://3d.nih.gov/entries/3DPX-' || p_partkey", "text": "'science medicine anatomy 3D model | ' || p_type || ' | heart k2 | desc'",
    "files": "'stl=m0.stl' || array_to_string(list_transform(range(1, 8), lambda i: ';glb=m' || i || '.glb'), '')",
}, "FROM part WHERE p_partkey % 4 < 3") + " UNION ALL " + expect({
    "id": "'nih3d:3DPX-' || p_partkey", "title": "'old'", "object_type": "p_type", "medium": "'STL'", **CC0, "content_type": "'3d'",
    "source_url": "'https://3d.nih.gov/entries/3DPX-' || p_partkey", "text": "'science medicine anatomy 3D model | ' || p_type || ' | heart k2'", "files": "'stl=old.stl'",
}, "FROM part WHERE p_partkey % 4 = 3"))
def map_nih3d(spark, sf, limits=SITE_FIELDS):
    rows = raw_json(spark, sf, "part", """{"entryId": "e", "threedpxId": "3DPX-$k", "category": "$kind", "keywords": ["Heart", " heart ", "K2"], "submissions": [
      {"submissionId": "s1", "submissionStatus": "Published", "version": 1, "metadata": {"license": "CC0", "title": "old"}, "workflowRuns": [{"prefectRunId": "r", "outputFiles": [{"fileId": "f", "fileFormat": "stl", "name": "old.stl"}]}]},
      {"submissionId": "s3", "submissionStatus": "Draft", "version": 9, "metadata": {"license": "CC0", "title": "draft"}},
      {"submissionId": "s4", "submissionStatus": "Published", "version": 5, "metadata": {"license": "CC0", "title": "no models"}, "workflowRuns": [{"prefectRunId": "r", "outputFiles": [{"fileId": "f", "fileFormat": "png", "name": "x.png"}]}]},
      {"submissionId": "s2", "submissionStatus": "Published", "version": 2, "publishedDate": "2020-05-01T00:00:00Z", "modifiedByUser": {"displayName": "Lab"}, "metadata": {"license": "$license", "title": "$title", "description": "desc"},
        "workflowRuns": [{"prefectRunId": "r", "outputFiles": [{"fileId": "t", "fileFormat": "png", "name": "thumb_1.png"}, $files]}]}]}""",
        {"kind": "p_type", "license": "CASE p_partkey % 4 WHEN 0 THEN 'Public Domain' WHEN 1 THEN 'CC BY 4.0' WHEN 2 THEN 'CC-BY-SA' ELSE 'CC-BY-NC' END", "title": "CASE WHEN p_size % 4 <> 0 THEN p_name ELSE '' END",
         "files": """array_join(transform(sequence(0, 9), i -> concat('{"fileId": "f', i, '", "fileFormat": "', CASE WHEN i = 0 THEN 'STL' ELSE 'glb' END, '", "name": "m', i, CASE WHEN i = 0 THEN '.stl' ELSE '.glb' END, '"}')), ', ')""",
         "k": "p_partkey"}, G.NIH3D.schema)
    # where the newest license is not open the first version is used instead
    return shown(G.NIH3D.apply(rows, limits=limits))


# without limits --------------------------------------------------------------


def _whole(name: str, *changes: tuple[str, str]) -> None:
    """The query without limits; in its SQL, the values that the preset leaves out come back."""
    sql, limited = ORACLES[name], QUERIES[name]
    for short, full in changes:
        assert short in sql, (name, short)
        sql = sql.replace(short, full)
    query(f"{name}_whole", sql)(lambda spark, sf: limited(spark, sf, limits=None))


_whole("q_map_met", ("least(p_size % 12, 8)", "p_size % 12"))
_whole("q_map_si", ("note one | note two", "note one | note two | three"))
_whole("q_map_europeana", ("Maker A; Maker B", "Maker A; Maker B; Maker C"), ("Italy; Spain", "Italy; Spain; France"))
_whole("q_map_wellcome", ("Etching; Print; Pictures", "Etching; Print; Third; Pictures"), ("s7 s8", "s7 s8 s9 s10"))
_whole("q_map_nih3d", ("range(1, 8)", "range(1, 10)"))


# readers and sinks -----------------------------------------------------------


@query("q_read_ndjson", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def read_ndjson(spark, sf):
    """Gzip lines with blank and broken ones between them."""
    path = scratch_path(spark, "ndjson")
    customer = table(spark, sf, "customer").select(F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")).alias("value"))
    broken = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(F.lit('{"c_custkey": 1, "c_na')).alias("value"))
    customer.unionByName(broken).write.option("compression", "gzip").text(path)
    return R.read_ndjson_records(spark, path, "c_custkey bigint, c_name string, c_acctbal double", glob="*.txt.gz", partitions=8)


@query("q_error_containment", "SELECT 'good' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'bad', count(*) FILTER (c_custkey % 3 = 0) FROM customer")
def error_containment(spark, sf):
    path = scratch_path(spark, "mixed")
    customer = table(spark, sf, "customer")
    good = customer.select(F.to_json(F.struct("c_custkey", "c_name")).alias("value"))
    bad = customer.filter("c_custkey % 3 = 0").select(F.concat(F.lit('{"c_custkey": '), F.col("c_custkey").cast("string"), F.lit(', "c_name"')).alias("value"))
    good.unionByName(bad).write.text(path)
    kept, rejected = R.read_with_rejects(spark, path, "c_custkey bigint, c_name string")
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("kind"), "n").unionByName(
        rejected.agg(F.count(F.lit(1)).alias("n")).select(F.lit("bad").alias("kind"), "n")
    )


@query("q_read_json_pages", "SELECT o_orderkey AS uuid, o_orderpriority AS title FROM orders")
def read_json_pages(spark, sf):
    """Pages of 500 results under a nested path, one document per line file."""
    path = scratch_path(spark, "pages")
    orders = table(spark, sf, "orders")
    rows = F.collect_list(F.struct(F.col("o_orderkey").alias("uuid"), F.col("o_orderpriority").alias("title")))
    pages = orders.groupBy(F.floor(F.col("o_orderkey") / 500).alias("page")).agg(rows.alias("result"))
    text = pages.select("page", F.to_json(F.struct(F.struct(F.struct("result").alias("response")).alias("nyplAPI"))).alias("value"))
    text.write.partitionBy("page").text(path)
    return R.read_json_pages(spark, f"{path}/page=*", "nyplAPI.response.result", "uuid bigint, title string")


@query("q_read_patent_pages", "SELECT 'US' || o_orderkey AS publication_number, o_orderpriority AS title FROM orders")
def read_patent_pages(spark, sf):
    orders = table(spark, sf, "orders")
    rec = F.struct(F.concat(F.lit("US"), F.col("o_orderkey").cast("string")).alias("publication_number"), F.col("o_orderpriority").alias("title"))
    pages = orders.groupBy(F.floor(F.col("o_orderkey") / 100).alias("page")).agg(F.collect_list(rec).alias("recs"))
    inner = F.to_json(F.struct(F.struct(F.array(F.struct(F.transform("recs", lambda r: F.struct(r.alias("patent"))).alias("result"))).alias("cluster")).alias("results")))
    flat = F.to_json(F.struct(F.col("recs").alias("organic_results")))
    as_text = F.concat(F.lit(")]}'\n"), F.to_json(F.struct(inner.alias("content"))))
    as_object = F.concat(F.lit('{"content":'), inner, F.lit("}"))
    kind = F.col("page") % 4
    text = F.when(kind == 0, as_text).when(kind == 1, as_object).when(kind == 2, flat).otherwise(inner)
    answers = pages.select(text.alias("value"))
    return R.parse_patent_pages(answers, F.col("value")).select("publication_number", "title")


FEEDS = [*FORMS, "extra"]


def staged(spark, sf) -> DataFrame:
    """Items of twelve feeds; the feed ``extra`` repeats every third item of the others."""
    table(spark, sf, "part").createOrReplaceTempView("part")
    rows = spark.sql(IMAGE_ROWS.replace(" FROM part", ", p_name AS title, CASE WHEN p_partkey % 97 = 0 THEN 2 ELSE 0 END AS boost, p_size FROM part"))
    rows = rows.withColumns({"id": F.concat_ws(":", "source", "source_id"), "content_type": F.lit("image"), "feed": F.col("source"), "seq": F.col("rid")})
    again = rows.filter("rid % 3 = 0").withColumns({"feed": F.lit("extra"), "seq": F.col("rid") + 1000000, "title": F.lit("again")})
    both = rows.unionByName(again).withColumn("title", F.when(F.col("p_size") == 9, F.lit("")).otherwise(F.col("title")))
    zero = "https://creativecommons.org/publicdomain/zero/1.0/"
    both = both.withColumns({"public_domain": F.lit(True), "rights_label": F.lit("CC0"), "license_url": F.lit(zero)})
    return conform(both.drop("p_size", "rid"))


@query("q_build_catalog", f"""
WITH u AS ({IMAGE_ROWS.replace(" FROM part", ", p_name AS title, CASE WHEN p_partkey % 97 = 0 THEN 2 ELSE 0 END AS boost, p_size FROM part")}),
s AS (SELECT *, source AS feed, rid AS seq, 0 AS f FROM u UNION ALL SELECT * REPLACE ('again' AS title), 'extra', rid + 1000000, 1 FROM u WHERE rid % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY boost DESC, ((seq % 1000003) * 2654435761) % 1000003, source_id, seq) AS rn FROM s WHERE p_size <> 9),
k AS (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY f, seq) AS first FROM r WHERE rn <= CASE feed WHEN 'aic' THEN 30 WHEN 'extra' THEN 500 ELSE 100 END)
SELECT source || ':' || source_id AS id, title, boost, rid % 7 <> 0 AS compacted, CASE WHEN source NOT IN ('met', 'aic', 'cma', 'nga', 'si') THEN 'CC0' END AS rights_label FROM k WHERE first = 1""")
def build_catalog(spark, sf):
    caps = {f: 100 for f in FEEDS} | {"aic": 30, "extra": 500}
    catalog = B.build_catalog(staged(spark, sf), FEEDS, caps)
    compacted = F.col("img").isNotNull() & ~((F.col("source") == "europeana") & (F.col("source_id").cast("int") % 7 == 0))
    return catalog.select("id", "title", "boost", compacted.alias("compacted"), "rights_label")


@query("q_ingest_report", f"""
WITH u AS ({IMAGE_ROWS.replace(" FROM part", ", p_size FROM part")})
SELECT source, count(*) AS seen, count(*) FILTER (p_size <> 9) AS kept, count(*) FILTER (p_size <> 9) AS stored, count(*) FILTER (p_size <> 9 AND rid % 7 <> 0) AS compacted FROM u GROUP BY source""")
def ingest_report(spark, sf):
    rows = staged(spark, sf).filter("feed <> 'extra'")
    report = A.IngestReport(FEEDS)
    kept = report.kept(report.seen(rows).filter("title <> ''"))
    report.stored(B.compact(kept)).write.parquet(scratch_path(spark, "ingested"))
    return report.rows(spark)


@query("q_number_rows", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rid FROM orders")
def number_rows(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return with_seq(orders, [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()], [F.col("o_orderdate")], "rid").select("o_orderkey", "rid")


@query("q_write_read_catalog", with_items("SELECT rid, source, title, 'stamp' AS built_at FROM items WHERE source IN ('Brand#3', 'Brand#8') AND year_start >= 1600"))
def write_read_catalog(spark, sf):
    path = scratch_path(spark, "catalog")
    B.write_catalog(items_part(spark, sf), path, built_at="stamp")
    return B.read_catalog(spark, path, ["Brand#3", "Brand#8"]).filter("year_start >= 1600").select("rid", "source", "title", "built_at")


@query("q_manifest", with_items(r"""
SELECT title, source, creator, CAST(year_start AS VARCHAR) AS "date", coalesce(rights_label, '') AS rights, '' AS "record url", replace(title, ' ', '_') || '.jpg' AS file FROM items"""))
def manifest(spark, sf):
    items = items_part(spark, sf).withColumns({
        "title": F.concat(F.lit(" "), F.replace("title", F.lit(" "), F.lit("\t \n"))), "source_name": F.col("source"), "date_display": F.col("year_start").cast("string"),
        "file": F.concat(F.replace("title", F.lit(" "), F.lit("_")), F.lit(".jpg")),
    })
    path = scratch_path(spark, "manifest")
    K.write_manifest_tsv(items, path)
    back = spark.read.option("sep", "\t").option("header", True).csv(path)
    return back.select(F.ltrim("title").alias("title"), "source", "creator", "date", F.coalesce("rights", F.lit("")).alias("rights"), F.coalesce(F.col("record url"), F.lit("")).alias("record url"), "file")


def order_versions(spark, sf, cond: str, shift: int) -> DataFrame:
    """Orders as staged rows: one id per customer and priority, several versions."""
    rows = table(spark, sf, "orders").filter(cond).selectExpr(
        "concat('c', o_custkey, ':', o_orderpriority) id", "o_orderstatus source", "CAST(o_custkey AS STRING) source_id", "concat('order ', o_orderkey) title",
        f"o_orderkey + {shift} updated_at", "o_orderkey seq",
    )
    return rows.withColumn("source", F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(3)).cast("string")))


UPSERTED = """
WITH v AS (SELECT 'c' || o_custkey || ':' || o_orderpriority AS id, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS b FROM orders)
SELECT id, 'order ' || arg_max(o_orderkey, b * 1000000000 + o_orderkey) AS title, count(*) FILTER (o_orderkey >= 0) > 0 AS stored FROM v GROUP BY id"""


@query("q_upsert_staging", UPSERTED)
def upsert(spark, sf):
    path = scratch_path(spark, "staging")
    K.upsert_staging(order_versions(spark, sf, "o_orderkey % 3 <> 0", 0), path, buckets=4)
    second = order_versions(spark, sf, "o_orderkey % 3 = 0", 0)
    K.upsert_staging(second, path, buckets=4)
    back = K.read_staging(spark, path, second.schema)
    return back.select("id", "title", F.lit(True).alias("stored"))


@query("q_drop_source", with_items("SELECT rid, source FROM items WHERE source NOT IN ('Brand#2')"))
def drop_source(spark, sf):
    path = scratch_path(spark, "reload")
    items = items_part(spark, sf)
    K.upsert_staging(items.select("id", "source", "rid", F.col("rid").alias("updated_at")), path, buckets=2)
    K.drop_source(spark, path, "Brand#2")
    return spark.read.schema("id string, rid bigint, updated_at bigint, bucket int, source string").parquet(path).select("rid", "source")


