"""Scalar function queries: cleaning, dates, names, URLs, rights."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.checks import query
from vitrine.checks.views import items_part, table, with_items
from vitrine.functions import rights as R, text as X, urls as U
from vitrine.functions.years import parse_years, year_span, years
from vitrine.operators.filters import allowed_url, drop_redundant_files
from vitrine.plans import build as B
from vitrine.schema import conform, file_struct

SPACES = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def clean_sql(c: str, n: int | None = None) -> str:
    t = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&lt;", "<"), ("&gt;", ">")):
        t = f"replace({t}, '{entity}', '{char}')"
    t = f"nullif(trim(regexp_replace({t}, '{SPACES}', ' ', 'g')), '')"
    return t if n is None else f"CASE WHEN length({t}) > {n} THEN substring({t}, 1, {n - 1}) || '…' ELSE {t} END"


@query("q_clean", f"SELECT page_id, {clean_sql('html')} AS whole, {clean_sql('html', 400)} AS cut FROM pages")
def clean(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.clean("html").alias("whole"), X.clean("html", 400).alias("cut"))


@query("q_trim_to", """
SELECT doc_id, CASE WHEN length(text) > 260 THEN substring(text, 1, 259) || '…' ELSE text END AS cut, length(text) AS n FROM documents""")
def trim_to(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.trim_to("text", 260).alias("cut"), F.length("text").cast("bigint").alias("n"))


# a display date and its range for every order, by template
ORDER_DATES = """
SELECT o_orderkey, y, k,
  CASE k WHEN 0 THEN '' || y WHEN 1 THEN 'ca. ' || y WHEN 2 THEN y || '–' || (y + 7) WHEN 3 THEN y || '-' || substring('' || (y + 3), 3, 2)
    WHEN 4 THEN substring('' || y, 1, 3) || '0s' WHEN 5 THEN 'early ' || substring('' || y, 1, 3) || '0''s' WHEN 6 THEN 'late ' || c || 'th century'
    WHEN 7 THEN 'before ' || y WHEN 8 THEN 'after ' || y WHEN 9 THEN (y - 1000) || ' BCE' WHEN 10 THEN c || 'th–' || (c + 1) || 'th century'
    WHEN 11 THEN 'n.d.' WHEN 12 THEN 'mid-' || c || 'th century' WHEN 13 THEN 'first half of the ' || c || 'th century'
    WHEN 14 THEN c || 'th century B.C.' WHEN 15 THEN y || '-07-04' WHEN 16 THEN '2nd millennium' WHEN 17 THEN (y % 60 + 10) || ' AD'
    WHEN 18 THEN 'no. 12' WHEN 19 THEN 'late ' || substring('' || y, 1, 3) || '0s' WHEN 20 THEN '3rd millennium B.C.'
    WHEN 21 THEN '500-' || y ELSE 'about ' || y || '-' || (y + 5) END AS display, c
FROM (SELECT o_orderkey, CAST(1500 + o_custkey % 480 AS INT) AS y, CAST(o_orderkey % 23 AS INT) AS k, CAST(12 + o_custkey % 8 AS INT) AS c FROM orders)
"""


@query("q_years", f"""
WITH d AS ({ORDER_DATES})
SELECT o_orderkey, display,
  CAST(CASE k WHEN 0 THEN y WHEN 1 THEN y - 5 WHEN 2 THEN y WHEN 3 THEN y WHEN 4 THEN y - y % 10 WHEN 5 THEN y - y % 10 WHEN 6 THEN c * 100 - 49
    WHEN 7 THEN y - 30 WHEN 8 THEN y WHEN 9 THEN -(y - 1000) WHEN 10 THEN (c - 1) * 100 + 1 WHEN 12 THEN (c - 1) * 100 + 26
    WHEN 13 THEN (c - 1) * 100 + 1 WHEN 14 THEN -c * 100 WHEN 15 THEN y WHEN 16 THEN 1001 WHEN 17 THEN y % 60 + 10 WHEN 19 THEN y - y % 10 + 5
    WHEN 20 THEN -3000 WHEN 21 THEN CASE WHEN y - 500 <= 1200 THEN 500 END WHEN 22 THEN y END AS INT) AS year_start,
  CAST(CASE k WHEN 0 THEN y WHEN 1 THEN y + 5 WHEN 2 THEN y + 7
    WHEN 3 THEN greatest(y - y % 100 + (y + 3) % 100, y) WHEN 4 THEN y - y % 10 + 9 WHEN 5 THEN y - y % 10 + 4
    WHEN 6 THEN c * 100 WHEN 7 THEN y WHEN 8 THEN y + 30 WHEN 9 THEN -(y - 1000) WHEN 10 THEN (c + 1) * 100 WHEN 12 THEN c * 100 - 25
    WHEN 13 THEN (c - 1) * 100 + 50 WHEN 14 THEN -((c - 1) * 100 + 1) WHEN 15 THEN greatest(y - y % 100 + 7, y) WHEN 16 THEN 2000 WHEN 17 THEN y % 60 + 10
    WHEN 19 THEN y - y % 10 + 9 WHEN 20 THEN -2001 WHEN 21 THEN CASE WHEN y - 500 <= 1200 THEN y END WHEN 22 THEN y + 5 END AS INT) AS year_end
FROM d""")
def parsed_years(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    dates = spark.sql(ORDER_DATES).withColumn("r", parse_years("display"))
    return dates.select("o_orderkey", "display", F.col("r.start").alias("year_start"), F.col("r.end").alias("year_end"))


NUMERIC_DATES = """
SELECT p_partkey, CASE p_partkey % 7 WHEN 3 THEN NULL WHEN 4 THEN '0' WHEN 6 THEN 'x' ELSE '' || (1000 + p_partkey % 900) END AS s,
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '' || (900 + p_partkey % 1100) ELSE ' ' || (1000 + p_partkey % 900 + p_size) || '.5 ' END AS e,
  CASE WHEN p_partkey % 2 = 0 THEN '' || (1600 + p_size) END AS d, p_size FROM part
"""


@query("q_years_numeric", f"""
WITH r AS (SELECT p_partkey, TRY_CAST(s AS BIGINT) AS s, CAST(trunc(TRY_CAST(trim(e) AS DOUBLE)) AS BIGINT) AS e, d, p_size FROM ({NUMERIC_DATES})),
f AS (SELECT *, coalesce(s <> 0 AND e <> 0 AND s <= e AND e - s <= 1200 AND e <= 2100, FALSE) AS sane, coalesce(s <> 0 AND e IS NULL, FALSE) AS alone FROM r)
SELECT p_partkey, CAST(CASE WHEN sane OR alone THEN s WHEN d IS NOT NULL THEN 1600 + p_size WHEN s <> 0 THEN s END AS INT) AS year_start,
  CAST(CASE WHEN sane THEN e WHEN alone THEN s WHEN d IS NOT NULL THEN 1600 + p_size WHEN s <> 0 THEN CASE WHEN e <> 0 AND e >= s THEN e ELSE s END END AS INT) AS year_end
FROM f""")
def numeric_years(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    dates = spark.sql(NUMERIC_DATES).withColumn("r", years(F.col("s"), F.col("e"), F.col("d")))
    return dates.select("p_partkey", F.col("r.start").alias("year_start"), F.col("r.end").alias("year_end"))


@query("q_year_span", """
WITH d AS (SELECT p_brand, CAST(1500 + p_size * 10 AS INT) AS y FROM part)
SELECT p_brand, min(y) AS first_year, max(y) + 9 AS last_year FROM d GROUP BY p_brand""")
def spans(spark, sf):
    # few distinct dates per brand, so the list is short whatever the table holds
    dates = table(spark, sf, "part").select("p_brand", F.concat((1500 + F.col("p_size") * 10).cast("string"), F.lit("s")).alias("d")).distinct()
    listed = dates.groupBy("p_brand").agg(F.collect_list("d").alias("ds"))
    span = listed.withColumn("r", year_span(F.transform("ds", parse_years)))
    return span.select("p_brand", F.col("r.start").alias("first_year"), F.col("r.end").alias("last_year"))


@query("q_join_unique", """
WITH p AS (SELECT p_partkey, [p_type, lower(p_type), NULL, '  ' || p_brand || ' ', p_name, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END] AS parts FROM part)
SELECT p_partkey, upper(p_type) || '; ' || p_brand || '; ' || p_name AS joined FROM p JOIN part USING (p_partkey)""")
def join_unique(spark, sf):
    part = table(spark, sf, "part")
    parts = F.array(
        "p_type", F.lower("p_type"), F.lit(None).cast("string"), F.concat(F.lit("  "), "p_brand", F.lit(" ")), "p_name",
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(""),
    )
    return part.select("p_partkey", X.join_unique(parts).alias("joined"))


@query("q_slug", """
WITH s AS (SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g') AS t,
  regexp_replace(lower(strip_accents(split_part(text, chr(10), 1))), '[^a-z0-9]+', '-', 'g') AS l FROM documents)
SELECT doc_id, coalesce(nullif(regexp_replace(t, '^-+|-+$', '', 'g'), ''), 'untitled') AS slug,
  coalesce(nullif(substring(regexp_replace(l, '^-+|-+$', '', 'g'), 1, 60), ''), 'untitled') AS title_slug FROM s""")
def slug(spark, sf):
    """The whole text without a cut, and the first line as a title."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", X.slug("text", None).alias("slug"), X.slug(title).alias("title_slug"))


@query("q_ext", r"""
WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, regexp_replace(url, '/([a-z]+)/', '/\1.JPG') FROM pages
  UNION ALL SELECT page_id + 2000000, split_part(url, '?', 1) || '.tiff?w=1.png#a.b' FROM pages)
SELECT page_id, nullif(lower(regexp_extract(regexp_replace(url, '[?#](.|\n)*$', ''), '\.([A-Za-z0-9]{2,5})$', 1)), '') AS ext FROM u""")
def ext(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    jpg = pages.select(F.col("page_id") + 1000000, F.regexp_replace("url", "/([a-z]+)/", "/$1.JPG"))
    # only the first match is replaced on the SQL side
    jpg = pages.select(F.col("page_id") + 1000000, F.regexp_replace("url", "^(.*?)/([a-z]+)/", "$1/$2.JPG"))
    tiff = pages.select(F.col("page_id") + 2000000, F.concat(F.substring_index("url", "?", 1), F.lit(".tiff?w=1.png#a.b")))
    return pages.union(jpg).union(tiff).select("page_id", X.ext_of("url").alias("ext"))


@query("q_to_int", """
WITH v AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' || p_retailprice WHEN 1 THEN ' ' || p_partkey || ' ' WHEN 2 THEN '' WHEN 3 THEN p_name ELSE '-' || p_size || '.9' END AS v FROM part)
SELECT p_partkey, CAST(trunc(TRY_CAST(trim(v) AS DOUBLE)) AS BIGINT) AS n FROM v""")
def to_int(spark, sf):
    part = table(spark, sf, "part").selectExpr(
        "p_partkey",
        "CASE p_partkey % 5 WHEN 0 THEN '' || p_retailprice WHEN 1 THEN ' ' || p_partkey || ' ' WHEN 2 THEN '' WHEN 3 THEN p_name ELSE '-' || p_size || '.9' END v",
    )
    return part.select("p_partkey", X.to_int("v").alias("n"))


QUERY_WORDS = r"""
WITH q AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[“”"''‘’`]', ' ', 'g'), '[^\p{L}\p{N}]+'),
  lambda w: length(w) > 0 AND length(w) < 40) AS w FROM conversations)
SELECT conv_id, turn, array_to_string(w[1:12], ' ') AS words FROM q"""


@query("q_tokenize_query", QUERY_WORDS.replace(" AND length(w) < 40", "").replace("w[1:12]", "w"))
def tokenize(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(X.query_tokens("text"), " ").alias("words"))


@query("q_tokenize_query_limits", QUERY_WORDS)
def tokenize_limits(spark, sf):
    """The same with the bounds of a public site."""
    words = X.query_tokens("text", **X.SITE_QUERY)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(words, " ").alias("words"))


FORMS = {
    "met": ("https://images.metmuseum.org/CRDImages/ep/web-large/DP{k}.jpg",) * 2 + ("https://images.metmuseum.org/CRDImages/ep/original/DP{k}.jpg", "ep/DP{k}.jpg"),
    "aic": ("https://www.artic.edu/iiif/2/{k}/full/600,/0/default.jpg", "https://www.artic.edu/iiif/2/{k}/full/1686,/0/default.jpg", "https://www.artic.edu/iiif/2/{k}/full/3000,/0/default.jpg", "{k}"),
    "cma": ("https://openaccess-cdn.clevelandart.org/{k}/{k}_web.jpg", "https://openaccess-cdn.clevelandart.org/{k}/{k}_print.jpg", "https://openaccess-cdn.clevelandart.org/{k}/{k}_full.tif", "{k}"),
    "nga": ("https://api.nga.gov/iiif/{k}/full/!600,600/0/default.jpg", "https://api.nga.gov/iiif/{k}/full/!1600,1600/0/default.jpg", "https://api.nga.gov/iiif/{k}/full/max/0/default.jpg", "{k}"),
    "si": ("https://ids.si.edu/ids/deliveryService?id=A%20{k}&max=600", "https://ids.si.edu/ids/deliveryService?id=A%20{k}&max=1600", "https://ids.si.edu/ids/deliveryService?id=A%20{k}", "A {k}"),
    "rijks": ("https://iiif.micr.io/{k}/full/500,/0/default.jpg", "https://iiif.micr.io/{k}/full/1600,/0/default.jpg", "https://iiif.micr.io/{k}/full/max/0/default.jpg", "{k}"),
    "harvard": ("https://nrs.harvard.edu/urn-3:HUAM:{k}?width=600", "https://nrs.harvard.edu/urn-3:HUAM:{k}?width=1600", "https://nrs.harvard.edu/urn-3:HUAM:{k}", "HUAM:{k}"),
    "smk": ("https://iip-thumb.smk.dk/iiif/jp2/{k}/full/!600,600/0/default.jpg", "https://iip-thumb.smk.dk/iiif/jp2/{k}/full/!1600,1600/0/default.jpg", "https://iip-thumb.smk.dk/iiif/jp2/{k}/full/max/0/default.jpg", "{k}"),
    "nypl": ("https://images.nypl.org/index.php?id={k}&t=r", "https://images.nypl.org/index.php?id={k}&t=q", "https://images.nypl.org/index.php?id={k}&t=g", "{k}"),
    "flickr": ("https://live.staticflickr.com/{k}.jpg", "https://live.staticflickr.com/{k}_b.jpg", "https://live.staticflickr.com/{k}_b.jpg", "{k}"),
    "europeana": ("https://api.europeana.eu/thumbnail/v2/url.json?uri=https%3A%2F%2Fx.org%2F{k}&type=IMAGE&size=w400", "https://x.org/{k}", "https://x.org/{k}", "https://x.org/{k}"),
    "wellcome": ("https://iiif.wellcomecollection.org/thumbs/{k}/full/!600,600/0/default.jpg", "https://iiif.wellcomecollection.org/thumbs/{k}/full/!1024,1024/0/default.jpg", "https://iiif.wellcomecollection.org/thumbs/{k}/full/!1024,1024/0/default.jpg", "{k}"),
}


def _form(i: int) -> str:
    cases = " ".join(
        f"WHEN {n} THEN replace('{forms[i]}', '{{k}}', '' || p_partkey)" for n, forms in enumerate(FORMS.values())
    )
    return f"CASE p_partkey % 12 {cases} END"


SOURCES = "CASE p_partkey % 12 " + " ".join(f"WHEN {n} THEN '{s}'" for n, s in enumerate(FORMS)) + " END"
# every seventh record has an original that no form gives back
IMAGE_ROWS = f"""SELECT p_partkey AS rid, {SOURCES} AS source, '' || p_partkey AS source_id, {_form(0)} AS thumb_url,
  CASE WHEN p_size = 7 THEN NULL ELSE {_form(1)} END AS image_url,
  CASE WHEN p_partkey % 7 = 0 THEN 'https://other.example.org/' || p_partkey ELSE {_form(2)} END AS original_url FROM part"""


@query("q_compact_expand", f"""
WITH u AS ({IMAGE_ROWS})
SELECT rid, u.source, CASE WHEN rid % 7 <> 0 THEN {_form(3)} WHEN source = 'europeana' THEN NULL END AS img,
  CASE WHEN rid % 7 <> 0 THEN thumb_url END AS thumb, CASE WHEN rid % 7 <> 0 THEN {_form(1)} END AS image, CASE WHEN rid % 7 <> 0 THEN original_url END AS original
FROM u JOIN part ON p_partkey = rid""")
def compact_expand(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    rows = spark.sql(IMAGE_ROWS)
    keyed = rows.withColumn("img", U.compact_images(F.col("source"), F.col("thumb_url"), F.col("image_url"), F.col("original_url")))
    return keyed.withColumn("u", U.expand_images(F.col("source"), F.col("img"))).select("rid", "source", "img", "u.thumb", "u.image", "u.original")


@query("q_record_url", f"""
WITH u AS ({IMAGE_ROWS})
SELECT rid, CASE source WHEN 'met' THEN 'https://www.metmuseum.org/art/collection/search/' || rid WHEN 'aic' THEN 'https://www.artic.edu/artworks/' || rid
  WHEN 'cma' THEN CASE WHEN rid % 7 = 0 THEN 'https://www.clevelandart.org/art/collection/search' ELSE 'https://clevelandart.org/art/' || rid END
  WHEN 'nga' THEN 'https://www.nga.gov/collection/art-object-page.' || rid || '.html' WHEN 'rijks' THEN 'https://www.rijksmuseum.nl/en/collection/' || rid END AS url FROM u""")
def record_url(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    rows = spark.sql(IMAGE_ROWS)
    key = U.compact_images(F.col("source"), F.col("thumb_url"), F.col("image_url"), F.col("original_url"))
    return rows.select("rid", U.default_record_url(F.col("source"), F.col("source_id"), key).alias("url"))


@query("q_commons_urls", """
SELECT p_partkey, 'https://commons.wikimedia.org/wiki/Special:FilePath/' || replace(p_name, ' ', '%20') || '%20(' || p_partkey || ')*%26.jpg?width=600' AS thumb,
  'https://commons.wikimedia.org/wiki/Special:FilePath/' || replace(p_name, ' ', '%20') || '%20(' || p_partkey || ')*%26.jpg' AS original,
  p_name || ' (' || p_partkey || ')*&.jpg' AS back FROM part""")
def commons(spark, sf):
    part = table(spark, sf, "part")
    name = F.concat("p_name", F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")*&.jpg"))
    urls = part.select("p_partkey", U.commons_urls(name).alias("u"))
    coded = F.regexp_extract("u.original", "FilePath/(.+)$", 1)
    return urls.select("p_partkey", "u.thumb", "u.original", U.decode_component(coded).alias("back"))


RIGHTS_ROWS = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'http://creativecommons.org/publicdomain/mark/1.0/' WHEN 1 THEN 'http://creativecommons.org/publicdomain/zero/1.0/'
  WHEN 2 THEN 'http://creativecommons.org/licenses/by/4.0/' WHEN 3 THEN 'http://creativecommons.org/licenses/by-sa/3.0/' WHEN 4 THEN 'http://creativecommons.org/licenses/by-nc/4.0/' ELSE 'http://rightsstatements.org/vocab/InC/1.0/' END AS url,
  CASE p_size % 8 WHEN 0 THEN 'Public Domain' WHEN 1 THEN 'CC0 1.0' WHEN 2 THEN 'CC-BY' WHEN 3 THEN 'CC BY 4.0' WHEN 4 THEN 'CC-BY-SA 4.0' WHEN 5 THEN 'CC BY-NC 4.0' WHEN 6 THEN 'All rights reserved' END AS name,
  CASE p_size % 4 WHEN 0 THEN 'pdm' WHEN 1 THEN 'cc0' WHEN 2 THEN 'cc-by' ELSE 'inc' END AS code,
  '' || (p_partkey % 12) AS number FROM part"""


@query("q_rights", f"""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Public domain' WHEN 1 THEN 'CC0' WHEN 2 THEN 'CC BY 4.0' WHEN 3 THEN 'CC BY-SA 4.0' END AS by_url,
  CASE WHEN p_partkey % 6 < 2 THEN TRUE WHEN p_partkey % 6 < 4 THEN FALSE END AS pd_by_url,
  CASE p_size % 8 WHEN 0 THEN 'Public domain' WHEN 1 THEN 'CC0' WHEN 2 THEN 'CC BY 4.0' WHEN 3 THEN 'CC BY 4.0' WHEN 4 THEN 'CC BY-SA 4.0' END AS by_name,
  CASE p_size % 4 WHEN 0 THEN 'Public domain' WHEN 1 THEN 'CC0' WHEN 2 THEN 'CC BY 4.0' END AS by_code,
  CASE p_partkey % 12 WHEN 7 THEN 'No known copyright restrictions' WHEN 9 THEN 'CC0' WHEN 10 THEN 'Public domain' END AS by_number
FROM part""")
def rights(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    rows = spark.sql(RIGHTS_ROWS)
    return rows.select(
        "p_partkey",
        R.rights_from_url(F.col("url"))["rights_label"].alias("by_url"),
        R.rights_from_url(F.col("url"))["public_domain"].alias("pd_by_url"),
        R.rights_from_license_name(F.col("name"))["rights_label"].alias("by_name"),
        R.rights_from_license_id(F.col("code"))["rights_label"].alias("by_code"),
        R.rights_from_photo_license(F.col("number"))["rights_label"].alias("by_number"),
    )


def _brand_defaults(spark):
    return B.source_defaults(spark, {f"Brand#{i}": (True, "CC0", "https://creativecommons.org/publicdomain/zero/1.0/") for i in range(0, 26, 2)})


ELIDE_VIEW = "SELECT *, CASE WHEN public_domain THEN 'https://creativecommons.org/publicdomain/zero/1.0/' END AS license_url, TRY_CAST(replace(source, 'Brand#', '') AS INT) % 2 = 0 AS even FROM items"


@query("q_elide_restore", with_items(f"""
SELECT rid, even AND coalesce(public_domain, FALSE) AS elided, CASE WHEN even AND coalesce(public_domain, FALSE) THEN NULL ELSE coalesce(rights_label, 'none') END AS stored_label,
  CASE WHEN rights_label IS NULL AND even THEN TRUE ELSE public_domain END AS public_domain,
  CASE WHEN rights_label IS NOT NULL THEN rights_label WHEN even THEN 'CC0' ELSE 'Rights unclear — check source' END AS rights_label,
  CASE WHEN rights_label IS NULL AND even THEN 'https://creativecommons.org/publicdomain/zero/1.0/' ELSE license_url END AS license_url
FROM ({ELIDE_VIEW})"""))
def elide_restore(spark, sf):
    zero = "https://creativecommons.org/publicdomain/zero/1.0/"
    items = items_part(spark, sf).withColumn("license_url", F.when(F.col("public_domain"), F.lit(zero)))
    defaults = _brand_defaults(spark)
    elided = B.elide_rights(items.withColumn("had_label", F.col("rights_label").isNotNull()), defaults)
    gone = F.col("had_label") & F.col("rights_label").isNull()
    marked = elided.withColumn("elided", gone).withColumn("stored_label", F.when(~gone, F.coalesce("rights_label", F.lit("none"))))
    back = B.restore_rights(marked, defaults)
    return back.select("rid", "elided", "stored_label", "public_domain", "rights_label", "license_url")


@query("q_row_to_item", f"""
WITH u AS ({IMAGE_ROWS})
SELECT rid, source, thumb_url, {_form(1)} AS image_url, original_url,
  CASE WHEN source = 'cma' THEN 2 ELSE 1 END + CASE WHEN rid % 4 = 0 THEN 1 ELSE 0 END AS n_files,
  original_url AS first_file, CASE WHEN source = 'cma' THEN 'Full resolution TIFF' ELSE 'Original' END AS first_label,
  coalesce(CASE WHEN source IN ('met', 'aic', 'cma', 'nga', 'si') THEN 'CC0' WHEN source = 'rijks' THEN 'Public domain' END, 'Rights unclear — check source') AS rights_label
FROM u JOIN part ON p_partkey = rid""")
def row_to_item(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    full = spark.sql(IMAGE_ROWS.replace("CASE WHEN p_size = 7 THEN NULL ELSE", "CASE WHEN 1 = 1 THEN").replace("END END AS image_url", "END END AS image_url"))
    extra = F.when(F.col("rid") % 4 == 0, F.array(file_struct("pdf", F.concat(F.lit("https://f.example.org/"), "source_id"), "Notes"), file_struct("jpg", F.col("original_url"), "Copy")))
    staged = conform(full.withColumn("content_type", F.lit("image")).withColumn("files", extra))
    stored = B.elide_rights(B.compact(staged))
    items = B.row_to_item(stored)
    first = F.get("files", F.lit(0))
    return items.select("rid", "source", "thumb_url", "image_url", "original_url", F.size("files").alias("n_files"),
                        first["url"].alias("first_file"), first["label"].alias("first_label"), "rights_label")


@query("q_redundant_files", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'https://a.example.org/' || p_partkey ELSE 'https://a.example.org/' || p_partkey || ',https://b.example.org/' || p_partkey END AS kept FROM part""")
def redundant_files(spark, sf):
    part = table(spark, sf, "part")
    a = F.concat(F.lit("https://a.example.org/"), F.col("p_partkey").cast("string"))
    b = F.concat(F.lit("https://b.example.org/"), F.col("p_partkey").cast("string"))
    kept = drop_redundant_files(F.array(file_struct("jpg", a), file_struct("jpg", b)), F.when(F.col("p_partkey") % 2 == 0, b))
    return part.select("p_partkey", F.array_join(F.transform(kept, lambda f: f["url"]), ",").alias("kept"))


@query("q_download_name", with_items("""
SELECT rid, source || '-' || rid || '-' || replace(title, ' ', '-') || '.jpg' AS name FROM items"""))
def download_name(spark, sf):
    ext = F.coalesce(X.ext_of("thumb_url"), F.lit("jpg"))
    return items_part(spark, sf).select("rid", X.download_name(F.col("source"), F.col("id"), F.col("title"), ext).alias("name"))


@query("q_caption", with_items("""
SELECT rid, concat_ws(' · ', creator, CASE WHEN rid % 4 = 0 THEN NULL ELSE 'ca. ' || year_start END) AS line1,
  CASE WHEN public_domain THEN source || ' · ' || rights_label ELSE source END AS line2 FROM items"""))
def caption(spark, sf):
    date = F.when(F.col("rid") % 4 != 0, F.concat(F.lit("ca. "), F.col("year_start").cast("string")))
    named = B.with_source_name(items_part(spark, sf))
    c = X.caption(F.col("creator"), date, F.col("source_name"), F.col("public_domain"), F.col("rights_label"))
    return named.select("rid", c.alias("c")).select("rid", "c.line1", "c.line2")


@query("q_rendition_order", f"""
WITH u AS ({IMAGE_ROWS})
SELECT rid, array_to_string(CASE WHEN image_url IS NULL THEN CASE WHEN original_url = thumb_url THEN [original_url] ELSE [original_url, thumb_url] END
  ELSE list_distinct_in_order END, ' ') AS orig, n_urls FROM (
  SELECT *, CASE WHEN original_url = image_url THEN CASE WHEN thumb_url = image_url THEN [original_url] ELSE [original_url, thumb_url] END
    WHEN thumb_url IN (original_url, image_url) THEN [original_url, image_url] ELSE [original_url, image_url, thumb_url] END AS list_distinct_in_order,
  CASE WHEN image_url IS NULL THEN 2 ELSE 3 END AS n_urls FROM u)""")
def renditions(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    rows = conform(spark.sql(IMAGE_ROWS))
    return rows.select("rid", F.array_join(B.rendition_order(), " ").alias("orig"), F.size(B.item_urls(rows)).alias("n_urls"))


@query("q_allowed_url", """
WITH u AS (SELECT page_id, url, page_id % 6 AS k FROM pages)
SELECT page_id, k IN (1, 2, 3) AS allowed FROM u""")
def allowed(spark, sf):
    pages = table(spark, sf, "pages")
    k = F.col("page_id") % 6
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    url = (
        F.when(k == 0, F.col("url"))
        .when(k == 1, F.concat(F.lit("https://patentimages.storage.googleapis.com"), path))
        .when(k == 2, F.concat(F.lit("https://abc.public.blob.vercel-storage.com"), path))
        .when(k == 3, F.concat(F.lit("https://storage.googleapis.com/patentimages"), path))
        .when(k == 4, F.concat(F.lit("https://storage.googleapis.com/other"), path))
        .otherwise(F.concat(F.lit("http://patentimages.storage.googleapis.com"), path))
    )
    return pages.select("page_id", allowed_url(url).alias("allowed"))


@query("q_page_title", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' (' || (1500 + p_size) || ') — p. ' || p_partkey WHEN 1 THEN p_name || ' — p. ' || p_partkey ELSE p_name END AS title FROM part""")
def page_title(spark, sf):
    part = table(spark, sf, "part").selectExpr(
        "p_partkey",
        """CASE p_partkey % 3 WHEN 0 THEN 'Image from page ' || p_partkey || ' of "' || p_name || '" (' || (1500 + p_size) || ')'
           WHEN 1 THEN 'Image from page ' || p_partkey || ' of "' || p_name || '"' ELSE p_name END t""",
    )
    return part.select("p_partkey", X.rewrite_page_title("t").alias("title"))


@query("q_parse_files", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 0 ELSE 1 END AS n, CASE WHEN p_partkey % 3 <> 2 THEN 'https://f.example.org/' || p_partkey END AS url, CASE WHEN p_partkey % 3 <> 2 THEN CAST(p_size AS BIGINT) END AS size FROM part""")
def parse_files(spark, sf):
    part = table(spark, sf, "part").selectExpr(
        "p_partkey",
        """CASE WHEN p_partkey % 3 = 2 THEN '[{"format": broken' ELSE '[{"format":"jpg","url":"https://f.example.org/' || p_partkey || '","size":' || p_size || '}]' END j""",
    )
    first = F.get("fs", F.lit(0))
    return part.select("p_partkey", B.parse_files(F.col("j")).alias("fs")).select("p_partkey", F.size("fs").alias("n"), first["url"].alias("url"), first["size"].alias("size"))


@query("q_tag_terms", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_type ELSE p_brand || ' ' || p_type END AS tags FROM part""")
def tag_terms(spark, sf):
    part = table(spark, sf, "part")
    terms = F.when(F.col("p_partkey") % 2 == 0, F.array("p_name", "p_type"))
    return part.select("p_partkey", X.tag_terms(terms, F.concat_ws("|", "p_brand", "p_type")).alias("tags"))


@query("q_search_text", """
SELECT p_partkey, concat_ws(' | ', p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END, p_name) AS text FROM part""")
def search_text(spark, sf):
    part = table(spark, sf, "part")
    middle = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 0, F.lit(""))
    return part.select("p_partkey", X.join_parts(F.col("p_brand"), middle, F.col("p_name")).alias("text"))
