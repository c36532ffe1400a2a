"""Mappings of museum sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions import rights as R
from vitrine.functions.text import (
    clean, english_terms, english_type, ext_of, first_nonblank, join_parts, join_unique, let, nonblank, tag_terms, to_int,
)
from vitrine.functions.urls import commons_urls, decode_component, encode_component
from vitrine.functions.years import parse_years, year_span, years
from vitrine.operators.aggregates import primary_image, terms_by_object
from vitrine.schema import file_struct, no_files
from vitrine.sources.mapping import (
    Limits, SourceMapping, first, or_untitled, prepared, present, raw, rights_columns, strings, year_columns,
)

def one_file(format, url, label) -> Column:
    return F.array(file_struct(format, url, label))


# Metropolitan Museum: bulk CSV rows joined with one API object per id ---------

MET_CSV = [
    "Object ID", "Is Highlight", "Is Public Domain", "Department", "Object Name", "Title", "Culture", "Period",
    "Artist Display Name", "Artist Display Bio", "Object Date", "Object Begin Date", "Object End Date", "Medium",
    "Country", "City", "Classification", "Tags", "Object Number",
]
MET_OBJECT = """objectID bigint, primaryImage string, primaryImageSmall string, additionalImages array<string>,
  objectURL string, title string, objectName string, objectDate string, objectBeginDate bigint, objectEndDate bigint,
  artistDisplayName string, artistDisplayBio string, medium string, culture string, period string, city string,
  country string, department string, classification string, tags array<struct<term:string>>"""


def met_rows(csv: DataFrame) -> DataFrame:
    """Public-domain CSV rows with typed id and years."""
    return csv.filter(F.col("`Is Public Domain`") == "True").select(
        to_int("`Object ID`").alias("met_id"),
        (F.col("`Is Highlight`") == "True").alias("highlight"),
        *[F.col(f"`{c}`") for c in MET_CSV[3:] if c not in ("Object Begin Date", "Object End Date")],
        F.nullif(to_int("`Object Begin Date`"), F.lit(0).cast("bigint")).alias("begin"),
        F.nullif(to_int("`Object End Date`"), F.lit(0).cast("bigint")).alias("end"),
    )


def pending_rows(rows: DataFrame, done: DataFrame, key: str = "met_id") -> DataFrame:
    """Rows not yet crawled."""
    return rows.join(done.select(key), key, "left_anti")


def _met_columns(obj, limits: Limits) -> dict[str, Column]:
    # the API value wins when it is there at all, even when it is empty
    def pick(api: str, csv: str) -> Column:
        return F.coalesce(obj(api), raw(csv)) if obj else raw(csv)

    artist = clean(pick("artistDisplayName", "Artist Display Name"))
    bio = clean(pick("artistDisplayBio", "Artist Display Bio"), limits.length("biography"))
    begin = F.coalesce(obj("objectBeginDate"), raw("begin")) if obj else raw("begin")
    end = F.coalesce(obj("objectEndDate"), raw("end")) if obj else raw("end")
    terms = F.transform(obj("tags"), lambda t: t["term"]) if obj else F.lit(None).cast("array<string>")
    return {
        "title": or_untitled(clean(pick("title", "Title")), clean(raw("Object Name"))),
        "creator": F.concat(artist, F.coalesce(F.concat(F.lit(" ("), bio, F.lit(")")), F.lit(""))),
        "date_display": clean(pick("objectDate", "Object Date")),
        **year_columns(years(begin, end, pick("objectDate", "Object Date"))),
        "object_type": clean(pick("objectName", "Object Name")),
        "medium": clean(pick("medium", "Medium")),
        "culture": join_unique(F.array(pick("culture", "Culture"), pick("period", "Period"))),
        "place": join_unique(F.array(pick("city", "City"), pick("country", "Country"))),
        **rights_columns(R.CC0),
        "text": join_parts(
            pick("department", "Department"), pick("classification", "Classification"), tag_terms(terms, raw("Tags"))
        ),
        "boost": F.when(raw("highlight"), 2).otherwise(0),
    }


def _met_record_url() -> Column:
    return F.concat(F.lit("https://www.metmuseum.org/art/collection/search/"), raw("met_id").cast("string"))


def _met_api(name: str) -> Column:
    return raw(f"o.{name}")


def _met_api_columns(limits: Limits) -> dict[str, Column]:
    big, small = nonblank(raw("o.primaryImage")), nonblank(raw("o.primaryImageSmall"))
    views = F.transform(limits.first(strings("o.additionalImages"), "views"), lambda u: file_struct("jpg", u, "Additional view"))
    return {
        **_met_columns(_met_api, limits),
        "source_url": first_nonblank(raw("o.objectURL"), _met_record_url()),
        "thumb_url": F.coalesce(small, big),
        "image_url": F.coalesce(small, big),
        "original_url": F.coalesce(big, small),
        "files": F.concat(one_file("jpg", F.coalesce(big, small), "Original"), views),
    }


MET = SourceMapping(
    key="met",
    schema=MET_OBJECT,
    source_id=lambda: raw("met_id"),
    keep=lambda: first_nonblank(raw("o.primaryImage"), raw("o.primaryImageSmall")).isNotNull(),
    columns=_met_api_columns,
)


def met_items(csv: DataFrame, objects: DataFrame, limits: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """CSV rows joined with their API objects."""
    api = objects.select(F.col("objectID").alias("met_id"), F.struct("*").alias("o"))
    return MET.apply(met_rows(csv).join(api, "met_id"), limits=limits)


def _commons_columns(limits: Limits) -> dict[str, Column]:
    ext = F.coalesce(nonblank(F.lower(F.regexp_extract(raw("filename"), r"(?i)\.([a-z]+)$", 1))), F.lit("jpg"))
    return {
        **_met_columns(None, limits),
        "source_url": _met_record_url(),
        "thumb_url": raw("u.thumb"),
        "image_url": raw("u.image"),
        "original_url": raw("u.original"),
        "files": one_file(ext, raw("u.original"), "Original (Wikimedia Commons)"),
    }


MET_COMMONS = SourceMapping(
    key="met",
    schema="metId string, image string",
    source_id=lambda: raw("met_id"),
    keep=lambda: F.lit(True),
    columns=_commons_columns,
)


def metwiki_items(
    pairs: DataFrame, csv: DataFrame, crawled: DataFrame, limits: Mapping[str, Mapping[str, int]] | None = None
) -> DataFrame:
    """Objects known from a (metId, image) list that the crawl has not reached. ``crawled``: column met_id."""
    link = F.regexp_extract(F.trim("image"), r"Special:FilePath/(.+)$", 1)
    found = (
        pairs.select(F.trim("metId").alias("m"), decode_component(nonblank(link)).alias("filename"))
        .filter(F.col("m").rlike(r"^\d+$") & F.col("filename").rlike(r"(?i)\.(jpe?g|png|tiff?)$"))
        .select(F.col("m").cast("bigint").alias("met_id"), "filename")
    )
    fresh = pending_rows(found, crawled).withColumn("u", commons_urls(F.col("filename")))
    return MET_COMMONS.apply(fresh.join(met_rows(csv), "met_id"), limits=limits)


# National Gallery of Art: three CSV files -----------------------------------

NGA_IMAGES = ["depictstmsobjectid", "openaccess", "viewtype", "sequence", "iiifurl", "width", "height", "maxpixels"]
NGA_TERMS = ["objectid", "termtype", "term"]
NGA_OBJECTS = [
    "objectid", "isvirtual", "title", "attribution", "displaydate", "beginyear", "endyear", "classification", "medium",
    "subclassification", "departmentabbr", "portfolio", "series",
]


def _nga_columns(_limits: Limits) -> dict[str, Column]:
    def sized(size: str) -> Column:
        return F.concat(raw("iiifurl"), F.lit(f"/full/{size}/0/default.jpg"))

    return {
        "source_url": F.concat(F.lit("https://www.nga.gov/collection/art-object-page."), raw("objectid"), F.lit(".html")),
        "title": or_untitled(clean(raw("title"))),
        "creator": clean(raw("attribution")),
        "date_display": clean(raw("displaydate")),
        **year_columns(years(raw("beginyear"), raw("endyear"), raw("displaydate"))),
        "object_type": clean(raw("classification")),
        "medium": clean(raw("medium")),
        "place": join_unique(raw("places")),
        **rights_columns(R.CC0),
        "thumb_url": sized("!600,600"),
        "image_url": sized("!1600,1600"),
        "original_url": sized("max"),
        "width": F.nullif(to_int(raw("width")), F.lit(0).cast("bigint")),
        "height": F.nullif(to_int(raw("height")), F.lit(0).cast("bigint")),
        "files": one_file("jpg", sized("max"), "Full resolution JPEG"),
        "text": join_parts(
            raw("subclassification"), raw("departmentabbr"), raw("portfolio"), raw("series"), join_unique(raw("keywords"), " ")
        ),
    }


NGA = SourceMapping(
    key="nga",
    schema=", ".join(f"{c} string" for c in NGA_OBJECTS),
    source_id=lambda: raw("objectid"),
    keep=lambda: F.coalesce(raw("isvirtual"), F.lit("")) != "1",
    columns=_nga_columns,
)


def nga_items(images: DataFrame, terms: DataFrame, objects: DataFrame, order: str = "seq") -> DataFrame:
    """Objects with an open-access image, their terms and places. ``terms`` carries an arrival column."""
    opened = images.filter("openaccess = '1'").withColumnRenamed("depictstmsobjectid", "objectid")
    best = primary_image(opened.select("objectid", "viewtype", "sequence", "iiifurl", "width", "height"), "objectid")
    needed = terms.join(best.select("objectid"), "objectid", "left_semi")
    places = terms_by_object(needed, "objectid", ["Place Executed"], order).withColumnRenamed("terms", "places")
    words = terms_by_object(
        needed, "objectid", ["Keyword", "Style", "School", "Theme"], order, ["Keywords", "Themes"]
    ).withColumnRenamed("terms", "keywords")
    wide = objects.join(best, "objectid").join(places, "objectid", "left").join(words, "objectid", "left")
    return NGA.apply(wide)


# Cleveland Museum of Art -----------------------------------------------------


def _cma_columns(limits: Limits) -> dict[str, Column]:
    web, print_, full = (nonblank(raw(f"images.{k}.url")) for k in ("web", "print", "full"))
    creators = F.transform(raw("creators"), lambda c: first_nonblank(c["description"], c["name"]))
    listed = F.array_compact(
        F.array(
            F.when(print_.isNotNull(), file_struct("jpg", print_, "Print (~3400px)")),
            F.when(full.isNotNull(), file_struct("tif", full, "Full resolution TIFF")),
        )
    )
    return {
        "source_url": first_nonblank(raw("url"), F.concat(F.lit("https://clevelandart.org/art/"), raw("accession_number"))),
        "title": or_untitled(clean(raw("title"))),
        "creator": join_unique(present(creators)),
        "date_display": clean(raw("creation_date")),
        **year_columns(years(raw("creation_date_earliest"), raw("creation_date_latest"), raw("creation_date"))),
        "object_type": clean(raw("type")),
        "medium": clean(raw("technique")),
        "culture": join_unique(raw("culture")),
        **rights_columns(R.CC0),
        "thumb_url": web,
        "image_url": F.coalesce(print_, web),
        "original_url": F.coalesce(full, print_, web),
        "width": F.nullif(to_int(raw("images.web.width")), F.lit(0).cast("bigint")),
        "height": F.nullif(to_int(raw("images.web.height")), F.lit(0).cast("bigint")),
        "files": F.when(F.size(listed) > 0, listed).otherwise(one_file("jpg", web, "Web")),
        "text": join_parts(
            raw("department"), raw("collection"), raw("tombstone"), clean(raw("description"), limits.length("description")),
            F.array_join(strings("artists_tags"), " "),
        ),
    }


CMA = SourceMapping(
    key="cma",
    schema="""id bigint, title string, share_license_status string, accession_number string, url string,
      images struct<web:struct<url:string,width:string,height:string>,print:struct<url:string>,full:struct<url:string>>,
      creators array<struct<description:string,name:string>>, culture array<string>, creation_date string,
      creation_date_earliest bigint, creation_date_latest bigint, technique string, type string, department string,
      collection string, tombstone string, description string, artists_tags array<string>""",
    source_id=lambda: raw("id"),
    keep=lambda: nonblank(raw("images.web.url")).isNotNull() & (raw("share_license_status") == "CC0"),
    columns=_cma_columns,
)


# Art Institute of Chicago ----------------------------------------------------


def _aic_columns(_limits: Limits) -> dict[str, Column]:
    def sized(width: int) -> Column:
        return F.concat(F.lit("https://www.artic.edu/iiif/2/"), raw("image_id"), F.lit(f"/full/{width},/0/default.jpg"))

    kinds = F.array_distinct(present(F.array(raw("artwork_type_title"), raw("classification_title"))))
    return {
        "source_url": F.concat(F.lit("https://www.artic.edu/artworks/"), raw("id").cast("string")),
        "title": or_untitled(clean(raw("title"))),
        "creator": clean(first(F.split(raw("artist_display"), "\n"))),
        "date_display": clean(raw("date_display")),
        **year_columns(years(raw("date_start"), raw("date_end"), raw("date_display"))),
        "object_type": clean(F.array_join(kinds, " / ")),
        "medium": clean(raw("medium_display")),
        "place": clean(raw("place_of_origin")),
        **rights_columns(R.CC0),
        "thumb_url": sized(600),
        "image_url": sized(1686),
        "original_url": sized(3000),
        "width": F.nullif(raw("thumbnail.width"), F.lit(0).cast("bigint")),
        "height": F.nullif(raw("thumbnail.height"), F.lit(0).cast("bigint")),
        "files": one_file("jpg", sized(3000), "Largest (3000px)"),
        "text": join_parts(
            raw("department_title"), F.array_join(strings("term_titles"), " "), F.array_join(strings("category_titles"), " ")
        ),
        "boost": F.when(raw("is_boosted"), 2).when(~raw("has_not_been_viewed_much"), 1).otherwise(0),
    }


AIC = SourceMapping(
    key="aic",
    schema="""id bigint, title string, artist_display string, date_display string, date_start bigint, date_end bigint,
      artwork_type_title string, classification_title string, medium_display string, place_of_origin string,
      is_public_domain boolean, image_id string, thumbnail struct<width:bigint,height:bigint>, department_title string,
      term_titles array<string>, category_titles array<string>, is_boosted boolean, has_not_been_viewed_much boolean""",
    source_id=lambda: raw("id"),
    keep=lambda: nonblank(raw("image_id")).isNotNull() & raw("is_public_domain"),
    columns=_aic_columns,
)


# Smithsonian -----------------------------------------------------------------

SI_TEXT = "array<struct<label:string,content:string>>"
SI_SCHEMA = f"""type string, title string, unit_name string, content struct<
  descriptiveNonRepeating:struct<title:struct<content:string>,metadata_usage:struct<access:string>,record_ID:string,
    record_link:string,guid:string,data_source:string,online_media:struct<media:array<struct<type:string,idsId:string,
      thumbnail:string,usage:struct<access:string>,resources:array<struct<label:string,url:string,filename:string,
        category:string,title:string,width:bigint,height:bigint,attributes:array<map<string,string>>>>>>>>,
  freetext:struct<date:{SI_TEXT},name:{SI_TEXT},notes:{SI_TEXT},place:{SI_TEXT},objectType:{SI_TEXT},
    physicalDescription:{SI_TEXT}>,
  indexedStructured:struct<date:array<string>,culture:array<string>,topic:array<string>,name:array<string>,
    object_type:array<string>,geoLocation:array<map<string,struct<content:string>>>>>"""


def model_format(declared: Column, filename: Column) -> Column:
    """Model format: declared type, then file name hints, then the extension, else zip."""
    name = F.lower(filename)
    hinted = (
        F.when(name.contains("-obj") | name.endswith(".obj"), "obj")
        .when(name.contains("-gltf") | name.endswith(".gltf"), "gltf")
        .when(name.endswith(".glb"), "glb")
        .when(name.endswith(".usdz"), "usdz")
        .when(name.contains("print_ready") | name.contains("-stl") | name.endswith(".stl"), "stl")
    )
    stated = F.replace(F.lower(declared), F.lit("draco compressed "), F.lit(""))
    return F.coalesce(nonblank(stated), hinted, ext_of(filename), F.lit("zip"))


def _si_texts(kind: str, labels: list[str] | None = None) -> Column:
    entries = raw(f"content.freetext.{kind}")
    if labels:
        entries = F.filter(entries, lambda x: F.lower(F.coalesce(x["label"], F.lit(""))).rlike("|".join(labels)))
    return present(F.coalesce(F.transform(entries, lambda x: x["content"]), F.array().cast("array<string>")))


def _attribute(resource: Column, name: str) -> Column:
    """Value from a list of small maps, the last one that has it."""
    return F.try_element_at(F.array_compact(F.transform(resource["attributes"], lambda m: F.try_element_at(m, F.lit(name)))), F.lit(-1))


def _model_file(r: Column) -> Column:
    name = first_nonblank(r["filename"], F.substring_index(r["url"], "/", -1))
    return file_struct(
        model_format(_attribute(r, "MODEL_FILE_TYPE"), name), r["url"], join_parts(r["category"], r["title"], sep=" · "),
        name, F.nullif(to_int(_attribute(r, "FILE_SIZE")), F.lit(0).cast("bigint")),
    )


def _si_prepare(_limits: Limits) -> dict[str, Column]:
    media = raw("content.descriptiveNonRepeating.online_media.media")
    open_image = F.filter(
        media,
        lambda m: (m["type"] == "Images") & nonblank(m["idsId"]).isNotNull() & (m["usage"].isNull() | (m["usage"]["access"] == "CC0")),
    )
    model = first(F.filter(media, lambda m: m["type"] == "3d_voyager"))
    usable = F.filter(model["resources"], lambda r: nonblank(r["url"]).isNotNull())
    dates = _si_texts("date")
    stated = parse_years(first(dates))
    indexed = year_span(F.transform(raw("content.indexedStructured.date"), parse_years))
    image = first(open_image)

    def resource(pattern: str) -> Column:
        return first(F.filter(image["resources"], lambda r: r["label"].rlike(f"(?i){pattern}")))

    return {
        "image": image,
        "model": model,
        "model_files": F.coalesce(F.transform(usable, _model_file), no_files()),
        "date": first(dates),
        "years": F.coalesce(stated, indexed),
        "base": F.concat(F.lit("https://ids.si.edu/ids/deliveryService?id="), encode_component(image["idsId"])),
        "hi": F.coalesce(resource("high-resolution jpeg"), resource("high-resolution")),
        "screen": resource("screen"),
        "types": _si_texts("objectType"),
        "places": _si_texts("place"),
    }


def _si_columns(limits: Limits) -> dict[str, Column]:
    d = "content.descriptiveNonRepeating"
    ix = "content.indexedStructured"
    image, model = prepared("image"), prepared("model")
    is_model = model.isNotNull()
    base, hi, screen = prepared("base"), prepared("hi"), prepared("screen")
    best = F.when(
        nonblank(hi["url"]).isNotNull(), F.array(file_struct(F.coalesce(ext_of(hi["url"]), F.lit("jpg")), hi["url"], hi["label"]))
    ).otherwise(no_files())
    thumb = first_nonblank(model["thumbnail"], image["thumbnail"])
    geo = F.flatten(F.transform(raw(f"{ix}.geoLocation"), lambda g: F.transform(F.map_values(g), lambda v: v["content"])))
    types, places = prepared("types"), prepared("places")
    notes = F.array_join(F.transform(limits.first(_si_texts("notes"), "notes"), lambda s: clean(s, limits.length("note"))), " | ")
    text = join_parts(
        raw("unit_name"), raw(f"{d}.data_source"), F.array_join(strings(f"{ix}.topic"), " "),
        F.array_join(strings(f"{ix}.name"), " "), notes,
    )
    none = F.lit(None)

    def sized(n: int) -> Column:
        return F.concat(base, F.lit(f"&max={n}"))

    return {
        "source_url": first_nonblank(
            raw(f"{d}.record_link"), F.regexp_replace(raw(f"{d}.guid"), "^http:", "https:"),
            F.concat(F.lit("https://collections.si.edu/search/detail/"), raw(f"{d}.record_ID")),
        ),
        "title": clean(first_nonblank(raw(f"{d}.title.content"), raw("title"))),
        "creator": join_unique(limits.first(_si_texts("name"), "creator")),
        "date_display": clean(prepared("date")),
        **year_columns(prepared("years")),
        "object_type": join_unique(F.when(F.size(types) > 0, types).otherwise(raw(f"{ix}.object_type"))),
        "medium": join_unique(_si_texts("physicalDescription", ["medium", "material", "technique"])),
        "culture": join_unique(limits.first(strings(f"{ix}.culture"), "culture")),
        "place": join_unique(F.when(F.size(places) > 0, places).otherwise(present(geo))),
        **rights_columns(R.CC0),
        "thumb_url": F.when(is_model, thumb).otherwise(sized(600)),
        "image_url": F.when(is_model, F.replace(thumb, F.lit("scene-image-thumb"), F.lit("scene-image-medium"))).otherwise(sized(1600)),
        "original_url": F.when(is_model, none).otherwise(base),
        "width": F.when(~is_model, F.coalesce(screen["width"], hi["width"])),
        "height": F.when(~is_model, F.coalesce(screen["height"], hi["height"])),
        "content_type": F.when(is_model, F.lit("3d")).otherwise(F.lit("image")),
        "files": F.when(is_model, prepared("model_files")).otherwise(F.concat(one_file("jpg", base, "Full size JPEG"), best)),
        "text": F.when(is_model, F.concat(text, F.lit(" | 3D model"))).otherwise(text),
        "boost": F.when(is_model, 1).otherwise(0),
    }


SI = SourceMapping(
    key="si",
    schema=SI_SCHEMA,
    source_id=lambda: raw("content.descriptiveNonRepeating.record_ID"),
    keep=lambda: (raw("type") == "edanmdm")
    & (raw("content.descriptiveNonRepeating.metadata_usage.access") == "CC0")
    & (F.when(prepared("model").isNotNull(), F.size(prepared("model_files")) > 0).otherwise(prepared("image").isNotNull())),
    columns=_si_columns,
    prepare=_si_prepare,
)


# Rijksmuseum: OAI-PMH Dublin Core records ------------------------------------

OAI_DC = ["identifier", "title", "creator", "date", "type", "format", "description", "coverage", "subject", "rights", "relation"]
OAI_RECORD = "header struct<identifier:string,datestamp:string>, metadata struct<`oai_dc:dc`:struct<{}>>".format(
    ",".join(f"`dc:{c}`:array<string>" for c in OAI_DC)
)


def dc_record(records: DataFrame) -> DataFrame:
    """Flatten OAI records to one array column per Dublin Core element."""
    fields = [F.col(f"metadata.`oai_dc:dc`.`dc:{c}`").alias(c) for c in OAI_DC]
    return records.select(F.col("header.identifier").alias("oai_id"), F.col("header.datestamp").alias("datestamp"), *fields)


def _rijks_prepare(_limits: Limits) -> dict[str, Column]:
    iiif = first(F.filter(raw("relation"), lambda u: u.contains("iiif.micr.io")))
    numbered = first(F.filter(raw("identifier"), lambda s: s.rlike("^[A-Z]{1,4}-")))
    formats = F.transform(raw("format"), lambda f: F.regexp_replace(f, r"\s*\((materiaal|techniek)\)\s*", ""))
    return {
        "rights": first(raw("rights")),
        "micrio": nonblank(F.regexp_extract(iiif, r"iiif\.micr\.io/([^/]+)/", 1)),
        "number": first_nonblank(numbered, first(raw("identifier"))),
        "oai": nonblank(F.regexp_extract(raw("oai_id"), r"^https://id\.rijksmuseum\.nl/(\d+)$", 1)),
        "formats": formats,
    }


def _rijks_columns(limits: Limits, dictionary: Mapping[str, str]) -> dict[str, Column]:
    def sized(size: str) -> Column:
        return F.concat(F.lit("https://iiif.micr.io/"), prepared("micrio"), F.lit(f"/full/{size}/0/default.jpg"))

    named = F.filter(raw("creator"), lambda c: ~c.rlike("(?i)^anoniem$"))
    zero = prepared("rights").rlike("(?i)zero")
    desc = first(raw("description"))
    spoken = F.concat(
        F.array(first(raw("title"))), strings("type"), F.coalesce(prepared("formats"), F.array().cast("array<string>")), F.array(desc), strings("subject")
    )
    return {
        "source_url": F.concat(
            F.lit("https://www.rijksmuseum.nl/en/collection/"), encode_component(F.coalesce(prepared("number"), F.lit("")))
        ),
        "title": clean(first(raw("title"))),
        "creator": join_unique(limits.first(named, "creator")),
        "date_display": clean(first(raw("date"))),
        **year_columns(parse_years(first(raw("date")))),
        "object_type": join_unique(limits.first(F.transform(raw("type"), lambda t: english_type(t, dictionary)), "object_type")),
        "medium": join_unique(limits.first(prepared("formats"), "medium")),
        "place": join_unique(limits.first(raw("coverage"), "place")),
        **rights_columns(F.when(zero, R.CC0.struct()).otherwise(R.PD.struct())),
        "thumb_url": sized("500,"),
        "image_url": sized("1600,"),
        "original_url": sized("max"),
        "text": join_parts(
            english_terms(F.array_join(spoken, " "), dictionary, keep_apostrophes=True), F.array_join(strings("subject"), " "), clean(desc, limits.length("description"))
        ),
    }


def rijks_mapping(dictionary: Mapping[str, str] | None = None) -> SourceMapping:
    """``dictionary`` maps Dutch words to English search terms; the caller lands it (``read_dictionary``)."""
    return SourceMapping(
        key="rijks",
        schema=OAI_RECORD,
        source_id=lambda: F.coalesce(prepared("number"), prepared("oai")),
        keep=lambda: prepared("oai").isNotNull()
        & prepared("rights").rlike("(?i)publicdomain/mark|publicdomain/zero")
        & prepared("micrio").isNotNull(),
        columns=lambda limits: _rijks_columns(limits, dictionary or {}),
        prepare=_rijks_prepare,
    )


def rijks_items(
    records: DataFrame,
    dictionary: Mapping[str, str] | None = None,
    limits: Mapping[str, Mapping[str, int]] | None = None,
) -> DataFrame:
    return rijks_mapping(dictionary).apply(dc_record(records), limits=limits)


# Harvard Art Museums ---------------------------------------------------------

MAKER = "(?i)artist|painter|maker|designer|sculptor|printmaker|photographer"


def _harvard_prepare(_limits: Limits) -> dict[str, Column]:
    shown = F.filter(raw("images"), lambda i: nonblank(i["baseimageurl"]).isNotNull())
    placed = F.transform(
        shown,
        lambda i, n: F.struct(F.coalesce(F.nullif(i["displayorder"], F.lit(0).cast("bigint")), F.lit(9).cast("bigint")).alias("o"), n.alias("n"), i.alias("i")),
    )
    # smallest display order, then the earlier image
    return {"image": F.array_min(placed)["i"]}


def _harvard_columns(limits: Limits) -> dict[str, Column]:
    base = prepared("image")["baseimageurl"]
    makers = F.filter(raw("people"), lambda p: F.coalesce(p["role"], F.lit("")).rlike(MAKER))
    names = present(F.transform(makers, lambda p: first_nonblank(p["name"], p["displayname"])))
    places = present(F.transform(raw("places"), lambda p: p["displayname"]))
    kinds = present(F.transform(raw("worktypes"), lambda w: w["worktype"]))
    dated = first_nonblank(raw("dated"), raw("century"))
    return {
        "source_url": first_nonblank(
            raw("url"), F.concat(F.lit("https://www.harvardartmuseums.org/collections/object/"), raw("objectid").cast("string"))
        ),
        "title": clean(raw("title")),
        "creator": join_unique(limits.first(names, "creator")),
        "date_display": clean(dated, limits.length("date")),
        **year_columns(years(raw("datebegin"), raw("dateend"), dated)),
        "object_type": join_unique(F.concat(F.array(raw("classification")), F.coalesce(limits.first(kinds, "kinds"), F.array().cast("array<string>")))),
        "medium": clean(first_nonblank(raw("medium"), raw("technique")), limits.length("medium")),
        "culture": clean(raw("culture")),
        "place": join_unique(limits.first(places, "place")),
        "public_domain": F.lit(None),
        "rights_label": F.lit("Harvard Art Museums — verify rights before reuse"),
        "license_url": F.lit("https://harvardartmuseums.org/collections/api"),
        "thumb_url": F.concat(base, F.lit("?width=600")),
        "image_url": F.concat(base, F.lit("?width=1600")),
        "original_url": base,
        "width": prepared("image")["width"],
        "height": prepared("image")["height"],
        "files": one_file(F.coalesce(ext_of(base), F.lit("jpg")), base, "Full size"),
        "text": join_parts(raw("division"), raw("department"), raw("century")),
    }


HARVARD = SourceMapping(
    key="harvard",
    schema="""objectid bigint, title string, people array<struct<role:string,name:string,displayname:string>>, dated string,
      datebegin bigint, dateend bigint, classification string, culture string, medium string, technique string, century string,
      division string, department string, url string,
      images array<struct<baseimageurl:string,displayorder:bigint,width:bigint,height:bigint>>, imagepermissionlevel bigint,
      worktypes array<struct<worktype:string>>, places array<struct<displayname:string>>""",
    source_id=lambda: raw("objectid"),
    keep=lambda: (raw("imagepermissionlevel") == 0) & prepared("image").isNotNull(),
    columns=_harvard_columns,
    prepare=_harvard_prepare,
)


# SMK -------------------------------------------------------------------------

# Danish terms with their English search words.
DANISH = {
    "maleri": "painting", "malerier": "paintings", "tegning": "drawing", "tegninger": "drawings", "grafik": "print graphic art",
    "træsnit": "woodcut", "clairobscurtræsnit": "chiaroscuro woodcut", "radering": "etching", "kobberstik": "engraving",
    "litografi": "lithograph", "akvarel": "watercolor", "gouache": "gouache", "pastel": "pastel", "skulptur": "sculpture",
    "buste": "bust", "relief": "relief", "gips": "plaster", "bronze": "bronze", "marmor": "marble", "portræt": "portrait",
    "selvportræt": "self-portrait", "landskab": "landscape", "søstykke": "seascape marine", "stilleben": "still life",
    "interiør": "interior", "kvinde": "woman", "kvinder": "women", "mand": "man", "mænd": "men", "barn": "child",
    "børn": "children", "pige": "girl", "dreng": "boy", "blomst": "flower", "blomster": "flowers", "frugt": "fruit",
    "træ": "tree wood", "træer": "trees", "hest": "horse", "heste": "horses", "hund": "dog", "kat": "cat", "fugl": "bird",
    "fugle": "birds", "fisk": "fish", "ko": "cow", "køer": "cows", "får": "sheep", "skib": "ship", "skibe": "ships",
    "båd": "boat", "hav": "sea", "strand": "beach", "skov": "forest", "bjerg": "mountain", "flod": "river",
    "kirke": "church", "slot": "castle", "hus": "house", "gade": "street", "by": "city town", "bro": "bridge",
    "krig": "war", "slag": "battle", "soldat": "soldier", "konge": "king", "dronning": "queen", "engel": "angel",
    "kristus": "christ", "madonna": "madonna", "nøgen": "nude", "model": "model", "dans": "dance", "musik": "music",
    "vinter": "winter", "sommer": "summer", "sne": "snow", "nat": "night", "måne": "moon", "sol": "sun", "papir": "paper",
    "lærred": "canvas", "olie": "oil", "pen": "pen", "blyant": "pencil", "kridt": "chalk", "kul": "charcoal", "tusch": "ink",
}


def _smk_prepare(_limits: Limits) -> dict[str, Column]:
    thumb = F.coalesce(raw("image_thumbnail"), F.lit(""))
    return {
        "iiif": nonblank(F.regexp_extract(thumb, r"^(https://iip-thumb\.smk\.dk/iiif/jp2/[^/]+)/full/", 1)),
        "plain": thumb.startswith("https://api.smk.dk/api/v1/thumbnail/"),
        "dated": first(raw("production_date")),
    }


def _smk_columns(limits: Limits, dictionary: Mapping[str, str]) -> dict[str, Column]:
    def sized(size: str) -> Column:
        return F.concat(prepared("iiif"), F.lit(f"/full/{size}/0/default.jpg"))

    thumb, native = raw("image_thumbnail"), nonblank(raw("image_native"))
    dated = prepared("dated")
    makers = F.filter(present(F.transform(raw("production"), lambda p: p["creator"])), lambda c: ~c.rlike("(?i)^ubekendt"))
    zero = F.coalesce(raw("rights"), F.lit("")).rlike("(?i)zero")
    types = present(F.coalesce(F.transform(raw("object_names"), lambda o: o["name"]), F.array().cast("array<string>")))
    spoken = F.concat(F.array(first(raw("titles"))["title"]), types, strings("techniques"))
    native_file = F.when(native.isNotNull(), one_file("jpg", native, "Full resolution (SMK download)")).otherwise(no_files())
    return {
        "source_url": F.concat(F.lit("https://open.smk.dk/en/artwork/image/"), encode_component(raw("object_number"))),
        "title": clean(first(raw("titles"))["title"]),
        "creator": join_unique(limits.first(makers, "creator")),
        "date_display": clean(dated["period"]),
        **year_columns(years(F.substring(dated["start"], 1, 4), F.substring(dated["end"], 1, 4), dated["period"])),
        "object_type": join_unique(limits.first(F.transform(types, lambda t: english_type(t, dictionary)), "object_type")),
        "medium": join_unique(limits.first(F.concat(strings("techniques"), strings("materials")), "medium")),
        **rights_columns(F.when(zero, R.CC0.struct()).otherwise(R.PD.struct())),
        "thumb_url": F.coalesce(sized("!600,600"), thumb),
        "image_url": F.coalesce(sized("!1600,1600"), thumb),
        "original_url": F.coalesce(sized("max"), native, thumb),
        "width": F.nullif(raw("image_width"), F.lit(0).cast("bigint")),
        "height": F.nullif(raw("image_height"), F.lit(0).cast("bigint")),
        "files": native_file,
        "text": join_parts(english_terms(F.array_join(spoken, " "), dictionary), F.lit("Denmark Danish")),
    }


def smk_mapping(dictionary: Mapping[str, str] = DANISH) -> SourceMapping:
    return SourceMapping(
        key="smk",
        schema=SMK_SCHEMA,
        source_id=lambda: raw("object_number"),
        keep=lambda: nonblank(raw("object_number")).isNotNull()
        & raw("public_domain")
        & (prepared("iiif").isNotNull() | prepared("plain")),
        columns=lambda limits: _smk_columns(limits, dictionary),
        prepare=_smk_prepare,
    )


SMK_SCHEMA = """object_number string, public_domain boolean, image_thumbnail string, image_native string, image_width bigint,
  image_height bigint, titles array<struct<title:string>>, production_date array<struct<start:string,end:string,period:string>>,
  production array<struct<creator:string>>, object_names array<struct<name:string>>, techniques array<string>,
  materials array<string>, rights string"""
SMK = smk_mapping()
RIJKS = rijks_mapping()
