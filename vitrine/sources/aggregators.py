"""Mappings of aggregators, photo services, libraries, 3D repositories and patents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions import rights as R
from vitrine.functions.text import (
    clean, ext_of, first_nonblank, join_parts, join_unique, let, nonblank, rewrite_page_title, to_int, trim_to,
)
from vitrine.functions.urls import decode_component, encode_component
from vitrine.functions.years import parse_years
from vitrine.schema import file_struct, no_files
from vitrine.sources.mapping import (
    Limits, SourceMapping, first, prepared, present, raw, rights_columns, strings, year_columns,
)

EMPTY = "array<string>"


# Europeana -------------------------------------------------------------------

NO_TITLE = r"(?i)^\[?(untitled|unknown|zonder titel|ohne titel)\]?$"
# Data providers already indexed from their own source.
EXCLUDED_PROVIDERS = ["Rijksmuseum", "National Gallery of Denmark", "Wellcome Collection", "Statens Museum for Kunst"]


def _europeana_prepare(limits: Limits) -> dict[str, Column]:
    named = F.coalesce(first_nonblank(first(raw("dcTitleLangAware.en")), first(raw("dcTitleLangAware.eng"))), first(raw("title")))
    numbers = F.transform(raw("year"), lambda y: y.try_cast("double"))
    usable = F.filter(numbers, lambda y: (y > 0) & (y <= 2100))
    return {
        "title": clean(named, limits.length("title")),
        "shown": first(raw("edmIsShownBy")),
        "rights": R.rights_from_url(F.coalesce(first(raw("rights")), F.lit(""))),
        "number": nonblank(F.regexp_replace(raw("id"), "^/", "")),
        "start": F.array_min(usable).cast("int"),
        "end": F.array_max(usable).cast("int"),
        "provider": clean(first(raw("dataProvider")), limits.length("provider")),
    }


def _europeana_columns(limits: Limits) -> dict[str, Column]:
    start, end, shown = prepared("start"), prepared("end"), prepared("shown")
    credit = F.coalesce(F.concat(F.lit(" · "), prepared("provider")), F.lit(""))
    described = first_nonblank(first(raw("dcDescriptionLangAware.en")), first(raw("dcDescription")))
    span = F.concat_ws("–", start.cast("string"), F.nullif(end.cast("string"), start.cast("string")))
    return {
        "source_url": F.concat(F.lit("https://www.europeana.eu/en/item/"), prepared("number")),
        "title": prepared("title"),
        "creator": join_unique(limits.first(strings("dcCreator"), "creator"), "; ", limits.length("creators")),
        "date_display": nonblank(span),
        "year_start": start,
        "year_end": end,
        "place": join_unique(limits.first(strings("country"), "place")),
        "public_domain": prepared("rights.public_domain"),
        "rights_label": F.concat(prepared("rights.rights_label"), credit),
        "license_url": first_nonblank(first(raw("rights")), prepared("rights.license_url")),
        "thumb_url": F.concat(
            F.lit("https://api.europeana.eu/thumbnail/v2/url.json?uri="), encode_component(shown), F.lit("&type=IMAGE&size=w400")
        ),
        "image_url": shown,
        "original_url": shown,
        "text": join_parts(raw("theme"), prepared("provider"), clean(described, limits.length("description"))),
    }


EUROPEANA = SourceMapping(
    key="europeana",
    schema="""id string, theme string, rights array<string>, edmIsShownBy array<string>, title array<string>,
      dcTitleLangAware struct<en:array<string>,eng:array<string>>, dcCreator array<string>, year array<string>,
      dataProvider array<string>, country array<string>, dcDescriptionLangAware struct<en:array<string>>,
      dcDescription array<string>""",
    source_id=lambda: prepared("number"),
    keep=lambda: prepared("rights").isNotNull()
    & prepared("shown").rlike("^https?://")
    & prepared("title").isNotNull()
    & ~prepared("title").rlike(NO_TITLE)
    & prepared("number").isNotNull(),
    columns=_europeana_columns,
    prepare=_europeana_prepare,
)


# Flickr ----------------------------------------------------------------------

# The account of scanned book pages, skipped accounts, accounts with a type of their own.
BOOK_ACCOUNT = "126377022@N07"
SKIPPED_ACCOUNTS = ["25053835@N03"]
ACCOUNT_TYPES = {"61021753@N02": "Book illustration"}


def _flickr_prepare(limits: Limits) -> dict[str, Column]:
    dated = F.when(~raw("datetaken").startswith("0"), parse_years(F.substring(raw("datetaken"), 1, 4)))
    return {
        "title": clean(raw("title"), limits.length("title")),
        "book": F.coalesce(raw("account") == BOOK_ACCOUNT, F.lit(False)),
        "rights": R.rights_from_photo_license(raw("license")),
        "years": F.coalesce(parse_years(raw("title")), dated),
    }


def _flickr_columns(limits: Limits) -> dict[str, Column]:
    book, title = prepared("book"), prepared("title")
    medium, large, original = raw("url_m"), nonblank(raw("url_l")), nonblank(raw("url_o"))
    own = None
    for account, kind in ACCOUNT_TYPES.items():
        own = F.when(raw("account") == account, kind) if own is None else own.when(raw("account") == account, kind)
    return {
        "source_url": F.concat(
            F.lit("https://www.flickr.com/photos/"), F.coalesce(raw("owner"), F.lit("")), F.lit("/"), raw("id")
        ),
        "title": F.when(book, rewrite_page_title(title)).otherwise(title),
        "creator": clean(first_nonblank(raw("account_name"), raw("ownername")), limits.length("creator")),
        "date_display": prepared("years.start").cast("string"),
        **year_columns(prepared("years")),
        "object_type": F.coalesce(own, F.when(book, "Book illustration").otherwise("Photograph")),
        **rights_columns(prepared("rights")),
        "thumb_url": medium,
        "image_url": F.coalesce(large, medium),
        "original_url": F.coalesce(original, large, medium),
        "width": F.nullif(to_int(raw("width_m")), F.lit(0).cast("bigint")),
        "height": F.nullif(to_int(raw("height_m")), F.lit(0).cast("bigint")),
        "text": join_parts(
            F.when(book, "book illustration engraving plate").otherwise("photograph archive"), clean(raw("description._content"), limits.length("description"))
        ),
    }


FLICKR = SourceMapping(
    key="flickr",
    schema="""id string, owner string, ownername string, account string, account_name string, title string, license string,
      url_m string, url_l string, url_o string, width_m string, height_m string, datetaken string,
      description struct<_content:string>""",
    source_id=lambda: raw("id"),
    keep=lambda: prepared("rights").isNotNull()
    & nonblank(raw("url_m")).isNotNull()
    & ~F.coalesce(raw("account").isin(SKIPPED_ACCOUNTS), F.lit(False)),
    columns=_flickr_columns,
    prepare=_flickr_prepare,
)


# Wellcome Collection ---------------------------------------------------------


def _wellcome_prepare(_limits: Limits) -> dict[str, Column]:
    places = F.flatten(F.filter(F.transform(raw("items"), lambda i: i["locations"]), lambda x: x.isNotNull()))
    image = first(F.filter(places, lambda x: (x["locationType"]["id"] == "iiif-image") & nonblank(x["url"]).isNotNull()))
    return {
        "base": nonblank(F.regexp_extract(image["url"], r"^(.*)/info\.json$", 1)),
        # the license of that very location, even when a later one is open
        "rights": R.rights_from_license_id(image["license"]["id"]),
        "date": first(_produced(lambda p: p["dates"])),
    }


def _labels(values: Column) -> Column:
    return present(F.coalesce(F.transform(values, lambda v: v["label"]), F.array().cast(EMPTY)))


def _produced(inner) -> Column:
    return F.flatten(F.transform(raw("production"), lambda p: _labels(inner(p))))


def _wellcome_columns(limits: Limits) -> dict[str, Column]:
    thumbs = F.regexp_replace(prepared("base"), "^(.*?)/image/", "$1/thumbs/")

    people = present(F.transform(raw("contributors"), lambda c: c["agent"]["label"]))
    kind = F.when(nonblank(raw("workType.label")).isNotNull(), F.array(raw("workType.label"))).otherwise(F.array().cast(EMPTY))
    return {
        "source_url": F.concat(F.lit("https://wellcomecollection.org/works/"), raw("id")),
        "title": clean(raw("title")),
        "creator": join_unique(limits.first(people, "creator")),
        "date_display": clean(prepared("date"), limits.length("date")),
        **year_columns(parse_years(prepared("date"))),
        "object_type": join_unique(F.concat(limits.first(_labels(raw("genres")), "kinds"), kind)),
        "place": join_unique(limits.first(_produced(lambda p: p["places"]), "place")),
        **rights_columns(prepared("rights")),
        "thumb_url": F.concat(thumbs, F.lit("/full/!600,600/0/default.jpg")),
        "image_url": F.concat(thumbs, F.lit("/full/!1024,1024/0/default.jpg")),
        "original_url": F.concat(thumbs, F.lit("/full/!1024,1024/0/default.jpg")),
        "text": join_parts(
            F.array_join(limits.first(_labels(raw("subjects")), "subjects"), " "),
            clean(first_nonblank(raw("description"), raw("physicalDescription")), limits.length("description")),
        ),
    }


_LABEL = "array<struct<label:string>>"
WELLCOME = SourceMapping(
    key="wellcome",
    schema=f"""id string, type string, title string, description string, physicalDescription string,
      items array<struct<locations:array<struct<locationType:struct<id:string>,url:string,license:struct<id:string>>>>>,
      production array<struct<dates:{_LABEL},places:{_LABEL}>>, contributors array<struct<agent:struct<label:string>>>,
      subjects {_LABEL}, genres {_LABEL}, workType struct<label:string>""",
    source_id=lambda: raw("id"),
    keep=lambda: (raw("type") == "Work") & prepared("base").isNotNull() & prepared("rights").isNotNull(),
    columns=_wellcome_columns,
    prepare=_wellcome_prepare,
)


# NYPL ------------------------------------------------------------------------


def _nypl_columns(limits: Limits) -> dict[str, Column]:
    def sized(size: str) -> Column:
        return F.concat(F.lit("https://images.nypl.org/index.php?id="), raw("imageID"), F.lit(f"&t={size}"))

    title = clean(raw("title"), limits.length("title"))
    return {
        "source_url": first_nonblank(raw("itemLink"), F.concat(F.lit("https://digitalcollections.nypl.org/items/"), raw("uuid"))),
        "title": title,
        **year_columns(parse_years(title)),
        **rights_columns(R.PD),
        "rights_label": F.lit("Public domain (NYPL)"),
        "thumb_url": sized("r"),
        "image_url": sized("q"),
        "original_url": sized("g"),
        "text": F.lit("New York Public Library"),
    }


NYPL = SourceMapping(
    key="nypl",
    schema="uuid string, title string, imageID string, typeOfResource string, itemLink string",
    source_id=lambda: raw("uuid"),
    keep=lambda: (F.coalesce(nonblank(raw("typeOfResource")), F.lit("still image")) == "still image")
    & nonblank(raw("imageID")).isNotNull(),
    columns=_nypl_columns,
)


# NASA 3D ---------------------------------------------------------------------

# Model file extensions, and the formats shown first.
MODEL_EXTENSIONS = ["stl", "glb", "gltf", "obj", "fbx", "blend", "3ds", "lwo", "zip", "7z", "usdz", "dae", "ply"]
MODEL_ORDER = ["stl", "glb", "obj", "gltf"]
MODEL_URL = (
    r"""(?i)(https://assets\.science\.nasa\.gov/content/dam/[^"'\s<>]+?\.[a-z0-9]{2,5})(?:\?[^"'\s<>]*)?(?=["'\s<>])"""
)


def sort_files(files: Column) -> Column:
    """Files in the preferred format order, stable. A format outside the list comes first."""
    order = F.lit(MODEL_ORDER)
    ranked = F.transform(
        files, lambda f, i: F.struct((F.array_position(order, f["format"]) - 1).alias("o"), i.alias("i"), f.alias("f"))
    )
    return F.transform(F.array_sort(ranked), lambda x: x["f"])


def html_model_urls(html: Column) -> Column:
    """Distinct model URLs in a page, query string stripped, in page order."""
    found = F.regexp_extract_all(html, F.lit(MODEL_URL), F.lit(1))
    return F.filter(
        F.array_distinct(found), lambda u: ext_of(u).isin(MODEL_EXTENSIONS) & ~u.contains("/resources/image/")
    )


def _nasa_file(url: Column) -> Column:
    def build(name: Column) -> Column:
        ext = ext_of(url)
        hint = nonblank(F.lower(F.regexp_extract(name, r"(?i)\b(stl|obj|glb|gltf|fbx|3ds|blend)\b", 1)))
        kind = F.when(ext.isin("zip", "7z"), F.coalesce(hint, ext)).otherwise(ext)
        return file_struct(kind, url, name, name)

    last = F.substring_index(url, "/", -1)
    return let(F.coalesce(decode_component(last), last), build)


def _formats_label(files: Column) -> Column:
    return F.array_join(F.array_distinct(F.transform(files, lambda f: F.upper(f["format"]))), ", ")


def _nasa_prepare(_limits: Limits) -> dict[str, Column]:
    html = F.coalesce(raw("content.rendered"), F.lit(""))
    files = F.transform(html_model_urls(html), _nasa_file)
    return {"files": sort_files(files), "preview": nonblank(F.regexp_replace(raw("featured_image_url"), r"(?s)\?.*$", ""))}


def _nasa_columns(limits: Limits) -> dict[str, Column]:
    html = F.coalesce(raw("content.rendered"), F.lit(""))
    unstyled = F.regexp_replace(html, r"<style[\s\S]*?</style>", "")
    preview = prepared("preview")
    return {
        "source_url": raw("link"),
        "title": clean(raw("title.rendered")),
        "creator": F.lit("NASA"),
        "object_type": F.lit("3D model"),
        "medium": _formats_label(prepared("files")),
        **rights_columns(R.NASA),
        "thumb_url": F.concat(preview, F.lit("?w=600&fit=clip")),
        "image_url": F.concat(preview, F.lit("?w=1600&fit=clip")),
        "original_url": preview,
        "content_type": F.lit("3d"),
        "files": prepared("files"),
        "text": join_parts(F.lit("spacecraft space science 3D model"), clean(first_nonblank(raw("excerpt.rendered"), unstyled), limits.length("description"))),
        "boost": F.lit(1),
    }


NASA3D = SourceMapping(
    key="nasa3d",
    schema="""id bigint, link string, title struct<rendered:string>, excerpt struct<rendered:string>,
      content struct<rendered:string>, featured_image_url string""",
    source_id=lambda: raw("id"),
    keep=lambda: F.size(prepared("files")) > 0,
    columns=_nasa_columns,
    prepare=_nasa_prepare,
)


# NIH 3D ----------------------------------------------------------------------

# Model formats.
NIH_FORMATS = ["STL", "GLB", "OBJ", "X3D", "WRL", "PLY", "GLTF", "USDZ", "3MF"]


def _nih_prepare(_limits: Limits) -> dict[str, Column]:
    def outputs(sub: Column) -> Column:
        def of_run(run: Column) -> Column:
            usable = F.filter(run["outputFiles"], lambda f: nonblank(f["fileId"]).isNotNull() & nonblank(run["prefectRunId"]).isNotNull())
            return F.transform(
                usable,
                lambda f: F.struct(
                    F.upper(F.coalesce(f["fileFormat"], F.lit(""))).alias("fmt"),
                    F.concat(
                        F.lit("https://3d.nih.gov/api/submissions/"), sub["submissionId"], F.lit("/runs/"), run["prefectRunId"],
                        F.lit("/output-files/"), f["fileId"],
                    ).alias("url"),
                    f["name"].alias("name"),
                    F.nullif(f["fileSize"], F.lit(0).cast("bigint")).alias("size"),
                ),
            )

        runs = F.filter(F.transform(sub["workflowRuns"], of_run), lambda x: x.isNotNull())
        return F.coalesce(F.flatten(runs), F.array().cast("array<struct<fmt:string,url:string,name:string,size:bigint>>"))

    published = F.filter(raw("submissions"), lambda s: s["submissionStatus"] == "Published")
    # highest version first, then the earlier submission
    ranked = F.transform(
        F.array_sort(F.transform(published, lambda s, i: F.struct((-F.coalesce(s["version"], F.lit(0).cast("bigint"))).alias("v"), i.alias("i")))),
        lambda k: F.get(published, k["i"]),
    )
    described = F.transform(
        ranked,
        lambda s: F.struct(s.alias("s"), R.rights_from_license_name(s["metadata"]["license"]).alias("rights"), outputs(s).alias("out")),
    )
    chosen = F.filter(
        described, lambda d: d["rights"].isNotNull() & F.exists(d["out"], lambda f: f["fmt"].isin(NIH_FORMATS))
    )
    return {"chosen": first(chosen)}


def _nih_columns(limits: Limits) -> dict[str, Column]:
    sub, out = prepared("chosen.s"), prepared("chosen.out")
    models = F.transform(
        F.filter(out, lambda f: f["fmt"].isin(NIH_FORMATS)),
        lambda f: file_struct(F.lower(f["fmt"]), f["url"], f["name"], f["name"], f["size"]),
    )
    thumbs = F.filter(
        out, lambda f: ~f["fmt"].isin(NIH_FORMATS) & F.coalesce(f["name"], F.lit("")).rlike(r"(?i)thumb.*\.(jpg|jpeg|png)$")
    )
    thumb = first(thumbs)["url"]
    number = first_nonblank(raw("threedpxId"), raw("entryId"))
    words = limits.first(F.array_distinct(F.transform(strings("keywords"), lambda k: F.lower(F.trim(k)))), "keywords")
    published = nonblank(F.substring(sub["publishedDate"], 1, 10))
    year = F.substring(published, 1, 4).try_cast("int")
    return {
        "source_url": F.concat(F.lit("https://3d.nih.gov/entries/"), number),
        "title": F.coalesce(clean(sub["metadata"]["title"]), F.concat(F.lit("NIH 3D "), raw("threedpxId"))),
        "creator": clean(sub["modifiedByUser"]["displayName"]),
        "date_display": published,
        "year_start": year,
        "year_end": year,
        "object_type": F.coalesce(clean(raw("category")), F.lit("3D model")),
        "medium": _formats_label(models),
        **rights_columns(prepared("chosen.rights")),
        "thumb_url": thumb,
        "image_url": thumb,
        "content_type": F.lit("3d"),
        "files": limits.first(models, "files"),
        "text": join_parts(
            F.lit("science medicine anatomy 3D model"), raw("category"), F.array_join(words, " "), clean(sub["metadata"]["description"], limits.length("description"))
        ),
    }


NIH3D = SourceMapping(
    key="nih3d",
    schema="""entryId string, threedpxId string, category string, keywords array<string>,
      submissions array<struct<submissionId:string,submissionStatus:string,version:bigint,publishedDate:string,
        metadata:struct<license:string,title:string,description:string>,modifiedByUser:struct<displayName:string>,
        workflowRuns:array<struct<prefectRunId:string,outputFiles:array<struct<fileId:string,fileFormat:string,name:string,fileSize:bigint>>>>>>""",
    source_id=lambda: first_nonblank(raw("threedpxId"), raw("entryId")),
    keep=lambda: prepared("chosen").isNotNull(),
    columns=_nih_columns,
    prepare=_nih_prepare,
)


# Patents ---------------------------------------------------------------------

FIGURE_HOST = "https://patentimages.storage.googleapis.com/"


def patent_clean(c: Column, max_len: int | None = None) -> Column:
    """Like ``clean`` with the entities search results use; blank stays blank."""
    t = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"<[^>]+>", " ")
    for entity, char in (("&hellip;", "…"), ("&amp;", "&"), ("&#39;", "'"), ("&quot;", '"')):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.trim(F.regexp_replace(t, r"[\s\p{Z}\x{FEFF}]+", " "))
    return t if max_len is None else trim_to(t, max_len)


def _absolute(path: Column) -> Column:
    path = nonblank(path)
    return F.when(path.startswith("http"), path).otherwise(F.concat(F.lit(FIGURE_HOST), path))


def _patent_columns(limits: Limits) -> dict[str, Column]:
    number = raw("publication_number")
    figures = F.coalesce(raw("figures"), F.array().cast("array<struct<thumbnail:string,full:string>>"))
    sheets = F.transform(
        F.filter(figures, lambda f: first_nonblank(f["full"], f["thumbnail"]).isNotNull()),
        lambda f, i: file_struct(
            "png", _absolute(first_nonblank(f["full"], f["thumbnail"])), F.concat(F.lit("Figure sheet "), (i + 1).cast("string")),
            F.concat(number, F.lit("-fig"), (i + 1).cast("string"), F.lit(".png")),
        ),
    )
    pdf = nonblank(raw("pdf"))
    document = F.when(
        pdf.isNotNull(), F.array(file_struct("pdf", _absolute(pdf), "Full patent PDF", F.concat(number, F.lit(".pdf"))))
    ).otherwise(no_files())
    published = first_nonblank(raw("publication_date"), raw("grant_date"), raw("filing_date"))
    year = F.nullif(to_int(F.substring(published, 1, 4)), F.lit(0).cast("bigint"))
    us = number.startswith("US")
    return {
        "source_url": F.concat(F.lit("https://patents.google.com/patent/"), encode_component(number), F.lit("/en")),
        "title": first_nonblank(patent_clean(raw("title"), limits.length("title")), number),
        "creator": nonblank(join_parts(patent_clean(raw("inventor"), limits.length("person")), patent_clean(raw("assignee"), limits.length("person")), sep=" · ")),
        "date_display": nonblank(
            join_parts(
                F.concat(F.lit("priority "), nonblank(raw("priority_date"))), F.concat(F.lit("published "), published), sep=" · "
            )
        ),
        "year_start": year,
        "year_end": year,
        "object_type": F.when(number.startswith("USD"), "Design patent").otherwise("Patent"),
        "place": F.substring(number, 1, 2),
        "public_domain": F.when(us, F.lit(True)),
        "rights_label": F.when(us, "Public record (US patent document)").otherwise("Patent document, check jurisdiction"),
        "thumb_url": _patent_image(),
        "image_url": _patent_image(),
        "original_url": _patent_image(),
        "files": F.concat(sheets, document),
    }


def _patent_image() -> Column:
    head = first(raw("figures"))
    return F.coalesce(_absolute(head["full"]), _absolute(raw("thumbnail")), _absolute(head["thumbnail"]))


PATENT_SCHEMA = """publication_number string, title string, inventor string, assignee string, priority_date string,
  filing_date string, grant_date string, publication_date string, figures array<struct<thumbnail:string,full:string>>,
  pdf string, thumbnail string"""
PATENTS = SourceMapping(
    key="patents",
    schema=PATENT_SCHEMA,
    source_id=lambda: raw("publication_number"),
    keep=lambda: nonblank(raw("publication_number")).isNotNull() & _patent_image().isNotNull(),
    columns=_patent_columns,
)


def patent_items(records: DataFrame, limits: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    return PATENTS.apply(records, limits=limits)
