"""Image keys: store one short key per record instead of three long URLs, when nothing is lost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from vitrine.functions.rights import CC0, PD, Rights
from vitrine.functions.text import let, nonblank


def encode_component(c: Column) -> Column:
    """Percent-encoding of a URL component (form encoding differs in the characters restored here)."""
    t = F.url_encode(c)
    for form, plain in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        t = F.replace(t, F.lit(form), F.lit(plain))
    return t


def decode_component(c: Column) -> Column:
    """Percent-decoding; null when the escapes are malformed. A plus sign stays a plus sign."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


@dataclass(frozen=True)
class UrlRule:
    """How one source builds its image URLs. ``{k}`` stands for the key."""

    match: tuple[str, ...]  # URL roles the key is read from, first present wins
    pattern: str  # regular expression with the key as group 1
    thumb: str
    image: str
    original: str
    record: str | None = None  # ``{id}`` stands for the source id, ``{k}`` for the key
    record_without_key: str | None = None
    rights: Rights | None = None
    encoded: bool = False  # the key is percent-encoded inside the URLs


# URL forms and default rights per source.
URL_RULES: dict[str, UrlRule] = {
    "met": UrlRule(
        match=("original", "thumb"),
        pattern=r"^https://images\.metmuseum\.org/CRDImages/([^/]+/(?:original|web-large)/[^/?#]+)$",
        thumb="https://images.metmuseum.org/CRDImages/{dept}/web-large/{file}",
        image="https://images.metmuseum.org/CRDImages/{dept}/web-large/{file}",
        original="https://images.metmuseum.org/CRDImages/{dept}/original/{file}",
        record="https://www.metmuseum.org/art/collection/search/{id}",
        rights=CC0,
    ),
    "aic": UrlRule(
        match=("thumb",),
        pattern=r"^https://www\.artic\.edu/iiif/2/([^/]+)/full/",
        thumb="https://www.artic.edu/iiif/2/{k}/full/600,/0/default.jpg",
        image="https://www.artic.edu/iiif/2/{k}/full/1686,/0/default.jpg",
        original="https://www.artic.edu/iiif/2/{k}/full/3000,/0/default.jpg",
        record="https://www.artic.edu/artworks/{id}",
        rights=CC0,
    ),
    "cma": UrlRule(
        match=("thumb",),
        pattern=r"^https://openaccess-cdn\.clevelandart\.org/([^/]+)/\1_web\.jpg$",
        thumb="https://openaccess-cdn.clevelandart.org/{k}/{k}_web.jpg",
        image="https://openaccess-cdn.clevelandart.org/{k}/{k}_print.jpg",
        original="https://openaccess-cdn.clevelandart.org/{k}/{k}_full.tif",
        record="https://clevelandart.org/art/{k}",
        record_without_key="https://www.clevelandart.org/art/collection/search",
        rights=CC0,
    ),
    "nga": UrlRule(
        match=("thumb",),
        pattern=r"^https://api\.nga\.gov/iiif/([^/]+)/full/",
        thumb="https://api.nga.gov/iiif/{k}/full/!600,600/0/default.jpg",
        image="https://api.nga.gov/iiif/{k}/full/!1600,1600/0/default.jpg",
        original="https://api.nga.gov/iiif/{k}/full/max/0/default.jpg",
        record="https://www.nga.gov/collection/art-object-page.{id}.html",
        rights=CC0,
    ),
    "si": UrlRule(
        match=("original",),
        pattern=r"^https://ids\.si\.edu/ids/deliveryService\?id=([^&]+)$",
        thumb="https://ids.si.edu/ids/deliveryService?id={k}&max=600",
        image="https://ids.si.edu/ids/deliveryService?id={k}&max=1600",
        original="https://ids.si.edu/ids/deliveryService?id={k}",
        rights=CC0,
        encoded=True,
    ),
    "rijks": UrlRule(
        match=("thumb",),
        pattern=r"^https://iiif\.micr\.io/([^/]+)/full/",
        thumb="https://iiif.micr.io/{k}/full/500,/0/default.jpg",
        image="https://iiif.micr.io/{k}/full/1600,/0/default.jpg",
        original="https://iiif.micr.io/{k}/full/max/0/default.jpg",
        record="https://www.rijksmuseum.nl/en/collection/{id}",
        rights=PD,
    ),
    "harvard": UrlRule(
        match=("original",),
        pattern=r"^https://nrs\.harvard\.edu/urn-3:((?:HUAM|huam):[A-Za-z0-9_.-]+)$",
        thumb="https://nrs.harvard.edu/urn-3:{k}?width=600",
        image="https://nrs.harvard.edu/urn-3:{k}?width=1600",
        original="https://nrs.harvard.edu/urn-3:{k}",
    ),
    "smk": UrlRule(
        match=("thumb",),
        pattern=r"^https://iip-thumb\.smk\.dk/iiif/jp2/([^/]+)/full/",
        thumb="https://iip-thumb.smk.dk/iiif/jp2/{k}/full/!600,600/0/default.jpg",
        image="https://iip-thumb.smk.dk/iiif/jp2/{k}/full/!1600,1600/0/default.jpg",
        original="https://iip-thumb.smk.dk/iiif/jp2/{k}/full/max/0/default.jpg",
    ),
    "nypl": UrlRule(
        match=("thumb",),
        pattern=r"^https://images\.nypl\.org/index\.php\?id=([A-Za-z0-9_-]+)&t=r$",
        thumb="https://images.nypl.org/index.php?id={k}&t=r",
        image="https://images.nypl.org/index.php?id={k}&t=q",
        original="https://images.nypl.org/index.php?id={k}&t=g",
    ),
    "flickr": UrlRule(
        match=("thumb",),
        pattern=r"^https://live\.staticflickr\.com/(.+)\.jpg$",
        thumb="https://live.staticflickr.com/{k}.jpg",
        image="https://live.staticflickr.com/{k}_b.jpg",
        original="https://live.staticflickr.com/{k}_b.jpg",
    ),
    "europeana": UrlRule(
        match=("original", "image"),
        pattern=r'^(https?://[^"]*)$',
        thumb="https://api.europeana.eu/thumbnail/v2/url.json?uri={enc}&type=IMAGE&size=w400",
        image="{k}",
        original="{k}",
    ),
    "wellcome": UrlRule(
        match=("thumb",),
        pattern=r"^https://iiif\.wellcomecollection\.org/(?:image|thumbs)/([^/]+)/full/",
        thumb="https://iiif.wellcomecollection.org/thumbs/{k}/full/!600,600/0/default.jpg",
        image="https://iiif.wellcomecollection.org/thumbs/{k}/full/!1024,1024/0/default.jpg",
        original="https://iiif.wellcomecollection.org/thumbs/{k}/full/!1024,1024/0/default.jpg",
    ),
}
# A second URL form of the first source, marked by a key prefix.
COMMONS_PATTERN = r"^https://commons\.wikimedia\.org/wiki/Special:FilePath/([^?]+)$"
COMMONS_URL = "https://commons.wikimedia.org/wiki/Special:FilePath/"
COMMONS_PREFIX = "c:"

IMAGE_SET = "struct<thumb:string,image:string,original:string>"


def _fill(template: str, **values: Column) -> Column:
    """Concatenate the literal parts of ``template`` with the columns named in braces."""
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(values[name])
    return F.concat(*parts)


def commons_urls(filename: Column) -> Column:
    """Three renditions of a Commons file."""

    def build(enc: Column) -> Column:
        base = F.concat(F.lit(COMMONS_URL), enc)
        return _images(F.concat(base, F.lit("?width=600")), F.concat(base, F.lit("?width=1600")), base)

    return let(encode_component(filename), build)


def _images(thumb: Column, image: Column, original: Column) -> Column:
    return F.struct(thumb.alias("thumb"), image.alias("image"), original.alias("original"))


def _extract(source: str, rule: UrlRule, urls: dict[str, Column]) -> Column:
    text = F.coalesce(*[nonblank(urls[m]) for m in rule.match], F.lit(""))
    key = nonblank(F.regexp_extract(text, rule.pattern, 1))
    if rule.encoded:
        key = decode_component(key)
    if source == "met":
        # the key leaves out the rendition folder
        plain = F.regexp_replace(key, "/(?:original|web-large)/", "/")
        original = F.coalesce(urls["original"], F.lit(""))
        commons = nonblank(F.regexp_extract(original, COMMONS_PATTERN, 1))
        key = F.when(commons.isNotNull(), F.concat(F.lit(COMMONS_PREFIX), decode_component(commons))).otherwise(plain)
    return key


def _expand(source: str, rule: UrlRule, key: Column) -> Column:
    enc = encode_component(key)
    shown = enc if rule.encoded else key
    values = {
        "k": shown,
        "enc": enc,
        "dept": F.substring_index(key, "/", 1),
        "file": F.regexp_replace(key, "^[^/]*/", ""),
    }
    built = _images(*[_fill(t, **values) for t in (rule.thumb, rule.image, rule.original)])
    if source == "harvard":
        # older keys lack the collection prefix
        return let(
            F.when(key.contains(":"), key).otherwise(F.concat(F.lit("HUAM:"), key)),
            lambda k: _images(*[_fill(t, k=k) for t in (rule.thumb, rule.image, rule.original)]),
        )
    if source == "met":
        name = F.regexp_replace(key, f"^{COMMONS_PREFIX}", "")
        return F.when(key.startswith(COMMONS_PREFIX), commons_urls(name)).otherwise(built)
    return built


def _by_source(source: Column, cases: dict[str, Column]) -> Column:
    out = None
    for name, value in cases.items():
        out = F.when(source == name, value) if out is None else out.when(source == name, value)
    return out


def expand_images(source: Column, key: Column) -> Column:
    """struct<thumb,image,original> of a key; null for unknown sources or a null key."""
    built = _by_source(source, {s: _expand(s, r, key) for s, r in URL_RULES.items()})
    return F.when(key.isNotNull(), built)


def compact_images(source: Column, thumb: Column, image: Column, original: Column) -> Column:
    """Short key, only when expanding it gives back every URL that is present."""
    urls = {"thumb": thumb, "image": image, "original": original}
    found = _by_source(source, {s: _extract(s, r, urls) for s, r in URL_RULES.items()})

    def check(pair: Column) -> Column:
        ok = F.lit(True)
        for role, given in urls.items():
            ok = ok & (F.coalesce(given, F.lit("")).isin("") | given.eqNullSafe(pair["urls"][role]))
        return F.when(ok, pair["key"])

    def round_trip(key: Column) -> Column:
        return let(F.struct(key.alias("key"), expand_images(source, key).alias("urls")), check)

    return let(found, lambda key: F.when(key.isNotNull(), round_trip(key)))


def default_record_url(source: Column, source_id: Column, key: Column) -> Column:
    """Record page that follows from the source's URL form; null when the source has none."""
    cases = {}
    for name, rule in URL_RULES.items():
        if not rule.record:
            continue
        url = _fill(rule.record, id=source_id, k=key)
        if rule.record_without_key:
            url = F.coalesce(url, F.lit(rule.record_without_key))
        cases[name] = url
    return _by_source(source, cases)


def elide_record_url(source_url: Column, default: Column) -> Column:
    return F.when(~source_url.eqNullSafe(default), source_url)


def restore_record_url(source_url: Column, default: Column) -> Column:
    return F.coalesce(source_url, default, F.lit(""))
