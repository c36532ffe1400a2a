"""Source mappings keep whole values by default and cut them only by a preset."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vitrine.sources import aggregators as G, museums as M
from vitrine.sources.mapping import SITE_FIELDS

LONG = " ".join(f"word{i}" for i in range(400))
MANY = [f"v{i}" for i in range(30)]


def labels(values):
    return [{"label": v} for v in values]


RECORDS = {
    "europeana": (G.EUROPEANA, {
        "id": "/9/1", "rights": ["http://creativecommons.org/publicdomain/mark/1.0/"], "edmIsShownBy": ["https://i.example.org/a"], "title": [LONG],
        "dcCreator": MANY, "country": MANY, "dataProvider": [LONG], "dcDescription": [LONG]}),
    "flickr": (G.FLICKR, {"id": "1", "owner": "o", "account": "x", "account_name": LONG, "title": LONG, "license": "9", "url_m": "https://i.example.org/m", "description": {"_content": LONG}}),
    "wellcome": (G.WELLCOME, {
        "id": "w", "type": "Work", "title": "t", "description": LONG, "subjects": labels(MANY), "genres": labels(MANY), "contributors": [{"agent": {"label": v}} for v in MANY],
        "production": [{"dates": labels(["1900"]), "places": labels(MANY)}],
        "items": [{"locations": [{"locationType": {"id": "iiif-image"}, "url": "https://iiif.wellcomecollection.org/image/V/info.json", "license": {"id": "pdm"}}]}]}),
    "harvard": (M.HARVARD, {
        "objectid": 1, "title": "t", "people": [{"role": "Artist", "name": v} for v in MANY], "dated": LONG, "classification": "c", "medium": LONG, "images": [{"baseimageurl": "https://i.example.org/b", "displayorder": 1}],
        "imagepermissionlevel": 0, "worktypes": [{"worktype": v} for v in MANY], "places": [{"displayname": v} for v in MANY]}),
    "smk": (M.SMK, {
        "object_number": "K", "public_domain": True, "image_thumbnail": "https://api.smk.dk/api/v1/thumbnail/1", "titles": [{"title": "t"}], "production": [{"creator": v} for v in MANY],
        "object_names": [{"name": v} for v in MANY], "techniques": MANY, "materials": ["last"], "rights": "zero"}),
}
#: column -> what the whole value must hold at its end
ENDS = {
    "europeana": {"title": "word399", "creator": "v29", "place": "v29", "rights_label": "word399", "text": "word399"},
    "flickr": {"title": "word399", "creator": "word399", "text": "word399"},
    "wellcome": {"creator": "v29", "object_type": "v29", "place": "v29", "text": "word399"},
    "harvard": {"creator": "v29", "date_display": "word399", "medium": "word399", "object_type": "v29", "place": "v29"},
    "smk": {"creator": "v29", "object_type": "v29", "medium": "last"},
}


def item(spark, key, limits):
    mapping, record = RECORDS[key]
    row = F.from_json(F.lit(json.dumps(record)), mapping.schema)
    return mapping.apply(spark.range(1).select(row.alias("x")).select("x.*"), limits=limits).first()


@pytest.mark.parametrize("key", RECORDS)
def test_values_are_whole_by_default(spark, key):
    whole, cut = item(spark, key, None), item(spark, key, SITE_FIELDS)
    for column, end in ENDS[key].items():
        assert whole[column].endswith(end), (column, whole[column][-40:])
        assert len(cut[column]) < len(whole[column]) and not cut[column].endswith(end), column


def test_limits_of_one_field(spark):
    some = item(spark, "wellcome", {"wellcome": {"creator": 2}, "smk": {"place": 1}})
    assert some.creator == "v0; v1" and some.place.endswith("v29")
