"""Throttle, boards, staging, catalog: small brute-force checks and round trips."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vitrine.functions.urls import compact_images, expand_images
from vitrine.operators import boards as B
from vitrine.operators.patents import SITE_PATENT_PAGES, PatentQuery, clamp_patent_page, page_of_offset, patent_filter
from vitrine.operators.similarity import image_signature, rank_similar, rank_similar_many
from vitrine.operators.throttle import fixed_window_throttle, window_state
from vitrine.plans import build
from vitrine.schema import conform
from vitrine.sources import readers, sinks


@pytest.mark.parametrize("seed,window", [(1, 600_000), (2, 5_000_000), (3, 100)])
def test_throttle_equals_walking_each_key(spark, seed, window):
    rng = random.Random(seed)
    rows = sorted((("hot" if i % 3 == 0 else f"k{rng.randrange(9)}"), 1_700_000_000_000 + rng.randrange(40_000_000), i) for i in range(2500))
    state, want = {}, {}
    for key, now, n in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        end, used = state.get(key, (None, 0))
        end, used = (now + window, 1) if end is None or end < now else (end, used + 1)
        state[key] = (end, used)
        want[n] = (end - window, used, used <= 3)
    df = spark.createDataFrame(rows, "k string, ms bigint, n bigint").withColumn("ts", F.timestamp_millis("ms"))
    out = fixed_window_throttle(df, "k", "ts", "n", max_uses=3, window_ms=window).collect()
    assert {r.n: (r.window_start, r.used, r.allowed) for r in out} == want


def test_throttle_goes_on_from_a_state(spark):
    rng = random.Random(9)
    rows = sorted(((("hot" if i % 3 == 0 else f"k{i % 5}"), 1_700_000_000_000 + rng.randrange(9_000_000), i) for i in range(900)), key=lambda r: r[1])
    df = spark.createDataFrame(rows, "k string, ms bigint, n bigint").withColumn("ts", F.timestamp_millis("ms"))
    whole = {r.n: (r.window_start, r.used) for r in fixed_window_throttle(df, "k", "ts", "n", 3, 600_000).collect()}
    cut = rows[500][1]
    first = fixed_window_throttle(df.filter(F.col("ms") < cut), "k", "ts", "n", 3, 600_000)
    second = fixed_window_throttle(df.filter(F.col("ms") >= cut), "k", "ts", "n", 3, 600_000, state=window_state(first, "k"))
    assert {r.n: (r.window_start, r.used) for r in first.unionByName(second).collect()} == whole


def replay(ops):
    """Board operations one after the other."""
    boards = {"favorites": {"name": "Favorites", "created": 0, "updated": 0, "items": []}}
    for seq, ts, op, bid, name, item in ops:
        b = boards.get(bid)
        if op == "create" and b is None:
            boards[bid] = {"name": name.strip() or "Untitled board", "created": ts, "updated": ts, "items": []}
        elif b is None:
            continue
        elif op == "rename":
            b["name"], b["updated"] = name.strip() or b["name"], ts
        elif op == "remove" and bid != "favorites":
            del boards[bid]
        elif op == "add" and item not in b["items"]:
            b["items"].append(item)
            b["updated"] = ts
        elif op == "remove_item":
            b["items"] = [i for i in b["items"] if i != item]
            b["updated"] = ts
        elif op == "upsert_item":
            if item not in b["items"]:
                b["items"].append(item)
            b["updated"] = ts
    return boards


@pytest.mark.parametrize("seed", range(3))
def test_board_ops_equal_replay(spark, seed):
    rng = random.Random(seed)
    kinds = ["create"] * 3 + ["rename"] * 2 + ["remove"] + ["add"] * 8 + ["remove_item"] * 3 + ["upsert_item"] * 2
    ops = [
        (i, i * 10, rng.choice(kinds), rng.choice(["favorites", "a", "b", "c", "d"]), rng.choice([f" n{i} ", "  "]), f"i{rng.randrange(6)}")
        for i in range(300)
    ]
    want = replay(ops)
    got = B.apply_board_ops(spark.createDataFrame(ops, "seq bigint, ts bigint, op string, board_id string, name string, item_id string"))
    assert {r.board_id: (r.name, r.created_at, r.updated_at) for r in got.boards.collect()} == {
        k: (b["name"], b["created"], b["updated"]) for k, b in want.items()
    }
    items = {}
    for r in got.items.orderBy("board_id", "pos").collect():
        items.setdefault(r.board_id, []).append(r.item_id)
    assert items == {k: b["items"] for k, b in want.items() if b["items"]}


def some_boards(spark, boards, items):
    return B.Boards(
        spark.createDataFrame(boards, "board_id string, name string, created_at bigint, updated_at bigint"),
        spark.createDataFrame(items, "board_id string, pos bigint, item_id string"),
    )


def test_merge_boards_is_idempotent_and_adds_favorites(spark):
    a = some_boards(spark, [("x", "old", 0, 5), ("y", "Y", 3, 3)], [("x", 0, "p"), ("x", 1, "q"), ("y", 0, "p")])
    b = some_boards(spark, [("x", "new", 9, 6)], [("x", 0, "r"), ("x", 1, "p")])
    once = B.merge_boards(a, b)
    again = B.merge_boards(once, b)
    for m in (once, again):
        assert sorted(map(tuple, m.boards.collect())) == [("favorites", "Favorites", 0, 0), ("x", "new", 9, 6), ("y", "Y", 3, 3)]
        listed = [(r.board_id, r.pos, r.item_id) for r in m.items.orderBy("board_id", "pos").collect()]
        assert listed == [("x", 0, "p"), ("x", 1, "q"), ("x", 2, "r"), ("y", 0, "p")]


def test_compact_only_when_nothing_is_lost(spark):
    rows = [
        ("met", "https://images.metmuseum.org/CRDImages/ep/web-large/a.jpg", None, "https://images.metmuseum.org/CRDImages/ep/original/a.jpg", "ep/a.jpg"),
        ("met", "https://commons.wikimedia.org/wiki/Special:FilePath/A%20b%2B(c)%C3%A9.jpg?width=600", None, "https://commons.wikimedia.org/wiki/Special:FilePath/A%20b%2B(c)%C3%A9.jpg", "c:A b+(c)é.jpg"),
        ("met", "https://images.metmuseum.org/CRDImages/ep/web-large/a.jpg", "https://other/x.jpg", None, None),
        ("flickr", "https://live.staticflickr.com/1/2_a.jpg", None, "https://live.staticflickr.com/1/3_o.jpg", None),
        ("si", None, None, "https://ids.si.edu/ids/deliveryService?id=a%zz", None),
        ("unknown", "https://x/y.jpg", None, None, None),
    ]
    df = spark.createDataFrame(rows, "source string, thumb string, image string, original string, want string")
    out = df.withColumn("key", compact_images(F.col("source"), F.col("thumb"), F.col("image"), F.col("original")))
    out = out.withColumn("u", expand_images(F.col("source"), F.col("key"))).collect()
    for r in out:
        assert r.key == r.want
        if r.key:
            assert r.thumb in (None, r.u.thumb) and r.original in (None, r.u.original)


def test_staging_upsert_rewrites_only_touched_folders(spark, tmp_path):
    path = str(tmp_path / "staging")
    schema = "id string, source string, title string, updated_at bigint"
    sinks.upsert_staging(spark.createDataFrame([(f"s:{i}", "s" if i % 3 else "big", "v1", 1) for i in range(60)], schema), path, buckets=4)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "staging").rglob("*.parquet")}
    batch = spark.createDataFrame([("s:3", "big", "v2", 2), ("s:3", "big", "v3", 3), ("s:new", "big", "v1", 1)], schema)
    sinks.upsert_staging(batch, path, buckets=4)
    back = {r.id: r.title for r in sinks.read_staging(spark, path, batch.schema).collect()}
    assert len(back) == 61 and back["s:3"] == "v3" and back["s:6"] == "v1"
    kept = [p for p in before if p.exists() and p.stat().st_mtime_ns == before[p]]
    assert kept and all("source=s" in str(p) for p in before if p not in kept) is False
    sinks.upsert_staging(batch, path, buckets=4)
    assert sinks.read_staging(spark, path, batch.schema).count() == 61
    sinks.drop_source(spark, path, "big")
    assert {r.source for r in sinks.read_staging(spark, path, batch.schema).collect()} == {"s"}


def test_catalog_round_trip_restores_items(spark, tmp_path):
    rows = [
        ("nga:1", "nga", "1", "A", "https://api.nga.gov/iiif/k/full/!600,600/0/default.jpg", "https://api.nga.gov/iiif/k/full/max/0/default.jpg", "nga", 1),
        ("other:7", "other", "7", "B", "https://t/x", "https://o/x.png", "other", 2),
    ]
    df = spark.createDataFrame(rows, "id string, source string, source_id string, title string, thumb_url string, original_url string, feed string, seq bigint")
    rights = F.when(F.col("source") == "nga", "CC0").otherwise("Mine")
    staged = conform(df).withColumns({"public_domain": F.lit(True), "rights_label": rights, "license_url": F.lit("https://creativecommons.org/publicdomain/zero/1.0/"), "content_type": F.lit("image")})
    catalog = build.number_rows(build.build_catalog(staged, ["nga", "other"]))
    build.write_catalog(catalog, str(tmp_path / "catalog"))
    back = build.row_to_item(build.read_catalog(spark, str(tmp_path / "catalog")))
    got = {r.id: r for r in back.collect()}
    assert got["nga:1"].img == "k" and got["nga:1"].rights_label == "CC0" and got["nga:1"].public_domain
    assert got["nga:1"].original_url == rows[0][5] and got["nga:1"].source_url.endswith("art-object-page.1.html")
    assert got["other:7"].img is None and got["other:7"].original_url == "https://o/x.png" and got["other:7"].rights_label == "Mine"
    assert got["other:7"].files[0].url == "https://o/x.png" and got["other:7"].files[0].format == "png"
    assert sorted(r.rid for r in got.values()) == [1, 2]


def test_signature_of_a_flat_image_is_zero(spark):
    df = spark.createDataFrame([(1, [10] * 768), (2, [(i * 37) % 256 for i in range(768)]), (3, None)], "id int, pixels array<int>")
    sig = df.select("id", image_signature(F.col("pixels")).alias("s")).select("id", "s.*")
    rows = {r.id: r for r in sig.collect()}
    assert set(rows[1].gray) == {0.0} and rows[1].color == [10.0] * 48
    assert abs(sum(rows[2].gray)) < 1e-9
    usable = sig.filter("id < 3")
    assert [r.id for r in rank_similar(usable, 1, 5).collect()] == [2]
    assert rank_similar(usable, 99, 5).count() == 0
    assert [(r.base, r.id, r["rank"]) for r in rank_similar_many(usable, [1, 2], 5).orderBy("base").collect()] == [(1, 2, 1), (2, 1, 1)]


def test_patent_arguments():
    asked = ((None, None), (1, -4), (500, 90))
    assert [clamp_patent_page(*a) for a in asked] == [(100, 0), (1, 0), (500, 90)]
    assert [clamp_patent_page(*a, **SITE_PATENT_PAGES) for a in asked] == [(100, 0), (10, 0), (100, 50)]
    assert page_of_offset(250, 100) == 2


def test_patent_filter_ignores_bad_dates(spark):
    df = spark.createDataFrame([("US1", "T", "I", "A", "2000-01-01", "2001-01-01", None, "2002-01-01")], "publication_number string, title string, inventor string, assignee string, priority_date string, filing_date string, grant_date string, publication_date string")
    assert df.filter(patent_filter(PatentQuery(before="90", after="x"), df.columns)).count() == 1
    assert df.filter(patent_filter(PatentQuery(before="2001"), df.columns)).count() == 0


def test_csv_reader_trims_headers_and_pads(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id , title\n1,"a ""q""\nb"\n\n2\n'.encode())
    rows = readers.read_csv_records(spark, str(tmp_path / "a.csv"), ["id", "title", "absent"]).collect()
    assert [tuple(r) for r in rows] == [("1", 'a "q"\nb', ""), ("2", "", "")]


def test_dictionary_is_read_with_a_size_check(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("Prent\tprint\nleeg\t\n")
    assert readers.read_dictionary(spark, str(tmp_path / "d.tsv")) == {"prent": "print"}
    with pytest.raises(ValueError):
        readers.read_dictionary(spark, str(tmp_path / "d.tsv"), max_words=0)


def test_images_need_pillow(spark, tmp_path):
    pytest.importorskip("pyspark")
    try:
        import PIL  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="Pillow"):
            readers.read_images(spark, str(tmp_path))


@pytest.mark.parametrize("newest", [False, True])
def test_upsert_replaces_ids_that_move(spark, tmp_path, newest):
    """To another source, to a source that then has nothing else, and with another number of buckets asked for."""
    path = str(tmp_path / "moving")
    schema = "id string, source string, title string, updated_at bigint"
    first = [(f"i{i}", "a" if i % 2 else "b", "v1", 1) for i in range(80)] + [("lone", "c", "v1", 1), ("odd", "x/y", "v1", 1)]
    sinks.upsert_staging(spark.createDataFrame(first, schema), path, buckets=4)
    batch = spark.createDataFrame([("i1", "b", "v2", 2), ("i2", "d", "v2", 2), ("lone", "a", "v2", 2), ("odd", "a", "v2", 2), ("new", "c", "v2", 2)], schema)
    for buckets in (4, 7):
        sinks.upsert_staging(batch, path, buckets=buckets, newest=newest)
        back = {(r.id, r.source, r.title) for r in sinks.read_staging(spark, path, batch.schema).collect()}
        want = {r[0]: r for r in first} | {r.id: tuple(r) for r in batch.collect()}
        assert back == {r[:3] for r in want.values()} and len(back) == len(want)
    late = spark.createDataFrame([("i3", "d", "late", 0)], schema)
    sinks.upsert_staging(late, path, newest=newest)
    found = [(r.source, r.title) for r in sinks.read_staging(spark, path, batch.schema).filter("id = 'i3'").collect()]
    assert found == ([("a", "v1")] if newest else [("d", "late")])


def test_a_small_batch_leaves_other_folders_alone(spark, tmp_path):
    path = tmp_path / "small"
    schema = "id string, source string, title string, updated_at bigint"
    sinks.upsert_staging(spark.createDataFrame([(f"i{i}", f"s{i % 3}", "v1", 1) for i in range(300)], schema), str(path), buckets=8)
    before = {f for f in path.rglob("*.parquet")}
    sinks.upsert_staging(spark.createDataFrame([("i0", "s0", "v2", 2)], schema), str(path))
    assert len({f.parent for f in set(path.rglob("*.parquet")) - before}) == 1
