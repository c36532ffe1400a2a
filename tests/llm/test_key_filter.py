"""Wide rows are found or left out by many keys without a shuffle of the whole table, with the rows of a plain join."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from vitrine.llm import common, exact_dedup, minhash  # noqa: E402
from vitrine.session import landed  # noqa: E402

WIDE = "doc_id long, text string, word string, bits string"


@pytest.fixture(scope="module")
def docs(spark):
    """Near copies of every third text, equal texts, null texts and ids, names used inside; 7 also has the text of 4."""
    rng = random.Random(5)
    rows = []
    for i in range(150):
        w = [f"w{rng.randint(0, 400)}" for _ in range(80)]
        rows.append((i, " ".join(w)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join(w + ["more"])))
        if i % 5 == 0:
            rows.append((2000 + i, "  ".join(w)))
    rows += [(None, "x y"), (None, "x y"), (7, rows[7][1]), (8, None), (3000, None), (3001, ""), (3002, "lone")]
    full = [(i, t, f"word-{i}", f"bits-{i}") for i, t in rows]
    return landed(spark.createDataFrame(full, WIDE).repartition(5))


def ordered(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def many(monkeypatch):
    """Any number of keys counts as many."""
    monkeypatch.setattr(common, "BROADCAST_KEYS", -1)


@pytest.fixture
def no_small_tables(spark):
    """Without a hint no table is broadcast, as with large ones."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_filter_lets_every_key_through_and_few_others(spark, kind):
    rows = landed(spark.range(100_000).select(F.when(F.col("id") > 0, F.col("id")).cast(kind).alias("id")))
    keys = landed(spark.range(0, 100_000, 50).select(F.when(F.col("id") > 0, F.col("id")).alias("key")))
    found = common.sifted(rows, keys, "id", "key")
    assert found.where("id IS NULL OR id % 50 = 0").count() == 2000
    assert found.count() < 2000 + 0.12 * 98_000
    assert common.sifted(rows, keys, "id", "key", "left_anti").count() == 100_000 - found.count()
    none = keys.where("key < 0")
    assert common.sifted(rows, none, "id", "key").count() == 0
    assert common.sifted(rows, none, "id", "key", "left_anti").count() == 100_000


def test_a_full_filter_changes_no_row(spark, many, monkeypatch):
    monkeypatch.setattr(common, "FILTER_WORDS", 1)
    rows = landed(spark.range(5000).toDF("id"))
    keys = landed(spark.range(0, 5000, 3).toDF("key"))
    assert common.among(rows, keys, {"id": "key"}).where("id % 3 = 0").count() == 1667
    assert common.among(rows, keys, {"id": "key"}).count() == 1667
    assert common.without(rows, keys, {"id": "key"}).where("id % 3 != 0").count() == 3333
    assert common.without(rows, keys, {"id": "key"}).count() == 3333


def test_stages_return_the_same_rows_with_many_keys(docs, monkeypatch):
    few = [ordered(f(docs)) for f in (exact_dedup.drop_exact_duplicates, minhash.drop_near_duplicates)]
    assert [len(x) for x in few] == [docs.count() - 34, docs.count() - 82]
    monkeypatch.setattr(common, "BROADCAST_KEYS", -1)
    for f, want in zip((exact_dedup.drop_exact_duplicates, minhash.drop_near_duplicates), few, strict=True):
        got = f(docs)
        assert got.columns == docs.columns and ordered(got) == want
        assert f(docs.limit(0)).count() == 0


def test_texts_and_bands_are_not_shuffled_whole(docs, no_small_tables, monkeypatch):
    plans = {}

    def noted(df, name="step"):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return landed(df, name)

    monkeypatch.setattr(minhash, "landed", noted)
    minhash.near_classes(docs)
    assert "hashpartitioning" not in plans["texts"]
    assert "hashpartitioning(band" not in plans["shared"]


def test_wide_rows_are_shuffled_behind_the_filter_only(docs, no_small_tables, many):
    for drop in (exact_dedup.drop_exact_duplicates, minhash.drop_near_duplicates):
        plan = drop(docs)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("LeftAnti") == 2 and "Union" in plan
        # a filter stands below each join that shuffles, and one more leaves the other rows where they are
        assert plan.count("BroadcastHashJoin") == plan.count("SortMergeJoin") + 1
