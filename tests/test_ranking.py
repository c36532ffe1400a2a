"""Split rankings and merges against the naive definitions, with one group holding a third of the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from vitrine.operators import caps as C, merge as M
from vitrine.operators.ranking import bucket_rank, first_per_key, seq_bucket, top_n


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"g{rng.randrange(40)}" if i % 50 else None, rng.randrange(6), rng.random()) for i in range(9000)]
    return spark.createDataFrame(rows, "id bigint, g string, level int, score double").cache()


def pairs(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


def test_bucket_rank_equals_row_number(skewed):
    got = bucket_rank(skewed, ["g"], [-F.col("level"), seq_bucket(F.col("id"), 500)], [F.col("level").desc(), F.col("id").asc()])
    plain = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.col("level").desc(), "id")).cast("bigint"))
    assert pairs(got, "id", "g", "rank") == pairs(plain, "id", "g", "rank")


def test_bucket_rank_limit_keeps_the_same_rows(skewed):
    order = [F.col("id").asc()]
    got = bucket_rank(skewed, ["g"], [seq_bucket(F.col("id"), 100)], order, limit=37)
    plain = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("id"))).filter("rank <= 37")
    assert pairs(got, "id", "rank") == pairs(plain, "id", "rank")


def test_top_n_equals_row_number(skewed):
    order = [F.col("score").desc(), F.col("id").asc()]
    got = top_n(skewed, ["g"], order, 25, salt_by=["id"], rank="rank")
    plain = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter("rank <= 25")
    assert pairs(got, "id", "rank") == pairs(plain, "id", "rank")


def test_group_limits_run_before_the_shuffle(skewed):
    plan = first_per_key(skewed, ["g"], [F.col("id").asc()])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_caps_are_exact_and_prefer_highlights(spark, skewed):
    rows = skewed.filter("g is not null").select(F.col("g").alias("source"), F.col("id").alias("rid"), F.col("id").alias("source_id"), F.when(F.col("id") % 97 == 0, 2).otherwise(0).alias("boost"))
    kept = C.cap_per_source(rows, {"hot": 200}, default=20)
    counts = {r.source: r.n for r in kept.groupBy("source").agg(F.count("*").alias("n")).collect()}
    sizes = {r.source: r.n for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert counts == {s: min(n, 200 if s == "hot" else 20) for s, n in sizes.items()}
    assert kept.filter("source = 'hot' and boost = 2").count() == rows.filter("source = 'hot' and boost = 2").count()


def test_shuffle_hash_does_not_overflow(spark):
    big = spark.createDataFrame([(5_000_000_000_000,), (7,)], "rid bigint").select(M.shuffle_hash(F.col("rid"), 7).alias("h")).collect()
    assert [r.h for r in big] == [(n * M.HASH_FACTOR + 7) % M.HASH_PRIME for n in (5_000_000_000_000, 7)]


def greedy(lists, penalty):
    """The merge as defined: best discounted head, earlier source on a tie."""
    taken, out = {s: 0 for s in lists}, []
    while any(taken[s] < len(rows) for s, rows in lists.items()):
        best, value = None, None
        for s, rows in lists.items():
            if taken[s] < len(rows):
                v = rows[taken[s]][1] / (1 + penalty * taken[s])
                if value is None or v > value:
                    best, value = s, v
        out.append(lists[best][taken[best]][0])
        taken[best] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("signed", [False, True])
def test_diverse_merge_equals_greedy(spark, seed, signed):
    rng = random.Random(seed)
    rows, lists = [], {}
    for n, s in enumerate("abcd"):
        size = rng.randrange(1, 25)
        scores = sorted([round(rng.uniform(-3 if signed else 0, 5), 1) for _ in range(size)], reverse=True)
        lists[s] = [(n * 100 + i, v) for i, v in enumerate(scores)]
        rows += [(rid, s, n, v, i + 1) for i, (rid, v) in enumerate(lists[s])]
    df = spark.createDataFrame(rows, "rid bigint, source string, place int, score double, rank int")
    merge = M.diverse_order_signed if signed else M.diverse_order
    valued, order = merge(df, [F.col("place").asc()])
    assert [r.rid for r in valued.orderBy(*order).collect()] == greedy(lists, M.PENALTY)


def test_round_robin(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, "a", 0), (4, "b", 1)], "rid bigint, source string, place int")
    got = M.round_robin_page(df, [F.col("rid").asc()], [F.col("place").asc()], 0, 10)
    assert [r.rid for r in got.orderBy("pos").collect()] == [1, 4, 2, 3]


def test_pages_are_disjoint_and_grow(spark, skewed):
    df = skewed.filter("g is not null").withColumnRenamed("id", "rid").withColumnRenamed("g", "source")
    pages = [{r.rid for r in M.diverse_page(df, [F.col("source").asc()], o, 40).collect()} for o in (0, 40, 80)]
    assert len(set().union(*pages)) == 120


def test_unique_names_are_unique_per_use(spark):
    df = spark.createDataFrame([(i, "a.jpg" if i < 7 else "b.tar.gz" if i < 9 else "c") for i in range(10)], "seq bigint, name string")
    out = [r.unique_name for r in C.unique_names(df, "name", "seq", width=3).orderBy("seq").collect()]
    assert out == ["a.jpg", *[f"a-{k}.jpg" for k in range(2, 8)], "b.tar.gz", "b.tar-2.gz", "c"]


def test_seed_and_page_bounds():
    assert [M.clamp_seed(s) for s in (None, float("nan"), -5.9, 1000004)] == [7, 7, 5, 1]
    asked = ((None, None), (9999, 9999), (-1, -1), (10, 1495))
    assert [M.clamp_page(*a) for a in asked] == [(250, 0), (9999, 9999), (1, 0), (10, 1495)]
    assert [M.clamp_page(*a, **M.SITE_PAGES) for a in asked] == [(250, 0), (500, 1000), (1, 0), (10, 1490)]
