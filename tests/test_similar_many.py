"""Many bases in blocks against the distance of each pair."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import similarity as S


@pytest.mark.parametrize("block", [4, 1024])
def test_many_bases_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BASE_BLOCK", block)
    monkeypatch.setattr(S, "CELL_ROWS", 20)
    monkeypatch.setattr(S, "SCORES", 60)
    rng = random.Random(block)
    same = ([0.5] * 64, [9.0] * 48)
    rows = []
    for i in range(90):
        gray, color = same if i % 3 == 0 else ([rng.uniform(-2, 2) for _ in range(64)], [rng.uniform(0, 255) for _ in range(48)])
        rows.append((f"p{i}", gray if i != 7 else None, color))
    df = spark.createDataFrame(rows, "id string, gray array<double>, color array<double>")
    bases = [f"p{i}" for i in range(0, 40, 3)] + ["p7", "p1", "p1", "unknown"]
    table = spark.createDataFrame([(b,) for b in bases], "id string")
    got = {(r.base, r["rank"]): (r.id, round(r.d, 9)) for r in S.rank_similar_many(df, table, 5).collect()}

    def distance(a, b):
        gray = sum((x - y) ** 2 for x, y in zip(a[1], b[1])) / 64
        color = sum(((x - y) / 255) ** 2 for x, y in zip(a[2], b[2])) / 48
        return gray**0.5 + 1.5 * color**0.5

    by_id = {r[0]: r for r in rows if r[1] is not None}
    want = {}
    for b in set(bases) & set(by_id):
        near = sorted((distance(by_id[b], r), i) for i, r in by_id.items() if i != b)[:5]
        want |= {(b, n): (i, round(d, 9)) for n, (d, i) in enumerate(near, 1)}
    assert got == want
    assert {(r.base, r["rank"]) for r in S.rank_similar_many(df, bases, 5).collect()} == set(want)
    assert S.rank_similar_many(df, ["unknown"], 5).count() == 0
    assert S.rank_similar_many(df, table, 5).where(F.col("d") < 0).count() == 0
