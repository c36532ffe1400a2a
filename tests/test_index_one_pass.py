"""A written index takes texts to sorted postings in one pass: documents are dealt, postings are not shuffled."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vitrine.functions.stem import stem
from vitrine.plans import text_index as X
from vitrine.schema import TEXT_COLUMNS, conform


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (i, f"s{i % 3}", "Red boats" if i % 2 else None, "oak Oak relational boats boat " * (i % 4) + f"w{i % 11}" if i % 7 else "")
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, "rid bigint, source string, title string, text string")
    return conform(df.withColumns({"content_type": F.lit("image"), "boost": F.lit(0), "year_start": F.lit(1500)}))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stemmed", [False, True])
def test_no_posting_is_shuffled(spark, items, tmp_path, stemmed):
    index = X.build_index(items, stemmed=stemmed, land=False)
    text = plan(X.postings(index.rows))
    # the one exchange lies below the step that makes rows of terms
    assert text.count("Exchange") == 1 and text.index("Generate") < text.index("Exchange") and "Join" not in text
    X.write_index(index, str(tmp_path / "index"))
    written, landed = X.read_index(spark, str(tmp_path / "index"), stemmed), X.build_index(items, stemmed=stemmed)
    for name in ("postings", "vocabulary", "sources"):
        a, b = getattr(written, name), getattr(landed, name)
        assert a.count() == b.count() > 0 and a.exceptAll(b.select(a.columns)).count() == 0
    want = {}
    for r in items.select("rid", "title", "text").collect():
        for value, weight in ((r.title, 12.0), (r.text, 1.0)):
            for w in (value or "").lower().split():
                w = stem(w) if stemmed else w
                want[r.rid, w] = want.get((r.rid, w), 0.0) + weight
    assert {(r.rid, r.term): r.f for r in written.postings.collect()} == want


def test_terms_asked_for_and_no_document(spark, items, tmp_path):
    X.write_index(X.build_index(items, stemmed=True, terms=["boat"], land=False), str(tmp_path / "some"))
    some = X.read_index(spark, str(tmp_path / "some"), True)
    assert [(r.term, r.n_docs) for r in some.vocabulary.collect()] == [("boat", 120)]
    X.write_index(X.build_index(items.limit(0), land=False), str(tmp_path / "none"))
    assert X.read_index(spark, str(tmp_path / "none")).postings.count() == 0


def test_tokens_are_summed_inside_the_row(items):
    sums = X.index_tokens(items, summed=True)
    assert "Exchange" not in plan(sums)
    tokens = X.index_tokens(items).groupBy("rid", "len", "column", "weight").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("terms"), F.min("term").alias("lo"), F.max("term").alias("hi")
    )
    assert sums.count() == tokens.count() > 0 and sums.exceptAll(tokens).count() == 0
    assert set(r.column for r in sums.select("column").distinct().collect()) <= set(TEXT_COLUMNS)
