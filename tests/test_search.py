"""Search against brute force on a small corpus, with and without stemming."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from vitrine.functions.stem import stem
from vitrine.functions.text import fold_word, tokenize_query
from vitrine.plans.search import SearchParams, search
from vitrine.plans.text_index import WEIGHTS, build_index, translate_terms, read_index, write_index
from vitrine.schema import TEXT_COLUMNS, conform

WORDS = "Chairs chair running runner red École ecole painting paintings boat boats relational relation oak".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)

    def text(n):
        return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))

    rows = [
        (i, "hot" if i % 3 == 0 else f"s{i % 4}", text(4), text(3), text(3), None, text(2), text(2), text(9), i % 3 if i % 5 == 0 else 0, 1500 + i % 50)
        for i in range(150)
    ]
    cols = ["rid", "source", *TEXT_COLUMNS, "boost", "year_start"]
    types = "rid bigint, source string, " + ", ".join(f"{c} string" for c in TEXT_COLUMNS) + ", boost int, year_start int"
    df = spark.createDataFrame(rows, types).withColumn("content_type", F.lit("image"))
    return [dict(zip(cols, r)) for r in rows], conform(df).cache()


def brute(rows, q, stemmed):
    norm = (lambda w: stem(fold_word(w))) if stemmed else fold_word
    terms = [norm(w) for w in tokenize_query(q)]
    docs = {r["rid"]: {c: [norm(w) for w in tokenize_all(r[c])] for c in TEXT_COLUMNS} for r in rows}
    lengths = {k: sum(len(v) for v in d.values()) for k, d in docs.items()}
    avg = sum(lengths.values()) / len(docs)
    tf = {k: {t: sum(WEIGHTS[c] * d[c].count(t) for c in d) for t in set(terms)} for k, d in docs.items()}
    df = {t: sum(1 for k in docs if tf[k][t] > 0) for t in set(terms)}
    out = {}
    for r in rows:
        k = r["rid"]
        if not any(tf[k].values()):
            continue
        score = 0.0
        for t in terms:
            idf = math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5))
            f = tf[k][t]
            score += max(idf, 0) and idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[k] / avg)) or (1e-6 * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[k] / avg)) if idf <= 0 else 0)
        out[k] = (round(score + 0.4 * r["boost"], 6), all(tf[k][t] > 0 for t in set(terms)))
    return out


def tokenize_all(value):
    return (value or "").split()


def naive_search(rows, q, stemmed, limit):
    """Lists per source, second pass when thin, greedy merge."""
    scores = brute(rows, q, stemmed)
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + 1
    sources = sorted(sizes, key=lambda s: (-sizes[s], s))
    by_id = {r["rid"]: r for r in rows}
    order = sorted(scores, key=lambda k: (-scores[k][0], k))
    cands = [k for s in sources for k in order if by_id[k]["source"] == s and scores[k][1]]
    if len(tokenize_query(q)) > 1 and len(cands) < limit:
        cands += [k for s in sources for k in order if by_id[k]["source"] == s and not scores[k][1]]
    lists = {}
    for k in cands:
        lists.setdefault(by_id[k]["source"], []).append(k)
    for s in lists:
        lists[s].sort(key=lambda k: -scores[k][0])
    taken, out = {s: 0 for s in lists}, []
    while len(out) < len(cands):
        best, value = None, -1.0
        for s, ks in lists.items():
            if taken[s] < len(ks):
                v = scores[ks[taken[s]]][0] / (1 + 0.06 * taken[s])
                if v > value:
                    best, value = s, v
        out.append(lists[best][taken[best]])
        taken[best] += 1
    return [(k, scores[k][0]) for k in out[:limit]]


@pytest.mark.parametrize("stemmed", [False, True])
@pytest.mark.parametrize("q", ["chair", "red oak", "running paintings boat", "école relational", "oak oak red"])
def test_search_equals_brute_force(corpus, q, stemmed):
    rows, df = corpus
    page = search(df, SearchParams(q=q, limit=40), index=build_index(df, stemmed=stemmed)).page
    got = [(r.rid, r.score) for r in page.orderBy("pos").collect()]
    want = naive_search(rows, q, stemmed, 40)
    assert [k for k, _ in got] == [k for k, _ in want]
    assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got, want))


def test_written_index_gives_the_same_page(spark, corpus, tmp_path):
    _, df = corpus
    write_index(build_index(df), str(tmp_path / "index"))
    stored = search(df, SearchParams(q="red boat", limit=30), index=read_index(spark, str(tmp_path / "index")))
    fresh = search(df, SearchParams(q="red boat", limit=30))
    assert [tuple(r) for r in stored.page.select("rid", "pos").orderBy("pos").collect()] == [tuple(r) for r in fresh.page.select("rid", "pos").orderBy("pos").collect()]


def test_nonsense_is_empty_and_reversed_years_too(corpus):
    _, df = corpus
    assert search(df, SearchParams(q="zzzz qqqq")).page.count() == 0
    assert search(df, SearchParams(q="oak", year_from=1900, year_to=1500)).page.count() == 0


def test_second_page_continues_the_first(corpus):
    _, df = corpus
    index = build_index(df)
    first = [r.rid for r in search(df, SearchParams(q="oak", limit=10), index=index).page.orderBy("pos").collect()]
    second = [r.rid for r in search(df, SearchParams(q="oak", limit=10, offset=10), index=index).page.orderBy("pos").collect()]
    both = [r.rid for r in search(df, SearchParams(q="oak", limit=20), index=index).page.orderBy("pos").collect()]
    assert first + second == both


def test_total_is_the_sum_over_sources(corpus):
    _, df = corpus
    found = search(df, SearchParams(q="oak"))
    assert found.total.first().total == sum(r.hits for r in found.per_source.collect()) > 0


def test_punctuation_only_query_browses(corpus):
    _, df = corpus
    assert search(df, SearchParams(q="?!", limit=5)).page.count() == 5


def test_translate_terms(spark):
    df = spark.createDataFrame([(1, "Prent, foto's en prent"), (2, "niets")], "id int, t string")
    out = translate_terms(df, "id", F.col("t"), {"prent": "print", "foto's": "photographs", "leeg": ""}, keep_apostrophes=True).collect()
    assert [(r.id, r.english) for r in out] == [(1, "print photographs")]


def test_long_page_is_joined_and_equal(corpus, monkeypatch):
    _, df = corpus
    index = build_index(df)
    ask = SearchParams(q="oak", limit=30)
    short = [r.rid for r in search(df, ask, index=index).page.orderBy("pos").collect()]
    monkeypatch.setattr("vitrine.plans.search.BROADCAST_ROWS", 5)
    long = search(df, ask, index=index)
    assert [r.rid for r in long.page.orderBy("pos").collect()] == short
    assert [r.rid for r in long.fetch(df).orderBy("pos").collect()] == short


def test_search_reads_no_catalog_row_but_the_page(spark, corpus, tmp_path):
    """The answer comes from the index; the page then reads its rows by their numbers."""
    from vitrine.plans.build import read_catalog, write_catalog

    rows, df = corpus
    write_catalog(df, str(tmp_path / "catalog"))
    write_index(build_index(df), str(tmp_path / "index"))
    catalog = read_catalog(spark, str(tmp_path / "catalog"))
    index = read_index(spark, str(tmp_path / "index"))
    ask = SearchParams(q="red boat", limit=30, year_from=1510, content="image", sources=["hot", "s1"])
    found = search(catalog, ask, index=index)
    for part in (found.hits, found.per_source):
        assert "/catalog" not in part._jdf.queryExecution().executedPlan().toString()
    page = found.fetch(catalog)
    assert "In(rid" in page._jdf.queryExecution().executedPlan().toString()
    got = [(r.rid, r.pos) for r in page.orderBy("pos").collect()]
    assert got == [(r.rid, r.pos) for r in found.page.orderBy("pos").collect()]
    years = {r["rid"]: (r["year_start"], r["source"]) for r in rows}
    assert got and all(years[k][0] >= 1510 and years[k][1] in ("hot", "s1") for k, _ in got)
    # a filter by a part of a text asks the catalog for that column alone
    some = search(catalog, SearchParams(q="red boat", limit=30, creator="oak"), index=index)
    assert {r.rid for r in some.hits.collect()} <= {r["rid"] for r in rows if "oak" in (r["creator"] or "")}


def test_terms_are_counted_inside_the_row(spark, corpus):
    from vitrine.plans.text_index import postings, row_terms

    rows, df = corpus
    posts = postings(row_terms(df))
    assert "Exchange" not in posts._jdf.queryExecution().executedPlan().toString()
    got = {(r.rid, r.term): (r.f, r.len, r.source) for r in posts.collect()}
    want = {}
    for r in rows:
        words = [(c, fold_word(w)) for c in TEXT_COLUMNS for w in tokenize_all(r[c])]
        for c, w in words:
            f, _, _ = want.get((r["rid"], w), (0.0, 0, ""))
            want[r["rid"], w] = (f + WEIGHTS[c], len(words), r["source"])
    assert got == want
    assert postings(row_terms(df.limit(0))).count() == 0
    some = postings(row_terms(df, terms=["oak"]))
    assert {(r.rid, r.f) for r in some.collect()} == {(k, f) for (k, w), (f, _, _) in want.items() if w == "oak"}
