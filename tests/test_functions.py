"""Golden vectors of the scalar functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vitrine.functions import text as X
from vitrine.functions.stem import stem
from vitrine.functions.years import parse_years, year_span, years

YEARS = [
    ("1850", 1850, 1850), ("ca. 1850", 1845, 1855), ("c. 1850", 1845, 1855), ("circa 1850", 1845, 1855), ("1850–1860", 1850, 1860),
    ("1850-60", 1850, 1860), ("1850-40", 1850, 1850), ("1850s", 1850, 1859), ("1850's", 1850, 1859), ("early 1900s", 1900, 1904),
    ("late 1920s", 1925, 1929), ("18th century", 1701, 1800), ("18th c.", 1701, 1800), ("late 19th century", 1851, 1900),
    ("early 19th century", 1801, 1850), ("mid-18th century", 1726, 1775), ("first half of the 17th century", 1601, 1650),
    ("19th–20th century", 1801, 2000), ("15th to 16th century", 1401, 1600), ("late 19th–early 20th century", 1901, 1950),
    ("1st century B.C.", -100, -1), ("3rd millennium B.C.", -3000, -2001), ("2nd millennium", 1001, 2000), ("500 BCE", -500, -500),
    ("500-400 B.C.", -500, -400), ("30 BCE", -30, -30), ("79 AD", 79, 79), ("before 1900", 1870, 1900), ("after 1850", 1850, 1880),
    ("before 1900-1910", 1900, 1910), ("1920/1925", 1920, 1925), ("1776-07-04", 1776, 1776), ("about 1700-1710", 1700, 1710),
    ("2nd-1st century BCE", -101, -100), ("500-1900", None, None), ("n.d.", None, None), ("undated", None, None), ("", None, None),
    (None, None, None), ("no. 12", None, None), ("2150", None, None), ("vol. 3.1850", None, None),
]


def test_parse_years(spark):
    df = spark.createDataFrame(YEARS, "d string, s int, e int").select("*", parse_years("d").alias("y"))
    for r in df.collect():
        assert ((r.y.start, r.y.end) if r.y else (None, None)) == (r.s, r.e), r.d


def test_years_prefers_sane_numbers(spark):
    rows = [
        ("1850", "1860", None, 1850, 1860), ("1850", None, None, 1850, 1850), ("0", "0", "1700s", 1700, 1709),
        ("1900", "1800", None, 1900, 1900), (None, None, None, None, None), ("1000", "2300", None, 1000, 2300), ("5", "x", "1900", 5, 5),
    ]
    df = spark.createDataFrame(rows, "a string, b string, d string, s int, e int")
    for r in df.select("*", years(F.col("a"), F.col("b"), F.col("d")).alias("y")).collect():
        assert ((r.y.start, r.y.end) if r.y else (None, None)) == (r.s, r.e), r


def test_year_span(spark):
    df = spark.createDataFrame([(["1840s", "n.d.", "1820"],), (["n.d."],), ([],)], "d array<string>")
    out = df.select(year_span(F.transform("d", parse_years)).alias("y")).collect()
    assert [(r.y and (r.y.start, r.y.end)) for r in out] == [(1820, 1849), None, None]


def values(spark, rows, kind, fn):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"v {kind}").select(fn("v").alias("o")).collect()]


def test_clean(spark):
    given = ["<b>A</b> &amp; B", "  ﻿ ", "&amp;lt;", "x" * 12, "a\n\tb", None]
    assert values(spark, given, "string", lambda c: X.clean(c, 10)) == ["A & B", None, "<", "x" * 9 + "…", "a b", None]


def test_join_unique(spark):
    given = [["Oak", "oak", None, " Ash "], [], None, ["", "<i></i>"]]
    assert values(spark, given, "array<string>", X.join_unique) == ["Oak; Ash", None, None, None]


def test_slug(spark):
    given = ["Édouard Manet!", "", None, "ﬁne ½ ﬂag™", "--A--B--", "a" * 70, "Ωmega"]
    assert values(spark, given, "string", X.slug) == ["edouard-manet", "untitled", "untitled", "fine-1-2-flagtm", "a-b", "a" * 60, "mega"]


def test_ext_of(spark):
    given = ["http://x/a.JPG?w=1", "http://x/a", "http://x/a.tif#b.png", "a.toolong", "a.b.7z"]
    assert values(spark, given, "string", X.ext_of) == ["jpg", None, "tif", None, "7z"]


def test_to_int(spark):
    given = ["12.9", " 7 ", "", None, "12d", "-3.2", "1e3", "NaN", "Infinity"]
    assert values(spark, given, "string", X.to_int) == [12, 7, None, None, None, -3, 1000, None, None]


def test_query_tokens_agree_on_both_sides(spark):
    given = ["O'Keeffe’s “red-chair”", "", "a" * 40 + " b", " ".join("abcdefghijklmnop"), "Édouard №5", "½ cup"]
    in_spark = values(spark, given, "string", X.query_tokens)
    assert in_spark == [X.tokenize_query(q) for q in given]
    bounded = values(spark, given, "string", lambda c: X.query_tokens(c, **X.SITE_QUERY))
    assert bounded == [X.tokenize_query(q, **X.SITE_QUERY) for q in given]
    assert bounded[2:4] == [["b"], list("abcdefghijkl")] and in_spark[2:4] == [["a" * 40, "b"], list("abcdefghijklmnop")]
    assert in_spark[0] == ["o", "keeffe", "s", "red", "chair"]


def test_fold_agrees_on_both_sides(spark):
    given = ["Édouard", "ÑANDÚ", "øre", "ﬁn", "Ελλάδα", "é"]
    assert values(spark, given, "string", X.fold) == [X.fold_word(w) for w in given]


def test_rewrite_page_title(spark):
    given = ['Image from page 371 of "Encyclopédie x" (1884)', 'Image from page 3 of "T"', "Other"]
    assert values(spark, given, "string", X.rewrite_page_title) == ["Encyclopédie x (1884) — p. 371", "T — p. 3", "Other"]


def test_english_terms_checks_its_size(spark):
    with pytest.raises(ValueError):
        X.english_terms(F.lit("a"), {f"w{i}": "x" for i in range(X.MAX_DICTIONARY + 1)})


@pytest.mark.parametrize(
    "word,expected",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"),
        ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"),
        ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
        ("conditional", "condit"), ("digitizer", "digit"), ("generalizations", "gener"), ("oscillators", "oscil"), ("triplicate", "triplic"),
        ("formative", "form"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("adoption", "adopt"),
        ("adjustment", "adjust"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
        ("is", "is"), ("été", "été"), ("archaeology", "archaeolog"), ("archaeological", "archaeolog"), ("possibly", "possibl"), ("possible", "possibl"),
    ],
)
def test_stem(word, expected):
    assert stem(word) == expected


def test_slug_of_a_whole_text(spark):
    """Without a bound nothing is cut, and a title keeps its own slug."""
    from vitrine.checks import scalars
    from vitrine.checks.views import table

    assert values(spark, ["É" * 100 + "\nb " * 50], "string", lambda c: X.slug(c, None)) == ["e" * 100 + "-b" * 50]
    sf = "/root/testdata/sf0.001"
    long = table(spark, sf, "documents").filter("length(text) > 300").select("doc_id")
    got = scalars.slug(spark, sf).join(long, "doc_id").collect()
    assert got and max(len(r.slug) for r in got) > 60 >= max(len(r.title_slug) for r in got)
