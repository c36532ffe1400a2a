"""Full-text index as DataFrames: tokens, postings, vocabulary, and BM25 over them."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F, types as T

from vitrine.functions.stem import stem
from vitrine.functions.text import english_terms, fold_word, let, tokens
from vitrine.schema import TEXT_COLUMNS
from vitrine.session import landed

# Column weights and BM25 constants.
WEIGHTS = {
    "title": 12.0, "creator": 4.0, "object_type": 10.0, "medium": 3.0, "culture": 4.0, "place": 4.0, "text": 1.0,
}
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
BOOST_WEIGHT = 0.4
POSTINGS = (
    "rid bigint, term string, f double, len int, source string, boost int, year_start int, year_end int, content_type string, "
    "public_domain boolean"
)
# sums of doubles depend on the order tasks finish; rounding makes ranks repeatable
SCORE_DIGITS = 6
# Documents that a task takes when an index is written; 260 distinct words each make a sort of some 300 MB.
SEGMENT_ROWS = 8192


def index_tokens(items: DataFrame, columns: Sequence[str] = TEXT_COLUMNS, summed: bool = False) -> DataFrame:
    """Every token of every searchable column: rid, doc length, column, weight, term.

    With ``summed`` one row per document and column that has tokens, worked out inside the row: n (tokens), terms (distinct
    ones), lo and hi (first and last in order) in place of the term.
    """
    split = items.select("rid", *[tokens(c).alias(f"w_{c}") for c in columns])
    length = sum((F.size(f"w_{c}") for c in columns), F.lit(0))

    def field(c: str) -> Column:
        words = F.col(f"w_{c}")
        sums = [
            F.size(words).cast("bigint").alias("n"), F.size(F.array_distinct(words)).cast("bigint").alias("terms"),
            F.array_min(words).alias("lo"), F.array_max(words).alias("hi"),
        ]
        return F.struct(F.lit(c).alias("column"), F.lit(WEIGHTS[c]).alias("weight"), *(sums if summed else [words.alias("words")]))

    per_column = split.select("rid", length.alias("len"), F.explode(F.array(*[field(c) for c in columns])).alias("f"))
    if summed:
        return per_column.select("rid", "len", "f.*").where(F.col("n") > 0)
    return per_column.select("rid", "len", "f.column", "f.weight", F.explode("f.words").alias("term"))


# What a search filters, ranks and merges by; a posting carries them, so that no catalog row is read for them.
FACETS = ("source", "boost", "year_start", "year_end", "content_type", "public_domain")


def spread(items: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores are dealt over all cores; a table of many files is left as it is."""
    cores = items.sparkSession.sparkContext.defaultParallelism
    return items.repartition(cores) if len(items.inputFiles()) < cores else items


def _starts(w: Column, key: Callable[[Column], Column]) -> Column:
    """Places (from 1) of a sorted array where another value begins."""
    return F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.coalesce(key(F.get(w, i - 1)) != key(F.get(w, i - 2)), F.lit(True)))


def _counted(words: Column, weight: float) -> Column:
    """Distinct words of an array in order, as (term, f) with f their number times the weight."""

    def of_sorted(w: Column) -> Column:
        def one(at: Column, start: Column, j: Column) -> Column:
            n = F.coalesce(F.get(at, j + 1), F.size(w) + 1) - start
            return F.struct(F.get(w, start - 1).alias("term"), (n * F.lit(weight)).alias("f"))

        return let(_starts(w, lambda x: x), lambda at: F.transform(at, lambda start, j: one(at, start, j)))

    empty = F.array().cast("array<struct<term:string,f:double>>")
    return F.when(F.size(words) > 0, let(F.sort_array(words), of_sorted)).otherwise(empty)


def _runs(words: Column) -> Column:
    """Distinct terms of an array of (term, f) with the sum of f: runs of the sorted array, inside the row."""

    def of_sorted(w: Column) -> Column:
        starts = _starts(w, lambda x: x["term"])
        return let(starts, lambda at: F.transform(at, lambda start, j: summed(w, start, F.coalesce(F.get(at, j + 1), F.size(w) + 1))))

    def summed(w: Column, start: Column, end: Column) -> Column:
        f = F.aggregate(F.slice(w, start, end - start), F.lit(0.0), lambda n, x: n + x["f"])
        whole = F.struct(F.get(w, start - 1)["term"].alias("term"), f.alias("f"))
        # most terms come once: nothing to cut out and sum
        return F.when(end - start == 1, F.get(w, start - 1)).otherwise(whole)

    return F.when(F.size(words) > 0, let(F.sort_array(words), of_sorted))


def row_terms(items: DataFrame, columns: Sequence[str] = TEXT_COLUMNS, terms: Sequence[str] | None = None) -> DataFrame:
    """One row per document: rid, its facets, its length and its distinct terms with their weighted frequency.

    The words of a row are sorted and summed where they are: no shuffle, and each text is split once. A row without
    words has null for its terms. With ``terms`` only those are kept; the length still counts all.
    """
    facets = [c for c in FACETS if c in items.columns]
    split = items.select("rid", *facets, *[tokens(c).alias(f"w_{c}") for c in columns])

    def counted(column: str) -> Column:
        words = F.col(f"w_{column}")
        if terms is not None:
            words = F.filter(words, lambda w: w.isin(list(terms)))
        return _counted(words, WEIGHTS[column])

    length = sum((F.size(f"w_{c}") for c in columns), F.lit(0))
    return split.select("rid", *facets, length.alias("len"), let(F.concat(*[counted(c) for c in columns]), _runs).alias("terms"))


@lru_cache(maxsize=200_000)
def _stem(word: str) -> str:
    """Stem of a word, remembered by the Python worker (some 40 MB)."""
    return stem(word)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [_stem(w) for w in ws])


def postings(rows: DataFrame) -> DataFrame:
    """Weighted term frequency per document from its ``row_terms``: term, f, and what the row carries."""
    # the outer form: for the plain one Spark would add a filter on the terms below, and work them out twice
    one = rows.select("rid", F.inline_outer("terms"), "len", *[c for c in FACETS if c in rows.columns])
    return one.where(F.col("term").isNotNull())


def stem_terms(rows: DataFrame) -> DataFrame:
    """``row_terms`` of stems: words of a document with one stem add up inside the row, no posting is shuffled."""
    stems = rows.withColumn("_stems", _stems(F.col("terms.term")))
    both = F.zip_with("_stems", F.col("terms.f"), lambda s, f: F.struct(s.alias("term"), f.alias("f")))
    return stems.withColumn("terms", _runs(both)).drop("_stems")


def corpus_stats(rows: DataFrame) -> DataFrame:
    """One row from the ``row_terms`` of a corpus: number of documents and average length."""
    return rows.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))


def vocabulary(postings_df: DataFrame, stats: DataFrame) -> DataFrame:
    """Document frequency per term, with the corpus statistics a score needs."""
    both = stats.select(F.struct("n_docs", "avg_len").alias("s")).scalar()
    counted = postings_df.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("_s", both)
    return counted.select("term", "df", "_s.n_docs", "_s.avg_len")


@dataclass
class TextIndex:
    """Postings that carry the facets, document frequencies, and the number of documents per source."""

    postings: DataFrame
    vocabulary: DataFrame
    stemmed: bool = False
    stats: DataFrame | None = None  # set on a freshly built index, needed to write it
    sources: DataFrame | None = None  # source, count
    rows: DataFrame | None = None  # the ``row_terms`` of an index that is written at once

    def query_terms(self, words: Sequence[str]) -> list[str]:
        folded = [fold_word(w) for w in words]
        return [stem(w) for w in folded] if self.stemmed else folded

    @property
    def has_facets(self) -> bool:
        return set(FACETS) <= set(self.postings.columns)


def build_index(
    items: DataFrame, stemmed: bool = False, terms: Sequence[str] | None = None, columns: Sequence[str] = TEXT_COLUMNS, land: bool = True
) -> TextIndex:
    """Index of ``items``. With ``terms`` only those are kept, which is enough to answer one query.

    The terms of all rows are landed once; postings, lengths, corpus sums and source counts are read from there. An index that
    is written at once needs no landing (``land=False``): ``write_index`` works out the terms on its one way to the postings.
    """
    rows = row_terms(spread(items) if land else _dealt(items), columns, None if stemmed else terms)
    if stemmed:
        rows = stem_terms(rows)
        if terms is not None:
            kept = F.filter("terms", lambda t: t["term"].isin(list(terms)))
            rows = rows.withColumn("terms", F.when(F.size(kept) > 0, kept))
    if land:
        rows = landed(rows, "row-terms")
    posts = postings(rows)
    stats = corpus_stats(rows)
    listed = rows if land else items
    sources = listed.groupBy("source").agg(F.count(F.lit(1)).alias("count")) if "source" in rows.columns else None
    return TextIndex(posts, vocabulary(posts, stats), stemmed, stats, sources, None if land else rows)


def _dealt(items: DataFrame) -> DataFrame:
    """Rows dealt over tasks of about ``SEGMENT_ROWS``, so that what a task sorts has one size at any size of the corpus."""
    tasks = -(-items.count() // SEGMENT_ROWS)
    return items.repartition(max(tasks, items.sparkSession.sparkContext.defaultParallelism), "rid")


def write_index(index: TextIndex, path: str) -> None:
    """Postings in segments sorted by term, so a query reads only the pages of its words in each.

    A segment holds the postings of its documents: texts are split, counted and sorted in one pass, and no posting is shuffled.
    A word that is in a third of all documents is in all segments, as its documents are.
    """
    if not index.has_facets:
        raise ValueError(f"the postings need all of {FACETS}; conform the items first")
    spark, posts, stats, seen = index.postings.sparkSession, index.postings, index.stats, None
    if index.rows is not None:
        # the corpus sums come with the write, no job of their own
        seen = Observation()
        posts = postings(index.rows.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("len").alias("len")))
    posts = posts.selectExpr(*[f"cast({c} as {t}) as {c}" for c, t in (x.split() for x in POSTINGS.split(", "))])
    posts.sortWithinPartitions("term", "rid").write.mode("overwrite").parquet(f"{path}/postings")
    if seen is not None:
        n, length = seen.get["n"], seen.get["len"]
        stats = spark.range(1).select(F.lit(n).alias("n_docs"), F.lit(length / n if n else None).cast("double").alias("avg_len"))
    # document frequencies come from the written table, the tokens are not split again
    posts = spark.read.parquet(f"{path}/postings")
    vocab = vocabulary(posts, stats)
    vocab.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/vocabulary")
    if index.sources is not None:
        index.sources.write.mode("overwrite").parquet(f"{path}/sources")


def read_index(spark: SparkSession, path: str, stemmed: bool = False) -> TextIndex:
    """A written index. Its schema is known, so no file footer is read to find it."""
    def part(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/{name}")

    return TextIndex(
        part("postings", POSTINGS), part("vocabulary", "term string, df bigint, n_docs bigint, avg_len double"), stemmed,
        sources=part("sources", "source string, count bigint"),
    )


def idf(df: int, n_docs: int) -> float:
    raw = math.log((n_docs - df + 0.5) / (df + 0.5))
    return raw if raw > 0 else IDF_FLOOR


def look_up(index: TextIndex, terms: Sequence[str]) -> dict[str, Row]:
    """Vocabulary rows of the query's words, at most one for each; words of no document are missing."""
    return {r["term"]: r for r in index.vocabulary.filter(F.col("term").isin(sorted(set(terms)))).collect()}


def bm25_matches(
    index: TextIndex, terms: Sequence[str], keep: Column | None = None, known: Mapping[str, Row] | None = None
) -> DataFrame:
    """Documents with any of the terms: rid, the facets of the index, bm25, n_terms (distinct terms found).

    A term that is repeated in the query counts as often as it is repeated. ``keep`` is a filter on the facets; it is
    applied to the postings as they are read and changes no score. ``known`` is the result of ``look_up``; its few numbers
    become literals of the plan.
    """
    known = look_up(index, terms) if known is None else known
    times = {t: n for t, n in Counter(terms).items() if t in known}
    weights = [F.lit(x) for t, n in times.items() for x in (t, n * idf(known[t]["df"], known[t]["n_docs"]))]
    avg_len = next((r["avg_len"] for r in known.values()), None) or 1.0
    f, length = F.col("f"), F.col("len")
    weight = F.element_at(F.create_map(*weights), F.col("term")) if weights else F.lit(0.0)
    part = weight * (f * (K1 + 1)) / (f + K1 * (1 - B + B * length / F.lit(avg_len)))
    hits = index.postings.filter(F.col("term").isin(list(times)) if times else F.lit(False))
    if keep is not None:
        hits = hits.filter(keep)
    carried = [c for c in FACETS if c in index.postings.columns]
    if len(times) == 1:
        # a document has one posting of a term: nothing to bring together
        return hits.select("rid", *carried, part.alias("bm25"), F.lit(1).cast("bigint").alias("n_terms"))
    # the facets are the same in all postings of a document
    return hits.groupBy("rid", *carried).agg(F.sum(part).alias("bm25"), F.count(F.lit(1)).alias("n_terms"))


def boosted_score(bm25: Column, boost: Column) -> Column:
    return F.round(bm25 + BOOST_WEIGHT * F.coalesce(boost, F.lit(0)), SCORE_DIGITS)


def has_terms(index: TextIndex, words: Sequence[str], mode: str = "all") -> DataFrame:
    """Documents with all or any of the words in any column: rid."""
    terms = sorted(set(index.query_terms(words)))
    hits = index.postings.filter(F.col("term").isin(terms)).groupBy("rid").agg(F.count(F.lit(1)).alias("n"))
    return hits.filter(F.col("n") == len(terms)).drop("n") if mode == "all" else hits.drop("n")


def translate_terms(
    df: DataFrame, key: str, text: Column, dictionary: DataFrame | Mapping[str, str], keep_apostrophes: bool = False
) -> DataFrame:
    """Distinct English terms per row for the words found in a dictionary, in the order met.

    ``dictionary`` has columns ``term`` and ``english``, or is a small mapping. Result: key, english.
    """
    if isinstance(dictionary, Mapping):
        # a word table this small needs neither join nor shuffle
        out = df.select(key, english_terms(text, dictionary, keep_apostrophes).alias("english"))
        return out.filter(F.col("english") != "")
    separator = r"[^\p{L}']+" if keep_apostrophes else r"[^\p{L}]+"
    words = df.select(key, F.posexplode(F.split(F.lower(text), separator)).alias("at", "term"))
    # one row per word and text before the join: long texts repeat their words
    firsts = words.groupBy(key, "term").agg(F.min("at").alias("at"))
    english = firsts.join(dictionary, "term").groupBy(key, "english").agg(F.min("at").alias("at"))
    listed = english.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "english"))).alias("_e"))
    return listed.select(key, F.array_join(F.transform("_e", lambda e: e["english"]), " ").alias("english"))
