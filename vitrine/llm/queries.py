"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import (
    exact_dedup,
    extraction,
    hard_negatives,
    minhash,
    packing,
    pii,
    quality,
    secrets,
    sentencepieces,
    token_counts,
    toxicity,
    warc,
    whitening,
)
from vitrine.llm.common import table
from vitrine.llm.spans import count_base, joined

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


def _span_result(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return found.select(
        "doc_id",
        *[count_base(F.col("spans"), k).alias(f"n_{k}") for k in kinds],
        F.sha2(joined(F.col("spans"), base_only=True), 256).alias("base_sha256"),
        joined(F.col("spans"), base_only=False).alias("spans"),
    )


@query()
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = minhash.NearRules(words=4, percent=80)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), rules).drop("class_id")


@query(r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query()
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_result(secrets.secrets(table(spark, sf_dir, "documents").select("doc_id", "text")), secrets.KINDS[:3])


@query()
def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_result(pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")), pii.KINDS)


@query(r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs)
), sizes AS (
  SELECT r, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM words GROUP BY r
), windows AS (
  SELECT r, i, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w AS three
  FROM words WINDOW w AS (PARTITION BY r ORDER BY i)
), again AS (
  SELECT r, i FROM windows WHERE three IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, three) > 1
), repeats AS (
  SELECT r, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) v(d) GROUP BY r
), lines AS (
  SELECT r, source, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS k
  FROM (SELECT r, source, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), prints AS (
  SELECT r, source, md5(lower(trim(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g')))) AS p FROM docs
), hosts AS (
  SELECT source, count(DISTINCT p) AS n FROM prints GROUP BY source
), common AS (
  SELECT l.source, k FROM lines l JOIN prints USING (r) JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, k, h.n HAVING count(DISTINCT p) >= 3 AND count(DISTINCT p) >= 0.05 * h.n
), gone AS (
  SELECT r, sum(len(string_split(l.k, ' '))) AS n
  FROM lines l JOIN common c ON l.k = c.k AND l.source IS NOT DISTINCT FROM c.source GROUP BY r
), dups AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r
), counted AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines,
         coalesce(a.n, 0) AS n_repeat_words, coalesce(n_words, 0) - CAST(coalesce(g.n, 0) AS BIGINT) AS words_left
  FROM docs LEFT JOIN sizes USING (r) LEFT JOIN repeats a USING (r) LEFT JOIN gone g USING (r) LEFT JOIN dups d USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_left >= 0.2 * n_words AS kept
FROM counted
""")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


@query()
def op1_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query()
def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    counts = extraction.train(*extraction.labelled_pages(pages, table(spark, sf_dir, "documents")))
    found = extraction.main_text(pages, counts)
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query()
def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 2, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query()
def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query()
def op5_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encoding_report(table(spark, sf_dir, "documents"))


@query(r"""
WITH usable AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
), scored AS (
  SELECT a.id AS anchor_id, r.id, r.label = a.label AS same, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM usable a JOIN usable r ON a.id % 100 = 0 AND a.id <> r.id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), inside AS (
  SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score
FROM inside WHERE rank <= 10
""")
def op11_secondary_sort_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    seven = F.col("vec_id") % 7 == 0
    label = F.when(seven, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, label=label)


@query()
def op12_bidiagonal_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query()
def op13_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path(token_counts.MODEL)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), model)
