"""Python functions on texts get batches that are limited by bytes, so a worker's memory does not follow the rows' length."""

from __future__ import annotations

import tracemalloc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitrine.llm import minhash, packing, pii

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def _largest_batch(docs) -> tuple[int, int]:
    """Bytes of the largest batch of a table function, and of the largest of a column function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    @F.arrow_udf("long")
    def size(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    return (
        docs.mapInArrow(run, "n long").agg(F.max("n")).first()[0],
        docs.select(size("text").alias("n")).agg(F.max("n")).first()[0],
    )


@pytest.mark.parametrize("operator", [minhash.near_duplicates, packing.pack, pii.personal_data, pii.redact])
def test_operators_bound_their_batches(spark, operator):
    few = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    long = spark.range(2000, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text")
    )
    before = spark.conf.get(LIMIT, None)
    spark.conf.unset(LIMIT)
    try:
        operator(few)
        assert max(_largest_batch(long)) < 6 << 20
        spark.conf.set(LIMIT, "1000000")
        operator(few)
        assert spark.conf.get(LIMIT) == "1000000"  # what the session names stays
        assert max(_largest_batch(long)) < 2 << 20
    finally:
        spark.conf.unset(LIMIT) if before is None else spark.conf.set(LIMIT, before)


def test_many_short_texts_are_hashed_in_little_memory():
    texts = [" ".join(f"w{i * j % 997}" for j in range(300 + i % 7)) for i in range(2000)]
    texts[5], texts[6], texts[7] = "", None, "langes Wört " * 60_000
    column = pa.array(texts, pa.string())
    tracemalloc.start()
    short = column.slice(8)
    for _ in minhash.text_words(short):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    for text, words in zip(texts, minhash.text_words(column), strict=True):
        assert np.array_equal(words, minhash._words_of((text or "").encode()))
