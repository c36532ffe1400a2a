"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed; for each host (here: ``source``) the distinct documents that hold a line are
counted. Lines above the limits are boilerplate and removed; a document of which too little is left is
rejected. Copies of one text count as one document, of the line and of the host: documents are told apart by a
digest of their whole normalised text, so a group of copies does not turn its own text into boilerplate. Near
copies differ in their texts and count one by one.

The input's columns travel in one struct, so none of their names can clash with a name used here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import SPACE, text_of
from vitrine.session import landed


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; a line is boilerplate if both line limits are reached within its host.

    The share decides on every host of ``line_docs / line_share`` distinct texts or more; on smaller ones the
    count keeps a line that two documents happen to share.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    line_docs: int = 3
    line_share: float = 0.05
    left_share: float = 0.2  # of the words; with less left, a document is depleted


RULES = QualityRules()

#: hosts and lines (8 bytes each, and a row for each host) up to which the boilerplate is broadcast
BROADCAST_LINES = 1_000_000


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it as often as needed in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _windows(words: Column) -> Column:
    """Hashes of the three-word windows, in order."""
    return F.when(
        F.size(words) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows found twice or more.

    Windows are sorted by (hash, position); neighbours with equal hashes repeat. Of the sorted positions of
    those, each adds the words which the one before it does not cover. Texts without a repeat skip all that.
    """

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        again = _let(
            pairs,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"]))
                        | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])),
                    ),
                    lambda x: x["p"],
                )
            ),
        )
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(
            again,
            start,
            lambda a, p: F.struct(
                (a["n"] + F.least(p - a["last"], F.lit(3))).cast("bigint").alias("n"), p.alias("last")
            ),
            lambda a: a["n"],
        )

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
        covered(hashes)
    )


def _line_key(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def _lines(text: Column) -> Column:
    """Lines that have a word, as structs of the hash of the normalised line and its number of words."""
    keys = F.filter(F.transform(F.split(text, "\n"), _line_key), lambda k: k != "")
    return F.transform(
        keys, lambda k: F.struct(F.xxhash64(k).alias("h"), F.size(F.split(k, " ")).cast("bigint").alias("w"))
    )


def _duplicate_lines(text: Column) -> Column:
    return _let(
        F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != ""),
        lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
    )


def profile(docs: DataFrame, keep: list[str], text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(row, host, q): the ``keep`` columns in one struct, the host, and the base counts, the lines' hashes and
    the text's digest, in one pass over the texts."""
    text = text_of(text_col)
    # the array is bound by _let, so that no expression is worked out per element
    measured = _let(
        _words(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.coalesce(F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)), F.lit(0)).alias(
                "word_chars"
            ),
            _let(
                _windows(w),
                lambda h: F.struct(_repeat_words(h).alias("n_repeat_words")),
            ).alias("windows"),
        ),
    )
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.col(host_col).alias("host"),
        F.struct(
            measured.alias("m"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
            _duplicate_lines(text).alias("n_dup_lines"),
            _lines(text).alias("lines"),
            F.unhex(F.md5(_line_key(text))).alias("print"),
        ).alias("q"),
    )


def boilerplate(profiled: DataFrame, rules: QualityRules = RULES) -> DataFrame:
    """(host, hashes): the lines of each host that reach both limits; both count distinct texts.

    A host has at most ``lines per document / line_share`` such lines, so the array does not grow with the host.
    """
    lines = profiled.select("host", F.col("q.print").alias("print"), F.explode(F.array_distinct("q.lines.h")).alias("h"))
    counts = lines.distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs"))
    texts = profiled.select(F.col("host").alias("of"), F.col("q.print").alias("print")).distinct()
    hosts = texts.groupBy("of").agg(F.count(F.lit(1)).alias("host_docs"))
    common = counts.where(F.col("docs") >= rules.line_docs)
    kept = common.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(
        F.col("docs") >= F.lit(rules.line_share) * F.col("host_docs")
    )
    return kept.groupBy("host").agg(F.collect_list("h").alias("hashes"))


def judged(profiled: DataFrame, rules: QualityRules = RULES) -> DataFrame:
    """A landed profile with ``hashes`` and ``verdict``: base_failed, words_left without boilerplate, kept."""
    found = landed(boilerplate(profiled, rules), "boilerplate")
    size = found.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    common = found.withColumnRenamed("host", "of")
    if size <= BROADCAST_LINES:
        common = F.broadcast(common)
    both = profiled.join(common, F.col("host").eqNullSafe(F.col("of")), "left").select(
        "row", "q", F.coalesce("hashes", F.array().cast("array<bigint>")).alias("hashes")
    )
    m = F.col("q.m")
    gone = F.when(F.size("hashes") == 0, F.lit(0).cast("bigint")).otherwise(
        F.aggregate(
            F.col("q.lines"),
            F.lit(0).cast("bigint"),
            lambda a, x: a + F.when(F.array_contains(F.col("hashes"), x["h"]), x["w"]).otherwise(0),
        )
    )
    failed = (m["n_words"] < rules.min_words) | (
        100 * m["windows"]["n_repeat_words"] > rules.max_repeat_percent * m["n_words"]
    )
    left = both.withColumns({"words_left": m["n_words"] - gone, "base_failed": failed})
    kept = ~F.col("base_failed") & (F.col("words_left") >= F.lit(rules.left_share) * m["n_words"])
    verdict = F.struct("base_failed", "words_left", kept.alias("kept"))
    return left.select("row", "q", "hashes", verdict.alias("verdict"))


def quality_report(
    docs: DataFrame,
    rules: QualityRules = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, words_left and kept.

    A null text has no words and fails the base rules; a null host is a host of its own; ids may be null or
    repeated, as rows are never joined by id. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), F.col(host_col).alias("_h"))
    done = judged(landed(profile(rows, ["doc_id"], "_t", "_h"), "profile"), rules)
    return done.select(
        "row.doc_id",
        "q.m.n_words",
        "q.m.word_chars",
        "q.n_symbols",
        "q.n_dup_lines",
        "q.m.windows.n_repeat_words",
        "verdict.base_failed",
        "verdict.kept",
        "verdict.words_left",
    )


def clean_documents(docs: DataFrame, rules: QualityRules = RULES) -> DataFrame:
    """The documents that pass, without the lines above the limits; ``n_chars`` is counted anew.

    All columns of ``docs`` stay as they are, whatever their names. Lines are removed from kept documents only;
    a text without such lines is left byte for byte. Null texts go, as they fail the base rules.
    """
    done = judged(landed(profile(docs, list(docs.columns)), "profile"), rules).where("verdict.kept")
    text = F.col("row.text")
    left = F.array_join(
        F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("hashes"), F.xxhash64(_line_key(x)))),
        "\n",
    )
    done = done.withColumn("fresh", F.when(F.col("verdict.words_left") < F.col("q.m.n_words"), left).otherwise(text))
    fresh = {"text": F.col("fresh"), "n_chars": F.length("fresh").cast("bigint")}
    return done.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
