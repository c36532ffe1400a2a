"""Toxicity by a weighted finite-state pattern grammar.

Small transducers read the classes of a clause's words: one finds insults and threats with their weights, the
others follow targets, negation and reported speech and change those weights. Their composition gives scores
per clause, not per word. The insult lexicon (words and word beginnings with weights) is learned from one part
of the labelled rows, the weights of the clause features by logistic regression from another.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import let
from vitrine.llm.common import text_of
from vitrine.session import landed

# Function words of the grammar in English, German, French and Spanish.
TARGETS = frozenset("you your yours yourself they them he she him her du dich dir dein deine sie ihr euch tu toi te "
                    "ton ta vous votre tú ti usted ustedes vosotros".split())  # fmt: skip
NEGATIONS = frozenset("not no never none isn't aren't don't nicht kein keine nie pas jamais aucun nunca jamás ni".split())
REPORTS = frozenset("said says say called calls wrote quoted claimed reportedly sagte schrieb nannte dit écrit dijo "
                    "escribió llamó".split())  # fmt: skip
THREATS = frozenset("kill murder shoot stab strangle hurt töten umbringen tuer frapper matar golpear".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# Each transducer: state -> class -> (next state, factor on the weight of the word read).
Transducer = dict[int, dict[int, tuple[int, float]]]


def _machine(trigger: int, span: int, factor: float) -> Transducer:
    """After ``trigger``, for ``span`` more words, weights are multiplied by ``factor``."""
    table: Transducer = {0: {c: (span if c == trigger else 0, 1.0) for c in range(6)}}
    for left in range(1, span + 1):
        table[left] = {c: (span if c == trigger else left - 1, factor) for c in range(6)}
    return table


TARGETED = _machine(TARGET, 6, 1.5)
NEGATED = _machine(NEGATION, 3, 0.4)
REPORTED = _machine(REPORT, 12, 0.6)


def composed(*machines: Transducer) -> dict[tuple[int, ...], dict[int, tuple[tuple[int, ...], float]]]:
    """The product of transducers: states side by side, factors multiplied; only reachable states."""
    start = (0,) * len(machines)
    table: dict = {}
    todo = [start]
    while todo:
        state = todo.pop()
        if state in table:
            continue
        table[state] = {}
        for c in range(6):
            steps = [m[s][c] for m, s in zip(machines, state, strict=True)]
            table[state][c] = (tuple(x[0] for x in steps), math.prod(x[1] for x in steps))
            todo.append(table[state][c][0])
    return table


GRAMMAR = composed(TARGETED, NEGATED, REPORTED)
_START = (0, 0, 0)
_CLAUSE = re.compile(r"[^.!?;:\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
FEATURES = 7


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [-2.0] + [0.0] * FEATURES)


class Scorer:
    """Clause features of texts under a lexicon; one per task."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.lengths = sorted({len(x) for x in model.starts}, reverse=True)
        self.automaton = ahocorasick.Automaton()
        for w in (*model.words, *model.starts, *THREATS):
            self.automaton.add_word(w, len(w))
        self.automaton.make_automaton()

    def _weight(self, word: str) -> float:
        got = self.model.words.get(word, 0.0)
        for n in self.lengths:
            if word[:n] in self.model.starts:
                return max(got, self.model.starts[word[:n]])
        return got

    def features(self, text: str) -> list[float]:
        low = text.lower()
        for end, n in self.automaton.iter(low):
            if end - n < 0 or not low[end - n].isalpha():
                return self._clauses(low)
        return [0.0] * FEATURES

    def _clauses(self, low: str) -> list[float]:
        scores, hits, threats, words, seen = [], 0, 0.0, 0, set()
        for clause in _CLAUSE.finditer(low):
            state, score, target = _START, 0.0, False
            for m in _TOKEN.finditer(clause[0]):
                w = m[0]
                words += 1
                weight = self._weight(w)
                kind = (INSULT if weight > 0 else THREAT if w in THREATS else TARGET if w in TARGETS
                        else NEGATION if w in NEGATIONS else REPORT if w in REPORTS else OTHER)
                target |= kind == TARGET
                state, factor = GRAMMAR[state][kind]
                if kind == INSULT:
                    score += weight * factor
                    hits += 1
                    seen.add(w)
                elif kind == THREAT and target:
                    threats += factor
            scores.append(score)
        top = max(scores, default=0.0)
        return [
            float(hits > 0),
            math.log1p(hits),
            math.log1p(sum(scores)),
            math.log1p(top),
            float(len(seen) > 1),
            math.log1p(threats),
            1000 * hits / (1000 + words),
        ]

    def score(self, text: str) -> float:
        w = self.model.weights
        z = w[0] + sum(a * b for a, b in zip(w[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# -- training --------------------------------------------------------------------------------------------


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


#: forms that may be taken for telling by chance, over the whole lexicon
BY_CHANCE = 0.05


def _fingerprint(words: Column) -> Column:
    """Smallest hash of three words in a row: near copies share it, texts that only share common words do not."""

    def least(w: Column) -> Column:
        windows = F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1)))
        return F.array_min(F.transform(windows, lambda i: F.xxhash64(F.array_join(F.slice(w, i, 3), " "))))

    return let(words, least)


def _lexicon(rows: DataFrame, entries: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings that tell toxic rows: at most ``entries`` of each.

    Rows count by the distinct fingerprints among them, so that copies of one text do not turn its ordinary words into
    evidence; a form's counts are small sketches that combine before the shuffle. A form is telling when its share of
    toxic rows is so far above that of all rows that, by Chernoff's bound and over all forms tested, fewer than
    ``BY_CHANCE`` would be by chance. Few labels therefore give a short lexicon, and too few none; weights are smoothed log
    ratios.
    """
    all_words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    base = rows.select("toxic", all_words.alias("all"))
    base = base.select("toxic", F.array_distinct("all").alias("words"), _fingerprint(F.col("all")).alias("print"))
    bad, good = (F.when(F.col("toxic") == label, F.col("print")) for label in (1, 0))
    forms = base.select("toxic", "print", F.explode("words").alias("w")).where("length(w) >= 3")
    starts = F.array(*[F.when(F.length("w") > n, F.substring("w", 1, n)) for n in (4, 5, 6)])
    form = F.explode(
        F.concat(
            F.array(F.struct(F.lit(False).alias("start"), F.col("w").alias("form"))),
            F.transform(starts, lambda s: F.struct(F.lit(True).alias("start"), s.alias("form"))),
        )
    )

    met = [F.approx_count_distinct(c, 0.1).alias(n) for c, n in ((bad, "bad"), (good, "good"))]
    counts = forms.select("toxic", "print", form.alias("f")).where("f.form IS NOT NULL").groupBy("f.start", "f.form").agg(*met)
    counts = landed(counts, "forms")
    totals = base.agg(F.count_distinct(bad).alias("bad"), F.count_distinct(good).alias("good")).first()
    tested = counts.where("bad > 0").count()
    if not totals["bad"] or not totals["good"] or not tested:
        return {}, {}
    share = totals["bad"] / (totals["bad"] + totals["good"])
    n, part = F.col("bad") + F.col("good"), F.col("bad") / (F.col("bad") + F.col("good"))
    apart = part * F.log(part / share) + F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - share))).otherwise(0.0)
    weight = F.log((F.col("bad") + 0.5) / (totals["bad"] + 1)) - F.log((F.col("good") + 0.5) / (totals["good"] + 1))
    scored = counts.where((part > share) & (n * apart > math.log(tested / BY_CHANCE))).withColumn("weight", weight).where("weight > 1.5")
    out: tuple[dict[str, float], dict[str, float]] = ({}, {})
    for start in (False, True):
        top = scored.where(F.col("start") == start).orderBy(F.desc("weight"), "form").limit(entries)
        out[start].update({r["form"]: r["weight"] for r in top.select("form", "weight").collect()})
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    w[0] = math.log((y.sum() + 1) / (len(y) - y.sum() + 9))
    keep = ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-3

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((np.logaddexp(0.0, z) - y * z).sum() + 0.5 * v @ keep @ v)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:  # a full Newton step can overshoot
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000, entries: int = 400) -> Model:
    """A model from at most about ``rows`` labelled documents whose fold is not 2.

    The sample is every labelled id whose hash is below the share that ``rows`` is of all labelled ids. Folds 0
    and 1 give the lexicon, fold 3 the weights. Without labels of both kinds every text scores the prior.
    """
    marked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "toxic")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(fold(F.col("doc_id")) != 2)
    share = min(1.0, rows / max(1, marked.count()))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    sample = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(landed(chosen, "labels")), "doc_id")
    sample = landed(sample, "labelled")  # bounded by ``rows``
    words, starts = _lexicon(sample.where(fold(F.col("doc_id")) != 3), entries)
    model = Model(words, starts)
    seen = feature_rows(sample.where(fold(F.col("doc_id")) == 3), model).toPandas()
    if len(seen) and 0 < seen["toxic"].sum() < len(seen):
        model.weights = _logistic(np.vstack(seen["features"].to_numpy()), seen["toxic"].to_numpy(float))
    return model


def feature_rows(rows: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            x = [scorer.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "features"]
            )

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, features array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row of ``docs``; a null or empty text has the score of a text without any pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())],
                                             names=["doc_id", "score"])

    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(run, "doc_id long, score double")
