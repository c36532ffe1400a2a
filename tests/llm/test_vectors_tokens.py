"""Hard negatives, whitening and token counts against brute force."""

from __future__ import annotations

import random
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from vitrine.llm import bidiagonal, hard_negatives, token_counts, vectors, whitening  # noqa: E402

ROWS = "vec_id long, label int, embedding array<float>, id string, key string, cell int, positives string, n string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3, "z", "w") for r in rows], ROWS)


def _vectors(n, width, seed, hot=0):
    rng = random.Random(seed)
    same = [rng.uniform(-1, 1) for _ in range(width)]
    out = [(i, rng.randrange(4), same if i % 3 == 0 and hot else [rng.uniform(-1, 1) for _ in range(width)]) for i in range(n)]
    return out


ODD = [
    (900, None, [0.1, 0.2, 0.3]), (901, 1, None), (902, 1, [0.1, None, 0.3]), (903, 1, [float("nan"), 0.0, 0.0]),
    (904, 2, [float("inf"), 0.0, 0.0]), (None, 1, [0.1, 0.1, 0.1]),
]


def _negatives_by_force(rows, rules, every=10):
    kept = [
        (i, lab, np.array([int(np.floor(rules.scale * float(np.float32(c)))) for c in v], object))
        for i, lab, v in rows
        if i is not None and lab is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)
    ]
    anchors = {}
    for i, lab, v in sorted(kept, key=lambda r: (r[0], r[1], list(r[2]))):
        if i % every == 0:
            anchors.setdefault(i, (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        ranked = sorted((-int(v @ w), i, other) for i, other, w in kept if i != a)
        positives = [(-s, i) for s, i, other in ranked if other == lab][: rules.positives]
        for score, i in positives:
            inside = [
                (-s, j) for s, j, other in ranked
                if other != lab and rules.low * score <= -100 * s and -100 * s <= rules.high * score
            ]
            out += [(a, i, r, j, score, s) for r, (s, j) in enumerate(inside[: rules.negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("hot", [0, 1])
def test_hard_negatives_equal_brute_force(spark, hot):
    rows = _vectors(300, 3, 5, hot) + ODD
    rules = hard_negatives.HardNegativeRules(cell_anchors=7, cell_rows=64)  # several blocks on both sides
    got = hard_negatives.hard_negatives(_table(spark, rows).repartition(5), F.col("vec_id") % 10 == 0, rules)
    assert sorted(map(tuple, got.collect())) == _negatives_by_force(rows, rules)


def test_hard_negatives_with_zero_scores_repeats_and_empty(spark):
    rules = hard_negatives.HardNegativeRules(positives=2, negatives=2)
    # scores of 0: negatives with a smaller id come before the positive and still count
    rows = [(i, i % 2, [0.0, 1.0] if i else [1.0, 0.0]) for i in range(8)] + [(10, 0, [1.0, 1.0]), (10, 1, [1.0, 1.0]), (11, 0, [0.5, 0.5]), (11, 0, [0.5, 0.5])]
    got = hard_negatives.hard_negatives(_table(spark, rows), F.col("vec_id") % 10 == 0, rules)
    assert sorted(map(tuple, got.collect())) == _negatives_by_force(rows, rules)
    empty = hard_negatives.hard_negatives(_table(spark, rows).limit(0), F.lit(True), rules)
    assert empty.count() == 0 and empty.columns[0] == "anchor_id"
    assert hard_negatives.hard_negatives(_table(spark, rows), F.lit(False), rules).count() == 0


def test_packed_keys_keep_the_order():
    rng = random.Random(3)
    rows = [(rng.randint(-(2**63), 2**63 - 1), rng.choice([0, -1, 1, rng.randint(-(2**62), 2**62)]), rng.randint(0, 1), rng.randint(-5, 5)) for _ in range(500)]
    keys = [hard_negatives.pack(a, np.array([s]), role, np.array([i])).tobytes() for a, s, role, i in rows]
    assert [r for _, r in sorted(zip(keys, rows, strict=True))] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))
    assert list(zip(*hard_negatives.unpack(keys), strict=True)) == rows


def test_large_scores_stay_exact():
    left, right = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**30, 1.0], [2.0**40, 0.0]])
    got = hard_negatives.products(left, right)
    assert got.tolist() == [[(2**40 + 1) * 2**30 + 3 if (2**40 + 1) * 2**30 + 3 < 2**63 else 2**63 - 1, 2**63 - 1]]


def test_singular_values_and_vectors():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(80, 12)))
    w, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    dependent = rng.normal(size=(50, 12))
    dependent[:, 3], dependent[:, 5] = 0, dependent[:, 6]
    cases = [rng.normal(size=(60, 12)), rng.normal(size=(60, 12)) * np.logspace(0, -9, 12), q * np.repeat([3, 2, 2 + 1e-10, 1], 3) @ w,
             dependent, np.zeros((3, 12)), np.ones((9, 12)), rng.normal(size=(4, 12)), rng.normal(size=(60, 12)) * 1e-140]
    for a in cases:
        values, z = bidiagonal.leading(whitening.triangle(a), 12)
        want = np.zeros(12)
        s = np.linalg.svd(a, compute_uv=False)
        want[: len(s)] = s**2
        top = max(want[0], 1e-300)
        assert np.abs(values - want).max() <= 1e-12 * top
        assert np.abs(z.T @ z - np.eye(12)).max() < 1e-12
        assert np.abs(a.T @ (a @ z) - z * values).max() <= 1e-12 * top


def _whitened_by_force(rows, k):
    kept = [(i, v) for i, _, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    off = np.array([[n * c - s for c, s in zip(r, sums, strict=True)] for r in x], object)
    centred = (off / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return {(i, j): (n, sum(v * v for v in o), (c @ u[:, j]) / np.sqrt(e[j]), e[j] / e.sum())
            for (i, _), o, c in zip(kept, off, centred, strict=True) for j in range(min(k, len(e)))}


def test_whitening_equals_eigenvectors(spark):
    rows = _vectors(200, 3, 9) + ODD[:-1]
    got = whitening.whiten(_table(spark, rows).repartition(40)).collect()  # more partitions than one merge takes
    want = _whitened_by_force(rows, 8)
    assert len(got) == len(want)
    signs = defaultdict(set)
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id, r.component - 1]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - abs(whitened)) < 1e-9 and abs(r.explained / explained - 1) < 1e-9 and r.identity_error < 1e-9
        if abs(whitened) > 1e-6:
            signs[r.component].add(r.whitened * whitened > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_degenerate_tables(spark):
    assert whitening.whiten(_table(spark, [(1, 1, [1.0])]).limit(0)).count() == 0
    one = whitening.whiten(_table(spark, [(1, 1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, 1, 0, None, 0.0, None) for c in (1, 2)]
    # a constant dimension, a shorter vector, an id twice, no id
    rows = [(1, 1, [0.5, 7.0]), (1, 1, [-0.5, 7.0]), (None, 1, [1.5, 7.0]), (4, 1, [0.25, 7.0])]
    got = whitening.whiten(_table(spark, rows)).collect()
    assert len(got) == 8 and all((r.whitened is None) == (r.component == 2) for r in got)
    # entries that no long holds after squaring
    huge = whitening.whiten(_table(spark, [(1, 1, [1e15, 0.0]), (2, 1, [-1e15, 1.0]), (3, 1, [0.0, 5.0])])).collect()
    assert len(huge) == 6 and all(r.deviation is None or r.deviation >= 0 for r in huge)


def test_usable_vectors(spark):
    df = _table(spark, ODD + [(1, 1, [1.0]), (2, 1, [])]).select("vec_id", vectors.usable("embedding").alias("ok"))
    assert {r.vec_id for r in df.collect() if r.ok} == {900, None, 1, 2}


tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizers.path(token_counts.MODEL))


def _texts():
    rng = random.Random(11)
    machine = token_counts.transducer(tokenizers.path(token_counts.MODEL))
    pieces = sorted(machine.model.score)
    out = ["", " ", "  a  b ", "\n\t\r\x00", "<s> </s><unk> <0x0A>", "▁", "a" * 70, "é漢字𝄞", "aaab" * 50]
    for n in range(400):
        kind = n % 3
        if kind == 0:
            out.append("".join(rng.choice(pieces) for _ in range(rng.randint(1, 10))))
        elif kind == 1:
            out.append("".join(rng.choice("aab ▁\n\teé漢𝄞-=") for _ in range(rng.randint(0, 40))))
        else:
            out.append("".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0x80, 0x2FFF), rng.randint(0x1F300, 0x1F700)])) for _ in range(20)))
    return out


def test_transducer_counts_and_maps(library):
    machine = token_counts.Transducer(token_counts.PieceModel(tokenizers.path(token_counts.MODEL)), keep=500)  # forgets often
    rng = random.Random(2)
    for text in _texts():
        want = len(library.encode(text))
        assert machine.tokens(text) == want, repr(text)
        whole = machine.prefixed(text) if text else ""
        step = rng.randint(1, 9)
        maps = [machine.chunk_map(whole[at : at + step]) for at in range(0, len(whole), step)]
        while len(maps) > 1:
            maps = [machine.composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        assert (machine.applied(maps[0]) if maps else 0) == want, repr(text)


def test_token_counts_on_spark(spark, library):
    texts = [*_texts(), None, "word " * 30_000, "x" * 100_000]
    rows = [(i if i != 3 else None, t, "a", 1, 2) for i, t in enumerate(texts)] + [(7, "again", "a", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, head string, rid int, n_tokens int").repartition(6)
    got = token_counts.token_counts(docs, tokenizers.path(token_counts.MODEL), limit=100, chunk=50)
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for i, t, *_ in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(docs.limit(0), tokenizers.path(token_counts.MODEL)).count() == 0


def test_other_model_kinds_are_refused(tmp_path):
    pytest.importorskip("sentencepiece")
    raw = Path(tokenizers.path(token_counts.MODEL)).read_bytes()
    path = tmp_path / "other.model"
    path.write_bytes(raw + b"\x1a\x02\x20\x01")  # a second normaliser record: extra white space removed
    with pytest.raises(ValueError, match="spaces kept"):
        token_counts.PieceModel(str(path))


def test_toxicity_learns_from_few_labels(spark):
    """Unrelated texts share common words; telling words are still found, those of one copied text are not."""
    from vitrine.llm import toxicity

    rng = random.Random(6)
    common = "the and are with from this that".split()
    own = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400)]

    def text(extra=()):
        words = [rng.choice(common if rng.random() < 0.4 else own) for _ in range(40)] + list(extra)
        rng.shuffle(words)
        return " ".join(words)

    copied = text(["copyword"])
    rows = [(i, text(["scoundrel"] if i % 2 else ["wretch"]), 1) for i in range(0, 40)]
    rows += [(i, copied + f" n{i}", 1) for i in range(40, 80)]
    rows += [(i, text(), 0) for i in range(80, 400)] + [(400, None, 1), (401, "", 0), (402, "scoundrel", None), (None, "x y", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert {"scoundrel", "wretch"} <= set(model.words) and "copyword" not in model.words and not set(common) & set(model.words)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(scored[i] for i in range(40)) >= 0.3 > max(scored[i] for i in range(80, 400))
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), labels.limit(0)).words == {}
