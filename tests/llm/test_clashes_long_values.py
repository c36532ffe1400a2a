"""Clashing column names, very long values, and lines counted on hosts of every size."""

from __future__ import annotations

import math
import random
import re
import sys
import time
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from vitrine.llm import exact_dedup, pii, quality, secrets  # noqa: E402
from vitrine.llm.spans import Cover  # noqa: E402

#: names that the operators use inside, as columns of the input
INNER = ["host", "hashes", "kept", "words_left", "base_failed", "row", "q", "of", "fresh", "verdict", "print", "h",
         "id", "sha", "_sha", "text_sha256", "again", "rid", "first", "group_size", "a.b", "m", "keep_id", "spans"]


def clashing(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, "
    schema += ", ".join(f"`{c}` string" for c in INNER)
    data = [(i, t, "en", s, len(t or ""), *[f"{c}-{i}" for c in INNER]) for i, t, s in rows]
    return spark.createDataFrame(data, schema)


LONG = " ".join(f"word{k}" for k in range(20_000))
ROWS = [(1, "one two\nshared", "h"), (2, "one  two\nshared", "h"), (2, "one  two\nshared", "h"), (3, None, "h"), (4, "", None)]
ROWS += [(None, "x y z", None), (5, LONG, "h"), (6, LONG + "\nshared", "other")]


def test_quality_stage_keeps_columns_of_any_name(spark):
    rules = quality.QualityRules(min_words=1)
    docs = clashing(spark, ROWS)
    got = quality.clean_documents(docs, rules)
    assert got.columns == docs.columns
    out = got.collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "2", "2", "5", "6", "None"]
    for r in out:
        assert [r[c] for c in INNER] == [f"{c}-{r.doc_id}" for c in INNER]
        assert r.n_chars == len(r.text)
    assert quality.clean_documents(docs.limit(0), rules).count() == 0
    assert quality.quality_report(docs).count() == len(ROWS)


def test_exact_dedup_stage_keeps_columns_of_any_name(spark):
    docs = clashing(spark, ROWS)
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "3", "5", "6", "None"]  # 2 is like 1, 4 like 3
    for r in rows:
        assert [r[c] for c in INNER] == [f"{c}-{r.doc_id}" for c in INNER]
    assert exact_dedup.drop_exact_duplicates(docs.limit(0)).count() == 0


def test_redaction_keeps_columns_of_any_name(spark):
    docs = clashing(spark, [*ROWS, (7, "to a.b@c.de", "h")])
    rows = pii.redact(docs).collect()
    assert {r.text for r in rows if r.doc_id == 7} == {"to [EMAIL]"}
    assert all([r[c] for c in INNER] == [f"{c}-{r.doc_id}" for c in INNER] for r in rows)


@pytest.mark.parametrize("size, holders, common", [(2, 2, False), (5, 3, True), (40, 3, True), (200, 9, False), (200, 10, True)])
def test_lines_are_judged_on_hosts_of_every_size(spark, size, holders, common):
    """Three texts of a small host, a twentieth of a large one; brute force is the count itself."""
    rows = [(i, f"own{i} words{i}" + ("\nmenu of the site" if i < holders else ""), "h") for i in range(size)]
    rows += [(1000 + i, "own0 words0\nmenu of the site", "h") for i in range(30)]  # copies of one text
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality_report(docs, quality.QualityRules(min_words=1)).collect()}
    for i in range(size):
        assert got[i].words_left == got[i].n_words - (4 if common and i < holders else 0)


def plain_bits(value: str, words) -> float:
    """The cost model, span by span."""
    rank = {w: i for i, w in reversed(list(enumerate(words, 1)))}
    low = value.lower()
    leet = low.translate(str.maketrans("430157$@", "aeoistsa"))
    kinds = [(str.islower, 26), (str.isupper, 26), (str.isdigit, 10), (lambda c: not c.isalnum(), 33)]
    brute = math.log2(max(10, sum(n for f, n in kinds if any(f(c) for c in value))))
    near = {a + b for row in secrets.KEYBOARD for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))}
    best = [0.0] + [math.inf] * len(value)
    for j in range(1, len(value) + 1):
        for i in range(j):
            span, k, costs = low[i:j], j - i, []
            if k == 1:
                costs.append(brute)
            if k >= 3:
                for form, extra in ((span, 0), (leet[i:j], 2)):
                    if k <= 24 and form in rank:
                        costs.append(math.log2(rank[form] + 1) + extra + (0 if value[i:j].islower() else 2) + 1)
                if len(set(span)) == 1:
                    costs.append(brute + math.log2(k) + 1)
                if all(span[x : x + 2] in near for x in range(k - 1)):
                    costs.append(math.log2(47) + 2 * math.log2(k) + 1)
            m = secrets._DATE.match(value, i)
            if m and m.end() == j:
                costs.append(math.log2(366 * 120) * min(1, k / 8) + 1)
            for w in (2, 3, 4):
                if k % w == 0 and k >= 2 * w and span == span[:w] * (k // w):
                    costs.append(w * brute + math.log2(k // w) + 1)
            best[j] = min(best[j], best[i] + min(costs, default=math.inf))
    return best[-1]


def test_guess_bits_against_every_segmentation():
    rng = random.Random(5)
    words = [*secrets.COMMON, "aaa", "abab", "qwe"]
    for _ in range(400):
        value = ""
        for _ in range(rng.randint(1, 4)):
            block = "".join(rng.choice("qwasA1$") for _ in range(rng.randint(1, 4)))
            row = rng.choice(secrets.KEYBOARD)
            value += rng.choice([rng.choice(words), block * rng.randint(1, 7), row[: rng.randint(1, 10)], "2020-10-31", "P4ss"])
        want = plain_bits(value, words)
        assert abs(secrets.guess_bits(value, words) - want) < 1e-9, value
        assert (secrets._guess_bits(value, secrets._ranks(words), 45.0) >= 45.0) == (want >= 45.0), value


def test_long_values_take_linear_time():
    find = secrets.secret_finder()
    for block in ("qwertyuiop", "ab!", "qw", "a", "kX9#vT2$pLm4Rz"):
        spent = []
        for size in (20_000, 80_000):
            value = (block * size)[:size]
            start = time.process_time()
            found = find("passphrase: " + value)
            spent.append(time.process_time() - start)
        assert spent[1] < 8 * spent[0] + 0.5, (block, spent)  # square growth would be sixteen times
        assert all(s[1:3] == (12, 12 + size) for s in found)  # one span of the whole value, if any
    many = "a.b@c.de jane (at) example (dot) org " * 4000
    start = time.process_time()
    assert len(pii.find_personal_data(many)) == 8000
    assert time.process_time() - start < 10


def test_cover_against_all_pairs():
    rng = random.Random(2)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 6)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 8)))]
        cover = Cover(spans)
        for start in range(45):
            end = start + rng.randint(1, 5)
            assert cover.meets(start, end) == any(a < end and start < b for a, b in spans)


def test_base_secrets_against_their_patterns():
    """Base spans equal a scan with the stated patterns and the length tests behind them."""
    rng = random.Random(9)
    bits = ["password", "Token", "api_key", "APIKEY", '"', "'", ":", "=", " ", "AKIA", "ABCDEF123456789XYZ", "0123456789abcdef", "x/y+z.", "ſecret"]
    stated = [
        ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    ]
    for _ in range(500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        want = [
            (kind, m.start(), m.end())
            for kind, pattern, group, least in stated
            for m in re.finditer(pattern, text, re.A)
            if len(m[group]) >= least
        ]
        got = [s[:3] for s in secrets.secret_finder()(text) if s[3]]
        assert got == sorted(want, key=lambda s: (s[1], secrets.KINDS.index(s[0]))), text
