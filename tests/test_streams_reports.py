"""The prefix scan of windows, quota verdicts event by event, and counts that come with a write."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import throttle as H
from vitrine.operators.aggregates import IngestReport
from vitrine.streaming import jobs as J


def walk(rows, max_uses, window_ms):
    out, state = {}, {}
    for k, ms, n in sorted(rows, key=lambda r: (r[1], r[2])):
        start, used = state.get(k, (None, 0))
        if start is None or ms > start + window_ms:
            start, used = ms, 0
        state[k] = (start, used + 1)
        out[n] = (start, used + 1, used + 1 <= max_uses)
    return out


def test_functions_of_hours_compose():
    rng = np.random.default_rng(4)
    for window in (1, 40, 500):
        parts = [np.unique(rng.integers(a, a + 100, 9)) for a in (0, 100, 200, 300)]
        functions = [H._transitions(t, window) for t in parts]
        whole = functions[0]
        for f in functions[1:]:
            whole = H._then(whole, f)
        left = functions[2:]
        right = H._then(H._then(functions[0], functions[1]), H._then(*left))
        for end in range(-5, 100 + window, 3):
            want = np.array([end])
            for f in functions:
                want = H._after(f, want)
            assert H._after(whole, np.array([end])) == want == H._after(right, np.array([end]))


@pytest.mark.parametrize("fan_in", [2, 3, 512])
@pytest.mark.parametrize("window", [600_000, 9 * 3_600_000])
def test_throttle_over_a_tree_of_hours(spark, monkeypatch, fan_in, window):
    monkeypatch.setattr(H, "FAN_IN", fan_in)
    rng = random.Random(fan_in)
    base = 1_704_067_200_000
    # half of all events on one key, over ten days, with gaps
    rows = [("hot" if i % 2 else f"k{i % 7}", base + rng.randrange(240) ** 2 % 240 * 3_600_000 + rng.randrange(3_600_000), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, ms long, n long").withColumn("ts", F.timestamp_millis("ms"))
    got = {r.n: (r.window_start, r.used, r.allowed) for r in H.fixed_window_throttle(df, "k", "ts", "n", 3, window).collect()}
    assert got == walk(rows, 3, window)
    assert H.fixed_window_throttle(df.limit(0), "k", "ts", "n", 3, window).count() == 0


def test_no_function_grows_with_the_log():
    times = np.arange(0, 40 * 3_600_000, 7_000)
    whole = None
    for hour in range(40):
        mine = times[(times >= hour * 3_600_000) & (times < (hour + 1) * 3_600_000)]
        f = H._reachable(H._transitions(mine, 60_000), hour * 3_600_000, 60_000)
        whole = f if whole is None else H._reachable(H._then(whole, f), 0, 60_000)
        assert len(f[0]) <= 11 and len(whole[0]) <= 11  # the distinct times of one window


def test_quota_verdicts_are_given_once(spark, tmp_path):
    previous = spark.conf.get(J.STATE_PROVIDER)
    rows = [("a", f"2024-01-0{d} 0{h}:00:00", 10 * d + h) for d in (1, 2) for h in range(4)] + [("b", "2024-01-02 05:00:00", 90)]
    late = [("a", "2024-01-02 04:30:00", 91), ("a", "2023-12-01 00:00:00", 92)]  # within the delay, and far behind it
    try:
        for part in (rows, late):
            df = spark.createDataFrame(part, "k string, at string, n long").withColumn("ts", F.to_timestamp("at")).drop("at")
            df.write.mode("append").parquet(str(tmp_path / "in"))
            stream = J.read_stream(spark, str(tmp_path / "in"), df.schema)
            J.append_to(J.stream_quota_verdicts(stream, "k", "ts", "n", 2, "6 hours"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    finally:
        spark.conf.set(J.STATE_PROVIDER, previous)
    got = {r.tie: (str(r.day), r.used, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {10 * d + h: (f"2024-01-0{d}", h + 1, h < 2) for d in (1, 2) for h in range(4)}
    assert got == want | {90: ("2024-01-02", 1, True), 91: ("2024-01-02", 5, False)}


def test_ingest_report_comes_with_the_write(spark, tmp_path):
    rows = [("met", "x", "k"), ("met", "", "k"), ("aic", "y", None), ("odd", "z", None), (None, "w", None), ("met", "v", None)]
    raw = spark.createDataFrame(rows, "source string, title string, img string")
    report = IngestReport(["met", "aic", "nga"])
    report.stored(report.kept(report.seen(raw).filter("title <> ''"))).write.parquet(str(tmp_path / "out"))
    got = {r.source: (r.seen, r.kept, r.stored, r.compacted) for r in report.rows(spark).collect()}
    assert got == {"met": (3, 2, 2, 1), "aic": (1, 1, 1, 0), None: (2, 2, 2, 0)}
