"""Quota verdicts ask for state by bucket and day, however many keys and events there are."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from vitrine.streaming import jobs as J

DAY = J.DailyQuota.DAY_MS


class Kept:
    """Map state in memory that counts its calls."""

    def __init__(self):
        self.values, self.calls, self.timers = {}, 0, []

    def getMapState(self, *_):
        return self

    def containsKey(self, k):
        self.calls += 1
        return k in self.values

    def getValue(self, k):
        self.calls += 1
        return self.values.get(k)

    def updateValue(self, k, v):
        self.calls += 1
        self.values[k] = v

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def judged(rows, cap):
    seen, out = {}, {}
    for k, ms, n in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k, ms // DAY] = seen.get((k, ms // DAY), 0) + 1
        out[n] = (seen[k, ms // DAY], seen[k, ms // DAY] <= cap)
    return out


@pytest.mark.parametrize("keyed", [True, False])
def test_state_calls_do_not_grow_with_keys(spark, keyed):
    rng, state = random.Random(5), Kept()
    quota = J.DailyQuota(2, "bigint")
    quota.init(state)
    # the second trigger comes after the first in time, so one walk over both gives the same
    rows = [(2**60 + rng.randrange(400) if keyed else None, t * DAY // 2 + rng.randrange(DAY // 2), t * 5000 + i) for t in (0, 1, 2) for i in range(5000)]
    got = {}
    for trigger in (0, 1, 2):
        mine = pd.DataFrame([r for r in rows if r[2] // 5000 == trigger], columns=["event_key", "event_ms", "event_tie"])
        parts = [mine.iloc[:1000], mine.iloc[1000:]]
        for out in quota.handleInputRows((7 if keyed else J.NO_KEY,), iter(parts), None):
            got |= {r.tie: (r.used, r.allowed) for r in out.itertuples()}
    assert got == judged(rows, 2)
    assert state.calls <= 12 and state.timers == [DAY, 2 * DAY]


def test_keys_of_a_bucket_and_missing_keys(spark, tmp_path):
    previous = spark.conf.get(J.STATE_PROVIDER)
    rng = random.Random(6)
    rows = [(None if i % 9 == 0 else 2**60 + rng.randrange(40), 1_704_067_200_000 + (i // 300) * 7_200_000 + rng.randrange(7_200_000), i) for i in range(900)]
    try:
        for landing in range(3):
            df = spark.createDataFrame([r for r in rows if r[2] // 300 == landing], "k long, ms long, n long").selectExpr("k", "timestamp_millis(ms) ts", "n")
            df.write.mode("append").parquet(str(tmp_path / "in"))
            stream = J.read_stream(spark, str(tmp_path / "in"), df.schema)
            J.append_to(J.stream_quota_verdicts(stream, "k", "ts", "n", 3, buckets=4), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    finally:
        spark.conf.set(J.STATE_PROVIDER, previous)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.tie: (r.used, r.allowed) for r in out} == judged(rows, 3)
    assert {r.tie: r.key for r in out} == {n: k for k, _, n in rows}
