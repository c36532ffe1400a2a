"""Fixed-window throttle over a log of events, without walking a key in one task.

A window opens at the first event of a key after the previous window has run out, so
windows follow from each other. The log is cut into hours: each hour is first reduced to a
function, "when the running window ends here, it ends there afterwards". Functions of
neighbouring hours compose, so a parallel prefix scan finds the window that runs into each
hour: up a tree of ``FAN_IN`` hours a node, and down again. Then every hour finds its own windows.
Times are milliseconds, and equal times of a key count once, so an hour holds at most
3.6 million numbers however many events a key has. A function only has to know windows that
were open when its hours began, so its size is bounded by the window, not by the log.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vitrine.operators.ranking import bucket_rank
from vitrine.session import landed

CHUNK_MS = 3_600_000
FAN_IN = 1024
NEVER = -(1 << 62)


def _next_window(times: np.ndarray, window_ms: int) -> np.ndarray:
    """Index of the event that opens the window after the one opened by each event."""
    return np.searchsorted(times, times + window_ms, side="right")


def _transitions(times: np.ndarray, window_ms: int) -> tuple[np.ndarray, np.ndarray]:
    """Breakpoints r and the end of the running window after the hour; -1 stands for "unchanged"."""
    n = len(times)
    if n == 1:  # most hours of most keys
        return np.array([NEVER, times[0]]), np.array([times[0] + window_ms, -1])
    last = np.arange(n + 1)
    jump = np.append(_next_window(times, window_ms), n)
    # pointer doubling: the last opening reached from each event
    while True:
        ahead = jump[last]
        more = ahead < n
        if not more.any():
            break
        last = np.where(more, ahead, last)
    ends = np.append(times[last[:n]] + window_ms, -1)
    starts = np.concatenate([[NEVER], times])
    keep = np.append(True, ends[1:] != ends[:-1])
    return starts[keep], ends[keep]


def _reachable(f: tuple[np.ndarray, np.ndarray], start_ms: int, window_ms: int, latest: int = NEVER) -> tuple[np.ndarray, np.ndarray]:
    """The part of a function that windows opened before ``start_ms``, or a window that ends at ``latest``, can reach."""
    if len(f[0]) <= 2:
        return f
    n = int(np.searchsorted(f[0], max(start_ms + window_ms, latest), side="right"))
    return f[0][:n], f[1][:n]


def _after(f: tuple[np.ndarray, np.ndarray], ends: np.ndarray) -> np.ndarray:
    """End of the window behind the hours of ``f``, for each end before them."""
    found = f[1][np.searchsorted(f[0], ends, side="right") - 1]
    return np.where(found == -1, ends, found)


def _then(f: tuple[np.ndarray, np.ndarray], g: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The function of the hours of ``f`` followed by those of ``g``."""
    starts, ends = f[0], np.where(f[1] == -1, -1, _after(g, f[1]))
    if f[1][-1] == -1:
        # what f leaves as it is meets g as it came
        k = int(np.searchsorted(g[0], starts[-1], side="right")) - 1
        starts = np.concatenate([starts, g[0][k + 1 :]])
        ends = np.concatenate([ends[:-1], g[1][k:]])
    keep = np.append(True, ends[1:] != ends[:-1])
    return starts[keep], ends[keep]


def _function(hour) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(hour["_from"], dtype=np.int64), np.asarray(hour["_end"], dtype=np.int64)


def _chain(hours, end: int) -> list[int]:
    """End of the running window at the start of each hour, from the end of the window before the first."""
    carried = []
    for hour in hours:
        carried.append(int(end))
        after = int(hour["_end"][bisect_right(hour["_from"], end) - 1])
        end = end if after == -1 else after
    return carried


def _openings(times: np.ndarray, carry: int, window_ms: int) -> list[int]:
    """Windows that touch an hour: the one running at its start and the ones opened in it."""
    if len(times) == 1:
        fresh = [int(times[0])] if times[0] > carry else []
        return fresh if carry == NEVER else [carry - window_ms, *fresh]
    jump = _next_window(times, window_ms)
    at = int(np.searchsorted(times, carry, side="right"))
    found = [] if carry == NEVER else [carry - window_ms]
    while at < len(times):
        found.append(int(times[at]))
        at = int(jump[at])
    return found


def fixed_window_throttle(
    events: DataFrame, key: str, ts: str, tie: str, max_uses: int = 12, window_ms: int = 600_000, state: DataFrame | None = None
) -> DataFrame:
    """Adds window_start (epoch ms), used (count within the window) and allowed. Refused events count too.

    ``state`` (key, window_start, used) carries the windows that run when the log begins; an
    event from before its key's window counts into it.
    """
    rows = events.withColumn("_ms", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1000).cast("bigint"))
    rows = rows.withColumn("_chunk", F.floor(F.col("_ms") / CHUNK_MS).cast("bigint"))
    times = rows.select(key, "_chunk", "_ms").distinct()
    key_type = events.schema[key].dataType.simpleString()

    def openings(batches):
        for pdf in batches:
            found = [_openings(np.asarray(t), c, window_ms) for t, c in zip(pdf["_times"], pdf["_carry"])]
            yield pd.DataFrame({key: pdf[key], "_chunk": pdf["_chunk"], "_opens": found})

    # one row per key and hour; the list is bounded by the milliseconds of an hour
    hours = landed(times.groupBy(key, "_chunk").agg(F.sort_array(F.collect_list("_ms")).alias("_times")), "hours")
    carries = _running_windows(hours, key, key_type, window_ms, state)
    opened = hours.join(carries, [key, "_chunk"]).mapInPandas(openings, f"{key} {key_type}, _chunk bigint, _opens array<bigint>")
    opened = landed(opened, "windows")  # read twice by the ranking
    opens = F.col("_opens")
    placed = rows.join(opened, [key, "_chunk"]).withColumn(
        "window_start", F.coalesce(F.array_max(F.filter(opens, lambda o: o <= F.col("_ms"))), F.array_min(opens))
    )
    ranked = bucket_rank(
        placed.drop("_opens", "_chunk"), [key, "window_start"], [F.floor(F.col("_ms") / 1000)], [F.col("_ms").asc(), F.col(tie).asc()], rank="used"
    )
    if state is not None:
        earlier = state.select(key, "window_start", F.col("used").alias("_earlier"))
        ranked = ranked.join(earlier, [key, "window_start"], "left").withColumn("used", F.col("used") + F.coalesce("_earlier", F.lit(0))).drop("_earlier")
    return ranked.withColumn("allowed", F.col("used") <= max_uses).drop("_ms")


def _running_windows(hours: DataFrame, key: str, key_type: str, window_ms: int, state: DataFrame | None) -> DataFrame:
    """End of the window that runs into each hour: key, _chunk, _carry. A prefix scan over the hours of each key."""
    node = f"{key} {key_type}, _c bigint, _from array<bigint>, _end array<bigint>"
    first, last = hours.agg(F.min("_chunk"), F.max("_chunk")).first()
    first, width = first or 0, (last or 0) - (first or 0) + 1
    # windows of a state may have opened inside the first hours of this log, or behind them
    opened = None if state is None else state.agg(F.max("window_start")).first()[0]
    latest = NEVER if opened is None else opened + window_ms

    def summarize(batches):
        for pdf in batches:
            found = [
                _reachable(_transitions(np.asarray(t), window_ms), (first + c) * CHUNK_MS, window_ms, latest) for t, c in zip(pdf["_times"], pdf["_c"])
            ]
            yield pd.DataFrame({key: pdf[key], "_c": pdf["_c"], "_from": [f[0] for f in found], "_end": [f[1] for f in found]})

    def compose(hours_each: int):
        def run(batches):
            for pdf in batches:
                found = []
                for c, kids in zip(pdf["_c"], pdf["_kids"]):
                    whole = _function(kids[0])
                    for kid in kids[1:]:
                        whole = _then(whole, _function(kid))
                    found.append(_reachable(whole, (first + c * hours_each) * CHUNK_MS, window_ms, latest))
                yield pd.DataFrame({key: pdf[key], "_c": pdf["_c"], "_from": [f[0] for f in found], "_end": [f[1] for f in found]})

        return run

    def chain(batches):
        for pdf in batches:
            kids = [[k["_c"] for k in ks] for ks in pdf["_kids"]]
            yield pd.DataFrame({key: pdf[key], "_cs": kids, "_carries": [_chain(ks, e) for ks, e in zip(pdf["_kids"], pdf["_carry"])]})

    def together(nodes: DataFrame) -> DataFrame:
        """Up to FAN_IN neighbours of a key in one row."""
        listed = F.sort_array(F.collect_list(F.struct("_c", "_from", "_end"))).alias("_kids")
        return nodes.groupBy(key, F.floor(F.col("_c") / FAN_IN).cast("bigint").alias("_g")).agg(listed).withColumnRenamed("_g", "_c")

    nodes = hours.select(key, (F.col("_chunk") - first).alias("_c"), "_times").mapInPandas(summarize, node)
    levels, hours_each = [landed(together(nodes), "hours-tree")], 1
    while width > FAN_IN:
        hours_each *= FAN_IN
        width = -(-width // FAN_IN)
        nodes = levels[-1].mapInPandas(compose(hours_each), node)
        levels.append(landed(together(nodes), "hours-tree"))
    # the top has one row per key; its window comes from before the log
    carries = levels[-1].select(key, "_c").withColumn("_carry", F.lit(NEVER))
    if state is not None:
        running = state.select(key, (F.col("window_start") + window_ms).alias("_before"))
        carries = levels[-1].select(key, "_c").join(running, key, "left").select(key, "_c", F.coalesce("_before", F.lit(NEVER)).alias("_carry"))
    for level in reversed(levels):
        down = level.join(carries, [key, "_c"]).mapInPandas(chain, f"{key} {key_type}, _cs array<bigint>, _carries array<bigint>")
        pairs = down.select(key, F.explode(F.arrays_zip("_cs", "_carries")).alias("h"))
        carries = pairs.select(key, F.col("h._cs").alias("_c"), F.col("h._carries").alias("_carry"))
    return carries.select(key, (F.col("_c") + first).alias("_chunk"), "_carry")


def window_state(judged: DataFrame, key: str, before: DataFrame | None = None) -> DataFrame:
    """Last window of every key with its uses, from judged events and the state before them."""
    last = judged.groupBy(key).agg(F.max(F.struct("window_start", "used")).alias("w")).select(key, "w.window_start", "w.used")
    if before is None:
        return last
    return last.unionByName(before.join(last.select(key), key, "left_anti"))
