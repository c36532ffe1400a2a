"""Spans found in texts: their order, their digest, and the Arrow column that carries them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (kind, start, end, base): code points, end exclusive; base is False for what only the method finds
Span = tuple[str, int, int, bool]
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
)


class Cover:
    """Which characters a set of spans covers, as disjoint stretches that are searched by halving."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, start)
        return k < len(self.ends) and self.starts[k] < end


def span_column(find: Callable[[str], list[Span]], text: Column) -> Column:
    """The spans ``find`` gives for each text, worked out on Arrow batches."""

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        rows = [find(x) if x else [] for x in texts.to_pylist()]
        flat = [s for row in rows for s in row]
        offsets = [0]
        for row in rows:
            offsets.append(offsets[-1] + len(row))
        fields = [pa.array([s[i] for s in flat], t.type) for i, t in enumerate(_TYPE.value_type)]
        return pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_TYPE.value_type))
        )

    return run(text)


def joined(spans: Column, base_only: bool) -> Column:
    """kind:start:end, comma-joined, in the order found."""
    some = F.filter(spans, lambda s: s["base"]) if base_only else spans
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_base(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")
