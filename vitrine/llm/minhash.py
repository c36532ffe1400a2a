"""Near duplicates by one-permutation MinHash with optimal densification.

1. Every text becomes its set of word shingles (64-bit hashes, worked out for a whole Arrow batch at once),
   a one-permutation signature whose empty bins are filled by optimal densification, and band hashes.
2. Texts with equal sets collapse to one class, so thousands of copies cost one row from then on.
3. Members of a bucket are compared with pivots of the bucket, not with each other: star-shaped candidate
   edges, first from the most central member. Every edge is confirmed on the full sets of both texts.
4. Buckets whose members belong to several components get another star, from a member outside the largest
   one, while the rounds find many links. Only pairs that their sizes or the triangle inequality with the first
   pivot rule out are not compared.
5. What is still open then is closed at once: among the members left, a join over the rarest shingles of each
   set finds every pair of different components that can reach the limit (prefix and position filter).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import BROADCAST_KEYS, among, broadcast_if, sifted, text_of, without
from vitrine.session import bound_batches, landed


@dataclass(frozen=True)
class NearRules:
    """Shingle length in words, similarity in percent, and the signature's shape.

    With 64 bands of 8 bins a pair at similarity 0.8 shares no bucket with probability 8e-6.
    """

    words: int = 5
    percent: int = 80
    bands: int = 64
    rows: int = 8

    @property
    def bins(self) -> int:
        return self.bands * self.rows


RULES = NearRules()

# A star round that links fewer than one in so many of the members left is the last; only time depends on it.
_FEW = 50

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


# one random value per byte; A-Z share those of a-z
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x5851F42D4C957F2D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
# short texts are hashed together up to so many bytes; the arrays of that take some 30 times as much
_TOGETHER = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words in a block of UTF-8 bytes (at most one block long).

    A word's hash is the difference of two running sums of its bytes times powers of an odd number, shifted
    back to its start: no loop over words.
    """
    blank = _SPACE[data]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _UP[: len(data)], dtype=np.uint64)))
    return _mix((sums[end] - sums[start]) * _DOWN[start] + (end - start).astype(np.uint64) * _GOLD), start


def _words_of(text: bytes) -> np.ndarray:
    """Word hashes of one text of any length, in blocks that end at white space."""
    if len(text) <= _BLOCK:
        return word_hashes(np.frombuffer(text, np.uint8))[0]
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + _BLOCK)
        if end < len(text):
            back = max(text.rfind(bytes([c]), at, end) for c in (32, 9, 10, 11, 12, 13))
            if back <= at:  # one word longer than a block: it is hashed by its digest
                import hashlib

                tail = text[at:].lstrip().split(None, 1)
                word = tail[0].lower()
                out.append(np.array([int.from_bytes(hashlib.sha256(word).digest()[:8], "little")], np.uint64))
                at = len(text) - (len(tail[1]) if len(tail) > 1 else 0)
                continue
            end = back
        out.append(word_hashes(np.frombuffer(text[at:end], np.uint8))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer words than ``n`` the whole sequence; without words none."""
    return _shingles(_words_of(text), n)


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        total = _mix(total + words[i : len(words) - k + 1 + i])
    return np.unique(total)


def text_words(column: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text of a string column; short texts are hashed many at a time."""
    texts = [x.encode("utf-8", "surrogatepass") if x else b"" for x in column.to_pylist()]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size + len(texts[end]) + 1 <= _TOGETHER):
            size += len(texts[end]) + 1
            end += 1
        if end == at:
            yield _words_of(texts[at])
            at += 1
            continue
        hashes, start = word_hashes(np.frombuffer(b" ".join(texts[at:end]), np.uint8))
        ends = np.cumsum([len(x) + 1 for x in texts[at:end]])
        yield from np.split(hashes, np.searchsorted(start, ends[:-1]))
        at = end


@lru_cache(maxsize=4)
def _probes(bins: int) -> np.ndarray:
    """For every bin the order in which it would try the others, as a priority of each."""
    return (_mix(np.arange(1, bins * bins + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(bins, bins)


def signature(values: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signature: the smallest value per bin; an empty bin takes the value of another one.

    Each bin has its own random order of all bins, the same for every set, and takes the first filled one in
    it: optimal densification, in one step for sets of any size.
    """
    hashed = _mix(values ^ _GOLD)
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    place = (hashed % np.uint64(bins)).astype(np.int64)
    np.minimum.at(out, place, hashed // np.uint64(bins))
    full = np.zeros(bins, bool)
    full[place] = True
    filled, empty = np.flatnonzero(full), np.flatnonzero(~full)
    if len(empty):
        out[empty] = out[filled[_probes(bins)[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def band_hashes(sig: np.ndarray, rules: NearRules) -> np.ndarray:
    parts = sig.reshape(rules.bands, rules.rows)
    total = np.arange(rules.bands, dtype=np.uint64) * _M2
    for i in range(rules.rows):
        total = _mix(total + parts[:, i])
    return total.view(np.int64)


def profiles(docs: DataFrame, rules: NearRules = RULES) -> DataFrame:
    """(doc_id, n_shingles, set_hash, bands) per row of ``docs`` (doc_id, text); empty sets have no bands."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_shingles", pa.int64()),
            ("set_hash", pa.binary()),
            ("bands", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            size, digest, bands = [], [], []
            for words in text_words(batch.column("text")):
                found = _shingles(words, rules.words)
                size.append(len(found))
                if len(found):
                    digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    bands.append(band_hashes(signature(found, rules.bins), rules))
                else:
                    digest.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))],
                schema=schema,
            )

    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_hash binary, bands array<long>"
    )


def _compared(edges: DataFrame, texts: DataFrame, rules: NearRules) -> DataFrame:
    """(a, b, distance, linked) of edges, from the full shingle sets; ``texts`` holds (class_id, text)."""
    left = texts.select(F.col("class_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("class_id").alias("b"), F.col("text").alias("text_b"))
    pairs = edges.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("text_a"), batch.column("text_b")
            distance, linked = [], []
            for i in range(len(a)):
                if a[i] != last:
                    last, known = a[i], shingles(ta[i].as_py().encode("utf-8", "surrogatepass"), rules.words)
                other = shingles(tb[i].as_py().encode("utf-8", "surrogatepass"), rules.words)
                both = len(np.intersect1d(known, other, assume_unique=True))
                either = len(known) + len(other) - both
                distance.append(1 - both / either)
                linked.append(100 * both >= rules.percent * either)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(distance, pa.float64()), pa.array(linked, pa.bool_())],
                names=["a", "b", "distance", "linked"],
            )

    return pairs.mapInArrow(run, "a long, b long, distance double, linked boolean")


def components(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, comp): the smallest node reachable over the edges (a, b); landed.

    Each round takes the smallest label of a node's neighbours, then the label of that label, until nothing
    changes; the number of rounds is about the logarithm of the longest chain. ``start`` gives labels found
    earlier.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("to"))
    )
    both = landed(both.distinct(), "links")
    labels = both.select("node").distinct().withColumn("comp", F.col("node"))
    if start is not None:
        old = start.select("node", F.col("comp").alias("known"))
        # an earlier component stays together: its label is a neighbour of each member
        both = landed(
            both.unionByName(old.select("node", F.col("known").alias("to"))).unionByName(
                old.select(F.col("known").alias("node"), F.col("node").alias("to"))
            ).where("node != to").distinct(),
            "links",
        )
        labels = both.select("node").distinct().join(old, "node", "left").select(
            "node", F.coalesce("known", "node").alias("comp")
        )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("to"), "comp"), "to")
            .groupBy("node")
            .agg(F.min("comp").alias("near"))
        )
        step = landed(
            labels.join(near, "node", "left").select(
                "node", F.least("comp", F.coalesce("near", "comp")).alias("comp"), F.col("comp").alias("old")
            ),
            "labels",
        )
        if step.where("comp != old").isEmpty():
            return step.select("node", "comp")
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        labels = step.join(jump, "comp", "left").select(
            "node", F.least("comp", F.coalesce("further", "comp")).alias("comp")
        )


def _closing(members: DataFrame, texts: DataFrame, rules: NearRules) -> DataFrame:
    """Candidate edges (a, b) that hold every linked pair of ``members`` (class_id, comp) of different components.

    Shingles are ordered by their frequency among the members, rarest first. Of a linked pair the first common
    shingle lies in the prefix that remains without the overlap each set needs, and from its places on both sets
    still hold that overlap. Both bounds are exact, so nothing that could be a link is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shingles(words, rules.words).view(np.int64) for words in text_words(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("class_id"), batch.column("comp"), pa.array(found, pa.list_(pa.int64()))],
                names=["class_id", "comp", "shingles"],
            )

    # a class whose id is repeated has several texts, so each set has a number of its own
    sets = texts.join(members, "class_id").select("class_id", "comp", "text").mapInArrow(
        run, "class_id long, comp long, shingles array<long>"
    )
    sets = landed(sets.where(F.size("shingles") > 0).withColumn("row", F.monotonically_increasing_id()), "sets")
    each = sets.select("row", F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("often"))
    n = F.size("ordered").cast("bigint")
    prefix = n - F.ceil(n * rules.percent / 100 - 1e-9) + 1
    ordered = each.join(often, "s").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("often", "s"))).alias("ordered"))
    index = ordered.select(
        "row", n.alias("n"), F.posexplode(F.slice("ordered", F.lit(1), prefix.cast("int"))).alias("at", "x")
    ).where("x.often > 1")
    index = landed(
        index.join(sets.drop("shingles"), "row").select("class_id", "comp", F.col("x.s").alias("s"), "n", (F.col("n") - F.col("at")).alias("rest")),
        "prefixes",
    )
    other = index.select("s", *[F.col(c).alias(f"{c}_b") for c in ("class_id", "comp", "n", "rest")])
    reach = (100 + rules.percent) * F.least("rest", "rest_b") >= rules.percent * (F.col("n") + F.col("n_b"))
    return (
        index.join(other, "s")
        .where((F.col("class_id") < F.col("class_id_b")) & (F.col("comp") != F.col("comp_b")) & reach)
        .select(F.col("class_id").alias("a"), F.col("class_id_b").alias("b"))
        .distinct()
    )


def _stars(members: DataFrame, first: bool, rules: NearRules) -> tuple[DataFrame, DataFrame]:
    """One pivot for each bucket and the candidate edges from it to the other members.

    ``members`` has (band, class_id, n, weight, comp, d, retired). The first pivot is the most central class,
    usually the text that the others were copied from. Later ones come from members outside the bucket's largest
    component. Left out are edges inside a component, those whose sizes rule out the
    similarity, and those whose distances ``d`` to the first pivot differ by more than a link may have:
    the Jaccard distance is a metric, so such a pair is farther apart than that.
    """
    able = members.where(~F.col("retired"))
    if not first:
        sizes = members.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("size"))
        largest = sizes.groupBy("band").agg(F.max(F.struct("size", "comp")).alias("m"))
        able = able.join(largest.select("band", F.col("m.comp").alias("largest")), "band").where("comp != largest")
    pivots = able.groupBy("band").agg(
        F.max(F.struct("weight", "class_id", "n", "comp", "d")).alias("p")
    )
    pivots = landed(
        pivots.select("band", *[F.col(f"p.{c}").alias(f"pivot_{c}") for c in ("class_id", "n", "comp", "d")]), "pivots"
    )
    low, high = F.least("n", "pivot_n"), F.greatest("n", "pivot_n")
    near = F.abs(F.col("d") - F.col("pivot_d")) <= (100 - rules.percent) / 100 + 1e-9
    edges = (
        members.join(pivots, "band")
        .where("class_id != pivot_class_id AND comp != pivot_comp")
        .where((100 * low >= rules.percent * high) & F.coalesce(near, F.lit(True)))
        .select(F.least("class_id", "pivot_class_id").alias("a"), F.greatest("class_id", "pivot_class_id").alias("b"))
        .distinct()
    )
    return pivots, edges


def near_classes(docs: DataFrame, rules: NearRules = RULES) -> DataFrame:
    """Landed (doc_id, n_shingles, class_id, component_id) per row of ``docs`` (doc_id, text)."""
    bound_batches(docs.sparkSession)
    rows = landed(profiles(docs, rules), "profiles")
    sets = rows.where("set_hash IS NOT NULL AND doc_id IS NOT NULL")
    classes = sets.groupBy("set_hash").agg(
        F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
    )
    banded = classes.select("class_id", "n", F.explode("bands").alias("band"))
    shared = landed(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    # most bands are of one class only: they are left out where they are made, without a shuffle
    members = sifted(banded, shared, "band", "band").join(broadcast_if(shared, BROADCAST_KEYS), "band")
    members = landed(members, "shared")
    weight = members.groupBy("class_id").agg(F.sum("size").alias("weight"))
    members = members.drop("size").join(weight, "class_id")
    members = landed(
        members.withColumns(
            {"comp": F.col("class_id"), "d": F.lit(None).cast("double"), "retired": F.lit(False)}
        ),
        "members",
    )
    ids = landed(members.select("class_id").distinct(), "ids")
    texts = docs.select(F.col("doc_id").alias("class_id"), text_of("text").alias("text"))
    texts = landed(among(texts, ids, {"class_id": "class_id"}), "texts")
    labels: DataFrame | None = None
    known: DataFrame | None = None
    first = True
    while True:
        pivots, edges = _stars(members, first, rules)
        if known is not None:
            edges = edges.join(known.select("a", "b"), ["a", "b"], "left_anti")
        compared = landed(_compared(edges, texts, rules), "compared")
        known = compared if known is None else known.unionByName(compared)
        links = compared.where("linked").select("a", "b")
        n_links = links.count()
        if n_links:
            labels = components(links, labels)
            new = labels.select(F.col("node").alias("class_id"), F.col("comp").alias("new"))
            members = members.join(new, "class_id", "left").withColumn("comp", F.coalesce("new", "comp")).drop("new")
        if first:
            far = compared.select(F.col("a").alias("x"), F.col("b").alias("class_id"), "distance").unionByName(
                compared.select(F.col("b").alias("x"), F.col("a").alias("class_id"), "distance")
            )
            members = members.join(pivots.select("band", F.col("pivot_class_id").alias("x")), "band").join(
                far, ["x", "class_id"], "left"
            )
            members = members.withColumn(
                "d", F.when(F.col("x") == F.col("class_id"), F.lit(0.0)).otherwise(F.col("distance"))
            ).drop("x", "distance")
        was = pivots.select("band", F.col("pivot_class_id").alias("class_id"), F.lit(True).alias("was"))
        members = members.join(was, ["band", "class_id"], "left").withColumn(
            "retired", F.col("retired") | F.coalesce("was", F.lit(False))
        )
        members = landed(members.drop("was"), "members")
        # a bucket goes on while members that were not pivots belong to several components
        open_ = (
            members.where(~F.col("retired"))
            .groupBy("band")
            .agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
            .where("low != high")
            .select("band")
        )
        members = landed(members.join(open_, "band", "left_semi"), "members")
        if members.isEmpty():
            break
        left = members.where(~F.col("retired")).select("class_id", "comp").distinct()
        if not first and _FEW * n_links < left.count():
            edges = _closing(left, texts, rules).join(known.select("a", "b"), ["a", "b"], "left_anti")
            links = landed(_compared(edges, texts, rules), "compared").where("linked").select("a", "b")
            if not links.isEmpty():
                labels = components(links, labels)
            break
        first = False
    found = classes.select("set_hash", "class_id")
    if labels is not None:
        found = found.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    else:
        found = found.withColumn("comp", F.col("class_id"))
    found = landed(found.select("set_hash", "class_id", F.coalesce("comp", "class_id").alias("comp")), "classes")
    return rows.join(found, "set_hash", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("comp", "doc_id").alias("component_id"),
    )


def near_duplicates(
    docs: DataFrame, rules: NearRules = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable) and kept.

    Null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows
    without an id are never linked and are kept. Rows that repeat an id count as one document with several
    texts: what any of them is linked with belongs to its component. An empty table gives an empty result.
    """
    found = near_classes(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rules)
    return found.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "class_id",
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(
    docs: DataFrame, rules: NearRules = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, and those without an id, whole.

    Only the ids of dropped rows are joined with the wide rows.
    """
    gone = near_duplicates(docs, rules, id_col, text_col).where(~F.col("kept"))
    gone = landed(gone.select("doc_id").distinct(), "dropped")
    return without(docs, gone, {id_col: "doc_id"})
