"""Image similarity queries; the embeddings table stands in for images."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.checks import query
from vitrine.checks.views import table
from vitrine.operators import similarity as S

# 768 pixel values per row, from the 64 floats of an embedding
PIXELS = "transform(sequence(0, 767), i -> CAST(pmod(CAST(floor(CAST(embedding[pmod(i, 64)] AS DOUBLE) * 1000) AS BIGINT) + i * 7, 256) AS INT))"
PX_SQL = """
px AS (SELECT vec_id, i, CAST(((CAST(floor(CAST(embedding[i % 64 + 1] AS DOUBLE) * 1000) AS BIGINT) + i * 7) % 256 + 256) % 256 AS DOUBLE) AS v
  FROM embeddings, range(768) r(i)),
p AS (SELECT vec_id, i // 3 AS n, i % 3 AS c, v FROM px),
lum AS (SELECT vec_id, n, sum(v * CASE c WHEN 0 THEN 0.299::DOUBLE WHEN 1 THEN 0.587::DOUBLE ELSE 0.114::DOUBLE END) AS l FROM p GROUP BY vec_id, n),
g AS (SELECT vec_id, ((n // 16) // 2) * 8 + (n % 16) // 2 AS cell, sum(l) / 4 AS v FROM lum GROUP BY 1, 2),
m AS (SELECT vec_id, avg(v) AS mean, stddev_pop(v) AS sd FROM g GROUP BY 1),
gray AS (SELECT vec_id, cell, (v - mean) / sd AS v FROM g JOIN m USING (vec_id)),
color AS (SELECT vec_id, (((n // 16) // 4) * 4 + (n % 16) // 4) * 3 + c AS cell, sum(v) / 16 AS v FROM p GROUP BY 1, 2)
"""


def signatures(spark, sf):
    pixels = table(spark, sf, "embeddings").select("vec_id", "label", F.expr(PIXELS).alias("pixels"))
    return pixels.select("vec_id", "label", S.image_signature(F.col("pixels")).alias("s")).select("vec_id", "label", "s.gray", "s.color")


@query("q_signature", f"""
WITH {PX_SQL}
SELECT vec_id, 'gray' AS part, CAST(cell AS INT) AS cell, round(v, 6) + 0.0 AS v FROM gray UNION ALL SELECT vec_id, 'color', CAST(cell AS INT), round(v, 6) + 0.0 FROM color""")
def signature(spark, sf):
    sig = signatures(spark, sf)
    parts = [
        sig.select("vec_id", F.lit(p).alias("part"), F.posexplode(p).alias("cell", "v")).withColumn("v", F.round("v", 6) + F.lit(0.0))
        for p in ("gray", "color")
    ]
    return parts[0].unionByName(parts[1])


EMB = """
e AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS g, CAST(embedding[i] AS DOUBLE) * 255 AS c FROM embeddings, range(1, 65) r(i)),
d AS (SELECT b.vec_id AS base, e.vec_id, sqrt(sum((e.g - b.g) * (e.g - b.g)) / 64) + 1.5 * sqrt(sum(CASE WHEN e.i <= 48 THEN ((e.c - b.c) / 255) * ((e.c - b.c) / 255) ELSE 0 END) / 48) AS d
  FROM e JOIN e b ON e.i = b.i AND e.vec_id <> b.vec_id WHERE b.vec_id IN ({bases}) GROUP BY b.vec_id, e.vec_id)
"""


def embedded(spark, sf):
    """Embeddings taken as signatures: gray as it is, color from the first 48 values."""
    vec = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", "label", vec.alias("gray"), F.transform(F.slice(vec, 1, 48), lambda v: v * 255).alias("color"))


@query("q_similar", f"WITH {EMB.format(bases='0')} SELECT vec_id, round(d, 6) AS d FROM d ORDER BY d.d, vec_id LIMIT 20")
def similar(spark, sf):
    return S.rank_similar(embedded(spark, sf), 0, 20, key="vec_id").select("vec_id", F.round("d", 6).alias("d"))


BASES = "SELECT min(vec_id) FROM embeddings GROUP BY label"


@query("q_similar_many", f"""
WITH {EMB.format(bases=BASES)} SELECT base, vec_id, round(d, 6) AS d, rank FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY d.d, vec_id) AS rank FROM d) WHERE rank <= 15""")
def similar_many(spark, sf):
    sig = embedded(spark, sf)
    bases = sig.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    ranked = S.rank_similar_many(sig, bases, 15, key="vec_id")
    return ranked.select("base", "vec_id", F.round("d", 6).alias("d"), F.col("rank").cast("bigint").alias("rank"))


@query("q_similar_images", f"""
WITH {PX_SQL}, b AS (SELECT min(vec_id) AS base FROM embeddings),
dg AS (SELECT x.vec_id, sum((x.v - y.v) * (x.v - y.v)) AS s FROM gray x JOIN gray y ON x.cell = y.cell AND y.vec_id = (SELECT base FROM b) GROUP BY 1),
dc AS (SELECT x.vec_id, sum(((x.v - y.v) / 255) * ((x.v - y.v) / 255)) AS s FROM color x JOIN color y ON x.cell = y.cell AND y.vec_id = (SELECT base FROM b) GROUP BY 1)
SELECT vec_id, round(sqrt(dg.s / 64) + 1.5 * sqrt(dc.s / 48), 6) AS d FROM dg JOIN dc USING (vec_id) WHERE vec_id <> (SELECT base FROM b) ORDER BY sqrt(dg.s / 64) + 1.5 * sqrt(dc.s / 48), vec_id LIMIT 25""")
def similar_images(spark, sf):
    """Signatures from pixels, then the nearest images."""
    sig = signatures(spark, sf)
    base = table(spark, sf, "embeddings").agg(F.min("vec_id")).first()[0]
    return S.rank_similar(sig, base, 25, key="vec_id").select("vec_id", F.round("d", 6).alias("d"))
