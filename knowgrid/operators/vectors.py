"""Vectors as arrays: cosine, int8 quantising, ranking and the standout gate, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, zero vectors and unequal lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def quantise(v: Column) -> tuple[Column, Column]:
    """Signed bytes and their scale: largest magnitude over 127, halves away from zero."""
    scale = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) / 127.0
    q = F.when(scale > 0, F.transform(v, lambda x: F.round(x.cast("double") / scale).cast("tinyint"))).otherwise(F.transform(v, lambda x: F.lit(0).cast("tinyint")))
    return q, scale


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, score`` of the ``k`` vectors most like ``query``, positive scores only; one scan, top-k per task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = vectors.select(key, F.round(cosine(F.col(vector), q), 9).alias("score")).where("score > 0")
    return s.orderBy(F.desc("score"), key).limit(k)


def standout(ranked: DataFrame, least_field: int = 4, span: float = 0.15, least: float = 0.05) -> DataFrame:
    """``ranked`` (``key.., score``; a short list) with ``standout``: height over the list's median by ``span``, within
    0 and 1; below ``least`` it is dropped. A list shorter than ``least_field`` has no median to stand out from."""
    w = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    field = F.sort_array(F.collect_list("score").over(w), asc=False)
    n = F.size(field)
    median = F.element_at(field, (F.floor(n / 2) + 1).cast("int"))
    v = F.when(F.col("score") <= 0, 0.0).when(n < least_field, F.least(F.lit(1.0), F.col("score"))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("score") - median) / span)))
    return ranked.withColumn("standout", F.round(v, 6)).where(F.col("standout") >= least)
