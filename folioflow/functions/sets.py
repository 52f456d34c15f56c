"""Measures over arrays and vectors, all built-in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays as sets; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def set_scores(found: Column, gold: Column) -> Column:
    """Struct (precision, recall, f1) of two arrays as sets; two empty sets agree fully."""
    f, g = F.array_distinct(found), F.array_distinct(gold)
    tp = F.size(F.array_intersect(f, g)).cast("double")
    p = F.when(F.size(f) > 0, tp / F.size(f)).otherwise(0.0)
    r = F.when(F.size(g) > 0, tp / F.size(g)).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    empty = (F.size(f) == 0) & (F.size(g) == 0)
    one = F.lit(1.0)
    return F.struct(F.when(empty, one).otherwise(p).alias("precision"), F.when(empty, one).otherwise(r).alias("recall"), F.when(empty, one).otherwise(f1).alias("f1"))


def hits(keys: Column, text: Column) -> Column:
    """How many of ``keys`` (already folded) stand in ``text`` (folded); null and empty keys do not count."""
    return F.size(F.filter(keys, lambda k: (k != "") & F.contains(text, k)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float vectors, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
