"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def l2_normalised(a: Column, eps: float = 1e-8) -> Column:
    """VEC1: divided by its length, or by ``eps`` if that is larger."""
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda v: v.cast("double") / n)


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def mean_vector(a: Column) -> Column:
    """Elementwise mean of a group: one buffer for each group, combined on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(a.cast("array<double>"))))


def sum_vector(a: Column) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(a.cast("array<double>"))))


def variance_vector(a: Column) -> Column:
    """Elementwise sample variance of a group."""
    return vector_to_array(Summarizer.variance(array_to_vector(a.cast("array<double>"))))


def entropy(h: Column, drop_zeros: bool = True) -> Column:
    """Shannon entropy (natural): of the positive bins with 1e-10 added, or of all bins with 1e-12 added."""
    if drop_zeros:
        return -F.aggregate(F.filter(h, lambda v: v > 0), F.lit(0.0), lambda s, v: s + v.cast("double") * F.log(v.cast("double") + 1e-10))
    return -F.aggregate(h, F.lit(0.0), lambda s, v: s + v.cast("double") * F.log(v.cast("double") + 1e-12))


def argmax(a: Column) -> Column:
    """Position (from 0) of the largest value, the first on a tie."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
