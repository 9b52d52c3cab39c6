"""Vectors held as ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """L2-normalised vector."""
    v = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + EPS
    return F.transform(v, lambda x: x / norm)


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def mean_vector(v: Column) -> Column:
    """Aggregate: element-wise mean, combined before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))


def sum_vector(v: Column) -> Column:
    """Aggregate: element-wise sum."""
    return vector_to_array(Summarizer.sum(array_to_vector(v)))
