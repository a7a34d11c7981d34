"""Distances and norms of vector columns as Spark expressions; sums are in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _checked(u: Column, v: Column, value: Column) -> Column:
    """Fails on vectors of different lengths; null if either is null."""
    same = F.size(u) == F.size(v)
    return F.when(u.isNull() | v.isNull(), None).when(same, value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def inner_product(u: Column, v: Column) -> Column:
    return _checked(u, v, _sum(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double"))))


def l2sq_distance(u: Column, v: Column) -> Column:
    """Squared Euclidean distance."""
    return _checked(u, v, _sum(F.zip_with(u, v, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def l1_distance(u: Column, v: Column) -> Column:
    return _checked(u, v, _sum(F.zip_with(u, v, lambda x, y: F.abs(x.cast("double") - y.cast("double")))))


def magnitude(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def normalize(v: Column) -> Column:
    """The unit vector; a vector of zeros stays as it is."""
    norm = magnitude(v)
    return F.transform(v, lambda x: F.when(norm == 0, 0.0).otherwise(x.cast("double") / F.nullif(norm, F.lit(0.0))))


def cosine_distance(u: Column, v: Column) -> Column:
    """Null for a vector of zeros, whose angle isn't defined."""
    return 1 - F.try_divide(inner_product(u, v), F.sqrt(inner_product(u, u) * inner_product(v, v)))


def cosine_distance_units(u: Column, v: Column) -> Column:
    """For vectors of length one."""
    return 1 - inner_product(u, v)


def cosine_distance_guarded(u: Column, v: Column) -> Column:
    """1 for a vector of zeros, so that every pair can be ranked."""
    return F.when(u.isNull() | v.isNull(), None).otherwise(F.coalesce(cosine_distance(u, v), F.lit(1.0)))


METRICS: dict[str, Metric] = {"cosine": cosine_distance_guarded, "cosine_units": cosine_distance_units, "l2sq": l2sq_distance, "l1": l1_distance, "inner_product": lambda u, v: -inner_product(u, v)}


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero, so that equal distances tie on any engine."""
    return F.round(x, digits) + F.lit(0.0)


def register(spark: SparkSession) -> None:
    """SQL functions vec_dot, vec_l2sq, vec_l1, vec_norm and vec_cosine over arrays of doubles."""
    total = "aggregate(zip_with(u, v, (x, y) -> {}), 0D, (c, z) -> c + z)"
    dot = total.format("x * y")
    for name, body in (("vec_dot", dot), ("vec_l2sq", total.format("(x - y) * (x - y)")), ("vec_l1", total.format("abs(x - y)"))):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(u ARRAY<DOUBLE>, v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_norm(v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(v, 0D, (c, x) -> c + x * x))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_cosine(u ARRAY<DOUBLE>, v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN coalesce(1 - try_divide(vec_dot(u, v), vec_norm(u) * vec_norm(v)), 1D)")
