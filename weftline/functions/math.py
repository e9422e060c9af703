"""Combinatorics, numbers and vectors, mostly as native expressions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from weftline.functions.text import _c


def partitions(n: int, size: int, limit: int | None = None) -> Iterator[list[int]]:
    """Ways to write n as ``size`` non-increasing positive parts of at most ``limit``."""
    limit = n if limit is None else limit
    if size == 1:
        if 0 < n <= limit:
            yield [n]
        return
    for first in range(min(limit, n - size + 1), 0, -1):
        for rest in partitions(n - first, size - 1, first):
            yield [first, *rest]


def compositions(n: int, size: int) -> Iterator[list[int]]:
    """Ways to write n as ``size`` positive parts in any order."""
    if size == 1:
        if n > 0:
            yield [n]
        return
    for first in range(1, n - size + 2):
        for rest in compositions(n - first, size - 1):
            yield [first, *rest]


def _table(spark: SparkSession, rows: list[list[int]]) -> DataFrame:
    return spark.createDataFrame([(r,) for r in rows], StructType([StructField("parts", ArrayType(IntegerType()))]))


def sum_to_n(spark: SparkSession, n: int, size: int, limit: int | None = None) -> DataFrame:
    return _table(spark, list(partitions(n, size, limit)))


def possible_splits(spark: SparkSession, n: int, low: int = 1, high: int | None = None) -> DataFrame:
    """Rows of (index, length) lists: n split into ``low`` to ``high`` consecutive parts."""
    rows = []
    for k in range(low, (high or n) + 1):
        for parts in compositions(n, k):
            at, out = 0, []
            for p in parts:
                out.append((at, p))
                at += p
            rows.append((out,))
    return spark.createDataFrame(rows, "split array<struct<at:int,length:int>>")


def consecutive_gaps(spark: SparkSession, n: int, left: bool = False, right: bool = False) -> DataFrame:
    """Rows (at, length) of all runs inside n places; a run at an edge only if that side is allowed."""
    at = spark.range(n).select(F.col("id").cast("int").alias("at"))
    out = at.select("at", F.explode(F.sequence(F.lit(1), F.lit(n) - F.col("at"))).alias("length"))
    if not left:
        out = out.where("at > 0")
    if not right:
        out = out.where(F.col("at") + F.col("length") < n)
    return out


def byte_size(n: Column | str) -> Column:
    """Bytes that a non-negative number takes, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.hex(_c(n))) / 2)).cast("int")


def array_product(xs: Column | str) -> Column:
    """Product of an array; of none 0."""
    x = _c(xs)
    return F.when(F.size(x) > 0, F.aggregate(F.transform(x, lambda v: v.cast("double")), F.lit(1.0), lambda a, v: a * v)).otherwise(F.lit(0.0))


def dot_product(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def vector_add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def normalize(xs: Column | str, total: float = 1.0) -> Column:
    """Numbers scaled to sum to ``total``; null where they sum to 0."""
    x = F.transform(_c(xs), lambda v: v.cast("double"))
    s = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return F.when(s != 0, F.transform(x, lambda v: v / s * total))


def binary_search(xs: Column | str, x: Column | int) -> Column:
    """Index from 0 in a sorted array, or -1."""
    return (F.array_position(_c(xs), x) - 1).cast("int")


def histogram(df: DataFrame, value: Column, by_count: bool = False) -> DataFrame:
    """Rows (bin, n) by bin, or by count from the greatest."""
    out = df.groupBy(value.alias("bin")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "bin") if by_count else out.orderBy("bin")
