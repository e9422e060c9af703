"""Top-k queues, splits of data, parameter search, tries and encoded patterns."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def top(df: DataFrame, score: str, k: int, least: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """The k best rows; a bounded heap in each task and one merge."""
    return df.orderBy(F.asc(score) if least else F.desc(score), *ties).limit(k)


def top_by(df: DataFrame, by: list[str], score: str, k: int, least: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """The k best rows of each group, with ``rank``; Spark cuts each task's groups to k before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.asc(score) if least else F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def blocked(df: DataFrame, by: list[str], order: str, score: str, worse: bool = True, equal: bool = False, least: bool = False) -> DataFrame:
    """Rows that a queue takes in order of arrival: not those worse than the best so far, nor equal ones if ``equal``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = (F.min if least else F.max)(score).over(w)
    s, keep = F.col(score), F.lit(True)
    if worse:
        keep = keep & ((s <= F.col("_best")) if least else (s >= F.col("_best")))
    if equal:
        keep = keep & (s != F.col("_best"))
    return df.withColumn("_best", best).where(F.col("_best").isNull() | keep).drop("_best")


def pruned(df: DataFrame, score: str, limit: float, least: bool = False) -> DataFrame:
    return df.where(F.col(score) <= limit if least else F.col(score) >= limit)


def sampled(df: DataFrame, key: Column, k: int, seed: int = 0) -> DataFrame:
    """k rows by the least seeded hash of ``key``: the same whatever the partitions."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))).limit(k)


def split(df: DataFrame, key: Column, test: float, dev: float = 0.0, seed: int = 0) -> DataFrame:
    """``df`` with ``part``: test, dev or train, by a seeded hash of ``key``.

    Sizes below 1 are shares and need no shuffle.  Larger ones are numbers of
    rows: their bounds are the hashes of that rank, found with a bounded heap,
    so that no task sorts all rows.  Parallel files split alike by the same key.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    if test < 1 and dev < 1:
        u = F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
        return df.withColumn("part", F.when(u < test, F.lit("test")).when(u < test + dev, F.lit("dev")).otherwise(F.lit("train")))

    def bound(k: int) -> str:
        if k <= 0:
            return ""
        row = df.select(h.alias("_h")).orderBy("_h").limit(k).agg(F.max("_h")).first()
        return row[0] or ""

    a, b = bound(int(test)), bound(int(test) + int(dev))
    return df.withColumn("part", F.when(h <= a, F.lit("test")).when(h <= b, F.lit("dev")).otherwise(F.lit("train")))


def grid(spark: SparkSession, values: dict[str, list], constraint: Column | None = None) -> DataFrame:
    """All combinations of parameter values that the constraint admits."""
    names = list(values)
    out = spark.createDataFrame(list(itertools.product(*values.values())), names)
    return out if constraint is None else out.where(constraint)


def exhaustive_search(params: DataFrame, data: DataFrame, score: Column) -> DataFrame:
    """Rows of ``params`` with ``score``, an aggregate over ``data`` for each combination, by score from the least."""
    return params.crossJoin(data).groupBy(*params.columns).agg(score.alias("score")).orderBy("score", *params.columns)


def progressive_search(params: DataFrame, data: DataFrame, score: Column, key: Column, most: int = 0, seed: int = 0) -> DataFrame:
    """Wrapped progressive sampling: round i scores on round(most / 100 * i * i) rows and drops the worse half, until one combination is left.

    The best (greatest score, ties by parameters) is returned with its score.
    The loop moves combinations only; a round is one aggregate.
    """
    n = most or data.count()
    left, i = params, 1
    while True:
        size = min(n, max(1, round(n / 100 * i * i)))
        scored = left.crossJoin(sampled(data, key, size, seed)).groupBy(*params.columns).agg(score.alias("score"))
        rows = scored.orderBy(F.desc("score"), *params.columns).collect()
        keep = max(1, len(rows) // 2)
        if keep == 1 or size >= n:
            return params.sparkSession.createDataFrame(rows[:1], scored.schema)
        left = params.sparkSession.createDataFrame([r[:-1] for r in rows[:keep]], params.schema)
        i += 1


def run_experiments(jobs: list[Callable[[], object]], size: int = 4, halt_on_error: bool = True) -> list[object]:
    """Actions started from ``size`` threads, so that Spark schedules them side by side; results in order."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(size) as pool:
        futures = [pool.submit(j) for j in jobs]
        out: list[object] = []
        for f in futures:
            try:
                out.append(f.result())
            except Exception as e:
                if halt_on_error:
                    for g in futures:
                        g.cancel()
                    raise
                out.append(e)
        return out


def trie(sequences: DataFrame, items: Column) -> DataFrame:
    """Rows (prefix, depth, n, ends): every prefix of the sequences, how many have it, and how many end there."""
    s = sequences.select(items.alias("_s")).groupBy("_s").agg(F.count("*").alias("_n"))
    p = s.select("_n", "_s", F.explode(F.sequence(F.lit(1), F.size("_s"))).alias("depth")).where("size(_s) > 0")
    return p.groupBy(F.slice("_s", F.lit(1), F.col("depth")).alias("prefix"), "depth").agg(F.sum("_n").cast("long").alias("n"), F.sum(F.when(F.col("depth") == F.size("_s"), F.col("_n")).otherwise(0)).cast("long").alias("ends"))


def leaves(nodes: DataFrame) -> DataFrame:
    """Prefixes of a trie that no other continues."""
    parents = nodes.where("depth > 1").select(F.slice("prefix", F.lit(1), F.col("depth") - 1).alias("prefix")).distinct()
    return nodes.join(parents, "prefix", "left_anti")


def vocabulary(items: DataFrame, item: Column) -> DataFrame:
    """Rows (type, n, cls): classes from 1 by falling count, ties by type.

    Ranks come from the counts of counts, of which there are few, so that no one task ranks all types.
    """
    n = items.groupBy(item.alias("type")).agg(F.count("*").alias("n"))
    sizes = n.groupBy("n").agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("n", F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("n").orderBy("type"))
    return n.join(base, "n").select("type", "n", (F.col("_base") + within).cast("long").alias("cls"))


def encode_pattern(classes: Column) -> Column:
    """A binary key of an array of classes: for each the number of its bytes, then the bytes, least first."""

    def one(c: Column) -> Column:
        h = F.hex(c)
        even = F.when(F.length(h) % 2 == 1, F.concat(F.lit("0"), h)).otherwise(h)
        size = (F.length(even) / 2).cast("int")
        rev = F.array_join(F.transform(F.sequence(size, F.lit(1), F.lit(-1)), lambda i: F.substring(even, i * 2 - 1, F.lit(2))), "")
        return F.concat(F.lpad(F.hex(size), 2, "0"), rev)

    return F.unhex(F.array_join(F.transform(classes, lambda c: one(c.cast("long"))), ""))


#: Pairs that a task compares, and rows of which every executor may hold all.
PAIRS_IN_TASK, PAIRS_BROADCAST = 8_000_000, 1_000_000


def ordered_pairs(df: DataFrame, key: str) -> DataFrame:
    """Structs (a, b) of all rows a and b with the key of a less than that of b.

    The rows' number, squared, is the work, so it says into how many tasks it
    is cut, however few files hold the rows.  Up to
    PAIRS_BROADCAST rows of one side are held by every executor.
    """
    n = df.count()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n * n / PAIRS_IN_TASK))
    a, b = (df.select(F.struct(*df.columns).alias(k)) for k in "ab")
    less = F.col(f"a.{key}") < F.col(f"b.{key}")
    return a.repartition(min(tasks, max(n, 1)), f"a.{key}").join(F.broadcast(b) if n <= PAIRS_BROADCAST else b, less)
