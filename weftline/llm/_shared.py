"""What the operators share: the cluster's shared folder, size checks before a broadcast, fresh names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import ensure_workers
from weftline.storage import checkpoint, new_folder, shared_dir, written

__all__ = ["MAX_BROADCAST_ROWS", "checkpoint", "components", "ensure_workers", "few", "fresh", "maybe_broadcast", "new_folder", "shared_dir", "union_of", "written"]

#: Rows of at most a few dozen bytes that may be broadcast; beyond it joins are shuffled.
MAX_BROADCAST_ROWS = 1_000_000


def few(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than that."""
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is checked to be small, else as it is (a shuffled join, split by AQE where skewed)."""
    return F.broadcast(df) if few(df, most) else df


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name for each of ``names`` that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b), ids of any type that is ordered: rows (node, root) for every node but the roots; a root is the least id.

    Alternating large-star and small-star rounds; each is two joins on ids
    alone and every round is checkpointed.  Self loops and repeated edges are
    allowed, nulls are dropped.
    """
    e = checkpoint(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    while True:
        sym = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = sym.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = sym.join(m, sym.a == m.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        m2 = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(m2, large.a == m2.u).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpoint(small.union(m2.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
