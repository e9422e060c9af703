"""Frequency lists and distributions: tables (type, n) and (type, p)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import BEGIN, END


def count_types(df: DataFrame, item: Column, by: list[str] | None = None, case_sensitive: bool = True) -> DataFrame:
    """Rows (by..., type, n); counted on the map side before the one shuffle."""
    item = item if case_sensitive else F.lower(item)
    return df.groupBy(*(by or []), item.alias("type")).agg(F.count("*").alias("n"))


def count_items(df: DataFrame, items: Column, by: list[str] | None = None, case_sensitive: bool = True) -> DataFrame:
    """Like :func:`count_types` for an array of items in each row."""
    return count_types(df.select(*(by or []), F.explode(items).alias("_item")), F.col("_item"), by, case_sensitive)


#: Tokens whose n-grams a worker makes and counts at once.
PIECE = 200_000


def count_ngrams(df: DataFrame, tokens: Column, low: int, high: int, begin: str = BEGIN, end: str = END) -> DataFrame:
    """Like :func:`count_items` of :func:`weftline.functions.text.multi_ngrams`, made and first counted by whole arrays of some lines."""

    def grams(lists: pa.ListArray) -> pa.RecordBatch:
        n = lists.value_lengths().to_numpy().astype(np.int64)
        pad = high - 1
        words = pa.concat_arrays([lists.flatten(), pa.array([begin, end])])
        # places in the words of every line with all its markers, and where lines begin
        first = np.concatenate([[0], np.cumsum(n + 2 * pad)])
        row = np.repeat(np.arange(len(n)), n + 2 * pad)
        k = np.arange(first[-1]) - first[:-1][row] - pad
        place = np.where(k < 0, len(words) - 2, np.where(k >= n[row], len(words) - 1, k + (np.cumsum(n) - n)[row]))
        made = []
        for size in range(low, high + 1):
            at = np.flatnonzero((k >= 1 - size) & (k < n[row]))
            parts = [words.take(pa.array(place[at + i])) for i in range(size)]
            made.append(pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0])
        got = pa.table({"type": pa.chunked_array(made, pa.string())}).group_by("type").aggregate([([], "count_all")]).combine_chunks()
        return pa.RecordBatch.from_arrays([got.column("type").chunk(0), got.column("count_all").chunk(0)], ["type", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            a = 0
            while a < len(lists):
                b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, side="right")), a + 1)
                part = grams(lists.slice(a, b - a))
                for i in range(0, part.num_rows, PIECE):
                    yield part.slice(i, PIECE)
                a = b
            pa.default_memory_pool().release_unused()

    lines = df.select(tokens.alias("_t")).where("_t IS NOT NULL")
    return lines.mapInArrow(run, "type string, n long").groupBy("type").agg(F.sum("n").alias("n"))


def totals(freq: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows (by..., tokens, types, ttr): tokens, distinct types, types per token."""
    t, n = F.sum("n").cast("long"), F.count("*")
    return freq.groupBy(*(by or [])).agg(t.alias("tokens"), n.alias("types"), F.try_divide(n, t).alias("ttr"))


def merge(*lists: DataFrame) -> DataFrame:
    """Lists added up."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out.groupBy("type").agg(F.sum("n").cast("long").alias("n"))


def same(a: DataFrame, b: DataFrame) -> bool:
    return a.select("type", "n").exceptAll(b.select("type", "n")).isEmpty() and b.select("type", "n").exceptAll(a.select("type", "n")).isEmpty()


def contains(freq: DataFrame, types: DataFrame) -> DataFrame:
    """Rows of ``freq`` whose type is in ``types``."""
    return freq.join(types.select("type").distinct(), "type", "left_semi")


def without(freq: DataFrame, types: DataFrame) -> DataFrame:
    return freq.join(types.select("type").distinct(), "type", "left_anti")


def ranked(freq: DataFrame, by: list[str] | None = None) -> DataFrame:
    """With ``rank`` by count from the greatest, ties by type."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("n"), "type")
    return freq.withColumn("rank", F.row_number().over(w))


def most_common(freq: DataFrame, k: int) -> DataFrame:
    """The k greatest, ties by type: a bounded heap in each task, no global sort."""
    return freq.orderBy(F.desc("n"), "type").limit(k)


def mode(freq: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The type of the greatest count (the least of them on a tie)."""
    top = freq.groupBy(*(by or [])).agg(F.max("n").alias("n"))
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by or []]
    on = F.col("a.n") == F.col("b.n")
    for c in cond:
        on = on & c
    hit = freq.alias("a").join(top.alias("b"), on)
    return hit.groupBy(*(F.col(f"a.{c}") for c in by or []), F.col("a.n")).agg(F.min("a.type").alias("type"))


def distribution(freq: DataFrame, by: list[str] | None = None, weight: str = "n") -> DataFrame:
    """Rows (by..., type, n, p): shares of the total, joined from an aggregate so that no single task sees all types."""
    total = freq.groupBy(*(by or [])).agg(F.sum(weight).alias("_total"))
    out = freq.join(total, by) if by else freq.crossJoin(F.broadcast(total))
    return out.withColumn("p", F.try_divide(F.col(weight).cast("double"), F.col("_total"))).drop("_total")


def renormalized(dist: DataFrame, low: float = 0.999, high: float = 1.0) -> DataFrame:
    """Probabilities divided by their sum where that is outside [low, high]."""
    total = dist.agg(F.sum("p").alias("_s"))
    s = F.col("_s")
    return dist.crossJoin(F.broadcast(total)).withColumn("p", F.when(s.between(low, high), F.col("p")).otherwise(F.try_divide("p", s))).drop("_s")


def information(p: Column | str, base: float = 2.0) -> Column:
    """-log p; null for 0."""
    p = F.col(p) if isinstance(p, str) else p
    return -F.ln(F.nullif(p, F.lit(0.0))) / math.log(base)


def entropy(dist: DataFrame, by: list[str] | None = None, base: float = 2.0) -> DataFrame:
    """Rows (by..., types, entropy, perplexity, max_entropy); 0 log 0 is 0."""
    h = F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0)) / math.log(base)
    return (
        dist.groupBy(*(by or []))
        .agg(F.count("*").alias("types"), h.alias("entropy"))
        .withColumn("perplexity", F.pow(F.lit(base), "entropy"))
        .withColumn("max_entropy", F.ln("types") / math.log(base))
    )


def freqlist(df: DataFrame, items: Column, base: float = 2.0, case_sensitive: bool = True) -> DataFrame:
    """Rows (type, n, p, information), the table of the frequency-list tool."""
    return distribution(count_items(df, items, None, case_sensitive)).withColumn("information", information("p", base))


def save(freq: DataFrame, path: str, add_p: bool = False) -> None:
    """Tab-separated type, count and (if asked for) share."""
    out = distribution(freq) if add_p else freq
    out.select("type", "n", *(["p"] if add_p else [])).write.csv(path, sep="\t", header=False, quote="", escape="", emptyValue="")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="type string, n long, p double", quote="").select("type", "n")


def tag_lists(tokens: DataFrame) -> DataFrame:
    """Rows (list, type, n): words, lemma with tag."""
    head = F.regexp_extract("postag", r"^([^(]+)", 1)
    kinds = {"word": F.col("word"), "lemma.pos.head": F.concat_ws(".", "lemma", head), "pos.head": head, "pos": F.col("postag")}
    return (
        tokens.select(F.explode(F.array(*(F.struct(F.lit(k).alias("list"), v.alias("type")) for k, v in kinds.items()))).alias("x"))
        .groupBy("x.list", "x.type")
        .agg(F.count("*").alias("n"))
    )
