"""Association of words that occur in the same line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import pairs


def pair_counts(lines: DataFrame, tokens: Column) -> DataFrame:
    """Rows (a, b, joint, adjacent): how often a stands before b in a line, every pair of places, and next to it."""
    return pairs.counts(lines, tokens).select("a", "b", "joint", "adjacent")


def association(lines: DataFrame, tokens: Column, least: int = 0, discount_adjacent: bool = False) -> DataFrame:
    """Rows (a, b, joint, adjacent, n_a, n_b, pmi, npmi, jaccard, dice, adjacency) of pairs that occur over ``least`` times.

    With T tokens and x the joint count, less the adjacent ones if discounted:
    pmi = ln((x/T) / ((n_a/T)(n_b/T))), npmi = pmi / -ln(x/T),
    jaccard = x / (n_a + n_b - x), dice = 2j / (1 + j), adjacency = adjacent /
    joint.  A score whose x is 0 is null.
    """
    total = lines.agg(F.sum(F.greatest(F.size(tokens), F.lit(0))).cast("double").alias("_t"))
    out = pairs.counts(lines, tokens, least=least).crossJoin(F.broadcast(total))
    x = (F.col("joint") - F.col("adjacent") if discount_adjacent else F.col("joint")).cast("double")
    x, t = F.when(x > 0, x), F.col("_t")
    pmi = F.ln(x * t / (F.col("n_a") * F.col("n_b")))
    j = F.try_divide(x, F.col("n_a") + F.col("n_b") - x)
    return out.select("a", "b", "joint", "adjacent", "n_a", "n_b", pmi.alias("pmi"), F.try_divide(pmi, -F.ln(x / t)).alias("npmi"), j.alias("jaccard"), F.try_divide(2 * j, 1 + j).alias("dice"), (F.col("adjacent") / F.col("joint")).alias("adjacency"))
