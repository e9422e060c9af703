"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._shared import checkpoint, fresh, maybe_broadcast

#: White space between tokens, the same in Java and RE2.
TOKEN = r"[^ \t\n\r\f]+"


def _targets(docs: DataFrame, weights: dict[str, float] | DataFrame) -> DataFrame:
    if isinstance(weights, DataFrame):
        return weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("_weight"))
    rows = [(k, float(v)) for k, v in weights.items()]
    return docs.sparkSession.createDataFrame(rows, "_source string, _weight double")


def source_rates(
    docs: DataFrame, weights: dict[str, float] | DataFrame, default_weight: float = 1.0, budget_tokens: int | None = None
) -> DataFrame:
    """Rows (source, tokens, weight, rate), one for each source that occurs.

    ``rate`` is how often each document of the source is to be repeated so that
    the source has ``weight`` / (sum of weights) of ``budget_tokens`` (by
    default the tokens there are).  A source not named in ``weights`` has
    ``default_weight``; the null source is one like any other.  Only sources
    with tokens share in the weights; one without has rate 0.
    """
    stats = docs.groupBy(F.col("source").alias("source")).agg(
        F.coalesce(F.sum(F.regexp_count("text", F.lit(TOKEN))), F.lit(0)).cast("long").alias("tokens")
    )
    t = _targets(docs, weights)
    stats = (
        stats.join(t, stats.source.eqNullSafe(t._source), "left")
        .groupBy("source", "tokens")
        .agg(F.max("_weight").alias("_weight"))
        .select("source", "tokens", F.coalesce("_weight", F.lit(float(default_weight))).alias("weight"))
    )
    stats = checkpoint(stats)  # read twice below, and by the caller
    total = stats.agg(
        F.sum("tokens").cast("double").alias("_all"), F.sum(F.when(F.col("tokens") > 0, F.col("weight"))).alias("_sum")
    )
    budget = F.col("_all") if budget_tokens is None else F.lit(float(budget_tokens))
    rate = F.try_divide(F.col("weight") * budget, F.col("_sum") * F.col("tokens").cast("double"))
    return stats.crossJoin(F.broadcast(total)).select(
        "source", "tokens", "weight", F.coalesce(F.when(F.col("tokens") > 0, rate), F.lit(0.0)).alias("rate")
    )


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | DataFrame,
    default_weight: float = 1.0,
    budget_tokens: int | None = None,
    seed: int = 0,
    copy_col: str | None = "copy",
) -> DataFrame:
    """``docs`` with each row emitted floor(rate) times and once more if its seeded draw is below the fraction of the rate.

    The draw is a hash of ``seed`` and ``doc_id`` (of the text where the id is
    null), so it doesn't depend on partitioning or retries; repeated rows draw
    alike.  Texts that are null or empty have no tokens and follow the rate of
    their source.  All columns are kept; ``copy_col`` (1, 2, ...) is added
    unless None, and replaces a column of that name.  An empty table gives none.

    Two passes over ``docs``: one reads source and text for the totals, which
    are combined before the shuffle so a hot source is no burden; the other is
    a map.  The rates are broadcast if checked to be few, else joined.
    """
    src, rate, n = fresh(docs, "_mix_source", "_mix_rate", "_mix_n")
    rates = checkpoint(
        source_rates(docs, weights, default_weight, budget_tokens).select(F.col("source").alias(src), F.col("rate").alias(rate))
    )
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit(""))))))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    whole = F.floor(rate)
    out = docs.join(maybe_broadcast(rates), F.col("source").eqNullSafe(F.col(src)), "inner")
    out = out.withColumn(n, (whole + (draw < F.col(rate) - whole).cast("long")).cast("int")).where(F.col(n) > 0)
    copies = F.explode(F.sequence(F.lit(1), F.col(n)))
    keep = [c for c in docs.columns if copy_col is None or c.lower() != copy_col.lower()]
    if copy_col is None:
        (tmp,) = fresh(docs, "_mix_copy")
        return out.select(*keep, copies.alias(tmp)).drop(tmp)
    return out.select(*keep, copies.alias(copy_col))


def mix_sql(weights: dict[str, float], default_weight: float = 1.0, seed: int = 0) -> str:
    """DuckDB's version of :func:`mix_sources` over ``documents``."""
    values = ", ".join(f"('{k}', {float(v)}::DOUBLE)" for k, v in weights.items())
    return f"""
WITH t(source, weight) AS (VALUES {values}),
stats AS (
  SELECT source, COALESCE(SUM(LEN(regexp_extract_all(text, '{TOKEN}'))), 0)::DOUBLE AS tokens
  FROM documents GROUP BY source),
w AS (
  SELECT s.source, s.tokens, COALESCE(t.weight, {float(default_weight)}::DOUBLE) AS weight
  FROM stats s LEFT JOIN t ON s.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT source, CASE WHEN tokens > 0 THEN
      weight * SUM(tokens) OVER () / (SUM(CASE WHEN tokens > 0 THEN weight END) OVER () * tokens) ELSE 0 END AS rate
  FROM w),
n AS (
  SELECT d.*, FLOOR(rate)::INT + (CASE WHEN
      ('0x' || SUBSTR(MD5('{seed}:' || COALESCE(d.doc_id::VARCHAR, 'text:' || MD5(COALESCE(d.text, '')))), 1, 13))::BIGINT
        / 4503599627370496.0::DOUBLE < rate - FLOOR(rate) THEN 1 ELSE 0 END) AS n
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, text, lang, source, n_chars, UNNEST(RANGE(1, n + 1))::INT AS copy FROM n WHERE n > 0"""
