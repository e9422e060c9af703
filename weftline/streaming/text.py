"""Streams of text: the native text functions are stateless and run on streams as they are; counts keep state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 100, whole: bool = False) -> DataFrame:
    """A stream (value) of lines, or of whole files, as they appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=whole)


def sentences(lines: DataFrame, text: str = "value") -> DataFrame:
    """Rows (sentence): tokenised sentences, a line at a time."""
    return lines.select(F.explode(T.split_sentences(T.tokenize(text))).alias("sentence"))


def tokens(lines: DataFrame, text: str = "value") -> DataFrame:
    return lines.select(F.explode(T.tokenize(text)).alias("token"))


def reflowed(files: DataFrame, text: str = "value") -> DataFrame:
    """Rows (line) of whole files with wrapped lines joined."""
    return files.select(F.explode(T.reflow(text)).alias("line"))


def running_frequencies(lines: DataFrame, items: Column) -> DataFrame:
    """Rows (type, n) over all of the stream so far; for output mode update or complete."""
    return lines.select(F.explode(items).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def windowed_frequencies(rows: DataFrame, items: Column, time: str, window: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows (start, end, type, n) by event time; what is later than ``late`` is dropped and its state freed."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    out = rows.withWatermark(time, late).select(w.alias("w"), F.explode(items).alias("type")).groupBy("w", "type").agg(F.count("*").alias("n"))
    return out.select("w.start", "w.end", "type", "n")
