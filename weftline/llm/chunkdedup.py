"""Repeated substrings by content-defined chunking with a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import _bytes as B

_r = np.random.default_rng(2016)
GEAR = _r.integers(0, 1 << 32, 256, np.uint32)
_SECOND = _r.integers(0, 1 << 63, 256, np.uint64)
#: Bytes that the 32-bit gear hash depends on.
WINDOW = 32


def gear(data: np.ndarray, off: np.ndarray | None = None) -> np.ndarray:
    """The gear hash after every byte: h = (h << 1) + GEAR[byte], of which the last 32 bytes count; by doubling the window.

    With the bounds ``off`` of texts, of these only the bytes of its own text.
    """
    h = GEAR[data]
    k = 1
    while k < WINDOW and k < len(h):
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint32(k)
        for j in range(k if off is not None else 0):  # the first k bytes of a text have nothing k bytes before them
            at = off[:-1] + j
            at = at[at < off[1:]]
            nxt[at] = h[at]
        h, k = nxt, 2 * k
    return h


def cut(data: np.ndarray, off: np.ndarray, least: int, bits: int, most: int, alone: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the text, beginning and end of every chunk; ``off`` has the n + 1 bounds of the texts.

    A chunk ends after a byte where the top ``bits`` bits of the gear hash are
    zero, once it has ``least`` bytes; at ``most`` bytes; or with the text.  The
    hash begins anew with each text, so that equal texts are cut alike.  The
    texts are walked side by side, one chunk of each at a time.
    """
    marks = np.flatnonzero(gear(data, off if alone else None) >> np.uint32(32 - bits) == 0) + 1
    marks = np.append(marks, len(data) + most + 1)
    doc, a, b = [], [], []
    live = np.flatnonzero(np.diff(off) > 0)
    at = off[live]
    while len(live):
        end = np.minimum(np.minimum(marks[np.searchsorted(marks, at + least)], at + most), off[live + 1])
        doc.append(live)
        a.append(at)
        b.append(end)
        more = end < off[live + 1]
        live, at = live[more], end[more]
    if not doc:
        z = np.zeros(0, np.int64)
        return z, z, z
    return np.concatenate(doc), np.concatenate(a), np.concatenate(b)


def chunks(docs: DataFrame, least: int, bits: int, most: int) -> DataFrame:
    """Rows (d1, d2, salt, doc_id, start, stop) of every chunk with its digest.

    A chunk that has an earlier equal one in its Arrow batch is a later copy
    for certain; its salt scatters it, so that however common a chunk is, a
    digest meets at most one row of each batch.  For others the salt is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), B.filled(batch.column(1))
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for lo, hi in B.pieces(text):
                data, off = B.buffer(text.slice(lo, hi - lo))
                doc, a, b = cut(data, off, least, bits, most, alone=True)
                pw, _ = B.powers(len(data) + 1)
                s2 = np.zeros(len(data) + 1, B.U64)
                np.cumsum(_SECOND[data] * pw[: len(data)], out=s2[1:])
                got = (B.range_hash(B.prefix_hash(data), a, b), B.range_hash(s2, a, b), ids[lo + doc], a - off[doc], b - off[doc])
                for c, x in zip(cols, got, strict=True):
                    c.append(x)
            if not cols[0]:
                continue
            d1, d2, doc, a, b = map(np.concatenate, cols)
            order = np.lexsort((a, doc))
            d1, d2, doc, a, b = d1[order], d2[order], doc[order], a[order], b[order]
            code, uniq = pd.factorize(d1 ^ (d2 << B.U64(1)))
            first = np.empty(len(uniq), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            again = (first[code] != np.arange(len(code))) & (d1[first[code]] == d1) & (d2[first[code]] == d2)
            salt = np.where(again, B.mix(doc.astype(B.U64) * B.U64(31) + a.astype(B.U64)) | B.U64(1), B.U64(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (d1.view(np.int64), d2.view(np.int64), salt.view(np.int64), doc, a.astype(np.int32), b.astype(np.int32))],
                ["d1", "d2", "salt", "doc_id", "start", "stop"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text <> ''")
    return rows.mapInArrow(run, "d1 long, d2 long, salt long, doc_id long, start int, stop int")


def repeated_chunks(docs: DataFrame, least: int = 16, bits: int = 5, most: int = 256, min_span: int = 80) -> DataFrame:
    """Rows (doc_id, start, stop, n_chunks): byte ranges of the UTF-8 texts that repeat earlier text, to be removed.

    Every chunk equal to one before it, by doc_id and place, is a later copy;
    the first stays.  Copies next to each other are one range; ranges under
    ``min_span`` bytes are left alone.  As chunks are bounded by content, an
    insertion shifts the bounds around it only.

    Null ids and null or empty texts give no rows; rows that repeat an id have
    their texts compared like any others, repeated rows being copies from the
    first byte on.  One shuffle of 36 bytes a chunk; common chunks are
    collapsed before it, in each batch.
    """
    c = chunks(docs, least, bits, most)
    by = Window.partitionBy("d1", "d2", "salt").orderBy("doc_id", "start")
    again = c.withColumn("k", F.row_number().over(by)).where("salt <> 0 OR k > 1").select("doc_id", "start", "stop")
    doc = Window.partitionBy("doc_id").orderBy("start", "stop")
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        again.withColumn("new", (F.col("start") > F.coalesce(F.max("stop").over(before), F.lit(-1))).cast("int"))
        .withColumn("span", F.sum("new").over(doc))
        .groupBy("doc_id", "span")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").cast("int").alias("n_chunks"))
    )
    return spans.where(F.col("stop") - F.col("start") >= min_span).select("doc_id", "start", "stop", "n_chunks")
