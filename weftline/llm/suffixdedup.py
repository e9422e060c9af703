"""Repeated passages by suffix arrays: an array of longest previous factors tells the later copies from the first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import _bytes as B

#: Words that an anchor is the hash of.
ANCHOR = 12


def suffix_array(codes: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of ``codes`` sorted by their first ``most`` or more symbols, and the ranks of each power of two below that.

    Prefix doubling: ranks by 2k symbols come from sorting pairs of ranks by k.
    """
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels, k, n = [rank], 1, len(codes)
    while k < most and n:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * np.int64(n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        rank, k = new, 2 * k
        levels.append(rank)
        if rank[order[-1]] == n - 1:
            break
    return np.argsort(rank, kind="stable"), levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, below twice the symbols of the last level: equal ranks of 2**k symbols are 2**k equal symbols."""
    n = len(levels[0])
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero((a < n) & (b < n))
        same = fits[levels[k][a[fits]] == levels[k][b[fits]]]
        a[same] += 1 << k
        b[same] += 1 << k
        out[same] += 1 << k
    return out


def longest_previous(place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in sorted order: the longest prefix that each shares with one of a smaller ``place``, and which that is (-1: none).

    ``lcp[i]`` is what i - 1 and i share.  An earlier match of greatest length
    is the previous or the next smaller place in the order.  Both are found for
    all suffixes at once by pointer jumping: whoever points to a larger place
    takes over that one's pointer, as all between are larger still.
    """

    def one_side(place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(place)
        to, share = np.arange(n) - 1, lcp.copy()
        live = np.arange(1, n)
        while len(live):
            live = live[(to[live] >= 0)]
            live = live[place[to[live]] > place[live]]
            nxt = to[live]
            share[live], to[live] = np.minimum(share[live], share[nxt]), to[nxt]
        share[to < 0] = 0
        return to, share

    n = len(place)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, ps = one_side(place, np.concatenate([[0], lcp[1:]]))
    q, qs = one_side(place[::-1], np.concatenate([[0], lcp[1:][::-1]]))
    q, qs = n - 1 - q[::-1], qs[::-1]
    q = np.where(q >= n, -1, q)
    return np.maximum(ps, qs), np.where((ps == 0) & (qs == 0), -1, np.where(ps >= qs, p, q))


def anchors(h: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window of ``least`` words the anchor that its words choose.

    Returns text, hash, place of the first window and number of windows for
    each run of consecutive windows with the same anchor: the least hash of
    ANCHOR words (of ``least``, if that is fewer) inside the window, the
    rightmost on a tie.  Equal windows choose alike.
    """
    wide = min(ANCHOR, least)
    n = np.diff(first)
    span = least - wide + 1
    long = np.flatnonzero(n >= least)
    if not len(long):
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, B.U64), z, z
    size = len(h) - wide + 1
    g = np.zeros(size, B.U64)
    for k in range(wide):
        g = g * B.U64(0x9FB21C651E98DF25) + h[k : size + k]
    g = B.mix(g)
    # least of the next `span` hashes, by doubling; places break ties to the right
    value, at, have = g.copy(), np.arange(size), 1
    while have < span:
        step = min(have, span - have)
        left = value[:-step] < value[step:]
        value[:-step], at[:-step] = np.where(left, value[:-step], value[step:]), np.where(left, at[:-step], at[step:])
        have += step
    count = n[long] - least + 1
    begin = np.repeat(first[:-1][long], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc = np.repeat(long, count)
    a = at[begin]
    runs = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])))
    return doc[runs], g[a[runs]], begin[runs], np.diff(np.append(runs, len(a)))


def _scatter(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    return B.mix(doc.astype(B.U64) * B.U64(0x9FB21C651E98DF25) + place.astype(B.U64)) | B.U64(1)


def _leaders(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For every row the first in ``order`` of those with its key."""
    code, uniq = pd.factorize(key[order])
    first = np.empty(len(uniq), np.int64)
    first[code[::-1]] = order[::-1]
    out = np.empty(len(key), np.int64)
    out[order] = first[code]
    return out


def _anchor_rows(src: DataFrame, least: int) -> DataFrame:
    """Rows (doc_id, h, anchor, place, windows, salt, weight) for the runs of windows of every text.

    An anchor that occurs again in its batch is shared for certain: all its rows
    but one are scattered by a salt, the one left stands for them by its weight.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids, h = B.filled(batch.column(2)), batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for lo, hi in B.pieces(text):
                w = B.words(text.slice(lo, hi - lo))
                doc, g, at, n = anchors(w.hash, w.first, least)
                for c, x in zip(cols, (lo + doc, g, at - w.first[doc], n), strict=True):
                    c.append(x)
            if not cols[0]:
                continue
            doc, g, at, n = map(np.concatenate, cols)
            lead = _leaders(np.arange(len(g)), g)
            weight = np.bincount(lead, minlength=len(g)).astype(np.int32)
            salt = np.where(lead == np.arange(len(g)), B.U64(0), _scatter(doc, at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (ids[doc], h[doc], g.view(np.int64), at.astype(np.int32), n.astype(np.int32), salt.view(np.int64), weight)],
                ["doc_id", "h", "anchor", "place", "windows", "salt", "weight"],
            )

    return src.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, anchor long, place int, windows int, salt long, weight int")


def _segments(joined: DataFrame, least: int) -> DataFrame:
    """The words of every run of windows: rows (key, doc_id, place, windows, words, first_doc_id), words as 32-bit hashes.

    ``key`` is the anchor.  A segment that equals an earlier one of its anchor
    and batch is a later copy for certain: it has no words but the id of that
    one, and a scattered key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids = B.filled(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            runs = batch.column(2)
            inner = runs.flatten()
            off = np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy())])
            anchor, place, n = (inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            row = np.repeat(np.arange(len(ids)), np.diff(off))
            words, digest = [], []
            for lo, hi in B.pieces(text):
                w = B.words(text.slice(lo, hi - lo))
                x, y = off[lo], off[hi]
                size = n[x:y] + least - 1
                begin = w.first[row[x:y] - lo] + place[x:y]
                to = np.concatenate([[0], np.cumsum(size)])
                within = np.arange(to[-1]) - np.repeat(to[:-1], size)
                flat = w.hash[within + np.repeat(begin, size)]
                pw, _ = B.powers(int(size.max(initial=0)) + 1)
                if len(size):
                    digest.append(B.mix(np.add.reduceat(flat * pw[within], to[:-1]) ^ anchor[x:y].view(B.U64)) + size.view(B.U64))
                flat = (flat >> B.U64(32)).astype("<u4")
                words += [flat[to[k] : to[k + 1]].tobytes() for k in range(len(size))]
            if not digest:
                continue
            lead = _leaders(np.lexsort((place, ids[row])), np.concatenate(digest))
            own = lead == np.arange(len(lead))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(own, anchor, _scatter(ids[row], place).view(np.int64))),
                    pa.array(ids[row]),
                    pa.array(place.astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array([x if o else None for x, o in zip(words, own, strict=True)], pa.binary()),
                    pa.array(ids[row][lead], mask=own),
                ],
                ["key", "doc_id", "place", "windows", "words", "first_doc_id"],
            )

    return joined.select("doc_id", "text", "runs").mapInArrow(run, "key long, doc_id long, place int, windows int, words binary, first_doc_id long")


def repeats_of(doc: np.ndarray, place: np.ndarray, windows: np.ndarray, words: list[bytes], least: int) -> pd.DataFrame:
    """Rows (doc_id, start, stop, first_doc_id) of the later copies among some segments, by their longest previous factors.

    The segments are those of some anchors, all of each.  Windows are ordered by
    document and place; suffixes that begin where a segment has no window left
    serve the comparison only.
    """
    size = np.array([len(x) // 4 for x in words])
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    codes = np.empty(int(size.sum() + len(size)), np.int64)
    fill = np.ones(len(codes), np.bool_)
    fill[begin + size] = False
    codes[fill] = np.frombuffer(b"".join(words), "<u4")
    codes[~fill] = (1 << 32) + np.arange(len(size))  # separators that equal nothing
    order, levels = suffix_array(codes, least)
    segment = np.repeat(np.arange(len(size)), size + 1)
    inside = np.arange(len(codes)) - begin[segment]
    order = order[inside[order] < windows[segment[order]]]
    seg = segment[order]
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = common_prefix(levels, order[:-1], order[1:])
    at = place[seg] + inside[order]
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((seg, at, doc[seg]))] = np.arange(len(order))
    length, source = longest_previous(rank, lcp)
    hit = np.flatnonzero(length >= least)
    out = pd.DataFrame({"doc_id": doc[seg[hit]], "start": at[hit], "stop": at[hit] + length[hit], "first_doc_id": doc[seg[source[hit]]], "seg": seg[hit]})
    # windows that overlap are one span
    out = out.sort_values(["seg", "start"], kind="stable", ignore_index=True)
    run = ((out["seg"] != out["seg"].shift()) | (out["start"] > out["stop"].shift())).cumsum()
    return out.groupby(run).agg(doc_id=("doc_id", "first"), start=("start", "min"), stop=("stop", "max"), first_doc_id=("first_doc_id", "min"))


def _copies(segments: DataFrame, least: int, at_once: int = 400_000) -> DataFrame:
    """Later copies among all segments; those of some anchors at once, until they have ``at_once`` words."""
    schema = "doc_id long, start int, stop int, first_doc_id long"

    def batch_of(out: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out[c].to_numpy(), t) for c, t in (("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("first_doc_id", pa.int64()))], ["doc_id", "start", "stop", "first_doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            pdf = batch.to_pandas()
            sure = pdf[pdf["words"].isna()]
            if len(sure):
                start = sure["place"].to_numpy()
                yield batch_of(pd.DataFrame({"doc_id": sure["doc_id"], "start": start, "stop": start + sure["windows"].to_numpy() + least - 1, "first_doc_id": sure["first_doc_id"].astype("int64")}))
            pdf = pdf[pdf["words"].notna()]
            size = (pdf["words"].str.len() // 4).cumsum().to_numpy()
            key, a = pdf["key"].to_numpy(), 0
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            for b in new:  # every anchor begins a new group if enough is held
                if n + (size[b - 1] - (size[a - 1] if a else 0) if b > a else 0) >= at_once and (b > 0 or not held or held[-1]["key"].iloc[-1] != key[0]):
                    held.append(pdf.iloc[a:b])
                    yield batch_of(_of(pd.concat(held), least))
                    held, n, a = [], 0, b
            if a < len(pdf):
                held.append(pdf.iloc[a:])
                n += size[-1] - (size[a - 1] if a else 0)
        if held:
            yield batch_of(_of(pd.concat(held), least))

    return segments.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _of(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    return repeats_of(pdf["doc_id"].to_numpy(), pdf["place"].to_numpy(np.int64), pdf["windows"].to_numpy(np.int64), list(pdf["words"]), least)


def repeated_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """Rows (doc_id, start, stop, first_doc_id): ranges of words that repeat earlier text and are to be removed.

    Every run of at least ``least`` words (case and punctuation ignored) that
    stood before, in a document of a smaller id or earlier in the same one, is a
    later copy; the first stays.  ``start`` and ``stop`` count a document's
    words; ``first_doc_id`` is the least id among the earlier matches found.

    Each window of ``least`` words chooses an anchor among its words, equal
    windows the same.  Anchors that occur once are dropped; the words around the
    others are brought together by anchor, and there a suffix array and its
    longest previous factors are built.  So every pair of equal windows meets in
    one place, and the result is exact but for collisions of hashes.  Segments
    that equal one before in their batch are settled there, so that a passage
    that is everywhere makes no large group.

    Null ids and texts, and texts with fewer words, have no rows; rows that
    repeat an id are compared like any others, a repeated row being a copy of
    the first.  The texts of documents with shared anchors are shuffled once.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = _anchor_rows(src, least)
    shared = found.withColumn("n", F.sum("weight").over(Window.partitionBy("anchor", "salt"))).where("salt <> 0 OR n > 1")
    runs = shared.groupBy("doc_id", "h").agg(F.collect_set(F.struct("anchor", "place", "windows")).alias("runs"))
    copies = _copies(_segments(src.join(runs, ["doc_id", "h"]), least), least)
    doc = Window.partitionBy("doc_id").orderBy("start", "stop")
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    return (
        copies.withColumn("new", (F.col("start") > F.coalesce(F.max("stop").over(before), F.lit(-1))).cast("int"))
        .withColumn("span", F.sum("new").over(doc))
        .groupBy("doc_id", "span")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_doc_id").alias("first_doc_id"))
        .select("doc_id", "start", "stop", "first_doc_id")
    )
