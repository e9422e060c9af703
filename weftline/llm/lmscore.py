"""Likelihood of documents under a unigram model of subwords, summed over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import _bytes as B
from weftline.llm._shared import ensure_workers, written

_GAP = np.ones(256, np.bool_)
_GAP[list(b" \t\n\r\x0b\x0c")] = False
#: Bytes of words whose lattices are held at once.
LATTICE = 400_000


class Vocabulary:
    """Pieces of a vocabulary file as bytes, a blank standing for the mark of a word's beginning, with first weights from its scores.

    A single byte that is no piece by itself has the file's byte piece, so any
    text has a segmentation.  The scores of a merge vocabulary are ranks, not
    probabilities: piece of rank r begins with a weight of 1 / (r + 3).
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, tuple[int, float]] = {}
        spare: dict[bytes, tuple[int, float]] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i):
                continue
            if sp.is_byte(i):
                spare[bytes([int(sp.id_to_piece(i)[3:5], 16)])] = (i, 40_000.0)
                continue
            b = sp.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in b[1:]:
                found[b] = (i, max(0.0, -sp.get_score(i)))
        spare.pop(b"\n", None)
        found = {**spare, **found}
        self.pieces = sorted(found)
        self.ids = np.array([found[b][0] for b in self.pieces])
        w = 1.0 / (np.array([found[b][1] for b in self.pieces]) + 3.0)
        self.prior = np.log(w / w.sum())
        self.longest = max(map(len, self.pieces))
        # table of hashes: a place has the pieces begin[h] to begin[h + 1]
        text = pa.array(self.pieces, pa.binary())
        data, off = B.buffer(text.cast(pa.large_binary()))
        s, (_, inv) = B.prefix_hash(data), B.powers(len(data) + 1)
        key = B.mix((s[off[1:]] - s[off[:-1]]) * inv[off[:-1]])
        order = np.argsort(key >> B.U64(46), kind="stable")
        self.key, self.of = np.append(key[order], B.U64(0)), np.append(order, 0)
        self.begin = np.searchsorted((key[order] >> B.U64(46)).astype(np.int64), np.arange((1 << 18) + 1))
        self.count = np.diff(self.begin).astype(np.uint8)
        self.ways = int(self.count.max())

    def find(self, key: np.ndarray) -> np.ndarray:
        """Piece of every hash, or the number of pieces for none."""
        h = (key >> B.U64(46)).astype(np.int64)
        n = self.count[h]
        out = np.full(len(key), len(self.pieces), np.int32)
        for k in range(self.ways):
            some = np.flatnonzero(n > k)
            p = self.begin[h[some]] + k
            hit = self.key[p] == key[some]
            out[some[hit]] = self.of[p[hit]]
        return out


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def lattice(v: Vocabulary, raw: np.ndarray) -> np.ndarray:
    """Piece at [l - 1, word, i] that is bytes i to i + l of a word, for words of equal length in the rows of ``raw``."""
    n, size = raw.shape
    pw, inv = B.powers(size + 1)
    s = np.zeros((n, size + 1), B.U64)
    np.cumsum((raw.astype(B.U64) + B.U64(1)) * pw[:size], axis=1, out=s[:, 1:])
    most = min(size, v.longest)
    out = np.full((most, n, size), len(v.pieces), np.int32)
    for k in range(1, most + 1):
        key = B.mix(((s[:, k:] - s[:, : size + 1 - k]) * inv[: size + 1 - k]).ravel())
        out[k - 1, :, : size + 1 - k] = v.find(key).reshape(n, -1)
    return out


def _logsum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials over the first axis."""
    m = x.max(axis=0)
    safe = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe).sum(axis=0)) + safe


def forward(score: np.ndarray) -> np.ndarray:
    """Log of the summed weights of all segmentations of each word's first j bytes; ``score`` is [length - 1, word, begin]."""
    most, n, size = score.shape
    a = np.full((size + 1, n), -np.inf)
    a[0] = 0.0
    for j in range(1, size + 1):
        k = min(j, most)
        a[j] = _logsum(np.stack([a[j - x] + score[x - 1, :, j - x] for x in range(1, k + 1)]))
    return a


def backward(score: np.ndarray) -> np.ndarray:
    most, n, size = score.shape
    b = np.full((size + 1, n), -np.inf)
    b[size] = 0.0
    for i in range(size - 1, -1, -1):
        k = min(size - i, most)
        b[i] = _logsum(np.stack([b[i + x] + score[x - 1, :, i] for x in range(1, k + 1)]))
    return b


def by_length(start: np.ndarray, end: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Words of equal length, so many at once that their lattices fit LATTICE."""
    size = end - start
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(size[order]) > 0)) if len(order) else order
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=len(order) > 0):
        n = int(size[order[a]])
        step = max(1, LATTICE * 8 // (n * min(n, longest)))
        for k in range(a, b, step):
            yield order[k : min(k + step, b)]


def distinct_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, begin and end of every distinct word, which one each word is, its text, and the sizes of the texts."""
    data, off = B.buffer(text)
    a, b = B.runs(_GAP[data], off)
    doc = np.searchsorted(off, a, side="right") - 1
    key = np.empty(len(a), B.U64)
    for lo, hi in B.pieces(text):  # the sums of a hash take eight times the text
        x, y = np.searchsorted(a, off[[lo, hi]])
        key[x:y] = B.range_hash(B.prefix_hash(data[off[lo] : off[hi]]), a[x:y] - off[lo], b[x:y] - off[lo])
    code, uniq = pd.factorize(key ^ (b - a).astype(B.U64))
    first = np.empty(len(uniq), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return data, a[first], b[first], code, doc, np.diff(off)


def _rows(data: np.ndarray, a: np.ndarray, size: int) -> np.ndarray:
    """Words with a blank before each."""
    raw = np.full((len(a), size + 1), 32, np.uint8)
    raw[:, 1:] = data[a[:, None] + np.arange(size)]
    return raw


def word_scores(v: Vocabulary, logp: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability of every word over all its segmentations."""
    padded, out = np.append(logp, -np.inf), np.zeros(len(a))
    for some in by_length(a, b, v.longest):
        size = int(b[some[0]] - a[some[0]])
        out[some] = forward(padded[lattice(v, _rows(data, a[some], size))])[-1]
    return out


def expected_counts(v: Vocabulary, logp: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words that occur ``times``, over all segmentations."""
    padded, out = np.append(logp, -np.inf), np.zeros(len(logp) + 1)
    for some in by_length(a, b, v.longest):
        size = int(b[some[0]] - a[some[0]]) + 1
        piece = lattice(v, _rows(data, a[some], size - 1))
        score = padded[piece]
        f, r = forward(score), backward(score)
        weight = times[some]
        for k in range(1, len(piece) + 1):
            p, at = piece[k - 1, :, : size + 1 - k].T, f[: size + 1 - k] + r[k:] - f[size]
            hit = p < len(logp)
            post = np.exp(at[hit] + padded[p[hit]]) * np.broadcast_to(weight, p.shape)[hit]
            out += np.bincount(p[hit], post, len(out))
    return out[:-1]


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n): how often each distinct word of all texts occurs.

    Words are counted in every stretch of a task's texts and merged on the map
    side before the one shuffle, which carries the distinct words of each task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = B.filled(batch.column(0))
            for lo, hi in B.pieces(text, 3 * B.CHUNK):
                data, a, b, code, _, _ = distinct_words(text.slice(lo, hi - lo))
                n = np.bincount(code, minlength=len(a))
                for x in range(0, len(a), 50_000):
                    size = (b - a)[x : x + 50_000]
                    to = np.concatenate([[0], np.cumsum(size)])
                    flat = data[np.arange(to[-1]) + np.repeat(a[x : x + 50_000] - to[:-1], size)]
                    word = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(to), pa.py_buffer(flat)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([word, pa.array(n[x : x + 50_000])], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, model: str, rounds: int = 1, smooth: float = 0.1) -> np.ndarray:
    """Log probabilities of the vocabulary's pieces, re-estimated on all of ``docs`` by ``rounds`` of expectation maximisation.

    What is gathered from the corpus is the count of every distinct word, which
    grows with it; the expected counts of pieces are computed once a distinct
    word instead of wherever it stands, so further rounds don't read the texts
    again.  The result is one number a piece of the fixed vocabulary.
    """
    ensure_workers(docs.sparkSession)
    v = vocabulary(model)
    logp = v.prior
    words = word_counts(docs)
    if rounds > 1:
        words = written(words, "words")
    for _ in range(rounds):
        shipped = docs.sparkSession.sparkContext.broadcast(logp)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = vocabulary(model)
            total = np.zeros(len(v.pieces))
            for batch in batches:
                data, off = B.buffer(batch.column(0))
                total += expected_counts(v, shipped.value, data, off[:-1], off[1:], batch.column(1).to_numpy().astype(float))
            some = np.flatnonzero(total > 0)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["piece", "n"])

        got = words.mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        c = np.full(len(v.pieces), smooth)
        np.add.at(c, got["piece"].to_numpy(np.int64), got["n"].to_numpy(float))
        logp = np.log(c / c.sum())
    return logp


def score(docs: DataFrame, model: str, logp: np.ndarray | None = None, rounds: int = 1) -> DataFrame:
    """Rows (doc_id, n_words, n_bytes, log_prob, bits_per_byte), one for each row of ``docs``.

    ``log_prob`` is the natural logarithm of the document's marginal
    probability: the summed probability of all ways to write its words, each
    with a blank before it, in pieces of the vocabulary at ``model`` (a path
    that all workers can read).  No piece spans a blank, so it is the sum over
    words.  ``bits_per_byte`` relates it to the words' bytes with their blanks;
    a low one means text like the corpus.  Probabilities come from :func:`train`
    on ``docs`` unless given.

    A null or empty text has no words, a log_prob of 0 and null bits; repeated
    rows are scored alike; null ids stay null.  Words are scored once for each
    stretch of texts however often they occur there.
    """
    if logp is None:
        logp = train(docs, model, rounds)
    shipped = docs.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            text = B.filled(batch.column(1))
            for lo, hi in B.pieces(text, 3 * B.CHUNK):
                data, a, b, code, doc, _ = distinct_words(text.slice(lo, hi - lo))
                s = word_scores(v, shipped.value, data, a, b)
                n = hi - lo
                total = np.bincount(doc, s[code], n) if len(code) else np.zeros(n)
                words = np.bincount(doc, minlength=n).astype(np.int64)
                size = np.bincount(doc, (b - a + 1)[code], n).astype(np.int64) if len(code) else np.zeros(n, np.int64)
                bits = pa.array(-total / np.log(2) / np.maximum(size, 1), mask=size == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(words), pa.array(size), pa.array(total), bits], ["doc_id", "n_words", "n_bytes", "log_prob", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_bytes long, log_prob double, bits_per_byte double")
