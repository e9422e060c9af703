"""Benchmark decontamination: every passage of the training texts queries a BM25 index of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import _bytes as B
from weftline.llm._shared import written

#: Entries of an index that a task holds; more items are spread over several indexes, all of which every passage queries.
MAX_ENTRIES = 100_000
#: Postings of a block; the greatest impact of each is kept.
BLOCK = 32
#: Groups of entries for which a passage's score is bounded before it is searched.
GROUPS = 128


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last sentence, or of a single sentence the last quarter of its words."""
    parts = re.split(r"(?<=[.?!])\s+", text.strip())
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    w = text.split()
    k = max(1, len(w) // 4)
    return " ".join(w[:-k]), " ".join(w[-k:])


def grams(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of the runs of ``n`` words, of all of them if there are fewer."""
    n = min(n, len(h))
    if not n:
        return np.zeros(0, B.U64)
    out = np.zeros(len(h) - n + 1, B.U64)
    for k in range(n):
        out = out * B.U64(0x9FB21C651E98DF25) + h[k : len(h) - n + 1 + k]
    return out


def edits(part: np.ndarray, text: np.ndarray) -> int:
    """Fewest words replaced, left out or put in that make ``part`` a run of ``text``."""
    at = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, h in enumerate(part):
        step = np.append(k + 1, np.minimum(row[:-1] + (text != h), row[1:] + 1))
        row = np.minimum.accumulate(step - at) + at
    return int(row.min())


def _hashes(text: str) -> np.ndarray:
    return B.words(pa.array([text])).hash


@dataclass
class Index:
    """Inverted index of entries (an item, or a part of a long one); impacts are divided by what the entry scores for itself."""

    terms: np.ndarray  # sorted hashes
    begin: np.ndarray  # postings of term t: begin[t] to begin[t + 1]
    entry: np.ndarray
    impact: np.ndarray
    upper: np.ndarray  # greatest impact of each term
    item: np.ndarray  # of each entry: place in items
    items: list[tuple[int, np.ndarray, np.ndarray]]  # id, question words, answer words
    block: list[list[tuple[int, float]]] = field(default_factory=list)  # by term: last entry and greatest impact of each block
    slots: np.ndarray = field(default_factory=lambda: np.zeros(1 << 18, np.bool_))
    group: np.ndarray | None = None  # by term and group of entries: greatest impact

    def __post_init__(self) -> None:
        size = -(-len(self.item) // GROUPS)
        self.group = np.zeros((len(self.terms), -(-len(self.item) // size)), np.float32)
        np.maximum.at(self.group, (np.repeat(np.arange(len(self.terms)), np.diff(self.begin)), self.entry // size), self.impact * 1.000001)
        for t in range(len(self.terms)):
            a, b = self.begin[t], self.begin[t + 1]
            self.block.append([(int(self.entry[min(k + BLOCK, b) - 1]), float(self.impact[k : min(k + BLOCK, b)].max())) for k in range(a, b, BLOCK)])
        self.slots[(self.terms >> B.U64(46)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term of every hash, -1 for none."""
        out = np.full(len(h), -1, np.int32)
        some = np.flatnonzero(self.slots[(h >> B.U64(46)).astype(np.int64)])
        if len(self.terms) and len(some):
            t = np.minimum(np.searchsorted(self.terms, h[some]), len(self.terms) - 1)
            hit = self.terms[t] == h[some]
            out[some[hit]] = t[hit]
        return out

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All entries with a score of at least ``least`` for these distinct terms, by block-max WAND.

        Lists are kept in the order of their current entry.  The pivot is the
        first at which the terms' greatest impacts reach ``least``; it is scored
        only if those of the blocks around it do as well, else the lists skip
        past the first of these blocks' ends.
        """
        eps = 1e-9
        lists = []
        for t in terms:
            a, b = int(self.begin[t]), int(self.begin[t + 1])
            lists.append([int(self.entry[a]), a, a, b, float(self.upper[t]), self.block[t]])
        out = []

        def advance(x: list, to: int) -> bool:
            """Move to the first entry >= to; whether there is one."""
            p = x[1] + int(np.searchsorted(self.entry[x[1] : x[3]], to))
            if p >= x[3]:
                return False
            x[1], x[0] = p, int(self.entry[p])
            return True

        while lists:
            lists.sort(key=lambda x: x[0])
            s, pivot = 0.0, -1
            for k, x in enumerate(lists):
                s += x[4]
                if s >= least - eps:
                    pivot = k
                    break
            if pivot < 0:
                break
            d = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == d:
                pivot += 1
            s, end = 0.0, 1 << 62
            for x in lists[: pivot + 1]:
                k = (x[1] - x[2]) // BLOCK
                while x[5][k][0] < d:
                    k += 1
                    if k == len(x[5]):
                        break
                if k < len(x[5]):
                    s += x[5][k][1]
                    end = min(end, x[5][k][0])
            if s >= least - eps:
                if lists[0][0] == d:
                    score = sum(float(self.impact[x[1]]) for x in lists[: pivot + 1])
                    if score >= least - eps:
                        out.append((d, score))
                    to, upto = d + 1, pivot + 1
                else:
                    to, upto = d, next(k for k, x in enumerate(lists) if x[0] == d)
            else:
                to, upto = max(end, d) + 1 if end < 1 << 62 else d + 1, pivot + 1
                if pivot + 1 < len(lists):
                    to = min(to, max(lists[pivot + 1][0], d + 1))
            lists = [x for k, x in enumerate(lists) if k >= upto or advance(x, to)]
        return out


def entries_of(text: str, most: int) -> list[np.ndarray]:
    """An item's words, in parts of at most ``most`` of nearly equal size."""
    h = _hashes(text)
    return np.array_split(h, -(-len(h) // most)) if len(h) else []


def build_indexes(items: DataFrame, part_words: int, k1: float = 1.2, b: float = 0.75, most: int = MAX_ENTRIES) -> list[Index]:
    """Indexes over ``items`` (item_id, text), each of at most about ``most`` entries, with statistics of all.

    Null ids and texts without words are left out; items that repeat an id are
    items of their own.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, h in enumerate(entries_of(text, part_words)):
                    u, c = np.unique(h, return_counts=True)
                    rows += [(i, text, k, len(h), int(t), int(n)) for t, n in zip(u.view(np.int64), c, strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["item_id", "text", "part", "len", "term", "tf"])

    src = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    postings = written(src.mapInArrow(post, "item_id long, text string, part int, len int, term long, tf int"), "postings")
    entries = postings.groupBy("item_id", "text", "part").agg(F.first("len").alias("len"))
    n, mean = entries.agg(F.count("*"), F.avg("len")).first()
    if not n:
        return []
    shards = -(-n // most)
    idf = postings.groupBy("term").agg(F.log1p((F.lit(float(n)) - F.count("*") + 0.5) / (F.count("*") + 0.5)).alias("idf"))
    sat = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(float(mean))))
    weighted = postings.join(idf, "term").select("item_id", "text", "part", "term", (F.col("idf") * sat).alias("impact"))
    out = []
    for s in range(shards):
        mine = weighted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s).toPandas()
        if len(mine):
            out.append(_index(mine))
    return out


def _index(p: pd.DataFrame) -> Index:
    # entries of like length are neighbours, so that the bounds of their groups are tight
    p = p.assign(words=p.groupby(["item_id", "text", "part"])["term"].transform("size"))
    p = p.sort_values(["words", "item_id", "text", "part", "term"], kind="stable", ignore_index=True)
    item, firsts = _codes(p[["item_id", "text"]])
    items = []  # an item whose parts are apart occurs more than once
    for f in firsts:
        q, a = question_and_answer(p["text"][f])
        items.append((int(p["item_id"][f]), _hashes(q), _hashes(a)))
    entry, efirst = _codes(p[["item_id", "text", "part"]])
    own = np.bincount(entry, p["impact"])
    impact = p["impact"].to_numpy() / own[entry]
    term = p["term"].to_numpy().view(np.uint64)
    order = np.lexsort((entry, term))
    terms, begin = np.unique(term[order], return_index=True)
    return Index(terms, np.append(begin, len(order)), entry[order], impact[order], np.maximum.reduceat(impact[order], begin), item[efirst], items)


def _codes(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs of equal rows, and each run's first row."""
    new = (p != p.shift()).any(axis=1).to_numpy()
    new[0] = True
    return np.cumsum(new) - 1, np.flatnonzero(new)


@dataclass
class Rule:
    """When a passage leaks an item: its words, the step between passages, the least score, the least overlaps.

    ``whole`` is the least share of the item's words that stand as in the item
    where question and answer are taken together; in an item of five words or
    more one may always differ.
    """

    passage_words: int = 64
    stride: int = 32
    least_score: float = 0.45
    question: float = 0.6
    answer: float = 0.6
    whole: float = 0.9


def _may_reach(index: Index, term: np.ndarray, cell: np.ndarray, doc: np.ndarray, per: int, least: float) -> np.ndarray:
    """For every cell of words whether the passage of ``per`` cells from it can reach ``least`` for some entry.

    WAND's bound, for groups of entries: the greatest impacts in a group of the
    distinct terms of each cell are summed.  A passage without a group that
    reaches the score has no entry that does.  Passages may begin with cells
    that have no term.
    """
    some = np.flatnonzero(term >= 0)
    out = np.zeros(len(doc), np.bool_)
    if not len(some):
        return out
    size = len(index.terms)
    key = pd.unique(cell[some] * size + term[some])
    at, t = key // size, key % size
    cfirst = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    for lo in range(0, len(cfirst), 20_000):
        hi = min(lo + 20_000, len(cfirst))
        upto = cfirst[hi] if hi < len(cfirst) else len(t)
        c0 = at[cfirst[lo]]
        # cells before the first of this stretch may begin passages that reach into it: their sums are carried by overlap
        back = int(np.searchsorted(at[cfirst], c0 - per + 1))
        a, b = cfirst[back], upto
        base = max(c0 - per + 1, 0)
        sums = np.zeros((at[b - 1] - base + per, index.group.shape[1]), np.float32)
        sums[at[cfirst[back:hi]] - base] = np.add.reduceat(index.group[t[a:b]], cfirst[back:hi] - a, axis=0)
        n = at[b - 1] - base + 1
        total = sums[:n].copy()
        same = doc[base : base + n]
        for k in range(1, per):
            ok = np.append(same[k:] == same[:-k], np.zeros(min(k, n), np.bool_))[:n]
            total += sums[k : n + k] * ok[:, None]
        out[base : base + n] |= (total >= least - 1e-4).any(axis=1)
    return out


def leaks(text: pa.Array, indexes: list[Index], rule: Rule) -> list[tuple[int, int, float, float, float]]:
    """Rows (place in ``text``, item, score, question overlap, answer overlap), the best of each text and item, of whole texts."""
    w = B.words(text)
    n = np.diff(w.first)
    per = rule.passage_words // rule.stride
    cells = -(-n // rule.stride)
    cfirst = np.concatenate([[0], np.cumsum(cells)])
    doc = np.repeat(np.arange(len(n)), cells)
    begin = w.first[doc] + (np.arange(cfirst[-1]) - cfirst[doc]) * rule.stride
    # a passage begins with every cell but those whose words the passage before already has
    end = np.minimum(begin + per * rule.stride, w.first[doc + 1])
    whole = (np.arange(cfirst[-1]) == cfirst[doc]) | (begin + (per - 1) * rule.stride < w.first[doc + 1])
    cell = np.repeat(np.arange(cfirst[-1]), np.minimum(rule.stride, w.first[doc + 1] - begin))
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for index in indexes:
        term = index.lookup(w.hash)
        for k in np.flatnonzero(_may_reach(index, term, cell, doc, per, rule.least_score) & whole):
            t = np.unique(term[begin[k] : end[k]])
            for e, score in index.search([int(x) for x in t if x >= 0], rule.least_score):
                item, q, a = index.items[index.item[e]]
                d, m = int(doc[k]), len(q) + len(a)
                lo, hi = max(w.first[d], begin[k] - m), min(w.first[d + 1], end[k] + m)
                near = w.hash[lo:hi]
                got = []
                for part in (q, a):
                    g = np.unique(grams(part))
                    got.append(float(np.isin(g, grams_of(near, min(5, len(part)))).mean()) if len(g) else 1.0)
                leak = got[0] >= rule.question and got[1] >= rule.answer
                if not leak:  # runs of five words are lost by an edit in each
                    got = [max(x, 1.0 - edits(part, near) / len(part)) if len(part) else x for x, part in zip(got, (q, a), strict=True)]
                    leak = got[0] >= rule.question and got[1] >= rule.answer
                if not leak and m >= 5:
                    leak = edits(np.concatenate([q, a]), near) <= max(1, int((1.0 - rule.whole) * m + 1e-9))
                if leak:
                    best[d, item] = max(best.get((d, item), (0.0, 0.0, 0.0)), (score, *got))
    return [(d, i, *v) for (d, i), v in sorted(best.items())]


def grams_of(h: np.ndarray, n: int) -> np.ndarray:
    return grams(h, n) if len(h) >= n else np.zeros(0, B.U64)


def contaminated(docs: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap) for every document that holds a test item.

    Texts are cut into overlapping passages that cover all their words; each
    passage is a query of its distinct words.  Entries whose score is at least
    ``least_score`` of what they score for themselves are retrieved; one counts
    if around the passage stand enough runs of five words of both its question
    and its answer, or enough of the words of both in their order, each with
    few edits, or nearly all of the item.  The overlaps are the greater of the
    share of runs and that of unedited words, the latter only where it was needed.
    Null and empty texts hold nothing; a row that is
    repeated is reported as often; null ids are reported as null.  Without items
    there are no rows.  A map: the index goes to the tasks, in several parts if
    it is large, and no text is shuffled.
    """
    indexes = build_indexes(items, rule.passage_words * 3 // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids = B.filled(batch.column(1)), batch.column(0)
            for lo, hi in B.pieces(text, B.STAGE_CHUNK // 2):
                rows = leaks(text.slice(lo, hi - lo), indexes, rule)
                if rows:
                    d, i, s, q, a = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([lo + x for x in d])), pa.array(i, pa.int64()), pa.array(s), pa.array(q), pa.array(a)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def decontaminated(docs: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns; see :func:`contaminated`."""
    indexes = build_indexes(items, rule.passage_words * 3 // 4)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = B.filled(batch.column(at))
            for lo, hi in B.pieces(text, B.STAGE_CHUNK // 2):
                keep = np.ones(hi - lo, np.bool_)
                for row in leaks(text.slice(lo, hi - lo), indexes, rule):
                    keep[row[0]] = False
                yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
