"""Quality rules whose cutoffs come with a guarantee on how many good documents they reject."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import _bytes as B
from weftline.llm._shared import checkpoint, fresh, maybe_broadcast

#: Each rule grades a text from 0 (nothing wrong) to 100, in whole percent rounded up.
RULES = ("symbol", "upper", "stutter", "phrase")

_SYMBOL = np.zeros(256, np.bool_)
_SYMBOL[list(b"%&$#*|!~^<>{}[]\\=_@")] = True
_UPPER = np.zeros(256, np.bool_)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Whole percent, rounded up; 0 of 0 is 0."""
    return np.where(whole > 0, -(-100 * part // np.maximum(whole, 1)), 0).astype(np.int32)


def grades(text: pa.Array) -> list[np.ndarray]:
    """Grades of every text under each of RULES.

    symbol: bytes that are symbols, of all bytes.  upper: upper-case letters of
    all letters (ASCII and Latin-1).  stutter: words equal to the word before,
    of all words but the first.  phrase: pairs of words that occurred before in
    the text, of all pairs.  A text without words has 0 under all but symbol.
    """
    data, off = B.buffer(text)
    up, alpha = _UPPER[data], _ALPHA[data]
    if len(data) > 1:
        c3 = (data[:-1] == 0xC3) & (data[1:] >= 0x80)
        alpha[1:] |= c3
        up[1:] |= c3 & (data[1:] <= 0x9E)

    def per_text(flag: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return s[off[1:]] - s[off[:-1]]

    w = B.words(text)
    n = np.diff(w.first)
    pair = w.doc[1:] == w.doc[:-1]
    same = pair & (w.hash[1:] == w.hash[:-1])
    doc = w.doc[1:][pair]
    key = B.mix(w.hash[:-1][pair] * B.U64(0x9FB21C651E98DF25) + w.hash[1:][pair] + doc.astype(B.U64) * B.U64(0xA24BAED4963EE407))
    code, uniq = pd.factorize(key)
    seen = np.empty(len(uniq), np.int64)
    seen[code[::-1]] = doc[::-1]
    size = len(text)
    stutter = np.bincount(w.doc[1:][same], minlength=size)
    pairs = np.maximum(n - 1, 0)
    distinct = np.bincount(seen, minlength=size)
    return [
        _share(per_text(_SYMBOL[data]), np.diff(off)),
        _share(per_text(up), per_text(alpha)),
        _share(stutter, pairs),
        _share(pairs - distinct, pairs),
    ]


def graded(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with the grades of RULES in new columns ``names``; a map over whole texts, other columns pass through."""
    at = [c.lower() for c in docs.columns].index("text")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.IntegerType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = B.filled(batch.column(at))
            for lo, hi in B.pieces(text, B.STAGE_CHUNK):
                cols = grades(text.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *map(pa.array, cols)], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n trials, summed exactly in logarithms."""
    if k >= n:
        return 1.0
    lp, lq, ln = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    return min(1.0, math.fsum(math.exp(ln - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq) for i in range(k + 1)))


def choose(good: np.ndarray, bad: np.ndarray, risk: float, delta: float, price: float) -> tuple[int | None, int, int]:
    """Cutoff, good rejected and bad rejected, from counts of labelled grades 0 to 100; no cutoff if none is safe.

    Cutoffs 99, 98, ..., 1 (reject above it) are tested in that order, each by
    whether the exact upper confidence bound of the false rejection rate is
    within ``risk``, that is P(Bin(n, risk) <= k) <= delta; the first failure
    ends it, so the order needs no correction of its own.  Of the cutoffs that
    passed, all of which are safe at once, the one is taken that rejects most:
    share of the bad less ``price`` times share of the good; the highest on a tie.
    """
    n, nb = int(good.sum()), int(bad.sum())
    best: tuple[float, int, int, int] | None = None
    for c in range(99, 0, -1):
        k = int(good[c + 1 :].sum())
        if n == 0 or k > n * risk or binomial_cdf(k, n, risk) > delta:
            break
        kb = int(bad[c + 1 :].sum())
        gain = kb / max(nb, 1) - price * k / n
        if kb and (best is None or gain > best[0]):
            best = (gain, c, k, kb)
    return best[1:] if best else (None, 0, 0)


#: Part of delta that the test of all rules together has; the rest is for the rules one by one.
JOINT = 0.95


def units(good: np.ndarray) -> np.ndarray:
    """A grade of each rule that one in a hundred good documents exceeds, 1 at least, from counts by rule and grade; 5 without any."""
    n = good.sum(axis=1, keepdims=True)
    u = np.maximum((np.cumsum(good, axis=1) < 0.99 * n).sum(axis=1), 1)
    return np.where(n[:, 0] > 0, u, 5)


def choose_all(grade: np.ndarray, good: np.ndarray, bad: np.ndarray, unit: np.ndarray, risk: float, delta: float, price: float) -> list[int | None]:
    """A cutoff for each of RULES from labelled rows of ``grade`` (one column a rule), which occur ``good`` and ``bad`` times.

    Two families are tested.  One lowers the cutoffs of all rules together, each
    in its ``unit``, and has the whole ``risk`` and ``JOINT`` of ``delta``; few
    labels suffice for it.  The other has each rule by itself, with an equal
    part of ``risk`` and of what is left of ``delta``; it serves where units
    mislead.  The one that gains more is taken.  Units may not depend on these
    good rows, or the tests would not be in a fixed order.
    """
    k = grade.shape[1]
    level = 100 * np.arange(101)[:, None] // (np.arange(101)[:, None] + 3 * unit)  # of each grade, by rule

    def counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(x, good, 101).astype(np.int64), np.bincount(x, bad, 101).astype(np.int64)

    c = choose(*counts(level[grade, np.arange(k)].max(axis=1)), risk, JOINT * delta, price)[0]
    together = [None if c is None else int((level[:, r] <= c).sum()) - 1 for r in range(k)]
    apart = [choose(*counts(grade[:, r]), risk / k, (1 - JOINT) * delta / k, price)[0] for r in range(k)]

    def gain(cuts: list[int | None]) -> float:
        gone = (grade > np.array([100 if c is None else c for c in cuts])).any(axis=1)
        return bad[gone].sum() / max(bad.sum(), 1) - price * good[gone].sum() / max(good.sum(), 1)

    return max(together, apart, key=gain)


def thresholds(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05, price: float = 5.0
) -> DataFrame:
    """Rows (stratum, rule, cutoff, n_good, good_rejected, n_bad, bad_rejected); cutoff is null where none is safe.

    ``labels`` (doc_id, quality) is the held-out set: no rule is fitted to it.
    With probability 1 - ``delta`` over the draw of labels, the rules together
    reject at most ``risk`` of the good documents of every stratum, each of
    which has an equal part of ``delta`` (Bonferroni); see :func:`choose_all`.
    The units of a stratum come from the good documents of all others, whose
    labels are drawn apart from its own.
    The counts of rejected are those of each rule alone.  Null labels and ids
    don't count; a label row that is repeated counts once, contradicting ones
    count for both sides.
    """
    names = fresh(docs, *(f"_{r}" for r in RULES))
    g = graded(docs.select("doc_id", stratum, "text"), names).select(
        F.col("doc_id").alias("_id"), F.col(stratum).cast("string").alias("stratum"), *(F.col(n).alias(r) for n, r in zip(names, RULES, strict=True))
    )
    lab = labels.select(F.col("doc_id").alias("_lid"), F.col("quality").cast("int").alias("_q")).where("_lid IS NOT NULL AND _q IN (0, 1)").distinct()
    hist = (
        g.join(lab, g._id == lab._lid)
        .groupBy("stratum", *RULES)
        .agg(F.sum("_q").alias("n_good"), F.sum(1 - F.col("_q")).alias("n_bad"))
    )
    hist = checkpoint(hist)
    strata = hist.select(F.coalesce("stratum", F.lit("\0"))).distinct().count()
    level = delta / max(strata, 1)
    total = np.zeros((len(RULES), 101), np.int64)
    by_rule = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(r).alias("grade")) for k, r in enumerate(RULES))))
    for k, x, n in hist.select(by_rule.alias("x"), "n_good").groupBy("x.rule", "x.grade").agg(F.sum("n_good")).collect():
        total[k, x] = n

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        grade, good, bad = pdf[list(RULES)].to_numpy(), pdf["n_good"].to_numpy(), pdf["n_bad"].to_numpy()
        own = np.array([np.bincount(g, good, 101) for g in grade.T]).astype(np.int64)
        rows = []
        for r, c, g in zip(RULES, choose_all(grade, good, bad, units(total - own), risk, level, price), grade.T, strict=True):
            gone = g > (100 if c is None else c)
            rows.append((pdf["stratum"].iloc[0], r, c, good.sum(), good[gone].sum(), bad.sum(), bad[gone].sum()))
        out = pd.DataFrame(rows, columns=["stratum", "rule", "cutoff", "n_good", "good_rejected", "n_bad", "bad_rejected"])
        return out.astype({"cutoff": "Int32"})

    schema = "stratum string, rule string, cutoff int, n_good long, good_rejected long, n_bad long, bad_rejected long"
    return checkpoint(hist.groupBy("stratum").applyInPandas(pick, schema))


def keep_good(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", scores: bool = False, **how: float
) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns (and their grades if ``scores``).

    A row is rejected if a grade is above the cutoff of its stratum; see
    :func:`thresholds`.  A stratum without a safe cutoff, or without labels,
    rejects nothing; null strata are one stratum; null and empty texts are kept.
    Two maps over the texts, no shuffle of them; the cutoffs are one row a
    stratum and are broadcast if checked to be few.
    """
    cut = thresholds(docs, labels, stratum, **how)
    names = fresh(docs, *RULES)
    limit, key = fresh(docs.select("*", *(F.lit(0).alias(n) for n in names)), "_limit", "_stratum")
    wide = cut.groupBy(F.col("stratum").alias(key)).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", F.coalesce("cutoff", F.lit(100))))).alias(limit)
    )
    g = graded(docs, names).join(maybe_broadcast(checkpoint(wide)), F.col(stratum).cast("string").eqNullSafe(F.col(key)), "left")
    for n, r in zip(names, RULES, strict=True):
        g = g.where(F.col(n) <= F.coalesce(F.col(limit)[r], F.lit(100)))
    return g.select(*docs.columns, *(names if scores else []))
