"""Patterns over token sequences, e.g. ``[pos="det"] [pos="a"]? "test|trial"``, compiled to an automaton without empty steps.

A token expression is a quoted word (alternatives by ``|``), ``[]`` for any
token, or conditions ``attr = "v"`` and ``attr != "v"`` joined by ``&``; it may
be followed by ``?``, ``+``, ``*``, ``{n}``, ``{n,m}`` or ``{n-m}``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import forest

#: Names of attributes in patterns that differ from those of columns.
ALIASES = {"text": "word", "tag": "pos"}


@dataclass(frozen=True)
class Condition:
    attr: str
    values: tuple[str, ...]
    negated: bool = False


@dataclass(frozen=True)
class Token:
    conditions: tuple[Condition, ...]
    least: int = 1
    most: int | None = 1


class PatternError(ValueError):
    pass


_LEX = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|(!=|=|[\[\]&?+*])|\{\s*(\d+)\s*(?:[,-]\s*(\d+)?\s*)?(\})|([\w.:-]+))')


def parse(pattern: str) -> list[Token]:
    toks, at = [], 0
    text = pattern.strip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise PatternError(f"unexpected {text[at:at + 10]!r} in {pattern!r}")
        if m.group(1) is not None:
            toks.append(("str", re.sub(r"\\(.)", r"\1", m.group(1))))
        elif m.group(2):
            toks.append(("op", m.group(2)))
        elif m.group(5):
            lo = int(m.group(3))
            bounded = re.search(r"[,-]", m.group(0))
            toks.append(("interval", (lo, lo if not bounded else int(m.group(4)) if m.group(4) else None)))
        else:
            toks.append(("name", m.group(6)))
        at = m.end()
    out: list[Token] = []
    i = 0

    def take(kind: str, value: str | None = None):
        nonlocal i
        if i >= len(toks) or toks[i][0] != kind or (value is not None and toks[i][1] != value):
            raise PatternError(f"expected {value or kind} in {pattern!r}")
        i += 1
        return toks[i - 1][1]

    while i < len(toks):
        if toks[i][0] == "str":
            conds = (Condition("word", tuple(take("str").split("|"))),)
        else:
            take("op", "[")
            found = []
            while i < len(toks) and toks[i] != ("op", "]"):
                if found:
                    take("op", "&")
                if toks[i][0] == "str":
                    found.append(Condition("word", tuple(take("str").split("|"))))
                    continue
                attr, op = take("name"), take("op")
                if op not in ("=", "!="):
                    raise PatternError(f"expected = or != in {pattern!r}")
                found.append(Condition(ALIASES.get(attr, attr), tuple(take("str").split("|")), op == "!="))
            take("op", "]")
            conds = tuple(found)
        least, most = 1, 1
        if i < len(toks):
            kind, v = toks[i]
            if kind == "interval":
                least, most = v
            elif kind == "op" and v in "?+*":
                least, most = {"?": (0, 1), "+": (1, None), "*": (0, None)}[v]
            if kind == "interval" or (kind == "op" and v in "?+*"):
                i += 1
        if most is not None and most < least:
            raise PatternError(f"empty interval in {pattern!r}")
        out.append(Token(conds, least, most))
    if not out:
        raise PatternError("empty pattern")
    return out


@dataclass
class Automaton:
    """Positions, each with the number of its predicate; where a match may begin, what follows what, and where it may end."""

    predicate: list[int]
    first: set[int]
    follow: dict[int, set[int]]
    last: set[int]
    empty: bool


def automaton(tokens: list[Token], legacy: bool = False) -> tuple[Automaton, list[tuple[Condition, ...]]]:
    """``legacy`` has the counts that an older matcher allows: ? and * exactly 1, + 1 or 2, {n,m} for n > 1 1 to m - n, or m."""
    preds: list[tuple[Condition, ...]] = []
    a = Automaton([], set(), {}, set(), True)
    for t in tokens:
        if t.conditions not in preds:
            preds.append(t.conditions)
        k = preds.index(t.conditions)
        if legacy and t.most is None:
            counts, loop = ({1, 2} if t.least else {1}), False
        elif legacy and t.least == 0:
            counts, loop = set(range(1, t.most + 1)), False
        elif legacy and 1 < t.least < (t.most or 0):
            counts, loop = {*range(1, t.most - t.least + 1), t.most}, False
        elif t.most is None:
            counts, loop = {max(t.least, 1)} | ({0} if t.least == 0 else set()), True
        else:
            counts, loop = set(range(t.least, t.most + 1)), False
        size = max(counts)
        if not size:
            continue
        base = len(a.predicate)
        chain = list(range(base, base + size))
        a.predicate += [k] * size
        for p in chain:
            a.follow[p] = {p + 1} if p + 1 < base + size else set()
        if loop:
            a.follow[chain[-1]].add(chain[-1])
        for p in a.last:
            a.follow[p].add(base)
        if a.empty:
            a.first.add(base)
        ends = {chain[c - 1] for c in counts if c}
        skip = 0 in counts
        a.last = ends | (a.last if skip else set())
        a.empty = a.empty and skip
    return a, preds


def _holds(conds: tuple[Condition, ...], token: Column) -> Column:
    out = F.lit(True)
    for c in conds:
        hit = F.coalesce(token[c.attr].isin(*c.values), F.lit(False))
        out = out & (~hit if c.negated else hit)
    return out


def _matches(a: Automaton, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and stop of all matches in sequences of ``n`` tokens each, whose predicates are the bits of ``flat``."""
    follow = [(p, q) for p, qs in a.follow.items() for q in sorted(qs)]
    base = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    stop = base[1:][row]
    rows, starts, stops = [], [], []
    begin = np.arange(len(flat))
    active = np.zeros((len(begin), len(a.predicate)), np.bool_)
    for p in a.first:
        active[:, p] = True
    length = 0
    while len(begin):
        at = begin + length
        inside = at < stop[begin]
        begin, active, at = begin[inside], active[inside], at[inside]
        bits = flat[at]
        for p, k in enumerate(a.predicate):
            active[:, p] &= (bits >> k) & 1 > 0
        length += 1
        hit = begin[active[:, sorted(a.last)].any(axis=1)]
        rows.append(row[hit])
        starts.append(hit - base[row[hit]])
        stops.append(hit - base[row[hit]] + length)
        nxt = np.zeros_like(active)
        for p, q in follow:
            nxt[:, q] |= active[:, p]
        live = nxt.any(axis=1)
        begin, active = begin[live], nxt[live]
    r, begins, ends = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, starts, stops))
    order = np.lexsort((ends, begins, r))
    return r[order], begins[order].astype(np.int32), ends[order].astype(np.int32)


def find(sequences: DataFrame, pattern: str, keys: list[str], tokens: str = "tokens", legacy: bool = False) -> DataFrame:
    """Rows (keys..., start, stop) of all matches: every beginning, every length, overlapping ones too.

    ``tokens`` is an array of structs with a field for each attribute that the
    pattern names.  Which predicates a token meets is decided natively, as bits
    of a number; only keys and these numbers go to Python, where all beginnings
    of a batch advance through the automaton together.  A map: no shuffle.
    Empty matches are not reported.
    """
    a, preds = automaton(parse(pattern), legacy)
    if len(preds) > 62:
        raise PatternError("more than 62 different token expressions")
    mask = F.transform(F.col(tokens), lambda t: sum((F.when(_holds(p, t), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, p in enumerate(preds[1:], 1)), F.when(_holds(preds[0], t), F.lit(1)).otherwise(F.lit(0)).cast("long")))
    src = sequences.select(*keys, mask.alias("_mask")).where("_mask IS NOT NULL AND size(_mask) > 0")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + (", " if keys else "") + "start int, stop int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            r, start, stop = _matches(a, flat, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(r)) for i in range(len(keys))), pa.array(start), pa.array(stop)], [*keys, "start", "stop"])

    return src.mapInArrow(run, schema)


def find_in_text(docs: DataFrame, pattern: str, legacy: bool = False) -> DataFrame:
    """Rows (doc_id, eid, start, stop) of all matches in the sentences of documents (doc_id, text), the only attribute being the word; a map from documents on."""
    a, preds = automaton(parse(pattern), legacy)
    if len(preds) > 62:
        raise PatternError("more than 62 different token expressions")
    if odd := {c.attr for p in preds for c in p} - {"word"}:
        raise PatternError(f"words of plain text have no {', '.join(sorted(odd))}")

    def body(f: forest.Forest, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(len(f.words), np.int64)
        for k, conds in enumerate(preds):
            ok = np.ones(len(bits), np.bool_)
            for c in conds:
                ok &= pc.is_in(f.words, pa.array(c.values, pa.string())).to_numpy(zero_copy_only=False) != c.negated
            bits |= ok.astype(np.int64) << k
        s = np.flatnonzero(f.tag == forest.S)
        r, start, stop = _matches(a, bits, f.last[s] - s)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(f.doc[s[r]])), pa.array(f.eid[s[r]].astype(np.int32)), pa.array(start), pa.array(stop)], ["doc_id", "eid", "start", "stop"])

    return forest.mapped(docs, body, "doc_id string, eid int, start int, stop int")


def matches(sequences: DataFrame, pattern: str, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """The keys of sequences that match as a whole."""
    hit = find(sequences, pattern, keys, tokens)
    return hit.join(sequences.select(*keys, F.size(tokens).alias("_n")), keys).where("start = 0 AND stop = _n").select(*keys).distinct()


def to_tree_query(pattern: str) -> str:
    """The same pattern as a SELECT over spans of words in the language of :mod:`weftline.plans.treequery`."""
    parts = []
    for t in parse(pattern):
        conds = []
        for c in t.conditions:
            name, op = ("text", c.attr) if c.attr == "word" else ("class", c.attr)
            one = [f'{name} {"!=" if c.negated else "="} "{v}"' for v in c.values]
            expr = one[0] if len(one) == 1 else "( " + (" AND " if c.negated else " OR ").join(one) + " )"
            conds.append(expr if c.attr == "word" else f"{op} HAS {expr}")
        size = "" if (t.least, t.most) == (1, 1) else f" {{{t.least},{'' if t.most is None else t.most}}}"
        where = " WHERE " + " AND ".join(conds) if conds else ""
        parts.append(f"w{size}{where}")
    return "SELECT FOR SPAN " + " & ".join(parts)


def find_words(sequences: DataFrame, pattern: list, keys: list[str], words: str = "words", case_sensitive: bool = False, max_gap: int = 10, left: int = 0, right: int = 0) -> DataFrame:
    """Rows (keys..., start, stop, match, left, right) for a list of words: a string, True for any word, a tuple of alternatives, ``*`` for a gap of 1 to ``max_gap`` words."""
    fold = (lambda s: s) if case_sensitive else str.lower
    quote = lambda s: s.replace("\\", "\\\\").replace('"', '\\"')
    parts = []
    for p in pattern:
        if p is True:
            parts.append("[]")
        elif p == "*":
            parts.append(f"[]{{1,{max_gap}}}")
        else:
            parts.append('"' + "|".join(quote(fold(x)) for x in ((p,) if isinstance(p, str) else p)) + '"')
    w = F.col(words) if case_sensitive else F.transform(words, F.lower)
    hits = find(sequences.select(*keys, F.transform(w, lambda x: F.struct(x.alias("word"))).alias("tokens")), " ".join(parts), keys)
    out = hits.join(sequences.select(*keys, words), keys)
    return out.select(
        *keys, "start", "stop", F.slice(words, F.col("start") + 1, F.col("stop") - F.col("start")).alias("match"),
        F.slice(words, F.greatest(F.col("start") + 1 - left, F.lit(1)), F.least(F.lit(left), F.col("start"))).alias("left"), F.slice(words, F.col("stop") + 1, F.lit(right)).alias("right"),
    )
