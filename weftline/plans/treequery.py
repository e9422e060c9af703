"""A query language over annotation trees, compiled to joins on the table of elements.

    SELECT w WHERE text = "house" FOR s WHERE ( pos HAS class = "n" )
    SELECT pos OF "tags" WHERE class MATCHES "^n" IN w
    SELECT FOR SPAN w WHERE pos HAS class = "det" & w {0,2} & w WHERE text = "house"
    EDIT lemma WHERE class = "x" WITH class "y" FOR w
    ADD pos WITH class "n" FOR w WHERE text = "house"
    APPEND w WITH text "!" FOR s ID d.s.1        DELETE pos FOR w ID d.s.1.w.2

A selector is a tag, ``ALL`` or ``ID x``, then maybe ``OF set`` and ``WHERE``.
``FOR`` looks at all below its targets, ``IN`` at children; targets joined by
commas are a union, and may be nested.  Conditions are joined by AND or OR (not
both without parentheses); NOT negates one; ``tag HAS ...`` asks for one below,
and PREVIOUS, NEXT and PARENT for a neighbour.  ``RETURN target`` gives the
innermost targets instead of what was found in them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import forest, tree
from weftline.plans import cql
from weftline.sources.annotated import NOT_AUTH, elements_of_text
from weftline.storage import written

K = ["doc_id", "eid"]
OPS = ("=", "==", "!=", "<", ">", "<=", ">=", "CONTAINS", "NOTCONTAINS", "MATCHES", "NOTMATCHES")
ACTIONS = ("SELECT", "EDIT", "ADD", "APPEND", "PREPEND", "DELETE")
ATTRS = {"class": "cls", "text": "text", "value": "text", "phon": "text", "id": "xml_id", "set": "set", "annotator": "annotator", "confidence": "confidence", "n": "n", "speaker": "speaker", "src": "src"}
_STOP = {"FOR", "IN", "WITH", "RETURN", "FORMAT", "WHERE", "OF", "AND", "OR", "&", ",", ")", "HAS"}


class QueryError(ValueError):
    pass


@dataclass
class Compare:
    attr: str
    op: str
    value: str


@dataclass
class Has:
    tag: str
    set: str | None
    filter: object
    where: str = "below"


@dataclass
class Logic:
    op: str
    parts: list


@dataclass
class Selector:
    tag: str | None = None
    id: str | None = None
    set: str | None = None
    filter: object = None
    least: int = 1
    most: int | None = 1


@dataclass
class Query:
    action: str
    focus: Selector | None
    values: dict[str, str] = field(default_factory=dict)
    targets: list[tuple[str, list[Selector]]] = field(default_factory=list)  # (FOR or IN, union), innermost first
    span: list[Selector] | None = None
    give: str = "focus"


class _Parser:
    def __init__(self, text: str):
        self.t = re.findall(r'"(?:[^"\\]|\\.)*"|\{\d+(?:,\d*)?\}|[(),&]|[^\s(),&"{]+', text)
        self.i = 0

    def peek(self, k: int = 0) -> str | None:
        return self.t[self.i + k] if self.i + k < len(self.t) else None

    def next(self, want: str | None = None) -> str:
        x = self.peek()
        if x is None or (want and x != want):
            raise QueryError(f"expected {want or 'more'}, found {x}")
        self.i += 1
        return re.sub(r"\\(.)", r"\1", x[1:-1]) if x[0] == '"' else x

    def selector(self) -> Selector:
        s = Selector()
        x = self.next()
        if x == "ID":
            s.id = self.next()
        elif x != "ALL":
            s.tag = x
            if self.peek() == "ID":
                self.next()
                s.id = self.next()
        if self.peek() == "OF":
            self.next()
            s.set = self.next()
        if self.peek() and re.fullmatch(r"\{\d+(?:,\d*)?\}", self.peek()):
            lo, comma, hi = self.next()[1:-1].partition(",")
            s.least, s.most = int(lo), (int(hi) if hi else None) if comma else int(lo)
        if self.peek() == "WHERE":
            self.next()
            s.filter = self.filter()
        return s

    def filter(self) -> object:
        parts, op = [self.condition()], None
        while self.peek() in ("AND", "OR"):
            x = self.next()
            if op not in (None, x):
                raise QueryError("AND and OR need parentheses")
            op = x
            parts.append(self.condition())
        return parts[0] if op is None else Logic(op, parts)

    def condition(self) -> object:
        x = self.peek()
        if x == "NOT":
            self.next()
            return Logic("NOT", [self.condition()])
        if x == "(":
            self.next()
            f = self.filter()
            self.next(")")
            return f
        if x in ("PREVIOUS", "NEXT", "PARENT"):
            where = self.next().lower()
            tag = self.next()
            f = None
            if self.peek() == "WHERE":
                self.next()
                f = self.condition()
            return Has(tag, None, f, where)
        name = self.next()
        if name.startswith(":"):
            op, value = self.next(), self.next()
            return Has(name[1:], None, Compare("class", op, value))
        if self.peek() in OPS:
            return Compare(name, self.next(), self.next())
        set_ = None
        if self.peek() == "OF":
            self.next()
            set_ = self.next()
        self.next("HAS")
        return Has(name, set_, self.condition())

    def query(self) -> Query:
        action = self.next()
        if action not in ACTIONS:
            raise QueryError(f"unknown action {action}")
        q = Query(action, None if self.peek() == "FOR" else self.selector())
        if self.peek() == "WITH":
            self.next()
            while self.peek() and self.peek() not in ("FOR", "IN", "RETURN"):
                k = self.next()
                q.values[k] = self.next()
                if self.peek() == ",":
                    self.next()
        while self.peek() in ("FOR", "IN"):
            how = self.next()
            if self.peek() == "SPAN":
                self.next()
                q.span = [self.selector()]
                while self.peek() == "&":
                    self.next()
                    q.span.append(self.selector())
                continue
            union = [self.selector()]
            while self.peek() == ",":
                self.next()
                union.append(self.selector())
            q.targets.append((how, union))
        if self.peek() == "RETURN":
            self.next()
            q.give = self.next()
        if self.peek() is not None:
            raise QueryError(f"unexpected {self.peek()}")
        return q


def parse(text: str) -> Query:
    return _Parser(text).query()


def with_text(elements: DataFrame) -> DataFrame:
    """``elements`` with ``text``: their content, or that of their own authoritative text element of class current."""
    if "text" in elements.columns:
        return elements
    t = elements.where("tag IN ('t', 'ph') AND auth AND coalesce(textclass, 'current') = 'current'").groupBy("doc_id", F.col("parent_eid").alias("eid")).agg(F.min_by("content", "eid").alias("_t"))
    return elements.join(t, K, "left").withColumn("text", F.coalesce("content", "_t")).drop("_t")


def _compare(c: Compare) -> Column:
    x = F.col(ATTRS[c.attr]) if c.attr in ATTRS else F.try_element_at("attrs", F.lit(c.attr))
    v = F.lit(float(c.value)) if c.attr == "confidence" else F.lit(c.value)
    if c.attr == "confidence" and c.op in ("CONTAINS", "NOTCONTAINS", "MATCHES", "NOTMATCHES"):
        x, v = x.cast("string"), F.lit(c.value)
    got = {
        "=": lambda: x == v, "==": lambda: x == v, "!=": lambda: ~x.eqNullSafe(v), "<": lambda: x < v, ">": lambda: x > v, "<=": lambda: x <= v, ">=": lambda: x >= v,
        "CONTAINS": lambda: x.contains(v), "NOTCONTAINS": lambda: ~x.contains(v), "MATCHES": lambda: x.rlike(c.value), "NOTMATCHES": lambda: ~x.rlike(c.value),
    }
    return F.coalesce(got[c.op](), F.lit(c.op.startswith("NOT")))


class _Plan:
    """Filters become columns: what HAS and its like find is joined as a flag, so any nesting of AND, OR and NOT is an expression."""

    def __init__(self, elements: DataFrame):
        self.columns = elements.columns
        self.all = tree.with_auth_path(with_text(elements))
        self.n = 0

    def condition(self, df: DataFrame, f: object) -> tuple[DataFrame, Column]:
        if f is None:
            return df, F.lit(True)
        if isinstance(f, Compare):
            return df, _compare(f)
        if isinstance(f, Logic):
            cols = []
            for p in f.parts:
                df, c = self.condition(df, p)
                cols.append(c)
            out = ~cols[0] if f.op == "NOT" else cols[0]
            for c in cols[1:]:
                out = out & c if f.op == "AND" else out | c
            return df, out
        self.n += 1
        flag = f"_f{self.n}"
        found = self.select(Selector(f.tag, None, f.set, f.filter))
        if f.where == "below":
            keys = found.where("auth_path").select("doc_id", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("eid"))
        elif f.where == "parent":
            keys = self.all.select("doc_id", "parent_eid", F.col("eid").alias("_e")).join(found.select("doc_id", F.col("eid").alias("parent_eid")), ["doc_id", "parent_eid"], "left_semi").select("doc_id", F.col("_e").alias("eid"))
        else:
            near = tree.next_of(self.all, f.tag, back=f.where == "previous")
            keys = near.select("doc_id", "eid", "other_eid").join(found.select("doc_id", F.col("eid").alias("other_eid")), ["doc_id", "other_eid"], "left_semi").select(*K)
        return df.join(keys.distinct().withColumn(flag, F.lit(True)), K, "left"), F.coalesce(F.col(flag), F.lit(False))

    def select(self, s: Selector) -> DataFrame:
        # what is not authoritative is found only if it is asked for by tag or id
        df = self.all.where(F.col("auth_path") | F.lit(bool(s.id)) | F.lit(s.tag in NOT_AUTH))
        if s.tag:
            df = df.where(F.col("tag") == s.tag)
        if s.id:
            df = df.where(F.col("xml_id") == s.id)
        if s.set:
            df = df.where(F.col("set") == s.set)
        df, c = self.condition(df, s.filter)
        return df.where(c).select(*self.all.columns)

    def union(self, sels: list[Selector]) -> DataFrame:
        out = self.select(sels[0])
        for s in sels[1:]:
            out = out.unionByName(self.select(s))
        return out.dropDuplicates(K) if len(sels) > 1 else out

    def within(self, found: DataFrame, how: str, anchors: DataFrame) -> DataFrame:
        up = F.slice("path", F.lit(1), F.size("path") - 1) if how == "FOR" else F.array("parent_eid")
        a = anchors.select("doc_id", F.col("eid").alias("_a")).distinct()
        hit = found.select(*K, F.explode(up).alias("_a")).join(a, ["doc_id", "_a"], "left_semi").select(*K).distinct()
        return found.join(hit, K, "left_semi")

    def targets(self, q: Query) -> DataFrame | None:
        out = None
        for how, union in reversed(q.targets):
            found = self.union(union)
            out = found if out is None else self.within(found, self._how, out)
            self._how = how
        return out

    def spans(self, q: Query) -> DataFrame:
        """Rows (doc_id, eids): runs of words of a sentence, of each beginning the longest."""
        words = self.select(Selector("w"))
        anchors = self.targets(q)
        if anchors is not None:
            words = self.within(words, "FOR", anchors)
        flags = []
        for k, s in enumerate(q.span):
            words, c = self.condition(words, s.filter)
            words = words.withColumn(f"_s{k}", c.cast("string"))
            flags.append(f"_s{k}")
        words = tree.nearest_ancestor(self.all, "s", words).select("doc_id", F.col("anc_eid").alias("_sent"), "eid", *flags)
        seq = words.groupBy("doc_id", "_sent").agg(F.array_sort(F.collect_list(F.struct("eid", *flags))).alias("tokens"))
        parts = [f'[{flags[k]}="true"]' + (f"{{{s.least},{'' if s.most is None else s.most}}}" if (s.least, s.most) != (1, 1) else "") for k, s in enumerate(q.span)]
        hits = cql.find(seq, " ".join(parts), ["doc_id", "_sent"]).groupBy("doc_id", "_sent", "start").agg(F.max("stop").alias("stop"))
        return hits.join(seq, ["doc_id", "_sent"]).select("doc_id", F.transform(F.slice("tokens", F.col("start") + 1, F.col("stop") - F.col("start")), lambda t: t["eid"]).alias("eids"))


def run(elements: DataFrame, query: str | Query) -> DataFrame:
    """What SELECT finds (rows of elements; of spans, doc_id and eids), or the elements after EDIT, ADD, APPEND, PREPEND or DELETE."""
    q = parse(query) if isinstance(query, str) else query
    plan = _Plan(elements)
    if q.action == "SELECT" and q.span:
        return plan.spans(q)
    anchors = plan.targets(q)
    values = {ATTRS.get(k, k): F.lit(float(v) if k == "confidence" else v) for k, v in q.values.items()}
    if "text" in values:
        values["content"] = values.pop("text")
    if q.action in ("ADD", "APPEND", "PREPEND"):
        if anchors is None:
            raise QueryError(f"{q.action} needs FOR")
        if q.focus.set:
            values["set"] = F.lit(q.focus.set)
        where = {"ADD": "inside", "APPEND": "after", "PREPEND": "before"}[q.action]
        return tree.added(elements, anchors, q.focus.tag, where, **values)
    found = plan.select(q.focus)
    if anchors is not None:
        found = plan.within(found, q.targets[0][0], anchors)
    if q.action == "DELETE":
        return tree.deleted(elements, found)
    if q.action == "EDIT":
        return tree.edited(elements, found, **values)
    if q.give == "target":
        if anchors is None:
            raise QueryError("RETURN target needs FOR")
        below = found.select("doc_id", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("eid"))
        found = anchors.join(below.distinct(), K, "left_semi")
    elif q.give != "focus":
        raise QueryError(f"RETURN {q.give} is unknown")
    return found.select(*elements.columns)


class _Local:
    """Queries on plain text, whose elements have a tag, words have text, and all other attributes are null: each is evaluated on a forest of whole documents."""

    def __init__(self, queries: list[Query]):
        self.queries = queries
        self.patterns: list[str] = []
        self.fits = queries[-1].action == "SELECT" and all(map(self._query, queries))

    def _query(self, q: Query) -> bool:
        if q.action not in ("SELECT", "EDIT", "DELETE") or q.span is not None or q.focus is None or q.give not in ("focus", "target"):
            return False
        if q.action == "EDIT" and (q.focus.tag != "w" or {ATTRS.get(k) for k in q.values} != {"text"}):
            return False
        if q.give == "target" and (q.action != "SELECT" or not q.targets):
            return False
        fits = all(map(self._selector, [q.focus, *(s for _, union in q.targets for s in union)]))
        return fits and not (q.action == "EDIT" and self._later(q))

    def _later(self, q: Query) -> bool:
        """Whether a query after the edit ``q`` asks for patterns, which are matched before it."""
        later = _Local.__new__(_Local)
        later.patterns = []
        rest = self.queries[next(i for i, x in enumerate(self.queries) if x is q) + 1 :]
        for x in rest:
            later._selector(x.focus or Selector())
            for _, union in x.targets:
                for s in union:
                    later._selector(s)
        return bool(later.patterns)

    def _selector(self, s: Selector) -> bool:
        return s.id is None and self._filter(s.filter)

    def _filter(self, f: object) -> bool:
        if isinstance(f, Logic):
            return all([self._filter(p) for p in f.parts])
        if isinstance(f, Has):
            return self._filter(f.filter)
        if isinstance(f, Compare):
            if ATTRS.get(f.attr) == "text" and f.op in ("MATCHES", "NOTMATCHES") and f.value not in self.patterns:
                self.patterns.append(f.value)
            return ATTRS.get(f.attr) != "xml_id"
        return True

    def condition(self, f: forest.Forest, c: object) -> np.ndarray:
        n = len(f.tag)
        if c is None:
            return np.ones(n, np.bool_)
        if isinstance(c, Logic):
            parts = [self.condition(f, p) for p in c.parts]
            return ~parts[0] if c.op == "NOT" else np.logical_and.reduce(parts) if c.op == "AND" else np.logical_or.reduce(parts)
        if isinstance(c, Has):
            found = self.select(f, Selector(c.tag, None, c.set, c.filter))
            if c.where == "below":
                return f.above(found)
            if c.where == "parent":
                return f.children(found)
            return f.beside(forest.TAGS.index(c.tag), found, c.where == "previous") if c.tag in forest.TAGS else np.zeros(n, np.bool_)
        null = c.op == "!=" or c.op.startswith("NOT")
        if ATTRS.get(c.attr) != "text":
            return np.full(n, null)
        if c.op in ("MATCHES", "NOTMATCHES"):
            hit = (f.bits >> self.patterns.index(c.value)) & 1 > 0
        elif c.op in ("CONTAINS", "NOTCONTAINS"):
            hit = pc.match_substring(f.words, c.value).to_numpy(zero_copy_only=False)
        else:
            how = {"=": pc.equal, "==": pc.equal, "!=": pc.not_equal, "<": pc.less, ">": pc.greater, "<=": pc.less_equal, ">=": pc.greater_equal}[c.op]
            hit = how(f.words, c.value).to_numpy(zero_copy_only=False)
        return f.of_words(~hit if c.op.startswith("NOT") else hit, null)

    def select(self, f: forest.Forest, s: Selector) -> np.ndarray:
        tag = forest.TAGS.index(s.tag) if s.tag in forest.TAGS else -1
        if s.set or (s.tag and tag < 0):
            return np.zeros(len(f.tag), np.bool_)
        found = self.condition(f, s.filter)
        return found & (f.tag == tag) if s.tag else found

    def within(self, f: forest.Forest, found: np.ndarray, how: str, anchors: np.ndarray) -> np.ndarray:
        return found & (f.below(anchors) if how == "FOR" else f.children(anchors))

    def run(self, f: forest.Forest) -> tuple[forest.Forest, np.ndarray]:
        for q in self.queries:
            anchors = outer = None
            for how, union in reversed(q.targets):
                found = np.logical_or.reduce([self.select(f, s) for s in union])
                anchors, outer = found if anchors is None else self.within(f, found, outer, anchors), how
            found = self.select(f, q.focus)
            if anchors is not None:
                found = self.within(f, found, q.targets[0][0], anchors)
            if q.action == "DELETE":
                f = f.without(found)
            elif q.action == "EDIT":
                f = replace(f, words=pc.if_else(pa.array(found[f.tag == forest.W]), [*q.values.values()][-1], f.words))
            elif q.give == "target":
                found = anchors & f.above(found)
        return f, found


def run_on_text(docs: DataFrame, *queries: str, columns: tuple[str, ...] = ("doc_id", "eid", "content")) -> DataFrame:
    """Columns of what the last query, a SELECT, finds in documents (doc_id, text), after the edits before it.

    A map from documents on, without their table of elements, but for what
    that alone has (ids, spans, new elements, patterns on edited text).
    """
    parsed = [parse(q) for q in queries]
    plan = _Local(parsed)
    if not plan.fits or not set(columns) <= set(forest.COLUMNS) or len(plan.patterns) > 31:
        e = written(elements_of_text(docs), "elements")
        for q in parsed:
            e = run(e, q)
        return e.select(*columns)

    def body(f: forest.Forest, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        f, found = plan.run(f)
        yield f.rows(found, ids, list(columns))

    return forest.mapped(docs, body, ", ".join(f"{c} {forest.COLUMNS[c]}" for c in columns), tuple(plan.patterns))


def to_json(elements: DataFrame) -> DataFrame:
    """Rows (doc_id, json): each element's attributes as one JSON object in document order."""
    cols = [c for c in elements.columns if c not in ("doc_id", "path", "last")]
    return elements.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("eid", *(c for c in cols if c not in ("eid", "attrs")), F.to_json("attrs").alias("attrs"))))).alias("json"))


def ordered(elements: DataFrame) -> DataFrame:
    """Document order."""
    return elements.orderBy(*K)
