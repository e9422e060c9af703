"""Controlled vocabularies: legacy XML definitions and SKOS as RDF/XML or Turtle, as rows (set, cls, label, parent, subset, kind)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "set string, cls string, label string, parent string, subset string, kind string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _local(tag: str) -> str:
    return re.split(r"[}#/:]", tag)[-1]


def legacy(root: ET.Element) -> Iterator[tuple]:
    """Classes (nested ones have the outer as parent) of a set and its subsets."""
    ids = lambda e: e.get("{http://www.w3.org/XML/1998/namespace}id") or e.get("id")

    def classes(e: ET.Element, name: str, subset: str | None, parent: str | None, kind: str) -> Iterator[tuple]:
        for c in e:
            if _local(c.tag) == "class":
                yield (name, ids(c), c.get("label"), parent, subset, kind)
                yield from classes(c, name, subset, ids(c), kind)

    name = ids(root)
    kind = root.get("type") or "closed"
    found = list(classes(root, name, None, None, kind))
    yield from found or [(name, None, root.get("label"), None, None, kind)]
    for s in root:
        if _local(s.tag) == "subset":
            k = s.get("type") or "closed"
            inner = list(classes(s, name, ids(s), None, k))
            yield from inner or [(name, None, s.get("label"), None, ids(s), k)]


def _triples_xml(root: ET.Element) -> Iterator[tuple[str, str, str]]:
    rdf = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
    for node in root:
        s = node.get(rdf + "about") or node.get(rdf + "ID") or ""
        yield s, "type", _local(node.tag)
        for p in node:
            yield s, _local(p.tag), p.get(rdf + "resource") or (p.text or "").strip()


def _triples_turtle(text: str) -> Iterator[tuple[str, str, str]]:
    text = re.sub(r"(?m)^\s*(?:@prefix|@base|PREFIX|BASE).*$", "", text)
    toks = re.findall(r'<[^>]*>|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^\S+)?|[;,.](?=\s|$)|[^\s;,]+(?<![.])', text)
    s = p = None
    for t in toks:
        if t == ".":
            s = p = None
        elif t == ";":
            p = None
        elif t == ",":
            continue
        elif s is None:
            s = t.strip("<>")
        elif p is None:
            p = "type" if t == "a" else _local(t.strip("<>"))
        else:
            m = re.match(r'"((?:[^"\\]|\\.)*)"', t)
            yield s, p, m.group(1) if m else t.strip("<>")


def skos(triples: list[tuple[str, str, str]]) -> Iterator[tuple]:
    """Concepts by notation; collections are the set and, where members of another, its subsets; a flag open or empty makes the kind."""
    get: dict[str, dict[str, list[str]]] = {}
    for s, p, o in triples:
        get.setdefault(s, {}).setdefault(p, []).append(o)
    one = lambda s, p: next(iter(get.get(s, {}).get(p, [])), None)
    collections = [s for s in get if "Collection" in {_local(o) for o in get[s].get("type", [])}]
    members = {m for s in collections for m in get[s].get("member", [])}
    roots = [s for s in collections if s not in members]
    for root in roots:
        for c in [root, *(m for m in get[root].get("member", []) if m in collections)]:
            kind = "open" if (one(c, "open") or "").lower() in ("true", "1") else "empty" if (one(c, "empty") or "").lower() in ("true", "1") else "closed"
            subset = None if c == root else one(c, "notation")
            rows = [(one(root, "notation") or root, one(m, "notation"), one(m, "prefLabel"), one(one(m, "broader") or "", "notation"), subset, kind) for m in get[c].get("member", []) if m not in collections]
            yield from rows or [(one(root, "notation") or root, None, one(c, "prefLabel"), None, subset, kind)]


def read_vocabularies(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA from (path, content); the kind of file is told from its content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for content in pdf["content"].dropna():
                text = content if isinstance(content, str) else bytes(content).decode()
                if text.lstrip().startswith("<"):
                    root = ET.fromstring(text)
                    rows += list(skos(list(_triples_xml(root)))) if _local(root.tag) == "RDF" else list(legacy(root))
                else:
                    rows += list(skos(list(_triples_turtle(text))))
            yield pd.DataFrame(rows, columns=_NAMES)

    return files.select("content").mapInPandas(run, SCHEMA).select(*(F.col(c) for c in _NAMES))
