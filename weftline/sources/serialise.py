"""Elements written as XML, JSON or text."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ATTRS = (("xml:id", "xml_id"), ("set", "set"), ("class", "cls"), ("annotator", "annotator"), ("confidence", "confidence"), ("n", "n"), ("src", "src"), ("speaker", "speaker"))


def to_xml(elements: DataFrame) -> DataFrame:
    """Rows (doc_id, xml): one document each, put together in the worker that has all its elements.

    Text elements are written with their text, without markup inside it.
    """
    cols = ["eid", "parent_eid", "tag", "space", "auth", "content", "attrs", *(c for _, c in _ATTRS), "textclass"]
    docs = elements.where("category <> 'markup'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in cols if c != "attrs"], F.map_entries("attrs").alias("attrs")))).alias("e"))

    def document(rows: list) -> str:
        out: list[str] = []
        open_: list[tuple[int, str]] = []
        for r in rows:
            while open_ and open_[-1][0] != r["parent_eid"]:
                out.append(f"</{open_.pop()[1]}>")
            a = {k: r[c] for k, c in _ATTRS if r[c] is not None and not (c == "confidence" and r[c] != r[c])}
            if not r["space"]:
                a["space"] = "no"
            a |= {x["key"]: x["value"] for x in (r["attrs"] if r["attrs"] is not None else [])}
            head = "".join(f" {k}={quoteattr(str(v))}" for k, v in a.items())
            inner = escape(r["content"]) if r["content"] is not None else ""
            if r["tag"] == "w" and r["content"] is not None:
                inner = f"<t>{inner}</t>"
            out.append(f"<{r['tag']}{head}>{inner}")
            open_.append((r["eid"], r["tag"]))
        out += [f"</{t}>" for _, t in reversed(open_)]
        return '<?xml version="1.0" encoding="utf-8"?>\n' + "".join(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "xml": [document(list(rows)) for rows in pdf["e"]]})

    return docs.mapInPandas(run, "doc_id string, xml string")


def save(documents: DataFrame, path: str, column: str = "xml", compression: str | None = None) -> None:
    """One row of text a document, by parts; ``compression`` gzip or bzip2."""
    writer = documents.select(F.regexp_replace(column, "\n", " ").alias("value")).write
    (writer.option("compression", compression) if compression else writer).text(path)
