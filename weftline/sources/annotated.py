"""Annotated documents as a table of elements, from XML or from plain text.

Columns of ELEMENTS: ``eid`` numbers a document's elements in document order
from 0; ``last`` is the greatest eid inside the element; ``path`` has the eids
from the root to the element itself.
"""

from __future__ import annotations

import bz2
import gzip
import io
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.session import ensure_workers
from weftline.sources.formats import corpus_files

ELEMENTS = (
    "doc_id string, eid int, parent_eid int, ord int, last int, depth int, path array<int>, tag string, category string, xml_id string, set string, cls string, "
    "annotator string, confidence double, n string, src string, speaker string, textclass string, auth boolean, space boolean, content string, attrs map<string,string>"
)
_STRUCTURE = {"text", "speech", "div", "head", "p", "s", "w", "utt", "quote", "list", "item", "label", "table", "tablehead", "row", "cell", "figure", "caption", "event", "entry", "term", "def", "ex", "note", "part", "ref", "gap", "br", "whitespace", "linebreak", "hiddenw"}
_TOKEN = {"pos", "lemma", "sense", "domain", "phon", "lang", "metric", "alignment", "errordetection", "subjectivity", "str"}
_SPAN = {"entity", "chunk", "su", "dependency", "coreferencechain", "semrole", "predicate", "timesegment", "sentiment", "statement", "observation", "spanrelation"}
_ROLE = {"hd", "dep", "coreferencelink", "source", "target", "relation", "cue"}
_CORRECTION = {"correction", "new", "original", "current", "suggestion", "alt", "altlayers"}
_MARKUP = {"t-str", "t-style", "t-error", "t-correction", "t-gap", "t-hbr"}
#: Elements that are not authoritative, with all below them.
NOT_AUTH = {"original", "suggestion", "alt", "altlayers", "external"}
_KNOWN = {"{http://www.w3.org/XML/1998/namespace}id": "xml_id", "set": "set", "class": "cls", "annotator": "annotator", "confidence": "confidence", "n": "n", "src": "src", "speaker": "speaker", "textclass": "textclass", "space": "space", "auth": "auth"}


def category(tag: str) -> str:
    for name, tags in (("structure", _STRUCTURE), ("token", _TOKEN), ("span", _SPAN), ("spanrole", _ROLE), ("correction", _CORRECTION), ("markup", _MARKUP), ("text", {"t", "ph"}), ("feature", {"feat"}), ("ref", {"wref", "aref", "xref"})):
        if tag in tags:
            return name
    return "layer" if tag in {"entities", "chunking", "syntax", "dependencies", "coreferences", "semroles", "morphology", "phonology", "timing", "sentiments", "statements", "observations", "spanrelations"} else "meta"


def _opened(content: bytes) -> io.IOBase:
    if content[:2] == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=io.BytesIO(content))
    if content[:3] == b"BZh":
        return bz2.BZ2File(io.BytesIO(content))
    return io.BytesIO(content)


def elements_of(doc_id: str, content: bytes) -> Iterator[tuple]:
    """Rows of one document, each when its element ends; consumed elements are cleared, so memory holds one branch.

    Attributes that only some corpora use (``lemma``, ``pos``, ``correction``,
    ``original`` on a word) become annotations below it.
    """
    stack: list[dict] = []
    eid = 0
    for event, e in ET.iterparse(_opened(content), events=("start", "end")):
        if event == "start":
            tag = e.tag.rpartition("}")[2]
            up = stack[-1] if stack else None
            stack.append({"eid": eid, "kids": 0, "tag": tag, "path": [*(up["path"] if up else []), eid], "ord": up["kids"] if up else 0, "extra": []})
            if up:
                up["kids"] += 1
            eid += 1
            if tag == "w":
                for k in ("pos", "lemma", "correction", "original"):
                    if k in e.attrib:
                        stack[-1]["extra"].append((eid, k, e.attrib[k], stack[-1]["kids"]))
                        stack[-1]["kids"] += 1
                        eid += 1
            continue
        x = stack.pop()
        known, rest = dict.fromkeys(set(_KNOWN.values())), {}
        for k, v in e.attrib.items():
            if k in _KNOWN:
                known[_KNOWN[k]] = v
            else:
                rest[k.rpartition("}")[2]] = v
        conf = known["confidence"]
        parent = x["path"][-2] if len(x["path"]) > 1 else None
        for k, name, value, o in x["extra"]:
            rest.pop(name, None)
            yield (doc_id, k, x["eid"], o, k, len(x["path"]), [*x["path"], k], name, category(name), None, None, value, None, None, None, None, None, None, name != "original", True, None, {})
        text = "".join(e.itertext()) if x["tag"] in ("t", "ph", "desc", "comment", "content") or category(x["tag"]) == "markup" else None
        yield (
            doc_id, x["eid"], parent, x["ord"], eid - 1, len(x["path"]) - 1, x["path"], x["tag"], category(x["tag"]), known["xml_id"], known["set"], known["cls"],
            known["annotator"], float(conf) if conf else None, known["n"], known["src"], known["speaker"], known["textclass"] or (known["cls"] if x["tag"] in ("t", "ph") else None),
            known["auth"] != "no" and x["tag"] not in NOT_AUTH, known["space"] != "no", text, rest,
        )
        if not (stack and (stack[-1]["tag"] == "t" or category(stack[-1]["tag"]) == "markup")):
            e.clear()


def read_annotated(spark: SparkSession, path: str, glob: str = "*.xml*", only: str | None = None, ignore_errors: bool = False, tags: tuple[str, ...] = ()) -> DataFrame:
    """ELEMENTS of every file below ``path``; with ``tags`` only those are passed on, from the parser on.

    A document is one task's work, the unit in which such corpora come.  With
    ``ignore_errors`` what precedes an error in a broken document is kept.
    """
    return parse_annotated(corpus_files(spark, path, glob, only, binary=True).withColumnRenamed("path", "doc_id"), ignore_errors, tags)


def parse_annotated(files: DataFrame, ignore_errors: bool = False, tags: tuple[str, ...] = ()) -> DataFrame:
    """ELEMENTS of rows (doc_id, content); null contents have none."""
    ensure_workers(files.sparkSession)
    names = [c.split()[0] for c in ELEMENTS.split(", ") if " " in c]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                rows: list[tuple] = []
                if content is None:
                    continue
                try:
                    for r in elements_of(doc, content.encode() if isinstance(content, str) else bytes(content)):
                        if not tags or r[7] in tags:
                            rows.append(r)
                        if len(rows) >= 20_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except ET.ParseError:
                    if not ignore_errors:
                        raise
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, ELEMENTS)


def elements_of_text(docs: DataFrame) -> DataFrame:
    """ELEMENTS of plain documents (doc_id, text): a text of paragraphs, sentences and words, all native.

    Words carry their text in ``content``.  A document is numbered by a window
    over its own elements, so documents are spread by one shuffle on doc_id.
    """
    p = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode_outer(T.paragraphs("text")).alias("p", "_p"))
    p = p.select("doc_id", "p", T.split_sentences(T.tokenize("_p")).alias("_ss"))
    p = p.withColumn("_np", F.aggregate("_ss", F.size("_ss"), lambda a, x: a + F.size(x)))
    s = p.select("doc_id", "p", "_np", F.posexplode_outer("_ss").alias("s", "_s"))
    w = s.select("doc_id", "p", "s", "_np", F.size("_s").alias("_ns"), F.posexplode_outer("_s").alias("w", "word"))
    node = lambda tag, depth, o, path, below, word=None: F.struct(below.cast("int").alias("below"), F.lit(tag).alias("tag"), F.lit(depth).alias("depth"), o.cast("int").alias("ord"), path.alias("k"), (word if word is not None else F.lit(None).cast("string")).alias("content"))
    at = lambda *c: F.array(*(F.col(x) if isinstance(x, str) else F.lit(x) for x in c))
    none = F.lit(None).cast("int")
    first_w, first_s = F.coalesce("w", F.lit(0)) == 0, F.coalesce("s", F.lit(0)) == 0
    rows = F.filter(
        F.array(
            F.when(first_w & first_s & (F.coalesce("p", F.lit(0)) == 0), node("text", 0, F.lit(0), at(-1, -1, -1), F.lit(None))),
            F.when(first_w & first_s & F.col("p").isNotNull(), node("p", 1, F.col("p"), at("p", -1, -1), F.col("_np"))),
            F.when(first_w & F.col("s").isNotNull(), node("s", 2, F.col("s"), at("p", "s", -1), F.col("_ns"))),
            F.when(F.col("w").isNotNull(), node("w", 3, F.col("w"), at("p", "s", "w"), F.lit(0), F.col("word"))),
        ),
        lambda x: x.isNotNull(),
    )
    nodes = w.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*")
    by = Window.partitionBy("doc_id").orderBy("k")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = nodes.withColumn("eid", F.row_number().over(by) - 1)
    last = lambda d: F.last(F.when(F.col("depth") == d, F.col("eid")), True).over(upto)
    full = F.array(F.lit(0), last(1), last(2), last(3))
    e = e.withColumn("path", F.slice(full, F.lit(1), F.col("depth") + 1)).withColumn("size", F.count("*").over(Window.partitionBy("doc_id")))
    text = lambda: F.lit(None).cast("string")
    return e.withColumn("last", F.coalesce(F.col("eid") + F.col("below"), F.col("size") - 1).cast("int")).select(
        "doc_id", F.col("eid").cast("int").alias("eid"), F.when(F.col("depth") > 0, F.element_at("path", -2)).otherwise(none).alias("parent_eid"), "ord", "last", "depth", "path", "tag", F.lit("structure").alias("category"),
        F.concat_ws(".", "doc_id", F.when(F.col("depth") > 0, F.concat(F.lit("p."), F.col("k")[0] + 1)), F.when(F.col("depth") > 1, F.concat(F.lit("s."), F.col("k")[1] + 1)), F.when(F.col("depth") > 2, F.concat(F.lit("w."), F.col("k")[2] + 1))).alias("xml_id"),
        text().alias("set"), text().alias("cls"), text().alias("annotator"), F.lit(None).cast("double").alias("confidence"), text().alias("n"), text().alias("src"), text().alias("speaker"), F.when(F.col("tag") == "w", F.lit("current")).alias("textclass"),
        F.lit(True).alias("auth"), F.lit(True).alias("space"), "content", F.create_map().cast("map<string,string>").alias("attrs"),
    )
