"""Navigation, text and editing of annotated documents as relations over their elements.

Containment is an equi-join on the exploded path, never a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = ["doc_id", "eid"]
#: What stands between the texts of an element's children, by its tag.
DELIMITERS = {"w": " ", "s": " ", "utt": " ", "item": "\n", "row": "\n", "p": "\n\n", "list": "\n\n", "figure": "\n\n", "head": "\n\n", "div": "\n\n\n", "text": "\n\n\n", "speech": "\n\n\n", "cell": " | "}


def with_auth_path(elements: DataFrame) -> DataFrame:
    """``elements`` with ``auth_path``: whether it and all above it are authoritative."""
    bad = elements.where(~F.col("auth")).select("doc_id", F.col("eid").alias("_bad"))
    below = elements.select(*K, F.explode("path").alias("_bad")).join(bad, ["doc_id", "_bad"], "left_semi").select(*K).distinct()
    return elements.join(below.withColumn("_hit", F.lit(True)), K, "left").withColumn("auth_path", F.col("_hit").isNull()).drop("_hit")


def ancestry(elements: DataFrame) -> DataFrame:
    """Rows (doc_id, eid, anc_eid, dist) of every element and those above it."""
    n = F.size("path")
    return elements.where(n > 1).select(*K, F.posexplode(F.slice("path", F.lit(1), n - 1)).alias("_i", "anc_eid"), n.alias("_n")).select(*K, "anc_eid", (F.col("_n") - F.col("_i") - 1).alias("dist"))


def descendants(elements: DataFrame, anchors: DataFrame, tag: str | None = None, set_: str | None = None, recursive: bool = True, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Elements below ``anchors`` (doc_id, eid), with ``anchor_eid``; not those below a tag of ``ignore``."""
    found = elements
    if tag:
        found = found.where(F.col("tag") == tag)
    if set_:
        found = found.where(F.col("set") == set_)
    up = F.slice("path", F.lit(1), F.size("path") - 1) if recursive else F.array("parent_eid")
    rows = found.where("depth > 0").withColumn("anchor_eid", F.explode(up))
    out = rows.join(anchors.select("doc_id", F.col("eid").alias("anchor_eid")).distinct(), ["doc_id", "anchor_eid"])
    if ignore:
        block = elements.where(F.col("tag").isin(*ignore)).select("doc_id", F.col("eid").alias("_b"))
        hit = out.select(*K, "anchor_eid", F.explode("path").alias("_b")).where("_b > anchor_eid AND _b <> eid").join(block, ["doc_id", "_b"], "left_semi")
        out = out.join(hit.select(*K, "anchor_eid").distinct(), [*K, "anchor_eid"], "left_anti")
    return out


def count(elements: DataFrame, anchors: DataFrame, tag: str | None = None, **how) -> DataFrame:
    """Rows (doc_id, eid, n) for every anchor, none being 0."""
    n = descendants(elements, anchors, tag, **how).groupBy("doc_id", F.col("anchor_eid").alias("eid")).agg(F.count("*").alias("_n"))
    return anchors.select(*K).distinct().join(n, K, "left").select(*K, F.coalesce("_n", F.lit(0)).alias("n"))


def nth(elements: DataFrame, tag: str, index: int) -> DataFrame:
    """Of every document the element of a tag at an index from 0, or from the end if negative."""
    order = F.asc("eid") if index >= 0 else F.desc("eid")
    w = Window.partitionBy("doc_id").orderBy(order)
    return elements.where(F.col("tag") == tag).withColumn("_k", F.row_number().over(w)).where(F.col("_k") == (index + 1 if index >= 0 else -index)).drop("_k")


def nearest_ancestor(elements: DataFrame, tag: str, of: DataFrame) -> DataFrame:
    """``of`` (doc_id, eid, path) with ``anc_eid``, the nearest above it of a tag, or null."""
    up = of.select(*K, F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("anc_eid"))
    hit = up.join(elements.where(F.col("tag") == tag).select("doc_id", F.col("eid").alias("anc_eid")), ["doc_id", "anc_eid"])
    return of.join(hit.groupBy(*K).agg(F.max("anc_eid").alias("anc_eid")), K, "left")


def common_ancestors(pairs: DataFrame, a: str = "path_a", b: str = "path_b") -> DataFrame:
    """``pairs`` with ``common``: eids above both, nearest first."""
    inner = lambda p: F.slice(p, F.lit(1), F.size(p) - 1)
    return pairs.withColumn("common", F.reverse(F.array_intersect(inner(F.col(a)), inner(F.col(b)))))


def neighbours(elements: DataFrame, tag: str = "w", scope: str | None = "s", size: int = 1, value: str = "content") -> DataFrame:
    """Elements of a tag with arrays ``left`` and ``right`` of ``value`` of up to ``size`` neighbours, bounded by the nearest ``scope`` above."""
    e = elements.where(F.col("tag") == tag)
    by = ["doc_id"]
    if scope:
        e = nearest_ancestor(elements, scope, e).withColumnRenamed("anc_eid", "_scope")
        by.append("_scope")
    w = Window.partitionBy(*by).orderBy("eid")
    return e.withColumn("left", F.collect_list(value).over(w.rowsBetween(-size, -1))).withColumn("right", F.collect_list(value).over(w.rowsBetween(1, size))).drop("_scope")


def next_of(elements: DataFrame, tag: str, back: bool = False, scope: str | None = None) -> DataFrame:
    """Elements of a tag with ``other_eid``, the next (or previous) of that tag in the document or scope."""
    e = elements.where(F.col("tag") == tag)
    by = ["doc_id"]
    if scope:
        e = nearest_ancestor(elements, scope, e).withColumnRenamed("anc_eid", "_scope")
        by.append("_scope")
    w = Window.partitionBy(*by).orderBy("eid")
    return e.withColumn("other_eid", (F.lag if back else F.lead)("eid").over(w)).drop("_scope")


def child_index(elements: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows (doc_id, anchor_eid, eid, index): the place of the child of the anchor that is or holds the element."""
    d = descendants(elements, anchors)
    child = F.get("path", F.array_position("path", F.col("anchor_eid")).cast("int"))
    kids = elements.select("doc_id", F.col("eid").alias("_c"), "ord")
    return d.select("doc_id", "anchor_eid", "eid", child.alias("_c")).join(kids, ["doc_id", "_c"]).select("doc_id", "anchor_eid", "eid", F.col("ord").alias("index"))


def by_id(elements: DataFrame, *ids: str) -> DataFrame:
    return elements.where(F.col("xml_id").isin(*ids))


def annotations(elements: DataFrame, tag: str) -> DataFrame:
    """Rows (doc_id, eid, cls): the authoritative annotation of a tag on each word, the first if there are several."""
    a = elements.where((F.col("tag") == tag) & F.col("auth"))
    words = elements.where(F.col("tag") == "w").select("doc_id", F.col("eid").alias("parent_eid"))
    return a.join(words, ["doc_id", "parent_eid"]).groupBy("doc_id", F.col("parent_eid").alias("eid")).agg(F.min_by("cls", "eid").alias("cls"))


def alternatives(elements: DataFrame, tag: str) -> DataFrame:
    """Annotations of a tag that stand in alternatives, with ``alt_eid`` and the annotated ``word_eid``."""
    alt = elements.where("tag = 'alt'").select("doc_id", F.col("eid").alias("alt_eid"), F.col("parent_eid").alias("word_eid"))
    return elements.where(F.col("tag") == tag).join(alt, (elements["doc_id"] == alt["doc_id"]) & (F.col("parent_eid") == F.col("alt_eid"))).drop(alt["doc_id"])


def span_refs(elements: DataFrame) -> DataFrame:
    """Rows (doc_id, span_eid, ord, target_eid): words that spans refer to, nested spans' included."""
    ref = elements.where("tag = 'wref'").select("doc_id", F.col("eid").alias("ord"), F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("span_eid"), F.coalesce(F.col("attrs")["id"], "xml_id").alias("_id"))
    spans = elements.where("category IN ('span', 'spanrole')").select("doc_id", F.col("eid").alias("span_eid"))
    words = elements.where("xml_id IS NOT NULL AND category = 'structure'").select("doc_id", F.col("xml_id").alias("_id"), F.col("eid").alias("target_eid"))
    return ref.join(spans, ["doc_id", "span_eid"]).join(words, ["doc_id", "_id"]).select("doc_id", "span_eid", "ord", "target_eid")


def spans_over(refs: DataFrame, words: DataFrame) -> DataFrame:
    """Spans that refer to any of ``words`` (doc_id, eid)."""
    return refs.join(words.select("doc_id", F.col("eid").alias("target_eid")), ["doc_id", "target_eid"], "left_semi").select("doc_id", "span_eid").distinct()


def spans_exactly(refs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (doc_id, set_id, span_eid) of spans that have just the words of a set (doc_id, set_id, eid): a division of relations on sorted arrays."""
    a = refs.groupBy("doc_id", "span_eid").agg(F.array_sort(F.collect_set("target_eid")).alias("_w"))
    b = sets.groupBy("doc_id", "set_id").agg(F.array_sort(F.collect_set("eid")).alias("_w"))
    return b.join(a, ["doc_id", "_w"]).select("doc_id", "set_id", "span_eid")


def spans_holding(refs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (doc_id, set_id, span_eid) of spans that have all words of a set."""
    need = sets.groupBy("doc_id", "set_id").agg(F.count_distinct("eid").alias("_n"))
    hit = sets.join(refs.select("doc_id", F.col("target_eid").alias("eid"), "span_eid"), ["doc_id", "eid"]).groupBy("doc_id", "set_id", "span_eid").agg(F.count_distinct("eid").alias("_k"))
    return hit.join(need, ["doc_id", "set_id"]).where("_k = _n").select("doc_id", "set_id", "span_eid")


def features(elements: DataFrame) -> DataFrame:
    """Rows (doc_id, eid, subset, classes): the features of every element, in order."""
    f = elements.where("tag = 'feat'")
    return f.groupBy("doc_id", F.col("parent_eid").alias("eid"), F.col("attrs")["subset"].alias("subset")).agg(F.transform(F.array_sort(F.collect_list(F.struct("eid", "cls"))), lambda x: x["cls"]).alias("classes"))


def inherited(elements: DataFrame, name: str) -> DataFrame:
    """Rows (doc_id, eid, value) of an attribute, the nearest above where the element has none."""
    own = elements.where(F.col(name).isNotNull()).select("doc_id", F.col("eid").alias("_a"), F.col(name).alias("_v"))
    up = elements.select(*K, F.explode("path").alias("_a")).join(own, ["doc_id", "_a"])
    return elements.select(*K).join(up.groupBy(*K).agg(F.max_by("_v", "_a").alias("value")), K, "left")


def word_text(elements: DataFrame, cls: str = "current") -> DataFrame:
    """Rows (doc_id, eid, path, text, space) of words in a text class: their own content, or that of their text element (in a correction: the new one, or the original for class ``original``)."""
    skip = ("new", "current") if cls == "original" else ("original", "suggestion")
    w = elements.where("tag = 'w'")
    own = w.where("content IS NOT NULL").select(*K, "path", F.col("content").alias("text"), "space")
    t = elements.where((F.col("tag") == "t") & (F.coalesce("textclass", F.lit("current")) == F.lit(cls)) | ((F.col("tag") == "t") & F.lit(cls == "original")))
    up = t.select("doc_id", F.col("eid").alias("_t"), F.explode("path").alias("_a"), F.col("content").alias("text"), F.coalesce("textclass", F.lit("current")).alias("_c"))
    bad = elements.where(F.col("tag").isin(*skip, "alt", "altlayers", "str", "morphology", "phonology")).select("doc_id", F.col("eid").alias("_a"))
    blocked = up.join(bad, ["doc_id", "_a"], "left_semi").select("doc_id", "_t").distinct()
    hit = up.join(blocked, ["doc_id", "_t"], "left_anti").join(w.where("content IS NULL").select("doc_id", F.col("eid").alias("_a"), "path", "space"), ["doc_id", "_a"])
    best = hit.groupBy("doc_id", F.col("_a").alias("eid"), "path", "space").agg(F.min_by("text", F.struct(F.col("_c") != cls, "_t")).alias("text"))
    return own.unionByName(best.select(*K, "path", "text", "space"))


def text_of(elements: DataFrame, tag: str, cls: str = "current", retain_tokenisation: bool = False) -> DataFrame:
    """Rows (doc_id, eid, text) of every element of a tag: its words' texts, each followed by the delimiter of the widest element that ends with it.

    No delimiter trails; a word without space after it has none.
    """
    w = word_text(elements, cls)
    up = w.select("doc_id", F.col("eid").alias("w"), "text", "space", F.explode("path").alias("eid"))
    e = elements.where(F.col("category") == "structure").select("doc_id", "eid", "tag", "depth")
    inside = up.join(e, K)
    target = inside.where(F.col("tag") == tag).select("doc_id", F.col("eid").alias("of"), "w", "text", "space", F.col("depth").alias("_d"))
    ends = inside.groupBy(*K).agg(F.max("w").alias("w"))
    delim = F.create_map(*(F.lit(x) for kv in DELIMITERS.items() for x in kv))
    closes = inside.join(ends, [*K, "w"]).select("doc_id", "w", F.col("depth").alias("_cd"), F.coalesce(F.try_element_at(delim, F.col("tag")), F.lit("\n\n")).alias("_del"))
    # the outermost element below the target that ends with the word decides
    j = target.join(closes, ["doc_id", "w"]).where("_cd > _d").groupBy("doc_id", "of", "w", "text", "space").agg(F.min_by("_del", "_cd").alias("_del"))
    self_ = target.where(F.lit(tag == "w")).select("doc_id", "of", "w", "text", "space", F.lit("").alias("_del"))
    piece = F.concat("text", F.when(F.col("space") | F.lit(retain_tokenisation), F.col("_del")).when(F.col("_del") == " ", F.lit("")).otherwise(F.col("_del")))
    rows = F.array_sort(F.collect_list(F.struct("w", piece.alias("piece"), "text")))
    return j.unionByName(self_).groupBy("doc_id", F.col("of").alias("eid")).agg(rows.alias("_r")).select(*K, F.concat(F.array_join(F.transform(F.slice("_r", F.lit(1), F.size("_r") - 1), lambda x: x["piece"]), ""), F.element_at("_r", -1)["text"]).alias("text"))


def valid_offsets(texts: DataFrame, reference: str = "reference", text: str = "text", offset: str = "offset") -> DataFrame:
    """``texts`` with ``valid``: whether the reference has the text at the offset."""
    t, o = F.col(text), F.col(offset)
    return texts.withColumn("valid", F.coalesce(F.expr(f"substring(`{reference}`, `{offset}` + 1, length(`{text}`))") == t, F.lit(False)) & (o >= 0))


def same_trees(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (doc_id, same) by comparing every element's place, tag, attributes and content."""
    cols = ["eid", "parent_eid", "ord", "tag", "xml_id", "set", "cls", "annotator", "confidence", "content"]
    h = lambda df, n: df.groupBy("doc_id").agg(F.count("*").alias(f"{n}c"), F.sum(F.xxhash64(*cols, F.array_sort(F.map_entries("attrs"))).cast("decimal(38,0)")).alias(f"{n}h"))
    return h(a, "a").join(h(b, "b"), "doc_id", "full").select("doc_id", F.coalesce((F.col("ac") == F.col("bc")) & (F.col("ah") == F.col("bh")), F.lit(False)).alias("same"))


def renumbered(elements: DataFrame) -> DataFrame:
    """Elements after an edit, with eid, last, ord and path made anew from parent links and a sort key ``eid`` that may be a fraction (column ``_key``)."""
    e = elements.withColumn("_new", (F.row_number().over(Window.partitionBy("doc_id").orderBy("_key")) - 1).cast("int"))
    m = e.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("eid", "_new"))).alias("_m"))
    e = e.join(m, "doc_id").withColumn("path", F.transform("path", lambda x: F.try_element_at("_m", x)))
    e = e.withColumn("parent_eid", F.try_element_at("_m", F.col("parent_eid"))).withColumn("eid", F.col("_new"))
    last = e.select("doc_id", "eid", F.explode("path").alias("_a")).groupBy("doc_id", F.col("_a").alias("eid")).agg(F.max("eid").alias("_last"))
    e = e.join(last, K).withColumn("last", F.col("_last"))
    e = e.withColumn("ord", (F.row_number().over(Window.partitionBy("doc_id", "parent_eid").orderBy("eid")) - 1).cast("int"))
    return e.select(*[c for c in elements.columns if c != "_key"])


def deleted(elements: DataFrame, targets: DataFrame) -> DataFrame:
    """``elements`` without ``targets`` (doc_id, eid) and all below them, numbered anew."""
    t = targets.select("doc_id", F.col("eid").alias("_t")).distinct()
    gone = elements.select(*K, F.explode("path").alias("_t")).join(t, ["doc_id", "_t"], "left_semi").select(*K).distinct()
    return renumbered(elements.join(gone, K, "left_anti").withColumn("_key", F.col("eid").cast("double")))


def edited(elements: DataFrame, targets: DataFrame, **values: Column) -> DataFrame:
    """``elements`` with columns set on ``targets`` (doc_id, eid); the rest stays."""
    t = targets.select(*K).distinct().withColumn("_hit", F.lit(True))
    e = elements.join(t, K, "left")
    return e.select(*(F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).cast(elements.schema[c].dataType).alias(c) if c in values else F.col(c) for c in elements.columns))


def added(elements: DataFrame, targets: DataFrame, tag: str, where: str = "inside", **values: Column) -> DataFrame:
    """``elements`` with one new element for each target: the last child (``inside``), or the sibling ``before`` or ``after`` it."""
    t = elements.join(targets.select(*K).distinct(), K, "left_semi")
    new_id = (-F.row_number().over(Window.partitionBy("doc_id").orderBy("eid"))).cast("int")
    base = F.slice("path", F.lit(1), F.size("path") - 1) if where != "inside" else F.col("path")
    key = F.col("last") + 0.5 if where in ("inside", "after") else F.col("eid") - 0.5
    parent = F.col("eid") if where == "inside" else F.col("parent_eid")
    from weftline.sources.annotated import category

    fixed = {"eid": F.col("_id"), "parent_eid": F.col("_parent"), "ord": F.lit(0), "last": F.col("_id"), "path": F.concat("_base", F.array("_id")), "depth": F.size("_base"), "tag": F.lit(tag), "category": F.lit(category(tag)), "auth": F.lit(True), "space": F.lit(True), "attrs": F.create_map().cast("map<string,string>"), "doc_id": F.col("doc_id")} | values
    n = t.select("doc_id", new_id.alias("_id"), parent.alias("_parent"), base.alias("_base"), key.alias("_key"))
    n = n.select(*(fixed.get(c, F.lit(None)).cast(elements.schema[c].dataType).alias(c) for c in elements.columns), "_key")
    return renumbered(elements.withColumn("_key", F.col("eid").cast("double")).unionByName(n))


def vocabulary_errors(elements: DataFrame, sets: DataFrame) -> DataFrame:
    """Elements whose class their set doesn't allow; ``sets`` has (set, cls, kind): an open set allows all, an empty one only null, a closed one its members."""
    kinds = sets.groupBy("set").agg(F.max("kind").alias("_kind"))
    e = elements.join(kinds, "set").where("_kind <> 'open'")
    member = sets.where("cls IS NOT NULL").select("set", "cls").distinct()
    closed = e.where("_kind = 'closed' AND cls IS NOT NULL").join(member, ["set", "cls"], "left_anti")
    return closed.unionByName(e.where("_kind = 'empty' AND cls IS NOT NULL").select(*closed.columns)).select(*elements.columns)
