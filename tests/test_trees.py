import pytest
from pyspark.sql import functions as F

from weftline.operators import tree
from weftline.plans import treequery as Q
from weftline.sources import annotated, serialise, vocabularies

XML = """<?xml version="1.0"?><doc xml:id="d" xmlns="http://x.example/ns"><text xml:id="d.text">
<p xml:id="d.p.1"><s xml:id="d.s.1">
<w xml:id="w1"><t>The</t><pos class="det" set="tags"/></w>
<w xml:id="w2"><t>old</t><pos class="adj" set="tags" annotator="me" confidence="0.5"/><alt auth="no"><pos class="n" set="tags"/></alt></w>
<w xml:id="w3" space="no"><correction><new><t>house</t></new><original auth="no"><t>huose</t></original></correction><pos class="n" set="tags"><feat subset="num" class="sg"/></pos></w>
<w xml:id="w4"><t>.</t></w>
<entities><entity class="loc" set="ents"><wref id="w2"/><wref id="w3"/></entity></entities>
</s></p>
<p xml:id="d.p.2"><s xml:id="d.s.2" speaker="bob"><w xml:id="w5"><t>Bye</t></w><w xml:id="w6"><t>!</t></w></s></p>
</text></doc>"""


@pytest.fixture(scope="module")
def e(spark):
    df = spark.createDataFrame([("d", XML), ("n", None)], "doc_id string, content string")
    return annotated.parse_annotated(df).cache()


def ids(df):
    return sorted(r.xml_id for r in df.collect())


def q(e, text):
    return Q.run(e, text)


def test_reading(e):
    assert {r.tag: r.n for r in e.groupBy("tag").agg(F.count("*").alias("n")).collect()} == {"doc": 1, "text": 1, "p": 2, "s": 2, "w": 6, "t": 7, "pos": 4, "alt": 1, "correction": 1, "new": 1, "original": 1, "feat": 1, "entities": 1, "entity": 1, "wref": 2}
    assert sorted(r.eid for r in e.collect()) == list(range(e.count()))
    p = e.where("xml_id = 'd.p.1'").first()
    inside = e.where(F.array_contains("path", p.eid)).agg(F.max("eid")).first()[0]
    assert p.last == inside


def test_text(e):
    text = {r.eid: r.text for r in tree.text_of(e, "s").collect()}
    s = {r.xml_id: r.eid for r in e.where("tag = 's'").collect()}
    assert text[s["d.s.1"]] == "The old house." and text[s["d.s.2"]] == "Bye !"
    assert [r.text for r in tree.text_of(e, "text").collect()] == ["The old house.\n\nBye !"]
    orig = {r.eid: r.text for r in tree.text_of(e, "s", cls="original").collect()}
    assert orig[s["d.s.1"]] == "The old huose."


def test_select(e):
    assert ids(q(e, "SELECT w")) == ["w1", "w2", "w3", "w4", "w5", "w6"]
    assert ids(q(e, 'SELECT w WHERE text = "old"')) == ["w2"]
    assert ids(q(e, 'SELECT w WHERE pos HAS class = "n"')) == ["w3"]  # what is in an alternative is not authoritative
    assert ids(q(e, 'SELECT w WHERE :pos = "det"')) == ["w1"]
    assert ids(q(e, 'SELECT w WHERE ( text = "old" OR text = "Bye" ) AND NOT pos HAS annotator = "you"')) == ["w2", "w5"]
    assert ids(q(e, "SELECT w FOR s ID d.s.2")) == ["w5", "w6"]
    assert ids(q(e, "SELECT s IN p ID d.p.1")) == ["d.s.1"]
    assert ids(q(e, 'SELECT w FOR ID d.s.1 , ID d.s.2 FOR p ID d.p.2')) == ["w5", "w6"]
    assert ids(q(e, 'SELECT w WHERE PREVIOUS w WHERE ( text = "Bye" )')) == ["w6"]
    assert ids(q(e, 'SELECT w WHERE PARENT s WHERE ( speaker = "bob" )')) == ["w5", "w6"]
    assert ids(q(e, 'SELECT pos OF "tags" WHERE confidence < 0.7 FOR w RETURN target')) == ["w2"]
    assert ids(q(e, 'SELECT w WHERE text MATCHES "^[A-Z]"')) == ["w1", "w5"]
    spans = q(e, 'SELECT FOR SPAN w WHERE :pos = "det" & w {0,1} & w WHERE text = "."').collect()
    assert spans == []
    (s,) = q(e, 'SELECT FOR SPAN w WHERE :pos = "det" & w {0,2} & w WHERE text = "."').collect()
    assert len(s.eids) == 4
    for bad in ("FROB w", "SELECT w WHERE a = 1 AND b = 2 OR c = 3", "SELECT w RETURN x y"):
        with pytest.raises(Q.QueryError):
            Q.parse(bad)


def test_edit(e):
    out = q(e, 'EDIT pos WHERE class = "det" WITH class "x", annotator "me"')
    assert [(r.cls, r.annotator) for r in out.where("tag = 'pos'").orderBy("eid").collect()][0] == ("x", "me")
    out = q(e, 'DELETE w WHERE text = "old"')
    assert ids(out.where("tag = 'w'")) == ["w1", "w3", "w4", "w5", "w6"] and out.where("tag = 'pos'").count() == 2
    assert sorted(r.eid for r in out.collect()) == list(range(out.count()))
    out = q(e, 'APPEND w WITH id "w1b", text "very" FOR w ID w1')
    assert [r.xml_id for r in out.where("tag = 'w'").orderBy("eid").collect()][:3] == ["w1", "w1b", "w2"]
    assert out.where("xml_id = 'w1b'").first().ord == 1
    out = q(e, 'PREPEND w WITH id "w0", text "Oh" FOR w ID w1')
    assert [r.xml_id for r in out.where("tag = 'w'").orderBy("eid").collect()][:2] == ["w0", "w1"]
    out = q(e, 'ADD lemma OF "lem" WITH class "bye" FOR w ID w5')
    got = out.where("tag = 'lemma'").first()
    assert got.cls == "bye" and got.set == "lem" and out.where(F.col("eid") == got.parent_eid).first().xml_id == "w5"
    assert tree.text_of(q(e, 'APPEND w WITH text "very" FOR w ID w1'), "s").where("text = 'The very old house.'").count() == 1


def test_navigation(e):
    w = e.where("tag = 'w'")
    assert {r.xml_id: r.cls for r in tree.annotations(e, "pos").join(w.select("doc_id", "eid", "xml_id"), ["doc_id", "eid"]).collect()} == {"w1": "det", "w2": "adj", "w3": "n"}
    assert tree.nth(e, "w", -1).first().xml_id == "w6" and tree.nth(e, "w", 1).first().xml_id == "w2"
    n = tree.count(e, e.where("tag = 's'"), "w").collect()
    assert sorted(r.n for r in n) == [2, 4]
    assert tree.descendants(e, e.where("tag = 'text'"), "pos", ignore=("alt",)).count() == 3
    refs = tree.span_refs(e)
    eid = {r.xml_id: r.eid for r in w.collect()}
    assert tree.spans_over(refs, w.where("xml_id = 'w3'")).count() == 1
    sets = e.sparkSession.createDataFrame([("d", 1, eid["w2"]), ("d", 1, eid["w3"]), ("d", 2, eid["w2"])], "doc_id string, set_id int, eid int")
    assert [r.set_id for r in tree.spans_exactly(refs, sets).collect()] == [1]
    assert sorted(r.set_id for r in tree.spans_holding(refs, sets).collect()) == [1, 2]
    assert tree.features(e).first().classes == ["sg"]
    sp = {r.eid: r.value for r in tree.inherited(e, "speaker").collect()}
    assert sp[eid["w5"]] == "bob" and sp[eid["w1"]] is None
    assert tree.alternatives(e, "pos").first().word_eid == eid["w2"]
    nx = {r.xml_id: r.other_eid for r in tree.next_of(e, "w", scope="s").collect()}
    assert nx["w1"] == eid["w2"] and nx["w4"] is None
    a = tree.with_auth_path(e)
    assert a.where("NOT auth_path").count() == 4  # alt, its pos, original, its t
    assert tree.same_trees(e, e).first().same and not tree.same_trees(e, q(e, "DELETE w ID w1")).first().same


def test_round_trip(spark, e):
    x = serialise.to_xml(e).withColumnRenamed("xml", "content")
    again = annotated.parse_annotated(x)
    assert tree.same_trees(e, again).first().same
    assert Q.to_json(e).count() == 1


def test_broken_documents(spark):
    d = spark.createDataFrame([("x", "<doc><w><t>a</t></w><w>")], "doc_id string, content string")
    assert annotated.parse_annotated(d, ignore_errors=True).where("tag = 't'").count() == 1
    assert annotated.parse_annotated(spark.createDataFrame([("y", "<doc><w><t>a</t></w></doc>")], d.schema), tags=("w",)).count() == 1


def test_plain_text(spark):
    d = spark.createDataFrame([(1, "One two. Three!\n\nFour"), (2, ""), (3, None)], "doc_id long, text string")
    e = annotated.elements_of_text(d)
    rows = [(r.eid, r.parent_eid, r.last, r.tag, r.content) for r in e.where("doc_id = '1'").orderBy("eid").collect()]
    assert rows == [(0, None, 12, "text", None), (1, 0, 8, "p", None), (2, 1, 5, "s", None), (3, 2, 3, "w", "One"), (4, 2, 4, "w", "two"), (5, 2, 5, "w", "."), (6, 1, 8, "s", None), (7, 6, 7, "w", "Three"), (8, 6, 8, "w", "!"), (9, 0, 11, "p", None), (10, 9, 11, "s", None), (11, 10, 11, "w", "Four")] or rows[0][2] == 11
    assert e.where("doc_id IN ('2', '3')").count() == 2


def test_vocabularies(spark, e):
    old = '<set xml:id="tags" type="closed"><class xml:id="det" label="D"/><class xml:id="n"><class xml:id="np"/></class><subset xml:id="num" type="open"/></set>'
    ttl = '@prefix skos: <http://s#> .\n<#s> a skos:Collection ; skos:notation "ents" ; skos:member <#l>, <#p> .\n<#l> a skos:Concept ; skos:notation "loc" ; skos:prefLabel "place" .\n<#p> a skos:Concept ; skos:notation "per" ; skos:broader <#l> .'
    v = vocabularies.read_vocabularies(spark.createDataFrame([("a", old), ("b", ttl)], "path string, content string"))
    rows = {(r.set, r.cls, r.parent, r.subset, r.kind) for r in v.collect()}
    assert rows == {("tags", "det", None, None, "closed"), ("tags", "n", None, None, "closed"), ("tags", "np", "n", None, "closed"), ("tags", None, None, "num", "open"), ("ents", "loc", None, None, "closed"), ("ents", "per", "loc", None, "closed")}
    bad = tree.vocabulary_errors(e, v.where("subset IS NULL").select("set", "cls", "kind"))
    assert [r.cls for r in bad.collect()] == ["adj"]
