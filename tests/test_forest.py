"""Plain text as forests: the same rows as the joins on elements give, from a map alone."""

import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import __spark_entry__
from weftline.operators import forest, tree
from weftline.plans import cql, treequery
from weftline.sources.annotated import elements_of_text

#: Queries, and how many shuffles they may take: none stores or shuffles elements.
SHUFFLES = {n: 1 for n in ('token_pattern','tree_select_has','tree_select_where','word_neighbours','tree_edit_delete','tree_select_previous','element_counts')} | {'paragraph_text': 0, 'word_by_index': 0}


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["de", "en", ",", ",", ".", "!", "...", "a", "Kraftfahrzeughaftpflicht", "niederschlag", "x-y", "…"])
    par = lambda: " ".join(word() for _ in range(rnd.choice([0, 1, 2, 5, 40]))) or "\t"
    texts = [None, "", "\n\n", "\t\n\n\t", "a", ". . a ..", "a.\n \nb"] + ["\n\n".join(par() for _ in range(rnd.choice([1, 1, 2, 6]))) for _ in range(60)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def e(docs):
    return elements_of_text(docs).cache()


@pytest.fixture(autouse=True)
def small_pieces(monkeypatch):
    monkeypatch.setattr(forest, "PIECE", 50)  # for code that runs here; workers have their own


def rows(df):
    return sorted(map(str, df.collect()))


def test_elements(docs, e):
    every = treequery.run_on_text(docs, "SELECT ALL", columns=tuple(forest.COLUMNS))
    assert rows(every) == rows(e.select(*forest.COLUMNS))


def test_pieces(docs):
    lists = docs.select(F.transform(F.split("text", "\n\n"), lambda p: F.split(p, " ")).alias("t")).toArrow().column("t").combine_chunks()
    cuts = list(forest._cuts(lists))
    assert len(cuts) > 5 and [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == len(lists)


@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_no_elements_stored_or_shuffled(spark, monkeypatch, name):
    def write(*_, **__):
        raise AssertionError("elements are stored")

    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Exchange") <= SHUFFLES[name]


def test_paragraph_text(docs, e):
    for tag in ("p", "s", "w", "text"):
        assert rows(forest.text_of(docs, tag).select("doc_id", "eid", "text")) == rows(tree.text_of(e, tag)), tag
    assert rows(forest.text_of(docs, "p").select("doc_id", "eid", "ord")) == rows(e.join(tree.text_of(e, "p"), ["doc_id", "eid"]).select("doc_id", "eid", "ord"))


def test_token_pattern(docs, e):
    w = tree.nearest_ancestor(e, "s", e.where("tag = 'w'"))
    seq = w.groupBy("doc_id", F.col("anc_eid").alias("eid")).agg(F.array_sort(F.collect_list(F.struct(F.col("eid").alias("k"), F.col("content").alias("word")))).alias("tokens"))
    for pattern in ('"," []? "en"', '[word!="de|en"]+ "."', '"no such word"'):
        assert rows(cql.find_in_text(docs, pattern)) == rows(cql.find(seq, pattern, ["doc_id", "eid"])), pattern
    with pytest.raises(cql.PatternError):
        cql.find_in_text(docs, '[pos="n"]')


def same(docs, e, *queries):
    assert treequery._Local([treequery.parse(q) for q in queries]).fits, queries
    for q in queries:
        e = treequery.run(e, q)
    columns = ("doc_id", "eid", "parent_eid", "last", "tag", "content")
    assert rows(treequery.run_on_text(docs, *queries, columns=columns)) == rows(e.select(*columns)), queries


def test_tree_select_has(docs, e):
    same(docs, e, 'SELECT w FOR s WHERE ( w HAS text = "de" )')
    same(docs, e, 'SELECT s WHERE w HAS text = "de" FOR p WHERE NOT w HAS text = "!" RETURN target')
    same(docs, e, 'SELECT w IN s FOR p WHERE w HAS text = "en" , p WHERE w HAS text = "!"')


def test_tree_select_where(docs, e):
    same(docs, e, 'SELECT w WHERE text MATCHES "^.{12,}$"')
    same(docs, e, 'SELECT w WHERE ( text < "b" OR text CONTAINS "-" ) AND text NOTMATCHES "^[,.]$"')
    same(docs, e, 'SELECT ALL WHERE class != "x" AND NOT text = "de"')
    same(docs, e, 'SELECT ALL WHERE text NOTCONTAINS "e" AND class NOTMATCHES "x"')


def test_word_neighbours(docs, e):
    for size in (1, 3):
        assert rows(forest.neighbours(docs, size, 14)) == rows(tree.neighbours(e, size=size).where("length(content) >= 14").select("doc_id", "content", "left", "right"))


def test_tree_edit_delete(docs, e):
    edits = 'EDIT w WHERE text = "de" WITH text "DE"', 'DELETE w WHERE text = ","'
    same(docs, e, *edits, 'SELECT w WHERE text = "DE" OR text = "de" OR text = "."')
    same(docs, e, 'DELETE s WHERE w HAS text = "de"', "SELECT ALL")
    assert not treequery._Local([treequery.parse(q) for q in (*edits, 'SELECT w WHERE text MATCHES "^D"')]).fits
    assert rows(treequery.run_on_text(docs, edits[0], 'SELECT w WHERE text MATCHES "^D"', columns=("content",))) == rows(treequery.run_on_text(docs, edits[0], 'SELECT w WHERE text = "DE"', columns=("content",)))


def test_tree_select_previous(docs, e):
    same(docs, e, 'SELECT w WHERE PREVIOUS w WHERE ( text = "," ) AND text MATCHES "^.{4,}$"')
    same(docs, e, 'SELECT w WHERE NEXT w WHERE ( text = "," ) AND PARENT s WHERE ( w HAS text = "de" )')


def test_element_counts(docs, e):
    assert rows(forest.counts(docs)) == rows(e.groupBy("doc_id", "tag").agg(F.count("*").alias("n")))


def test_word_by_index(docs, e):
    for tag, k in (("w", -1), ("w", 0), ("w", 7), ("s", -2)):
        assert rows(forest.nth(docs, tag, k)) == rows(tree.nth(e, tag, k).select("doc_id", "eid", "content")), (tag, k)
