import gzip

from pyspark.sql import functions as F

from weftline.operators import models
from weftline.sources import formats as S


def put(tmp_path, name, text):
    p = tmp_path / name
    (gzip.open(p, "wt") if name.endswith(".gz") else open(p, "w")).write(text)
    return str(p)


def test_giza(spark, tmp_path):
    p = put(tmp_path, "x.A3.gz", "# Sentence pair (1) source length 2 target length 3 alignment score : 0.5\nla maison bleue\nNULL ({ }) the ({ 1 }) house ({ 2 3 })\n# Sentence pair (2) source length 1 target length 1 alignment score : 1e-3\nx\nNULL ({ 1 }) y ({ })\n")
    rows = S.read_giza(spark, p).orderBy("idx").collect()
    assert (rows[0].source, rows[0].target, rows[0].score) == (["the", "house"], ["la", "maison", "bleue"], 0.5)
    assert [(x.s, x.t) for x in rows[0].links] == [(0, 0), (1, 1), (1, 2)] and rows[1].links == []
    links = S.links_of(S.read_giza(spark, p))
    t = {r.s: (r.first, r.last, r.consecutive) for r in models.aligned_targets(links, ["file", "idx"]).collect()}
    assert t == {0: (0, 0, True), 1: (1, 2, True)}
    back = spark.createDataFrame([(0, 0), (2, 1)], "s int, t int").withColumn("idx", F.lit(1))
    got = models.intersect_alignments(links, back, ["idx"]).select("s", "t").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 2)]


def test_phrase_table(spark, tmp_path):
    p = put(tmp_path, "pt.txt", "a b ||| x ||| 0.1 0.2\nc ||| y ||| 0.9 0.8\na b ||| z w ||| 0.3 0.4\n")
    t = S.read_phrase_table(spark, p)
    o = {r.source: [x.target for x in r.options] for r in S.phrase_options(t).collect()}
    assert o == {"a b": ["x", "z w"], "c": ["y"]}
    assert S.read_phrase_table(spark, p, reverse=True, max_words=1).collect()[0].source == "y"
    assert S.read_phrase_table(spark, p, score_filter=F.col("scores")[0] > 0.2).count() == 2


def test_arpa_and_backoff(spark, tmp_path):
    p = put(tmp_path, "m.arpa", "\\data\\\nngram 1=3\nngram 2=1\n\n\\1-grams:\n-1.0\t<unk>\n-0.5\ta\t-0.3\n-0.7\tb\t-0.2\n\n\\2-grams:\n-0.1\ta b\n\n\\end\\\n")
    m = S.read_arpa(spark, p)
    assert m.count() == 4
    q = spark.createDataFrame([(1, ["a"], "b"), (2, ["b"], "a"), (3, [], "a"), (4, ["x", "a"], "b"), (5, ["a"], "zzz"), (6, ["q"], "a")], "id int, history array<string>, word string")
    got = {r.id: round(r.logprob, 6) for r in models.backoff_scores(q, m, 2).collect()}
    assert got == {1: -0.1, 2: -0.7, 3: -0.5, 4: -0.1, 5: -1.3, 6: -0.5}
    S.write_arpa(m, str(tmp_path / "out"))
    assert {(tuple(r.ngram), r.logprob, r.backoff) for r in S.read_arpa(spark, str(tmp_path / "out")).collect()} == {(tuple(r.ngram), r.logprob, r.backoff) for r in m.collect()}


def test_simple_lm(spark, tmp_path):
    g = spark.createDataFrame([(1, ["a"], 3), (2, ["a", "b"], 2)], "level int, ngram array<string>, n long")
    S.write_simple_lm(g, str(tmp_path / "lm"))
    assert sorted(S.read_simple_lm(spark, str(tmp_path / "lm")).collect()) == sorted(g.collect())


def test_classified(spark, tmp_path):
    p = put(tmp_path, "o.txt", "# c\na c ? c { c 1.00000, d 1.00000 }        1.0000000000000\nx y A B\n")
    a, b = S.read_classified(spark, p).collect()
    assert (a.features, a.ref, a.pred, a.dist, a.distance) == (["a", "c"], "?", "c", {"c": 0.5, "d": 0.5}, 1.0)
    assert (b.features, b.ref, b.pred, b.dist, b.distance) == (["x", "y"], "A", "B", None, None)
    assert S.read_classified(spark, p, ignore_columns=(1,)).collect()[0].features == ["c"]


def test_tagged(spark, tmp_path):
    p = put(tmp_path, "t.txt", "De\tde\tLID(bep)\nkat\tkat\tN(soort)\n\n#2\nloopt\tNONE\tWW(pv)\n")
    t = S.read_tagged(spark, p)
    rows = t.orderBy("sent", "pos").select("sent", "pos", "word", "lemma").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "De", "de"), (0, 1, "kat", "kat"), (1, 0, "loopt", None)]
    S.write_tagged(t, str(tmp_path / "out"))
    again = S.read_tagged(spark, str(tmp_path / "out"))
    assert sorted(r.word for r in again.collect()) == ["De", "kat", "loopt"]


def test_senses_and_lexicon(spark, tmp_path):
    p = put(tmp_path, "s.txt", "w1 s1 0.9 s2 0.1 3.5\nw2 +vdis3 ?\n")
    a, b = S.read_senses(spark, p).orderBy("word_id").collect()
    assert [(x.sense, x.confidence) for x in a.senses] == [("s1", 0.9), ("s2", 0.1)] and a.distance == 3.5
    assert [(x.sense, x.confidence) for x in b.senses] == [("s3", None)] and b.distance is None
    lex = spark.createDataFrame([("de", "de", "LID")], "word string, lemma string, postag string")
    got = S.tag_by_lexicon(spark.createDataFrame([("De",), ("de",), ("x",)], "word string"), lex)
    assert {r.word: r.postag for r in got.collect()} == {"De": "LID", "de": "LID", "x": None}


def test_words_by_regex_and_xpath(spark, tmp_path):
    d = tmp_path / "c" / "sub"
    d.mkdir(parents=True)
    put(d, "a.xml", '<?xml version="1.0"?><T xmlns="http://x/"><p><s>\n<w xml:id="d.p.1.s.1.w.1" lemma="de" pos="LID">De</w>\n<w xml:id="d.p.1.s.1.w.2" pos="N">kat</w></s></p></T>')
    files = S.corpus_files(spark, str(tmp_path / "c"))
    w = S.scan_words(files)
    assert [(r.word, r.lemma) for r in w.orderBy("word_id").collect()] == [("De", "de"), ("kat", None)]
    assert S.grouped_words(w).first().words == ["De", "kat"]
    assert sorted(r.value for r in S.xpath_all(files, "//w/text()").collect()) == ["De", "kat"]
    assert S.corpus_files(spark, str(tmp_path / "c"), only="sub").count() == 1


def test_hmm(spark):
    start = {"rainy": 0.6, "sunny": 0.4}
    trans = {("rainy", "rainy"): 0.7, ("rainy", "sunny"): 0.3, ("sunny", "rainy"): 0.4, ("sunny", "sunny"): 0.6}
    emit = {("rainy", "walk"): 0.1, ("rainy", "shop"): 0.4, ("rainy", "clean"): 0.5, ("sunny", "walk"): 0.6, ("sunny", "shop"): 0.3, ("sunny", "clean"): 0.1}
    d = spark.createDataFrame([(1, ["walk", "shop", "clean"]), (2, ["dig"])], "id int, observations array<string>")
    a, b = models.viterbi(d, start, trans, emit, ["id"]).orderBy("id").collect()
    assert a.path == ["sunny", "rainy", "rainy"] and abs(a.p - 0.01344) < 1e-9 and b.path is None


def test_alignment_by_cursor(spark):
    d = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "b", "c"])], "id int, l array<string>, r array<string>")
    assert [(r.i, r.j) for r in models.greedy_alignment(d, "l", "r", ["id"]).collect()] == [(0, 0), (1, 2), (2, 3)]
