import math

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import cooccurrence, evaluation, freq, models, search, selection
from weftline.streaming import text as stream


def test_frequency_lists(spark):
    d = spark.createDataFrame([("This is a sentence .",), ("Moreover , this sentence is a test .",)], "t string")
    f = freq.count_items(d, T.raw_tokens("t"))
    n = {r.type: r.n for r in f.collect()}
    assert n["sentence"] == 2 and n["this"] == 1 and sum(n.values()) == 13 and len(n) == 9
    low = {r.type: r.n for r in freq.count_items(d, T.raw_tokens("t"), case_sensitive=False).collect()}
    assert low["this"] == 2
    b = {r.type: r.n for r in freq.count_items(d, T.joined_ngrams(T.raw_tokens("t"), 2)).collect()}
    assert b["is a"] == 2 and b["This is"] == 1
    assert freq.same(f, f) and not freq.same(f, freq.merge(f, f))
    assert freq.contains(f, spark.createDataFrame([("sentence",)], "type string")).first().n == 2
    e = freq.entropy(freq.distribution(f)).first()
    assert math.isclose(e.entropy, -sum(v / 13 * math.log2(v / 13) for v in n.values()))


def test_frequency_file(spark, tmp_path):
    f = spark.createDataFrame([("a b", 3), ('q"', 1)], "type string, n long")
    freq.save(f, str(tmp_path / "f"), add_p=True)
    assert freq.same(freq.load(spark, str(tmp_path / "f")), f)


def test_evaluation(spark):
    rows = [("cat", "cat")] * 5 + [("cat", "dog")] * 3 + [("dog", "cat")] * 2 + [("dog", "rabbit")] + [("dog", "dog")] * 3 + [("rabbit", "rabbit")] * 11 + [("rabbit", "dog")] * 2
    d = spark.createDataFrame(rows, "goal string, observation string")
    s = evaluation.class_scores(evaluation.class_counts(d))
    got = {r["class"]: (r.tp, r.fp, r.tn, r.fn, round(r.precision, 6), round(r.recall, 6), round(r.fscore, 6)) for r in s.collect()}
    assert got == {"cat": (5, 2, 17, 3, 0.714286, 0.625, 0.666667), "rabbit": (11, 1, 13, 2, 0.916667, 0.846154, 0.88), "dog": (3, 5, 16, 3, 0.375, 0.5, 0.428571)}
    assert round(evaluation.averages(s).first().overall_accuracy, 6) == 0.703704
    assert evaluation.confusion_wide(d, ["cat", "dog", "rabbit"]).where("goal = 'cat'").first().dog == 3
    o = spark.createDataFrame(list(zip([1, 2, 3, 4, 3, 2], [4, 1, 3, 4, 2, 2], strict=True)), "goal int, observation int")
    total = evaluation.ordinal_errors(o).where("observation IS NULL").first()
    assert math.isclose(total.mae, 5 / 6) and math.isclose(total.rmse, math.sqrt(11 / 6))
    missing = spark.createDataFrame([("a", None), ("a", "a")], "goal string, observation string")
    assert [(r.tp, r.fn) for r in evaluation.class_counts(missing).collect()] == [(1, 1)]


def test_association(spark):
    d = spark.createDataFrame([("a b a",), ("b c",)], "t string")
    rows = {(r.a, r.b): r for r in cooccurrence.association(d, T.raw_tokens("t")).collect()}
    r = rows["a", "b"]
    assert (r.joint, r.adjacent, r.n_a, r.n_b) == (1, 1, 2, 2) and math.isclose(r.pmi, math.log((1 / 5) / (2 / 5 * 2 / 5)))
    assert math.isclose(r.jaccard, 1 / 3) and math.isclose(r.dice, 0.5)
    disc = {(r.a, r.b): r.pmi for r in cooccurrence.association(d, T.raw_tokens("t"), discount_adjacent=True).collect()}
    assert disc["a", "b"] is None


def test_models(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "a c")], "id int, t string")
    m = models.train_ngrams(d, T.raw_tokens("t"), 2)
    s = {r.id: r.log_prob for r in models.score_sentences(d, T.raw_tokens("t"), m, 2, ["id"]).collect()}
    assert math.isclose(s[1], math.log(0.5))
    unseen = models.score_sentences(spark.createDataFrame([(3, "z")], d.schema), T.raw_tokens("t"), m, 2, ["id"]).first()
    assert unseen.log_prob is None
    arpa = models.arpa_of(m)
    q = models.text_queries(d, T.raw_tokens("t"), ["id"])
    assert models.backoff_scores(q, arpa, 2).where("logprob IS NULL").count() == 0
    t = models.cooccurring_words(spark.createDataFrame([("la maison", "the house"), ("la fleur", "the flower")], "s string, t string"), T.raw_tokens("s"), T.raw_tokens("t"))
    assert {r.source: r.target for r in models.best_targets(t).collect()}["la"] == "the"


def test_queues_and_splits(spark):
    v = spark.createDataFrame(list(enumerate([3, 6, 6, 1, 8, 2])), "seq int, score int").withColumn("q", F.lit(1))
    scores = lambda df: [r.score for r in df.orderBy("seq").collect()]
    assert [r.score for r in selection.top(v, "score", 6, least=True).collect()] == [1, 2, 3, 6, 6, 8]
    assert sorted(scores(selection.blocked(v, ["q"], "seq", "score")), reverse=True) == [8, 6, 6, 3]
    assert sorted(scores(selection.blocked(v, ["q"], "seq", "score", equal=True)), reverse=True) == [8, 6, 3]
    assert sorted(scores(selection.blocked(v, ["q"], "seq", "score", least=True))) == [1, 3]
    d = spark.range(100)
    parts = {r.part: r.n for r in selection.split(d, F.col("id"), 10, 5).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"test": 10, "dev": 5, "train": 85}
    assert selection.sampled(d, F.col("id"), 7).count() == 7


def test_parameter_search(spark):
    g = selection.grid(spark, {"a": [2, 4], "b": [2, 5, 8], "c": [3, 6, 9]})
    data = spark.createDataFrame([(i,) for i in range(1, 7)], "v int")
    score = F.sum(F.col("v") * F.col("a") * F.col("b") - F.col("c"))
    assert tuple(selection.exhaustive_search(g, data, score).collect()[-1])[:3] == (4, 8, 3)
    assert tuple(selection.progressive_search(g, data, score, F.col("v")).first())[:3] == (4, 8, 3)
    assert selection.run_experiments([lambda: spark.range(3).count(), lambda: spark.range(4).count()], 2) == [3, 4]


def test_tries_and_patterns(spark):
    d = spark.createDataFrame([(["a", "b"],), (["a", "c"],), (["a"],)], "s array<string>")
    t = selection.trie(d, F.col("s"))
    assert {tuple(r.prefix): (r.n, r.ends) for r in t.collect()} == {("a",): (3, 1), ("a", "b"): (1, 1), ("a", "c"): (1, 1)}
    assert sorted(tuple(r.prefix) for r in selection.leaves(t).collect()) == [("a", "b"), ("a", "c")]
    k = spark.createDataFrame([([1, 256],)], "c array<long>").select(selection.encode_pattern(F.col("c")).alias("k")).first().k
    assert bytes(k) == b"\x01\x01\x02\x00\x01"


def test_reordering_search(spark):
    goal = "This is a test sentence .".split()
    start = spark.createDataFrame([(1, "a This test . sentence is".split())], "id int, state array<string>")
    want = F.array(*map(F.lit, goal))
    score = lambda s: F.aggregate(F.zip_with(s, want, lambda x, y: (x != y).cast("int")), F.lit(0), lambda a, x: a + x)
    far = lambda s: F.aggregate(F.transform(s, lambda x: F.abs(F.array_position(s, x) - F.array_position(want, x)).cast("int")), F.lit(0), lambda a, x: a + x)
    r = search.beam_search(start, search.swapped_neighbours, lambda s: s == want, far, beam=3, max_depth=15).first()
    assert r.state == goal and len(r.path) == r.depth + 1 and score is not None
    near = spark.createDataFrame([(1, ["b", "a", "c"]), (2, ["c", "b", "a"])], "id int, state array<string>")
    abc = F.array(*map(F.lit, "abc"))
    got = {r.id: r.depth for r in search.breadth_first(near, search.swapped_neighbours, lambda s: s == abc).collect()}
    assert got == {1: 1, 2: 3}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One two. Two!\n")
    (tmp_path / "in" / "b.txt").write_text("two\n")
    lines = stream.read_lines(spark, str(tmp_path / "in"))
    q = stream.running_frequencies(lines, T.tokenize("value")).writeStream.outputMode("complete").format("memory").queryName("freqs").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.type: r.n for r in spark.table("freqs").collect()}
    assert got["two"] == 2 and got["Two"] == 1
    q = stream.sentences(lines).writeStream.format("memory").queryName("sents").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("sents").count() == 3


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and "bigram_freq_markers" in q


def test_ordered_pairs(spark, monkeypatch):
    d = spark.range(40).select("id", F.concat(F.lit("né#"), (F.col("id") % 7).cast("string")).alias("name")).coalesce(1)
    want = {(a, b) for a in range(40) for b in range(a + 1, 40)}
    for limit in (1000, 10):
        monkeypatch.setattr(selection, "PAIRS_BROADCAST", limit)
        monkeypatch.setattr(selection, "PAIRS_IN_TASK", 100)
        p = selection.ordered_pairs(d, "id")
        assert {tuple(r) for r in p.select("a.id", "b.id").collect()} == want
        assert p.rdd.getNumPartitions() >= 16  # however few files there are
    assert [r.name for r in T.without_common_prefix(d, "name").orderBy("id").limit(3).collect()] == ["0", "1", "2"]
    assert [r.name for r in T.without_common_prefix(d.limit(1), "name").collect()] == [""]


def test_count_ngrams(spark):
    d = spark.createDataFrame([([],), (["a"],), (None,), ("a b a b é".split(),), ("a b".split(),), (["b"] * 40,)], "t array<string>").coalesce(1)
    for low, high in ((1, 3), (2, 2), (1, 1), (3, 5)):
        want = freq.count_items(d, T.multi_ngrams("t", low, high))
        got = freq.count_ngrams(d, F.col("t"), low, high)
        assert got.count() == want.count() and freq.same(got, want), (low, high)
    assert freq.count_ngrams(d.where("t IS NULL"), F.col("t"), 1, 2).count() == 0


def test_multi_ngram_windows_makes_whole_arrays(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["multi_ngram_windows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "MapInArrow" in plan
