import re

from pyspark.sql import functions as F

from weftline.functions import math as M
from weftline.functions import text as T


def one(spark, col, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v))
    return df.select(col.alias("x")).first().x


CASES = [
    ("This is a test.", "This is a test ."),
    ("This, is the first sentence! This is the second sentence.", "This , is the first sentence ! This is the second sentence ."),
    ("This is a test", "This is a test"),
    ("I go to http://www.example.com when I need to find something.", "I go to http://www.example.com when I need to find something ."),
    ("Write me at someone@example.org.", "Write me at someone@example.org ."),
    ("I won € 300,000.00!", "I won € 300,000.00 !"),
    ("Hij zegt: \"Wat een lief baby'tje is dat!\"", "Hij zegt : \" Wat een lief baby'tje is dat ! \""),
    ("wait... what?!", "wait ... what ? !"),
    ("", ""),
]


def test_tokenize(spark):
    for text, want in CASES:
        assert one(spark, T.tokenize("t"), t=text) == want.split()


def test_split_sentences(spark):
    split = lambda s: [" ".join(x) for x in one(spark, T.split_sentences("t"), t=s.split())]
    assert split("This is one . And two ? ! Rest") == ["This is one .", "And two ? !", "Rest"]
    assert split("a ... b .") == ["a ...", "b ."]
    assert split("") == [] and split(".") == ["."]


def test_ngrams(spark):
    t = "This is a test .".split()
    for n, want in ((1, 5), (2, 6), (3, 7)):
        assert len(one(spark, T.ngrams("t", n), t=t)) == want
    assert one(spark, T.ngrams("t", 2), t=["hi"]) == [["<begin>", "hi"], ["hi", "<end>"]]
    assert len(one(spark, T.ngrams("t", 3), t=["hi"])) == 3
    assert one(spark, T.ngrams("t", 2, None, None), t=t)[0] == ["This", "is"]
    assert one(spark, T.ngrams("t", 2, None, None), t=["x"]) == []
    assert len(one(spark, T.multi_ngrams("t", 1, 3), t=t)) == 18


def test_overlap(spark):
    df = spark.createDataFrame(
        [([4, 5, 6, 7], [5, 6]), ([4, 5, 6, 7], [4, 5, 6, 7]), ([4, 5, 6, 7], [8, 9, 10]), ([4, 5, 6, 7], [1, 2, 3, 4, 5]), ([4, 5, 6, 7], [6, 7, 8, 9])],
        "h array<int>, n array<int>",
    )
    got = [[(tuple(o.part), o.placement) for o in r.x] for r in df.select(T.calculate_overlap("h", "n").alias("x")).collect()]
    assert got == [[((5, 6), 0)], [((4, 5, 6, 7), 2)], [], [((4, 5), -1)], [((6, 7), 1)]]


def test_small_functions(spark):
    assert one(spark, T.strip_accents("t"), t="áàâãāĝŭçñßt") == "aaaaagucnt"
    assert one(spark, T.norm_spaces("t"), t="  a \n b\t") == "a b"
    assert one(spark, T.reflow("t"), t="This is wrapp-\ned text\nthat ends.\n\n---\nNew one") == ["This is wrapped text that ends.", "", "New one"]
    assert one(spark, T.parse_time("t"), t="01:02:03.5") == 3723500 and one(spark, T.parse_time("t"), t="x") is None
    assert str(one(spark, T.parse_datetime("t"), t="2011-12-15T19:00:01+02:00")) == "2011-12-15 19:00:01"
    assert one(spark, T.version_at_least("t", "1.2"), t="1.10.0") and not one(spark, T.version_at_least("t", "1.2"), t="1.1")
    tag = one(spark, T.cgn_tag("t"), t="N(soort,ev,basis,onz,stan)")
    assert tag.head == "N" and [(f.subset, f.cls) for f in tag.feats] == [("ntype", "soort"), ("getal", "ev"), ("graad", "basis"), ("genus", "onz"), ("naamval", "stan")]
    ctx = one(spark, T.contexts("t", ["b"], 2), t=["a", "b", "c", "b"])
    assert [(c.at, c.left, c.focus, c.right) for c in ctx] == [(2, ["a"], ["b"], ["c", "b"]), (4, ["b", "c"], ["b"], [])]
    assert one(spark, T.levenshtein_within("t", "u", 2), t="kitten", u="sitting") == 3
    sw = spark.createDataFrame([(["a", "b", "c"], 1)], "t array<string>, d int").select(T.swapped("t", "d").alias("x")).first().x
    assert sorted(sw) == [["a", "c", "b"], ["b", "a", "c"]]


def test_math(spark):
    assert sorted(map(tuple, M.partitions(5, 2))) == [(3, 2), (4, 1)]
    assert M.consecutive_gaps(spark, 4).count() == 3
    assert M.possible_splits(spark, 3).count() == 4
    df = spark.createDataFrame([([2.0, 3.0], [4.0, 5.0], [1, 3, 7])], "a array<double>, b array<double>, s array<int>")
    r = df.select(M.array_product("a").alias("p"), M.dot_product("a", "b").alias("d"), M.vector_add("a", "b").alias("v"), M.normalize("a").alias("n"), M.binary_search("s", F.lit(7)).alias("i"), M.binary_search("s", F.lit(2)).alias("j"), M.byte_size(F.lit(256)).alias("z")).first()
    assert (r.p, r.d, r.v, r.n, r.i, r.j, r.z) == (6.0, 23.0, [6.0, 8.0], [0.4, 0.6], 2, -1, 2)


def test_sentence_ends(spark):
    toks = [[], ["a"], [".", ".", "a"], ["a", ".", "?", "b", "...", "c"], ["…", "x", "。"], [".a", "b", ".", None, "c"]]
    d = spark.createDataFrame(list(enumerate(toks)), "id int, t array<string>")
    got = {r.id: (r.s, r.n) for r in d.select("id", T.split_sentences("t").alias("s"), T.count_sentences("t").alias("n")).collect()}
    assert got[3][0] == [["a", ".", "?"], ["b", "..."], ["c"]] and got[2][0] == [[".", "."], ["a"]] and got[4][0] == [["…"], ["x", "。"]]
    assert all(len(s) == n and sum(s, []) == toks[k] for k, (s, n) in got.items())


def test_classes_name_single_characters():
    # a range, a negated range or \w in a class costs Java a chain of tests for each character
    for pattern in (T.TOKEN, T.WORD, T.MAIL, T.URL):
        for inside in re.findall(r"(?<!\\)\[((?:\\.|[^\]\\])+)\]", pattern):
            assert not re.search(r"(?<!\\)-|\\[a-zA-Z]", inside), inside
    ref = re.compile(r"[\w:#@%/;$()~_?\+-=\\.&]", re.A)
    assert all(bool(re.match(T._U, chr(c))) == bool(ref.match(chr(c))) for c in range(0x3000))
    ref = re.compile(r"[^\t\n\x0b\f\r !-/:-@\[-`{-~]")
    assert all(bool(re.match(T._C, chr(c))) == bool(ref.match(chr(c))) for c in range(0x3000))


def test_strip_accents_by_pieces():
    """A worker never holds a batch as Python strings, only pieces of it."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["Éa ﬁ ½ ß 漢" * 400, None, ""] * 3000)
    tracemalloc.start()
    got = T.strip_accents.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == ["Ea fi 12  " * 400, None, ""] * 3000 and got.type == pa.string()
    assert peak < 16 * T.PIECE  # of 20 MB of text
