import itertools
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weftline.plans import cql

SENT = [("This", "this", "det"), ("is", "be", "v"), ("a", "a", "det"), ("first", "first", "a"), ("test", "test", "n"), ("of", "dit", "prep"), ("the", "the", "det"), ("new", "new", "a"), ("module", "module", "n"), (".", ".", "punc")]
CASES = [
    ('"the"', 1, 1), ('[ pos = "det" ]', 3, 3), ('[ pos = "det" ] [ pos = "a" ] [ pos = "n" ]', 2, 2), ('[ pos = "det" ] [ pos = "a" ]? [ pos = "n" ]', 2, 2),
    ('[ pos = "det" ] []? [ pos = "n" ]', 2, 2), ('[ pos = "det" ] []+ [ pos = "n" ]', 2, 5), ('[ pos = "det" ] []* [ pos = "n" ]', 2, 5), ('[pos="det" & word!="This|the"]', 1, 1), ('[tag="a"]{1,2}[pos="n"]', 2, 2),
]


@pytest.fixture(scope="module")
def sent(spark):
    return spark.createDataFrame([(1, [dict(zip(("word", "lemma", "pos"), t, strict=True)) for t in SENT]), (2, None), (3, [])], "sent_id int, tokens array<struct<word:string,lemma:string,pos:string>>")


def test_patterns(sent):
    for pattern, legacy, standard in CASES:
        assert cql.find(sent, pattern, ["sent_id"], legacy=True).count() == legacy, pattern
        assert cql.find(sent, pattern, ["sent_id"]).count() == standard, pattern
    got = cql.find(sent, '[ pos = "det" ] []+ [ pos = "n" ]', ["sent_id"]).collect()
    assert [(r.start, r.stop) for r in got] == [(0, 5), (0, 9), (2, 5), (2, 9), (6, 9)]


def test_errors():
    for bad in ('[pos="x"', '"a" {3,1}', "", '[pos < "x"]'):
        with pytest.raises(cql.PatternError):
            cql.parse(bad)
    assert cql.to_tree_query('[pos="det"]? "a|b"') == 'SELECT FOR SPAN w {0,1} WHERE pos HAS class = "det" & w WHERE ( text = "a" OR text = "b" )'


@given(st.lists(st.tuples(st.sampled_from("ab."), st.sampled_from(["", "?", "+", "*", "{2}", "{1,3}", "{0,2}", "{2,}"])), min_size=1, max_size=4), st.text("ab", max_size=7))
@settings(max_examples=150, deadline=None)
def test_automaton_is_the_regular_expression(parts, text):
    pattern = " ".join(("[]" if c == "." else f'"{c}"') + q for c, q in parts)
    rx = re.compile("".join(c + q for c, q in parts))
    a, preds = cql.automaton(cql.parse(pattern))
    got = set()
    for i in range(len(text)):
        active = set(a.first)
        for j in range(i, len(text)):
            active = {p for p in active if all(text[j] in c.values for c in preds[a.predicate[p]])}
            if active & a.last:
                got.add((i, j + 1))
            active = {q for p in active for q in a.follow[p]}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(text) + 1), 2) if rx.fullmatch(text[i:j])}


def test_find_words(spark):
    d = spark.createDataFrame([(1, "a a a A b a a".split()), (2, "a b c d a b c".split())], "id int, words array<string>")
    assert cql.find_words(d.where("id = 1"), ["a", "a"], ["id"]).count() == 4
    assert cql.find_words(d.where("id = 1"), ["a", "a"], ["id"], case_sensitive=True).count() == 3
    assert cql.find_words(d.where("id = 2"), ["a", "*", "c"], ["id"]).count() == 3
    r = cql.find_words(d, [("c", "x"), True, "a"], ["id"], left=1, right=1).first()
    assert (r.match, r.left, r.right) == (["c", "d", "a"], ["b"], ["b"])
