"""Counts of pairs against brute force, and that no pair is shuffled or stored."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weftline.operators import pairs


@pytest.fixture(scope="module")
def lines(spark):
    rnd = random.Random(3)
    some = lambda: rnd.choice([None, []]) if rnd.random() < 0.1 else [rnd.choice("ab") if rnd.random() < 0.5 else f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 40))]
    return spark.createDataFrame([(some(), some()) for _ in range(80)], "s array<string>, t array<string>").repartition(3).cache()


@pytest.mark.parametrize("most", [pairs.PAIRS_IN_TASK, 300])
def test_cooccurrence_scores(lines, monkeypatch, most):
    monkeypatch.setattr(pairs, "PAIRS_IN_TASK", most)
    joint, near, n = Counter(), Counter(), Counter()
    for (s,) in lines.select("s").where("s IS NOT NULL").collect():
        n.update(s)
        joint.update((a, b) for i, a in enumerate(s) for b in s[i + 1 :])
        near.update(zip(s, s[1:], strict=False))
    for least in (0, 5):
        want = {(a, b, k, near[a, b], n[a], n[b]) for (a, b), k in joint.items() if k > least}
        got = [tuple(r) for r in pairs.counts(lines, F.col("s"), least=least).collect()]
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("most", [pairs.PAIRS_IN_TASK, 300])
def test_word_alignment(lines, monkeypatch, most):
    monkeypatch.setattr(pairs, "PAIRS_IN_TASK", most)
    joint, n_a, n_b = Counter(), Counter(), Counter()
    for s, t in lines.where("s IS NOT NULL AND t IS NOT NULL").collect():
        n_a.update(s)
        n_b.update(t)
        joint.update((a, b) for a in s for b in t)
    got = [tuple(r) for r in pairs.counts(lines, F.col("s"), F.col("t")).select("a", "b", "joint", "n_a", "n_b").collect()]
    assert len(got) == len(joint) and set(got) == {(a, b, k, n_a[a], n_b[b]) for (a, b), k in joint.items()}


def test_many_merges(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pairs, "PAIRS_AT_ONCE", 7)
    rnd = random.Random(4)
    rows = [[rnd.randrange(9) for _ in range(rnd.randrange(12))] for _ in range(50)]
    lists = lambda: iter([(pa.array(rows[:20], pa.list_(pa.int32())), None), (pa.array(rows[20:], pa.list_(pa.int32())), None)])
    got = Counter()
    for block in range(4):
        for k, n in zip(*(x.tolist() for x in pairs._made(lists(), block, 4, 9)), strict=True):
            got[k // 2 // 9 * 4 + block, k // 2 % 9, k % 2] += n
    assert got == Counter((a, b, int(j == 0)) for s in rows for i, a in enumerate(s) for j, b in enumerate(s[i + 1 :]))


def test_no_words(spark):
    assert pairs.counts(spark.createDataFrame([([],), (None,)], "s array<string>"), F.col("s")).count() == 0


@pytest.mark.parametrize("name", ["cooccurrence_scores", "word_alignment"])
def test_no_pair_shuffled(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 0 and plan.count("SortMergeJoin") == 0
