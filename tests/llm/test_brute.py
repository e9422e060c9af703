"""Operators against brute force, exact round trips and held-out labels."""

import math
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from weftline.llm import _bytes as B
from weftline.llm import chunkdedup, decontam, lmscore, minhash, pii, quality, suffixdedup, tokenbin, warc
from weftline.llm.queries import ORACLE, QUERIES, TOKENIZERS

SF = "/root/testdata/sf0.001"
RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words_of(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name]).fetchdf()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = lambda d: sorted(map(str, d.itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_near_duplicates_recall(spark, docs):
    rows = [(r.doc_id, words_of(r.text or "")) for r in docs.collect()]
    sh = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} for i, w in rows if w}
    ids = sorted(sh)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sh[a] & sh[b]) / len(sh[a] | sh[b]) >= 0.6]
    root = {r.doc_id: r.kept_doc_id for r in minhash.near_duplicates(docs).collect()}
    found = sum(root.get(a, a) == root.get(b, b) for a, b in pairs)
    assert pairs and found >= 0.9 * len(pairs)
    assert all(k < d for d, k in root.items())
    # nothing is far from all others of its group
    for d, k in root.items():
        mates = [x for x in ids if x != d and root.get(x, x) == k]
        assert max(len(sh[d] & sh[m]) / len(sh[d] | sh[m]) for m in mates) >= 0.3


def test_near_duplicates_of_repeated_ids_in_any_layout(spark):
    """Texts are compared, not ids: P + x under id 2 is a copy of P, Q under the same id is the first of its own group."""
    rng = random.Random(11)
    p, q = (" ".join(rng.choice("abcdefghijkl") * 2 + str(rng.randint(0, 999)) for _ in range(120)) for _ in "pq")
    rows = [(1, p), (2, p + " x"), (2, q), (3, q + " y"), (4, q.upper()), (4, q.upper()), (5, "other words")]
    for parts in (1, 4, 16):
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "text")
        assert sorted(map(tuple, minhash.near_duplicates(d).collect())) == [(2, 1), (3, 2), (4, 2)]
        assert sorted(map(tuple, minhash.keep_first(d).collect())) == sorted([(1, p), (2, q), (5, "other words")])


@given(st.lists(st.lists(st.integers(0, 3), min_size=4, max_size=4), min_size=1, max_size=14), st.sampled_from([0.5, 0.75]))
@settings(max_examples=80, deadline=None)
def test_buckets_lose_no_connection(rows, threshold):
    s = np.array(rows, np.uint16)
    near = [(a, b) for a in range(len(s)) for b in range(a) if (s[a] == s[b]).mean() >= threshold]

    def groups(edges):
        root = list(range(len(s)))
        for a, b in edges:
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
        return root

    got = minhash.link_bucket(s, threshold)
    assert groups(got) == groups(near) and {tuple(sorted(e)) for e in got} <= {tuple(sorted(e)) for e in near}


def test_large_buckets_are_linked_like_small_ones(spark, monkeypatch):
    base = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(base[:50] + [f"own{i}"] * (i % 3) + base[50:])) for i in range(12)] + [(20 + i, " ".join(f"x{i}y{k}" for k in range(40))) for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, minhash.near_duplicates(d).collect()))
    assert want == [(i, 0) for i in range(1, 12)]
    monkeypatch.setattr(minhash, "IN_TASK", 4)
    assert sorted(map(tuple, minhash.near_duplicates(d).collect())) == want


def test_what_a_bucket_connects_does_not_depend_on_its_size(spark, monkeypatch):
    """A member near the least of a bucket may be all that joins another to it, and share no other band with it."""
    rng = np.random.default_rng(5)
    rows, first = [], 0
    for band, (n, most) in enumerate([(3, 3), (9, 3), (25, 4), (40, 4), (40, 6), (60, 5), (30, 2)]):
        s = rng.integers(0, most, (n, 8)).astype(np.uint16)
        rows += [(first + k, 7, [band], x.tobytes(), x) for k, x in enumerate(s)]
        first += n
    # 0.5 from the least each, and 0.25, but both 0.5 from the same one
    chain = [[0] * 8, [0] * 4 + [1] * 4, [0, 0] + [2] * 2 + [1] * 4]
    rows += [(first + k, 7, [99], np.array(x, np.uint16).tobytes(), np.array(x)) for k, x in enumerate(chain)]
    root = {r[0]: r[0] for r in rows}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[2] == b[2] and (a[4] == b[4]).mean() >= 0.5:
                ra, rb = root[a[0]], root[b[0]]
                root = {k: min(ra, rb) if r in (ra, rb) else r for k, r in root.items()}
    want = {k: r for k, r in root.items() if k != r}
    assert want[first + 2] == first
    reps = spark.createDataFrame([r[:4] for r in rows], "doc_id long, t long, bands array<long>, sketch binary")
    for most in (4096, 8, 2):
        monkeypatch.setattr(minhash, "IN_TASK", most)
        got = minhash.components(minhash.link(reps, 0.5)).collect()
        assert {r.node.doc_id: r.root.doc_id for r in got} == want, most


@given(st.lists(st.lists(st.integers(0, 3), min_size=4, max_size=4), min_size=1, max_size=14), st.data())
@settings(max_examples=80, deadline=None)
def test_two_sides_lose_no_connection(rows, data):
    s, second = np.array(rows, np.uint16), data.draw(st.integers(0, len(rows)))
    near = {(a, b) for a in range(second) for b in range(second, len(s)) if (s[a] == s[b]).mean() >= 0.5}
    got = {tuple(sorted(e)) for e in minhash.link_bucket(s, 0.5, second)}

    def groups(edges):
        root = list(range(len(s)))
        for a, b in edges:
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
        return root

    assert got <= near and groups(got) == groups(near)


def test_rows_that_are_repeated_hide_no_bucket(spark):
    """1 and 2, and 1 and 3, share buckets; 2 and 3 are repeated, so that either bucket has as many rows and the same xor of hashes."""
    rng = random.Random(1)
    w = [f"w{rng.randint(0, 10**9)}" for _ in range(180)]
    m, a, b = w[:120], w[:90] + w[120:150], w[150:] + w[30:120]
    rows = [(i, " ".join(x)) for i, x in ((1, m), (2, a), (2, a), (3, b), (3, b))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(d).collect())) == [(2, 1), (3, 1)]


def test_min_max_is_unbiased():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 63, 3000, np.uint64)) for _ in range(2))
    a = np.concatenate([a[:1500], b[:1500]])
    sig = minhash.min_max(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512, 3)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05


def test_binomial_and_choice():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.02), (7, 7, 0.5)):
        assert math.isclose(quality.binomial_cdf(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    good, bad = np.zeros(101, int), np.zeros(101, int)
    good[[0, 50]] = 1000, 1
    bad[[10, 60]] = 5, 20
    c, k, kb = quality.choose(good, bad, 0.01, 0.01, 5.0)
    assert (k, kb) in ((0, 20), (1, 25)) and c is not None
    assert quality.choose(np.zeros(101, int), bad, 0.01, 0.01, 5.0)[0] is None


def test_risk_is_controlled():
    """The false rejection rate of chosen cutoffs exceeds the risk in at most a delta of draws."""
    rng, risk, delta, over = np.random.default_rng(3), 0.05, 0.1, 0
    p = np.exp(-np.arange(101) / 8.0)
    p /= p.sum()
    tail = np.append(np.cumsum(p[::-1])[::-1], 0)
    for _ in range(300):
        good = rng.multinomial(200, p)
        c, *_ = quality.choose(good, np.ones(101, int), risk, delta, 0.0)
        over += c is not None and tail[c + 1] > risk
    assert over <= 300 * delta


def test_quality_on_data(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good - kept) <= max(1, 0.05 * len(good))


def test_strata_of_few_labels_are_filtered(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for lang, n in (("en", 1500), ("de", 230), ("fr", 230), ("es", 230)):
        for k in range(n + 20):
            good = k < n
            text = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(30)) if good else "SHOUT %%%% " * 10 if k % 2 else "a b $ " * 20
            rows.append((len(rows), text, lang))
            labels.append((len(rows) - 1, int(good)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {r.doc_id for r in quality.keep_good(d, lab).collect()}
    assert kept == {i for i, good in labels if good}


def test_joint_risk_is_controlled():
    """All rules together reject more than the risk of the good in at most a delta of draws."""
    rng, risk, delta, over = np.random.default_rng(4), 0.05, 0.1, 0
    for _ in range(300):
        p = np.minimum(rng.geometric(0.04, (20_000, 4)) - 1, 100)
        g, bad = p[:200], rng.integers(0, 101, (50, 4))
        unit = quality.units(np.array([np.bincount(x, minlength=101) for x in p[200:400].T]))
        is_good = np.arange(250) < 200
        cuts = quality.choose_all(np.vstack([g, bad]), is_good.astype(int), (~is_good).astype(int), unit, risk, delta, 0.0)
        over += (p > [100 if c is None else c for c in cuts]).any(axis=1).mean() > risk
    assert over <= 300 * delta


def test_lattice_by_enumeration():
    v = lmscore.vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    p = dict(zip(v.pieces, v.prior, strict=True))

    def brute(s):
        return sum(math.exp(p[s[:k]]) * (brute(s[k:]) if k < len(s) else 1.0) for k in range(1, len(s) + 1) if s[:k] in p) if s else 1.0

    text = pa.array(["the cat sat", "zebra ünï x"])
    data, a, b, code, doc, _ = lmscore.distinct_words(text)
    got = lmscore.word_scores(v, v.prior, data, a, b)
    for s, x, y in zip(got, a, b, strict=True):
        assert math.isclose(s, math.log(brute(b" " + data[x:y].tobytes())), rel_tol=1e-9)
    counts = lmscore.expected_counts(v, v.prior, data, a, b, np.ones(len(a)))
    size = np.array([len(x) for x in v.pieces])
    assert math.isclose((counts * size).sum(), (b - a + 1).sum(), rel_tol=1e-9)  # pieces cover every byte once


def test_lm_prefers_the_corpus(spark, docs):
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    logp = lmscore.train(docs, model)
    assert abs(np.exp(logp).sum() - 1) < 1e-9
    first = docs.orderBy("doc_id").first().text
    junk = "".join(random.Random(1).choice("qxzjkvw") if c.isalpha() else c for c in first)
    got = {r.doc_id: r.bits_per_byte for r in lmscore.score(spark.createDataFrame([(1, first), (2, junk)], "doc_id long, text string"), model, logp).collect()}
    assert got[1] < got[2]


def test_wand_finds_all(spark):
    rng = random.Random(5)
    vocab = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(300)], k=rng.randint(5, 40))) + ". The end " + str(i)) for i in range(400)]
    (index,) = decontam.build_indexes(spark.createDataFrame(rows, "item_id long, text string"), 48)
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.terms)), 20))
        score = np.zeros(len(index.item))
        for t in terms:
            s = slice(index.begin[t], index.begin[t + 1])
            score[index.entry[s]] += index.impact[s]
        for least in (0.1, 0.3):
            assert sorted(e for e, _ in index.search(terms, least)) == np.flatnonzero(score >= least - 1e-9).tolist()


def test_decontamination_on_data(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    flagged = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).select("doc_id", "item_id").collect()}
    text = {r.doc_id: " ".join(words_of(r.text or "")) for r in docs.collect()}
    for r in items.collect():
        w = " ".join(words_of(r.text))
        for d, t in text.items():
            if w in t:
                assert (d, r.item_id) in flagged
    for d, i in flagged:  # every report has a run of eight words of the item
        w = words_of(items.where(f"item_id = {i}").first().text)
        assert any(" ".join(w[k : k + 8]) in text[d] for k in range(len(w) - 7))


def test_planted_item_deep_in_a_long_text(spark):
    item = "Which metal is liquid at room temperature and was once used in every household thermometer? Mercury was used for this purpose."
    fill = " ".join(f"filler{i}" for i in range(20_000))
    d = spark.createDataFrame([(1, fill + " " + item.upper() + " " + fill), (2, fill)], "doc_id long, text string")
    i = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(d, i).collect()] == [(1, 9)]
    assert [r.doc_id for r in decontam.decontaminated(d, i).collect()] == [2]


def test_items_with_one_word_replaced_or_dropped(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ask = "Which metal is liquid at room temperature and was once used in every household thermometer?"
    items += [(10_000, f"{ask} Mercury was used for this purpose."), (10_001, f"{ask} Mercury.")]
    rows, own = [], []
    for i, text in items:
        w = text.split()
        for k in range(len(w)):
            for mid in (["replacement"], []):
                rows.append((len(rows), " ".join(w[:k] + mid + w[k + 1 :])))
                own.append(i)
    only_answer = (len(rows), "He said that mercury was used for this purpose. And then he went home.")
    d = spark.createDataFrame([*rows, only_answer], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert not set(enumerate(own)) - found
    assert only_answer[0] not in {d for d, _ in found}


@given(st.lists(st.integers(0, 3), max_size=6), st.lists(st.integers(0, 3), max_size=8))
@settings(max_examples=60, deadline=None)
def test_edits_by_brute_force(part, text):
    def distance(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(distance(a[1:], b[1:]) + (a[0] != b[0]), distance(a[1:], b) + 1, distance(a, b[1:]) + 1)

    want = min(distance(part, text[i:j]) for i in range(len(text) + 1) for j in range(i, min(len(text), i + len(part)) + 1))
    assert decontam.edits(np.array(part, np.uint64), np.array(text, np.uint64)) == want


def test_item_after_a_cell_of_foreign_words(spark):
    item = "Which metal is liquid at room temperature and was once used in every household thermometer? Mercury was used for this purpose."
    d = spark.createDataFrame([(1, " ".join(f"foreign{i}" for i in range(32)) + " " + item)], "doc_id long, text string")
    i = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(d, i).collect()] == [(1, 9)]
    assert decontam.decontaminated(d, i).count() == 0


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
    return out


def brute_windows(texts, least):
    seen, out = set(), {}
    for d, t in sorted(texts.items()):
        w = words_of(t)
        for k in range(len(w) - least + 1):
            g = tuple(w[k : k + least])
            if g in seen:
                out.setdefault(d, set()).update(range(k, k + least))
            seen.add(g)
    return out


def test_passages_by_brute_force(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect() if r.text and r.doc_id is not None}
    assert covered(suffixdedup.repeated_passages(docs).collect()) == brute_windows(texts, 50)


def test_passages_with_self_overlap(spark):
    texts = {1: "a b " * 40, 2: "x y z " + "a b " * 10, 3: "q " + " ".join(f"w{i}" for i in range(30)), 4: " ".join(f"w{i}" for i in range(5, 30)) + " r"}
    d = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert covered(suffixdedup.repeated_passages(d, least=10).collect()) == brute_windows(texts, 10)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_longest_previous_factors(xs):
    codes = np.array(xs)
    order, levels = suffixdedup.suffix_array(codes, 64)
    lcp = np.zeros(len(xs), np.int64)
    lcp[1:] = suffixdedup.common_prefix(levels, order[:-1], order[1:])
    length, source = suffixdedup.longest_previous(order, lcp)

    def common(a, b):
        k = 0
        while b + k < len(xs) and xs[a + k] == xs[b + k]:
            k += 1
        return k

    for r, i in enumerate(order):
        assert length[r] == max([0, *(common(j, i) for j in range(i))])
        if length[r]:
            assert order[source[r]] < i and common(order[source[r]], i) == length[r]


def test_gear_chunks_by_hand():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 5, 700, 3000)]
    off = np.cumsum([0, *map(len, texts)])
    doc, a, b = chunkdedup.cut(np.frombuffer(b"".join(texts), np.uint8), off, 16, 5, 256)
    got = {k: sorted((int(x - off[k]), int(y - off[k])) for d, x, y in zip(doc, a, b, strict=True) if d == k) for k in range(4)}
    for k, t in enumerate(texts):
        want, at = [], 0
        for i in range(len(t)):
            n = i + 1 - at
            if n < 16 and i + 1 < len(t):
                continue
            h = 0
            for c in b"".join(texts)[max(0, off[k] + i - 31) : off[k] + i + 1]:
                h = (h << 1) + int(chunkdedup.GEAR[c]) & 0xFFFFFFFF
            if h >> 27 == 0 or n == 256 or i + 1 == len(t):
                want.append((at, i + 1))
                at = i + 1
        assert got[k] == want


def test_gear_begins_anew_with_each_text():
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (40, 1, 0, 7, 31, 32, 33, 200, 3, 90)]
    off = np.cumsum([0, *map(len, texts)])
    got = chunkdedup.gear(np.frombuffer(b"".join(texts), np.uint8), off)
    want = []
    for t in texts:
        h = 0
        for c in t:
            h = (h << 1) + int(chunkdedup.GEAR[c]) & 0xFFFFFFFF
            want.append(h)
    assert got.tolist() == want


def test_exact_copies_are_one_range_in_any_row_order(spark):
    rng = random.Random(6)
    line = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    base = [line(rng.randint(80, 400)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)] + [(1000 + i, t) for i, t in enumerate(base)] + [(500 + i, line(50)) for i in range(40)]
    seen = []
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1 + seed)
        seen.append(sorted((r.doc_id, r.start, r.stop) for r in chunkdedup.repeated_chunks(d).collect()))
    assert seen[0] == seen[1] == sorted((1000 + i, 0, len(t)) for i, t in enumerate(base))


def test_chunks_survive_an_insertion(spark):
    rng = random.Random(4)
    base = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400))
    d = spark.createDataFrame([(1, base), (2, base[:900] + " inserted words here " + base[900:]), (3, base[::-1])], "doc_id long, text string")
    rows = chunkdedup.repeated_chunks(d).collect()
    assert {r.doc_id for r in rows} == {2}
    got = sum(r.stop - r.start for r in rows)
    assert got > 0.8 * len(base)
    for r in rows:
        assert (base[:900] + " inserted words here " + base[900:])[r.start : r.stop][40:80] in base


@given(st.lists(st.lists(st.one_of(st.integers(0, 70_000), st.integers(0, (1 << 64) - 1)), max_size=300), max_size=5), st.sampled_from([1, 7, 128]))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(seqs, block):
    first = np.cumsum([0, *map(len, seqs)])
    ids = np.array([x for s in seqs for x in s], np.uint64)
    words, wf, offs, bf = tokenbin.encode(ids, first, block)
    for k, s in enumerate(seqs):
        got = tokenbin.decode(words[wf[k] : wf[k + 1]], len(s), offs[bf[k] : bf[k + 1]], block)
        assert got.tolist() == s


def test_token_ids_equal_the_tokenizer(spark, docs):
    enc = tokenbin.Encoder(RANKS)
    rows = tokenbin.token_ids(docs, RANKS).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert tokenbin.decode_row(bytes(r.payload), r.n_tokens, r.block_offsets).tolist() == enc.bpe.encode_ordinary(text[r.doc_id] or "")


@given(st.text(alphabet="ab 1\n\t'é☃.?", max_size=40))
@settings(max_examples=80, deadline=None)
def test_splitting_is_the_pattern(text):
    enc = _encoder()
    ids, first = enc(pa.array([text, "x", text]))
    assert ids[: first[1]].tolist() == enc.bpe.encode_ordinary(text) == ids[first[2] :].tolist()


_enc = []


def _encoder():
    if not _enc:
        _enc.append(tokenbin.Encoder(RANKS))
    return _enc[0]


def test_pseudonyms(spark):
    values = ["ann.b@example.org", "4111 1111 1111 1111", "+44 20 7946 0958", "123-45-6789", "192.168.1.20", "2021-02-28", "31/12/1999", "12/31/1999", "DE89 3704 0044 0532 0130 00", "0123456789abcdef0123456789abcdef"]
    bad = ["4111 1111 1111 1112", "999-45-6789", "300.1.1.1", "2021-02-30", "DE89 3704 0044 0532 0130 02"]
    text = " ; ".join(f"value {v}" for v in values)
    new, n = pii.pseudonymise(text, b"k")
    assert n == len(values) and not any(v in new for v in values)
    assert pii.pseudonymise(new, b"k", undo=True) == (text, n)
    for v in bad:
        assert pii.pseudonymise(f"is {v} now", b"k") == (f"is {v} now", 0)
    d = spark.createDataFrame([(1, f"mail {values[0]} and {values[1]}"), (2, f"{values[1]} paid")], "doc_id long, text string")
    a, b = (r.text for r in pii.pseudonyms(d, b"k").orderBy("doc_id").collect())
    assert b.removesuffix(" paid") in a  # linked across documents
    card = re.sub(r"\D", "", b)
    assert pii.luhn_digit(card[:-1]) == card[-1]


def test_compact_phone_numbers():
    for v, cc in (("+31612345678", "+31"), ("+15551234567", "+1"), ("+35312345678", "+353"), ("+74951234567", "+7"), ("+85212345678", "+852")):
        for after in ("", " 2024 too", " 12345", ", 4111 and"):
            text = f"call {v}{after}"
            new, n = pii.pseudonymise(text, b"k")
            assert n == 1 and v not in new and new.startswith(f"call {cc}") and len(new) == len(text)
            assert pii.pseudonymise(new, b"k", undo=True) == (text, n)
    (a, _), (b, _) = pii.pseudonymise("+31612345678", b"k"), pii.pseudonymise("x +31612345678 12", b"k")
    assert b == f"x {a} 12"  # linked beside other numbers
    assert pii.pseudonymise("+3161234 5678", b"k")[0].startswith("+31")
    assert pii.pseudonymise("+3161234 5678", b"k")[1] == 1
    assert pii.pseudonymise("+99912345678 and +1234567", b"k") == ("+99912345678 and +1234567", 0)


def test_cards_beside_other_numbers():
    card = "4111 1111 1111 1111"
    alone = pii.pseudonymise(card, b"k")[0]
    for form in ("{} 12/27", "{} 12-27", "{} 123", "42 {}", "7 {} 12/27", "1234 {}", "2021-02-28 {} 12", "{} 31/12/2027", "123-45-6789 {}"):
        text = "paid " + form.format(card) + " ok"
        new, n = pii.pseudonymise(text, b"k")
        assert n >= 1 and card not in new and len(new) == len(text)
        assert pii.pseudonymise(new, b"k", undo=True) == (text, n)
    assert pii.pseudonymise(f"{card} 12/27", b"k")[0] == f"{alone} 12/27"  # linked
    assert pii.pseudonymise("42 4111-1111-1111-1111", b"k")[1] == 1
    assert pii.pseudonymise(f"{card} 4012 8888 8888 1881", b"k")[1] == 2
    rng = random.Random(7)
    for _ in range(150):
        text = "".join(rng.choice("0123456789") + rng.choice(["", "", "", " ", "-"]) for _ in range(rng.randint(13, 90))) + "x y"
        new, n = pii.pseudonymise(text, b"k")
        assert pii.pseudonymise(new, b"k", undo=True) == (text, n)


@given(st.integers(2, 5000), st.binary(min_size=1, max_size=8))
@settings(max_examples=30, deadline=None)
def test_feistel_is_a_permutation(size, key):
    some = range(0, size, max(1, size // 50))
    out = [pii.permute(x, size, key, "t") for x in some]
    assert len(set(out)) == len(out) and all(0 <= y < size for y in out)
    assert [pii.permute(y, size, key, "t", undo=True) for y in out] == list(some)


def test_warc_index_of_foreign_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * i) for i in range(50)], "page_id long, url string, html string")
    own = warc.write_warc(pages.repartition(2), f"file://{tmp_path}/w")
    made = warc.index_warc(spark, f"file://{tmp_path}/w/*.warc.gz")
    key = lambda d: sorted((r.offset, r.length, r.url, r.digest) for r in d.collect())
    assert key(own) == key(made)
    got = {r.url: bytes(r.payload).decode() for r in warc.read_records(made.where("url LIKE '%7'")).collect()}
    assert got == {f"http://h/{i}": f"<p>{i}</p>" * i for i in range(50) if i % 10 == 7}


def test_first_of_copies_does_not_depend_on_the_size_of_buckets(spark, monkeypatch):
    """Of four texts in a row each is near the next only; whatever bucket they share, one stays."""
    near = lambda a, b: (a == b).mean() >= 0.5
    chain = np.array([[0] * 8, [0] * 4 + [1] * 4, [0, 0] + [2] * 2 + [1] * 4, [0, 0, 2, 2, 3, 3, 3, 3]], np.uint16)
    assert [(a, b) for a in range(4) for b in range(a) if near(chain[a], chain[b])] == [(1, 0), (2, 1), (3, 2)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4)], "doc_id long, text string").coalesce(1)
    sig = docs.selectExpr("doc_id", "xxhash64(text) AS t", "doc_id AS h1", "doc_id AS h2", "array(5L) AS bands").join(
        spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(chain)], "doc_id long, sketch binary"), "doc_id"
    )
    monkeypatch.setattr(minhash, "signatures", lambda *a: sig)
    for most in (4096, 2):
        monkeypatch.setattr(minhash, "IN_TASK", most)
        assert [r.doc_id for r in minhash.keep_first(docs).collect()] == [0], most


@pytest.mark.parametrize("stage", ["graded", "signatures", "decontaminated", "token_ids"])
def test_stages_of_the_pipeline_hold_little_memory(spark, monkeypatch, stage):
    """Beside a batch of 6 MB of text, which is most of what a worker keeps, no stage takes more than 60 MB of arrays."""

    class Docs:  # instead of a DataFrame: gives the function that the workers run
        columns, schema = ["doc_id", "text"], spark.createDataFrame([], "doc_id long, text string").schema
        select = where = lambda self, *_: self
        mapInArrow = lambda self, f, _: f

    monkeypatch.setattr(B, "_pow", [np.ones(1, B.U64), np.ones(1, B.U64)])
    monkeypatch.setattr(decontam, "build_indexes", lambda *a, **k: [])
    monkeypatch.setattr(tokenbin, "_encoders", {})  # a table made here would be sent to workers later
    run = {
        "graded": lambda: quality.graded(Docs(), list("abcd")),
        "signatures": lambda: minhash.signatures(Docs(), 3, 64, 4, 7),
        "decontaminated": lambda: decontam.decontaminated(Docs(), None),
        "token_ids": lambda: tokenbin.token_ids(Docs(), RANKS),
    }[stage]()
    rng = np.random.default_rng(2)
    text = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 3000, 400)) for _ in range(3000)])
    ids = pa.array(np.arange(len(text)))
    cols = [ids, ids, text] if stage == "signatures" else [ids, text]
    batch = pa.RecordBatch.from_arrays(cols, ["doc_id", "t", "text"] if len(cols) == 3 else ["doc_id", "text"])
    small = batch.slice(0, 5)
    assert sum(out.num_rows for out in run(iter([small]))) == 5  # tables that stay are made
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(text) and most < 60e6, most / 1e6


def test_pipeline_by_hand(spark):
    """The decisions of every stage, followed on the ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [r.doc_id for r in corpus_pipeline.run(spark, SF).collect()]
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = quality.keep_good(docs, labels)
    gone = {r.doc_id for r in minhash.near_duplicates(kept).collect()}
    leaked = {r.doc_id for r in decontam.contaminated(kept, items).collect()}
    ids = {r.doc_id for r in kept.collect()} - gone - leaked
    assert set(out) <= ids
    assert len(set(out)) > 0.3 * len(ids)
