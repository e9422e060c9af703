"""N-gram and back-off language models, Markov chains, hidden Markov models, word alignment, spelling of senses."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import BEGIN, END, joined_ngrams, let, padded
from weftline.operators.pairs import counts


def train_ngrams(sentences: DataFrame, tokens: Column, n: int) -> DataFrame:
    """Rows (history, word, n, n_history, p): p is how often ``word`` follows the n - 1 words of ``history`` (joined by blanks).

    The all-begin history is counted by sentences.  One shuffle for the counts;
    the totals of a history are a window on top of it.
    """
    grams = sentences.select(F.explode(let(padded(tokens, n), lambda p: F.transform(F.sequence(F.lit(n), F.size(p)), lambda i: F.struct(F.array_join(F.slice(p, i - n + 1, n - 1), " ").alias("history"), F.get(p, i - 1).alias("word"))))).alias("g"))
    counts = grams.groupBy("g.history", "g.word").agg(F.count("*").alias("n"))
    total = counts.groupBy("history").agg(F.sum("n").cast("long").alias("n_history"))
    return counts.join(total, "history").withColumn("p", F.col("n") / F.col("n_history"))


def score_sentences(sentences: DataFrame, tokens: Column, model: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Rows (keys..., n_grams, log_prob): the sum of ln p over a sentence's n-grams; null if one is unknown."""
    grams = sentences.select(*keys, F.explode(let(padded(tokens, n), lambda p: F.transform(F.sequence(F.lit(n), F.size(p)), lambda i: F.struct(F.array_join(F.slice(p, i - n + 1, n - 1), " ").alias("history"), F.get(p, i - 1).alias("word"))))).alias("g"))
    hit = grams.select(*keys, "g.history", "g.word").join(model.select("history", "word", "p"), ["history", "word"], "left")
    return hit.groupBy(*keys).agg(F.count("*").alias("n_grams"), F.when(F.count("p") == F.count("*"), F.sum(F.ln("p"))).alias("log_prob"))


def backoff_scores(queries: DataFrame, model: DataFrame, order: int, unknown: str = "<unk>") -> DataFrame:
    """``queries`` (id, history array, word) with ``logprob`` under an ARPA ``model`` (ngram array, logprob, backoff).

    The longest n-gram of up to ``order`` words that the model has gives the
    probability; every shorter step adds the back-off weight of the history it
    gave up (0 if absent).  A word that the model doesn't have is ``unknown``.
    One join a step on the joined n-gram; AQE broadcasts a small model.
    """
    m = model.select(F.array_join("ngram", " ").alias("_g"), F.col("logprob").alias("_lp"), F.coalesce("backoff", F.lit(0.0)).alias("_bo"))
    q = queries.withColumn("_h", F.when(F.size("history") > order - 1, F.slice("history", F.size("history") - order + 2, order - 1)).otherwise(F.col("history")))
    for k in range(order - 1, -1, -1):
        # the last k words of the history, if it has them
        h = F.when(F.size("_h") >= k, F.array_join(F.slice(F.col("_h"), F.size("_h") - k + 1, k), " ") if k else F.lit(""))
        full = F.when(h.isNotNull(), F.concat_ws(" ", F.nullif(h, F.lit("")), "word"))
        q = q.withColumn(f"_k{k}", full).withColumn(f"_hk{k}", h)
        q = q.join(m.select(F.col("_g").alias(f"_k{k}"), F.col("_lp").alias(f"_lp{k}")), f"_k{k}", "left")
        if k:
            q = q.join(m.select(F.col("_g").alias(f"_hk{k}"), F.col("_bo").alias(f"_bo{k}")), f"_hk{k}", "left")
    q = q.crossJoin(F.broadcast(m.where(F.col("_g") == unknown).agg(F.max("_lp").alias("_unk"))))
    out, given_up = None, F.lit(0.0)
    for k in range(order - 1, -1, -1):
        hit = F.col(f"_lp{k}").isNotNull()
        value = F.col(f"_lp{k}") + given_up
        out = F.when(hit, value) if out is None else out.when(hit, value)
        if k:
            given_up = given_up + F.coalesce(f"_bo{k}", F.lit(0.0))
    return q.select(*queries.columns, out.otherwise(F.col("_unk") + given_up).alias("logprob"))


def text_queries(sentences: DataFrame, tokens: Column, keys: list[str], order: int | None = None) -> DataFrame:
    """Rows (keys..., pos, history, word): every word of a sentence with those before it, of which a model of ``order`` needs the last order - 1."""
    begin = lambda i: F.lit(1) if order is None else F.greatest(i - order + 2, F.lit(1))
    size = lambda i: i if order is None else F.least(i, F.lit(order - 1))
    x = let(tokens, lambda t: F.transform(t, lambda w, i: F.struct((i + 1).alias("pos"), F.slice(t, begin(i), size(i)).alias("history"), w.alias("word"))))
    return sentences.select(*keys, F.explode(x).alias("x")).select(*keys, "x.*")


def arpa_of(counts: DataFrame, discount: float = 0.5) -> DataFrame:
    """A bigram back-off model (ngram, n, logprob, backoff) by absolute discounting from bigram counts (history, word, n); logs to base 10."""
    uni = counts.groupBy("word").agg(F.sum("n").cast("double").alias("c"))
    total = uni.agg(F.sum("c").alias("_t"))
    one = uni.crossJoin(F.broadcast(total)).select("word", (F.col("c") / F.col("_t")).alias("p"))
    hist = counts.groupBy("history").agg(F.sum("n").cast("double").alias("nh"), F.count("*").alias("kinds"))
    two = counts.join(hist, "history").join(one.withColumnRenamed("p", "pw"), "word")
    left = two.groupBy("history").agg((F.first("kinds") * discount / F.first("nh")).alias("mass"), (1 - F.sum("pw")).alias("rest"))
    weight = left.select("history", F.log10(F.when(F.col("rest") > 1e-12, F.col("mass") / F.col("rest")).otherwise(1e-99)).alias("backoff"))
    unigrams = one.join(weight, F.col("word") == F.col("history"), "full").select(F.array(F.coalesce("word", "history")).alias("ngram"), F.lit(1).alias("n"), F.coalesce(F.log10("p"), F.lit(-99.0)).alias("logprob"), "backoff")
    bigrams = two.select(F.array("history", "word").alias("ngram"), F.lit(2).alias("n"), F.log10((F.col("n") - discount) / F.col("nh")).alias("logprob"), F.lit(None).cast("double").alias("backoff"))
    return unigrams.unionByName(bigrams)


def transitions(sequences: DataFrame, states: Column) -> DataFrame:
    """Rows (src, dst, n, p) of a Markov chain over arrays of states, with begin and end marks."""
    model = train_ngrams(sequences, states, 2)
    return model.select(F.col("history").alias("src"), F.col("word").alias("dst"), "n", "p")


def sequence_probability(sequences: DataFrame, states: Column, chain: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys..., n_grams, log_prob) with begin and end marks; null where a step is impossible."""
    return score_sentences(sequences, states, chain.select(F.col("src").alias("history"), F.col("dst").alias("word"), "p"), 2, keys)


def reachable(edges: DataFrame, start: DataFrame, most: int = 1000) -> DataFrame:
    """Rows (start, node, depth): all nodes that can be reached from each start, by rounds of one join and an anti-join with those found.

    The set found is kept in the shared folder, so a lost executor costs one
    round; it ends when a round finds nothing new.
    """
    from weftline.storage import checkpoint

    e = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    found = checkpoint(start.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct())
    edge = found
    for k in range(1, most + 1):
        new = edge.join(e, edge.node == e._s).select("start", F.col("_d").alias("node"), F.lit(k).alias("depth")).distinct()
        edge = checkpoint(new.join(found.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", "depth"))
        if edge.isEmpty():
            break
        found = found.union(edge)
        if k % 10 == 0:
            found = checkpoint(found)
    return found


def viterbi(sequences: DataFrame, start: dict[str, float], trans: dict[tuple[str, str], float], emit: dict[tuple[str, str], float], keys: list[str], observations: str = "observations") -> DataFrame:
    """Rows (keys..., path, p): the most probable states of each array of observations, the greatest name on a tie; null if none is possible.

    The model is small and goes into the plan as literals; a sequence is one
    row, folded natively.
    """
    states = sorted({s for s, _ in emit} | set(start))

    def table(d: dict) -> Column:
        return F.create_map(*(x for k, v in d.items() for x in (F.lit("\0".join(k) if isinstance(k, tuple) else k), F.lit(float(v))))) if d else F.lit(None).cast("map<string,double>")

    t, e = table(trans), table(emit)
    zero = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(float(start.get(s, 0.0))).alias("p"), F.array().cast("array<string>").alias("path")) for s in states))

    def to(s: str) -> Callable[[Column], Column]:
        return lambda c: F.struct((c["p"] * F.coalesce(F.try_element_at(t, F.concat(c["state"], F.lit("\0" + s))), F.lit(0.0))).alias("p"), c["state"].alias("last"), c["path"].alias("path"))

    pick = F.array_max

    def step(acc: Column, o: Column) -> Column:
        out = []
        first = F.size(acc["cells"][0]["path"]) == 0
        for k, s in enumerate(states):
            em = F.coalesce(F.try_element_at(e, F.concat(F.lit(s + "\0"), o)), F.lit(0.0))
            best = pick(F.transform(acc["cells"], to(s)))
            p = F.when(first, acc["cells"][k]["p"]).otherwise(best["p"]) * em
            path = F.when(first, F.array(F.lit(s))).otherwise(F.concat(best["path"], F.array(F.lit(s))))
            out.append(F.struct(F.lit(s).alias("state"), p.alias("p"), path.alias("path")))
        return F.struct(F.array(*out).alias("cells"))

    def finish(acc: Column) -> Column:
        return F.array_max(F.transform(acc["cells"], lambda c: F.struct(c["p"].alias("p"), c["state"].alias("state"), c["path"].alias("path"))))

    best = F.aggregate(F.col(observations), F.struct(zero.alias("cells")), step, finish)
    return sequences.select(*keys, best.alias("b")).select(*keys, F.when(F.col("b.p") > 0, F.col("b.path")).alias("path"), F.when(F.col("b.p") > 0, F.col("b.p")).alias("p"))


def cooccurring_words(pairs: DataFrame, source: Column, target: Column) -> DataFrame:
    """Rows (source, target, n, p_target, p_source): distinct words of two aligned lines that meet, and the shares of their source and target."""
    n = counts(pairs, F.array_distinct(source), F.array_distinct(target))
    return n.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("joint").alias("n"), (F.col("joint") / F.col("n_a")).alias("p_target"), (F.col("joint") / F.col("n_b")).alias("p_source"))


def best_targets(table: DataFrame) -> DataFrame:
    """Rows (source, target, score): the target of the greatest p_target * p_source of each source, the least name on a tie; no sort."""
    score = F.col("p_target") * F.col("p_source")
    best = F.max_by(F.struct("target", score.alias("score")), F.struct(score, F.transform(F.split(F.hex("target"), ""), lambda c: -F.ascii(c))))
    return table.groupBy("source").agg(best.alias("b")).select("source", "b.target", "b.score")


def nearest_position(left: DataFrame, right: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """``left`` (keys..., word, pos) with ``match``: the place of the same word in ``right`` that is nearest, the first on a tie."""
    r = right.select(*keys, "word", F.col(pos).alias("_r"))
    near = F.min(F.when(F.col("_r").isNotNull(), F.struct(F.abs(F.col(pos) - F.col("_r")).alias("d"), F.col("_r").alias("at"))))
    return left.join(r, [*keys, "word"], "left").groupBy(*keys, "word", pos).agg(near["at"].alias("match"))


def greedy_alignment(df: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """Rows (keys..., i, j): places of two token arrays paired by one cursor over each; on a mismatch the right one skips one token."""

    def walk(batches):
        for pdf in batches:
            rows = []
            for *k, a, b in zip(*(pdf[c] for c in [*keys, left, right]), strict=True):
                if a is None or b is None:
                    continue
                j = 0
                for i, w in enumerate(a):
                    if j < len(b) and b[j] == w:
                        rows.append((*k, i, j))
                        j += 1
                    elif j + 1 < len(b) and b[j + 1] == w:
                        rows.append((*k, i, j + 1))
                        j += 2
            yield pd.DataFrame(rows, columns=[*keys, "i", "j"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return df.select(*keys, left, right).mapInPandas(walk, schema + ", i int, j int")


def intersect_alignments(forward: DataFrame, backward: DataFrame, keys: list[str]) -> DataFrame:
    """Links (keys..., s, t) that both directions have; ``backward`` has its own source and target in s and t."""
    back = backward.select(*keys, F.col("t").alias("s"), F.col("s").alias("t")).distinct()
    return forward.join(back, [*keys, "s", "t"], "left_semi")


def aligned_targets(links: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys..., s, first, last, consecutive): the range of targets of each source place, and whether it has no gap."""
    return links.groupBy(*keys, "s").agg(F.min("t").alias("first"), F.max("t").alias("last"), (F.max("t") - F.min("t") + 1 == F.count_distinct("t")).alias("consecutive"))


