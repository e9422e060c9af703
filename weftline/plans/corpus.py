"""Queries on plain text: tokens, sentences, n-grams, frequency lists, co-occurrence, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import math as M
from weftline.functions import text as T
from weftline.operators import cooccurrence, evaluation, freq, models, selection
from weftline.plans.registry import query
from weftline.session import table
from weftline.storage import written

RAW_SQL = f"regexp_extract_all(text, '{T.RAW}')"
TOK_SQL = "regexp_extract_all(text, '" + T.TOKEN_RE2.replace("'", "''") + "')"
EOS_SQL = "'^[.?!;。؟।॥…]+$'"


def _docs(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", *cols)


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


@query(f"SELECT w AS type, COUNT(*) AS n FROM (SELECT UNNEST({TOK_SQL}) AS w FROM documents) GROUP BY w")
def tokenize_freq(spark, sf):
    return freq.count_items(_docs(spark, sf), T.tokenize("text"))


@query(
    f"""WITH t AS (SELECT doc_id, {TOK_SQL} AS t FROM documents),
s AS (SELECT doc_id, LEN(t) AS n, LEN(list_filter(range(1, LEN(t) + 1), lambda i: i = LEN(t) OR (regexp_matches(t[i], {EOS_SQL}) AND NOT regexp_matches(t[i + 1], {EOS_SQL})))) AS k FROM t)
SELECT doc_id, n AS n_tokens, k AS n_sentences FROM s"""
)
def sentence_split(spark, sf):
    t = _docs(spark, sf).select("doc_id", T.tokenize("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), T.count_sentences("t").cast("long").alias("n_sentences"))


@query("SELECT doc_id, LEN(list_filter(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda x: TRIM(x, ' ') <> '')) AS n_paragraphs FROM documents")
def paragraph_split(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.paragraphs("text")).cast("long").alias("n_paragraphs"))


def _ngram_sql(n: int, sides: bool = True) -> str:
    pad = f"list_concat(list_concat(list_resize(CAST([] AS VARCHAR[]), {n - 1}, '<begin>'), r), list_resize(CAST([] AS VARCHAR[]), {n - 1}, '<end>'))" if sides and n > 1 else "r"
    return f"""SELECT array_to_string(list_slice(p, i, i + {n - 1}), ' ') AS type FROM (
  SELECT p, UNNEST(range(1, LEN(p) - {n} + 2)) AS i FROM (SELECT {pad} AS p FROM (SELECT {RAW_SQL} AS r FROM documents)))"""


@query(f"SELECT type, COUNT(*) AS n FROM ({_ngram_sql(2)}) GROUP BY type")
def bigram_windows(spark, sf):
    return freq.count_items(_docs(spark, sf), T.joined_ngrams(T.raw_tokens("text"), 2))


@query(f"SELECT type, COUNT(*) AS n FROM ({_ngram_sql(1)} UNION ALL {_ngram_sql(2)} UNION ALL {_ngram_sql(3)}) GROUP BY type HAVING COUNT(*) >= 5")
def multi_ngram_windows(spark, sf):
    return freq.count_ngrams(_docs(spark, sf), T.raw_tokens("text"), 1, 3).where("n >= 5")


@query(
    f"""WITH f AS (SELECT type, COUNT(*) AS n FROM ({_ngram_sql(2)}) GROUP BY type), p AS (SELECT type, n, n::DOUBLE / SUM(n) OVER () AS p FROM f)
SELECT type, n, p, -LN(p) / LN(2) AS information FROM p"""
)
def bigram_freq_markers(spark, sf):
    return freq.freqlist(_docs(spark, sf), T.joined_ngrams(T.raw_tokens("text"), 2))


FREQ_SQL = f"SELECT w AS type, COUNT(*) AS n FROM (SELECT UNNEST({RAW_SQL}) AS w FROM documents) GROUP BY w"


def _freq(spark, sf, **how) -> DataFrame:
    return freq.count_items(_docs(spark, sf), T.raw_tokens("text"), **how)


@query(FREQ_SQL)
def freq_list(spark, sf):
    return _freq(spark, sf)


@query(f"SELECT LOWER(type) AS type, SUM(n)::BIGINT AS n FROM ({FREQ_SQL}) GROUP BY LOWER(type)")
def freq_list_caseless(spark, sf):
    return _freq(spark, sf, case_sensitive=False)


@query(f"SELECT lang, COUNT(*)::BIGINT AS tokens, COUNT(DISTINCT w) AS types, COUNT(DISTINCT w)::DOUBLE / COUNT(*) AS ttr FROM (SELECT lang, UNNEST({RAW_SQL}) AS w FROM documents) GROUP BY lang")
def type_token_ratio(spark, sf):
    return freq.totals(freq.count_items(_docs(spark, sf, "lang"), T.raw_tokens("text"), ["lang"]), ["lang"])


@query(f"SELECT type, n, ROW_NUMBER() OVER (ORDER BY n DESC, type) AS rank FROM ({FREQ_SQL}) QUALIFY rank <= 100")
def freq_most_common(spark, sf):
    return freq.most_common(_freq(spark, sf), 100).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "type")).cast("long"))


@query(f"SELECT lang, MIN(w) AS type, MAX(n) AS n FROM (SELECT lang, w, COUNT(*) AS n, MAX(COUNT(*)) OVER (PARTITION BY lang) AS m FROM (SELECT lang, UNNEST({RAW_SQL}) AS w FROM documents) GROUP BY lang, w) WHERE n = m GROUP BY lang")
def freq_mode(spark, sf):
    return freq.mode(freq.count_items(_docs(spark, sf, "lang"), T.raw_tokens("text"), ["lang"]), ["lang"]).select("lang", "type", "n")


@query(f"SELECT type, SUM(n)::BIGINT AS n FROM ({FREQ_SQL} UNION ALL SELECT w, COUNT(*) FROM (SELECT UNNEST({RAW_SQL}) AS w FROM conversations) GROUP BY w) GROUP BY type")
def freq_merge(spark, sf):
    return freq.merge(_freq(spark, sf), freq.count_items(_turns(spark, sf), T.raw_tokens("text")))


@query(f"SELECT type, n FROM ({FREQ_SQL}) WHERE type NOT IN (SELECT UNNEST({RAW_SQL}) FROM conversations)")
def freq_difference(spark, sf):
    return freq.without(_freq(spark, sf), freq.count_items(_turns(spark, sf), T.raw_tokens("text")))


@query(
    f"""WITH f AS (SELECT lang, w, COUNT(*) AS n FROM (SELECT lang, UNNEST({RAW_SQL}) AS w FROM documents) GROUP BY lang, w), p AS (SELECT lang, n::DOUBLE / SUM(n) OVER (PARTITION BY lang) AS p FROM f)
SELECT lang, COUNT(*) AS types, ROUND(SUM(-p * LN(p)) / LN(2), 6) AS entropy, ROUND(POW(2, SUM(-p * LN(p)) / LN(2)), 3) AS perplexity, ROUND(LN(COUNT(*)) / LN(2), 6) AS max_entropy FROM p GROUP BY lang"""
)
def entropy_by_language(spark, sf):
    d = freq.distribution(freq.count_items(_docs(spark, sf, "lang"), T.raw_tokens("text"), ["lang"]), ["lang"])
    e = freq.entropy(d, ["lang"])
    return e.select("lang", "types", F.round("entropy", 6).alias("entropy"), F.round("perplexity", 3).alias("perplexity"), F.round("max_entropy", 6).alias("max_entropy"))


@query("SELECT doc_id, TRIM(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ') AS text FROM documents")
def normalized_spaces(spark, sf):
    return _docs(spark, sf).select("doc_id", T.norm_spaces("text").alias("text"))


@query("SELECT doc_id, regexp_replace(regexp_replace(strip_accents(text), 'ß', '', 'g'), '[^\\x00-\\x7f]', '', 'g') AS text FROM documents")
def accents_stripped(spark, sf):
    return _docs(spark, sf).select("doc_id", T.strip_accents("text").alias("text"))


@query(
    f"""WITH t AS (SELECT doc_id, {RAW_SQL} AS t FROM documents),
p AS (SELECT doc_id, t, UNNEST(list_filter(range(1, LEN(t) + 1), lambda i: t[i] = 'de')) AS k FROM t)
SELECT doc_id, k::INT AS place, array_to_string(list_slice(t, GREATEST(k - 3, 1), k - 1), ' ') AS l, t[k] AS focus, array_to_string(list_slice(t, k + 1, k + 3), ' ') AS r FROM p"""
)
def keyword_in_context(spark, sf):
    c = _docs(spark, sf).select("doc_id", F.explode(T.contexts(T.raw_tokens("text"), ["de"], 3)).alias("c"))
    return c.select("doc_id", F.col("c.at").alias("place"), F.array_join("c.left", " ").alias("l"), F.array_join("c.focus", " ").alias("focus"), F.array_join("c.right", " ").alias("r"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, LEAST(levenshtein(a.s_name, b.s_name), 3)::INT AS d FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")
def edit_distances(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    s = T.without_common_prefix(s, "name")  # of no weight in a distance, but of much in its time
    return selection.ordered_pairs(s, "k").select("a.k", "b.k", T.levenshtein_within("a.name", "b.name", 2).cast("int").alias("d")).toDF("a", "b", "d")


@query("SELECT (n_chars // 500)::BIGINT AS bin, COUNT(*) AS n FROM documents GROUP BY 1")
def length_histogram(spark, sf):
    return M.histogram(table(spark, sf, "documents"), F.floor(F.col("n_chars") / 500))


@query("SELECT lang, ROUND(AVG(n_chars), 6) AS mean, MEDIAN(n_chars) AS median, ROUND(STDDEV_SAMP(n_chars), 6) AS stddev FROM documents GROUP BY lang")
def length_statistics(spark, sf):
    c = F.col("n_chars")
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(F.avg(c), 6).alias("mean"), F.median(c).alias("median"), F.round(F.stddev_samp(c), 6).alias("stddev"))


@query(
    """SELECT a.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) > 0 AS positive, ROUND(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 5) AS dot
FROM embeddings a JOIN embeddings b ON b.vec_id = (SELECT MIN(vec_id) FROM embeddings)"""
)
def dot_products(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = e.agg(F.min_by("embedding", "vec_id").alias("q"))
    d = M.dot_product("embedding", "q")
    return e.crossJoin(F.broadcast(q)).select("vec_id", (d > 0).alias("positive"), F.round(d, 5).alias("dot"))


PAIRS_SQL = f"""WITH r AS (SELECT conv_id, turn, {RAW_SQL} AS t FROM conversations),
w AS (SELECT conv_id, turn, UNNEST(t) AS w, UNNEST(range(1, LEN(t) + 1)) AS i FROM r),
u AS (SELECT w, COUNT(*) AS n FROM w GROUP BY w), tt AS (SELECT COUNT(*)::DOUBLE AS t FROM w),
j AS (SELECT x.w AS a, y.w AS b, COUNT(*) AS joint, SUM((y.i = x.i + 1)::INT)::BIGINT AS adjacent
      FROM w x JOIN w y ON x.conv_id = y.conv_id AND x.turn = y.turn AND y.i > x.i GROUP BY x.w, y.w),
s AS (SELECT j.*, u.n AS n_a, v.n AS n_b, joint::DOUBLE AS x, t FROM j JOIN u ON u.w = a JOIN u v ON v.w = b, tt WHERE joint > 5),
k AS (SELECT *, LN(x * t / (n_a * n_b)) AS pmi, x / NULLIF(n_a + n_b - x, 0) AS jaccard FROM s)
SELECT a, b, joint, adjacent, n_a, n_b, pmi, pmi / -LN(x / t) AS npmi, jaccard, 2 * jaccard / NULLIF(1 + jaccard, 0) AS dice, adjacent / joint AS adjacency FROM k"""


@query(PAIRS_SQL)
def cooccurrence_scores(spark, sf):
    return cooccurrence.association(_turns(spark, sf), T.raw_tokens("text"), least=5)


@query("SELECT quality AS goal, toxic AS observation, COUNT(*) AS n FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return evaluation.confusion(table(spark, sf, "labels"), "quality", "toxic")


CLASS_SQL = """WITH d AS (SELECT l_returnflag AS g, CASE WHEN l_quantity < 20 THEN 'A' WHEN l_quantity < 40 THEN 'N' ELSE 'R' END AS o FROM lineitem),
c AS (SELECT DISTINCT g AS class FROM d UNION SELECT DISTINCT o FROM d),
k AS (SELECT class, SUM((g = class AND o = class)::INT)::BIGINT AS tp, SUM((g <> class AND o = class)::INT)::BIGINT AS fp, SUM((g = class AND o <> class)::INT)::BIGINT AS fn, SUM((g <> class AND o <> class)::INT)::BIGINT AS tn FROM d, c GROUP BY class),
s AS (SELECT *, COALESCE(tp / NULLIF(tp + fp, 0), 0.0) AS precision, COALESCE(tp / NULLIF(tp + fn, 0), 0.0) AS recall, tn / (tn + fp) AS specificity, (tp + tn) / (tp + tn + fp + fn) AS accuracy, fp / (fp + tn) AS fpr FROM k)"""


def _classified(spark, sf) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("goal"), F.when(q < 20, "A").when(q < 40, "N").otherwise("R").alias("observation"))


@query(CLASS_SQL + "SELECT class, tp, fp, fn, tn, precision, recall, specificity, accuracy, COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0.0) AS fscore, recall AS tpr, fpr, (1 + recall - fpr) / 2 AS auc FROM s")
def class_evaluation(spark, sf):
    return evaluation.class_scores(evaluation.class_counts(_classified(spark, sf)))


@query(CLASS_SQL + "SELECT SUM(tp) / SUM(tp + fn) AS overall_accuracy, SUM(precision * (tp + fn)) / SUM(tp + fn) AS micro_precision, SUM(recall * (tp + fn)) / SUM(tp + fn) AS micro_recall, AVG(precision) AS macro_precision, AVG(recall) AS macro_recall FROM s")
def averaged_evaluation(spark, sf):
    s = evaluation.averages(evaluation.class_scores(evaluation.class_counts(_classified(spark, sf))))
    return s.select("overall_accuracy", "micro_precision", "micro_recall", "macro_precision", "macro_recall")


@query(
    """WITH d AS (SELECT l_linenumber AS g, FLOOR(l_quantity / 8)::INT AS o FROM lineitem)
SELECT o AS observation, COUNT(*) AS n, AVG(ABS(g - o)) AS mae, SQRT(AVG((g - o) * (g - o))) AS rmse FROM d GROUP BY o
UNION ALL SELECT NULL, COUNT(*), AVG(ABS(g - o)), SQRT(AVG((g - o) * (g - o))) FROM d"""
)
def ordinal_evaluation(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("goal"), F.floor(F.col("l_quantity") / 8).cast("int").alias("observation"))
    return evaluation.ordinal_errors(d)


@query(
    """WITH c AS (SELECT l_returnflag AS k, FLOOR(l_quantity / 5) / 10.0::DOUBLE AS x, COUNT(*) FILTER (l_discount > 0.05) / COUNT(*)::DOUBLE AS y FROM lineitem GROUP BY ALL),
e AS (SELECT k, x, y FROM c UNION ALL SELECT DISTINCT k, UNNEST([0.0, 1.0])::DOUBLE, UNNEST([0.0, 1.0])::DOUBLE FROM (SELECT DISTINCT k FROM c)),
s AS (SELECT k, x - LAG(x) OVER w AS dx, y + LAG(y) OVER w AS sy FROM e WINDOW w AS (PARTITION BY k ORDER BY x, y))
SELECT k, SUM(dx * sy / 2) AS auc FROM s GROUP BY k"""
)
def curve_area(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k"), (F.floor(F.col("l_quantity") / 5) / 10.0).alias("x")).agg((F.count_if(F.col("l_discount") > 0.05) / F.count("*")).alias("y"))
    return evaluation.auc_curve(c, ["k"], "x", "y")


LM_SQL = f"""WITH r AS (SELECT list_concat(list_concat(['<begin>'], {RAW_SQL}), ['<end>']) AS p FROM conversations),
g AS (SELECT p[i - 1] AS history, p[i] AS word FROM (SELECT p, UNNEST(range(2, LEN(p) + 1)) AS i FROM r)),
c AS (SELECT history, word, COUNT(*) AS n FROM g GROUP BY 1, 2),
m AS (SELECT history, word, n, SUM(n) OVER (PARTITION BY history)::BIGINT AS n_history FROM c)"""


@query(LM_SQL + "SELECT history, word, n, n_history, n / n_history AS p FROM m")
def bigram_model(spark, sf):
    return models.train_ngrams(_turns(spark, sf), T.raw_tokens("text"), 2)


@query(
    LM_SQL
    + f""", q AS (SELECT conv_id, turn, list_concat(list_concat(['<begin>'], {RAW_SQL}), ['<end>']) AS p FROM conversations),
x AS (SELECT conv_id, turn, p[i - 1] AS history, p[i] AS word FROM (SELECT conv_id, turn, p, UNNEST(range(2, LEN(p) + 1)) AS i FROM q))
SELECT conv_id, turn, COUNT(*) AS n_grams, ROUND(SUM(LN(n / n_history)), 6) AS log_prob FROM x JOIN m USING (history, word) GROUP BY conv_id, turn"""
)
def sentence_scores(spark, sf):
    t = _turns(spark, sf)
    s = models.score_sentences(t, T.raw_tokens("text"), models.train_ngrams(t, T.raw_tokens("text"), 2), 2, ["conv_id", "turn"])
    return s.select("conv_id", "turn", "n_grams", F.round("log_prob", 6).alias("log_prob"))


@query(
    """WITH e AS (SELECT user_id, event_type AS s, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
f AS (SELECT COALESCE(b, '<begin>') AS src, s AS dst FROM e UNION ALL SELECT LAST(event_type ORDER BY ts, event_id), '<end>' FROM events GROUP BY user_id),
c AS (SELECT src, dst, COUNT(*) AS n FROM f GROUP BY 1, 2)
SELECT src, dst, n, n / SUM(n) OVER (PARTITION BY src) AS p FROM c"""
)
def markov_chain(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    return models.transitions(e, F.col("s.event_type"))


@query(
    f"""WITH p AS (SELECT list_distinct({RAW_SQL.replace("text", "a.text")}) AS s, list_distinct({RAW_SQL.replace("text", "b.text")}) AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
x AS (SELECT s AS source, UNNEST(t) AS target FROM (SELECT UNNEST(s) AS s, t FROM p)),
n AS (SELECT source, target, COUNT(*) AS n FROM x GROUP BY 1, 2),
ns AS (SELECT w AS source, COUNT(*) AS k FROM (SELECT UNNEST(s) AS w FROM p) GROUP BY 1), nt AS (SELECT w AS target, COUNT(*) AS k FROM (SELECT UNNEST(t) AS w FROM p) GROUP BY 1)
SELECT source, target, n, n / ns.k AS p_target, n / nt.k AS p_source FROM n JOIN ns USING (source) JOIN nt USING (target)"""
)
def word_alignment(spark, sf):
    c = _turns(spark, sf).select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return models.cooccurring_words(c.join(nxt, ["conv_id", "turn"]), T.raw_tokens("text"), T.raw_tokens("answer"))


@query(
    """WITH RECURSIVE e AS (SELECT n_nationkey AS s, (n_nationkey * 2) % 25 AS d FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation),
r AS (SELECT n_nationkey AS start, n_nationkey AS node, 0 AS depth FROM nation UNION SELECT start, d, depth + 1 FROM r JOIN e ON e.s = r.node WHERE depth < 12)
SELECT start, node, MIN(depth)::INT AS depth FROM r GROUP BY start, node"""
)
def reachable_nodes(spark, sf):
    n = F.col("n_nationkey")
    nat = table(spark, sf, "nation")
    e = nat.select(n.alias("src"), F.explode(F.array(n * 2 % 25, (n + 5) % 25)).alias("dst"))
    return models.reachable(e, nat.select(n.alias("node")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_orders(spark, sf):
    return selection.top(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 50, ties=("o_orderkey",))


@query("SELECT o_custkey, o_orderkey, o_totalprice, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 3")
def top_orders_by_customer(spark, sf):
    return selection.top_by(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 3, ties=("o_orderkey",))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM orders) WHERE b IS NULL OR o_totalprice >= b")
def queue_block_worse(spark, sf):
    return selection.blocked(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "o_totalprice")


@query("SELECT doc_id, CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.2 THEN 'dev' ELSE 'train' END AS part FROM (SELECT doc_id, ('0x' || SUBSTR(MD5('7:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents)")
def split_relative(spark, sf):
    return selection.split(table(spark, sf, "documents").select("doc_id"), F.col("doc_id"), 0.1, 0.1, seed=7)


@query("SELECT doc_id, CASE WHEN k <= 20 THEN 'test' WHEN k <= 30 THEN 'dev' ELSE 'train' END AS part FROM (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY MD5('7:' || doc_id)) AS k FROM documents)")
def split_absolute(spark, sf):
    return selection.split(table(spark, sf, "documents").select("doc_id"), F.col("doc_id"), 20, 10, seed=7)


@query("SELECT a, b, SUM(ABS(l_quantity - a * b)) AS score FROM lineitem, (SELECT UNNEST([1, 2, 4]) AS a) , (SELECT UNNEST([3, 6, 9]) AS b) WHERE a + b < 12 GROUP BY a, b")
def parameter_search(spark, sf):
    g = selection.grid(spark, {"a": [1, 2, 4], "b": [3, 6, 9]}, F.col("a") + F.col("b") < 12)
    return selection.exhaustive_search(g, table(spark, sf, "lineitem").select("l_quantity"), F.sum(F.abs(F.col("l_quantity") - F.col("a") * F.col("b"))))


TRIE_SQL = f"""WITH s AS (SELECT list_slice(t, 1, LEN(t)) AS t, COUNT(*) AS n FROM (SELECT string_split(p_name, ' ') AS t FROM part) GROUP BY 1),
p AS (SELECT list_slice(t, 1, d) AS p, d, n, d = LEN(t) AS e FROM (SELECT t, n, UNNEST(range(1, LEN(t) + 1)) AS d FROM s)),
k AS (SELECT p, d, SUM(n)::BIGINT AS n, SUM(CASE WHEN e THEN n ELSE 0 END)::BIGINT AS ends FROM p GROUP BY 1, 2)"""


@query(TRIE_SQL + "SELECT array_to_string(p, ' ') AS prefix, d::INT AS depth, n, ends FROM k")
def trie_nodes(spark, sf):
    return selection.trie(table(spark, sf, "part"), F.split("p_name", " ")).select(F.array_join("prefix", " ").alias("prefix"), "depth", "n", "ends")


@query(TRIE_SQL + "SELECT array_to_string(p, ' ') AS prefix, n FROM k WHERE NOT EXISTS (SELECT 1 FROM k c WHERE c.d = k.d + 1 AND list_slice(c.p, 1, k.d) = k.p)")
def trie_leaves(spark, sf):
    return selection.leaves(selection.trie(table(spark, sf, "part"), F.split("p_name", " "))).select(F.array_join("prefix", " ").alias("prefix"), "n")


@query(f"SELECT type, n, ROW_NUMBER() OVER (ORDER BY n DESC, type) AS cls FROM ({FREQ_SQL})")
def class_encoding(spark, sf):
    return selection.vocabulary(_docs(spark, sf).select(F.explode(T.raw_tokens("text")).alias("w")), F.col("w"))


@query(
    f"""WITH w AS (SELECT conv_id, turn, UNNEST(t) AS word, UNNEST(range(1, LEN(t) + 1)) AS pos FROM (SELECT conv_id, turn, {RAW_SQL} AS t FROM conversations)),
x AS (SELECT a.conv_id, a.turn, a.word, a.pos, b.pos AS m, ROW_NUMBER() OVER (PARTITION BY a.conv_id, a.turn, a.pos ORDER BY ABS(a.pos - b.pos), b.pos) AS k FROM w a LEFT JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.word = b.word)
SELECT conv_id, turn, word, pos, m AS match FROM x WHERE k = 1"""
)
def nearest_position(spark, sf):
    c = _turns(spark, sf).select("conv_id", "turn", F.posexplode(T.raw_tokens("text")).alias("pos", "word")).withColumn("pos", (F.col("pos") + 1).cast("long"))
    return models.nearest_position(c, c.withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"])


@query("SELECT a::INT AS at, l::INT AS length FROM (SELECT UNNEST(range(12)) AS a), (SELECT UNNEST(range(1, 13)) AS l) WHERE a > 0 AND a + l < 12")
def consecutive_gaps(spark, sf):
    return M.consecutive_gaps(spark, 12)


@query(
    """WITH RECURSIVE s AS (SELECT [p] AS parts, p AS m, 20 - p AS rest FROM (SELECT UNNEST(range(1, 21)) AS p)
  UNION ALL SELECT list_append(parts, p), p, rest - p FROM s, (SELECT UNNEST(range(1, 21)) AS p) WHERE p <= m AND p <= rest AND LEN(parts) < 4)
SELECT array_to_string(parts, '+') AS parts FROM s WHERE rest = 0 AND LEN(parts) = 4"""
)
def number_partitions(spark, sf):
    return M.sum_to_n(spark, 20, 4).select(F.array_join(F.transform("parts", lambda x: x.cast("string")), "+").alias("parts"))


@query(
    LM_SQL
    + f""", h AS (SELECT history, SUM(n) AS nh FROM c GROUP BY 1), u AS (SELECT word, SUM(n) AS k FROM c GROUP BY 1), tt AS (SELECT SUM(n) AS t FROM c),
q AS (SELECT conv_id, turn, {RAW_SQL} AS p FROM conversations), x AS (SELECT conv_id, turn, CASE WHEN i > 1 THEN p[i - 1] END AS history, p[i] AS word FROM (SELECT conv_id, turn, p, UNNEST(range(1, LEN(p) + 1)) AS i FROM q))
SELECT conv_id, turn, ROUND(SUM(CASE WHEN x.history IS NULL THEN LOG10(k / t) ELSE LOG10((n - 0.5) / nh) END), 6) AS log10_prob
FROM x JOIN u USING (word) LEFT JOIN c ON c.history = x.history AND c.word = x.word LEFT JOIN h ON h.history = x.history, tt GROUP BY conv_id, turn"""
)
def backoff_model(spark, sf):
    t = _turns(spark, sf)
    counts = written(models.train_ngrams(t, T.raw_tokens("text"), 2), "bigrams")
    arpa = written(models.arpa_of(counts), "arpa")  # a model is a table: it is joined once a step
    q = models.text_queries(t, T.raw_tokens("text"), ["conv_id", "turn"], order=2)
    return models.backoff_scores(q, arpa, 2).groupBy("conv_id", "turn").agg(F.round(F.sum("logprob"), 6).alias("log10_prob"))


@query()
def hidden_states(spark, sf):
    """Most probable states of every user's events; beyond SQL, held against a worked example in the tests."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    kinds = {"click": (0.3, 0.2), "view": (0.5, 0.2), "purchase": (0.02, 0.2), "signup": (0.08, 0.2), "error": (0.1, 0.2)}
    emit = {(s, k): v[i] for k, v in kinds.items() for i, s in enumerate(("idle", "keen"))}
    trans = {("idle", "idle"): 0.8, ("idle", "keen"): 0.2, ("keen", "idle"): 0.3, ("keen", "keen"): 0.7}
    return models.viterbi(e.select("user_id", F.col("s.event_type").alias("observations")), {"idle": 0.7, "keen": 0.3}, trans, emit, ["user_id"])
