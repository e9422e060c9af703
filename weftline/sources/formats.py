"""Readers and writers of corpus, alignment, phrase-table and model files, as DataFrames over ``spark.read.text``.

Compressed files (.gz, .bz2) are read as they are.  Formats whose records span
lines are cut by ``lineSep`` or read as whole files; no reader pulls lines to
the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus_files(spark: SparkSession, path: str, glob: str = "*.xml*", only: str | None = None, binary: bool = False) -> DataFrame:
    """Files below a directory (path, content), those of sub-collection ``only`` if given; further conditions are filters on ``path``."""
    at = f"{path.rstrip('/')}/{only}" if only else path
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if binary:
        return reader.format("binaryFile").load(at).select("path", "content")
    return reader.text(at, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")


def read_giza(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file, idx, score, source, target, links) of A3 files: three lines a record, links (s, t) counted from 0; those of NULL are left out.

    The first word of a record's last line is NULL; ``source`` is that line's
    words, ``target`` those of the line before, as the places in ``({ })`` count.
    """
    recs = _whole(spark, path).select("file", _lines(F.col("text")).alias("l"))
    n = F.floor((F.size("l")) / 3).cast("int")
    one = F.explode(F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("l", i * 3).alias("head"), F.get("l", i * 3 + 1).alias("target"), F.get("l", i * 3 + 2).alias("aligned")))))
    r = recs.select("file", one.alias("r")).select("file", "r.*")
    pair = F.regexp_extract_all("aligned", F.lit(r"(\S+) \(\{([\d ]*)\}\)"), F.lit(1))
    nums = F.regexp_extract_all("aligned", F.lit(r"(\S+) \(\{([\d ]*)\}\)"), F.lit(2))
    r = r.withColumn("words", pair).withColumn("places", nums)
    links = F.flatten(
        F.transform(
            F.slice("places", F.lit(2), F.size("places")),
            lambda p, i: F.transform(F.filter(F.split(F.trim(p), " "), lambda x: x != ""), lambda x: F.struct(i.alias("s"), (x.cast("int") - 1).alias("t"))),
        )
    )
    return r.select(
        "file",
        F.regexp_extract("head", r"\((\d+)\)", 1).try_cast("int").alias("idx"),
        F.regexp_extract("head", r"alignment score : (\S+)", 1).try_cast("double").alias("score"),
        F.filter(F.slice("words", F.lit(2), F.size("words")), lambda w: w != "").alias("source"),
        F.filter(F.split("target", r"\s+"), lambda w: w != "").alias("target"),
        links.alias("links"),
    )


def links_of(giza: DataFrame) -> DataFrame:
    """Rows (file, idx, s, t), one a link."""
    return giza.select("file", "idx", F.explode("links").alias("l")).select("file", "idx", "l.s", "l.t")


def read_phrase_table(
    spark: SparkSession, path: str | list[str], delimiter: str = r"\|\|\|", quoted: bool = False, reverse: bool = False, score_column: int = 3, max_words: int = 0, score_filter: Column | None = None
) -> DataFrame:
    """Rows (source, target, scores) of a phrase table, ``reverse`` swapping the two; filters on length and scores run with the scan."""
    parts = F.split(F.col("value"), rf"\s*{delimiter}\s*")
    a, b = (F.get(parts, 1), F.get(parts, 0)) if reverse else (F.get(parts, 0), F.get(parts, 1))
    if quoted:
        a, b = (F.regexp_replace(x, '^"|"$', "") for x in (a, b))
    scores = F.transform(F.filter(F.split(F.trim(F.get(parts, score_column - 1)), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    out = spark.read.text(path).where(F.col("value") != "").select(F.trim(a).alias("source"), F.trim(b).alias("target"), scores.alias("scores"))
    if max_words:
        out = out.where((F.size(F.split("source", " ")) <= max_words) & (F.size(F.split("target", " ")) <= max_words))
    return out if score_filter is None else out.where(score_filter)


def phrase_options(table: DataFrame) -> DataFrame:
    """Rows (source, options): all targets of a source wherever they stand in the file."""
    return table.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("target", "scores"))).alias("options"))


def read_arpa(spark: SparkSession, path: str | list[str], base_e: bool = False) -> DataFrame:
    """Rows (ngram, n, logprob, backoff) of ARPA files: the entry's words tell its order, so lines need no state.

    Probabilities are logs to base 10, natural ones with ``base_e``.
    """
    f = F.split(F.trim("value"), r"\t")
    lines = spark.read.text(path).where(F.col("value").rlike(r"^-?[\d.]+(?:[eE][-+]?\d+)?\t"))
    k = 2.302585092994046 if base_e else 1.0
    ngram = F.filter(F.split(F.get(f, 1), " "), lambda w: w != "")
    return lines.select(ngram.alias("ngram"), F.size(ngram).alias("n"), (F.get(f, 0).cast("double") * k).alias("logprob"), (F.get(f, 2).try_cast("double") * k).alias("backoff"))


def write_arpa(model: DataFrame, path: str) -> None:
    """An ARPA file's sections by rising n; a global sort by (n, n-gram) in ranges, a folder of parts."""
    counts = {r.n: r.k for r in model.groupBy("n").agg(F.count("*").alias("k")).collect()}
    spark = model.sparkSession
    line = F.concat_ws("\t", F.format_string("%.6f", "logprob"), F.array_join("ngram", " "), F.format_string("%.6f", "backoff"))
    body = model.select("n", F.lit(1).alias("k"), line.alias("value"))
    heads = [(0, 0, "\\data\\\n" + "\n".join(f"ngram {n}={k}" for n, k in sorted(counts.items())) + "\n")]
    heads += [(n, 0, f"\\{n}-grams:") for n in counts] + [(n, 2, "") for n in counts] + [(max(counts, default=0) + 1, 3, "\\end\\")]
    body.unionByName(spark.createDataFrame(heads, "n int, k int, value string")).orderBy("n", "k", "value").select("value").write.text(path)


def read_simple_lm(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (level, ngram, n) of a simple model's sections: lines of an n-gram, a tab and a count; the level is the n-gram's length."""
    f = F.split("value", "\t")
    grams = F.split(F.get(f, 0), " ")
    return spark.read.text(path).where(F.col("value").rlike(r"^[^\t]+\t\d+(?:\t|$)")).select(F.size(grams).alias("level"), grams.alias("ngram"), F.get(f, 1).cast("long").alias("n"))


def write_simple_lm(grams: DataFrame, path: str) -> None:
    grams.select(F.concat_ws("\t", F.array_join("ngram", " "), F.col("n").cast("string")).alias("value")).write.text(path)


def read_classified(spark: SparkSession, path: str | list[str], delimiter: str = " ", ignore_columns: tuple[int, ...] = (), ignore_values: tuple[str, ...] = ()) -> DataFrame:
    """Rows (features, ref, pred, dist, distance) of a classifier's output; lines that begin with # are comments.

    A line has features, the class, the class predicted, and maybe a
    distribution in braces, normalised here, and a distance.  Columns are
    ignored by their place from 1.
    """
    v = F.trim("value")
    inside = F.regexp_extract(v, r"\{([^}]*)\}", 1)
    items = F.filter(F.split(inside, ","), lambda x: F.trim(x) != "")
    weights = F.transform(items, lambda x: F.struct(F.regexp_extract(F.trim(x), r"^(.*)\s+\S+$", 1).alias("k"), F.regexp_extract(F.trim(x), r"(\S+)$", 1).cast("double").alias("w")))
    tail = F.regexp_extract(v, r"\}\s*([-\d.eE+]+)\s*$", 1).try_cast("double")
    cells = F.filter(F.split(F.trim(F.regexp_replace(v, r"\s*\{.*$", "")), delimiter.replace(" ", r"\s+") if delimiter == " " else delimiter), lambda x: x != "")
    out = spark.read.text(path).where((v != "") & ~v.startswith("#")).select(cells.alias("c"), weights.alias("w"), tail.alias("distance"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x["w"])
    feats = F.slice("c", F.lit(1), F.size("c") - 2)
    if ignore_columns:
        feats = F.filter(feats, lambda x, i: ~(i + 1).isin(*ignore_columns))
    if ignore_values:
        feats = F.filter(feats, lambda x: ~x.isin(*ignore_values))
    dist = F.when(F.size("w") > 0, F.map_from_entries(F.transform("w", lambda x: F.struct(x["k"], F.try_divide(x["w"], total)))))
    return out.where("size(c) >= 2").select(feats.alias("features"), F.element_at("c", -2).alias("ref"), F.element_at("c", -1).alias("pred"), dist.alias("dist"), "distance")


def read_tagged(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file, sent, pos, word, lemma, postag) of tagger data: a token a line, sentences apart by a blank line or #N; NONE is null."""
    blocks = _whole(spark, path).select("file", F.posexplode(F.filter(F.split(F.regexp_replace("text", r"\r\n?", "\n"), r"\n(?:#\d*)?[ \t]*\n|(?:^|\n)#\d+\n"), lambda b: F.trim(b) != "")).alias("sent", "b"))
    toks = blocks.select("file", "sent", F.posexplode(F.filter(F.split("b", "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^#\d*$"))).alias("pos", "line"))
    f = F.split("line", "\t")
    none = lambda c: F.when((c != "NONE") & (c != ""), c)
    return toks.select("file", "sent", "pos", F.get(f, 0).alias("word"), none(F.get(f, 1)).alias("lemma"), none(F.get(f, 2)).alias("postag"))


def write_tagged(tokens: DataFrame, path: str) -> None:
    """One row of text a sentence, its tokens a line each and a blank line after."""
    line = F.concat_ws("\t", "word", F.coalesce("lemma", F.lit("NONE")), F.coalesce("postag", F.lit("NONE")))
    s = tokens.groupBy("file", "sent").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("t"))
    s.select(F.concat(F.array_join(F.col("t.line"), "\n"), F.lit("\n")).alias("value")).write.text(path)


def read_senses(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (word_id, senses, distance) of sense tagging: pairs of a sense and its confidence, then maybe a distance; ? is unknown (null), +vdi is dropped."""
    f = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    rest = F.slice(f, F.lit(2), F.size(f))
    odd = F.size(rest) % 2 == 1
    num = lambda x: F.when(x != "?", x.try_cast("double"))
    pairs = F.transform(F.when(F.size(rest) >= 2, F.sequence(F.lit(0), F.floor(F.size(rest) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.regexp_replace(F.get(rest, i * 2), r"^\+vdi", "").alias("sense"), num(F.get(rest, i * 2 + 1)).alias("confidence")))
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(f, 0).alias("word_id"), F.transform(pairs, lambda p: F.struct(F.when(p["sense"] != "?", p["sense"]).alias("sense"), p["confidence"].alias("confidence"))).alias("senses"), F.when(odd, num(F.element_at(rest, -1))).alias("distance"))


def write_senses(df: DataFrame, path: str) -> None:
    num = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    pairs = F.array_join(F.transform("senses", lambda p: F.concat_ws(" ", F.coalesce(p["sense"], F.lit("?")), num(p["confidence"]))), " ")
    df.select(F.concat_ws(" ", "word_id", pairs, F.col("distance").cast("string")).alias("value")).write.text(path)


def read_sense_data(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (word_id, sense, lemma, pos) of a tab-separated dataset."""
    return spark.read.csv(path, sep="\t", schema="word_id string, sense string, lemma string, pos string", quote="")


def read_lexicon(spark: SparkSession, path: str | list[str], columns: str = "word string, lemma string, postag string") -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=columns, quote="")


def tag_by_lexicon(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``tokens`` with lemma and postag of the lexicon's entry for the word, else for it in lower case; null if there is none."""
    lex = lexicon.groupBy(F.col("word").alias("_w")).agg(F.min(F.struct("lemma", "postag")).alias("_e"))
    low = lex.select(F.col("_w").alias("_v"), F.col("_e").alias("_f"))
    out = tokens.join(lex, tokens.word == F.col("_w"), "left").join(low, F.lower(tokens.word) == F.col("_v"), "left")
    e = F.coalesce("_e", "_f")
    return out.select(*tokens.columns, e["lemma"].alias("lemma"), e["postag"].alias("postag"))


def scan_words(files: DataFrame, tag: str = "w") -> DataFrame:
    """Rows (path, word_id, word, lemma, pos) of XML whose words are elements on a line each, found by regular expressions alone."""
    whole = rf"<{tag}\s[^>]*>[^<]*</{tag}>"
    w = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(whole), F.lit(0))).alias("x"))
    attr = lambda a: F.nullif(F.regexp_extract("x", rf'\s{a}="([^"]*)"', 1), F.lit(""))
    return w.select("path", F.coalesce(attr("xml:id"), attr("id")).alias("word_id"), F.regexp_extract("x", r">([^<]*)<", 1).alias("word"), attr("lemma").alias("lemma"), attr("pos").alias("pos"))


def grouped_words(words: DataFrame, unit: str = "s") -> DataFrame:
    """Rows (path, unit_id, words) by the part of a word's id up to its sentence (``s``) or paragraph (``p``)."""
    key = F.regexp_extract("word_id", rf"^(.*\.{unit}\.\d+)", 1)
    place = F.regexp_extract("word_id", r"(\d+)$", 1).try_cast("int")
    sent = F.regexp_extract("word_id", r"\.s\.(\d+)", 1).try_cast("int")
    return words.groupBy("path", key.alias("unit_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(sent.alias("s"), place.alias("k"), "word"))), lambda x: x["word"]).alias("words"))


def xpath_all(files: DataFrame, expression: str, content: str = "content") -> DataFrame:
    """Rows (path, value) of an XPath expression over many files; prefixes and namespaces are dropped first."""
    x = F.col(content).cast("string")
    for pattern, by in ((r"\sxmlns(?::[\w-]+)?=(?:\"[^\"]*\"|'[^']*')", ""), (r"(</?)[\w-]+:(?=\w)", "$1"), (r"(\s)(?!xml:)[\w-]+:(?=[\w-]+=[\"'])", "$1"), (r"<\?xml[^>]*\?>", "")):
        x = F.regexp_replace(x, pattern, by)
    return files.select("path", F.explode(F.xpath(x, F.lit(expression))).alias("value"))


def parallel(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (line_no, a, b) of two aligned tables (line_no, text)."""
    return a.select("line_no", F.col("text").alias("a")).join(b.select("line_no", F.col("text").alias("b")), "line_no")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file, line_no, text); a file is numbered in its own row, so files number in parallel."""
    return _whole(spark, path).select("file", F.posexplode(_lines(F.regexp_replace("text", r"\r?\n$", ""))).alias("line_no", "text"))
