"""Tools: freqlist, pmi, split, reflow, tags, query."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import cooccurrence, freq, selection
from weftline.plans import treequery
from weftline.session import ensure_workers, get_session
from weftline.sources import formats
from weftline.sources.annotated import read_annotated


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="tool", required=True)
    for name, extra in {
        "freqlist": [("-n", dict(type=int, default=1)), ("--caseless", dict(action="store_true")), ("--markers", dict(action="store_true"))],
        "pmi": [("--score", dict(default="pmi", choices=["pmi", "npmi", "jaccard", "dice", "adjacency"])), ("--least", dict(type=int, default=0)), ("--discount", dict(action="store_true"))],
        "split": [("--test", dict(type=float, default=0.1)), ("--dev", dict(type=float, default=0.0)), ("--seed", dict(type=int, default=0))],
        "reflow": [],
        "tags": [],
        "query": [("--query", dict(required=True))],
    }.items():
        q = sub.add_parser(name)
        q.add_argument("input")
        q.add_argument("output")
        for flag, kw in extra:
            q.add_argument(flag, **kw)
    a = p.parse_args(argv)
    spark = get_session()
    ensure_workers(spark)
    if a.tool == "query":
        treequery.to_json(treequery.run(read_annotated(spark, a.input), a.query)).write.json(a.output)
        return
    if a.tool == "reflow":
        whole = spark.read.text(a.input, wholetext=True)
        whole.select(F.explode(T.reflow("value")).alias("value")).write.text(a.output)
        return
    lines = formats.numbered_lines(spark, a.input)
    tokens = T.raw_tokens("text")
    if a.tool == "freqlist":
        mark = (T.BEGIN, T.END) if a.markers else (None, None)
        out = freq.freqlist(lines, T.joined_ngrams(tokens, a.n, *mark), case_sensitive=not a.caseless)
        out.orderBy(F.desc("n"), "type").write.csv(a.output, sep="\t")
    elif a.tool == "pmi":
        out = cooccurrence.association(lines, tokens, a.least, a.discount)
        out.select("a", "b", a.score).orderBy(F.asc(a.score) if a.score == "npmi" else F.desc(a.score)).write.csv(a.output, sep="\t")
    elif a.tool == "split":
        selection.split(lines, F.col("line_no"), a.test, a.dev, a.seed).select("part", F.col("text").alias("value")).write.partitionBy("part").text(a.output)
    else:
        t = F.explode(tokens).alias("tag")
        lines.select(t).select("tag", T.cgn_tag("tag").alias("x")).select(F.to_json(F.struct("tag", "x.head", "x.feats")).alias("value")).write.text(a.output)


if __name__ == "__main__":
    main()
