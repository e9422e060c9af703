"""Every operator and stage over nulls, empty and very long texts, repeated rows, no rows, and columns whose names clash."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import chunkdedup, decontam, lmscore, minhash, mixing, pii, quality, suffixdedup, tokenbin, warc
from weftline.llm.queries import TOKENIZERS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{i % 97} and{i % 89} some{i % 83} more{i % 79}" for i in range(60))
LONG = " ".join(f"w{i * 7919 % 100003}" for i in range(60_000))
ROWS = [
    (1, PROSE, "en", "a", 10),
    (2, PROSE, "en", "a", 10),
    (2, PROSE, "en", "a", 10),
    (3, "", "en", None, 0),
    (4, None, None, "b", None),
    (None, PROSE, "de", "b", 10),
    (None, None, None, None, None),
    (5, LONG, "fr", "b", len(LONG)),
    (6, "   \n\t", "en", "c", 5),
    (7, "x", "en", "c", 1),
    (7, "y", "de", "c", 1),
    (8, "Ünïcödé ☃ 👍 ' \0 end", "de", "a", 9),
]
MODEL, RANKS = f"{TOKENIZERS}/piece_bpe_32k.model", f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    names = ["copy", "n_private", "symbol", "upper", "stutter", "phrase", "_limit", "_stratum", "_rank", "_gone", "_mix_source", "rate", "h", "k", "band", "score", "item_id", "KEPT_DOC_ID"]
    return docs.select("*", *(F.lit("x").alias(n) for n in names))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (None, 1, 0), (3, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "What is the colour of the sky at noon in summer? Blue with a few clouds."), (None, "x"), (2, None), (3, ""), (4, "one")], "item_id long, text string")


def operators(spark, labels, items):
    return {
        "mix": lambda d: mixing.mix_sources(d, {"a": 3.0}, 1.0),
        "near": minhash.near_duplicates,
        "keep_first": minhash.keep_first,
        "keep_good": lambda d: quality.keep_good(d, labels),
        "lm": lambda d: lmscore.score(d, MODEL),
        "leaks": lambda d: decontam.contaminated(d, items),
        "clean": lambda d: decontam.decontaminated(d, items),
        "passages": suffixdedup.repeated_passages,
        "chunks": chunkdedup.repeated_chunks,
        "tokens": lambda d: tokenbin.token_ids(d, RANKS),
        "pii": lambda d: pii.pseudonyms(d, b"key"),
    }


NAMES = ["mix", "near", "keep_first", "keep_good", "lm", "leaks", "clean", "passages", "chunks", "tokens", "pii"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, labels, items, name):
    assert operators(spark, labels, items)[name](docs.where("false")).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_and_hard_rows(spark, docs, clashing, labels, items, name):
    op = operators(spark, labels, items)[name]
    plain, wide = op(docs).collect(), op(clashing).collect()
    assert len(plain) == len(wide)


def test_defined_results(spark, docs, labels, items):
    ops = operators(spark, labels, items)
    near = {r.doc_id: r.kept_doc_id for r in ops["near"](docs).collect()}
    assert near == {2: 1}
    kept = ops["keep_first"](docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 3, 4, 5, 6, 7, 7, 8]  # the texts of 7 differ: both stay
    assert kept.where("doc_id IS NULL").count() == 2
    assert ops["keep_good"](docs).count() == len(ROWS)  # labels too few for any safe cutoff
    lm = ops["lm"](docs).collect()
    assert len(lm) == len(ROWS)
    assert all(r.log_prob == 0 and r.bits_per_byte is None and r.n_words == 0 for r in lm if r.doc_id in (3, 4, 6))
    assert ops["leaks"](docs).count() == 0 and ops["clean"](docs).count() == len(ROWS)
    tok = ops["tokens"](docs).collect()
    assert len(tok) == len(ROWS)
    assert all(r.n_tokens == 0 and bytes(r.payload) == b"" and r.block_offsets == [] for r in tok if r.doc_id in (3, 4))
    assert {r.doc_id for r in ops["passages"](docs).collect()} == {2}
    assert {r.doc_id for r in ops["chunks"](docs).collect()} == {2}
    assert ops["pii"](docs).agg(F.sum("n_private")).first()[0] == 0


def test_null_source_is_mixed(spark, docs):
    rates = {r.source: r for r in mixing.source_rates(docs, {"a": 3.0}).collect()}
    assert rates[None].tokens == 0 and rates[None].rate == 0.0
    assert set(rates) == {"a", "b", "c", None}


def test_no_items_or_labels(spark, docs, labels, items):
    assert decontam.contaminated(docs, items.where("false")).count() == 0
    assert decontam.decontaminated(docs, items.where("false")).count() == len(ROWS)
    assert quality.keep_good(docs, labels.where("false")).count() == len(ROWS)


def test_warc_edges(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é</p>"), (1, "http://a/", "<p>é</p>"), (2, None, "x"), (3, "http://b/", None), (None, "u", ""), (4, "http://c/\r\nInjected: 1", "z" * 3_000_000)], "page_id long, url string, html string")
    got = warc.pages_by_warc(pages)
    assert all(r.verified for r in got.collect())
    key = lambda rows: sorted(((r.page_id, r.url, r.html) for r in rows), key=str)
    assert key(got.collect()) == key(pages.collect())
    assert warc.pages_by_warc(pages.where("false")).count() == 0
    assert warc.pages_by_warc(pages.select("*", F.lit(1).alias("file"), F.lit(2).alias("digest"))).count() == 6


def test_stages_keep_the_columns(spark, docs, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "What is the colour of the sky at noon in summer? Blue.")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns
        assert stage(spark, docs.where("false"), at).count() == 0
    docs.write.parquet(f"{at}/documents.parquet")
    assert corpus_pipeline.run(spark, at).columns == ["doc_id", "n_tokens", "payload", "block_offsets"]
    assert corpus_pipeline.run(spark, at).count() > 0
