"""Odd inputs for every operator: clashing names, other id types, empty tables, repeats, long texts."""

import random

import pytest
from pyspark.sql import functions as F

from noetica.llm import bpe, langid, licenses, mixing, quality, simhash, suffix_dedup, token_files, topk, warc
from tests.llm.test_operators import EDGE, documents, sentence

RND = random.Random(12)
SHARED = sentence(30)
TEXTS = [sentence(60) + "\n" + SHARED + "\n" + sentence(20) for _ in range(12)] + EDGE + [None, "", sentence(60)]
#: Names that operators use while at work, or once did.
NAMES = [
    "_id", "_spans", "_left", "_count", "_copy", "_key", "_source", "_mass", "_weight", "_rate", "_parts", "_cdf", "_terms", "_logs", "_mean", "id", "row", "copy", "copy_no", "key", "n", "c0", "c1", "c9",
    "fp", "fingerprint", "component_id", "first_id", "root", "node", "kind", "u", "v", "bucket", "gram", "context", "at", "state", "start", "end", "rank", "last", "around", "low", "high",
    "part", "number", "local", "n_tokens", "ids_crc32", "held_out", "lang_pred", "score", "vector", "kept", "n_words", "base_failed", "labels", "spans", "value", "payload", "size", "sha1", "owner", "revisit", "headers", "block", "ask", "query_id", "vec",
]


def with_names(df):
    return df.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(NAMES) if n not in df.columns])


def language(docs):
    return langid.identify(docs, langid.learn(docs))


#: What takes documents and gives a row for each.
BY_ROW = {"op3": simhash.near_duplicates, "op5": language, "op6": suffix_dedup.digests, "op7": bpe.digests, "op8": token_files.round_trip, "op9": quality.verdicts, "op10": licenses.scan}
#: What gives documents back, with all their columns.
THROUGH = {"mix": mixing.mix, "clean": quality.clean, "first_of_each": simhash.first_of_each, "remove": suffix_dedup.remove, "tokenize": bpe.tokenize}


def rows(df, columns=None):
    return sorted(map(str, df.select(*(columns or df.columns)).collect()))


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, TEXTS).cache()


@pytest.mark.parametrize("name", BY_ROW)
def test_names_do_not_matter(docs, name):
    of = BY_ROW[name]
    assert rows(of(with_names(docs))) == rows(of(docs))


@pytest.mark.parametrize("name", THROUGH)
def test_columns_pass_through(docs, name):
    of = THROUGH[name]
    plain, named = of(docs), of(with_names(docs))
    assert rows(named, plain.columns) == rows(plain)
    for i, n in enumerate(c for c in NAMES):
        if n not in docs.columns:
            assert named.where(F.col(f"`{n}`") != f"x{i}").isEmpty(), n


def test_copy_number_gives_way(docs):
    out = mixing.mix(docs.withColumn("copy_no", F.lit("own")), copy_col="copy_no")
    assert out.columns.count("copy_no") == 1 and dict(out.dtypes)["copy_no"] == "bigint"
    assert rows(out) == rows(mixing.mix(docs, copy_col="copy_no"))


@pytest.mark.parametrize("name", [*BY_ROW, *THROUGH])
def test_empty_table(docs, name):
    of = (BY_ROW | THROUGH)[name]
    empty = of(docs.limit(0))
    assert empty.count() == 0 and empty.schema == of(docs).schema


def test_empty_tables_of_others(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert warc.round_trip(pages).count() == 0 and topk.search(vectors, lambda i: i % 50 == 0).count() == 0


@pytest.mark.parametrize("name", ["op3", "op5", "op6", "op7", "op9", "op10", *THROUGH])
def test_string_ids(docs, name):
    """Ids that are texts, no numbers: results as for the numbers that sort alike."""
    of = (BY_ROW | THROUGH)[name]
    named = docs.withColumn("doc_id", F.concat(F.lit("k"), F.lpad(F.col("doc_id").cast("string"), 5, "0")))
    got = of(named)
    if name == "mix":
        assert set(got.columns) == set(docs.columns) and got.count()
        return
    rest = [c for c in got.columns if c not in ("doc_id", "component_id")]
    assert rows(got.withColumn("i", F.substring("doc_id", 2, 9).cast("long")), ["i", *rest]) == rows(of(docs).withColumn("i", F.col("doc_id")), ["i", *rest])


@pytest.mark.parametrize("name", ["op3", "op5", "op7", "op9", "op10"])
def test_repeated_and_null_ids(docs, name):
    """Every row of a table that has each row twice, and some without an id, gets its row."""
    of = BY_ROW[name]
    odd = docs.unionByName(docs).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    got = of(odd)
    assert got.count() == 2 * len(TEXTS) + 3 and got.where("doc_id is null").count() == 3
    if name in ("op7", "op9", "op10"):
        assert rows(got.where("doc_id is not null").distinct()) == rows(of(docs))


def test_repeated_ids_with_other_texts(spark):
    """Two unrelated texts that share an id are told apart; copies without an id are one."""
    a, b = sentence(60), sentence(60)
    docs = spark.createDataFrame([(1, a), (2, b), (2, a), (3, a), (None, b), (None, b)], "doc_id long, text string")
    kept = [tuple(r) for r in simhash.first_of_each(docs).collect()]
    assert sorted(t for _, t in kept) == sorted([a, b]) and {i for i, t in kept if t == b} == {None}
    removed = suffix_dedup.remove(docs).collect()
    assert sum(r.text == a for r in removed) == 1 and sum(r.text == b for r in removed) == 1 and len(removed) == 6


def test_repeated_rows_in_token_files(spark):
    docs = spark.createDataFrame([(5, "b a"), (5, "b a"), (None, "c"), (1, None)], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.round_trip(docs).collect())
    assert [i for _, i, _ in got] == [None, 1, 5, 5] and [n for *_, n in got][1] == 1
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_repeated_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (None, "u", "y"), (None, None, None)], "page_id long, url string, html string")
    got = warc.round_trip(with_names(pages)).collect()
    assert len(got) == 5 and sum(r.record_type == "revisit" and r.refers_to == 2 for r in got) == 2
    vectors = spark.createDataFrame([(50, [1.0]), (50, [1.0]), (51, [0.5]), (None, [9.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.search(with_names(vectors), lambda i: i % 50 == 0).collect()] == [(50, 1, 51, 256 * 128)]


def test_very_long_texts(spark):
    """A megabyte of words, and as many letters and blanks without a break."""
    texts = ["word " * 200_000, "a" * 300_000, " " * 300_000, "ab. " + SHARED]
    docs = documents(spark, texts).repartition(2)
    seven = {r.doc_id: r for r in bpe.digests(docs).collect()}
    eight = {r.doc_id: r for r in token_files.round_trip(docs).collect()}
    nine = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    ten = {r.doc_id: r for r in licenses.scan(docs).collect()}
    six = {r.doc_id: r for r in suffix_dedup.digests(docs).collect()}
    five = {r.doc_id: r for r in language(docs).collect()}
    three = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert nine[0].n_words == ten[0].n_words == 200_000 and nine[0].base_failed and nine[2].n_words == 0
    assert eight[0].n_tokens == 200_001 and eight[2].n_tokens == 1 and seven[1].n_tokens > 1000
    assert six[0].n_removed == 1_000_000 - 5 and six[1].n_removed == 300_000 - 1 and six[3].n_removed == 0
    assert five[2].lang_pred == "und" and five[1].lang_pred == "en" and three[2].fingerprint == "0" * 16


def test_long_stretches_are_not_stored():
    own = bpe.encoder()
    own.encode_batch(["x" * 5000, "-" * 100_000, "short words"])
    assert max(map(len, own.held)) <= bpe.LONGEST
    words = token_files.word_encoder()
    words.encode_batch(["x" * 5000, "short words"])
    assert max(map(len, words.held)) <= token_files.LONGEST


def test_special_tokens_in_all_cases():
    """The library finds its special tokens in raw text only, whatever stands beside them."""
    own = token_files.word_encoder()
    added = ["<|startoftext|>", "<|endoftext|>"]
    texts = [f"{a}{t}{b}" for t in (*added, *map(str.upper, added), *map(str.title, added), "<|EndOfText|>", "<|endoftext|") for a in ("", "a ", "B", "\n") for b in ("", " c", ".", "D")]
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert list(memoryview(ids).cast("I")) == own.tokenizer.encode(text, add_special_tokens=False).ids, text
