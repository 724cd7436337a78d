import public_tokenizers
import pytest
from pyspark.sql import functions as F

from helixframe.llm import token_counts as C

TEXTS = ["plain words and more words", "  two  blanks\n\n\tlines ", "<|endoftext|> and <|endoftext|>", "naïve 中文 \U0001f642 it's we'll", "a" * 3000, "x y​", "Upper UPPER upper", "é é", "1234567 12.5%", "<|STARTOFTEXT|> <|startoftext|>"]


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text))
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    return lambda text: len(known.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, name):
    rows = [(i, t) for i, t in enumerate([*TEXTS, *TEXTS[:3], "", None])]
    count = library(name)
    out = C.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), public_tokenizers.path(name), limit=10)
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got == {i: (len((t or "").encode()), count(t or ""), count(t or "") > 10) for i, t in rows}


def test_equal_normalised_content_has_one_digest():
    normalised, _ = C.counter(public_tokenizers.path("word_bpe_49k.json"))
    assert normalised("Some  WORDS") == normalised("some words")
    assert normalised("<|STARTOFTEXT|>") != normalised("<|startoftext|>")
    plain, _ = C.counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert plain("Some words") != plain("some words")


def test_only_distinct_misses_are_encoded_and_appended(spark, tmp_path):
    cache, path = f"file://{tmp_path}/cache", public_tokenizers.path("byte_bpe_50k.json")
    stored = lambda: spark.read.option("recursiveFileLookup", "true").parquet(cache).count()
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id long, text string").repartition(6)
    first = C.count_tokens(docs, cache=cache).collect()
    assert len(first) == 50 and stored() == 7
    more = docs.union(spark.createDataFrame([(99, "text new"), (100, "text new")], docs.schema))
    assert len(C.count_tokens(more, cache=cache).collect()) == 52 and stored() == 8
    # what is stored is believed, so hits aren't encoded again; another vocabulary has its own counts
    of = C.version(path)
    known = spark.createDataFrame([(bytearray(C._digest("forged")), 12345)] * 2, C.CACHE)
    known.write.parquet(f"{cache}/version={of}/batch=forged")
    one = spark.createDataFrame([(1, "forged")], "doc_id long, text string")
    assert C.count_tokens(one, cache=cache).collect()[0][1:] == (6, 12345, True)
    assert C.count_tokens(one, public_tokenizers.path("piece_bpe_32k.model"), cache=cache).collect()[0].n_tokens < 10


def test_large_lookups_find_the_same_misses(spark, monkeypatch):
    looked = spark.createDataFrame([(bytearray([i]), None if i % 3 else i) for i in range(9)], C.CACHE)
    texts = spark.createDataFrame([(bytearray([i]), str(i)) for i in range(9)], "digest binary, text string")
    want = [str(i) for i in range(9) if i % 3]
    for size in (C.BROADCAST_BYTES, 150, 0):  # both sides small, the hits alone, none
        monkeypatch.setattr(C, "BROADCAST_BYTES", size)
        assert sorted(r.text for r in C._missing(texts, looked).collect()) == want


def test_messy_and_empty(spark, messy, empty):
    count = library("byte_bpe_50k.json")
    got = sorted(map(tuple, C.count_tokens(messy).collect()), key=str)
    want = [(r.doc_id, len((r.text or "").encode()), count(r.text or ""), count(r.text or "") > C.LIMIT) for r in messy.collect()]
    assert got == sorted(want, key=str)
    out = C.count_tokens(empty)
    assert out.count() == 0 and out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]


def test_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t "), "id")).alias("text"))
    assert C.count_tokens(docs.repartition(8)).filter("n_tokens > 0").count() == 3000


def test_unknown_vocabularies_raise(spark, empty):
    with pytest.raises(ValueError):
        C.count_tokens(empty, "vocabulary.txt")
