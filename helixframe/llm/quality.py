"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, numbers as 0, runs of white space as one blank) and hashed, and the distinct documents of
a host (``source``) that hold a line are counted over all documents; rows of one text are one document. A line that more
than ``LIMIT`` of them hold is removed, whatever the host's size. A document that keeps fewer than ``MIN_WORDS`` words, or
less than ``MIN_LEFT`` of its words, is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import bounded, free_names, in_chunks, materialise, records, utf8

MIN_WORDS = 10
#: In percent of the words.
MOST_REPEATED = 20
WINDOW = 5
#: Distinct documents of a host that may hold a line.
LIMIT = 20
MIN_LEFT = 0.3

SPACES = " \t\n\r\x0b\x0c"
_RUN = re.compile(rf"[{SPACES}]+")
_DIGIT = re.compile("[0-9]+")


def repeated_words(words: list, size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more, its first place included."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first, hit = {}, set()
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit.update((i, j))
    return len({k for i in hit for k in range(i, i + size)})


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; words are runs without ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, "#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def normalised(line: str) -> str:
    return _DIGIT.sub("0", _RUN.sub(" ", line).strip(" ").lower())


def line_hash(line: str) -> int | None:
    """The hash of a normalised line; None if it has no word."""
    line = normalised(line)
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63) if line else None


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's measures, and for each of its lines the hash, null without a word, and the number of words."""
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("key", pa.binary()), *((n, pa.int64()) for n in NAMES), ("lines", pa.list_(pa.int64())), ("words", pa.list_(pa.int32()))])

    def rows():
        for doc_id, host, key, text in records(batches, "doc_id", "host", "key", "text"):
            lines = text.split("\n")
            yield doc_id, host, key, *measures(text), [line_hash(x) for x in lines], [len(x.encode("utf-8", "surrogatepass").split()) for x in lines]

    yield from in_chunks(rows(), schema, 1024)


def _host() -> Column:
    return utf8(F.col("source").cast("string"))


def _key() -> Column:
    """16 bytes that tell texts of a host apart."""
    return F.unhex(F.md5(F.concat(_host(), F.lit("\0"), utf8(F.col("text")))))


def _measured(docs: DataFrame) -> DataFrame:
    kinds = ", ".join(f"{n} long" for n in NAMES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _host().alias("host"), _key().alias("key"), utf8(F.col("text")).alias("text"))
    measured = rows.mapInArrow(_measure, f"doc_id long, host string, key binary, {kinds}, lines array<long>, words array<int>")
    return materialise(measured.withColumn("row", F.monotonically_increasing_id()))


def frequent_lines(measured: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(host, line) of the lines in more than ``limit`` distinct documents of a host."""
    texts = measured.groupBy("key").agg(F.any_value("host").alias("host"), F.any_value("lines").alias("lines"))
    lines = texts.select("host", F.explode(F.array_distinct("lines")).alias("line")).filter("line is not null")
    return lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("host", "line")


def assess(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The measures of each row, its lines, the frequent ones among them (``gone``), n_left_words, base_failed and kept."""
    measured = _measured(docs)
    frequent = materialise(frequent_lines(measured, limit))
    lines = measured.select("row", "host", F.explode(F.arrays_zip("lines", "words")).alias("x")).select("row", "host", F.col("x.lines").alias("line"), F.col("x.words").alias("words"))
    lost = lines.join(bounded(frequent), ["host", "line"]).groupBy("row").agg(F.sum("words").alias("lost"), F.collect_set("line").alias("gone"))
    out = measured.drop("words").join(lost, "row", "left").withColumn("n_left_words", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = (F.col("n_left_words") >= MIN_WORDS) & (F.col("n_left_words") >= MIN_LEFT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & left)


def quality_rules(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, the five measures, base_failed, kept, n_left_words.

    Defined cases: a null or empty text has no word and fails. A null source is one host, the same as the empty name.
    Repeated rows and doc_ids give a row each; rows of one text are one document in the counts. A line that a text repeats
    counts once for it, and all its words are lost if it is removed. A very long text is measured whole. An empty table
    gives an empty result. Columns other than doc_id, source and text are not read.
    """
    return assess(docs, limit).select("doc_id", *NAMES, "base_failed", "kept", "n_left_words")


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, stays): for each line of a text whether it stays; null for a text that is rejected."""
    schema = pa.schema([("key", pa.binary()), ("stays", pa.list_(pa.bool_()))])

    def rows():
        for key, kept, lines, gone in records(batches, "key", "kept", "lines", "gone"):
            gone = frozenset(gone or ())
            yield key, [x not in gone for x in lines] if kept else None

    yield from in_chunks(rows(), schema, 1024)


def filter_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The documents that are kept, with all their columns; ``text`` without its frequent lines, ``n_chars`` to match.

    A verdict belongs to a host and text: those that reject or change a text are joined by a digest of both, and no text
    is parsed again.

    Defined cases: null and empty texts are rejected, as they have no word. A null source is one host, the same as the
    empty name. Repeated rows stay as often as they come. A very long text is treated whole. Columns of any name and type
    are handed on; an empty table gives an empty result.
    """
    verdicts = assess(docs, limit).filter(~F.col("kept") | F.col("gone").isNotNull()).select("key", "kept", "lines", "gone")
    once = verdicts.groupBy("key").agg(F.any_value(F.struct("kept", "lines", "gone")).alias("x")).select("key", "x.*")
    key, stays, rejected = free_names(docs, "key", "stays", "rejected")
    masks = materialise(once.mapInArrow(_masks, "key binary, stays array<boolean>"))
    masks = bounded(masks).select(F.col("key").alias(key), F.col("stays").alias(stays), F.col("stays").isNull().alias(rejected))
    out = docs.withColumn(key, _key()).join(masks, key, "left").filter(~F.coalesce(F.col(rejected), F.lit(False)))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: F.get(stays, i)), "\n")
    out = out.withColumn("text", F.when(F.col(stays).isNotNull(), left).otherwise(F.col("text"))).select(*(F.col(f"`{n}`") for n in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
