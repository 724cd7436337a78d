"""Token counts of whole texts through a cache of digests.

A text is known by the digest of its normalised content, and a vocabulary by the digest of its file, of the library that
reads it and of that library's version. Counts stored under both are looked up; only distinct texts without one are encoded,
and their counts are appended to the cache. Texts of known digests never leave the task that reads them.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from importlib import metadata
from pathlib import PurePath

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import BROADCAST_BYTES, bounded, materialise, shared_folder, sliced
from helixframe.llm.tokens import Encoder, default_vocabulary

#: Tokens above which a document is over the limit.
LIMIT = 1024
DIGEST_BYTES = 16
CACHE = "digest binary, n_tokens long"


def _library(path: str) -> str:
    kinds = {".json": "tokenizers", ".model": "sentencepiece"}
    kind = PurePath(path).suffix
    if kind not in kinds:
        raise ValueError(f"{path}: a vocabulary is a .json file of tokenizers or a .model file of sentencepiece")
    return kinds[kind]


def version(path: str) -> str:
    """The digest of a vocabulary's bytes, the library for it and that library's version."""
    library = _library(path)
    with open(path, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    return hashlib.sha256(f"{library} {metadata.version(library)} {content}".encode()).hexdigest()[:32]


def _byte_level(model: dict) -> bool:
    """Whether ``tokens.Encoder`` reads this file: plain byte-level BPE whose ids follow its merges."""
    body, before = model.get("model", {}), model.get("pre_tokenizer") or {}
    plain = model.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or body.get("type", "BPE") != "BPE" or body.get("dropout") or body.get("continuing_subword_prefix") or body.get("end_of_word_suffix") or body.get("ignore_merges"):
        return False
    parts = (m.split(" ") if isinstance(m, str) else m for m in body["merges"])
    return all(body["vocab"].get("".join(pair)) == 256 + i for i, pair in enumerate(parts))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> tuple[Callable[[str], str], Callable[[str], int]]:
    """(normalised, counted) of a vocabulary: texts of equal normalised content have equal counts.

    What a vocabulary's own normaliser makes equal is equal, unless the text holds an added token, which the library finds
    before it normalises.
    """
    if _library(path) == "sentencepiece":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda text: text), (lambda text: len(pieces.encode(text, num_threads=1)))
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    if _byte_level(model):
        encoder = Encoder(path)
        return (lambda text: text), (lambda text: len(encoder.ids(text)) // 4)
    import tokenizers

    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    added, normaliser = [t["content"] for t in model.get("added_tokens", [])], library.normalizer

    def normalised(text: str) -> str:
        short = normaliser.normalize_str(text) if normaliser else text
        return f"\0{text}" if any(t in text or t in short for t in added) else short

    return normalised, (lambda text: len(library.encode(text, add_special_tokens=False).ids))


def _digest(content: str) -> bytes:
    return hashlib.blake2b(content.encode("utf-8", "surrogatepass"), digest_size=DIGEST_BYTES).digest()


def stored(spark: SparkSession, cache: str, of: str) -> DataFrame:
    """(digest, n_tokens) that a cache holds for a version; a digest has one row, whoever appended it."""
    try:
        rows = spark.read.schema(CACHE).option("recursiveFileLookup", "true").parquet(f"{cache}/version={of}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _missing(texts: DataFrame, looked: DataFrame) -> DataFrame:
    """The texts whose digest was looked up without finding a count; whichever side is small is sent to them."""
    misses, hits = looked.filter("n_tokens is null").select("digest"), looked.filter("n_tokens is not null").select("digest")
    n, found = looked.agg(F.count("*"), F.count("n_tokens")).first()
    size = DIGEST_BYTES + 24
    if (n - found) * size <= BROADCAST_BYTES or found * size > BROADCAST_BYTES:
        return texts.join(bounded(misses), "digest", "left_semi")
    return texts.join(F.broadcast(hits), "digest", "left_anti")


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, cache: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of documents (doc_id, text).

    vocabulary: a file that is at the same path on every machine. cache: a folder that all executors see; without one a
    new folder of the shared one is taken, so that nothing was met before. A run that fails leaves the cache as it was or
    with its whole batch, and appending a batch twice changes no count.

    A null text is empty and has 0 tokens; a very long one is encoded whole; equal texts are encoded once, wherever they
    lie; rows are kept one for one, also without a doc_id and with a repeated one; an empty table gives no rows; other
    columns don't matter.
    """
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    of, cache = version(path), cache or f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    kind = docs.schema["doc_id"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalised = counter(path)[0]
        for b in sliced(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_digest(normalised(t)) for t in texts], pa.binary()), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())], names=["doc_id", "digest", "n_bytes"])

    def texts_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalised, seen = counter(path)[0], set()
        for b in sliced(batches):
            new = {}
            for t in b.column("text").to_pylist():
                if (d := _digest(normalised(t or ""))) not in seen:
                    new[d] = t or ""
                    seen.add(d)
            if len(seen) > 200_000:  # what is sent again is left out later
                seen.clear()
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array(new.values(), pa.string())], names=["digest", "text"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, seen = counter(path)[1], set()  # all rows of a digest are in this task
        for b in sliced(batches):
            new = {}
            for d, t in zip(b.column("digest").to_pylist(), b.column("text").to_pylist(), strict=True):
                if d not in seen:
                    new[d] = counted(t)
                    seen.add(d)
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array(new.values(), pa.int64())], names=["digest", "n_tokens"])

    text = docs.select("doc_id", "text")
    keys = materialise(text.mapInArrow(keyed, f"doc_id {kind}, digest binary, n_bytes long"))
    looked = materialise(keys.select("digest").distinct().join(stored(spark, cache, of), "digest", "left"))
    missing = _missing(text.select("text").mapInArrow(texts_once, "digest binary, text string"), looked)
    batch = f"{cache}/version={of}/batch={uuid.uuid4().hex}"
    missing.repartition("digest").mapInArrow(encoded, CACHE).write.parquet(batch)
    counts = looked.filter("n_tokens is not null").unionByName(spark.read.schema(CACHE).parquet(batch))
    out = keys.join(bounded(counts), "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
