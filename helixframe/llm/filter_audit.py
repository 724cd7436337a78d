"""Filter interaction audit: what each step of every order of some filters removes, and what else would have.

A document counts by its mask, the set of filters that it fails. In an order a mask is removed at the first of its filters.
The orders that share a beginning follow each other lexicographically, so those in which a given filter, after given filters
outside the mask, removes it are one interval of ranks, found from the beginning's Lehmer code. Counts are added where such
an interval begins and taken off where it ends; the running sum over all ranks gives every order's totals at once.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import bounded, materialise, sliced

FILTERS = "ABCDE"
#: A: fewest words. B: least percentage of distinct words. C: largest percentage of capital letters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = re.compile(rb"[#$%&*|]")
_CAPITALS, _INNER_BYTES = bytes(range(65, 91)), bytes(range(0x80, 0xC0))

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
_ARROW = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in COUNTS)])


def rank(beginning: list[int], k: int) -> tuple[int, int]:
    """The interval of lexicographic ranks of the orders of 0 to k - 1 that begin so, by the beginning's Lehmer code."""
    low = 0
    for i, f in enumerate(beginning):
        smaller = f - sum(g < f for g in beginning[:i])
        low += smaller * math.factorial(k - 1 - i)
    return low, low + math.factorial(k - len(beginning))


@functools.lru_cache(maxsize=4)
def intervals(k: int) -> np.ndarray:
    """Rows (mask, step, low, high): the ranks of the orders of k filters in which that step, from 0, removes the mask."""
    rows = []
    for mask in range(1, 2**k):
        inside = [f for f in range(k) if mask >> f & 1]
        outside = [f for f in range(k) if not mask >> f & 1]
        for step in range(len(outside) + 1):
            spans = sorted(rank([*before, f], k) for before in itertools.permutations(outside, step) for f in inside)
            for low, high in spans:
                if rows and rows[-1][:2] == [mask, step] and rows[-1][3] == low:
                    rows[-1][3] = high
                else:
                    rows.append([mask, step, low, high])
    return np.array(rows)


@functools.lru_cache(maxsize=4)
def orders(k: int) -> np.ndarray:
    """All orders of 0 to k - 1, by rank."""
    return np.array(list(itertools.permutations(range(k))))


def totals(counts: np.ndarray, k: int) -> np.ndarray:
    """(rank, step, COUNTS) from (mask, 3) numbers of documents, good and toxic ones."""
    mask, step, low, high = intervals(k).T
    change = np.zeros((k, math.factorial(k) + 1, 3), np.int64)
    np.add.at(change, (step, low), counts[mask])
    np.subtract.at(change, (step, high), counts[mask])
    lost = change.cumsum(axis=1)[:, :-1].transpose(1, 0, 2)
    removed, order = lost[:, :, 0], orders(k)
    fails = np.array([counts[[m for m in range(2**k) if m >> f & 1], 0].sum() for f in range(k)])
    shapley = np.bincount(order.ravel(), removed.ravel(), k) if counts.sum() < 2**40 else np.array([removed[order == f].sum() for f in range(k)])
    alone = counts[2 ** np.arange(k), 0]
    kept = counts[:, 0].sum() - removed.cumsum(axis=1)
    return np.stack([kept, removed, fails[order] - removed, alone[order], lost[:, :, 1], lost[:, :, 2], shapley.astype(np.int64)[order]], axis=2)


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """SCHEMA of rows (part, mask, good, toxic): one row for every part, order and step, zeros included.

    mask: the bits, from the lowest, of the filters that the row fails. A null part is the empty string; null masks and
    flags count as 0. Rows are counted by part and mask before they are shuffled, and a task holds one part's counts, one
    for each mask. Without rows there are no parts and no rows.
    """
    k = len(filters)
    names = ["".join(filters[f] for f in order) for order in orders(k)]

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, rows in zip(b.column("part").to_pylist(), b.column("rows").to_pylist(), strict=True):
                counts = np.zeros((2**k, 3), np.int64)
                for r in rows:
                    counts[r["mask"]] = r["n"], r["good"], r["toxic"]
                found = totals(counts, k).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(found), pa.string()), pa.array([n for n in names for _ in range(k)]), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(names))), *(pa.array(c) for c in found.T)],
                    schema=_ARROW,
                )

    flag = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).alias(c)
    counted = masks.groupBy(F.coalesce("part", F.lit("")).alias("part"), F.coalesce("mask", F.lit(0)).alias("mask")).agg(F.count("*").alias("n"), flag("good"), flag("toxic"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows")).mapInArrow(function, SCHEMA)


def text_mask(text: bytes) -> int:
    """The bits of the filters A to D that a text fails."""
    words = text.split()  # at ASCII white space
    few = len(words) < LEAST_WORDS
    same = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INNER_BYTES))
    return few | same << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | (SYMBOLS.search(text) is not None) << 3


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every row of documents (doc_id, source, text); labels: doc_id, quality, toxic.

    A null text is empty, so copies of it count as identical to it. A row without a doc_id has no smaller one before it and
    none after it, repeated rows of a doc_id don't come before each other, and a doc_id with several labels has each that
    one of them gives. Texts stay in the task that reads them: a digest of 16 bytes tells copies apart, and only the least
    doc_id of texts that occur again is joined, by a broadcast where it is small.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            digests = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(map(text_mask, texts), pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    rows = materialise(docs.select("doc_id", "source", "text").mapInArrow(function, f"doc_id {kind}, part string, mask int, digest binary"))
    again = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("digest", "least")
    rows = rows.join(bounded(materialise(again)), "digest", "left")
    rows = rows.withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0))
    given = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return rows.join(bounded(materialise(given)), "doc_id", "left").select("part", "mask", "good", "toxic")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five filters over whole documents, by source.

    Null sources are the part of the empty string; very long texts are measured whole, one at a time; other columns of
    either table don't matter; empty documents give no rows, and without labels nothing good or toxic is lost. See
    ``document_masks`` for nulls, ties and repeated rows.
    """
    return audit(document_masks(docs, labels))


_WORD = r"[^\x20\x09-\x0D]+"
#: The same rows by trying every order on every mask.
ORACLE_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM docs GROUP BY t),
measured AS (SELECT part, doc_id, t, least, regexp_extract_all(t, '{_WORD}') AS w FROM docs JOIN firsts USING (t)),
given AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, [len(w) < {LEAST_WORDS}, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t),
                regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic
  FROM measured LEFT JOIN given USING (doc_id)),
masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
tried AS (SELECT *, list_filter([1, 2, 3, 4, 5], lambda i: fails[strpos('ABCDE', o[i])])[1] AS gone FROM masks, orders),
steps AS (SELECT *, fails[strpos('ABCDE', o[step])] AS bad, len(list_filter(fails, lambda f: f)) AS m FROM tried, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
summed AS (
  SELECT part, o AS filter_order, step, o[step] AS letter,
         coalesce(sum(n) FILTER (gone IS NULL OR gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (bad AND gone < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad AND m = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM summed"""
