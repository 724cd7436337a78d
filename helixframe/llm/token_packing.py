"""Best-fit-decreasing packing into token-id matrices.

Documents longer than a sequence are split without loss. Each partition takes blocks of ``BLOCK_TOKENS`` ids, places the
pieces of a block longest first, each into the sequence with the least room that holds it, and finds that sequence by a
segment tree over the room left. Sequences under ``FULL`` of their length are taken apart again, and their pieces are dealt
to groups of about a block each and packed once more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import in_chunks, materialise, records
from helixframe.llm.tokens import default_vocabulary, document_ids, encoder

LENGTH = 2048
BLOCK_TOKENS = 4_000_000
FULL = 0.97
PAD_ID = 0

SEQUENCES = "sequence_id long, n_tokens int, n_segments int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>"
_SEQUENCES = [("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("input_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))]


class Rooms:
    """A segment tree over 0..length: which amounts of room some bin has left; bins with equal room are a stack."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.any = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        node = room + self.leaves
        while node:
            self.any[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room of ``need`` or more, taken out, with its room."""
        node = need + self.leaves
        while not self.any[node]:
            while node & 1:  # a right child: go up
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # past the right end of this level
                return None
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.any[node] -= 1
            node >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Bins of piece numbers; pieces of equal length keep their order."""
    rooms, bins = Rooms(length), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        room, b = found or (length, len(bins))
        if not found:
            bins.append([])
        bins[b].append(i)
        if room > lengths[i]:
            rooms.put(room - lengths[i], b)
    return bins


def position_ids(cu_seqlens: list[int], length: int) -> np.ndarray:
    """0, 1, 2, ... from each reset; the padding counts on its own."""
    at = np.arange(length, dtype=np.int32)
    ends = [*cu_seqlens, length] if cu_seqlens[-1] < length else cu_seqlens
    return at - np.repeat(np.array(ends[:-1], np.int32), np.diff(ends))


def matrix(rows: list[bytes], length: int, dtype: str) -> np.ndarray:
    """The id matrix of some rows' ``input_ids``."""
    return np.frombuffer(b"".join(rows), dtype).reshape(-1, length)


def _sequence(sequence_id: int, pieces: list[tuple], length: int, dtype: str) -> tuple:
    """pieces: (doc_id, start, ids)"""
    ends = np.cumsum([0] + [len(p[2]) // np.dtype(dtype).itemsize for p in pieces]).tolist()
    body = b"".join(p[2] for p in pieces)
    pad = np.full(length - ends[-1], PAD_ID, dtype).tobytes()
    return sequence_id, ends[-1], len(pieces), body + pad, ends, ends[:-1], [p[0] for p in pieces], [p[1] for p in pieces]


def _first(path: str, length: int, dtype: str, most: int):
    schema = pa.schema([("task", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), *_SEQUENCES])
    width = np.dtype(dtype).itemsize

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        if encoder(path).largest > np.iinfo(dtype).max:
            raise ValueError(f"{dtype} doesn't hold the ids of {path}")

        def packed(pieces):
            nonlocal made
            for b in best_fit_decreasing([len(p[2]) // width for p in pieces], length):
                mine = [pieces[i] for i in b]
                if sum(len(p[2]) for p in mine) >= FULL * length * width:
                    yield (None, None, None, None, *_sequence((task << 32) + made, mine, length, dtype))
                    made += 1
                else:
                    for p in mine:
                        yield task, *p, *[None] * len(_SEQUENCES)

        def rows():
            pieces, held = [], 0
            for doc_id, text in records(batches, "doc_id", "text"):
                ids = np.frombuffer(document_ids(text, path), "<u4").astype(dtype).tobytes()
                for start in range(0, len(ids) // width, length):
                    pieces.append((doc_id, start, ids[width * start : width * (start + length)]))
                held += len(ids) // width
                if held >= most:
                    yield from packed(pieces)
                    pieces, held = [], 0
            yield from packed(pieces)

        yield from in_chunks(rows(), schema, 256)

    return function


def _second(length: int, dtype: str, most: int):
    width = np.dtype(dtype).itemsize

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            group, made, pieces, held = None, 0, [], 0

            def packed():
                nonlocal made
                for b in best_fit_decreasing([len(p[2]) // width for p in pieces], length):
                    yield _sequence((1 << 62) + (group << 36) + made, [pieces[i] for i in b], length, dtype)
                    made += 1

            for g, doc_id, start, ids in records(batches, "grp", "doc_id", "start", "ids"):
                if g != group or held >= most:
                    yield from packed()
                    pieces, held = [], 0
                    if g != group:
                        group, made = g, 0
                pieces.append((doc_id, start, ids))
                held += len(ids) // width
            yield from packed()

        yield from in_chunks(rows(), pa.schema(_SEQUENCES), 256)

    return function


def pack_best_fit(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, dtype: str = "<u2", block: int = BLOCK_TOKENS) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, n_segments, input_ids, cu_seqlens, position_resets, doc_ids, starts.

    ``input_ids`` is one row of the id matrix: ``length`` numbers of ``dtype``, padded with 0. ``cu_seqlens`` holds 0 and
    the end of each segment, ``position_resets`` the offsets at which positions start again from 0; ``doc_ids`` and
    ``starts`` say which ids of which document a segment has. Every id of every document is in exactly one segment.

    Defined cases: a null or empty text has the end id alone. Null and repeated doc_ids and repeated rows are packed as
    rows of their own. An empty table gives an empty result. Columns other than doc_id and text are not read. A ``dtype``
    that doesn't hold the vocabulary's ids raises.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = materialise(docs.mapInArrow(_first(vocabulary or default_vocabulary(), length, dtype, block), f"task long, doc_id long, start long, ids binary, {SEQUENCES}"))
    left = first.filter("sequence_id is null")
    held = left.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    groups = max(1, math.ceil(held / np.dtype(dtype).itemsize / block))
    left = left.withColumn("grp", F.pmod(F.xxhash64("task", "doc_id", "start", F.crc32("ids")), F.lit(groups))).select("grp", "doc_id", "start", "ids")
    left = left.repartition("grp").sortWithinPartitions("grp", "doc_id", "start", "ids")
    whole = first.filter("sequence_id is not null").drop("task", "doc_id", "start", "ids")
    return whole.unionByName(left.mapInArrow(_second(length, dtype, block), SEQUENCES))


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write the packed rows as Parquet; ``matrix`` turns a file's ``input_ids`` column into the id matrix."""
    packed.write.mode("overwrite").option("maxRecordsPerFile", 65_536).parquet(path)
