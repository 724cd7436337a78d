"""Bounded-space online packing.

Each partition keeps ``OPEN`` windows; a piece goes to the open window with the least room that holds it, and when none
does the fullest window is emitted and a new one opened. What is still open at the end of the partitions is merged: its
pieces are dealt to groups of about ``GROUP_TOKENS`` and packed again by the same rule, longest first.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import in_chunks, materialise, records
from helixframe.llm.tokens import default_vocabulary, document_ids

LENGTH = 2048
OPEN = 64
#: Tokens of leftovers that are merged together, and the windows that stay open meanwhile.
GROUP_TOKENS, MERGE_OPEN = 500_000, 1024
FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Windows:
    """Open windows by the room they have left, with their pieces; pieces' third item is the length."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.made, self.by_room, self.pieces = length, most, 0, [], {}

    def add(self, piece: tuple) -> Iterator[tuple[int, list[tuple]]]:
        """Place a piece; yields (window number, pieces) of windows that this closes."""
        need = piece[2]
        i = bisect_left(self.by_room, (need, -1))
        if i < len(self.by_room):
            room, window = self.by_room.pop(i)
        else:
            if len(self.by_room) >= self.most:
                _, fullest = self.by_room.pop(0)
                yield fullest, self.pieces.pop(fullest)
            room, window = self.length, self.made
            self.made += 1
            self.pieces[window] = []
        self.pieces[window].append(piece)
        if room > need:
            insort(self.by_room, (room - need, window))
        else:
            yield window, self.pieces.pop(window)

    def left(self) -> Iterator[tuple[int, list[tuple]]]:
        yield from sorted(self.pieces.items())


def _rows(task: int, window: int, pieces: list[tuple], is_open: bool) -> Iterator[tuple]:
    offset = 0
    for p in pieces:
        yield *p, task, (task << 32) + window, offset, is_open
        offset += p[2]


def _pack(path: str, length: int, most: int, with_ids: bool):
    schema = pa.schema(FIELDS + [("ids", pa.list_(pa.int32()))] * with_ids + [("task", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("is_open", pa.bool_())])

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, windows = TaskContext.get().partitionId(), Windows(length, most)

        def rows():
            for doc_id, text in records(batches, "doc_id", "text"):
                ids = document_ids(text, path)
                n = len(ids) // 4
                for start in range(0, n, length):
                    part = ids[4 * start : 4 * (start + length)]
                    piece = (doc_id, start, len(part) // 4, zlib.crc32(part), n)
                    for closed in windows.add((*piece, np.frombuffer(part, "<i4")) if with_ids else piece):
                        yield from _rows(task, *closed, False)
            for window, pieces in windows.left():
                yield from _rows(task, window, pieces, True)

        yield from in_chunks(rows(), schema, 512 if with_ids else 8192)

    return function


def _merge(length: int, most: int, with_ids: bool):
    names = [f[0] for f in FIELDS] + ["ids"] * with_ids
    schema = pa.schema(FIELDS + [("ids", pa.list_(pa.int32()))] * with_ids + [("sequence_id", pa.int64()), ("offset", pa.int64())])

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def placed(group: int, window: int, pieces: list[tuple]) -> Iterator[tuple]:
            offset = 0
            for p in pieces:
                yield *p, (1 << 62) + (group << 32) + window, offset
                offset += p[2]

        def rows():
            group, windows = None, Windows(length, most)
            for g, *piece in records(batches, "grp", *names):
                if g != group:
                    for closed in windows.left():
                        yield from placed(group, *closed)
                    group, windows = g, Windows(length, most)
                for closed in windows.add(tuple(piece)):
                    yield from placed(group, *closed)
            for closed in windows.left():
                yield from placed(group, *closed)

        yield from in_chunks(rows(), schema, 512 if with_ids else 8192)

    return function


def pack_online(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, most: int = OPEN, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, [ids array<int>,] sequence_id, offset.

    A document's ids (with the end id) are cut every ``length`` ids; a sequence is the concatenation of its pieces by
    offset, to be padded to ``length``. ``ids_crc32`` is the unsigned CRC-32 of the little-endian unsigned 32-bit ids.

    Defined cases: a null or empty text has the end id alone. Null and repeated doc_ids and repeated rows are packed as
    rows of their own. An empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    path = vocabulary or default_vocabulary()
    extra = ", ids array<int>" * with_ids
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = materialise(docs.mapInArrow(_pack(path, length, most, with_ids), f"{COLUMNS}{extra}, task long, sequence_id long, offset long, is_open boolean"))
    left = placed.filter("is_open")
    groups = max(1, math.ceil((left.agg(F.sum("length")).first()[0] or 0) / GROUP_TOKENS))
    left = left.withColumn("grp", F.pmod(F.xxhash64("task", "doc_id", "start", "ids_crc32"), F.lit(groups)))
    left = left.drop("task", "sequence_id", "offset", "is_open").repartition("grp").sortWithinPartitions("grp", F.desc("length"), "doc_id", "start", "ids_crc32")
    merged = left.mapInArrow(_merge(length, MERGE_OPEN, with_ids), f"{COLUMNS}{extra}, sequence_id long, offset long")
    return placed.filter("not is_open").drop("task", "is_open").unionByName(merged)
