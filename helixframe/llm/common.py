"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a table may be broadcast.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see.

    Where it is unset a new folder of this machine is taken, which only a local master can use; elsewhere this raises.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder := tempfile.mkdtemp(prefix="spark-"))
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where the table has such a column already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def width(column: Column, kind: T.DataType) -> Column:
    """The bytes of a value, about."""
    if isinstance(kind, T.StringType | T.BinaryType):
        size = F.octet_length(column) + 16
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType | T.BinaryType):
        size = F.aggregate(column, F.lit(16), lambda s, x: s + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
    elif isinstance(kind, T.ArrayType):
        parts = len(kind.elementType) if isinstance(kind.elementType, T.StructType) else 1
        size = F.size(column) * (8 * parts) + 16
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(8))


def bounded(df: DataFrame, most: int | None = None) -> DataFrame:
    """With a broadcast hint if the table's values take no more than so many bytes (``BROADCAST_BYTES``).

    A larger table gets none, and Spark joins by a shuffle and splits skewed keys. The table should be materialised, as
    its bytes are summed here.
    """
    row = sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    size = df.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= (BROADCAST_BYTES if most is None else most) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(column, F.lit(""))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def records(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a part of a batch at a time."""
    for batch in sliced(batches):
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) for each run of equal keys; the partition has to be sorted by the keys and a group has to be bounded."""
    key, rows = None, []
    k = len(keys)
    for row in records(batches, *keys, *names):
        if row[:k] != key:
            if rows:
                yield key, rows
            key, rows = row[:k], []
        rows.append(row[k:])
    if rows:
        yield key, rows


def grouped(df: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """Apply a batch function to partitions in which the rows of a key stand together.

    Cheaper than a grouped pandas function where most groups have two or three rows.
    """
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(function, schema)


def in_chunks(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` of the rows."""
    chunk: list[tuple] = []
    for row in rows:
        chunk.append(row)
        if len(chunk) >= size:
            yield batch(chunk, schema)
            chunk = []
    if chunk:
        yield batch(chunk, schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Hashes(dict):
    """word -> stable signed 64-bit hash, kept for a bounded number of words."""

    def __init__(self, limit: int = 150_000):
        import xxhash

        super().__init__()
        self.digest, self.limit = xxhash.xxh3_64_intdigest, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self.digest(word.encode("utf-8", "surrogatepass")) - (1 << 63)
        self[word] = value
        return value


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_set(words: list[str], hashes: Hashes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text has one shingle, an empty one none."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)).view(np.uint64)
    n = max(1, len(w) - size + 1)
    h = np.full(n, len(w) if len(w) < size else 0, np.uint64)
    for i in range(min(size, len(w))):
        h = h * MIX + mixed(w[i : i + n])
    return np.unique(mixed(h))
