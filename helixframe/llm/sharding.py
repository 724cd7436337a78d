"""Sharding by fixed virtual slots.

Records are hashed into ``SLOTS`` virtual slots, a number that never changes. Bytes are summed per slot, and a versioned
map says which shard holds a slot. A first map gives slots, largest first, to the shard with the fewest bytes; rebalancing
edits the last version and moves as few slots as it can. Only the slots' sums, a fixed number, come to the driver.

A record's slot is the hash of doc_id and text; of rows that agree in both, each takes one of as many slots as there are
rows, so that no slot holds a large group of them.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import bounded, materialise, shared_folder, utf8

SLOTS = 4096
SHARDS = 8
MAP = "version int, virtual_slot int, shard int, first long"


def virtual_slot(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS)).cast("int")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot).

    A row without a double has the slot of its doc_id and text alone, so it keeps it whatever other rows there are.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(utf8(text).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("record"),
    )
    rows = materialise(rows)
    again = materialise(rows.groupBy("record").agg(F.count("*").alias("n")).filter("n > 1"))
    rows = rows.join(bounded(again), "record", "left")
    turn = F.when(F.col("n").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("n"))).otherwise(0)
    return rows.select("doc_id", "size", "text_crc32", F.when(turn == 0, virtual_slot(F.col("record"))).otherwise(virtual_slot(F.col("record"), turn)).alias("virtual_slot"))


def slot_sums(records: DataFrame) -> DataFrame:
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def first_map(sums: list[tuple[int, int]], shards: int = SHARDS) -> dict[int, int]:
    """slot -> shard for (slot, bytes): each slot, largest first, to the shard with the fewest bytes so far."""
    load = [(0, shard) for shard in range(shards)]
    out = {}
    for slot, size in sorted(sums, key=lambda s: (-s[1], s[0])):
        total, shard = load[0]
        out[slot] = shard
        heapq.heapreplace(load, (total + size, shard))
    return out


def rebalanced(old: dict[int, int], sums: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """The next version of a map: slots leave shards that are gone or hold more than their part, for those that hold least.

    Slots that the map doesn't have yet and those that leave, largest first, go to the shard with the fewest bytes. While
    the sums are as they were, one shard more takes slots only into itself.
    """
    size = dict(sums)
    fair = sum(size.values()) / shards
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    loose = []
    for slot in sorted(size, key=lambda s: (-size[s], s)):
        held[old[slot]].append(slot) if old.get(slot, shards) < shards else loose.append(slot)
    load = {s: sum(size[x] for x in held[s]) for s in held}
    for shard in held:
        for slot in list(held[shard]):
            if load[shard] - size[slot] >= fair:
                held[shard].remove(slot)
                load[shard] -= size[slot]
                loose.append(slot)
    for slot in sorted(loose, key=lambda s: (-size[s], s)):
        shard = min(load, key=lambda s: (load[s], s))
        held[shard].append(slot)
        load[shard] += size[slot]
    return {slot: shard for shard, slots in held.items() for slot in slots}


def map_table(spark: SparkSession, version: int, slots: dict[int, int], n_rows: dict[int, int]) -> DataFrame:
    """A version of the map as a table; ``first`` is the number of rows of the shard's smaller slots."""
    at: dict[int, int] = {}
    rows = []
    for slot in sorted(slots):
        shard = slots[slot]
        rows.append((version, slot, shard, at.get(shard, 0)))
        at[shard] = at.get(shard, 0) + n_rows.get(slot, 0)
    return spark.createDataFrame(rows, MAP)


def store_map(slots: DataFrame, path: str) -> None:
    """Add a version to the stored map; older versions stay readable."""
    slots.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """(version, slot -> shard) of the stored map, the last version unless one is named."""
    table = spark.read.schema(MAP).parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    return version, {r.virtual_slot: r.shard for r in table.filter(F.col("version") == version).collect()}


def shard(docs: DataFrame, shards: int = SHARDS, version: int = 1, old: dict[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, size, text_crc32, shard, slot, virtual_slot; the map's version).

    ``slot`` is the row's place in its shard, gapless from 0: the rows of the shard's smaller virtual slots come first,
    those of one virtual slot in the order of doc_id, text_crc32 and size. A given older map is rebalanced, else a first
    one made.

    Defined cases: a null text has no bytes and size 1. Null and repeated doc_ids and repeated rows get places of their
    own. An empty table gives an empty result and map. Columns other than doc_id and text are not read.
    """
    records = materialise(sized(docs))
    sums = slot_sums(records).collect()  # at most SLOTS rows
    pairs = [(r.virtual_slot, r.bytes) for r in sums]
    slots = rebalanced(old, pairs, shards) if old else first_map(pairs, shards)
    table = map_table(docs.sparkSession, version, slots, {r.virtual_slot: r.n_rows for r in sums})
    rows = placed(records, table)
    return rows.select("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot"), table


def placed(records: DataFrame, slots: DataFrame) -> DataFrame:
    """The rows with a version of the map, at most ``SLOTS`` rows, and their place in the shard."""
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    rows = records.withColumn("at", F.row_number().over(order) - 1).join(F.broadcast(slots), "virtual_slot")
    return rows.withColumn("slot", (F.col("first") + F.col("at")).cast("long"))


def digest(docs: DataFrame, shards: int = SHARDS, path: str | None = None) -> DataFrame:
    """The rows with the law they hold to: shards' bytes are near equal.

    The map is stored as version 1 at ``path`` (a new folder of the shared one) and read again to place the rows; then it
    is edited for one shard more and stored as version 2, whose shard is ``next_shard``.

    Defined cases: a null text has no bytes, and its size is 1, as that of an empty one; a very long text is one row of its
    size; repeated rows and doc_ids, null ones too, each have a place; an empty table gives an empty result; columns other
    than doc_id and text are not read.
    """
    path = path or f"{shared_folder(docs.sparkSession)}/slots-{uuid.uuid4().hex}"
    records = materialise(sized(docs))
    sums = slot_sums(records).collect()  # at most SLOTS rows
    pairs, n_rows = [(r.virtual_slot, r.bytes) for r in sums], {r.virtual_slot: r.n_rows for r in sums}
    store_map(map_table(docs.sparkSession, 1, first_map(pairs, shards), n_rows), path)
    version, slots = load_map(docs.sparkSession, path, 1)
    grown = rebalanced(slots, pairs, shards + 1)
    store_map(map_table(docs.sparkSession, version + 1, grown, n_rows), path)
    first, second = (docs.sparkSession.read.schema(MAP).parquet(path).filter(F.col("version") == v) for v in (version, version + 1))
    table = first.join(F.broadcast(second.select("virtual_slot", F.col("shard").alias("next_shard"))), "virtual_slot")
    rows = placed(records, table)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version", "next_shard")
