"""Cumulative-snapshot collapse for chat logs, with DataFrame functions only.

A log may hold a conversation several times, each time with more turns. Every turn gets a rolling hash of the
conversation up to it; a conversation whose last hash is a hash inside a longer one is a snapshot of that one and goes,
of equal conversations the smallest conv_id stays. What stays is rendered to one text.

Only digests of the turns are sorted and compared; the texts of the conversations that stay are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import bounded, materialise

START, MIDDLE, END = "<|", "|>\n", "\n<|end|>\n"


def _turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest) without nulls in role and text."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.withColumn("digest", F.md5("text"))


def _hashes(pos: Column) -> list[Column]:
    """Two 64-bit hashes of a turn at a position."""
    return [F.xxhash64(pos, "role", "digest").alias("h"), F.xxhash64("digest", pos, "role", F.lit(1)).alias("g")]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, n_turns, h, g): two rolling hashes of the turns up to pos; a turn without a conv_id stands alone.

    Positions count from 1 in the order of turn (nulls first), role and the text's MD5. Each turn's hash holds its position,
    role and text; their running exclusive-or is the rolling hash.
    """
    small = _turns(turns).drop("text")
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy(F.asc_nulls_first("turn"), "role", "digest")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = small.filter("conv_id is not null").withColumn("pos", F.row_number().over(order)).withColumn("n_turns", F.count("*").over(whole))
    named = named.select("conv_id", "turn", "role", "digest", "pos", "n_turns", *_hashes(F.col("pos")))
    named = named.select("conv_id", "pos", "n_turns", F.bit_xor("h").over(sofar).alias("h"), F.bit_xor("g").over(sofar).alias("g"))
    alone = small.filter("conv_id is null").select("conv_id", F.lit(1).alias("pos"), F.lit(1).cast("long").alias("n_turns"), *_hashes(F.lit(1)))
    return named.unionByName(alone)


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, h, g) of the conversations that are no prefix of a longer one."""
    prefixes = materialise(prefix_hashes(turns))
    last = prefixes.filter("pos = n_turns").groupBy("n_turns", "h", "g").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = prefixes.filter("pos < n_turns").select(F.col("pos").cast("long").alias("n_turns"), "h", "g").distinct()
    return last.join(inner, ["n_turns", "h", "g"], "left_anti").select("conv_id", "n_turns", "n_copies", "h", "g")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(MIDDLE), text, F.lit(END))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation that stays: conv_id, n_turns long, n_copies long, chat string.

    Defined cases: null roles and texts count as empty; a null turn comes first; rows with equal turns are ordered by role
    and the text's MD5, and repeated rows are turns of their own. A row with a null conv_id is a conversation of one turn,
    equal ones are copies. An empty table gives an empty result. Columns other than conv_id, turn, role and text are not
    read. A conversation is one row of the result, so one conversation has to fit in a row.
    """
    kept, rows = materialise(maximal(turns)), _turns(turns)
    part = rendered(F.col("role"), F.col("text")).alias("part")
    named = bounded(kept.filter("conv_id is not null").select("conv_id", "n_turns", "n_copies"))
    chats = rows.join(named, "conv_id").groupBy("conv_id", "n_turns", "n_copies")
    chats = chats.agg(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", part))).alias("parts"))
    chats = chats.select("conv_id", "n_turns", "n_copies", F.array_join(F.col("parts.part"), "").alias("chat"))
    # equal turns without a conv_id are one before they are shuffled
    alone = rows.filter("conv_id is null").select(*_hashes(F.lit(1)), part).groupBy("h", "g").agg(F.min("part").alias("chat"))
    alone = alone.join(kept.filter("conv_id is null"), ["h", "g"]).select("conv_id", "n_turns", "n_copies", "chat")
    return chats.unionByName(alone)


ORACLE_SQL = """
WITH rows AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
turns AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN r END AS alone,
         row_number() OVER (PARTITION BY conv_id, CASE WHEN conv_id IS NULL THEN r END ORDER BY turn NULLS FIRST, role, md5(text)) AS pos FROM rows),
prefixes AS (
  SELECT conv_id, alone, pos, count(*) OVER (PARTITION BY conv_id, alone) AS n_turns,
         string_agg(md5(role || chr(1) || text), ',') OVER (PARTITION BY conv_id, alone ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix
  FROM turns),
last AS (
  SELECT prefix, n_turns, min(conv_id) AS conv_id, min(alone) AS alone, count(*) AS n_copies FROM prefixes WHERE pos = n_turns GROUP BY prefix, n_turns),
kept AS (
  SELECT * FROM last WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE pos < n_turns))
SELECT k.conv_id, k.n_turns, k.n_copies,
       string_agg('<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10), '' ORDER BY t.pos) AS chat
FROM kept k JOIN turns t ON t.conv_id = k.conv_id OR (k.conv_id IS NULL AND t.conv_id IS NULL AND t.alone = k.alone)
GROUP BY k.conv_id, k.n_turns, k.n_copies, k.prefix
"""
