"""Contigs derived from text tables, so that sequence queries run on any corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the base that each letter a to z stands for.
LETTER_BASES = "AGTTCAGCTAGCATCGTGCATGACTA"
MINIMUM_TASKS = 8


def document_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(genome_id, contig_id, name, circ, seq, len): the letters of every document as bases, its source as the genome.

    The rows are dealt out so that a single input file still gives every core a share.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", "")
    seq = F.translate(letters, "abcdefghijklmnopqrstuvwxyz", LETTER_BASES)
    out = docs.select(
        F.col("source").alias("genome_id"),
        F.col("doc_id").alias("contig_id"),
        F.concat_ws("_", "lang", F.col("doc_id").cast("string")).alias("name"),
        (F.pmod("doc_id", F.lit(5)) == 0).alias("circ"),
        seq.alias("seq"),
    ).withColumn("len", F.length("seq"))
    tasks = spark.sparkContext.defaultParallelism
    return out.repartition(max(tasks, MINIMUM_TASKS)) if out.rdd.getNumPartitions() < tasks else out
