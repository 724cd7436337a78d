"""Decoys of many accessions in batches that can be stopped and started again.

A folder in shared storage has the tables ``sequences`` and ``decoys``, a part for each batch, and ``manifest``, one row for each
accession tried. A batch's manifest rows are appended last, and only outputs that a manifest row names are read, so what a
stopped batch has left counts for nothing and its accessions are pending again.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import decoys
from helixframe.operators.models import kept

#: Accessions of a batch, about; the columns of the manifest.
SIZE = 1000
MANIFEST = "genome_id string, n_records long, merged_len long, transl_table string, n_orfs long, n_target long, n_inserted long, status string, message string, batch string"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row an accession tried so far, of ``MANIFEST``: one that is done, else a failed one; none where there is no manifest."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    names = [c for c in rows.columns if c != "genome_id"]
    best = rows.groupBy("genome_id").agg(F.min_by(F.struct(*names), F.struct(F.col("status") != "ok", "batch")).alias("x"))
    return best.select("genome_id", "x.*")


def read_output(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of ``sequences`` or ``decoys`` of the accessions that the manifest holds as done, each once."""
    done = manifest(spark, folder).filter("status = 'ok'").select("genome_id", "batch")
    return spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}").withColumn("batch", F.col("batch").cast("string")).join(done, ["genome_id", "batch"], "left_semi").drop("batch")


def faults(contigs: DataFrame) -> DataFrame:
    """(genome_id, fault): each accession, and why it can't be worked on, or null. Rows without an accession have no part."""
    size = F.col("size")
    some = F.when(size > 0, 1)
    sized = contigs.filter("genome_id is not null").select("genome_id", "contig_id", F.length("seq").alias("size"))
    sums = sized.groupBy("genome_id").agg(F.sum(size.cast("long")).alias("size"), F.count(some).alias("n"), F.count_distinct(F.when(size > 0, F.col("contig_id"))).alias("ids"))
    why = F.when(F.coalesce("size", F.lit(0)) == 0, "no sequence").when(F.col("ids") < F.col("n"), "contigs without an id of their own").when(F.col("size") >= 1 << 31, "longer than an axis of 32 bits")
    return sums.select("genome_id", why.alias("fault"))


def run_batches(contigs: DataFrame, folder: str, seed: int = 42, table: str = "11", size: int = SIZE, most: int | None = None) -> DataFrame:
    """Decoys for the accessions of contigs (genome_id, contig_id, seq) that aren't done; the manifest of all.

    An accession that fails has the status ``failed`` with a message, fails no other, and is tried again by the next run. The
    decoys depend on seed and accession, not on batches. most: batches after which the run stops.
    """
    spark = contigs.sparkSession
    done = manifest(spark, folder).filter("status = 'ok'")
    pending = kept(faults(contigs.join(done.select("genome_id"), "genome_id", "left_anti")))  # before sequences are made
    n = -(-pending.count() // size)
    for turn in range(n if most is None else min(n, most)):
        part = pending.filter(F.pmod(F.xxhash64("genome_id"), F.lit(n)) == turn)
        broken = part.filter("fault is not null")
        _record(broken.select("genome_id", F.col("fault").alias("message")), folder)
        _attempt(contigs, part.filter("fault is null").select("genome_id"), folder, seed, table)
    return manifest(spark, folder)


def _record(failed: DataFrame, folder: str) -> None:
    """Append accessions (genome_id, message) as failed."""
    _append(failed.withColumn("status", F.lit("failed")).withColumn("batch", F.lit(uuid.uuid4().hex)), folder)


def _append(rows: DataFrame, folder: str) -> None:
    schema = rows.sparkSession.createDataFrame([], MANIFEST).schema
    rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)).write.mode("append").parquet(f"{folder}/manifest")


def _attempt(contigs: DataFrame, accessions: DataFrame, folder: str, seed: int, table: str, depth: int = 0) -> None:
    """One batch; if it fails it is halved by bits of the accessions' hash until the accessions that fail stand alone."""
    n = accessions.count()
    if not n:
        return
    batch = uuid.uuid4().hex
    try:
        made = decoys.insert_decoys(contigs.join(accessions, "genome_id", "left_semi"), seed, table)
        made.contigs.write.parquet(f"{folder}/sequences/batch={batch}")
        made.decoys.write.parquet(f"{folder}/decoys/batch={batch}")
        rows = kept(made.manifest)
    except (PySparkException, Py4JJavaError) as error:
        if n == 1 or depth == 63:
            text = (str(error).strip() or type(error).__name__).splitlines()[0]
            return _record(accessions.withColumn("message", F.lit(f"{type(error).__name__}: {text}")), folder)
        bit = F.shiftright(F.xxhash64(F.lit(7), "genome_id"), depth).bitwiseAND(F.lit(1))
        for side in (0, 1):
            _attempt(contigs, accessions.filter(bit == side), folder, seed, table, depth + 1)
        return
    status = F.when(F.col("valid"), "ok").otherwise("failed")
    message = F.when(F.col("valid"), F.col("message")).otherwise("a decoy is not a sound frame")
    _append(rows.select("*", status.alias("status")).withColumn("message", message).withColumn("batch", F.lit(batch)), folder)
