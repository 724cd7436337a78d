"""Reading frames of FASTA files as they arrive; the scan keeps no state, so results are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import orfs
from helixframe.sources.readers import fasta_records


def stream_orfs(spark: SparkSession, folder: str, minlen: int = 90, table: str = "11", files_per_trigger: int = 16) -> DataFrame:
    """A streaming DataFrame of the ORFs of every record that lands in a folder; genome_id is the record's name."""
    lines = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    contigs = fasta_records(lines).select(F.col("name").alias("genome_id"), F.lit(0).cast("long").alias("contig_id"), "circ", "seq")
    return orfs.find_orfs(contigs, minlen, table)


def write_orfs(stream: DataFrame, out: str, checkpoint: str, once: bool = True):
    """Append to Parquet, exactly once by the checkpoint; ``once`` takes what is there and ends."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
