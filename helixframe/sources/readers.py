"""Readers of sequence and annotation files.

Plain FASTA is read by Spark's text source with record separators, so large files split. Compressed files (known by their
first bytes, whatever their names), GenBank and EMBL are read whole, one file a row, and parsed in the task that reads
them; paths may be in any store that Spark reads.
"""

from __future__ import annotations

import gzip
import io
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.alphabet import READ_THROUGH

CONTIGS = "file string, contig_ord int, name string, circ boolean, seq string"


class InvalidSequenceFile(ValueError):
    """The content is neither FASTA nor GenBank nor EMBL."""


def is_gzip(content: Column) -> Column:
    return F.substring(F.hex(content), 1, 4) == "1F8B"


def topology(header: str, default: bool) -> bool:
    return True if " circular" in header else False if " linear" in header else default


def _fasta(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    header, body = None, []
    for line in lines:
        if line.startswith(">"):
            if header is not None:
                yield header, "".join(body)
            header, body = line[1:], []
        elif line:
            body.append(line if line[-1].isalpha() else line[:-1])
    if header is not None and body:  # a last record without a body goes
        yield header, "".join(body)


def _flat(lines: Iterable[str], first: str, start: str) -> Iterator[tuple[str, str]]:
    """Records of GenBank or EMBL: a header line, then letters between a start line and //."""
    header, body, inside = None, [], False
    for line in lines:
        if line.startswith(first):
            header, body, inside = line, [], False
        elif line.startswith(start):
            inside = True
        elif line.startswith("//"):
            if header is not None and body:
                yield header, "".join(body)
            header, body, inside = None, [], False
        elif inside:
            letters = re.sub("[^A-Za-z]", "", line).upper()
            if letters:
                body.append(letters)


def lines_of(raw: bytes) -> Iterator[str]:
    """The lines of a file's content, which is decompressed as they are read if it is gzip."""
    source = io.BytesIO(raw)
    text = io.TextIOWrapper(gzip.GzipFile(fileobj=source) if raw[:2] == b"\x1f\x8b" else source, "utf-8", "replace", newline="\n")
    return (line.rstrip("\r\n") for line in text)


def parse(lines: Iterable[str], default_circular: bool = False) -> Iterator[tuple[str, bool, str]]:
    """(name, circular, sequence) of every record; the first line that isn't empty tells the format."""
    lines = iter(lines.split("\n") if isinstance(lines, str) else lines)
    lines = (x.rstrip("\r") for x in lines)
    top = next((x for x in lines if x.strip()), "")
    lines = itertools.chain([top], lines)
    if top.startswith(">"):
        records, token = _fasta(lines), lambda h: h.split(" ")[0]
    elif top.startswith("LOCUS"):
        records, token = _flat(lines, "LOCUS", "ORIGIN"), lambda h: (h.split() + ["", ""])[1]
    elif top.startswith("ID   "):
        records, token = _flat(lines, "ID   ", "SQ   "), lambda h: (h.split() + ["", ""])[1].rstrip(";")
    else:
        raise InvalidSequenceFile("empty file" if not top else f"unknown first line: {top[:60]!r}")
    for header, seq in records:
        yield token(header), topology(header, default_circular), seq


def _files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (files.option("pathGlobFilter", glob) if glob else files).load(path).select("path", "content")


def _chunks(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], size: int = 256) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _parsed(spark: SparkSession, path: str, glob: str | None, default_circular: bool, tolerant: bool) -> DataFrame:
    """CONTIGS and error: a file that can't be read has one row with its error, or fails the read."""
    fields = [("file", pa.string()), ("contig_ord", pa.int32()), ("name", pa.string()), ("circ", pa.bool_()), ("seq", pa.string()), ("error", pa.string())]

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for name, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                    i = 0
                    try:
                        for i, record in enumerate(parse(lines_of(raw.as_py()), default_circular)):
                            yield name, i, *record, None
                    except (InvalidSequenceFile, OSError, EOFError) as error:
                        if not tolerant:
                            raise InvalidSequenceFile(f"{name}: {error}") from None
                        yield name, i, None, None, None, str(error)

        yield from _chunks(rows(), fields)

    return _files(spark, path, glob).mapInArrow(function, f"{CONTIGS}, error string")


def read_contigs(spark: SparkSession, path: str, glob: str | None = None, default_circular: bool = False, tolerant: bool = False) -> DataFrame:
    """CONTIGS of all files of a path, FASTA, GenBank or EMBL, plain or compressed, in the order of the files' records.

    A file of no known format, or whose compression is broken, fails the read with its name; a tolerant read goes on
    without it, with the records before the fault, and ``failed_files`` names it. Compressed files are read as a stream;
    a file's stored size has to be under 2 GB.
    """
    return _parsed(spark, path, glob, default_circular, tolerant).filter("error is null").drop("error")


def failed_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, error) of the files that a tolerant read leaves out."""
    return _parsed(spark, path, glob, False, True).filter("error is not null").select("file", "error")


def genbank_tables(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, table): the genetic code that most coding features of an annotated GenBank file name, of equally frequent ones
    the first; 11 without one, or where it is none of ours."""

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for name, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                    yield name, -1, None
                    feature, at = "", 0
                    for line in lines_of(raw.as_py()):
                        if line.startswith("     ") and line[5:6].strip():
                            feature = line.split()[0]
                        elif not line.startswith(" "):
                            feature = ""
                        elif feature == "CDS" and (m := re.match(r"\s+/transl_table=\"?(\d+)", line)):
                            yield name, at, m[1]
                            at += 1

        yield from _chunks(rows(), [("file", pa.string()), ("at", pa.int32()), ("value", pa.string())])

    found = _files(spark, path, glob).mapInArrow(function, "file string, at int, value string")
    counts = found.groupBy("file", "value").agg(F.count("value").alias("n"), F.min("at").alias("first"))
    best = counts.groupBy("file").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("value"))
    return best.select("file", F.when(F.col("value").isin(*READ_THROUGH), F.col("value")).otherwise("11").alias("table"))


def fasta_records(lines: DataFrame, default_circular: bool = False) -> DataFrame:
    """(name, circ, seq) from text read with ``lineSep`` of a line end and ``>``."""
    value = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    out = lines.select(value.alias("v")).filter(F.trim("v") != "").select(F.substring_index("v", "\n", 1).alias("header"), F.when(F.instr("v", "\n") > 0, F.substring(F.col("v"), F.instr("v", "\n") + 1, F.length("v"))).otherwise("").alias("body"))
    seq = F.regexp_replace(F.regexp_replace("body", r"(?m)[^A-Za-z\n]$", ""), "\n", "")
    circ = F.when(F.instr("header", " circular") > 0, True).when(F.instr("header", " linear") > 0, False).otherwise(default_circular)
    return out.select(F.substring_index("header", " ", 1).alias("name"), circ.alias("circ"), seq.alias("seq"))


def read_fasta(spark: SparkSession, path: str, default_circular: bool = False) -> DataFrame:
    """(name, circ, seq) of plain FASTA files of any size, without an order between records."""
    return fasta_records(spark.read.option("lineSep", "\n>").text(path), default_circular)


def read_gff(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("CDS",)) -> DataFrame:
    """(assembly, host, start, end, strand, type) of feature files; lines with fewer than eight fields are left out."""
    columns = ["host", "source", "type", "start", "end", "score", "strand", "phase", "attributes"]
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    rows = rows.filter(F.col("phase").isNotNull() & F.col("type").isin(*kinds))
    assembly = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    return rows.select(assembly.alias("assembly"), F.regexp_replace("host", r"\.[^.]*$", "").alias("host"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "strand", "type")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(assembly, host, name, start, end, strand): features under ``>host`` lines; start may exceed end on the minus strand.

    A file's lines are numbered as they are read and the last host line before a feature is carried on to it.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    host = F.last(F.when(F.col("line").startswith(">"), F.split(F.expr("substring(line, 2)"), r"\s+")[0]), ignorenulls=True).over(upto)
    rows = lines.withColumn("host", host).filter(~F.col("line").startswith(">") & (F.trim("line") != ""))
    part = F.split(F.trim("line"), r"\s+")
    assembly = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    return rows.filter(F.size(part) >= 4).select(
        assembly.alias("assembly"), F.regexp_replace("host", r"\.[^.]*$", "").alias("host"), part[0].alias("name"),
        part[1].cast("int").alias("start"), part[2].cast("int").alias("end"), F.substring(part[3], 1, 1).alias("strand"),
    )
