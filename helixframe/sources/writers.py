"""Text lines of the output formats as columns; a sink is a sorted projection written with ``df.write.text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import gc_bin_label, gc_percent, translate_dna

#: The source named in feature lines.
PROGRAM = "helixframe"


def tag(idx: Column) -> Column:
    return F.format_string("ORF%06d", idx.cast("long") + 1)


def partial(edge: Column) -> Column:
    """Whether the 5' and the 3' end is missing, as two digits."""
    return F.concat((edge >= 5).cast("int").cast("string"), edge.isin(3, 8).cast("int").cast("string"))


def sign(strand: Column) -> Column:
    return F.when(strand == 1, "-").otherwise("+")


def fixed(value: Column, digits: int = 3) -> Column:
    """A number with so many decimals; what is a half once the number is scaled goes to the even digit.

    The scaled number is a double, as it is in SQL: 0.5115 times a thousand is just below 511.5 and gives 0.511.
    """
    scale = 10.0**digits
    return F.format_string(f"%.{digits}f", F.rint(value.cast("double") * scale) / scale)


def gff_line() -> Column:
    """For genes with name, i_score, t_score, r_score, rstart, rend, strand, idx and edge_type."""
    kind = F.when(F.col("i_score") >= 0, "CDS").otherwise("ORF")
    attributes = F.concat(F.lit("ID="), tag(F.col("idx")), F.lit(";partial="), partial(F.col("edge_type")), F.lit(";r_score="), fixed(F.col("r_score")))
    return F.concat_ws("\t", "name", F.lit(PROGRAM), kind, F.col("rstart").cast("string"), F.col("rend").cast("string"), fixed(F.col("t_score")), sign(F.col("strand")), F.lit("0"), attributes)


def bed_line() -> Column:
    """Six columns; the score is cut, not rounded, to 0..1000."""
    score = F.greatest(F.lit(0), F.least(F.lit(1000), (F.col("t_score") * 1000).cast("int")))
    return F.concat_ws("\t", "name", (F.col("rstart") - 1).cast("string"), F.col("rend").cast("string"), tag(F.col("idx")), score.cast("string"), sign(F.col("strand")))


def fasta_header() -> Column:
    """The spelling of the last field is part of the format."""
    place = F.concat("name", F.lit(":"), F.col("rstart").cast("string"), F.lit(".."), F.col("rend").cast("string"), F.lit("("), sign(F.col("strand")), F.lit(")"))
    return F.concat(F.lit(">"), place, F.lit(" ID="), tag(F.col("idx")), F.lit(";score="), fixed(F.col("t_score")), F.lit(";paritial="), partial(F.col("edge_type")))


def location() -> Column:
    """The GenBank location: complement, join across the origin, < and > at missing ends."""
    edge, minus = F.col("edge_type"), F.col("strand") == 1
    open5, open3 = edge >= 5, edge.isin(3, 8)
    low = F.when(F.when(minus, open3).otherwise(open5), "<").otherwise("")
    high = F.when(F.when(minus, open5).otherwise(open3), ">").otherwise("")
    start, end, whole = (F.col(c).cast("string") for c in ("rstart", "rend", "contig_len"))
    wrapped = F.concat(F.lit("join("), start, F.lit(".."), whole, F.lit(",1.."), end, F.lit(")"))
    span = F.when(F.col("rstart") > F.col("rend"), wrapped).otherwise(F.concat(low, start, F.lit(".."), high, end))
    return F.when(minus, F.concat(F.lit("complement("), span, F.lit(")"))).otherwise(span)


def genbank_feature(table: str = "11") -> Column:
    """The lines of one gene with nt."""
    blank = " " * 21
    kind = F.when(F.col("i_score") >= 0, "CDS").otherwise("ORF")
    protein = translate_dna(F.col("nt"), table, F.col("edge_type") >= 5)
    lines = [
        F.concat(F.lit("     "), kind, F.lit(" " * 13), location()),
        F.concat(F.lit(f"{blank}/locus_tag="), tag(F.col("idx"))),
        F.lit(f"{blank}/transl_table={table}"),
        F.lit(f"{blank}/codon_start=1"),
        F.lit(f'{blank}/note="Derived by protein-coding gene prediction method: {PROGRAM}"'),
        F.concat(F.lit(f'{blank}/translation="'), protein, F.lit('"')),
    ]
    return F.concat_ws("\n", *lines)


def origin(seq: Column) -> Column:
    """The sequence in numbered lines of six blocks of ten, in lower case."""
    starts = F.when(F.length(seq) > 0, F.sequence(F.lit(1), F.length(seq), F.lit(60))).otherwise(F.array().cast("array<int>"))
    line = lambda i: F.concat(F.lpad(i.cast("string"), 9, " "), F.lit(" "), F.rtrim(F.regexp_replace(F.lower(F.substring(seq, i, F.lit(60))), "(.{10})", "$1 ")))
    return F.array_join(F.transform(starts, line), "\n")


def locus(name: Column, length: Column, circ: Column, date: Column) -> Column:
    """name, length, topology and date in the columns of a LOCUS line."""
    digits = length.cast("string")
    size = F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), 27 - F.length(name) - F.length(digits))), digits)
    return F.concat(name, F.lit(" "), size, F.lit(" bp    DNA"), F.lpad(F.when(circ, "circular").otherwise("  linear"), 13, " "), F.lit(" UNA "), F.upper(F.date_format(date, "dd-MMM-yyyy")))


def write_lines(lines: DataFrame, path: str, order: list[str], header: list[str] | None = None) -> None:
    """Write lines in order as text; a range partition keeps the order across the files."""
    rows = lines.orderBy(*order).select("value")
    if header:
        top = lines.sparkSession.createDataFrame([(h,) for h in header], "value string").coalesce(1)
        rows = top.unionByName(rows)
    rows.write.mode("overwrite").text(path)


class UnknownFormat(ValueError):
    """An output format that isn't one of ``FORMATS``."""


FORMATS = ("gff", "bed", "gbk", "gbk-full", "faa", "faa-tmp", "fna")


def output_lines(genes: DataFrame, contigs: DataFrame, kind: str, table: str, date: Column) -> DataFrame:
    """(genome_id, contig_id, at, part, value): the lines of an output format in the order of contig, place and part.

    genes: of the gene-finding plans, with nt; contigs: genome_id, contig_id, name, circ, len and, for gbk-full, seq. Only
    contigs that have a gene get a header or a closing line.
    """
    if kind not in FORMATS:
        raise UnknownFormat(f"{kind} is not one of {', '.join(FORMATS)}")
    protein = translate_dna(F.col("nt"), table, F.col("edge_type") >= 5)
    share = F.concat(F.lit(";gc_cont="), fixed(F.col("gc_cont")))
    body = {
        "gff": [gff_line],
        "bed": [bed_line],
        "gbk": [lambda: genbank_feature(table)],
        "gbk-full": [lambda: genbank_feature(table)],
        "faa": [fasta_header, lambda: protein],
        "faa-tmp": [lambda: F.concat(F.lit(">"), F.col("idx").cast("string")), lambda: protein],
        "fna": [lambda: F.concat(fasta_header(), share), lambda: F.col("nt")],
    }[kind]
    lines = F.posexplode(F.array(*(f() for f in body))).alias("part", "value")
    out = genes.select("genome_id", "contig_id", F.col("idx").alias("at"), lines)
    if kind in ("faa", "faa-tmp", "fna"):
        return out
    keys = ["genome_id", "contig_id"]
    used = contigs.join(genes.select(*keys).distinct(), keys, "left_semi")
    top = locus(F.col("name"), F.col("len"), F.col("circ"), date)
    if kind in ("gff", "bed"):
        head = [F.concat(F.lit("# "), top)]
    else:
        head = [F.concat(F.lit("LOCUS       "), top), F.concat(F.lit("DEFINITION  "), F.col("name")), F.lit("FEATURES             Location/Qualifiers")]
    heads = used.select(*keys, F.lit(-1).cast("long").alias("at"), F.posexplode(F.array(*head)).alias("part", "value"))
    out = heads.unionByName(out)
    if kind in ("gbk", "gbk-full"):
        tail = [F.lit("ORIGIN"), *([origin(F.col("seq"))] if kind == "gbk-full" else []), F.lit("//")]
        out = out.unionByName(used.select(*keys, F.lit(2**62).cast("long").alias("at"), F.posexplode(F.array(*tail)).alias("part", "value")))
    return out


def write_output(genes: DataFrame, contigs: DataFrame, path: str, kind: str, table: str = "11", date: Column | None = None) -> None:
    """Write genes as text in a format of ``FORMATS``."""
    lines = output_lines(genes, contigs, kind, table, F.current_date() if date is None else date)
    write_lines(lines, path, ["genome_id", "contig_id", "at", "part"], ["##gff-version 3", f"# trans_tbl={table}"] if kind == "gff" else None)


def folded(seq: Column, width: int = 70) -> Column:
    """A sequence in lines of a width."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def write_decoys(made, fasta: str, gff: str) -> None:
    """Each accession with its decoys as one FASTA record, its contigs one behind the other, and the decoys' places as GFF3.

    made: of ``decoys.insert_decoys``.
    """
    head = F.concat(F.lit(">"), "genome_id", F.lit(" with decoys, "), F.col("n_records").cast("string"), F.lit(" contigs in one"))
    top = made.manifest.select("genome_id", F.lit(-1).cast("long").alias("contig_id"), head.alias("value"))
    write_lines(top.unionByName(made.contigs.select("genome_id", "contig_id", folded(F.col("seq")).alias("value"))), fasta, ["genome_id", "contig_id"])
    number = F.row_number().over(Window.partitionBy("genome_id").orderBy("start")).cast("string")
    line = F.concat_ws("\t", "genome_id", F.lit(PROGRAM), F.lit("CDS"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("0"), F.concat(F.lit("ID=decoy_"), number, F.lit(";Note=decoy")))
    region = made.manifest.select("genome_id", F.lit(-1).alias("start"), F.concat_ws(" ", F.lit("##sequence-region"), "genome_id", F.lit("1"), F.col("merged_len").cast("string")).alias("value"))
    write_lines(region.unionByName(made.decoys.select("genome_id", "start", line.alias("value"))), gff, ["genome_id", "start"], ["##gff-version 3"])


def write_bins(contigs: DataFrame, path: str, low: float = 20, high: float = 80, step: int = 1) -> None:
    """FASTA of the contigs (class, name, seq) in a folder for each class and G+C bin; those outside the range are left out."""
    binned = contigs.withColumn("gc_bin", gc_bin_label(gc_percent(F.col("seq")), low, high, step)).filter("gc_bin is not null")
    lines = binned.select("class", "gc_bin", F.concat_ws("\n", F.concat(F.lit(">"), F.col("name")), folded(F.col("seq"), 60)).alias("value"))
    lines.write.mode("overwrite").partitionBy("class", "gc_bin").text(path)


def write_features(scored: DataFrame, path: str) -> None:
    """Features and labels (1 from a t_score of a half on) of long ORFs; how long depends on the genome's G+C.

    scored: genome_id, len, n_gc, t_score and features; a genome of middling G+C takes ORFs of 240 nt, others of 180.
    """
    share = scored.groupBy("genome_id").agg((100 * F.sum("n_gc") / F.sum("len")).alias("_gc"))
    least = F.when((F.col("_gc") < 45) | (F.col("_gc") >= 63), 180).otherwise(240)
    rows = scored.join(share, "genome_id").filter(F.col("len") >= least)
    rows.select("genome_id", F.transform("features", lambda x: x.cast("float")).alias("features"), (F.col("t_score") >= 0.5).cast("int").alias("label")).write.mode("overwrite").parquet(path)
