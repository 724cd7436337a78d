"""Column functions on sequences; all are built from Spark's own functions and stay in its generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.alphabet import COMPLEMENT_LETTERS, LETTERS, ORDER, genetic_code


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), LETTERS, COMPLEMENT_LETTERS)


def gc_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "GCgc", ""))


def gc_percent(seq: Column) -> Column:
    """0 for an empty sequence."""
    return F.when(F.length(seq) > 0, 100 * gc_count(seq) / F.length(seq)).otherwise(F.lit(0.0))


def codons(seq: Column, phase: int = 0) -> Column:
    """The whole codons from an offset on."""
    return F.regexp_extract_all(F.substring(seq, phase + 1, 2**31 - 1), F.lit("(?s)(...)"), 1)


def base_address(base: Column) -> Column:
    """T and U 0, C 1, A 2, G 3, others -1."""
    base = F.translate(F.upper(base), "U", "T")
    out = F.lit(-1)
    for i, b in enumerate(ORDER):
        out = F.when(base == b, i).otherwise(out)
    return out


def kmer_address(kmer: Column, size: int) -> Column:
    """Base-4 number of a k-mer; -1 if a base is ambiguous."""
    digits = [base_address(F.substring(kmer, i + 1, 1)) for i in range(size)]
    number = sum((d * 4 ** (size - 1 - i) for i, d in enumerate(digits)), F.lit(0))
    bad = F.lit(False)
    for d in digits:
        bad = bad | (d < 0)
    return F.when(bad | (F.length(kmer) != size), -1).otherwise(number).cast("int")


def translate_dna(seq: Column, table: str = "11", partial5: Column | None = None) -> Column:
    """Protein of the whole codons; the first is M unless the 5' end is missing, unknown codons are X, stops are *."""
    pairs = [F.lit(x) for pair in genetic_code(table).items() for x in pair]
    code = F.create_map(*pairs)
    body = F.transform(codons(F.upper(seq)), lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X")))
    protein = F.array_join(body, "")
    whole = F.when(F.length(protein) > 0, F.concat(F.lit("M"), F.substring(protein, 2, 2**31 - 1))).otherwise(F.lit(""))
    return whole if partial5 is None else F.when(partial5, protein).otherwise(whole)


def gc_bin(gc: Column) -> Column:
    """0 below 0.20, 60 from 0.80, else one bin for each hundredth from 1 on; ``gc`` is a fraction."""
    return F.when(gc < 0.2, 0).when(gc >= 0.8, 60).otherwise(F.floor((gc - 0.2) * 100).cast("int") + 1)


def gc_bin_label(percent: Column, low: float = 20, high: float = 80, step: int = 1) -> Column:
    """Label of a bin of ``step`` percent, such as 25_26; null outside [low, high)."""
    lower = F.greatest(F.floor(percent) - F.pmod(F.floor(percent), F.lit(step)), F.lit(int(low)))
    label = F.format_string("%02d_%02d", lower.cast("int"), (lower + step).cast("int"))
    return F.when((percent >= low) & (percent < high), label)


def genome_seed(seed: int, accession: Column) -> Column:
    """The first 64 bits of sha256("seed:accession") as an unsigned decimal."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), accession), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def unversioned(host: Column) -> Column:
    """An accession without the version after its last dot."""
    return F.regexp_replace(host, r"\.[^.]*$", "")


def sigmoid(x: Column, temperature: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-x / temperature))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def rbf(x: Column, y: Column, gamma: float) -> Column:
    distance = F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return F.exp(-gamma * distance)


def genetic_code_table(spark: SparkSession) -> DataFrame:
    """(table, codon, aa, is_start, is_stop) of all codes: 384 rows."""
    from helixframe.functions.alphabet import READ_THROUGH, start_codons

    rows = [(t, c, a, c in start_codons(t), a == "*") for t in READ_THROUGH for c, a in genetic_code(t).items()]
    return spark.createDataFrame(rows, "table string, codon string, aa string, is_start boolean, is_stop boolean")
