"""The library's functions for SQL: temporary functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from helixframe.functions.alphabet import COMPLEMENT_LETTERS, LETTERS, genetic_code

ORF = "strand int, frame int, starts array<int>, types array<int>, start int, end int, len int, edge_type int, n_gc int, n_g2 int, rstart int, rend int, nt string"


def _sql_functions() -> dict[str, str]:
    code = ", ".join(f"'{c}', '{a}'" for c, a in genetic_code("11").items())
    codons = "regexp_extract_all(seq, '(?s)(...)', 1)"
    return {
        "gc_content(seq STRING) RETURNS DOUBLE": "CASE WHEN length(seq) > 0 THEN (length(seq) - length(translate(seq, 'GCgc', ''))) / length(seq) END",
        "revcomp(seq STRING) RETURNS STRING": f"translate(reverse(seq), '{LETTERS}', '{COMPLEMENT_LETTERS}')",
        "codons(seq STRING) RETURNS ARRAY<STRING>": codons,
        "translate_dna(seq STRING) RETURNS STRING": f"CASE WHEN length(seq) >= 3 THEN concat('M', substring(array_join(transform({codons}, c -> coalesce(try_element_at(map({code}), upper(c)), 'X')), ''), 2)) WHEN seq IS NOT NULL THEN '' END",
    }


class FindOrfs:
    """The table function: find_orfs(seq, circ, table, minlen, meta)."""

    def eval(self, seq: str, circ: bool, table: str, minlen: int, meta: bool):
        from helixframe.operators.orfs import scan

        if seq is not None and len(seq) >= minlen:
            yield from scan(seq, bool(circ), minlen, table, bool(meta))


def register(spark: SparkSession) -> None:
    """Make gc_content, revcomp, codons, translate_dna (code 11), zcurve and the table function find_orfs known to the session.

    All but zcurve and find_orfs are SQL expressions that stay in Spark's own code.
    """
    for head, body in _sql_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf("array<double>")
    def zcurve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from helixframe.operators.features import zcurves

        for seqs in batches:
            yield pd.Series(list(zcurves([s or "" for s in seqs])))

    spark.udf.register("zcurve", zcurve)
    spark.udtf.register("find_orfs", F.udtf(FindOrfs, returnType=ORF))
