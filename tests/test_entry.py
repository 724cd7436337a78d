import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

WITHOUT = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("helixframe.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert "top_genes" in e.queries() and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_without_the_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "helixframe").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def values(rows, columns):
    def plain(v):
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    order = sorted(columns)
    return sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in rows)


@pytest.mark.parametrize("name", ["top_genes", "orf_edges", "orf_circular", "gc_bin_lag", "overlap_pairs", "gaps", "tis_argmax", "gff_lines", "code_table_score", "early_exit", "prefix_sum_sampler", "zscore", "minmax_scale", "mlp_score", "pwm_counts", "start_odds", "record_lengths", "orf_chunked", "eval_greedy", "sampled_codons", "overlap_report", "decoy_counts", "decoy_resumed"])
def test_against_sql(spark, name):
    import __spark_entry__ as e

    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = base.execute(e.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = e.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert values([tuple(r) for r in got.collect()], got.columns) == values(want.fetchall(), columns)
