import random

import pytest
from pyspark.errors import PySparkException

from helixframe.operators import decoys
from helixframe.plans import decoy_batches as B


@pytest.fixture(scope="module")
def contigs(spark):
    rng = random.Random(2)
    rows = [(g, i, "".join(rng.choices("ACGT", k=6000))) for g in ("a", "b", "c") for i in range(2)]
    rows += [("empty", 1, ""), ("empty", 2, None), ("twice", 1, "ACGT" * 50), ("twice", 1, "ACGT" * 60), (None, 1, "ACGT" * 60)]
    return spark.createDataFrame(rows, "genome_id string, contig_id long, seq string").cache()


def content(spark, folder):
    rows = sorted(tuple(r.asDict()[c] for c in r.asDict() if c != "batch") for r in B.manifest(spark, folder).collect())
    return rows, *(sorted(map(tuple, B.read_output(spark, folder, n).collect())) for n in ("sequences", "decoys"))


def test_a_stopped_run_that_is_started_again_gives_the_same(spark, contigs, tmp_path, monkeypatch):
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    B.run_batches(contigs, whole)
    rows, sequences, made = content(spark, whole)
    status = {r[0]: (r[7], r[8]) for r in rows}
    assert status["empty"] == ("failed", "no sequence") and status["twice"] == ("failed", "contigs without an id of their own")
    assert {g for g, (s, _) in status.items() if s == "ok"} == {"a", "b", "c"} and {r[0] for r in sequences} == {"a", "b", "c"} and made

    # stopped after some batches, then within one: its outputs are there, its manifest rows aren't
    B.run_batches(contigs, parts, size=2, most=1)
    append = B._append
    with monkeypatch.context() as m:
        m.setattr(B, "_append", lambda rows, folder: append(rows, folder) if "n_orfs" not in rows.columns else (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            B.run_batches(contigs, parts)
    B.run_batches(contigs, parts)
    assert content(spark, parts) == (rows, sequences, made)
    # nothing is pending but what failed
    called = []
    monkeypatch.setattr(decoys, "insert_decoys", lambda *a: called.append(a))
    B.run_batches(contigs, parts)
    assert not called and content(spark, parts) == (rows, sequences, made)


def test_one_that_fails_fails_no_other(spark, contigs, tmp_path, monkeypatch):
    folder, insert = str(tmp_path / "out"), decoys.insert_decoys

    def breaking(rows, seed, table):
        if not rows.filter("genome_id = 'b'").isEmpty():
            raise PySparkException("no luck")
        return insert(rows, seed, table)

    with monkeypatch.context() as m:
        m.setattr(decoys, "insert_decoys", breaking)
        got = {r.genome_id: r for r in B.run_batches(contigs, folder).collect()}
    assert got["b"].status == "failed" and "no luck" in got["b"].message and got["a"].status == got["c"].status == "ok"
    assert {r.genome_id: r.status for r in B.run_batches(contigs, folder).collect()}["b"] == "ok"
