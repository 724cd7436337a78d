"""The start model against a plain version of the same rules."""

import math
import random

import numpy as np
import pytest
from helixframe.operators import networks, orfs, startmodel
from helixframe.plans import gene_finder
from pyspark.sql import functions as F

STARTS = ("ATG", "GTG", "TTG")


def genome(seed, genes=25):
    """Genes with a signal before their starts, and stretches without meaning between them."""
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choices("ACGT", k=n))
    codon = lambda: rng.choice([a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT" if a + b + c not in ("TAA", "TAG", "TGA")])
    out = []
    for _ in range(genes):
        out += ["TAA", draw(rng.randint(40, 90)), "AGGAGG", draw(6), "ATG", *(codon() for _ in range(rng.randint(90, 160))), "TAA"]
    return "".join(out)


def plain_model(seeds, order, most):
    """(log tables, most, uf, df) of seeds (ctx, starts, start, len), by counting one word at a time."""
    counts, bases = {}, dict.fromkeys("ACGT", 0)
    for ctx, starts, start, length, *_ in seeds:
        if length < 300:
            continue
        at = lambda o: 200 + o - starts[0]  # noqa: B023, E731
        places = [(1 if s == start else 2, s) for s in starts[:most] if s >= start]
        places += [(0, o) for o in range(start - 150, start - 3) if ctx[at(o) : at(o) + 3] in STARTS]
        for kind, o in places:
            for k in range(-50, 15 - order):
                word = ctx[at(o) + k : at(o) + k + order + 1]
                counts[kind, k, word] = counts.get((kind, k, word), 0) + 1
                if kind == 0:
                    bases[word[0]] += 1
    logp = lambda kind, k, word: math.log((counts.get((kind, k, word), 0) + 1) / sum(counts.get((kind, k, word[:-1] + b), 0) + 1 for b in "ACGT"))
    a, c, g, t = (bases[b] / sum(bases.values()) for b in "ACGT")
    s, e = a * t * g + g * t * g + t * t * g, t * a * a + t * a * g + t * g * a
    p, total, before, i = s / (s + e), 0.0, 0.0, 0
    while (total := total + (1 - p) * p**i) <= 0.999 and i <= 100:
        before += i * (1 - p) * p**i
        i += 1
    return logp, i + 1, before, i - before


def plain_choice(row, model, order, minlen=90):
    ctx, starts, start, length, end = row
    logp, most, uf, df = model
    scores = []
    for s in starts[:most]:
        sums = [sum(logp(kind, k, ctx[200 + s - starts[0] + k :][: order + 1]) for k in range(-50, 15 - order)) for kind in (0, 1, 2)]
        scores.append(1 / (1 + math.exp(sums[0] - sums[1]) * uf + math.exp(sums[2] - sums[1]) * df))
    j = int(np.argmax(scores))
    new = starts[j] if end - starts[j] >= minlen else start
    return (ctx, starts, new, end - new, end), scores[j]


def test_rounds_against_a_plain_loop(spark):
    contigs = spark.createDataFrame([("g", 1, False, genome(1)), ("h", 1, False, genome(2))], "genome_id string, contig_id long, circ boolean, seq string")
    found = orfs.find_orfs(contigs, 90, context=True).withColumn("i_score", F.when(F.col("len") >= 270, 0.9).otherwise(0.1)).cache()
    model = startmodel.refined_model(found, 90, "11", rounds=4)
    got = {(r.genome_id, r.strand, r.frame, r.end): (r.start, r.r_score) for r in startmodel.rescored(found, model, 90).collect()}
    bounds = {r.genome_id: (r.most, r.uf, r.df) for r in model.collect()}
    moved = 0
    for g in ("g", "h"):
        rows = [r for r in found.collect() if r.genome_id == g]
        seeds = [(r.ctx, r.starts, r.start, r.len, r.end) for r in rows if r.len >= 300 and not r.edge_type and r.i_score > 0.5]
        most = 6
        for order in (0, 1, 2):
            for _ in range(4):
                plain = plain_model(seeds, order, most)
                most = plain[1]
                new = [plain_choice(s, plain, order)[0] for s in seeds]
                same = sum(a[2] == b[2] for a, b in zip(seeds, new, strict=True)) / len(seeds)
                seeds = new
                if same > 0.99:
                    break
        assert bounds[g][0] == plain[1] and np.allclose(bounds[g][1:], plain[2:])
        for r in rows:
            if not r.edge_type:
                want, score = plain_choice((r.ctx, r.starts, r.start, r.len, r.end), plain, 2)
                assert got[g, r.strand, r.frame, r.end][0] == want[2] and math.isclose(got[g, r.strand, r.frame, r.end][1], score, rel_tol=1e-9, abs_tol=1e-300)
                moved += want[2] != r.start
            else:
                assert got[g, r.strand, r.frame, r.end] == (r.start, 0.0)
    assert moved


def test_expected_candidates_and_their_column_form(spark):
    assert startmodel.expected_candidates(0.5) == (10, 0.98046875, 8.01953125)
    rows = [("a", "A", 0.3), ("a", "C", 0.2), ("a", "G", 0.3), ("a", "T", 0.2), ("b", "A", 1.0), ("c", "T", 0.5), ("c", "G", 0.5), ("d", "T", 0.5), ("d", "A", 0.5)]
    got = {r.genome_id: r for r in startmodel.start_odds(spark.createDataFrame(rows, "genome_id string, base string, share double")).collect()}
    assert got["b"].p is None and got["c"].p == 1 and got["d"].p == 0
    for g in "acd":
        want = startmodel.expected_candidates(got[g].p)
        assert got[g].most == want[0] and np.allclose((got[g].uf, got[g].df), want[1:], atol=1e-9)


def test_surroundings(spark):
    seq = genome(3, 2)
    rows = orfs.find_orfs(spark.createDataFrame([("g", 1, True, seq), ("g", 2, False, seq[:150])], "genome_id string, contig_id long, circ boolean, seq string"), 75, context=True, sequences=True)
    rows = rows.withColumn("again", orfs.span(F.col("start"), F.col("end"))).collect()
    assert rows and all(r.again == r.nt and len(r.ctx) == 200 + r.end - r.starts[0] + 15 for r in rows)
    r = next(r for r in rows if r.contig_id == 1 and r.strand == 0)
    assert r.ctx == (seq * 3)[len(seq) + r.starts[0] - 200 : len(seq) + r.end + 15]


def test_coordinates_follow_the_start(spark):
    found = orfs.find_orfs(spark.createDataFrame([("g", 1, c, genome(4, 3)) for c in (True, False)], "genome_id string, contig_id long, circ boolean, seq string"), 90, context=True).withColumn("gc_cont", orfs.gc_content())
    for a, b in zip(found.collect(), gene_finder.refreshed(found).collect(), strict=True):
        assert all(a[c] == b[c] for c in ("start", "len", "n_gc", "n_g2", "rstart", "rend", "gc_cont"))


def test_network_looks_at_the_tail_where_it_has_to(spark):
    class Later(networks.StartNetwork):
        def score(self, windows):
            return np.array([w.count("G") / 65 for w in windows])

    found = orfs.find_orfs(spark.createDataFrame([("g", 1, False, genome(5, 6))], "genome_id string, contig_id long, circ boolean, seq string"), 90, context=True)
    got = networks.best_starts(found, Later([], None, None, []), F.col("len") >= 120).collect()
    assert any(len(r.starts) > 5 for r in got)
    for r in got:
        if r.len < 120:
            assert r.best is None and r.score is None
            continue
        scores = [r.ctx[200 + s - r.starts[0] - 50 : 200 + s - r.starts[0] + 15].count("G") / 65 for s in r.starts]
        used = scores[:5] if max(scores[:5]) >= networks.ENOUGH else scores
        assert r.best == r.starts[int(np.argmax(used))] and math.isclose(r.score, max(used))


def test_stored_start_models(spark, tmp_path):
    from helixframe.operators import models

    def table(order, least=-1.0):
        return np.full(3 * (startmodel.UP + startmodel.DOWN - order) * 4 ** (order + 1), least).tobytes()

    schema = "genome_id string, pwm binary, markov int, most int, uf double, df double"
    sound = [("a", table(0), 0, 3, 0.5, 1.5), ("b", table(2), 2, 4, 1.0, 2.0)]
    startmodel.save_model(spark.createDataFrame(sound, schema), str(tmp_path / "m"))
    assert sorted(map(tuple, startmodel.load_model(spark, str(tmp_path / "m")).collect())) == sorted((g, bytearray(t), *rest) for g, t, *rest in sound)
    for i, odd in enumerate([("c", table(1)[:-8], 1, 3, 0.5, 0.5), ("c", table(1), 4, 3, 0.5, 0.5), ("c", table(1, 0.5), 1, 3, 0.5, 0.5), ("c", table(1, float("nan")), 1, 3, 0.5, 0.5), ("c", None, 1, 3, 0.5, 0.5), ("c", table(1), 1, 0, 0.5, 0.5), sound[0]]):
        startmodel.save_model(spark.createDataFrame([*sound, odd], schema), str(tmp_path / f"m{i}"))
        with pytest.raises(models.BadModel, match=odd[0]):
            startmodel.load_model(spark, str(tmp_path / f"m{i}"))


def test_records():
    from helixframe.operators import features

    got = features.encode_records(["ATGAAACCCGG", "", "NNN"])
    assert got.shape == (3, 189) and got.dtype == np.float32 and not got[1].any()
    assert np.allclose(got[0], features.zcurve("ATGAAACCCGG", False)) and features.encode_records([]).shape == (0, 189)
    for odd in ("ATG", b"ATG", 3, ["ATG", None], [b"ATG"]):
        with pytest.raises(TypeError):
            features.encode_records(odd)
