import random

import pytest
from helixframe.functions.alphabet import COMPLEMENT_LETTERS, LETTERS
from helixframe.operators import orfs
from helixframe.operators.orfs import scan


def naive(seq, circular, minlen, starts=("ATG", "GTG", "TTG"), stops=("TAA", "TAG", "TGA")):
    """The scan, one codon at a time."""
    out = []
    n = len(seq)
    for strand in (0, 1):
        s = seq if not strand else seq[::-1].translate(str.maketrans(LETTERS, COMPLEMENT_LETTERS))
        s = s * 2 if circular else s
        mine = []
        for frame in range(3):
            held = [] if circular else [(frame, 5)]
            ends = []
            for at in range(frame, len(s), 3):
                if at + 3 >= len(s):
                    break
                codon = s[at : at + 3]
                if codon in starts:
                    if not held and at >= n:
                        break
                    if at == frame and held:
                        held = []
                    held = [*held, (at, starts.index(codon))]
                elif codon in stops and held:
                    ends.append((held, at + 3, 0))
                    held = []
            if held and not circular:
                ends.append((held, n, 3))
            for held, end, open3 in ends:
                start = held[0][0]
                if held[0][1]:
                    start = next((p for p, k in held[1:] if k == 0 and p - held[0][0] <= 75 and end - p >= minlen), start)
                if minlen <= end - start <= 50_000:
                    mine.append((strand, frame, [p for p, _ in held], [k for _, k in held], start, end, end - start, (5 if held[0][1] == 5 else 0) + open3))
        again = {o[5] - n for o in mine if circular and o[5] > n}
        out += [o for o in mine if o[5] not in again]
    return out


@pytest.mark.parametrize("circular", [False, True])
def test_against_codon_walk(circular):
    rng = random.Random(7)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, *rng.choices(range(13, 600), k=150)]:
        seq = "".join(rng.choices("ACGTN", weights=[5, 5, 5, 5, 0.1], k=n))
        got = [r[:8] for r in scan(seq, circular, 6)]
        assert got == naive(seq, circular, 6), (seq, circular)


@pytest.mark.parametrize(
    ("seq", "circular", "starts", "types", "span", "edge", "forward"),
    [
        ("ATGAAATAGC", False, [0], [0], (0, 9), 0, (1, 9)),
        ("ATGAAATAG", False, [0], [0], (0, 9), 3, (1, 9)),
        ("GTGAAACCCATGAAACCCTAAC", False, [0, 9], [1, 0], (9, 21), 0, (10, 21)),
        ("AAATAGCCCATG", True, [9], [0], (9, 18), 0, (10, 6)),
    ],
)
def test_known_frames(seq, circular, starts, types, span, edge, forward):
    row = next(r for r in scan(seq, circular, 6) if r[0] == 0 and r[1] == 0)
    assert (row[2], row[3], row[4:6], row[7], row[10:12]) == (starts, types, span, edge, forward)


def test_content():
    for r in scan("ATGGGGCCCTAAATGAGGGTAGAAACCCTTT", False, 6):
        nt = r[12]
        assert r[8] == nt.count("G") + nt.count("C") and r[9] == nt[1::3].count("G")
        assert len(nt) == r[6]


def test_complete_only():
    rng = random.Random(3)
    for _ in range(50):
        seq = "".join(rng.choices("ACGT", k=400))
        for r in scan(seq, False, 30, complete_only=True):
            codons = [r[12][i : i + 3] for i in range(0, r[6], 3)]
            assert codons[0] in ("ATG", "GTG", "TTG") and codons[-1] in ("TAA", "TAG", "TGA")
            assert not set(codons[:-1]) & {"TAA", "TAG", "TGA"}


def test_one_scan_for_several_codes(spark):
    rng = random.Random(12)
    rows = [("g", i, bool(i % 2), "".join(rng.choices("ACGTACGTTGAN" if i % 3 else "ATGC", k=rng.choice([80, 400, 901, 1500])))) for i in range(30)]
    contigs = spark.createDataFrame(rows, "genome_id string, contig_id long, circ boolean, seq string")
    codes = ("11", "16", "4")
    for complete_only in (False, True):
        got = orfs.find_orfs_by_code(contigs, codes, 75, ("ATG",), complete_only).collect()
        assert len(got) == len({(r.contig_id, r.strand, r.start, r.end) for r in got})
        for code in codes:
            want = orfs.find_orfs(contigs, 75, code, complete_only=complete_only, only=("ATG",), sequences=True).collect()
            mine = sorted((r.contig_id, r.strand, r.start, r.end, r.len, r.n_gc, r.nt) for r in got if code in r.codes)
            assert mine == sorted((r.contig_id, r.strand, r.start, r.end, r.len, r.n_gc, r.nt) for r in want) and mine
        assert any(len(r.codes) == 3 for r in got) and any(len(r.codes) == 1 for r in got)
