"""Open reading frames of contigs on both strands.

A contig is scanned where it lies: whole-array steps give the stops and starts of a frame and the reading frames between
them, so sequences never move between tasks and only short ORF rows leave the scan.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.alphabet import COMPLEMENT_LETTERS, LETTERS, ORDER, start_codons, stop_codons

#: Nucleotides within which a start that isn't ATG gives way to an ATG; shortest partial ORF in metagenomes; longest ORF.
NEAR, PARTIAL, LONGEST = 75, 60, 50_000
#: Bases of an ORF's surroundings that come with it on demand.
BEFORE, AFTER = 200, 15
#: The start type of a frame that begins before the contig.
OPEN5 = 5

SCHEMA = "genome_id string, contig_id long, name string, contig_len int, strand int, frame int, starts array<int>, types array<int>, start int, end int, len int, edge_type int, n_gc int, n_g2 int, rstart int, rend int, nt string"
_ARROW = pa.schema([("genome_id", pa.string()), ("contig_id", pa.int64()), ("name", pa.string()), ("contig_len", pa.int32()), ("strand", pa.int32()), ("frame", pa.int32()), ("starts", pa.list_(pa.int32())), ("types", pa.list_(pa.int32())), *((n, pa.int32()) for n in ("start", "end", "len", "edge_type", "n_gc", "n_g2", "rstart", "rend")), ("nt", pa.string())])

_COMPLEMENT = str.maketrans(LETTERS, COMPLEMENT_LETTERS)


def _digits() -> np.ndarray:
    table = np.full(256, -1, np.int64)
    for i, b in enumerate(ORDER):
        table[[ord(b), ord(b.lower())]] = i
    table[[ord("U"), ord("u")]] = 0
    return table


DIGITS = _digits()


def address(codon: str) -> int:
    a, b, c = (ORDER.index(x) for x in codon)
    return 16 * a + 4 * b + c


@functools.lru_cache(maxsize=None)
def kinds(table: str, starts: tuple[str, ...] | None = None) -> np.ndarray:
    """By codon address: the start's number, -1 for a stop, -2 for others and, at the end, for ambiguous codons."""
    out = np.full(65, -2)
    starts = starts or tuple(start_codons(table))
    out[[address(c) for c in starts]] = range(len(starts))
    out[[address(c) for c in stop_codons(table)]] = -1
    return out


def _addresses(codes: np.ndarray) -> np.ndarray:
    """Of the codon at each place; -1 if it is ambiguous."""
    return np.where((codes[:-2] < 0) | (codes[1:-1] < 0) | (codes[2:] < 0), -1, 16 * codes[:-2] + 4 * codes[1:-1] + codes[2:]) if len(codes) > 2 else np.empty(0, np.int64)


def _frames(codes: np.ndarray, length: int, circular: bool, table: str, last: bool, only: tuple[str, ...] | None = None, least: int = 0) -> Iterator[tuple[int, list[int], list[int], int, bool]]:
    """(frame, starts, types, end, runs off the end) of every stretch that ends in a stop or, on a linear contig, at its end.

    The codon at the very end is looked at only with ``last``. Stretches shorter than ``least`` from their first start on are
    left out before their starts are listed.
    """
    here = kinds(table, only)[_addresses(codes)][: max(0, len(codes) - 3 + last)]
    rows = -(-len(here) // 3)
    # the codons of a frame stand one behind the other, with a mark of its end behind them
    kind = np.full((3, rows + 1), -2)
    kind[:, rows] = -3
    kind[:, :rows] = np.concatenate([here, np.full(3 * rows - len(here), -2)]).reshape(-1, 3).T
    kind = kind.ravel()
    start_at, stop_at = np.nonzero(kind >= 0)[0], np.nonzero((kind == -1) | (kind == -3))[0]
    start_kind = kind[start_at]
    upto = np.searchsorted(start_at, stop_at)
    before = np.concatenate([[0], upto[:-1]])
    frames = stop_at // (rows + 1)
    off = kind[stop_at] == -3
    places = 3 * (start_at % (rows + 1)) + start_at // (rows + 1)
    ends = np.where(off, length, 3 * (stop_at % (rows + 1)) + frames + 3)
    first = np.append(places, len(codes) + length)[before]  # of the stretch, if it has a start
    wanted = (upto > before) & (ends - first >= least)
    if circular:
        wanted &= (first < length) & ~off
        opens = np.zeros(len(off), bool)
    else:
        opens = np.concatenate([[True], off[:-1]]) & ~((upto > before) & (first == frames))
        wanted = np.where(opens, ends - frames >= least, wanted)
    for i in np.nonzero(wanted)[0].tolist():
        s, k = places[before[i] : upto[i]].tolist(), start_kind[before[i] : upto[i]].tolist()
        if opens[i]:
            s, k = [int(frames[i]), *s], [OPEN5, *k]
        yield int(frames[i]), s, k, int(ends[i]), bool(off[i])


def refined(starts: list[int], types: list[int], end: int, minlen: int) -> int:
    """The first start; if that isn't ATG, the first ATG near it that leaves the least length."""
    if types[0]:
        for s, t in zip(starts[1:], types[1:], strict=True):
            if t == 0 and s - starts[0] <= NEAR and end - s >= minlen:
                return s
    return starts[0]


def _thirds(sums: np.ndarray, start: int, end: int) -> int:
    """What the places start, start + 3, ... before an end have, by running sums over every third place from three before the first on."""
    return int(sums[start + 3 * ((end - start + 2) // 3)] - sums[start])


def scan(seq: str, circular: bool, minlen: int, table: str = "11", meta: bool = False, complete_only: bool = False, only: tuple[str, ...] | None = None) -> Iterator[tuple]:
    """Fields of SCHEMA from strand on, without the nucleotides' wrap being visible."""
    length = len(seq)
    for strand in (0, 1):
        mine = seq if not strand else seq[::-1].translate(_COMPLEMENT)
        text = mine * 2 if circular else mine
        codes = DIGITS[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
        gc = np.concatenate([[0], np.cumsum((codes == 1) | (codes == 3))])
        # the G at every third place up to one, by a place's number plus 3
        g = np.concatenate([np.zeros(3, np.int64), codes == 3, np.zeros(-len(codes) % 3, np.int64)]).reshape(-1, 3).cumsum(axis=0).ravel()
        found = []
        for frame, s, k, end, open3 in _frames(codes, length, circular, table, complete_only, only, min(minlen, PARTIAL) if meta else minlen):
            open5 = k[0] == OPEN5
            if complete_only:
                if open3:
                    continue
                s, k = (s[1:], k[1:]) if open5 else (s, k)
                if not s:
                    continue
            start = s[0] if complete_only else refined(s, k, end, minlen)
            least = PARTIAL if meta and (open5 or open3) else minlen
            if not least <= end - start <= LONGEST and not (complete_only and end - start >= minlen):
                continue
            found.append((frame, s, k, start, end, 0 if complete_only else 5 * open5 + 3 * open3))
        again = {end - length for _, _, _, _, end, _ in found if circular and end > length}
        for frame, s, k, start, end, edge in found:
            if circular and end in again:  # met once more after a lap
                continue
            rstart, rend = (length - end, length - start) if strand else (start, end)
            if circular:
                rstart, rend = rstart + length * (rstart < 0), rend - length * (rend > length)
            yield strand, frame, s, k, start, end, end - start, edge, int(gc[end] - gc[start]), _thirds(g, start + 1, end), rstart + 1, rend, text[start:end]


def find_orfs(contigs: DataFrame, minlen: int = 90, table: str = "11", meta: bool = False, complete_only: bool = False, sequences: bool = False, context: bool = False, only: tuple[str, ...] | None = None, columns: list[str] | None = None) -> DataFrame:
    """ORFs of contigs (genome_id, contig_id, circ, seq and perhaps name); a contig's name and length come with its ORFs.

    start and end are 0-based, half-open and count along the strand; rstart and rend are 1-based, inclusive and forward.
    edge_type: 5 open at the 5' end, 3 at the 3' end, 8 both. ``complete_only`` gives the ORFs from the first start after a
    stop to the next stop of linear sequences, without moving starts. Contigs below ``minlen`` and null sequences give none.
    ``context`` adds ctx, the bases from ``BEFORE`` before the first start to ``AFTER`` behind the end; beyond its ends a
    sequence goes on from its other end. ``only`` names the start codons to use instead of the table's. With ``columns`` only
    these leave the scan.
    """

    schema = _ARROW.append(pa.field("ctx", pa.string())) if context else _ARROW
    names = [n for n in schema.names if n in columns] if columns else schema.names
    kinds_of = dict(x.split() for x in (SCHEMA + ", ctx string").split(", "))

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for genome, contig, name, circ, seq in zip(*(b.column(c).to_pylist() for c in ("genome_id", "contig_id", "name", "circ", "seq")), strict=True):
                laps = {}
                if seq is None or len(seq) < minlen:
                    continue
                for row in scan(seq, bool(circ) and not complete_only, minlen, table, meta, complete_only, only):
                    found = (genome, contig, name, len(seq), *(row if sequences else row[:-1] + (None,)))
                    if context:
                        if row[0] not in laps:
                            laps[row[0]] = around(seq if not row[0] else seq[::-1].translate(_COMPLEMENT))
                        found += (laps[row[0]](row[2][0] - BEFORE, row[5] + AFTER),)
                    rows.append(found)
                    if len(rows) > 2000:
                        yield _batch(rows, schema, names)
                        rows = []
            if rows:
                yield _batch(rows, schema, names)

    # short contigs are left out in the scan: a filter would have Spark make seq once more
    name = F.col("name") if "name" in contigs.columns else F.col("contig_id").cast("string")
    ready = contigs.select("genome_id", F.col("contig_id").cast("long").alias("contig_id"), name.alias("name"), "circ", "seq")
    out = ready.mapInArrow(function, ", ".join(f"{n} {kinds_of[n]}" for n in names))
    return out if sequences else out.drop("nt")


def stop_sets(codes: tuple[str, ...]) -> np.ndarray:
    """By codon address: the set of codes in which it is a stop, as bits, and 0 for ambiguous codons at the end."""
    out = np.zeros(65, np.uint8)
    for bit, code in enumerate(codes):
        out[[address(c) for c in stop_codons(code)]] |= 1 << bit
    return out


def scan_codes(seq: str, minlen: int, codes: tuple[str, ...], only: tuple[str, ...], circular: bool = False, complete_only: bool = False) -> Iterator[tuple]:
    """(strand, start, end, bits, G and C, nucleotides) of the ORFs under several codes, which have the start codons ``only``.

    Codons are looked up once: each has the set of codes that it stops. Along a frame every code waits for its own next
    stop, and an ORF that is the same under several codes comes once, with all their bits.
    """
    length, stops, starts = len(seq), stop_sets(codes), kinds(codes[0], only) >= 0
    for strand in (0, 1):
        mine = seq if not strand else seq[::-1].translate(_COMPLEMENT)
        text = mine * 2 if circular else mine
        digits = DIGITS[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
        gc = np.concatenate([[0], np.cumsum((digits == 1) | (digits == 3))])
        codon = _addresses(digits)
        found: dict[tuple[int, int], int] = {}
        for frame in range(3):
            at = np.arange(frame, max(frame, len(digits) - 3 + complete_only), 3)
            here = codon[at] if len(at) else np.empty(0, np.int64)
            which, is_start = stops[here], starts[here]
            marks = np.nonzero((which > 0) | is_start)[0]
            waits: list[list[tuple[int, int]]] = [[] if circular or complete_only else [(frame, OPEN5)] for _ in codes]
            for place, bits, begins in zip(at[marks].tolist(), which[marks].tolist(), is_start[marks].tolist(), strict=True):
                for bit in range(len(codes)):
                    mine_ = waits[bit]
                    if bits >> bit & 1:
                        _closed(found, mine_, place + 3, bit, minlen, length, circular, complete_only)
                        waits[bit] = []
                    elif begins:
                        if place == frame and mine_ and mine_[0][1] == OPEN5:
                            mine_.clear()
                        mine_.append((place, 0))
            if not circular and not complete_only:
                for bit in range(len(codes)):
                    _closed(found, waits[bit], length, bit, minlen, length, circular, complete_only)
        again = {(end - length, bit) for (_, end), bits in found.items() for bit in range(len(codes)) if circular and end > length and bits >> bit & 1}
        for (start, end), bits in found.items():
            for bit in range(len(codes)):
                if (end, bit) in again:
                    bits &= ~(1 << bit)
            if bits:
                yield strand, start, end, bits, int(gc[end] - gc[start]), text[start:end]


def _closed(found: dict, waits: list[tuple[int, int]], end: int, bit: int, minlen: int, length: int, circular: bool, complete_only: bool) -> None:
    """Add the ORF from one of a code's starts to an end, if it is long enough."""
    if not waits or circular and waits[0][0] >= length:
        return
    places, types = [p for p, _ in waits], [t for _, t in waits]
    start = places[0] if complete_only else refined(places, types, end, minlen)
    if end - start >= minlen and (complete_only or end - start <= LONGEST):
        found[start, end] = found.get((start, end), 0) | 1 << bit


def find_orfs_by_code(contigs: DataFrame, codes: tuple[str, ...], minlen: int = 90, only: tuple[str, ...] = ("ATG",), complete_only: bool = False) -> DataFrame:
    """(genome_id, contig_id, strand, start, end, len, n_gc, codes array<string>, nt) of contigs, scanned once for several codes.

    For each code these are the ORFs of ``find_orfs`` with its table and the start codons ``only``.
    """
    fields = [("genome_id", pa.string()), ("contig_id", pa.int64()), *((n, pa.int32()) for n in ("strand", "start", "end", "len", "n_gc")), ("codes", pa.list_(pa.string())), ("nt", pa.string())]
    named = [[c for bit, c in enumerate(codes) if bits >> bit & 1] for bits in range(1 << len(codes))]

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for genome, contig, circ, seq in zip(*(b.column(c).to_pylist() for c in ("genome_id", "contig_id", "circ", "seq")), strict=True):
                for strand, start, end, bits, n_gc, nt in scan_codes(seq, minlen, codes, only, bool(circ) and not complete_only, complete_only):
                    rows.append((genome, contig, strand, start, end, end - start, n_gc, named[bits], nt))
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    ready = contigs.filter(F.length("seq") >= minlen).select("genome_id", F.col("contig_id").cast("long").alias("contig_id"), "circ", "seq")
    return ready.mapInArrow(function, "genome_id string, contig_id long, strand int, start int, end int, len int, n_gc int, codes array<string>, nt string")


def around(seq: str):
    """A function that gives the bases from one place to another of a sequence that goes on from its other end."""
    before = BEFORE // len(seq) + 1
    text = seq * (before + 3 + AFTER // len(seq))
    return lambda a, b: text[before * len(seq) + a : before * len(seq) + b]


def _batch(rows: list[tuple], schema: pa.Schema, names: list[str]) -> pa.RecordBatch:
    columns = [(c, f) for c, f in zip(zip(*rows, strict=True), schema, strict=True) if f.name in names]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], names=names)


def gc_content() -> Column:
    return F.col("n_gc") / F.col("len")


def g2_content() -> Column:
    return F.col("n_g2") * 3 / F.col("len")


def seeds(orfs: DataFrame, min_len: int = 550, high_gc: float = 0.57, gc: Column | None = None) -> DataFrame:
    """Trusted ORFs: long ones, and with high G+C, the ORF's own or ``gc``, those with few G at codon position 2."""
    gc = gc_content() if gc is None else gc
    return orfs.filter((F.col("len") >= min_len) & ((gc <= high_gc) | (g2_content() < 0.2 * gc + 0.12)))


def span(start: Column, end: Column) -> Column:
    """The bases of an ORF from a start on, from its ctx and starts."""
    return F.substring(F.col("ctx"), start - F.get("starts", F.lit(0)) + BEFORE + 1, end - start)
