"""Open reading frames of contigs of any length, chunk by chunk.

A contig is stored as rows of so many bases, each with two bases from either side. For each strand and frame a chunk knows
every stretch between two of its own stops; only the starts before its first stop and after its last one wait for other
chunks. These ends, with how many G and C lie before each start, are merged along the contig by running sums: of stops, so
that all that stands between one stop and the next has one number, and of bases. A circular contig is run through twice, as
a second lap of the same chunks. No task holds a contig; it holds chunks, and the starts of one reading frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.models import kept
from helixframe.operators.orfs import _COMPLEMENT, DIGITS, LONGEST, NEAR, OPEN5, PARTIAL, kinds, refined

#: Bases of a chunk.
SIZE = 1 << 20
CHUNK = ["genome_id", "contig_id", "name", "circ", "contig_len", "at", "before", "bases", "after"]
#: The fields of an ORF, and those of a stretch that is merged with others.
ORF = [("genome_id", pa.string()), ("contig_id", pa.int64()), ("name", pa.string()), ("contig_len", pa.int32()), ("strand", pa.int32()), ("frame", pa.int32()), ("starts", pa.list_(pa.int32())), ("types", pa.list_(pa.int32())), *((n, pa.int32()) for n in ("start", "end", "len", "edge_type", "n_gc", "n_g2", "rstart", "rend"))]
ENDS = [("circ", pa.bool_()), ("place", pa.int64()), ("part", pa.int32()), ("stops", pa.int32()), ("gc", pa.list_(pa.int32())), ("g2", pa.list_(pa.int32())), ("end_gc", pa.int32()), ("end_g2", pa.int32()), ("all_gc", pa.int32()), ("all_g2", pa.int32())]
_SQL = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.list_(pa.int32()): "array<int>"}


def _schema(fields: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"`{n}` {_SQL[t]}" for n, t in fields)


def _batches(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part, strict=True), fields, strict=True)], names=[n for n, _ in fields])
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def cut(contigs: DataFrame, size: int = SIZE) -> DataFrame:
    """CHUNK rows of contigs (genome_id, contig_id, circ, seq and perhaps name): ``bases`` from place ``at`` on, with up to two
    bases on either side, which on a circular contig go on at its other end."""
    if size < 3:
        raise ValueError("a chunk has three bases at least")
    n, at = F.length("seq"), F.col("at")
    name = F.col("name") if "name" in contigs.columns else F.col("contig_id").cast("string")
    rows = contigs.filter(n >= 3).select("genome_id", F.col("contig_id").cast("long").alias("contig_id"), name.alias("name"), F.coalesce("circ", F.lit(False)).alias("circ"), n.alias("contig_len"), "seq")
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("contig_len") - 1, F.lit(size))))
    piece = lambda a, k: F.substring(F.col("seq"), a + 1, k)
    before = F.when(at >= 2, piece(at - 2, F.lit(2))).when(F.col("circ"), piece(F.col("contig_len") - 2, F.lit(2))).otherwise("")
    left = F.col("contig_len") - at - size
    lap = F.when(F.col("circ"), F.substring("seq", 1, 2)).otherwise("")
    after = F.substring(F.concat(F.when(left > 0, piece(at + size, F.lit(2))).otherwise(""), lap), 1, 2)
    return rows.select("genome_id", "contig_id", "name", "circ", "contig_len", at, before.alias("before"), piece(at, F.lit(size)).alias("bases"), after.alias("after"))


def _orf(key: tuple, circ: bool, starts: list[int], types: list[int], gc: list[int], g2: list[int], end: int, end_gc: int, end_g2: int, open3: bool, options: tuple) -> tuple | None:
    """The fields of ORF of a reading frame with these starts, or None if it is none. gc, g2: counts up to each start."""
    minlen, meta, complete_only = options
    genome, contig, name, length, strand, frame = key
    open5 = bool(types) and types[0] == OPEN5
    if complete_only:
        if open3:
            return None
        starts, types, gc, g2 = (x[open5:] for x in (starts, types, gc, g2))
        open5 = False
    if not starts or circ and (starts[0] >= length or open3):
        return None
    start = starts[0] if complete_only else refined(starts, types, end, minlen)
    least = PARTIAL if meta and (open5 or open3) else minlen
    if end - start < least or end - start > LONGEST and not complete_only:
        return None
    i = starts.index(start)
    rstart, rend = (length - end, length - start) if strand else (start, end)
    if circ:
        rstart, rend = rstart + length * (rstart < 0), rend - length * (rend > length)
    return genome, contig, name, length, strand, frame, starts, types, start, end, end - start, 0 if complete_only else 5 * open5 + 3 * open3, end_gc - gc[i], end_g2 - g2[i], rstart + 1, rend


def _stretches(chunk: tuple, kind_of: np.ndarray, options: tuple) -> Iterator[tuple]:
    """Rows of ORF and ENDS: ORFs between two stops of the chunk, and what stands before its first and after its last stop."""
    genome, contig, name, circ, length, at, before, bases, after = chunk
    own = len(bases)
    for strand in (0, 1):
        text = bases + after if not strand else (before + bases)[::-1].translate(_COMPLEMENT)
        codes = DIGITS[np.frombuffer(text.encode("ascii", "replace"), np.uint8)].astype(np.int8)
        wide = codes.astype(np.int16)
        codon = np.where((wide[:-2] < 0) | (wide[1:-1] < 0) | (wide[2:] < 0), -1, 16 * wide[:-2] + 4 * wide[1:-1] + wide[2:])
        kind = kind_of[codon].astype(np.int8)
        gc = np.concatenate([[0], np.cumsum((codes == 1) | (codes == 3), dtype=np.int32)])
        first = at if not strand else length - at - own
        for lap in range(1 + circ):
            origin, total = first + lap * length, length * (1 + circ)
            seen = min(len(kind), max(0, total - 3 + (options[2] and not circ) - origin))
            for frame in range(3):
                at_two = (np.arange(len(codes)) + origin) % 3 == (frame + 1) % 3
                g2 = np.concatenate([[0], np.cumsum((codes == 3) & at_two, dtype=np.int32)])
                place = np.arange((frame - origin) % 3, seen, 3)
                mark = kind[place]
                place, mark = place[mark > -2], mark[mark > -2]
                if origin == 0 and not circ and not (len(place) and place[0] == frame and mark[0] >= 0):
                    place, mark = np.append(frame, place), np.append(np.int8(OPEN5), mark)
                key = genome, contig, name, length, strand, frame
                stops = np.nonzero(mark == -1)[0]
                begins, uptos = np.append(0, stops + 1), np.append(stops, len(place))
                # of those between two stops, the ones that have a start and may be long enough
                far = np.append(place[stops] + 3, 0) - np.append(place, 0)[begins]
                wanted = (uptos > begins) & (far >= (min(options[0], PARTIAL) if options[1] else options[0]))
                wanted[[0, -1]] = True
                for k in np.nonzero(wanted)[0].tolist():
                    stop = int(stops[k]) if k < len(stops) else None
                    i = place[begins[k] : uptos[k]]
                    starts, types = (i + origin).tolist(), mark[begins[k] : uptos[k]].tolist()
                    end = None if stop is None else int(place[stop]) + 3
                    if k and stop is not None:
                        if starts and (found := _orf(key, circ, starts, types, gc[i].tolist(), g2[i].tolist(), end + origin, int(gc[end]), int(g2[end]), False, options)):
                            yield *found, *[None] * len(ENDS)
                    else:
                        last = stop is None
                        yield (
                            *key, starts, types, None, None if last else end + origin, *[None] * 6,
                            circ, origin, int(k > 0), int(not last), gc[i].tolist(), g2[i].tolist(), None if last else int(gc[end]), None if last else int(g2[end]), int(gc[own]) if last else 0, int(g2[own]) if last else 0,
                        )


def find_orfs_in_chunks(chunks: DataFrame, minlen: int = 90, table: str = "11", meta: bool = False, complete_only: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``orfs.find_orfs``, without the bases, of contigs in chunks (CHUNK, of ``cut`` or stored so).

    Unlike there, ``complete_only`` goes across the origin of circular contigs. A genome's contigs have different
    contig_ids. Chunks may be of different sizes of three bases or more and come in any order; all of a contig have to be
    there. Contigs shorter than ``minlen`` have no ORF.
    """
    options, kind_of = (minlen, meta, complete_only), kinds(table, only)
    fields = [*ORF, *ENDS]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = (row for b in batches for i in range(len(b)) for row in zip(*(c.to_pylist() for c in b.slice(i, 1).columns), strict=True))
        yield from _batches((row for chunk in chunks for row in _stretches(chunk, kind_of, options)), fields)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for genome, contig, name, length, strand, frame, circ, marks, end, end_gc, end_g2, open3 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    marks = [m for piece in marks for m in zip(piece["starts"], piece["types"], piece["gc"], piece["g2"], strict=True)]
                    if marks and (found := _orf((genome, contig, name, length, strand, frame), circ, *map(list, zip(*marks, strict=True)), end, end_gc, end_g2, open3, options)):
                        yield (*found, circ)

        yield from _batches(rows(), [*ORF, ("circ", pa.bool_())])

    rows = kept(chunks.filter(F.col("contig_len") >= minlen).select(*CHUNK).mapInArrow(scanned, _schema(fields)))
    group = ["genome_id", "contig_id", "strand", "frame"]
    along = Window.partitionBy(*group).orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.filter("place is not null")
    for name, what in (("island", "stops"), ("gc_before", "all_gc"), ("g2_before", "all_g2")):
        ends = ends.withColumn(name, F.coalesce(F.sum(what).over(along), F.lit(0)).cast("int"))
    plus = lambda values, n: F.transform(values, lambda x: x + F.col(n))
    piece = F.struct("place", "part", "starts", "types", plus("gc", "gc_before").alias("gc"), plus("g2", "g2_before").alias("g2"))
    island = Window.partitionBy(*group, "island")
    last = F.coalesce(F.max("end").over(island), F.col("contig_len"))
    ends = ends.withColumn("first", F.min(F.get("starts", F.lit(0))).over(island)).withColumn("last", last)
    if not complete_only:  # its start can only be a little further on
        ends = ends.filter(F.col("last") - F.col("first") <= LONGEST + NEAR)
    closed = F.max("stops") == 1
    whole = ends.filter("first is not null").groupBy(*group, "island").agg(
        F.first("name").alias("name"), F.first("contig_len").alias("contig_len"), F.first("circ").alias("circ"), F.sort_array(F.collect_list(piece)).alias("marks"), F.first("last").alias("end"),
        F.when(closed, F.max(F.col("end_gc") + F.col("gc_before"))).otherwise(F.max(F.col("gc_before") + F.col("all_gc"))).alias("end_gc"),
        F.when(closed, F.max(F.col("end_g2") + F.col("g2_before"))).otherwise(F.max(F.col("g2_before") + F.col("all_g2"))).alias("end_g2"),
        (~closed).alias("open3"),
    )
    whole = whole.select("genome_id", "contig_id", "name", "contig_len", "strand", "frame", "circ", "marks", "end", "end_gc", "end_g2", "open3").mapInArrow(merged, _schema([*ORF, ("circ", pa.bool_())]))
    # a frame that goes on from the contig's end is met again, without its beginning, in the first lap
    again = Window.partitionBy("genome_id", "contig_id", "strand", F.when(F.col("circ"), F.pmod("end", "contig_len")).otherwise(F.col("end")))
    whole = whole.withColumn("most", F.max("end").over(again)).filter("not circ or end = most")
    names = [n for n, _ in ORF]
    return rows.filter("place is null").select(*names).unionByName(whole.select(*names))


def find_orfs(contigs: DataFrame, minlen: int = 90, size: int = SIZE, **options) -> DataFrame:
    """``find_orfs_in_chunks`` of whole contigs, which are cut up first."""
    return find_orfs_in_chunks(cut(contigs, size), minlen, **options)
