"""``spark.read.format("helix_seq")``: sequence files read in parts by byte range.

A part takes the records whose line begins after a line end in its range, and reads on to the end of its last one. In plain
files the range counts bytes. In gzip files (known by their first bytes) it counts stored bytes, and a part has the members
that begin in its range, found by their first bytes and by being sound to their end; a file of one member is one part's
work. FASTA, GenBank and EMBL are told apart by a file's first line that isn't empty.

Files are read by Arrow's file systems, so a path is local, shared, or in a store that Arrow knows; ``readers.read_contigs``
reads from every store that Spark does.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from helixframe.operators import ordered
from helixframe.sources.readers import InvalidSequenceFile, _fasta, _flat, topology

NAME = "helix_seq"
SCHEMA = "file string, part long, place int, name string, circ boolean, seq string, len int"
_ARROW = pa.schema([("file", pa.string()), ("part", pa.int64()), ("place", pa.int32()), ("name", pa.string()), ("circ", pa.bool_()), ("seq", pa.string()), ("len", pa.int32())])
#: Bytes of a part; bytes read at once; bytes and records of an Arrow batch.
PART, BLOCK, BATCH_BYTES, BATCH_ROWS = 64 << 20, 1 << 20, 8 << 20, 1000
_MEMBER = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")


@dataclass
class Part(InputPartition):
    """Bytes from ``low`` up to ``high`` of a file."""

    path: str
    low: int
    high: int


@dataclass(frozen=True)
class Kind:
    """How records of a format begin and are read."""

    start: bytes
    records: Callable
    token: Callable[[str], str]


FORMATS = [
    Kind(b">", _fasta, lambda h: h.split(" ")[0]),
    Kind(b"LOCUS", lambda lines: _flat(lines, "LOCUS", "ORIGIN"), lambda h: (h.split() + ["", ""])[1]),
    Kind(b"ID   ", lambda lines: _flat(lines, "ID   ", "SQ   "), lambda h: (h.split() + ["", ""])[1].rstrip(";")),
]


def plain_blocks(file, at: int) -> Iterator[tuple[int | None, int, bytes]]:
    """(None, place, bytes) from a place on."""
    file.seek(at)
    while block := file.read(BLOCK):
        yield None, at, block
        at += len(block)


def member_blocks(file, at: int) -> Iterator[tuple[int | None, int, bytes]]:
    """(member, 0, bytes) of the gzip members from the one at a place on; ``member`` is where one begins."""
    file.seek(at)
    member, inflate, rest, read = at, zlib.decompressobj(31), b"", at
    while True:
        if not rest:
            rest = file.read(BLOCK)
            read += len(rest)
            if not rest:
                if not inflate.eof and read > member:
                    raise EOFError("the last member is cut off")
                return
        out = inflate.decompress(rest, BLOCK * 4)
        if out:
            yield member, 0, out
        rest = inflate.unconsumed_tail or inflate.unused_data
        if inflate.eof:
            if not rest:
                rest = file.read(BLOCK)
                read += len(rest)
            if not rest.startswith(b"\x1f"):  # what follows the last member is no data
                return
            member, inflate = read - len(rest), zlib.decompressobj(31)


def first_member(file, low: int, high: int) -> int | None:
    """Where the first gzip member begins in a range: one that can be read to its end, check sum included."""
    at = low
    while at < high:
        file.seek(at)
        block = file.read(min(BLOCK, high - at) + 3)
        for m in _MEMBER.finditer(block):
            if at + m.start() < high and _sound(file, at + m.start()):
                return at + m.start()
        at += BLOCK
    return None


def _sound(file, at: int) -> bool:
    file.seek(at)
    inflate = zlib.decompressobj(31)
    try:
        while not inflate.eof:
            rest = file.read(BLOCK)
            if not rest:
                return False
            while rest and not inflate.eof:
                inflate.decompress(rest, BLOCK * 4)
                rest = inflate.unconsumed_tail
    except zlib.error:
        return False
    return True


def lines_after(blocks: Iterator[tuple[int | None, int, bytes]], whole: bool) -> Iterator[tuple[int, bytes]]:
    """(where the line end before it is, line); ``whole``: from a file's beginning, else what stands before a line end is left out.

    In a member the line end's place is where the member begins.
    """
    parts, before = [] if whole else None, -1
    for member, at, block in blocks:
        begin = 0
        while (end := block.find(b"\n", begin)) >= 0:
            if parts is not None:
                yield before, b"".join([*parts, block[begin:end]])
            parts, before = [], at + end if member is None else member
            begin = end + 1
        if parts is not None:
            parts.append(block[begin:])
    if parts is not None and (last := b"".join(parts)):
        yield before, last


def _text(line: bytes) -> str:
    return line.decode("utf-8", "replace").rstrip("\r\n")


def kind_of(lines: Iterator[tuple[int, bytes]]) -> Kind:
    top = next((x for _, x in lines if x.strip()), b"")
    for kind in FORMATS:
        if top.startswith(kind.start):
            return kind
    raise InvalidSequenceFile("empty file" if not top else f"unknown first line: {_text(top)[:60]!r}")


def records(file, low: int, high: int, default_circular: bool) -> Iterator[tuple[int, str, bool, str]]:
    """(place, name, circular, sequence) of a range's records, in order."""
    file.seek(0)
    packed = file.read(2) == b"\x1f\x8b"
    blocks = member_blocks if packed else plain_blocks
    kind = kind_of(lines_after(blocks(file, 0), True))
    at = first_member(file, low, high) if packed and low else low
    if at is None:
        return
    lines = lines_after(blocks(file, at), not low)
    lines = itertools.dropwhile(lambda x: not x[1].startswith(kind.start), lines)
    place, group = 0, []
    for before, line in itertools.chain(lines, [(0, None)]):
        if line is None or line.startswith(kind.start):
            if group:
                # a record that isn't the file's last is followed by another one
                for header, seq in itertools.islice(kind.records([*group, *([] if line is None else [_text(kind.start)])]), 1):
                    yield place, kind.token(header), topology(header, default_circular), seq
                    place += 1
            if line is None or before >= high:
                return
            group = []
        group.append(_text(line))


class SequenceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob")
        self.circular = options.get("circular", "false").lower() == "true"
        self.least, self.size = int(options.get("minlen", 0)), int(options.get("partbytes", PART))

    def partitions(self) -> list[Part]:
        import fnmatch

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else "file:"
        files = [f for f in files if not self.glob or fnmatch.fnmatch(f.base_name, self.glob)]
        return [Part(scheme + f.path, low, low + self.size) for f in sorted(files, key=lambda f: f.path) for low in range(0, max(1, f.size), self.size)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        path = partition.path
        system, name = (fs.LocalFileSystem(), path.removeprefix("file:")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
        rows, size = [], 0
        with system.open_input_file(name) as file:
            try:
                for place, token, circular, seq in records(file, partition.low, partition.high, self.circular):
                    if len(seq) < self.least:
                        continue
                    rows.append((path, partition.low, place, token, circular, seq, len(seq)))
                    size += len(seq)
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield _batch(rows)
                        rows, size = [], 0
            except (InvalidSequenceFile, EOFError, zlib.error) as error:
                raise InvalidSequenceFile(f"{path}: {error}") from None
        if rows:
            yield _batch(rows)


class FilteredReader(SequenceReader):
    """Takes filters on ``len``; Spark allows such a reader only where its filter push-down is switched on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("len",):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            else:
                yield f


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class SequenceSource(DataSource):
    """Options: ``glob`` of file names, ``circular`` (the topology where a header names none), ``minlen`` of a record, ``partBytes``, and
    ``pushdown``: filters on ``len`` are passed into the reader, which takes Spark's setting
    ``spark.sql.python.filterPushdown.enabled``. part and place order a file's records.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SequenceReader:
        if "path" not in self.options:
            raise ValueError("a path has to be given")
        options = {k.lower(): v for k, v in self.options.items()}
        return (FilteredReader if options.get("pushdown", "false").lower() == "true" else SequenceReader)(options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SequenceSource)


def read_sequences(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, contig_ord, name, circ, seq), as ``readers.read_contigs`` gives them, by way of the source.

    With ``minlen`` the records that stay are numbered.
    """
    register(spark)
    rows = spark.read.format(NAME).options(**options).load(path)
    numbered = ordered.numbered(rows, ["file"], ["part"], ["place"], "contig_ord")
    return numbered.select("file", F.col("contig_ord").cast("int").alias("contig_ord"), "name", "circ", "seq")
