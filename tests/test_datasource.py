import gzip
import random

import pytest

from helixframe.sources import datasource, readers

FASTA = ">a x circular\r\nACGT\r\nAC*\r\n\r\n>empty\n>b\nacgtn\n>c linear\nAAA\n>last\n"
GENBANK = "\n\nLOCUS       G1 8 bp DNA circular BCT\nDEFINITION LOCUS\nORIGIN\n        1 acgt acgt\n//\nLOCUS       G2 0 bp\nORIGIN\n//\nLOCUS       G3 4 bp\nORIGIN\n 1 ttga\n//\n"
EMBL = "ID   E1; SV 1; circular; DNA\nSQ   Sequence 8 BP;\n     acgtacgt                8\n//\nID   E2; SV 1\nSQ   x\n     ggcc 4\n//\n"


def rows(df):
    return sorted((r.file.split("/")[-1], r.contig_ord, r.name, r.circ, r.seq) for r in df.collect())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("sequences")
    rng = random.Random(2)
    many = "".join(f">r{i} {rng.choice(['circular', 'linear', ''])}\n" + "".join("".join(rng.choices("ACGT", k=rng.randint(0, 70))) + "\n" for _ in range(rng.randint(0, 4))) for i in range(400))
    plain = {"f.fna": FASTA, "g.gb": GENBANK, "e.embl": EMBL, "many.fna": many, "nofinal.fna": ">x\nACGT\n>y\nGG"}
    for name, text in plain.items():
        (path / name).write_bytes(text.encode())
        (path / f"{name}.packed").write_bytes(gzip.compress(text.encode()))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(5))
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        (path / f"{name}.members").write_bytes(b"".join(gzip.compress(x.encode()) for x in pieces))
    lines = many.splitlines(keepends=True)
    (path / "lines.gz").write_bytes(b"".join(gzip.compress("".join(lines[i : i + 7]).encode()) for i in range(0, len(lines), 7)))
    return path


@pytest.mark.parametrize("size", [1, 7, 100, 4096, 1 << 26])
def test_same_rows_as_the_whole_file_reader(spark, folder, size):
    if size < 100:  # a part for every few bytes: the small files alone
        for name in ("f.fna", "g.gb", "e.embl", "nofinal.fna", "f.fna.packed", "g.gb.members", "nofinal.fna.members"):
            assert rows(datasource.read_sequences(spark, str(folder / name), partBytes=size)) == rows(readers.read_contigs(spark, str(folder / name))), name
    else:
        assert rows(datasource.read_sequences(spark, str(folder), partBytes=size)) == rows(readers.read_contigs(spark, str(folder)))


def test_every_split_of_a_file_gives_each_record_once(folder):
    for name in ("f.fna", "many.fna", "lines.gz", "many.fna.members"):
        data = folder / name
        with open(data, "rb") as file:
            whole = [x[1:] for x in datasource.records(file, 0, 1 << 40, False)]
            n, rng = data.stat().st_size, random.Random(1)
            for _ in range(25):
                cuts = [0, *sorted(rng.randint(1, n) for _ in range(rng.randint(1, 9))), n]
                assert [x[1:] for a, b in zip(cuts, cuts[1:], strict=False) if a < b for x in datasource.records(file, a, b, False)] == whole, name


def test_large_files_have_several_parts(spark, folder):
    datasource.register(spark)
    df = spark.read.format("helix_seq").option("partBytes", 5000).load(str(folder / "many.fna"))
    assert df.rdd.getNumPartitions() > 5 and df.count() == 400
    assert spark.read.format("helix_seq").option("partBytes", 2000).load(str(folder / "lines.gz")).select("part").distinct().count() > 3


def test_options(spark, folder):
    datasource.register(spark)
    read = lambda **o: spark.read.format("helix_seq").options(**o).load(str(folder))
    everything = read().cache()
    assert read(minlen=100).count() == everything.filter("len >= 100").count() > 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = read(pushdown="true").filter("len > 99 and circ")
        assert pushed.count() == everything.filter("len > 99 and circ").count() > 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert {r.file.split("/")[-1] for r in read(glob="*.gb").select("file").collect()} == {"g.gb"}
    plain = read(circular="true", glob="nofinal.fna").collect()
    assert len(plain) == 2 and all(r.circ for r in plain)


def test_faults(spark, tmp_path):
    datasource.register(spark)
    for name, raw in (("empty", b""), ("blank", b"\n\n"), ("odd", b"hello\n"), ("cut", gzip.compress(b">a\nACGT\n" * 1000)[:-20])):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(Exception, match=name):
            spark.read.format("helix_seq").load(str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("helix_seq").load(str(tmp_path / "nowhere")).collect()
    (tmp_path / "tail").write_bytes(gzip.compress(b">a\nACGT\n") + b"\0" * 100)
    assert spark.read.format("helix_seq").load(str(tmp_path / "tail")).count() == 1
