import zlib
from collections import defaultdict

import numpy as np
import pytest
from helixframe.llm import online_packing as O
from helixframe.llm import token_packing as B
from helixframe.llm.tokens import default_vocabulary, document_ids


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_vocabulary())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


ODD = ["", " ", "  a  b ", " x", "x ", "a\n b", "a \n\n b", "\t tab", "a  b c", "it's  we'll 123 45x <|endoftext|> ok", "　 a", "日本語 テスト", "🙂 🙂🙂 a", "a\x1c b\x85 c", "x" * 300 + " y", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", " <|endoftext|>\n\n", "it<|endoftext|>'s", "<|endoftext", "<|<|endoftext|>|>"]


def test_ids(exact):
    for text in ODD:
        assert np.frombuffer(document_ids(text, default_vocabulary()), "<u4").tolist() == exact(text), repr(text)


def test_ids_of_documents(spark, exact):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert np.frombuffer(document_ids(r.text, default_vocabulary()), "<u4").tolist() == exact(r.text)


def whole(pieces, texts, exact, length):
    """Each document's ids come back from its pieces, and sequences have no gap."""
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for x in by_sequence.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))]
        assert sum(n for _, n in x) <= length
    got = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        got[p.doc_id].append((p.start, p.doc_tokens, list(p.ids)))
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(exact(t))
    for i, documents in want.items():
        ids = sum(documents, [])
        assert sorted(x for p in got[i] for x in p[2]) == sorted(ids)
        if len(documents) == 1:
            assert [x for p in sorted(got[i]) for x in p[2]] == ids and {p[1] for p in got[i]} == {len(ids)}
    return by_sequence


def test_online(spark, exact):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    made = whole(O.pack_online(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], exact, 2048)
    used = sum(n for x in made.values() for _, n in x)
    assert used > 0.95 * 2048 * (len(made) - 1)


def test_online_messy(messy, empty, exact):
    texts = [(r.doc_id, r.text) for r in messy.collect()]
    whole(O.pack_online(messy, length=64, most=3).collect(), texts, exact, 64)
    assert O.pack_online(messy, with_ids=False).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert O.pack_online(empty).count() == 0


def test_windows():
    windows = O.Windows(10, 2)
    closed = [x for n in (6, 7, 3, 9, 1, 4) for x in windows.add((0, 0, n))]
    assert [sum(p[2] for p in pieces) for _, pieces in closed] == [10, 10, 10]  # 7+3 fits best, 9+1, 6+4
    assert list(windows.left()) == []
    windows = O.Windows(10, 2)
    closed = [x for n in (6, 8, 7) for x in windows.add((0, 0, n))]
    assert [[p[2] for p in pieces] for _, pieces in closed] == [[8]]  # the fullest goes


def naive_online(lengths, length, most):
    """(pieces of the windows as they close, pieces of those left), by looking at every open window for every piece."""
    open_, closed = [], []
    for i, n in enumerate(lengths):
        fits = [w for w in open_ if w[0] >= n]
        if fits:
            w = min(fits, key=lambda w: (w[0], w[1]))
        else:
            if len(open_) >= most:
                full = min(open_, key=lambda w: (w[0], w[1]))
                open_.remove(full)
                closed.append(full[2])
            w = [length, i, []]
            open_.append(w)
        w[0] -= n
        w[2].append(i)
        if not w[0]:
            open_.remove(w)
            closed.append(w[2])
    return closed, sorted(w[2] for w in open_)


def test_online_against_naive_packing():
    rng = np.random.default_rng(7)
    for most in (1, 2, 5, 40):
        lengths = rng.integers(1, 65, 400).tolist()
        windows = O.Windows(64, most)
        closed = [[p[0] for p in pieces] for i, n in enumerate(lengths) for _, pieces in windows.add((i, 0, n))]
        assert (closed, sorted([p[0] for p in pieces] for _, pieces in windows.left())) == naive_online(lengths, 64, most)


def test_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = rng.integers(1, 64, 200).tolist()
        bins = B.best_fit_decreasing(lengths, 64)
        free, naive = [], []
        for i in sorted(range(200), key=lambda i: -lengths[i]):
            fits = [b for b in range(len(free)) if free[b] >= lengths[i]]
            b = min(fits, key=lambda b: free[b]) if fits else len(free)
            if not fits:
                free.append(64)
                naive.append(0)
            free[b] -= lengths[i]
        assert len(bins) == len(free) and sorted(sum(bins, [])) == list(range(200))
        assert all(sum(lengths[i] for i in b) <= 64 for b in bins)
    assert B.best_fit_decreasing([], 64) == []


def unpacked(rows, length):
    pieces = defaultdict(list)
    for r in rows:
        ids = B.matrix([r.input_ids], length, "<u2")[0]
        assert r.cu_seqlens[-1] == r.n_tokens and r.n_segments == len(r.doc_ids) and r.position_resets == r.cu_seqlens[:-1]
        assert not ids[r.n_tokens :].any()
        positions = B.position_ids(r.cu_seqlens, length)
        assert all(positions[a] == 0 and positions[b - 1] == b - a - 1 for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False))
        for i, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            pieces[i].append((s, ids[a:b].tolist()))
    return pieces


def test_matrices(spark, exact, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    packed = B.pack_best_fit(docs)
    B.write_matrices(packed, str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    pieces = unpacked(rows, 2048)
    for r in docs.collect():
        assert sum((ids for _, ids in sorted(pieces[r.doc_id])), []) == exact(r.text)
    assert sum(r.n_tokens for r in rows) > 0.97 * 2048 * (len(rows) - 1)
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_many_blocks_and_groups(spark, exact):
    """More than 256 blocks in a group, and many groups: ids of sequences don't meet and no token is lost."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), cast(1 + id % 7 AS int)) AS text").repartition(3)
    from pyspark.sql import functions as F

    for block in (100, 5000):
        rows = B.pack_best_fit(docs, length=64, block=block).collect()
        assert len({r.sequence_id for r in rows}) == len(rows)
        pieces = unpacked(rows, 64)
        assert all(sum((ids for _, ids in sorted(pieces[r.doc_id])), []) == exact(r.text) for r in docs.filter(F.col("doc_id") % 50 == 0).collect())
        assert sum(r.n_tokens for r in rows) == sum(len(ids) for p in pieces.values() for _, ids in p)
    second = B._second(64, "<u2", 60)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"grp": [5] * 400, "doc_id": list(range(400)), "start": [0] * 400, "ids": [np.arange(60, dtype="<u2").tobytes()] * 400})
    ids = [x for out in second([batch]) for x in out.column("sequence_id").to_pylist()]
    assert len(set(ids)) == 400  # 400 blocks of one group
    with pytest.raises(Exception, match="doesn't hold"):
        B.pack_best_fit(docs, dtype="<u1").count()


def test_matrices_messy(messy, empty, exact):
    pieces = unpacked(B.pack_best_fit(messy, length=64).collect(), 64)
    want = defaultdict(list)
    for r in messy.collect():
        want[r.doc_id] += exact(r.text)
    assert {i: sorted(x for _, ids in p for x in ids) for i, p in pieces.items()} == {i: sorted(x) for i, x in want.items()}
    assert B.pack_best_fit(empty).count() == 0
