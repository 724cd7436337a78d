import hashlib

from helixframe.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, pos int, n_turns int, h long"


def conversations(turns):
    by = {}
    for n, (c, t, r, x) in enumerate(turns):
        by.setdefault((c is None, n if c is None else c), []).append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    by = {c: tuple((r, x) for _, _, r, _, x in sorted(v)) for c, v in by.items()}
    out = {}
    for c in sorted(by):
        v = by[c]
        if any(len(w) > len(v) and w[: len(v)] == v for w in by.values()):
            continue
        if v not in out:
            out[v] = [None if c[0] else c[1], 0]
        out[v][1] += 1
    return sorted(((c, len(v), n, "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in v)) for v, (c, n) in out.items()), key=str)


def check(spark, turns):
    got = C.format_chats(spark.createDataFrame([(*t, 1, 2, 3) for t in turns], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == conversations(turns)


def test_snapshots(spark):
    talk = [("user", "hello"), ("assistant", "hi"), ("user", "what is 2+2?"), ("assistant", "4"), ("user", "thanks")]
    turns = []
    for c, n in ((1, 1), (2, 3), (3, 5), (4, 5), (5, 2)):
        turns += [(c, k, *talk[k]) for k in range(n)]
    turns += [(6, 0, "user", "hello"), (6, 1, "assistant", "hi!"), (7, 0, "assistant", "hello")]
    check(spark, turns)


def test_messy(spark):
    turns = [(1, 0, "user", None), (1, None, None, "x"), (1, 0, "user", None), (None, 0, "user", "a"), (None, 0, "user", "b"), (2, 3, "user", ""), (2, 3, "user", ""), (3, 1, None, "x"), (4, 9, "user", "y" * 100_000)]
    check(spark, turns)
    check(spark, turns + [(None, 5, "user", "a"), (None, None, None, None), (None, 1, "user", "y" * 100_000), (8, 1, "user", "b"), (8, 2, "user", "c")])
    assert C.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    df = C.format_chats(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    parts = C.prefix_hashes(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    assert "Python" not in parts._jdf.queryExecution().toString()
    assert "Python" not in df._jdf.queryExecution().toString()
