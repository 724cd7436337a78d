import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import re
from collections import defaultdict

import corpus_pipeline as P
from helixframe.llm import secrets
from helixframe.llm.tokens import default_vocabulary
from test_jaccard_join import brute
from test_quality import naive, naive_words

SF = "/root/testdata/sf0.001"


def after_rules(rows):
    """Documents and texts that the quality rules leave, line by line."""
    from helixframe.llm import quality as Q

    seen = defaultdict(set)
    for r in rows:
        for x in r.text.split("\n"):
            if Q.normalised(x):
                seen[r.source, Q.normalised(x)].add(r.text)
    out = {}
    for r in rows:
        n = naive(r.text)
        lines = [x for x in r.text.split("\n") if len(seen[r.source, Q.normalised(x)]) <= Q.LIMIT]
        left = sum(len(naive_words(x)) for x in lines)
        if n[0] >= 10 and 100 * n[4] <= 20 * n[0] and left >= 10 and left >= 0.3 * n[0]:
            out[r.doc_id] = "\n".join(lines)
    return out


def without_items(texts, items):
    words = lambda t: re.findall(r"\w+", t.lower())
    tests = [[tuple(w[i : i + 8]) for i in range(len(w) - 7)] for w in (words(t) for t in items)]
    out = {}
    for i, t in texts.items():
        w = words(t)
        mine = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        if not any(x and sum(g in mine for g in x) >= 0.5 * len(x) for x in tests):
            out[i] = t
    return out


def test_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    texts = after_rules(docs)
    kept = {c for c, _ in brute(list(texts.items())).values()}
    texts = {i: t for i, t in texts.items() if i in kept}
    texts = without_items(texts, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    tokenizer = Tokenizer.from_file(default_vocabulary())
    tokenizer.encode_special_tokens = True
    want = {i: [*tokenizer.encode(secrets.redacted(t), add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces = defaultdict(list)
    for r in P.run(spark, SF).collect():
        pieces[r.doc_id].append((r.start, list(r.ids)))
    assert {i: sum((ids for _, ids in sorted(p)), []) for i, p in pieces.items()} == want


def test_stages_keep_the_columns(spark, messy):
    docs = messy
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        docs = out
    assert {r.doc_id for r in P.STAGES[-1][1](spark, docs, SF).collect()} == {1, 5, 6, None}


def test_empty(spark, empty):
    docs = empty
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
