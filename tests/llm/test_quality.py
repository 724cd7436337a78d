import re
from collections import defaultdict

from helixframe.llm import quality as Q


def naive(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


TEXTS = ["", "a b c d e a b c d e", "x " * 30, "one\none\n \n\none two\r\none", "a b c d e f a b c d e f g", "#*$ %&|<> é\x0bü\x0c\xa0z \x85q", "a\n" * 4, "  lead and trail  "]


def test_measures():
    for text in TEXTS:
        assert Q.measures(text) == naive(text), text


def verdicts(rows, limit):
    """kept and words left, by counting the distinct documents of every line in its source."""
    documents = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            documents[s or "", Q.normalised(x)].add(t or "")
    out = []
    for i, t, s in rows:
        t, s = t or "", s or ""
        n = naive(t)
        left = sum(len(naive_words(x)) for x in t.split("\n") if len(documents[s, Q.normalised(x)]) <= limit)
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        out.append((i, *n, failed, not failed and left >= 10 and left >= 0.3 * n[0], left))
    return sorted(out, key=str)


def naive_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def rows_with_boilerplate():
    rows = []
    for i in range(40):
        own = " ".join(f"w{i}x{k}" for k in range(8 + i % 9))
        rows.append((i, f"Accept  all COOKIES {i}\n{own}\nshare this page with friends now please", "a" if i % 2 else None))
    rows += [(100 + i, "accept all cookies 7\nshare this page with friends now please and a few more words", "a") for i in range(30)]
    return rows


def test_line_frequency(spark):
    rows = rows_with_boilerplate()
    got = Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), 5)
    assert sorted(map(tuple, got.collect()), key=str) == verdicts(rows, 5)


def test_boilerplate_of_a_large_host(spark):
    """A line in 1 to 10 % of a large host is removed, however large the host; a large group of copies isn't."""
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(12)).translate(str.maketrans("0123456789", "abcdefghij"))
    rows = [(i, own(i) + ("\nRead more of this every day" if i % 12 == 0 else "") + ("\nSold by the shop" if i % 60 == 0 else ""), "big") for i in range(6000)]
    rows += [(10_000 + i, "\n".join(own(k) for k in range(90_000, 90_003)), "big") for i in range(400)]
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert sorted(map(tuple, got.values()), key=str) == verdicts(rows, Q.LIMIT)
    assert got[0].n_words - got[0].n_left_words == 10 and got[12].n_words - got[12].n_left_words == 6
    assert all(got[10_000 + i].kept and got[10_000 + i].n_left_words == 36 for i in range(400))


def test_one_limit_at_every_size(spark):
    """Whether a line goes depends on its own documents alone, not on how many others its host has."""
    for others in (0, 3000):
        rows = [(i, f"the same line\n{'a' * (i % 5 + 1)} b c d e f g h i j {chr(97 + i)}x", "s") for i in range(22)]
        rows += [(100 + i, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x{chr(97 + k)}" for k in range(11)), "s") for i in range(others)]
        for n, lost in ((20, 0), (21, 3)):
            got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame([r for r in rows if not n <= r[0] < 100], "doc_id long, text string, source string")).collect()}
            assert {got[i].n_words - got[i].n_left_words for i in range(n)} == {lost}


def test_filter_follows_the_verdicts(spark):
    rows = rows_with_boilerplate()
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars long")
    kept = Q.filter_documents(docs, 5).collect()
    assert sorted(r.doc_id for r in kept) == sorted(r[0] for r in verdicts(rows, 5) if r[7])
    assert all(len(r.text) == r.n_chars and "cookies" not in r.text.lower() for r in kept if r.doc_id < 100)


def test_filter_equals_the_rules_line_by_line(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0")).withColumn("key", docs.doc_id)
    documents = defaultdict(set)
    for r in docs.collect():
        for x in r.text.split("\n"):
            documents[r.source, Q.normalised(x)].add(r.text)
    for limit in (1, 20):
        kept = {r.doc_id for r in Q.quality_rules(docs, limit).collect() if r.kept}
        out = Q.filter_documents(docs, limit)
        assert out.dtypes == docs.dtypes
        want = sorted((r.doc_id, "\n".join(x for x in r.text.split("\n") if not Q.normalised(x) or len(documents[r.source, Q.normalised(x)]) <= limit)) for r in docs.collect() if r.doc_id in kept)
        assert sorted((r.doc_id, r.text) for r in out.collect()) == want


def test_messy(messy, empty):
    got = Q.quality_rules(messy).collect()
    assert len(got) == messy.count()
    assert [(r.n_words, r.base_failed, r.kept) for r in got if r.doc_id in (2, 3, 4)] == [(0, True, False)] * 3
    assert all(r.kept for r in got if r.doc_id in (1, 6) or r.doc_id is None and r.n_words)
    kept = Q.filter_documents(messy)
    assert kept.columns == messy.columns and kept.count() == sum(r.kept for r in got)
    assert Q.quality_rules(empty).count() == 0 and Q.filter_documents(empty).count() == 0
