import re

from helixframe.llm import decontamination as D

ITEM = "Natalia sold 48 clips to her friends in April, then Paul Smith sold 24 kg of apples for 3.50 dollars each in May."
PLAIN = "To thbleor theati hein to ertionnt of antion thinhe a ed eringed the, the heen inginan ates erbleouou."


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    b = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): r for r in D.decontaminate(d, b).collect()}


def test_words_keep_in_step(spark):
    texts = [ITEM, PLAIN, "5kg, 3.5 % and 1,000.25 km/h Über Alles; John A. Smith-Jones said: Hello World!", "", "#n 7#p ab", None, " x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(D.raw_words(D.marked(D.F.col("text"))).alias("v"), D.template_words(D.F.col("text")).alias("t"))
    for r in df.collect():
        assert len(r.v) == len(r.t), r
    t = df.first().t
    assert t.count("#n") == 3 and t.count("#u") == 2 and t.count("#p") == 4 and not {"paul", "natalia"} & set(t)


def test_slots(spark):
    changed = ITEM.replace("48", "70").replace("24", "35").replace("Paul Smith", "Maria").replace("kg", "lb").replace("3.50", "2")
    twice = "In all Anna Lee gave 7 coins to a friend, and then the friend gave 7 coins back to Anna Lee who had given them."
    docs = [
        (1, f"Some words first. {ITEM} And after.", "a"),
        (2, f"Unlike it. {changed}", "a"),
        (3, "Natalia went home in April and sold nothing at all to her friends.", "a"),
        (4, PLAIN.upper().replace(".", " !"), "b"),
        (5, twice.replace("7 coins to", "9 coins to").replace("7 coins back", "9 coins back"), "b"),
        (6, twice.replace("7 coins to", "9 coins to"), "b"),
    ]
    got = run(spark, docs, [(10, ITEM, 0), (11, PLAIN, 0), (12, twice, 0)])
    assert set(got) == {(1, 10), (2, 10), (4, 11), (5, 12)}
    assert got[1, 10].n_changed == 0 and got[2, 10].n_changed >= 4 and got[5, 12].n_changed == 2
    assert got[4, 11].n_matched == got[4, 11].n_windows


def test_conflicting_slots_cost_only_their_windows(spark):
    long = "At the old market Tom Reed bought 7 boxes of sweet red cherries in the early morning, carried all of them slowly up the steep hill to his sister, and then sold 7 boxes of them again."
    asked = "In the shop Anna puts 3 red apples and 5 green pears in the big basket near the door, so how many fruits are there?"
    docs = [(1, long.replace("bought 7", "bought 9"), "a"), (2, asked.replace("3 red", "4 red").replace("5 green", "4 green"), "a"), (3, long, "a")]
    got = run(spark, docs, [(10, long, 0), (11, asked, 0)])
    assert set(got) == {(1, 10), (2, 11), (3, 10)}
    assert got[1, 10].n_matched < got[1, 10].n_windows and got[2, 11].n_changed == 2
    assert got[2, 11].n_matched == got[2, 11].n_windows and got[3, 10].n_matched == got[3, 10].n_windows


def test_probes(spark):
    """Short items, numbers in words, names at a sentence's start, coinciding values, inserted words, templated benchmarks."""
    asked = "Anna has 12 red apples in a basket and gives 3 of them to her brother at school."
    long = "the quick survey of every harbour town found that most boats never leave the bay in winter"
    items = [
        (1, "Which river flows through Vienna and Budapest?"),
        (2, asked),
        (3, long),
        (4, "12 + 7 + 3 + 4 = 26"),
        (5, "Paris"),
        (6, "Bob sold 5 old books to a shop and then bought 8 new ones for his mother there."),
        (7, "Eve sold 9 old books to a shop and then bought 2 new ones for his mother there."),
        (8, asked),
        (9, "what is seven plus nine"),
    ]
    put_in = long.split()
    put_in.insert(8, "almost")
    docs = [
        (1, "He asked me: Which river flows through Vienna and Budapest? I did not know."),
        (2, asked.replace("12", "3")),
        (3, asked.replace("12", "twelve")),
        (4, asked.replace("Anna", "Gustav")),
        (5, "So it is written. " + " ".join(put_in) + " as they say."),
        (6, "we know 12 + 7 + 3 + 4 = 26 by heart, they said"),
        (7, "we know 12 + 8 + 3 + 4 = 27 by heart, they said"),
        (8, "Paris."),
        (9, "Paris is a town that many of us know from books and films alone."),
        (10, "Tom sold 4 old books to a shop and then bought 6 new ones for his mother there."),
        (11, "the river that flows through the town is wide and deep in spring"),
        (12, "tell me what is seven plus nine then"),
    ]
    got = run(spark, [(*d, "s") for d in docs], [(*i, 0) for i in items])
    assert set(got) == {(1, 1), (2, 2), (3, 2), (4, 2), (5, 3), (6, 4), (8, 5), (10, 6), (12, 9)}
    assert got[2, 2].n_items == 2 and got[10, 6].n_items == 2 and got[5, 3].n_matched < got[5, 3].n_windows


def test_both_forms_of_the_template_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    t = D.F.col("text")
    words = docs.select(D.template_words(t).alias("t"), D.raw_words(D.marked(t)).alias("v"))
    assert words.filter("size(t) <> size(v)").count() == 0
    pairs = words.select(D.F.explode(D.F.arrays_zip("t", "v")).alias("x"))
    assert pairs.filter((D.F.col("x.t") == "#p") != D.F.col("x.v").startswith(D.NAME)).count() == 0


def test_runs_choose_every_text_with_a_window(spark):
    """Wherever a window of an item begins in a text, the runs at every third word meet one of its runs."""
    item = "aa bb cc dd ee ff gg hh"
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(k)) + f" {item} end") for k in range(12)], "doc_id long, text string")
    classes = D.item_classes(spark.createDataFrame([(1, f"start {item} stop")], "item_id long, text string"))
    assert D._near(docs, classes).count() == 12


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    words = lambda t: re.findall(r"\w+", t.lower())
    want = set()
    tests = {r.item_id: [tuple(w[i : i + 8]) for w in [words(r.text)] for i in range(len(w) - 7)] for r in items.collect()}
    for r in docs.collect():
        w = words(r.text)
        mine = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        want |= {(r.doc_id, k) for k, x in tests.items() if sum(i in mine for i in x) >= 0.5 * len(x)}
    got = {(r.doc_id, r.item_id) for r in D.decontaminate(docs, items).collect()}
    assert got == want and want
    left = D.remove_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - len({i for i, _ in want})


def test_messy(spark, messy, empty):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (None, None), (2, ""), (3, "too short"), (None, "a text without an id that has a few more words than ten in all")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in D.decontaminate(messy, items).collect()), key=str)
    assert got == [(1, 1), (None, None)]
    left = D.remove_contaminated(messy, items)
    assert left.columns == messy.columns and left.count() == messy.count() - 3
    assert D.decontaminate(empty, items).count() == 0
    assert D.decontaminate(messy, items.limit(0)).count() == 0 and D.remove_contaminated(messy, items.limit(0)).count() == messy.count()


def test_without_broadcast(spark, messy, monkeypatch):
    monkeypatch.setattr(D.common, "BROADCAST_BYTES", -1)
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    assert D.remove_contaminated(messy, items).count() == messy.count() - 2


def test_no_python_in_the_plan(spark, messy):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert "Python" not in D.decontaminate(messy, items)._jdf.queryExecution().toString()
