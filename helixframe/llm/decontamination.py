"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts become templates: numbers, in digits or words, units after a number and names (words with a capital first letter;
neighbours count as one) turn into typed placeholders, other words into lower case. Windows of ``WINDOW`` template words are
hashed and joined with those of the benchmark; texts that can't hold one are set aside first, as any window holds a run of
``PART`` words that begins at every third word. Windows are compared with their
values too, as a text in capitals shows no names; a window with fewer than ``LITERALS`` words that aren't placeholders says
too little, and is compared with its values alone. An item shorter than a window is one window; one of fewer than ``SHORT``
words is met by documents that consist of it.

For documents that meet an item the slots' values are then read from the text: along each alignment of document and item a
value of the item stands for the value that most of its places have in the document. Windows over a place with another
value, or of a value without a majority, are dropped and the others count, so a question with other numbers or names is
caught, also if some of them coincide or one was edited. Windows of several alignments that follow each other closely are
one chain, so that words put into an item don't hide it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm import common
from helixframe.llm.common import bounded, free_names, materialise, utf8

WINDOW = 8
#: Words of a window that aren't placeholders.
LITERALS = 4
#: Words of the runs that texts are chosen by, one of which begins at every ``STRIDE`` words; WINDOW is PART + STRIDE - 1.
PART, STRIDE = 6, 3
#: Items below this number of words are compared with whole documents.
SHORT = 4
#: An item is met if this share of its windows is found, or so many in one alignment (13 words), or this share of its words
#: in a chain of windows that begin so many words apart at most.
COVERED = 0.5
ALIGNED = 6
CHAINED = 0.75
APART = 16

#: Units of measure and currencies that may follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years mph kmh kb mb gb tb hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar k c f usd eur gbp dollar dollars euro euros pound pounds cent cents percent meter meters metre metres kilometer kilometers mile miles gram grams kilogram kilograms liter liters litre litres degree degrees"
_UNITS = "|".join(sorted(UNITS.split(), key=lambda u: (-len(u), u)))
#: Numbers in words.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()

#: Letters from the private use area: they join a number's or name's parts and mark names and units.
JOIN, NAME, UNIT = "\ue000", "\ue001", "\ue002"
_PLAIN = rf"\p{{L}}\p{{M}}\p{{N}}{JOIN}"
_TOKEN = f"{_PLAIN}{NAME}{UNIT}"
_CAPITAL = r"\p{Lu}(?=[\p{Ll}'’])"
_START = rf"(?<![{_PLAIN}'’])"
_IS_UNIT = rf"(\p{{N}})\x20?((?i:{_UNITS})|%|€|\$|£)(?![\p{{L}}\p{{N}}])"
_NUMBER = "|".join(sorted(NUMBERS, key=lambda w: (-len(w), w)))


def _joined(text: Column) -> Column:
    """The text without this module's letters, and with the parts of numbers joined."""
    out = F.translate(utf8(text), f"#{JOIN}{NAME}{UNIT}", "    ")
    return F.when(out.rlike(r"\p{N}[.,]\p{N}"), F.regexp_replace(out, r"[.,](?=\p{N})(?<=\p{N}.)", JOIN)).otherwise(out)


def marked(text: Column) -> Column:
    """The text with the parts of numbers and names joined and with names and units marked."""
    out = F.regexp_replace(_joined(text), _IS_UNIT, f"$1 {UNIT}$2")
    out = F.regexp_replace(out, rf"{_START}({_CAPITAL})", f"{NAME}$1")
    return F.regexp_replace(out, rf"({NAME}[{_PLAIN}]+)\x20(?={NAME})", f"$1{JOIN}")


def raw_words(text: Column) -> Column:
    """The words of a marked text."""
    return F.array_remove(F.split(text, f"[^{_TOKEN}]+"), "")


def canonical(text: Column) -> Column:
    """The template of a text: its words, as many as ``raw_words``, joined by blanks, with placeholders for its slots."""
    out = _joined(text)
    out = F.when(out.rlike(r"\p{N}"), F.regexp_replace(out, _IS_UNIT, "$1 #u")).otherwise(out)
    out = F.lower(F.regexp_replace(out, rf"{_START}{_CAPITAL}[{_PLAIN}]*+(?:\x20{_CAPITAL}[{_PLAIN}]*+)*+", "#p"))
    out = F.trim(F.regexp_replace(out, f"[^{_PLAIN}#]++", " "))
    return F.regexp_replace(out, rf"(?<![^\x20])(?:\p{{N}}[^\x20]*+|(?=[befhmnostz])(?:{_NUMBER})(?![^\x20]))", "#n")


def words(joined: Column) -> Column:
    return F.array_remove(F.split(joined, " "), "")


def template_words(text: Column) -> Column:
    return words(canonical(text))


def value_words(text: Column) -> Column:
    """The words in lower case, without marks; a unit that is a sign is %."""
    return F.transform(raw_words(marked(text)), lambda w: F.when(w == UNIT, "%").otherwise(F.lower(F.translate(w, f"{NAME}{UNIT}", ""))))


def runs_of(joined: Column, size: int, stride: int = 1) -> Column:
    """The runs of ``size`` words that begin at every ``stride`` words of words joined by blanks, joined likewise."""
    step = r"[^\x20]++\x20?" * stride if stride > 1 else ""
    return F.regexp_extract_all(joined, F.lit(rf"(?<![^\x20])(?=([^\x20]++(?:\x20[^\x20]++){{{size - 1}}})){step}"), F.lit(1))


def _window(words: Column, start: Column, size) -> Column:
    return F.xxhash64(F.array_join(F.slice(words, start, size), " "))


def item_classes(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_items, n_words, template, words): items that differ in their slots' values alone are one class.

    Items of a class have the same places with equal values. The class is named by its smallest item_id; items without a
    word are left out.
    """
    text = F.col("text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), template_words(text).alias("template"), value_words(text).alias("words"))
    slots = F.filter(F.arrays_zip(F.col("template").alias("t"), F.col("words").alias("v")), lambda x: x.t.startswith("#"))
    values = F.transform(slots, lambda x: x.v)
    # a short item, or one of placeholders only, is compared by its values, so these are part of its class
    bare = (F.size("template") < SHORT) | (F.size(F.filter("template", lambda w: ~w.startswith("#"))) < LITERALS)
    items = items.filter(F.size("template") > 0).withColumn("places", F.when(bare, F.transform("words", lambda w: F.xxhash64(w))).otherwise(F.transform(values, lambda v: F.array_position(values, v))))
    order = F.struct(F.col("item_id").isNull(), "item_id", "words")
    classes = items.groupBy("template", "places").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"), F.min_by("words", order).alias("words"))
    return classes.select("item_id", "n_items", F.size("template").alias("n_words"), "template", "words")


def item_windows(classes: DataFrame) -> DataFrame:
    """(cid, n_windows, n_words, size, kind, i, h): kind is template, raw (by values) and whole (documents that consist of it)."""
    size = F.least(F.lit(WINDOW), F.col("n_words"))
    windows = classes.select("cid", "n_words", "template", "words", size.alias("size"), (F.col("n_words") - size + 1).alias("n_windows"))
    windows = windows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n_windows"))))
    literal = F.size(F.filter(F.slice("template", F.col("i"), F.col("size")), lambda w: ~w.startswith("#")))
    by_template = F.when((F.col("n_words") >= SHORT) & (literal >= LITERALS), F.lit("template"))
    by_values = F.when(F.col("n_words") < SHORT, "whole").otherwise("raw")
    windows = windows.withColumn("kind", F.explode(F.array_compact(F.array(by_template, by_values))))
    of = lambda c: _window(F.col(c), F.col("i"), F.col("size"))
    return windows.select("cid", "n_windows", "n_words", "size", "kind", "i", F.when(F.col("kind") == "template", of("template")).otherwise(of("words")).alias("h"))


def _key() -> tuple[Column, ...]:
    return F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(utf8(F.col("text"))).alias("text_hash")


def _near(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text) of the different documents that may hold a window of an item.

    Every text is canonicalised here, once, and nothing but keys of the benchmark's runs is compared with it.
    """
    n = F.col("n_words")
    start = lambda last: F.explode(F.sequence(F.lit(1), last)).alias("i")
    classes = classes.select("n_words", F.explode(F.array("template", "words")).alias("template"))
    parts = classes.filter(n >= WINDOW).select("template", F.lit(PART).alias("size"), start(n - (PART - 1)))
    parts = parts.unionByName(classes.filter(n < WINDOW).select("template", n.alias("size"), F.lit(1).alias("i")))
    parts = materialise(parts.select("size", _window(F.col("template"), F.col("i"), F.col("size")).alias("h")).distinct())
    sizes = {r["size"] for r in parts.select("size").distinct().collect()}  # at most WINDOW rows
    joined = docs.select(*_key(), canonical(F.col("text")).alias("joined"))
    runs = None
    for size in sorted(sizes or {PART}):
        few = joined.filter(F.size(words(F.col("joined"))) == size) if size < SHORT else joined
        found = few.select("doc_id", "text_hash", F.explode(runs_of(F.col("joined"), size, STRIDE if size == PART else 1)).alias("run"))
        if size == PART:  # a last run that the stride doesn't meet is inside no window that the stride doesn't meet
            found = found if not classes.filter(n == PART).take(1) else joined.select("doc_id", "text_hash", F.explode(runs_of(F.col("joined"), size)).alias("run"))
        found = found.select("doc_id", "text_hash", F.xxhash64("run").alias("h")).join(bounded(parts.select("h")), "h", "left_semi")
        runs = found if runs is None else runs.unionByName(found)
    keys = materialise(runs.select("doc_id", "text_hash").distinct())
    return materialise(_semi(docs.select(*_key(), "text"), bounded(keys)).dropDuplicates(["doc_id", "text_hash"]))


def _hits(near: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, cid, n_windows, n_words, size, pos, i, diagonal) of the windows that documents and items share."""
    hits = None
    pairs = {(r.kind, r["size"]) for r in items.select("kind", "size").distinct().collect()}  # at most as many as kinds and sizes
    for kind, size in sorted(pairs or {("template", WINDOW)}):
        joined = canonical(F.col("text")) if kind == "template" else F.array_join(value_words(F.col("text")), " ")
        rows = near.select("doc_id", "text_hash", joined.alias("joined"))
        if kind == "whole":
            rows = rows.filter(F.size(words(F.col("joined"))) == size)
        rows = rows.select("doc_id", "text_hash", F.posexplode(runs_of(F.col("joined"), size)).alias("at", "run"))
        mine = materialise(items.filter((F.col("kind") == kind) & (F.col("size") == size)).drop("kind"))
        rows = rows.select("doc_id", "text_hash", (F.col("at") + 1).alias("pos"), F.xxhash64("run").alias("h")).join(bounded(mine), "h").drop("h")
        hits = rows if hits is None else hits.unionByName(rows)
    return materialise(hits.distinct().withColumn("diagonal", F.col("pos") - F.col("i")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and class of items it meets: doc_id, text_hash, item_id, n_items, n_matched,
    n_windows, n_slots, n_changed.

    ``n_matched`` counts the item's windows found without a conflicting slot, ``n_slots`` the slots under them and
    ``n_changed`` those with another value than the item's. Documents that meet no item have no row. Items that differ in
    their slots' values alone, equal ones included, are one class, named by its smallest item_id.

    Defined cases: null and empty texts and items meet nothing. Repeated rows and doc_ids give a row for each different
    (doc_id, text). A window that a text repeats counts once for an item. A null item_id names its class only if the class
    has no other. An empty table on either side gives an empty result. Other columns are not read.
    """
    classes = materialise(item_classes(benchmark).withColumn("cid", F.monotonically_increasing_id()))
    items = materialise(item_windows(classes))
    near = _near(docs, classes)
    hits = _hits(near, items)

    # values of the slots, for the documents and items that met
    pair = F.arrays_zip(template_words(F.col("text")).alias("t"), value_words(F.col("text")).alias("v"))
    slots = near.select("doc_id", "text_hash", F.posexplode(pair).alias("at", "x")).filter(F.col("x.t").startswith("#"))
    slots = slots.select("doc_id", "text_hash", (F.col("at") + 1).alias("at"), F.col("x.v").alias("value"))
    item_slots = classes.select("cid", F.posexplode(F.arrays_zip(F.col("template").alias("t"), F.col("words").alias("v"))).alias("at", "x")).filter(F.col("x.t").startswith("#"))
    item_slots = item_slots.select("cid", (F.col("at") + 1).alias("k"), F.col("x.v").alias("item_value"))

    lines = ["doc_id", "text_hash", "cid", "diagonal"]
    under = F.explode(F.sequence(F.col("i"), F.col("i") + F.col("size") - 1)).alias("k")
    covered = hits.select(*lines, under).distinct()
    pairs = covered.join(item_slots, ["cid", "k"]).withColumn("at", F.col("k") + F.col("diagonal"))
    pairs = materialise(_inner(pairs, slots, ["doc_id", "text_hash", "at"]))
    counts = pairs.groupBy(*lines, "item_value", "value").agg(F.count("*").alias("n"))
    major = counts.groupBy(*lines, "item_value").agg(F.max_by("value", "n").alias("major"), (2 * F.max("n") > F.sum("n")).alias("clear"))
    bad = _inner(pairs, major, [*lines, "item_value"]).filter((F.col("value") != F.col("major")) | ~F.col("clear"))
    bad = bad.select(*lines, F.explode(F.sequence(F.col("k") - (WINDOW - 1), F.col("k"))).alias("i"))
    short = hits.filter(F.col("size") < WINDOW).select(*lines, "i", "size")  # a short item's only window begins at 1
    bad = bad.unionByName(_inner(short, bad.select(*lines).distinct(), lines).select(*lines, "i")).distinct()
    sound = materialise(_inner(hits.select(*lines, "n_windows", "n_words", "size", "pos", "i").distinct(), bad, [*lines, "i"], "left_anti"))

    seen = _inner(sound.select(*lines, under).distinct(), pairs, [*lines, "k"]).groupBy(*lines).agg(F.count("*").alias("slots"), F.sum((F.col("value") != F.col("item_value")).cast("int")).alias("changed"))
    found = _inner(sound.groupBy(*lines, "n_windows", "n_words").agg(F.collect_set("i").alias("found")), seen, lines, "left")
    met = found.groupBy("doc_id", "text_hash", "cid", "n_windows", "n_words").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).cast("long").alias("n_matched"),
        F.max(F.size("found")).alias("aligned"),
        F.sum(F.coalesce("slots", F.lit(0))).alias("n_slots"),
        F.sum(F.coalesce("changed", F.lit(0))).alias("n_changed"),
    )
    met = _inner(met, chained_words(sound), ["doc_id", "text_hash", "cid"], "left")
    enough = (F.col("n_matched") >= COVERED * F.col("n_windows")) | (F.col("aligned") >= ALIGNED) | (F.col("chained") >= CHAINED * F.col("n_words"))
    met = met.filter(enough).join(classes.select("cid", "item_id", "n_items"), "cid")
    return met.select("doc_id", "text_hash", "item_id", "n_items", "n_matched", F.col("n_windows").cast("long").alias("n_windows"), "n_slots", "n_changed")


def chained_words(sound: DataFrame) -> DataFrame:
    """(doc_id, text_hash, cid, chained): the most words of an item under a chain of windows on several diagonals."""
    keys = ["doc_id", "text_hash", "cid"]
    order = Window.partitionBy(*keys).orderBy("pos", "i")
    cut = F.coalesce(F.col("pos") - F.lag("pos").over(order) > APART, F.lit(True)).cast("int")
    chains = sound.withColumn("cut", cut).withColumn("chain", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("i"), F.col("i") + F.col("size") - 1))))
    return chains.groupBy(*keys, "chain").agg(F.size(words).alias("n")).groupBy(*keys).agg(F.max("n").alias("chained"))


def _inner(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys match."""
    right = right.select(*(F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns))
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(right, condition, how).drop(*(f"_{c}" for c in on))


def _semi(left: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of the left, documents, whose doc_id and text's hash the keys have."""
    own, id_, other = free_names(left, "own_hash", "other_id", "other_hash")
    keys = keys.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(other))
    keyed = left.withColumn(own, F.xxhash64(utf8(F.col("text"))))
    return keyed.join(keys, (F.col(own) == F.col(other)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), how).drop(own)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that meet no benchmark item, with all their columns.

    Defined cases: null and empty texts stay. Of repeated rows all stay or go. Columns of any name and type are handed on.
    An empty table of documents gives an empty result, an empty benchmark leaves all documents.
    """
    found = materialise(decontaminate(docs, benchmark).select("doc_id", "text_hash").distinct())
    return _semi(docs, bounded(found), "left_anti")
