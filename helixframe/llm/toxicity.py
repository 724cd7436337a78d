"""A counterfactual-regularised toxicity classifier.

Features are a text's distinct words (lower case, without punctuation at their ends) and the words' first 4 to 6 letters;
those that set toxic documents apart, by a chi-squared statistic over the training rows, are kept (words that clean ones
have more often fit the sample and cost held-out accuracy). A logistic
regression is fitted with a second penalty. Every labelled sentence gives a pair that differs in identity terms alone: its
terms are swapped for others of their kind, and a sentence without one is taken once with each of two terms of a kind,
which also trains the terms' own weights. The difference between a pair's scores is punished, so that a group's mention
alone moves no score.

Training takes at most ``SAMPLE`` labelled rows outside the held-out fold, those with the smallest hash of doc_id, each with one
text; scoring reads every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import in_chunks, materialise, records

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 20_000
FEATURES = 3000
#: Toxic documents that have to hold a feature.
LEAST = 3
PREFIXES = (4, 5, 6)
STRENGTH = 1e-5
COUNTERFACTUAL = 1.0
STEPS = 300
FOLDS = 5

#: Terms for groups of people, each line one kind; a term is swapped for the next of its line.
IDENTITY = """
women men
woman man
girls boys
female male
christians muslims jews hindus buddhists atheists
christian muslim jewish hindu buddhist atheist
black white asian latino arab
blacks whites asians latinos arabs
gay lesbian straight bisexual transgender queer
gays lesbians heterosexuals
disabled blind deaf autistic
immigrants refugees migrants foreigners
immigrant refugee migrant foreigner
african european american mexican chinese indian
frauen männer
muslime christen juden
femmes hommes
musulmans chrétiens juifs
mujeres hombres
musulmanes cristianos judíos
"""
#: Each term's stand-in; the terms in a fixed order, from which sentences without one get theirs.
SWAPS = {a: b for line in IDENTITY.strip().split("\n") for t in [line.split()] for a, b in zip(t, t[1:] + t[:1], strict=True)}
TERMS = sorted(SWAPS)
_EDGES = ".,;:!?\"'()[]{}<>*#%&|$«»„“”…-"


def held_out(doc_id) -> "F.Column":
    """Whether crc32 of the id as text has remainder 0; a null id is in no fold and never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


class Words:
    """The features of texts; what a token gives is kept for a bounded number of tokens."""

    def __init__(self, known: dict[str, int] | None = None, limit: int = 200_000):
        self.known, self.limit, self.seen, self.useful = known, limit, set(), {}

    def learn(self, tokens: set[str]) -> None:
        if len(self.seen) + len(tokens) > self.limit:
            self.seen, self.useful = set(), {}
        self.seen |= tokens
        for token in tokens:
            word = token.strip(_EDGES)
            names = [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) >= n)] if word else []
            value = tuple(names if self.known is None else (self.known[x] for x in names if x in self.known))
            if value:
                self.useful[token] = value

    def of(self, text: str) -> set:
        """The features of a text, names or (with known ones) numbers."""
        tokens = set(text.lower().split())
        if not tokens <= self.seen:
            self.learn(tokens - self.seen if len(self.seen) + len(tokens) <= self.limit else tokens)
        out: set = set()
        for token in self.useful.keys() & tokens if len(self.useful) < len(tokens) else tokens & self.useful.keys():
            out.update(self.useful[token])
        return out


def swapped(text: str) -> str | None:
    """The lower-case text with its identity terms swapped; None if it has none."""
    tokens = text.lower().split()
    bare = [t.strip(_EDGES) for t in tokens]
    if not any(b in SWAPS for b in bare):
        return None
    return " ".join(t.replace(b, SWAPS[b]) if b in SWAPS else t for t, b in zip(tokens, bare, strict=True))


def counterfactual(text: str) -> tuple[str, str, bool]:
    """(a text, the same with other terms, whether terms had to be put in): a term and its stand-in by the text's checksum."""
    other = swapped(text)
    if other is not None:
        return text, other, False
    term = TERMS[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(TERMS)]
    return f"{term} {text}", f"{SWAPS[term]} {text}", True


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold a feature, summed over part of the partition."""
    words, schema = Words(), pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    seen = (Counter(), Counter())

    def out():
        yield from in_chunks(((f, seen[1][f], seen[0][f]) for f in seen[0].keys() | seen[1].keys()), schema, 20_000)

    for text, toxic in records(batches, "text", "toxic"):
        seen[toxic].update(words.of(text))
        if len(seen[0]) + len(seen[1]) > 1_000_000:
            yield from out()
            seen[0].clear()
            seen[1].clear()
    yield from out()


def _vectors(known: dict[str, int]):
    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, schema = Words(known), pa.schema([("toxic", pa.int32()), ("x", pa.list_(pa.int32())), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("put_in", pa.bool_())])

        def rows():
            for text, toxic in records(batches, "text", "toxic"):
                one, other, put_in = counterfactual(text)
                yield toxic, *(sorted(words.of(t)) for t in (text, one, other)), put_in

        yield from in_chunks(rows(), schema)

    return function


@dataclass
class Model:
    known: dict[str, int]
    weights: np.ndarray
    bias: float
    #: The mean squared score change of the training pairs.
    change: float = 0.0

    def score(self, text: str, words: Words) -> float:
        z = self.bias + sum(self.weights[i] for i in words.of(text))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class Sparse:
    """Rows of feature numbers."""

    def __init__(self, rows: list):
        self.n = len(rows)
        self.owner = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.column = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(self.owner) else np.empty(0, np.int64)

    def scores(self, w: np.ndarray) -> np.ndarray:
        z = np.bincount(self.owner, w[self.column], self.n) + w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def back(self, slope: np.ndarray, size: int) -> np.ndarray:
        """The gradient of the weights, the bias last, from that of the rows' logits."""
        out = np.bincount(self.column, slope[self.owner], size)
        out[-1] += slope.sum()
        return out


def objective(w: np.ndarray, x: Sparse, label: np.ndarray, here: Sparse, there: Sparse, strength: float, penalty: float) -> tuple[float, np.ndarray, float]:
    """(loss, its gradient, the mean squared score change of the pairs); w has the bias last.

    The loss is the mean log loss + strength * |weights|^2 + penalty * the mean squared change.
    """
    p = x.scores(w)
    n, m = max(1, x.n), max(1, here.n)
    bare = np.append(w[:-1], 0)
    a, b = here.scores(w), there.scores(w)
    change = float(((a - b) ** 2).sum() / m)
    loss = float(-np.log(np.where(label > 0, p, 1 - p)).sum() / n + strength * (bare**2).sum() + penalty * change)
    slope = 2 * penalty * (a - b) / m
    grad = x.back((p - label) / n, len(w)) + 2 * strength * bare + here.back(slope * a * (1 - a), len(w)) - there.back(slope * b * (1 - b), len(w))
    return loss, grad, change


def train(x: list, label: np.ndarray, pairs: list[tuple[list, list]], n: int, strength: float = STRENGTH, penalty: float = COUNTERFACTUAL, steps: int = STEPS) -> tuple[np.ndarray, float, float]:
    """Weights, bias and the pairs' mean squared score change, by full-batch Adam on ``objective``."""
    w, first, second = np.zeros((3, n + 1))
    rows, here, there = Sparse(x), Sparse([a for a, _ in pairs]), Sparse([b for _, b in pairs])
    for step in range(1, steps + 1):
        _, grad, _ = objective(w, rows, label, here, there, strength, penalty)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w[:n], float(w[n]), objective(w, rows, label, here, there, strength, penalty)[2]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = COUNTERFACTUAL) -> Model:
    """A model from labelled rows outside the held-out fold.

    Rows with a null id or label are not used; of several labels for an id the largest holds, of several texts the first in
    order. Without a row of each label
    the model gives every text the smoothed share of toxic rows.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id")  # at most ``sample`` keys
    rows = materialise(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"))
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return Model({}, np.empty(0), float(np.log((bad + 0.5) / (good + 0.5))) if bad or good else float(np.log(0.1 / 0.9)))
    counts = rows.mapInArrow(_counts, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    a, b = F.col("toxic"), F.col("clean")
    c, d = bad - a, good - b
    chi = (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) + 1)
    best = counts.filter((a >= LEAST) & (a * good > 2 * b * bad)).withColumn("chi", chi.cast("double"))
    best = [r.feature for r in best.orderBy(F.desc("chi"), "feature").limit(FEATURES).collect()]
    kept = set(best)
    index = {f: i for i, f in enumerate(best + [t for t in TERMS if t not in kept])}
    found = rows.mapInArrow(_vectors(index), "toxic int, x array<int>, a array<int>, b array<int>, put_in boolean").collect()  # at most ``sample`` short rows
    more = [r for r in found if r.put_in]
    label = np.array([r.toxic for r in found + more], float)
    weights, bias, change = train([r.x for r in found] + [r.a for r in more], label, [(r.a, r.b) for r in found], len(index), penalty=penalty)
    return Model(index, weights, bias, change)


def _score(model: Model):
    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.known)
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

        def rows():
            for doc_id, text in records(batches, "doc_id", "text"):
                score = model.score(text or "", words)
                yield doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0, score, int(score >= 0.5)

        yield from in_chunks(rows(), schema)

    return function


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Defined cases: a null text counts as empty; empty texts get the score of a text without features. A null doc_id is
    not held out. Repeated rows and doc_ids give a row each. Without labels every score is 0.1, an empty table of documents
    gives an empty result. Only doc_id and text of the documents and doc_id and toxic of the labels are read.
    """
    model = fit(docs, labels, sample)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
