"""N-gram Jaccard self-join by chosen paths.

A text is the set of its five-word shingles (words: lower case, split at white space; a text of one to four words is one
shingle). Each distinct text gets a min-hash embedding of ``COORDINATES`` values. From a run's root, and from every node
that holds more than ``BUCKET`` texts, a text descends to the children (coordinate, value) of the coordinates sampled at
that node, 1 / similarity of them on average; nodes of two to ``BUCKET`` texts are leaves. Two texts at the wanted
similarity share a leaf of a run with a probability that the branching process bounds from below, and as many runs are
made as the target recall needs.

Within a leaf all pairs of embeddings are compared; what might reach the similarity is joined into candidate classes by
one edge per text, so the rows made stay in proportion to the texts. A node that is still too full at the last level, or
of which a part of ``DENSE`` resembles its first text, so that no coordinate would part it, joins all its texts to one
candidate class. What is joined to texts is joined once for each text, however many nodes of however many runs it stands in.
Inside every candidate class the texts are then compared exactly, in blocks of texts of a like size: links
are counted and true classes found from the whole shingle sets. Sets whose sizes differ so far that they can't reach the
similarity never meet. No link between different texts that a run has found is lost, and copies of a text are never expanded
into pairs. As every link counts, n texts that resemble each other take n^2 / 2 comparisons; each is sent to n / ``BLOCK``
tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import MIX, Hashes, batch, bounded, free_names, grouped, in_chunks, materialise, mixed, records, runs, shingle_set, sliced, utf8
from helixframe.llm.graph import components

SIMILARITY = 0.8
SHINGLE = 5
COORDINATES = 64
BUCKET = 256
LEVELS = 4
RECALL = 0.995
DENSE = 0.2
SEED = 20240229
#: Equal coordinates that a pair at the similarity falls short of by chance about once in 2000 cases.
LEAST_EQUAL = (SIMILARITY - 3.3 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDINATES)) * COORDINATES
#: Texts of one side of an exact comparison, about, and their shingles.
BLOCK, BLOCK_SHINGLES = 512, 400_000


def runs_needed(recall: float = RECALL, levels: int = LEVELS) -> int:
    """Runs after which a pair at the similarity has met in a leaf with the wanted probability.

    With Poisson(1) shared children at each level, a pair survives one level with 1 - 1/e, a further one with
    1 - exp(-survival so far); the deepest leaf is the worst case.
    """
    survival = 1.0
    for _ in range(levels):
        survival = 1 - math.exp(-survival)
    return math.ceil(math.log(1 - recall) / math.log(1 - survival))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def embedding(shingles: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 2048):
        out = np.minimum(out, ((shingles[i : i + 2048, None] * factors[0] + factors[1]) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def _embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, factors = Hashes(), _factors()
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int32()), ("sig", pa.binary()), ("sketch", pa.binary())])

    def rows():
        for doc_id, key, text in records(batches, "doc_id", "key", "text"):
            s = shingle_set(text.lower().split(), hashes, SHINGLE)
            sig = embedding(s, factors)
            yield doc_id, key, len(s), sig.tobytes(), sig.astype(np.uint8).tobytes()

    yield from in_chunks(rows(), schema)


def _children(paths: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and paths of the children: at each node a coordinate is sampled with 1 / (similarity * coordinates)."""
    at = mixed(paths[:, None] ^ (np.arange(1, COORDINATES + 1, dtype=np.uint64) * MIX)[None, :])
    row, i = np.nonzero(at < np.uint64(int((1 << 64) / (SIMILARITY * COORDINATES))))
    return row, mixed(at[row, i] + (sigs[row, i].astype(np.uint64) + np.uint64(1)) * MIX)


def _emit(rid: np.ndarray, path: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(path.view(np.int64), pa.int64())], names=["rid", "path"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def _roots(n_runs: int):
    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, sigs = b.column("rid").to_numpy(), _matrix(b.column("sig"))
            for r in range(n_runs):
                row, path = _children(np.full(len(rid), mixed(np.array([SEED + r], np.uint64))[0]), sigs)
                if len(row):
                    yield _emit(rid[row], path)

    return function


def at_texts(places: DataFrame, texts: DataFrame, *names: str) -> DataFrame:
    """The named columns of places (rid, ...) as an array of structs ``places``, with the columns of texts: a row for each text.

    A text of a large group of near copies stands in a node of nearly every run; its embedding is joined once for all of them.
    """
    return places.groupBy("rid").agg(F.collect_list(F.struct(*names)).alias("places")).join(texts, "rid")


def _places(b: pa.RecordBatch) -> tuple[np.ndarray, pa.StructArray]:
    """Row numbers and structs of all places of the batch's texts."""
    return pc.list_parent_indices(b.column("places")).to_numpy(), pc.list_flatten(b.column("places"))


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        text, nodes = _places(b)
        row, path = _children(nodes.field("path").to_numpy().view(np.uint64), _matrix(b.column("sig"))[text])
        if len(row):
            yield _emit(b.column("rid").to_numpy()[text[row]], path)


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest row of its connected component."""
    label = np.arange(len(linked))
    for start in range(len(linked)):
        if label[start] != start:
            continue
        front = np.array([start])
        while len(front):
            reached = np.nonzero(linked[front].any(axis=0) & (label > start))[0]
            label[reached] = start
            front = reached
    return label


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node of a text whether the text's sketch resembles that of the node's first text."""
    for b in sliced(batches):
        text, nodes = _places(b)
        close = (_bytes(b.column("sketch"))[text] == _bytes(nodes.field("hub_sketch"))).sum(axis=1) >= LEAST_EQUAL
        yield pa.RecordBatch.from_arrays([nodes.field("path"), pa.array(b.column("rid").to_numpy()[text]), nodes.field("hub"), pa.array(close.astype("i4"))], names=["path", "rid", "hub", "close"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate edges of each leaf: pairs whose sketches agree as far as chance allows at the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows():
        for _, members in runs(batches, ["gid"], ["rid", "sketch"]):
            if len(members) < 2:
                continue
            sigs = np.frombuffer(b"".join(m[1] for m in members), np.uint8).reshape(len(members), -1)
            if len(members) == 2:
                label = np.array([0, 0 if (sigs[0] == sigs[1]).sum() >= LEAST_EQUAL else 1])
            else:
                label = _forest(np.stack([(sigs == s).sum(axis=1) >= LEAST_EQUAL for s in sigs]))
            for i in np.nonzero(label != np.arange(len(label)))[0]:
                yield members[i][0], members[label[i]][0]

    yield from in_chunks(rows(), schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    schema = pa.schema([("rid", pa.int64()), ("component", pa.int64()), ("bucket", pa.int32()), ("blocks", pa.int32()), ("above", pa.int32()), ("below", pa.int32()), ("n_copies", pa.int64()), ("shingles", pa.binary())])
    yield from in_chunks(((*rest, shingle_set(t.lower().split(), hashes, SHINGLE).tobytes()) for *rest, t in records(batches, *schema.names[:-1], "text")), schema, 256)


def blocks_of(members: DataFrame) -> DataFrame:
    """The members (component, n_shingles, ...) with their bucket of sizes and the number of blocks of it and of its neighbours.

    Sizes of a bucket are within the similarity of each other, so a text has links in its own bucket and the next ones alone.
    """
    bucket = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(1 / SIMILARITY) + 1e-9).cast("int")
    members = members.withColumn("bucket", bucket)
    sizes = members.groupBy("component", "bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    near = [sizes.select("component", (F.col("bucket") + k).alias("bucket"), F.col("blocks").alias(name)) for k, name in ((-1, "above"), (1, "below"))]
    sizes = sizes.join(near[0], ["component", "bucket"], "left").join(near[1], ["component", "bucket"], "left").fillna(0, ["above", "below"])
    return members.join(bounded(materialise(sizes)), ["component", "bucket"])


def tiles(sets: DataFrame) -> DataFrame:
    """A row for each pair of blocks (left, right as struct<bucket, block>) that a text is part of."""
    block = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    sets = sets.withColumn("mine", F.struct("bucket", block.alias("block")))
    others = lambda n, k: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct((F.col("bucket") + k).cast("int").alias("bucket"), i.alias("block")))
    other = F.concat(others(F.col("blocks"), 0), others(F.col("above"), 1), others(F.col("below"), -1))
    sets = sets.withColumn("other", F.explode(other))
    return sets.select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "rid", "n_copies", "shingles")


def _common(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of the left with all of the right (None: with the left).

    A product of 0/1 matrices over the shingles that occur twice at least, taken a slice of columns at a time.
    """
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    owner, column = owner[keep], new[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n, width = len(left), 4096
    out = np.zeros((n, len(right) if right else n), np.float32)
    for lo in range(0, int((count > 1).sum()), width):
        i, j = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[i:j], column[i:j] - lo] = 1
        out += m[:n] @ (m[n:] if right else m).T
    return out


def _reaches(common: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    union = a[:, None] + b[None, :] - common
    return (common > 0) & (common >= similarity * union - 1e-6)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links of a pair of blocks: for each text the documents it links to and one text of its component here."""
    schema = pa.schema([("rid", pa.int64()), ("hub", pa.int64()), ("links", pa.int64())])
    for (_, i, j), members in runs(batches, ["component", "i", "j"], ["side", "rid", "n_copies", "shingles"]):
        if len(members) < 2:
            continue
        members.sort(key=lambda m: (m[0], m[1]))
        sets = [np.frombuffer(m[3], "<u8") for m in members]
        rid, copies = np.array([m[1] for m in members]), np.array([m[2] for m in members])
        size = np.array([len(s) for s in sets], float)
        n = sum(m[0] == 0 for m in members)
        if i == j:
            linked = _reaches(_common(sets, None), size, size, SIMILARITY)
            np.fill_diagonal(linked, False)
        elif 0 < n < len(members):
            part = _reaches(_common(sets[:n], sets[n:]), size[:n], size[n:], SIMILARITY)
            linked = np.zeros((len(sets), len(sets)), bool)
            linked[:n, n:], linked[n:, :n] = part, part.T
        else:
            continue
        found = list(zip(rid.tolist(), rid[_forest(linked)].tolist(), (linked @ copies).tolist(), strict=True))
        if found := [x for x in found if x[2]]:
            yield batch(found, schema)


def candidate_edges(texts: DataFrame, recall: float = RECALL) -> DataFrame:
    """(a, b) of texts (rid, sig, sketch): a forest over what the leaves of all runs hold similar.

    ``sketch`` holds the last byte of each coordinate, enough to compare texts that share a node.
    """
    level = texts.select("rid", "sig").mapInArrow(_roots(runs_needed(recall)), "rid long, path long")
    sigs, sketches, leaves, edges = texts.select("rid", "sig"), texts.select("rid", "sketch"), [], []
    for depth in range(1, LEVELS + 1):
        sizes = level.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        level = materialise(level.join(sizes, "path"))
        leaves.append(level.filter(F.col("n") <= BUCKET).select("path", "rid"))
        full = level.filter(F.col("n") > BUCKET).select("path", "rid")
        if full.isEmpty():
            break
        hubs = full.groupBy("path").agg(F.min("rid").alias("hub"))
        hubs = materialise(hubs.join(sketches.select(F.col("rid").alias("hub"), F.col("sketch").alias("hub_sketch")), "hub"))
        full = at_texts(full.join(bounded(hubs), "path"), sketches, "path", "hub", "hub_sketch")
        full = materialise(full.mapInArrow(_agreement, "path long, rid long, hub long, close int"))
        dense = full.groupBy("path").agg(F.avg("close").alias("part")).withColumn("stays", (F.col("part") >= DENSE) | F.lit(depth == LEVELS))
        full = full.join(bounded(materialise(dense)), "path")
        edges.append(full.filter("stays and rid <> hub").select(F.col("rid").alias("a"), F.col("hub").alias("b")).distinct())
        level = materialise(at_texts(full.filter("not stays"), sigs, "path").mapInArrow(_descend, "rid long, path long"))
    paths = leaves[0]
    for x in leaves[1:]:
        paths = paths.unionByName(x)
    # the runs repeat many leaves; each set of texts is looked at once
    groups = paths.groupBy("path").agg(F.sort_array(F.collect_set("rid")).alias("rids")).groupBy("rids").agg(F.min("path").alias("gid"))
    members = at_texts(groups.select("gid", F.explode("rids").alias("rid")), sketches, "gid").select("rid", "sketch", F.explode("places.gid").alias("gid"))
    out = grouped(members.select("gid", "rid", "sketch"), ["gid"], _sketch, "a long, b long")
    for x in edges:
        out = out.unionByName(x)
    return out


def jaccard_join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id long, n_links long, is_kept boolean, text_key binary (16).

    Documents are linked if their shingle sets have a Jaccard similarity of 0.8 or more; ``n_links`` counts the other
    documents a document is linked to, copies included; ``class_id`` is the smallest doc_id that links connect it with,
    and ``is_kept`` marks one document of each class: that doc_id's first row in the order of text_key (with repeated
    rows, each of the equal rows).

    Defined cases: a null text counts as empty. Texts without a word have no shingle, link to nothing and are each their
    own class. Rows of equal texts link to each other, repeated doc_ids included. A null doc_id is its class's id only
    if the class has no other. An empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    docs = docs.withColumn("key", F.unhex(F.md5("text")))
    rows = materialise(docs.mapInArrow(_embed, "doc_id long, key binary, n_shingles int, sig binary, sketch binary"))
    texts = rows.filter("n_shingles > 0").groupBy("key").agg(F.first("sig").alias("sig"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n_copies"), F.min("doc_id").alias("least"))
    texts = materialise(texts.withColumn("rid", F.monotonically_increasing_id()))

    nodes = components(candidate_edges(texts, recall))
    members = nodes.withColumnRenamed("node", "rid").join(texts.select("rid", "key", "n_copies", "n_shingles"), "rid")
    members = materialise(blocks_of(materialise(members)))
    bodies = docs.select("key", "text").join(bounded(members.select("key")), "key", "left_semi")
    bodies = bodies.groupBy("key").agg(F.first("text").alias("text"))
    members = bodies.join(members, "key").select("rid", "component", "bucket", "blocks", "above", "below", "n_copies", "text")
    sets = members.mapInArrow(_sets, "rid long, component long, bucket int, blocks int, above int, below int, n_copies long, shingles binary")
    found = materialise(grouped(tiles(sets), ["component", "i", "j"], _compare, "rid long, hub long, links long"))

    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = components(found, "rid", "hub").withColumnRenamed("node", "rid")
    known = texts.select("rid", "key", "n_copies", "least").join(classes, "rid", "left").join(links, "rid", "left")
    known = known.withColumn("component", F.coalesce("component", "rid"))
    heads = known.groupBy("component").agg(F.min("least").alias("class_id"), F.min_by("key", F.struct(F.col("least").isNull(), "least", "key")).alias("head"))
    known = known.join(heads, "component").select("key", "class_id", "head", "least", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    out = rows.select("doc_id", "key", "n_shingles").join(known, "key", "left")
    alone = F.col("n_shingles") == 0
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        (alone | ((F.col("key") == F.col("head")) & F.col("doc_id").eqNullSafe(F.col("least")))).alias("is_kept"),
        F.col("key").alias("text_key"),
    )


def keep_one(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The documents of which one stays for each class, with all their columns.

    Of rows that agree in doc_id and text one stays. The documents that go, fewer than those that stay, are taken out by
    an anti-join, so that texts needn't move while the keys of those that go are few.

    Defined cases: texts without a word, null ones too, are alone in their class and stay; a very long text is compared
    whole; rows without a doc_id have their own places in classes; an empty table gives an empty result; columns of any name
    and type are handed on.
    """
    own, id_, key = free_names(docs, "own_key", "other_id", "other_key")
    found = materialise(jaccard_join(docs, recall).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), "is_kept"))
    keyed = docs.withColumn(own, F.unhex(F.md5(utf8(F.col("text")))))
    same = (F.col(own) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_))
    out = keyed.join(bounded(materialise(found.filter("not is_kept").select(id_, key).distinct())), same, "left_anti")
    again = materialise(found.filter("is_kept").groupBy(id_, key).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    if not again.isEmpty():
        again = bounded(again)
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["doc_id", own]))
    return out.drop(own)
