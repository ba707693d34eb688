"""MinHash near-duplicates with tensored banding.

A document's set holds its distinct 5-word shingles (words [^\\x20\\x09-\\x0D]+, A-Z lower-cased); with fewer words the whole
sequence is its one shingle. Two collections of SIDE keys each are drawn, a key being ROWS minhashes. A table of the
usual banding is replaced by a pair (i, j): its key joins key i of the first collection and key j of the second. So
SIDE * SIDE tables need only 2 * SIDE * ROWS minhashes, about the square root of what that many tables of their own
would. A pair with similarity s meets in some table with probability (1 - (1 - s**ROWS)**SIDE)**2: over 0.9998 at the
limit of 0.75, over 0.999999 at 0.82.

1. Sketches: one pass over the texts gives set sizes, 128-bit digests of the sets and keys.
2. Equal sets are one class, represented by its smallest doc_id; the rest works on classes. A class has a number of its
   own, given when the classes are written, so no two classes can be taken for one.
3. Keys of a collection that only one class has are dropped before pairs of keys are formed.
4. In each table bucket, members are linked with one member (a star, not all pairs), and links are checked on the full
   sets from the texts. This is repeated with other centres for buckets that still hold several components.
5. Between the classes of the buckets that still do, pairs in different components are found by an exact prefix filter
   on their full sets, and checked. So after it every pair of classes that shares a bucket is in one component or
   is known not to be linked; no bucket is capped and no group is paired off with itself. A shingle that many of them
   have is dealt over as many tasks, and only sets of sizes that can be similar meet.

Defined results: a null or empty text, or one without words, has an empty set, is linked with nothing, and is its own
component; a row with a null doc_id is linked with nothing, its component_id is null and it is kept; rows that repeat
(also under one doc_id) have equal sets and so one component; rows that share a doc_id but not their text are documents of
their own, in the component that their text is in; a very long text is shingled in one piece and holds a worker's memory
for its set; an empty table gives an empty table; other columns are not read, and pass through ``one_of_each`` unchanged
whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelake.llm import graph, shared
from gatelake.llm import text as tx

SHINGLE = 5
PERCENT = 75
ROWS = 3
SIDE = 18
#: Rounds of stars before what is left is compared pair by pair.
STARS = 2
#: Rows of a shingle that a task joins in the pairwise round; a shingle of more is dealt over several.
HOT_ROWS = 1024
#: Classes with more than this part of all rows are joined back by a broadcast.
HOT = 1000
#: Logarithm of the ratio of two bands of set sizes, a little over that of the sizes of two sets that can be linked.
BAND = math.log(1.005 * 100 / PERCENT)

_N = 2 * SIDE * ROWS
_random = np.random.Generator(np.random.PCG64(20240607))
_FACTOR = _random.integers(0, 1 << 63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 1 << 63, _N, dtype=np.uint64)
_SLOT = _random.integers(0, 1 << 63, 2 * SIDE, dtype=np.uint64)


def sets_of(data: bytes, bounds: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice."""
    words = tx.Words(data, bounds, tx.SPACED)
    grams, out = words.grams(k), []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(grams[lo : hi - k + 1]))
        elif hi > lo:
            h = words.hashes[lo:hi]
            out.append(tx.mixed((h * tx.FACTORS[: hi - lo]).sum(keepdims=True) + tx.FACTORS[8 + hi - lo]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def keys_of(shingles: np.ndarray) -> np.ndarray:
    """The 2 * SIDE keys of a set: those of the first collection, then those of the second."""
    least = np.full(_N, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 256):
        np.minimum(least, (shingles[lo : lo + 256, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    return tx.mixed((tx.mixed(least).reshape(-1, ROWS) * tx.FACTORS[:ROWS]).sum(axis=1) + _SLOT)


SKETCH = "doc_id long, text_key long, n_shingles long, high long, low long, keys array<long>"


def sketches(docs: DataFrame) -> DataFrame:
    """Set size, digest (``high`` and ``low``, null for an empty set) and keys of every document."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, bounds in tx.slices(batch):
                sizes, highs, lows, keys = [], [], [], []
                for found in sets_of(data, bounds):
                    sizes.append(len(found))
                    digest = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64).tolist() if len(found) else (None, None)
                    highs.append(digest[0])
                    lows.append(digest[1])
                    keys.append(keys_of(found).view(np.int64) if len(found) else [])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(sizes, pa.int64()), pa.array(highs, pa.int64()), pa.array(lows, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=[x.split()[0] for x in SKETCH.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").transform(shared.arrow, run, SKETCH)


def _candidates(classes: DataFrame) -> tuple[DataFrame, str]:
    """(node, left, right): the keys of each collection that another class has too, where both sides have some; and a
    written table. What is joined back to rows of a hot key is written first: Spark splits a join's hot partition only
    where both sides come from a shuffle, and not from an aggregate, and broadcasts a side that is small."""
    keys = classes.select("node", F.posexplode("keys").alias("slot", "key"))
    common = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select("key")
    common, path = shared.written(common, "common-keys")
    side = lambda wanted: F.collect_list(F.when((F.col("slot") < SIDE) == F.lit(wanted), F.col("key")))
    return keys.join(common, "key").groupBy("node").agg(side(True).alias("left"), side(False).alias("right")).where("size(left) > 0 and size(right) > 0"), path


def _tables(candidates: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(bucket, node, root) for every table; without labels each node is its own root."""
    rooted = _rooted(candidates, labels)
    half = rooted.select("node", "root", "right", F.explode("left").alias("l"))
    return half.select("node", "root", "l", F.explode("right").alias("r")).select(F.xxhash64("l", "r").alias("bucket"), "node", "root")


def _rooted(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return nodes.withColumn("root", F.col("node"))
    return nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough, as links (u, v)."""

    def run(batches):
        last, held = None, None
        for batch in batches:
            a = batch.column("a").to_numpy()
            if not len(a):
                continue
            new = np.r_[a[0] != last, a[1:] != a[:-1]]
            firsts = batch.take(pa.array(np.flatnonzero(new)))
            sets_a = [] if new[0] else [held]
            sets_a += [s for _, _, data, bounds in tx.slices(firsts, "text_a") for s in sets_of(data, bounds)]
            group = np.cumsum(new) - int(new[0])
            linked = []
            for lo, _, data, bounds in tx.slices(batch, "text_b"):
                for i, b in enumerate(sets_of(data, bounds), lo):
                    one = sets_a[group[i]]
                    both = len(np.intersect1d(one, b, assume_unique=True))
                    linked.append(100 * both >= PERCENT * (len(one) + len(b) - both) > 0)
            last, held = a[-1], sets_a[-1]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(linked, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.select("a", "b", "text_a", "text_b").transform(shared.arrow, run, "u long, v long")


def _mixed(tables: DataFrame, *more: Column) -> tuple[DataFrame, str]:
    """Buckets that hold several components, written."""
    return shared.written(tables.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), *more).where("low != high").drop("low", "high"), "mixed")


def _star(tables: DataFrame, turn: int) -> tuple[DataFrame, str]:
    """Pairs of one centre of each bucket with the members of other components; and a written table."""
    centre = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("order"), F.col("node").alias("a"), F.col("root").alias("of"))).alias("centre")
    mixed, path = _mixed(tables, centre)
    stars = tables.join(mixed.select("bucket", "centre.a", "centre.of"), "bucket").where("root != of")
    return stars.select("a", F.col("node").alias("b")).distinct(), path


def _across(nodes: DataFrame, labels: DataFrame, texts: DataFrame) -> tuple[DataFrame, list[str]]:
    """Pairs of ``nodes`` in different components that may still be similar enough, none left out; and written tables.

    Shingles are ordered by how many of the nodes have them, rare ones first. Two sets with a similarity at the limit
    share one of the rarest quarter of each, and their first common one leaves enough room behind it in both for the
    overlap that their sizes ask for. A shingle that one node has holds a place and no row. Of the components that share
    a shingle the largest is not joined with itself, so a big group of copies costs its members times the outsiders."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, bounds in tx.slices(batch):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([x.view(np.int64) for x in sets_of(data, bounds)], pa.list_(pa.int64()))], names=["node", "shingles"])

    sets, at_sets = shared.written(texts.join(nodes, "node", "left_semi").select("node", "text").transform(shared.arrow, run, "node long, shingles array<long>"), "sets")
    every = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    spread, at_spread = shared.written(every.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "shingles")
    ranked = every.join(spread, "shingle").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("ranked"))
    alone = F.col("size") - F.size("ranked")
    prefix = F.greatest(F.lit(0), F.floor(F.col("size") * (100 - PERCENT) / 100) + 1 - alone).cast("int")
    rows = ranked.select("node", "size", alone.alias("alone"), F.posexplode(F.slice("ranked", F.lit(1), prefix)).alias("i", "r"))
    rows = _rooted(rows.select("node", "size", (F.col("alone") + F.col("i")).alias("place"), F.col("r.shingle").alias("shingle")), labels)
    rows, at_rows = shared.written(rows, "prefixes")
    by_root = rows.groupBy("shingle", "root").agg(F.count("*").alias("n"), F.min("size").alias("size"))
    top = by_root.groupBy("shingle").agg(F.max_by("root", "n").alias("top"), F.min("size").alias("smallest"), F.sum("n").alias("n"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    top, at_top = shared.written(top, "top-roots")
    return _pairs(rows, top).distinct(), [at_sets, at_spread, at_rows, at_top]


def _pairs(rows: DataFrame, top: DataFrame) -> DataFrame:
    """(a, b): prefix rows (shingle, node, root, size, place) of one shingle joined where neither is in the shingle's largest
    component, or one; sizes and places leave room for the overlap.

    Rows that are joined with others (``outside``) are sent to every cell of a shingle, the others to one cell by hash, so a
    task has about HOT_ROWS of them however common the shingle is. Sizes of similar sets differ by a third at most, so
    they are in one band of sizes or in the next."""
    room = F.col("size") - F.col("place")
    enough = lambda left, a, b: (100 + PERCENT) * left >= PERCENT * (a + b)
    band = lambda size: F.floor(F.ln(size) / F.lit(BAND)).cast("int")
    held = rows.join(top, "shingle").withColumn("room", room).withColumn("cells", F.ceil(F.col("n") / HOT_ROWS).cast("int"))
    outside = held.where(F.col("root") != F.col("top")).where(enough(F.col("room"), F.col("size"), F.col("smallest")))
    near = F.array(*[band(F.col("size")) + i for i in (-1, 0, 1)])
    outside = outside.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).withColumn("band", F.explode(near)).select("shingle", "cell", "band", "node", "root", "size", "room")
    other = held.select("shingle", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int").alias("cell"), band(F.col("size")).alias("band"), F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("size").alias("size_b"), F.col("room").alias("room_b"))
    pairs = outside.join(other, ["shingle", "cell", "band"]).where(F.col("root") != F.col("root_b")).where(enough(F.least("room", "room_b"), F.col("size"), F.col("size_b")))
    return pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, root) of the classes that are linked with another."""
    spark = docs.sparkSession
    found, at_common = _candidates(classes)
    candidates, path = shared.written(found, "candidates")
    paths = [at_common, path]
    owners, path = shared.written(candidates.select("node").join(classes.select("node", "doc_id", "text_key"), "node"), "owners")
    paths.append(path)
    # the class's smallest document; the digest of its text tells apart rows that share a doc_id
    held = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").join(owners.hint("merge"), ["doc_id", "text_key"])
    texts, path = shared.written(held.select("node", "text"), "texts")
    paths.append(path)
    if texts.count() > owners.count():  # rows that repeat
        texts, path = shared.written(texts.dropDuplicates(["node"]), "texts")
        paths.append(path)
    labels = still = at_labels = None
    for turn in range(STARS + 1):
        if turn == 1:  # from here on only buckets that a star has not made one component
            tables = _tables(candidates, labels)
            mixed, at_mixed = _mixed(tables)
            still, path = shared.written(tables.join(mixed, "bucket").select("bucket", "node"), "buckets")
            paths += [at_mixed, path]
        if turn < STARS:
            pairs, path = _star(_rooted(still, labels) if turn else _tables(candidates, None), turn)
            paths.append(path)
        else:
            pairs, more = _across(still.select("node").distinct(), labels, texts)
            paths += more
        new, path = shared.written(_verified(pairs, texts), "verified")
        paths.append(path)
        if labels is not None and new.isEmpty():
            continue
        known = new if labels is None else new.unionByName(labels.select(F.col("node").alias("u"), F.col("root").alias("v")))
        if labels is not None:
            paths.append(at_labels)
        labels, at_labels = shared.written(graph.components(known), "components")
    shared.remove(spark, *paths)
    return labels


def classes_of(table: DataFrame) -> tuple[DataFrame, str]:
    """(node, high, low, n, doc_id, text_key, keys): equal sets as one class each, with a number that no other has, its rows and
    its smallest document; and the written table. The numbers hold once the table is written: it is read, never made again."""
    least = F.min(F.struct("doc_id", "text_key", "keys")).alias("least")
    found = table.where("doc_id is not null and high is not null").groupBy("high", "low").agg(F.count("*").alias("n"), least)
    return shared.written(found.select(F.monotonically_increasing_id().alias("node"), "high", "low", "n", "least.*"), "classes")


def components_of(docs: DataFrame, table: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows of ``table`` (sketches) with the smallest document of their component (``least``: doc_id and text_key), null
    for an empty set or a null doc_id; and written tables."""
    classes, at_classes = classes_of(table)
    roots = links(docs, classes)
    own = classes.select("node", "high", "low", "n", F.struct("doc_id", "text_key").alias("own"))
    named, at_named = shared.written(own.join(roots, "node").select("root", "high", "low", "own"), "named")
    smallest, at_smallest = shared.written(named.groupBy("root").agg(F.min("own").alias("smallest")), "smallest")
    linked = named.join(smallest, "root").select(F.col("high").alias("_h"), F.col("low").alias("_l"), "smallest")
    by_class = own.join(linked, (F.col("high") == F.col("_h")) & (F.col("low") == F.col("_l")), "left").select("high", "low", "n", F.coalesce("smallest", "own").alias("least"))
    by_class, at_by_class = shared.written(by_class, "by-class")
    rows = table.select("doc_id", "text_key", "n_shingles", "high", "low")
    keyed = rows.where("doc_id is not null and high is not null")
    alone = rows.where("doc_id is null or high is null").withColumn("least", F.lit(None).cast(by_class.schema["least"].dataType))
    # classes of more than a HOT-th of all rows are less than HOT, and no row of theirs is shuffled
    least_hot = max(1, table.count() // HOT)
    hot = F.broadcast(by_class.where(F.col("n") > least_hot).drop("n"))
    cold = by_class.where(F.col("n") <= least_hot).drop("n")
    rest = keyed.join(hot.drop("least"), ["high", "low"], "left_anti").join(cold, ["high", "low"])
    every = keyed.join(hot, ["high", "low"]).unionByName(rest).unionByName(alone)
    return every.drop("high", "low"), [at_classes, at_named, at_smallest, at_by_class]


def report(docs: DataFrame) -> DataFrame:
    """A row a document: n_shingles, component_id (the smallest doc_id that links reach) and kept."""
    table, _ = shared.written(sketches(docs), "sketches")
    out, _ = components_of(docs, table)
    component = F.coalesce("least.doc_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id, of repeated rows one."""
    spark = docs.sparkSession
    table, at = shared.written(sketches(docs), "sketches")
    out, paths = components_of(docs, table)
    first = (F.col("least.doc_id") == F.col("doc_id")) & (F.col("least.text_key") == F.col("text_key"))
    found, at_found = shared.written(out.where("least is not null").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), first.alias("first")), "near-dup")
    shared.remove(spark, at, *paths)
    same = lambda rows, others: (rows["doc_id"].cast("long") == others["_doc"]) & (F.xxhash64(rows["text"]) == others["_key"])
    gone = found.where("not first").drop("first")
    left = docs.join(gone, same(docs, gone), "left_anti")
    again, at_again = shared.written(found.where("first").groupBy("_doc", "_key").count().where("count > 1").drop("count"), "again")
    if again.isEmpty():
        shared.remove(spark, at_again)
        return left
    return left.join(again, same(left, again), "left_anti").unionByName(left.join(again, same(left, again), "left_semi").dropDuplicates(["doc_id", "text"]))
