"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles; documents with equal sets are one class from the
start. A class is known by its min-hashes, samples of its shingles. In each run all classes walk down
a tree: a node chooses, by a hash of the path to it, one or two of the sampled places (five of four
on average, one over the least similarity), and classes that have the same shingle at a chosen place
go on to the same child. So two sets of the least similarity share, on average, one child of each
node that they share. A small node is a leaf; a larger one splits again, unless most of its classes
agree, as groups of near copies do: further splits would only repeat it.

Leaves are compared by brute force, exactly, on the shingles themselves. A pair counts in the first
leaf that its two classes share. Leaves that stay large are cut into blocks, and pairs of blocks are
compared by tasks of their own. A task returns a row for each class, its number of new links and the
least class it is linked to, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm import words
from evigraph.llm.common import checkpointed, release_shuffles, ship, small
from evigraph.llm.components import components

ship(__name__)

WIDTH = 5
#: Min-hashes of a class, the places that nodes choose from, and the share of nodes that choose two.
PLACES, SECOND = 64, 4
#: Classes a node may have before it splits; classes, and shingles in all, of a block of a leaf that stays larger.
LEAF, BLOCK, BLOCK_SHINGLES = 512, 2048, 1 << 20
#: A node is not split further if one of its children has at least this share of it.
AGREE = 0.8
#: Pairs whose shingles are compared at a time, and shingles that are hashed at a time.
PAIRS, HASHED = 1 << 14, 1 << 16
#: Bits of a leaf's number below its run, and bits of the run.
RUN_BITS, RUN_LIMIT = 57, 6


def lost_in_run(agreeing: float, depth: int) -> float:
    """Probability that one run loses a pair of which this share of the places agrees, were all leaves at the greatest depth.

    q(0) = 0, and q(k) is the chance that no chosen place leads both sets to one child in which they
    are not lost later on.
    """
    q = 0.0
    for _ in range(depth):
        parted = 1 - agreeing + agreeing * q
        q = ((SECOND - 1) * parted + parted**2) / SECOND
    return q


def recall_of(similarity: float, runs: int, depth: int) -> float:
    """Probability that any of some runs finds a pair of this similarity.

    All runs choose from the same places, of which a number that is binomially distributed agrees.
    """
    chance = [math.comb(PLACES, k) * similarity**k * (1 - similarity) ** (PLACES - k) for k in range(PLACES + 1)]
    return sum(c * (1 - lost_in_run(k / PLACES, depth) ** runs) for k, c in enumerate(chance))


def runs_needed(similarity: float, recall: float, depth: int) -> int:
    """Runs after which a pair of this similarity is found with probability recall, were all leaves at the greatest depth."""
    for runs in range(1, 1 << RUN_LIMIT):
        if recall_of(similarity, runs, depth) >= recall:
            return runs
    raise ValueError("a recall beyond what these places and runs can give")


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; of fewer words one for all, of none none."""
    for _, h, ends in words.word_hashes(texts):
        n = max(0, len(h) - width + 1)
        grams = np.full(n, width, np.uint64)
        for k in range(width):
            grams = words.mixed(grams * np.uint64(words.BASE) + h[k : k + n])
        for a, b in zip(ends, ends[1:]):
            if b - a >= width:
                yield distinct(grams[a : b - width + 1])
            else:
                short = np.full(1, b - a, np.uint64)
                for w in h[a:b]:
                    short = words.mixed(short * np.uint64(words.BASE) + w)
                yield short if b > a else short[:0]


def class_key(shingles: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(shingles.tobytes())


def signatures(sets: list[np.ndarray], multipliers: np.ndarray) -> np.ndarray:
    """Sets (none empty) by min-hashes; of a min-hash 32 bits are kept."""
    whole = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    return np.stack([np.minimum.reduceat(whole * m, starts) >> np.uint64(32) for m in multipliers], 1).astype(np.uint32).view(np.int32)


def signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: doc_id, text_hash, text to doc_id, text_hash, key, n (shingles), places."""
    multipliers = words.mixed(np.arange(1, PLACES + 1, dtype=np.uint64)) | np.uint64(1)
    for batch in batches:
        keys, sizes, places, wait = [], [], [None] * batch.num_rows, []

        def sign():
            if wait:
                for i, x in zip([i for i, _ in wait], signatures([s for _, s in wait], multipliers)):
                    places[i] = x
                wait.clear()

        held = 0
        for i, s in enumerate(shingle_sets(batch.column("text"))):
            keys.append(class_key(s) if len(s) else None)
            sizes.append(len(s))
            if len(s):
                wait.append((i, s))
                held += len(s)
            if held >= HASHED:
                sign()
                held = 0
        sign()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "text_hash", "key", "n", "places"])


def bits(sets: list[np.ndarray]) -> np.ndarray:
    """Bit matrix, sets by those members that at least two of them have."""
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    out = np.zeros((len(sets), (int(shared.sum()) + 63) // 64), np.uint64)
    at = 0
    for row, s in zip(out, sets):
        c = column[at : at + len(s)]
        at += len(s)
        p = place[c[shared[c]]]
        np.bitwise_or.at(row, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
    return out


class Cell:
    """Classes of one pair of blocks of a leaf, in order of their keys."""

    def __init__(self, rows: list[dict], similarity: float):
        self.rows, self.similarity = rows, similarity
        self.size = np.array([len(r["shingles"]) // 8 for r in rows])
        self.copies = np.array([r["copies"] for r in rows], np.int64)
        self.block = np.array([r["block"] for r in rows])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of documents newly linked to each class, and the first class of its part."""
        n, leaf, shingles, earlier = len(self.rows), self.rows[0]["leaf"], None, None
        links, root = np.zeros(n, np.int64), np.arange(n)
        same_block = self.rows[0]["left"] == self.rows[0]["right"]
        for i in range(n - 1):
            other = np.arange(i + 1, n)
            if not same_block:
                other = other[self.block[i + 1 :] != self.block[i]]
            a, b = self.size[i], self.size[other]
            other = other[np.minimum(a, b) >= self.similarity * np.maximum(a, b) - 1e-9]
            if not len(other):
                continue
            if earlier is None:
                earlier = bits([np.array([x for x in r["leaves"] if x < leaf], np.int64) for r in self.rows])
            other = other[~(earlier[i] & earlier[other]).any(1)]
            if not len(other):
                continue
            if shingles is None:
                shingles = bits([np.frombuffer(r["shingles"], np.uint64) for r in self.rows])
            common = np.concatenate([np.bitwise_count(shingles[i] & shingles[other[k : k + PAIRS]]).sum(1, dtype=np.int64) for k in range(0, len(other), PAIRS)])
            # s = c / (a + b - c), in whole numbers up to the threshold itself
            near = other[common >= self.similarity * (a + self.size[other] - common) - 1e-9]
            links[i] += self.copies[near].sum()
            links[near] += self.copies[i]
            if len(near):
                parts = np.unique(np.append(root[near], root[i]))
                root[np.isin(root, parts)] = parts[0]
        return links, root


def comparer(similarity: float):
    """For mapInArrow: rows sorted by leaf, left, right, key to key, links, root of each class with new links.

    Rows come with a text of the class, which takes less to ship than its shingles, which are made here.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def done():
            links, root = Cell(rows, similarity).links()
            some = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array([rows[i]["key"] for i in some], pa.binary()), pa.array(links[some]), pa.array([rows[i]["key"] for i in root[some]], pa.binary())], names=["key", "links", "root"])

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = shingle_sets(part.column("text"))
                for row, shingles in zip(part.drop_columns(["text"]).to_pylist(), sets):
                    row["shingles"] = shingles.tobytes()
                    at = (row["leaf"], row["left"], row["right"])
                    if at != cell and rows:
                        yield done()
                        rows = []
                    cell = at
                    rows.append(row)
        if rows:
            yield done()

    return compare


def children(run: Column, at: Column, places: Column) -> Column:
    """Array of the one or two children to which a class goes on from a node."""
    chosen = [F.pmod(F.xxhash64(F.lit(k), run, at), F.lit(PLACES)).cast("int") for k in (1, 2)]
    child = [F.xxhash64(run, at, c, F.get(places, c)) for c in chosen]
    return F.when(F.pmod(F.xxhash64(F.lit(3), run, at), F.lit(SECOND)) == 0, F.array_distinct(F.array(*child))).otherwise(F.array(child[0]))


def leaf_number(at: Column) -> Column:
    """Numbers leaves so that those of earlier runs come first."""
    return F.shiftleft(F.col("run").cast("bigint"), RUN_BITS).bitwiseOR(F.shiftrightunsigned(at, 64 - RUN_BITS))


def tree_leaves(classes: DataFrame, runs: int, depth: int) -> DataFrame:
    """(key, run, leaf, members, shingles): the leaves of all runs in which a class is not alone."""
    count = [F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")]
    start = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(0).cast("bigint").alias("at")) for r in range(runs)])
    rows = classes.select("key", "n", F.inline(F.transform(start, lambda x: F.struct(x["run"].alias("run"), children(x["run"], x["at"], F.col("places")).alias("at")))))
    rows = rows.select("key", "n", "run", F.explode("at").alias("at"))
    # tables of nodes are stored before they are joined, as only then a node with many classes can be split between tasks
    sizes = checkpointed(rows.groupBy("run", "at").agg(*count).filter(F.col("members") > 1))
    rows, leaves = checkpointed(rows.join(sizes, ["run", "at"])), []
    as_leaf = ["key", "run", leaf_number(F.col("at")).alias("leaf"), "members", "shingles"]
    for _ in range(depth - 1):
        leaves.append(rows.filter(F.col("members") <= LEAF).select(*as_leaf))
        large = rows.filter(F.col("members") > LEAF)
        if large.isEmpty():
            return _union(leaves)
        down = large.join(classes.select("key", "places"), "key").select("key", "n", "run", "at", "members", "shingles", children(F.col("run"), F.col("at"), F.col("places")).alias("next"))
        down = checkpointed(down)
        goes = down.select("run", "at", "members", "n", F.explode("next").alias("next"))
        sizes = goes.groupBy("run", "at", "next").agg(F.first("members").alias("all"), *count)
        # one row a child of a large node
        agrees = (F.max("members").over(Window.partitionBy("run", "at")) >= AGREE * F.col("all")).alias("agrees")
        sizes = checkpointed(sizes.select("run", "at", "next", "members", "shingles", agrees).filter(F.col("agrees") | (F.col("members") > 1)))
        dense = checkpointed(sizes.filter("agrees").select("run", "at").distinct())
        leaves.append(down.join(dense, ["run", "at"], "left_semi").select(*as_leaf))
        on = down.select("key", "n", "run", "at", F.explode("next").alias("next")).join(sizes.filter(~F.col("agrees")).drop("agrees"), ["run", "at", "next"])
        rows = checkpointed(on.select("key", "n", "run", F.col("next").alias("at"), "members", "shingles"))
    return _union([*leaves, rows.select(*as_leaf)])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def join_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = 0.8, recall: float = 0.99, depth: int = 6) -> DataFrame:
    """One row a document: doc_id, text_hash, class_id, n_links, copies, first.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is at
    least `similarity`; words are parted by ASCII white space and taken as they are. class_id is the
    least doc_id that chains of links reach; n_links counts the other documents linked to this one,
    copies those with the same set, itself included. A text of one to four words has one shingle.
    first: whether no other document that chains of links reach has a smaller id, or the same id and
    a smaller text_hash (xxhash64).

    recall: the probability with which a link of the least similarity would be found if all leaves
    were at the greatest depth; greater similarity and shallower leaves have more. Nodes at that depth
    are leaves whatever their size. Links are checked exactly.

    Null text and text without words: no set, a class of its own, 0 links. Null ids: null class, 0
    links, compared with nothing. Repeated ids: each row counts as a document of its own; rows alike
    in id and text are copies, and all first if one is. Empty table: no rows. Ids must be integers;
    other columns are not read.
    """
    runs = runs_needed(similarity, recall, depth)
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = base.select("doc_id", "text_hash", "text").mapInArrow(signer, "doc_id bigint, text_hash bigint, key binary, n bigint, places array<int>")
    signed = checkpointed(signed.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.col("key"))))
    low = F.min(F.struct("doc_id", "text_hash")).alias("low")
    classes = signed.filter(F.col("key").isNotNull()).groupBy("key").agg(low, F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("places").alias("places"))
    classes = checkpointed(classes)
    spark = docs.sparkSession

    leaves = checkpointed(tree_leaves(classes, runs, depth))
    # places have done their work; the tables that hold them may go
    signed, classes = checkpointed(signed.select("doc_id", "text_hash", "key")), checkpointed(classes.drop("places"))
    release_shuffles(spark)
    own = leaves.groupBy("key").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    leaves = leaves.join(own, "key")
    # a leaf whose members all share an earlier leaf holds no new pair
    first = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.array_min(F.filter("leaves", lambda x: F.shiftright(x, RUN_BITS) == r)))
    with_first = leaves.select("leaf", first.alias("firsts"))
    ends = [F.struct(F.min(F.col("firsts")[r]).alias("low"), F.max(F.col("firsts")[r]).alias("high"), F.count(F.col("firsts")[r]).alias("n")) for r in range(runs)]
    fresh = with_first.groupBy("leaf").agg(F.count(F.lit(1)).alias("all"), F.array(*ends).alias("ends"))
    fresh = fresh.filter(~F.exists("ends", lambda e: (e["low"] < F.col("leaf")) & (e["low"] == e["high"]) & (e["n"] == F.col("all")))).select("leaf")
    fresh = checkpointed(fresh)
    leaves = checkpointed(leaves.join(fresh, "leaf", "left_semi"))
    wanted = small(checkpointed(leaves.select("key").distinct().join(classes, "key").select("low.*", "key", "copies")), 1_000_000)
    del own, with_first, fresh
    release_shuffles(spark)
    # one text of each class; rows alike in id and text come several times
    texts = base.join(wanted, ["doc_id", "text_hash"]).groupBy("key").agg(F.first("text").alias("text"), F.first("copies").alias("copies"))

    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    cells = leaves.withColumn("blocks", blocks).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    cells = cells.select("key", "leaf", "leaves", "block", "left", "right").join(texts, "key")
    ordered = cells.repartition("leaf", "left", "right").sortWithinPartitions("leaf", "left", "right", "key")
    found = checkpointed(ordered.mapInArrow(comparer(similarity), "key binary, links bigint, root binary"))
    del texts, cells, ordered
    release_shuffles(spark)

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    lows = classes.join(parts, "key").groupBy("component").agg(F.min("low").alias("first"))
    known = classes.select("key", "low", "copies").join(links, "key", "left").join(parts.join(lows, "component").drop("component"), "key", "left")
    known = known.select("key", F.coalesce("first", "low").alias("low"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    out = signed.select("doc_id", "text_hash", "key").join(known, "key", "left")
    is_first = F.coalesce((F.col("doc_id") == F.col("low.doc_id")) & (F.col("text_hash") == F.col("low.text_hash")), F.lit(True))
    return out.select("doc_id", "text_hash", F.coalesce("low.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("copies"), is_first.alias("first"))
