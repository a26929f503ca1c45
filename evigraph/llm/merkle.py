"""Merkle manifest of a dataset: one tree a group of rows, and a tree over the groups' roots.

Leaves stand in order of group and id; every `ARITY` nodes in a row, or what is left at the end of a
level, become one node of the next. The manifest is an append log in postorder: a node is written as
soon as all below it are. Builders are aligned: each takes the leaves of one subtree of `HEIGHT`
levels, so its nodes are a run of the log that needs no other builder, and is one row (a segment).
The roots of a tier's segments are the leaves of the next tier, which has a log of its own, until a
tree fits one segment.

A subtree's size follows from its number of leaves, so the position of any node in the log has a
closed form; proofs read siblings from a segment by position, and pass a segment's own path down to
the tier below. Builders hold one segment, of bounded size, whatever the size of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import checkpointed, ship
from evigraph.operators.relational import lookup_join

ship(__name__)

ARITY = 8
#: Levels of a segment above its leaves; a segment has up to ARITY to HEIGHT leaves and some 150 KB.
HEIGHT = 4


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(c: Column) -> Column:
    """A value as text that no other list of values spells: "-" for null, else its UTF-8 byte count, a colon, and it."""
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def top_level(n: int, arity: int = ARITY, height: int = HEIGHT) -> int:
    """The level of a segment's root, in a tier of n leaves."""
    level, nodes = 0, n
    while nodes > 1 and level < height:
        level, nodes = level + 1, -(-nodes // arity)
    return level


def position(level: int, index: np.ndarray, n: int, arity: int = ARITY, height: int = HEIGHT) -> np.ndarray:
    """How many nodes of a tier's log come before these nodes of a level.

    Written before a node are all nodes below it and to its left, and to its left of the levels above.
    """
    start, end = index * arity**level, np.minimum(n, (index + 1) * arity**level)
    below = sum((-(-end // arity**m) for m in range(level)), np.zeros_like(index))
    return below + index + sum((start // arity**m for m in range(level + 1, height + 1)), np.zeros_like(index))


def append_log(leaves: Iterable[str], first: int, n: int, arity: int = ARITY, height: int = HEIGHT) -> Iterator[str]:
    """The nodes over a segment's leaves, which are `first` and following of n, in order of completion."""
    top, runs = top_level(n, arity, height), [[] for _ in range(height + 1)]
    for i, node in enumerate(leaves, first):
        for level in range(top + 1):
            yield node
            if level == top:
                break
            runs[level].append(node)
            if len(runs[level]) < arity and i < n - 1:
                break
            node = digest(*runs[level])
            runs[level].clear()


def segment_runs(log: bytes, block: int, n: int, arity: int = ARITY, height: int = HEIGHT) -> list[tuple[int, list[str]]]:
    """For each level of a segment below its root: its first run's number, and each run's digests joined, read by position."""
    first, last = block * arity**height, min(n, (block + 1) * arity**height)
    base = int(position(0, np.array([first]), n, arity, height)[0])
    nodes = np.frombuffer(log, np.uint8).reshape(-1, 32)
    out = []
    for level in range(top_level(n, arity, height)):
        width = arity**level
        index = np.arange(first // width, -(-last // width))
        text = nodes[position(level, index, n, arity, height) - base].tobytes().hex()
        out.append((first // width // arity, [text[k : k + 64 * arity] for k in range(0, len(text), 64 * arity)]))
    return out


def path_of(runs: list[tuple[int, list[str]]], index: int, arity: int = ARITY) -> list[tuple[int, str]]:
    """For each level from the leaf up, its place among its run, and the run's other digests joined."""
    path = []
    for first, texts in runs:
        index, place = divmod(index, arity)
        run = texts[index - first]
        path.append((place, run[: 64 * place] + run[64 * place + 64 :]))
    return path


def fold(leaf: str, path: Iterable[tuple[int, str]]) -> str:
    """The root that a leaf and its path lead to."""
    for place, others in path:
        leaf = digest(others[: 64 * place], leaf, others[64 * place :])
    return leaf


def packed(path: Sequence[tuple[int, str]]) -> bytes:
    """A path as bytes: place, number of others, others, level by level."""
    return b"".join(bytes([place, len(others) // 64]) + bytes.fromhex(others) for place, others in path)


def unpacked(data: bytes) -> list[tuple[int, str]]:
    path, at = [], 0
    while at < len(data):
        place, size = data[at], 32 * data[at + 1]
        path.append((place, data[at + 2 : at + 2 + size].hex()))
        at += 2 + size
    return path


def builder(arity: int, height: int):
    """For applyInArrow: the leaves (index, n, digest) of a segment to its row."""

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tree, block, n = (k.as_py() for k in key)
        rows = rows.sort_by("index")
        log = list(append_log(rows.column("digest").to_pylist(), block * arity**height, n, arity, height))
        data = [[tree], [block], [n], [bytes.fromhex("".join(log))], [log[-1]]]
        return pa.table(data, pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("log", pa.binary()), ("digest", pa.string())]))

    return build


def prover(arity: int, height: int):
    """For cogrouped applyInArrow: rows (tree, index) of a segment, and its own path, to (tree, index, path)."""

    def prove(rows: pa.Table, segment: pa.Table) -> pa.Table:
        schema = pa.schema([("tree", pa.int64()), ("index", pa.int64()), ("path", pa.binary())])
        if not rows.num_rows:
            return schema.empty_table()
        s = segment.to_pylist()[0]
        runs = segment_runs(s["log"], s["block"], s["n"], arity, height)
        index = rows.column("index")
        return pa.table([rows.column("tree"), index, pa.array([packed(path_of(runs, i, arity)) + (s["path"] or b"") for i in index.to_pylist()], pa.binary())], schema=schema)

    return prove


def checker(arity: int, height: int):
    """For cogrouped applyInArrow: leaf rows of a segment and its own path to proofs and folded roots."""

    def check(rows: pa.Table, segment: pa.Table) -> pa.Table:
        proofs, folded, roots = [], [], []
        if rows.num_rows:
            s = segment.to_pylist()[0]
            runs, above = segment_runs(s["log"], s["block"], s["n"], arity, height), unpacked(s["path"] or b"")
            for index, claimed in zip(rows.column("index").to_pylist(), rows.column("claimed").to_pylist()):
                path = path_of(runs, index, arity) + above
                proofs.append(digest(*(others for _, others in path)))
                folded.append(fold(claimed, path))
            roots = [s["subroot"]] * rows.num_rows
        return pa.table([rows.column("doc_id"), rows.column("leaf"), pa.array(roots, pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string())], names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    return check


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows sorted by range, with the long column `at`; (group, range, first, rows) of each group's rows in each range).

    A row's place in its group is at - first, and the rows of the group's earlier ranges. Rows and
    numbers are stored, since a second run might cut ranges elsewhere.
    """
    by = [F.col(g).asc_nulls_first() for g in group] + list(order)
    rows = checkpointed(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("range", F.shiftright("at", 33))
    return rows, rows.groupBy(*group, "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))


@dataclass
class Manifest:
    """leaves: (doc_id, leaf, claimed, tree, index, n); tiers: segments (tree, block, n, log, digest) from the leaves up; trees: (tree, group, n); top: tiers over the subroots."""

    leaves: DataFrame
    trees: DataFrame
    tiers: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    arity: int
    height: int


def built(nodes: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """Segments of all tiers over nodes (tree, index, n, digest)."""
    tiers, size = [], arity**height
    while True:
        block = F.floor(F.col("index") / size).cast("bigint").alias("block")
        tier = nodes.select("tree", block, "n", "index", "digest").groupBy("tree", "block", "n").applyInArrow(builder(arity, height), "tree bigint, block bigint, n bigint, log binary, digest string")
        tiers.append(checkpointed(tier))
        nodes = tiers[-1].filter(F.col("n") > size).select("tree", F.col("block").alias("index"), F.ceil(F.col("n") / size).cast("bigint").alias("n"), "digest")
        if nodes.isEmpty():
            return tiers


def subroots(tiers: Sequence[DataFrame], size: int) -> DataFrame:
    """(tree, digest): the roots of segments that are whole trees."""
    out = None
    for t in tiers:
        one = t.filter(F.col("n") <= size).select("tree", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def with_paths(tiers: Sequence[DataFrame], above: DataFrame | None, arity: int, height: int) -> DataFrame:
    """The lowest tier's segments with the path of each one's root. above: (tree, path) of the trees' own roots, if there are any."""
    size, lower = arity**height, None
    for tier in reversed(tiers):
        whole = tier.filter(F.col("n") <= size)
        whole = whole.join(above, "tree", "left") if above is not None else whole.withColumn("path", F.lit(None).cast("binary"))
        segments = whole.select("tree", "block", "n", "log", "path")
        if lower is not None:
            parts = tier.filter(F.col("n") > size)
            keys = parts.select("tree", F.floor(F.col("block") / size).cast("bigint").alias("block"), F.col("block").alias("index"))
            # both sides come from stored tables; columns of their own
            paths = keys.groupBy("tree", "block").cogroup(lower.groupBy("tree", "block")).applyInArrow(prover(arity, height), "tree bigint, index bigint, path binary")
            segments = segments.unionByName(parts.join(paths.withColumnRenamed("index", "block"), ["tree", "block"]).select("tree", "block", "n", "log", "path"))
        lower = segments
    return lower


def build_manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str | None = "lang", *, claimed: Column | None = None, arity: int = ARITY, height: int = HEIGHT) -> Manifest:
    """The manifest of a table: a tree a value of group_col (none: one tree), and one over their roots.

    A leaf is the digest of the encoded values of `fields`. Leaves of a group ascend by id, groups
    by value (text by UTF-8 bytes), null first in both. claimed: the leaf that someone claims for a
    row, for check_rows(); null, or none given, stands for the row's own.

    Null fields are leaves' "-". Repeated ids stand in order of their leaves; rows alike have equal
    leaves and stand side by side. Empty table: no trees, root None. Other columns are not read.
    """
    leaf = leaf_digest(*[F.col(f"`{c}`") for c in fields])
    group = (F.col(f"`{group_col}`") if group_col else F.lit(None).cast("string")).alias("group")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), group, leaf.alias("leaf"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    # the last key parts rows alike; stored, so that ranges are sampled from digests and not from texts
    rows = checkpointed(rows.withColumn("salt", F.monotonically_increasing_id()))
    rows, ranges = numbered(rows, ["group"], [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("claimed").asc_nulls_first(), F.col("salt")])
    ranges = checkpointed(ranges)
    groups, spots = numbered(ranges.groupBy("group").agg(F.sum("rows").alias("n")), [], [F.col("group").asc_nulls_first()])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row a range of the groups' table
    spots = spots.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).select("range", "first", "before")
    trees = checkpointed(groups.join(spots, "range").select((F.col("at") - F.col("first") + F.col("before")).alias("tree"), "group", "n"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.withColumn("before", before).alias("o").join(trees.alias("t"), F.col("o.group").eqNullSafe(F.col("t.group"))).select(F.col("o.range").alias("in_range"), F.col("o.group").alias("in_group"), (F.col("before") - F.col("first")).alias("shift"), "tree", "n")
    offsets = checkpointed(offsets)
    leaves = lookup_join(rows, offsets, (F.col("range") == F.col("in_range")) & F.col("group").eqNullSafe(F.col("in_group")), "inner")
    leaves = leaves.select("doc_id", "leaf", F.coalesce("claimed", "leaf").alias("claimed"), "tree", (F.col("at") + F.col("shift")).alias("index"), "n")
    if trees.isEmpty():
        return Manifest(leaves, trees, [], [], None, arity, height)
    tiers = built(leaves.select("tree", "index", "n", F.col("leaf").alias("digest")), arity, height)
    count = trees.count()
    top = built(subroots(tiers, arity**height).select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("index"), F.lit(count).cast("bigint").alias("n"), "digest"), arity, height)
    root = subroots(top, arity**height).first()["digest"]
    return Manifest(leaves, trees, tiers, top, root, arity, height)


def segments_with_paths(m: Manifest) -> DataFrame:
    """(tree, block, n, log, path, subroot): the segments of leaves, each with the path from its root to the manifest's."""
    size = m.arity**m.height
    low = with_paths(m.top, None, m.arity, m.height)
    keys = m.trees.select(F.lit(0).cast("bigint").alias("tree"), F.floor(F.col("tree") / size).cast("bigint").alias("block"), F.col("tree").alias("index"))
    paths = keys.groupBy("tree", "block").cogroup(low.groupBy("tree", "block")).applyInArrow(prover(m.arity, m.height), "tree bigint, index bigint, path binary")
    roots = subroots(m.tiers, size).withColumnRenamed("digest", "subroot")
    segments = with_paths(m.tiers, paths.select(F.col("index").alias("tree"), "path"), m.arity, m.height)
    return segments.join(roots, "tree")


def proofs(m: Manifest) -> DataFrame:
    """(doc_id, leaf, tree, index, path): each leaf's path to the root, as packed() gives it."""
    size = m.arity**m.height
    block = F.floor(F.col("index") / size).cast("bigint").alias("block")
    keys = m.leaves.select("tree", block, "index").groupBy("tree", "block")
    paths = keys.cogroup(segments_with_paths(m).groupBy("tree", "block")).applyInArrow(prover(m.arity, m.height), "tree bigint, index bigint, path binary")
    return m.leaves.select("doc_id", "leaf", "tree", "index").join(paths, ["tree", "index"])


def check_rows(m: Manifest) -> DataFrame:
    """One row a row of the table: doc_id, leaf, subroot, root, proof_sha256 (of its siblings, from the leaf up), folded_root (from the claimed leaf), verified."""
    size = m.arity**m.height
    block = F.floor(F.col("index") / size).cast("bigint").alias("block")
    id_type = m.leaves.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, leaf string, subroot string, proof_sha256 string, folded_root string"
    if m.root is None:
        return m.leaves.sparkSession.createDataFrame([], out).select("doc_id", "leaf", "subroot", F.lit(None).cast("string").alias("root"), "proof_sha256", "folded_root", F.lit(False).alias("verified"))
    rows = m.leaves.select("tree", block, "index", "doc_id", "leaf", "claimed").groupBy("tree", "block")
    checked = rows.cogroup(segments_with_paths(m).groupBy("tree", "block")).applyInArrow(checker(m.arity, m.height), out)
    root = F.lit(m.root)
    return checked.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
