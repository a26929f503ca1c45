"""Removing long repeated byte strings with a logarithmic family of indexes of anchored strings.

A string of `length` bytes is repeated if it also starts earlier. A suffix array of every byte is
beyond the means of a shuffle, so only some suffixes are indexed, and by hash: of the K-byte grams
inside a string the one with the least hash is its anchor, which its content alone decides, so equal
strings have equal anchors at equal places. Strings in a row with one anchor form a stretch, about
one for every 35 bytes; equal stretches hold equal strings, and strings can only be equal across
different stretches if those have the same anchor gram.

Each task keeps a family of sorted levels of stretches. A batch of documents becomes a level of its
own, is scanned against the existing ones, where of equal stretches the later is settled, and joins
them as the newest; levels of like size merge, so there are logarithmically many. The levels of all
tasks merge in one sorting shuffle by anchor, whose scan finds the first of each stretch in the
corpus. First stretches that share an anchor with different ones, which happens where copies begin,
end or differ, are told apart string by string, all those of an anchor in one place, or by their own
hashes where very many share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm import words
from evigraph.llm.common import checkpointed, let, release_shuffles, ship

ship(__name__)

K = 32
#: Stretches that a task's family holds before it is handed on; bounds its memory.
FAMILY = 1 << 20
#: Stretches that may share an anchor and still be told apart in one task; larger groups are dealt out by string.
GROUP = 1 << 15
NULL_ID = -(1 << 63)
U = np.uint64


class Hashed:
    """Prefix sums of a run of bytes, from which any substring's hash follows."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        base = words.BASE ^ (seed << 32)
        n = len(data)
        self.down = words.powers(pow(base, -1, 1 << 64), n + 1)
        value = words.mixed(np.arange(1 + 256 * seed, 257 + 256 * seed, dtype=U))
        self.total = np.concatenate([np.zeros(1, U), np.cumsum(value[data] * words.powers(base, n), dtype=U)])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return words.mixed((self.total[stop] - self.total[start]) * self.down[start])


def stretches(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, number of starts, anchor hash, content hash) of all stretches of a block of texts."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(U), none.view(U)
    h = Hashed(data)
    at = np.arange(n - K + 1)
    gram = h(at, at + K)
    # the high half of the hash, then the place: ties go to the first, which content alone decides
    least = (gram & U(0xFFFFFFFF00000000)) | at.astype(U)
    width, done = length - K + 1, 1
    while 2 * done <= width:
        least, done = np.minimum(least[:-done], least[done:]), 2 * done
    if done < width:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    anchor = (least & U(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(anchor)), "right") - 1
    inside = np.arange(len(anchor)) + length <= ends[text + 1]
    begins = inside.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(begins)
    ordinal = np.cumsum(begins) - 1
    count = np.bincount(ordinal[inside], minlength=len(first)) if len(first) else none
    a = anchor[first]
    content = words.mixed(h(first, first + count - 1 + length) + (a - first).astype(U) * U(256) + count.astype(U))
    return text[first], first - ends[text[first]], count, gram[a], content


def tag(bits: np.ndarray, start: np.ndarray, count: np.ndarray | int = 0) -> np.ndarray:
    """One long that sorts by 17 more bits of the text's hash, then start (32 bits), and holds a number of starts (14 bits)."""
    return (bits << 46) | (start << 14) | count


def starts_of(tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First start and number of starts."""
    return (tags >> 14) & 0xFFFFFFFF, tags & 0x3FFF


def joined_runs(*rows: np.ndarray) -> list[np.ndarray]:
    """Runs of starts that follow each other in a text, as few as hold in tags. Columns: what tells texts apart, and tags."""
    order = np.lexsort(rows[::-1])
    rows = [x[order] for x in rows]
    if not len(order):
        return rows
    *texts, tags = rows
    start, count = starts_of(tags)
    new = np.ones(len(order), bool)
    new[1:] = start[1:] != start[:-1] + count[:-1]
    for x in (*texts, tags >> 46):
        new[1:] |= x[1:] != x[:-1]
    # a run of 8192 starts and the stretch that ends it fit; longer runs are parted
    before = np.cumsum(count) - count
    part = (before - before[np.flatnonzero(new)][np.cumsum(new) - 1]) >> 13
    new[1:] |= part[1:] != part[:-1]
    first = np.flatnonzero(new)
    return [*(x[first] for x in texts), tag(tags[first] >> 46, start[first], np.add.reduceat(count, first))]


class Family:
    """Levels of (content, anchor, doc, text, tag), each sorted by content, sizes growing geometrically. Earlier is what sorts first by all columns."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    def __len__(self) -> int:
        return sum(len(x[0]) for x in self.levels)

    def add(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Indexes a batch; returns the rows, new or old, of which an equal earlier one is known. Rows alike in all columns are one place."""
        order = np.argsort(rows[0], kind="stable")
        rows = [x[order] for x in rows]
        # among rows of equal content the earliest comes first
        same = np.zeros(len(order), bool)
        same[1:] = rows[0][1:] == rows[0][:-1]
        same[:-1] |= same[1:]
        if len(some := np.flatnonzero(same)):
            part = [x[some] for x in rows]
            order = np.lexsort(part[::-1])
            for x, y in zip(rows, part):
                x[some] = y[order]
        if len(rows[0]):
            other = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in rows], axis=0)])
            rows = [x[other] for x in rows]
        new = np.ones(len(rows[0]), bool)
        new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        later = [[x[~new] for x in rows]]
        rows = [x[new] for x in rows]
        for level in self.levels:
            at = np.minimum(np.searchsorted(level[0], rows[0]), len(level[0]) - 1)
            same = (level[0][at] == rows[0]) & (level[1][at] == rows[1])
            mine, theirs = np.flatnonzero(same), at[same]
            earlier, other = np.zeros(len(mine), bool), np.zeros(len(mine), bool)
            for k in reversed(range(2, len(rows))):
                a, b = rows[k][mine], level[k][theirs]
                earlier, other = (a < b) | ((a == b) & earlier), other | (a != b)
            # the earlier of two keeps the place in the level
            for k in range(2, len(rows)):
                old, fresh = level[k][theirs], rows[k][mine]
                level[k][theirs] = np.where(earlier, fresh, old)
                rows[k][mine] = np.where(earlier, old, fresh)
            later.append([x[mine[other]] for x in rows])
            rows = [x[~same] for x in rows]
        if len(rows[0]):
            self.levels.append(rows)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            b, a = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(x) for x in zip(a, b)]
            merged = np.argsort(both[0], kind="stable")
            self.levels.append([x[merged] for x in both])
        return [np.concatenate(x) for x in zip(*later)]


ROW = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("text", pa.int64()), ("tag", pa.int64()), ("settled", pa.bool_())])


def indexer(length: int):
    """For mapInArrow: doc, hash, text to stretches; settled ones have an equal earlier one in the same task."""

    def out(rows: list[np.ndarray], settled: bool) -> Iterator[pa.RecordBatch]:
        content, anchor, doc, text, tags = rows
        for k in range(0, len(doc), 1 << 16):
            s = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(anchor[s].view(np.int64)), pa.array(content[s].view(np.int64)), pa.array(doc[s]), pa.array(text[s]), pa.array(tags[s]), pa.array(np.full(len(doc[s]), settled))], schema=ROW)

    def settled(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, text, tags = joined_runs(*rows[2:])
        none = np.zeros(len(doc), U)
        return out([none, none, doc, text, tags], True)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family()
        for batch in batches:
            docs, hashes, bits = (batch.column(c).to_numpy() for c in ("doc", "hash", "bits"))
            for first, data, ends in words.blocks(batch.column("text")):
                text, start, count, anchor, content = stretches(data, ends, length)
                text = text + first
                yield from settled(family.add([content, anchor, docs[text], hashes[text], tag(bits[text], start, count)]))
            if len(family) > FAMILY:
                for level in family.levels:
                    yield from out(level, False)
                family = Family()
        for level in family.levels:
            yield from out(level, False)

    return index


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over stretches sorted by anchor, content, doc, text, tag: (doc, text, tag, anchor, open).

    Later stretches come out with open false: all their strings are repeated. First ones whose anchor
    other first ones share come out with open true. The last first one waits for what follows. Rows
    alike in all columns are one place, read from rows of the table that are alike.
    """
    last, held = None, None

    def out(doc, text, tags, anchor, is_open):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(text), pa.array(tags), pa.array(anchor), pa.array(np.full(len(doc), is_open))], names=["doc", "text", "tag", "anchor", "open"])

    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in range(5)]
        settled = batch.column(5).to_numpy(zero_copy_only=False)
        anchor, content, doc, text, tags = (x[settled] for x in cols)
        yield out(doc, text, tags, anchor, False)
        anchor, content, doc, text, tags = (x[~settled] for x in cols)
        if not len(anchor):
            continue
        rows = [anchor, content, doc, text, tags]
        other = np.concatenate([[last != tuple(x[0] for x in rows)], np.any([x[1:] != x[:-1] for x in rows], axis=0)])
        before, last = last, tuple(x[-1] for x in rows)
        anchor, content, doc, text, tags = (x[other] for x in rows)
        if not len(anchor):
            continue
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        new[0] = before is None or before[:2] != (anchor[0], content[0])
        yield out(doc[~new], text[~new], tags[~new], anchor[~new], False)
        rows = [anchor[new], doc[new], text[new], tags[new], np.zeros(int(new.sum()), bool)]
        if held is not None:
            rows = [np.concatenate([[h], x]) for h, x in zip(held, rows)]
        if not len(rows[0]):
            continue
        same = rows[0][1:] == rows[0][:-1]
        shared = rows[4].astype(bool)
        shared[1:] |= same
        shared[:-1] |= same
        held = [x[-1] for x in rows[:4]] + [shared[-1]]
        shared = shared[:-1]
        yield out(*(x[:-1][shared] for x in (rows[1], rows[2], rows[3], rows[0])), True)
    if held is not None and held[4]:
        yield out(*(np.array([x]) for x in (held[1], held[2], held[3], held[0])), True)


def strings_of(rows: pa.Table | pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """(h1, h2, doc, text, tag) of every string of some stretches: doc, text, tag, bytes."""
    data = rows.column("bytes").to_pylist()
    doc, text, tags = (rows.column(c).to_numpy() for c in ("doc", "text", "tag"))
    size = np.array([len(x) for x in data], np.int64)
    start, count = starts_of(tags)
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(size) - size, count) + within
    whole = np.frombuffer(b"".join(data), np.uint8)
    h = [Hashed(whole, seed)(begin, begin + length).view(np.int64) for seed in (0, 1)]
    return *h, np.repeat(doc, count), np.repeat(text, count), tag(np.repeat(tags >> 46, count), np.repeat(start, count) + within, 1)


def resolver(length: int):
    """For mapInArrow over stretches sorted by anchor: (doc, text, tag) of the runs of strings that also start earlier.

    Equal strings have equal anchors, so whole groups of an anchor are settled together, several at a
    time; a group at the end of a batch waits for the next.
    """

    def later(rows: pa.Table) -> pa.RecordBatch:
        h1, h2, doc, text, tags = strings_of(rows, length)
        order = np.lexsort((tags, text, doc, h2, h1))
        h1, h2, doc, text, tags = (x[order] for x in (h1, h2, doc, text, tags))
        # of equal strings the first is kept, and rows that are the same place
        first = np.ones(len(h1), bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = np.flatnonzero(first)[np.cumsum(first) - 1]
        again = (doc != doc[at]) | (text != text[at]) | (tags != tags[at])
        runs = joined_runs(doc[again], text[again], tags[again])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in runs], names=["doc", "text", "tag"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            anchor = rows.column("anchor").to_numpy()
            new = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            first = 0
            for k in range(0, len(new), 512):
                end = int(new[min(k + 511, len(new) - 1)])
                yield later(rows.slice(first, end - first))
                first = end
            held = rows.slice(first)
        if held is not None and held.num_rows:
            yield later(held)

    return resolve


def string_rows(length: int):
    """For mapInArrow over stretches: (h1, h2, doc, text, tag) of each string."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                got = strings_of(batch.slice(k, 4096), length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["h1", "h2", "doc", "text", "tag"])

    return rows


def remover(length: int):
    """For mapInArrow: cuts texts; see remove_repeats for the columns."""

    def cut(text: str | None, *later: list | None):
        raw = (text or "").encode("utf-8", "surrogatepass")
        tags = np.array([t for x in later for t in x or ()], np.int64)
        if not len(tags):
            return len(raw), 0, 0, raw
        mark = np.zeros(len(raw) + 1, np.int64)
        start, count = starts_of(tags)
        np.add.at(mark, start, 1)
        np.add.at(mark, start + count - 1 + length, -1)
        gone = np.cumsum(mark)[:-1] > 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        return len(raw), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), kept

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                done = [cut(*row) for row in zip(*(part.column(c).to_pylist() for c in ("text", "later", "more")))]
                cols = [part.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return remove


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 100) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining UTF-8 bytes).

    Removes each byte covered by a string of `length` bytes that also starts earlier: in a document
    with a smaller id (null first), or in the same document at an earlier place; overlaps count.
    Strings are judged on the input and never cross documents. n_spans counts maximal removed runs.
    A cut may part a character, so that kept is not text. Stretches are compared by 64-bit hashes of
    their content and of their anchor, single strings by two 64-bit hashes.

    Null text: empty. Texts shorter than `length` stay whole. Rows alike in id and text count as one
    document and come out alike; rows that share only the id are ordered by a hash of the text. Empty
    table: no rows. Ids must be integers, lengths from 64 to 255 bytes; other columns are not read.
    """
    if not 64 <= length <= 255:
        raise ValueError("length must be from 64 to 255")
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    base = base.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID)))
    # texts that share an id, as all without one do, are told apart by 81 bits of their hashes, of which those in a column of their own are 0 where no id has two texts
    hashed = base.withColumn("hash", F.xxhash64("text"))
    ids = hashed.groupBy("doc").agg((F.min("hash") != F.max("hash")).alias("unlike"), (F.count(F.lit(1)) > 1).alias("again")).agg(F.max("unlike"), F.max("again")).first()
    unlike, again = (bool(x) for x in ids)
    base = hashed if unlike else base.withColumn("hash", F.lit(0).cast("bigint"))
    base = base.withColumn("bits", F.xxhash64(F.lit(1), "text").bitwiseAND(F.lit((1 << 17) - 1)))
    same = ["doc", "hash", "bits"]
    text = ["doc", F.col("text").alias("hash"), F.shiftright("tag", 46).alias("bits")]

    found = base.select(*same, "text").mapInArrow(indexer(length), "anchor bigint, content bigint, doc bigint, text bigint, tag bigint, settled boolean")
    # settled rows only pass through and are spread by their place
    found = found.repartition(F.when(F.col("settled"), F.xxhash64("doc", "text", "tag")).otherwise(F.col("anchor")))
    found = found.sortWithinPartitions("anchor", "content", "doc", "text", "tag").mapInArrow(scan, "doc bigint, text bigint, tag bigint, anchor bigint, open boolean")
    found = found.groupBy(*text).agg(
        F.collect_list(F.when(~F.col("open"), F.col("tag"))).alias("later"),
        F.collect_list(F.when(F.col("open"), F.struct("tag", "anchor"))).alias("open"),
    )
    found = checkpointed(found)
    release_shuffles(spark)

    # strings of large groups meet by their hashes, those of others by their anchors
    large = found.select(F.explode("open.anchor").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP)
    large = checkpointed(large.select("anchor", F.lit(True).alias("large")))
    any_large = not large.isEmpty()

    def bytes_of(b, o):
        start = F.shiftright(o["tag"], 14).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        count = o["tag"].bitwiseAND(F.lit(0x3FFF)).cast("int")
        return F.struct(o["anchor"].alias("anchor"), o["tag"].alias("tag"), F.substring(b, start + 1, count - 1 + length).alias("bytes"))

    opened = base.join(found.filter(F.size("open") > 0).select(*same, "open"), same)
    opened = opened.select("doc", F.col("hash").alias("text"), F.inline(let(F.col("text").cast("binary"), lambda b: F.transform("open", lambda o: bytes_of(b, o)))))
    if again:
        # rows alike are one document
        opened = opened.dropDuplicates(["doc", "text", "tag"])
    more = opened
    if any_large:
        opened = checkpointed(opened.join(large, "anchor", "left"))
        more = opened.filter(F.col("large").isNull()).drop("large")
    more = more.repartition("anchor").sortWithinPartitions("anchor").select("doc", "text", "tag", "anchor", "bytes").mapInArrow(resolver(length), "doc bigint, text bigint, tag bigint")
    if any_large:
        strings = checkpointed(opened.filter("large").select("doc", "text", "tag", "bytes").mapInArrow(string_rows(length), "h1 bigint, h2 bigint, doc bigint, text bigint, tag bigint"))
        first = strings.groupBy("h1", "h2").agg(F.min(F.struct("doc", "text", "tag")).alias("f")).select("h1", "h2", "f.*")
        more = more.unionByName(strings.join(first, ["h1", "h2", "doc", "text", "tag"], "left_anti").select("doc", "text", "tag"))
    more = checkpointed(more.groupBy(*text).agg(F.collect_list("tag").alias("more")))
    del opened
    release_shuffles(spark)

    known = found.select(*same, "later").join(more, same, "left")
    rows = base.join(known, same, "left").select("doc_id", "text", "later", "more")
    return rows.mapInArrow(remover(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
