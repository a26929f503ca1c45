"""Lexical retrieval packing: documents that share rare words share training sequences.

Two passes. The first counts, over all documents, in how many each hashed word occurs; the table has
a fixed size. The second range-partitions documents by their last word in code-point order, mostly a
rare one, and their id, so that documents of like words lie together and a group of copies is cut
wherever a partition is full. Each partition is worked through shard by shard. A shard of a bounded
number of words holds a BM25 inverted index of its documents: the document that opens a sequence is
the query, and its unused neighbours, best first, fill the window. A document that does not fit is
cut, and what is left opens the next sequence. So sequences are full; only the last of a partition
is split at powers of two.

Where documents come in a training order, they are dealt out to slices of it first, each of as many
documents, and all this is done within slices: sequences follow the order from slice to slice.
"""

from __future__ import annotations

import json
import math
import struct
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm import words
from evigraph.llm.common import checkpointed, ship, small, worker_store

ship(__name__)

#: Word hashes; their document frequencies are the corpus statistics of BM25.
BUCKETS = 1 << 17
K1, B = 1.2, 0.75
#: A text counts as a word for each so many bytes at least, where sizes bound memory: texts may have no blanks.
WORD_BYTES = 8
# Fixed value: the pieces that byte-level tokenizers of this kind merge within.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Tokens' bytes by id, if the tokenizer is a byte-level one whose ids are in order of its merges.

    Such a tokenizer shows bytes as printable characters: those of Latin-1 that print stand for
    themselves, the others for code points from 256 on, in order.
    """
    before = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or model.get("type") != "BPE" or spec.get("normalizer") or any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "dropout")):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    return ranks if merged == sorted(merged) and len(merged) + 256 == len(ranks) else None


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    Byte-level tokenizers are run by the faster of two public libraries, which gives the same ids;
    texts that spell a special token, and other tokenizers, go to the one that owns the file. It is
    loaded for these only.
    """

    def __init__(self, path: str):
        self.path, self.fast = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if ranks := byte_ranks(spec):
            from tiktoken import Encoding

            self.fast = Encoding("byte_level", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(x in text for x in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


def encoder(path: str) -> Encoder:
    """The worker's encoder."""
    store = worker_store("encoders")
    if path not in store:
        store[path] = Encoder(path)
    return store[path]


def terms_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """Hashed words of each text, in order: runs of letters and digits, A-Z as a-z."""
    for _, hashes, ends in words.word_hashes(texts, words.MARKS, fold=True):
        yield from np.split((hashes & np.uint64(BUCKETS - 1)).astype(np.int32), ends[1:-1])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a partition, at BUCKETS the documents, after it the words, and the words by which sizes are planned."""
    counts = np.zeros(BUCKETS + 3, np.int64)
    for batch in batches:
        size = np.diff(words.text_bytes(batch.column(0))[1])
        for first, hashes, ends in words.word_hashes(batch.column(0), words.MARKS, fold=True):
            n = np.diff(ends)
            pairs = np.sort(np.repeat(np.arange(len(n)) * BUCKETS, n) + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64))
            new = np.ones(len(pairs), bool)
            new[1:] = pairs[1:] != pairs[:-1]
            counts[:BUCKETS] += np.bincount(pairs[new] & (BUCKETS - 1), minlength=BUCKETS)
            counts[BUCKETS:] += (len(n), len(hashes), int(np.maximum(n + 1, size[first : first + len(n)] // WORD_BYTES).sum()))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])


class Index:
    """BM25 inverted index of a shard's documents, under the corpus' statistics."""

    def __init__(self, terms: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = n = max(len(terms), 1)
        length = np.array([len(t) for t in terms], np.int64)
        key = np.concatenate([*terms, np.zeros(0, np.int32)]).astype(np.int64) * n + np.repeat(np.arange(len(terms)), length)
        # words in more than half of all documents have no weight
        key = np.sort(key[idf[key // n] > 0])
        first = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
        tf = np.diff(np.append(first, len(key))).astype(np.float64)
        term, self.doc = key[first] // n, key[first] % n
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.doc] / max(mean, 1.0)))
        starts = np.flatnonzero(np.concatenate([np.ones(min(len(term), 1), bool), term[1:] != term[:-1]]))
        self.start, self.size = starts, np.diff(np.append(starts, len(term)))
        local = np.repeat(np.arange(len(starts)), self.size)
        self.local = local[np.argsort(self.doc.astype(np.int16 if n < 1 << 15 else np.int64), kind="stable")]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=n))])

    def scores(self, d: int) -> np.ndarray:
        """Score of every document for document d as the query."""
        q = self.local[self.bounds[d] : self.bounds[d + 1]]
        size = self.size[q]
        total = int(size.sum())
        at = np.arange(total) + np.repeat(self.start[q] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if total else np.zeros(0, np.int64)
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n)


class Packer:
    """Fills sequences; holds the open one between shards."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.open: list[tuple] = []
        self.used = 0
        self.rows: list[tuple] = []

    def place(self, doc, ids: bytes) -> bool:
        """Appends a document; whether a sequence that it opens is still open."""
        n, at, opens = len(ids) // 4, 0, False
        while at < n:
            opens |= self.used == 0
            take = min(self.window - self.used, n - at)
            self.open.append((doc, at, ids[4 * at : 4 * (at + take)], n))
            self.used, at = self.used + take, at + take
            if self.used == self.window:
                self.flush([self.window])
                opens = False
        return opens

    def flush(self, sizes: list[int]) -> None:
        """Deals the open pieces out to sequences of these sizes, which add up to them."""
        pieces = self.open[::-1]
        for size in sizes:
            offset = 0
            while offset < size:
                doc, start, ids, n = pieces.pop()
                take = min(size - offset, len(ids) // 4)
                self.rows.append((doc, start, take, n, self.sequence, offset, ids[: 4 * take]))
                if 4 * take < len(ids):
                    pieces.append((doc, start + take, ids[4 * take :], n))
                offset += take
            self.sequence += 1
        self.open, self.used = [], 0

    def close(self) -> None:
        """The last sequence needs no padding where its parts' sizes are powers of two."""
        self.flush([1 << k for k in range(self.used.bit_length() - 1, -1, -1) if self.used >> k & 1])


def pack_shard(packer: Packer, docs: list, texts: list[str], encode, idf: np.ndarray, mean: float, end_id: int) -> None:
    """Places every document of a shard, neighbours of the open sequence's first document first."""
    # copies lie together, and are encoded once
    known = {t: encode(t) + struct.pack("<I", end_id) for t in dict.fromkeys(texts)}
    ids = [known[t] for t in texts]
    index = Index(list(terms_of(pa.array(texts, pa.large_string()))), idf, mean)
    free, following = np.ones(len(docs), bool), 0
    # scores against the open sequence's first document; sorted, best last, once it takes more than two neighbours
    scores, near, picked = None, None, 0
    for _ in range(len(docs)):
        d = -1
        if scores is not None and packer.used:
            if picked == 2 and near is None:
                some = np.flatnonzero(scores > 0)
                near = some[np.lexsort((-some, scores[some]))].tolist()
            if near is None:
                best = int(np.argmax(scores))
                d = best if scores[best] > 0 else -1
            elif near:
                d = near.pop()
        if d < 0:
            while not free[following]:
                following += 1
            d = following
        free[d] = False
        if packer.place(docs[d], ids[d]):
            scores, near, picked = np.where(free, index.scores(d), 0.0), None, 0
        elif scores is not None:
            scores[d], picked = 0.0, picked + 1


def with_slices(docs: DataFrame, slices: int, name: str = "slice") -> DataFrame:
    """docs with the slice, 0 to slices - 1, of their own order; each slice holds as many rows, or one more or less.

    The order is that in which the rows are stored: files by name and rows in a file, as readers do
    not keep it, or partitions and their rows where docs is not a plain scan of files.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("__part"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        at = F.monotonically_increasing_id()
        # read twice, so the partitions have to be the same
        placed = checkpointed(docs).select("*", F.format_string("%010d", F.shiftright(at, 33)).alias("__part"), at.bitwiseAND((1 << 33) - 1).alias("__row"))
    counts = placed.groupBy("__part").agg((F.max("__row") + 1).alias("__n"))
    # a row for each file or partition
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    total = F.sum("__n").over(Window.partitionBy())
    offsets = small(checkpointed(counts.select("__part", before.alias("__before"), total.alias("__total"))))
    rank = F.col("__before") + F.col("__row")
    return placed.join(offsets, "__part").withColumn(name, F.floor(rank * slices / F.col("__total")).cast("int")).select(*[F.col(f"`{c}`") for c in docs.columns], name)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, window: int = 1024, end_id: int = 0, shard_words: int = 1 << 18, partition_words: int = 1 << 20, slice_col: str | None = None) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    A document is its tokens and end_id; ids holds a piece's ids as little-endian unsigned 32-bit
    bytes. Each id lies in exactly one piece, pieces of a sequence follow each other without gaps,
    and a sequence has `window` ids, or fewer, a power of two, at the end of a partition or slice.
    slice_col: a number; documents of lower ones get lower sequence_ids, and a sequence holds one
    slice's documents only.
    shard_words and partition_words bound the memory and the work of a task; a text counts as a word
    for each WORD_BYTES at least.

    Null and empty text: end_id alone. Null and repeated ids: each row is a document of its own.
    Documents without a common word are packed in order. Empty table: no rows. Other columns are
    not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.lit(0) if slice_col is None else F.col(slice_col)).cast("int").alias("slice"))
    found = rows.select("text").mapInArrow(count_terms, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS + 3, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    n_docs, n_words, planned = (int(x) for x in counts[BUCKETS:])
    df = counts[:BUCKETS]
    idf = np.log(np.maximum((n_docs - df + 0.5) / (df + 0.5), 1.0)).astype(np.float32)
    mean = n_words / max(n_docs, 1)
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, weights = encoder(tokenizer_path), shared.value
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        shard, texts, size, part = [], [], 0, None

        def done():
            cols = list(zip(*packer.rows)) or [()] * 7
            packer.rows = []
            types_ = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types_)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("slice").to_pylist()):
                if own != part:
                    if part is not None:
                        pack_shard(packer, shard, texts, encode, weights, mean, end_id)
                        packer.close()
                        shard, texts, size = [], [], 0
                        yield done()
                    part = own
                shard.append(doc)
                texts.append(text)
                size += max(text.count(" ") + 1, len(text) // WORD_BYTES)
                if size >= shard_words:
                    pack_shard(packer, shard, texts, encode, weights, mean, end_id)
                    shard, texts, size = [], [], 0
                    yield done()
        if id_type is not None:
            # may be empty, if the last batch filled a shard
            pack_shard(packer, shard, texts, encode, weights, mean, end_id)
            packer.close()
            yield done()

    near = F.substring(F.array_max(F.split("text", " ")), 1, 32)
    parts = max(1, math.ceil(planned / partition_words))
    # the hash parts texts that share an id, as all without one do
    keys = [*([] if slice_col is None else ["slice"]), "near", "doc_id", "text_hash"]
    placed = rows.withColumn("near", near).withColumn("text_hash", F.xxhash64("text")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return placed.select("doc_id", "text", "slice").mapInArrow(pack, schema)
