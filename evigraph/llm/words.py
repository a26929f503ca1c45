"""Hashes of all words of a batch of texts at once, from the batch's own bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from evigraph.llm.common import ship, worker_store

ship(__name__)

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: ASCII white space, and that with all other ASCII characters but letters and digits.
WHITE = bytes([32, *range(9, 14)])
MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
#: Bytes of text that are worked on at a time, or one text.
BLOCK = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijection that spreads every bit of unsigned 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base to 0 .. n-1, modulo 2 to 64; the worker keeps those that a block needs."""
    known = worker_store("powers")
    out = known.get(base, np.ones(1, np.uint64))
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    if len(out) <= 2 * BLOCK:
        known[base] = out
    return out[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins and ends; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, ends) of runs of texts of about BLOCK bytes."""
    data, ends = text_bytes(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK, "right")) - 1)
        yield first, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def word_hashes(texts: pa.Array, between: bytes = WHITE, fold: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes, ends) by block: 64-bit hashes of all words in order, and where each text's words end.

    Words are runs of bytes other than `between`; with fold, A-Z count as a-z.
    """
    splits = np.zeros(256, bool)
    splits[list(between)] = True
    value = np.arange(1, 257, dtype=np.uint64)
    if fold:
        value[65:91] += np.uint64(32)
    up, down = powers(BASE, BLOCK + 1), powers(INVERSE, BLOCK + 1)
    for first, data, ends in blocks(texts):
        n = len(data)
        if n > len(up):
            up, down = powers(BASE, n), powers(INVERSE, n)
        inside = ~splits[data]
        edge = np.zeros(n + 1, bool)
        edge[ends] = True
        edge[:-1] |= ~inside
        edge[-1] = True
        begins = inside.copy()
        begins[1:] &= edge[1:n] | ~inside[:-1]
        stops = inside & edge[1:]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * up[:n], dtype=np.uint64)])
        h = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) if len(s) else np.zeros(0, np.uint64)
        yield first, h, np.searchsorted(s, ends)
