"""Vectorised work on the texts of an Arrow batch: words, hashes, shingles and statistics.

Texts stay UTF-8 bytes in one buffer; every step handles a block of whole
documents at once. White space is ASCII (space and 9 to 13), so bytes suffice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: First bytes of code points: all but UTF-8 continuation bytes.
LEADS = (np.arange(256) & 0xC0) != 0x80
BASE = U(0x9E3779B97F4A7C15) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * BASE)
_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """BASE to the power 0 .. n-1, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 4096), BASE)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


def runs(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n in lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


@dataclass
class Block:
    """Whole documents ``first`` .. ``last`` - 1 of a batch; text i is data[at[i]:at[i + 1]]."""

    first: int
    last: int
    data: np.ndarray
    at: np.ndarray


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts in blocks of about ``limit`` bytes; null counts as empty. A longer text has a block of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield Block(first, min(last, n), data[at[first] : at[min(last, n)]], at[first : min(last, n) + 1] - at[first])
        first = last


@dataclass
class Words:
    """All words of a block: data[start:end], and of_doc, the first word of each document and after the last."""

    start: np.ndarray
    end: np.ndarray
    of_doc: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of_doc) - 1), np.diff(self.of_doc))


def words(block: Block, space: np.ndarray = SPACE) -> Words:
    solid = ~space[block.data]
    n = len(solid)
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    inner = block.at[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begin[inner] = solid[inner]
    stop[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(begin)
    return Words(start, np.flatnonzero(stop) + 1, np.searchsorted(start, block.at))


def hash_spans(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span codes[start:end]; spans don't overlap and come in order. ``codes`` are BYTE_CODE values."""
    length = end - start
    full = np.flatnonzero(length > 0)
    out = mix(length.astype(U))
    if len(full):
        size = length[full]
        offset = runs(size)
        firsts = np.cumsum(size) - size
        values = codes[np.repeat(start[full], size) + offset] * powers(int(size.max()))[offset]
        out[full] = mix(np.add.reduceat(values, firsts) ^ out[full])
    return out


def hash_words(block: Block, found: Words, lower: bool = False) -> np.ndarray:
    return hash_spans(BYTE_CODE[LOWER[block.data] if lower else block.data], found.start, found.end)


def hash_windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Of every n consecutive values; there are len(hashes) - n + 1."""
    if len(hashes) < n:
        return np.zeros(0, U)
    total = np.zeros(len(hashes) - n + 1, U)
    for k in range(n):
        total = total * BASE + hashes[k : len(hashes) - n + 1 + k]
    return mix(total ^ U(n))


def windows_inside(of_doc: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which windows of n values lie in one document, for windows over all ``total`` values."""
    if total < n:
        return np.zeros(0, bool)
    end_of_doc = np.repeat(of_doc[1:], np.diff(of_doc))
    return np.arange(total - n + 1) + n <= end_of_doc[: total - n + 1]


def shingles(hashes: np.ndarray, of_doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every distinct n-word shingle, sorted. Shorter documents have their whole sequence as one; documents without words none."""
    counts = np.diff(of_doc)
    inside = windows_inside(of_doc, n, len(hashes))
    doc = np.repeat(np.arange(len(counts)), counts)[: len(inside)][inside]
    value = hash_windows(hashes, n)[inside]
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            total = np.zeros(len(short), U)
            for k in range(size):
                total = total * BASE + hashes[of_doc[short] + k]
            doc, value = np.concatenate([doc, short]), np.concatenate([value, mix(total ^ U(size))])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if len(doc):
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        doc, value = doc[new], value[new]
    return doc, value


def lists(values: np.ndarray, doc: np.ndarray, n_docs: int) -> pa.ListArray:
    """An Arrow list for each of n_docs documents; doc is sorted."""
    ends = np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
