"""Statistics of whole documents, worked out for a block of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import kernels as K

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True
STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True
LETTERS = UPPER | np.roll(UPPER, 32)
WINDOW = 8

#: Counts, and then what models see: shares and means that don't depend on length, and the length itself.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "stops", "marks", "same_next", "distinct_words", "line_length", "short_words", "sentence_length", "symbol_words", "other_letters")


def _per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in flags[at[i]:at[i + 1]]."""
    done = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return done[at[1:]] - done[at[:-1]]


def _in_doc(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value: whether its document has it elsewhere too, and whether it has it earlier."""
    key = K.mix(value ^ K.mix(doc.astype(K.U) + K.U(7)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    earlier, repeated = np.empty(len(key), bool), np.empty(len(key), bool)
    earlier[order], repeated[order] = same, twice
    return repeated, earlier


def _lines(block: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every line."""
    breaks = np.flatnonzero(block.data == 10)
    doc_of_break = np.searchsorted(block.at, breaks, "right") - 1
    n = len(block.at) - 1
    doc = np.concatenate([np.arange(n), doc_of_break])
    start = np.concatenate([block.at[:-1], breaks + 1])
    end = np.concatenate([breaks, block.at[1:]])
    # Lines start in order and so do their ends; the last one of a document ends with it.
    order = np.lexsort((np.concatenate([np.zeros(n), np.ones(len(breaks))]), start, doc))
    last = np.argsort(np.concatenate([doc_of_break * 2, np.arange(n) * 2 + 1]), kind="stable")
    return start[order], end[last], doc[order]


def of_block(block: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS as long columns and SHARES as double columns, with a row for each document."""
    found, data, at = K.words(block), block.data, block.at
    n_words = np.diff(found.of_doc)
    doc = found.doc
    codes = K.BYTE_CODE[data]
    hashes = K.hash_spans(codes, found.start, found.end)
    chars = _per_doc(K.LEADS[data] & ~K.SPACE[data], at)
    symbols = _per_doc(SYMBOLS[data], at)

    inside = K.windows_inside(found.of_doc, WINDOW, len(hashes))
    at_window = np.flatnonzero(inside)
    repeated, _ = _in_doc(doc[at_window], K.hash_windows(hashes, WINDOW)[at_window])
    covers = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(covers, at_window[repeated], 1)
    np.add.at(covers, at_window[repeated] + WINDOW, -1)
    repeat_words = _per_doc(np.cumsum(covers)[:-1] > 0, found.of_doc)

    start, end, line_doc = _lines(block)
    has_word = np.searchsorted(found.start, end) > np.searchsorted(found.start, start)
    start, end, line_doc = start[has_word], end[has_word], line_doc[has_word]
    _, earlier = _in_doc(line_doc, K.hash_spans(codes, start, end))
    n_docs = len(n_words)
    dup_lines = np.bincount(line_doc[earlier], minlength=n_docs)
    n_lines = np.bincount(line_doc, minlength=n_docs)

    _, word_before = _in_doc(doc, hashes)
    same_next = np.zeros(len(hashes), bool)
    same_next[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    leads = np.concatenate([[0], np.cumsum(K.LEADS[data], dtype=np.int64)])
    lengths = leads[found.end] - leads[found.start]
    marks = np.concatenate([[0], np.cumsum(SYMBOLS[data], dtype=np.int64)])
    has_symbol = marks[found.end] > marks[found.start]
    words, solid = np.maximum(n_words, 1), np.maximum(chars, 1)
    stops = _per_doc(STOPS[data], at)
    letters = LETTERS[data]
    shares = np.stack(
        [
            np.log1p(n_words),
            chars / words,
            symbols / solid,
            dup_lines / np.maximum(n_lines, 1),
            repeat_words / words,
            _per_doc(UPPER[data], at) / solid,
            _per_doc(DIGITS[data], at) / solid,
            stops / words,
            _per_doc(data == 33, at) / words,
            _per_doc(same_next, found.of_doc) / words,
            1 - _per_doc(word_before, found.of_doc) / words,
            np.log1p(words / np.maximum(n_lines, 1)),
            _per_doc(lengths <= 3, found.of_doc) / words,
            np.log1p(words / np.maximum(stops, 1)),
            _per_doc(has_symbol, found.of_doc) / words,
            _per_doc(K.LEADS[data] & (data >= 128), at) / np.maximum(_per_doc(letters, at), 1),
        ],
        axis=1,
    )
    return np.stack([n_words, chars, symbols, dup_lines, repeat_words], axis=1).astype(np.int64), shares


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS (long each) and shares (array of doubles, as SHARES) for each row of ``docs`` (doc_id, text)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                counts, shares = of_block(block)
                n = block.last - block.first
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * shares.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, n), *[pa.array(np.ascontiguousarray(c)) for c in counts.T], pa.ListArray.from_arrays(offsets, pa.array(shares.ravel()))],
                    names=["doc_id", *COUNTS, "shares"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(measure, "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "shares array<double>")
