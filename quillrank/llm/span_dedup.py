"""Substring dedup on sliding spans of sentences.

The shortest runs of two or more consecutive sentences that have enough words
are hashed, one from every sentence on and one up to every sentence that none
of these ends with (and a very long sentence for itself); runs are joined over all documents, and sentences
that a non-first repeat covers go. Of equal runs the first in order of doc_id
and position stays. Long sentences, and text without stops, are cut where the
words themselves say so, so a passage is cut alike wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import kernels as K
from quillrank.llm.tables import free_name, quoted

#: Fewest words of a run, and of a sentence that counts alone; shorter runs recur by chance, in notices and in quotations.
RUN_WORDS, ALONE_WORDS = 20, 40
#: Sentences of more words are cut before words whose hash, with that of the word after, is the lowest among so many words on both sides.
LONG_WORDS, AROUND = 24, 6
#: A sentence of fewer words belongs to the one before it in its line.
OWN_WORDS = 3
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
#: BASE times this is 1 modulo 2**64.
INVERSE = K.U(pow(int(K.BASE), -1, 1 << 64))
#: Rows without a doc_id take places from here on.
NO_ID = 2**62


COUNTS = ("n_sentences", "n_removed")


@dataclass
class Sentences:
    """Of a block: byte ranges start:end (white space after a sentence is its own), document and first sentence of each document."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    of_doc: np.ndarray
    words: np.ndarray
    name: np.ndarray


def _cuts(hashes: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words before which long sentences (of ``size`` words from word ``at`` on) are cut; what is outside a sentence doesn't matter."""
    place, length = K.runs(size), np.repeat(size, size)
    inside = (length > LONG_WORDS) & (place > 0)
    after = np.append(hashes[1:], K.U(0))
    after[place == length - 1] = 0
    pair = K.mix(hashes * K.BASE + after)
    for k in range(1, AROUND + 1):
        inside[k:] &= (pair[k:] < pair[:-k]) | (place[k:] < k)
        inside[:-k] &= (pair[:-k] <= pair[k:]) | (place[:-k] + k >= length[:-k])
    return np.flatnonzero(inside)


def sentences(block: K.Block) -> Sentences:
    """Sentences end at a word that ends in a full stop, exclamation or question mark, and with their line; long ones are cut further."""
    found = K.words(block)
    n = len(found.start)
    n_docs = len(block.at) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Sentences(none, none, none, np.zeros(n_docs + 1, np.int64), none, np.zeros(0, K.U))
    lines = np.concatenate([[0], np.cumsum(block.data == 10, dtype=np.int64)])
    first = np.zeros(n, bool)
    first[found.of_doc[:-1][np.diff(found.of_doc) > 0]] = True
    first[1:] |= lines[found.start[1:]] > lines[found.end[:-1]]
    begins = first.copy()
    begins[1:] |= STOP[block.data[found.end[:-1] - 1]]
    at = np.flatnonzero(begins)
    short = np.diff(np.append(at, n)) < OWN_WORDS
    at = at[first[at] | ~short]
    hashes = K.hash_words(block, found, lower=True)
    size = np.diff(np.append(at, n))
    at = np.union1d(at, _cuts(hashes, at, size))
    size = np.diff(np.append(at, n))
    doc = found.doc[at]
    start = found.start[at]
    end = np.append(start[1:], len(block.data))
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = block.at[doc[last] + 1]
    name = K.mix(np.add.reduceat(hashes * K.powers(int(size.max()))[K.runs(size)], at) ^ size.astype(K.U))
    return Sentences(start, end, doc, np.searchsorted(doc, np.arange(n_docs + 1)), size, name)


def runs(s: Sentences, run_words: int = RUN_WORDS, alone_words: int = ALONE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first sentence and number of sentences of every run that counts, in order of document and position."""
    n = len(s.doc)
    done = np.concatenate([[0], np.cumsum(s.words)])
    here = np.arange(n)
    stop = np.maximum(np.searchsorted(done, done[:-1] + run_words, "left"), here + 2)
    start = np.minimum(np.searchsorted(done, done[1:] - run_words, "right") - 1, here - 1)
    on, up = stop <= s.of_doc[s.doc + 1], start >= s.of_doc[s.doc]
    # Up to a sentence only where no run from another one on ends.
    ended = np.zeros(n + 1, bool)
    ended[stop[on]] = True
    up &= ~ended[1:]
    alone = np.flatnonzero(s.words >= alone_words)
    span = np.unique(np.concatenate([here[on] * (n + 1) + stop[on], start[up] * (n + 1) + here[up] + 1, alone * (n + 1) + alone + 1]))
    at, stop = span // (n + 1), span % (n + 1)
    # A polynomial of the sentences' names; its powers are taken back to those of the run's start.
    total = np.concatenate([np.zeros(1, K.U), np.cumsum(s.name * K.powers(n))])
    back = np.full(n, INVERSE)
    back[:1] = 1
    name = (total[stop] - total[at]) * np.multiply.accumulate(back)[at]
    size = stop - at
    return K.mix(name ^ K.mix(size.astype(K.U))), at, size


def _later(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Which runs their own document has earlier."""
    order = np.lexsort((np.arange(len(name)), name, doc))
    same = np.zeros(len(name), bool)
    same[1:] = (doc[order][1:] == doc[order][:-1]) & (name[order][1:] == name[order][:-1])
    out = np.zeros(len(name), bool)
    out[order] = same
    return out


def _spans(docs: DataFrame, least: tuple[int, int]) -> DataFrame:
    """run, doc_id: every distinct run of each document."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for block in K.blocks(batch.column("text")):
                s = sentences(block)
                name, at, _ = runs(s, *least)
                doc = s.doc[at]
                first = ~_later(doc, name)
                yield pa.RecordBatch.from_arrays([pa.array(name[first].view(np.int64)), pa.array(ids[block.first + doc[first]], pa.int64())], names=["run", "doc_id"])

    return docs.mapInArrow(hashes, "run long, doc_id long")


def _without(batches: Iterator[pa.RecordBatch], column: str, known: str, kept: list[str], counts: bool, least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column(known).fill_null([])
        mark_ends, mark_names = marks.offsets.to_numpy(), marks.values.to_numpy(zero_copy_only=False).view(K.U)
        texts, n_sentences, n_removed = [], [], []
        for block in K.blocks(batch.column(column)):
            s = sentences(block)
            name, at, size = runs(s, *least)
            doc = s.doc[at]
            n_docs = block.last - block.first
            own = slice(mark_ends[block.first], mark_ends[block.last])
            mark_doc = np.repeat(np.arange(n_docs), np.diff(mark_ends[block.first : block.last + 1]))
            tag = lambda d, x: K.mix(x ^ K.mix(d.astype(K.U)))
            repeats = np.isin(tag(doc, name), tag(mark_doc, mark_names[own])) | _later(doc, name)
            covers = np.zeros(len(s.doc) + 1, np.int64)
            np.add.at(covers, at[repeats], 1)
            np.add.at(covers, at[repeats] + size[repeats], -1)
            gone = np.cumsum(covers)[:-1] > 0
            removed = np.bincount(s.doc[gone], minlength=n_docs)
            raw = block.data.tobytes()
            bounds = block.at.tolist()
            for k in range(n_docs):
                if not removed[k]:
                    texts.append(raw[bounds[k] : bounds[k + 1]])
                    continue
                mine = range(s.of_doc[k], s.of_doc[k + 1])
                head = raw[bounds[k] : s.start[mine[0]]]
                texts.append(head + b"".join(raw[s.start[i] : s.end[i]] for i in mine if not gone[i]))
            n_sentences.append(np.diff(s.of_doc))
            n_removed.append(removed)
        if not texts:
            continue
        text = pa.array(texts, pa.binary()).cast(pa.string())
        if batch.column(column).null_count:
            text = pc.if_else(batch.column(column).is_null(), pa.scalar(None, pa.string()), text)
        columns = [text if c == column else batch.column(c) for c in kept]
        added = [pa.array(np.concatenate(x).astype(np.int64)) for x in (n_sentences, n_removed)] if counts else []
        yield pa.RecordBatch.from_arrays([*columns, *added], names=[*kept, *COUNTS[: len(added)]])


def dedup_spans(docs: DataFrame, counts: bool = True, run_words: int = RUN_WORDS, alone_words: int = ALONE_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with repeated spans taken out of text; with ``counts``, n_sentences and n_removed (long) are added.

    Words are compared in lower case (A-Z), white space and breaks between them
    don't count. Texts are read whole, however long. A text that loses nothing
    stays as it is, byte for byte; one that loses every sentence becomes empty;
    null stays null. Repeats of fewer than ``run_words`` words, or of one sentence
    under ``alone_words``, stay, and so does what of a repeated passage shares a
    sentence with other text. Rows with a null doc_id come last in order. Rows
    that share a doc_id count as one document: what one of them has first, the
    others keep too, so exact repeated rows stay alike. An empty table gives no
    rows. Runs are told apart by 64-bit hashes. With ``counts``, columns called
    n_sentences or n_removed are replaced; other names don't matter. A run that
    very many documents have is a large key of the join, which adaptive
    execution splits.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).bitwiseOR(F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit(NO_ID - 1))))
    place, marks = free_name("place", docs), free_name("repeats", docs)
    spans = _spans(docs.select(order.alias("doc_id"), F.col("text").cast("string").alias("text")), (run_words, alone_words))
    first = spans.groupBy("run").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("run", "first_id")
    repeats = spans.join(first, "run").where("doc_id > first_id").groupBy("doc_id").agg(F.collect_set("run").alias(marks)).withColumnRenamed("doc_id", place)
    kept = [c for c in docs.columns if not counts or c not in COUNTS]
    marked = docs.select(*quoted(*kept)).withColumn("text", F.col("text").cast("string")).withColumn(place, order).join(repeats, place, "left").select(*quoted(*kept), marks)
    types = {f.name: f.dataType.simpleString() for f in marked.schema}
    schema = ", ".join([f"{quoted(c)[0]} {types[c]}" for c in kept] + [f"{c} long" for c in COUNTS if counts])
    return marked.mapInArrow(lambda batches: _without(batches, "text", marks, kept, counts, (run_words, alone_words)), schema)
