"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A text's terms are its words and the beginnings of its longer words. A term
weighs (1 + log of its count) * idf * relevance: document frequencies are
counted over all documents, and the relevance of a term (log2 of 2 plus its
toxic examples over its clean ones) raises what goes with toxic texts. The
examples' terms are the vocabulary; no term of theirs is left out.

Labelled vectors stand in blocks of alike ones. The inverted index has for each
term the blocks that hold it, its largest weight there, and its postings; the
terms with the longest lists have them written out as rows, a weight for every
example. What the rows give, and the sum of a text's other weights times the
blocks' largest, bound all cosines in a block, and a block is scored only for
texts whose bound on it can still beat their k-th best, so the neighbours are
exact. Their votes, weighted by distance, are the score, and the nearest ones
are the evidence.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import kernels as K
from quillrank.llm.sketches import SCHEMA as COUNTERS
from quillrank.llm.sketches import merged, pieces
from quillrank.llm.tables import opened, stash
from quillrank.stored import fresh_folder

#: Most labelled examples of each label, those of the lowest hashes of doc_id.
MOST_TOXIC, MOST_CLEAN = 1000, 3000
#: Bytes of the beginnings that count beside whole words.
BEGINNING = 8
NEIGHBOURS, BLOCK, EVIDENCE = 12, 64, 3
NEAREST = 0.01
#: Votes of the mean rate that join those of the neighbours.
SMOOTHING = 0.1

SEPARATORS = np.ones(256, bool)
SEPARATORS[65:91] = SEPARATORS[97:123] = SEPARATORS[128:] = False
FILTER = 1 << 22
#: Terms whose lists are rows.
COMMON = 512
#: Texts, and terms of texts, that are scored at once.
TEXTS, PORTION = 256, 60_000
#: Dimensions in which examples are compared to put alike ones into one block.
SIGNS = 128


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII and Latin-1 capitals in lower case."""
    low = K.LOWER[data]
    accented = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    low[accented] += 0x20
    return low


def terms(block: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, documents and counts of the distinct terms of each document, in order of document and name."""
    found = K.words(block, SEPARATORS)
    size = found.end - found.start
    if not len(size):
        return np.zeros(0, K.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offset = K.runs(size)
    values = K.BYTE_CODE[folded(block.data)[np.repeat(found.start, size) + offset]] * K.powers(int(size.max()))[offset]
    total = np.concatenate([np.zeros(1, K.U), np.cumsum(values)])
    first, doc = np.cumsum(size) - size, found.doc
    long = size > BEGINNING
    name = np.concatenate([K.mix((total[first + size] - total[first]) ^ K.U(1)), K.mix((total[first[long] + BEGINNING] - total[first[long]]) ^ K.U(2))])
    doc = np.concatenate([doc, doc[long]])
    order = np.lexsort((name, doc))
    name, doc = name[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
    at = np.flatnonzero(new)
    return name[at], doc[at], np.diff(np.append(at, len(doc)))


class Vocabulary:
    """Names in order, and which of them given names are."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.may = np.zeros(FILTER, bool)
        self.may[(names & K.U(FILTER - 1)).astype(np.int64)] = True

    def known(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the given names that are in the vocabulary, and their terms."""
        hit = np.flatnonzero(self.may[(name & K.U(FILTER - 1)).astype(np.int64)])
        if not len(hit) or not len(self.names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        term = np.minimum(np.searchsorted(self.names, name[hit]), len(self.names) - 1)
        same = self.names[term] == name[hit]
        return hit[same], term[same]


def arranged(doc: np.ndarray, name: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """An order of n sparse vectors in which alike ones are close: halves along their main direction, again and again."""
    sign = lambda k: (K.mix(name ^ K.U(k)) & K.U(1)).astype(np.float64) * 2 - 1
    x = np.stack([np.bincount(doc, weight * sign(k), n) for k in range(SIGNS)], axis=1)
    out, waiting = [], [np.arange(n)]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= BLOCK:
            out.append(rows)
            continue
        part = x[rows] - x[rows].mean(axis=0)
        way = np.ones(SIGNS)
        for _ in range(12):
            way = part.T @ (part @ way)
            way /= max(np.sqrt(way @ way), 1e-300)
        ranked = rows[np.argsort(part @ way, kind="stable")]
        half = -(-(len(rows) // 2) // BLOCK) * BLOCK
        waiting += [ranked[half:], ranked[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Bounds:
    """What may be an example: so many of label 0 and of label 1, those of the lowest hashes of doc_id; texts of so many bytes at most, and of one label so many terms in all. They bound the index."""

    clean: int = MOST_CLEAN
    toxic: int = MOST_TOXIC
    longest: int = 1 << 16
    terms: int = 2_000_000


@dataclass
class Index:
    """Distinct labelled vectors in blocks: by term its row or, with the largest weight there and the postings, its blocks."""

    weight: np.ndarray
    row: np.ndarray
    rows: np.ndarray
    of_term: np.ndarray
    block: np.ndarray
    largest: np.ndarray
    of_entry: np.ndarray
    place: np.ndarray
    share: np.ndarray
    rate: np.ndarray
    votes: np.ndarray
    example: np.ndarray
    toxic: np.ndarray
    prior: float

    def unit(self, doc: np.ndarray, term: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """The coordinates of unit vectors."""
        x = (1 + np.log(times)) * self.weight[term]
        length = np.sqrt(np.bincount(doc, x * x, n))
        return x / np.maximum(length[doc], 1e-300)

    def nearest(self, doc: np.ndarray, term: np.ndarray, x: np.ndarray, n: int, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar entries of each of n unit vectors, most similar first (ties: the lowest entry), and their cosines; -1 and 0 where fewer share a term."""
        n_blocks = -(-len(self.rate) // BLOCK)
        best, found = np.zeros((n, k)), np.full((n, k), -1, np.int64)
        row = self.row[term]
        rare = row < 0
        common = np.zeros((n, len(self.rows)))
        common[doc[~rare], row[~rare]] = x[~rare]
        dense = (common @ self.rows).reshape(n, n_blocks, BLOCK)
        term, doc, x = term[rare], doc[rare], x[rare]
        size = self.of_term[term + 1] - self.of_term[term]
        entry = np.repeat(self.of_term[term], size) + K.runs(size)
        text, x = np.repeat(doc, size), np.repeat(x, size)
        block = self.block[entry]
        bound = dense.max(axis=2) + np.bincount(text * n_blocks + block.astype(np.int64), x * self.largest[entry], n * n_blocks).reshape(n, n_blocks)
        by_block = np.argsort(block, kind="stable")
        starts = np.searchsorted(block[by_block], np.arange(n_blocks + 1))
        for b in np.argsort(-bound.mean(axis=0), kind="stable").tolist():
            active = (bound[:, b] > 0) & (bound[:, b] >= best[:, -1] - 1e-9)
            texts = np.flatnonzero(active)
            if not len(texts):
                continue
            own = by_block[starts[b] : starts[b + 1]]
            own = own[active[text[own]]]
            size = self.of_entry[entry[own] + 1] - self.of_entry[entry[own]]
            posting = np.repeat(self.of_entry[entry[own]], size) + K.runs(size)
            at = (np.cumsum(active) - 1)[text[own]]
            cosine = dense[texts, b] + np.bincount(np.repeat(at * BLOCK, size) + self.place[posting], np.repeat(x[own], size) * self.share[posting], len(texts) * BLOCK).reshape(-1, BLOCK)
            better = np.flatnonzero(cosine.max(axis=1) >= best[texts, -1] - 1e-9)
            texts, cosine = texts[better], cosine[better]
            ids = np.where(cosine > 0, b * BLOCK + np.arange(BLOCK), -1)
            both, names = np.concatenate([best[texts], cosine], axis=1), np.concatenate([found[texts], ids], axis=1)
            order = np.lexsort((names, -np.round(both, 9)), axis=1)[:, :k]
            best[texts], found[texts] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        return found, best

    def score(self, doc: np.ndarray, term: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, and the nearest entries and their cosines, of n texts; the mean rate where no entry shares a term."""
        found, cosine = self.nearest(doc, term, self.unit(doc, term, times, n), n)
        vote = np.where(found >= 0, self.votes[found], 0) / (NEAREST + np.maximum(0, 1 - cosine)) ** 2
        return ((vote * self.rate[found]).sum(axis=1) + SMOOTHING * self.prior) / (vote.sum(axis=1) + SMOOTHING), found, cosine


def build_index(doc: np.ndarray, term: np.ndarray, times: np.ndarray, doc_id: np.ndarray, label: np.ndarray, weight: np.ndarray, stands: tuple[float, float], names: np.ndarray) -> Index:
    """The index of examples with terms (doc, term, times, in order); ``stands``: how many labelled documents an example of label 0, and of label 1, stands for."""
    n = len(doc_id)
    ends = np.searchsorted(doc, np.arange(n + 1))
    tag = K.mix(names[term] ^ K.mix(times.astype(K.U)))
    whole = np.concatenate([np.zeros(1, K.U), np.cumsum(tag)])
    # Equal texts of terms are one entry, named by the smallest doc_id.
    _, sample, group = np.unique(whole[ends[1:]] - whole[ends[:-1]], return_index=True, return_inverse=True)
    entries = len(sample)
    ones, zeros = (np.bincount(group, (label == k) * stands[k], entries) for k in (1, 0))
    smallest = np.full(entries, np.iinfo(np.int64).max)
    np.minimum.at(smallest, group, doc_id)
    prior = ones.sum() / max(1e-9, ones.sum() + zeros.sum())
    size = (ends[1:] - ends[:-1])[sample]
    at = np.repeat(ends[:-1][sample], size) + K.runs(size)
    doc, term, times = np.repeat(np.arange(entries), size), term[at], times[at]
    none = np.zeros(0)
    index = Index(weight, none, none, none, none, none, none, none, none, none, none, none, none, float(prior))
    x = index.unit(doc, term, times, entries)
    order = arranged(doc, names[term], x, entries)
    place = np.empty(entries, np.int64)
    place[order] = np.arange(entries)
    doc = place[doc]
    ranked = np.lexsort((doc, term))
    doc, term, x = doc[ranked], term[ranked], x[ranked]
    longest = np.lexsort((names, -np.bincount(term, minlength=len(names))))[:COMMON]
    index.row = np.full(len(names), -1, np.int32)
    index.row[longest] = np.arange(len(longest))
    index.rows = np.zeros((len(longest), -(-entries // BLOCK) * BLOCK))
    in_row = index.row[term] >= 0
    index.rows[index.row[term[in_row]], doc[in_row]] = x[in_row]
    doc, term, x = doc[~in_row], term[~in_row], x[~in_row]
    block = doc // BLOCK
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])][: len(term)])
    index.of_entry = np.append(first, len(term)).astype(np.int32)
    index.of_term = np.searchsorted(term[first], np.arange(len(weight) + 1)).astype(np.int32)
    index.block = block[first].astype(np.int16)
    index.largest = np.maximum.reduceat(x, first) if len(first) else none
    index.place, index.share = (doc % BLOCK).astype(np.uint8), x
    index.rate, index.votes = (ones / (ones + zeros))[order], (ones + zeros)[order]
    index.example, index.toxic = smallest[order], (ones > zeros).astype(np.int32)[order]
    return index


def _known(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in K.blocks(batch.column("text")):
            name, doc, times = terms(block)
            n = block.last - block.first
            ids, label = (batch.column(c).slice(block.first, n) for c in ("doc_id", "label"))
            yield pa.RecordBatch.from_arrays([ids, label, pa.array(np.bincount(doc, minlength=n)), K.lists(name.view(np.int64), doc, n), K.lists(times.astype(np.int32), doc, n)], names=["doc_id", "label", "n_terms", "terms", "times"])


def _examples(docs: DataFrame, labels: DataFrame, bounds: Bounds) -> tuple[DataFrame, tuple[float, float]] | None:
    """doc_id, label, terms and times of the examples, and how many labelled documents one of each label stands for; None where a label is missing."""
    spark, known = docs.sparkSession, _known(labels)
    totals = dict(known.groupBy("label").count().collect())
    if len(totals) < 2:
        return None
    lowest = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect() for k, most in enumerate((bounds.clean, bounds.toxic))]
    sample = spark.createDataFrame([tuple(r) for part in lowest for r in part], "doc_id long, label int").distinct()
    # The sample is bounded by its two parameters, and so are its texts.
    short = docs.join(F.broadcast(sample), "doc_id").where(F.octet_length("text") <= bounds.longest)
    one = short.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = stash(one.mapInArrow(_example_terms, "doc_id long, label int, n_terms long, terms array<long>, times array<int>"), "toxicity-examples")
    sizes = {(r.doc_id, r.label): r.n_terms for r in found.where("n_terms > 0").select("doc_id", "label", "n_terms").collect()}
    chosen = []
    for part in lowest:
        total = 0
        for key in dict.fromkeys(map(tuple, part)):
            total += sizes.get(key, 0)
            if key in sizes and total <= bounds.terms:
                chosen.append(key)
    counts = [sum(label == k for _, label in chosen) for k in (0, 1)]
    if not all(counts):
        return None
    rows = found.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, label int")), ["doc_id", "label"]).select("doc_id", "label", "terms", "times")
    return rows, (totals[0] / counts[0], totals[1] / counts[1])


def _in_one_task(rows: DataFrame, make: Callable[[pa.Table], object], folder: str) -> str:
    """What ``make`` makes of all the rows, few by the bounds, in order of doc_id and label; a file in the shared folder, so it never passes the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make(pa.Table.from_batches(list(batches)))
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.pickle"
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            pickle.dump(made, out, protocol=5)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["file"])

    return rows.repartition(1).sortWithinPartitions("doc_id", "label").mapInArrow(work, "file string").first().file


def read_made(file: str):
    """What a file holds. Every task reads it for itself and lets go of it, so workers don't keep an index for the stages after."""
    system, path = opened(file)
    with system.open_input_stream(path, compression=None) as source:
        return pickle.loads(source.read())  # noqa: S301  written by the task above


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).combine_chunks().flatten().to_numpy()


def document_frequencies(docs: DataFrame, names: str) -> np.ndarray:
    """In how many of all documents each term of the file ``names`` is, and, last, the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(read_made(names))
        total = np.zeros(len(vocabulary.names) + 1, np.int32)
        for batch in batches:
            total[-1] += batch.num_rows
            for block in K.blocks(batch.column("text")):
                _, term = vocabulary.known(terms(block)[0])
                total[:-1] += np.bincount(term, minlength=len(total) - 1).astype(np.int32)
        yield pieces(total)

    n = docs.sparkSession.createDataFrame([(names,)], "file string").mapInArrow(_length, "n long").first().n
    return merged(docs.select("text").mapInArrow(count, COUNTERS), n + 1, np.int32, np.int64, np.add)


def _length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(read_made(f)) for f in batch.column(0).to_pylist()], pa.int64())], names=["n"])


def fit_examples(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> str | None:
    """The file that holds the vocabulary and the index, which a task makes; None where one of the labels is missing."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _examples(docs, labels, bounds)
    if found is None:
        return None
    rows, stands = found
    folder = fresh_folder(docs.sparkSession, "toxicity-index")
    df = document_frequencies(docs, _in_one_task(rows, lambda found: np.unique(_column(found, "terms").view(K.U)), folder))
    shared = docs.sparkSession.sparkContext.broadcast(df.astype(np.int32))

    def build(found: pa.Table) -> tuple[np.ndarray, Index]:
        label, doc_id = found.column("label").to_numpy(), found.column("doc_id").to_numpy()
        doc = np.repeat(np.arange(len(found)), np.diff(found.column("terms").combine_chunks().offsets.to_numpy()))
        names, term = np.unique(_column(found, "terms").view(K.U), return_inverse=True)
        with_term = [np.bincount(term, label[doc] == k, len(names)) * stands[k] for k in (0, 1)]
        weight = np.log(1 + shared.value[-1] / np.maximum(shared.value[:-1], 1)) * np.log2(2 + with_term[1] / np.maximum(1, with_term[0]))
        return names, build_index(doc, term, _column(found, "times"), doc_id, label, weight, stands, names)

    return _in_one_task(rows, build, folder)


def _judged(texts: pa.Array, vocabulary: Vocabulary, index: Index) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some texts at a time, in order: how many, their scores, and the nearest entries and cosines."""
    for block in K.blocks(texts):
        name, doc, times = terms(block)
        hit, term = vocabulary.known(name)
        doc, times = doc[hit], times[hit]
        n = block.last - block.first
        ends = np.searchsorted(doc, np.arange(n + 1))
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + PORTION, "right")) - 1)
            last = min(last, first + TEXTS, n)
            own = slice(ends[first], ends[last])
            yield last - first, *index.score(doc[own] - first, term[own], times[own], last - first)
            first = last


def score_toxicity(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text), as ``labels`` (doc_id, label: 1 is toxic) mark it.

    Returns doc_id, score (calibrated, 0 to 1) and evidence, the nearest
    examples (doc_id, toxic, cosine). Texts are read whole, however long; only
    examples are bounded (``Bounds``). Null and empty texts, and those that share no
    term with an example, score as the share of label 1 and have no evidence;
    rows with a null doc_id are scored; repeated rows score alike; of rows that
    share a labelled doc_id the text that comes first is the example; between
    equal cosines the lower entry of the index is nearer; without labels of
    both kinds every score is 0 and has no evidence; an empty table gives no
    rows; other columns are ignored.
    """
    found = fit_examples(docs, labels, bounds)
    if found is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(None).cast("array<struct<doc_id:bigint,toxic:int,cosine:double>>").alias("evidence"))
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, index = read_made(found)
        vocabulary = Vocabulary(names)
        for batch in batches:
            at = 0
            for n, score, entry, cosine in _judged(batch.column("text"), vocabulary, index):
                entry, cosine = entry[:, :EVIDENCE], np.minimum(cosine[:, :EVIDENCE], 1.0)
                there = entry >= 0
                near = pa.StructArray.from_arrays([pa.array(index.example[entry[there]]), pa.array(index.toxic[entry[there]]), pa.array(cosine[there])], names=["doc_id", "toxic", "cosine"])
                ends = pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), pa.array(score), pa.ListArray.from_arrays(ends, near)], names=["doc_id", "score", "evidence"])
                at += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, score double, evidence array<struct<doc_id:bigint,toxic:int,cosine:double>>")


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5, bounds: Bounds = Bounds()) -> DataFrame:
    """The rows of ``docs`` that score under ``limit``, with all their columns, whatever their names.

    Texts are judged where they lie and not shuffled. Null and empty texts
    score as the share of label 1, so they stay where most labels are 0;
    repeated rows stay or go together; without labels of both kinds all rows
    stay; an empty table gives no rows.
    """
    found = fit_examples(docs, labels, bounds)
    if found is None:
        return docs
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, index = read_made(found)
        vocabulary = Vocabulary(names)
        for batch in batches:
            at = 0
            for n, score, _, _ in _judged(batch.column("text"), vocabulary, index):
                yield batch.slice(at, n).filter(pa.array(score < limit))
                at += n

    return docs.mapInArrow(keep, docs.schema)
