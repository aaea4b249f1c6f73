"""Exact Jaccard self-join on word shingles by vertical partitioning.

All shingles stand in one global order, rare ones first. Every document's set
is cut along that order into fragments; overlaps are counted fragment by
fragment and summed for each pair. Two sets that are similar enough share a
shingle among the first few of each (the prefix), so only pairs that meet there
are counted. Three things keep hot groups linear:

* equal sets are one class from the start;
* members of a posting list are first paired with its most central class only,
  and what links is joined into components;
* other pairs are formed only between classes of different components, which
  is all that can still change the result.

The order comes from a count sketch of fixed size; any order gives the same
result, a good one gives few candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import kernels as K
from quillrank.llm.components import components
from quillrank.llm.sketches import SCHEMA as SKETCH
from quillrank.llm.sketches import merged, pieces
from quillrank.llm.tables import free_name, quoted, stash, temporary

#: Counters of the sketch that gives the global order.
ORDER_WIDTH = 1 << 20
#: Bits of the filter of classes that have candidates.
FILTER_BITS = 1 << 23
FRAGMENTS = 4
#: A class with more partners than this is dealt over so many cells for each fragment.
PARTNERS, SALTS = 512, 8


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[K.Block, np.ndarray, np.ndarray]]:
    for block in K.blocks(batch.column("text")):
        found = K.words(block)
        doc, value = K.shingles(K.hash_words(block, found, lower=True), found.of_doc, n)
        yield block, doc, value


def _sums(ufunc: np.ufunc, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """ufunc over values[ends[i]:ends[i + 1]], 0 where there are none."""
    out = np.zeros(len(ends) - 1, values.dtype)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        out[full] = ufunc.reduceat(values, ends[:-1][full])
    return out


def _class_of(value: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set, that don't depend on order."""
    a = K.mix(_sums(np.add, K.mix(value ^ K.U(1)), ends))
    return a, _sums(np.bitwise_xor, K.mix(value ^ K.U(2)), ends)


def _order(docs: DataFrame, n: int) -> np.ndarray:
    """The sketch: about how often the shingles of each counter occur. Texts shorter than a shingle aren't counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_WIDTH, np.int64)
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                found = K.words(block)
                value = K.hash_windows(K.hash_words(block, found, lower=True), n)[K.windows_inside(found.of_doc, n, len(found.start))]
                total += np.bincount((value & K.U(ORDER_WIDTH - 1)).astype(np.int64), minlength=ORDER_WIDTH)
        yield pieces(np.minimum(total, 65535).astype(np.uint16))

    total = merged(docs.mapInArrow(count, SKETCH), ORDER_WIDTH, np.uint16, np.int64, np.add)
    return np.minimum(total, 2**31 - 1).astype(np.int32)


def _pivots(order: np.ndarray) -> np.ndarray:
    """Counts at which the global order is cut, so that fragments hold about as many shingles each."""
    ranked = np.sort(order).astype(np.float64)
    done = np.cumsum(ranked)
    at = np.searchsorted(done, done[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS) if done[-1] else np.zeros(FRAGMENTS - 1, int)
    return ranked[np.minimum(at, len(ranked) - 1)]


def _classes(docs: DataFrame, order, n: int, percent: int) -> DataFrame:
    """For each row: doc_id, n_shingles, class names a and b, the prefix, and central: minus how many shingles of the prefix are much rarer than its commonest."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for batch in batches:
            for block, doc, value in _sets(batch, n):
                docs_here = block.last - block.first
                ends = np.searchsorted(doc, np.arange(docs_here + 1))
                size = np.diff(ends)
                a, b = _class_of(value, ends)
                common = counts[(value & K.U(ORDER_WIDTH - 1)).astype(np.int64)]
                ranked = np.lexsort((value, common, doc))
                keep = size - -(-percent * size // 100) + 1
                keep[size == 0] = 0
                first = K.runs(size) < np.repeat(keep, size)
                most = _sums(np.maximum, common, ends)
                central = -_sums(np.add, (first & (4 * common[ranked] < np.repeat(most, size))).astype(np.int64), ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first, docs_here),
                        pa.array(size.astype(np.int64)),
                        pa.array(a.view(np.int64)),
                        pa.array(b.view(np.int64)),
                        pa.array(central),
                        K.lists(value[ranked][first].view(np.int64), doc[first], docs_here),
                    ],
                    names=["doc_id", "n_shingles", "a", "b", "central", "prefix"],
                )

    return docs.mapInArrow(prefixes, "doc_id long, n_shingles long, a long, b long, central long, prefix array<long>")


def _spot(doc_id: np.ndarray) -> np.ndarray:
    """The bit of the filter for a document that stands for its class, or for the name of a class without a doc_id."""
    return (K.mix(doc_id.view(K.U)) & K.U(FILTER_BITS - 1)).astype(np.int64)


def _filter_of(pairs: DataFrame, kinds: DataFrame) -> np.ndarray:
    wanted = pairs.select(F.col("l").alias("a")).union(pairs.select("r")).distinct().join(kinds, "a").select(F.coalesce("first_id", "a"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_spot(batch.column(0).to_numpy())] = True
        yield pieces(np.packbits(bits))

    return merged(wanted.mapInArrow(mark, SKETCH), FILTER_BITS // 8, np.uint8, np.uint8, np.bitwise_or)


def _segments(docs: DataFrame, order, pivots: np.ndarray, bits, n: int) -> DataFrame:
    """a, fragment, segment for the documents that the filter lets through: their sets, cut along the global order, perhaps several times for a class."""

    def through(spot: np.ndarray, passes: np.ndarray) -> np.ndarray:
        return ((passes[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1).astype(bool)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, passes = order.value, bits.value
        for batch in batches:
            # Rows without an id are known by their class only, once their sets are made.
            nameless = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            chosen = nameless | through(_spot(batch.column("doc_id").fill_null(0).to_numpy()), passes)
            nameless, batch = nameless[chosen], batch.filter(pa.array(chosen))
            for block, doc, value in _sets(batch, n):
                ends = np.searchsorted(doc, np.arange(block.last - block.first + 1))
                a, _ = _class_of(value, ends)
                wanted = (~nameless[block.first : block.last] | through(_spot(a), passes))[doc]
                doc, value = doc[wanted], value[wanted]
                if not len(doc):
                    continue
                fragment = np.searchsorted(pivots, counts[(value & K.U(ORDER_WIDTH - 1)).astype(np.int64)], "left")
                cell = doc * FRAGMENTS + fragment
                ranked = np.argsort(cell, kind="stable")
                cell, value = cell[ranked], value[ranked]
                first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                offsets = pa.array(np.r_[first, len(cell)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[cell[first] // FRAGMENTS].view(np.int64)), pa.array((cell[first] % FRAGMENTS).astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(value.view(np.int64)))],
                    names=["a", "fragment", "segment"],
                )

    return docs.mapInArrow(cut, "a long, fragment int, segment array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, kinds: DataFrame, order, pivots: np.ndarray, n: int, percent: int) -> DataFrame:
    """The pairs (l, r, l_size, r_size) that are similar enough, by partial overlaps summed over the fragments."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(pairs, kinds))
    # Classes with very many partners stand in so many cells, and their partners are dealt over these.
    ends = pairs.select(F.col("l").alias("a")).union(pairs.select("r"))
    hot = stash(ends.groupBy("a").agg(F.count("*").alias("partners")).where(F.col("partners") > PARTNERS).select("a", F.lit(SALTS).alias("salts")), "join-hot")
    salts = F.coalesce("salts", F.lit(1))
    segments = _segments(docs, order, pivots, bits, n).join(hot, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    # Several documents may pass for one class. Grouped by cell, its segments lie as both joins want them and are shuffled once.
    segments = segments.groupBy("a", "fragment", "salt").agg(F.first("segment").alias("segment"))
    left = segments.select(F.col("a").alias("l"), "fragment", F.col("salt").alias("l_salt"), F.col("segment").alias("l_segment"))
    right = segments.select(F.col("a").alias("r"), "fragment", F.col("salt").alias("r_salt"), F.col("segment").alias("r_segment"))
    cells = pairs
    for end, other in (("l", "r"), ("r", "l")):
        cells = cells.join(hot.withColumnRenamed("a", end), end, "left").withColumn(f"{end}_salt", F.pmod(F.xxhash64(other), salts).cast("int")).drop("salts")
    cells = cells.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    partial = cells.join(left, ["l", "fragment", "l_salt"]).join(right, ["r", "fragment", "r_salt"]).select("l", "r", "l_size", "r_size", F.size(F.array_intersect("l_segment", "r_segment")).alias("shared"))
    shared = partial.groupBy("l", "r", "l_size", "r_size").agg(F.sum("shared").alias("shared"))
    return shared.where(F.col("shared") * 100 >= (F.col("l_size") + F.col("r_size") - F.col("shared")) * percent).select("l", "r")


def _pairs(left: DataFrame, right: DataFrame, apart, percent: int) -> DataFrame:
    """Distinct pairs (l, r, l_size, r_size) that meet at a shingle and can be similar enough.

    If the shingle is the first that two sets share, what comes before it is
    lost to their overlap; a pair that fails so at its first one fails at all.
    """
    x_size, y_size = F.col("x.n_shingles"), F.col("y.n_shingles")
    most = F.least(x_size - F.col("x.place"), y_size - F.col("y.place"))
    can = most * 100 >= (x_size + y_size - most) * percent
    met = left.alias("x").join(right.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & apart & can)
    swapped = F.col("x.a") > F.col("y.a")
    ends = [F.when(swapped, F.col(f"{q}.{c}")).otherwise(F.col(f"{p}.{c}")).alias(name) for p, q, c, name in (("x", "y", "a", "l"), ("y", "x", "a", "r"), ("x", "y", "n_shingles", "l_size"), ("y", "x", "n_shingles", "r_size"))]
    return met.select(*ends).distinct()


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Join ``docs`` (doc_id, text) with itself where the Jaccard similarity of their n-word shingle sets is ``percent`` % or more.

    Returns doc_id, n_shingles and component_id, the smallest doc_id that links
    lead to. Texts are read whole, however long. Words are runs without ASCII
    white space, A-Z lower-cased; a shorter text is one shingle. Pairs at
    exactly ``percent`` % link, and which of tied classes is a hub doesn't
    change the result. Null and empty texts have no shingles and are
    components of their own; equal sets always share one. A row with a null
    doc_id joins its component but never names it. Repeated rows are kept; an
    empty table gives no rows; other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = _order(docs, n)
    order, pivots = context.broadcast(counts), _pivots(counts)
    with temporary() as keep:
        sets = keep(stash(_classes(docs, order, n, percent), "join-sets"))
        classes = sets.where("n_shingles > 0").groupBy("a", "b", "n_shingles").agg(F.min("doc_id").alias("first_id"), F.first("prefix").alias("prefix"), F.first("central").alias("central"))
        kinds = keep(stash(sets.where("n_shingles > 0").groupBy("a", "n_shingles").agg(F.min("doc_id").alias("first_id"), F.first("central").alias("central")), "join-classes"))
        postings = classes.select("a", F.posexplode("prefix").alias("place", "shingle"))
        repeated = postings.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle")
        met = stash(postings.join(repeated, "shingle").join(kinds.select("a", "n_shingles", "central"), "a"), "join-postings")

        # Each list against its most central class.
        hubs = met.groupBy("shingle").agg(F.max(F.struct("central", "a", "n_shingles", "place")).alias("hub")).select("shingle", "hub.*")
        stars = stash(_pairs(met, hubs, F.col("x.a") != F.col("y.a"), percent), "join-stars")
        links = stash(_verified(stars, docs, kinds, order, pivots, n, percent), "join-links")
        parts = stash(components(links), "join-parts")

        # What is left: pairs of different components that still meet in a list.
        marked = met.join(parts.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
        mixed = marked.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle")
        open_lists = stash(marked.join(mixed, "shingle").select("shingle", "a", "n_shingles", "place", "label"), "join-open")
        cross = _pairs(open_lists, open_lists, (F.col("x.a") < F.col("y.a")) & (F.col("x.label") != F.col("y.label")), percent)
        cross = stash(cross.join(stars.select("l", "r"), ["l", "r"], "left_anti"), "join-cross")
        more = stash(_verified(cross, docs, kinds, order, pivots, n, percent), "join-links")
        parts = keep(stash(components(links.union(more)), "join-parts"))

    labelled = kinds.join(parts.withColumnRenamed("node", "a"), "a", "left").select("a", F.coalesce("label", "a").alias("label"), "first_id")
    names = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(names, "label").select("a", "component_id")
    some = sets.where("n_shingles > 0").select("a", "doc_id", "n_shingles").join(named, "a", "left").select("doc_id", "n_shingles", "component_id")
    return some.union(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest doc_id, with all their columns.

    Rows that share a doc_id are one document: the one whose text comes first
    stays, of repeated rows one. Rows with a null doc_id, which have no name to
    be kept by, stay; so do null and empty texts. Texts are compared whole,
    however long. An empty table gives no rows; other columns, whatever their
    names, go along.
    """
    key, mark, rank = F.col("doc_id").cast("long"), free_name("kept_id", docs), free_name("place", docs)
    firsts = stash(ngram_join(docs, n, percent).where("doc_id = component_id").select("doc_id").distinct(), "join-firsts")
    # Ids are a small part of the rows; hashed on, texts are shuffled once and not sorted.
    kept = docs.withColumn(mark, key).join(firsts.withColumnRenamed("doc_id", mark).hint("shuffle_hash"), mark, "left_semi")
    repeated = stash(docs.groupBy(key.alias(mark)).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1).where(F.col(mark).isNotNull()).select(mark), "join-repeated")
    if not repeated.isEmpty():
        # Tasks keep the first text of each id that they meet, so however many rows share one, few are shuffled.
        first_text = F.struct(F.col("text").isNotNull().alias("there"), F.coalesce("text", F.lit("")).alias("text"))
        again = kept.join(repeated, mark, "left_semi")
        one = again.groupBy(mark).agg(F.min_by(F.struct(*quoted(*again.columns)), first_text).alias(rank)).select(f"`{rank}`.*")
        kept = kept.join(repeated, mark, "left_anti").unionByName(one)
    columns = quoted(*docs.columns)
    return kept.select(*columns).union(docs.where(key.isNull()).select(*columns))


ORACLE_JOIN = """
WITH RECURSIVE word_lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')) END) AS g FROM word_lists
), grams AS (SELECT doc_id, unnest(g) AS g FROM sets),
links AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN (SELECT doc_id AS x, len(g) AS nx FROM sets) USING (x) JOIN (SELECT doc_id AS y, len(g) AS ny FROM sets) USING (y)
  WHERE 100 * shared >= {percent} * (nx + ny - shared)
), reach(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM sets JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""
