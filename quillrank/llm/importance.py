"""Resampling documents towards a target distribution of hashed word n-grams, by importance weights and Gumbel keys.

N-grams are never made as strings. Each word's CRC-32 is computed once; that of
a run of words follows from the parts: the checksum of A before B is A's,
shifted by the length of B (a matrix over GF(2), kept as tables by byte), added
to B's. A space before a word is one more such part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm import kernels as K
from quillrank.llm.sketches import SCHEMA as SKETCH
from quillrank.llm.sketches import merged, pieces
from quillrank.llm.tables import free_name, quoted, stash

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, "42"

# Bytes of words: digits, letters and all that isn't ASCII.
NO_WORD = np.ones(256, bool)
NO_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

POLYNOMIAL = np.uint32(0xEDB88320)
ONES = np.uint32(0xFFFFFFFF)
#: Shifts of fewer bytes have a matrix each; longer ones are put together from powers of two.
NEAR = 64


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ POLYNOMIAL, c >> np.uint32(1))
    return c


BYTE = _byte_table()


def apply_matrix(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit vectors over GF(2), given by its values for each of the four bytes."""
    return matrix[0, crc & 255] ^ matrix[1, (crc >> 8) & 255] ^ matrix[2, (crc >> 16) & 255] ^ matrix[3, crc >> 24]


def _near_shifts() -> np.ndarray:
    """The matrices of 0 .. NEAR zero bytes."""
    out = np.zeros((NEAR + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for n in range(NEAR):
        out[n + 1] = BYTE[out[n] & 255] ^ (out[n] >> np.uint32(8))
    return out


SHIFT = _near_shifts()
#: The matrices of NEAR, 2 * NEAR, 4 * NEAR ... bytes, as far as they were needed.
_doubled = [SHIFT[NEAR]]


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each checksum as if n more zero bytes followed, without the ones at its ends."""
    low, rest = n % NEAR, n // NEAR
    out = SHIFT[low, 0, crc & 255] ^ SHIFT[low, 1, (crc >> 8) & 255] ^ SHIFT[low, 2, (crc >> 16) & 255] ^ SHIFT[low, 3, crc >> 24]
    power = 0
    while rest.any():
        if power == len(_doubled):
            _doubled.append(apply_matrix(_doubled[-1], _doubled[-1]))
        odd = np.flatnonzero(rest & 1)
        out[odd] = apply_matrix(_doubled[power], out[odd])
        rest, power = rest >> 1, power + 1
    return out


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end], all words a byte further at a time; longer ones than NEAR bytes one by one."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    begin, length = start[order], size[order]
    crc = np.full(len(order), ONES)
    for k in range(min(NEAR, int(length[0]) if len(length) else 0)):
        n = int(np.searchsorted(-length, -k, "left"))
        crc[:n] = BYTE[(crc[:n] ^ data[begin[:n] + k]) & 255] ^ (crc[:n] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = crc ^ ONES
    for i in np.flatnonzero(size > NEAR):
        out[i] = zlib.crc32(data[start[i] : end[i]])
    return out


def feature_crcs(block: K.Block, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, K.Words]]:
    """For runs of 1, 2, ... ``longest`` words: checksums by first word, which of these runs lie in one document, and the words."""
    found, data = K.words(block, NO_WORD), K.LOWER[block.data]
    own, size = word_crcs(data, found.start, found.end), found.end - found.start
    spaced = shifted(np.full(len(own), np.uint32(zlib.crc32(b" "))), size) ^ own
    run = own
    for n in range(1, longest + 1):
        yield run, K.windows_inside(found.of_doc, n, len(own)), found
        if len(run) <= 1:
            break
        run = shifted(run[:-1], size[n:] + 1) ^ spaced[n:]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all ``texts`` (text) fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                for crc, inside, _ in feature_crcs(block, longest):
                    total += np.bincount(crc[inside] % np.uint32(buckets), minlength=buckets)
        yield pieces(total)

    return merged(texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, SKETCH), buckets, np.int64, np.int64, np.add)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, a thousand times the logarithm of how much likelier it is in the target, rounded down."""
    buckets, s, t = len(source), float(source.sum()), float(target.sum())
    ratio = ((target + 1.0) * (s + buckets)) / ((source + 1.0) * (t + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of ``docs`` (doc_id, text)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                n_docs = block.last - block.first
                n_words, n_features, weight = (np.zeros(n_docs, np.int64) for _ in range(3))
                for n, (crc, inside, found) in enumerate(feature_crcs(block, longest), 1):
                    counts = np.diff(found.of_doc)
                    n_words = counts
                    n_features = n_features + np.maximum(counts - n + 1, 0)
                    sums = np.zeros(len(crc) + 1, np.int64)
                    np.cumsum(np.where(inside, gain[crc % np.uint32(len(gain))], 0), out=sums[1:])
                    at = np.minimum(found.of_doc, len(crc))
                    weight = weight + sums[at[1:]] - sums[at[:-1]]
                ids = batch.column("doc_id").slice(block.first, n_docs)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """A thousand times a Gumbel variable that depends on the seed and the id alone; all null ids share one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Draw ``percent`` % of the ``docs`` (doc_id, text) of ``least_words`` or more words, without replacement and in proportion to how much likelier their features are among the texts of ``target`` (text).

    Returns doc_id, n_features, weight, score, rank (long) for each row; rank
    is 1, 2, 3 ... by falling score for those that are drawn, else null. Equal
    scores go by doc_id, null last, repeated rows each take a place. Texts are
    read whole, however long; null and empty ones, and those without words, have
    no feature, weight 0 and are never drawn. An empty table gives no rows, an
    empty target makes buckets count by their rarity. Other columns are ignored.

    Of all counts, the driver gets one of each bucket. Only rows around the cut
    and above it are sorted, over ranges; a row's rank is its place in its range
    and how many rows the ranges before hold.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = weighed(docs, gain, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("tag", F.monotonically_increasing_id())
    scored = stash(scored, "importance")
    columns = ["doc_id", "n_features", "weight", "score"]
    able = scored.where(F.col("n_words") >= least_words)
    n, near = able.agg(F.count("*"), F.percentile_approx("score", max(0.0, 0.99 - percent / 100 - 0.01), 1000)).first()
    n_drawn = percent * n // 100
    if not n_drawn:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    # An estimate of the cut saves sorting the rest; where it is too high, all rows are sorted.
    high = F.col("score") >= near if able.where(F.col("score") >= near).count() >= n_drawn else F.lit(True)
    best_first = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tag")]
    placed = stash(able.where(high).repartitionByRange(*best_first).sortWithinPartitions(*best_first).withColumn("at", F.monotonically_increasing_id()).drop("tag"), "importance-ranks")
    part, inside = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each task
    rank = F.col("before") + inside + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(before), "part").select(*columns, F.when(rank <= n_drawn, rank).alias("rank"))
    rest = scored.where(~((F.col("n_words") >= least_words) & high)).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.union(rest)


def drawn_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that ``importance_resample`` draws, with all their columns; those that share a drawn doc_id all come, null ids don't."""
    mark = free_name("drawn", docs)
    drawn = stash(importance_resample(docs, target, **settings).where("rank is not null and doc_id is not null").select(F.col("doc_id").alias(mark)).distinct(), "drawn")
    return docs.withColumn(mark, F.col("doc_id").cast("long")).join(drawn, mark, "left_semi").select(*quoted(*docs.columns))


# The checksum of a string in SQL: {0} is the string, t the table of bytes.
SQL_CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
SQL_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen({0}) + 1), lambda k: CAST('0x' || substr(hex(encode({0})), 2 * k - 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

ORACLE_IMPORTANCE = (
    "WITH "
    + SQL_CRC_TABLE
    + """, word_lists AS (
  SELECT doc_id, is_target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT doc_id, text, false AS is_target FROM {docs} UNION ALL SELECT item_id, text, true FROM {target})
), features AS (
  SELECT doc_id, is_target, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS f FROM word_lists
), counted AS (SELECT doc_id, is_target, f, count(*) AS n FROM features GROUP BY ALL),
hashed AS (SELECT f, """
    + SQL_CRC.format("f")
    + """ % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), crc_table),
spread AS (SELECT doc_id, is_target, bucket, n FROM counted JOIN hashed USING (f)),
totals AS (SELECT CAST(coalesce(sum(n) FILTER (NOT is_target), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(n) FILTER (is_target), 0) AS DOUBLE) AS t_all FROM spread),
buckets AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (NOT is_target), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (is_target), 0) AS DOUBLE) AS t FROM spread GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM buckets, totals),
weights AS (SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM spread JOIN gains USING (bucket) WHERE NOT is_target GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, CAST(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM word_lists LEFT JOIN weights USING (doc_id) WHERE NOT is_target
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20 QUALIFY rank <= 5 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100
)
SELECT doc_id, n_features, weight, score, CAST(rank AS BIGINT) AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
)
