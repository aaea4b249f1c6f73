"""Document fingerprints by randomised edit embedding.

All texts share one random walk: at each step it says for every character
whether the reader moves on or reads the character once more. What is read is a
string in which near texts (by edit distance) differ in few places (by Hamming
distance). Fingerprints sample it at fixed places, as many in each octave, so
texts of any length compare place by place. Banding over samples finds
candidates, and comparing fingerprints verifies them. Bands grow with the
logarithm of the number of rows, so strangers seldom share one; a bucket that is
full all the same is dealt over cells that together see each of its pairs.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm import kernels as K
from quillrank.llm.components import components
from quillrank.llm.tables import stash, temporary

#: Kinds of characters the walk tells apart, steps after which it repeats, and its longest stay at a character.
KINDS, PERIOD, LONGEST = 64, 1 << 16, 255
#: Samples of each octave; the first one has so many places.
SAMPLES, FIRST_PLACES = 64, 128
#: Share of samples in which unrelated texts agree.
CHANCE = 0.13
ABSENT = 255
STEPS = 1024
BLOCK_BYTES = 1 << 23
PARTS_PER_PARTITION = 4
#: Documents are near from this likeness on; of pairs that are just so near, banding may miss this share.
LIKENESS, MISSED = 0.8, 0.01
#: Samples of a band beyond those at which one stranger shares it.
SPARE_SAMPLES = 3
#: Rows of a cell of which all pairs are compared at once; in a fuller one each row in turn meets those that it isn't joined to yet.
FULL = 64
#: Rows of a bucket that go to one cell together.
CELL_ROWS = 4096


def _stays() -> np.ndarray:
    """stays[kind, step]: how long the reader stays at a character that it meets at that step."""
    bits = K.mix(np.arange(PERIOD, dtype=K.U) ^ K.U(0x5EED))
    moves = (bits[None, :] >> np.arange(KINDS, dtype=K.U)[:, None]) & K.U(1)
    out = np.full((KINDS, PERIOD), LONGEST, np.int32)
    stay = np.full(KINDS, LONGEST, np.int32)
    for lap in range(2):
        for step in range(PERIOD - 1, -1, -1):
            stay = np.where(moves[:, step] == 1, 1, np.minimum(stay + 1, LONGEST))
            if lap:
                out[:, step] = stay
    return out


_tables: dict[str, np.ndarray] = {}


def _table(name: str, make) -> np.ndarray:
    if name not in _tables:
        _tables[name] = make()
    return _tables[name]


def places(octaves: int) -> np.ndarray:
    """The sampled places of the first octaves, in order."""
    out = []
    for o in range(octaves):
        low, high = (0, FIRST_PLACES) if o == 0 else (FIRST_PLACES << (o - 1), FIRST_PLACES << o)
        spread = K.mix(np.arange(SAMPLES, dtype=K.U) + K.U(1000 * o + 17)) % K.U((high - low) // SAMPLES)
        out.append(low + np.arange(SAMPLES) * ((high - low) // SAMPLES) + spread.astype(np.int64))
    return np.concatenate(out)


def octaves_of(length: int) -> int:
    """How many octaves hold all places below ``length``; at least one."""
    return max(1, math.ceil(math.log2(max(length, 1) / FIRST_PLACES)) + 1) if length > FIRST_PLACES else 1


def weights(n: int) -> np.ndarray:
    """What each of the first n samples counts: the places it stands for."""
    octave = np.arange(n) // SAMPLES
    return np.where(octave == 0, FIRST_PLACES, FIRST_PLACES * 2.0 ** (np.maximum(octave, 1) - 1)) / SAMPLES


def walk(kinds: np.ndarray, at: np.ndarray, begin: np.ndarray, mark: np.ndarray, sampled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Read texts kinds[at[i]:at[i + 1]] from step begin[i] on and note in sampled[i] the kind at every sampled place passed.

    Returns the step at which each text ends, and the step at which its
    character number mark[i] begins. Texts go side by side, the longest first.
    """
    stays = _table("stays", _stays).reshape(-1)
    where = places(sampled.shape[1] // SAMPLES)
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    step, marked = begin.astype(np.int64).copy(), begin.astype(np.int64).copy()
    longest = int(length.max()) if len(length) else 0
    for first in range(0, longest, STEPS):
        active = order[: int(np.searchsorted(-length[order], -first, "left"))]
        left = length[active] - first
        n = min(STEPS, int(left[0]))
        grid = np.zeros((n, len(active)), np.uint8)
        size = np.minimum(left, n)
        column, row = np.repeat(np.arange(len(active)), size), K.runs(size)
        grid[row, column] = kinds[np.repeat(at[active] + first, size) + row]
        base = grid.astype(np.int32) * PERIOD
        steps = np.empty((n + 1, len(active)), np.int32)
        now = step[active].astype(np.int32)
        live = len(active) - np.searchsorted(size[::-1], np.arange(n), "right")
        steps[0] = now
        for i, m in enumerate(live.tolist()):
            head = steps[i, :m]
            np.add(head, stays[base[i, :m] + (head & (PERIOD - 1))], out=steps[i + 1, :m])
            if m < len(active):
                steps[i + 1, m:] = steps[i, m:]
        now = steps[n]
        here = mark[active] - first
        inside = np.flatnonzero((here >= 0) & (here <= size))
        marked[active[inside]] = steps[here[inside], inside]
        low, high = np.searchsorted(where, steps[0]), np.searchsorted(where, steps[n])
        for k in np.flatnonzero(high > low).tolist():
            wanted = where[low[k] : high[k]]
            char = np.searchsorted(steps[: size[k], k], wanted, "right") - 1
            sampled[active[k], low[k] : high[k]] = grid[char, k]
        step[active] = now
    return step, marked


def _nibbles(sampled: np.ndarray) -> np.ndarray:
    """Four bits of each sample, by kind and place, so that other characters agree only by chance."""
    n = sampled.shape[1]
    code = (K.mix(np.arange(n, dtype=K.U)[:, None] * K.U(KINDS) + np.arange(KINDS, dtype=K.U)[None, :]) & K.U(15)).astype(np.uint8)
    out = code[np.arange(n)[None, :], np.minimum(sampled, KINDS - 1)]
    return np.where(sampled == ABSENT, ABSENT, out)


def _written(nibbles: np.ndarray, ends: np.ndarray) -> list[str]:
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)[np.minimum(nibbles, 15)]
    counts = (nibbles != ABSENT).sum(axis=1).tolist()
    return [f"{end:x}:{row[:n].tobytes().decode()}" for row, n, end in zip(digits, counts, ends.tolist(), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of nibbles: the weighted share of agreeing samples beyond chance, 0 to 1. Two empty texts are alike."""
    w = weights(a.shape[1])
    return _beyond_chance(((a == b) & (a != ABSENT)) @ w, ((a != ABSENT) | (b != ABSENT)) @ w)


def _beyond_chance(agree: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.where(of == 0, 1.0, np.clip((agree / np.maximum(of, 1e-9) - CHANCE) / (1 - CHANCE), 0, 1))


def parsed(fingerprints: list[str]) -> np.ndarray:
    """Rows of nibbles, ABSENT beyond the end."""
    bodies = [f.partition(":")[2] for f in fingerprints]
    out = np.full((len(bodies), max([SAMPLES, *map(len, bodies)])), ABSENT, np.uint8)
    for row, body in zip(out, bodies, strict=True):
        row[: len(body)] = [int(c, 16) for c in body]
    return out


def _kinds(block: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of every code point, where texts begin among them, and the byte at which each one begins (and the end)."""
    leads = np.flatnonzero(K.LEADS[block.data])
    at = np.searchsorted(leads, block.at)
    kinds = np.empty(len(leads), np.uint8)
    data = np.concatenate([block.data, np.zeros(3, np.uint8)])
    for first in range(0, len(leads), 1 << 19):
        own = leads[first : first + (1 << 19)]
        points = data[own].astype(K.U)
        more = np.ones(len(own), bool)
        for k in range(1, 4):
            more &= ~K.LEADS[data[own + k]]
            points[more] = points[more] * K.U(64) + data[own[more] + k]
        kinds[first : first + len(own)] = K.mix(points) & K.U(KINDS - 1)
    return kinds, at, np.append(leads, len(block.data))


def _fingerprints(block: K.Block, last: int) -> list:
    """Columns for rows 0 .. last - 1 of a block, whose row i + 1 is the document after row i."""
    kinds, at, byte = _kinds(block)
    n = np.diff(at)
    cut = n - n // 4
    width = SAMPLES * octaves_of(4 * int(n.max()) + LONGEST)
    own = np.full((len(n), width), ABSENT, np.uint8)
    ends, cut_step = walk(kinds, at, np.zeros(len(n), np.int64), cut, own)
    taken = np.minimum(n[:last] // 4, n[1 : last + 1])
    edited = own[:last].copy()
    edited[places(width // SAMPLES)[None, :] >= cut_step[:last, None]] = ABSENT
    inserted = np.concatenate([[0], np.cumsum(taken)])
    copied = kinds[np.repeat(at[1 : last + 1], taken) + K.runs(taken)]
    edited_ends, _ = walk(copied, inserted, cut_step[:last], np.full(last, -1), edited)
    own, edited = _nibbles(own), _nibbles(edited)
    raw = block.data.tobytes()
    digests = []
    for i in range(last):
        head = raw[byte[at[i]] : byte[at[i] + cut[i]]]
        tail = raw[byte[at[i + 1]] : byte[at[i + 1] + taken[i]]]
        digests.append(hashlib.sha256(head + tail).hexdigest())
    return [
        pa.array(n[:last]),
        pa.array(digests),
        pa.array(_written(own[:last], ends[:last])),
        pa.array(_written(edited, edited_ends)),
        pa.array(likeness(own[:last], edited)),
        pa.array(likeness(own[:last], own[1 : last + 1])),
    ]


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order, and each part ends with a sentinel, the document after its last one. Classes of a part (sentinel -1) come before its rows."""
    carried, classes = None, {}
    for batch in batches:
        named = batch.filter(pa.compute.equal(batch.column("sentinel"), -1))
        if named.num_rows:
            ids, nodes, names = (named.column(c).to_pylist() for c in ("doc_id", "node", "class_id"))
            classes |= zip(zip(ids, nodes, strict=True), names, strict=True)
            batch = batch.filter(pa.compute.not_equal(batch.column("sentinel"), -1))
            if not batch.num_rows:
                continue
        table = pa.Table.from_batches([batch] if carried is None else [carried, batch]).combine_chunks()
        carried = table.slice(table.num_rows - 1).to_batches()[0]
        part, sentinel = table.column("part").to_numpy(), table.column("sentinel").to_numpy()
        use = ~sentinel[:-1].astype(bool) & (part[1:] == part[:-1])
        for block in _overlapping(table.column("text"), BLOCK_BYTES):
            rows = block.last - block.first - 1
            chosen = pa.array(use[block.first : block.last - 1])
            columns = _fingerprints(block, rows)
            ids = table.column("doc_id").slice(block.first, rows).combine_chunks()
            keys = zip(ids.to_pylist(), columns[NAMES.index("fingerprint")].to_pylist(), strict=True)
            class_id = pa.array([classes.get((d, node_of(f)), d) if classes else d for d, f in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *columns, class_id], names=["doc_id", *NAMES, "class_id"]).filter(chosen)


def _overlapping(texts: pa.ChunkedArray, limit: int) -> Iterator[K.Block]:
    """Blocks that share a row with the next one."""
    texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.chunk(0)
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts) - 1:
        last = min(len(texts) - 1, max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 2))
        block = next(K.blocks(texts.slice(first, last - first + 1), 1 << 62))
        yield K.Block(first, last + 1, block.data, block.at)
        first = last


def _constant(values: list, kind: str) -> Column:
    """One literal, however many values it has."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _place_among(order: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most ``order``; looked up in two levels."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    group = F.size(F.filter(_constant([g[0] for g in groups], "array<bigint>"), lambda b: b <= order))
    inside = F.size(F.filter(F.get(_constant(groups, "array<array<bigint>>"), group - 1), lambda b: b <= order))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * step + inside)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint every row of ``docs`` (doc_id, text), and the same text with its end replaced by the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next and class_id (see ``near_classes``). The last n_chars // 4 code points give way to as
    many (or all) first ones of the next document in order of doc_id; after the
    last comes the first. Null ids come before all others; rows with one doc_id
    are in order of their texts. Null text is empty; two empty texts are alike
    (1.0). Texts are read whole, however long, and equal texts have equal
    fingerprints. An empty table gives no rows; other columns are ignored. Rows
    of one doc_id are one task's.

    Rows are dealt by ranges of doc_id and the first row of each range is also
    sent to the range before it, so texts are shuffled once; classes other than
    a row's own id go along.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with temporary() as keep:
        prints = stash(docs.mapInArrow(_own_prints, PRINTS), "edit-prints")
        named = prints.select("doc_id", "node").join(_class_names(prints, LIKENESS), "node").where("class_id is not null and not doc_id <=> class_id").distinct()
        named = keep(stash(named, "edit-classes"))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    parts = PARTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts)
    bounds = sorted(set(docs.select(order.alias("id")).agg(quantiles).first()[0] or []))
    part = _place_among(order, bounds)
    heads = {r.part: r.id for r in docs.select(part.alias("part"), order.alias("id")).groupBy("part").agg(F.min("id").alias("id")).collect()}
    filled = sorted(heads)
    before = {p: filled[k - 1] for k, p in enumerate(filled)}
    parts_range = range(len(bounds) + 1)
    is_head = F.col("id") == F.get(_constant([heads.get(p) for p in parts_range], "array<bigint>"), F.col("part"))
    part_before = F.get(_constant([before.get(p, 0) for p in parts_range], "array<int>"), F.col("part"))
    here = F.struct(F.col("part"), F.lit(0).alias("sentinel"))
    there = F.struct(part_before.alias("part"), F.lit(1).alias("sentinel"))
    rows = docs.select("doc_id", "text", order.alias("id"), part.alias("part"))
    dealt = rows.select("doc_id", "text", "id", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))).alias("to"))
    dealt = dealt.select("doc_id", "text", "id", "to.part", "to.sentinel", F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("class_id"))
    classes = named.select("doc_id", F.lit(None).cast("string").alias("text"), order.alias("id"), part.alias("part"), F.lit(-1).alias("sentinel"), "node", "class_id")
    dealt = dealt.unionByName(classes).repartition("part").sortWithinPartitions("part", "sentinel", "id", "text")
    return dealt.select("doc_id", "text", "part", "sentinel", "node", "class_id").mapInArrow(_neighbours, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long")


PRINTS = "doc_id long, node long, print binary"


def node_of(fingerprint: str) -> int:
    """A fingerprint's 64-bit name."""
    return int.from_bytes(hashlib.blake2b(fingerprint.encode(), digest_size=8).digest(), "big", signed=True)


def _packed(fingerprint: str) -> bytes:
    """Its samples, two in a byte, after a byte that is 1 if the last one stands alone."""
    body = fingerprint.partition(":")[2]
    odd = len(body) & 1
    return bytes([odd]) + bytes.fromhex(body + "0" * odd)


def _unpacked(prints: list[bytes]) -> np.ndarray:
    """Rows of nibbles in whole octaves, ABSENT beyond the end."""
    octaves = -(-max([SAMPLES, *(2 * len(p) - 2 for p in prints)]) // SAMPLES)
    out = np.full((len(prints), SAMPLES * octaves), ABSENT, np.uint8)
    for row, p in zip(out, prints, strict=True):
        pairs = np.frombuffer(p, np.uint8)[1:]
        n = 2 * len(pairs) - p[0]
        row[:n] = np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:n]
    return out


def _prints(doc_id: pa.Array, fingerprints: list[str]) -> pa.RecordBatch:
    packed = list(map(_packed, fingerprints))
    return pa.RecordBatch.from_arrays([doc_id, pa.array(map(node_of, fingerprints), pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "node", "print"])


def _own_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in K.blocks(batch.column("text"), BLOCK_BYTES):
            kinds, at, _ = _kinds(block)
            n = np.diff(at)
            own = np.full((len(n), SAMPLES * octaves_of(4 * int(n.max()) + LONGEST)), ABSENT, np.uint8)
            ends, _ = walk(kinds, at, np.zeros(len(n), np.int64), np.full(len(n), -1), own)
            yield _prints(batch.column("doc_id").slice(block.first, len(n)), _written(_nibbles(own), ends))


def _picks(bands: int, samples: int, usable: int) -> np.ndarray:
    """Which of the usable samples each band looks at.

    Each band has the samples in a random order by weight and takes the first
    ones, so two texts agree on a pick about as often as in their likeness.
    """
    name = np.arange(bands, dtype=K.U)[:, None] << K.U(32) | np.arange(usable, dtype=K.U)[None, :]
    even = ((K.mix(K.mix(name ^ K.U(0xBA4D))) >> K.U(11)).astype(np.float64) + 1) / 2.0**53
    return np.argsort(-np.log(even) / weights(usable), axis=1, kind="stable")[:, :samples]


def _bands(bands: int, samples: int):
    """A function from prints to their bands' hashes, one row each."""
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(prints: list[bytes]) -> np.ndarray:
        nibbles = _unpacked(prints)
        usable = (nibbles != ABSENT).sum(axis=1)
        out = np.empty((len(prints), bands), K.U)
        for n in np.unique(usable).tolist():
            if n not in known:
                known[n] = _picks(bands, samples, n)
            rows, at = np.flatnonzero(usable == n), known[n]
            total = np.broadcast_to(K.mix(np.arange(bands, dtype=K.U)), (len(rows), bands)).copy()
            for k in range(at.shape[1]):
                total = K.mix(total * K.BASE + (at[:, k].astype(K.U) * K.U(16))[None, :] + nibbles[rows[:, None], at[None, :, k]])
            out[rows] = total
        return out

    return of


def band_shape(n: int, least: float) -> tuple[int, int]:
    """Samples of a band and number of bands for n rows."""
    samples = max(4, math.ceil(math.log(max(n, 2)) / -math.log(CHANCE)) + SPARE_SAMPLES)
    agree = (CHANCE + (1 - CHANCE) * least) ** samples
    return samples, max(16, math.ceil(math.log(MISSED) / math.log(1 - agree))) if agree < 1 else 16


def _banded(rows: DataFrame, bands: int, samples: int) -> DataFrame:
    """The rows (node, print and others) once for each of their bands, with band in place of print."""
    others = [f for f in rows.schema if f.name != "print"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _bands(bands, samples)
        for whole in batches:
            for at in range(0, whole.num_rows, STEPS):
                batch = whole.slice(at, STEPS)
                keys = of(batch.column("print").to_pylist())
                again = pa.array(np.repeat(np.arange(batch.num_rows), bands))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *[batch.column(f.name).take(again) for f in others]], names=["band", *[f.name for f in others]])

    return rows.mapInArrow(spread, ", ".join(["band long", *[f"{f.name} {f.dataType.simpleString()}" for f in others]]))


def _distinct_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task once."""
    seen: set[int] = set()
    for batch in batches:
        new = [i for i, x in enumerate(batch.column("node").to_pylist()) if not (x in seen or seen.add(x))]
        yield batch.take(pa.array(new, pa.int64()))


def _near(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """Of the pairs (l, r) those whose likeness is ``least`` or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEPS):
                batch = whole.slice(at, STEPS)
                both = _unpacked(batch.column("a").to_pylist() + batch.column("b").to_pylist())
                near = likeness(both[: batch.num_rows], both[batch.num_rows :]) >= least
                yield pa.RecordBatch.from_arrays([batch.column("l"), batch.column("r")], names=["l", "r"]).filter(pa.array(near))

    left, right = (prints.select(F.col("node").alias(end), F.col("print").alias(name)) for end, name in (("l", "a"), ("r", "b")))
    return pairs.join(left, "l").join(right, "r").select("l", "r", "a", "b").mapInArrow(compare, "l long, r long")


def _cells(rows: DataFrame, size: int) -> DataFrame:
    """Rows (band, node, label) of bands in which several labels meet, as (node, label, cells): cells are structs (cell, side, inner).

    What has to be compared in a band are rows of different labels. Its largest
    label and all others are dealt into chunks of about ``size`` rows. A cell has
    one chunk of either (sides 0 and 1), or two of the others; in one cell of
    each chunk of the others (``inner``) its own rows meet too. So every pair of
    rows of different labels has a cell, unless both are of the largest label,
    and rows of a large label grow no more than others are many.
    """
    band, of_label = Window.partitionBy("band"), Window.partitionBy("band", "label")
    counted = rows.repartition("band").withColumn("of", F.count("*").over(of_label)).withColumn("main", F.max(F.struct("of", "label")).over(band)).withColumn("n", F.count("*").over(band))
    mixed = counted.where("n > main.of")
    chunks, others = F.ceil(F.col("main.of") / size), F.ceil((F.col("n") - F.col("main.of")) / size)
    is_main = F.col("label") == F.col("main.label")
    own = F.pmod(F.xxhash64("node"), F.when(is_main, chunks).otherwise(others))
    mixed = mixed.select("band", "node", "label", chunks.alias("chunks"), others.alias("others"), is_main.alias("is_main"), own.alias("own"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    cell = lambda kind, i, j, side, inner: F.struct(F.xxhash64("band", F.lit(kind), i, j).alias("cell"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"), inner.alias("inner"))
    of_main = F.transform(upto("others"), lambda j: cell(0, F.col("own"), j, 0, F.col("own") == 0))
    with_main = F.transform(upto("chunks"), lambda c: cell(0, c, F.col("own"), 1, c == 0))
    with_others = F.transform(F.filter(upto("others"), lambda i: i != F.col("own")), lambda i: cell(1, F.least(i, "own"), F.greatest(i, "own"), (F.col("own") > i).cast("int"), F.lit(False)))
    return mixed.select("node", "label", F.when(F.col("is_main"), of_main).otherwise(F.concat(with_main, with_others)).alias("cells"))


def _forest(label: np.ndarray, side: np.ndarray, inner: bool, nibbles: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between the rows of a cell that join its labels up as all its near pairs do, one fewer than the labels they join."""
    part = np.unique(label, return_inverse=True)[1]
    w = weights(nibbles.shape[1])
    weight, by_octave = (nibbles != ABSENT) @ w, w[::SAMPLES]

    def near(a: np.ndarray, b: np.ndarray, of: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(np.packbits(a != b, axis=-1).view(np.uint64)) @ by_octave
        return _beyond_chance(of - apart, of) >= least

    links: list[tuple[int, int]] = []

    def join(i: int, found: np.ndarray) -> None:
        for j in found.tolist():
            if part[i] != part[j]:
                part[part == part[j]] = part[i]
                links.append((i, j))

    place = np.arange(len(label))
    if len(label) <= FULL:
        met = (part[:, None] != part[None, :]) & (side[:, None] == 1) & ((side[None, :] == 0) | (inner & (place[:, None] < place[None, :])))
        met &= near(nibbles[:, None, :], nibbles[None, :, :], np.maximum(weight[:, None], weight[None, :]))
        for i in np.flatnonzero(met.any(axis=1)).tolist():
            join(i, np.flatnonzero(met[i]))
        return links
    for i in np.flatnonzero(side == 1).tolist():
        met = np.flatnonzero((part != part[i]) & ((side == 0) | (inner & (place > i))))
        if len(met):
            join(i, met[near(nibbles[met], nibbles[i], np.maximum(weight[met], weight[i]))])
    return links


def _links_of_cells(rows: DataFrame, least: float) -> DataFrame:
    """Links (l, r) that join labels up as the near pairs of all cells do, for rows (cell, side, inner, node, label, print)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in (b for b in batches if b.num_rows):
            table = pa.Table.from_batches([batch] if carried is None else [carried, batch]).combine_chunks()
            begin = int(np.searchsorted(table.column("cell").to_numpy(), table.column("cell")[-1].as_py()))
            yield links_of(table.slice(0, begin))
            carried = table.slice(begin).combine_chunks().to_batches()[0]
        if carried is not None:
            yield links_of(pa.Table.from_batches([carried]))

    def links_of(table: pa.Table) -> pa.RecordBatch:
        cell, side, inner, node, label = (table.column(c).to_numpy() for c in ("cell", "side", "inner", "node", "label"))
        at = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]]) if len(cell) else np.zeros(1, np.int64)
        left, right = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own, prints = node[a:b], table.column("print").slice(a, b - a).to_pylist()
            for i, j in _forest(label[a:b], side[a:b], bool(inner[a]), _unpacked(prints), least):
                left.append(own[i])
                right.append(own[j])
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["l", "r"])

    return rows.repartition("cell").sortWithinPartitions("cell").select("cell", "side", "inner", "node", "label", "print").mapInArrow(compare, "l long, r long")


def _class_names(prints: DataFrame, least: float, size: int = CELL_ROWS) -> DataFrame:
    """node and class_id, the smallest doc_id of what verified links lead to, for stashed rows (PRINTS)."""
    samples, bands = band_shape(prints.count(), least)
    # Every node against the hub that it meets in most bands; the hub of a bucket is its smallest node.
    once = prints.select("node", "print").mapInArrow(_distinct_prints, "node long, print binary")
    met = _banded(once, bands, samples).withColumn("hub", F.min("node").over(Window.partitionBy("band"))).where("node <> hub")
    oftenest = met.select("node", "hub").repartition("node").groupBy("node", "hub").agg(F.count("*").alias("n")).groupBy("node").agg(F.max(F.struct("n", "hub")).alias("top"))
    anchors = stash(oftenest.select(F.col("top.hub").alias("l"), F.col("node").alias("r")), "edit-anchors")
    wanted = anchors.select(F.col("l").alias("node")).union(anchors.select("r")).distinct()
    firsts = stash(once.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("print").alias("print")), "edit-firsts")
    links = stash(_near(anchors, firsts, least), "edit-links")

    # A node's label is its hub's hub, as far as links lead; what meets across labels is compared wherever it meets.
    up = links.select(F.col("r").alias("node"), F.col("l").alias("label"))
    further = up.join(up.select(F.col("node").alias("label"), F.col("label").alias("last")), "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    labelled = firsts.join(further, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "print")
    open_rows = _cells(_banded(labelled, bands, samples), size).join(firsts, "node").select("node", "label", "print", F.inline("cells"))
    links = links.union(_links_of_cells(open_rows, least))
    return _class_ids(prints, components(links))


def _class_ids(prints: DataFrame, parts: DataFrame) -> DataFrame:
    smallest = prints.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    named = smallest.join(parts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("first_id").alias("class_id"))
    return named.join(names, "label").select("node", "class_id")


def near_classes(fingerprints: DataFrame, least: float = LIKENESS, size: int = CELL_ROWS) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of the documents that verified links lead to, for rows (doc_id, fingerprint).

    Documents meet in a band when a few samples agree, more for more rows.
    Each is compared with the hub it meets most often. Then all documents of a
    bucket that these links don't join are compared, so no near pair that meets
    is lost; a bucket of more than ``size`` rows is dealt over cells (see
    ``_cells``). Equal fingerprints are one class. A row with a null id joins
    its class but never names it.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _prints(batch.column("doc_id"), batch.column("fingerprint").to_pylist())

    prints = stash(fingerprints.select(F.col("doc_id").cast("long").alias("doc_id"), "fingerprint").mapInArrow(pack, PRINTS), "edit-prints")
    return prints.select("doc_id", "node").join(_class_names(prints, least, size), "node").select("doc_id", "class_id")
