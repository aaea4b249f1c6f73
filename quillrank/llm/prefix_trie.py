"""The trie of all conversations' turns, built family by family and then merged.

A conversation is rebuilt from the first turns of its base and its own later
ones. Texts stay where they are: a turn is its checksum and length. All
conversations of one base meet in a task, which rebuilds them and merges their
paths to a small trie; only its nodes, each known by a checksum of its whole
path, are shuffled and merged with those of other families.

Each node belongs to its smallest member, so a conversation owns the last
stretch of its own path, a chain, and what hangs on it are other chains. Sums
over subtrees take a number of rounds logarithmic in how deep chains hang on
chains; inside a chain they are running sums.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.importance import SQL_CRC, SQL_CRC_TABLE
from quillrank.llm.tables import bounded_batches, discard, stash

#: Conversations that share a base, and how many of its first turns they can take over: a checksum modulo this.
FAMILY, TAKEN = 5, 9
ROOT = bytes(16)
#: Nodes that a task merges before it hands them on.
MOST_NODES = 1 << 17
ROWS = 8192
#: Letters of a list of ids that are put together before it is hashed in order.
PIECE = 1 << 16
NODE = "node binary, parent binary, depth long, conv_id long, n_convs long, n_bytes long, ends array<long>"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def taken_over(conv_id: int) -> int:
    """How many turns a conversation has from its base."""
    return zlib.crc32(str(conv_id).encode()) % TAKEN


def turns(conversations: DataFrame) -> DataFrame:
    """base, conv_id, turn, turn_hash, n_bytes: what identifies each turn, without its text."""
    c, text = F.col("conv_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    name = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where(c.isNotNull()).select(c.alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(name).alias("turn_hash"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.select(F.expr(f"try_subtract(conv_id, pmod(conv_id, {FAMILY}))").alias("base"), "*")


class _Family:
    """The trie of the conversations of one base that were added so far."""

    def __init__(self):
        self.nodes: dict[bytes, list] = {}

    def step(self, parent: bytes, depth: int, turn: bytes, n_bytes: int, conv_id: int) -> bytes:
        node = hashlib.blake2b(parent + turn, digest_size=16).digest() if depth else ROOT
        found = self.nodes.get(node)
        if found is None:
            self.nodes[node] = [parent, depth, conv_id, 1, n_bytes, []]
        else:
            found[2] = min(found[2], conv_id)
            found[3] += 1
        return node

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = list(self.nodes)
        numbers = [(c, pa.int64()) for c in ("depth", "conv_id", "n_convs", "n_bytes")]
        for i in range(0, len(names), ROWS):
            yield _columns([(n, *self.nodes[n]) for n in names[i : i + ROWS]], ("node", pa.binary()), ("parent", pa.binary()), *numbers, ("ends", pa.list_(pa.int64())))
        self.nodes = {}


def family_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of each family's trie, each with its number of members there, the smallest of them and those that end there.

    A conversation's turns pass its task in order and aren't gathered; of the
    base, the first turns are kept. Where a family has very many nodes, those
    found so far are handed on, and met again when all are merged.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, base, beginning = _Family(), None, []
        conv_id, taken, own, depth, node = None, 0, 0, 0, ROOT

        def ended() -> None:
            if conv_id is not None:
                trie.nodes[node][5].append(conv_id)

        for batch in batches:
            for of, c, turn, n_bytes in zip(*(batch.column(k).to_pylist() for k in ("base", "conv_id", "turn_hash", "n_bytes")), strict=True):
                if c != conv_id:
                    ended()
                    if of != base or len(trie.nodes) > MOST_NODES:
                        # Small families go out together.
                        if len(trie.nodes) > ROWS:
                            yield from trie.rows()
                        base, beginning = of, beginning if of == base else []
                    conv_id, taken, own, depth = c, taken_over(c), 0, 0
                    node = trie.step(ROOT, 0, b"", 0, c)
                    if c != of:
                        for t, n in beginning[:taken]:
                            depth += 1
                            node = trie.step(node, depth, t, n, c)
                if c == of and own < TAKEN - 1:
                    beginning.append((turn, n_bytes))
                own += 1
                if own > taken or c == of:
                    depth += 1
                    if len(trie.nodes) > MOST_NODES:
                        kept = trie.nodes.pop(node)
                        yield from trie.rows()
                        trie.nodes[node] = kept
                    node = trie.step(node, depth, turn, n_bytes, c)
        ended()
        yield from trie.rows()

    bounded_batches(conversations.sparkSession)
    met = turns(conversations).repartition("base").sortWithinPartitions("base", "conv_id", F.col("turn").asc_nulls_first(), "turn_hash")
    return met.mapInArrow(build, NODE)


def ends_hashes(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 for ``ends`` (node, conv_id): the checksum of the conv_ids of each node, in order and joined by commas.

    Ids are sorted over ranges, so the list of a node at which very many end is
    put together by many tasks; only its pieces pass the one that hashes them
    in order.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple] = []
        node, first, ids, size = None, None, [], 0
        for batch in batches:
            for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if n != node or size > PIECE:
                    if ids:
                        pieces.append((node, first, ",".join(ids)))
                    node, first, ids, size = n, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if len(pieces) >= ROWS or sum(map(len, (p[2] for p in pieces[-64:]))) > PIECE:
                yield _columns(pieces, ("node", pa.binary()), ("first", pa.int64()), ("piece", pa.string()))
                pieces = []
        if ids:
            pieces.append((node, first, ",".join(ids)))
        yield _columns(pieces, ("node", pa.binary()), ("first", pa.int64()), ("piece", pa.string()))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        node, sha = None, None
        for batch in batches:
            for n, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if n == node:
                    sha.update(b"," + piece.encode())
                    continue
                if node is not None:
                    found.append((node, sha.hexdigest()))
                node, sha = n, hashlib.sha256(piece.encode())
            if len(found) >= ROWS:
                yield _columns(found, ("node", pa.binary()), ("ends_sha256", pa.string()))
                found = []
        if node is not None:
            found.append((node, sha.hexdigest()))
        yield _columns(found, ("node", pa.binary()), ("ends_sha256", pa.string()))

    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join, "node binary, first long, piece string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def _columns(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def looked_up(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """``rows`` joined with ``known`` on ``key``, where ``known`` has it once and any number of rows may share it.

    Keys that very many rows share, at most four for each partition of a
    shuffle, are broadcast, so their rows stay where they are.
    """
    n_tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    common = [r[0] for r in counts.where(F.col("n") > rows.count() // (4 * n_tasks) + 1).select(key).collect()]
    is_common = F.col(key).isin(common) if common else F.lit(False)
    few, many = known.where(is_common), known.where(~is_common)
    return rows.where(is_common).join(F.broadcast(few), key).unionByName(rows.where(~is_common).join(many, key))


def chain_totals(chains: DataFrame) -> DataFrame:
    """conv_id, saved, leaves of each chain and all that hang on it, for ``chains`` (conv_id, up_conv, saved, leaves).

    After k rounds a chain has the sums of all fewer than 2**k steps below it,
    and knows the one 2**k steps above.
    """
    state = stash(chains.select("conv_id", "up_conv", "saved", "leaves"), "chains")
    while not (open_ := state.where("up_conv is not null")).isEmpty():
        below = open_.groupBy(F.col("up_conv").alias("conv_id")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"))
        summed = state.join(below, "conv_id", "left").select("conv_id", "up_conv", (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"))
        above = looked_up(open_.select("conv_id", "up_conv"), "up_conv", state.select(F.col("conv_id").alias("up_conv"), F.col("up_conv").alias("next")))
        older, state = state, stash(summed.drop("up_conv").join(above.select("conv_id", F.col("next").alias("up_conv")), "conv_id", "left").select("conv_id", "up_conv", "saved", "leaves"), "chains")
        discard(older)
    return state.drop("up_conv")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt ``conversations`` (conv_id, turn, role, text).

    Returns, for each distinct beginning, the root without a turn included:
    conv_id (its smallest member), depth, parent_conv_id (the parent's conv_id,
    null for the root), n_convs (members), n_children, n_leaves (nodes without
    children below it or itself), saved_tokens (over its subtree, members but
    one times the bytes of the last text) and ends_sha256 (of the members that
    end there, ascending). Null turns come first, turns with equal numbers go by
    a checksum of role and text, repeated rows are turns of their own. Null
    roles and texts are empty; texts count whole, however long. Rows with a null
    conv_id belong to no conversation. An empty table gives no rows, and other
    columns are ignored.
    """
    families = stash(family_nodes(conversations), "family-nodes")
    merged = families.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("n_bytes").alias("n_bytes"))
    nodes = stash(merged, "trie-nodes")
    ends = stash(ends_hashes(families.select("node", F.explode("ends").alias("conv_id"))), "trie-ends")
    discard(families)
    own = (F.col("n_convs") - 1) * F.col("n_bytes")
    heads = nodes.groupBy("conv_id").agg(F.min("depth").alias("head"), F.max("depth").alias("tail"), F.min_by("parent", "depth").alias("parent"), F.sum(own).alias("saved"))
    heads = stash(heads, "trie-heads")
    # All that begins at the root hangs on its owner; others look their parents up.
    top = heads.where("head = 0").select("conv_id").first()
    if top is None:
        return nodes.select("conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("n_children"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.lit(NO_ENDS).alias("ends_sha256"))
    higher = heads.where("head > 1")
    parents = nodes.join(higher.select(F.col("parent").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("parent"), F.col("conv_id").alias("up_conv"))
    first = heads.where("head <= 1").withColumn("up_conv", F.when(F.col("head") == 1, F.lit(top.conv_id).cast("long")))
    hung = stash(looked_up(higher, "parent", parents).unionByName(first).select("conv_id", "head", "tail", "saved", "up_conv"), "trie-hung")
    discard(heads)

    on = hung.where("up_conv is not null").groupBy(F.col("up_conv").alias("conv_id"), (F.col("head") - 1).alias("depth"))
    busy = on.agg(F.count("*").alias("n"))
    ends_in_leaf = busy.select("conv_id", F.col("depth").alias("tail"), F.lit(0).alias("leaves"))
    chains = hung.join(ends_in_leaf, ["conv_id", "tail"], "left").withColumn("leaves", F.coalesce("leaves", F.lit(1)).cast("long"))
    totals = chain_totals(chains)
    below = hung.where("up_conv is not null").join(totals.select("conv_id", F.col("saved").alias("all_saved"), "leaves"), "conv_id")
    attached = below.groupBy(F.col("up_conv").alias("conv_id"), (F.col("head") - 1).alias("depth")).agg(F.count("*").alias("n_hung"), F.sum("all_saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves"))

    rows = nodes.join(hung.select("conv_id", "head", "tail", "up_conv"), "conv_id").join(attached, ["conv_id", "depth"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    is_leaf = ((F.col("depth") == F.col("tail")) & F.col("n_hung").isNull()).cast("long")
    deeper = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.select(
        "node", "conv_id", "depth",
        F.when(F.col("depth") > F.col("head"), F.col("conv_id")).otherwise(F.col("up_conv")).alias("parent_conv_id"),
        "n_convs",
        (zero("n_hung") + (F.col("depth") < F.col("tail")).cast("long")).alias("n_children"),
        F.sum(zero("hung_leaves") + is_leaf).over(deeper).alias("n_leaves"),
        F.sum(zero("hung_saved") + own).over(deeper).alias("saved_tokens"),
    )
    return counted.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).drop("node")


ORACLE_TRIE = (
    "WITH "
    + SQL_CRC_TABLE
    + """, convs AS (SELECT conv_id, """
    + SQL_CRC.format("CAST(conv_id AS VARCHAR)")
    + """ % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM {conversations} WHERE conv_id IS NOT NULL), crc_table),
placed AS (SELECT conv_id, [coalesce(role, ''), coalesce(text, '')] AS turn, strlen(coalesce(text, '')) AS n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM {conversations}),
rebuilt AS (
  SELECT c.conv_id, place, turn, n_bytes FROM convs c JOIN placed p ON p.conv_id = c.base AND place <= h
  UNION ALL SELECT c.conv_id, place + 1000000, turn, n_bytes FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND place > h
), paths AS (
  SELECT conv_id, row_number() OVER w AS depth, list(turn) OVER w AS path, n_bytes, count(*) OVER (PARTITION BY conv_id) AS size FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), all_paths AS (
  SELECT conv_id, depth, path, n_bytes, depth = size AS ends FROM paths
  UNION ALL SELECT conv_id, 0, [], 0, conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs
), nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM all_paths GROUP BY ALL
), children AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
weighed AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (depth, path)),
above AS (SELECT k AS depth, path[1:k] AS path, (n_convs - 1) * n_bytes AS saved, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM weighed)),
sums AS (SELECT depth, path, CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(sum(leaf) AS BIGINT) AS n_leaves FROM above GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM weighed n JOIN sums USING (depth, path) LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
)
