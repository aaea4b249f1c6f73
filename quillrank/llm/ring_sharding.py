"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every row hashes to a slot of the ring and belongs to the next virtual node
clockwise. A shard takes rows until it is full; what arrives later continues
clockwise to the next virtual node whose shard has room. Only counts per ring
slot (a fixed number, whatever the input) reach the driver; rows are ranked
inside their slot and joined to the intervals planned for it.
"""

from __future__ import annotations

import math
import zlib
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.tables import stash

RING_SLOTS = 1 << 14
VIRTUAL_NODES = 64


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard. Without slack they add up to ``rows`` and are at most one apart."""
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil((1 + slack) * rows / shards)] * shards


def place(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> list[tuple]:
    """Intervals (ring_slot, first, last, shard, base): ranks first..last of a slot go to a shard, from its place base on.

    ``counts`` has at most RING_SLOTS entries. The walk goes clockwise; at each
    virtual node its own arc is served before rows carried over from full shards.
    """
    room = capacities(sum(counts.values()), shards, slack)
    nodes = sorted((zlib.crc32(f"shard {s}, node {v}".encode()) % RING_SLOTS, s) for s in range(shards) for v in range(virtual_nodes))
    own: list[list] = [[] for _ in nodes]
    at = 0
    for slot in sorted(counts):
        while at < len(nodes) and nodes[at][0] < slot:
            at += 1
        own[at % len(nodes)].append((slot, 1, counts[slot]))
    taken, carried, out = [0] * shards, deque(), []
    lap = 0
    while lap == 0 or carried:
        for k, (_, shard) in enumerate(nodes):
            queue = deque(own[k] if lap == 0 else ())
            queue.extend(carried)
            carried = deque()
            while queue:
                slot, first, last = queue.popleft()
                n = min(last - first + 1, room[shard] - taken[shard])
                if n > 0:
                    out.append((slot, first, first + n - 1, shard, taken[shard]))
                    taken[shard] += n
                if first + n <= last:
                    carried.append((slot, first + n, last))
        lap += 1
    return out


def shard_documents(docs: DataFrame, shards: int = 8, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text) into a shard 0 .. ``shards`` - 1.

    Returns doc_id, size (UTF-8 bytes plus 1; null text: 1), text_crc32, shard
    and slot (gapless from 0 in each shard). With ``slack`` 0 shard counts are
    at most one apart; with slack e no shard holds more than (1 + e) times the
    mean and fewer rows leave their first shard. Texts count whole, however
    long. Null ids are placed by their text; rows alike in all that places them
    are a tie in which either may have either slot, and repeated rows each get
    one; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digests = stash(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ).withColumn("point", F.xxhash64("doc_id", "text_crc32", "size")),
        "ring-digests",
    ).withColumn("ring_slot", F.pmod(F.col("point"), F.lit(RING_SLOTS)).cast("int"))
    counts = {r.ring_slot: r["count"] for r in digests.groupBy("ring_slot").count().collect()}
    plan = spark.createDataFrame(place(counts, shards, virtual_nodes, slack), "ring_slot int, first long, last long, shard int, base long")
    ranked = digests.withColumn("rank", F.row_number().over(Window.partitionBy("ring_slot").orderBy("point", "doc_id", "size", "text_crc32")).cast("long"))
    # The plan has a row for each ring slot and for each split of one, so its size is bounded by the ring.
    return (
        ranked.join(F.broadcast(plan), "ring_slot")
        .where(F.col("rank").between(F.col("first"), F.col("last")))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))
    )
