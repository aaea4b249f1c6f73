"""WARC archives of pages, and one index over them all in order of URL and time.

Pages with equal payloads meet in one task, which writes one of them as a
response and the others as revisits. Archives are then read back; every one
gives a run of index entries that is sorted on its own. Runs are merged by loser
trees, a range of keys for each task, so the ranges in order are the history of
all captures.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from itertools import groupby
from operator import itemgetter
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.tables import bounded_batches, discard, opened, stash
from quillrank.stored import fresh_folder, remove

#: An archive is closed when it has so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Entries of an index are written and read so many at a time.
BLOCK = 4096
#: Most runs that are merged at once.
FAN_IN = 64
#: Where no time of capture is given, pages follow each other by the second, in order of page_id.
FIRST = datetime(2000, 1, 1, tzinfo=UTC)
SPAN = 1 << 31

ENTRY = pa.schema([("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
COLUMNS = "url_key string, captured long, page_id long, archive string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long"
KEY = "struct<url_key:string,captured:bigint,page_id:bigint,archive:string,offset:bigint>"
RUNS = f"run string, path string, block int, low {KEY}, high {KEY}"
#: In the order of entries, a page without an id comes first.
NO_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """The host from its last label on, then path and query: all pages of a site stand together. Without a host, the URL as it is."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname, parts.port
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else "")
    return f"{name}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _line(text: str | None) -> str:
    """A header's value: what would end the line, and other control characters, as percent codes."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text or "")


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, captured: int, payload: bytes | None, n_bytes: int, digest: str, original: tuple | None) -> bytes:
    """One record, compressed for itself. ``original`` has the page_id of the response that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    body = http + (payload or b"") if original is None else http
    date = (FIRST + timedelta(seconds=captured)).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if original is not None:
        lines += [f"WARC-Refers-To: {_name(original[0], digest)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def _groups(pages: DataFrame, least_bytes: int) -> dict[str, tuple]:
    """The digests that very many pages share: the largest page_id of each. There can be four at most for each partition of a shuffle."""
    counts = pages.where(F.length("payload") >= least_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("top"))
    share = pages.count() // (4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    return {r.sha: (r.top,) for r in counts.where(F.col("n") > share).collect()}


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, captured: Column | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives into ``folder``, which all executors share; returns archive, n_records.

    Of pages with equal payloads of ``least_bytes`` or more, the one with the
    largest page_id is the response, of repeated rows one. ``captured`` has
    seconds after ``FIRST``. Payloads that very many pages share are found
    first; only those that may be the response keep them on the way, and the
    others are spread. A task that is run again writes new files, and those of
    the failed one aren't in the result.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    page_id = F.col("page_id").cast("long")
    when = F.coalesce(F.pmod(page_id, F.lit(SPAN)), F.lit(0)) if captured is None else captured
    rows = pages.select(page_id.alias("page_id"), F.col("url").cast("string").alias("url"), when.cast("long").alias("captured"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    common = spark.sparkContext.broadcast(_groups(rows, least_bytes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """key, by which equal payloads meet or rows that are decided spread, and refers_to, a list with an id or null where it is known."""
        met, n = set(), 0
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column("payload")).to_pylist()
            keys, refers, bare = [], [], []
            for sha, own, size in zip(batch.column("sha").to_pylist(), batch.column("page_id").to_pylist(), sizes, strict=True):
                top = common.value.get(sha)
                n += 1
                if size < least_bytes:
                    keys.append(f"{sha}-{own}-{n}")
                    refers.append(None)
                    bare.append(False)
                elif top is not None and (own != top[0] or sha in met):
                    keys.append(f"{sha}-{own}-{n}")
                    refers.append([top[0]])
                    bare.append(True)
                else:
                    if top is not None:
                        met.add(sha)
                    keys.append(sha)
                    refers.append(None)
                    bare.append(False)
            payload = pa.compute.if_else(pa.array(bare, pa.bool_()), pa.scalar(None, batch.column("payload").type), batch.column("payload"))
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("page_id"), batch.column("url"), batch.column("captured"), payload, pa.array(sizes, pa.int64()), batch.column("sha"), pa.array(refers, pa.list_(pa.int64()))], names=["key", "page_id", "url", "captured", "payload", "n_bytes", "sha", "refers"])

    dealt = rows.mapInArrow(deal, "key string, page_id long, url string, captured long, payload binary, n_bytes long, sha string, refers array<long>")
    dealt = dealt.repartition("key").sortWithinPartitions("key", F.col("page_id").desc_nulls_last(), "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        out, path, n, last = None, "", 0, (None, None)

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["archive", "n_records"])

        for batch in batches:
            for key, page, url, at, payload, n_bytes, sha, refers in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if key == sha and last[0] == sha:
                    refers = [last[1]]
                elif key == sha:
                    last = (sha, page)
                if out is not None and out.tell() >= archive_bytes:
                    yield closed()
                    out = None
                if out is None:
                    name, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    system.create_dir(root, recursive=True)
                    path, out = f"{folder}/{name}", system.open_output_stream(f"{root}/{name}", compression=None)
                out.write(record(page, url, at, payload, n_bytes, base64.b32encode(bytes.fromhex(sha)).decode(), None if refers is None else (refers[0],)))
                n += 1
        if out is not None:
            yield closed()

    return stash(dealt.mapInArrow(write, "archive string, n_records long"), "archives")


def records(archive: str) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """offset, length, headers and block of each record, one in memory at a time."""
    system, path = opened(archive)
    with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as source:
        at, waiting = 0, source.read(1 << 20)
        while waiting:
            unpack, parts, length = zlib.decompressobj(31), [], 0
            while not unpack.eof:
                parts.append(unpack.decompress(waiting))
                length += len(waiting) - len(unpack.unused_data)
                waiting = unpack.unused_data if unpack.eof else source.read(1 << 20)
                if not waiting and not unpack.eof:
                    raise ValueError(f"{archive} ends inside the record at {at}")
            waiting = waiting or source.read(1 << 20)
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield at, length, headers, rest[: int(headers["Content-Length"])]
            at += length


def entry(archive: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    """The index entry of a record. A response's size and digest are taken of the payload itself, and must be what its headers say."""
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    n_bytes, digest = int(fields["Content-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    original = None
    if headers["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (len(payload), found) != (n_bytes, digest):
            raise ValueError(f"{archive}: the record at {offset} is damaged")
    else:
        original = headers["WARC-Refers-To"].split(":")[2]
    own = headers["WARC-Record-ID"].split(":")[2]
    captured = int((datetime.strptime(headers["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC) - FIRST).total_seconds())
    return url_key(headers["WARC-Target-URI"]), captured, int(own) if own else None, archive, offset, length, headers["WARC-Type"], n_bytes, digest, int(original) if original else None


def _order(row: tuple) -> tuple:
    return row[0], row[1], NO_ID if row[2] is None else row[2], row[3], row[4]


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ENTRY, strict=True)], schema=ENTRY)


class _Run:
    """Writes sorted entries as a file of blocks, and says where each begins and ends."""

    def __init__(self, folder: str, run: str | None = None):
        system, root = opened(folder)
        name = f"run-{uuid.uuid4().hex}.arrow"
        system.create_dir(root, recursive=True)
        self.path, self.found = f"{folder}/{name}", []
        self.run, self.out = run or name, system.open_output_stream(f"{root}/{name}", compression=None)
        self.file = pa.ipc.new_file(self.out, ENTRY, options=pa.ipc.IpcWriteOptions(compression="zstd"))

    def write(self, rows: list[tuple]) -> None:
        self.file.write_batch(_blocks(rows))
        low, high = (dict(zip(("url_key", "captured", "page_id", "archive", "offset"), _order(r), strict=True)) for r in (rows[0], rows[-1]))
        self.found.append({"run": self.run, "path": self.path, "block": len(self.found), "low": low, "high": high})

    def close(self) -> pa.RecordBatch:
        self.file.close()
        self.out.close()
        key = pa.struct([("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])
        return pa.RecordBatch.from_pylist(self.found, pa.schema([("run", pa.string()), ("path", pa.string()), ("block", pa.int32()), ("low", key), ("high", key)]))


def index_runs(archives: DataFrame, folder: str) -> DataFrame:
    """Read archives back and write a sorted run of entries for each into ``folder``; returns a row for each block of each run."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                # One archive's entries, whose bytes are bounded.
                rows = sorted((entry(archive, *r) for r in records(archive)), key=_order)
                run = _Run(folder)
                for i in range(0, len(rows), BLOCK):
                    run.write(rows[i : i + BLOCK])
                yield run.close()

    # A task for each archive.
    return stash(archives.select("archive").repartition(max(1, archives.count())).mapInArrow(index, RUNS), "runs")


class Cursor:
    """The entries of one run from ``low`` up to ``high``, a block in memory at a time."""

    def __init__(self, blocks: list[tuple[str, int]], low: tuple | None, high: tuple | None):
        self.blocks, self.low, self.high = iter(blocks), low, high
        self.path, self.file = None, None
        self.at, self.keys, self.rows = 0, [], []

    def key(self) -> tuple | None:
        """The next entry's place in the order; None after the last."""
        while self.at >= len(self.keys):
            block = next(self.blocks, None)
            if block is None:
                return None
            if block[0] != self.path:
                system, path = opened(block[0])
                self.path, self.file = block[0], pa.ipc.open_file(system.open_input_file(path))
            self.rows = list(zip(*(c.to_pylist() for c in self.file.get_batch(block[1]).columns), strict=True))
            self.keys = [_order(r) for r in self.rows]
            first = bisect_left(self.keys, self.low) if self.low else 0
            last = bisect_left(self.keys, self.high) if self.high else len(self.keys)
            self.keys, self.rows, self.at = self.keys[first:last], self.rows[first:last], 0
        return self.keys[self.at]

    def taken(self, before: tuple | None) -> list[tuple]:
        """The entries of this block that come before that place."""
        end = len(self.keys) if before is None else bisect_left(self.keys, before, self.at)
        out, self.at = self.rows[self.at : end], end
        return out


def loser_tree(cursors: list[Cursor]) -> Iterator[list[tuple]]:
    """Merges sorted runs: stretches of entries in order.

    Inner nodes hold the loser of the match below them; after the winner has
    moved on, only the matches on its own way up are played again. It gives all
    its entries before the best of those losers at once.
    """
    k = len(cursors)
    keys = [c.key() for c in cursors]
    beats = lambda i, j: keys[j] is None or keys[i] is not None and keys[i] <= keys[j]
    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        i, j = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (i, j) if beats(i, j) else (j, i)
    best = winners[1] if k > 1 else 0
    while k and keys[best] is not None:
        node, second = (best + k) // 2, None
        while node:
            if keys[losers[node]] is not None and (second is None or keys[losers[node]] < second):
                second = keys[losers[node]]
            node //= 2
        yield cursors[best].taken(second)
        keys[best] = cursors[best].key()
        node = (best + k) // 2
        while node:
            if not beats(best, losers[node]):
                best, losers[node] = losers[node], best
            node //= 2


def _ranges(runs: DataFrame, n: int) -> DataFrame:
    """``runs`` with range, low_end and high_end: each block in every range of keys that it reaches into; about as many blocks begin in each."""
    sampled = runs.select("low").repartitionByRange(n, "low").groupBy(F.spark_partition_id()).agg(F.min("low").alias("low"))
    ends = sorted(tuple(r.low) for r in sampled.collect())[1:]  # one for each range
    if not ends:
        return runs.select("*", F.lit(0).alias("range"), F.lit(None).cast(KEY).alias("low_end"), F.lit(None).cast(KEY).alias("high_end"))
    names = ("url_key", "captured", "page_id", "archive", "offset")
    known = F.from_json(F.lit(json.dumps([dict(zip(names, e, strict=True)) for e in ends])), f"array<{KEY}>")
    below = lambda c: F.size(F.filter("ends", lambda e: e <= F.col(c)))
    spread = runs.withColumn("ends", known).withColumn("range", F.explode(F.sequence(below("low"), below("high"))))
    return spread.select("run", "path", "block", "low", "range", F.get("ends", F.col("range") - 1).alias("low_end"), F.get("ends", F.col("range")).alias("high_end"))


def merge_runs(runs: DataFrame, folder: str, fan_in: int = FAN_IN) -> DataFrame:
    """All entries of ``runs`` in one order, by url_key, captured, page_id and place: the columns of entries, range and ``at``, the place in it.

    Where there are more runs than ``fan_in``, groups of them are merged to
    longer runs first. Ties go by archive and offset, so no two entries are equal.
    """
    n_tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[list[tuple]]]]:
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("part", "range", "low_end", "high_end", "run", "path", "block")), strict=True))
        for (part, k), found in groupby(rows, itemgetter(0, 1)):
            cursors = []
            for _, of_run in groupby(found, itemgetter(4)):
                of_run = list(of_run)
                low, high = (None if end is None else tuple(end.values()) for end in of_run[0][2:4])
                cursors.append(Cursor([(r[5], r[6]) for r in of_run], low, high))
            yield (part, k), loser_tree(cursors)

    def lengthen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, _), merged in stretches(batches):
            run, waiting = None, []
            for rows in merged:
                waiting += rows
                while len(waiting) >= BLOCK:
                    run = run or _Run(folder, str(part))
                    run.write(waiting[:BLOCK])
                    del waiting[:BLOCK]
            if waiting:
                run = run or _Run(folder, str(part))
                run.write(waiting)
            if run is not None:
                yield run.close()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, k), merged in stretches(batches):
            at, waiting = 0, []

            def numbered(rows: list[tuple]) -> pa.RecordBatch:
                block = _blocks(rows)
                return pa.RecordBatch.from_arrays([*block.columns, pa.array([k] * len(rows), pa.int32()), pa.array(range(at, at + len(rows)), pa.int64())], names=[*ENTRY.names, "range", "at"])

            for rows in merged:
                waiting += rows
                if len(waiting) >= BLOCK:
                    yield numbered(waiting)
                    at, waiting = at + len(waiting), []
            if waiting:
                yield numbered(waiting)

    def dealt(part: Column) -> DataFrame:
        return _ranges(runs, n_tasks).withColumn("part", part).repartition(n_tasks, "part", "range").sortWithinPartitions("part", "range", "run", "low")

    while (n := runs.select("run").distinct().count()) > fan_in:
        runs = stash(dealt(F.pmod(F.xxhash64("run"), F.lit(-(-2 * n // fan_in))).cast("int")).mapInArrow(lengthen, RUNS), "runs")
    return dealt(F.lit(0)).mapInArrow(finish, f"{COLUMNS}, range int, at long")


def archive_pages(pages: DataFrame, folder: str, least_bytes: int = 0, captured: Column | None = None, archive_bytes: int = ARCHIVE_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives into ``folder``, read them back and index them.

    Returns a row for each page: url_key, captured (seconds after ``FIRST``),
    page_id, archive, offset, length, record_type, payload_bytes,
    payload_digest, refers_to, and position, its place among all from 0, by
    url_key and time. Payloads are the html in UTF-8, whole however long; null
    is empty. A null or odd url is its own key, and a null page_id comes before
    others and is the response only among its like; then refers_to is null.
    Repeated rows are a response and revisits of it. Where no time is given,
    page_ids are the seconds, and equal times go by page_id. An empty table
    gives no rows and no archive; other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = fresh_folder(spark, "index")
    archives = write_archives(pages, folder, least_bytes, archive_bytes, captured)
    runs = index_runs(archives, scratch)
    merged = stash(merge_runs(runs, scratch, fan_in), "captures")
    remove(spark, scratch)
    discard(archives, runs)
    sizes = merged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row for each range
    return merged.join(F.broadcast(before), "range").select(*ENTRY.names, (F.col("before") + F.col("at")).alias("position"))


ORACLE_WARC = """
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM {pages}),
spelt AS (
  SELECT h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1)), '') AS payload_digest
  FROM (SELECT DISTINCT h FROM hashed)
), top AS (SELECT h, max(page_id) AS top FROM hashed GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM hashed JOIN spelt USING (h) JOIN top USING (h)
"""
