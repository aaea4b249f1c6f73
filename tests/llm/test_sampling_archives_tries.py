"""Importance resampling, archives and the trie of conversations against plain versions, and on odd rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from small_data import DATA

from quillrank.llm import importance as I
from quillrank.llm import kernels as K
from quillrank.llm import prefix_trie as T
from quillrank.llm import warc as W
from quillrank.llm.tables import read
from quillrank.stored import fresh_folder

from llm_words import ODD


# Importance resampling.
def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + n]).encode() for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f) % 10000
    features = [plain_features(t) for _, t in rows]
    source, aim = Counter(bucket(f) for _, fs in features for f in fs), Counter(bucket(f) for t in target for f in plain_features(t)[1])
    n_source, n_aim = source.total(), aim.total()
    gain = {b: math.floor(1000 * math.log((aim[b] + 1.0) * (n_source + 10000.0) / ((source[b] + 1.0) * (n_aim + 10000.0)))) for b in source}
    out = []
    for (d, _), (w, fs) in zip(rows, features, strict=True):
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i for i, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def test_checksums_of_runs_are_those_of_their_strings():
    texts = ["one Two three four", "", None, "x" * 5000 + " " + "yé" * 300 + " z", "Ünïcode—日本 3D 🎉", "a" * 63 + " " + "b" * 64 + " " + "c" * 65 + " " + "d" * 128]
    for block in K.blocks(pa.array(texts), limit=1 << 20):
        found = defaultdict(list)
        for n, (crc, inside, words) in enumerate(I.feature_crcs(block, 3), 1):
            for i in np.flatnonzero(inside):
                found[int(words.doc[i])].append(int(crc[i]))
        for k, text in enumerate(texts):
            assert found[k] == [zlib.crc32(f) for f in plain_features(text)[1]]


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_resampling_is_the_plain_one(spark, percent):
    docs, target = read(spark, DATA, "documents"), read(spark, DATA, "benchmark")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = plain_resample(rows, [r.text for r in target.collect()], percent)
    assert sorted((tuple(r) for r in I.importance_resample(docs, target, percent).collect()), key=str) == expected
    drawn = I.drawn_documents(docs, target, percent=percent)
    assert drawn.columns == docs.columns
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r[0] for r in expected if r[4])


def test_resampling_of_odd_rows(spark, table, odd):
    target = spark.createDataFrame([(1, None), (2, "word1 and number"), (3, "")], "item_id long, text string")
    expected = plain_resample([(r[0], r[1]) for r in ODD], [None, "word1 and number", ""], 60)
    assert sorted((tuple(r) for r in I.importance_resample(odd, target, 60).collect()), key=str) == expected
    # Ties: equal texts of repeated and of null ids, each with a place of its own.
    text = " ".join(f"w{i}" for i in range(30))
    ranks = sorted(r.rank for r in I.importance_resample(table([(1, text)] * 5 + [(None, text)] * 5), target, 100).collect())
    assert ranks == list(range(1, 11))
    assert I.importance_resample(odd.limit(0), target).count() == 0
    assert I.importance_resample(odd, target.limit(0), 100).where("rank is not null").count() == 2


# Archives.
def plain_captures(rows):
    place = lambda p: (p is not None, p or 0)
    top = {}
    for p, _, html in rows:
        top[html or ""] = max(top.get(html or "", (False, 0)), place(p))
    met, out = set(), []
    for p, _, html in rows:
        data, best = (html or "").encode(), top[html or ""]
        response = place(p) == best and (html or "") not in met
        if response:
            met.add(html or "")
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response or not best[0] else best[1]))
    return sorted(out, key=str)


PAGES = [(i, f"http://{'www' if i % 3 else 'a'}.example.{'com' if i % 2 else 'org'}/p/{i % 17}?q={i}#f", f"<p>page {i % 40}</p>" if i % 3 else "the same") for i in range(300)]
ODD_PAGES = [(None, None, None), (None, "no host", None), (1, "http://[bad/x", ""), (2, "http://h:8080/a\r\nWARC-Type: x", "é" * 200_000), (3, "https://H.example:443/", "x"), (3, "https://H.example:443/", "x"), (3, "ftp://other", "x"), (2**62, "http://late/", "\r\n\r\n"), (-5, "http://early/", "early"), (None, "http://early/", "alone")]


@pytest.mark.parametrize(("rows", "archive_bytes", "fan_in"), [(PAGES, 1 << 30, 64), (PAGES, 4000, 2), (ODD_PAGES, 300, 2)])
def test_captures_are_the_plain_ones(spark, rows, archive_bytes, fan_in):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("x").alias(c) for c in ("key", "sha", "payload", "range", "at", "archive")])
    found = W.archive_pages(pages, fresh_folder(spark, "warc"), archive_bytes=archive_bytes, fan_in=fan_in).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == plain_captures(rows)
    # One order over all, by URL and time.
    by_place = sorted(found, key=lambda r: r.position)
    assert [r.position for r in by_place] == list(range(len(rows)))
    order = [(r.url_key, r.captured, W.NO_ID if r.page_id is None else r.page_id) for r in by_place]
    assert order == sorted(order)
    # Entries lead to their records, and payloads come back.
    payloads = {h or "" for _, _, h in rows}
    for archive in {r.archive for r in found}:
        at = {offset: (length, headers, block) for offset, length, headers, block in W.records(archive)}
        for r in found:
            if r.archive == archive:
                length, headers, block = at[r.offset]
                assert (length, headers["WARC-Type"]) == (r.length, r.record_type)
                body = block.split(b"\r\n\r\n", 1)[1].decode()
                assert body in payloads if r.record_type == "response" else body == ""


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    kinds = Counter(r.record_type for r in W.archive_pages(pages, fresh_folder(spark, "warc"), least_bytes=9).where("payload_digest is not null").collect() if r.payload_bytes < 9)
    assert kinds == {"response": 100}
    assert W.archive_pages(pages.limit(0), fresh_folder(spark, "warc")).count() == 0


class _Plain:
    """A run in memory, in blocks of a few entries."""

    def __init__(self, rows, width):
        self.blocks, self.rows = [rows[i : i + width] for i in range(0, len(rows), width)], []

    def key(self):
        while not self.rows and self.blocks:
            self.rows = self.blocks.pop(0)
        return self.rows[0] if self.rows else None

    def taken(self, before):
        n = sum(before is None or r < before for r in self.rows)
        out, self.rows = self.rows[:n], self.rows[n:]
        return out


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8, 65])
def test_loser_trees_merge_any_number_of_runs(k):
    dice = random.Random(k)
    rows = [(dice.randrange(1000), i) for i in range(40 * k)]
    runs = [sorted(r for r in rows if r[1] % k == j and j % 5) for j in range(k)]
    merged = [r for stretch in W.loser_tree([_Plain(r, 3) for r in runs]) for r in stretch]
    assert merged == sorted(r for run in runs for r in run)


def test_a_damaged_archive_is_found(spark, tmp_path):
    good = W.record(1, "http://a/", 5, b"payload", 7, base64.b32encode(hashlib.sha1(b"other..").digest()).decode(), None)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(good)
    with pytest.raises(ValueError, match="damaged"):
        [W.entry(f"file://{path}", *r) for r in W.records(f"file://{path}")]
    path.write_bytes(good[:-20])
    with pytest.raises(ValueError, match="ends inside"):
        list(W.records(f"file://{path}"))


# The trie.
def plain_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            name = bytes.fromhex(hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest())
            own[c].append(((t is not None, t or 0, name), (role or "", text or "")))
    own = {c: [turn for _, turn in sorted(found)] for c, found in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not children[p]
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()), key=str)


def found_trie(conversations):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in T.prefix_trie(conversations).select(*columns).collect()), key=str)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(3))
def test_trie_is_the_plain_one(spark, seed):
    """Few different turns, so that paths meet, part and hang on each other in many levels."""
    dice = random.Random(seed)
    rows = [(c, t, dice.choice(["user", "bot"][: 1 + seed % 2]), dice.choice(["é", "aa", "a"][: 1 + (t > 3) + seed % 2])) for c in dice.sample(range(-20, 400), 150) for t in range(dice.randrange(1, 14))]
    assert found_trie(spark.createDataFrame(rows, TURNS).repartition(3)) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    long = "y" * 300_000
    rows = [(None, 1, "user", "nobody's"), (0, None, None, None), (0, None, None, "null turns"), (0, 1, "", ""), (0, 1, "", ""), (3, 1, "user", long), (4, 2, "user", long), (4, 2, "user", long), (7, 5, "bot", None), (7, 5, "bot", "tie"), (2**62, 1, "x", "y"), (-7, 1, "x", "y")]
    odd = spark.createDataFrame(rows, TURNS).select("*", *[F.lit(1).alias(c) for c in ("node", "parent", "depth", "base", "n_bytes", "ends")])
    assert found_trie(odd) == plain_trie(rows)
    assert found_trie(odd.limit(0)) == []
    # Conversations that lose all their turns are members of the root alone.
    short = [(c, 1, "user", "hi") for c in range(1, 200, 5)]
    assert found_trie(spark.createDataFrame(short, TURNS)) == plain_trie(short)


def test_trie_in_portions(spark, monkeypatch):
    """Very long conversations and families hand their nodes on; lists that very many share come in pieces."""
    monkeypatch.setattr(T, "MOST_NODES", 50)
    monkeypatch.setattr(T, "ROWS", 7)
    monkeypatch.setattr(T, "PIECE", 40)
    rows = [(c, t, "u", str(t)) for c in (0, 1, 2, 10) for t in range(120)] + [(c, t, "u", str(t)) for c in range(100, 400) for t in range(2)]
    assert found_trie(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)
