"""Mixing, packing, sharding, URL filter and fingerprints against plain versions and round trips."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from small_data import DATA

from quillrank.llm import queries as Q
from quillrank.llm.edit_embedding import fingerprint_documents, near_classes
from quillrank.llm.packing import LENGTH, choose_ends, default_tokenizer, pack_documents
from quillrank.llm.ring_sharding import place, shard_documents
from quillrank.llm.source_mix import mix_sources, mixed_documents
from quillrank.llm.tables import read
from quillrank.llm.url_filter import BUCKETS, RATE, RIDGE, RULES, STEPS, filter_urls, fit, grams, host_of, labelled_urls, path_of

from llm_words import words


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in read(spark, DATA, "documents").collect()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_sql(name, same_as_duck):
    same_as_duck(Q.queries()[name], Q.oracle_sql()[name])


def test_mix_takes_its_targets(spark):
    source = {r.doc_id: r.source for r in read(spark, DATA, "documents").collect()}
    taken, target = Counter(), {}
    for r in Q.op4_mix_sources(spark, DATA).collect():
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_mixed_documents_have_the_words_that_the_mix_takes(odd, spark):
    plan = Counter()
    for r in mix_sources(odd).collect():
        plan[r.doc_id] += r.taken
    mixed = mixed_documents(odd)
    assert mixed.columns == odd.columns
    found = Counter()
    for r in mixed.collect():
        found[r.doc_id] += len(words(r.text))
    assert +found == +plan
    assert mix_sources(odd.limit(0)).count() == mixed_documents(odd.limit(0)).count() == 0


def check_packed(pieces, expected: dict) -> None:
    """expected: a list of id lists for each doc_id; pieces carry ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(expected)
    for doc_id, own in by_doc.items():
        ids = sorted((p.start, np.frombuffer(p.ids, "<u4").tolist()) for p in own)
        if len(expected[doc_id]) == 1:
            assert [i for _, part in ids for i in part] == expected[doc_id][0]
            assert [s for s, _ in ids] == np.cumsum([0, *[len(x) for _, x in ids]])[:-1].tolist()
        assert sum(p.length for p in own) == sum(map(len, expected[doc_id]))
        assert all(p.length == len(p.ids) // 4 and p.doc_tokens in {len(x) for x in expected[doc_id]} for p in own)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        assert sum(p.length for p in own) <= LENGTH


def encoded(rows):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(default_tokenizer()), defaultdict(list)
    for doc_id, text in rows:
        out[doc_id].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2])
    return out


def test_packing_keeps_every_token(spark, texts):
    pieces = pack_documents(read(spark, DATA, "documents")).collect()
    check_packed(pieces, encoded(texts.items()))
    used = Counter()
    for p in pieces:
        used[p.sequence_id] += p.length
    padding = sum(LENGTH - n for n in used.values() if n & (n - 1))
    assert padding < 0.1 * sum(used.values())


def test_packing_of_odd_rows(odd, table):
    special = [(20, "a<|endoftext|>b <|STARTOFTEXT|>"), (21, "don't it's 'tis 3.14,5 a.b. x,, ..., e.g."), (22, "tab\tand\x0bmore\x0c  nbsp em")]
    docs = odd.select("doc_id", "text").union(table(special).select("doc_id", "text"))
    check_packed(pack_documents(docs).collect(), encoded([tuple(r) for r in docs.collect()]))
    assert pack_documents(odd.limit(0)).count() == 0


def test_window_ends_cost_least():
    rng = np.random.default_rng(5)
    for _ in range(30):
        at = np.cumsum(rng.integers(1, 9, 14)).tolist()
        penalty = rng.integers(0, 30, len(at)).tolist()

        def cost(ends, at=at, penalty=penalty):
            total, before = 0, 0
            for e in ends:
                total += 16 - (e - before) + 8 + penalty[at.index(e)]
                before = e
            return total

        best = [None] * len(at)
        for j in range(len(at)):
            for i in range(-1, j):
                begin = at[i] if i >= 0 else 0
                if at[j] - begin <= 16 and (i < 0 or best[i] is not None):
                    c = (best[i] if i >= 0 else 0) + 16 - (at[j] - begin) + 8 + penalty[j]
                    best[j] = c if best[j] is None else min(best[j], c)
        assert cost(choose_ends(at, penalty, 16)) == best[-1]


def test_shards_hold_every_row_once(spark, texts, odd):
    rows = Q.op8_ring_shards(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_shard = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        by_shard[r.shard].append(r.slot)
    assert set(by_shard) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert shard_documents(odd).count() == odd.count() and shard_documents(odd.limit(0)).count() == 0


def test_ring_moves_few_rows_and_keeps_its_bound():
    counts = {slot: 5 + slot % 7 for slot in range(0, 1 << 14, 3)}
    total = sum(counts.values())

    def shards(n, slack):
        out = {}
        for slot, first, last, shard, _ in place(counts, n, slack=slack):
            out.update({(slot, k): shard for k in range(first, last + 1)})
        return out

    for slack in (0.0, 0.1):
        before, after = shards(8, slack), shards(9, slack)
        assert len(before) == len(after) == total
        assert max(Counter(before.values()).values()) <= np.ceil((1 + slack) * total / 8)
        assert sum(before[k] != after[k] for k in before) < 0.18 * total


def test_the_ring_places_as_a_walk_row_by_row():
    """Every row goes clockwise to the first virtual node whose shard has room; a node serves its own arc before what full shards passed on."""
    rng = np.random.default_rng(4)
    counts = {int(slot): int(n) for slot, n in zip(rng.choice(1 << 14, 60, replace=False), rng.integers(1, 9, 60), strict=True)}
    nodes = sorted((zlib.crc32(f"shard {s}, node {v}".encode()) % (1 << 14), s) for s in range(3) for v in range(4))
    rows = [(slot, k) for slot in sorted(counts) for k in range(1, counts[slot] + 1)]
    room = [len(rows) // 3 + (s < len(rows) % 3) for s in range(3)]
    waiting, expected = [], {}
    for lap in range(3):
        for k, (at, shard) in enumerate(nodes):
            before = nodes[k - 1][0] if k else -1
            own = [r for r in rows if before < r[0] <= at or k == 0 and r[0] > nodes[-1][0]] if lap == 0 else []
            queue, waiting = own + waiting, []
            for r in queue:
                if room[shard]:
                    room[shard] -= 1
                    expected[r] = shard
                else:
                    waiting.append(r)
    found = {(slot, k): shard for slot, first, last, shard, _ in place(counts, 3, 4) for k in range(first, last + 1)}
    assert found == expected


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
    path = rest[end:]
    stop = min([i for i in (path.find(c) for c in "?#") if i >= 0] or [len(path)])
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:stop]


def rule_of(host, path):
    fits = [(len(rule), rule, action) for action, rule in RULES for at, _, rest in [rule.partition("/")] if (host == at or host.endswith("." + at)) and path.startswith("/" + rest)]
    return max(fits)[1:] if fits else (None, None)


def check_urls(rows, urls) -> None:
    for r in rows:
        host, path = split_url(urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        rule, verdict = rule_of(host, path)
        assert r.rule == rule and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_urls(spark):
    urls = {r.page_id: r.url for r in read(spark, DATA, "pages").collect()}
    rows = Q.op7_url_filter(spark, DATA).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    check_urls(rows, urls)


def test_odd_urls_and_the_model(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/en/12?x#y", "http://a.org", "http://notorg/", "http://example.org/es/", "http://x.com/fr/1://b.com/de/", "http://k.com?/de/", "http://É.ORG/a\nb"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule", "'z' as grams")
    rows = filter_urls(pages, labelled_urls(spark)).collect()
    assert len(rows) == len(urls)
    check_urls(rows, dict(enumerate(urls)))
    # Names of neither label's table.
    new = ["https://big-casino-slots.example.net/en/5", "https://cheap-pills-online.example.net/x", "https://schoollibrary.example.net/en/5", "https://historymuseum.example.net/x"]
    verdicts = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(list(enumerate(new)), "page_id long, url string"), labelled_urls(spark)).collect()}
    assert verdicts == {0: "block", 1: "block", 2: "allow", 3: "allow"}
    assert filter_urls(pages.limit(0), labelled_urls(spark)).count() == 0


def test_the_fit_as_in_matrices(spark):
    """Gradient steps of the dual with whole matrices."""
    labelled = labelled_urls(spark)
    rows = labelled.select("label", grams(host_of(F.col("url")), path_of(F.col("url"))).alias("grams")).collect()
    x = np.zeros((len(rows), BUCKETS))
    for i, r in enumerate(rows):
        x[i, r.grams] = 1 / np.sqrt(len(r.grams))
    y = np.array([r.label for r in rows])
    kernel = 1 + x @ x.T
    dual = np.zeros(len(rows))
    for _ in range(STEPS):
        dual += RATE / kernel.sum(axis=1).max() * (y - 1 / (1 + np.exp(-(kernel @ dual))) - RIDGE * dual)
    weights, intercept = fit(labelled)
    assert np.allclose(weights, x.T @ dual) and np.isclose(intercept, dual.sum())


def test_held_out_urls(spark):
    """Every fifth name is kept from the fit, with all its URLs."""
    rows = [tuple(r) for r in labelled_urls(spark).collect()]
    held = [r for k, r in enumerate(rows) if k // 2 % 5 == 2]
    known = spark.createDataFrame([r for r in rows if r not in held], "url string, label int")
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(held)], "page_id long, url string")
    right = [(r.score >= 0.5) == (held[r.page_id][1] == 1) for r in filter_urls(pages, known, rules=()).collect()]
    assert np.mean(right) >= 0.75


def edited(rows):
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(t) // 4
        out.append((d, t[: len(t) - k] + after[:k]))
    return out


def test_fingerprints_of_edited_texts_are_those_of_the_texts_themselves(spark, texts, table):
    rows = sorted((d, t or "") for d, t in texts.items())
    changed = dict(edited(rows))
    found = {r.doc_id: r for r in Q.op9_edit_fingerprints(spark, DATA).collect()}
    assert set(found) == set(texts)
    again = {r.doc_id: r.fingerprint for r in fingerprint_documents(table(list(changed.items()))).collect()}
    following = {d: rows[(i + 1) % len(rows)][0] for i, (d, _) in enumerate(rows)}
    seen = {}
    for d, t in rows:
        r = found[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed[d].encode()).hexdigest()
        assert r.edited_fingerprint == again[d]
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == texts[following[d]]:
            assert r.near_next == 1
    long = [found[d] for d, t in rows if len(t) > 400 and t != (texts[following[d]] or "")]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97


def test_fingerprints_of_odd_rows(odd, table):
    rows = fingerprint_documents(odd).collect()
    assert len(rows) == odd.count()
    assert len({r.fingerprint for r in rows if r.n_chars == 0}) == 1
    one = fingerprint_documents(table([(1, "abcdefgh")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1
    assert fingerprint_documents(odd.limit(0)).count() == 0


def test_near_texts_share_a_class(table):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdefgh nopqrstu"), 2000)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:1800] + "X" + t[1801:]) for i, t in enumerate(base)] + [(200 + i, t) for i, t in enumerate(base)]
    classes = {r.doc_id: r.class_id for r in near_classes(fingerprint_documents(table(rows)).select("doc_id", "fingerprint")).collect()}
    assert all(classes[200 + i] == classes[i] == i for i in range(20))
    assert np.mean([classes[100 + i] == i for i in range(20)]) >= 0.9
