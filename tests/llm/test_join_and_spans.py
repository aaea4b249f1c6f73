"""The n-gram join against all pairs, and span dedup against a plain version."""

from __future__ import annotations

import random

from small_data import DATA

from quillrank.llm import queries as Q
from quillrank.llm.ngram_join import ngram_join, one_of_each
from quillrank.llm.span_dedup import dedup_spans
from quillrank.llm.tables import read

from plain import brute_components, plain_dedup


def crafted(seed: int, n: int) -> list[tuple]:
    """Copies, near copies in chains, common beginnings, short texts."""
    rng = random.Random(seed)
    rows, base = [], [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 4, 6, 30, 80]))] for _ in range(12)]
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 0, 1, 2, 5])):
            text[rng.randrange(len(text))] = f"X{rng.randrange(50)}"
        if rng.random() < 0.1:
            base.append(text)
        rows.append((1000 - i, rng.choice(["", "common start of every text "]) + rng.choice([" ", "\n"]).join(text)))
    return rows


def test_join_finds_what_all_pairs_find(table):
    for seed, n, percent in ((1, 4, 85), (3, 3, 50)):
        rows = crafted(seed, 150)
        found = sorted(tuple(r) for r in ngram_join(table(rows), n, percent).collect())
        assert found == brute_components(rows, n, percent)


def test_join_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, DATA, "documents").collect()]
    assert sorted(tuple(r) for r in Q.op3_ngram_join(spark, DATA).collect()) == brute_components(rows, 4, 85)


def test_join_on_odd_rows(odd):
    rows = ngram_join(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_shingles == by_id[2].n_shingles == by_id[3].n_shingles == 0 and by_id[2].component_id == 2
    assert by_id[6].component_id == 5 and by_id[8].component_id == 4
    assert ngram_join(odd.limit(0)).count() == 0


def test_one_document_of_each_group_stays(odd, table):
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 7]
    assert kept.where("doc_id is null").count() == 2
    two = one_of_each(table([(1, "b c d e f g"), (1, "a c d e f g h")])).collect()
    assert [r.text for r in two] == ["a c d e f g h"]
    assert one_of_each(odd.limit(0)).count() == 0


def passages(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    sentence = lambda: " ".join(f"s{rng.randrange(3000)}" for _ in range(rng.choice([1, 2, 6, 9, 14, 45]))) + rng.choice([".", "!", "?", "", "...\n", "\n\n"])
    shared = [" ".join(sentence() for _ in range(5)) for _ in range(4)]
    return [(i, " ".join(rng.choice([sentence(), sentence(), rng.choice(shared)]) for _ in range(rng.randrange(9)))) for i in range(n)]


def test_spans_go_as_in_the_plain_version(table):
    for seed in (1, 2, 3):
        rows = passages(seed, 80)
        assert {r.doc_id: r.text for r in dedup_spans(table(rows)).collect()} == plain_dedup(rows)


def test_spans_with_other_bounds(table):
    rows = passages(4, 60)
    assert {r.doc_id: r.text for r in dedup_spans(table(rows), run_words=8, alone_words=14).collect()} == plain_dedup(rows, 8, 14)


def test_rows_of_one_id_are_one_document(table):
    """A third of all rows have one id: the text that comes first stays, once; null comes before all."""
    many = [(7, f"text number {i % 40} of very many {i % 40} under one and the same id {i % 40}") for i in range(60)]
    rows = [*many, (8, "b and some more words"), (8, None), (8, "a and other words, too"), *[(100 + i, f"unlike {i} {i + 1} {i * 7} {i * 11}") for i in range(120)]]
    kept = sorted(((r.doc_id, r.text) for r in one_of_each(table(rows)).collect()), key=str)
    assert kept == sorted([(7, min(t for _, t in many)), (8, None), *rows[-120:]], key=str)


def test_spans_on_documents(spark):
    """In many small batches, too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = [(r.doc_id, r.text) for r in read(spark, DATA, "documents").collect()]
    assert {r.doc_id: r.text for r in Q.op5_span_dedup(spark, DATA).collect()} == plain_dedup(rows)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_spans_on_odd_rows(odd):
    found = dedup_spans(odd)
    assert found.count() == odd.count() and set(odd.columns) <= set(found.columns)
    by_id = {r.doc_id: r.text for r in found.collect()}
    before = {r.doc_id: r.text for r in odd.collect()}
    assert by_id[1] is None and by_id[2] == "" and by_id[3] == before[3] and by_id[7] == before[7]
    assert by_id[5] == before[5] and by_id[6] == ""
    assert dedup_spans(odd.limit(0)).count() == 0
