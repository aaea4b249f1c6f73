"""The corpus pipeline against plain stages, and on what goes wrong in large tables."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from small_data import DATA

import corpus_pipeline as C
from quillrank import stored as stored_tables
from quillrank.llm import queries as Q
from quillrank.llm.packing import LENGTH, default_tokenizer
from quillrank.llm.tables import read

from plain import brute_components, plain_dedup, plain_mix, plain_toxicity


def stored(spark, folder, docs, labels) -> str:
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def encoded(text: str | None) -> list[int]:
    from tokenizers import Tokenizer

    if not hasattr(encoded, "tokenizer"):
        encoded.tokenizer = Tokenizer.from_file(default_tokenizer())
    return encoded.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def check_packed(rows, texts: list[tuple]) -> None:
    """Pieces hold every document's ids once, and sequences are gapless and full enough."""
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    expected = Counter((d, tuple(encoded(t))) for d, t in texts)
    found = Counter()
    for doc_id, own in pieces.items():
        own.sort(key=lambda r: (r.sequence_id, r.offset))
        ids = []
        for r in own:
            assert r.start == len(ids)
            ids += [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
            if len(ids) == r.doc_tokens:
                found[doc_id, tuple(ids)] += 1
                ids = []
        assert not ids
    assert found == expected
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= LENGTH


def test_the_pipeline_as_plain_stages(spark, tmp_path):
    docs, labels = read(spark, DATA, "documents"), read(spark, DATA, "labels")
    folder = stored(spark, tmp_path, docs, labels)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    source = {d: s for d, _, s in rows}
    scores = plain_toxicity([(d, t) for d, t, _ in rows], {r.doc_id: r.toxic for r in labels.collect()})
    clean = [(d, t) for d, t, _ in rows if scores[d][0] < 0.5]
    firsts = {d for d, _, c in brute_components(clean, 5, 80) if d == c}
    cut = plain_dedup([r for r in clean if r[0] in firsts])
    mixed = plain_mix([(d, t, source[d]) for d, t in cut.items()])
    check_packed(C.run(spark, folder).collect(), [(d, t) for (d, _), t in mixed.items()])


def test_stages_keep_columns_and_odd_rows(odd, spark, tmp_path):
    """Nulls, empty and very long texts, ties and repeated rows, and columns with the names that operators use."""
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (5, 1, 0), (7, 0, 1), (None, None, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    folder = stored(spark, tmp_path, odd, labels)
    docs = read(spark, folder, "documents")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.where("label <> 'x' or place <> 'x' or n_removed <> 'x'").isEmpty(), name
        docs = out
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert texts and all(t for _, t in texts)
    found = C.STAGES[-1][1](spark, docs, folder)
    assert sum(r.length for r in found.collect()) == sum(len(encoded(t)) for _, t in texts)


def test_an_empty_table_stays_empty(odd, spark, tmp_path):
    labels = spark.createDataFrame([(4, 0)], "doc_id long, toxic int")
    folder = stored(spark, tmp_path, odd.limit(0), labels)
    assert C.run(spark, folder).count() == 0


@pytest.mark.parametrize("name,stage", C.STAGES[:-1])
def test_a_stage_takes_repeated_rows_and_ties(name, stage, table, spark, tmp_path):
    docs = table([(7, "a b c d e f. g h i j k l. m n o p q r."), (7, "a b c d e f. g h i j k l. m n o p q r."), (7, "another text of the same id"), (None, None)])
    folder = stored(spark, tmp_path, docs, spark.createDataFrame([], "doc_id long, toxic int"))
    found = Counter((r.doc_id, r.text) for r in stage(spark, docs, folder).collect())
    if name in ("toxicity", "substring_dedup"):
        assert found == Counter((r.doc_id, r.text) for r in docs.collect())
    elif name == "ngram_join":
        assert found == Counter({(7, "a b c d e f. g h i j k l. m n o p q r."): 1, (None, None): 1})
    else:
        # Rows that are alike share a cut evenly, so two of them may leave a word.
        assert 0 <= round(1.5 * 42) - sum(len(t.split()) for _, t in found.elements()) <= 1


@pytest.mark.parametrize(("name", "most"), [("op3_ngram_join", 3), ("op9_edit_fingerprints", 1), ("op11_importance_resampling", 2), ("op12_warc", 2), ("pipeline", 4)])
def test_no_more_is_left_than_the_result_is_made_of(spark, tmp_path, monkeypatch, name, most):
    """Of tables and files in the shared folder."""
    monkeypatch.setattr(stored_tables, "shared_folder", lambda _: f"file://{tmp_path}")
    query = C.run if name == "pipeline" else Q.queries()[name]
    query(spark, DATA).write.format("noop").mode("overwrite").save()
    left = [p for p in tmp_path.iterdir() if p.is_dir()]
    assert 0 < len(left) <= most
