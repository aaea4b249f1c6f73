"""Edits from contents against a plain longest common subsequence, and imports of what can't be read."""

from __future__ import annotations

import json
import random

import pytest

from quillrank.operators.diff import edit_script, edits_from_contents, lines_of
from quillrank.schema import BAD_DATE, BAD_JSON, MISSING_KEY
from quillrank.sources import gerrit, github


def kept_lines(a: list, b: list) -> int:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def replayed(older: str | None, newer: str | None, script: list) -> list:
    a, b, out, at = lines_of(older), lines_of(newer), [], 0
    for kind, begin_a, end_a, begin_b, end_b in script:
        assert {"INSERT": begin_a == end_a and begin_b < end_b, "DELETE": begin_a < end_a and begin_b == end_b, "REPLACE": begin_a < end_a and begin_b < end_b}[kind]
        out += a[at:begin_a]
        assert len(out) == begin_b
        out += b[begin_b:end_b]
        at = end_a
    return out + a[at:]


@pytest.mark.parametrize("seed", range(300))
def test_scripts_are_shortest_and_lead_to_the_newer_text(seed):
    rng = random.Random(seed)
    letters = "abcdef"[: rng.randrange(1, 7)]
    texts = ["".join(f"{rng.choice(letters)}\n" for _ in range(rng.randrange(25))) + rng.choice(["", "a"]) for _ in range(2)]
    script = edit_script(*texts)
    a, b = map(lines_of, texts)
    assert replayed(*texts, script) == b
    assert sum(e[2] - e[1] + e[4] - e[3] for e in script) == len(a) + len(b) - 2 * kept_lines(a, b)


@pytest.mark.parametrize(("older", "newer", "script"), [(None, None, []), (None, "a\nb", [("INSERT", 0, 0, 0, 2)]), ("a\n", "", [("DELETE", 0, 1, 0, 0)]), ("a", "a\n", [("REPLACE", 0, 1, 0, 1)]), ("a\nb\nc\n", "a\nx\ny\nc\n", [("REPLACE", 1, 2, 1, 3)])])
def test_scripts_of_odd_texts(older, newer, script):
    assert edit_script(older, newer) == script


def test_versions_meet_across_moves_and_gaps(spark):
    commits = [("s", "f", 0, "c0", "f", ""), ("s", "f", 1, "c1", "f", ""), ("s", "f", 2, "c2", "old/f", ""), ("s", "f", 3, "c3", "old/f", "")]
    contents = [("s", "c0", "f", "a\nb\n"), ("s", "c1", "f", "a\n"), ("s", "c2", "old/f", "a\n"), ("s", "c9", "f", "no one's")]
    file_commit = spark.createDataFrame(commits, "sub_project string, root_path string, commit_seq int, commit_id string, path string, change_id string")
    found = edits_from_contents(file_commit, spark.createDataFrame(contents, "sub_project string, commit_id string, path string, content string"))
    assert sorted(tuple(r) for r in found.collect()) == [("s", "f", 0, 0, "INSERT", 1, 1, 1, 2), ("s", "f", 2, 0, "INSERT", 0, 0, 0, 1)]


def test_pull_requests_that_cant_be_read_are_rejected_one_by_one(spark):
    pull = {"id": 1, "number": 10, "state": "closed", "created_at": "2020-01-02T03:04:05Z", "user": {"id": 5, "login": "x"}}
    bad = {BAD_DATE: [{**pull, "created_at": "yesterday"}, {**pull, "created_at": None}, {**pull, "created_at": "2020-13-02T03:04:05Z"}], MISSING_KEY: [{k: v for k, v in pull.items() if k != "id"}, {**pull, "number": None}, {**pull, "user": None}]}
    bodies = {json.dumps(b): cause for cause, found in bad.items() for b in found} | {json.dumps(pull)[:40]: BAD_JSON, "": BAD_JSON, json.dumps({**pull, "id": "one"}): BAD_JSON}
    fine = [json.dumps({**pull, "id": 100 + k, "state": "open" if k == 2 else "closed"}) for k in range(3)]
    pulls, rejects = github.import_pulls(spark.createDataFrame([(b,) for b in [*bodies, *fine]], "body string"))
    assert {r.body: r.cause for r in rejects.collect()} == bodies
    assert sorted(r.changeId for r in pulls.collect()) == ["100", "101"]
    assert github.closed_pulls(spark.createDataFrame([(b,) for b in [*bodies, *fine]], "body string")).count() == 2


def test_changes_that_cant_be_read_are_rejected_one_by_one(spark):
    change = {"id": "p~1", "_number": 1, "project": "p", "created": "2020-01-02 03:04:05.000000000", "owner": {"_account_id": 7, "name": "n"}}
    bad = [({**change, "created": "soon"}, BAD_DATE), ({k: v for k, v in change.items() if k != "owner"}, MISSING_KEY), ({**change, "_number": "x"}, BAD_JSON)]
    prefix = ")]}'\n"
    pages = [prefix + json.dumps([change, *[b for b, _ in bad], {**change, "id": "p~2"}]), prefix + json.dumps(change), prefix + "[{", "", prefix + "[]"]
    changes, rejects = gerrit.import_changes(spark.createDataFrame([(p,) for p in pages], "body string"))
    assert sorted(r.id for r in changes.collect()) == ["p~1", "p~2"]
    found = sorted((r.cause, json.loads(r.body).get("id") if r.body.startswith("{") else r.body) for r in rejects.collect())
    assert found == sorted([(cause, "p~1") for _, cause in bad] + [(BAD_JSON, pages[1]), (BAD_JSON, pages[2]), (BAD_JSON, "")])
