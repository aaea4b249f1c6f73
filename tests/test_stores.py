"""Storing, exports, requests and responses, step by step."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from small_data import DATA

from quillrank.functions.times import gerrit_millis, github_millis
from quillrank.operators.cleaning import cleaned, keep_reviewed, without_owner
from quillrank.operators.rank_lines import initial_points
from quillrank.plans.recommend import TABLES, Method, append, as_json, delete_without_files, load, recommend, save, shown
from quillrank.plans.store import Conflict, Store
from quillrank.schema import DEVELOPER, FILE_PATH, PROJECT, PULL_REQUEST, REVIEW, History, Settings
from quillrank.sources import exports, gerrit, git, github, star, star_git
from quillrank.streaming.refresh import latest_counts, start_refresh


def small(spark, shift: int = 0, prs=(1, 2)) -> History:
    """Two developers and one who is stored under another id if ``shift``ed."""
    table = spark.createDataFrame
    people = [(1 + shift, "a", "", "Ann", None), (2 + shift, "b", "", "Bo", None), (3 + shift, None, "c@x", None, None)]
    pulls = [(p, "p", "s", f"ch{p}", p, 1000 * p, 1 + shift) for p in prs]
    return History(table([("p", None)], PROJECT), table(people, DEVELOPER), table(pulls, PULL_REQUEST), table([(p, r + shift) for p in prs for r in (1, 2, 3)], REVIEW), table([(p, x) for p in prs for x in ("a/b", "a/b", "c")], FILE_PATH))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cleaning_in_one_go(spark):
    raw = star.raw_history(spark, DATA)
    two, one = keep_reviewed(without_owner(raw)), cleaned(raw)
    for name in ("pull_requests", "reviews", "file_paths"):
        assert rows(getattr(one, name)) == rows(getattr(two, name))


def test_appending_calls_people_by_their_stored_ids(spark, tmp_path):
    save(cleaned(small(spark)), str(tmp_path / "h"))
    append(load(spark, str(tmp_path / "h")), small(spark, shift=50, prs=(2, 3)), str(tmp_path / "h"))
    now = load(spark, str(tmp_path / "h"))
    assert rows(now.pull_requests.select("id", "owner_id")) == [(1, 1), (2, 1), (3, 1)]
    assert rows(now.developers.select("id")) == [(1,), (2,), (3,)]
    assert rows(now.reviews) == [(p, r) for p in (1, 2, 3) for r in (2, 3)]
    assert rows(now.file_paths) == rows(small(spark, prs=(1, 2, 3)).file_paths)


def everything(history: History) -> dict:
    return {name: rows(getattr(history, name)) for name in TABLES}


@pytest.mark.parametrize("breaks_at", range(len(TABLES) + 1))
def test_what_breaks_off_at_any_step_changes_nothing(spark, tmp_path, monkeypatch, breaks_at):
    folder = str(tmp_path / "h")
    save(cleaned(small(spark)), folder)
    before, steps = everything(load(spark, folder)), []
    write, commit = Store._write, Store._commit

    def broken(what):
        def step(*args):
            if len(steps) == breaks_at:
                raise OSError("gone")
            steps.append(what)
            return what(*args)

        return step

    monkeypatch.setattr(Store, "_write", broken(write))
    monkeypatch.setattr(Store, "_commit", broken(commit))
    changes = [lambda: append(load(spark, folder), small(spark, prs=(3,)), folder), lambda: save(small(spark, prs=(9,)), folder)]
    if breaks_at < 2:
        changes.append(lambda: Store(spark, folder).delete(small(spark).pull_requests))
    for change in changes:
        steps.clear()
        with pytest.raises(OSError, match="gone"):
            change()
        assert everything(load(spark, folder)) == before
    monkeypatch.undo()
    append(load(spark, folder), small(spark, prs=(3,)), folder)
    append(load(spark, folder), small(spark, prs=(3,)), folder)
    assert everything(load(spark, folder)) == everything(cleaned(small(spark, prs=(1, 2, 3))))
    Store(spark, folder).clean()
    assert everything(load(spark, folder)) == everything(cleaned(small(spark, prs=(1, 2, 3))))
    assert Store(spark, folder).versions() == [3] and not list((tmp_path / "h/versions").glob("_*"))


def test_readers_keep_their_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "h"))
    assert everything(store.load()) == {name: [] for name in TABLES}
    assert store.replace(cleaned(small(spark))) == 1
    old = store.load()
    files = spark.createDataFrame([(1, '{"message": "Not Found"}'), (2, "[]")], "number long, body string")
    delete_without_files(files, "other", store.folder)
    assert rows(store.load().pull_requests.select("id")) == [(1,), (2,)]
    delete_without_files(files, "p", store.folder)
    now = store.load()
    assert [rows(t.select(c).distinct()) for t, c in ((now.pull_requests, "id"), (now.reviews, "pr_id"), (now.file_paths, "pr_id"))] == [[(2,)]] * 3
    assert rows(now.developers) == rows(old.developers)
    store.append(cleaned(small(spark, prs=(1,))))
    assert rows(store.load().pull_requests.select("id")) == [(1,), (2,)]
    assert everything(old) == everything(cleaned(small(spark))) == everything(store.load(1))
    with pytest.raises(Conflict):
        store._commit([], 2)
    assert github.after_files(old, "p", files).pull_requests.select("id").collect() == [(2,)]
    store.replace(small(spark, prs=(7,)))
    store.clean()
    assert store.versions() == [5] and rows(store.load().pull_requests.select("id")) == [(7,)]


def test_lists_end_at_their_first_empty_page(spark):
    pages = [(1, 1, "[1]"), (1, 2, "[ ]"), (1, 3, "[3]"), (2, 1, "[1]"), (2, 3, "[3]"), (3, 2, "[2]"), (4, 1, None), (4, 2, "[2]"), (5, 1, "[1]"), (5, 2, "[2]"), (None, 1, "[1]")]
    found = github.until_empty(spark.createDataFrame(pages, "number long, page int, body string"), "number")
    assert rows(found.select("number", "page")) == sorted([(1, 1), (2, 1), (5, 1), (5, 2), (None, 1)], key=str)


def test_exports_are_read_as_they_are_written(spark, tmp_path):
    history = cleaned(small(spark))
    exports.write_export(history, str(tmp_path / "e"))
    back = exports.normalized(exports.read_export(spark, str(tmp_path / "e/project=p"), lines=True), "p")
    assert rows(back.pull_requests.select("change_id", "change_number", "ts", "sub_project")) == rows(history.pull_requests.select("change_id", "change_number", "ts", "sub_project"))
    assert (back.reviews.count(), back.file_paths.count(), back.developers.count()) == (4, 6, 3)
    bad = tmp_path / "bad.json"
    bad.write_text('{"changeId": "x", "reviewers": [], "filePaths": []}\n{"changeId": "y", \n7\n{"timestamp": 5}\n')
    assert rows(exports.normalized(exports.read_export(spark, str(bad), lines=True), "p").pull_requests.select("change_id")) == [("x",)]
    whole = tmp_path / "whole.json"
    whole.write_text('[{"changeId": "x", "timestamp": 1,\n "reviewers": [], "filePaths": [{"location": "a"}]}, {"changeId": "y"}]')
    assert rows(exports.normalized(exports.read_export(spark, str(whole)), "p").pull_requests.select("change_id", "ts")) == [("x", 1), ("y", None)]


def test_a_request_gets_developers_in_order(spark):
    history = cleaned(small(spark))
    target = spark.createDataFrame([(9, "p", "s", "chx", 9, 9000, 1)], PULL_REQUEST)
    paths = spark.createDataFrame([(9, "a/b")], FILE_PATH)
    for method in (Method.PATHS, Method.BAYES):
        ranking = recommend(history, target, paths, method, Settings(demote_inactive=True))
        assert [r.name for r in shown(ranking, history).orderBy("rank").collect()] == ["Bo", None]
        (body,) = [json.loads(r.body) for r in as_json(ranking, history).collect()]
        assert [p.get("accountId") for p in body] == ["b", None]
    log = spark.createDataFrame([("s", "a/b", k, f"c{k}", "a/b", f"ch{k}") for k in range(3)], "sub_project string, root_path string, commit_seq int, commit_id string, path string, change_id string")
    edit = spark.createDataFrame([("s", "a/b", 0, 0, "REPLACE", 0, 2, 0, 2), ("s", "a/b", 1, 0, "REPLACE", 0, 1, 0, 1)], "sub_project string, root_path string, commit_seq int, edit_seq int, type string, begin_a int, end_a int, begin_b int, end_b int")
    people = spark.createDataFrame([("ch1", "a", "approver", 2), ("ch2", "b", "owner", None)], "change_id string, account_id string, role string, value int")
    ranking = recommend(history, target, paths, Method.LINES, git={"file_commit": log, "edit": edit, "change_people": people})
    assert [(r.name, round(s, 9)) for r, s in zip(shown(ranking, history).orderBy("rank").collect(), [r.score for r in ranking.orderBy("rank").collect()], strict=True)] == [("Bo", 1.9), ("Ann", 1.0)]


def test_github_responses(spark):
    pulls = ['{"id": 5, "number": 2, "state": "closed", "created_at": "2020-01-02T03:04:05Z", "changed_files": 1, "user": {"id": 8, "login": "dev", "avatar_url": "u"}}', '{"id": 6, "number": 3, "state": "open"}', '{"state": null}', "no json", None]
    (pull,) = github.closed_pulls(spark.createDataFrame([(b,) for b in pulls], "body string")).collect()
    assert (pull.number, pull.changeId, pull.subProject, pull.timestamp, pull.owner.accountId, pull.owner.avatar) == (2, "5", "", 1577934245000, "8", "u")
    files = spark.createDataFrame([(2, 1, '[{"filename": "a"}, {"filename": "b"}]'), (2, 2, "[]"), (3, 1, '{"message": "Not Found"}')], "number long, page int, body string")
    assert rows(github.file_paths(files)) == [(2, "a"), (2, "b")] and rows(github.without_files(files)) == [(3,)]
    assert github.page(1) == (0, 30) and github.page(3) == (60, 30)
    urls = spark.createDataFrame([("https://api.github.com/x",), ("https://review.example.org",), (None,)], "u string")
    assert [r[0] for r in urls.select(github.is_github(F.col("u"))).collect()] == [True, False, False]


def test_gerrit_responses(spark):
    account = lambda k, **more: {"_account_id": k, "name": f"n{k}", "email": f"{k}@x", **more}
    changes = [
        {"id": "p~1", "_number": 1, "project": "p", "created": "2020-01-02 03:04:05.999999999", "owner": account(1, avatars=[{"url": "first"}, {"url": "second"}]), "labels": {"Code-Review": {"all": [{**account(2), "value": 2}, {**account(3), "value": 0}, {**account(1), "value": 1}]}}, "current_revision": "r", "revisions": {"r": {"files": {"/COMMIT_MSG": {}, "a/b": {}}}, "old": {"files": {"z": {}}}}, "messages": [{"author": account(7)}, {"author": account(7)}, {}]},
        {"id": "p~2", "_number": 2, "project": "p", "created": "2020-01-02 03:04:05", "owner": account(4), "labels": {"Code-Review": {}}},
    ]
    found = gerrit.changes(spark.createDataFrame([(star_git.PREFIX + json.dumps(changes),)], "body string"))
    assert rows(gerrit.file_paths(found, keep_message=False)) == [("p~1", "a/b")] and len(rows(gerrit.file_paths(found))) == 2
    assert [r.id for r in gerrit.change(found, "p~2").collect()] == ["p~2"] and gerrit.change(found, "none").count() == 0
    (live,) = gerrit.live_target(found, 1).collect()
    assert (live.changeId, live.subProject, live.timestamp, live.owner.avatar, live.paths) == ("p~1", "p", 1577934245000, "first", ["a/b"])
    assert rows(gerrit.people_of_changes(found)) == [("p~1", 1, "approver"), ("p~1", 1, "owner"), ("p~1", 2, "approver")]
    assert [(r.changeId, r.author.accountId) for r in gerrit.commentators(found).collect()] == [("p~1", "7")]
    (seen,) = gerrit.account_of(found, 4).collect()
    assert (seen.name, seen.avatar) == ("n4", None)


def test_times_and_points(spark):
    one = spark.range(1)
    assert one.select(github_millis(F.lit("1970-01-01T00:00:01Z")), gerrit_millis(F.lit("1970-01-01 00:00:02.5")), initial_points(F.lit("a.py"))).first()[:] == (1000, 2000, 1.0)


MESSAGES = {
    "Subject": [],
    "Subject\n\nChange-Id: Iabc": [("Change-Id", "Iabc")],
    "Subject\n\nBody: text\n\nSigned-off-by: A B\nnot a footer\nChange-Id:  I9\n\n": [("Signed-off-by", "A B"), ("Change-Id", "I9")],
    "Subject: x\n\nNo footers here": [],
    "": [],
}


@pytest.mark.parametrize("message", MESSAGES)
def test_footers(message, spark):
    found = spark.createDataFrame([(message,)], "m string").select(git.footers(F.col("m")).alias("f"), git.change_id(F.col("m")).alias("c")).first()
    assert [tuple(f) for f in found.f] == MESSAGES[message]
    assert found.c == (MESSAGES[message][0][1] if MESSAGES[message] else "")


def test_refresh_counts_each_review_once(spark, tmp_path):
    schema = "project string, reviewer_id long, owner_id long, sub_project string"
    add = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    for batch in ([("p", 1, 2, None), ("p", 1, 2, None)], [("p", 1, 2, None), ("q", 1, 2, "s")]):
        add(batch)
        start_refresh(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert rows(latest_counts(spark, str(tmp_path / "out"))) == [("p", 1, 2, None, 3), ("q", 1, 2, "s", 1)]
