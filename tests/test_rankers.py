"""The path ranker against a plain one, and all rankers on nulls, ties and empty tables."""

from __future__ import annotations

import random
from collections import defaultdict
from dataclasses import replace

import pytest
from small_data import DATA

from quillrank.operators import path_blocks
from quillrank.operators import rank_nb as rank_nb_module
from quillrank.operators.path_blocks import rank_paths_in_blocks
from quillrank.operators.postprocess import demote_inactive, with_activity
from quillrank.operators.rank_nb import beliefs, fit_nb, fold_cutoffs, fold_targets, rank_nb
from quillrank.operators.rank_paths import rank_paths
from quillrank.operators.relational import reviewed_between
from quillrank.plans.evaluate import VARIANTS, evaluate, path_targets
from quillrank.schema import DEVELOPER, FILE_PATH, PROJECT, PULL_REQUEST, REVIEW, History
from quillrank.sources import star

SUBS = (None, "", "a", "a/b", "/", "x")
PATHS = ("", "/", "a", "x", "a/x", "x/a/y", "ab/x/y", "//a", "y/ab", "x/y/z/a/", "a/a/a")
DAY = 24 * 60 * 60 * 1000


def made(spark, seed: int, n: int) -> History:
    rng = random.Random(seed)
    table = spark.createDataFrame
    pulls = [(k, rng.choice(["p", "q"]), rng.choice(SUBS), f"c{k}", k, rng.randrange(n // 2) * 100 * DAY, rng.randrange(4)) for k in range(n)]
    reviews = {(k, rng.randrange(5)) for k in range(n) for _ in range(rng.randrange(3))}
    paths = [(k, rng.choice(PATHS)) for k in range(n) for _ in range(rng.randrange(4))]
    return History(table([("p", None), ("q", None)], PROJECT), table([(k, str(k), "", f"n{k}", None) for k in range(5)], DEVELOPER), table(pulls, PULL_REQUEST), table(sorted(reviews), REVIEW), table(paths, FILE_PATH))


def parts(path: str) -> list[str]:
    if path == "":
        return [""]
    bare = path.rstrip("/")
    return bare.split("/") if bare else []


def common(a: list, b: list) -> tuple:
    prefix = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    suffix = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))  # noqa: B905
    substring = max((k for k in range(1, len(a) + 1) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i : i + k] == b[j : j + k]), default=0)
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return prefix, suffix, substring, table[-1][-1]


def plain_ranking(history: History, use_sub_project: bool) -> dict:
    """(reviewer, points) in order, by target, for all pull requests."""
    pulls = history.pull_requests.collect()
    reviewers, paths = defaultdict(set), defaultdict(list)
    for r in history.reviews.collect():
        reviewers[r.pr_id].add(r.reviewer_id)
    sub = {p.id: (p.sub_project or "") if use_sub_project else "" for p in pulls}
    for f in history.file_paths.collect():
        paths[f.pr_id].append(parts(f"{sub[f.pr_id].replace('/', '')}/{f.location}" if sub[f.pr_id] else f.location))
    out = {}
    for t in pulls:
        scores = [defaultdict(float) for _ in range(4)]
        for h in pulls:
            if h.project == t.project and (h.ts, h.id) < (t.ts, t.id) and paths[t.id] and paths[h.id]:
                for k in range(4):
                    total = sum(common(a, b)[k] / max(len(a), len(b)) for a in paths[t.id] for b in paths[h.id] if max(len(a), len(b)))
                    for r in reviewers[h.id]:
                        scores[k][r] += total / (len(paths[t.id]) * len(paths[h.id]))
        points = defaultdict(int)
        for ballot in scores:
            order = sorted((r for r in ballot if round(ballot[r], 9) > 0), key=lambda r: (-round(ballot[r], 9), r))
            for place, r in enumerate(order):
                points[r] += len(order) - place
        if points:
            out[t.id] = sorted(points.items(), key=lambda x: (-x[1], x[0]))
    return out


@pytest.mark.parametrize("use_sub_project", [False, True])
def test_paths_as_a_plain_ranking(use_sub_project, spark):
    """Sub-projects that are components of paths, empty ones and none; empty paths, slashes only, and equal times."""
    for seed in (1, 2):
        history = made(spark, seed, 40)
        targets = history.pull_requests.selectExpr("id as target_id", "project", "row_number() over (partition by project order by ts desc, id desc) - 1L as rk")
        found = defaultdict(list)
        for r in rank_paths(targets, history, use_sub_project).orderBy("target_id", "rank").collect():
            found[r.target_id].append((r.reviewer_id, r.score))
        assert dict(found) == plain_ranking(history, use_sub_project)


@pytest.mark.parametrize(("use_sub_project", "block"), [(False, 7), (True, 5), (True, 256)])
def test_paths_in_blocks_as_a_plain_ranking(use_sub_project, block, spark, monkeypatch):
    """Sums before a block and what happens inside it, where equal times and pull requests without paths or reviewers lie at its borders."""
    monkeypatch.setattr(path_blocks, "BLOCK", block)
    for seed in (1, 2):
        history = made(spark, seed, 40)
        targets = history.pull_requests.selectExpr("id as target_id")
        ranked = lambda rows: {(r.target_id, r.reviewer_id): (r.score, r.rank) for r in rows.collect()}
        expected = {(t, r): (points, k) for t, found in plain_ranking(history, use_sub_project).items() for k, (r, points) in enumerate(found, 1)}
        assert ranked(rank_paths_in_blocks(targets, history, use_sub_project)) == expected
        demoted = ranked(demote_inactive(spark.createDataFrame([(*key, float(s), k) for key, (s, k) in expected.items()], path_blocks.RANKING), history))
        assert ranked(rank_paths_in_blocks(targets, history, use_sub_project, 12)) == demoted
        assert ranked(rank_paths_in_blocks(targets, history, use_sub_project, 12, best=2)) == {key: v for key, v in demoted.items() if v[1] <= 2}
        asked = spark.createDataFrame([(t, 3) for t in range(40)], "target_id long, reviewer_id long")
        assert ranked(rank_paths_in_blocks(targets, history, use_sub_project, 12, asked=asked)) == {key: v for key, v in demoted.items() if key[1] == 3}


@pytest.mark.parametrize("use_sub_project", [False, True])
def test_bayes_in_blocks(use_sub_project, spark, monkeypatch):
    """Ranks by beliefs of single rows, and demotion, the best and those asked for as from the whole ranking."""
    monkeypatch.setattr(rank_nb_module, "BLOCK", 3)
    history = made(spark, 4, 90)
    model, targets = fit_nb(history, fold_cutoffs(history), use_sub_project), fold_targets(history)
    ballots = defaultdict(list)
    for r in beliefs(model, targets, history).collect():
        ballots[r.target_id, r.location, r.n_copies].append((-r.belief, r.reviewer_id))
    points = defaultdict(lambda: defaultdict(int))
    for (target, _, copies), ballot in ballots.items():
        for place, (_, who) in enumerate(sorted(ballot)):
            points[target][who] += (len(ballot) - place) * copies
    ranked = lambda rows: {(r.target_id, r.reviewer_id): (r.score, r.rank) for r in rows.collect()}
    expected = {(t, r): (s, k) for t, found in points.items() for k, (r, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0])), 1)}
    assert expected and ranked(rank_nb(model, targets, history)) == expected
    demoted = ranked(demote_inactive(spark.createDataFrame([(*key, float(s), k) for key, (s, k) in expected.items()], path_blocks.RANKING), history))
    assert ranked(rank_nb(model, targets, history, 12)) == demoted
    assert ranked(rank_nb(model, targets, history, 12, best=2)) == {key: v for key, v in demoted.items() if v[1] <= 2}
    asked = spark.createDataFrame([(t, r) for t in range(90) for r in (1, 99)], "target_id long, reviewer_id long")
    assert ranked(rank_nb(model, targets, history, 12, asked=asked)) == {key: v for key, v in demoted.items() if key[1] == 1}


def test_activity_is_open_at_both_ends(spark):
    history = made(spark, 3, 60)
    pulls = {p.id: p for p in history.pull_requests.collect()}
    done = [(pulls[r.pr_id].project, r.reviewer_id, pulls[r.pr_id].ts) for r in history.reviews.collect()]
    counts = {(p.id, r): sum(q == p.project and who == r and p.ts - 360 * DAY < ts < p.ts for q, who, ts in done) for p in pulls.values() for r in range(6)}
    assert {(r.target_id, r.reviewer_id): r.n_recent for r in reviewed_between(history, 12).collect()} == {k: v for k, v in counts.items() if v}
    ranking = spark.createDataFrame([(p, r, 1.0, 1) for p in pulls for r in range(6)], "target_id long, reviewer_id long, score double, rank int")
    assert {(r.target_id, r.reviewer_id): r.is_active for r in with_activity(ranking, history).collect()} == {k: v > 0 for k, v in counts.items()}


def test_nothing_in_nothing_out(spark):
    history = star.load_history(spark, DATA)
    none = replace(history, pull_requests=history.pull_requests.limit(0), reviews=history.reviews.limit(0), file_paths=history.file_paths.limit(0))
    for variant in VARIANTS:
        assert evaluate(none, variant).count() == 0
    bare = replace(history, file_paths=history.file_paths.limit(0))
    assert rank_paths(path_targets(bare), bare, True).count() == 0
    assert rank_nb(fit_nb(bare, fold_cutoffs(bare)), fold_targets(bare), bare).count() == 0
    assert demote_inactive(rank_paths(path_targets(bare), bare), bare).count() == 0
