"""Ballots that are the order of defaults but for few reviewers, and models of what a query asks for."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from small_data import DATA

from quillrank.operators import rank_nb
from quillrank.queries import queries


@pytest.mark.parametrize("levels", [3, 1000])
def test_moves_as_sorting_each_ballot(levels):
    """Equal beliefs, of copies of a reviewer, go by number among those who move and those who stay."""
    rng = np.random.default_rng(levels)
    n, n_ballots = 60, 40
    belief = rng.integers(1, levels + 1, n) / levels
    order, copies = rank_nb._Order(belief), rng.integers(1, 4, n_ballots)
    movers = [np.sort(rng.choice(n, rng.integers(0, 12), replace=False)) for _ in range(n_ballots)]
    ballot, who = np.repeat(np.arange(n_ballots), [len(m) for m in movers]), np.concatenate(movers)
    falls = -rng.integers(0, levels + 2, len(who)) / levels
    expected = np.zeros(n, np.int64)
    for k in range(n_ballots):
        own = -belief
        own[who[ballot == k]] = falls[ballot == k]
        expected[np.lexsort((np.arange(n), own))] += np.arange(n, 0, -1) * copies[k]
    at, to, each, own = rank_nb._moves(order, ballot, who, falls, copies[ballot])
    steps = np.cumsum(np.bincount(at + 1, each, n + 1)[:n] - np.bincount(to, each, n + 1)[:n])
    found = copies.sum() * np.arange(n, 0, -1) + steps + np.bincount(at, own, n)
    assert (found[order.place] == expected).all()


@pytest.mark.parametrize(("name", "counted"), [("nb_prior", set()), ("nb_cond_owner", {"owner"}), ("nb_cond_subproject", {"sub_project"}), ("nb_defaults_path", {"path"})])
def test_only_what_is_asked_for_is_counted(name, counted, spark, monkeypatch):
    labels = defaultdict(int)
    write = rank_nb.written

    def noted(df, label):
        labels[label] += 1
        return write(df, label)

    monkeypatch.setattr(rank_nb, "written", noted)
    assert queries()[name](spark, DATA).count() > 0
    assert {x.removeprefix("counts-") for x in labels if x.startswith("counts-")} == counted
