"""Ranks reviewers by a naive-Bayes model of who reviews which owner's changes to which files.

Only observed cells are stored, with one default for each reviewer and feature
for all others. Models for several cutoffs are fitted together: a cell is one
row, with its count in each model.

Targets are ranked in blocks that follow each other in time. A block has its
model's reviewers once, the observed cells of the values that its targets have,
and who reviewed when; beliefs and places are arrays inside it, so no row is
made for a target and a reviewer but those asked for. The order by defaults is
sorted once, and a ballot only works out where the few reviewers go who have
seen its owner or path.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.times import months_ms
from quillrank.operators.relational import newest_first, reviewed, sized
from quillrank.schema import History
from quillrank.stored import written

#: Probability that a reviewer's unobserved values share.
EPSILON = 0.01
FOLDS = 10
FEATURES = {"owner": "owner_id", "sub_project": "sub_project", "path": "location"}


#: Targets of a block, places in the orders that are kept for its sub-projects, and reviewers that are put in place at once.
BLOCK, ORDER_CELLS, MOVERS = 1024, 1 << 22, 1 << 20
BLOCKS = ["project", "fold", "part"]
RANKING = "target_id long, reviewer_id long, score double, rank int"


def fold_cutoffs(history: History) -> DataFrame:
    """project, fold, cutoff: models are fitted on what is strictly before the first pull request after the fold.

    A fold has an 11th of the project's pull requests; projects with fewer than 11 have none.
    """
    placed = sized(newest_first(history.pull_requests)).withColumn("fold_size", F.expr("n div 11"))
    starts = placed.where("fold_size > 0 and rk > 0 and rk % fold_size = 0 and rk div fold_size <= 10")
    return starts.select("project", (F.expr("rk div fold_size") - 1).cast("int").alias("fold"), F.col("ts").alias("cutoff"))


def whole_history(history: History) -> DataFrame:
    """One model of everything for each project."""
    return history.pull_requests.select("project").distinct().select("project", F.lit(0).alias("fold"), F.lit(2**63 - 1).alias("cutoff"))


@dataclass(frozen=True)
class Model:
    """prior (reviewer_id, n_reviews, p), universes (size of each feature's universe) and, by feature, counts (value and its number in each model), sums of them and defaults (total, n_values, p)."""

    prior: DataFrame
    universes: DataFrame
    counts: dict[str, DataFrame]
    sums: dict[str, DataFrame]
    defaults: dict[str, DataFrame]

    @property
    def cells(self) -> dict[str, DataFrame]:
        """project, fold, reviewer_id, value, n, p of every observed cell."""
        return {f: _all_cells(self.counts[f], self.sums[f]) for f in self.counts}


def _all_cells(counts: DataFrame, sums: DataFrame) -> DataFrame:
    found = _cells(counts.join(sums, ["project", "reviewer_id"]), F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
    return found.select("project", "fold", "reviewer_id", "value", "n", "p")


def _cells(rows: DataFrame, fold) -> DataFrame:
    """With n and p of the model ``fold``, where the value is observed there."""
    found = rows.withColumn("fold", fold).withColumn("n", F.get("ns", F.col("fold"))).where("n > 0")
    return found.withColumn("p", smoothed(F.col("n"), F.get("totals", F.col("fold")), F.get("n_values", F.col("fold"))))


def _spread(history: History, cutoffs: DataFrame) -> History:
    """The pull requests that any model holds, written once, and what hangs on them. They belong to folds 0 .. n_models - 1, for later folds end earlier."""
    ends = cutoffs.groupBy("project").agg(F.collect_list("cutoff").alias("ends"))  # at most FOLDS for each project
    inside = history.pull_requests.join(ends, "project").withColumn("n_models", F.size(F.filter("ends", lambda c: F.col("ts") < c))).where("n_models > 0").drop("ends")
    return replace(history, pull_requests=written(inside, "modelled"))


def _in_models(count) -> list:
    return F.array(*[count(k) for k in range(FOLDS)])


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    """ns: for each project and keys, how many rows each model holds."""
    return rows.groupBy("project", *keys).agg(_in_models(lambda k: F.count_if(F.col("n_models") > k)).alias("ns"))


def _universes(inside: History, features: Collection[str] = tuple(FEATURES)) -> DataFrame:
    pulls, seen = inside.pull_requests, reviewed(inside)
    of = {f: pulls.join(inside.file_paths, F.col("id") == F.col("pr_id")) if f == "path" else pulls for f in FEATURES if f in features}
    out = _counted(pulls).withColumnRenamed("ns", "n_pull_requests")
    for rows, key, name in ((seen, "reviewer_id", "n_reviewers"), *((rows, FEATURES[f], f"{f}_universe") for f, rows in of.items())):
        # Null is a value like others, so no reviewer can have seen all that there are.
        most = rows.groupBy("project", key).agg(F.max("n_models").alias("n_models"))
        out = out.join(_counted(most).withColumnRenamed("ns", name), "project", "left")
    unknown = lambda name: (F.coalesce(F.get(name, F.col("fold")), F.lit(0)) + 1).alias(name)
    folds = out.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).where("n_reviewers[fold] > 0")
    return folds.select("project", "fold", F.get("n_pull_requests", F.col("fold")).alias("n_pull_requests"), F.get("n_reviewers", F.col("fold")).alias("n_reviewers"), *[unknown(f"{f}_universe") for f in FEATURES if f in features])


def universes(history: History, cutoffs: DataFrame) -> DataFrame:
    """project, fold, n_pull_requests, n_reviewers, and how many owners, paths and sub-projects there are, with one more of each for all unknown ones."""
    return _universes(_spread(history, cutoffs))


def smoothed(n, of, n_values):
    """What an observed value keeps. It gets negative where its share is under EPSILON / n_values."""
    return n / of - EPSILON / n_values


def _prior(seen: DataFrame, sizes: DataFrame) -> DataFrame:
    each = _counted(seen, "reviewer_id").select("project", "reviewer_id", F.posexplode("ns").alias("fold", "n_reviews")).where("n_reviews > 0")
    return each.join(sizes.select("project", "fold", "n_pull_requests"), ["project", "fold"]).select("project", "fold", "reviewer_id", "n_reviews", (F.col("n_reviews") / F.col("n_pull_requests")).alias("p"))


def _observed(inside: History, seen: DataFrame, feature: str) -> tuple[DataFrame, DataFrame]:
    """Counts of a feature's values, and sums of them. All that a reviewer did in a project comes to one task, and a pull request's paths come as a list; so rows are dealt once, and the sums are nearly complete where the counts were written."""
    value = FEATURES[feature]
    if feature == "path":
        paths = inside.file_paths.groupBy(F.col("pr_id").alias("id")).agg(F.collect_list("location").alias("paths"))
        rows = seen.join(paths, "id").select("project", "reviewer_id", "n_models", "paths").repartition("project", "reviewer_id").select("project", "reviewer_id", "n_models", F.explode("paths").alias(value))
    else:
        rows = seen.select("project", "reviewer_id", "n_models", value).repartition("project", "reviewer_id")
    counts = written(_counted(rows, "reviewer_id", value).withColumnRenamed(value, "value"), f"counts-{feature}")
    n = lambda k: F.get("ns", F.lit(k))
    return counts, written(counts.groupBy("project", "reviewer_id").agg(_in_models(lambda k: F.sum(n(k))).alias("totals"), _in_models(lambda k: F.count_if(n(k) > 0)).alias("n_values")), f"sums-{feature}")


def _seen(inside: History) -> DataFrame:
    return reviewed(inside).select("id", "project", "n_models", "reviewer_id", "owner_id", "sub_project")


def priors(history: History, cutoffs: DataFrame) -> DataFrame:
    """The prior of the models alone."""
    inside = _spread(history, cutoffs)
    return _prior(_seen(inside), _universes(inside, ()))


def observed_cells(history: History, cutoffs: DataFrame, feature: str) -> DataFrame:
    """The observed cells of one feature alone."""
    inside = _spread(history, cutoffs)
    return _all_cells(*_observed(inside, _seen(inside), feature))


def fit_nb(history: History, cutoffs: DataFrame, use_sub_project: bool = True, features: Collection[str] = tuple(FEATURES)) -> Model:
    features = [f for f in FEATURES if f in features and (use_sub_project or f != "sub_project")]
    inside = _spread(history, cutoffs)
    sizes = written(_universes(inside, features), "universes")
    seen = written(_seen(inside), "reviewed")
    keys = ["project", "fold", "reviewer_id"]
    prior = written(_prior(seen, sizes), "prior")
    counts, sums, defaults = {}, {}, {}
    for feature in features:
        counts[feature], sums[feature] = _observed(inside, seen, feature)
        universe = sizes.select("project", "fold", F.col(f"{feature}_universe").alias("universe"))
        row = prior.select(*keys).join(sums[feature], ["project", "reviewer_id"], "left").join(universe, ["project", "fold"])
        row = row.withColumns({c: F.coalesce(F.get(of, F.col("fold")), F.lit(0)) for c, of in (("total", "totals"), ("n_values", "n_values"))})
        defaults[feature] = row.select(*keys, "total", "n_values", (F.lit(EPSILON) / (F.col("universe") - F.col("n_values"))).alias("p"))
    return Model(prior, sizes, counts, sums, defaults)


def fold_targets(history: History) -> DataFrame:
    """target_id, project, rk, fold: the pull requests that the models of the folds are tried on."""
    placed = sized(newest_first(history.pull_requests)).withColumn("fold_size", F.expr("n div 11"))
    return placed.where(f"fold_size > 0 and rk < {FOLDS} * fold_size").select(F.col("id").alias("target_id"), "project", "rk", F.expr("rk div fold_size").cast("int").alias("fold"))


def beliefs(model: Model, targets: DataFrame, history: History) -> DataFrame:
    """target_id, location, n_copies, reviewer_id, belief: in proportion to the probability of each reviewer of the model, for every path of ``targets`` (target_id, project, fold)."""
    pulls = history.pull_requests.select(F.col("id").alias("target_id"), "owner_id", "sub_project")
    paths = history.file_paths.groupBy(F.col("pr_id").alias("target_id"), "location").agg(F.count("*").alias("n_copies"))
    located = targets.select("target_id", "project", "fold").join(pulls, "target_id")

    def times(rows: DataFrame, feature: str) -> DataFrame:
        keys = ["project", "fold", "reviewer_id"]
        # Only cells of values that a target has.
        of = located.join(paths, "target_id") if feature == "path" else located
        wanted = of.select("project", "fold", F.col(FEATURES[feature]).alias("value")).distinct()
        met = wanted.join(model.counts[feature], ["project", "value"]).join(model.sums[feature], ["project", "reviewer_id"])
        cell = _cells(met, F.col("fold")).select(*keys, F.col("value").alias(FEATURES[feature]), F.col("p").alias("p_cell"))
        default = model.defaults[feature].select(*keys, F.col("p").alias("p_default"))
        met = rows.join(default, keys).join(cell, [*keys, FEATURES[feature]], "left")
        return met.withColumn("belief", F.col("belief") * F.coalesce("p_cell", "p_default")).drop("p_cell", "p_default")

    out = located.join(model.prior.select("project", "fold", "reviewer_id", F.col("p").alias("belief")), ["project", "fold"])
    # What doesn't depend on the path is multiplied before a row is made for each path.
    out = times(out, "owner")
    if "sub_project" in model.counts:
        out = times(out, "sub_project")
    return times(out.join(paths, "target_id"), "path").select("target_id", "location", "n_copies", "reviewer_id", "belief")


def _reviewers_of_blocks(model: Model, blocks: DataFrame, history: History, months: int | None) -> DataFrame:
    """BLOCKS and reviewers: for each reviewer of the model, the prior, the defaults and what observed cells are worked out with, when they last reviewed before the block and whether they did so just at its beginning."""
    keys = ["project", "fold", "reviewer_id"]
    base, columns = model.prior.select(*keys, "p"), []
    for feature in model.counts:
        own = {"p": feature, "total": f"{feature}_total", "n_values": f"{feature}_n_values"}
        base = base.join(model.defaults[feature].select(*keys, *[F.col(c).alias(name) for c, name in own.items()]), keys)
        columns += own.values()
    asked = blocks.select(*BLOCKS, "low").join(base, ["project", "fold"])
    never = F.lit(None).cast("long")
    if months is None:
        asked = asked.withColumns({"last": never, "at_low": never})
    else:
        # Questions and reviews stand in one order of time for each reviewer of a project.
        known = asked.columns
        asked = asked.withColumn("done", never).withColumn("ts", F.col("low"))
        done = reviewed(history).select("project", "reviewer_id", "ts").distinct().withColumn("done", F.col("ts"))
        of_one = Window.partitionBy("project", "reviewer_id").orderBy("ts")
        both = asked.unionByName(done, allowMissingColumns=True)
        both = both.withColumns({"last": F.max("done").over(of_one.rangeBetween(Window.unboundedPreceding, -1)), "at_low": F.max("done").over(of_one.rangeBetween(0, 0))})
        asked = both.where("part is not null").select(*known, "last", "at_low")
    return asked.groupBy(*BLOCKS).agg(F.sort_array(F.collect_list(F.struct("reviewer_id", "p", *columns, "last", "at_low"))).alias("reviewers"))


def _cells_of_blocks(model: Model, feature: str, targets: DataFrame) -> DataFrame:
    """BLOCKS, feature, value, reviewer_id, n: who has the values that a block's targets have, and how often in the model."""
    wanted = targets.select(*BLOCKS, F.col(FEATURES[feature]).alias("value")).distinct()
    met = wanted.join(model.counts[feature], ["project", "value"]).withColumn("n", F.get("ns", F.col("fold"))).where("n > 0")
    return met.select(*BLOCKS, F.lit(feature).alias("feature"), F.col("value").cast("string").alias("value"), "reviewer_id", "n")


class _Order:
    """All reviewers by falling belief, equal ones by number, as nothing but defaults has it."""

    def __init__(self, belief: np.ndarray):
        falls, self.n = -belief, len(belief)
        self.first = np.argsort(falls, kind="stable")
        self.place = np.empty(self.n, np.int64)
        self.place[self.first] = np.arange(self.n)
        ordered = falls[self.first]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        self.levels, self.starts = ordered[starts], np.append(starts, self.n)
        self.codes = np.repeat(np.arange(len(starts)), np.diff(self.starts)) * self.n + self.first

    def before(self, falls: np.ndarray, who: np.ndarray) -> np.ndarray:
        """How many of the order come before ``who``, if they stood at ``falls``."""
        level = np.searchsorted(self.levels, falls)
        equal = self.levels[np.minimum(level, len(self.levels) - 1)] == falls
        out = self.starts[level]
        out[equal] = np.searchsorted(self.codes, level[equal] * self.n + who[equal])
        return out


def _moves(order: _Order, ballot: np.ndarray, who: np.ndarray, falls: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, ...]:
    """What movers change in the points that the places of an order give, for ballots in order that are the order but for them.

    Those who stay have the points of their place, plus the number of movers
    that stood before it, less the number that stand before it now: steps, which
    add up over the ballots of a target. Returns where these steps begin and
    what they are worth (two for each mover), and for each mover its place and
    what it gets over one who stays there.
    """
    n, at, to = order.n, order.place[who], order.before(falls, who)
    base, size = ballot * (n + 1), np.arange(len(ballot))
    start = np.searchsorted(ballot, ballot)
    left, came = np.sort(base + at), np.sort(base + to)
    among = np.empty(len(ballot), np.int64)
    among[np.lexsort((who, falls, ballot))] = size
    points = n - (to - (np.searchsorted(left, base + to) - start) + among - start)
    stays = n - at + np.searchsorted(left, base + at) - np.searchsorted(came, base + at, "right")
    return at, to, copies, (points - stays) * copies


class _Cells:
    """By value, the numbers of its reviewers and what is observed."""

    def __init__(self, rows: pa.Table, of: Callable[[np.ndarray], np.ndarray], total: np.ndarray, n_values: np.ndarray):
        coded = rows.column("value").combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        self.at = of(rows.column("reviewer_id").to_numpy()[order])
        self.p = smoothed(rows.column("n").to_numpy()[order], total[self.at], n_values[self.at])
        ends = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        self.parts = {v: slice(ends[k], ends[k + 1]) for k, v in enumerate(coded.dictionary.to_pylist())}

    def of(self, values: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of ``values`` that is observed: its place in the list, a reviewer and what is observed."""
        parts = [self._part(v) for v in values]
        sizes = [x.stop - x.start for x in parts]
        cells = np.concatenate([np.arange(x.start, x.stop) for x in parts] or [np.zeros(0, np.int64)])
        return np.repeat(np.arange(len(parts)), sizes), self.at[cells], self.p[cells]

    def n_of(self, value) -> int:
        part = self._part(value)
        return part.stop - part.start

    def _part(self, value) -> slice:
        return slice(0, 0) if value is None else self.parts.get(str(value), slice(0, 0))


def _rank_block(features: tuple[str, ...], window: int | None, best: int | None):
    """The function that ranks one block: a table of one row, and the observed cells."""

    def rank(block: pa.Table, observed: pa.Table) -> pa.Table:
        one = {c: block.column(c).combine_chunks() for c in block.column_names}
        people = one["reviewers"].flatten()
        # Reviewers go by their place among all ids.
        reviewers, n = people.field("reviewer_id").to_numpy(), len(people)

        def of(ids: np.ndarray) -> np.ndarray:
            """Numbers of those among ``ids`` that the model knows."""
            at = np.minimum(np.searchsorted(reviewers, ids), n - 1)
            return at[reviewers[at] == ids]

        prior = people.field("p").to_numpy()
        default = {f: people.field(f).to_numpy() for f in features}
        cells = {f: _Cells(observed.filter(pc.equal(observed.column("feature"), f)), of, people.field(f"{f}_total").to_numpy(), people.field(f"{f}_n_values").to_numpy()) for f in features}
        long_ago = np.iinfo(np.int64).min // 2
        last, low = people.field("last").fill_null(long_ago).to_numpy().copy(), one["low"][0].as_py()
        at_low = people.field("at_low").is_valid().to_numpy(zero_copy_only=False)
        done = one["events"].flatten()
        times, who = done.field("ts").to_numpy(), done.field("reviewer_id").to_numpy()
        known = np.isin(who, reviewers)  # reviews that the model doesn't know of are nobody's here
        times, who = times[known], of(who[known])
        orders: dict = {}

        def order_of(sub) -> tuple[_Order, np.ndarray | None]:
            """The order of a sub-project, for so many reviewers know one that each has its own, and what is likely there."""
            if sub not in orders:
                if len(orders) >= max(1, ORDER_CELLS // n):
                    orders.clear()
                usual, likely = prior * default["owner"], None
                if "sub_project" in features:
                    _, at, p = cells["sub_project"].of([sub])
                    likely = default["sub_project"].copy()
                    likely[at] = p
                    usual = usual * likely
                orders[sub] = _Order(usual * default["path"]), likely
            return orders[sub]

        def scores(targets: list[dict]) -> Iterator[np.ndarray]:
            """Points of all reviewers, for each of ``targets`` of one sub-project."""
            order, likely = order_of(targets[0]["sub_project"] if "sub_project" in features else None)
            of_target = np.repeat(np.arange(len(targets)), [len(t["paths"]) for t in targets])
            copies = np.array([q["n_copies"] for t in targets for q in t["paths"]], np.int64)
            owned, of_owner, p_owner = cells["owner"].of([targets[k]["owner_id"] for k in of_target])
            held, on_path, p_path = cells["path"].of([q["location"] for t in targets for q in t["paths"]])
            movers = np.unique(np.concatenate([owned * n + of_owner, held * n + on_path]))
            ballot, who = movers // n, movers % n
            owner, path = default["owner"][who], default["path"][who]
            owner[np.searchsorted(movers, owned * n + of_owner)] = p_owner
            path[np.searchsorted(movers, held * n + on_path)] = p_path
            belief = prior[who] * owner if likely is None else prior[who] * owner * likely[who]
            at, to, each, own = _moves(order, ballot, who, -(belief * path), copies[ballot])
            ends = np.searchsorted(of_target[ballot], np.arange(len(targets) + 1))
            falling, total = np.arange(n, 0, -1), np.bincount(of_target, copies, len(targets))
            for k in range(len(targets)):
                part = slice(ends[k], ends[k + 1])
                steps = np.bincount(at[part] + 1, each[part], n + 1)[:n] - np.bincount(to[part], each[part], n + 1)[:n]
                score = total[k] * falling + np.cumsum(steps) + np.bincount(at[part], own[part], n)
                yield score[order.place].astype(np.int64)

        def scored(targets: list[dict]) -> Iterator[tuple[dict, np.ndarray]]:
            """Targets in order with their points; those that follow each other are worked on together as far as their movers allow."""
            low, size = 0, 0
            for k, t in enumerate([*targets, None]):
                more = 0 if t is None else n + sum(cells["owner"].n_of(t["owner_id"]) + cells["path"].n_of(q["location"]) for q in t["paths"])
                if t is None or size and size + more > MOVERS:
                    some: dict = {}
                    for x in targets[low:k]:
                        some.setdefault(x["sub_project"] if "sub_project" in features else None, []).append(x)
                    found = {name: scores(own) for name, own in some.items()}
                    yield from ((x, next(found[x["sub_project"] if "sub_project" in features else None])) for x in targets[low:k])
                    low, size = k, 0
                size += more

        seen, out = 0, []
        for target, score in scored(sorted(one["targets"].flatten().to_pylist(), key=lambda t: t["ts"])):
            ts = target["ts"]
            key = score
            if window is not None:
                if ts > low:
                    last[at_low] = np.maximum(last[at_low], low)
                    end = int(np.searchsorted(times, ts, "left"))
                    last[who[seen:end]] = times[seen:end]  # in order of time, so the latest stays
                    seen = end
                key = score + (last > ts - window) * (int(score.max()) + 1)
            if target["asked"] is None:
                shown = np.argsort(-key, kind="stable")[:best]
                ranks = np.arange(1, len(shown) + 1)
            else:
                shown = of(np.array(target["asked"], np.int64))
                ranks = np.array([1 + np.count_nonzero(key > key[k]) + np.count_nonzero(key[:k] == key[k]) for k in shown], np.int64)
            out.append((np.full(len(shown), target["target_id"]), reviewers[shown], score[shown].astype(float), ranks.astype(np.int32)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table(dict(zip(("target_id", "reviewer_id", "score", "rank"), columns, strict=True)))

    return rank


def _blocks(model: Model, targets: DataFrame, history: History, months: int | None, asked: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """A row for each block, with low (its first time), targets, reviewers and events; and the observed cells."""
    placed = newest_first(history.pull_requests).withColumn("part", F.expr(f"rk div {BLOCK}"))
    paths = history.file_paths.groupBy(F.col("pr_id").alias("target_id"), "location").agg(F.count("*").alias("n_copies"))
    rows = targets.select("target_id", "project", "fold").join(placed.select(F.col("id").alias("target_id"), "part", "ts", "owner_id", "sub_project"), "target_id")
    rows = rows.join(model.prior.select("project", "fold").distinct(), ["project", "fold"], "left_semi")
    rows = written(rows.join(paths.groupBy("target_id").agg(F.collect_list(F.struct("location", "n_copies")).alias("paths")), "target_id"), "nb-targets")
    if asked is None:
        wanted = rows.withColumn("asked", F.lit(None).cast("array<long>"))
    else:
        wanted = rows.join(asked.groupBy("target_id").agg(F.collect_set("reviewer_id").alias("asked")), "target_id", "left").withColumn("asked", F.coalesce("asked", F.array().cast("array<long>")))
    blocks = wanted.groupBy(*BLOCKS).agg(F.min("ts").alias("low"), F.collect_list(F.struct("ts", "target_id", "owner_id", "sub_project", "paths", "asked")).alias("targets"))
    low = rows.groupBy(*BLOCKS).agg(F.min("ts").alias("low"))
    whole = blocks.join(_reviewers_of_blocks(model, low, history, months), BLOCKS)
    if months is None:
        whole = whole.withColumn("events", F.array().cast("array<struct<ts:bigint,reviewer_id:bigint>>"))
    else:
        done = placed.select("id", "project", "part", "ts").join(history.reviews, F.col("id") == F.col("pr_id"))
        done = done.join(low.select("project", "part").distinct(), ["project", "part"], "left_semi")
        whole = whole.join(done.groupBy("project", "part").agg(F.sort_array(F.collect_list(F.struct("ts", "reviewer_id"))).alias("events")), ["project", "part"], "left")
    values = {f: rows.select(*BLOCKS, F.explode("paths.location").alias("location")) if f == "path" else rows for f in model.counts}
    return whole, reduce(DataFrame.unionByName, [_cells_of_blocks(model, f, v) for f, v in values.items()])


def rank_nb(model: Model, targets: DataFrame, history: History, months: int | None = None, best: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """target_id, reviewer_id, score, rank for ``targets`` (target_id, project, fold): all reviewers of the model, by points R, R - 1, ... 1 for each path of a target, copies too. Targets without paths are not ranked.

    With ``months``, reviewers who weren't active in so many before the target
    come last. Only the first ``best`` are returned if given, or only those that
    ``asked`` (target_id, reviewer_id) has.
    """
    rank = _rank_block(tuple(model.counts), None if months is None else months_ms(months), best)
    blocks, cells = _blocks(model, targets, history, months, asked)
    cells = cells.toDF(*cells.columns)  # columns of their own, for both sides come from the same targets
    return blocks.groupBy(*BLOCKS).cogroup(cells.groupBy(*BLOCKS)).applyInArrow(rank, RANKING)
