"""The path ranker for very many targets: a sweep over time in blocks, with running sums in place of pairs of pull requests.

What a reviewer has done is the sum, over what they reviewed, of each path's
share of its pull request. A target's score with a reviewer is then the sum of
those shares times how alike the paths are to the target's, so an older pull
request is met once, when the sum of its block is made, and not by every newer
one. Blocks of pull requests that follow each other in a project get the sums
up to their beginning; what happens inside is added up on the way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.functions.paths import TECHNIQUES, components
from quillrank.functions.times import months_ms
from quillrank.operators.borda import DIGITS
from quillrank.operators.rank_paths import located
from quillrank.operators.relational import newest_first, reviewed
from quillrank.schema import History
from quillrank.stored import written

#: Pull requests of a block, and cells of a matrix that is worked on at once.
BLOCK, CELLS = 256, 1 << 21
BLOCKS = ["project", "part"]
RANKING = "target_id long, reviewer_id long, score double, rank int"


def alike(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity in each technique of every path in ``a`` with every one in ``b``: components as numbers, padded with -1 and with -2."""
    x, y = len(a), len(b)
    longest = np.maximum(n_a[:, None], n_b[None, :])
    same = [[a[:, i, None] == b[None, :, j] for j in range(b.shape[1])] for i in range(a.shape[1])]
    prefix, suffix, substring = (np.zeros((x, y), np.int16) for _ in range(3))
    going = np.ones((x, y), bool)
    for i in range(min(a.shape[1], b.shape[1])):
        going = going & same[i][i]
        prefix += going
    going = np.ones((x, y), bool)
    for k in range(min(a.shape[1], b.shape[1])):
        own, other = n_a - 1 - k, n_b - 1 - k
        left = np.where(own >= 0, a[np.arange(x), np.maximum(own, 0)], -1)
        right = np.where(other >= 0, b[np.arange(y), np.maximum(other, 0)], -2)
        going = going & (left[:, None] == right[None, :])
        suffix += going
    runs, rows = [np.zeros((x, y), np.int16)] * (b.shape[1] + 1), [np.zeros((x, y), np.int16)] * (b.shape[1] + 1)
    for line in same:
        new_runs, new_rows = [runs[0]], [rows[0]]
        for j, equal in enumerate(line):
            new_runs.append((runs[j] + 1) * equal)
            substring = np.maximum(substring, new_runs[-1])
            new_rows.append(np.maximum(np.maximum(rows[j + 1], new_rows[j]), rows[j] + equal))
        runs, rows = new_runs, new_rows
    common = {"prefix": prefix, "suffix": suffix, "substring": substring, "subsequence": rows[-1]}
    return np.stack([common[t] / np.maximum(longest, 1) for t in TECHNIQUES])


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """values[..., ends[i]:ends[i + 1]] added up, 0 where there are none."""
    out = np.zeros((*values.shape[:-1], len(ends) - 1))
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        out[..., full] = np.add.reduceat(values, ends[:-1][full], axis=-1)
    return out


def _rank_block(window: int | None, best: int | None):
    """The function that ranks the targets of one block, a table of one row."""

    def rank(block: pa.Table) -> pa.Table:
        one = {c: block.column(c).combine_chunks() for c in block.column_names}
        people = one["people"].flatten()
        reviewers = people.field("reviewer_id").to_numpy()
        n = len(reviewers)
        # In the order of time, the oldest first.
        pulls = sorted(one["pulls"].flatten().to_pylist(), key=lambda p: -p["rk"])
        known = one["known"].flatten()
        path_ids = known.field("path").to_numpy()
        lists = known.field("parts")
        lengths = np.diff(lists.offsets.to_numpy())
        codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        parts = np.full((len(path_ids), max(1, int(lengths.max(initial=0)))), -2, np.int32)
        parts[np.repeat(np.arange(len(path_ids)), lengths), place] = codes
        at_path = {p: k for k, p in enumerate(path_ids.tolist())}

        # Shares before the block, by reviewer, and those of its pull requests.
        cells = one["cells"].flatten()
        who = np.searchsorted(reviewers, cells.field("reviewer_id").to_numpy())
        by_who = np.argsort(who, kind="stable")
        cell_ends = np.searchsorted(who[by_who], np.arange(n + 1))
        order = np.argsort(path_ids, kind="stable")
        cell_path = order[np.searchsorted(path_ids[order], cells.field("path").to_numpy()[by_who])]
        cell_share = cells.field("share").to_numpy()[by_who]
        own = [[(at_path[q["path"]], q["n_copies"]) for q in p["paths"]] for p in pulls]
        sizes = np.array([sum(c for _, c in o) for o in own], float)
        pull_ends = np.cumsum([0, *map(len, own)])
        pull_path = np.array([k for o in own for k, _ in o], np.int64)
        pull_share = np.array([c for o in own for _, c in o], float) / np.repeat(np.maximum(sizes, 1), np.diff(pull_ends))
        did = np.zeros((len(pulls), n))
        for i, p in enumerate(pulls):
            did[i, np.searchsorted(reviewers, np.array(p["reviewers"], np.int64))] = 1

        is_target = [p["is_target"] for p in pulls]
        wanted = np.unique([k for o, t in zip(own, is_target, strict=True) if t for k, _ in o]).astype(np.int64)
        before, inside = np.zeros((4, len(wanted), n)), np.zeros((4, len(wanted), len(pulls)))
        step = max(1, CELLS // max(len(path_ids), len(cell_path), 1))
        for low in range(0, len(wanted), step):
            some = wanted[low : low + step]
            mine = np.where(parts[some] == -2, -1, parts[some])
            likes = alike(mine, lengths[some], parts, lengths)
            for t in range(4):
                before[t, low : low + step] = _sums(likes[t][:, cell_path] * cell_share, cell_ends)
                inside[t, low : low + step] = _sums(likes[t][:, pull_path] * pull_share, pull_ends)

        long_ago = np.iinfo(np.int64).min // 2
        last = people.field("last").fill_null(long_ago).to_numpy().copy()
        at_low, low = people.field("at_low").is_valid().to_numpy(zero_copy_only=False), one["low"][0].as_py()
        out, seen = [], 0
        for i, pull in enumerate(pulls):
            if not is_target[i] or not own[i]:
                continue
            places, copies = np.searchsorted(wanted, [k for k, _ in own[i]]), np.array([c for _, c in own[i]], float)
            score = np.einsum("f,tfr->tr", copies, before[:, places])
            if i:
                score += np.einsum("f,tfh->th", copies, inside[:, places, :i]) @ did[:i]
            score = np.round(score / sizes[i], DIGITS)
            points = np.zeros(n, np.int64)
            for t in range(4):
                positive = np.flatnonzero(score[t] > 0)
                ballot = positive[np.argsort(-score[t][positive], kind="stable")]
                points[ballot] += np.arange(len(ballot), 0, -1)
            key = points
            if window is not None:
                ts = pull["ts"]
                while seen < len(pulls) and pulls[seen]["ts"] < ts:
                    mine = did[seen] > 0
                    last[mine] = np.maximum(last[mine], pulls[seen]["ts"])
                    seen += 1
                recent = np.maximum(last, low) if ts > low else last
                active = np.where(at_low, recent, last) > ts - window
                key = points + active * (int(points.max(initial=0)) + 1)
            ranked = np.flatnonzero(points > 0)
            ranked = ranked[np.argsort(-key[ranked], kind="stable")]
            ranks = np.arange(1, len(ranked) + 1, dtype=np.int32)
            if pull["asked"] is not None:
                shown = np.isin(reviewers[ranked], np.array(pull["asked"], np.int64))
                ranked, ranks = ranked[shown], ranks[shown]
            out.append((np.full(len(ranked[:best]), pull["id"]), reviewers[ranked[:best]], points[ranked[:best]].astype(float), ranks[:best]))
        kinds = (np.int64, np.int64, float, np.int32)
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, k) for k in kinds]
        return pa.table(dict(zip(("target_id", "reviewer_id", "score", "rank"), columns, strict=True)))

    return rank


def _shares_before(shares: DataFrame) -> DataFrame:
    """project, part, reviewer_id, path, share: what older blocks add up to, for ``shares`` of blocks; a sum stands in every block up to the next one that adds to it."""
    oldest_first = Window.partitionBy("project", "reviewer_id", "path").orderBy(F.col("part").desc())
    summed = shares.withColumn("total", F.sum("share").over(oldest_first)).withColumn("next", F.coalesce(F.lead("part").over(oldest_first), F.lit(0)))
    return summed.where("part > 0").withColumn("in_part", F.explode(F.sequence(F.col("next"), F.col("part") - 1))).select("project", F.col("in_part").alias("part"), "reviewer_id", "path", F.col("total").alias("share"))


def _people(blocks: DataFrame, history: History, months: int | None) -> DataFrame:
    """BLOCKS and people: for each reviewer of the project, when they last reviewed before the block and whether they did so just at its beginning."""
    done = reviewed(history).select("project", "reviewer_id", "ts").distinct()
    asked = blocks.join(done.select("project", "reviewer_id").distinct(), "project")
    never = F.lit(None).cast("long")
    if months is None:
        asked = asked.withColumns({"last": never, "at_low": never})
    else:
        of_one = Window.partitionBy("project", "reviewer_id").orderBy("ts")
        both = asked.withColumn("done", never).withColumn("ts", F.col("low")).unionByName(done.withColumn("done", F.col("ts")), allowMissingColumns=True)
        asked = both.withColumns({"last": F.max("done").over(of_one.rangeBetween(Window.unboundedPreceding, -1)), "at_low": F.max("done").over(of_one.rangeBetween(0, 0))}).where("part is not null")
    return asked.groupBy(*BLOCKS).agg(F.sort_array(F.collect_list(F.struct("reviewer_id", "last", "at_low"))).alias("people"))


def rank_paths_in_blocks(targets: DataFrame, history: History, use_sub_project: bool = False, months: int | None = None, best: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """target_id, reviewer_id, score, rank, as ``rank_paths`` has them, for ``targets`` (target_id) among the history's pull requests.

    With ``months``, reviewers who weren't active in so many before the target
    come last. Only the first ``best`` are returned if given, or only those that
    ``asked`` (target_id, reviewer_id) has.
    """
    full = components(F.col("location"))
    paths = located(history, use_sub_project).withColumn("parts", F.when(F.col("sub").isNull(), full).otherwise(F.concat(F.array("sub"), full))).withColumn("path", F.xxhash64("parts"))
    paths = written(paths.groupBy("pr_id", "path").agg(F.first("parts").alias("parts"), F.sum("n_copies").alias("n_copies")), "path-parts")
    placed = newest_first(history.pull_requests).select(F.col("id").alias("pr_id"), "project", "ts", "rk", F.expr(f"rk div {BLOCK}").alias("part"))
    sizes = paths.groupBy("pr_id").agg(F.sum("n_copies").alias("n_paths"))
    placed_paths = placed.join(paths, "pr_id")
    shares = placed_paths.join(sizes, "pr_id").join(history.reviews, "pr_id").groupBy("project", "part", "reviewer_id", "path").agg(F.sum(F.col("n_copies") / F.col("n_paths")).alias("share"))
    before = written(_shares_before(shares), "shares-before")

    of_pull = paths.groupBy("pr_id").agg(F.collect_list(F.struct("path", "n_copies")).alias("paths"))
    people = history.reviews.groupBy("pr_id").agg(F.collect_list("reviewer_id").alias("reviewers"))
    chosen = targets.select(F.col("target_id").alias("pr_id"), F.lit(True).alias("is_target"))
    rows = placed.join(of_pull, "pr_id", "left").join(people, "pr_id", "left").join(chosen, "pr_id", "left")
    if asked is None:
        rows = rows.withColumn("asked", F.lit(None).cast("array<long>"))
    else:
        rows = rows.join(asked.groupBy(F.col("target_id").alias("pr_id")).agg(F.collect_set("reviewer_id").alias("asked")), "pr_id", "left").withColumn("asked", F.coalesce("asked", F.array().cast("array<long>")))
    empty = lambda c: F.coalesce(c, F.array()).alias(c)
    pulls = rows.select(*BLOCKS, F.struct(F.col("pr_id").alias("id"), "ts", "rk", F.coalesce("is_target", F.lit(False)).alias("is_target"), empty("paths"), empty("reviewers"), "asked").alias("p"))
    blocks = pulls.groupBy(*BLOCKS).agg(F.min("p.ts").alias("low"), F.collect_list("p").alias("pulls"))
    met = placed_paths.select(*BLOCKS, "path").union(before.select(*BLOCKS, "path")).distinct()
    known = met.join(paths.groupBy("path").agg(F.first("parts").alias("parts")), "path").groupBy(*BLOCKS).agg(F.collect_list(F.struct("path", "parts")).alias("known"))
    cells = before.groupBy(*BLOCKS).agg(F.collect_list(F.struct("reviewer_id", "path", "share")).alias("cells"))
    low = placed.groupBy(*BLOCKS).agg(F.min("ts").alias("low"))
    whole = blocks.join(known, BLOCKS).join(_people(low, history, months), BLOCKS).join(cells, BLOCKS, "left")
    return whole.groupBy(*BLOCKS).applyInArrow(_rank_block(None if months is None else months_ms(months), best), RANKING)
