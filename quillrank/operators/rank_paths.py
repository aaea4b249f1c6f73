"""Ranks reviewers by how alike the paths are that they have reviewed.

A target's score with an older pull request is the mean similarity of all pairs
of their paths, in four ways; it goes to each reviewer of the older one, and
four Borda counts are added up. Paths that share no component have similarity 0
in all four, so only pairs that share one are looked at, each pair once.

With sub-projects, every path begins with the name of its pull request's one,
so all paths of one sub-project share a component. Such pairs are not made:
what two prefixed paths have in common follows from what the bare ones have,
and pairs that share nothing but the sub-project count by their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.paths import COMMON, TECHNIQUES, components, without_slashes
from quillrank.operators.borda import points, ranked, total
from quillrank.operators.relational import newest_first
from quillrank.schema import History
from quillrank.stored import written

#: Paths are dealt so many ways on one side of the join that finds pairs, so that a common component is not one task.
SALTS = 16
#: How an older pull request's sub-project stands to the target's: there is none, another one, or the same.
CASES = ("none", "other", "same")


def located(history: History, use_sub_project: bool) -> DataFrame:
    """pr_id, sub (the sub-project's component, null without one), location (below it) and n_copies."""
    if not use_sub_project:
        return history.file_paths.groupBy("pr_id", F.lit(None).cast("string").alias("sub"), "location").agg(F.count("*").alias("n_copies"))
    name = without_slashes(F.col("sub_project"))
    subs = history.pull_requests.select(F.col("id").alias("pr_id"), F.when(name != "", name).alias("sub"), (F.length("sub_project") > 0).alias("is_named"))
    # An empty path below a sub-project adds no component, as a slash alone; a name of slashes only is part of the path.
    below = F.when(F.col("sub").isNotNull() & (F.col("location") == ""), F.lit("/")).when(F.col("sub").isNull() & F.col("is_named"), F.concat(F.lit("/"), F.col("location"))).otherwise(F.col("location"))
    return history.file_paths.join(subs, "pr_id").groupBy("pr_id", "sub", below.alias("location")).agg(F.count("*").alias("n_copies"))


def newest_targets(history: History) -> DataFrame:
    """The newest pull request of each project, with its place."""
    return newest_first(history.pull_requests).where("rk = 0").select(F.col("id").alias("target_id"), "project", "rk")


def common_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """f, g, n_f, n_g (numbers of components) and what they have in common in each technique, for the distinct locations of (project, location) rows that share a project and a component.

    A pair meets at every project and component that both have, and counts at
    the first of them only.
    """

    def side(rows: DataFrame, name: str, parts: str, projects: str) -> DataFrame:
        return rows.groupBy(F.col("location").alias(name)).agg(F.sort_array(F.collect_set("project")).alias(projects)).withColumn(parts, components(F.col(name)))

    def dealt(rows: DataFrame, projects: str, parts: str, salt: Column) -> DataFrame:
        spread = rows.withColumn("project", F.explode(projects)).withColumn("part", F.explode(F.array_distinct(parts))).withColumn("salt", salt)
        # Pairs are few bytes but much work each, so the number of partitions is set and not left to be coalesced by size.
        return spread.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "project", "part", "salt")

    f = dealt(side(left, "f", "a", "in_f"), "in_f", "a", F.pmod(F.xxhash64("f"), F.lit(SALTS)).cast("int"))
    g = dealt(side(right, "g", "b", "in_g"), "in_g", "b", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = f.join(g, ["project", "part", "salt"]).where((F.array_intersect("in_f", "in_g")[0] == F.col("project")) & (F.array_intersect("a", "b")[0] == F.col("part")))
    return met.select("f", "g", F.size("a").alias("n_f"), F.size("b").alias("n_g"), *[COMMON[t](F.col("a"), F.col("b")).alias(t) for t in TECHNIQUES])


def path_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """f, g and their similarity in each technique, for distinct locations that share a component."""
    pairs = common_pairs(left.withColumn("project", F.lit("")), right.withColumn("project", F.lit("")))
    return pairs.select("f", "g", *[(F.col(t) / F.greatest("n_f", "n_g")).alias(t) for t in TECHNIQUES])


def _below(case: str, technique: str, less: int = 0) -> Column:
    """The similarity of two paths below their sub-projects, from n_f, n_g and what the bare paths have in common; ``sub`` is the first one's.

    Right where neither sub-project is a component of the other path. ``less``
    is taken off what they have in common.
    """
    common, prefixed = F.col(technique), F.col("sub").isNotNull()
    if case == "same":
        if technique == "suffix":
            common = common + F.when((F.col("prefix") == F.col("n_f")) & (F.col("n_f") == F.col("n_g")), 1).otherwise(0)
        elif technique == "substring":
            common = F.greatest(common, F.col("prefix") + 1)
        else:
            common = common + 1
    elif technique == "prefix":
        common = F.lit(0) if case == "other" else F.when(prefixed, 0).otherwise(common)
    longer = F.greatest(F.col("n_f") + prefixed.cast("int"), F.col("n_g") + (0 if case == "none" else 1))
    return (common - less) / longer


def _base(technique: str) -> int:
    """What paths of one sub-project have in common by its name alone."""
    return 0 if technique == "suffix" else 1


def _collisions(own: DataFrame, older: DataFrame) -> DataFrame:
    """target_id, pr_id and, by technique, what ``_below`` lacks over pairs of paths one of which has the other's sub-project as a component."""
    f = own.select("project", "sub", F.col("location").alias("f")).distinct().withColumn("a", components(F.col("f")))
    g = older.select("project", F.col("sub").alias("sub_g"), F.col("location").alias("g")).distinct().withColumn("b", components(F.col("g")))
    columns = ["project", "sub", "f", "a", "sub_g", "g", "b"]
    by_f = f.where("sub is not null").join(g.withColumn("part", F.explode(F.array_distinct("b"))).withColumnRenamed("project", "of"), (F.col("project") == F.col("of")) & (F.col("sub") == F.col("part"))).select(*columns)
    by_g = g.where("sub_g is not null").withColumnRenamed("project", "of").join(f.withColumn("part", F.explode(F.array_distinct("a"))), (F.col("project") == F.col("of")) & (F.col("sub_g") == F.col("part"))).select(*columns)
    met = by_f.union(by_g).distinct().withColumns({"n_f": F.size("a"), "n_g": F.size("b"), **{t: COMMON[t](F.col("a"), F.col("b")) for t in TECHNIQUES}})
    full = lambda sub, parts: F.when(F.col(sub).isNull(), F.col(parts)).otherwise(F.concat(F.array(F.col(sub)), F.col(parts)))
    whole = met.withColumns({"full_f": full("sub", "a"), "full_g": full("sub_g", "b")})

    def lacking(t: str) -> Column:
        case = F.when(F.col("sub_g").isNull(), _below("none", t)).when(F.col("sub").eqNullSafe(F.col("sub_g")), _below("same", t)).otherwise(_below("other", t))
        return F.coalesce(COMMON[t](F.col("full_f"), F.col("full_g")) / F.greatest(F.size("full_f"), F.size("full_g")) - case, F.lit(0.0))

    differs = whole.select("project", "sub", "f", "sub_g", "g", *[lacking(t).alias(t) for t in TECHNIQUES]).where(" or ".join(f"{t} <> 0" for t in TECHNIQUES))
    x, d, h = own.alias("x"), differs.alias("d"), older.alias("h")
    at_f = x.join(d, (F.col("x.project") == F.col("d.project")) & (F.col("x.location") == F.col("d.f")) & F.col("x.sub").eqNullSafe(F.col("d.sub")))
    at_g = at_f.join(h, (F.col("x.project") == F.col("h.project")) & (F.col("d.g") == F.col("h.location")) & F.col("d.sub_g").eqNullSafe(F.col("h.sub")) & (F.col("h.rk") > F.col("x.rk")))
    return at_g.select("x.target_id", "h.pr_id", *[(F.col(f"d.{t}") * F.col("x.n_copies") * F.col("h.n_copies")).alias(t) for t in TECHNIQUES])


def _same_sub_project(own: DataFrame, older: DataFrame) -> DataFrame:
    """target_id, pr_id and what their paths have in common by the name of their one sub-project, which depends on lengths only."""
    n = F.size(components(F.col("location")))
    x = own.where("sub is not null").groupBy("target_id", "project", "rk", "sub", n.alias("n")).agg(F.sum("n_copies").alias("n_copies")).alias("x")
    h = older.where("sub is not null").groupBy("pr_id", "project", "rk", "sub", n.alias("n")).agg(F.sum("n_copies").alias("n_copies")).alias("h")
    met = x.join(h, (F.col("x.project") == F.col("h.project")) & (F.col("x.sub") == F.col("h.sub")) & (F.col("h.rk") > F.col("x.rk")))
    alike = F.col("x.n_copies") * F.col("h.n_copies") / (F.greatest("x.n", "h.n") + 1)
    # Two paths that are nothing but their sub-project end alike, too.
    bare = ((F.col("x.n") == 0) & (F.col("h.n") == 0)).cast("int")
    return met.select("x.target_id", "h.pr_id", *[(alike * (_base(t) or bare)).alias(t) for t in TECHNIQUES])


def pair_scores(history: History, targets: DataFrame, use_sub_project: bool = False) -> DataFrame:
    """target_id, pr_id and a score for each technique, for ``targets`` (target_id, project, rk) and every older pull request of the project whose paths share a component, the sub-project's too if in use."""
    paths = written(located(history, use_sub_project), "located")
    counts = paths.groupBy("pr_id").agg(F.sum("n_copies").alias("n_paths"))
    own = targets.join(paths.withColumnRenamed("pr_id", "target_id"), "target_id")
    older = newest_first(history.pull_requests).select(F.col("id").alias("pr_id"), "project", "rk").join(paths, "pr_id")
    pairs = written(common_pairs(own, older), "path-pairs")
    # One row for each target and path of the history before pull requests come in.
    cases = CASES if use_sub_project else ("none",)
    met = own.join(pairs, F.col("location") == F.col("f"))
    likes = met.groupBy("target_id", "project", "rk", "sub", "g").agg(*[F.sum(_below(c, t, _base(t) if c == "same" else 0) * F.col("n_copies")).alias(f"{c}_{t}") for c in cases for t in TECHNIQUES])
    x, h = likes.alias("x"), older.alias("h")
    seen = x.join(h, (F.col("x.project") == F.col("h.project")) & (F.col("x.g") == F.col("h.location")) & (F.col("h.rk") > F.col("x.rk")))

    def alike(t: str) -> Column:
        if not use_sub_project:
            return F.col(f"x.none_{t}")
        return F.when(F.col("h.sub").isNull(), F.col(f"x.none_{t}")).when(F.col("h.sub").eqNullSafe(F.col("x.sub")), F.col(f"x.same_{t}")).otherwise(F.col(f"x.other_{t}"))

    rows = seen.select("x.target_id", "h.pr_id", *[(alike(t) * F.col("h.n_copies")).alias(t) for t in TECHNIQUES])
    if use_sub_project:
        rows = rows.union(_same_sub_project(own, older)).union(_collisions(own, older))
    sums = rows.groupBy("target_id", "pr_id").agg(*[F.sum(t).alias(t) for t in TECHNIQUES])
    sized = sums.join(counts, "pr_id").join(counts.select(F.col("pr_id").alias("target_id"), F.col("n_paths").alias("n_own")), "target_id")
    return sized.select("target_id", "pr_id", *[(F.col(t) / (F.col("n_paths") * F.col("n_own"))).alias(t) for t in TECHNIQUES])


def technique_scores(history: History, scores: DataFrame) -> DataFrame:
    """target_id, reviewer_id, technique, score: the sum over what each reviewer has reviewed."""
    sums = scores.join(history.reviews, "pr_id").groupBy("target_id", "reviewer_id").agg(*[F.sum(t).alias(t) for t in TECHNIQUES])
    return sums.unpivot(["target_id", "reviewer_id"], list(TECHNIQUES), "technique", "score").withColumn("score", F.round("score", 9))


def rank_paths(targets: DataFrame, history: History, use_sub_project: bool = False) -> DataFrame:
    """target_id, reviewer_id, score, rank. Reviewers without any similarity are not ranked; owners are not left out."""
    ballots = points(technique_scores(history, pair_scores(history, targets, use_sub_project)), "target_id", "technique")
    return ranked(total(ballots))
