"""File paths as arrays of components, and how alike two of them are. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TECHNIQUES = ("prefix", "suffix", "substring", "subsequence")


def components(path: Column) -> Column:
    """Parts between slashes. Empty parts at the end don't count, those at the start do; only slashes: no parts; empty path: one empty part."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.when(path == "", F.array(F.lit(""))).when(path.rlike("^/+$"), F.array().cast("array<string>")).otherwise(parts)


def without_slashes(text: Column) -> Column:
    return F.replace(text, F.lit("/"), F.lit(""))


def with_sub_project(location: Column, sub_project: Column) -> Column:
    """The path below its sub-project, where there is one."""
    return F.when(F.length(sub_project) > 0, F.concat(without_slashes(sub_project), F.lit("/"), location)).otherwise(location)


def last_segment(url: Column) -> Column:
    """What follows the last slash; with one slash at the end, what stands before it."""
    parts = F.split(url, "/")
    return F.when(F.element_at(parts, -1) != "", F.element_at(parts, -1)).otherwise(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")))


def common_prefix(a: Column, b: Column) -> Column:
    """How many components agree from the start on: the place of the first pair that differs tells."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def common_substring(a: Column, b: Column) -> Column:
    """The longest run of components that both have.

    Folds over ``a``; the state holds for each place in ``b`` how long the run is that ends there.
    """
    nothing = F.struct(F.array_repeat(F.lit(0), F.size(b)).alias("ending"), F.lit(0).alias("best"))

    def step(state: Column, part: Column) -> Column:
        ending = F.transform(b, lambda other, j: F.when(part == other, F.coalesce(F.get(state["ending"], j - 1), F.lit(0)) + 1).otherwise(F.lit(0)))
        return F.struct(ending.alias("ending"), F.greatest(state["best"], F.array_max(ending)).alias("best"))

    return F.when((F.size(a) < 1) | (F.size(b) < 1), F.lit(0)).otherwise(F.aggregate(a, nothing, step, lambda s: s["best"]))


def common_subsequence(a: Column, b: Column) -> Column:
    """The most components that both have in the same order.

    Folds over ``a``; the state holds the answer for what was read of ``a`` and every beginning of ``b``.
    """

    def step(row: Column, part: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            F.array(F.lit(0)),
            lambda new, j: F.concat(new, F.array(F.when(part == F.get(b, j - 1), F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.get(new, j - 1))))),
        )

    last = F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), step, lambda row: F.element_at(row, -1))
    return F.when((F.size(a) < 1) | (F.size(b) < 1), F.lit(0)).otherwise(last)


COMMON = dict(zip(TECHNIQUES, (common_prefix, common_suffix, common_substring, common_subsequence), strict=True))


def similarity(technique: str, a: Column, b: Column) -> Column:
    """Common components over the longer path's number of them; null if neither has any."""
    return F.try_divide(COMMON[technique](a, b).cast("double"), F.greatest(F.size(a), F.size(b)).cast("double"))
