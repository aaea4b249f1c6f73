"""Histories of files, from tables taken from a repository's log.

commit_file (sub_project, log_seq, commit_id, path, change_id) has a row for
each file of each commit, log_seq 0 the newest. rename (sub_project, commit_id,
walk_order, change_type, old_path, new_path) has what a walk back from a commit
meets. file_content (sub_project, commit_id, path, content) has files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A line of a commit message that is a footer.
FOOTER = r"^[A-Za-z0-9-]+:"


def footers(message: Column) -> Column:
    """key and value of the footer lines of a commit message, in order: lines with a key in its last paragraph, unless that is its first."""
    text = F.regexp_replace(message, r"\n+$", "")
    last = F.regexp_extract(text, r"(?s)\n\n(?:.*\n\n)?(.*)$", 1)
    lines = F.filter(F.split(last, "\n"), lambda line: line.rlike(FOOTER))
    part = lambda line, pattern: F.regexp_extract(line, pattern, 1)
    return F.transform(lines, lambda line: F.struct(part(line, "^([^:]*):").alias("key"), part(line, "^[^:]*: *(.*)$").alias("value")))


def change_id(message: Column) -> Column:
    """The value of the first footer, whatever its key; empty without footers."""
    return F.coalesce(F.get(footers(message), F.lit(0))["value"], F.lit(""))


def _sequenced(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("sub_project", "root_path").orderBy("hop", "log_seq")
    return rows.select("sub_project", "root_path", (F.row_number().over(order) - 1).cast("int").alias("commit_seq"), "commit_id", "path", "change_id")


def history(commit_file: DataFrame, paths: DataFrame) -> DataFrame:
    """file_commit rows for paths (sub_project, root_path), newest first, without renames."""
    found = commit_file.join(paths.select("sub_project", F.col("root_path").alias("path"), "root_path").distinct(), ["sub_project", "path"])
    return _sequenced(found.withColumn("hop", F.lit(0)))


def renamed_from(rename: DataFrame, starts: DataFrame) -> DataFrame:
    """sub_project, root_path, old_path: the first rename or copy on the walk from a commit to a path that holds the given one.

    ``starts`` has sub_project, root_path, commit_id.
    """
    r, s = rename.where("change_type in ('RENAME', 'COPY')").alias("r"), starts.alias("s")
    met = s.join(r, (F.col("s.sub_project") == F.col("r.sub_project")) & (F.col("s.commit_id") == F.col("r.commit_id")) & F.col("r.new_path").contains(F.col("s.root_path")))
    return met.groupBy("s.sub_project", "s.root_path").agg(F.min_by("r.old_path", "r.walk_order").alias("old_path"))


def history_with_renames(commit_file: DataFrame, rename: DataFrame, paths: DataFrame) -> DataFrame:
    """As ``history``, followed by the history of the path that the file had before; renames before that one are not followed.

    The walk starts at the oldest commit under the newer path.
    """
    wanted = paths.select("sub_project", "root_path").distinct()
    own = commit_file.join(wanted.withColumn("path", F.col("root_path")), ["sub_project", "path"]).withColumn("hop", F.lit(0))
    starts = own.groupBy("sub_project", "root_path").agg(F.max_by("commit_id", "log_seq").alias("commit_id"))
    old = renamed_from(rename, starts)
    before = commit_file.join(old.withColumnRenamed("old_path", "path"), ["sub_project", "path"]).withColumn("hop", F.lit(1))
    columns = ["sub_project", "root_path", "hop", "log_seq", "commit_id", "path", "change_id"]
    return _sequenced(own.select(*columns).union(before.select(*columns)))


def nearest_code_lines(file_content: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (sub_project, commit_id, path, line_no) with nearest_line: the nearest other line of code, the one before it first.

    A line of code has more than one character, or one that is no white space;
    for one character, the line before decides for the line after too. Where
    a look-up leaves the file, or there is no file, it is the line before; where
    a file of one line has no other, the line itself.
    """
    rows = wanted.join(file_content, ["sub_project", "commit_id", "path"], "left").withColumn("lines", F.split(F.regexp_replace("content", "\\n+$", ""), "\n"))
    code = "(length(get(lines, {0})) > 1 or (length(get(lines, {1})) = 1 and not get(lines, {1}) rlike '^\\\\s$'))"
    up, down = "line_no - 1 - x", "line_no - 1 + x"
    # Of each distance: the first of both sides that holds, or that the look-up fails.
    seen = f"""transform(sequence(1, greatest(size(lines) - 1, 1)), x -> CASE
        WHEN x >= size(lines) THEN line_no
        WHEN {up} < 0 OR {up} >= size(lines) THEN line_no - 1
        WHEN {code.format(up, up)} THEN line_no - x
        WHEN {down} >= size(lines) THEN line_no - 1
        WHEN {code.format(down, up)} THEN line_no + x END)"""
    found = F.get(F.filter(F.expr(seen), lambda n: n.isNotNull()), F.lit(0))
    near = F.when(F.col("content").isNull(), F.col("line_no") - 1).otherwise(F.coalesce(found, F.col("line_no")))
    return rows.select("sub_project", "commit_id", "path", "line_no", near.cast("int").alias("nearest_line"))
