"""More queries of the entry module: the line ranker, histories of files, and captured JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators import rank_lines as L
from quillrank.operators.diff import edits_from_contents
from quillrank.operators.postprocess import top
from quillrank.operators.rank_paths import newest_targets
from quillrank.plans.recommend import recommend, shown
from quillrank.queries import _NEWEST, _RANKED, HISTORY, TOP, _history, _path_ctes, _ranking, _raw
from quillrank.schema import EXPORT, History
from quillrank.sources import exports, gerrit, git, github, star, star_git
from quillrank.stored import written

# The repository's log, as DuckDB sees it.
LOG = """
lines AS (SELECT lineitem.*, o_orderkey, epoch_ms(o_orderdate) AS ts, p_brand || '/' || p_type || '/' || replace(p_name, ' ', '/') AS root_path
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
commits AS (SELECT *, row_number() OVER (PARTITION BY root_path ORDER BY ts DESC, o_orderkey DESC) - 1 AS commit_seq FROM (SELECT DISTINCT root_path, ts, o_orderkey FROM lines)),
edits AS (SELECT root_path, commit_seq, l_linenumber AS b, CASE l_returnflag WHEN 'A' THEN 'INSERT' WHEN 'R' THEN 'DELETE' ELSE 'REPLACE' END AS type,
  CAST(l_quantity % 5 + 1 AS INT) AS older, CAST(l_suppkey % 5 + 1 AS INT) AS newer FROM lines JOIN commits USING (root_path, o_orderkey, ts)),
targets AS (SELECT id AS target_id FROM pr),
files AS (SELECT DISTINCT target_id, root_path FROM targets JOIN lines ON o_orderkey = target_id),
placed_files AS (SELECT target_id, f.root_path, commit_seq AS place, n_commits FROM files f JOIN commits c ON c.root_path = f.root_path AND o_orderkey = target_id
  JOIN (SELECT root_path, max(commit_seq) + 1 AS n_commits FROM commits GROUP BY root_path) n ON n.root_path = f.root_path WHERE n_commits > 1 AND commit_seq < n_commits - 1)"""


def _log(body: str) -> str:
    return f"WITH {HISTORY}, {LOG} {body}"


def _line_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed files of all pull requests, and the tables that the line ranker takes."""
    file_commit, edit = (written(rows, "log") for rows in star_git.edits(spark, folder))
    paths = star.load_history(spark, folder).file_paths
    targets = paths.select(F.col("pr_id").alias("target_id"), F.col("pr_id").cast("string").alias("change_id"), F.lit(star_git.REPOSITORY).alias("sub_project"), F.col("location").alias("root_path"))
    return written(L.placed_targets(targets, file_commit), "placed"), file_commit, edit


def _line_points(spark: SparkSession, folder: str) -> DataFrame:
    placed, file_commit, edit = _line_inputs(spark, folder)
    return L.commit_points(L.line_points(placed, L.affected_lines(placed, edit), file_commit, edit))


@_raw(
    "line_affected",
    _log(
        """SELECT DISTINCT target_id, root_path, CAST(line AS INT) AS line FROM (
  SELECT target_id, root_path, unnest(range(b + 1, b + 1 + older)) AS line FROM placed_files JOIN edits USING (root_path) WHERE commit_seq = place AND type = 'DELETE'
  UNION ALL SELECT target_id, root_path, unnest(range(b + 1, b + 1 + newer)) FROM placed_files JOIN edits USING (root_path) WHERE commit_seq = place AND type = 'REPLACE'
  UNION ALL SELECT target_id, root_path, b FROM placed_files JOIN edits USING (root_path) WHERE commit_seq = place AND type = 'INSERT')"""
    ),
)
def line_affected(spark: SparkSession, folder: str) -> DataFrame:
    placed, _, edit = _line_inputs(spark, folder)
    return L.affected_lines(placed, edit).select("target_id", "root_path", F.col("line").cast("int").alias("line"))


def _people_scores(spark: SparkSession, folder: str) -> DataFrame:
    placed, file_commit, edit = _line_inputs(spark, folder)
    return L.people_scores(placed, L.affected_lines(placed, edit), file_commit, edit, star_git.change_people(spark, folder))


# What follows a line through older commits depends on the order of edits; tests compare it with a plain version.
@_raw("line_commit_points")
def line_commit_points(spark: SparkSession, folder: str) -> DataFrame:
    return _line_points(spark, folder).withColumn("points", F.round("points", 9))


@_raw("line_people_points")
def line_people_points(spark: SparkSession, folder: str) -> DataFrame:
    return _people_scores(spark, folder)


@_raw("line_rank_topk")
def line_rank_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top(L.ranked(_people_scores(spark, folder).withColumnRenamed("account_id", "reviewer_id")), TOP)


@_raw(
    "people_of_changes",
    """SELECT CAST(l_orderkey AS VARCHAR) AS change_id, l_suppkey AS account_id FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING max(l_linenumber % 4 - 1) > 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_custkey % (SELECT count(*) FROM supplier) FROM orders""",
)
def people_of_changes(spark: SparkSession, folder: str) -> DataFrame:
    return L.people_of_changes(star_git.change_people(spark, folder))


_FILES = """WITH part_path AS (SELECT p_partkey, p_brand || '/' || p_type || '/' || replace(p_name, ' ', '/') AS path FROM part),
commit_file AS (SELECT DISTINCT {'t': -epoch_ms(o_orderdate), 'k': -o_orderkey} AS log_seq, CAST(o_orderkey AS VARCHAR) AS commit_id, path
  FROM lineitem JOIN part_path ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
starts AS (SELECT path, arg_max(commit_id, log_seq) AS commit_id FROM commit_file GROUP BY path),
renames AS (SELECT s.commit_id, n.p_partkey AS walk_order, o.path AS old_path, n.path AS new_path FROM starts s JOIN part_path n ON n.path = s.path AND n.p_partkey % 3 = 0 JOIN part_path o ON o.p_partkey = n.p_partkey + 1),
before AS (SELECT s.path AS root_path, arg_min(old_path, walk_order) AS old_path FROM starts s JOIN renames r ON r.commit_id = s.commit_id AND contains(new_path, s.path) GROUP BY s.path),
hops AS (SELECT path AS root_path, 0 AS hop, log_seq, commit_id, path FROM commit_file UNION ALL SELECT root_path, 1, log_seq, commit_id, path FROM before JOIN commit_file ON path = old_path)
"""


@_raw("rename_one_hop_history", _FILES + "SELECT root_path, CAST(row_number() OVER (PARTITION BY root_path ORDER BY hop, log_seq) - 1 AS INT) AS commit_seq, commit_id, path FROM hops")
def rename_one_hop_history(spark: SparkSession, folder: str) -> DataFrame:
    """Of all paths."""
    commits = star_git.commit_file(spark, folder)
    wanted = commits.select("sub_project", F.col("path").alias("root_path"))
    return git.history_with_renames(commits, star_git.renames(spark, folder), wanted).select("root_path", "commit_seq", "commit_id", "path")


@_raw("file_history", _FILES + "SELECT root_path, CAST(row_number() OVER (PARTITION BY root_path ORDER BY log_seq) - 1 AS INT) AS commit_seq, commit_id FROM hops WHERE hop = 0")
def file_history(spark: SparkSession, folder: str) -> DataFrame:
    """Of all paths, renames not followed."""
    commits = star_git.commit_file(spark, folder)
    return git.history(commits, commits.select("sub_project", F.col("path").alias("root_path"))).select("root_path", "commit_seq", "commit_id")


_CODE = "(length(lines[{0} + 1]) > 1 OR (length(lines[{1} + 1]) = 1 AND NOT regexp_full_match(lines[{1} + 1], '\\s')))"


@_raw(
    "nearest_code_line",
    f"""WITH files AS (SELECT page_id, string_split(regexp_replace(html, '\\n+$', ''), chr(10)) AS lines FROM pages WHERE html IS NOT NULL),
wanted AS (SELECT page_id, lines, CAST(page_id % len(lines) + 1 AS INT) AS line_no FROM files),
steps AS (SELECT *, unnest(range(1, greatest(len(lines) - 1, 1) + 1)) AS x FROM wanted),
seen AS (SELECT page_id, line_no, x, CASE WHEN x >= len(lines) THEN line_no WHEN line_no - 1 - x < 0 THEN line_no - 1 WHEN {_CODE.format("(line_no - 1 - x)", "(line_no - 1 - x)")} THEN line_no - x
  WHEN line_no - 1 + x >= len(lines) THEN line_no - 1 WHEN {_CODE.format("(line_no - 1 + x)", "(line_no - 1 - x)")} THEN line_no + x END AS found FROM steps)
SELECT page_id, w.line_no, CAST(coalesce(s.found, w.line_no) AS INT) AS nearest_line FROM wanted w LEFT JOIN (SELECT page_id, arg_min(found, x) AS found FROM seen WHERE found IS NOT NULL GROUP BY page_id) s USING (page_id)""",
)
def nearest_code_line(spark: SparkSession, folder: str) -> DataFrame:
    """For one line of each page, another one on every page."""
    files = star_git.page_files(spark, folder).where("content is not null")
    n = F.size(F.split(F.regexp_replace("content", "\\n+$", ""), "\n"))
    wanted = files.select("sub_project", "commit_id", "path", (F.col("path").cast("long") % n + 1).cast("int").alias("line_no"))
    return git.nearest_code_lines(files, wanted).select(F.col("path").cast("long").alias("page_id"), "line_no", "nearest_line")


@_raw(
    "json_export_roundtrip",
    f"""WITH {HISTORY} SELECT project, change_id, change_number, sub_project, ts, CAST(owner_id AS VARCHAR) AS owner_account, n_reviewers, coalesce(n_paths, 0) AS n_paths
FROM pr JOIN (SELECT pr_id, count(*) AS n_reviewers FROM review GROUP BY pr_id) r ON r.pr_id = id LEFT JOIN (SELECT pr_id, count(*) AS n_paths FROM path GROUP BY pr_id) p ON p.pr_id = id
WHERE owner_id IN (SELECT s_suppkey FROM supplier) UNION ALL
SELECT project, change_id, change_number, sub_project, ts, NULL, n_reviewers, coalesce(n_paths, 0)
FROM pr JOIN (SELECT pr_id, count(*) AS n_reviewers FROM review GROUP BY pr_id) r ON r.pr_id = id LEFT JOIN (SELECT pr_id, count(*) AS n_paths FROM path GROUP BY pr_id) p ON p.pr_id = id
WHERE owner_id NOT IN (SELECT s_suppkey FROM supplier)""",
)
def json_export_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The whole history as export objects, read again and normalized."""
    written = exports.nested(star.load_history(spark, folder)).select("project", F.to_json(F.struct(F.expr("* except (project)"))).alias("body"))
    read = written.select("project", F.from_json("body", EXPORT).alias("x")).select("project", "x.*")
    back = exports.normalized(read.drop("project"), "all")
    reviewers = back.reviews.groupBy("pr_id").agg(F.count("*").alias("n_reviewers"))
    paths = back.file_paths.groupBy("pr_id").agg(F.count("*").alias("n_paths"))
    owners = back.developers.select(F.col("id").alias("owner_id"), F.col("account_id").alias("owner_account"))
    rows = back.pull_requests.drop("project").join(owners, "owner_id", "left").join(reviewers, F.col("id") == reviewers.pr_id).drop("pr_id").join(paths, F.col("id") == paths.pr_id, "left")
    return rows.join(read.select("project", F.col("changeId").alias("change_id")), "change_id").select("project", "change_id", "change_number", "sub_project", "ts", "owner_account", "n_reviewers", F.coalesce("n_paths", F.lit(0).cast("long")).alias("n_paths"))


@_raw("json_github_reviewers", "SELECT DISTINCT l_orderkey AS number, CAST(l_suppkey AS VARCHAR) AS account_id, 'dev-' || l_suppkey AS name FROM lineitem WHERE l_suppkey % 10 <> 0")
def json_github_reviewers(spark: SparkSession, folder: str) -> DataFrame:
    return github.reviewers(*star_git.github_responses(spark, folder)).select("number", F.col("reviewer.accountId").alias("account_id"), "reviewer.name")


_PULLS = """WITH made AS (SELECT o_orderkey AS number, '{' || CASE WHEN o_orderkey % 7 = 2 THEN '' ELSE '"id":' || o_orderkey || ',' END || '"number":' || o_orderkey || ',"state":"closed","created_at":"'
  || CASE WHEN o_orderkey % 7 = 1 THEN 'yesterday' ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' END || '","user":{"id":' || o_custkey || ',"login":"dev"}}' AS body FROM orders)"""


@_raw("import_rejects", _PULLS + " SELECT CASE WHEN number % 7 = 0 THEN substr(body, 1, 30) ELSE body END AS body, CASE number % 7 WHEN 0 THEN 'bad JSON' WHEN 1 THEN 'bad date' ELSE 'missing key' END AS cause FROM made WHERE number % 7 < 3")
def import_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """What an import of all pull requests leaves out, and why."""
    return github.import_pulls(star_git.github_pulls(spark, folder))[1]


@_raw("imported_pulls", "SELECT o_orderkey AS number, CAST(o_orderkey AS VARCHAR) AS change_id, epoch_ms(date_trunc('day', o_orderdate)) AS ts, CAST(o_custkey AS VARCHAR) AS owner FROM orders WHERE o_orderkey % 7 > 2")
def imported_pulls(spark: SparkSession, folder: str) -> DataFrame:
    """And what it takes."""
    pulls = github.import_pulls(star_git.github_pulls(spark, folder))[0]
    return pulls.select("number", F.col("changeId").alias("change_id"), F.col("timestamp").alias("ts"), F.col("owner.accountId").alias("owner"))


@_raw(
    "paged_files",
    """WITH placed AS (SELECT l_orderkey AS number, p_brand || '/' || p_type || '/' || replace(p_name, ' ', '/') AS location, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_brand || '/' || p_type || '/' || replace(p_name, ' ', '/')) AS k FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT number, location FROM placed WHERE k <= 2 OR (number % 5 <> 0 AND number % 6 <> 0)""",
)
def paged_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of all orders, from pages; a list ends at its first page that is empty or lacking."""
    return github.file_paths(star_git.github_files(spark, folder))


_LCS = "list_reduce(list_prepend([0 FOR z IN range(0, len(b) + 1)], list_transform(a, lambda x: [CASE WHEN x = y THEN 1 ELSE 0 END FOR y IN b])), lambda prev, same: list_reduce(range(1, len(b) + 1), lambda cur, j: list_append(cur, CASE WHEN same[j] = 1 THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END), [0]))[len(b) + 1]"


@_raw(
    "diff_of_contents",
    f"""WITH {HISTORY}, {LOG}, ordered AS (SELECT p_brand || '/' || p_type || '/' || replace(p_name, ' ', '/') AS root_path, o_orderkey, o_orderdate, l_linenumber AS number, l_returnflag || ' ' || l_suppkey % 4 AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
so_far AS (SELECT root_path, o_orderkey, row_number() OVER w AS k, list({{'number': number, 'line': line}}) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS lines FROM ordered WINDOW w AS (PARTITION BY root_path ORDER BY o_orderdate, o_orderkey, number, line)),
content AS (SELECT root_path, o_orderkey, [x.line FOR x IN list_sort(arg_max(lines, k))] AS c FROM so_far GROUP BY ALL),
versions AS (SELECT root_path, o_orderkey, c AS b, lag(c) OVER (PARTITION BY root_path ORDER BY o_orderdate, o_orderkey) AS a FROM content JOIN (SELECT o_orderkey, o_orderdate FROM orders) USING (o_orderkey)),
sized AS (SELECT root_path, CAST(o_orderkey AS VARCHAR) AS commit_id, len(a) AS n_a, len(b) AS n_b, {_LCS} AS n_kept FROM versions WHERE a IS NOT NULL)
SELECT root_path, commit_id, CAST(n_a - n_kept AS BIGINT) AS n_deleted, CAST(n_b - n_kept AS BIGINT) AS n_inserted FROM sized WHERE n_a > n_kept OR n_b > n_kept""",
)
def diff_of_contents(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines every commit deletes and inserts in each of its files, by shortest edit scripts of their contents. Scripts differ, these numbers don't."""
    file_commit, content = star_git.file_versions(spark, folder)
    found = edits_from_contents(file_commit, content).groupBy("sub_project", "root_path", "commit_seq").agg(F.sum(F.col("end_a") - F.col("begin_a")).alias("n_deleted"), F.sum(F.col("end_b") - F.col("begin_b")).alias("n_inserted"))
    return found.join(file_commit.select("root_path", "commit_seq", "commit_id"), ["root_path", "commit_seq"]).select("root_path", "commit_id", "n_deleted", "n_inserted")


@_raw("line_rank_from_contents")
def line_rank_from_contents(spark: SparkSession, folder: str) -> DataFrame:
    """The line ranker for all pull requests over a log whose edits are worked out from contents."""
    file_commit, content = star_git.file_versions(spark, folder)
    file_commit = written(file_commit, "log")
    edit = written(edits_from_contents(file_commit, content), "log")
    targets = file_commit.select(F.col("commit_id").cast("long").alias("target_id"), "change_id", "sub_project", "root_path")
    return top(L.rank_lines(targets, file_commit, edit, star_git.change_people(spark, folder)), TOP)


@_raw("json_gerrit_labels", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS change_id, CAST(l_suppkey AS VARCHAR) AS account_id FROM lineitem WHERE l_linenumber % 4 - 1 > 0")
def json_gerrit_labels(spark: SparkSession, folder: str) -> DataFrame:
    return gerrit.reviewers(gerrit.changes(star_git.gerrit_responses(spark, folder))).select(F.col("changeId").alias("change_id"), F.col("reviewer.accountId").alias("account_id"))


@_raw(
    "json_gerrit_files",
    """SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS change_id, p_brand || '/' || p_type || '/' || replace(p_name, ' ', '/') AS location FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), '/COMMIT_MSG' FROM lineitem""",
)
def json_gerrit_files(spark: SparkSession, folder: str) -> DataFrame:
    return gerrit.file_paths(gerrit.changes(star_git.gerrit_responses(spark, folder))).select(F.col("changeId").alias("change_id"), "location")


@_raw("commit_change_id", "SELECT CAST(o_orderkey AS VARCHAR) AS commit_id, CASE o_orderkey % 4 WHEN 1 THEN 'I' || o_orderkey WHEN 2 THEN 'dev-' || o_custkey ELSE '' END AS change_id FROM orders")
def commit_change_id(spark: SparkSession, folder: str) -> DataFrame:
    return star_git.commit_messages(spark, folder).select("commit_id", git.change_id(F.col("message")).alias("change_id"))


@_ranking("recommended_reviewers", _history(f"SELECT target_id, rank, s_name AS name FROM ranking JOIN supplier ON s_suppkey = reviewer_id WHERE rank <= {TOP}", _path_ctes(_NEWEST, True) + _RANKED))
def recommended_reviewers(h: History) -> DataFrame:
    """The newest pull request of each project comes in as a request that the stored history doesn't have."""
    newest = newest_targets(h).select("target_id")
    of = lambda rows, key, how: rows.join(newest.withColumnRenamed("target_id", key), key, how)
    before = History(h.projects, h.developers, of(h.pull_requests, "id", "left_anti"), of(h.reviews, "pr_id", "left_anti"), of(h.file_paths, "pr_id", "left_anti"))
    targets, paths = of(h.pull_requests, "id", "left_semi"), of(h.file_paths, "pr_id", "left_semi")
    return shown(top(recommend(before, targets, paths), TOP), before).select("target_id", "rank", "name")
