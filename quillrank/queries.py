"""The queries of the entry module over the star-schema tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import paths as P
from quillrank.operators import cleaning, rank_nb, rank_paths, relational
from quillrank.operators.borda import points
from quillrank.operators.postprocess import demote_inactive, top, with_activity
from quillrank.plans import evaluate as E
from quillrank.schema import History
from quillrank.sources import star

Query = Callable[[SparkSession, str], DataFrame]
MONTHS, TOP = 12, 5
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

# The history, as DuckDB sees it.
HISTORY = """
raw_pr AS (
  SELECT o_orderkey AS id, n_name AS project, o_orderpriority AS sub_project, CAST(o_orderkey AS VARCHAR) AS change_id, o_orderkey AS change_number,
         epoch_ms(o_orderdate) AS ts, o_custkey % (SELECT count(*) FROM supplier) AS owner_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), raw_review AS (SELECT DISTINCT l_orderkey AS pr_id, l_suppkey AS reviewer_id FROM lineitem),
other_review AS (SELECT r.* FROM raw_review r LEFT JOIN raw_pr p ON p.id = r.pr_id WHERE p.owner_id IS NULL OR p.owner_id <> r.reviewer_id),
pr AS (SELECT * FROM raw_pr WHERE owner_id IS NOT NULL AND id IN (SELECT pr_id FROM other_review)),
review AS (SELECT * FROM other_review WHERE pr_id IN (SELECT id FROM pr)),
path AS (
  SELECT l_orderkey AS pr_id, p_brand || '/' || p_type || '/' || replace(p_name, ' ', '/') AS location FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_orderkey IN (SELECT id FROM pr)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, id DESC) - 1 AS rk, count(*) OVER (PARTITION BY project) AS n_project FROM pr
), seen AS (SELECT pr.*, reviewer_id FROM pr JOIN review ON id = pr_id)"""


def _history(body: str, ctes: str = "") -> str:
    return f"WITH {HISTORY}{', ' + ctes if ctes else ''} {body}"


def _query(name: str, sql: str | None = None, load: Callable[[SparkSession, str], History] = star.load_history) -> Callable[[Callable[[History], DataFrame]], Callable[[History], DataFrame]]:
    """Registers a query over the cleaned history."""

    def add(f: Callable[[History], DataFrame]) -> Callable[[History], DataFrame]:
        _queries[name] = lambda spark, folder: f(load(spark, folder))
        if sql:
            _sql[name] = sql
        return f

    return add


#: For rankers, which read the history's tables many times.
_ranking = partial(_query, load=star.stored_history)


def _raw(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query over the tables themselves."""

    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


# Tables and cleaning.
_query("history_projects", "SELECT n_name AS name FROM nation")(lambda h: h.projects.select("name"))
_query("history_developers", "SELECT s_suppkey AS id, CAST(s_suppkey AS VARCHAR) AS account_id, '' AS email, s_name AS name FROM supplier")(lambda h: h.developers.drop("avatar"))
_query("history_pull_requests", _history("SELECT * FROM pr"))(lambda h: h.pull_requests)
_query("history_reviews", _history("SELECT * FROM review"))(lambda h: h.reviews)
_query("history_file_paths", _history("SELECT * FROM path"))(lambda h: h.file_paths)
_raw("owner_removed_reviews", _history("SELECT r.* FROM raw_review r JOIN raw_pr p ON p.id = r.pr_id AND p.owner_id = r.reviewer_id"))(lambda s, d: cleaning.own_reviews(star.raw_history(s, d)))
_raw("ingest_reject_no_reviewer", _history("SELECT * FROM raw_pr WHERE id NOT IN (SELECT id FROM pr)"))(lambda s, d: cleaning.rejected(cleaning.without_owner(star.raw_history(s, d))))


@_raw("insert_if_absent_pr", _history("SELECT project, change_id FROM raw_pr WHERE id NOT IN (SELECT id FROM pr)"))
def insert_if_absent_pr(spark: SparkSession, folder: str) -> DataFrame:
    """All raw pull requests are offered to a store that has the cleaned ones."""
    return cleaning.insert_if_absent(star.load_history(spark, folder).pull_requests, star.raw_history(spark, folder).pull_requests, cleaning.PULL_REQUEST_KEY).select("project", "change_id")


@_raw("insert_if_absent_developer", "SELECT CAST(c_custkey AS VARCHAR) AS account_id, '' AS email, c_name AS name FROM customer GROUP BY ALL")
def insert_if_absent_developer(spark: SparkSession, folder: str) -> DataFrame:
    """Customers are offered, twice each, to a store that has the suppliers."""
    offered = star.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("account_id"), F.lit("").alias("email"), F.col("c_name").alias("name"))
    return cleaning.insert_if_absent(star.load_history(spark, folder).developers, offered.union(offered), cleaning.DEVELOPER_KEY).select("account_id", "email", "name")


# Finders and counts.
_query("prs_newest_first", _history("SELECT project, id, ts, rk FROM placed"))(lambda h: relational.newest_first(h.pull_requests).select("project", "id", "ts", "rk"))
_query("prs_in_activity_window", _history("SELECT p.id AS target_id, s.reviewer_id, count(*) AS n_recent FROM pr p JOIN seen s ON s.project = p.project AND s.ts < p.ts AND s.ts > p.ts - 31104000000 GROUP BY ALL"))(lambda h: relational.reviewed_between(h, MONTHS))
_query("count_all_prs", _history("SELECT count(*) AS n FROM pr"))(lambda h: h.pull_requests.agg(F.count("*").alias("n")))
_query("count_pr_by_reviewer", _history("SELECT project, reviewer_id, count(*) AS n FROM seen GROUP BY ALL"))(lambda h: relational.count_by(relational.reviewed(h), "project", "reviewer_id"))
_query("count_pr_by_reviewer_subproject", _history("SELECT project, reviewer_id, sub_project, count(*) AS n FROM seen GROUP BY ALL"))(lambda h: relational.count_by(relational.reviewed(h), "project", "reviewer_id", "sub_project"))
_query("count_pr_by_reviewer_owner", _history("SELECT project, reviewer_id, owner_id, count(*) AS n FROM seen GROUP BY ALL"))(lambda h: relational.count_by(relational.reviewed(h), "project", "reviewer_id", "owner_id"))
_query("count_paths_by_reviewer", _history("SELECT project, reviewer_id, count(*) AS n FROM seen JOIN path ON id = pr_id GROUP BY ALL"))(lambda h: relational.count_by(relational.reviewed_paths(h), "project", "reviewer_id"))
_query("count_paths_by_reviewer_location", _history("SELECT project, reviewer_id, location, count(*) AS n FROM seen JOIN path ON id = pr_id GROUP BY ALL"))(lambda h: relational.count_by(relational.reviewed_paths(h), "project", "reviewer_id", "location"))


@_query("prs_before_cutoff", _history("SELECT c.project, fold, p.id FROM cuts c JOIN pr p ON p.project = c.project AND p.ts < c.cutoff", "cuts AS (SELECT project, CAST(rk // (n_project // 11) - 1 AS INT) AS fold, ts AS cutoff FROM placed WHERE n_project // 11 > 0 AND rk > 0 AND rk % (n_project // 11) = 0 AND rk // (n_project // 11) <= 10)"))
def prs_before_cutoff(h: History) -> DataFrame:
    """Strictly before the cutoff of each fold."""
    return rank_nb.fold_cutoffs(h).join(h.pull_requests, "project").where("ts < cutoff").select("project", "fold", "id")


@_query("pr_by_change_id", _history("SELECT project, change_id, id FROM pr"))
def pr_by_change_id(h: History) -> DataFrame:
    return relational.pull_request_of_change(h.pull_requests, h.pull_requests.select("project", "change_id")).select("project", "change_id", "id")


@_query("developer_by_natural_key", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def developer_by_natural_key(h: History) -> DataFrame:
    return relational.developer_of_key(h.developers, h.developers.select("account_id", "name", "email")).select("id", "name")


_query("project_by_name", "SELECT n_name AS name FROM nation WHERE n_name = 'NATION_0'")(lambda h: relational.project_of_name(h.projects, "NATION_0").select("name"))

# Paths.
_PARTS = "CASE WHEN {0} = '' THEN [''] WHEN regexp_full_match({0}, '/+') THEN [] ELSE string_split(regexp_replace({0}, '/+$', ''), '/') END"
_raw("path_components", f"SELECT page_id, CAST(len(p) AS INT) AS n_parts, array_to_string(p, '|') AS parts FROM (SELECT page_id, {_PARTS.format('url')} AS p FROM pages)")(
    lambda s, d: star.table(s, d, "pages").select("page_id", P.components(F.col("url")).alias("p")).select("page_id", F.size("p").alias("n_parts"), F.array_join("p", "|").alias("parts"))
)
_raw("url_last_segment", "SELECT page_id, CASE WHEN string_split(url, '/')[-1] <> '' THEN string_split(url, '/')[-1] ELSE coalesce(string_split(url, '/')[-2], '') END AS segment FROM pages")(
    lambda s, d: star.table(s, d, "pages").select("page_id", P.last_segment(F.col("url")).alias("segment"))
)
_query("path_subproject_prefix", _history("SELECT pr_id, location, CASE WHEN length(sub_project) > 0 THEN replace(sub_project, '/', '') || '/' || location ELSE location END AS below FROM path JOIN pr ON id = pr_id"))(
    lambda h: h.file_paths.join(h.pull_requests, F.col("pr_id") == F.col("id")).select("pr_id", "location", P.with_sub_project(F.col("location"), F.col("sub_project")).alias("below"))
)

# What two lists of components a and b have in common, in SQL.
_COMMON = {
    "prefix": "len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[1:k] = b[1:k]))",
    "suffix": "len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[len(a) - k + 1:] = b[len(b) - k + 1:]))",
    "substring": "coalesce(list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: len(list_filter(range(1, len(a) - k + 2), lambda i: len(list_filter(range(1, len(b) - k + 2), lambda j: a[i:i + k - 1] = b[j:j + k - 1])) > 0)) > 0)), 0)",
    "subsequence": "list_reduce(a, lambda prev, x: list_reduce(range(1, len(b) + 1), lambda cur, j: list_append(cur, CASE WHEN x = b[j] THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END), [0]), [0 FOR z IN range(0, len(b) + 1)])[len(b) + 1]",
}


def _known_paths(h: History) -> DataFrame:
    return h.file_paths.select("location").distinct()


def _alike(technique: str, h: History) -> DataFrame:
    """For each path, how many others have something in common with it by a technique, and how much in all; they share a component."""
    known = _known_paths(h)
    pairs = rank_paths.path_pairs(known, known)
    return pairs.select("f", "g", technique).where(f"{technique} > 0").select("f", F.round(technique, 9).alias(technique)).groupBy("f").agg(F.count("*").alias("n_alike"), F.round(F.sum(technique), 6).alias("total"))


_PAIRS = "known AS (SELECT DISTINCT location AS f, string_split(location, '/') AS a FROM path), "
for _technique in P.TECHNIQUES:
    _query(
        f"sim_{_technique}",
        _history(
            "SELECT f, count(*) AS n_alike, round(sum(s), 6) AS total FROM alike WHERE s > 0 GROUP BY f",
            _PAIRS + f"alike AS (SELECT f, CAST({_COMMON[_technique]} AS DOUBLE) / greatest(len(a), len(b)) AS s FROM (SELECT x.f, x.a, y.a AS b FROM known x, known y WHERE list_has_any(x.a, y.a)))",
        ),
    )(partial(_alike, _technique))

# The path ranker, for the newest pull request of each project.
_NEWEST = "targets AS (SELECT id AS target_id, project, rk FROM placed WHERE rk = 0), "
_WALK = "targets AS (SELECT id AS target_id, project, rk FROM placed WHERE n_project - rk >= n_project // 11), "


def _path_ctes(targets: str, sub_project: bool) -> str:
    below = "CASE WHEN length(sub_project) > 0 THEN replace(sub_project, '/', '') || '/' || location ELSE location END" if sub_project else "location"
    sums = ", ".join(f"sum(s_{t} * n_copies) AS s_{t}" for t in P.TECHNIQUES)
    means = ", ".join(f"s_{t} / (n.n_paths * m.n_paths) AS {t}" for t in P.TECHNIQUES)
    sims = ", ".join(f"CAST({_COMMON[t]} AS DOUBLE) / greatest(len(a), len(b)) AS s_{t}" for t in P.TECHNIQUES)
    return (
        targets
        + f"""located AS (SELECT pr_id, {below} AS location, count(*) AS n_copies FROM path JOIN pr ON id = pr_id GROUP BY ALL),
sizes AS (SELECT pr_id, sum(n_copies) AS n_paths FROM located GROUP BY pr_id),
known AS (SELECT DISTINCT location AS f, string_split(location, '/') AS a FROM located),
wanted AS (SELECT DISTINCT location AS f FROM located JOIN targets ON pr_id = target_id),
pairs AS (SELECT f, g, {sims} FROM (SELECT x.f, x.a, y.f AS g, y.a AS b FROM known x, known y WHERE x.f IN (SELECT f FROM wanted) AND list_has_any(x.a, y.a))),
likes AS (SELECT target_id, project, rk, g, {sums} FROM targets JOIN located ON pr_id = target_id JOIN pairs ON f = location GROUP BY ALL),
sums AS (SELECT x.target_id, h.pr_id, {", ".join(f"sum(s_{t} * h.n_copies) AS s_{t}" for t in P.TECHNIQUES)} FROM likes x JOIN located h ON h.location = x.g JOIN placed p ON p.id = h.pr_id AND p.project = x.project AND p.rk > x.rk GROUP BY ALL),
scored AS (SELECT target_id, sums.pr_id, {means} FROM sums JOIN sizes n ON n.pr_id = sums.pr_id JOIN sizes m ON m.pr_id = target_id),
by_technique AS (SELECT target_id, reviewer_id, technique, round(sum(score), 9) AS score FROM (UNPIVOT scored ON {", ".join(P.TECHNIQUES)} INTO NAME technique VALUE score) u JOIN review r ON r.pr_id = u.pr_id GROUP BY ALL),
ballots AS (SELECT *, count(*) OVER (PARTITION BY target_id, technique) - row_number() OVER (PARTITION BY target_id, technique ORDER BY score DESC, reviewer_id) + 1 AS points FROM by_technique WHERE score > 0),
scores AS (SELECT target_id, reviewer_id, CAST(sum(points) AS DOUBLE) AS score FROM ballots GROUP BY ALL)"""
    )


_ACTIVE = """, judged AS (SELECT s.*, EXISTS (SELECT 1 FROM seen h JOIN pr t ON t.id = s.target_id WHERE h.project = t.project AND h.reviewer_id = s.reviewer_id AND h.ts < t.ts AND h.ts > t.ts - 31104000000) AS is_active FROM scores s)"""
_JUDGED = """, recent AS (SELECT t.id AS target_id, h.reviewer_id FROM pr t JOIN seen h ON h.project = t.project AND h.ts < t.ts AND h.ts > t.ts - 31104000000 GROUP BY ALL),
judged AS (SELECT s.*, r.reviewer_id IS NOT NULL AS is_active FROM scores s LEFT JOIN recent r USING (target_id, reviewer_id))"""
_RANKED = ", ranking AS (SELECT target_id, reviewer_id, score, CAST(row_number() OVER (PARTITION BY target_id ORDER BY score DESC, reviewer_id) AS INT) AS rank FROM scores)"
_DEMOTED = _JUDGED + ", ranking AS (SELECT target_id, reviewer_id, score, CAST(row_number() OVER (PARTITION BY target_id ORDER BY is_active DESC, score DESC, reviewer_id) AS INT) AS rank FROM judged)"
_METRICS = """, hits AS (SELECT t.target_id, t.project, min(k.rank) AS first_hit FROM targets t LEFT JOIN (SELECT k.* FROM ranking k JOIN review v ON v.pr_id = k.target_id AND v.reviewer_id = k.reviewer_id) k ON k.target_id = t.target_id GROUP BY ALL)"""
_MEASURES = "SELECT project, count(*) AS n_targets, " + ", ".join(f"round(avg(CASE WHEN first_hit <= {k} THEN 100.0::DOUBLE ELSE 0 END), 6) AS top_{k}" for k in E.TOPS) + ", round(avg(coalesce(1.0::DOUBLE / first_hit, 0)), 6) AS mrr FROM hits GROUP BY project"


def _newest_scores(h: History, sub_project: bool = False) -> DataFrame:
    return rank_paths.pair_scores(h, rank_paths.newest_targets(h), sub_project)


_ranking("pr_pair_score", _history("SELECT target_id, pr_id, " + ", ".join(f"round({t}, 9) AS {t}" for t in P.TECHNIQUES) + " FROM scored", _path_ctes(_NEWEST, False)))(
    lambda h: _newest_scores(h).select("target_id", "pr_id", *[F.round(t, 9).alias(t) for t in P.TECHNIQUES])
)
_ranking("reviewer_score_by_technique", _history("SELECT * FROM by_technique", _path_ctes(_NEWEST, False)))(lambda h: rank_paths.technique_scores(h, _newest_scores(h)))
_ranking("borda_points", _history("SELECT * FROM ballots", _path_ctes(_NEWEST, False)))(lambda h: points(rank_paths.technique_scores(h, _newest_scores(h)), "target_id", "technique"))
_ranking("rank_paths_topk", _history(f"SELECT * FROM ranking WHERE rank <= {TOP}", _path_ctes(_NEWEST, False) + _RANKED))(lambda h: top(rank_paths.rank_paths(rank_paths.newest_targets(h), h), TOP))
_ranking("rank_paths_plus_topk", _history(f"SELECT * FROM ranking WHERE rank <= {TOP}", _path_ctes(_NEWEST, True) + _DEMOTED))(lambda h: top(demote_inactive(rank_paths.rank_paths(rank_paths.newest_targets(h), h, True), h, MONTHS), TOP))
_ranking("active_reviewers", _history("SELECT target_id, reviewer_id, is_active FROM judged", _path_ctes(_NEWEST, False) + _JUDGED))(
    lambda h: with_activity(rank_paths.rank_paths(rank_paths.newest_targets(h), h), h, MONTHS).select("target_id", "reviewer_id", "is_active")
)
_ranking("retired_demotion", _history("SELECT * FROM ranking", _path_ctes(_NEWEST, False) + _DEMOTED))(lambda h: demote_inactive(rank_paths.rank_paths(rank_paths.newest_targets(h), h), h, MONTHS))

# The naive-Bayes ranker.
_CUTS = "cuts AS (SELECT project, CAST(rk // (n_project // 11) - 1 AS INT) AS fold, ts AS cutoff FROM placed WHERE n_project // 11 > 0 AND rk > 0 AND rk % (n_project // 11) = 0 AND rk // (n_project // 11) <= 10), "
_ALL = "cuts AS (SELECT DISTINCT project, CAST(0 AS INT) AS fold, 9223372036854775807 AS cutoff FROM pr), "


def _nb_ctes(cuts: str) -> str:
    out = (
        cuts
        + """ps AS (SELECT fold, s.* FROM seen s JOIN cuts c ON c.project = s.project AND s.ts < c.cutoff),
pp AS (SELECT fold, p.* FROM pr p JOIN cuts c ON c.project = p.project AND p.ts < c.cutoff),
sf AS (SELECT ps.*, location FROM ps JOIN path ON pr_id = id),
sizes AS (SELECT project, fold, count(*) AS n_pull_requests, count(DISTINCT owner_id) + 1 AS owner_universe, count(DISTINCT sub_project) + 1 AS sub_project_universe FROM pp GROUP BY ALL),
sizes2 AS (SELECT project, fold, count(DISTINCT location) + 1 AS path_universe FROM pp JOIN path ON pr_id = id GROUP BY ALL),
sizes3 AS (SELECT project, fold, count(DISTINCT reviewer_id) AS n_reviewers FROM ps GROUP BY ALL),
universe AS (SELECT s.project, s.fold, n_pull_requests, n_reviewers, owner_universe, coalesce(path_universe, 1) AS path_universe, sub_project_universe FROM sizes s JOIN sizes3 USING (project, fold) LEFT JOIN sizes2 USING (project, fold)),
counted AS (SELECT project, fold, reviewer_id, count(*) AS n_reviews FROM ps GROUP BY ALL),
prior AS (SELECT project, fold, reviewer_id, n_reviews, CAST(n_reviews AS DOUBLE) / n_pull_requests AS p FROM counted JOIN universe USING (project, fold))"""
    )
    for feature, value, rows in (("owner", "owner_id", "ps"), ("path", "location", "sf"), ("sub_project", "sub_project", "ps")):
        out += f""",
n_{feature} AS (SELECT project, fold, reviewer_id, {value} AS value, count(*) AS n FROM {rows} GROUP BY ALL),
t_{feature} AS (SELECT project, fold, reviewer_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_values FROM n_{feature} GROUP BY ALL),
cell_{feature} AS (SELECT project, fold, reviewer_id, value, n, CAST(n AS DOUBLE) / total - 0.01::DOUBLE / n_values AS p FROM n_{feature} JOIN t_{feature} USING (project, fold, reviewer_id)),
rest_{feature} AS (SELECT project, fold, reviewer_id, coalesce(total, 0) AS total, coalesce(n_values, 0) AS n_values, 0.01::DOUBLE / ({feature}_universe - coalesce(n_values, 0)) AS p FROM counted LEFT JOIN t_{feature} USING (project, fold, reviewer_id) JOIN universe USING (project, fold))"""
    return out


def _belief_ctes(cuts: str, targets: str, sub_project: bool) -> str:
    joins, factor = "", "prior.p * coalesce(co.p, ro.p)"
    if sub_project:
        joins, factor = "JOIN rest_sub_project rs USING (project, fold, reviewer_id) LEFT JOIN cell_sub_project cs ON cs.project = t.project AND cs.fold = t.fold AND cs.reviewer_id = prior.reviewer_id AND cs.value = t.sub_project", factor + " * coalesce(cs.p, rs.p)"
    return (
        _nb_ctes(cuts)
        + f""", targets AS ({targets}),
copies AS (SELECT t.*, location, count(*) AS n_copies FROM targets t JOIN path ON pr_id = target_id GROUP BY ALL),
belief AS (SELECT target_id, location, n_copies, reviewer_id, {factor} * coalesce(cp.p, rp.p) AS belief FROM copies t JOIN prior USING (project, fold)
  JOIN rest_owner ro USING (project, fold, reviewer_id) LEFT JOIN cell_owner co ON co.project = t.project AND co.fold = t.fold AND co.reviewer_id = prior.reviewer_id AND co.value = t.owner_id
  {joins} JOIN rest_path rp USING (project, fold, reviewer_id) LEFT JOIN cell_path cp ON cp.project = t.project AND cp.fold = t.fold AND cp.reviewer_id = prior.reviewer_id AND cp.value = t.location),
ballots AS (SELECT target_id, reviewer_id, n_copies * (count(*) OVER (PARTITION BY target_id, location) - row_number() OVER (PARTITION BY target_id, location ORDER BY belief DESC, reviewer_id) + 1) AS points FROM belief),
scores AS (SELECT target_id, reviewer_id, CAST(sum(points) AS DOUBLE) AS score FROM ballots GROUP BY ALL)"""
    )


_NEWEST_NB = "SELECT id AS target_id, project, CAST(0 AS INT) AS fold, owner_id, sub_project FROM placed WHERE rk = 0"
_FOLD_NB = "SELECT id AS target_id, project, CAST(rk // (n_project // 11) AS INT) AS fold, owner_id, sub_project FROM placed WHERE n_project // 11 > 0 AND rk < 10 * (n_project // 11)"


def _first_model(h: History, sub_project: bool = True) -> rank_nb.Model:
    """The model of what is older than the first fold alone."""
    return rank_nb.fit_nb(h, rank_nb.fold_cutoffs(h).where("fold = 0"), sub_project)


def _newest_nb(h: History) -> DataFrame:
    """The newest pull request of each project is tried on the model of what is older than the first fold."""
    return rank_paths.newest_targets(h).select("target_id", "project", F.lit(0).alias("fold"))


_ranking("nb_universe_sizes", _history("SELECT * FROM universe", _nb_ctes(_CUTS)))(lambda h: rank_nb.universes(h, rank_nb.fold_cutoffs(h)))
_ranking("nb_prior", _history("SELECT * FROM prior", _nb_ctes(_CUTS)))(lambda h: rank_nb.priors(h, rank_nb.fold_cutoffs(h)))
_ranking("nb_cond_owner", _history("SELECT * FROM cell_owner", _nb_ctes(_CUTS)))(lambda h: rank_nb.observed_cells(h, rank_nb.fold_cutoffs(h), "owner"))
_ranking("nb_cond_path", _history("SELECT * FROM cell_path", _nb_ctes(_CUTS)))(lambda h: rank_nb.observed_cells(h, rank_nb.fold_cutoffs(h), "path"))
_ranking("nb_cond_subproject", _history("SELECT * FROM cell_sub_project", _nb_ctes(_CUTS)))(lambda h: rank_nb.observed_cells(h, rank_nb.fold_cutoffs(h), "sub_project"))
_ranking("nb_defaults_path", _history("SELECT * FROM rest_path", _nb_ctes(_ALL)))(lambda h: rank_nb.fit_nb(h, rank_nb.whole_history(h), features=("path",)).defaults["path"])
_ranking("nb_belief", _history("SELECT * FROM belief", _belief_ctes(_CUTS, _NEWEST_NB, True)))(lambda h: rank_nb.beliefs(_first_model(h), _newest_nb(h), h))
_ranking("nb_rank_topk", _history(f"SELECT * FROM ranking WHERE rank <= {TOP}", _belief_ctes(_CUTS, _NEWEST_NB, False) + _RANKED))(lambda h: rank_nb.rank_nb(_first_model(h, False), _newest_nb(h), h, best=TOP))
_ranking("nb_plus_rank_topk", _history(f"SELECT * FROM ranking WHERE rank <= {TOP}", _belief_ctes(_CUTS, _NEWEST_NB, True) + _DEMOTED))(lambda h: rank_nb.rank_nb(_first_model(h), _newest_nb(h), h, MONTHS, TOP))

# Evaluation.
_query("fold_cutoffs", _history("SELECT * FROM cuts", _CUTS.rstrip(", ")))(rank_nb.fold_cutoffs)
_query("eval_targets_paths", _history("SELECT * FROM targets", _WALK.rstrip(", ")))(E.path_targets)
_query("eval_targets_nb", _history("SELECT target_id, project, rk, fold FROM (SELECT id AS target_id, project, rk, CAST(rk // (n_project // 11) AS INT) AS fold FROM placed WHERE n_project // 11 > 0 AND rk < 10 * (n_project // 11))"))(rank_nb.fold_targets)
# The walk over all targets pairs paths by number, and finds what they have in common by their subsets and runs of components.
_WALK_PAIRS = """known AS (SELECT location, row_number() OVER (ORDER BY location) AS n, string_split(location, '/') AS a FROM (SELECT DISTINCT location FROM path)),
subsets AS (SELECT DISTINCT n, len(s) AS k, array_to_string(s, '/') AS s FROM (SELECT n, [a[i] FOR i IN range(1, len(a) + 1) IF (mask >> (i - 1)) & 1 = 1] AS s FROM (SELECT n, a, unnest(range(1, 1 << len(a))) AS mask FROM known))),
stretches AS (SELECT DISTINCT n, k, array_to_string(a[i:i + k - 1], '/') AS s FROM (SELECT n, a, i, unnest(range(1, len(a) - i + 2)) AS k FROM (SELECT n, a, unnest(range(1, len(a) + 1)) AS i FROM known))),
in_order AS (SELECT x.n AS f, y.n AS g, max(x.k) AS subsequence FROM subsets x JOIN subsets y USING (s) GROUP BY ALL),
in_row AS (SELECT x.n AS f, y.n AS g, max(x.k) AS substring FROM stretches x JOIN stretches y USING (s) GROUP BY ALL),
pairs AS (SELECT f, g, substring, subsequence, """ + ", ".join(f"{_COMMON[t]} AS {t}" for t in ("prefix", "suffix")) + """
  FROM (SELECT f, g, substring, subsequence, x.a, y.a AS b FROM in_order JOIN in_row USING (f, g) JOIN known x ON x.n = f JOIN known y ON y.n = g)),
located AS (SELECT pr_id, n, len(a) AS parts, count(*) AS n_copies FROM path JOIN known USING (location) GROUP BY ALL),
sizes AS (SELECT pr_id, sum(n_copies) AS n_paths FROM located GROUP BY pr_id)"""


def _walk_ctes(sub_project: bool) -> str:
    # Two paths of one sub-project have its name in common, too.
    common, longer = {t: f"coalesce({t}, 0)" for t in P.TECHNIQUES}, "greatest(x.parts, h.parts)"
    if sub_project:
        same, longer = "t.sub_project = o.sub_project", f"({longer} + 1)"
        common = {
            "prefix": f"CASE WHEN {same} THEN coalesce(prefix, 0) + 1 ELSE 0 END",
            "suffix": f"coalesce(suffix, 0) + CASE WHEN {same} AND x.n = h.n THEN 1 ELSE 0 END",
            "substring": f"greatest(coalesce(substring, 0), CASE WHEN {same} THEN coalesce(prefix, 0) + 1 ELSE 0 END)",
            "subsequence": f"coalesce(subsequence, 0) + CASE WHEN {same} THEN 1 ELSE 0 END",
        }
    sums = ", ".join(f"sum(x.n_copies * h.n_copies * CAST({common[t]} AS DOUBLE) / {longer}) AS s_{t}" for t in P.TECHNIQUES)
    scores = ", ".join(f"round(sum(s_{t} / (m.n_paths * o.n_paths)), 9) AS {t}" for t in P.TECHNIQUES)
    return (
        _WALK
        + _WALK_PAIRS
        + f""", sums AS (SELECT t.target_id, o.id AS pr_id, {sums} FROM (SELECT targets.*, sub_project FROM targets JOIN pr ON id = target_id) t JOIN placed o ON o.project = t.project AND o.rk > t.rk
  JOIN located x ON x.pr_id = t.target_id JOIN located h ON h.pr_id = o.id LEFT JOIN pairs ON f = x.n AND g = h.n GROUP BY ALL),
by_reviewer AS (SELECT target_id, reviewer_id, {scores} FROM sums s JOIN sizes m ON m.pr_id = s.pr_id JOIN sizes o ON o.pr_id = target_id JOIN review r ON r.pr_id = s.pr_id GROUP BY ALL),
by_technique AS (UNPIVOT by_reviewer ON {", ".join(P.TECHNIQUES)} INTO NAME technique VALUE score),
ballots AS (SELECT *, count(*) OVER (PARTITION BY target_id, technique) - row_number() OVER (PARTITION BY target_id, technique ORDER BY score DESC, reviewer_id) + 1 AS points FROM by_technique WHERE score > 0),
scores AS (SELECT target_id, reviewer_id, CAST(sum(points) AS DOUBLE) AS score FROM ballots GROUP BY ALL)"""
    )


# The same with every pair of whole paths spelt out; it outgrows memory over larger tables, so tests compare it on a small history.
SMALL_SQL = {
    "metrics_v1": _history(_MEASURES, _path_ctes(_WALK, False) + _RANKED + _METRICS),
    "metrics_v2": _history(_MEASURES, _path_ctes(_WALK, True) + _DEMOTED + _METRICS),
}
_ranking("metrics_v1", _history(_MEASURES, _walk_ctes(False) + _RANKED + _METRICS))(lambda h: E.evaluate(h, "v1", MONTHS))
_ranking("metrics_v2", _history(_MEASURES, _walk_ctes(True) + _DEMOTED + _METRICS))(lambda h: E.evaluate(h, "v2", MONTHS))
_ranking("metrics_v3", _history(_MEASURES, _belief_ctes(_CUTS, _FOLD_NB, False) + _DEMOTED + _METRICS))(lambda h: E.evaluate(h, "v3", MONTHS))
_ranking("metrics_v4", _history(_MEASURES, _belief_ctes(_CUTS, _FOLD_NB, True) + _DEMOTED + _METRICS))(lambda h: E.evaluate(h, "v4", MONTHS))


def queries() -> dict[str, Query]:
    from quillrank import queries_sources  # noqa: F401  registers more

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
