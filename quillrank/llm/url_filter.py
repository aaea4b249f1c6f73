"""URL filters: listed rules first, then logistic regression on hashed character n-grams of host and path.

Training and scoring are column expressions. The model is fitted in its dual
form, one coefficient for each labelled URL, so a fit costs one small row of
kernel values whatever the width of the hash space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.tables import stash

BUCKETS = 1 << 12
SIZES = (3, 4, 5)
STEPS = 300
#: A step converges while it is under 8 over the kernel's largest eigenvalue, and that is at most the largest sum of a row; a step is this much over that sum.
RATE = 6.0
#: Most labelled URLs, those of the lowest hashes; their kernel is one row of that number squared.
MOST_LABELLED = 400
RIDGE = 0.02

#: (action, host and path). The longest that fits a URL decides.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

# The small labelled table: names of hosts by the kind of site they are used for.
UNWANTED = (
    "casino-win", "casino-royal", "best-casino", "online-slots", "free-slots", "poker-cash", "free-bets", "sport-bets", "bet-bonus", "bets-today",
    "cheap-pills", "pills-shop", "buy-pills", "cheap-meds", "discount-pharma", "spam-farm", "link-farm", "seo-farm", "spam-links", "click-farm",
    "adult-x", "adult-cams", "xxx-adult", "hot-cams", "ads-track", "ad-tracker", "track-ads", "popup-ads", "ads-server", "fast-loans",
    "payday-loan", "free-crypto", "win-prizes", "free-prizes", "cheap-replica", "replica-watch", "miracle-diet", "get-rich-quick", "warez-crack", "crack-keys",
)
WANTED = (
    "citylibrary", "riverschool", "universitypress", "gardening", "historynotes", "openatlas", "physicsforum", "dailyreport", "localnews", "bookreview",
    "mathnotes", "therecipe", "kitchenstories", "thenotebook", "weatherstation", "museumguide", "thebotanist", "travelnotes", "musiclessons", "translation",
    "theobserver", "communityhall", "healthservice", "astronomers", "softwaredocs", "statistics", "grammarhelp", "parishrecords", "railwaymap", "thegazette",
    "editions", "institution", "education", "motionstudy", "stationery", "orchestra", "theatre", "handbook", "otherland", "northern",
)
LANGUAGES, ENDINGS, TOPS, PREFIXES = ("en", "de", "fr", "es"), ("", "/", ".html", "?page=2", "#top"), ("com", "net", "org"), ("", "www.", "blog.", "m.")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label (1: unwanted). Paths, prefixes and top-level domains come in turn for either label, so only names tell them apart."""
    rows = []
    for label, names in ((1, UNWANTED), (0, WANTED)):
        for k, name in enumerate(names):
            for turn in range(2):
                i = 7 * turn + k
                rows.append((f"https://{PREFIXES[i % 4]}{name}.example.{TOPS[i % 3]}/{LANGUAGES[(i // 3) % 4]}/{97 * i % 1000}{ENDINGS[i % 5]}", label))
    return spark.createDataFrame(rows, "url string, label int")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, hash or the end, in lower case; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The rule that decides and what it says; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column) -> Column:
    """Distinct hash buckets of the character n-grams of the host and of the path, in which numbers count as one character."""
    text = F.concat(F.lit("^"), host, F.lit(" "), F.regexp_replace(path, "[0-9]+", "0"), F.lit("$"))

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(n), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return F.array_distinct(F.concat(*map(of_size, SIZES)))


def fit(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights of the buckets and the intercept, from a small table (url, label) of which MOST_LABELLED rows are used. Gradient steps on the dual of ridge-penalised logistic loss."""
    bounded = labelled.where("label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(MOST_LABELLED)
    rows = bounded.select("label", grams(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("label", "grams"))).alias("rows"))
    like = "transform(rows, a -> transform(rows, b -> 1D + size(array_intersect(a.grams, b.grams)) / sqrt(size(a.grams) * size(b.grams))))"
    step = f"""aggregate(sequence(1, {STEPS}), array_repeat(0D, size(rows)), (c, t) -> transform(c, (v, i) ->
        v + rate * (rows[i].label - 1 / (1 + exp(-aggregate(zip_with(kernel[i], c, (k, x) -> k * x), 0D, (s, x) -> s + x))) - {RIDGE} * v)))"""
    # Written, so that the kernel is worked out once and not at each step.
    rate = f"{RATE}D / array_max(transform(kernel, r -> aggregate(r, 0D, (s, x) -> s + x)))"
    fitted = stash(one.withColumn("kernel", F.expr(like)).withColumn("rate", F.expr(rate)), "url-kernel").withColumn("dual", F.expr(step))
    pairs = fitted.select(F.explode(F.arrays_zip("rows", "dual")).alias("x")).select("x.dual", F.col("x.rows.grams").alias("grams"))
    share = pairs.select("dual", F.explode("grams").alias("bucket"), F.sqrt(F.size("grams")).alias("norm"))
    by_bucket = share.groupBy("bucket").agg(F.sum(F.col("dual") / F.col("norm")).alias("weight")).union(pairs.agg(F.lit(-1), F.sum("dual")))
    weights, intercept = [0.0] * BUCKETS, 0.0
    for bucket, weight in by_bucket.collect():
        if bucket < 0:
            intercept = weight or 0.0
        else:
            weights[bucket] = weight
    return weights, intercept


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Judge the url of every row of ``pages`` (page_id, url).

    Returns page_id, host, path, rule, verdict (allow or block) and score, the
    model's probability that the URL is unwanted. A null URL, or one without
    ``://``, has an empty host and path and is judged by the model; URLs are
    read whole, however long; of rules of one length that fit, a blocking one
    decides, then the later by code point; repeated rows are judged alike; an
    empty table gives no rows; other columns are ignored.
    """
    weights, intercept = fit(labelled)
    table = F.from_json(F.lit("[" + ",".join(map(repr, weights)) + "]"), "array<double>")
    split = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    total = F.aggregate("grams", F.lit(0.0), lambda s, b: s + F.get(table, b)) / F.sqrt(F.size("grams"))
    scored = split.withColumn("grams", grams(F.col("host"), F.col("path"))).withColumn("score", 1 / (1 + F.exp(-(total + intercept))))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
