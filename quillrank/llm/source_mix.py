"""Mixing sources to target weights with exact word budgets.

Documents get hash-random keys; inside a source they are taken in key order
until the source's budget is spent, whole epochs first. Prefix sums are built
in two levels, over ranges of the key and inside the one range that holds the
cut, so no task ever sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.tables import free_name, quoted, stash

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Key ranges are cut so that about so many rows of a source share one.
ROWS_PER_RANGE = 2048


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the hash-random key, that depends on doc_id alone and so is the same in every run."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
    ).withColumn("mix_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, n_rows, target: a row for each source.

    The targets fill up like water: sources in order of cap over weight are
    full for as long as their cap is under what is left by weight.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), cycle + 1)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    level = (F.col("total") * share - F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * most)
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", level)
        .withColumn("open_level", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything))
        .select("source", "source_size", "n_rows", F.least("cap", F.coalesce(F.col("open_level.level") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def cuts(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Where each source stops: epochs in full, then the documents before (cut_key, cut_id, cut_size), then cut_words of each document there."""
    goal = goals.withColumn("budget", F.round("target").cast("long")).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).withColumn("digits", F.ceil(F.greatest(F.lit(0.0), F.log(F.col("n_rows") / ROWS_PER_RANGE) / F.log(F.lit(16.0)))).cast("int"))
    a, b = sized.alias("a"), goal.alias("b")
    ranged = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).where("b.rest > 0").select("a.*", "b.rest", F.expr("substring(a.mix_key, 1, b.digits)").alias("key_range"))
    sums = ranged.groupBy("source", "key_range", "rest").agg(F.sum("size").alias("range_size"))
    before = F.sum("range_size").over(Window.partitionBy("source").orderBy("key_range")) - F.col("range_size")
    holds = sums.withColumn("before", before).where("before < rest and rest <= before + range_size").select("source", "key_range", "before").alias("h")
    r = ranged.alias("r")
    inside = r.join(holds, F.col("r.source").eqNullSafe(F.col("h.source")) & (F.col("r.key_range") == F.col("h.key_range"))).select("r.*", "h.before")
    alike = inside.groupBy("source", "rest", "before", "mix_key", "doc_id", "size").agg(F.count("*").alias("n_alike"))
    spent = F.sum(F.col("size") * F.col("n_alike")).over(Window.partitionBy("source").orderBy("mix_key", "doc_id", "size")) - F.col("size") * F.col("n_alike")
    at = (
        alike.withColumn("spent", F.col("before") + spent)
        .where("spent < rest and rest <= spent + size * n_alike")
        .select("source", F.col("mix_key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), F.expr("(rest - spent) div n_alike").alias("cut_words"))
    )
    g, c = goal.alias("g"), at.alias("c")
    return g.join(c, F.col("g.source").eqNullSafe(F.col("c.source")), "left").select("g.source", "g.source_size", "g.target", "g.epochs", "c.cut_key", "c.cut_id", "c.cut_size", "c.cut_words")


def taken_words(size: Column, mix_key: Column, doc_id: Column) -> Column:
    here = F.struct(mix_key.alias("k"), doc_id.alias("i"), size.alias("s"))
    cut = F.struct(F.col("c.cut_key").alias("k"), F.col("c.cut_id").alias("i"), F.col("c.cut_size").alias("s"))
    return F.col("c.epochs") * size + F.when(F.col("c.cut_key").isNull(), F.lit(0)).when(here < cut, size).when(here == cut, F.col("c.cut_words")).otherwise(F.lit(0))


def plan_mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> tuple[DataFrame, DataFrame]:
    sized = stash(with_keys(docs), "mix-sizes")
    return sized, stash(cuts(sized, targets(sized, weights, share, most)), "mix-cuts")


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """How many words of each row of ``docs`` (doc_id, text, source) the mix takes.

    Returns doc_id, size, source_size, target and taken (long; whole epochs
    counted). Texts are counted whole, however long. A source without words
    takes none; a null source is a source of its own, last in order; null text
    has size 0; rows alike in doc_id and size, a tie in the order of keys, share
    a cut evenly. Sources are few: their totals, a row each, are ranked in one
    task. An empty table gives no rows; other columns are ignored.
    """
    sized, where = plan_mix(docs, weights, share, most)
    s, c = sized.alias("s"), where.alias("c")
    # No broadcast hint: the table of sources is written, so Spark broadcasts it by its real size or not at all.
    return s.join(c, F.col("s.source").eqNullSafe(F.col("c.source"))).select(
        "s.doc_id", "s.size", "c.source_size", "c.target", taken_words(F.col("s.size"), F.col("s.mix_key"), F.col("s.doc_id")).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each epoch of a document.

    The document at a source's cut gives its first words, joined by spaces.
    Texts are read whole, however long. Null, empty and wordless texts have
    nothing to take and no row; a null source is a source of its own; rows
    alike in doc_id and size share a cut evenly, so ties and repeated rows need
    no order; an empty table gives no rows; other columns, whatever their
    names, go along.
    """
    _, where = plan_mix(docs, weights, share, most)
    mix, epoch = free_name("mix", docs), free_name("epoch", docs)
    d, c = docs.alias("d"), where.alias("c")
    size, words = F.col(f"{mix}.size"), F.col(f"{mix}.taken")
    key = F.md5(F.coalesce(F.col("d.doc_id").cast("string"), F.lit("")).cast("binary"))
    n = word_count(F.col("d.text"))
    joined = d.join(c, F.col("d.source").cast("string").eqNullSafe(F.col("c.source"))).select("d.*", F.struct(n.alias("size"), taken_words(n, key, F.col("d.doc_id").cast("long")).alias("taken")).alias(mix))
    copies = F.sequence(F.lit(1).cast("long"), F.expr(f"({mix}.taken + {mix}.size - 1) div {mix}.size"))
    rows = joined.where(words > 0).withColumn(epoch, F.explode(copies))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), (words - (F.col(epoch) - 1) * size).cast("int")), " ")
    return rows.withColumn("text", F.when(F.col(epoch) * size <= words, F.col("text")).otherwise(part)).select(*quoted(*docs.columns))


ORACLE_MIX = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS mix_key
  FROM {docs}
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS DOUBLE) * 2 AS cap,
         [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), goals AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM levels WHERE cap > level * weight) * weight, cap)) AS target FROM levels
), sums AS (
  SELECT s.*, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY mix_key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - spent)) END AS BIGINT) AS taken
FROM sums
"""
