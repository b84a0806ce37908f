"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document gets the exponential key -ln(u) / w, where u is a uniform number drawn from the md5 of its id and w its
quality weight; within a source, ascending keys are a weighted sample without replacement. A source whose target exceeds
its size is first taken whole, epoch by epoch; what then remains is filled in key order up to the budget, and the
document on the border gives as many words as are missing.

Keys are cut into buckets that rise with the key, so a prefix sum needs a window over one bucket of one source plus the
sums of the buckets before it: no task ever sorts a whole source.

Defined results: a null text has size 0 and takes 0 words; null sources are one source, ordered last; a null doc_id is
drawn as the empty string; equal keys go by doc_id, then size, and rows equal in all three are interchangeable; an empty
table gives an empty result; other columns are left out of mix() and kept by materialise(), and may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import WORD, staged, unused

#: A source is taken this many times at most.
MAX_EPOCHS = 3
#: Weights of the sources by their place in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Least quality weight of a document.
LEAST_WEIGHT = 0.25
#: Hex digits of the md5 that make the uniform number.
DIGITS = 13
ROWS_PER_BUCKET = 100_000
LEAST_BUCKETS = 256


def quality_weight(words: Column) -> Column:
    """Share of distinct words among a text's words, LEAST_WEIGHT at least."""
    return F.greatest(F.lit(LEAST_WEIGHT), F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)))


def keyed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """(_doc, _source, _size, _key) of every document. _source sorts as the source does, with null last."""
    words = F.coalesce(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    drawn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    u = (F.conv(F.substring(drawn, 1, DIGITS), 16, 10).cast("long") + 1) / F.lit(float(16**DIGITS + 1))
    return docs.select(
        F.col("doc_id").alias("_doc"),
        F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))).alias("_source"),
        F.size(words).cast("long").alias("_size"),
        (-F.log(u) / quality_weight(words)).alias("_key"),
    )


def targets(sources: DataFrame) -> DataFrame:
    """Add _target to (_source, _total): weights share all words, no source above MAX_EPOCHS times its size.

    The sources are ordered by size / weight, the order in which they fill up; the level is that of the first source
    that its share does not fill.
    """
    place = F.row_number().over(Window.orderBy("_source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((place - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    s = sources.select("_source", "_total", weight.alias("_weight")).withColumn("_cap", F.col("_total") * MAX_EPOCHS)
    fill = Window.orderBy(F.col("_cap") / F.col("_weight"), "_source")
    everything = Window.partitionBy()
    rest = F.sum("_weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    before = F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("_level", (F.sum("_total").over(everything) - before) / rest)
    s = s.withColumn("_level", F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_source"), F.col("_level")))).over(everything)["_level"])
    return s.select("_source", "_total", F.coalesce(F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight")), F.col("_cap").cast("double")).alias("_target"))


def _mixed(docs: DataFrame, seed: str) -> DataFrame:
    rows = staged(keyed(docs, seed), "mix")
    buckets = max(LEAST_BUCKETS, math.ceil(rows.count() / ROWS_PER_BUCKET))
    rows = rows.withColumn("_bucket", F.floor(F.lit(buckets) * F.col("_key") / (1 + F.col("_key"))))
    sums = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"))
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sources = targets(rows.groupBy("_source").agg(F.sum("_size").alias("_total")))
    sums = sums.join(sources, "_source").select("_source", "_bucket", "_ahead", "_total", "_target")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "_doc", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(sums, ["_source", "_bucket"])
    budget = F.floor(F.col("_target") + 0.5).cast("long")
    epochs = F.coalesce(F.try_divide(budget - budget % F.greatest("_total", F.lit(1)), F.col("_total")).cast("long"), F.lit(0))
    left = budget - epochs * F.col("_total") - F.col("_ahead") - F.col("_in")
    taken = epochs * F.col("_size") + F.least(F.col("_size"), F.greatest(F.lit(0), left))
    return rows.select("_doc", "_source", "_size", "_total", "_target", taken.cast("long").alias("_taken"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return _mixed(docs, seed).select(F.col("_doc").alias("doc_id"), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def materialise(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: each document once for each epoch that takes it, in the columns of docs.

    A document of which only some words are taken has its first words, joined by single spaces, and their n_chars.
    Documents without words take no part. doc_id and source must name rows: rows that share both share their fate, the
    first of them by size.
    """
    doc, source, size, taken, time = unused(docs, "doc", "key", "size", "taken", "time")
    plan = _mixed(docs, seed).where("_taken > 0").groupBy("_doc", "_source").agg(F.min("_size").alias("_size"), F.min_by("_taken", "_size").alias("_taken"))
    plan = plan.select(F.col("_doc").alias(doc), F.col("_source").alias(source), F.col("_size").alias(size), F.col("_taken").alias(taken))
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    both = docs.join(plan, F.col("doc_id").eqNullSafe(F.col(doc)) & (key == F.col(source)))
    part = F.col(taken) % F.col(size)
    both = both.withColumn(time, F.explode(F.sequence(F.lit(0), F.ceil(F.col(taken) / F.col(size)).cast("int") - 1)))
    cut = (F.col(time) == F.floor(F.col(taken) / F.col(size))) & (part > 0)
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), part.cast("int")), " ")
    both = both.withColumn("text", F.when(cut, first).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return both.select(*docs.columns)


SQL = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {DIGITS}) AS BIGINT) + 1) / CAST({16**DIGITS + 1} AS DOUBLE) AS u
  FROM documents),
k AS (
  SELECT doc_id, skey, CAST(len(words) AS BIGINT) AS size,
         -ln(u) / greatest({LEAST_WEIGHT}::DOUBLE, len(list_distinct(words))::DOUBLE / greatest(len(words), 1)) AS key FROM d),
s AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS total, (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS weight FROM k GROUP BY skey),
f AS (
  SELECT *, ((SELECT sum(total) FROM s) - coalesce(sum(3 * total) OVER (ORDER BY (3 * total)::DOUBLE / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
       / sum(weight) OVER (ORDER BY (3 * total)::DOUBLE / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
l AS (SELECT level FROM f WHERE level * weight <= 3 * total ORDER BY (3 * total)::DOUBLE / weight, skey LIMIT 1),
t AS (SELECT skey, total, least((3 * total)::DOUBLE, coalesce((SELECT level FROM l) * weight, (3 * total)::DOUBLE)) AS target FROM s),
r AS (
  SELECT doc_id, size, total, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CAST(coalesce(sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM k JOIN t USING (skey))
SELECT doc_id, size, total AS source_size, target,
       CAST(CASE WHEN total = 0 THEN 0 ELSE (budget // total) * size + least(size, greatest(0, budget - (budget // total) * total - before)) END AS BIGINT) AS taken
FROM r
"""
