"""Inputs that the queries derive from the tables, the same in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.metadata import typed_map
from lodestar.types import METADATA, tagged_column

DIMENSIONS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, values): all embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, values): each vector times 1 to 5, so that the metrics rank differently."""
    factor = (1 + F.col("id") % 5).cast("float")
    return vectors(spark, sf_dir).withColumn("values", F.transform("values", lambda x: x * factor))


def zeroed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, values): the vectors of every 50th id are zeros."""
    return vectors(spark, sf_dir).withColumn("values", F.when(F.col("id") % 50 == 0, F.transform("values", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("values")))


def tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, values): all vectors, and all of them again under other ids, so every score is tied."""
    rows = vectors(spark, sf_dir)
    return rows.unionByName(rows.withColumn("id", F.col("id") + 1_000_000_000))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query: the vector of id 0. One row reaches the driver, as a query does."""
    row = vectors(spark, sf_dir).where("id = 0").first()
    return list(row["values"]) if row else [0.0] * DIMENSIONS


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, metadata): label of every vector; language, source, length and a ratio of those that have a document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label").join(docs, "id", "left")
    fields = {
        "label": tagged_column("int64", F.col("label").cast("long")),
        "lang": tagged_column("string", F.col("lang")),
        "source": tagged_column("string", F.col("source")),
        "long_doc": tagged_column("bool", F.col("n_chars") > 500),
        "ratio": tagged_column("double", F.col("n_chars").cast("double") / 2),
    }
    return rows.select("id", typed_map(fields).cast(METADATA).alias("metadata"))


def mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, metadata): the label as a number on even ids, as a string on odd ones."""
    label = F.col("label").cast("long")
    x = F.when(F.col("vec_id") % 2 == 0, tagged_column("int64", label)).otherwise(tagged_column("string", label.cast("string")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), typed_map({"x": x}).cast(METADATA).alias("metadata"))


def segments(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three segments: all rows; every third doubled; every seventh removed."""
    rows = vectors(spark, sf_dir)
    live = F.lit(False).alias("is_deleted")
    return [
        rows.select("id", live, "values"),
        rows.where("id % 3 = 0").select("id", live, F.transform("values", lambda x: x * F.lit(2.0).cast("float")).alias("values")),
        rows.where("id % 7 = 0").select("id", F.lit(True).alias("is_deleted"), F.lit(None).cast("array<float>").alias("values")),
    ]


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come back after the segments: every 21st as it was."""
    return vectors(spark, sf_dir).where("id % 21 = 0").select("id", F.lit(False).alias("is_deleted"), "values")


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rounds of operations: inserts, more inserts (some repeat ids), updates, removes; some vectors too short."""
    rows = vectors(spark, sf_dir)
    short = F.when(F.col("id") % 11 == 0, F.slice("values", 1, DIMENSIONS - 1)).otherwise(F.col("values"))
    labels = F.when(F.col("id") % 6 == 0, typed_map({"even": tagged_column("bool", F.col("id") % 4 == 0)})).cast(METADATA)
    out = None
    for n, (op, every) in enumerate((("insert", 2), ("insert", 3), ("update", 5), ("remove", 4))):
        part = rows.where(F.col("id") % every == 0).select(
            (F.lit(n * 1_000_000_000).cast("bigint") + F.col("id")).alias("seq"),
            F.lit(op).alias("op"),
            "id",
            (F.lit(None).cast("array<float>") if op == "remove" else short).alias("values"),
            (labels if op == "insert" else F.lit(None).cast(METADATA)).alias("metadata"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations as a log, whose numbers rise with seq; without vectors that are too short."""
    rows = ops(spark, sf_dir).where("values IS NULL OR size(values) = 64")
    op = F.when(F.col("op") == "remove", "delete").otherwise(F.col("op"))
    return rows.select((F.col("seq") + 1).alias("lsn"), op.alias("op"), "id", F.coalesce(F.size("values"), F.lit(0)).alias("dimensions"), "values", F.lit(None).cast("bigint").alias("checkpoint_lsn"))


# The same in SQL: common table expressions, by name.
VECTORS = "e AS (SELECT vec_id AS id, embedding AS v FROM embeddings)"
SCALED = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x * CAST(1 + vec_id % 5 AS FLOAT)) AS v FROM embeddings)"
ZEROED = "e AS (SELECT vec_id AS id, CASE WHEN vec_id % 50 = 0 THEN list_transform(embedding, lambda x: 0::FLOAT) ELSE embedding END AS v FROM embeddings)"
TIED = "e AS (SELECT vec_id AS id, embedding AS v FROM embeddings UNION ALL SELECT vec_id + 1000000000, embedding FROM embeddings)"
QUERY = "q0 AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
META = (
    "m AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, lang, source, n_chars > 500 AS long_doc, CAST(n_chars AS DOUBLE) / 2 AS ratio "
    "FROM embeddings LEFT JOIN documents ON vec_id = doc_id)"
)
KEYS = """k AS (
  SELECT id, 'label' AS field, 'int64' AS kind, CAST(label AS VARCHAR) AS payload FROM m WHERE label IS NOT NULL
  UNION ALL SELECT id, 'lang', 'string', lang FROM m WHERE lang IS NOT NULL
  UNION ALL SELECT id, 'source', 'string', source FROM m WHERE source IS NOT NULL
  UNION ALL SELECT id, 'long_doc', 'bool', CAST(long_doc AS VARCHAR) FROM m WHERE long_doc IS NOT NULL
  UNION ALL SELECT id, 'ratio', 'double', CAST(CAST(ratio * 2 AS BIGINT) AS VARCHAR) FROM m WHERE ratio IS NOT NULL)"""
VERSIONS = """s AS (
  SELECT 0 AS g, vec_id AS id, false AS gone, embedding AS v FROM embeddings
  UNION ALL SELECT 1, vec_id, false, list_transform(embedding, lambda x: x * 2::FLOAT) FROM embeddings WHERE vec_id % 3 = 0
  UNION ALL SELECT 2, vec_id, true, NULL FROM embeddings WHERE vec_id % 7 = 0)"""
ALL_VERSIONS = VERSIONS[:-1] + "\n  UNION ALL SELECT 3, vec_id, false, embedding FROM embeddings WHERE vec_id % 21 = 0)"
NEWEST = "l AS (SELECT id, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY g DESC) AS r FROM s) WHERE r = 1 AND NOT gone)"
OPS = """o AS (
  SELECT vec_id AS seq, 'insert' AS op, vec_id AS id, CASE WHEN vec_id % 11 = 0 THEN embedding[1:63] ELSE embedding END AS v, CASE WHEN vec_id % 6 = 0 THEN vec_id % 4 = 0 END AS even FROM embeddings WHERE vec_id % 2 = 0
  UNION ALL SELECT 1000000000 + vec_id, 'insert', vec_id, CASE WHEN vec_id % 11 = 0 THEN embedding[1:63] ELSE embedding END, CASE WHEN vec_id % 6 = 0 THEN vec_id % 4 = 0 END FROM embeddings WHERE vec_id % 3 = 0
  UNION ALL SELECT 2000000000 + vec_id, 'update', vec_id, CASE WHEN vec_id % 11 = 0 THEN embedding[1:63] ELSE embedding END, NULL FROM embeddings WHERE vec_id % 5 = 0
  UNION ALL SELECT 3000000000 + vec_id, 'remove', vec_id, NULL, NULL FROM embeddings WHERE vec_id % 4 = 0),
a AS (SELECT *, coalesce(len(v) = 64, false) AS fits FROM o),
b AS (SELECT *, coalesce(last_value(CASE WHEN op = 'insert' AND fits THEN true WHEN op = 'remove' THEN false END IGNORE NULLS)
        OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS live FROM a),
j AS (SELECT *, CASE WHEN op IN ('insert', 'update') AND NOT fits THEN 'dimension_mismatch' WHEN op = 'insert' AND live THEN 'duplicate_id'
        WHEN op <> 'insert' AND NOT live THEN 'not_found' ELSE 'ok' END AS status FROM b)"""


def dot(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]), lambda s, x: s + x, 0::FLOAT)"


def squared(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda s, x: s + x, 0::FLOAT)"


def norm(a: str) -> str:
    return f"CAST(sqrt({dot(a, a)}) AS FLOAT)"


def cosine(a: str, b: str) -> str:
    norms = f"CAST({norm(a)} * {norm(b)} AS FLOAT)"
    return f"CASE WHEN {norms} = 0 THEN 0::FLOAT ELSE CAST({dot(a, b)} / {norms} AS FLOAT) END"


def score(a: str, b: str, metric: str) -> str:
    return {"dot_product": dot, "cosine": cosine, "euclidean": lambda x, y: f"(0::FLOAT - {squared(x, y)})"}[metric](a, b)
