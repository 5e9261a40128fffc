"""The corpus model on the driver's test tables, and the same as SQL.

Documents are papers: the first line is the title, the language the venue, and
the year follows from the id. Vectors' labels are leaf clusters (9 is noise), and
middle and broad topics follow from the leaf, so that every orphan rule fires.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import text as tx

VENUES, FIRST_YEAR, LAST_YEAR, LAST_COMPLETE = ("de", "en", "es", "fr"), 2018, 2025, 2024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    year = (F.lit(FIRST_YEAR) + F.col("doc_id") % 8).cast("int")
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return d.select(
        "doc_id", tx.paper_id(F.col("lang"), year, F.col("doc_id")).alias("paper_id"), title.alias("title"), F.col("text").alias("abstract"),
        F.col("lang").alias("venue"), year.alias("year"), "source", F.array(F.struct(F.concat(F.lit("Author "), F.col("source")).alias("name"))).alias("authors"),
        F.array_distinct(tx.terms(title, stop=[])).alias("keywords"),
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, mid and mega; a document without a vector is noise."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    leaf = F.coalesce(F.when(F.col("label") != 9, F.col("label")), F.lit(-1))
    mid = F.when(F.col("leaf").isin(0, 1, 2), 0).when(F.col("leaf").isin(3, 4), 1).when((F.col("leaf") == 5) & (F.col("doc_id") % 2 == 0), 1).when(F.col("leaf").isin(7, 8), 2).otherwise(-1)
    mega = F.when(F.col("mid") == 0, 0).when(F.col("mid") == 2, 1).when((F.col("mid") == -1) & (F.col("doc_id") % 3 == 0), 0).otherwise(-1)
    return d.join(e, "doc_id", "left").select("doc_id", leaf.alias("leaf")).withColumn("mid", mid).withColumn("mega", mega)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).join(assignments(spark, sf_dir), "doc_id")


def leaf_names(spark: SparkSession) -> DataFrame:
    """A label for most leaves; leaf 8 has none."""
    return spark.range(8).select(F.col("id").cast("int").alias("cluster_id"), F.concat(F.lit("Leaf "), F.col("id").cast("string")).alias("label"))


def mid_names(spark: SparkSession) -> DataFrame:
    return spark.range(3).select(F.col("id").cast("int").alias("cluster_id"), F.concat(F.lit("Topic "), F.col("id").cast("string")).alias("label"))


def mega_names(spark: SparkSession) -> DataFrame:
    return spark.range(2).select(F.col("id").cast("int").alias("cluster_id"), F.concat(F.lit("Area "), F.col("id").cast("string")).alias("label"))


PAPERS_SQL = r"""
papers AS (
  SELECT doc_id, lang || ':' || CAST(2018 + doc_id % 8 AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR) AS paper_id,
    split_part(text, chr(10), 1) AS title, text AS abstract, lang AS venue, CAST(2018 + doc_id % 8 AS INTEGER) AS year, source,
    'Author ' || source AS author, list_distinct(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z][a-z0-9-]{2,}')) AS keywords
  FROM documents)"""

ASSIGN_SQL = """
leaves AS (
  SELECT doc_id, coalesce(CASE WHEN label <> 9 THEN label END, -1) AS leaf
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
mids AS (
  SELECT doc_id, leaf, CASE WHEN leaf IN (0, 1, 2) THEN 0 WHEN leaf IN (3, 4) THEN 1 WHEN leaf = 5 AND doc_id % 2 = 0 THEN 1
    WHEN leaf IN (7, 8) THEN 2 ELSE -1 END AS mid FROM leaves),
assigned AS (
  SELECT doc_id, leaf, mid, CASE WHEN mid = 0 THEN 0 WHEN mid = 2 THEN 1 WHEN mid = -1 AND doc_id % 3 = 0 THEN 0 ELSE -1 END AS mega
  FROM mids)"""

REMAP_SQL = """
mid2 AS (
  SELECT doc_id, leaf, CASE WHEN leaf >= 0 AND max(mid) OVER (PARTITION BY leaf) < 0 THEN -2 ELSE mid END AS mid, mega FROM assigned),
remapped AS (
  SELECT doc_id, leaf, mid, CASE WHEN max(mega) OVER (PARTITION BY mid) < 0 THEN -3 ELSE mega END AS mega FROM mid2),
trend AS (
  SELECT r.*, venue, year, CASE mega WHEN -3 THEN 'Cross-Cutting & Specialized Research' WHEN -1 THEN 'Unclustered'
    WHEN 0 THEN 'Area 0' WHEN 1 THEN 'Area 1' ELSE CAST(mega AS VARCHAR) END AS category
  FROM remapped r JOIN papers USING (doc_id))"""


def prelude(*parts: str) -> str:
    return "WITH " + ",".join(parts)
