"""Reading and writing corpora: Parquet trees, vector stores, labels, raw caches, configuration."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators.quality import require_unique
from lexigrid.schema import LABEL, PAPER

#: Columns that search and lookups need.
SEARCHED = ["paper_id", "title", "abstract", "authors", "venue", "year", "source", "source_url", "pdf_url", "keywords"]


def scan(spark: SparkSession, root: str, columns: list[str] | None = None) -> DataFrame:
    """All Parquet files under root, with the columns pruned at the scan."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(root)
    return df.select(*columns) if columns else df


def scan_unique(spark: SparkSession, root: str, key: str = "paper_id") -> DataFrame:
    """The searched columns that the files have; an error if a key repeats."""
    df = scan(spark, root)
    return require_unique(df.select(*(c for c in SEARCHED if c in df.columns)), key)


def write_partitioned(papers: DataFrame, root: str) -> None:
    """Papers by venue and year, in the declared schema; only partitions that occur are replaced."""
    cut = papers.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in PAPER.fields))
    # by ranges, so that a venue's year of many papers is dealt over tasks, and small ones share one
    cut.repartitionByRange("venue", "year", "paper_id").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("venue", "year").parquet(root)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Cluster labels from a JSON map of id to {label, size, keywords, sample_titles}."""
    value = "struct<label:string,size:bigint,keywords:array<string>,sample_titles:array<string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("id", "v"))
    return rows.select(F.col("id").cast("int").alias("cluster_id"), *(F.col(f"v.{f.name}").cast(f.dataType).alias(f.name) for f in LABEL.fields[1:]))


def write_labels(labels: DataFrame, path: str) -> None:
    """The JSON map of read_labels; there is one row per cluster."""
    entry = F.struct(F.col("cluster_id").cast("string"), F.struct("label", "size", "keywords", "sample_titles"))
    labels.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def import_store(spark: SparkSession, path: str, values: str = "vecs") -> DataFrame:
    """paper_id and vec (or label) from an npz file of ids and rows; keys, never positions, tell rows apart."""
    with np.load(path, allow_pickle=False) as z:
        ids, rows = z["ids"].tolist(), z[values]
    if len(ids) != len(rows) or len(set(ids)) != len(ids):
        raise ValueError("the store has repeated or missing ids")
    if rows.ndim == 1:
        return spark.createDataFrame(list(zip(ids, rows.tolist(), strict=True)), "paper_id string, label int")
    return spark.createDataFrame(list(zip(ids, rows.tolist(), strict=True)), "paper_id string, vec array<float>")


def export_store(vectors: DataFrame, path: str) -> None:
    """An npz file of ids and vecs, for tools that read no Parquet."""
    rows = vectors.select("paper_id", "vec").orderBy("paper_id").toPandas()
    np.savez(path, ids=np.array(rows["paper_id"].tolist()), vecs=np.array(rows["vec"].tolist(), np.float32))


def resume(docs: DataFrame, store: str, embed, key: str = "doc_id") -> DataFrame:
    """Append vectors of documents that the store lacks; the store as it is then."""
    from lexigrid.operators.quality import missing
    from lexigrid.operators.vectors import embedded

    spark = docs.sparkSession
    try:
        done = spark.read.parquet(store).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = docs.select(key).limit(0)
    embedded(missing(docs, done, key), embed).write.mode("append").parquet(store)
    return spark.read.parquet(store)


def without_prefix(store: DataFrame, prefix: str, key: str = "paper_id") -> DataFrame:
    """The store less the rows of a venue, so that they are made anew."""
    return store.filter(~F.col(key).startswith(prefix))


def raw_cache(spark: SparkSession, root: str) -> DataFrame:
    """Cached objects that have both content and sidecar: path, content, sha256, bytes and the sidecar's fields.

    The sidecar of name.ext is name.ext.meta.json beside it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    data = files.filter(~F.col("path").endswith(".meta.json")).select("path", "content", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"))
    meta = files.filter(F.col("path").endswith(".meta.json")).select(F.regexp_replace("path", r"\.meta\.json$", "").alias("path"), F.parse_json(F.col("content").cast("string")).alias("meta"))
    parts = F.split("path", "/")
    named = {"source": -4, "venue": -3, "year": -2}
    return data.join(meta, "path").withColumns({k: F.element_at(parts, i) for k, i in named.items()} | {"part": F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", "")})


def cache_faults(cache: DataFrame) -> DataFrame:
    """Objects whose hash or size is not what their sidecar says."""
    told = cache.withColumns({"told_hash": F.variant_get("meta", "$.sha256", "string"), "told_bytes": F.variant_get("meta", "$.bytes", "bigint")})
    return told.filter((F.col("told_hash") != F.col("sha256")) | (F.col("told_bytes") != F.col("bytes"))).select("path", "sha256", "told_hash", "bytes", "told_bytes")


def cache_write(root: str, source: str, venue: str, year: int, part: str, ext: str, data: bytes, meta: dict | None = None) -> Path:
    """Write one object and its sidecar, each by rename, the sidecar last."""
    import hashlib
    from datetime import UTC, datetime

    path = Path(root, source, venue, str(year), f"{part}.{ext}")
    path.parent.mkdir(parents=True, exist_ok=True)
    told = {"source": source, "venue": venue, "year": year, "part": part, "fetched_at": datetime.now(UTC).isoformat(), "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), **(meta or {})}
    for to, content in ((path, data), (path.with_name(path.name + ".meta.json"), json.dumps(told, indent=1).encode())):
        new = to.with_name(to.name + ".tmp")
        new.write_bytes(content)
        new.replace(to)
    return path


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The [[collection]] tables of a TOML file; a few rows that describe what to fetch."""
    rows = tomllib.loads(Path(path).read_text())["collection"]
    return spark.createDataFrame([(r.get("venue"), r["year"], r.get("collection"), r.get("main_volumes"), r.get("volume"), r.get("api"), r.get("expected"), r.get("note")) for r in rows], "venue string, year int, collection string, main_volumes array<string>, volume string, api string, expected int, note string")
