"""Schemas of the corpus model."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()

#: A paper: one wide record for every source.
PAPER = T.StructType(
    [
        T.StructField("paper_id", _S), T.StructField("source_id", _S), T.StructField("title", _S), T.StructField("abstract", _S),
        T.StructField("authors", T.ArrayType(T.StructType([T.StructField("name", _S), T.StructField("source_author_id", _S)]))),
        T.StructField("venue", _S), T.StructField("year", T.IntegerType()), T.StructField("track", _S), T.StructField("length", _S),
        T.StructField("source", _S), T.StructField("source_url", _S), T.StructField("pdf_url", _S), T.StructField("doi", _S),
        T.StructField("arxiv_id", _S), T.StructField("s2_corpus_id", _S), T.StructField("keywords", T.ArrayType(_S)), T.StructField("primary_area", _S),
    ]
)
VECTOR = T.StructType([T.StructField("paper_id", _S), T.StructField("vec", T.ArrayType(T.FloatType()))])
EDGE = T.StructType([T.StructField("src", _S), T.StructField("dst", _S), T.StructField("rank", T.IntegerType()), T.StructField("sim", T.DoubleType())])
ASSIGNMENT = T.StructType([T.StructField("paper_id", _S), *(T.StructField(x, T.IntegerType()) for x in ("leaf", "mid", "mega"))])
LABEL = T.StructType([T.StructField("cluster_id", T.IntegerType()), T.StructField("label", _S), T.StructField("size", T.LongType()), T.StructField("keywords", T.ArrayType(_S)), T.StructField("sample_titles", T.ArrayType(_S))])

#: Labels of rows without a cluster, of leaves without a middle topic, and of middle topics without a broad one.
NOISE, NO_MID, NO_MEGA = -1, -2, -3
