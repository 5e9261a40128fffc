"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid import runtime
from lexigrid.runtime import prepare, settled, shared_dir

from . import textkernel

__all__ = ["maybe_broadcast", "prepare", "settled", "shared_dir", "small_enough", "table", "tidy"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most ``rows`` rows; reads no more than that of it."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only once a count has shown that df is small; otherwise Spark shuffles."""
    return F.broadcast(df) if small_enough(df, rows) else df


def tidy(run: Callable[[runtime.Batches], runtime.Batches], forget: Callable[[], None] | None = None) -> Callable[[runtime.Batches], runtime.Batches]:
    """run, after which its worker returns what it and the text kernel no longer need."""

    def clear() -> None:
        textkernel.forget()
        if forget:
            forget()

    return runtime.tidy(run, clear)
