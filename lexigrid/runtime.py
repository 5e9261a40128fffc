"""What operators need from a session, and what Python workers give back."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])
#: Bytes of an Arrow batch between the JVM and Python, of which each task holds a few.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Bytes of vectors in a block of queries; the rows that one is held against are up to four times as much.
BLOCK_BYTES = 8 << 20

Batches = Iterator[pa.RecordBatch]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that spark.checkpoint.dir names.

    Where the setting is missing, a session whose executors are threads of the driver
    gets a temporary folder; on a cluster that is an error, as executors would not
    see one another's files.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if own := sc.getCheckpointDir():
        return own.rsplit("/", 1)[0]
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="lexigrid-")


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, bound Arrow batches, and give checkpoints a folder if there is none."""
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = ":".join([*paths, ROOT])
    if spark.conf.get(_BATCH_KEY, None) in (None, "64MB", "67108864b"):  # Spark's own choice
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return spark


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint, after which the shuffles that led to it leave the executors' disks.

    Spark removes the files of a shuffle (and of a checkpoint, where the session cleans
    those) only after the driver's garbage collector has met it without a reference, and
    a driver with memory to spare seldom collects: an operator of many joins would keep
    the files of all of them.
    """
    out = df.checkpoint()
    del df  # its plan refers to the shuffles
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def tidy(run: Callable[[Batches], Batches], forget: Callable[[], None] | None = None) -> Callable[[Batches], Batches]:
    """run, after which its worker returns what it no longer needs; workers live on and serve other operators."""

    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # not glibc

    return tidied


def _packed(rows: DataFrame, of: int, name: str) -> DataFrame:
    """rows as ``of`` blocks, each one binary value (an Arrow stream) in a partition of its own."""
    schema = rows.limit(0).toArrow().schema

    def pack(batches: Batches) -> Batches:
        sink, n = pa.BufferOutputStream(), 0
        with pa.ipc.new_stream(sink, schema) as out:
            for batch in batches:
                out.write_batch(batch.cast(schema))
                n += batch.num_rows
        if n:
            data = sink.getvalue()
            ends = pa.array([0, data.size], pa.int32()).buffers()[1]
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), 1, [None, ends, data])], names=[name])

    return rows.repartition(of).mapInArrow(tidy(pack), f"{name} binary").checkpoint()


def crossed(asked: DataFrame, rows: DataFrame, dim: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_bytes: int = BLOCK_BYTES, more: int = 0) -> DataFrame:
    """What run gives for every block of ``asked`` with every block of ``rows``.

    Vectors of ``dim`` doubles (and ``more`` numbers that a row of ``asked`` holds or gives) make blocks of bounded bytes, which are kept once in the
    checkpoint folder. Each pair of blocks is a task of a Cartesian product of these
    files: nothing passes the driver, executors' memory does not grow with the tables,
    and no copy of a vector is shuffled, so that the disk grows with the vectors.
    """
    size = max(1, block_bytes // (8 * max(1, dim)))
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-asked.count() * 8 * max(1, dim + more) // block_bytes))
    parts = max(1, -(-n // (4 * size)), min(-(-2 * cores // blocks), -(-n // 256)))
    left, right = _packed(asked, blocks, "_l"), _packed(rows, parts, "_r")

    def cell(batches: Batches) -> Batches:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                yield from run(*(pa.ipc.open_stream(x.as_buffer()).read_all() for x in (a, b))).to_batches()

    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(tidy(cell), schema)


def placed(rows: DataFrame, group: str, *order: str | Column) -> DataFrame:
    """rows with _p, the place in their group by ``order`` (from 0), and _n, the group's size; rows whose group is null go.

    Rows are sorted by ranges of (group, order), so that a large group is dealt over
    many tasks: a row's place is that in its range, plus its group's rows before it.
    """
    prepare(rows.sparkSession)
    spread = rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = spread.groupBy("_part", group).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group)
    before = F.sum("_c").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", group, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_c").over(w).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order)) - 1
    return spread.withColumn("_p", inside).join(starts, ["_part", group]).withColumn("_p", F.col("_p") + F.col("_before")).drop("_part", "_before")
