"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector, less the mean of all, is rotated by one random orthogonal matrix;
the signs of the result are its code, packed to bits, and two scalars correct
for its length and for what the code lost. A query's inner product with a vector
is estimated from the packed code and those scalars, with an error bound: for each
byte of a code, a table of 256 sums of the query's components tells what it adds,
so codes are never unpacked and a vector costs an addition per eight dimensions. Only
vectors whose upper bound reaches the query's twentieth best exact product so
far are reranked by exact products on the original vectors, in double precision.

The index (codes, scalars and vectors) is written once in the shared folder.
Blocks of queries meet blocks of the index in the tasks of one job; each
keeps its best per query. No vector or query passes the driver.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite
component take no part, nor do those of another length than the commonest (the
smaller of equals); null ids take no part; rows that repeat an id are one vector
(the smallest); equal products go to the smaller id; a query has fewer than k
rows if there are fewer other vectors; empty tables give empty results; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.runtime import BLOCK_BYTES, crossed

from .runtime import maybe_broadcast, prepare, tidy

#: Standard deviations of the estimate that the error bound spans.
SIGMAS = 4.0
#: Repeated ids up to this many are broadcast, so that no vector of another id is shuffled for them.
BROADCAST_ROWS = 500_000
_ROWS, _QUERIES = 4096, 256
#: The signs that each byte of a code stands for.
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def usable(vectors: DataFrame) -> DataFrame:
    """id and vec of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), x.alias("vec"))
    size = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.filter(F.size("vec") == (size["d"] if size else -1))
    again = maybe_broadcast(rows.groupBy("id").count().filter("count > 1").select("id"), BROADCAST_ROWS)
    merged = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("vec").alias("vec"))
    return rows.join(again, "id", "left_anti").unionByName(merged)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, center: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, length, and the code's inner product with the unit vector."""
    y = (x - center) @ rotate.T
    length = np.linalg.norm(y, axis=1)
    lost = np.abs(y).sum(1) / (np.sqrt(x.shape[1]) * np.where(length > 0, length, 1))
    return np.packbits(y > 0, axis=1), length, np.where(length > 0, lost, 1.0)


def estimate(codes: np.ndarray, length: np.ndarray, lost: np.ndarray, base: np.ndarray, q: np.ndarray, center: np.ndarray, rotate: np.ndarray, sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors) and their error bounds; base: products of the queries with the mean."""
    dim = q.shape[1]
    turned = np.zeros((len(q), 8 * codes.shape[1]), np.float32)  # a code's spare bits meet zeros
    turned[:, :dim] = q @ rotate.T / np.sqrt(dim)
    total = np.zeros((len(codes), len(q)), np.float32)
    for b in range(codes.shape[1]):
        total += (_SIGNS @ turned[:, 8 * b : 8 * b + 8].T)[codes[:, b]]
    guess = np.ascontiguousarray(total.T) * (length / lost).astype(np.float32) + base.astype(np.float32)[:, None]
    error = (length * np.sqrt(np.maximum(1 - lost**2, 0)) / lost).astype(np.float32)
    bound = (sigmas / np.sqrt(max(dim - 1, 1)) * np.linalg.norm(q, axis=1)).astype(np.float32)[:, None] * error
    return guess, bound + np.float32(1e-5) * (1 + np.abs(guess))


def build_index(vectors: DataFrame, seed: int = 7) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The index table, the mean of all vectors and the rotation."""
    prepare(vectors.sparkSession)
    rows = usable(vectors).checkpoint()
    means = rows.select(F.posexplode("vec")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()  # a row per dimension
    center = np.array([r["m"] for r in means])
    rotate = rotation(len(center), seed) if len(center) else np.zeros((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(center))
                codes, length, lost = encode(x, center, rotate)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(lost)], names=["id", "vec", "code", "length", "lost"])

    return rows.mapInArrow(tidy(run), "id long, vec array<double>, code binary, length double, lost double").checkpoint(), center, rotate


def _cell(k: int, center: np.ndarray, rotate: np.ndarray, sigmas: float):
    """The k best that each of a block of queries finds in a block of the index."""
    dim = len(center)

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def run(asked: pa.Table, index: pa.Table) -> pa.Table:
        ids = asked["id"].to_numpy()
        best = np.full((len(ids), k), -np.inf)
        owner = np.full((len(ids), k), np.iinfo(np.int64).max)
        if len(ids) and index.num_rows:
            q, x, names = matrix(asked["vec"]), matrix(index["vec"]), index["id"].to_numpy()
            codes = np.frombuffer(b"".join(index["code"].to_pylist()), np.uint8).reshape(len(names), -1)
            length, lost, base = index["length"].to_numpy(), index["lost"].to_numpy(), q @ center
            for j in range(0, len(ids), _QUERIES):
                block = slice(j, j + _QUERIES)
                for i in range(0, len(names), _ROWS):
                    part = slice(i, i + _ROWS)
                    guess, bound = estimate(codes[part], length[part], lost[part], base[block], q[block], center, rotate, sigmas)
                    guess[ids[block][:, None] == names[part]] = -np.inf
                    _rerank(guess, bound, x[part], names[part], q[block], best[block], owner[block], k)
        r, c = np.nonzero(np.isfinite(best))
        return pa.table({"query_id": ids[r], "vec_id": owner[r, c], "score": best[r, c]})

    return run


def _rerank(guess, bound, x, names, q, best, owner, k) -> None:
    """Update best and owner (each query's k best so far) by the vectors that their bounds choose."""
    top = min(k, guess.shape[1])
    lead = np.argpartition(-guess, top - 1, axis=1)[:, :top] if top < guess.shape[1] else np.broadcast_to(np.arange(top), (len(q), top))
    sure = np.sort(np.einsum("qkd,qd->qk", x[lead], q), axis=1) if top == k else None
    for r in range(len(q)):
        least = best[r, -1]
        if sure is not None and np.isfinite(guess[r, lead[r]]).all():
            least = max(least, sure[r, 0])
        near = np.flatnonzero((guess[r] + bound[r] >= least) & np.isfinite(guess[r]))
        if not len(near):
            continue
        exact = x[near] @ q[r]
        score, name = np.concatenate((best[r], exact)), np.concatenate((owner[r], names[near]))
        keep = np.lexsort((name, -score))[:k]
        best[r], owner[r] = score[keep], name[keep]


def search(vectors: DataFrame, every: int = 20, k: int = 20, sigmas: float = SIGMAS, seed: int = 7, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row whose id is divisible by ``every``."""
    index, center, rotate = build_index(vectors, seed)
    asked = index.filter(F.col("id") % every == 0).select("id", "vec")
    found = crossed(asked, index, len(center), _cell(k, center, rotate, sigmas), "query_id long, vec_id long, score double", block_bytes)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
