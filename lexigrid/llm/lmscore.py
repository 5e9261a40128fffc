"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from the SPAN tokens on either side of it; the summed
conditional log-probabilities score a document. The network is a log-bilinear
window model trained in numpy: the neighbours' embeddings, each turned by the
weights of its place, are summed, put through tanh, and give a distribution over
token classes in two steps, a group of classes and a class of the group. A class is
one of the commonest words or a bucket of rarer ones; there are as many as the square
root of the number of different words (LEAST_CLASSES at least), a quarter of them
buckets, so classes grow with the vocabulary. A word's probability is that of its
class times its share of the class's tokens.

What is gathered from the corpus covers all documents: the counts of all words
(aggregated by word before and after the shuffle) give classes and shares, and
the network, started on a bounded sample by the driver, is then trained on every
token of every document. For that the documents' classes are dealt to shards by a
hash of doc_id and text; a shard trains on its documents in the hash's order, and the
shards' weights are averaged by their number of tokens, in ROUNDS rounds that share
out the shards. The number of shards follows the square root of the number of tokens,
so neither partitions nor machines change a model by more than rounding. Every counted
word has a share of its own: the tasks hold those of the commonest (at most
VOCABULARY), and the tokens of all others are joined with the full counts. A word that
the corpus does not have is given the average share of its class's words beyond the
commonest.

Edge cases: a null, empty or wordless text has no token, log-likelihood 0 and a
null mean; neighbours beyond either end are a mark of their own; equal counts go
to the smaller hash; repeated rows are scored alike; without any token in the
corpus nothing is trained and all scores are 0; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .runtime import prepare, tidy

WIDTH, SPAN, LEAST_CLASSES = 16, 2, 128
#: Words whose shares are broadcast (the others' are joined), and documents that start the network.
VOCABULARY, SAMPLE = 60_000, 400
#: Rounds of training, and the tokens of which the number of shards is the square root of the count.
ROUNDS, SHARD_TOKENS = 2, 50_000
_U, _UNIT, _PART = np.uint64, 1 << 32, 4096


class WindowNetwork:
    """Class distributions from SPAN neighbours on each side; class c is place c % side of group c // side."""

    def __init__(self, classes: int, width: int = WIDTH, span: int = SPAN, seed: int = 5):
        r = np.random.default_rng(seed)
        self.classes, self.span, self.side = classes, span, int(np.ceil(np.sqrt(classes)))
        groups = -(-classes // self.side)
        self.embed = (r.standard_normal((2 * span, classes + 1, width)) * 0.1).astype(np.float32)  # one table per place; the last row is the edge
        self.group = (r.standard_normal((width, groups)) * 0.1).astype(np.float32)
        self.group_bias = np.zeros(groups, np.float32)
        self.out = (r.standard_normal((groups, width, self.side)) * 0.1).astype(np.float32)
        self.bias = np.zeros((groups, self.side), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.group, self.group_bias, self.out, self.bias]

    def places(self, g: int) -> int:
        """The number of classes of a group; the last may have fewer."""
        return min(self.side, self.classes - g * self.side)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        return np.tanh(sum(self.embed[k][around[:, k]] for k in range(2 * self.span)))

    def _by_group(self, target: np.ndarray):
        """The tokens in order of their class's group, and each group's slice of that order."""
        groups = target // self.side
        order = np.argsort(groups, kind="stable")
        edges = np.searchsorted(groups[order], np.arange(len(self.group_bias) + 1))
        return order, [(g, slice(i, j)) for g, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]

    def log_probs(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each token's class given its neighbours' classes."""
        order, slices = self._by_group(target)
        h, t = self.hidden(around[order]), target[order]
        got = _log_softmax_at(h @ self.group + self.group_bias, t // self.side)
        for g, s in slices:
            n = self.places(g)
            got[s] += _log_softmax_at(h[s] @ self.out[g][:, :n] + self.bias[g][:n], t[s] % self.side)
        out = np.empty_like(got)
        out[order] = got
        return out

    def train(self, around: np.ndarray, target: np.ndarray, rate: float = 0.4, batch: int = 256, most: int = 4096, seen: int = 0) -> None:
        """One pass of stochastic gradient steps. Batches grow from ``batch`` to ``most`` with the tokens seen, the rate with their square root."""
        width, first_batch, first_rate, i = self.embed.shape[2], batch, rate, 0
        while i < len(target):
            batch = min(most, max(first_batch, (seen + i) // 64))
            rate = first_rate * max(1.0, batch / 1024) ** 0.5
            order, slices = self._by_group(target[i : i + batch])
            a, t = around[i : i + batch][order], target[i : i + batch][order]
            h = self.hidden(a)
            p = _slope(h @ self.group + self.group_bias, t // self.side, rate / len(t))
            back = p @ self.group.T
            self.group -= h.T @ p
            self.group_bias -= p.sum(0)
            for g, s in slices:
                n = self.places(g)
                p = _slope(h[s] @ self.out[g][:, :n] + self.bias[g][:n], t[s] % self.side, rate / len(t))
                back[s] += p @ self.out[g][:, :n].T
                self.out[g][:, :n] -= h[s].T @ p
                self.bias[g][:n] -= p.sum(0)
            back *= 1 - h * h
            for k in range(2 * self.span):
                by = np.argsort(a[:, k], kind="stable")
                near = a[by, k]
                first = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1])))
                self.embed[k][near[first]] -= np.add.reduceat(back[by], first, axis=0).reshape(-1, width)
            i += batch


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    picked = z[np.arange(len(at)), at]
    return picked - np.log(np.exp(z, out=z).sum(1))


def _slope(z: np.ndarray, at: np.ndarray, rate: float) -> np.ndarray:
    """rate times the gradient of the negative log-softmax."""
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    z[np.arange(len(at)), at] -= 1
    z *= np.float32(rate)
    return z


def neighbours(classes: np.ndarray, counts: np.ndarray, span: int, edge: int) -> np.ndarray:
    """The classes around every token (tokens x 2 span), edge beyond its text's ends."""
    n = len(classes)
    doc = np.repeat(np.arange(len(counts)), counts)
    out = np.full((n, 2 * span), edge, np.int32)
    for k, step in enumerate([*range(-span, 0), *range(1, span + 1)]):
        here, there = (slice(-step, n), slice(0, n + step)) if step < 0 else (slice(0, n - step), slice(step, n))
        if n > abs(step):
            out[here, k] = np.where(doc[here] == doc[there], classes[there], edge)
    return out


class Lexicon:
    """Class and log share of known words (hashes in order), and of the rest on average; rare: word and c of each of the rest, if any."""

    rare: DataFrame | None = None

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rest_tokens: np.ndarray, rest_words: np.ndarray, common: int):
        rank = np.lexsort((hashes, -counts))
        n, self.buckets = min(common, len(hashes)), len(rest_tokens)
        classes = bucket_of(hashes, n, self.buckets)
        classes[rank[:n]] = np.arange(n)
        mass = np.bincount(classes, weights=counts, minlength=n + self.buckets)
        mass[n:] += rest_tokens
        order = np.argsort(hashes)
        self.size, self.n, self.tokens = n + self.buckets, n, int(counts.sum() + rest_tokens.sum())
        self.hashes, self.classes = hashes[order], classes[order].astype(np.int32)
        self.shares = np.log(counts[order] / mass[self.classes]).astype(np.float32)
        each = np.maximum(rest_tokens, 1) / np.maximum(rest_words, 1)
        self.rest = np.log(np.minimum(1.0, each / np.maximum(mass[n:], 1))).astype(np.float32)
        self.rest_mass = np.log(np.maximum(mass[n:], 1))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rare"}  # tables stay on the driver

    def gains(self) -> DataFrame:
        """What a rare word's own log share is above its bucket's average, in units of 1 / _UNIT, so that sums are the same in any order."""
        offsets = self.rare.sparkSession.createDataFrame([(b, float(x)) for b, x in enumerate(-self.rest_mass - self.rest)], "bucket int, offset double")
        rows = self.rare.withColumn("bucket", _bucket(self.buckets)).join(F.broadcast(offsets), "bucket")  # a row per bucket
        return rows.select("word", F.round((F.log("c") + F.col("offset")) * _UNIT).cast("long").alias("gain"))

    def knows(self, words: np.ndarray) -> np.ndarray:
        return self.hashes[np.minimum(np.searchsorted(self.hashes, words), max(len(self.hashes) - 1, 0))] == words

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, words), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == words
        classes = np.where(known, self.classes[at], bucket_of(words, self.n, self.buckets)).astype(np.int32)
        return classes, np.where(known, self.shares[at], self.rest[np.maximum(classes - self.n, 0)])


def bucket_of(words: np.ndarray, common: int, buckets: int) -> np.ndarray:
    return common + (words >> _U(40)).astype(np.int64) % buckets


def _bucket(buckets: int) -> Column:
    """The bucket of column word, from 0."""
    return F.pmod(F.shiftrightunsigned("word", 40), F.lit(buckets)).cast("int")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offsets = tk.text_buffers(batch.column(0))
        for i, j in tk.runs(offsets, 8 << 20):
            parts = [tk.word_hashes(values, offsets[a + i : b + i + 1])[0] for a, b in tk.runs(offsets[i : j + 1])]
            words, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "c"])


def lexicon(docs: DataFrame, common: int | None = None, vocabulary: int = VOCABULARY) -> Lexicon | None:
    """Counted over all documents; ``common`` words have a class of their own (by default as the vocabulary's size says); at most ``vocabulary`` words and the buckets' totals reach the driver, the rest stays a table."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(_count_words), "word long, c long").groupBy("word").agg(F.sum("c").alias("c")).checkpoint()
    # The least count that leaves at most ``vocabulary`` words comes from a histogram of counts; each task then sends its share.
    level = F.floor(F.log2("c") * 16).cast("int")
    sizes = sorted(((r["level"], r["k"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)  # some hundred rows
    least, total = None, 0
    for at, k in sizes:
        if total + k > vocabulary and least is not None:
            break
        least, total = at, total + k
    if least is None:
        return None
    classes = max(LEAST_CLASSES, int(np.ceil(np.sqrt(sum(k for _, k in sizes)))))
    buckets = classes // 4
    common = classes - buckets if common is None else common
    chosen = counts.filter(level >= least)
    known = (chosen if total <= vocabulary else chosen.orderBy(F.desc("c"), "word").limit(vocabulary)).toPandas()
    words, c = known["word"].to_numpy().view(_U), known["c"].to_numpy()
    rest = counts.filter(level < least)
    if total > vocabulary:  # one level of equal counts alone is larger than the vocabulary
        low, last = int(c[-1]), int(known["word"].iloc[-1])
        rest = counts.filter((F.col("c") < low) | ((F.col("c") == low) & (F.col("word") > last)))
    tokens, kinds = np.zeros(buckets), np.zeros(buckets)
    for r in rest.groupBy(_bucket(buckets).alias("b")).agg(F.sum("c").alias("t"), F.count("*").alias("k")).collect():
        tokens[r["b"]], kinds[r["b"]] = r["t"], r["k"]
    made = Lexicon(words, c, tokens, kinds, common)
    if kinds.any():
        made.rare = rest
    return made


def _classer(shared):
    """Each document's number of tokens and their classes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            values, offsets = tk.text_buffers(batch.column(1))
            for i, j in tk.runs(offsets):
                hashes, counts = tk.word_hashes(values, offsets[i : j + 1])
                classes, ends = words.look_up(hashes)[0].astype("<u4"), np.cumsum(counts)
                packed = [classes[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(packed, pa.binary())], names=["key", "classes"]).filter(pa.array(counts > 0))

    return run


def _trainer(shared, edge: int):
    """Weights of every shard of a partition, trained on its documents in the order in which they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, net, shard, seen = shared.value, None, None, 0
        held: list[bytes] = []

        def step() -> None:
            nonlocal seen, held
            counts = np.array([len(x) // 4 for x in held])
            classes = np.frombuffer(b"".join(held), "<u4").astype(np.int64)
            net.train(neighbours(classes, counts, net.span, edge), classes, seen=seen)
            seen, held = seen + len(classes), []

        def finished() -> Iterator[pa.RecordBatch]:
            if held:
                step()
            flat = np.concatenate([w.reshape(-1) for w in net.weights()]).astype(np.float64) * seen
            parts = [flat[i : i + _PART] for i in range(0, len(flat), _PART)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([shard] * len(parts), pa.int32()), pa.array(parts, pa.list_(pa.float64())), pa.array([float(seen)] * len(parts))], names=["part", "shard", "w", "n"])

        for batch in batches:
            size = 0
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != shard:
                    if net is not None:
                        yield from finished()
                    net, shard, seen, held, size = copy.deepcopy(start), s, 0, [], 0
                held.append(x)
                size += len(x)
                if size >= 1 << 20:
                    step()
                    size = 0
        if net is not None:
            yield from finished()

    return run


def _averaged(key: tuple, rows: pa.Table) -> pa.Table:
    """The shards' weights of one part, added in order of the shards."""
    rows = rows.sort_by("shard")
    w = np.array(rows["w"].combine_chunks().flatten()).reshape(rows.num_rows, -1)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([w.sum(0) / rows["n"].to_numpy().sum()], pa.list_(pa.float64()))})


def fit(docs: DataFrame, common: int | None = None, vocabulary: int = VOCABULARY, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[Lexicon, WindowNetwork] | None:
    """Lexicon and network of a corpus."""
    spark = prepare(docs.sparkSession)
    words = lexicon(docs, common, vocabulary)
    if words is None:
        return None
    net = WindowNetwork(words.size)
    text = F.col("text").cast("string")
    keyed = docs.select(F.xxhash64("doc_id", text).alias("key"), text.alias("text"))
    made = keyed.mapInArrow(tidy(_classer(spark.sparkContext.broadcast(words))), "key long, classes binary").checkpoint()
    first = made.orderBy("key", "classes").limit(sample).toArrow()["classes"].to_pylist()  # at most ``sample`` whole documents
    if first:
        counts = np.array([len(x) // 4 for x in first])
        classes = np.frombuffer(b"".join(first), "<u4").astype(np.int64)
        around, take = neighbours(classes, counts, net.span, words.size), np.random.default_rng(3).permutation(len(classes))
        net.train(around[take], classes[take], most=256)
    shards = rounds * max(1, round((words.tokens / SHARD_TOKENS) ** 0.5 / rounds))
    dealt = made.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(shards)).cast("int"))
    for r in range(rounds):
        mine = dealt.filter(F.col("shard") % rounds == r).repartitionByRange(max(1, shards // rounds), "shard").sortWithinPartitions("shard", "key", "classes").select("shard", "classes")
        trained = mine.mapInArrow(tidy(_trainer(spark.sparkContext.broadcast(net), words.size)), "part int, shard int, w array<double>, n double").groupBy("part").applyInArrow(_averaged, "part int, w array<double>")
        parts = trained.orderBy("part").toArrow()["w"].combine_chunks()  # one number per weight
        flat, at = np.array(parts.flatten()), 0
        for w in net.weights() if len(flat) else ():
            w[...] = flat[at : at + w.size].reshape(w.shape)
            at += w.size
    return words, net


def _scorer(shared, rare: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = shared.value
        for batch in batches:
            values, offsets = tk.text_buffers(batch.column(1))
            for i, j in tk.runs(offsets, 256 << 10):
                hashes, counts = tk.word_hashes(values, offsets[i : j + 1])
                classes, shares = words.look_up(hashes)
                around = neighbours(classes, counts, net.span, words.size)
                each = shares.astype(np.float64)
                for a in range(0, len(classes), 16384):
                    each[a : a + 16384] += net.log_probs(around[a : a + 16384], classes[a : a + 16384])
                total = np.bincount(np.repeat(np.arange(j - i), counts), weights=each, minlength=j - i).astype(np.float64)
                mean = pa.array(total / np.maximum(counts, 1), mask=counts == 0)
                columns = {"doc_id": batch.column(0).slice(i, j - i), "n_tokens": pa.array(counts), "log_likelihood": pa.array(total), "mean_log_likelihood": mean}
                if rare:
                    known = words.knows(hashes)
                    ends = np.concatenate(([0], np.cumsum(~known)))[np.concatenate(([0], np.cumsum(counts)))]
                    columns["rare"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes[~known].view(np.int64)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def score(docs: DataFrame, model: tuple[Lexicon, WindowNetwork] | None) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and mean_log_likelihood of every row."""
    spark = prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("log_likelihood"), F.lit(None).cast("double").alias("mean_log_likelihood"))
    shared = spark.sparkContext.broadcast(model)
    words, _ = model
    rare = words.rare is not None
    cut = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    made = cut.mapInArrow(tidy(_scorer(shared, rare)), f"doc_id {kind}, n_tokens long, log_likelihood double, mean_log_likelihood double" + ", rare array<long>" * rare)
    if not rare:
        return made
    # Rows are numbered before the checkpoint, so that both sides of the last join have the same numbers.
    made = made.withColumn("_r", F.monotonically_increasing_id()).checkpoint()
    gains = made.select("_r", F.explode("rare").alias("word")).join(words.gains(), "word").groupBy("_r").agg((F.sum("gain") / _UNIT).alias("gain"))
    total = F.col("log_likelihood") + F.coalesce("gain", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return made.drop("rare").join(gains, "_r", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"), mean.alias("mean_log_likelihood"))
