"""Near-duplicate classes by BagMinHash over multisets of five-word shingles.

A text is the multiset of its runs of five words. Every (shingle, level) pair
owns a Poisson process whose points carry a time, a signature component and a
position inside the levels of the process; levels are discretised weights, put
into dyadic blocks (0,1], (1,2], (2,4], ... so that one process stands for a
block and a text with a smaller weight takes only the points whose position lies
below it. The first point of each component is the signature, and two signatures
agree in a component with the probability of the weighted Jaccard similarity.

Signatures are banded; candidates are verified by the exact multiset overlap of
the whole texts. Texts with equal multisets are one class before banding, so a
group of copies costs one member. Inside a bucket members are compared with its
smallest member first, and a bucket whose members all met by that (one large
group of near copies) emits no pairs. In the other buckets, members that lie in
different classes are compared pair by pair, the likely pairs first, so that
classes have grown together before the rest is looked at; no candidate link
between different classes is left out.

A sketch of two bits of each component, compared inside the join, spares pairs
whose similarity is far below the threshold: one that lies at it passes unless
its estimate errs by SIGMAS standard deviations (3 in 100,000). A link of
similarity ``s`` becomes a candidate with probability
``1 - (1 - s**rows)**bands``: 0.99997 at 0.8 for the defaults.

Every verified link joins two different texts; ``links`` returns them with their
similarity. A class of ``t`` different texts is held together by ``t - 1`` of them,
which is its n_links; copies are not linked to one another but named by the class.

Edge cases: a null, empty or wordless text has no shingle and is alone in its
class; a text of one to four words is one shingle; a document is a doc_id with a
text, so rows that repeat both are one, and different texts of one doc_id are
compared like any others and each have a row; a null doc_id gets a null class; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .runtime import maybe_broadcast, prepare, settled, tidy

BANDS, ROWS, SHINGLE, THRESHOLD = 26, 5, 5, 0.8
#: Signature components, and bits of each in a sketch of WORDS long integers. Pairs whose estimate is above
#: the threshold less MARGIN are the likely ones.
SIZE, BITS = 512, 2
WORDS, SIGMAS, MARGIN = SIZE * BITS // 64, 4.0, 0.015
#: Ids are broadcast up to this number (16 bytes each on the wire); above it Spark shuffles.
BROADCAST_IDS = 1_000_000
#: Pairs that share one copy of a text while they are verified.
SALT = 256
_U = np.uint64


def _multiset(hashes: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text with their counts, and the text of each."""
    edges = np.concatenate(([0], np.cumsum(made)))
    hashes = hashes.copy()
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        hashes[i:j].sort()
    docs = np.repeat(np.arange(len(made)), made)
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    return hashes[at], np.diff(np.append(at, len(hashes))), docs[at]


def bag_minhash(items: np.ndarray, weights: np.ndarray, docs: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """Signatures (n_docs x size, float32 times; infinite for an empty text) of weighted sets."""
    out = np.full((n_docs, size), np.inf)
    mass = np.bincount(docs, weights=weights, minlength=n_docs)
    seeds, owner, width, below = [items], [docs], [np.ones(len(items))], [np.ones(len(items))]
    low, block = 1, 1
    while (more := weights > low).any():  # levels (low, 2 * low]
        seeds.append(tk.mix64(items[more] + _U(block * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF)))
        owner.append(docs[more])
        width.append(np.full(int(more.sum()), float(low)))
        below.append(np.minimum(weights[more] - low, low).astype(float))
        low, block = low * 2, block + 1
    seeds, owner, width, below = map(np.concatenate, (seeds, owner, width, below))
    horizon = np.where(mass > 0, size * (np.log(size) + 3) / np.maximum(mass, 1), 0.0)
    todo = mass > 0
    while todo.any():
        take = todo[owner] if not todo.all() else slice(None)
        s, o, w, b = seeds[take], owner[take], width[take], below[take]
        x, step = np.zeros(len(s)), 0
        while len(s):
            step += 1
            z = tk.mix64(s + _U(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            x = x - np.log(((z >> _U(11)).astype(float) + 0.5) * 2.0**-53) / w
            live = np.flatnonzero(x < horizon[o])
            s, o, w, b, x, z = s[live], o[live], w[live], b[live], x[live], z[live]
            z = tk.mix64(z ^ _U(0xA0761D6478BD642F))
            part = ((z & _U(0xFFFFFFFF)) * _U(size)) >> _U(32)
            inside = (z >> _U(32)).astype(float) * 2.0**-32 * w < b
            np.minimum.at(out.reshape(-1), o[inside] * size + part[inside].astype(np.int64), x[inside])
        short = todo & np.isinf(out).any(axis=1)
        out[short] = np.inf
        horizon[short] *= 2
        todo = short
    return out.astype(np.float32)


def _band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint32).astype(_U).reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15), bits.shape[:2]).copy()
    for k in range(rows):
        out = tk.mix64(out * _U(0x9E3779B97F4A7C15) + bits[:, :, k])
    return out.view(np.int64)


def _sketches(signature: np.ndarray) -> np.ndarray:
    """BITS bits of every component, packed (texts x WORDS)."""
    code = tk.mix64(np.ascontiguousarray(signature).view(np.uint32).astype(_U)) & _U((1 << BITS) - 1)
    code = code.reshape(len(signature), WORDS, 64 // BITS) << (np.arange(64 // BITS, dtype=_U) * _U(BITS))
    return np.bitwise_or.reduce(code, axis=2).view(np.int64)


def most_different(similarity: float, sigmas: float) -> int:
    """Components in which sketches of texts of this similarity differ at most."""
    differ = (1 - similarity) * (1 - 2.0**-BITS)
    return int(SIZE * differ + sigmas * (SIZE * differ * (1 - differ)) ** 0.5)


def _near(left: str, right: str, more: int, most: int) -> Column:
    """Whether two sketches differ in more than ``more`` components and at most in ``most``."""
    total = F.lit(0)
    for k in range(WORDS):
        x = F.col(f"{left}.s{k}").bitwiseXOR(F.col(f"{right}.s{k}"))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total.between(more + 1, most)


def _signer(shingle: int, bands: int, rows: int):
    kept = pa.schema([("own", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("buckets", pa.list_(pa.int64())), *((f"s{k}", pa.int64()) for k in range(WORDS))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = tk.text_buffers(batch.column(2))
            for i, j in tk.runs(offsets):
                hashes, made = tk.shingle_hashes(*tk.word_hashes(values, offsets[i : j + 1]), shingle)
                items, weights, docs = _multiset(hashes, made)
                size = j - i
                a, b = np.zeros(size, _U), np.zeros(size, _U)
                np.add.at(a, docs, tk.mix64(items * _U(0xD6E8FEB86659FD93) + weights.astype(_U)))
                np.add.at(b, docs, tk.mix64(items ^ (weights.astype(_U) * _U(0xCA5A826395121157))))
                signature = bag_minhash(items, weights, docs, size, max(SIZE, bands * rows))
                got, sketch = _band_hashes(signature[:, : bands * rows], bands, rows), _sketches(signature[:, :SIZE])
                edges = pa.array(np.arange(size + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, size), batch.column(1).slice(i, size), pa.array(made.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.ListArray.from_arrays(edges, pa.array(got.reshape(-1))), *(pa.array(sketch[:, k]) for k in range(WORDS))],
                    schema=kept,
                )

    return sign


def _overlap(shingle: int):
    """Multiset Jaccard similarity of the two texts of each row."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = np.zeros(batch.num_rows)
            sides = [tk.text_buffers(batch.column(k)) for k in (2, 3)]
            step = max(1, batch.num_rows * tk.RUN_BYTES // max(1, sum(int(o[-1] - o[0]) for _, o in sides)))
            for i in range(0, batch.num_rows, step):
                j = min(i + step, batch.num_rows)
                bags = [_multiset(*tk.shingle_hashes(*tk.word_hashes(v, o[i : j + 1]), shingle)) for v, o in sides]
                items, counts, docs = (np.concatenate(x) for x in zip(*bags, strict=True))
                order = np.lexsort((items, docs))
                items, counts, docs = items[order], counts[order], docs[order]
                same = np.flatnonzero((items[1:] == items[:-1]) & (docs[1:] == docs[:-1]))
                shared = np.bincount(docs[same], weights=np.minimum(counts[same], counts[same + 1]), minlength=j - i)
                both = np.bincount(docs, weights=counts, minlength=j - i)
                sims[i:j] = shared / np.maximum(both - shared, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims)], names=["a", "b", "sim"])

    return verify


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """own (the doc_id), text_hash, n (shingles), key_a and key_b (128 bits that name the multiset), the band hashes and the sketch."""
    cut = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return cut.mapInArrow(tidy(_signer(shingle, bands, rows)), "own long, text_hash long, n long, key_a long, key_b long, buckets array<long>, " + ", ".join(f"s{k} long" for k in range(WORDS)))


class _Names:
    """Documents under keys of their own: the doc_id, or a new number for the further texts of a doc_id that has several.

    extra (own, text_hash, key) holds the latter, twice (doc_id) the keys of rows that
    repeat a doc_id and its text; both are None where all ids differ.
    """

    def __init__(self, signed: DataFrame):
        self.extra = self.twice = None
        if not signed.groupBy("own").count().filter("count > 1").limit(1).count():
            return
        told = settled(signed.groupBy("own", "text_hash").agg(F.count("*").alias("n")))
        main = told.groupBy("own").agg(F.min("text_hash").alias("main"), F.count("*").alias("texts")).filter("texts > 1").select("own", "main")
        more = told.join(main, "own").filter("text_hash <> main").select("own", "text_hash")
        low, high = signed.agg(F.min("own"), F.max("own")).first()
        number = F.monotonically_increasing_id()
        key = F.lit(high + 1) + number if high < 1 << 62 else F.lit(low - 1) - number
        self.extra = settled(more.withColumn("key", key))
        self.twice = settled(self.keyed(told.filter("n > 1")).select("doc_id"))

    def keyed(self, rows: DataFrame) -> DataFrame:
        """rows (own, text_hash, ...) with doc_id, their key."""
        if self.extra is None:
            return rows.withColumn("doc_id", F.col("own"))
        return rows.join(maybe_broadcast(self.extra, BROADCAST_IDS), ["own", "text_hash"], "left").withColumn("doc_id", F.coalesce("key", "own")).drop("key")

    def once(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, ...) without those that repeat a document; only repeated ones are shuffled."""
        if self.twice is None:
            return rows
        few = maybe_broadcast(self.twice, BROADCAST_IDS)
        return rows.join(few, "doc_id", "left_anti").unionByName(rows.join(few, "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    def texts(self, docs: DataFrame) -> DataFrame:
        """doc_id (the key) and text."""
        cut = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
        return self.keyed(cut).select("doc_id", "text")


def verified(pairs: DataFrame, docs: DataFrame, names: _Names, shingle: int, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose texts' overlap reaches the threshold, with it (sim).

    A text b of many pairs is copied to SALT pairs each, so that no task gets all of them.
    """
    sides = pairs.groupBy(F.col("a").alias("doc_id")).agg(F.lit(0).cast("long").alias("n")).unionByName(pairs.groupBy(F.col("b").alias("doc_id")).agg(F.count("*").alias("n")))
    ids = settled(sides.groupBy("doc_id").agg(F.ceil(F.sum("n") / SALT).cast("int").alias("copies")))
    one = names.once(names.texts(docs).join(maybe_broadcast(ids.select("doc_id"), BROADCAST_IDS), "doc_id", "left_semi"))
    hot = maybe_broadcast(ids.filter("copies > 1").select(F.col("doc_id").alias("b"), "copies"), BROADCAST_IDS)
    left = one.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = one.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).join(hot, "b", "left")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    dealt = pairs.join(hot, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    both = dealt.join(left, "a").join(right, ["b", "salt"]).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(tidy(_overlap(shingle)), "a long, b long, sim double").filter(F.col("sim") >= threshold)


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of the nodes of edges (a, b), by alternating large and small stars.

    Every round is two grouped minima, each with a join, and is cut by a checkpoint. A node
    that is the smallest of its component has no row.
    """
    edges = settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(edges):
        down, up, self = (F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ("uv", "vu", "uu"))
        both = edges.select(F.explode(F.array(down, up)).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        # u > v in every edge: a node's larger neighbours take its smallest one, and so does the node itself where it has smaller ones.
        large = edges.select(F.explode(F.array(up, self)).alias("e")).select("e.*").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array_distinct(F.array("u", "v"))).alias("u"), F.col("m").alias("v"))
        edges = settled(small.filter("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node u points to one v only, which points to none."""
    roles = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("points")), F.struct(F.col("v").alias("node"), F.lit(0).alias("points")))).alias("r")).select("r.*")
    nodes = roles.groupBy("node").agg(F.sum("points").alias("out"), F.count("*").alias("n"))
    return not nodes.agg(F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("n") > F.col("out"))))).first()[0]


def _merged(joined: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after further links, worked out between the components so far."""
    if joined is None:
        return components(links)
    for x in ("a", "b"):
        links = links.join(joined.select(F.col("node").alias(x), "component"), x, "left").withColumn(x, F.coalesce("component", x)).drop("component")
    new = components(links)
    moved = joined.join(new.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return settled(moved.unionByName(new.join(joined.select("node"), "node", "left_anti")))


def _grouped(docs: DataFrame, threshold: float, shingle: int, bands: int, rows: int) -> tuple[DataFrame, list[DataFrame], _Names]:
    """Every document (doc_id, own, text_hash, n, component, n_links), the verified links (a, b, sim) and the documents' names."""
    prepare(docs.sparkSession)
    sketch = [f"s{k}" for k in range(WORDS)]
    signed = settled(signatures(docs, shingle, bands, rows))
    names = _Names(signed)
    signed = names.once(names.keyed(signed))
    if names.twice is not None:
        signed = settled(signed)
    keyed = signed.select("doc_id", "own", "text_hash", "n", "key_a", "key_b")
    copies = settled(keyed.filter("n > 0").groupBy("key_a", "key_b", "n").agg(F.min("doc_id").alias("rep")))
    reps = signed.join(copies.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep")
    spread = reps.select("rep", "n", F.posexplode("buckets").alias("band", "bucket"))
    centers = spread.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("c"), F.count("*").alias("size")).filter("size > 1")
    shared = settled(spread.join(centers.select("bucket", F.col("c.rep").alias("center"), F.col("c.n").alias("center_n")), "bucket"))
    least = most_different(threshold, SIGMAS)

    def near_in_size(m: str, n: str) -> Column:
        return F.least(m, n) >= threshold * F.greatest(m, n)

    stars = shared.filter("rep <> center").filter(near_in_size("n", "center_n")).select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct()
    one, two = (reps.select(F.col("rep").alias(x), F.struct(*sketch).alias(f"{x}s")) for x in ("a", "b"))
    stars = settled(stars.join(one, "a").join(two, "b").filter(_near("as", "bs", -1, least)).select("a", "b"))
    links = [settled(verified(stars, docs, names, shingle, threshold))]
    joined = _merged(None, links[0].select("a", "b"))
    # Members of a bucket that did not meet are compared with all that lie in another class, the likely pairs first.
    likely = most_different(threshold - MARGIN, 0)
    for more, most in ((-1, likely), (likely, least)):
        new = settled(verified(_across(shared, joined, reps, sketch, more, most, near_in_size), docs, names, shingle, threshold))
        if not new.isEmpty():
            joined = _merged(joined, new.select("a", "b"))
            links.append(new)
    classes = settled(copies.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("key_a", "key_b", "n", F.coalesce("component", "rep").alias("component")))
    texts = classes.groupBy("component").agg((F.count("*") - 1).alias("n_links")).filter("n_links > 0")
    classes = classes.join(maybe_broadcast(texts, BROADCAST_IDS), "component", "left")
    out = keyed.join(classes, ["key_a", "key_b", "n"], "left")
    return out.select("doc_id", "own", "text_hash", "n", F.coalesce("component", "doc_id").alias("component"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), links, names


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (the class's smallest doc_id), is_kept (it stands for the class), n_shingles, n_links (of the class)."""
    found, _, names = _grouped(docs, threshold, shingle, bands, rows)
    found = found.withColumn("is_kept", F.col("doc_id") == F.col("component"))
    if names.extra is None:
        found = found.withColumn("class_id", F.col("component"))
    else:
        least = found.groupBy("component").agg(F.min("own").alias("class_id"))
        found = found.join(least, "component")
    out = found.select(F.col("own").alias("doc_id"), "class_id", F.col("n").alias("n_shingles"), "n_links", "is_kept")
    none = [F.lit(None).cast(t).alias(c) for c, t in out.dtypes]
    return out.unionByName(docs.filter(F.col("doc_id").isNull()).select(*none))


def links(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The verified links between different texts: doc_a, doc_b (the smallest doc_id that has each text) and similarity."""
    found, made, names = _grouped(docs, threshold, shingle, bands, rows)
    every = made[0]
    for x in made[1:]:
        every = every.unionByName(x)
    if names.extra is not None:
        for c in ("a", "b"):
            every = every.join(names.extra.select(F.col("key").alias(c), "own"), c, "left").withColumn(c, F.coalesce("own", c)).drop("own")
    return every.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), F.col("sim").alias("similarity")).distinct()


def _across(shared: DataFrame, joined: DataFrame, reps: DataFrame, sketch: list[str], more: int, most: int, near_in_size) -> DataFrame:
    """Pairs of members of one bucket that lie in different classes and whose sketches differ in more than ``more`` and at most ``most`` components.

    Only buckets of several classes take part, and in them the members outside the
    class of the smallest member are the one side; pairs with the bucket's center
    have been compared before.
    """
    named = shared.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "rep").alias("main")).filter("low <> high").select("bucket", "main")
    inside = named.join(mixed, "bucket").select("bucket", "band", "rep", "n", "component", "center", (F.col("component") == F.col("main")).alias("is_main"))
    inside = settled(inside.join(reps.select("rep", F.struct(*sketch).alias("s"), "buckets"), "rep"))
    minor = inside.filter("not is_main and rep <> center").select("bucket", "band", F.col("rep").alias("x"), F.col("n").alias("n_x"), F.col("component").alias("comp_x"), F.col("center").alias("center_x"), F.col("s").alias("sx"), F.col("buckets").alias("buckets_x"))
    other = inside.select("bucket", F.col("rep").alias("y"), F.col("n").alias("n_y"), F.col("component").alias("comp_y"), F.col("is_main").alias("main_y"), F.col("s").alias("sy"), F.col("buckets").alias("buckets_y"))
    # A pair comes from the first bucket that it shares; there it may be seen from both sides.
    before = F.arrays_overlap(F.slice("buckets_x", F.lit(1), F.col("band")), F.slice("buckets_y", F.lit(1), F.col("band")))
    meet = minor.join(other, "bucket").filter("comp_x <> comp_y and y <> center_x and (main_y or x > y)").filter(near_in_size("n_x", "n_y")).filter(_near("sx", "sy", more, most)).filter(~before)
    found = settled(meet.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))
    # Where Spark has split a hot bucket, the pairs lie in many small parts, each of which would be a task of every later shuffle.
    return found.coalesce(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs less the rows that another document of their near-duplicate class represents, with their columns as they are.

    Different texts of one doc_id are documents of their own; of rows that repeat a
    doc_id with its text, the one of the smallest hash of all columns stays. Rows
    without a doc_id stay.
    """
    found, _, names = _grouped(docs, THRESHOLD, SHINGLE, BANDS, ROWS)
    gone = maybe_broadcast(settled(found.filter("doc_id <> component").select(F.col("own").alias("gone_id"), F.col("text_hash").alias("gone_hash"))), BROADCAST_IDS)
    same = docs["doc_id"].cast("long") == gone["gone_id"]
    if names.extra is None:
        return docs.join(gone, same, "left_anti")
    rows = docs.join(gone, same & F.xxhash64(docs["text"]).eqNullSafe(gone["gone_hash"]), "left_anti")
    # The rows are carried as one column, so that no name of theirs can clash with ours.
    carried = rows.select(F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("text_hash"), F.struct("*").alias("row"))
    named = names.keyed(carried)
    few = maybe_broadcast(names.twice, BROADCAST_IDS)
    single = named.filter("doc_id is null").unionByName(named.join(few, "doc_id", "left_anti").filter("doc_id is not null"))
    one = named.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return single.select("row.*").unionByName(one.select("row.*"))
