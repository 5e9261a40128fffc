"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every window of WINDOW consecutive words the minimum of its k-gram hashes is
its fingerprint (k = GRAM, so a window holds WINDOW - GRAM + 1 k-grams, and any
shared span of WINDOW words shares a fingerprint). Documents and benchmark meet
on distinct fingerprints; where a document has a fingerprint of the benchmark,
the windows around it are extended to their full words and joined on those, so
results do not rest on hashes. An item shorter than a window is one window of its
own length; documents are then read for windows of that length too.

The benchmark's fingerprints and windows, and the ids of documents that have
hits, are broadcast only if a count shows them to be few; else Spark shuffles.
Windows that the same items share are joined once, as a set of items that has a
name; the sets' items stay rows.

Edge cases: a null or empty text has no words and no hits; rows that repeat a
doc_id are counted for themselves and each gets a row, also with a null doc_id;
items with a null id are ignored; texts that repeat an item_id are one item;
empty tables give no hits or no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import maybe_broadcast, prepare

WINDOW, GRAM, CONTAMINATED = 8, 5, 2
#: Rows of fingerprints or windows, and values of hits, that are broadcast at most.
BROADCAST_ROWS, BROADCAST_VALUES = 200_000, 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words: of texts in lower case, and of any.
_BETWEEN, _BETWEEN_ANY = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _split(text: Column, separator: str) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), separator, -1)


def _inner(parts: Column) -> Column:
    """Parts without the empty ones that a separator at either end leaves."""
    first, last = (F.element_at(parts, i) == "" for i in (1, -1))
    return F.slice(parts, 1 + first.cast("int"), F.greatest(F.size(parts) - first.cast("int") - last.cast("int"), F.lit(0)))


def with_words(frame: DataFrame) -> DataFrame:
    """Adds words, the text's words in lower case; splitting is much cheaper than finding them."""
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    return frame.withColumn("parts", _split(lowered, _BETWEEN)).withColumn("words", _inner(F.col("parts"))).drop("parts")


def _first(array: Column, n: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(n, F.lit(0)))


def _gram_hash(k: int):
    return lambda x, i: F.xxhash64(x, *(F.get("hashes", i + j) for j in range(1, k)))


def _least_from(name: str, n: int):
    return lambda x, i: F.least(x, *(F.get(name, i + j) for j in range(1, n)))


def _start_if_in(prints: Column):
    return lambda fp, i: F.when(F.array_contains(prints, fp), i + 1)


def _hashed(frame: DataFrame, grams: list[int]) -> DataFrame:
    """Adds h<k>, the hashes of all runs of k words."""
    frame = frame.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    for k in grams:
        frame = frame.withColumn(f"h{k}", _first(F.transform("hashes", _gram_hash(k)), F.size("hashes") - (k - 1)))
    return frame.drop("hashes")


def _fingerprints(window: int, gram: int) -> Column:
    """The fingerprint of the window at each start; that of a short window is its own hash."""
    if window <= gram:
        return F.col(f"h{window}")
    inside = window - gram + 1
    return _first(F.transform(f"h{gram}", _least_from(f"h{gram}", inside)), F.size(f"h{gram}") - (inside - 1))


def _windows(frame: DataFrame, sizes: list[int], window: int, gram: int) -> DataFrame:
    """Adds f<n> for each window size."""
    need = sorted({min(n, gram) for n in sizes})
    frame = _hashed(frame, need)
    for n in sizes:
        frame = frame.withColumn(f"f{n}", _fingerprints(n, gram))
    return frame.drop(*(f"h{k}" for k in need))


def _text_of(start: Column, size: int) -> Column:
    return F.array_join(F.slice("words", start, size), " ")


def _broadcast_if_light(df: DataFrame, arrays: list[str]) -> DataFrame:
    """Hint a broadcast only once rows and their arrays' elements together are known to be few."""
    values = sum((F.coalesce(F.size(a), F.lit(0)) for a in arrays), F.lit(1))
    total = df.agg(F.coalesce(F.sum(values), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_VALUES else df


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with key and hash, which tell rows apart also where doc_id repeats or is null."""
    return docs.withColumns({"key": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "hash": F.xxhash64(F.col("text").cast("string"))})


class Benchmark:
    """A benchmark's window sizes and tables: prints (fp), spans (size, span, set_id) and sets (set_id, item_id)."""

    def __init__(self, benchmark: DataFrame, window: int, gram: int):
        parts = int(benchmark.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is told is kept, however few the bytes
        items = with_words(benchmark.filter("item_id is not null").select("item_id", "text")).drop("text").filter(F.size("words") > 0)
        items = items.withColumn("n", F.least(F.size("words"), F.lit(window))).repartition(parts, "item_id").checkpoint()
        self.window, self.gram = window, gram
        self.sizes = sorted({window, *(r["n"] for r in items.select("n").distinct().collect())})  # at most ``window`` numbers
        whole = None
        for n in self.sizes:
            part = _windows(items.filter(F.col("n") == n), [n], window, gram)
            part = part.select("item_id", F.lit(n).alias("size"), "words", F.posexplode(f"f{n}").alias("at", "fp")).select("item_id", "size", "fp", _text_of(F.col("at") + 1, n).alias("span"))
            whole = part if whole is None else whole.unionByName(part)
        whole = whole.distinct().checkpoint()
        # Windows of the same items have one set_id, made of the items' hashes, so that no window gathers its items.
        own = F.xxhash64(F.bit_xor(F.xxhash64("item_id")), F.bit_xor(F.xxhash64("item_id", F.lit(1))), F.count("*"))
        self.spans = whole.groupBy("size", "span").agg(own.alias("set_id")).checkpoint()
        one = self.spans.groupBy("set_id").agg(F.min(F.struct("size", "span")).alias("w")).select("set_id", "w.*")
        self.sets = whole.select("size", "span", "item_id").join(one, ["size", "span"]).select("set_id", "item_id").checkpoint()
        self.prints = whole.select("fp").distinct().checkpoint()

    def found(self, keyed: DataFrame) -> DataFrame:
        """Every window (key, hash, at, size, set_id) of keyed texts that items hold."""
        read = _windows(with_words(keyed.select("key", "hash", "text")).drop("text"), self.sizes, self.window, self.gram)
        own = F.array_distinct(F.concat(*(F.col(f"f{n}") for n in self.sizes)))
        met = read.select("key", "hash", F.explode(own).alias("fp")).join(maybe_broadcast(self.prints, BROADCAST_ROWS), "fp")
        hits = met.groupBy("key", "hash").agg(F.collect_set("fp").alias("prints")).checkpoint()
        seen = keyed.select("key", "hash", "text").join(_broadcast_if_light(hits, ["prints"]), ["key", "hash"])
        seen = _windows(with_words(seen).drop("text"), self.sizes, self.window, self.gram)
        starts = [F.transform(F.filter(F.transform(F.col(f"f{n}"), _start_if_in(F.col("prints"))), lambda i: i.isNotNull()), _sized(n)) for n in self.sizes]
        windows = seen.select("key", "hash", "words", F.explode(F.concat(*starts)).alias("w")).select("key", "hash", "w.*", _text_of(F.col("w.at"), F.col("w.size")).alias("span"))
        # Rows that repeat a document meet here, after its text has been left behind.
        return windows.join(maybe_broadcast(self.spans, BROADCAST_ROWS), ["size", "span"]).select("key", "hash", "at", "size", "set_id").distinct().checkpoint()

    def items_of(self, found: DataFrame) -> DataFrame:
        """key, hash and item_id of every item that a document holds windows of."""
        return found.select("key", "hash", "set_id").distinct().join(maybe_broadcast(self.sets, BROADCAST_ROWS), "set_id").select("key", "hash", "item_id").distinct()


def _sized(n: int):
    return lambda i: F.struct(i.alias("at"), F.lit(n).alias("size"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, contaminated: int = CONTAMINATED) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs."""
    prepare(docs.sparkSession)
    keyed, bench = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))), Benchmark(benchmark, window, gram)
    found = bench.found(keyed)
    reach = F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("end"))))
    start = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).alias("end"))
    covered = F.aggregate(
        reach, start,
        lambda acc, x: F.struct((acc["covered"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["at"], acc["end"]))).alias("covered"), F.greatest(acc["end"], x["end"]).alias("end")),
        lambda acc: acc["covered"],
    )
    n_hit = found.groupBy("key", "hash").agg(covered.alias("n_hit"))
    which = bench.items_of(found).groupBy("key", "hash").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    counted = keyed.withColumn("parts", _split(F.col("text"), _BETWEEN_ANY))
    counted = counted.select("doc_id", "key", "hash", F.size(_inner(F.col("parts"))).cast("long").alias("n_words"))
    out = counted.join(n_hit.join(which, ["key", "hash"]), ["key", "hash"], "left")
    n_items = F.coalesce(F.size("items"), F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_items >= contaminated).alias("contaminated"),
    )


def _without(text: Column, hit: Column) -> Column:
    """text less the words at the positions in hit, each with what separates it from the next word."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(_ANY_CASE), F.lit(0)).alias("every"), F.split(text, _ANY_CASE, -1).alias("between"), hit.alias("hit"))

    def joined(p: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(1), F.size(p["every"])), p["hit"])
        return F.concat(F.element_at(p["between"], 1), F.array_join(F.transform(kept, lambda i: F.concat(F.element_at(p["every"], i), F.element_at(p["between"], i + 1))), ""))

    return F.element_at(F.transform(F.array(parts), joined), 1)  # parts are split once, not for every word


def _hit_words(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy("key", "hash").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("size") - 1)))).alias(name))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, contaminated: int = CONTAMINATED) -> DataFrame:
    """docs without the rows that hold windows of ``contaminated`` items or more; from the others the hit words are cut.

    A cut takes each hit word and what separates it from the next word. Where a cut's
    sides make a window together, that is cut too, until no window is left. Columns
    stay as they are but for text and, where there is one, n_chars.
    """
    prepare(docs.sparkSession)
    bench = Benchmark(benchmark, window, gram)
    keyed = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("key", "hash", "text")
    found = bench.found(keyed)
    items = bench.items_of(found).groupBy("key", "hash").agg(F.count("*").alias("n_items"))
    marked, cuts = _hit_words(found, "cut1").join(items, ["key", "hash"]).checkpoint(), ["cut1"]

    def cut(text: Column) -> Column:
        for c in cuts:
            text = F.when(F.col(c).isNotNull(), _without(text, F.col(c))).otherwise(text)
        return text

    while True:
        left = keyed.join(_broadcast_if_light(marked.filter(F.col("n_items") < contaminated), cuts), ["key", "hash"]).withColumn("text", cut(F.col("text")))
        found = bench.found(left)
        if found.isEmpty():
            break
        name = f"cut{len(cuts) + 1}"
        marked = marked.join(_hit_words(found, name), ["key", "hash"], "left").checkpoint()
        cuts.append(name)
    # The rows are carried as one column, so that no name of theirs can clash with ours.
    carried = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))).drop("doc_id")
    joined = carried.join(_broadcast_if_light(marked, cuts), ["key", "hash"], "left").filter(F.col("n_items").isNull() | (F.col("n_items") < contaminated))
    hit = F.col("cut1").isNotNull()
    out = joined.withColumn("new", F.when(hit, cut(F.col("text"))))
    changed = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return out.select(*(F.when(hit, changed[c]).otherwise(F.col("row").getField(c)).alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns))
