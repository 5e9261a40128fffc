"""Language identification by words first, backing off to shorter character n-grams.

A word of the learned lexicon adds its log frequency in each language. A word
that is not there adds the mean log frequency of its longest character n-grams
that are known (with marks for its two ends), n falling from LONGEST to 1. A
text's language has the greatest sum; its score is that language's share under
a softmax of the sums, tempered by the number of words.

The model is fitted on at most PER_LANGUAGE documents of each language, those of
the smallest hashes of doc_id (in each of BUCKETS buckets of ids) among documents
that are not held out, and keeps every word and n-gram of them: what a model holds is
bounded by the examples alone. Prediction covers every text whole and reads nothing
but the text.

Edge cases: a null text or one without a letter is ``und`` with score 0; a
letter in no known n-gram leaves the prior to decide; equal sums go to the
alphabetically first language; null languages, texts and doc_ids teach nothing;
without any example every text is ``und``; repeated rows are predicted alike; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import prepare, tidy

PER_LANGUAGE, BUCKETS, LONGEST = 2_048, 64, 5
#: Unknown words whose result a worker remembers before it starts anew.
REMEMBERED = 200_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [word[i : i + 1] for i in range(len(word))] if n == 1 else [marked[i : i + n] for i in range(len(marked) - n + 1)]


def held_out(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _matrix(counts: dict[str, list[int]], languages: list[str]) -> np.ndarray:
    return np.array(list(counts.values()), float).reshape(len(counts), len(languages))


class BackoffModel:
    """words and grams: text -> counts by language, in the order of languages."""

    def __init__(self, languages: list[str], priors: list[float], words: dict[str, list[int]], grams: dict[str, list[int]]):
        self.languages, self.n_words = languages, len(words)
        self.prior = np.log(np.array(priors, float)) if languages else np.zeros(0)
        self.words = {w: k for k, w in enumerate(words)}
        self.table = self._logs(_matrix(words, languages))
        self.grams: dict[str, int] = {}
        parts, by_n = [], defaultdict(list)
        for g in grams:
            by_n[len(g)].append(g)
        for gs in by_n.values():
            self.grams.update(zip(gs, range(len(self.grams), len(self.grams) + len(gs)), strict=True))
            parts.append(self._logs(np.array([grams[g] for g in gs], float)))
        self.gram_table = np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, len(languages)), np.float32)

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.1) / (counts.sum(0) + 0.1 * max(1, len(counts)))) if counts.size else counts

    def backoff(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            if known := [self.grams[g] for g in grams_of(word, n) if g in self.grams]:
                return self.gram_table[known].mean(0, dtype=float)
        return np.zeros(len(self.languages))

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """Summed log frequencies (texts x languages) of the texts' words."""
        if len(self.words) > self.n_words + REMEMBERED:
            for w in list(self.words)[self.n_words :]:
                del self.words[w]
        flat = [w for ws in texts for w in ws]
        if new := list(dict.fromkeys(w for w in flat if w not in self.words)):
            first, last = len(self.words), len(self.words) + len(new)
            if last > len(self.table):  # grows by half at least, so that it is seldom copied
                self.table = np.concatenate((self.table, np.zeros((max(last - len(self.table), len(self.table) // 2), len(self.languages)))))
            self.words.update(zip(new, range(first, last), strict=True))
            self.table[first:last] = [self.backoff(w) for w in new]
        rows = self.table[np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))]
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in texts])
        return np.column_stack([np.bincount(owner, weights=rows[:, k], minlength=len(texts)) for k in range(len(self.languages))])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [words_of(x) if x else [] for x in texts]
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        sums = self.sums(words) + self.prior
        best = sums.argmax(1)
        n = np.array([len(ws) for ws in words])
        odds = (sums - sums.max(1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
        share = 1 / np.exp(odds).sum(1)
        none = [not ws and not any(map(str.isalpha, x or "")) for x, ws in zip(texts, words, strict=True)]
        return ["und" if u else self.languages[k] for u, k in zip(none, best, strict=True)], [0.0 if u else float(p) for u, p in zip(none, share, strict=True)]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of n-grams of words, by language; n-grams are counted once for each different word of a batch."""
    for batch in batches:
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words[lang].update(words_of(text))
        for lang, counts in words.items():
            kinds = [list(counts.items())] + [Counter() for _ in range(LONGEST)]
            for w, c in counts.items():
                for n in range(1, LONGEST + 1):
                    for g in grams_of(w, n):
                        kinds[n][g] += c
            for n, kind in enumerate(kinds):
                rows = kind if n == 0 else list(kind.items())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array([n] * len(rows), pa.int32()), pa.array([g for g, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], names=["lang", "n", "gram", "c"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> BackoffModel:
    """Fit on at most per_language documents of each language."""
    prepare(docs.sparkSession)
    # A language's share is dealt over buckets of ids, so that no task ranks a whole language.
    order = Window.partitionBy("lang", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id")
    usable = docs.filter("doc_id is not null and text is not null and lang is not null").filter(~held_out())
    dealt = usable.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(BUCKETS)).alias("bucket"))
    chosen = dealt.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= max(1, per_language // BUCKETS)).select("doc_id").distinct()
    seen = usable.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = seen.mapInArrow(tidy(_counter), "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    priors = {r["lang"]: r["c"] for r in seen.groupBy("lang").agg(F.count("*").alias("c")).collect()}
    languages = sorted(priors)
    counts = counts.checkpoint()

    def told(which: str) -> dict[str, list[int]]:
        """Every word or n-gram of the examples with its counts by language, in order of its text."""
        each = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("c"))), F.lit(0).cast("long")).alias(f"c{k}") for k, x in enumerate(languages)]
        rows = counts.filter(which).groupBy("gram").agg(*each).orderBy("gram").toArrow()
        return dict(zip(rows["gram"].to_pylist(), zip(*(rows[f"c{k}"].to_pylist() for k in range(len(languages))), strict=True), strict=True))

    total = sum(priors.values())
    return BackoffModel(languages, [priors[x] / total for x in languages], told("n = 0"), told("n > 0")) if languages else BackoffModel([], [], {}, {})


def predict(docs: DataFrame, model: BackoffModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # words and n-grams of a bounded number of documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                names, scores = model.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    cut = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return cut.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
