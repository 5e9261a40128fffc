"""Clusters: sizes, vocabulary, composition, agreement of two clusterings, samples and label prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.stats import pairs_of, ratio
from lexigrid.functions.text import TITLE_PATTERN, TITLE_STOP_WORDS, terms
from lexigrid.runtime import placed

# The two families of venues.
LANGUAGE_VENUES, LEARNING_VENUES = ["acl", "emnlp", "naacl"], ["neurips", "icml", "iclr"]


def sizes(assigned: DataFrame, label: str = "leaf") -> DataFrame:
    return assigned.filter(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"))


def summary(assigned: DataFrame, label: str = "leaf") -> DataFrame:
    """Number of clusters, noise part, median and largest size."""
    n = assigned.groupBy(label).agg(F.count("*").alias("n"))
    real = F.when(F.col(label) >= 0, F.col("n"))
    noise = F.coalesce(F.sum(F.when(F.col(label) < 0, F.col("n"))), F.lit(0))
    return n.agg(F.count(real).alias("clusters"), ratio(noise, F.sum("n")).alias("noise"), F.percentile(real, F.lit(0.5)).alias("median_size"), F.max(real).alias("max_size"))


def ctfidf(docs: DataFrame, text: str = "text", label: str = "leaf", k: int = 10) -> DataFrame:
    """The k terms of highest class-based TF-IDF of each cluster: (count / cluster's terms) * ln(1 + clusters / clusters with the term).

    Terms are counted by cluster before anything else is joined, so what follows
    has a row per (cluster, term). Ties go to the smaller term.
    """
    rows = docs.filter(F.col(label) >= 0)
    tf = rows.select(F.col(label).alias("cluster"), F.explode(terms(F.col(text))).alias("term")).groupBy("cluster", "term").agg(F.count("*").alias("count"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    size = tf.groupBy("cluster").agg(F.sum("count").alias("size"))
    many = rows.agg(F.countDistinct(label).alias("clusters"))
    scored = tf.join(df, "term").join(size, "cluster").crossJoin(F.broadcast(many))  # many: one row
    score = ratio(F.col("count"), F.col("size")) * F.log(1 + ratio(F.col("clusters"), F.col("df")))
    w = Window.partitionBy("cluster").orderBy(F.desc("score"), "term")
    return scored.select("cluster", "term", "count", score.alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def common_title_terms(docs: DataFrame, label: str = "leaf", k: int = 3, name: str = "label") -> DataFrame:
    """A plain label: the k commonest title terms of each cluster, or "Unlabelled"."""
    rows = docs.filter(F.col(label) >= 0)
    counts = rows.select(label, F.explode(terms(F.col("title"), TITLE_PATTERN, TITLE_STOP_WORDS)).alias("term")).groupBy(label, "term").agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("n"), "term"))).filter(F.col("r") <= k)
    named = top.groupBy(label).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), " / ").alias(name))
    return rows.select(label).distinct().join(named, label, "left").withColumn(name, F.coalesce(name, F.lit("Unlabelled")))


def composition(docs: DataFrame, label: str = "leaf", by: str = "venue") -> DataFrame:
    """Members of each cluster by venue, as an ordered map and as its text."""
    n = docs.filter(F.col(label) >= 0).groupBy(label, by).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col(by).alias("v"))))
    out = n.groupBy(label).agg(F.sum("n").alias("n"), listed.alias("_l"))
    pairs = F.transform("_l", lambda x: F.struct(x["v"], -x["neg"]))
    said = F.array_join(F.transform("_l", lambda x: F.concat(x["v"], F.lit(":"), (-x["neg"]).cast("string"))), ",")
    return out.select(label, "n", F.map_from_entries(pairs).alias("breakdown"), said.alias("breakdown_text"))


def cross_index(docs: DataFrame, label: str = "leaf", by: str = "venue", one: list[str] | None = None, other: list[str] | None = None) -> DataFrame:
    """Parts of two families of venues in each cluster, and twice the smaller: 1 is an even mix."""
    part = lambda names: F.avg(F.col(by).isin(names).cast("double"))
    out = docs.filter(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"), part(one or LANGUAGE_VENUES).alias("one_frac"), part(other or LEARNING_VENUES).alias("other_frac"))
    return out.withColumn("cross_index", 2 * F.least("one_frac", "other_frac"))


def nesting(assigned: DataFrame, fine: str, coarse: str) -> DataFrame:
    """Part of the papers of fine clusters that lie in their cluster's main coarse one (noise of coarse is one too)."""
    n = assigned.filter(F.col(fine) >= 0).groupBy(fine, coarse).agg(F.count("*").alias("n"))
    best = n.groupBy(fine).agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.agg(ratio(F.sum("best"), F.sum("n")).alias("nesting"))


def adjusted_rand(assigned: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings of the same rows; noise is a label like any; 1 where it is undefined."""
    cell = assigned.groupBy(a, b).agg(F.count("*").alias("n"))
    sums = lambda df: F.coalesce(F.sum(pairs_of(F.col("n"))), F.lit(0.0))
    index = cell.agg(sums(cell).alias("both"), F.sum("n").alias("total"))
    sides = [cell.groupBy(c).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs_of(F.col("n"))), F.lit(0.0)).alias(s)) for c, s in ((a, "sa"), (b, "sb"))]
    row = index.crossJoin(F.broadcast(sides[0])).crossJoin(F.broadcast(sides[1]))  # one row each
    expected = ratio(F.col("sa") * F.col("sb"), pairs_of(F.col("total")))
    most = (F.col("sa") + F.col("sb")) / 2
    return row.select(F.coalesce(F.try_divide(F.col("both") - expected, most - expected), F.lit(1.0)).alias("ari"))


def strided_titles(docs: DataFrame, label: str = "leaf", k: int = 8, order: str = "doc_id") -> DataFrame:
    """k titles of each cluster at even steps, the step being its size divided by k (1 at least)."""
    rows = docs.filter(F.col(label) >= 0)
    spots = placed(rows.select(label, order, "title"), label, order).withColumn("_step", F.greatest(F.lit(1), F.floor(F.col("_n") / k)))
    return spots.filter((F.col("_p") % F.col("_step") == 0) & (F.col("_p") < F.col("_step") * k)).select(label, order, "title", (F.col("_p") / F.col("_step")).cast("int").alias("place"))


PROMPT = "Name the topic of a group of research papers in four to eight words, specific and technical, without quotation marks.\n\nIts distinguishing terms, the most distinctive first:\n%s\n\nSome of its titles:\n%s\n\nAnswer with the name alone."


def prompts(vocabulary: DataFrame, titles: DataFrame, label: str = "leaf", template: str = PROMPT) -> DataFrame:
    """A prompt per cluster from its terms (cluster, term, rank) and sample titles (label, place, title)."""
    words = vocabulary.groupBy(F.col("cluster").alias(label)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("terms"))
    lines = titles.groupBy(label).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: F.concat(F.lit("- "), x["title"])), "\n").alias("titles"))
    return words.join(lines, label, "left").select(label, F.format_string(template, "terms", F.coalesce("titles", F.lit(""))).alias("prompt"))


def labelled_by(prompt: DataFrame, call: Callable[[Column], Column] | None, fallback: DataFrame, label: str = "leaf") -> DataFrame:
    """A name per cluster from ``call`` (a column function around a model), else the fallback's label."""
    if call is None:
        return prompt.select(label).join(fallback, label, "left")
    return prompt.select(label, F.btrim(F.trim(call(F.col("prompt"))), F.lit('"')).alias("label"))


def sweep(assigned: DataFrame, fine: str, cuts: list[str]) -> DataFrame:
    """For each coarser labelling: clusters, noise and nesting of the fine one."""
    out = None
    for cut in cuts:
        row = summary(assigned, cut).crossJoin(F.broadcast(nesting(assigned, fine, cut))).withColumn("cut", F.lit(cut))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def seed_stability(assigned: DataFrame, labels: list[str]) -> DataFrame:
    """Adjusted Rand index of every pair of labellings."""
    out = None
    for i, a in enumerate(labels):
        for b in labels[i + 1 :]:
            row = adjusted_rand(assigned, a, b).withColumns({"a": F.lit(a), "b": F.lit(b)})
            out = row if out is None else out.unionByName(row)
    return out
