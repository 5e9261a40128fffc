"""Keys, coverage and agreement between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.stats import ratio


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df, or an error that names a repeated key."""
    if first := duplicate_keys(df, key).orderBy(key).first():
        raise ValueError(f"duplicate {key}: {first[key]}")
    return df


def id_mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids of one side only, with that side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("only_in", F.lit("right")))


def require_same_ids(left: DataFrame, right: DataFrame, key: str) -> None:
    if not id_mismatch(left, right, key).isEmpty():
        raise ValueError(f"the {key} values of the two sides do not match")


def accepted(submissions: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Submissions whose key is in the index."""
    return submissions.join(index.select(key).distinct(), key, "left_semi")


def missing(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of df that are not done yet."""
    return df.join(done.select(key), key, "left_anti")


def agreement(ours: DataFrame, theirs: DataFrame, by: str, key: str) -> DataFrame:
    """Per group: distinct keys of both sides, shared ones, recall (of theirs) and confirmation (of ours)."""
    a = ours.select(by, key).distinct().withColumn("o", F.lit(1))
    b = theirs.select(by, key).distinct().withColumn("t", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True).groupBy(by, key).agg(F.max("o").alias("o"), F.max("t").alias("t"))
    out = both.groupBy(by).agg(F.count("o").alias("n_ours"), F.count("t").alias("n_theirs"), F.count(F.when(F.col("o").isNotNull() & F.col("t").isNotNull(), 1)).alias("matched"))
    return out.withColumns({"recall": ratio(F.col("matched"), F.col("n_theirs")), "confirmation": ratio(F.col("matched"), F.col("n_ours"))})


def agreement_with_all(ours: DataFrame, theirs: DataFrame, groups: DataFrame, by: str, key: str) -> DataFrame:
    """agreement where every group is held against all of theirs (key): joined on the key first, grouped after."""
    told = theirs.select(key).distinct().withColumn("t", F.lit(1))
    own = ours.select(by, key).distinct().join(told, key, "left").groupBy(by).agg(F.count("*").alias("n_ours"), F.count("t").alias("matched"))
    rows = groups.select(by).distinct().join(own, by, "left").fillna(0, ["n_ours", "matched"])
    out = rows.crossJoin(F.broadcast(told.agg(F.count("*").alias("n_theirs"))))  # one row
    return out.select(by, "n_ours", "n_theirs", "matched", ratio(F.col("matched"), F.col("n_theirs")).alias("recall"), ratio(F.col("matched"), F.col("n_ours")).alias("confirmation"))


def unmatched_sample(ours: DataFrame, theirs: DataFrame, by: str, key: str, k: int = 2) -> DataFrame:
    """Per group the first k keys of theirs (by, key) that we lack."""
    from pyspark.sql import Window

    lacking = theirs.select(by, key).distinct().join(ours.select(by, key), [by, key], "left_anti")
    return lacking.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(key))).filter(F.col("k") <= k)


def coverage(papers: DataFrame) -> DataFrame:
    """Per venue and year: papers, those with an abstract and with keywords, and the source."""
    return papers.groupBy("venue", "year").agg(
        F.count("*").alias("n_papers"), F.count_if(F.length(F.trim("abstract")) > 0).alias("n_with_abstract"),
        F.count_if(F.size("keywords") > 0).alias("n_with_keywords"), F.min("source").alias("source"),
    )


def manifest(papers: DataFrame, absent: DataFrame) -> DataFrame:
    """Coverage, and rows of no papers with their reason (venue, year, note) for what is absent by design."""
    have = coverage(papers).withColumns({"complete": F.lit(True), "note": F.lit(None).cast("string")})
    lacking = absent.select("venue", "year", "note").join(have.select("venue", "year"), ["venue", "year"], "left_anti")
    zero = {c: F.lit(0).cast("long") for c in ("n_papers", "n_with_abstract", "n_with_keywords")}
    return have.unionByName(lacking.withColumns({**zero, "source": F.lit(None).cast("string"), "complete": F.lit(False)}))


def absent_cells(papers: DataFrame, venues: DataFrame, years: DataFrame, reasons: DataFrame) -> DataFrame:
    """Pairs of the venues' and years' grid without papers, with the reason if one is known."""
    grid = venues.select("venue").distinct().crossJoin(F.broadcast(years.select("year").distinct()))  # two short lists
    have = papers.select("venue", "year").distinct()
    return grid.join(have, ["venue", "year"], "left_anti").join(reasons.select("venue", "year", "note"), ["venue", "year"], "left").withColumn("note", F.coalesce("note", F.lit("unexpected")))


def drift(papers: DataFrame, expected: DataFrame) -> DataFrame:
    """Papers against the configured number, by venue and year."""
    n = papers.groupBy("venue", "year").agg(F.count("*").alias("n_papers"))
    return expected.select("venue", "year", "expected").join(n, ["venue", "year"], "left").withColumn("n_papers", F.coalesce("n_papers", F.lit(0).cast("long"))).withColumn("drift", F.col("n_papers") - F.col("expected"))


def absent_volumes(volumes: DataFrame, required: DataFrame) -> DataFrame:
    """Documents (name) that lack a required volume: the guard against a wrong document."""
    have = volumes.groupBy("name").agg(F.collect_set("volume").alias("have"))
    need = required.groupBy("name").agg(F.collect_set("volume").alias("need"))
    lacking = F.array_sort(F.array_except("need", F.coalesce("have", F.array().cast("array<string>"))))
    return need.join(have, "name", "left").select("name", lacking.alias("lacking")).filter(F.size("lacking") > 0)


def front_matter(pages: str):
    """Whether a page range is that of a paper: it starts with a digit."""
    return F.coalesce(F.col(pages).rlike(r"^\s*\d"), F.lit(False))
