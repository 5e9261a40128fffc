"""Counts and shares by venue, year and category; reliability rules; reports.

Everything stays in long form (venue, year, category, k, n); pivots are for the
edge. Zero cells of a present venue-year are kept, absent venue-years have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.stats import point_status, ratio, relative_width, wilson_half_width, year_window
from lexigrid.operators.hierarchy import UNCLUSTERED

OTHER = "Other"


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def share_within(counts: DataFrame, group: list[str], k: str = "n", name: str = "share") -> DataFrame:
    """Each row's part of its group's total, in percent."""
    return counts.withColumn(name, 100 * ratio(F.col(k), F.sum(k).over(Window.partitionBy(*group))))


def venue_years(trend: DataFrame) -> DataFrame:
    """Per venue and year: papers, labelled ones, noise and its rate."""
    out = trend.groupBy("venue", "year").agg(F.count("*").alias("n_total"), F.count_if(F.col("category") != UNCLUSTERED).alias("n_labeled"))
    out = out.withColumn("n_noise", F.col("n_total") - F.col("n_labeled"))
    return out.withColumn("noise_rate", ratio(F.col("n_noise"), F.col("n_total")))


def cells(trend: DataFrame) -> DataFrame:
    """venue, year, category, k, n for every category in every venue-year with labelled papers, zeros too."""
    k = count_by(trend.filter(F.col("category") != UNCLUSTERED), "venue", "year", "category", name="k")
    grid = k.groupBy("venue", "year").agg(F.sum("k").alias("n")).crossJoin(F.broadcast(k.select("category").distinct()))  # two short lists
    return grid.join(k, ["venue", "year", "category"], "left").select("venue", "year", "category", F.coalesce("k", F.lit(0).cast("long")).alias("k"), "n")


def pooled(cell: DataFrame) -> DataFrame:
    return cell.groupBy("category").agg(F.sum("k").alias("total"))


def top_categories(cell: DataFrame, n: int) -> DataFrame:
    """The n largest categories over all venues and years; ties by name."""
    return pooled(cell).orderBy(F.desc("total"), "category").limit(n)


def collapse(cell: DataFrame, top: DataFrame) -> DataFrame:
    """Every category outside the top set summed into OTHER, which every venue-year has."""
    named = cell.join(F.broadcast(top.select("category", F.lit(1).alias("_in"))), "category", "left")  # at most n rows
    category = F.when(F.col("_in").isNotNull(), F.col("category")).otherwise(OTHER)
    kept = named.withColumn("category", category).select("venue", "year", "category", "k", "n")
    spare = cell.select("venue", "year", F.lit(OTHER).alias("category"), F.lit(0).cast("long").alias("k"), "n").distinct()
    return kept.unionByName(spare).groupBy("venue", "year", "category").agg(F.sum("k").alias("k"), F.max("n").alias("n"))


def venue_against_pool(cell: DataFrame) -> DataFrame:
    """Share of each category in a venue, in all venues, and the gap in points."""
    own = share_within(cell.groupBy("venue", "category").agg(F.sum("k").alias("k")), ["venue"], "k", "venue_pct")
    total = pooled(cell)
    all_k = total.agg(F.sum("total").alias("all_k"))
    share = total.crossJoin(F.broadcast(all_k)).select("category", (100 * ratio(F.col("total"), F.col("all_k"))).alias("pooled_pct"))
    return own.join(share, "category").withColumn("gap_pp", F.col("venue_pct") - F.col("pooled_pct"))


def binned(cell: DataFrame, first: int = 2018, size: int = 2) -> DataFrame:
    """Counts summed inside windows of years (shares are taken after that), and the years that a window has."""
    return (
        cell.withColumn("window", year_window(F.col("year"), first, size)).groupBy("venue", "window", "category")
        .agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.countDistinct("year").alias("n_years_present"))
        .withColumnRenamed("window", "year")
    )


def described(cell: DataFrame, k: str = "k") -> DataFrame:
    """count, mean, std (of a sample), min, quartiles (linear) and max."""
    q = lambda p: F.percentile(k, F.lit(p))
    return cell.agg(F.count(k).alias("count"), F.avg(k).alias("mean"), F.stddev_samp(k).alias("std"), F.min(k).alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(k).alias("max"))


def small_cells(cell: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Numbers and parts of cells under 10, under 30 and of 0, overall or by group."""
    under = lambda n: F.avg((F.col("k") < n).cast("double"))
    return cell.groupBy(*(by or [])).agg(F.count("*").alias("cells"), F.count_if(F.col("k") < 10).alias("under10"), F.count_if(F.col("k") < 30).alias("under30"), F.count_if(F.col("k") == 0).alias("zero"), under(10).alias("part_under10"), under(30).alias("part_under30"))


def denominators(table: DataFrame, n: str = "n_labeled") -> DataFrame:
    """Smallest, median and largest denominator of each venue."""
    return table.groupBy("venue").agg(F.min(n).alias("min"), F.percentile(n, F.lit(0.5)).alias("median"), F.max(n).alias("max"))


def rules(cell: DataFrame) -> DataFrame:
    """Percent of each venue's cells that each rule would hide."""
    half = 100 * wilson_half_width(F.col("k"), F.col("n"))
    rel = relative_width(F.col("k"), F.col("n"))
    tests: dict[str, Column] = {"n_under30": F.col("n") < 30, "n_under50": F.col("n") < 50, "n_under100": F.col("n") < 100, "wilson_over5": half > 5, "wilson_over10": half > 10, "k_under30": F.col("k") < 30, "rel_over25": rel > 0.25, "rel_over50": rel > 0.5, "rel_over100": rel > 1}
    return cell.groupBy("venue").agg(*((100 * F.avg(t.cast("double"))).alias(name) for name, t in tests.items()))


def largest_bucket(cell: DataFrame) -> DataFrame:
    """Per venue and year the category of most papers (ties: the first by name) and its share."""
    best = cell.groupBy("venue", "year").agg(F.min(F.struct((-F.col("k")).alias("neg"), "category", "n")).alias("b"))
    return best.select("venue", "year", F.col("b.category").alias("category"), (100 * ratio(-F.col("b.neg"), F.col("b.n"))).alias("largest_pct"))


def points(cell: DataFrame) -> DataFrame:
    """share (percent), half_pp (Wilson half-width in points) and status of every cell."""
    k, n = F.col("k"), F.col("n")
    return cell.withColumns({"share": 100 * ratio(k, n), "half_pp": 100 * wilson_half_width(k, n), "status": point_status(k, n)})


def segments(point: DataFrame) -> DataFrame:
    """Drawn lines between the points of neighbouring years: neither may be hidden or absent.

    style is grey where an end is; run numbers the unbroken stretches of solid lines.
    """
    w = Window.partitionBy("venue", "category").orderBy("year")
    row = point.withColumns({"before": F.lag("status").over(w), "last": F.lag("year").over(w)})
    joined = (F.col("last") == F.col("year") - 1) & (F.col("status") != "hide") & (F.col("before") != "hide")
    lines = row.filter(joined).withColumn("style", F.when((F.col("status") == "grey") | (F.col("before") == "grey"), "grey").otherwise("solid"))
    starts = F.when((F.col("style") == "solid") & (F.lag("style").over(w) == "solid") & (F.lag("year").over(w) == F.col("last")), 0).otherwise(1)
    return lines.withColumn("_s", starts).withColumn("run", F.sum("_s").over(w)).select("venue", "category", F.col("last").alias("from_year"), F.col("year").alias("to_year"), "style", "run")


def reliability_notes(point: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per venue: part of its points that are not ok, whether that is most, and its largest category with its share."""
    part = point.groupBy("venue").agg(F.avg((F.col("status") != "ok").cast("double")).alias("unreliable"))
    size = share_within(point.groupBy("venue", "category").agg(F.sum("k").alias("k")), ["venue"], "k", "pct")
    big = size.groupBy("venue").agg(F.min(F.struct((-F.col("k")).alias("neg"), "category", "pct")).alias("b"))
    return part.join(big, "venue").select("venue", "unreliable", (F.col("unreliable") > threshold).alias("warn"), F.col("b.category").alias("largest"), F.col("b.pct").alias("largest_pct"))


def pivoted(df: DataFrame, index: str, columns: str, values: list, value: str, fill: float | None = None) -> DataFrame:
    """Wide form for the edge; the columns' values are given, so that none is collected."""
    out = df.groupBy(index).pivot(columns, values).agg(F.first(value))
    return out if fill is None else out.na.fill(fill)


def melted(wide: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return wide.unpivot(ids, columns, name, value)


def analytics_rows(cell: DataFrame) -> DataFrame:
    """One JSON document per venue-year: labelled papers, counts and shares by category."""
    entries = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", v))))
    share = F.col("share")
    rows = cell.withColumn("share", 100 * ratio(F.col("k"), F.col("n")))
    out = rows.groupBy("venue", "year").agg(F.max("n").alias("n_labeled"), entries(F.col("k")).alias("counts"), entries(share).alias("shares"))
    return out.select("venue", "year", F.to_json(F.struct("venue", "year", "n_labeled", "counts", "shares")).alias("doc"))


def year_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(F.make_date("year", F.lit(1), F.lit(1)).alias("date")).agg(F.count("*").alias("n"))
