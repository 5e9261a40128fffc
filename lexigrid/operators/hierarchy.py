"""Three levels of clusters: orphans, names and the topic tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.schema import NO_MEGA, NO_MID, NOISE

# Names of what has no cluster at a level.
UNCLUSTERED, NICHE, CROSS_CUTTING = "Unclustered", "Specialized / Niche Topics", "Cross-Cutting & Specialized Research"


def remap_orphans(assigned: DataFrame) -> DataFrame:
    """mid becomes NO_MID in leaves without any middle topic, then mega NO_MEGA in middle groups without any broad topic.

    Noise leaves keep their mid; the groups of mid -1 and NO_MID count as groups
    for mega. The largest value of each group is found by a grouped maximum, which
    combines before its shuffle, and joined as a small table, so that no window
    has to hold a large group in one task.
    """
    of_leaf = assigned.groupBy("leaf").agg(F.max("mid").alias("_m"))
    mid = F.when((F.col("leaf") >= 0) & (F.col("_m") < 0), NO_MID).otherwise(F.col("mid"))
    rows = assigned.join(of_leaf, "leaf").withColumn("mid", mid).drop("_m")
    of_mid = rows.groupBy("mid").agg(F.max("mega").alias("_m"))
    mega = F.when(F.col("_m") < 0, NO_MEGA).otherwise(F.col("mega"))
    return rows.join(of_mid, "mid").withColumn("mega", mega).drop("_m").select(*assigned.columns)


def with_names(assigned: DataFrame, leaves: DataFrame, mids: DataFrame, megas: DataFrame, missing: str = "?") -> DataFrame:
    """leaf_name, mid_name and mega_name; a label that is missing is ``missing``."""
    out = assigned
    for level, labels in (("leaf", leaves), ("mid", mids), ("mega", megas)):
        own = labels.select(F.col("cluster_id").alias(level), F.col("label").alias(f"{level}_name"))
        out = out.join(own, level, "left")
    special = {"leaf": {}, "mid": {NO_MID: NICHE}, "mega": {NO_MEGA: CROSS_CUTTING}}
    for level, names in special.items():
        c = F.when(F.col(level) == NOISE, UNCLUSTERED)
        for value, name in names.items():
            c = c.when(F.col(level) == value, name)
        out = out.withColumn(f"{level}_name", c.otherwise(F.coalesce(f"{level}_name", F.lit(missing))))
    return out


def with_category(assigned: DataFrame, megas: DataFrame) -> DataFrame:
    """category: the broad topic's name for trends; its number if it has none."""
    own = megas.select(F.col("cluster_id").alias("mega"), F.col("label").alias("category"))
    name = F.when(F.col("mega") == NO_MEGA, CROSS_CUTTING).when(F.col("mega") == NOISE, UNCLUSTERED).otherwise(F.coalesce("category", F.col("mega").cast("string")))
    return assigned.join(own, "mega", "left").withColumn("category", name)


def topic_tree(named: DataFrame) -> DataFrame:
    """Numbers of papers of every node of the tree mega > mid > leaf; a node's lower levels are null."""
    tree = named.rollup("mega_name", "mid_name", "leaf_name").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return tree.withColumn("depth", F.when(F.col("g") == 7, 0).when(F.col("g") == 3, 1).when(F.col("g") == 1, 2).otherwise(3)).drop("g")


def without_repeats(tree: DataFrame, label: str) -> DataFrame:
    """The tree less leaves of a catch-all name under a middle node of that name, which lead nowhere; counts above them stay."""
    return tree.filter(~((F.col("depth") == 3) & (F.col("mid_name") == label) & (F.col("leaf_name") == label)))
