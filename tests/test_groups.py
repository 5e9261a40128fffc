import math

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import clusters as cl
from lexigrid.operators import hierarchy as hi
from lexigrid.operators import quality as qu
from lexigrid.operators import trends as tr


def test_orphans(spark):
    rows = [(1, 1, -1, 5), (2, 1, -1, -1), (3, 2, 3, -1), (4, 2, -1, -1), (5, 9, 3, -1), (6, -1, -1, 5)]
    got = {r.id: (r.mid, r.mega) for r in hi.remap_orphans(spark.createDataFrame(rows, "id int, leaf int, mid int, mega int")).collect()}
    assert got == {1: (-2, 5), 2: (-2, -1), 3: (3, -3), 4: (-1, -1), 5: (3, -3), 6: (-1, 5)}
    all_orphans = spark.createDataFrame([(1, 1, -1, -1), (2, 1, -1, -1)], "id int, leaf int, mid int, mega int")
    assert {(r.mid, r.mega) for r in hi.remap_orphans(all_orphans).collect()} == {(-2, -3)}


@pytest.fixture(scope="module")
def trend(spark):
    rows = [("a", 2018, "x")] * 3 + [("a", 2018, "y")] + [("a", 2019, "z")] * 2 + [("b", 2018, "x"), ("b", 2018, hi.UNCLUSTERED)]
    return spark.createDataFrame(rows, "venue string, year int, category string")


def test_cells_keep_zeros_of_present_years_only(trend):
    got = {(r.venue, r.year, r.category): (r.k, r.n) for r in tr.cells(trend).collect()}
    assert got["a", 2018, "z"] == (0, 4) and got["a", 2018, "x"] == (3, 4) and got["b", 2018, "x"] == (1, 1)
    assert len(got) == 9 and ("b", 2019, "x") not in got
    share = {r.category: r.share for r in tr.points(tr.cells(trend)).filter("venue = 'a' and year = 2018").collect()}
    assert share == {"x": 75, "y": 25, "z": 0}


def test_top_and_other(trend):
    cell = tr.cells(trend)
    top = tr.top_categories(cell, 1)
    assert [r.category for r in top.collect()] == ["x"]
    got = {(r.venue, r.year, r.category): r.k for r in tr.collapse(cell, top).collect()}
    assert got == {("a", 2018, "x"): 3, ("a", 2018, "Other"): 1, ("a", 2019, "x"): 0, ("a", 2019, "Other"): 2, ("b", 2018, "x"): 1, ("b", 2018, "Other"): 0}


def test_noise_rate(trend):
    got = {(r.venue, r.year): r.noise_rate for r in tr.venue_years(trend).collect()}
    assert got == {("a", 2018): 0, ("a", 2019): 0, ("b", 2018): 0.5}


def test_bins_sum_before_shares(trend):
    got = {(r.venue, r.category): (r.year, r.k, r.n, r.n_years_present) for r in tr.binned(tr.cells(trend)).collect()}
    assert got["a", "x"] == (2018, 3, 6, 2) and got["b", "x"] == (2018, 1, 1, 1)


def test_segments_break_at_gaps(spark):
    rows = [("v", "c", y, s) for y, s in ((1, "ok"), (2, "hide"), (3, "ok"), (5, "ok"), (6, "ok"))]
    point = spark.createDataFrame(rows, "venue string, category string, year int, status string")
    assert [(r.from_year, r.to_year, r.style) for r in tr.segments(point).collect()] == [(5, 6, "solid")]
    grey = spark.createDataFrame([("v", "c", y, s) for y, s in ((1, "ok"), (2, "ok"), (3, "grey"), (4, "ok"), (5, "ok"))], point.schema)
    assert [(r.from_year, r.style, r.run) for r in tr.segments(grey).orderBy("from_year").collect()] == [(1, "solid", 1), (2, "grey", 2), (3, "grey", 3), (4, "solid", 4)]


def test_reports(trend):
    cell = tr.cells(trend)
    assert tr.described(cell).first()["count"] == 9
    assert tr.small_cells(cell).first().zero == 5
    assert {r.venue: r.category for r in tr.largest_bucket(cell.filter("year = 2018")).collect()} == {"a": "x", "b": "x"}
    assert '"x":3' in tr.analytics_rows(cell).filter("venue = 'a' and year = 2018").first().doc
    assert tr.rules(cell).filter("venue = 'a'").first().n_under30 == 100
    wide = tr.pivoted(cell.filter("year = 2018"), "venue", "category", ["x", "y"], "k", 0)
    assert tr.melted(wide, ["venue"], ["x", "y"], "category", "k").count() == 4


def test_rand_and_nesting(spark):
    rows = [("a", "x", "p"), ("a", "x", "p"), ("b", "x", "p"), ("b", "y", "p")]
    df = spark.createDataFrame(rows, "f string, c string, o string").withColumns({"fine": F.when(F.col("f") == "a", 0).otherwise(1), "coarse": F.when(F.col("c") == "x", 0).otherwise(1)})
    assert cl.adjusted_rand(df, "fine", "fine").first().ari == 1
    assert cl.adjusted_rand(df, "o", "o").first().ari == 1
    assert cl.nesting(df, "fine", "coarse").first().nesting == 0.75
    assert cl.seed_stability(df, ["fine", "coarse", "o"]).count() == 3
    assert cl.sweep(df, "fine", ["coarse"]).first().clusters == 2


def test_ctfidf(spark):
    df = spark.createDataFrame([(0, "shared alpha"), (1, "shared beta"), (-1, "noise noise")], "leaf int, text string")
    got = {(r.cluster, r.term): r.score for r in cl.ctfidf(df).collect()}
    assert got[0, "shared"] == pytest.approx(0.5 * math.log(2)) and got[0, "alpha"] == pytest.approx(0.5 * math.log(3)) and len(got) == 4


def test_composition_prompts_and_labels(spark):
    rows = [(0, i, "acl" if i % 3 else "icml", f"graph title {i}") for i in range(20)] + [(1, 30, "acl", "of the")]
    df = spark.createDataFrame(rows, "leaf int, doc_id long, venue string, title string")
    assert cl.composition(df).filter("leaf = 0").first().breakdown == {"acl": 13, "icml": 7}
    assert cl.cross_index(df).filter("leaf = 0").first().cross_index == pytest.approx(2 * 7 / 20)
    assert [r.doc_id for r in cl.strided_titles(df).filter("leaf = 0").orderBy("place").collect()] == [0, 2, 4, 6, 8, 10, 12, 14]
    labels = cl.common_title_terms(df)
    assert {r.leaf: r.label for r in labels.collect()} == {0: "graph / title", 1: "Unlabelled"}
    prompt = cl.prompts(cl.ctfidf(df, "title"), cl.strided_titles(df))
    assert "graph" in prompt.filter("leaf = 0").first().prompt
    assert cl.labelled_by(prompt, lambda c: F.lit(' "Graphs" '), labels).filter("leaf = 0").first().label == "Graphs"
    assert cl.labelled_by(prompt, None, labels).filter("leaf = 0").first().label == "graph / title"


def test_quality(spark):
    a = spark.createDataFrame([("v", "k1"), ("v", "k2"), ("w", "k3")], "g string, key string")
    b = spark.createDataFrame([("v", "k2"), ("v", "k4"), ("v", "k4")], "g string, key string")
    got = {r.g: (r.n_ours, r.n_theirs, r.matched, r.recall, r.confirmation) for r in qu.agreement(a, b, "g", "key").collect()}
    assert got == {"v": (2, 2, 1, 0.5, 0.5), "w": (1, 0, 0, None, 0.0)}
    assert [r.key for r in qu.unmatched_sample(a, b, "g", "key").collect()] == ["k4"]
    assert {(r.key, r.only_in) for r in qu.id_mismatch(a, b, "key").collect()} == {("k1", "left"), ("k3", "left"), ("k4", "right")}
    volumes = spark.createDataFrame([("f", "long")], "name string, volume string")
    needed = spark.createDataFrame([("f", "long"), ("f", "short")], "name string, volume string")
    assert qu.absent_volumes(volumes, needed).first().lacking == ["short"]
    pages = spark.createDataFrame([("1-9",), ("xi-xx",), (None,), (" 3",)], "pages string")
    assert [r[0] for r in pages.select(qu.front_matter("pages")).collect()] == [True, False, False, True]
