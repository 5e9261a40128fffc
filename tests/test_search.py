import pytest

from lexigrid.api import Corpus
from lexigrid.operators import search as s

PAPER = "paper_id string, title string, abstract string, authors array<struct<name:string>>, venue string, year int, source string, source_url string, pdf_url string, keywords array<string>"


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(papers(spark), leaves(spark, LEAVES), spark.createDataFrame([(3, "Rivers"), (5, "Land")], "cluster_id int, label string"))


#: id, title, abstract, year and author of five papers on rivers.
ROWS = [
    ("geo:2019:1", "Silt in slow rivers", "Floods leave silt behind.", 2019, "Ana Brook"),
    ("geo:2021:2", "Meanders", "word " * 90 + "where a river floods its plain", 2021, "Ben Hill"),
    ("geo:2021:3", "Floods and what follows floods", "Rain.", 2021, "Cy Flood"),
    ("geo:2022:4", "Deserts", "Dry land.", 2022, "Dee Moor"),
    ("geo:2020:5", "Tides", "The sea.", 2020, "Ana Brook"),
]
LEAVES = [3, 3, 3, 5, -1]


def papers(spark):
    return spark.createDataFrame([(i, t, a, [(who,)], "Geo", y, "made up", f"https://example.org/{i}", None, []) for i, t, a, y, who in ROWS], PAPER)


def leaves(spark, labels):
    return spark.createDataFrame(list(zip([r[0] for r in ROWS], labels, strict=False)), "paper_id string, leaf int")


def test_ranked_search(corpus):
    got = corpus.search_papers("floods")
    assert [p["paper_id"] for p in got["papers"]] == ["geo:2021:3", "geo:2021:2", "geo:2019:1"] and got["total_matches"] == 3
    long = got["papers"][1]["abstract_excerpt"]
    assert "floods" in long and long.startswith("…") and got["papers"][0]["match_basis"] == ["title"] and got["papers"][2]["match_basis"] == ["abstract"]
    assert corpus.search_papers("floods", year=2019)["total_matches"] == 1
    assert corpus.search_papers("FLOODS", venue="gEO")["total_matches"] == 3 and corpus.search_papers("floods", venue="other")["papers"] == []
    assert [p["paper_id"] for p in corpus.search_papers("floods", limit=1)["papers"]] == ["geo:2021:3"]


def test_scores(spark, corpus):
    score = lambda q: {int(r.paper_id[-1]): r.score for r in s.search(corpus.papers, q).collect()}
    assert score("floods") == {3: 4 + 8, 2: 1, 1: 1}
    assert score("floods floods") == {3: 2 * 4, 2: 2, 1: 2}
    assert score("flood cy") == {3: (4 + 3) + 3}
    assert score("silt brook") == {1: (4 + 1) + 3} and score("slow rivers") == {1: 4 + 4 + 8}


def test_related_and_single(corpus):
    got = corpus.related_papers("geo:2019:1")
    assert [p["paper_id"] for p in got["papers"]] == ["geo:2021:2", "geo:2021:3"] and got["total_cluster_peers"] == 2
    assert corpus.related_papers("geo:2022:4")["papers"] == corpus.related_papers("geo:2020:5")["papers"] == []
    one = corpus.get_paper("geo:2021:3")
    assert one["leaf_cluster"] == {"id": 3, "label": "Rivers"} and one["authors"] == ["Cy Flood"] and one["abstract"] == "Rain."
    assert corpus.get_paper("geo:2020:5")["leaf_cluster"] is None


def test_wrong_arguments(spark, corpus):
    with pytest.raises(LookupError):
        corpus.get_paper("geo:1900:0")
    wrong = [{"query": q} for q in ("", " \t", None, 7, ["x"])] + [{"query": "x"} | x for x in ({"limit": 0}, {"limit": 51}, {"limit": 2.0}, {"limit": True}, {"year": "2020"}, {"year": False}, {"venue": 1})]
    for bad in wrong:
        with pytest.raises(ValueError, match="expected|no term"):
            corpus.search_papers(**bad)
    with pytest.raises(ValueError, match="do not match"):
        Corpus(papers(spark), leaves(spark, LEAVES[:3]), corpus.labels)
    with pytest.raises(ValueError, match="duplicate"):
        Corpus(papers(spark).union(papers(spark)), leaves(spark, LEAVES), corpus.labels)


def test_browse_and_map(spark, corpus):
    rows = s.browse(corpus.papers.select("paper_id", "title", "venue", "year"), text="E", year="2021", sort="title", descending=True).collect()
    assert [r.title for r in rows] == ["Meanders"] and s.browse(corpus.papers, text="d", sort="title", descending=False).first().title == "Deserts"
    assert s.browse(corpus.papers, page=1, size=3).count() == 2
    points = spark.createDataFrame([("Leaf a", 0.0, 0.0), ("Leaf A", 1.0, 0.1), ("b", 100.0, 50.0)], "search_text string, x double, y double")
    box = s.bounding_box(points, s.map_search(points, "leaf A")).first()
    assert (box.n, box.max_x, box.compact) == (2, 1.0, True)
    assert not s.bounding_box(points, s.map_search(points, "")).first().compact
    assert not s.bounding_box(points, s.map_search(points, "zzz")).first().compact
