import math

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import stats as st
from lexigrid.functions import text as tx


def one(spark, column, **values):
    names = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], names) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def text(spark, column, s):
    return one(spark, column, s=("string", s))


@pytest.mark.parametrize(("title", "key"), [("Réel", "re el"), ("A&amp;amp;B", "a b"), ("It’s", "it s"), ("café au lait", "cafe au lait"), (None, "")])
def test_title_keys_decompose_and_unescape(spark, title, key):
    assert text(spark, tx.title_key(F.col("s")), title) == key


def test_white_space_is_that_of_python(spark):
    s = "a\t b\xa0c\x1dd e　 "
    assert text(spark, tx.collapse_space(F.col("s")), s) == " ".join(s.split())


def test_markup_is_cleaned(spark):
    assert text(spark, tx.clean_markup(F.col("s")), " a <i>b</i>&amp;\n c ") == "a b& c"


def test_terms_drop_stop_words(spark):
    assert text(spark, tx.terms(F.col("s")), "The Model of graph-nets, x1 GPT4 and it") == ["graph-nets", "gpt4"]


def test_keyword_sets(spark):
    assert one(spark, tx.keyword_set(F.col("k")), k=("array<string>", [" A  b", "a b", " ", "C"])) == ["a b", "c"]


def test_jaccard_of_empty_sets_is_zero(spark):
    assert one(spark, tx.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0
    assert one(spark, tx.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5


@pytest.mark.parametrize(
    ("body", "expected"),
    [("x" * 100 + "term" + "y" * 396, "…" + ("x" * 100 + "term" + "y" * 396)[20:340] + "…"), ("z" * 500, "z" * 320), ("term" + "q" * 316, "term" + "q" * 316)],
)
def test_excerpts(spark, body, expected):
    assert text(spark, tx.excerpt(F.col("s"), F.lower("s"), ["term"]), body) == expected


def test_snippets(spark):
    assert text(spark, tx.snippet(F.col("s"), 10), "one two three") == "one two…"
    assert text(spark, tx.snippet(F.col("s"), 4), "onetwothree") == "onet…"
    assert text(spark, tx.snippet(F.col("s"), 20), "short") == "short"


def test_names(spark):
    names = ("array<string>", ["A", "B", "C", "D"])
    assert one(spark, tx.author_line(F.col("n")), n=names) == "A, B, C, et al."
    assert one(spark, tx.full_name(F.lit(""), F.lit("Doe"))) == "Doe"
    assert one(spark, tx.slug(F.lit("https://x.org/v1/abc20a.html/"))) == "abc20a"
    assert text(spark, tx.split_list(F.col("s")), " a , ,b ") == ["a", "b"]
    assert text(spark, tx.unquote(F.col("s")), ' "A topic" ') == "A topic"


def test_length_class(spark):
    assert [text(spark, tx.length_class(F.col("s"), v), s) for s, v in (("long", ["x"]), ("1", ["1", "2"]), ("2", ["1", "2"]), ("1", ["1"]))] == ["long", "long", "short", None]


def test_markdown(spark):
    source = "# T\n\nA *b*\nc `d`\n\n- x\n  more\n- **y**\n\n![cap](p.png)\n## S\n[l](u)"
    expected = (
        '<h1>T</h1>\n<p>A <em>b</em> c <code>d</code></p>\n<ul><li>x more</li><li><strong>y</strong></li></ul>\n'
        '<figure><img src="p.png" alt="cap" loading="lazy"><figcaption>cap</figcaption></figure>\n<h2>S</h2>\n<p><a href="u" target="_blank" rel="noopener">l</a></p>'
    )
    assert text(spark, tx.markdown(F.col("s")), source) == expected
    for line, want in (("`*x*` and **a *b* c**", "<code>*x*</code> and <strong>a <em>b</em> c</strong>"), ("2 * 3 * 4 <", "2 * 3 * 4 &lt;"), ("[a](b) `[c](d)`", '<a href="b" target="_blank" rel="noopener">a</a> <code>[c](d)</code>'), ("*open", "*open")):
        assert text(spark, tx.inline_markdown(F.col("s")), line) == want


def test_casefold_is_more_than_lower(spark):
    assert text(spark, tx.casefold(F.col("s")), "Straße") == "strasse"


def wilson(k, n, z=1.959964):
    p = k / n
    return z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)


@pytest.mark.parametrize(("k", "n"), [(0, 100), (3, 335), (50, 100)])
def test_wilson(spark, k, n):
    got = one(spark, st.wilson_half_width(F.col("k"), F.col("n")), k=("long", k), n=("long", n))
    assert got == pytest.approx(wilson(k, n))
    if (k, n) == (3, 335):
        assert round(100 * got, 2) == 1.15


def test_status_is_strict_at_its_cutoffs(spark):
    status = [one(spark, st.point_status(F.col("k"), F.col("n")), k=("long", k), n=("long", n)) for k, n in ((0, 50), (1, 50), (6, 60), (50, 100))]
    rel = [math.inf if not k else wilson(k, n) / (k / n) for k, n in ((0, 50), (1, 50), (6, 60), (50, 100))]
    assert status == ["hide" if r > 1 else "grey" if r > 0.5 else "ok" for r in rel]
    assert one(spark, st.wilson_half_width(F.lit(0), F.lit(0))) is None


def test_vectors(spark):
    assert one(spark, st.l2_norm(F.array(F.lit(3.0), F.lit(4.0)))) == 5
    assert one(spark, st.unit(F.array(F.lit(0.0)))) == [0]
    assert one(spark, st.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(math.sqrt(0.5))
    assert one(spark, st.year_window(F.lit(2021))) == 2020
