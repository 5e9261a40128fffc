"""Main text, archives and nearest vectors."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest

from lexigrid.llm import ann, htmltext, warc
from tests_llm_common import SMALL

PARAGRAPH = "This paragraph tells at some length what the article has to say, and goes on for a while. "

PAGE = """<!DOCTYPE html><html class="no-js sidebar-open"><head><title>Site</title><style>p{}</style><script>var t="</p>";</script></head><body class="page header-fixed">
<header class="site-header"><a href="/">Home</a> <p>Welcome to the site of everything you ever wanted to know about it</p></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div id="cookie-notice">We use cookies to make this site a better place for you and all of our partners, please agree.</div>
<div class="layout"><ARTICLE class="post"><h1>The &quot;title&quot;&nbsp;of&#32;it</h1><p>Short.</p><!-- <p>not this</p> -->
<p>%s<b>bo</b>ld<br>line &lt;tag&gt;<p>%s<div class="ad">Buy this now, it is very cheap and very good, you will not regret it</div>
<aside>Related: something else that you may want to read today or tomorrow</aside><form><label>Mail</label><input value="x > y"><button>Go</button></form>
<ul><li>First point</li><li>Second <a href="/x">point</a></li></ul><p>End.</p>
<section class="comments"><p>%s says a reader who liked it very much indeed</p></section></article>
<div class="sidebar"><p>%s</p></div></div><footer>&copy; all of us</footer><script>document.write("<p>%s</p>")</script></body></html>""".replace("%s", PARAGRAPH)


def test_article_without_its_surroundings():
    want = f'The "title" of it Short. {PARAGRAPH}bold line <tag> {PARAGRAPH}First point Second point End.'
    assert htmltext.main_text(PAGE) == " ".join(want.split())


def test_pages_without_an_article_element():
    body = "".join(f"<p>{PARAGRAPH}{i}</p>" for i in range(6))
    page = f"<body><div><a href='/'>Home</a> | <a href='/x'>About</a></div><div class=content><h2>Head</h2>{body}<p>Fin.</p></div><div>Imprint</div></body>"
    got = htmltext.main_text(page)
    assert got.startswith(f"Head {PARAGRAPH}0") and got.endswith("Fin.") and "About" not in got and "Imprint" not in got


@pytest.mark.parametrize("name", ["content", "post", "entry", "x"])
@pytest.mark.parametrize("tag", ["div", "aside"])
def test_a_box_in_mid_article_does_not_end_it(name, tag):
    box = f'<{tag} class="related">' + "".join(f"<p>Advertised {i}</p>" for i in range(7)) + f"</{tag}>"
    links = "<ul>" + "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(7)) + "</ul>"
    for widget, kept in ((box, ""), (links, " ".join(f"Link {i}" for i in range(7)) + " ")):
        for few, many in ((1, 3), (3, 1)):
            before, after = (" ".join([PARAGRAPH] * k) for k in (few, many))
            page = f'<body><div class="nav"><a href="/">Home</a></div><div class="{name}"><p>{before}</p>{widget}<p>{after}</p></div><div><p>Other words.</p></div></body>'
            assert htmltext.main_text(page) == " ".join(f"{before} {kept}{after}".split())


def test_marks_of_what_is_not_the_article():
    inside = f"<h1>Head</h1><p>{PARAGRAPH}</p>"
    want = " ".join(f"Head {PARAGRAPH}".split())
    for extra in ('<p class="advert">Buy</p>', '<div class="sidebar-content">s</div>', '<div id="footer-content">f</div>', '<ul class="main-nav"><li>n</li></ul>', '<div class="comment-content">c</div>', '<p hidden>h</p>', '<div role="complementary">x</div>', '<div class="socialShare">y</div>', '<select><option>o</option></select>', "<footer>t</footer>"):
        assert htmltext.main_text(f"<body><article>{inside}{extra}</article></body>") == want, extra
    for frame in ('<div class="has-sidebar">%s</div>', '<div class="layout-sidebar wrapper">%s</div>', '<div class="page-header-fixed">%s</div>', '<div class="entry-header">%s</div>'):
        assert htmltext.main_text("<body>" + frame % f"<article>{inside}</article>" + "</body>") == want, frame
    assert htmltext.main_text(f'<article><header><h1>Head</h1></header><p>{PARAGRAPH}</p></article><div id="comments"><article><p>{PARAGRAPH * 3}</p></article></div>') == want


BODY = f"<h1>Head</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH * 2}</p><p>End.</p>"
WANT = " ".join(f"Head {PARAGRAPH * 3}End.".split())


@pytest.mark.parametrize("page", [
    '<div style="overflow:hidden">%s</div>', '<article style="overflow: hidden">%s</article>', '<div data-id="nav">%s</div>', '<article class="post comments-open">%s</article>',
    '<form id="aspnetForm"><div id="page">%s</div></form>', '<div class="sidebar-open"><div class="wrapper">%s</div></div>', '<div title="class=comments">%s</div>', "<div class='main-column'>%s</div>", "<table><tr><td>%s</td></tr></table>", "<div class=x data-role=nav>%s</div>",
])
def test_attributes_are_read_as_pairs(page):
    menu, foot = "<nav><ul><li><a href=/>Home</a></li></ul></nav>", "<footer>All rights</footer>"
    assert htmltext.main_text(f"<body>{menu}{page % BODY}{foot}</body>") == WANT


@pytest.mark.parametrize("frame", ["<article>%s</article>", "<div>%s</div>", "<main>%s</main>"])
def test_marks_only_weigh(frame):
    """Parts of an article whose slug is a word of marks stay; what is marked as itself goes."""
    for part in ('<section id="discussion">%s</section>', '<section id="related-work">%s</section>', '<section id="notice">%s</section>', '<h2 id="notice-period">Notice</h2>%s', '<div class="respond">%s</div>'):
        inside = part % f"<p>{PARAGRAPH}</p>"
        head = "Notice " if "<h2" in part else ""
        assert htmltext.main_text(f"<body>{frame % (BODY + inside)}</body>") == " ".join(f"{WANT} {head}{PARAGRAPH}".split()), part
    for part in ('<section class="comments">%s</section>', '<div class="notice">%s</div>', '<div class="related-posts">%s</div>', '<div id="cookie-banner">%s</div>', '<div class="ad-slot">%s</div>', "<aside>%s</aside>", '<div class="sidebar">%s</div>', '<section id="comments">%s</section>'):
        assert htmltext.main_text(f"<body>{frame % (BODY + part % f'<p>{PARAGRAPH}</p>')}</body>") == WANT, part


def plain_line_blocks(lengths, window=5, surge=60):
    """The stretch by its definition: every run of windows whose sums reach the level, the heaviest, without empty ends."""
    n = len(lengths)
    sums = [sum(lengths[i : i + window]) for i in range(n)]
    level = min(surge, max(sums, default=0))
    best = None
    for a in range(n):
        for b in range(a, n):
            if level and all(x >= level for x in sums[a : b + 1]) and (a == 0 or sums[a - 1] < level) and (b == n - 1 or sums[b + 1] < level):
                inside = [i for i in range(a, min(b + window, n)) if lengths[i]]
                if best is None or sum(lengths[i] for i in inside) > best[0]:
                    best = (sum(lengths[i] for i in inside), inside[0], inside[-1])
    return best[1:] if best else (0, -1)


def test_distribution_equals_its_definition():
    r = random.Random(9)
    for _ in range(300):
        lengths = [r.choice((0, 0, 0, 0, 5, 30, 200)) for _ in range(r.randrange(40))]
        got = htmltext._densest(lengths, 5, 60)
        assert got == plain_line_blocks(lengths) or got[0] > got[1] and not any(lengths), lengths


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p></p><br>", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a b"), ("<b>one</b>two", "onetwo"), ("a < b and <3", "a < b and <3"), ("<script>x", ""), ("<!-- open", ""), ("<article>x</article>", "x"), ("</div></div>x", "x"), ("<nav>only menu</nav>", "")])
def test_odd_pages(page, text):
    assert htmltext.main_text(page) == text


def test_page_query(spark):
    from lexigrid.llm.queries import QUERIES

    rows = QUERIES["op4_main_text"](spark, SMALL).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    import html
    import re

    for r in rows:
        inside = re.search(r"(?s)<article>(.*?)(?:</article>|<footer>)", pages[r.page_id])[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inside))).split())
        assert r.text == want and r.n_chars == len(want)
    df = spark.createDataFrame([(1, "u", None, 3), (1, "u", None, 3), (None, None, "<p>" + "x " * 200_000, 4)], "page_id long, url string, html string, text int")
    assert sorted(r.n_chars for r in htmltext.extract_text(df).collect()) == [0, 0, 399_999]
    assert htmltext.extract_text(df.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, digest string"


def written(spark, tmp_path, rows, **kw):
    folder = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, PAGES), folder, **kw)
    return folder


def test_round_trip(spark, tmp_path):
    rows = [(3, "http://a", "same é", None), (5, "http://b", "same é", None), (2, "u", None, "x"), (9, "u", "", None), (-7, "u\r\nx", "\r\n\r\nWARC/1.1\r\n\0\x1f", None), (None, None, "same é", None), (None, "u", "alone", None), (3, "http://a", "same é", None), (2**62, "u", "big" * 100_000, None)]
    folder = written(spark, tmp_path, rows, records_per_file=3)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to, r.payload) for r in warc.read_archives(spark, folder).collect()), key=repr)
    b = lambda s: s.encode()
    want = [(3, 7, "response", None, b("same é"))] * 2 + [(5, 7, "revisit", 3, None), (2, 0, "response", None, b""), (9, 0, "revisit", 2, None), (-7, 16, "response", None, b(rows[4][2])), (0, 7, "revisit", 3, None), (0, 5, "response", None, b"alone"), (2**62, 300_000, "response", None, b"big" * 100_000)]
    assert got == sorted(want, key=repr)
    for r in warc.read_archives(spark, folder).collect():
        assert r.gap is None and len(r.payload_digest) == 32
        if r.payload is not None:
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
    least = written(spark, tmp_path, rows[:4], least_bytes=1)
    assert [r.record_type for r in warc.read_archives(spark, least).filter("page_id in (2, 9)").collect()] == ["response"] * 2
    empty = written(spark, tmp_path, [(1, "u", "x", None)])
    warc.write_archives(spark.createDataFrame([], PAGES), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_files_are_bounded_by_bytes(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, "u", "".join(chr(r.randrange(33, 500)) for _ in range(60_000 if i == 7 else 2_000)), None) for i in range(60)]
    folder = written(spark, tmp_path, rows, file_bytes=20_000)
    sizes = sorted(p.stat().st_size for p in (tmp_path / "w").rglob("part-*"))
    assert len(sizes) > 5 and sizes[-1] > 20_000 and sizes[-2] <= 20_000
    got = {x.page_id: x.payload.decode() for x in warc.read_archives(spark, folder).collect()}
    assert got == {x[0]: x[2] for x in rows}


def archive(n=40):
    r = random.Random(1)
    return [warc._record(i, f"http://x/{i}", bytes(r.randrange(256) for _ in range(r.randrange(300))), None, False) for i in range(n)]


def ids(found):
    return [warc.page_of(x.headers["warc-record-id"]) for x in found if x.headers]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_of_every_kind_of_damage(zipped):
    records = archive()
    parts = [warc.members(x) if zipped else x for x in records]
    whole = b"".join(parts)
    starts = np.cumsum([0, *map(len, parts)])
    assert ids(warc.salvage(whole)) == list(range(40)) and not [x for x in warc.salvage(whole) if x.reason]
    flipped = bytearray(whole)
    at = int(starts[7]) + len(parts[7]) - 20
    flipped[at] ^= 0xFF
    found = list(warc.salvage(bytes(flipped)))
    assert ids(found) == [i for i in range(40) if i != 7]
    assert [(x.offset, x.length) for x in found if x.reason] == [(starts[7], len(parts[7]))]
    cut = whole[: int(starts[20]) + 30] + whole[int(starts[22]) :]
    assert ids(warc.salvage(cut)) == [i for i in range(40) if i not in (20, 21)]
    junk = b"garbage\n" + whole[: int(starts[3])] + b"\x1f\x8b\x08 not a member WARC/1.1 \n" * 3 + whole[int(starts[3]) :] + b"tail"
    found = list(warc.salvage(junk))
    assert ids(found) == list(range(40)) and len([x for x in found if x.reason]) == 3
    assert sum(x.length for x in found) == len(junk)
    assert ids(warc.salvage(whole[:-5])) == list(range(39))
    assert list(warc.salvage(b"")) == [] and [x.reason != "" for x in warc.salvage(b"x")] == [True]


def test_long_records_and_single_streams():
    long = warc._record(5, "u", b"ab" * (9 << 20), None, False)
    small = warc._record(6, "u", b"x", None, False)
    data = warc.members(long) + warc.members(small)
    assert data.endswith(b"\0") and ids(warc.salvage(data)) == [5, 6]
    assert ids(warc.salvage(gzip.compress(b"".join(archive(5))))) == list(range(5))


def test_archive_query(spark):
    from lexigrid.llm.queries import QUERIES

    rows = {r.page_id: r for r in QUERIES["op8_warc_round_trip"](spark, SMALL).collect()}
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    assert set(rows) == set(pages)
    for i, data in pages.items():
        r = rows[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[data] == i else ("revisit", first[data]))


def exact(rows, every, k):
    fine = {}
    for i, v in sorted(rows, key=repr):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[i] = min(fine.get(i, v), v)
    sizes = [len(v) for v in fine.values()]
    dim = min(set(sizes), key=lambda d: (-sizes.count(d), d)) if sizes else 0
    names = np.array([i for i, v in fine.items() if len(v) == dim])
    x = np.array([v for v in fine.values() if len(v) == dim], float)
    out = {}
    for q in names[names % every == 0] if len(names) else ():
        score = x @ x[names == q][0]
        order = [j for j in np.lexsort((names, -score)) if names[j] != q][:k]
        out[int(q)] = [(int(names[j]), float(score[j])) for j in order]
    return out


def searched(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {}
    for r in ann.search(df, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / max(len(w), 1) for q, w in want.items()])


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(r.standard_normal((1500, 48)) * r.uniform(0.2, 3, (1500, 1)) + 0.5)]
    want = exact(rows, 20, 20)
    got = searched(spark, rows, block_bytes=8000)
    assert set(got) == set(want) and recall(got, want) > 0.99
    for q in want:
        assert got[q][0][0] == want[q][0][0] and got[q][0][1] == pytest.approx(want[q][0][1])


def test_error_bounds_hold():
    r = np.random.default_rng(1)
    x, q = r.standard_normal((4000, 64)), r.standard_normal((20, 64))
    center, rotate = x.mean(0), ann.rotation(64)
    codes, length, lost = ann.encode(x, center, rotate)
    assert codes.shape == (4000, 8)
    guess, bound = ann.estimate(codes, length, lost, q @ center, q, center, rotate)
    assert (np.abs(guess - q @ x.T) <= bound).mean() > 0.999 and np.abs((guess - q @ x.T).mean()) < 0.1


@pytest.mark.parametrize("dim", [1, 13, 64])
def test_tables_of_bytes_add_what_the_signs_do(dim):
    r = np.random.default_rng(2)
    x, q = r.standard_normal((300, dim)), r.standard_normal((7, dim))
    center, rotate = x.mean(0), ann.rotation(dim)
    codes, length, lost = ann.encode(x, center, rotate)
    signs = np.where((x - center) @ rotate.T > 0, 1, -1) / np.sqrt(dim)
    want = (q @ rotate.T) @ signs.T * (length / lost) + (q @ center)[:, None]
    assert np.allclose(ann.estimate(codes, length, lost, q @ center, q, center, rotate)[0], want, atol=1e-4)


def test_vector_edges(spark):
    same = [(i, [1.0, 0.0]) for i in range(0, 60)]
    odd = [(100, None), (120, [0.0, 0.0]), (140, [float("nan"), 1.0]), (160, [None, 1.0]), (180, [1.0]), (None, [1.0, 0.0]), (0, [1.0, 0.0]), (200, [float("inf"), 1.0]), (220, [])]
    got = searched(spark, same + odd)
    assert got == exact(same + odd, 20, 20) and set(got) == {0, 20, 40}
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[20]][:3] == [0, 1, 2]
    assert searched(spark, [(0, [1.0]), (1, [2.0])]) == {0: [(1, 2.0)]} and searched(spark, [(0, [1.0])]) == {}
    assert searched(spark, [(1, [0.0])]) == {}


def test_vector_query(spark):
    from lexigrid.llm.queries import QUERIES

    rows = [(r.vec_id, [float(v) for v in r.embedding]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want, got = exact(rows, 20, 20), {}
    for r in QUERIES["op5_nearest_vectors"](spark, SMALL).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and recall(got, want) >= 0.99
