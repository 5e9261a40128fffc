import hashlib
import random
import re
from collections import defaultdict

from lexigrid.llm import decontam as dc
from tests_llm_common import SMALL, brute_words, frame


def brute(docs, items):
    spans = defaultdict(set)
    for i, t in items:
        if i is not None and (w := brute_words(t)):
            n = min(8, len(w))
            for k in range(len(w) - n + 1):
                spans[tuple(w[k : k + n])].add(i)
    sizes, out = {len(s) for s in spans}, {}
    for d, t in docs.items():
        w, hit, found = brute_words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := spans.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= got
        said = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(said.encode()).hexdigest(), len(found) >= 2)
    return out


def rows(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcÉé") for _ in range(r.choice((1, 2))))
    items = [(i, " ".join(word() for _ in range(r.choice((0, 1, 3, 7, 8, 9, 20))))) for i in range(30)] + [(30, None), (None, "a b c d e f g h"), (31, items_text := "q r s t u v w x y z"), (32, items_text), (10, "extra text of an item that is told twice over")]
    docs = {}
    for d in range(60):
        parts = [" ".join(word() for _ in range(r.choice((0, 5, 40))))]
        for _ in range(r.choice((0, 1, 2))):
            w = brute_words(r.choice(items)[1])
            a = r.randrange(len(w) + 1)
            parts += [" , ".join(w[a : a + r.choice((6, 8, 12))]).upper(), word()]
        docs[d] = "-".join(parts)
    docs |= {100: None, 101: "", 102: "!!", 103: "Q R S T U V W X Y", 104: "q r s t u v w"}
    got = rows(dc.contamination(frame(spark, docs), bench(spark, items)))
    assert got == brute(docs, items)
    assert any(x[4] for x in got.values()) and any(x[2] == 1 for x in got.values())


def test_shuffled_path_gives_the_same(spark, monkeypatch):
    docs = {1: "a b c d e f g h i", 2: "b c d e f g h i", 3: "nothing"}
    items = [(1, "a b c d e f g h i"), (2, "x " * 9)]
    want = rows(dc.contamination(frame(spark, docs), bench(spark, items)))
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(dc, "BROADCAST_VALUES", 0)
    assert rows(dc.contamination(frame(spark, docs), bench(spark, items))) == want == brute(docs, items)


def test_edges(spark):
    items = bench(spark, [(1, "a b c d e f g h")])
    df = spark.createDataFrame([(1, "x a b c d e f g h", 1), (1, "x a b c d e f g h", 2), (None, "a b c d e f g h", 3), (1, "other", 4)], "doc_id long, text string, words int")
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit) for r in dc.contamination(df, items).collect())
    assert got == [(-1, 8, 8), (1, 1, 0), (1, 9, 8), (1, 9, 8)]
    assert {r.n_hit for r in dc.contamination(df, items.limit(0)).collect()} == {0}
    assert dc.contamination(df.limit(0), items).count() == 0
    assert not re.search("Python|Arrow|Pandas", dc.contamination(df, items)._jdf.queryExecution().executedPlan().toString())


def test_decontaminate(spark):
    one, two = "a b c d e f g h", "i j k l m n o p"
    df = spark.createDataFrame([(1, f"Keep, {one}! this É", 30, "s"), (2, f"{one} {two}", 31, "s"), (3, "clean", 5, "s"), (4, one, 15, None), (None, f"x {two}", 17, "s"), (5, None, 0, "s")], "doc_id long, text string, n_chars long, hit string")
    out = dc.decontaminate(df, bench(spark, [(1, one), (2, two)]))
    got = {r.doc_id: (r.text, r.n_chars, r.hit) for r in out.collect()}
    assert got == {1: ("Keep, this É", 12, "s"), 3: ("clean", 5, "s"), 4: ("", 0, None), None: ("x ", 2, "s"), 5: (None, 0, "s")}
    assert out.columns == df.columns


def test_sides_of_a_cut_make_no_window(spark):
    """A window inside a window, whole or threefold: nothing of it is left."""
    one = "aa bb cc dd ee ff gg hh"
    two = "aa bb cc dd " * 2 + one + " ee ff gg hh" * 2
    df = spark.createDataFrame([(1, f"x aa bb cc dd [{one}] ee ff gg hh y", 1), (2, f"{two} end", 2), (2, f"{two} end", 3), (3, f"aa bb cc dd {one} gap ee ff gg hh", 4), (4, "w " * 20_000 + one, 5)], "doc_id long, text string, cut1 int")
    items = bench(spark, [(1, one)])
    out = dc.decontaminate(df, items)
    assert sorted((r.doc_id, r.cut1, r.text) for r in out.collect()) == [(1, 1, "x y"), (2, 2, "end"), (2, 3, "end"), (3, 4, "aa bb cc dd gap ee ff gg hh"), (4, 5, "w " * 20_000)]
    assert {r.n_hit for r in dc.contamination(out, items).collect()} == {0} and out.columns == df.columns


def test_windows_shared_by_many_items(spark):
    shared = "a b c d e f g h"
    items = [(i, f"{shared} own{i} " + " ".join(f"t{i}x{k}" for k in range(8))) for i in range(300)]
    docs = {1: f"{shared} {shared}", 2: f"z {items[7][1]}", 3: "t9x0 t9x1 t9x2 t9x3 t9x4 t9x5 t9x6 t9x7"}
    got = rows(dc.contamination(frame(spark, docs), bench(spark, items)))
    assert got == brute(docs, items) and [got[d][2] for d in (1, 2, 3)] == [300, 300, 1]


def test_query_on_small_tables(spark):
    from lexigrid.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert rows(QUERIES["op7_contamination"](spark, SMALL)) == brute(docs, items)
