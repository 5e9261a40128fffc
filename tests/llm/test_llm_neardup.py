import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lexigrid.llm import neardup as nd
from lexigrid.llm import textkernel as tk
from tests_llm_common import SMALL, brute_words, frame


def bag(text):
    w = brute_words(text)
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def overlap(a, b):
    shared, total = sum((a & b).values()), sum((a | b).values())
    return shared / total if total else 0


def classes(docs, threshold=0.8):
    bags = {i: bag(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(docs), 2):
        if overlap(bags[a], bags[b]) >= threshold:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in docs}


def found(spark, docs):
    return {r.doc_id: r.class_id for r in nd.near_duplicates(frame(spark, docs)).collect()}


def test_kernel_matches_plain_words():
    import pyarrow as pa

    texts = ["The  quick-brown fox", "", None, "éa ÉA ea", "x", "...", "a1 B2", "9", "end"] + ["w" * 3000]
    values, offsets = tk.text_buffers(pa.array(texts))
    hashes, counts = tk.word_hashes(values, offsets)
    words = [w for t in texts for w in brute_words(t or "")]
    assert counts.tolist() == [len(brute_words(t or "")) for t in texts]
    assert len(set(hashes.tolist())) == len(set(words)) and all((hashes[i] == hashes[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    part = pa.array(texts).slice(3, 4)
    again, _ = tk.word_hashes(*tk.text_buffers(part))
    assert again.tolist() == hashes[4 : 4 + len(again)].tolist()


def test_signatures_are_unbiased():
    r = np.random.default_rng(1)
    for changed in (60, 20):
        items, a = r.integers(0, 2**63, 100, dtype=np.uint64), r.integers(1, 9, 100)
        b = a.copy()
        b[:changed] = r.integers(1, 9, changed)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        got = []
        for t in range(40):
            s = nd.bag_minhash(np.tile(items + np.uint64(7919 * t), 2), np.concatenate((a, b)), np.repeat([0, 1], 100), 2, 130)
            got.append((s[0] == s[1]).mean())
        assert abs(np.mean(got) - want) < 4 * np.std(got) / 40**0.5


def test_against_all_pairs(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = {}
    for base in range(12):
        words = [r.choice(vocabulary) for _ in range(r.choice((6, 30, 120)))]
        for k in range(r.choice((1, 3, 8))):
            w = list(words)
            for _ in range(k // 2):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs[len(docs) * 3 + 1] = " ".join(w)
    docs |= {500: "one two", 501: "One, two!", 502: "two one", 503: "", 504: None, 505: "...", 506: "a b c d e " * 2000, 507: "a b c d e " * 2001, 508: "a b c d e " * 1000}
    assert found(spark, docs) == classes({i: t or "" for i, t in docs.items()})


def test_a_chain_is_one_class(spark):
    words = [f"x{i}" for i in range(200)]
    docs = {k: " ".join(words[8 * k : 8 * k + 100]) for k in range(12)}
    assert found(spark, docs) == classes(docs) == dict.fromkeys(docs, 0)


def test_large_groups_stay_whole(spark):
    r = random.Random(5)
    words = [f"v{r.randrange(500)}" for _ in range(150)]
    docs = {k: " ".join(words) for k in range(10, 310)}
    for k in range(310, 610):
        w = list(words)
        w[r.randrange(150)] = f"new{k}"
        docs[k] = " ".join(w)
    assert set(found(spark, docs).values()) == {10}


def test_edges(spark):
    rows = [(1, "same text of five words here", "x"), (1, "same text of five words here", "y"), (None, "same text of five words here", "z"), (2, "same text of five words here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = nd.near_duplicates(df).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1) for r in got) == [(-1, -1), (1, 1), (2, 1)]
    kept = nd.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1]
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_texts_under_one_id_are_documents_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(nd, "SALT", 2)
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in (3, 30, 50)]
    rows = [(1, "alpha beta gamma delta epsilon zeta", "x"), (1, "totally different words are here now", "y"), (1, "totally different words are here now", "z"), (9, " ".join(base), "a"), (1, near[0], "b"), (4, near[1], "c"), (5, near[2], "d"), (5, None, "e"), (None, near[2], "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, own string")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.n_links or 0) for r in nd.near_duplicates(df).collect())
    assert got == [(-1, -1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 3), (4, 1, 3), (5, 1, 3), (5, 5, 0), (9, 1, 3)]
    kept = [[(r.doc_id, r.text, r.own) for r in nd.keep_one(d).collect()] for d in (df, df.repartition(7))]
    assert sorted(kept[0], key=repr) == sorted(kept[1], key=repr) and len(kept[0]) == 5
    assert [t for d, t, _ in kept[0] if d == 1].count("totally different words are here now") == 1 and (None, near[2], "f") in kept[0]
    assert len([t for _, t, _ in kept[0] if t in (*near, " ".join(base))]) == 2  # the class's one, and the row without an id


def test_links_are_verified_pairs(spark):
    r = random.Random(8)
    words = [f"v{r.randrange(90)}" for _ in range(80)]
    docs = {k: " ".join([*words[: 7 * k], f"n{k}", *words[7 * k + 1 :]]) for k in range(10)} | {20: " ".join(words), 21: " ".join(words), 30: "other text", 31: ""}
    bags = {i: bag(t) for i, t in docs.items()}
    got = {(x.doc_a, x.doc_b): x.similarity for x in nd.links(frame(spark, docs)).collect()}
    assert all(s == pytest.approx(overlap(bags[a], bags[b])) and s >= 0.8 and a < b for (a, b), s in got.items())
    told = {x.doc_id: x for x in nd.near_duplicates(frame(spark, docs)).collect()}
    assert told[20].n_links == told[3].n_links == 10 <= len(got) and told[30].n_links == 0


def test_pairs_of_many_small_parts_are_read_by_few_tasks(spark):
    r = random.Random(10)
    words = [f"v{r.randrange(400)}" for _ in range(60)]
    docs = {k: " ".join(r.choice((w, w, w, w, w, w, w, w, w, f"x{r.randrange(99)}")) for w in words) for k in range(60)}
    seen, plain = [], nd.settled
    nd_settled = lambda df: plain(df.repartition(37) if df.columns == ["a", "b"] else df)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(nd, "settled", nd_settled)
        across = nd._across
        m.setattr(nd, "_across", lambda *a: seen.append(across(*a)) or seen[-1])
        assert found(spark, docs) == classes(docs)
    assert seen and all(p.rdd.getNumPartitions() <= 4 for p in seen)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 101: 100, 102: 100}


@pytest.mark.parametrize("name", ["documents"])
def test_query_equals_all_pairs_on_small_tables(spark, name):
    from lexigrid.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/{name}.parquet").collect()}
    got = {r.doc_id: r.class_id for r in QUERIES["op2_near_duplicates"](spark, SMALL).collect()}
    assert got == classes(docs)
