"""Quality, language and pseudo-likelihood."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexigrid.llm import langid, lmscore, quality
from lexigrid.llm import textkernel as tk
from tests_llm_common import SMALL, brute_words, frame

MEDIUM = "/root/testdata/sf0.01"


def auc(score, label):
    score, label = np.array(score), np.array(label)
    good, bad = score[label == 1], score[label == 0]
    return np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad])


def test_features_by_hand():
    texts = ["Ab ab. 12!\n#é", "", "x x x x x x", None]
    got = quality.features(*tk.text_buffers(pa.array(texts)))
    names = {n: i for i, n in enumerate(quality.FEATURES)}
    size = len(texts[0].encode())
    for kind, count in (("upper", 1), ("lower", 3), ("digit", 2), ("space", 2), ("newline", 1), ("stop", 1), ("shout", 1), ("symbol", 1), ("beyond", 2)):
        assert got[0, names[kind]] == pytest.approx(np.log((count + 0.5) / (size + 10))), kind
    assert got[0, names["words"]] == pytest.approx(np.log1p(4)) and got[0, names["echo"]] == pytest.approx(np.log(1.5 / 14))
    assert got[2, names["commonest"]] == pytest.approx(np.log(7 / 11)) and got[2, names["distinct5"]] == pytest.approx(np.log(2 / 3))
    assert np.isfinite(got).all() and (got[1] == got[3]).all()


def test_discriminant_equals_the_densities():
    r = np.random.default_rng(0)
    x = np.concatenate((r.normal(0, 1, (300, 3)), r.normal(1, (1, 2, 0.5), (200, 3))))
    y = np.repeat([0, 1], (300, 200))
    m = quality.Discriminant(x, y, shrink=0, pool=0)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)

    def density(g):
        c = np.cov(g.T, bias=True) + quality.FLOOR * np.eye(3)
        d = z - g.mean(0)
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1]

    want = density(z[y == 1]) + np.log(0.4) - density(z[y == 0]) - np.log(0.6)
    assert np.allclose(m._difference(x), want) and auc(m.score(x), y) > 0.8


def test_quality_query(spark):
    from lexigrid.llm.queries import QUERIES

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = QUERIES["op10_quality"](spark, MEDIUM).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert auc([r.score for r in held], [labels[r.doc_id] for r in held]) > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (None, "a b", 0.3), (3, "word " * 50_000, 0.4), (3, "word " * 50_000, 0.4)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (3, 7)], "doc_id long, quality int")
    for told in (labels, labels.limit(0)):
        m = quality.fit(docs, told)
        rows = quality.score(docs, m).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 3}) == 1
        assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert quality.score(docs.limit(0), m).count() == 0
    kept = quality.keep_good(docs, m)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    one = spark.createDataFrame([(i, 0) for i in range(4)], "doc_id long, quality int")
    assert quality.keep_good(docs, quality.fit(docs, one)).count() == 5


def test_repeated_documents_teach_once(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(("good", "fine", "word")) for _ in range(30)) if i % 2 else "!!! ??? 12 " * r.randrange(1, 9)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    models = [quality.fit(spark.createDataFrame(x, "doc_id long, text string").repartition(5), labels) for x in (rows, rows + rows[:7] * 20)]
    assert models[0].prior == models[1].prior and all((a == b).all() for x, y in zip(models[0].classes, models[1].classes, strict=True) for a, b in zip(x[:2], y[:2], strict=True))


def test_language_backoff_by_hand():
    m = langid.BackoffModel(["a", "b"], [0.5, 0.5], {"der": [9, 1], "le": [1, 9]}, {"ab": [1, 9], "gh": [9, 1], "abc": [8, 2], "ghi": [2, 8], "z": [1, 9], "k": [9, 1]})
    row = lambda g: m.gram_table[m.grams[g]].tolist()
    assert m.backoff("xabcx").tolist() == row("abc") and m.backoff("xabx").tolist() == row("ab")
    assert m.backoff("qzq").tolist() == row("z") and m.backoff("qq").tolist() == [0, 0]
    names, scores = m.predict(["der der", "xabx", None, "12 !", "qq", "Der"])
    assert names == ["a", "b", "und", "und", "a", "a"] and scores[2] == scores[3] == 0 and all(0 < s <= 1 for s in scores[:2])


def test_language_query(spark):
    from lexigrid.llm.queries import QUERIES

    told = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op9_language"](spark, MEDIUM).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == told[r.doc_id] for r in held]) > 0.98


def test_language_model_keeps_every_count(spark):
    """All words and n-grams of the examples, those seen once too, with their counts by language, by a plain count."""
    r = random.Random(6)
    texts = [(i, " ".join("".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6))) for _ in range(12)), r.choice(("de", "fr"))) for i in range(60)]
    m = langid.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    words, grams = {}, {}
    for i, text, lang in texts:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            for w in text.split():
                words.setdefault(w, [0, 0])[lang == "fr"] += 1
                for n in range(1, 6):
                    for g in langid.grams_of(w, n):
                        grams.setdefault(g, [0, 0])[lang == "fr"] += 1
    want = langid.BackoffModel(["de", "fr"], np.exp(m.prior), dict(sorted(words.items())), dict(sorted(grams.items())))
    assert list(m.words) == list(want.words) and np.allclose(m.table, want.table) and m.grams == want.grams and np.allclose(m.gram_table, want.gram_table)
    long = " ".join(w for w in words) * 300
    assert m.predict([long, "x" * 50_000])[0][0] in ("de", "fr") and len(m.table) >= len(m.words)


def test_language_edges(spark):
    docs = spark.createDataFrame([(0, "der die das", "de", 1), (2, "le la les", "fr", 2), (3, "the of and", None, 3), (None, "x", "xx", 4), (4, None, "de", 5), (4, "", "de", 6)], "doc_id long, text string, lang string, n int")
    m = langid.fit(docs)
    rows = langid.predict(docs, m).collect()
    assert len(rows) == 6 and {r.lang_pred for r in rows if r.doc_id == 4} == {"und"} and set(m.languages) <= {"de", "fr"}
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"} and langid.predict(docs.limit(0), m).count() == 0


def test_neighbours_stay_inside_texts():
    got = lmscore.neighbours(np.array([1, 2, 3, 4, 5]), np.array([3, 0, 2]), 2, 9)
    assert got.tolist() == [[9, 9, 2, 3], [9, 1, 3, 9], [1, 2, 9, 9], [9, 9, 5, 9], [9, 4, 9, 9]]


def test_network_gradient():
    net = lmscore.WindowNetwork(5, width=3, span=1, seed=1)
    for w in net.weights():
        w += np.random.default_rng(2).normal(0, 0.3, w.shape).astype(np.float32)
    around, target = np.array([[0, 4], [5, 2]]), np.array([3, 1])
    loss = lambda: -float(net.log_probs(around, target).astype(float).mean())
    before = [w.copy() for w in net.weights()]
    net.train(around, target, rate=1.0)
    step = [b - w for b, w in zip(before, net.weights(), strict=True)]
    for w, b in zip(net.weights(), before, strict=True):
        w[...] = b
    for w, g, at in ((net.group_bias, step[2], (1,)), (net.group, step[1], (0, 1)), (net.bias, step[4], (0, 1)), (net.out, step[3], (1, 0, 0)), (net.embed, step[0], (1, 4, 2))):
        w[at] += 1e-2
        up = loss()
        w[at] -= 2e-2
        down = loss()
        w[at] += 1e-2
        assert g[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_lexicon_covers_all_counts(spark):
    r = random.Random(1)
    texts = {i: " ".join(f"w{min(int(r.expovariate(0.02)), 400)}" for _ in range(200)) for i in range(40)}
    counts = {}
    for t in texts.values():
        for w in brute_words(t):
            counts[w] = counts.get(w, 0) + 1
    lex = lmscore.lexicon(frame(spark, texts), common=20, vocabulary=100)
    words = list(counts)
    hashes, _ = tk.word_hashes(*tk.text_buffers(pa.array([" ".join(words)])))
    classes, shares = lex.look_up(hashes)
    total = np.bincount(classes, weights=np.exp(shares.astype(float)), minlength=lex.size)
    assert np.allclose(total[total > 0], 1, atol=1e-3) and 50 < len(lex.hashes) <= 100
    assert {words[i] for i in np.flatnonzero(classes < 20)} <= set(sorted(words, key=lambda w: -counts[w])[:25])


def test_scores_follow_context(spark):
    """Texts of a fixed order score above their shuffled words: the network uses both sides."""
    r = random.Random(2)
    cycle = [f"c{i}" for i in range(30)]
    texts = {}
    for i in range(150):
        a = r.randrange(30)
        texts[i] = " ".join(cycle[(a + k) % 30] for k in range(60))
    model = lmscore.fit(frame(spark, texts))
    mixed = {i: " ".join(r.sample(t.split(), 60)) for i, t in texts.items()}
    mean = lambda d: np.mean([x.mean_log_likelihood for x in lmscore.score(frame(spark, d), model).collect()])
    assert mean(texts) > mean(mixed) + 0.5


def test_every_token_trains_by_default(spark):
    """Documents of 16 words teach all their words, also where none of them starts the network."""
    r = random.Random(4)
    texts = {i: " ".join(f"c{(a + k) % 30}" for k in range(16)) for i in range(8000) for a in [r.randrange(30)]}
    mixed = {i: " ".join(r.sample(t.split(), 16)) for i, t in texts.items()}
    for options in ({}, {"sample": 0}):
        model = lmscore.fit(frame(spark, texts), **options)
        mean = lambda d: np.mean([x.mean_log_likelihood for x in lmscore.score(frame(spark, d), model).collect()])  # noqa: E731,B023
        assert mean(texts) > mean(mixed) + 0.5, options


def test_words_beyond_the_broadcast_have_their_own_share(spark):
    """Scores do not depend on how many words are broadcast, also not those of rows that share an id."""
    r = random.Random(5)
    texts = [" ".join(f"w{min(int(r.expovariate(0.02)), 400)}" for _ in range(100)) for _ in range(60)]
    rows = [*enumerate(texts), (1, texts[0]), (None, texts[1]), (7, None), (8, "w0 never-seen-alone"), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda x: (x.doc_id is None, x.doc_id or 0, x.n_tokens, x.log_likelihood)
    some, every = (sorted(lmscore.score(docs, lmscore.fit(docs, common=20, vocabulary=v)).collect(), key=order) for v in (60, 10**6))
    assert len(some) == len(rows)
    for a, b in zip(some, every, strict=True):
        assert (a.doc_id, a.n_tokens) == (b.doc_id, b.n_tokens) and a.log_likelihood == pytest.approx(b.log_likelihood, abs=2e-2)
        assert (a.mean_log_likelihood is None) == (a.n_tokens == 0) and (a.n_tokens == 0 or a.mean_log_likelihood == pytest.approx(a.log_likelihood / a.n_tokens))


def test_score_equals_the_sum_over_tokens(spark):
    texts = {1: "a b c d a b", 2: "a", 3: None, 4: "..", 5: "zz yy"}
    words, net = lmscore.fit(frame(spark, texts))
    got = {r.doc_id: r for r in lmscore.score(frame(spark, texts), (words, net)).collect()}
    assert (got[3].n_tokens, got[3].log_likelihood, got[3].mean_log_likelihood) == (0, 0, None) and got[4].n_tokens == 0
    hashes, counts = tk.word_hashes(*tk.text_buffers(pa.array([texts[1]])))
    classes, shares = words.look_up(hashes)
    total = 0.0
    for i, c in enumerate(classes):
        near = [classes[i + k] if 0 <= i + k < len(classes) else words.size for k in (-2, -1, 1, 2)]
        h = np.tanh(sum(net.embed[j, n] for j, n in enumerate(near)))
        g = c // net.side
        z, y = h @ net.group + net.group_bias, (h @ net.out[g] + net.bias[g])[: net.places(g)]
        total += z[g] - np.log(np.exp(z).sum()) + y[c % net.side] - np.log(np.exp(y).sum()) + shares[i]
    assert got[1].log_likelihood == pytest.approx(total, abs=1e-3) and got[1].mean_log_likelihood == pytest.approx(total / 6, abs=1e-3)


def test_partitions_do_not_change_a_model(spark):
    r = random.Random(7)
    rows = [(i % 90, " ".join(f"w{min(int(r.expovariate(0.03)), 300)}" for _ in range(r.randrange(1, 400)))) for i in range(100)] + [(None, "w1 w2 w3"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.n_tokens, round(x.log_likelihood))
    got = []
    for n in (1, 4, 32):
        dealt = docs.repartition(n, "text")
        got.append(sorted(lmscore.score(docs, lmscore.fit(dealt)).collect(), key=key))
    for other in got[1:]:
        for a, b in zip(got[0], other, strict=True):
            assert (a.doc_id, a.n_tokens) == (b.doc_id, b.n_tokens) and a.log_likelihood == pytest.approx(b.log_likelihood, rel=1e-4)


def test_copies_score_above_their_shuffled_words(spark):
    """Documents that recur in a corpus are told from the same words in another order."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    some = [" ".join(r.choice(words) for _ in range(60)) for _ in range(8)]
    texts = dict(enumerate([*some * 40, *(" ".join(r.choice(words) for _ in range(60)) for _ in range(100))]))
    model = lmscore.fit(frame(spark, texts))
    probe = dict(enumerate([*some, *(" ".join(r.sample(t.split(), 60)) for t in some)]))
    got = {x.doc_id: x.log_likelihood for x in lmscore.score(frame(spark, probe), model).collect()}
    assert all(got[i] > got[i + 8] for i in range(8))


def test_classes_grow_with_the_vocabulary(spark):
    few, many = (lmscore.lexicon(frame(spark, {0: " ".join(f"w{i}" for i in range(n))})) for n in (50, 90_000))
    assert few.buckets == 32 and many.size == 300 and many.n == 225 and many.tokens == 90_000


def test_likelihood_edges(spark):
    empty = frame(spark, {1: None, 2: ""})
    assert lmscore.fit(empty) is None
    assert [r.log_likelihood for r in lmscore.score(empty, None).collect()] == [0, 0]
    assert lmscore.fit(empty.limit(0)) is None and lmscore.score(empty.limit(0), None).count() == 0


def test_likelihood_query(spark):
    from lexigrid.llm.queries import QUERIES

    rows = QUERIES["op3_pseudo_likelihood"](spark, SMALL).collect()
    assert len(rows) == 200 and all(r.log_likelihood < 0 and r.n_tokens > 0 for r in rows)
