import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexigrid.llm import packing as pk
from tests_llm_common import SMALL, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    return [[*e.ids, 2] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, texts, window=4096):
    """Every id once, sequences without gaps, and no padding but at full length or a power of two."""
    want = dict(zip(texts, ids_of(texts.values()), strict=True))
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.doc_tokens == len(want[r.doc_id]) and r.length > 0
        of[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(of) == set(want)
    for d, pieces in of.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == len(want[d])
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window and at & (at - 1) == 0


def test_fast_merges_equal_the_tokenizer():
    encoder = pk.PieceIds(PATH, pieces=2000)
    assert encoder.merges.sound
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFéèüßÑİıſ0123456789'.,!?-_#$%&*()[]{}<>|/\\\"~`^+=:;@²½ªµ\x00\x01\x1c\x1f\x7f\x85\xa0́ͅΣΑ漢字😀‍\n\t "
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(4000)]
    texts += ["".join(r.choice("thnderioas'") for _ in range(r.randrange(1, 30))) for _ in range(8000)]
    texts += ["<|endoftext|>x <|startoftext|>", "it's don't WE'LL", "ÀÉ" * 50, "a" * 5000, "", " \n "]
    for i in range(0, len(texts), 500):
        assert [x.tolist() for x in encoder.encode(texts[i : i + 500])] == ids_of(texts[i : i + 500])


def test_unsound_merges_are_not_used():
    assert not pk.ByteMerges._closed({"a": 0, "b": 1}, [("a", "b"), ("ab", "c"), ("b", "c"), ("x", "bc")])


@pytest.mark.parametrize("seed", range(6))
def test_packing_keeps_every_token(seed):
    r = random.Random(seed)
    window = r.choice((16, 64, 4096))
    lengths = [r.choice((1, 2, r.randrange(1, window), r.randrange(1, 3 * window), window)) for _ in range(r.choice((0, 1, 5, 300)))]
    got = pk.pack(lengths, window)
    held = defaultdict(int)
    for d, start, n, s, offset in got:
        assert 0 < n <= window and offset + n <= window
        held[s] += n
    for d, n in enumerate(lengths):
        at = 0
        for start, size in sorted((x[1], x[2]) for x in got if x[0] == d):
            assert start == at
            at += size
        assert at == n
    assert all(n & (n - 1) == 0 for n in held.values()) and set(held) == set(range(len(held)))


def test_costs_are_balanced():
    r = random.Random(2)
    lengths = [r.randrange(50, 2000) for _ in range(3000)]
    costs = defaultdict(float)
    sizes = defaultdict(int)
    for _, _, n, s, _ in pk.pack(lengths):
        costs[s] += n + pk.QUADRATIC * n * n
        sizes[s] += n
    full = [costs[s] for s in costs if sizes[s] == 4096]
    assert np.std(full) / np.mean(full) < 0.01


def test_documents(spark):
    r = random.Random(4)
    texts = {d: " ".join(r.choice(("the", "idiot's", "Éa", "12", "x" * 9)) for _ in range(r.choice((0, 3, 200, 6000)))) for d in range(80)} | {900: None, 901: "", 902: "a\x1cb 漢"}
    check(pk.pack_documents(frame(spark, texts), block_tokens=20_000).collect(), texts)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b", "x"), (1, "same", None), (1, "same", "y")], "doc_id long, text string, length string")
    got = sorted(((r.doc_id or -1), r.length) for r in pk.pack_documents(df).collect())
    assert [d for d, _ in got].count(1) >= 2 and sum(n for _, n in got) == 3 + 2 + 2
    assert pk.pack_documents(df.limit(0)).count() == 0


def test_query_on_small_tables(spark):
    from lexigrid.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check(QUERIES["op6_packed_sequences"](spark, SMALL).collect(), texts)


def test_rests_of_tasks_are_packed_together(spark):
    """Many small tasks leave no more short sequences than one group's powers of two."""
    texts = {d: " ".join(["word"] * (1 + d % 37)) for d in range(640)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(64)
    rows = pk.pack_documents(df).collect()
    check(rows, texts)
    held = defaultdict(int)
    for r in rows:
        held[r.sequence_id] += r.length
    assert sum(n < 4096 for n in held.values()) <= 12 and sum(held.values()) == sum(len(x) for x in ids_of(texts.values()))


def test_workers_start_from_tables_alone():
    import pickle

    a = pk.ByteMerges(PATH)
    b = pickle.loads(pickle.dumps(a))
    assert all((x == y).all() for x, y in zip(a.encode(["Hello", "wörld"]), b.encode(["Hello", "wörld"]), strict=True))
    assert "tokenizer" not in pk.PieceIds(PATH, b).__dict__
