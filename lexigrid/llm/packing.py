"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A document costs ``length + quadratic * length**2`` (its matrix products grow
linearly, its attention with the square). Inside a block of some million tokens
the documents are taken in descending cost and each goes to the sequence of
lowest cost that still has room for it; a document longer than a sequence first
fills whole sequences of its own, and what no sequence has room for is cut over
the lowest-cost ones. A block has as many full sequences as its tokens fill; the
tokens that are left over make sequences of powers of two, which need no padding.

A block is packed by the task that tokenised it, and its ids stay there but for the
rest (fewer than a sequence's tokens): the rests of GROUP neighbouring tasks meet in a
second, small pass, which packs them in the same way and ends in sequences of powers
of two. Memory follows the block, the group's rests and the longest document.

Edge cases: a null or empty text is the end-of-document id alone; a null doc_id
is carried as null; repeated rows are documents of their own; equal lengths are
taken in input order; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, tidy

WINDOW, END_ID, BLOCK_TOKENS = 4096, 2, 4_000_000
#: Attention against matrix products for a model width of 4096: L / (6 d).
QUADRATIC = 1 / (6 * 4096)
VOCABULARY = "word_bpe_49k.json"
#: White-space pieces whose ids a worker remembers before it starts anew.
PIECES = 150_000
#: Tasks (a power of two) whose blocks' rests are packed together, and what their sequences' ids start at.
GROUP, _RESTS = 256, 1 << 62
#: Separators to Python that are ordinary characters to the tokenizer.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Characters without combining marks, which composition leaves as they are.
_LATIN = re.compile("[\x01-\u024f]*").fullmatch


class ByteMerges:
    """The vocabulary's merges run by a faster engine, for pieces of Latin characters.

    That engine joins neighbours whose joint text is a token, the vocabulary those
    that it lists as a merge. The two agree on every text if each token's own text
    is merged back to that token: the first joint that is not a listed merge would
    end the run on its token's own text too. ``sound`` says whether that holds.
    """

    WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n"
    END = "</w>"

    def __init__(self, path: str):
        with open(path) as f:
            told = json.load(f)
        model, self.special = told["model"], [t["content"] for t in told["added_tokens"]]
        vocabulary, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.sound = model["end_of_word_suffix"] == self.END and self._closed(vocabulary, merges)
        if not self.sound:
            return
        byte = {c: b for b, c in enumerate(_byte_letters())}

        def raw(token: str) -> bytes:
            end = token.endswith(self.END) and token != self.END
            return bytes(byte[c] for c in (token[: -len(self.END)] if end else token)) + b"\0" * end

        # A word is closed by a zero byte; a byte that closes a word is one symbol, so that joint comes first.
        ranks = {raw(c + self.END): k for k, c in enumerate(byte)}
        ids = {k: vocabulary[c + self.END] for k, c in enumerate(byte)}
        for k, (x, y) in enumerate(merges, 256):
            ranks[raw(x + y)], ids[k] = k, vocabulary[x + y]
        for k, c in enumerate(byte, 256 + len(merges)):
            ranks[bytes([byte[c]])], ids[k] = k, vocabulary[c]
        self.ids = np.array([ids[k] for k in range(len(ids))], np.uint32)
        self.line = vocabulary[_byte_letters()[10] + self.END]
        self.ranks = ranks
        self._start()

    def _start(self) -> None:
        import regex
        import tiktoken

        self.words = regex.compile(self.WORD)
        self.engine = tiktoken.Encoding("merges", pat_str=r"[^\x00]+\x00", mergeable_ranks=self.ranks, special_tokens={})

    def __getstate__(self) -> dict:
        """What workers get: tables, from which each starts its engine without reading the vocabulary."""
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "engine")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if self.sound:
            self._start()

    @classmethod
    def _closed(cls, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> bool:
        order = {m: k for k, m in enumerate(merges)}
        for x, y in merges:
            symbols = list(x + y)
            if (x + y).endswith(cls.END):
                symbols[-len(cls.END) - 1 :] = ["".join(symbols[-len(cls.END) - 1 :])]
            while len(symbols) > 1:
                at = min(range(len(symbols) - 1), key=lambda i: order.get((symbols[i], symbols[i + 1]), len(order)))
                if (symbols[at], symbols[at + 1]) not in order:
                    return False
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return len({x + y for x, y in merges}) == len(merges) and all(c in vocabulary and c + cls.END in vocabulary for c in _byte_letters())

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids in one array, and the number of each."""
        words = self.words.findall("\n".join(pieces).lower() + "\n")
        ids = self.ids[self.engine.encode_to_numpy("\0".join(words) + "\0")]
        ends = np.flatnonzero(ids == self.line)
        sizes = np.diff(np.concatenate(([-1], ends))) - 1
        return np.delete(ids, ends), sizes


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PieceIds:
    """Ids of texts through remembered ids of their white-space pieces.

    The vocabulary drops white space and never joins over it, so a text's ids are
    its pieces' ids in order. Pieces of other than Latin characters, and all if the
    merges are not sound, go through the tokenizer itself.
    """

    def __init__(self, path: str, merges: ByteMerges | None = None, pieces: int = PIECES):
        self.path, self.pieces, self.merges = path, pieces, merges or ByteMerges(path)
        self._forget()

    @cached_property
    def tokenizer(self):
        """Loaded only where some piece needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, new: list[str]) -> None:
        latin = [w for w in new if _LATIN(w) and not ("<" in w and any(t in w for t in self.merges.special))] if self.merges.sound else []
        if latin:
            self._keep(latin, *self.merges.encode(latin))
        if rest := [w for w in new if w not in self.known] if len(latin) < len(new) else []:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            self._keep(rest, np.array([i for ids in got for i in ids], np.uint32), np.fromiter(map(len, got), np.int64, len(got)))

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids, END_ID last."""
        if len(self.known) > self.pieces:
            self._forget()
        odd = {k for k, x in enumerate(texts) if _ODD_SPACE.search(x)}
        split = [[] if k in odd else x.split() for k, x in enumerate(texts)]
        words = [w for ws in split for w in ws]
        if new := list(set(words).difference(self.known)):
            self._learn(new)
        slots = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[slots]
        ends = np.cumsum(sizes)
        where = np.repeat(self.starts[slots] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        ids = self.flat[where]
        cuts = np.cumsum([len(ws) for ws in split])
        edges = np.concatenate(([0], ends))[np.concatenate(([0], cuts))]
        out = [np.append(ids[i:j], np.uint32(END_ID)) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        for k in odd:
            out[k] = np.array([*self.tokenizer.encode(texts[k], add_special_tokens=False).ids, END_ID], np.uint32)
        return out


@lru_cache(1)
def byte_merges(path: str) -> ByteMerges:
    """Read and proven once, by the driver."""
    return ByteMerges(path)


_encoders: dict[str, PieceIds] = {}


def piece_ids(path: str, merges: ByteMerges) -> PieceIds:
    """A worker's encoder, which serves all its tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceIds(path, merges)
    return _encoders[path]


def _forget_pieces() -> None:
    for x in _encoders.values():
        x._forget()


def pack(lengths: list[int], window: int = WINDOW, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every token once; what fills no sequence makes powers of two."""
    pieces, rest, full = pack_full(lengths, window, quadratic)
    tail, room, power = sum(n for *_, n in rest), [], 1 << max(0, window.bit_length() - 1)
    while tail:  # the larger first
        power = min(power, 1 << (tail.bit_length() - 1))
        room.append(power)
        tail -= power
    b, at = 0, 0
    for d, start, n in rest:
        while n:
            take = min(n, room[b] - at)
            pieces.append((d, start, take, full + b, at))
            n, start, at = n - take, start + take, at + take
            if at == room[b]:
                b, at = b + 1, 0
    return pieces


def pack_full(lengths: list[int], window: int = WINDOW, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]], int]:
    """Pieces in full sequences, those (document, start, length) of fewer tokens than a window that are left, and the number of sequences."""
    pieces, made, rest = [], 0, []
    for d, n in enumerate(lengths):
        for k in range(n // window):
            pieces.append((d, k * window, window, made, 0))
            made += 1
        if n % window:
            rest.append((n % window, d, n - n % window))
    rest.sort(key=lambda x: (-x[0], x[1]))
    full = sum(x[0] for x in rest) // window
    room = [window] * full
    heap = [(0.0, b) for b in range(full)]
    waiting: dict[int, list[tuple[float, int]]] = {}  # sequences by the room they have, too small for what is being placed
    cut, size = [], window

    def place(d: int, start: int, n: int, cost: float, b: int, offset: int) -> float:
        pieces.append((d, start, n, made + b, offset))
        return cost + n + quadratic * n * n

    for n, d, start in rest:
        for r in range(size - 1, n - 1, -1):
            for x in waiting.pop(r, ()):
                heapq.heappush(heap, x)
        size = n
        while heap and room[heap[0][1]] < n:
            x = heapq.heappop(heap)
            waiting.setdefault(room[x[1]], []).append(x)
        if not heap:
            cut.append((n, d, start))
            continue
        cost, b = heapq.heappop(heap)
        cost = place(d, start, n, cost, b, window - room[b])
        room[b] -= n
        if room[b]:
            heapq.heappush(heap, (cost, b))
    for xs in waiting.values():
        for x in xs:
            heapq.heappush(heap, x)
    left = []
    for n, d, start in cut:
        while n and heap:
            cost, b = heapq.heappop(heap)
            take = min(n, room[b])
            cost = place(d, start, take, cost, b, window - room[b])
            room[b] -= take
            n, start = n - take, start + take
            if room[b]:
                heapq.heappush(heap, (cost, b))
        if n:
            left.append((d, start, n))
    return pieces, left, made + full


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: A rest's row: sequence_id tells its place among its task's, ids holds its tokens.
_REST_SCHEMA = SCHEMA + ", ids binary"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _packer(path: str, shared, window: int, quadratic: float, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, docs, ids, held, rests = piece_ids(path, shared.value), [], [], 0, 0
        task = TaskContext.get().partitionId() << 40
        base = task

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, docs, ids, held, rests
            got, left, made = pack_full([len(x) for x in ids], window, quadratic)
            columns = [
                [docs[d] for d, *_ in got], [x[1] for x in got], [x[2] for x in got], [_crc(ids[d][s : s + n]) for d, s, n, *_ in got],
                [len(ids[d]) for d, *_ in got], [base + x[3] for x in got], [x[4] for x in got],
            ]
            more = [
                [docs[d] for d, *_ in left], [x[1] for x in left], [x[2] for x in left], [None] * len(left),
                [len(ids[d]) for d, *_ in left], [task + rests + k for k in range(len(left))], [None] * len(left),
            ]
            tokens = [None] * len(got) + [ids[d][s : s + n].astype("<u4").tobytes() for d, s, n in left]
            base, rests = base + made, rests + len(left)
            docs, ids, held = [], [], 0
            yield pa.RecordBatch.from_arrays([*(pa.array(a + b, pa.int64()) for a, b in zip(columns, more, strict=True)), pa.array(tokens, pa.binary())], names=[*_NAMES, "ids"])

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for i in range(0, batch.num_rows, 256):
                for d, got in zip(names.slice(i, 256).to_pylist(), encoder.encode([x or "" for x in texts.slice(i, 256).to_pylist()]), strict=True):
                    docs.append(d)
                    ids.append(got)
                    held += len(got)
                if held >= block_tokens:
                    yield from flush()
        if docs:
            yield from flush()

    return run


def _rest_packer(window: int, quadratic: float):
    def run(key: tuple, rests: pa.Table) -> pa.Table:
        rows = rests.sort_by("sequence_id").to_pylist()
        ids = [np.frombuffer(r["ids"], "<u4") for r in rows]
        base, out = _RESTS | (key[0].as_py() << 40), {c: [] for c in _NAMES}
        for d, s, n, sequence, offset in pack([len(x) for x in ids], window, quadratic):
            r = rows[d]
            for c, v in zip(_NAMES, (r["doc_id"], r["start"] + s, n, _crc(ids[d][s : s + n]), r["doc_tokens"], base + sequence, offset), strict=True):
                out[c].append(v)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, quadratic: float = QUADRATIC, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece; ``path`` names the vocabulary file (default: the public one of this environment)."""
    spark = prepare(docs.sparkSession)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    shared = spark.sparkContext.broadcast(byte_merges(path))  # a vocabulary's merges
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = cut.mapInArrow(tidy(_packer(path, shared, window, quadratic, block_tokens), _forget_pieces), _REST_SCHEMA).checkpoint()
    rests = made.filter("ids is not null").withColumn("tasks", F.shiftright(F.shiftrightunsigned("sequence_id", 40), GROUP.bit_length() - 1))
    packed = rests.groupBy("tasks").applyInArrow(_rest_packer(window, quadratic), SCHEMA)
    return made.filter("ids is null").drop("ids").unionByName(packed)
