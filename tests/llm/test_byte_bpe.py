import base64
import hashlib
import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import byte_bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def model():
    with open(FILE, "rb") as f:
        return byte_bpe.Bpe(f.read(), P.PATTERN)


@pytest.fixture(scope="module")
def reference(model):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=model.ranks, special_tokens={})


def texts():
    rng = random.Random(2)
    parts = ["a", "é", "the", "\n", " ", "  ", "中", "1", "🙂", "%", " ", "'s", "nt", "ing", "ß", "\x1c", "͸", "<|endoftext|>"]
    out = ["".join(rng.choices(parts, k=rng.randint(0, 200))) for _ in range(400)]
    return out + [None, "", " ", "a" * 3000, "ab" * 400, "the " * 20000, "é" * 129, "x" * 257]


def test_like_the_library(model, reference):
    for t, ids in zip(texts(), model.encode_batch(texts())):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t or "")
        assert model.decode(ids) == (t or "").encode()


def test_heap_and_matrix_agree(model):
    rng = random.Random(4)
    for _ in range(200):
        piece = bytes(rng.choices(b"aeinst \xc3\xa9", k=rng.randint(2, 120)))
        out = [b""]
        model.merge_matrix([piece], 128, out, [0])
        assert out[0] == model.merge_long(piece)


def heap_merge(model, piece):
    """Single merges by a heap of (rank, place), neighbours as linked places."""
    pair = {(a, b): r for t, r in model.ranks.items() for i in range(1, len(t)) if (a := model.ranks.get(t[:i])) is not None and (b := model.ranks.get(t[i:])) is not None}
    ids = [model.ranks[bytes([c])] for c in piece]
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = lambda i: pair.get((ids[i], ids[after[i]])) if i >= 0 and after[i] < n else None
    heap = [(r, i) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if ids[i] < 0 or rank(i) != r:
            continue
        j = after[i]
        ids[i], ids[j], after[i] = r, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if (q := rank(k)) is not None:
                heapq.heappush(heap, (q, k))
    return [x for x in ids if x >= 0]


class Small:
    """A model of a small made-up vocabulary in which merges often make pairs of lower rank."""

    def __init__(self, seed):
        rng = random.Random(seed)
        tokens = [bytes([i]) for i in range(256)]
        while len(tokens) < 300:
            t = rng.choice(tokens[97:100] + tokens[256:]) + rng.choice(tokens[97:100] + tokens[256:])
            if t not in tokens and len(t) < 9:
                tokens.append(t)
        more = tokens[256:]
        rng.shuffle(more)
        lines = b"\n".join(base64.b64encode(t) + b" %d" % r for r, t in enumerate(tokens[:256] + more))
        self.model = byte_bpe.Bpe(lines, P.PATTERN)


def test_long_rows_against_single_merges(model):
    rng = random.Random(8)
    for alphabet in (b"a", b"ab", b"aeinst", b"abcdefghijklmnopqrstuvwxyz0123456789"):
        for n in (257, 1000, 5000):
            piece = bytes(rng.choices(alphabet, k=n))
            assert np.frombuffer(model.merge_long(piece), "<u4").tolist() == heap_merge(model, piece)
    for seed in range(30):
        small = Small(seed).model
        for n in (2, 3, 7, 40, 400):
            piece = bytes(rng.choices(b"abc", k=n))
            assert np.frombuffer(small.merge_long(piece), "<u4").tolist() == heap_merge(small, piece)


def test_every_code_point_is_cut_alike(model, reference):
    """A vocabulary that joins 'a', '1' and '!' to any character shows what the pattern takes as a piece."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for base in "a1!":
        ranks = {bytes([i]): i for i in range(256)}
        for c in every:
            ranks.setdefault((base + c).encode(), len(ranks))
        shown = tiktoken.Encoding("shown" + base, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for at in range(0, len(every), 100_000):
            text = "".join(f"{base}{c}\n\n" for c in every[at : at + 100_000])
            want = shown.encode_ordinary(text)
            pieces = {p for p in model.split(text) if p[0] == base and len(p) == 2}
            joined = {c for c in every[at : at + 100_000] if base + c in pieces}
            got = set(want)
            assert joined == {c for c in every[at : at + 100_000] if ranks[(base + c).encode()] in got}


def test_query_columns(spark, reference):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = byte_bpe.digest(byte_bpe.round_trip(docs, FILE, P.PATTERN), "doc_id").collect()
    assert len(got) == len(rows)
    for r in got:
        t = rows[r.doc_id][1] or ""
        ids = reference.encode_ordinary(t)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert byte_bpe.round_trip(docs.limit(0), FILE, P.PATTERN).count() == 0
