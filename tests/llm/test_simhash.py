import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from noticeflow.llm import simhash


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    ids = [i for i, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for k in range(len(rows)):
        low[find(k)] = min(low.get(find(k), ids[k]), ids[k])
    return {ids[k]: low[find(k)] for k in range(len(rows))}


def texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(300)]
    base = [rng.choices(vocab, k=rng.choice([1, 2, 3, 40, 400])) for _ in range(60)]
    out = []
    for w in base:
        for _ in range(rng.randint(1, 4)):
            w = list(w)
            if len(w) > 30 and rng.random() < 0.8:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(rng.choice([" ", "\n", " \t"]).join(w) if rng.random() < 0.5 else " ".join(w).upper())
    return out + [None, "", " \n", "One", "one  two", "é x y z", "word " * 30000]


def test_documents(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))
    got = {r.doc_id: r for r in simhash.near_dedup(docs).collect()}
    fps = [(i, brute_fp(t)) for i, t in rows]
    assert all(got[i].fingerprint == f"{f:016x}" for i, f in fps)
    assert {i: got[i].component_id for i, _ in fps} == brute_components(fps)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(fps).values()))


@pytest.mark.parametrize("shard_rows", [50, 8192])
def test_pairs_across_boundaries(spark, shard_rows):
    """Chains and dense balls of close fingerprints, over many small shards: no link is lost."""
    rng = np.random.default_rng(3)
    points = set(int(x) for x in rng.integers(0, 2**64, 700, np.uint64))
    for c in rng.integers(0, 2**64, 12, np.uint64):
        x = int(c)
        for _ in range(60):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            points.add(x)
            if rng.random() < 0.5:
                x = int(c)
    rows = [(i, x) for i, x in enumerate(sorted(points))]
    fps = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for _, x in rows], "fp long")
    edges = simhash.link_edges(fps, shard_rows).collect()
    unsigned = lambda v: v & (2**64 - 1)
    number = {x: i for i, x in rows}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        i, j = sorted((find(number[unsigned(e.a)]), find(number[unsigned(e.b)])))
        root[j] = i
    assert {i: find(i) for i, _ in rows} == brute_components(rows)


def test_repeated_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "q r s t"), (2, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_copies(docs).collect()) == [(0, "q r s t"), (1, "a b c d")]
    assert simhash.near_dedup(docs.limit(0)).count() == 0
