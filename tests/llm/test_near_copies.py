"""Near copies by exact five-word similarity against brute force over all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from noticeflow.llm import simhash
from noticeflow.llm.common import Scratch
from noticeflow.llm.confirm import confirmed, shingle_hashes


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def similar(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))  # Jaccard of 0.8 or more


def components(sets):
    label = {k: k for k in sets}
    keys = sorted(sets)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if similar(sets[a], sets[b])]
    for a, b in links:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}, links


def edited(rng, words, vocab, share):
    """Words replaced, inserted and deleted one by one, or a block put in, until about that share differs."""
    w = list(words)
    if rng.random() < 0.25:
        at = rng.randrange(len(w))
        return w[:at] + rng.choices(vocab, k=max(1, int(len(w) * share * 4))) + w[at:]
    for _ in range(max(1, int(len(w) * share))):
        at = rng.randrange(len(w))
        w[at : at + rng.choice([0, 1, 1, 1])] = rng.choices(vocab, k=rng.choice([0, 1, 1, 1]))
    return w


def corpus(groups=60, seed=11):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]
    out = []
    for g in range(groups):
        base = rng.choices(vocab, k=rng.choice([60, 120, 300, 900]))
        out.append(" ".join(base))
        for _ in range(rng.choice([1, 1, 3]) if g else 60):
            out.append(" ".join(edited(rng, base, vocab, rng.choice([0.003, 0.01, 0.02]))))
    out += [" ".join(rng.choices(vocab, k=rng.choice([1, 3, 4, 5, 40, 200]))) for _ in range(150)]
    rng.shuffle(out)
    return out + [None, "", " \n", "one two", "One  two", "three", "w " * 30_000, "w " * 30_001 + "v", "A B c D e f", "a b C d E F"]


def test_recall_and_exactness(spark):
    rows = list(enumerate(corpus()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit(1))
    got = {r.doc_id: r for r in simhash.near_copies(docs, shard_rows=100).collect()}
    assert len(got) == len(rows)
    sets = {i: shingles(t) for i, t in rows}
    whole, links = components(sets)
    assert len(links) > 200
    caught = [got[a].component_id == got[b].component_id for a, b in links]
    assert np.mean(caught) >= 0.97
    for i, r in got.items():  # no link that is not one: found components lie within the true ones
        assert whole[i] == whole[r.component_id] and r.kept == (i == r.component_id) and r.component_id <= i
    kept = {r.doc_id for r in simhash.drop_similar(docs).collect()}
    assert kept == {i for i, r in got.items() if r.kept}
    n = len(rows)
    assert [got[n - 10 + k].component_id for k in range(10)] == [n - 10] * 3 + [n - 7] * 2 + [n - 5, n - 4, n - 3, n - 2, n - 2]


def test_confirmed_links_every_component(spark):
    """Groups that the search connected wrongly or as chains come apart exactly as brute force says."""
    rng = random.Random(2)
    sets, root = {}, {}
    for g in range(30):
        base = [rng.randrange(1 << 40) for _ in range(40)]
        for _ in range(rng.choice([1, 2, 5, 40])):
            k = len(sets)
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                own[rng.randrange(40)] = rng.randrange(1 << 40)
            sets[k], root[k] = set(own), g // 3
    df = spark.createDataFrame([(k, root[k], list(s)) for k, s in sets.items()], "rid long, root long, shingles array<bigint>")
    for leaders in (1, 4):
        edges = [(r.a, r.b) for r in confirmed(df, Scratch(spark, "t"), 0.8, leaders).collect()]
        assert all(similar(sets[a], sets[b]) and root[a] == root[b] for a, b in edges)
        label = {k: k for k in sets}
        for _ in range(50):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        for g in set(root.values()):
            own = {k: s for k, s in sets.items() if root[k] == g}
            want, _ = components(own)
            assert {k: label[k] for k in own} == want
    assert confirmed(df.limit(0), Scratch(spark, "t"), 0.8).count() == 0


def test_shingle_hashes_and_odd_rows(spark):
    texts = [None, "", "a", "a b c d e", "a b c d e f a b c d e", " A  b\tc d e "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", shingle_hashes(F.col("t"), 5).alias("h"))
    h = {r.i: r.h for r in df.collect()}
    assert [len(h[i]) for i in range(6)] == [len(shingles(t)) for t in texts] == [1, 1, 1, 1, 6, 1] and h[0] == h[1] and h[3] == h[5]
    same = spark.createDataFrame([(None, "x y"), (None, "x y"), (3, "x y"), (3, "x y"), (1, "z")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text) for r in simhash.drop_similar(same).collect())
    assert got == [(1, "z"), (3, "x y")]
    assert simhash.drop_similar(same.limit(0)).count() == 0
