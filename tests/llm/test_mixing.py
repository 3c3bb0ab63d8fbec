import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from noticeflow.llm import mixing
from noticeflow.llm.common import Scratch


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, rest = {}, set(), share * sum(sizes.values())
    while True:
        left = [s for s in names if s not in full]
        total = sum(w[s] for s in left)
        for s in left:
            target[s] = rest * w[s] / total
        over = [s for s in left if target[s] > most * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
            full.add(s)
        if len(full) == len(names):
            return target


def rows():
    out = []
    for i in range(3000):
        source = None if i % 11 == 0 else f"src{i % 3}" if i % 2 else "é" if i % 5 == 0 else f"s{i % 40}"
        out.append((i, None if i % 97 == 0 else "w " * (i % 83) + ("\n" if i % 2 else "x"), source))
    return out + [(5000, "long " * 30000, "src0"), (5001, "", "only empty"), (5002, "\x0b a\x0cb\t", "tiny")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, source string").withColumn("shard", F.lit("mine"))


def test_draws(docs):
    got = {r.doc_id: r for r in mixing.draws(docs).collect()}
    assert len(got) == len(rows())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t, s in rows():
        assert got[i].size == size(t) and got[i].taken == got[i].size * len(got[i].shards) <= 2 * got[i].size
        sizes[s] += size(t)
        taken[s] += got[i].taken
        longest[s] = max(longest[s], size(t))
    target = brute_targets(sizes)
    for i, _, s in rows():
        assert got[i].source_size == sizes[s] and got[i].target == pytest.approx(target[s])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1
    assert {r.doc_id: r for r in mixing.draws(docs).collect()} == got


def test_mix_rows(docs):
    drawn = {r.doc_id: r.shards for r in mixing.draws(docs).collect()}
    out = mixing.mix(docs).collect()
    copies = defaultdict(list)
    for r in out:
        assert r.shard == "mine"
        copies[r.doc_id].append(r["_shard"])
    assert {k: sorted(v) for k, v in copies.items()} == {k: sorted(v) for k, v in drawn.items() if v}


def test_tree_splits_quotas_exactly(spark):
    q = [(0, 500), (1, 37), (2, 0), (3, 1)]
    quotas = spark.createDataFrame(q, "place int, q long")
    got = mixing.shard_quotas(quotas, 3, Scratch(spark, "t"), 1).collect()
    per_shard, per_place = defaultdict(int), defaultdict(int)
    for r in got:
        per_shard[r.shard] += r.q
        per_place[r.place] += r.q
    assert per_place == {0: 500, 1: 37, 3: 1} and sum(per_shard.values()) == 538
    assert len(per_shard) == 8 and max(per_shard.values()) - min(per_shard.values()) <= 1
    ones = [r.q for r in got if r.place == 1]
    assert max(ones) <= 12  # 37 draws over 8 shards, hypergeometric


def test_edges(spark):
    one = spark.createDataFrame([(1, "a b c", None), (1, "a b c", None), (None, None, None)], "doc_id long, text string, source string")
    got = mixing.draws(one).collect()
    assert len(got) == 3 and all(r.source_size == 6 and r.target == 9.0 for r in got)
    assert mixing.draws(one.limit(0)).count() == 0 and mixing.mix(one.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.draws(one.withColumn("text", F.lit(" "))).collect())


@pytest.mark.parametrize("n, q, left", [(1, 1, 1), (5, 5, 3), (5, 0, 3), (10, 4, 0), (10, 4, 10), (7, 3, 5), (40, 25, 20), (300, 17, 150), (3000, 1400, 1500)])
def test_counts_follow_the_hypergeometric_law(spark, n, q, left):
    """Of evenly spread uniforms each value gets its probability's share, to one."""
    m = 4000
    u = (F.col("id") + 0.5) / m
    drawn = spark.range(m).select(mixing.hypergeometric(*(F.lit(v).cast("long") for v in (n, q, left)), u).alias("x"))
    got = Counter(r.x for r in drawn.collect())
    for x in range(q + 1):
        p = math.comb(q, x) * math.comb(n - q, left - x) / math.comb(n, left) if left - x >= 0 else 0
        assert abs(got.pop(x, 0) - m * p) <= 1.01
    assert not got


def test_large_counts_stay_near_their_mean(spark):
    n, q, left = 8_000_000, 2_500_000, 4_000_000
    u = (F.col("id") + 0.5) / 50
    xs = [r.x for r in spark.range(50).select(mixing.hypergeometric(*(F.lit(v).cast("long") for v in (n, q, left)), u).alias("x")).collect()]
    deviation = math.sqrt(left * (q / n) * (1 - q / n) * (n - left) / (n - 1))
    assert all(abs(x - left * q / n) < 6 * deviation for x in xs)
    assert 0.5 < (sum((x - left * q / n) ** 2 for x in xs) / 50) ** 0.5 / deviation < 1.5


def test_a_deep_tree(spark):
    quotas = spark.createDataFrame([(i, 40 + i) for i in range(30)], "place int, q long")
    got = mixing.shard_quotas(quotas, 7, Scratch(spark, "deep"), 3).collect()
    per_place, per_shard = Counter(), Counter()
    for r in got:
        per_place[r.place] += r.q
        per_shard[r.shard] += r.q
    assert per_place == {i: 40 + i for i in range(30)} and len(per_shard) == 128 and max(per_shard.values()) - min(per_shard.values()) <= 1


def test_partitions_are_bounded(docs, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PARTS", 2)
    monkeypatch.setattr(mixing, "PART_SHARDS", 1)
    out = mixing.mix(docs)
    assert out.rdd.getNumPartitions() <= 2
    assert len({r["_shard"] for r in out.select("_shard").distinct().collect()}) > 2  # more shards than partitions
