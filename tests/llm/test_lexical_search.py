"""Hybrid search against scoring every document in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import lexical_search
from noticeflow.llm.byte_terms import portions

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counted = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n, tokens = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scores = []
        for i, c in counted:
            m = 25 + (75 * sum(c.values()) * n) // tokens
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n=700, words=60):
    rng = random.Random(seed)
    vocabulary = ["Wort", "x", "É", "中文", "a1", *(f"w{i}" for i in range(words))]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda m: rng.choice(" ,\n_-").join(rng.choices(vocabulary, weights, k=m))
    docs = [(i, text(rng.randint(0, 40))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(30)] + [(None, docs[7][1]), (None, None), (n + 40, ""), (3, docs[9][1]), (n + 50, "x" * 5000), (n + 51, "w1 " * 3000)]
    items = [(i, text(rng.randint(1, 15))) for i in range(25)] + [(90, None), (91, ""), (92, "absent"), (93, docs[5][1]), (94, "w1 w1 w1")]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"SHARD_DOCS": 100, "BLOCK": 4, "STRIDE": 2, "SHORT": 0.1}, {"SHARD_DOCS": 300, "BLOCK": 8, "SHORT": 0}, {"SHORT": 1}])
def test_against_scoring_every_document(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = corpus(len(limits))
    # tasks import the module anew, so only what the driver reads differs here; the shard is tried alone below
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("rank", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(0))
    got = [tuple(r) for r in lexical_search.search(d, i).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == brute(docs, items)


@pytest.mark.parametrize("block, stride, short", [(4, 1, 0.05), (4, 2, 0.3), (16, 8, 0), (128, 8, 1 / 32), (8, 2, 1)])
def test_a_shard_alone(monkeypatch, block, stride, short):
    """Every split between short and long lists, and any block, gives the same best documents."""
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "STRIDE", stride)
    monkeypatch.setattr(lexical_search, "SHORT", short)
    rng = np.random.default_rng(block)
    for _ in range(60):
        n, v = int(rng.integers(1, 400)), 30
        held = rng.random((v, n)) < np.linspace(0.01, 0.9, v)[:, None]
        tf = np.where(held, rng.integers(1, 9, (v, n)), 0)
        lengths = tf.sum(0) + 1
        there = np.flatnonzero(held.any(1))
        docs = np.concatenate([np.flatnonzero(held[t]) for t in there]) if len(there) else np.zeros(0)
        tfs = np.concatenate([tf[t][held[t]] for t in there]) if len(there) else np.zeros(0)
        shard = lexical_search.Shard(None, lengths.astype("<i8").tobytes(), there.astype(np.int32), held[there].sum(1), docs.astype("<i4").tobytes(), tfs.astype("<i4").tobytes(), n, int(lengths.sum()))
        asked = np.unique(rng.integers(0, v, 12))
        w = rng.integers(1, 3000, len(asked))
        m = 25 + (75 * lengths * n) // lengths.sum()
        scores = sum(int(x) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, x in zip(asked, w))
        for least in (1, int(np.median(scores)) + 1):
            want = sorted((-int(s), i) for i, s in enumerate(scores) if s >= least)[:10]
            places, found = shard.answer(asked, w, 10, least)
            assert list(zip((-found).tolist(), places.tolist())) == want


def test_items_in_blocks_text_ids_and_empty_tables(spark):
    docs, items = corpus(3, n=200)
    docs = [(None if i is None else f"d{i}", t) for i, t in docs]
    d = spark.createDataFrame(docs, "id string, body string")
    i = spark.createDataFrame(items + [(5, items[5][1]), (6, items[7][1])], "id int, q string")
    got = lexical_search.search(d, i, "id", "body", "id", "q", k=3, item_rows=7)
    assert got.columns == ["id", "rank", "_id", "score"]
    counted = sorted((str(tuple(r)) for r in got.collect()))
    want = []
    for row in brute([(x, t) for x, t in docs], sorted(set(items + [(6, items[7][1])]), key=str), 3):
        want.append(str(row))
    assert len(counted) == len(want)
    assert Counter(x.split(", ")[0] + x.rsplit(", ", 1)[1] for x in counted) == Counter(x.split(", ")[0] + x.rsplit(", ", 1)[1] for x in want)
    assert lexical_search.search(d.limit(0), i, "id", "body", "id", "q").count() == 0
    assert lexical_search.search(d, i.limit(0), "id", "body", "id", "q").count() == 0


def test_portions_cut_no_term():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices(["ab", "É", " ", ",", "Z9"], k=rng.randint(0, 60))).encode()
        whole = text.translate(lexical_search.TABLE).split()
        assert [t for ts in portions(text, lexical_search.TABLE, rng.randint(1, 9)) for t in ts] == whole
