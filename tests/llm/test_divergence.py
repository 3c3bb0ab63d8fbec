"""The audit against comparing every term of every pair of sources."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least, ranks=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = {t for t, n in docs[lang].items() if n >= least}
        peers = sorted(s for l, s in groups if l == lang)
        total = lambda s: sum(n for t, n in counts[lang, s].items() if t in kept)
        level = lambda n, all_n: 1 + 10**9 * (n + 5) // (all_n + 5 * len(kept))
        p = {s: {t: level(counts[lang, s][t], total(s)) for t in kept} for s in peers}
        whole = sum(map(total, peers))
        pairs = [(s, sum(abs(p[source][t] - p[s][t]) for t in kept)) for s in peers if s != source]
        q = {t: level(sum(counts[lang, s][t] for s in peers), whole) for t in kept}
        above = [(t, p[source][t] - q[t]) for t in kept if counts[lang, source][t] and p[source][t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", above, ranks)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, r) for r, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["Über", "é", "ab", "a_b", "中", "x1y", *("".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(60))]
    rows = []
    for _ in range(500):
        lang, source = rng.choice(["de", "en", None, ""]), rng.choice([None, "s1", "s2", "s3", "s4", "hot", "hot", "hot", "é"])
        lean = len(source or "") * 7
        rows.append((" ".join(rng.choices(words[lean % 50 :] + words[:9], k=rng.randint(0, 30))), lang, source))
    rows += [rows[0]] * 20 + [(None, "en", "silent"), ("", "fr", "alone"), (None, "it", "p"), ("x", "it", "q"), ("a b " * 4000, "en", "s1")]
    return rows


@pytest.mark.parametrize("least, entries, cells", [(5, 400_000, 1 << 22), (30, 50, 3)])
def test_against_every_pair_and_term(spark, monkeypatch, least, entries, cells):
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "CELLS", cells)
    rows = corpus(least)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("value", F.lit(1)).withColumn("term", F.lit("clash")).repartition(5)
    got = divergence.audit(docs, least_docs=least)
    assert got.schema.simpleString() == "struct<lang:string,source:string,part:string,item:string,value:bigint,rank:int>"
    assert sorted(map(tuple, got.collect())) == brute(rows, least)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_tree_adds_each_pair_of_nodes_once():
    rng = np.random.default_rng(4)
    z = rng.integers(1, 50, 12)
    rows = []
    for _ in range(300):
        i = np.flatnonzero(rng.random(12) < 0.5).astype(np.int32)
        rows.append((tuple(i.tolist()), tuple((z[i] + rng.integers(1, 3, len(i))).tolist()), int(rng.integers(1, 5))))
    rows.sort(key=lambda r: list(zip(r[0], r[1])))
    want = Counter()
    for i, p, m in rows:
        for x in range(len(i)):
            for y in range(x):
                a, b = z[i[x]], z[i[y]]
                want[i[x], i[y]] += m * (abs(p[x] - p[y]) - abs(p[x] - b) - abs(p[y] - a) + abs(a - b))
    for parts in (1, 7):
        got = Counter()
        for k in range(parts):
            tree = divergence.Tree()
            for i, p, m in rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]:
                tree.insert(np.array(i, np.int32), np.array(p), z[list(i)], m)
            tree.leave(0)
            for a, values in tree.sums.items():
                for b, v in enumerate(values.tolist()):
                    got[a, b] += v
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
