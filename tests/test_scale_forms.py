"""Forms that avoid single tasks and pairs of copies, against plain Python."""

import hashlib
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import components, shared, windows
from noticeflow.sources import writers


def roots(nodes, links):
    label = {n: n for n in nodes}
    for _ in nodes:
        old = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    return label


def test_close_titles_lose_no_link(spark):
    rng = random.Random(7)
    base = ["".join(rng.choices("abcdef ghij", k=rng.choice([12, 40, 90]))) for _ in range(25)]
    rows = []
    for i in range(260):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            t[rng.randrange(len(t))] = rng.choice("xyz é")
        rows.append((i, "".join(t), rng.choice("dddde"), f"2024-01-{rng.randint(1, 9):02}"))
    rows += [(900, None, "d", "2024-01-01"), (901, "", "d", "2024-01-01"), (902, "", "d", "2024-01-02"), (903, "x" * 3000, "d", None)]
    df = spark.createDataFrame(rows, "id int, t string, d string, day string")
    got = [(r.a, r.b) for r in components.close_title_edges(df, "id", "t", "d", "day").collect()]
    links = []
    for i, t, d, day in rows:
        for j, u, e, other in rows:
            if i < j and d == e and None not in (t, u, day, other) and abs(int(day[-2:]) - int(other[-2:])) <= 2:
                if t == u or SequenceMatcher(None, t, u).ratio() >= 0.92:
                    links.append((j, i))
    assert set(got) <= set(links) and len(got) == len(set(got)) and len(got) > 100
    ids = [r[0] for r in rows]
    assert roots(ids, got) == roots(ids, links)
    assert components.close_title_edges(df.limit(0), "id", "t", "d", "day").count() == 0


def test_numbers_without_one_task(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit("x").alias("v"))
    got = {r.k: r.n for r in windows.numbered_in_order(df, ["k"], "n").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(got))}
    assert windows.numbered_in_order(df.limit(0), ["k"], "n").count() == 0
    same = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, "7")], "ord int, id string")
    assert sorted(r.id for r in windows.repair_ids(same, "id", ["ord"]).collect()) == ["7", "8", "9", "a"]


def test_sequential_quota_is_bounded_and_exact(spark):
    rng = random.Random(4)
    for total, per in ((5, 2), (12, 1), (30, 4)):
        data = [(i, f"g{int(rng.paretovariate(0.7)) % 40}", f"u{int(rng.paretovariate(0.6)) % 60}") for i in range(1500)]
        df = spark.createDataFrame(data, "ord int, g string, url string")
        taken, seen, groups = [], set(), Counter()
        for i, g, u in data:
            if len(taken) < total and groups[g] < per and u not in seen:
                taken.append(i)
                seen.add(u)
                groups[g] += 1
        assert sorted(r.ord for r in windows.sequential_quota(df, "g", ["ord"], total, per, "url").collect()) == taken


def test_large_groups_have_one_id_without_a_list(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("t").alias("reason"))
    listed = components.duplicate_groups(edges, ["t"]).collect()
    assert listed[0].members == 300 and listed[0].group_id == "dup-" + hashlib.sha256("|".join(map(str, range(300))).encode()).hexdigest()[:12]
    one, two = (components.duplicate_groups(e, ["t"], listed=100).collect() for e in (edges, edges.repartition(5)))
    assert one == two and one[0].group_id != listed[0].group_id and one[0].members == 300


def test_shared_folder_and_documents(spark):
    assert shared.shared_folder(spark) == shared.shared_folder(spark)
    with pytest.raises(ValueError):
        writers.json_document(spark.range(1), writers.DOCUMENT_ITEMS + 1)
