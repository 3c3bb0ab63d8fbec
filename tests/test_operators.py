from collections import Counter

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import aggregates, components, filters, joins, scoring, topk, windows


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_filter_settings(spark):
    df = spark.createDataFrame(
        [(1, "bid", "", "모듈러 학교", 9.0, "2024-01-05"), (2, "bid", None, "도로", 3.0, None), (3, "news", "x", "Modular", None, "2024-02-01")],
        "id int, type string, kind string, title string, score double, day string",
    )
    ids = lambda **k: [r.id for r in filters.filter_items(df, filters.ItemFilter(**k)).orderBy("id").collect()]
    assert ids() == [1, 2, 3] and ids(one_of={"type": []}) == [1, 2, 3]
    assert ids(one_of_or_blank={"kind": ["y"]}) == [1, 2] and ids(at_least={"score": 5}) == [1] and ids(at_least={"score": 0}) == [1, 2, 3]
    assert ids(between={"day": (None, __import__("datetime").date(2024, 1, 31))}) == [1]
    assert ids(containing={"title": "MODULAR"}) == [3] and ids(without={"kind": ["x"]}) == [1, 2]
    assert ids(search="bid 모듈러", search_columns=["type", "title"]) == [1] and ids(search="b.d", search_columns=["type"]) == []


def test_delete_keeps_unknown(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, v string")
    assert rows(filters.delete_where(df, F.col("v") == "a"), "id") == [(2,), (3,)]
    assert rows(filters.update_where(df, F.col("v") == "a", {"v": F.lit("z")}), "id", "v") == [(1, "z"), (2, None), (3, "b")]


def test_scoped_union_back_is_distinct(spark):
    df = spark.createDataFrame([(1, True, "g"), (2, False, "g"), (3, False, "g"), (4, False, "n")], "id int, ok boolean, s string")
    tracked = spark.createDataFrame([(3,), (3,), (1,)], "id int")
    assert rows(filters.scoped(df, F.col("ok"), F.col("s") == "g", tracked, "id"), "id") == [(1,), (3,), (4,)]


def test_merge_rules(spark):
    old = spark.createDataFrame([(1, "a", 5, {"x": "1", "y": "2"}), (2, "b", 6, None)], "id int, t string, n int, m map<string,string>")
    new = spark.createDataFrame([(1, " ", 0, {"y": "3"}), (3, "c", None, {})], "id int, t string, n int, m map<string,string>")
    got = {r.id: r for r in joins.coalescing_merge(old, new, "id").collect()}
    assert (got[1].t, got[1].n, got[1].m, got[1].origin) == ("a", 0, {"x": "1", "y": "3"}, "both")  # zero is a value
    assert (got[2].origin, got[3].origin) == ("existing", "fresh")


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string")
    batch = spark.createDataFrame([(2, "c"), (2, "d"), (3, None), (None, "n")], "id int, v string")
    out = joins.upsert(old, batch, ["id"], ["v"])
    assert Counter(r.status for r in out.collect()) == {"kept": 1, "updated": 1, "inserted": 1, "skipped": 1}
    again = joins.upsert(out.drop("status"), batch, ["id"], ["v"])
    assert Counter(r.status for r in again.collect()) == {"kept": 1, "skipped": 3}
    assert rows(out, "id", "v") == rows(again, "id", "v")


def test_diff_and_removals(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (3, "z", None)], "id int, s string, n int")
    b = spark.createDataFrame([(2, "y", 9), (3, "z", None), (4, "w", 4)], "id int, s string, n int")
    got = {r.id: (r.change, r.changed_columns) for r in joins.snapshot_diff(a, b, "id").collect()}
    assert got == {1: ("removed", []), 2: ("changed", ["n"]), 4: ("added", [])}
    allowed = spark.createDataFrame([(1, " ")], "id int, reason string")
    assert rows(joins.unapproved_removals(a, b, allowed, "id"), "id") == [(1,)]


def test_cascade_and_last_wins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, k string")
    right = spark.createDataFrame([(1, "z", 1, "one"), (9, "a", 2, "by k"), (8, "a", 1, "older")], "id int, k string, at int, v string")
    got = {r.id: (r.v, r.tier) for r in joins.cascade_lookup(left, right, [["id"], ["k"]], ["at"], ["v"]).collect()}
    assert got == {1: ("one", 0), 2: ("by k", 1), 3: (None, None)}
    right = spark.createDataFrame([("a", 1, "old"), ("a", 2, "")], "k string, at int, v string")
    out = joins.enrich_last_wins(left.withColumn("v", F.lit("own")), right, "k", ["at"], ["v"])
    assert {r.id: (r.v, r.joined) for r in out.collect()} == {1: ("own", True), 2: ("own", True), 3: ("own", False)}


def test_id_repair(spark):
    df = spark.createDataFrame([(1, "7"), (2, None), (3, "7"), (4, " "), (5, "x")], "ord int, id string")
    assert rows(windows.repair_ids(df, "id", ["ord"]), "ord", "id") == [(1, "7"), (2, "8"), (3, "9"), (4, "10"), (5, "x")]


def test_quotas(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i < 8 else "c", f"u{i % 5}") for i in range(12)], "ord int, g string, url string")
    assert rows(windows.quota_sample(df, "g", ["ord"], 5, 2), "ord") == [(0,), (1,), (2,), (3,), (8,)]
    assert windows.quota_until_full(df, "g", ["ord"], 5, 2, 4).count() == 0 and windows.quota_until_full(df, "g", ["ord"], 5, 2, 5).count() == 5
    taken, seen, groups = [], set(), Counter()
    for r in df.orderBy("ord").collect():
        if len(taken) < 4 and groups[r.g] < 2 and r.url not in seen:
            taken.append((r.ord,))
            seen.add(r.url)
            groups[r.g] += 1
    assert rows(windows.sequential_quota(df, "g", ["ord"], 4, 2, "url"), "ord") == sorted(taken, key=str)


def test_provider_states(spark):
    df = spark.createDataFrame([(i, "p", s) for i, s in enumerate([429, 500, 429, 200, 429])], "ord int, p string, s int")
    got = windows.provider_states(df, "p", ["ord"], "s").orderBy("ord").collect()
    assert [(r.strikes, r.quarantined) for r in got] == [(1, False), (1, False), (2, True), (0, False), (1, False)]


def test_components_and_groups(spark):
    edges = spark.createDataFrame([(2, 1, "t"), (3, 2, "u"), (9, 8, "u"), (5, 5, "t")] + [(i, 100, "u") for i in range(101, 150)] + [(i + 1, i, "t") for i in range(200, 260)], "a long, b long, reason string")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {2: 1, 3: 1, 9: 8} | {i: 100 for i in range(101, 150)} | {i: 200 for i in range(201, 261)}
    import hashlib

    groups = {r.root: r for r in components.duplicate_groups(edges.where("a < 20"), ["t", "u"]).collect()}
    assert groups[1].members == 3 and groups[1].reason == "t" and groups[8].reason == "u"
    assert groups[1].group_id == "dup-" + hashlib.sha256(b"1|2|3").hexdigest()[:12]


def test_close_titles(spark):
    df = spark.createDataFrame(
        [(1, "modular school building tender", "d", "2024-01-03"), (2, "modular school building tenders", "d", "2024-01-05"), (3, "modular school building tender", "d", "2024-01-06"),
         (4, "modular school building tender", "e", "2024-01-03"), (5, None, "d", "2024-01-03"), (6, "road", "d", "2024-01-03")], "id int, t string, d string, day string")
    assert rows(components.close_title_edges(df, "id", "t", "d", "day"), "a", "b") == [(2, 1), (3, 2)]


def test_histogram_keeps_empty_buckets(spark):
    df = spark.createDataFrame([(0.0,), (4.0,), (4.5,), (None,), (500.0,)], "v double")
    assert rows(aggregates.histogram(df, "v", [("a", -0.1, 0), ("b", 0, 4), ("c", 4, 7), ("d", 7, 9)]), "bucket", "n") == [("a", 1), ("b", 1), ("c", 1), ("d", 0)]


def test_evidence(spark):
    e = lambda *xs: F.array(*[F.struct(F.lit("s").alias("source"), F.lit(v).cast("string").alias("value"), F.lit(c).alias("confidence")) for v, c in xs])
    one = lambda *xs: tuple(spark.range(1).select(scoring.resolve_evidence(e(*xs)).alias("r")).first().r)
    assert one(("de", 0.95), ("fr", 0.5)) == ("de", "confirmed", 0.95)
    assert one(("de", 0.95), ("fr", 0.99)) == (None, "conflicting", None)
    assert one(("de", 0.5), ("de", 0.6)) == ("de", "inferred", 0.6)
    assert one(("de", 0.5), (None, 0.9)) == (None, "unresolved", None)


@pytest.mark.parametrize("title, body, want", [
    ("Modular housing", "prefab", "publish_candidate"), ("", "modular housing", "malformed"), ("Prefab news", "", "irrelevant"), ("Modular building and modular phone", "", "irrelevant"),
])
def test_relevance(spark, title, body, want):
    assert spark.range(1).select(scoring.relevance(F.lit(title), F.lit(body), F.lit("http://x")).alias("r")).first().r.decision == want


def test_priority_and_orders(spark):
    df = spark.createDataFrame([(1, True, 1.0, "2024-01-02"), (2, False, 9.0, None), (3, None, 2.0, "2024-01-01"), (4, True, 1.0, None)], "id int, due boolean, score double, day string")
    out = topk.priority(df, [(F.col("due"), 20), (F.col("score") >= 8, 10)], F.col("score"), "day", "id").collect()
    assert [(r.id, r.priority) for r in out] == [(1, 21.0), (4, 21.0), (2, 19.0)]
    assert [r.id for r in topk.ordered(df, "posted", "id", posted="day", score="score").collect()] == [1, 3, 2, 4]


def test_representatives_and_missing_rows_take_nulls_and_repeats(spark):
    from noticeflow.operators import joins, topk, windows

    rows = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, "a", 1), (4, None, 5)], "id int, g string, r int")
    out = windows.representatives(rows, "g", "id", [F.col("r")]).collect()
    assert {(r.g, r.representative, r.members) for r in out} == {("a", 2, 3), (None, 4, 1)}
    more = spark.createDataFrame([(1,), (9,), (9,)], "id int")
    assert [r.id for r in joins.add_missing(rows.select("id"), more, "id").collect()] == [9]
    assert [r.id for r in topk.oldest_checked(rows, "g", "id", 2).collect()] == [4, 3]
    assert windows.representatives(rows.limit(0), "g", "id", [F.col("r")]).count() == 0
