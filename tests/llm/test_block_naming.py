import hashlib

import pytest
from pyspark.sql import functions as F

from noticeflow.llm import block_naming

WS = " \t\n\x0b\x0c\r"
LONG = "abcdefghij " * 300


def norm(t):
    return "".join(c for c in t or "" if c not in WS)


ROWS = [
    (1, "a b c"), (2, "abc"), (3, "a  b\tc\n"), (4, None), (5, ""), (6, " \n"), (7, "a bc"),
    (8, LONG), (9, LONG + "x"), (10, LONG.replace(" ", "\n")), (11, LONG[:-9]), (12, "é" * 700), (13, "é" * 699),
    (14, "abc"), (14, "abc"), (None, "abc"), (15, "zz"), (15, "zz"), (16, "zz  "), (17, "solo"), (17, "other"),
]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0))
    return sorted(
        (i if i is not None else -1, None if (b := min(groups[norm(t)]))[1] else b[2], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest())
        for i, t in rows
    )


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda b: F.octet_length(b).cast("long")])
@pytest.mark.parametrize("size", [64, 2048])
def test_against_brute_force(spark, hashed, size):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("name", F.lit("x")).withColumn("h", F.lit(1))
    got = block_naming.exact_dedup(docs, block_bytes=size, block_hash=hashed).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(ROWS)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({norm(t) for _, t in ROWS}) and all(r.doc_id == r.keep_id for r in kept)


def test_keep_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("kept_id", F.lit("x"))
    out = block_naming.drop_exact_copies(docs).collect()
    assert sorted(norm(r.text) for r in out) == sorted({norm(t) for _, t in ROWS})
    assert out[0].kept_id == "x" and {r.doc_id for r in out if norm(r.text) == "zz"} == {16}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert block_naming.exact_dedup(docs).count() == 0 and block_naming.drop_exact_copies(docs).count() == 0
