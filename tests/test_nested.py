"""Nested JSON against a recursive walk in Python."""

import json
import random

from pyspark.sql import functions as F

from noticeflow.operators import nested
from noticeflow.operators.shared import Scratch


def made(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.4:
        return rng.choice([None, True, 3, 2.5, "x", "N7", "", '{"no":"N7"}', "é"])
    if kind < 0.7:
        return {k: made(rng, depth - 1) for k in rng.sample(["no", "a", "b.c", "items", "0", ""], rng.randint(0, 4))}
    return [made(rng, depth - 1) for _ in range(rng.randint(0, 4))]


def walked(value, place=(), name="value", depth=0):
    kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "null" if value is None else "value"
    yield depth, place, name, kind, value
    inner = [(k, k, v) for k, v in value.items()] if kind == "object" else [(str(i), f"{name}_{i + 1}", v) for i, v in enumerate(value)] if kind == "array" else []
    for step, own, v in inner:
        yield from walked(v, (*place, step), own, depth + 1)


def payloads():
    rng = random.Random(9)
    out = [json.dumps(made(rng, rng.randint(1, 6)), ensure_ascii=False) for _ in range(150)]
    deep = {"no": "N7"}
    for i in range(10):
        deep = {"d": [deep, i]}
    return [*out, json.dumps(deep), None, "", "{", '{"a":1,"a":2}', "[]", "{}", "null", '"N7"']


def valid(text):
    try:
        return text is not None and json.loads(text, object_pairs_hook=lambda p: dict(p) if len({k for k, _ in p}) == len(p) else 1 / 0) is not ...
    except (ValueError, ZeroDivisionError):
        return False


def test_nodes_flat_records_and_known_ones(spark):
    texts = payloads()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("value", F.lit("clash"))
    found = nested.nodes(df, ["id"], "t", Scratch(spark, "nested"))
    got = sorted((r.id, r.depth, tuple(r.place), r.name, r.kind) for r in found.select("id", "depth", "place", "name", "kind").collect())
    want = sorted((i, d, p, n, k) for i, t in enumerate(texts) if valid(t) for d, p, n, k, _ in walked(json.loads(t)))
    assert got == want

    flat = {r.id: r.leaves for r in nested.flattened(found, ["id"]).collect()}
    for i, t in enumerate(texts):
        leaves = {}
        for _, _, n, k, v in sorted(walked(json.loads(t)), key=lambda x: [s.encode() for s in x[1]]) if valid(t) else ():
            if k in ("value", "null"):
                leaves[n] = v
        shown = {n: v if v is None or isinstance(v, str) else json.dumps(v) for n, v in leaves.items()}
        assert flat.get(i, {}) == shown

    known = spark.createDataFrame([("N7", ["é"]), ("N8", [])], "number string, words array<string>")
    rows = {(r.id, r.number): (r.how, r.objects, r.object) for r in nested.known_records(df, ["id"], "t", "no", known, "number", "words", Scratch(spark, "known")).collect()}
    for i, t in enumerate(texts):
        objects = [v for _, _, _, k, v in walked(json.loads(t)) if k == "object" and v.get("no") == "N7"] if valid(t) else []
        if objects:
            how, n, first = rows[i, "N7"]
            assert (how, n) == ("object", len(objects)) and json.loads(first) in objects
        elif t and ("N7" in t or "é" in t):
            assert rows[i, "N7"] == ("text", 0, None)
        else:
            assert (i, "N7") not in rows
    assert not [k for k in rows if k[1] == "N8"]
    assert nested.nodes(df.limit(0), ["id"], "t", Scratch(spark, "none")).count() == 0
