import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import tile_cosine


def brute(rows, threshold=0.95):
    good = [
        (i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)
    ]
    links = {k: set() for k in range(len(rows))}
    at = [k for k, r in enumerate(rows) if r in good]
    for a in at:
        for b in at:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
    out, seen = [], {}
    for k in range(len(rows)):
        if k not in seen:
            todo, group = [k], {k}
            while todo:
                for n in links[todo.pop()] - group:
                    group.add(n)
                    todo.append(n)
            ids = [rows[g][0] for g in group if rows[g][0] is not None]
            seen |= {g: min(ids, default=None) for g in group}
        out.append((rows[k][0], len(links[k]), seen[k]))
    return sorted(out, key=str)


def rows():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    out = []
    for i in range(300):
        v = base[i % 40] + rng.normal(size=16) * rng.choice([0, 0.02, 0.12, 0.3])
        out.append((i, [float(x) for x in np.float32(v * rng.choice([1e-3, 1, 50]))]))
    out += [(1000 + i, list(out[7][1])) for i in range(50)]
    out += [(400, None), (401, []), (402, [0.0] * 16), (403, [None] + [1.0] * 15), (404, [float("nan")] + [1.0] * 15)]
    out += [(405, [float("inf")] + [1.0] * 15), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (5, list(out[5][1])), (None, list(out[9][1]))]
    return out + [(408, [0.0] * 15 + [1e-40]), (409, [-0.0] * 15 + [1e-40]), (None, None)]


@pytest.mark.parametrize("block", [60, 8192])
def test_against_brute_force(spark, block):
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = tile_cosine.near_vectors(df, block=block).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(data)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_bounds_never_miss_a_pair():
    rng = np.random.default_rng(2)
    x = tile_cosine.unit(np.repeat(rng.normal(size=(30, 64)), 20, axis=0) + rng.normal(size=(600, 64)) * 0.23)
    codes, scale, error = tile_cosine.quantise(x)
    all_ = np.arange(600)
    got = {(i, j) for a, b in tile_cosine.tile_pairs(x, codes, scale, error, all_, all_, 0.95) for i, j in zip(a.tolist(), b.tolist())}
    want = set(zip(*(k.tolist() for k in np.nonzero(np.einsum("id,jd->ij", x, x) >= 0.95))))
    assert got == want and len(want) > 700
    assert (np.abs(x @ x.T - (codes * scale[:, None]) @ (codes * scale[:, None]).T) <= error[:, None] + error + error[:, None] * error).all()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert tile_cosine.near_vectors(df).count() == 0


def test_hash_of_two_vectors(spark, monkeypatch):
    data = rows()[:120]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    monkeypatch.setattr(tile_cosine.F, "xxhash64", lambda *a: F.lit(1).cast("long"))
    got = tile_cosine.near_vectors(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(data)


def test_open_pairs_are_the_same_in_both_passes():
    rng = np.random.default_rng(3)
    x = tile_cosine.unit(np.repeat(rng.normal(size=(20, 64)), 30, axis=0) + rng.normal(size=(600, 64)) * np.where(np.arange(600) < 300, 0.05, 0.22)[:, None])
    codes, scale, error = tile_cosine.quantise(x)

    def judged(at):
        found = tile_cosine.possible_pairs(codes[at], scale[at], error[at], np.arange(len(at)), np.arange(len(at)), 0.95)
        return {(at[i], at[j]): s for p, q, sure in found for i, j, s in zip(p.tolist(), q.tolist(), sure.tolist())}

    first = judged(np.arange(600))
    open_ = np.array(sorted({k for (i, j), sure in first.items() if not sure and i != j for k in (i, j)}))
    second = judged(open_)
    assert second == {k: s for k, s in first.items() if k[0] in set(open_) and k[1] in set(open_)}
    assert any(first.values()) and 20 < len(open_) < 600
    exact = np.einsum("id,jd->ij", x, x)
    assert all(exact[k] >= 0.95 for k, sure in first.items() if sure)
