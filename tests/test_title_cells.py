"""Titles compared by cells of bounded size: the same edges whatever the size, and a bound that rules out no close pair."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from noticeflow.operators import components


def test_bound_is_no_less_than_the_matches():
    rng = random.Random(4)
    for _ in range(400):
        x, y = ("".join(rng.choices("abc é😀", k=rng.randrange(40))) for _ in range(2))
        row = [0] * (len(y) + 1)
        for c in x:
            row, old = [0], row
            for j, d in enumerate(y):
                row.append(old[j] + 1 if c == d else max(row[j], old[j + 1]))
        assert components.common_at_most(x, y) == row[-1] >= sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks())


def test_edges_do_not_depend_on_the_cells(spark, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdef ", k=rng.choice([30, 31, 60]))) for _ in range(30)]
    rows = []
    for i in range(200):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("xy")
        rows.append((i, "".join(t), rng.choice("de"), f"2024-01-0{rng.randint(1, 9)}"))
    rows.append((900, "none", None, "2024-01-01"))
    df = spark.createDataFrame(rows, "id int, t string, d string, day string")
    one = {(r.a, r.b) for r in components.close_title_edges(df, "id", "t", "d", "day").collect()}
    monkeypatch.setattr(components, "CELL_ROWS", 7)
    many = components.close_title_edges(df, "id", "t", "d", "day")
    got = [(r.a, r.b) for r in many.where(F.col("reason") == "near_title").collect()]
    assert len(got) == len(set(got)) > 50 and set(got) == one
