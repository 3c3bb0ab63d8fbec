"""Counts of longer runs rule out titles before common subsequences are sought, and no close pair."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd

from noticeflow.operators import components


def cell(titles, start=0, name="x"):
    return pd.DataFrame({"id": np.arange(start, start + len(titles)), "title": titles, "at": 1, "n": [len(t) for t in titles], "cell": name})


def edges(left, right):
    return {tuple(map(int, e)) for e in components.close_pairs(0.92, 2)((), left, right).to_numpy()}


def test_unlike_prose_needs_no_common_subsequence(monkeypatch):
    rng, sought = random.Random(6), []
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(1500)]
    titles = [" ".join(rng.choices(words, k=250)) for _ in range(60)]
    seen = components.common_at_most
    monkeypatch.setattr(components, "common_at_most", lambda x, y: sought.append(1) or seen(x, y))
    assert edges(cell(titles), cell(titles)) == set() and len(sought) < 20


def test_every_close_pair_is_found():
    rng = random.Random(7)
    titles = ["", "a", "ab", "abcd", "abcde", "abcdef", "a" * 70_000, "a" * 69_000]
    for size in (6, 12, 13, 25, 50, 120, 199):
        for _ in range(4):
            base = [rng.choice("abc é😀") for _ in range(size)]
            for _ in range(5):
                t = list(base)
                for _ in range(rng.randrange(2 + size // 8)):
                    k = rng.randrange(len(t))
                    t[k : k + rng.randrange(2)] = rng.choices("xyz", k=rng.randrange(2))
                titles.append("".join(t))
    want = set()
    for a, x in enumerate(titles):
        for b in range(a + 1, len(titles)):
            y = titles[b]
            if x == y or (abs(len(x) - len(y)) <= 0.2 * len(x) + 1 and min(len(x), len(y)) < 1000 and SequenceMatcher(None, x, y).ratio() >= 0.92):
                want.add((b, a))
    small = [k for k, t in enumerate(titles) if len(t) < 1000]
    got = edges(cell(titles), cell(titles).sample(frac=1, random_state=1))
    assert {e for e in got if set(e) <= set(small)} == want and len(want) > 50
    half = len(titles) // 2
    across = edges(cell(titles[:half]), cell(titles[half:], half, "y"))
    assert {e for e in across if set(e) <= set(small)} == {(b, a) for b, a in want if a < half <= b}


def test_counts_of_two_widths_do_not_wrap():
    assert edges(cell(["b" * 66_000]), cell(["b" * 65_000], 1, "y")) == {(1, 0)}
