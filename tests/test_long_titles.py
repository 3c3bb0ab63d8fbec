"""near_duplicate_titles over first lines of any length, against all pairs."""

import random
from difflib import SequenceMatcher

from noticeflow.queries import QUERIES


def test_long_titles_against_all_pairs(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(60)]
    rows = []
    for n in (4, 20, 60, 300):
        for _ in range(3):
            w = rng.choices(words, k=n)
            for end in ("", " end", " quite other words " * n):
                rows.append((len(rows), " ".join(w) + end + rng.choice(["", "\nmore text"]), "en", "web"))
    rows.append((len(rows), None, "en", "web"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    title = {i: t.split("\n")[0] for i, t, *_ in rows if t is not None}
    want = {(b, a) for a in title for b in title if a < b and abs(a % 5 - b % 5) <= 2 and SequenceMatcher(None, title[a], title[b]).ratio() >= 0.92}
    assert any(len(title[a]) > 200 and len(title[b]) > 200 for a, b in want)
    assert {(r.a, r.b) for r in QUERIES["near_duplicate_titles"](spark, str(tmp_path)).collect()} == want
