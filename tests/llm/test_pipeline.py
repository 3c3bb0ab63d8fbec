"""The pipeline against a plain Python rendering of its stages, on a small corpus."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from noticeflow.llm import byte_cnn

from .test_mixing import brute_targets
from .test_near_copies import components, shingles

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


def corpus():
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(300):
        words = rng.choices(vocab, k=rng.choice([3, 30, 200]))
        bad = i % 5 == 0
        text = " ".join(w + "$$$" if bad and rng.random() < 0.6 else w for w in words)
        if i % 7 == 3:
            text = rows[-1][1] + rng.choice(["", " ", "\n\n"])
        if i % 11 == 5:
            w = rows[-1][1].split()
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        rows.append((i, text, "en", f"src{i % 3}" if i % 9 else None, len(text)))
        labels.append((i, int("$$$" not in text), 0))
    rows += [(900, None, None, None, None), (901, "", "en", "src0", 0), (902, rows[2][1], "en", "src1", 1), (2, rows[2][1], "en", "src2", 1)]
    return rows, labels


def test_pipeline(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    net = byte_cnn.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [r for r, s in zip(rows, net.scores([r[1] for r in rows])) if s >= 0.3]
    assert len(rows) / 2 < len(kept) < len(rows)

    groups = defaultdict(list)
    for r in kept:
        groups["".join(re.split(r"[\x20\x09-\x0D]+", r[1] or ""))].append(r)
    kept = [min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values()]
    low, links = components({r[0]: shingles(r[1]) for r in kept})
    assert links
    kept = {r[0]: r for r in kept if low[r[0]] == r[0]}

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(r.doc_id for r in out)
    assert set(copies) <= set(kept) and max(copies.values()) <= 2
    size = lambda r: len((r[1] or "").split())
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, r in kept.items():
        sizes[r[3]] += size(r)
        taken[r[3]] += size(r) * copies[i]
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 101
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        from noticeflow.llm.byte_bpe import Bpe

        ranks = Bpe(f.read(), P.PATTERN).ranks
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(kept[r.doc_id][1] or "")
        assert r.n_tokens * 4 == len(r.ids)


def test_stages_keep_the_columns(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
