import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import byte_cnn
from noticeflow.llm.byte_cnn import CHUNK, FILTERS, PORTION, WIDTH

DATA = "/root/testdata/sf0.01"


def brute_score(net, text):
    data = np.frombuffer((text or "").encode() + b"\0" * (WIDTH - 1), np.uint8)
    data = data if len(data) >= WIDTH else np.append(data, np.uint8(0))
    windows = np.array([sum(net.tables[w][data[i + w]] for w in range(WIDTH)) for i in range(len(data) - WIDTH + 1)])
    h = np.array([np.tanh(windows[i : i + CHUNK].max(axis=0) + net.bias) for i in range(0, len(windows), CHUNK)])
    return 1 / (1 + np.exp(-(np.concatenate((h.mean(axis=0), h.max(axis=0))) @ net.weights + net.level)))


def test_scores_cover_every_window():
    rng = np.random.default_rng(0)
    net = byte_cnn.Network(
        rng.normal(0, 1, (WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(size=FILTERS), rng.normal(size=2 * FILTERS), 0.1
    )
    lens = [0, 1, 3, 4, 5, CHUNK - 1, CHUNK, CHUNK + 1, 3 * CHUNK + 7, 2000, CHUNK * PORTION + 3]
    texts = [None] + ["".join(map(chr, rng.integers(32, 400, n))) for n in lens]
    assert np.allclose(net.scores(texts), [brute_score(net, t) for t in texts], atol=1e-4)
    assert len(net.scores([])) == 0


def test_training_sees_what_scoring_sees():
    rng = np.random.default_rng(3)
    net = byte_cnn.Network(rng.normal(0, 1, (WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(size=FILTERS), rng.normal(size=2 * FILTERS), 0.1)
    for n in (0, 1, 3, 4, 5, 100, CHUNK - 1, CHUNK, CHUNK + 1, CHUNK + 4, 4 * CHUNK, 20 * CHUNK + 1):
        text = "".join(map(chr, rng.integers(32, 120, n)))
        trained = byte_cnn.chunk_responses(net.tables, *byte_cnn.windows_and_chunks(byte_cnn.all_chunks(text))).max(axis=1)
        scored = np.concatenate([top for _, top in net.responses([text])])
        assert trained.shape == scored.shape and np.allclose(trained, scored, atol=1e-5)


def test_training_learns_a_pattern_and_is_repeatable():
    rng = np.random.default_rng(1)
    text = lambda bad: " ".join("".join(map(chr, rng.integers(97, 123, 5))) + ("$$" if bad and rng.random() < 0.3 else "") for _ in range(60))
    samples = [(byte_cnn.all_chunks(text(i % 4 == 0)), int(i % 4 != 0)) for i in range(400)]
    net = byte_cnn.train(samples)
    new = [text(i % 2 == 0) for i in range(60)]
    assert ((net.scores(new) >= 0.3) == (np.arange(60) % 2 == 1)).mean() > 0.95
    assert np.array_equal(net.tables, byte_cnn.train(samples).tables)
    assert np.allclose(byte_cnn.train([]).scores(["a", None]), 0.5)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("score", F.lit("clash"))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = byte_cnn.quality(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    kept = byte_cnn.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.where("predicted = 1").count()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x"), (2, "long " * 50000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in byte_cnn.quality(docs, none).collect()] == [0.5] * 4
    odd = spark.createDataFrame([(2, 1, 0), (2, None, 0), (1, 7, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert byte_cnn.quality(docs, odd).count() == 4
    assert byte_cnn.quality(docs.limit(0), odd).count() == 0
