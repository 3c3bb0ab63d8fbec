"""Token shards and their index against the tokenizers library and a dictionary."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeflow.llm import token_store
from noticeflow.llm.token_store import Bucket, Encoder, PerfectHash, Store, hashes

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
FILE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return Encoder(FILE, 2)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


PIECES = ["a", "the", " ", " ", "  ", "\n", "\t", "\xa0", " ", "　", "​", "\x85", "\x1c", "᠎", "\xe9", "中", "'s", "1", "!", "\x7f", "﻿", "<|endoftext|>", "️", "\x00", " x", " né,", "ÿĀɏ", " Ñandú.", " ×", "÷a", "ɐ"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.characters(max_codepoint=127), st.characters(exclude_categories=["Cs"])), max_size=30).map("".join))
def test_cut_texts_encode_as_whole_ones(library, encoder, text):
    assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == ids_of(library, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.characters(max_codepoint=127), st.characters(exclude_categories=["Cs"])), max_size=30).map("".join))
def test_parts_are_the_text(text):
    assert "".join(token_store.PART.findall(text)) == text


def test_long_texts_go_in_stretches(library, encoder, monkeypatch):
    monkeypatch.setattr(token_store, "PORTION", 7)
    monkeypatch.setattr(token_store, "REMEMBERED", 20)
    rng = random.Random(3)
    texts = ["".join(rng.choices(PIECES + [" word,", " don't", "x.y"], k=rng.randint(0, 60))) for _ in range(200)]
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)]
    assert got == [ids_of(library, t) for t in texts]


def test_every_character_after_a_space(library, encoder):
    """No character but those that are kept with the space joins the piece before it."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 4000):
        text = "".join(f"a \n {c} {c}\t b{c}1{c}" for c in every[at : at + 4000])
        assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == ids_of(library, text)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 64, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    keys = [b"k%d" % i for i in range(n)]
    high, low = hashes(keys) if n else (np.zeros(0, np.uint64),) * 2
    h = PerfectHash.over(high, low)
    assert sorted(h.slots(high, low).tolist()) == list(range(n))
    assert 64 * len(h.words) <= 6 * n + 64 * 20
    if n:
        with pytest.raises(ValueError):
            PerfectHash.over(np.append(high, high[0]), np.append(low, low[0]))


def test_bucket_finds_runs_and_refuses_others():
    keys = [f"{i}".encode() for i in range(500)]
    counts = [1 + (i % 3) for i in range(500)]
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    runs = np.zeros(sum(counts), token_store.RUN)
    runs["record"] = np.arange(len(runs))
    bucket = Bucket(Bucket.packed(keys, runs, first))
    asked = [*keys, *(f"x{i}".encode() for i in range(2000)), b"\xff", b""]
    got = {asked[i]: r["record"].tolist() for i, r in bucket.find(asked)}
    assert got == {k: list(range(f, f + c)) for k, f, c in zip(keys, first.tolist(), counts)}


def rows():
    rng = random.Random(6)
    words = ["the", "Größe", "中文", "a,b", "x1", "\n", "  y", "'ll"]
    out = [(i * 7 - 300, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)]
    rng.shuffle(out)
    out += [(None, "no id"), (None, None), (1000, None), (1001, ""), (1002, "q" * 30_000), (1003, "the " * 20_000)]
    return out + [(77, "again")] * 150 + [(77, "other")] * 3


def test_all_records_read_back_by_key(spark, library):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("start", F.lit(0)).repartition(4)
    store = Store.write(docs, FILE, shard_bytes=20_000, bucket_keys=50)
    assert store.manifest.count() > 3 and store.index.count() > 3
    take = lambda ids, width: (np.frombuffer(ids, f"<u{width}").tolist(),)
    got = [tuple(r) for r in store.fetch(docs, "doc_id", take, "ids array<int>").collect()]
    want = sorted((r[0] is None, r[0] or 0, ids_of(library, r[1])) for r in data)
    assert sorted((k is None, k or 0, ids) for k, _, _, ids in got) == want
    # starts run on without gaps, in the order of ids
    at = 0
    by_place = sorted(got, key=lambda r: r[1])
    for key, start, n, ids in by_place:
        assert start == at and n == len(ids)
        at += n
    order = [(k is None, k or 0) for k, *_ in by_place]
    assert order == sorted(order)
    foreign = spark.createDataFrame([(10**9 + i,) for i in range(300)] + [(77,), (77,)], "doc_id long")
    assert store.fetch(foreign, "doc_id", take, "ids array<int>").count() == 153 + sum(r[0] == 77 for r in data[:306])


def test_query_columns_text_keys_and_empty_table(spark, library):
    data = [(f"k{i}", f"text {i}") for i in range(30)] + [("", "empty key"), (None, "null")]
    docs = spark.createDataFrame(data, "doc_id string, text string")
    got = token_store.digest(docs, FILE)
    assert got.schema.simpleString() == "struct<doc_id:string,start:bigint,n_tokens:bigint,ids_crc32:bigint>"
    want, at = {}, 0
    for k, t in sorted(data, key=lambda r: (r[0] is None, r[0] or "")):
        ids = ids_of(library, t)
        want[k] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert token_store.digest(docs.limit(0), FILE).count() == 0


def test_damaged_magic_is_refused(tmp_path):
    (tmp_path / "x").write_bytes(b"0" * 200)
    with pytest.raises(ValueError):
        token_store.Shard(str(tmp_path / "x"))
    with pytest.raises(ValueError):
        Bucket(b"0" * 64)
