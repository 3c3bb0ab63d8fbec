import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from noticeflow.llm import warc


def pages():
    rng = random.Random(1)
    body = lambda n: "".join(rng.choices("abc <p>é\n\r", k=n))
    out = [(i, f"http://x/{i}", body(rng.choice([10, 900, 5000]))) for i in range(100, 160)]
    out += [(i, "http://copy\r\nEvil: 1", out[3][2]) for i in (5, 300, 301)] + [(310, None, None), (309, "u", ""), (311, "u", None)]
    return out + [(400, "big", body(200) * 5000), (5, "again", out[3][2]), (None, "no id", "only here"), (None, "no id", out[7][2]), (500, "in", "WARC/1.1\r\nWARC-Type: response\r\n\r\n")]


def brute(rows):
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, _, t in rows:
        data = (t or "").encode()
        low = first.get(t or "")
        out.append((i, len(data), warc.sha1_base32(data), "response" if i == low else "revisit", None if i == low else low))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    rows = warc.round_trip(df)
    assert rows.where("kind = 'gap'").count() == 0
    got = [tuple(r) for r in warc.digest(rows).collect()]
    assert sorted(got, key=str) == brute(pages())
    texts = {(i, t or "") for i, _, t in pages()}
    assert all((r.page_id, bytes(r.payload).decode()) in texts for r in rows.where("record_type = 'response'").collect())
    assert warc.round_trip(df.limit(0)).count() == 0


def test_least_size_of_revisits(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    got = warc.digest(warc.round_trip(df, least=50)).where("payload_bytes < 50").collect()
    assert {r.record_type for r in got} == {"response"} and {r.refers_to for r in got} == {None}


def records(n):
    return [warc.page_record(i, f"u{i}", f"payload {i} ".encode() * 40, None, False) for i in range(n)]


def salvaged(path, step):
    size = os.path.getsize(path)
    rows = [r for s in range(0, size, step) for r in warc.salvage(str(path), s, s + step)]
    return [r["page_id"] for r in rows if r["kind"] == "record"], [(r["start"], r["end"]) for r in rows if r["kind"] == "gap"]


@pytest.mark.parametrize("step", [100, 333, 1 << 20])
def test_salvage_packed(tmp_path, step):
    parts = records(12)
    starts = [sum(map(len, parts[:k])) for k in range(13)]
    bad = list(parts)
    bad[0] = bad[0][:20] + bytes([bad[0][20] ^ 255]) + bad[0][21:]  # damaged content
    bad[3] = bad[3][:-6] + b"\0\0\0\0\0\0"  # wrong checksum
    raw = gzip.decompress(parts[5]).replace(b"payload 5", b"payload X", 1)
    bad[5] = gzip.compress(raw)  # packs well, but the digests differ
    bad[8] = b"noise \x1f\x8b\x08 noise WARC/1.1\r\n noise"
    bad[11] = bad[11][:30]  # cut off
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(bad))
    at = [sum(map(len, bad[:k])) for k in range(13)]
    ids, gaps = salvaged(path, step)
    assert ids == [1, 2, 4, 6, 7, 9, 10]
    assert gaps == [(at[k], at[k + 1]) for k in (0, 3, 5, 8, 11)]
    path.write_bytes(b"".join(parts))
    assert salvaged(path, step) == (list(range(12)), []) and starts[12] == os.path.getsize(path)


def test_salvage_plain(tmp_path):
    plain = [gzip.decompress(r) for r in records(6)]
    plain[2] = plain[2].replace(b"payload 2", b"PAYLOAD 2", 1)
    plain[4] = plain[4].replace(b"Content-Length", b"Content-Longth")
    path = tmp_path / "a.warc"
    path.write_bytes(b"junk" + b"".join(plain))
    ids, gaps = salvaged(path, 1 << 20)
    assert ids == [0, 1, 3, 5] and len(gaps) == 3 and gaps[0] == (0, 4)
    long = gzip.decompress(warc.page_record(9, "u", b"x" * 3_000_000, None, False))
    path.write_bytes(plain[0] + long + plain[1])
    assert salvaged(path, 1 << 30) == ([0, 9, 1], [])


def test_read_ranges(spark, tmp_path):
    path = tmp_path / "b.warc.gz"
    parts = records(50)
    parts[20] = parts[20][:40]
    path.write_bytes(b"".join(parts))
    archives = spark.createDataFrame([(f"file://{path}", os.path.getsize(path))], "path string, bytes long")
    rows = warc.read_archives(spark, archives, 700)
    assert sorted(r.page_id for r in rows.where("kind = 'record'").collect()) == [i for i in range(50) if i != 20]
    assert [(r.end - r.start, r.reason) for r in rows.where("kind = 'gap'").collect()] == [(40, "member does not unpack")]


def test_lost_records_are_not_passed_over(spark, tmp_path):
    """A damaged archive raises, and its gaps are in the quarantine table."""
    import re

    from noticeflow.llm.common import Scratch

    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    scratch = Scratch(spark, "damaged")
    archives = scratch.keep(warc.write_archives(pages, f"file://{tmp_path}/a"), "archives")
    assert warc.checked(spark, archives, scratch).count() == 40
    path = next((tmp_path / "a").glob("*.warc.gz"))
    data = bytearray(path.read_bytes())
    for at in range(len(data) // 2, len(data) // 2 + 30):
        data[at] ^= 255
    path.write_bytes(bytes(data))
    with pytest.raises(warc.Incomplete) as e:
        warc.checked(spark, archives, scratch)
    gaps = spark.read.parquet(re.search(r"gaps in (\S+)", str(e.value))[1]).collect()
    assert len(gaps) == 1 and gaps[0].start <= len(data) // 2 < gaps[0].end and gaps[0].reason


def test_salvage_of_damaged_copies(spark):
    import hashlib

    rows = [(i, f"http://x/{i}", None if i % 50 == 3 else hashlib.sha256(str(i % 90).encode()).hexdigest() * (1 + i % 7)) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.salvaged(pages, F.col("page_id").isin(5, 6, 7, 100, 399)).collect()}
    assert sorted(got) == list(range(400))
    lost = {i for i, r in got.items() if r.outcome != "recovered"}
    assert lost == {5, 6, 7, 100, 399} and all(got[i].outcome == "quarantined" and got[i].reason for i in lost)
    assert all(r.intact for i, r in got.items() if i not in lost)
    assert {r.outcome for r in warc.salvaged(pages, F.lit(False)).collect()} == {"recovered"}
    assert warc.salvaged(pages.limit(0), F.lit(True)).count() == 0
