"""Packed lines with limits: nothing is lost in silence, and every file tells what was read of it."""

import gzip
import hashlib

from noticeflow.sources.packed_lines import PackedLines, PackedReader, file_figures


def rows(path, **options):
    reader = PackedReader({"path": str(path)} | {k: str(v) for k, v in options.items()})
    out = [r for p in reader.partitions() for r in reader.read(p)]
    return [(r[1], r[2], r[3], r[4]) for r in out if r[1] != "file"], [r[4:] for r in out if r[1] == "file"]


def test_members_long_lines_and_broken_text(tmp_path):
    data = gzip.compress(b"one\ntwo") + gzip.compress(b"2\n" + b"x" * 500_000 + b"\n\xff\n\nlast")
    (tmp_path / "a.gz").write_bytes(data)
    got, (file,) = rows(tmp_path / "a.gz", max_line=1000)
    assert got == [("line", 1, "one", None), ("line", 2, "two2", None), ("rejected", 3, None, "line of 500000 bytes"), ("rejected", 4, None, "no UTF-8"), ("line", 5, "", None), ("line", 6, "last", None)]
    assert file == (None, len(data), 3 + 1 + 4 + 1 + 500_000 + 1 + 2 + 1 + 4, 6, 2, hashlib.sha256(data).hexdigest())
    assert rows(tmp_path / "a.gz")[0][2] == ("line", 3, "x" * 500_000, None)


def test_what_ends_a_reading(tmp_path):
    data = gzip.compress(b"a\n" * 400_000, 0)
    cases = {"whole": (data, {}, None), "cut": (data[:-5], {}, "cut_off"), "bad": (data[:300_000] + b"\0\1\2" + data[300_003:], {}, "damaged"), "raw": (data, {"max_raw": 500_000}, "raw_limit"), "packed": (data, {"max_packed": 10}, "packed_limit"), "empty": (b"", {}, None)}
    for name, (content, options, reason) in cases.items():
        (tmp_path / name).write_bytes(content)
        got, (file,) = rows(tmp_path / name, **options)
        assert file[0] == reason and file[3] == len(got) and file[2] <= options.get("max_raw", 10**9)
        assert name == "bad" or all(r[2] in ("a", "") for r in got)
    assert len(rows(tmp_path / "whole")[0]) == 400_000
    assert rows(tmp_path / "whole", max_raw=800_000, max_packed=len(data))[0] == rows(tmp_path / "whole")[0]


def test_folder_as_a_table(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.gz").write_bytes(gzip.compress(b"\n".join(b"%d" % n for n in range(100 * i)) + b"\n" * (i > 0)))
    (tmp_path / "_SUCCESS").write_text("")
    spark.dataSource.register(PackedLines)
    df = spark.read.format("packed_lines").options(path=f"file://{tmp_path}").load()
    assert df.where("kind = 'line'").count() == 300
    assert sorted((r.lines, r.rejected, r.held, r.reason) for r in file_figures(df).collect()) == [(0, 0, True, None), (100, 0, True, None), (200, 0, True, None)]
