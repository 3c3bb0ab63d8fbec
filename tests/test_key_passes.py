"""Keys and edges of duplicate groups are computed once, however often they are read."""

from pyspark.sql import functions as F

from noticeflow.operators import components
from noticeflow.queries import merging

ROWS = [(1, "x", "p"), (2, "x", "q"), (3, "y", "q"), (4, "z", None), (5, "z", ""), (6, "", ""), (7, None, "r"), (7, None, "r")]


def counted(spark, kind="string"):
    seen = spark.sparkContext.accumulator(0)

    @F.udf(kind)
    def same(v):
        seen.add(1)
        return v

    return seen, same


def test_a_key_is_computed_once_for_each_row(spark):
    seen, same = counted(spark)
    df = spark.createDataFrame(ROWS, "id long, t string, u string")
    edges = components.key_edges(df, "id", {"t": same("t"), "u": F.col("u")})
    assert sorted((r.a, r.b, r.reason) for r in edges.collect()) == [(2, 1, "t"), (3, 2, "u"), (5, 4, "t")]
    got = sorted((r.root, r.members, r.reason) for r in components.duplicate_groups(edges, ["t", "u"]).collect())
    assert got == [(1, 3, "t"), (4, 2, "t")]
    assert seen.value == len(ROWS)
    assert components.key_edges(df.limit(0), "id", {"t": F.col("t")}).count() == 0


def test_edges_are_computed_once(spark):
    seen, same = counted(spark, "long")
    edges = spark.createDataFrame([(2, 1, "t"), (3, 2, "t"), (5, 4, "t")], "a long, b long, reason string").withColumn("a", same("a"))
    assert sorted((r.root, r.members) for r in components.duplicate_groups(edges, ["t"]).collect()) == [(1, 3), (4, 2)]
    assert seen.value == 3


def test_a_text_is_normalised_once(spark, tmp_path, monkeypatch):
    seen, same = counted(spark)
    plain = merging.text.unicode_words
    monkeypatch.setattr(merging.text, "unicode_words", lambda c: same(plain(c)))
    texts = ["One, two!", "one two", "a head\nand more", "A head\nand else", "...", "", None]
    docs = [(i, t, "en", "web", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.root, r.members, r.reason) for r in merging.duplicate_groups(spark, str(tmp_path)).collect())
    assert got == [(0, 2, "same_words"), (2, 2, "same_title")]
    assert seen.value == 2 * len(texts)  # the text's words and the first line's
