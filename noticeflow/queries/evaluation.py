"""Evaluation of a classifier against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates
from .registry import query, table


@query("SELECT d.doc_id, lang, quality, toxic, quality IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def label_left_join(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return d.join(labels, "doc_id", "left").withColumn("labelled", F.col("quality").isNotNull())


@query("""
WITH j AS (SELECT NOT contains(text, '$$$') AND NOT contains(text, ' | ') AS p, quality = 1 AS a FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT count(*) AS rows, count(a) AS labelled, count(*) FILTER (p AND a) AS true_positive, count(*) FILTER (p AND NOT a) AS false_positive,
  count(*) FILTER (NOT p AND NOT a) AS true_negative, count(*) FILTER (NOT p AND a) AS false_negative FROM j)
SELECT *, round(CAST(true_positive AS DOUBLE) / nullif(true_positive + false_positive, 0), 4) AS precision_relevant, round(CAST(true_negative AS DOUBLE) / nullif(true_negative + false_negative, 0), 4) AS precision_irrelevant,
  round(CAST(true_positive AS DOUBLE) / nullif(true_positive + false_negative, 0), 4) AS recall_relevant, round(CAST(labelled AS DOUBLE) / nullif(rows, 0), 4) AS coverage FROM c""")
def classifier_quality(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    predicted = ~F.contains("text", F.lit("$$$")) & ~F.contains("text", F.lit(" | "))
    return aggregates.classifier_quality(d, predicted, F.col("quality") == 1)
