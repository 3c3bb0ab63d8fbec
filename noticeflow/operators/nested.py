"""Nested JSON of any depth and shape: all of its nodes as rows, searches among them, and flat records.

The text becomes a VARIANT once; then each level is a lateral explode of the objects and arrays of the level before, until
none is left.  A level is written before the next is made, so work is in proportion to the nodes,
however deep one record may be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Known records in a list at most.
MOST_KNOWN = 2000


def nodes(df: DataFrame, keys: Sequence[str], payload: str, scratch: Scratch) -> DataFrame:
    """One row per node: the keys, ``depth`` (0 for the whole), ``place``, ``name``, ``kind`` and ``value`` (VARIANT).

    ``place`` is the array of the keys and numbers on the way.  ``name`` is the node's own key; items of an
    array have their array's name, an underscore and their number from 1.  ``kind`` is object, array, null or
    value.  Texts that are no JSON, and null ones, have no nodes; of an object's repeated keys
    no text is JSON either.  Keys of an object come in their own order, not in that of the text.
    """
    level = df.select(*keys, F.try_parse_json(payload).alias("value")).where("value IS NOT NULL")
    level = level.select(*keys, F.lit(0).alias("depth"), F.array().cast("array<string>").alias("place"), F.lit("value").alias("name"), "value")
    level = scratch.keep(level.withColumn("kind", _kind(F.col("value"))), "level")
    levels, depth = [level], 0
    while not level.where(F.col("kind").isin("object", "array")).isEmpty():
        depth += 1
        below = level.where(F.col("kind").isin("object", "array")).lateralJoin(
            df.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("pos", "key", "inner")
        )
        own = F.coalesce("key", F.concat("name", F.lit("_"), (F.col("pos") + 1).cast("string")))
        step = F.coalesce("key", F.col("pos").cast("string"))
        level = below.select(*keys, F.lit(depth).alias("depth"), F.concat("place", F.array(step)).alias("place"), own.alias("name"), F.col("inner").alias("value"))
        level = scratch.keep(level.withColumn("kind", _kind(F.col("value"))), "level")
        levels.append(level)
    # one scan of all levels' files, not a union of as many plans
    return df.sparkSession.read.schema(level.schema).parquet(*[x._scratch_path for x in levels])


def _kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    return (
        F.when(F.startswith(shape, F.lit("OBJECT")), "object").when(F.startswith(shape, F.lit("ARRAY")), "array")
        .when(F.is_variant_null(value), "null").otherwise("value")
    )


def text_of(value: Column) -> Column:
    """A leaf as text: strings without quotes, others as JSON; null for null."""
    return F.when(F.is_variant_null(value), None).otherwise(F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))


def objects_with(found: DataFrame, keys: Sequence[str], field: str, wanted: Column) -> DataFrame:
    """The objects at any depth whose own ``field`` equals ``wanted`` (a text over the keys): the keys, depth, place, object."""
    own = F.try_variant_get("value", f"$.{field}", "string")
    return found.where((F.col("kind") == "object") & own.eqNullSafe(wanted) & wanted.isNotNull()).select(*keys, "depth", "place", F.to_json("value").alias("object"))


def known_records(df: DataFrame, keys: Sequence[str], payload: str, field: str, known: DataFrame, number: str, words: str, scratch: Scratch) -> DataFrame:
    """Per row of ``df`` and known record it names: the keys, number, ``how`` it is found, and the first object.

    ``known`` has the number and an array of words.  ``how`` is ``object`` where an object has the number
    in ``field`` (``objects`` of them, the first by depth and place in ``object``), else ``text`` where the payload holds the
    number or one of the words anywhere.  Rows that name no known record are not returned.
    """
    all_nodes = nodes(df, keys, payload, scratch)
    numbers = all_nodes.where("kind = 'object'").withColumn("_own", F.try_variant_get("value", f"$.{field}", "string"))
    listed = known.select(F.col(number).alias("_number"), F.col(words).alias("_words")).limit(MOST_KNOWN + 1).collect()
    if len(listed) > MOST_KNOWN:
        raise ValueError(f"a list of known records has at most {MOST_KNOWN}")
    hits = numbers.join(F.broadcast(known.select(F.col(number).alias("_number")).distinct()), F.col("_own") == F.col("_number"))
    hits = hits.groupBy(*keys, "_number").agg(
        F.count(F.lit(1)).alias("objects"), F.min(F.struct("depth", F.array_join("place", "/").alias("at"), F.to_json("value").alias("object"))).alias("m")
    )
    # the list is one literal array that every row is held against
    own = F.array(*[F.struct(F.lit(r[0]).alias("number"), F.array(*map(F.lit, r[1] or [])).cast("array<string>").alias("words")) for r in listed])
    text = F.coalesce(F.col(payload), F.lit(""))
    named = F.filter(
        own, lambda k: ((k["number"] != "") & F.contains(text, k["number"])) | F.exists(k["words"], lambda w: (w != "") & F.contains(text, w))
    )
    texts = df.select(*keys, F.explode(F.transform(named, lambda k: k["number"])).alias("_number")) if listed else hits.select(*keys, "_number")
    return texts.unionByName(hits.select(*keys, "_number")).distinct().join(hits, [*keys, "_number"], "left").select(
        *keys, F.col("_number").alias(number), F.when(F.col("m").isNotNull(), "object").otherwise("text").alias("how"),
        F.coalesce("objects", F.lit(0)).alias("objects"), F.col("m.at").alias("at"), F.col("m.object").alias("object"),
    )


def flattened(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per record: ``leaves``, a map of the leaves' own names to their texts; of equal names the one with the last place."""
    leaves = found.where(F.col("kind").isin("value", "null"))
    last = leaves.groupBy(*keys, "name").agg(F.max_by(F.struct(text_of(F.col("value")).alias("text")), F.struct("place")).alias("v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("v.text").alias("text"))))).alias("leaves"))
