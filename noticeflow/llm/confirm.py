"""Exact similarities inside candidate groups, without comparing all pairs of a group.

A candidate group is what a search has connected; which of its members are really similar is found
in rounds.  In each round some members of every open group are leaders, four times as many as in the
round before, and are compared with all members that have not led yet and are not known to be
connected with them.  Confirmed pairs join their labels.  A group is done when the members that have
not led have one label: a group of true copies takes a few leaders, and only a group of texts that
are not similar after all comes to all its pairs.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CHARS, SPACE_CLASS, Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Leaders of a group in the first round.
LEADERS = 4


def shingle_hashes(text: Column, words: int) -> Column:
    """Array of the distinct 64-bit hashes of the shingles of so many words; of a shorter text, of all its words."""
    flat = F.translate(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS)), UPPER, LOWER)
    own = F.split(flat, f"[{SPACE_CLASS}]+")
    many = F.greatest(F.lit(1), F.size(own) - (words - 1))
    # a list of one element, so that the words are cut once and not for every shingle
    held = F.transform(F.array(F.struct(own.alias("w"), many.alias("n"))), lambda x: F.transform(
        F.sequence(F.lit(1), x["n"]), lambda i: F.xxhash64(F.array_join(F.slice(x["w"], i, words), " "))
    ))
    return F.array_distinct(held[0])


def confirmed(sets: DataFrame, scratch: Scratch, similarity: float, leaders: int = LEADERS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of a group with at least that Jaccard similarity.

    ``sets`` has ``rid``, ``root`` (the group) and ``shingles`` (distinct).  The similarity is compared
    as a fraction of whole numbers.
    """
    share = Fraction(str(similarity))
    p, q = share.numerator, share.denominator
    state = scratch.keep(sets.select("rid", "root", F.col("rid").alias("label"), F.lit(False).alias("led")), "state")
    edges = []
    while True:
        labels = state.where("not led").groupBy("root").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        active = scratch.keep(labels.where("low < high").select("root"), "open")
        if not active.limit(1).count():
            break
        waiting = state.where("not led").join(active, "root")
        turn = Window.partitionBy("root").orderBy(F.xxhash64("rid"), "rid")
        chosen = scratch.keep(waiting.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= leaders).select("rid", "root", "label"), "leaders")
        lead = chosen.join(sets.select("rid", "shingles"), "rid").select("root", F.col("rid").alias("x"), F.col("label").alias("x_label"), F.col("shingles").alias("x_set"))
        other = waiting.select("rid", "root", "label").join(sets.select("rid", "shingles"), "rid")
        n, m = F.size("shingles"), F.size("x_set")
        common = F.size(F.array_intersect("shingles", "x_set"))
        pairs = other.join(lead, "root").where(
            (F.col("label") != F.col("x_label")) & (q * F.least(n, m) >= p * F.greatest(n, m)) & ((p + q) * common >= p * (n + m))
        )
        found = scratch.keep(pairs.select(F.col("rid").alias("a"), F.col("x").alias("b"), "label", "x_label"), "pairs")
        edges.append(found.select("a", "b"))
        # labels that meet take the smallest one seen, looked up twice; finer labels only cost comparisons
        both = found.select("label", "x_label").unionByName(found.select(F.col("x_label").alias("label"), F.col("label").alias("x_label")))
        step = both.groupBy("label").agg(F.least(F.min("label"), F.min("x_label")).alias("to"))
        step = scratch.keep(step, "steps")
        twice = step.join(step.toDF("to", "to2"), "to", "left").select(F.col("label").alias("old"), F.least("to", "to2").alias("new"))
        led = chosen.select(F.col("rid").alias("leader"))
        new = state.join(twice, F.col("label") == F.col("old"), "left").join(led, F.col("rid") == F.col("leader"), "left")
        new = new.select("rid", "root", F.coalesce("new", "label").alias("label"), (F.col("led") | F.col("leader").isNotNull()).alias("led"))
        new = scratch.keep(new, "state")
        scratch.drop(state, active, chosen, step)
        state, leaders = new, leaders * 4
    out = sets.select(F.col("rid").alias("a"), F.col("rid").alias("b")).limit(0)
    for e in edges:
        out = out.unionByName(e)
    return out
