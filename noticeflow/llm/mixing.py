"""Mixing sources to target weights (DataFrame functions only).

Each source gets a target number of words: shares of the mix by weight, no source above ``most``
times its own words, the excess going to the others by weight.  Documents are dealt by a hash of
their id to the blocks of their source, and the blocks of a source stand in a permuted order; the
target is whole passes over them and a part of one more.  That gives each source an exact quota of
block draws.  A splitting tree shares the quotas among the output shards: at every node half of the
draws go left, how many of each source being drawn from the multivariate hypergeometric law: source by
source, one hypergeometric count by the inverse of its distribution, so that a node costs some standard deviations
a source and not a step a block.  A shard's quotas are then intervals of the sources' permuted draws, disjoint
from those of other shards, and its documents are shuffled locally by a hash.

Documents themselves only meet the plan: one small row per block.  The number of blocks is bounded
(``MAX_BLOCKS`` plus one per source), so the plan does not grow without bound with the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CHARS, SPACE_CLASS, Scratch, free_name

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Documents in a block at least, the number of blocks aimed at, block draws in a shard, shards in a
#: partition when the mix is written, and such partitions at most (beyond, each gets more shards).
BLOCK_DOCS, MAX_BLOCKS, SHARD_DRAWS, PART_SHARDS, MAX_PARTS = 256, 1 << 22, 16, 8, 1 << 15
#: Standard deviations, and values besides, on either side of the mode that a draw may go.
REACH, BESIDES = 14, 30


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null and empty count 0."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, f"[{SPACE_CLASS}]+"))).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """Adds ``target`` to a table of (source, source_size); its size is the number of sources.

    A source whose ``most`` times its size over its weight lies below the common level is full and
    gets that much; the level is where the rest adds up, found in one pass over the sources sorted
    by that ratio.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(place, F.lit(len(weights))) + 1)
    t = sources.withColumn("weight", w).withColumn("cap", most * F.col("source_size").cast("double"))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) * share
    t = t.withColumn("level", (total - before) / rest)
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio")))
    t = t.withColumn("found", level.over(Window.partitionBy()))
    return t.withColumn(
        "target", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("found"), F.col("cap")))
    ).drop("cap", "ratio", "level", "found", "weight")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _log_factorial(k: Column) -> Column:
    """ln k!, by a table up to 15 and Stirling's series beyond (error under 1e-12)."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = k.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(k < 16, F.get(small, k.cast("int"))).otherwise(series)


def hypergeometric(n: Column, q: Column, left: Column, u: Column) -> Column:
    """How many of ``q`` among ``n`` are in a sample of ``left``: the value to which ``u``, uniform in 0 to 1, falls.

    Values are tried from the mode to both sides, each with its probability from its neighbour's.
    """
    lo, hi = F.greatest(F.lit(0).cast("long"), left + q - n), F.least(q, left)
    x = lambda c: c.cast("double")
    mode = F.least(hi, F.greatest(lo, F.floor(x(left + 1) * x(q + 1) / x(n + 2)).cast("long")))
    share = x(q) / x(n)
    spread = F.sqrt(x(left) * share * (1 - share) * x(n - left) / F.greatest(F.lit(1.0), x(n - 1)))
    steps = F.least(hi - lo, F.ceil(REACH * spread).cast("long") + BESIDES)
    given = F.struct(n.alias("n"), q.alias("q"), left.alias("left"), lo.alias("lo"), hi.alias("hi"), mode.alias("mode"), steps.alias("steps"), u.alias("u"))

    def drawn(g: Column) -> Column:
        choose = lambda a, b: _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)
        at_mode = F.exp(choose(g["q"], g["mode"]) + choose(g["n"] - g["q"], g["left"] - g["mode"]) - choose(g["n"], g["left"]))
        rest = g["n"] - g["q"] - g["left"]

        def step(s: Column, _: Column) -> Column:
            a, b = s["a"], s["b"]
            up = F.when(a < g["hi"], s["pa"] * x(g["q"] - a) * x(g["left"] - a) / (x(a + 1) * x(rest + a + 1))).otherwise(0.0)
            down = F.when(b > g["lo"], s["pb"] * x(b) * x(rest + b) / (x(g["q"] - b + 1) * x(g["left"] - b + 1))).otherwise(0.0)
            found = F.when(s["x"].isNotNull(), s["x"]).when((a < g["hi"]) & (s["u"] - up <= 0), a + 1).when((b > g["lo"]) & (s["u"] - up - down <= 0), b - 1)
            return F.struct(
                (s["u"] - up - down).alias("u"), found.alias("x"), F.when(a < g["hi"], a + 1).otherwise(a).alias("a"), F.when(b > g["lo"], b - 1).otherwise(b).alias("b"),
                up.alias("pa"), down.alias("pb"),
            )

        def over(p: Column) -> Column:
            none = F.lit(None).cast("long")
            start = F.struct(
                (g["u"] - p).alias("u"), F.when(g["u"] - p <= 0, g["mode"]).otherwise(none).alias("x"), g["mode"].alias("a"), g["mode"].alias("b"), p.alias("pa"), p.alias("pb")
            )
            some = F.when(g["steps"] > 0, F.sequence(F.lit(1).cast("long"), g["steps"])).otherwise(F.array().cast("array<bigint>"))
            # what rounding leaves over falls to the mode
            return F.coalesce(F.aggregate(some, start, step)["x"], g["mode"])

        return _let(at_mode, over)

    return _let(given, drawn)


def _left_counts(seed: int) -> Column:
    """For a node's ``quotas``: how many of each source's draws go left."""

    def of_source(acc: Column, s: Column) -> Column:
        u = (F.pmod(F.xxhash64(F.lit(seed), F.col("node"), s["place"]), F.lit(1 << 53)) + 1) / F.lit(float(1 << 53))
        return _let(hypergeometric(acc["n"], s["q"], acc["left"], u), lambda drawn: F.struct(
            (acc["n"] - s["q"]).alias("n"), (acc["left"] - drawn).alias("left"),
            F.concat(acc["out"], F.array(F.struct(s["place"].alias("place"), s["q"].alias("q"), drawn.alias("x")))).alias("out"),
        ))

    zero = F.struct(
        F.col("total").alias("n"), F.floor(F.col("total") / 2).cast("long").alias("left"),
        F.array().cast("array<struct<place:int,q:bigint,x:bigint>>").alias("out"),
    )
    return F.aggregate("quotas", zero, of_source)["out"]


def shard_quotas(quotas: DataFrame, levels: int, scratch: Scratch, seed: int) -> DataFrame:
    """Splits (place, q) among 2**levels shards: rows (shard, place, q), q over 0."""
    nodes = quotas.where("q > 0").agg(
        F.lit(0).cast("long").alias("node"),
        F.array_sort(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), F.col("q").cast("long").alias("q")))).alias("quotas"),
        F.sum(F.col("q").cast("long")).alias("total"),
    )
    for _ in range(levels):
        split = nodes.withColumn("drawn", _left_counts(seed))
        left = F.transform("drawn", lambda d: F.struct(d["place"].alias("place"), d["x"].alias("q")))
        right = F.transform("drawn", lambda d: F.struct(d["place"].alias("place"), (d["q"] - d["x"]).alias("q")))
        half = F.floor(F.col("total") / 2).cast("long")
        sides = F.array(
            F.struct((F.col("node") * 2).alias("node"), left.alias("quotas"), half.alias("total")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas"), (F.col("total") - half).alias("total")),
        )
        nodes = split.select(F.explode(sides).alias("side")).select(
            "side.node", F.filter("side.quotas", lambda s: s["q"] > 0).alias("quotas"), "side.total"
        )
        nodes = scratch.keep(nodes, "nodes")
    return nodes.select(F.col("node").alias("shard"), F.explode("quotas").alias("s")).select("shard", "s.place", "s.q")


def plan(docs: DataFrame, scratch: Scratch, id: str, text: str, source: str, weights, share, most, seed: int):
    """(sources, blocks): per source its figures, per drawn block the shards that get it."""
    slim = scratch.keep(
        docs.select(F.col(id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes"
    )
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    per_block = max(BLOCK_DOCS, -(-slim.count() // MAX_BLOCKS))
    sources = targets(sources, weights, share, most)
    sources = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = scratch.keep(
        sources.withColumn("n_blocks", F.ceil(F.col("docs") / per_block).cast("long")).withColumn("passes", passes)
        .withColumn("part", F.col("target") - F.col("passes") * F.col("source_size")), "sources"
    )

    small = sources.select("source", "place", "n_blocks", "passes", "part")
    rows = slim.join(small.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("block", block_of(F.col("id"), F.col("n_blocks"), seed))
    blocks = rows.groupBy("place", "block").agg(
        F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("n_blocks", "passes", "part")]
    )
    order = Window.partitionBy("place").orderBy(F.xxhash64(F.lit(seed), "place", "block"), "block")
    # hash buckets that got no document are skipped, so the ranks count the blocks that exist
    blocks = blocks.withColumn("rank", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(order))
    blocks = blocks.withColumn("n_blocks", F.count(F.lit(1)).over(Window.partitionBy("place")))
    blocks = blocks.withColumn("begins", F.col("upto") - F.col("words")).withColumn(
        "in_part", (F.col("part") > 0) & (F.col("begins") < F.col("part"))
    )
    blocks = scratch.keep(blocks.withColumn("cut_here", F.col("in_part") & (F.col("upto") > F.col("part"))), "blocks")

    edge = blocks.where("cut_here").select("place", "block", (F.col("part") - F.col("begins")).alias("room"))
    inner = Window.partitionBy("place").orderBy(turn_of(F.col("id"), seed), "size").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        rows.select("id", "size", "place", "block").join(edge, ["place", "block"])
        .withColumn("upto", F.sum("size").over(inner)).where("upto - size / 2 <= room")
        .groupBy("place").agg(F.max(turn_of(F.col("id"), seed)).alias("cut"))
    )
    cuts = scratch.keep(cuts, "cuts")

    quotas = blocks.groupBy("place").agg(
        (F.max("passes") * F.max("n_blocks") + F.count_if("in_part")).alias("q"), F.max("n_blocks").alias("n_blocks")
    )
    quotas = scratch.keep(quotas, "quotas")
    total = quotas.agg(F.sum("q")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(total / SHARD_DRAWS))) if total else 0
    dealt = shard_quotas(quotas.select("place", "q"), levels, scratch, seed)
    upto = F.sum("q").over(Window.partitionBy("place").orderBy("shard"))
    draws = dealt.withColumn("upto", upto).select(
        "place", "shard", F.explode(F.sequence(F.col("upto") - F.col("q"), F.col("upto") - 1)).alias("draw")
    )
    draws = draws.join(quotas.select("place", "n_blocks"), "place").select(
        "place", F.pmod("draw", "n_blocks").alias("rank"), F.floor(F.col("draw") / F.col("n_blocks")).cast("long").alias("pass"), "shard"
    )
    whole = (F.col("pass") < F.col("passes")) | ~F.col("cut_here")
    shards = (
        draws.join(blocks.select("place", "rank", "block", "passes", "cut_here"), ["place", "rank"])
        .join(cuts, "place", "left")
        .groupBy("place", "block")
        .agg(
            F.array_sort(F.collect_list(F.when(whole, F.col("shard")))).alias("shards"),
            F.max(F.when(~whole, F.col("shard"))).alias("part_shard"),
            F.max(F.when(~whole, F.col("cut"))).alias("cut"),
        )
    )
    return sources, scratch.keep(shards, "plan"), 1 << levels


def block_of(id: Column, n_blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), id), n_blocks)


def turn_of(id: Column, seed: int) -> Column:
    """A document's place in its block's permutation."""
    return F.xxhash64(F.lit(seed + 1), id)


def _drawn(docs: DataFrame, id: str, text: str, source: str, weights, share, most, seed: int, extra) -> tuple[DataFrame, int]:
    scratch = Scratch(docs.sparkSession, "mixing")
    sources, blocks, n_shards = plan(docs, scratch, id, text, source, weights, share, most, seed)
    names = {c: f"mix__{c}" for c in (*sources.columns, *blocks.columns, "block")}
    s = sources.select(*[F.col(c).alias(names[c]) for c in ("source", "source_size", "target", "place", "n_blocks")])
    b = blocks.select(
        F.col("place").alias("mix__p"), F.col("block").alias("mix__b"),
        *[F.col(c).alias(names[c]) for c in ("shards", "part_shard", "cut")],
    )
    out = extra(docs).join(s, F.col(source).eqNullSafe(F.col("mix__source")))
    out = out.withColumn("mix__block", block_of(F.col(id), F.col("mix__n_blocks"), seed))
    out = out.join(b, (F.col("mix__place") == F.col("mix__p")) & (F.col("mix__block") == F.col("mix__b")), "left")
    part = F.when(turn_of(F.col(id), seed) <= F.col("mix__cut"), F.array("mix__part_shard"))
    none = F.array().cast("array<bigint>")
    return out.withColumn("mix__to", F.concat(F.coalesce("mix__shards", none), F.coalesce(part, none))), n_shards


def draws(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``shards``, ``taken``.

    ``shards`` names the output shard of every copy that the mix takes, in passes; ``taken`` is the
    words taken, repeats counted.  Whole documents are drawn, at most ``ceil(most)`` times; a
    source's words miss its target by half a document at most, up to ties of repeated ids, which
    are drawn together.  Null text has size 0; null is a source of its own, the last; null ids are
    one id.  A corpus without words takes nothing.  An empty table gives no rows.
    """
    slim = lambda d: d.select(F.col(id), F.col(source), word_count(F.col(text)).alias("mix__size"))
    out, _ = _drawn(docs, id, text, source, weights, share, most, seed, slim)
    return out.select(
        id,
        F.col("mix__size").alias("size"),
        F.col("mix__source_size").alias("source_size"),
        F.col("mix__target").alias("target"),
        F.col("mix__to").alias("shards"),
        (F.col("mix__size") * F.size("mix__to")).alias("taken"),
    )


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17,
) -> DataFrame:
    """The mix itself: the rows of ``docs`` once per copy taken, with their ``shard``, shuffled within it."""
    out, n_shards = _drawn(docs, id, text, source, weights, share, most, seed, lambda d: d)
    shard = free_name(docs, "shard")
    out = out.select(*docs.columns, F.posexplode("mix__to").alias("mix__copy", shard))
    turn = F.xxhash64(F.lit(seed + 2), F.col(id), F.col("mix__copy"))
    parts = min(max(1, n_shards // PART_SHARDS), MAX_PARTS)
    return out.repartition(parts, shard).sortWithinPartitions(shard, turn).drop("mix__copy")
