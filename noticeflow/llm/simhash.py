"""SimHash near-dedup with vantage-point trees.

Fingerprints within 3 bits of each other agree to within 1 bit on the upper or the lower 32 bits.
So there are two trees, one for each half, and in each the pairs looked for are within 1 on its
half and within 3 on the whole.  A node of a tree holds a vantage point, a set of bits and a
radius: fingerprints within the radius, counted on those bits, are at home on the near side, the
others on the far side.  By the triangle inequality a partner's distance to the vantage point
differs by at most the search radius on those bits (1 on the tree's half, 3 on others), so only
fingerprints in that narrow band are also sent across the boundary.  The leaves of the top tree
are shards; inside a shard the same search goes on to small leaves, where pairs are compared.

The top trees are fitted on a bounded sample of fingerprints (``SAMPLE_MAX``).  The sample decides
where shards are cut, never which pairs are found: every fingerprint is routed by the bounds.
A shard returns, for each of its fingerprints that has a link, the smallest one it is connected
to there, so a dense group costs one row per member and not one per pair.

``near_dedup`` links fingerprints of three-word shingles at 3 bits or fewer.  ``near_copies`` looks for
texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: two fingerprints
of distinct word pairs (edits spoil fewer of them than of longer shingles) are searched at 9 bits with
five trees each, one of whose five bands differs in at most one bit, and what is connected that way is
confirmed by exact similarities (``confirm``).
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import BROADCAST_ROWS, Scratch, joined_components, keep_decided, small_batches
from .confirm import confirmed, shingle_hashes

WORDS, RADIUS = 3, 3
#: Distinct fingerprints that a shard is meant to be home to, sampled fingerprints per shard, and
#: the most that are ever sampled (8 MB on the driver).
SHARD_ROWS, SAMPLE_PER_SHARD, SAMPLE_MAX = 8192, 128, 1 << 20
#: Below this many home fingerprints a leaf compares all; pairs held before they are merged.
LEAF_ROWS, PAIRS_HELD = 96, 1 << 18
#: Terms of ``near_copies``: words in a shingle and similarity; words in a shingle of the fingerprints,
#: their number, and the bits in which they may differ.
COPY_WORDS, COPY_SIMILARITY, PRINT_WORDS, PRINTS, PRINT_RADIUS = 5, 0.8, 2, 2, 9
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def tree_metrics(bands: int, radius: int) -> tuple:
    """For each tree: sets of bits and the distance a sought pair can have on them.

    The bits are cut into bands, one for each tree.  A pair within the radius differs in at most
    radius // bands bits of one band at least, so each tree looks for that on its own band.
    """
    edges = [64 * k // bands for k in range(bands + 1)]
    masks = [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:])]
    return tuple(((m, radius // bands), (m ^ ALL, radius), (ALL, radius)) for m in reversed(masks))


METRICS = tree_metrics(2, RADIUS)


def bit_counts(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def shingle_cuts(words: list[bytes], length: int):
    """Slices of the space-joined words, one for each shingle of ``length`` words."""
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return map(slice, starts[: len(words) - length + 1].tolist(), ends[length - 1 :].tolist())


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text, as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - WORDS + 1
    if n < 2:
        return xxhash.xxh64_intdigest(joined, 42)
    cuts, ones = shingle_cuts(words, WORDS), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = map(joined.__getitem__, islice(cuts, 1 << 16))
        ones += bit_counts(np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(42)), np.uint64, min(n - at, 1 << 16)))
    return majority(ones, n)


def fingerprints(text: pa.Array) -> pa.Array:
    """Fingerprints as signed integers; texts are turned into strings one at a time."""
    found = np.fromiter((fingerprint(t.as_py()) for t in text), np.uint64, len(text))
    return pa.array(found.view(np.int64), pa.int64())


def copy_fingerprints(text: str | None) -> list[int]:
    """``PRINTS`` independent fingerprints of the distinct shingles of ``PRINT_WORDS`` words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) < PRINT_WORDS:
        own = [joined]
    else:
        own = list(set(map(joined.__getitem__, shingle_cuts(words, PRINT_WORDS))))
    out = []
    for seed in range(PRINTS):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(own), 1 << 16):
            part = own[at : at + (1 << 16)]
            ones += bit_counts(np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(seed)), np.uint64, len(part)))
        out.append(majority(ones, len(own)))
    return out


def copy_prints(text: pa.Array) -> pa.Array:
    found = np.array([copy_fingerprints(t.as_py()) for t in text], np.uint64).reshape(-1, PRINTS).view(np.int64)
    return pa.FixedSizeListArray.from_arrays(pa.array(found.reshape(-1)), PRINTS).cast(pa.list_(pa.int64()))


def choose(points: np.ndarray, metrics, rng) -> tuple | None:
    """The vantage point, bits and radius that leave the least work; None if no cut helps."""
    if len(points) > 1024:
        points = rng.choice(points, 1024, replace=False)
    best, least = None, 0.9
    for v in rng.choice(points, 4):
        for bits, r in metrics:
            share = np.cumsum(np.bincount(np.bitwise_count((points ^ v) & bits), minlength=70)[:70]) / len(points)
            near, asked_near, asked_far = share[:60], share[r : 60 + r], 1 - np.concatenate((np.zeros(r), share[: 60 - r]))
            work = near * asked_near + (1 - near) * asked_far
            work[(near < 0.05) | (near > 0.95)] = 1
            k = int(work.argmin())
            if work[k] < least:
                best, least = (v, bits, r, k), work[k]
    return best


def build(points: np.ndarray, metrics, leaf: int, rng):
    """A tree of (vantage, bits, reach, radius, near, far); None is a leaf."""
    cut = choose(points, metrics, rng) if len(points) > leaf else None
    if cut is None:
        return None
    v, bits, r, mu = cut
    near = np.bitwise_count((points ^ v) & bits) <= mu
    return (*cut, build(points[near], metrics, leaf, rng), build(points[~near], metrics, leaf, rng))


def route(tree, points: np.ndarray, at: np.ndarray, home: np.ndarray, out: list, leaf: int = 1) -> None:
    """Appends (leaf number, index, home?) for every leaf each point must be compared in."""
    if not len(at):
        return
    if tree is None:
        out.append((leaf, at, home))
        return
    v, bits, r, mu, near, far = tree
    d = np.bitwise_count((points[at] ^ v) & bits).astype(np.int16)
    a, b = d - r <= mu, d + r > mu
    route(near, points, at[a], home[a] & (d[a] <= mu), out, 2 * leaf)
    route(far, points, at[b], home[b] & (d[b] > mu), out, 2 * leaf + 1)


class Links:
    """Components of numbered points; pairs are merged in bounded portions."""

    def __init__(self, n: int):
        self.label, self.a, self.b, self.held = np.arange(n), [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > PAIRS_HELD:
            self.merge()

    def merge(self) -> np.ndarray:
        label = self.label
        if self.held:
            a, b = np.concatenate(self.a), np.concatenate(self.b)
            while True:
                p, q = label[a], label[b]
                open_ = p != q
                if not open_.any():
                    break
                a, b, p, q = a[open_], b[open_], p[open_], q[open_]
                low = np.minimum(p, q)
                np.minimum.at(label, p, low)
                np.minimum.at(label, q, low)
                while (label != (label := label[label])).any():
                    pass
            self.a, self.b, self.held = [], [], 0
        self.label = label
        return label


def search(points: np.ndarray, asked: np.ndarray, home: np.ndarray, metrics, rng, links: Links) -> None:
    """Links every asked point with the home points within the radius (that of all bits, the last metric)."""
    radius = metrics[-1][1]
    cut = choose(points[home], metrics, rng) if len(home) > LEAF_ROWS else None
    if cut is None:
        for at in range(0, len(home), 512):
            part = home[at : at + 512]
            for q in range(0, len(asked), 4096):
                near = np.bitwise_count(points[part][:, None] ^ points[asked[q : q + 4096]][None, :]) <= radius
                i, j = np.nonzero(near)
                i, j = part[i], asked[q + j]
                links.add(i[i != j], j[i != j])
        return
    v, bits, r, mu = cut
    d, e = (np.bitwise_count((points[x] ^ v) & bits).astype(np.int16) for x in (home, asked))
    search(points, asked[e - r <= mu], home[d <= mu], metrics, rng, links)
    search(points, asked[e + r > mu], home[d > mu], metrics, rng, links)


def link_edges(fps: DataFrame, shard_rows: int = SHARD_ROWS, metrics: tuple = METRICS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) whose components are those of all links."""

    def shard_links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points = rows["fp"].to_numpy().view(np.uint64)
        links = Links(len(points))
        order = np.arange(len(points))
        search(points, order, order[rows["home"].to_numpy()], metrics[key[0]], np.random.default_rng(7), links)
        label = links.merge()
        linked = label != order
        return pd.DataFrame({"a": points[linked].view(np.int64), "b": points[label[linked]].view(np.int64)})

    n = fps.count()
    shards = max(1, -(-n // shard_rows))
    want = min(SAMPLE_MAX, shards * SAMPLE_PER_SHARD)
    part = min(1.0, 1.2 * want / max(n, 1))
    drawn = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(part * (1 << 30))).limit(want).toPandas()
    sample = np.sort(drawn["fp"].to_numpy(np.int64)).view(np.uint64)
    leaf = max(SAMPLE_PER_SHARD, len(sample) // shards)
    trees = [build(sample, m, leaf, np.random.default_rng(k)) if shards > 1 else None for k, m in enumerate(metrics)]

    def routed(batches):
        for pdf in batches:
            points = pdf["fp"].to_numpy().view(np.uint64)
            for k, tree in enumerate(trees):
                out: list = []
                route(tree, points, np.arange(len(points)), np.ones(len(points), bool), out)
                for number, at, home in out:
                    yield pd.DataFrame({"tree": k, "leaf": number, "fp": points[at].view(np.int64), "home": home})

    sent = fps.mapInPandas(routed, "tree int, leaf long, fp long, home boolean")
    return sent.groupBy("tree", "leaf").applyInPandas(shard_links, "a long, b long").distinct()


def near_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` (signed 64-bit), ``fingerprint``, ``component_id``, ``kept``.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any
    other.  Equal fingerprints are one node, so copies never multiply.  ``component_id`` is the
    smallest id of the component; ids that are null count only where a component has no other, and
    then it is null.  ``kept`` is true on every row with that id.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(
        docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_hash"), F.arrow_udf(fingerprints, LongType())(F.col(text)).alias("fp")), "fp"
    )
    fps = scratch.keep(rows.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    roots = joined_components(link_edges(fps.select("fp"), shard_rows), scratch)
    nodes = fps.join(roots, fps.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    nodes = scratch.keep(nodes, "rooted")
    lows = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    member = scratch.keep(nodes.join(lows, "root").select("fp", "component_id"), "members")
    return rows.join(member, "fp").select(
        F.col("id").alias(id),
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
        "text_hash",
    )


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, ``text_hash``, ``component_id`` and ``kept``, by exact similarity.

    Documents are linked if the Jaccard similarity of their sets of five-word shingles (of a shorter
    text: its whole word sequence; words as in the fingerprints) is 0.8 or more and one of their
    fingerprints leads to the other, directly or through documents between them.  Every link is exact;
    what the fingerprints miss is measured in the tests.  Null and empty texts, and texts of white
    space, have equal sets and are linked.  ``component_id`` is the smallest id of the component, null
    only where it has no other; ``kept`` is true on the rows of one id and text of each component.  An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near-copies")
    prints = F.arrow_udf(copy_prints, "array<bigint>")(F.col(text))
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_hash"), prints.alias("prints"))
    rows = rows.groupBy("id", "text_hash").agg(F.first("prints").alias("prints"), F.count(F.lit(1)).cast("int").alias("copies"))
    rows = scratch.keep(rows.withColumn("rid", F.monotonically_increasing_id()), "prints")
    edges = []
    for k in range(PRINTS):
        own = rows.select("rid", F.col("prints")[k].alias("fp"))
        nodes = scratch.keep(own.groupBy("fp").agg(F.min("rid").alias("first")), "nodes")
        found = scratch.keep(link_edges(nodes.select("fp"), shard_rows, tree_metrics(5, PRINT_RADIUS)), "links")
        near = found.join(nodes.toDF("a", "x"), "a").join(nodes.toDF("b", "y"), "b").select("x", "y")
        same = own.join(nodes, "fp").where("rid <> first").select("rid", "first")
        edges += [near.toDF("a", "b"), same.toDF("a", "b")]
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    roots = joined_components(every, scratch)
    group = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    group = scratch.keep(group.withColumnRenamed("node", "rid").join(rows.drop("prints", "copies"), "rid"), "candidates")
    member = group.select("rid", "root", F.col("id").alias("group_id"), F.col("text_hash").alias("group_hash"))
    member = F.broadcast(member) if group.count() <= BROADCAST_ROWS else member
    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    sets = slim.join(member, F.col("id").eqNullSafe(F.col("group_id")) & (F.xxhash64("text") == F.col("group_hash")))
    sets = sets.select("rid", "root", shingle_hashes(F.col("text"), COPY_WORDS).alias("shingles")).dropDuplicates(["rid"])
    links = confirmed(scratch.keep(sets, "sets"), scratch, COPY_SIMILARITY)
    found = joined_components(links, scratch)
    labelled = rows.drop("prints").join(found, F.col("rid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rid")).drop("node")
    labelled = scratch.keep(labelled, "labelled")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("best")
    best = scratch.keep(labelled.groupBy("root").agg(best), "best")
    out = labelled.join(best, "root").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(F.col("id").alias(id), "text_hash", F.col("best.id").alias("component_id"), (F.col("rid") == F.col("best.rid")).alias("kept"))


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component of ``near_dedup``, the one with the smallest id; all columns."""
    return keep_decided(docs, near_dedup(docs, id, text), id, F.xxhash64(text), "text_hash", text)


def drop_similar(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component of ``near_copies``, the one with the smallest id; all columns."""
    return keep_decided(docs, near_copies(docs, id, text), id, F.xxhash64(text), "text_hash", text)
