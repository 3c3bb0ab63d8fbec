"""Embedding near-dedup by int8 quantised tile products with rigorous error bounds.

Every usable vector is scaled to length one and quantised to int8 with one scale per vector; the
length of what the rounding took off is kept, rounded up.  Vectors are dealt to blocks, and each
pair of blocks is a tile.  In a tile the int8 codes are multiplied, and the two vectors' errors
bound how far the true cosine can lie from the product: |x.y - x'.y'| <= e_x + e_y + e_x e_y.
Pairs surely below the threshold and pairs surely above it are done; only for the others, the open
ones, are vectors of the tile sent after the codes and cosines recomputed in double precision.

The tiles of the first pass get codes alone, a byte a dimension.  The second pass gets the vectors
of those that have an open pair in a tile, a row per vector and tile, never one per pair; which
pairs are open follows from whole numbers and so is the same in both passes.

Equal vectors are one node with a count, so copies never multiply.  A tile returns counts of links
per node and, for each linked node, the smallest one it is connected to there: a dense group costs
a row per member and tile, not one per pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, joined_components
from .simhash import Links

THRESHOLD = 0.95
#: Vectors in a block, and the rows of a tile that are multiplied at once.
BLOCK, STRIP = 8192, 512
#: Vectors that a block has at least on average, however many cores there are.
LEAST_BLOCK = 512
#: Numbers in a gathered matrix of pairs.
GATHERED = 1 << 22
#: What double precision may take off a unit vector's cosine and its bounds, with room to spare.
ROUNDING = 1e-11


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length one without overflow."""
    x = matrix.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and upper bounds of the lengths of the quantisation errors."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error * (1 + 1e-9) + 1e-12


def possible_pairs(codes, scale, error, rows, columns, threshold):
    """(i, j, sure) of pairs whose bounds reach the threshold, as indices into the tile's vectors.

    A pair is possible if s_i s_j (q_i . q_j) >= t - e_i - e_j - e_i e_j.  Divided by the scales,
    both sides are one product of rows with two columns more than the codes, one strip of ``rows`` at
    a time.  Its rounding in float32 is under (dims + 2) 2**-23 in units of the cosine, twice that is
    given away.  What it lets through is judged by q_i . q_j itself, a whole number: the product
    lies at or over the threshold by more than the bounds (``sure``), or within them.
    """
    dims = codes.shape[1]
    least, most = threshold - (dims + 2) * 2.0**-22, 1 + error[rows].max(initial=0.0)
    right = np.empty((len(columns), dims + 2), np.float32)
    right[:, :dims] = codes[columns]
    right[:, dims], right[:, dims + 1] = 1 / scale[columns], error[columns] / scale[columns]
    step = max(1, GATHERED // dims)
    for at in range(0, len(rows), STRIP):
        r = rows[at : at + STRIP]
        left = np.empty((len(r), dims + 2), np.float32)
        left[:, :dims] = codes[r]
        left[:, dims], left[:, dims + 1] = (error[r] - least) / scale[r], most / scale[r]
        i, j = np.nonzero(left @ right.T >= 0)
        for s in range(0, len(i), step):
            p, q = r[i[s : s + step]], columns[j[s : s + step]]
            product = np.einsum("ij,ij->i", codes[p].astype(np.float64), codes[q].astype(np.float64)) * (scale[p] * scale[q])
            bound = error[p] + error[q] + error[p] * error[q] + ROUNDING
            some = product >= threshold - bound
            yield p[some], q[some], (product >= threshold + bound)[some]


def tile_pairs(x, codes, scale, error, rows, columns, threshold, settled=True):
    """(i, j) of linked pairs: open ones by their recomputed cosines, and, if ``settled``, the sure ones."""
    step = max(1, GATHERED // x.shape[1])
    for i, j, sure in possible_pairs(codes, scale, error, rows, columns, threshold):
        if settled:
            yield i[sure], j[sure]
        i, j = i[~sure], j[~sure]
        for s in range(0, len(i), step):
            p, q = i[s : s + step], j[s : s + step]
            hit = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            yield p[hit], q[hit]


FOUND = "dims int, first int, second int, node long, links long, low long, open boolean"


def tile_links(threshold: float, recompute: bool):
    """The function of a tile: first from the codes, or, with ``recompute``, from the vectors sent after."""

    def links_of_tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Per node of the tile: ``links`` (weighted by copies), ``low``, the node it hangs on, and ``open``."""
        dims, first, second = key
        codes = np.frombuffer(b"".join(pdf["codes"]), np.int8).reshape(len(pdf), -1)
        scale, error = pdf["scale"].to_numpy(), pdf["error"].to_numpy()
        block, node, copies = pdf["block"].to_numpy(), pdf["node"].to_numpy(), pdf["copies"].to_numpy()
        rows, columns = np.flatnonzero(block == first), np.flatnonzero(block == second)
        counts, links, unsettled = np.zeros(len(pdf), np.int64), Links(len(pdf)), np.zeros(len(pdf), bool)

        def settled():
            for i, j, sure in possible_pairs(codes, scale, error, rows, columns, threshold):
                rest = ~sure & (i != j)
                unsettled[i[rest]] = unsettled[j[rest]] = True
                yield i[sure], j[sure]

        if recompute:
            x = np.frombuffer(b"".join(pdf["vector"]), np.float64).reshape(len(pdf), -1)
            pairs = tile_pairs(x, codes, scale, error, rows, columns, threshold, settled=False)
        else:
            pairs = settled()
        for i, j in pairs:
            other = i != j
            i, j = i[other], j[other]
            np.add.at(counts, i, copies[j])
            if first != second:
                np.add.at(counts, j, copies[i])
            links.add(i, j)
        label = links.merge()
        some = (counts > 0) | unsettled
        return pd.DataFrame({
            "dims": dims, "first": first, "second": second, "node": node[some],
            "links": counts[some], "low": node[label[some]], "open": unsettled[some],
        })

    return links_of_tile


def near_vectors(
    vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id``, ``kept``.

    Cosines are compared in double precision; every pair of usable vectors is covered.  Null and
    empty vectors, vectors of zeros and those with null or non-finite components link with nothing
    and are components of their own.  Vectors of different lengths do not link.  ``n_links`` counts
    other rows, copies included; repeated ids are separate rows, and ids count once in the minimum.
    ``component_id`` is the smallest non-null id of the component, ``kept`` whether it is the row's.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "cosine")
    v = F.col("v")
    usable = (
        (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.select("id", F.when(F.coalesce(usable, F.lit(False)), F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    rows = rows.withColumn("hash", F.when(v.isNotNull(), F.xxhash64("v")))
    nodes = scratch.keep(
        rows.where("v is not null").groupBy("hash", "v").agg(F.min("id").alias("low_id"), F.count(F.lit(1)).alias("copies"))
        .select(F.monotonically_increasing_id().alias("node"), "hash", "low_id", "copies", "v"), "nodes"
    )
    number = nodes.count()
    # a hash leads rows back to their node alone if it stands for one vector of this table only
    one_to_one = nodes.groupBy("hash").count().where("count > 1").isEmpty()
    # blocks of bounded size, and more of them where they would give fewer tiles than four a core
    wanted = math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism))
    blocks = max(1, -(-number // block), min(wanted, number // LEAST_BLOCK))

    def quantised(batches):
        for pdf in batches:
            for dims, part in pdf.groupby(pdf["v"].map(len), sort=False):
                x = unit(np.array(part["v"].tolist()))
                codes, scale, error = quantise(x)
                yield pd.DataFrame({
                    "node": part["node"].to_numpy(), "copies": part["copies"].to_numpy(), "dims": dims,
                    "codes": [c.tobytes() for c in codes], "scale": scale, "error": error, "vector": [y.tobytes() for y in x],
                })

    coded = scratch.keep(
        nodes.select("node", "copies", "v").mapInPandas(
            quantised, "node long, copies long, dims int, codes binary, scale double, error double, vector binary"
        ).withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")), "codes"
    )
    # each block meets itself and every other once
    tile = ["dims", "first", "second"]
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = coded.withColumn("other", other).select(
        "dims", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        "node", "copies", "codes", "scale", "error", "block",
    )
    judged = scratch.keep(sent.groupBy(*tile).applyInPandas(tile_links(threshold, recompute=False), FOUND), "judged")
    open_ = judged.where("open").select("first", "second", "node").join(coded, "node")
    open_ = scratch.keep(open_.groupBy(*tile).applyInPandas(tile_links(threshold, recompute=True), FOUND), "recomputed")
    found = judged.unionByName(open_).where("links > 0")
    roots = joined_components(found.select(F.col("node").alias("a"), F.col("low").alias("b")), scratch)
    n = nodes.drop("v", "hash").join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    n = scratch.keep(n.select("node", "low_id", "copies", F.coalesce("root", "node").alias("root")), "rooted")
    low = n.groupBy("root").agg(F.min("low_id").alias("component_id"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    n = n.join(low, "root").join(counts, "node", "left").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    same = ["hash"] if one_to_one else ["hash", "v"]
    n = scratch.keep(n.join(nodes.select("node", *same), "node"), "members")
    return rows.select("id", *same).join(n, same, "left").select(
        F.col("id").alias(id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"),
    )
