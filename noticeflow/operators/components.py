"""Duplicate groups: connected components over shared keys and near-duplicate pairs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .shared import Scratch


def key_edges(rows: DataFrame, id: str, keys: Mapping[str, Column]) -> DataFrame:
    """Star edges (a, b, reason): every row of a key points to the smallest id with that key.

    A key with many rows gives one edge per row, never one per pair.  Keys may be costly, such as hashes
    of whole texts: they are computed once per row, into the shared folder, and removed when the edges are written.
    """
    scratch = Scratch(rows.sparkSession, "keys")
    marks = F.array(*[F.struct(F.lit(n).alias("reason"), k.cast("string").alias("key")) for n, k in keys.items()])
    each = rows.select(F.col(id).alias("a"), F.explode(marks).alias("m")).select("a", "m.reason", "m.key").where("key is not null and key <> ''")
    each = scratch.keep(each, "keys")
    hubs = each.groupBy("reason", "key").agg(F.min("a").alias("b"), F.max("a").alias("most")).where("b <> most").drop("most")
    edges = scratch.keep(each.join(hubs, ["reason", "key"]).where("a <> b").select("a", "b", "reason"), "edges")
    scratch.drop(each)
    return edges


#: Rows and characters of a cell of titles; classes by which characters, and runs of GRAM characters, are counted; characters of long runs and counted at once.
CELL_ROWS, CELL_CHARS, CLASSES, GRAM, GRAM_CLASSES, LONG, AT_ONCE = 4096, 4_000_000, 32, 3, 1024, 5, 500_000


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters in order, of the standard library's sequence matcher; not symmetric."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype=float)


def common_at_most(x: str, y: str) -> int:
    """Length of the longest common subsequence, which no matching of characters in order exceeds; a word of bits for all of ``x``."""
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    whole = (1 << len(x)) - 1
    row = whole
    for c in y:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(x) - row.bit_count()


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def long_runs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the runs of LONG characters, and how many runs each has."""
    codes = codes_of(text).astype("uint64")
    run = np.zeros(max(len(codes) - LONG + 1, 0), "uint64")
    for k in range(LONG):
        run = run * np.uint64(0x100000001B3) + codes[k : k + len(run)]
    return np.unique((run * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48), return_counts=True)


def close_pairs(least: float, days: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """For two cells of titles the edges (a, b) between them: of all pairs counts by class, then of runs, of longer runs, then common subsequences, then ratios.

    A character that is left out changes at most 2 * GRAM - 1 counts of runs by one, and at most (1 - least) of both titles' are.
    Classes that runs share only add to what two titles have in common.
    """
    low = least / (2 - least) * (1 - 1e-9)

    def counted(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        rows = rows.sort_values(["n", "id"], ignore_index=True)
        kind = "uint16" if rows.n.max() < 1 << 16 else "uint32"
        counts, runs = np.empty((len(rows), CLASSES), kind), np.empty((len(rows), GRAM_CLASSES), kind)
        texts = rows.title.tolist()
        sizes = np.array([len(t) for t in texts])
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // AT_ONCE)) + 1), len(rows)]
        for i, j in zip(cuts, cuts[1:]):
            codes, of = codes_of("".join(texts[i:j])), np.repeat(np.arange(j - i), sizes[i:j])
            counts[i:j] = np.bincount(of * CLASSES + codes % CLASSES, minlength=(j - i) * CLASSES).reshape(j - i, CLASSES)
            first = np.flatnonzero(of[: 1 - GRAM] == of[GRAM - 1 :])
            run = sum(codes[first + k] * np.uint32(m) for k, m in enumerate((1, 131, 17_161)))
            runs[i:j] = np.bincount(of[first] * GRAM_CLASSES + run % 1021, minlength=(j - i) * GRAM_CLASSES).reshape(j - i, GRAM_CLASSES)
        return rows, counts, runs

    def may_differ(size: int, x: np.ndarray, y: int) -> np.ndarray:
        """Counts of runs of a size that may be unlike in titles of x and y characters that are close."""
        return (2 * size - 1) * (1 - least) * (x + y) + 1e-6 * x + 1e-6

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        out: list[tuple[object, object]] = []
        known: dict[tuple[str, str], bool] = {}

        def close(x: str, y: str) -> bool:
            if (x, y) not in known:
                size = len(x) + len(y)
                known[x, y] = x == y or (2.0 * common_at_most(x, y) / size >= least and SequenceMatcher(None, x, y).ratio() >= least)
            return known[x, y]

        if len(left) and len(right):
            own = left.cell.iloc[0] == right.cell.iloc[0]
            (left, one, run), (right, two, runs) = counted(left), counted(right)
            n, at, ids = (right[c].to_numpy() for c in ("n", "at", "id"))
            texts = right.title.tolist()
            ends = np.searchsorted(n, left.n.to_numpy() / low + 1, "right")
            begins = np.searchsorted(n, left.n.to_numpy() * low - 1, "left")
            if own:  # both sides are the same rows in the same order
                begins = np.maximum(begins, np.arange(len(left)) + 1)
            # a class a row: sums run along the titles, and none exceeds a title's length
            two = np.ascontiguousarray(two.T)
            longer: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            mine = np.zeros(1 << 16, "int64")
            for i, r in enumerate(left.itertuples(index=False)):
                s = slice(begins[i], ends[i])
                both = np.minimum(two[:, s], one[i][:, None])
                both = both.sum(axis=0, dtype=both.dtype)
                ok = (2.0 * both / np.maximum(n[s] + r.n, 1) >= least) | (n[s] + r.n == 0)
                ok &= np.abs(at[s] - r.at) <= days
                near = np.flatnonzero(ok) + s.start
                shared = np.minimum(runs[near], run[i]).sum(axis=1, dtype="int64")
                apart = np.maximum(n[near] - GRAM + 1, 0) + max(r.n - GRAM + 1, 0) - 2 * shared
                near = near[apart <= may_differ(GRAM, n[near], r.n)]
                if not len(near):
                    continue
                kinds, times = long_runs(r.title)
                mine[kinds] = times
                needed = (np.maximum(n[near] - LONG + 1, 0) + max(r.n - LONG + 1, 0) - may_differ(LONG, n[near], r.n)) / 2
                for j, least_shared in zip(near.tolist(), needed.tolist()):
                    if j not in longer:
                        longer[j] = long_runs(texts[j])
                    theirs, often = longer[j]
                    if np.add.reduce(np.minimum(mine[theirs], often)) < least_shared:
                        continue
                    first = r.id < ids[j]
                    if close(*((r.title, texts[j]) if first else (texts[j], r.title))):
                        out.append((ids[j], r.id) if first else (r.id, ids[j]))
                mine[kinds] = 0
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def close_title_edges(rows: DataFrame, id: str, title: str, domain: str, day: str, days: int = 2, least: float = 0.92) -> DataFrame:
    """Edges between rows of one domain at most so many days apart whose titles are nearly equal.

    Rows of one domain, title and day are one node: each points to the smallest id, and only nodes are
    compared, so copies never multiply.  Days are dealt to blocks of days + 1; a block's nodes are cut by
    length into cells of bounded size, and a task compares two cells, of one block or the next, whose lengths
    allow the ratio.  A ratio of r needs titles that share r / 2 of all their characters, so counts of characters
    by class and of short and longer runs, and then their longest common subsequence, rule out nearly all pairs
    before the sequence is looked at.  No text is too frequent and no title too long to be compared.
    """
    width = days + 1
    at = F.datediff(F.to_date(day), F.lit("1970-01-01").cast("date"))
    base = rows.where(F.col(title).isNotNull() & F.col(day).isNotNull()).select(
        F.col(id).alias("id"), F.col(title).alias("title"), F.col(domain).alias("domain"), at.alias("at")
    )
    scratch = Scratch(rows.sparkSession, "titles")
    nodes = base.groupBy("domain", "title", "at").agg(F.min("id").alias("id"))
    nodes = scratch.keep(nodes.where("domain is not null").withColumns({"n": F.char_length("title"), "block": F.floor(F.col("at") / width)}), "nodes")
    own = base.join(nodes.select("domain", "title", "at", F.col("id").alias("first")), ["domain", "title", "at"]).where("id <> first")
    # lengths in order, as a table of their counts; a length of more rows than a cell holds is dealt by id
    lengths = nodes.groupBy("domain", "block", "n").agg(F.count(F.lit(1)).alias("rows"))
    until = Window.partitionBy("domain", "block").orderBy("n")
    full = F.greatest(F.sum("rows").over(until) / CELL_ROWS, F.sum(F.col("rows") * F.col("n")).over(until) / CELL_CHARS)
    lengths = lengths.withColumn("part", F.floor(full))
    size = Window.partitionBy("domain", "block", "part")
    dealt = F.ceil(F.greatest(F.sum("rows").over(size) / CELL_ROWS, F.sum(F.col("rows") * F.col("n")).over(size) / CELL_CHARS))
    lengths = scratch.keep(lengths.withColumn("dealt", F.greatest(dealt, F.lit(1)).cast("int")), "lengths")
    cells = lengths.groupBy("domain", "block", "part", "dealt").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    cells = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("dealt") - 1))).withColumn("cell", F.struct("block", "part", "salt")).drop("dealt", "part", "salt")
    other = cells.select("domain", F.col("block").alias("meet"), F.col("least").alias("least2"), F.col("most").alias("most2"), F.col("cell").alias("cell2"))
    low = least / (2 - least) * (1 - 1e-9)
    tiles = cells.withColumn("meet", F.explode(F.array("block", F.col("block") + 1))).join(other, ["domain", "meet"]).where(
        ((F.col("meet") > F.col("block")) | (F.col("cell") <= F.col("cell2"))) & (F.col("least2") * low - 1 <= F.col("most")) & (F.col("least") * low - 1 <= F.col("most2"))
    )
    tiles = scratch.keep(tiles.select("domain", "cell", "cell2"), "tiles")
    placed = nodes.join(lengths.select("domain", "block", "n", "part", "dealt"), ["domain", "block", "n"])
    salt = F.pmod(F.xxhash64("id"), F.col("dealt")).cast("int")
    placed = placed.select("domain", F.struct("block", "part", salt.alias("salt")).alias("own"), "id", "title", "at", "n")
    # each side has columns of its own: both are made of the same tables
    side = lambda c: placed.join(tiles.withColumn("own", F.col(c)), ["domain", "own"]).select(
        *[F.col(x).alias(x) for x in ("domain", "id", "title", "at", "n")], *[F.to_json(x).alias(y) for x, y in (("cell", "one"), ("cell2", "two"), ("own", "cell"))]
    )
    keys = ("domain", "one", "two")
    kind = nodes.schema["id"].dataType.simpleString()
    close = side("cell").groupBy(*keys).cogroup(side("cell2").groupBy(*keys)).applyInPandas(close_pairs(least, days), f"a {kind}, b {kind}")
    every = own.select(F.col("id").alias("a"), F.col("first").alias("b")).unionByName(close)
    return every.select("a", "b", F.lit("near_title").alias("reason"))


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of all nodes with an edge (a, b) to a smaller one, root the smallest node of the component.

    Large-star and small-star contraction in turn.  Each round is two grouped minima, which combine
    before they shuffle, and two joins on the node, which Spark can split when one node has a large
    share of the edges; it is written to the shared folder, and the round before it is removed.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    cur = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges_now = moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        # counted while they are written: no job of its own, no second read
        count = Observation()
        observed = edges_now.observe(count, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        new = scratch.keep(observed, "edges")
        mark = (count.get.get("n"), count.get.get("sum"))
        scratch.drop(cur)
        cur = new
        if mark == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark


#: Members of a group whose ids are listed to make its own id.
LISTED = 10_000


def duplicate_groups(edges: DataFrame, reasons: Sequence[str], listed: int = LISTED) -> DataFrame:
    """(group_id, root, members, reason) of the components of two rows or more.

    The group id is a hash of the sorted member ids; of a group with more than ``listed`` members,
    whose ids do not belong into one row, it is a hash of their number and of the sum of their
    hashes, which any order of adding gives alike.  The reason is the first in the given order.
    """
    scratch = Scratch(edges.sparkSession, "groups")
    edges = scratch.keep(edges, "edges")  # read for the components and for the reasons
    roots = scratch.keep(components(edges, scratch), "roots")
    members = roots.select("root", F.col("node").alias("id")).unionByName(roots.select("root", F.col("root").alias("id")).distinct())
    rank = F
    for n, r in enumerate(reasons):
        rank = rank.when(F.col("reason") == r, n)
    why = edges.join(roots, F.col("a") == F.col("node"), "left").select(F.coalesce("root", "a").alias("root"), rank.alias("k"))
    why = why.groupBy("root").agg(F.min("k").alias("k"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).cast("int").alias("members"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"))
    sizes = scratch.keep(sizes, "sizes")
    small = members.join(sizes.where(F.col("members") <= listed).select("root"), "root", "left_semi")
    ids = small.groupBy("root").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), "|")
    text = F.coalesce(text, F.concat_ws("#", "members", F.col("sum").cast("string")))
    return sizes.join(ids, "root", "left").join(why, "root").select(
        F.concat(F.lit("dup-"), F.substring(F.sha2(text, 256), 1, 12)).alias("group_id"), "root", "members",
        F.element_at(F.array(*[F.lit(r) for r in reasons]), F.col("k") + 1).alias("reason"),
    )
