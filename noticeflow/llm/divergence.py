"""Source divergence audit: how far the term distributions of the sources of a language lie apart.

Each task counts the terms of its documents by language and source before anything is shuffled.  A
kept term is then one row of a language: its nonzero counts in the order of the sources.  Smoothed
probabilities differ for every term, also for those that neither of two sources holds, so the sum of
differences of a pair of sources is taken apart:

* what it would be if neither source held any term: one figure for each pair;
* what the terms of one source change against the other's level of zero: the source's count classes
  (at most about the square root of twice its terms) against the other sources' levels, by sorted
  prefix sums;
* what terms held by both still change: frequent-pattern trees.  Equal rows are one row with a
  multiplicity, rows are dealt out in ranges of their order, and a task inserts its range into a tree
  whose path at any time is the row at hand.  Rows that begin alike share nodes; when a node is left,
  the number of terms below it is known, and its correction for every node above it is added once.
  A path that a range cuts has nodes in both tasks, whose multiplicities add up.

All of it is integer arithmetic, so the parts add up to exact sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .byte_terms import LETTERS, portions, term_table
from .common import Scratch, small_batches

TABLE = term_table(LETTERS)
#: Documents of a language that hold a kept term; smoothing; scale of probabilities; ranks of terms.
LEAST_DOCS, SMOOTH, SCALE, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: Entries that a task counts, and pairs of sources that it sums, before it hands them on.
ENTRIES, CELLS = 400_000, 1 << 22


def count_terms(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """Partial counts: (lang, source, term, n, docs), several rows for a term, one or more from a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            for key, body in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2)):
                if not body.is_valid:
                    continue
                n, holding = groups.setdefault(key, (Counter(), Counter()))
                seen: set[bytes] = set()
                for words in portions(body.as_buffer().to_pybytes(), TABLE):
                    n.update(words)
                    seen.update(words)
                holding.update(seen)
            if sum(len(n) for n, _ in groups.values()) > ENTRIES:
                yield from rows(groups)
                groups = {}
        yield from rows(groups)

    def rows(groups: dict) -> Iterator[pa.RecordBatch]:
        for (a, b), (n, holding) in groups.items():
            terms = list(n)
            columns = [pa.array([a], pa.string()).take(zeros := pa.array(np.zeros(len(terms), np.int32))), pa.array([b], pa.string()).take(zeros), pa.array(terms, pa.binary())]
            counts = [pa.array(np.fromiter((c[t] for t in terms), np.int64, len(terms))) for c in (n, holding)]
            yield pa.RecordBatch.from_arrays(columns + counts, names=["lang", "source", "term", "n", "docs"])

    small_batches(docs.sparkSession)
    slim = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))], F.col(text).cast("binary").alias("text"))
    return slim.mapInArrow(count, "lang string, source string, term binary, n long, docs long")


def level(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept)), exactly; 0 where no term is kept."""
    long = lambda c: c.cast("decimal(20,0)")
    part = F.call_function("div", (long(n + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)"), (long(total) + long(kept) * F.lit(SMOOTH).cast("decimal(2,0)")).cast("decimal(38,0)"))
    return F.when(kept > 0, part + 1).otherwise(F.lit(0).cast("long"))


def tree_corrections(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value), a > b: summed corrections of terms that sources ``a`` and ``b`` both hold.

    ``rows``: lang, path array<struct<i int, p long, z long>> in order of i, m long (terms with that path).
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, tree = None, Tree()
        for batch in batches:
            paths = batch.column(1)
            offsets = paths.offsets.to_numpy()
            fields = [paths.values.field(k).to_numpy() for k in range(3)]
            for r, (name, m) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if name != lang or tree.cells > CELLS:
                    yield from sums(lang, tree)
                    lang, tree = name, Tree()
                tree.insert(*[f[offsets[r] : offsets[r + 1]] for f in fields], m)
        yield from sums(lang, tree)

    def sums(lang: str | None, tree: Tree) -> Iterator[pa.RecordBatch]:
        tree.leave(0)
        for a, values in tree.sums.items():
            b = np.flatnonzero(values)
            if len(b):
                columns = [pa.array([lang] * len(b), pa.string()), pa.array(np.full(len(b), a, np.int32)), pa.array(b.astype(np.int32)), pa.array(values[b])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

    return rows.select("lang", "path", "m").mapInArrow(walk, "lang string, a int, b int, value long")


class Tree:
    """The path at hand of a frequent-pattern tree whose rows are inserted in order.

    A node is a source with its level; ``m`` counts the terms that run through it.
    """

    def __init__(self):
        self.i, self.p, self.z, self.m = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        self.sums: dict[int, np.ndarray] = {}
        self.cells = 0

    def insert(self, i: np.ndarray, p: np.ndarray, z: np.ndarray, m: int) -> None:
        n = min(len(i), len(self.m))
        differ = np.flatnonzero((i[:n] != self.i[:n]) | (p[:n] != self.p[:n]))
        shared = int(differ[0]) if len(differ) else n
        self.leave(shared)
        self.i, self.p, self.z = i, p, z
        self.m += [0] * (len(i) - shared)
        if self.m:
            self.m[-1] += m

    def leave(self, depth: int) -> None:
        """Closes the nodes below ``depth``, the deepest first: each corrects the pairs with the nodes above it."""
        while len(self.m) > depth:
            m, d = self.m.pop(), len(self.m)
            if not d:
                continue
            self.m[-1] += m
            p, z, up, zero = self.p[d], self.z[d], self.p[:d], self.z[:d]
            both = np.abs(p - up) - np.abs(p - zero) - np.abs(up - z) + np.abs(z - zero)
            a = int(self.i[d])
            if a not in self.sums:
                self.sums[a] = np.zeros(a, np.int64)
                self.cells += a
            self.sums[a][self.i[:d]] += m * both


def zero_levels(groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): changes by the terms of ``a`` against ``b``'s level of zero; where a < b, the base as well.

    ``groups``: lang, i, z, kept, classes array<struct<p long, m long>> (null: none), others array<struct<i int, z long>>.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in range(batch.num_rows):
                lang, i, z, kept = (batch.column(c)[g].as_py() for c in range(4))
                classes, others = batch.column(4)[g], batch.column(5)[g].values
                b, level_of_b = (others.field(k).to_numpy() for k in range(2))
                b, level_of_b = b[b != i], level_of_b[b != i]
                base = np.abs(z - level_of_b)
                value = np.where(b > i, kept * base, 0)
                if classes.is_valid and len(classes):
                    p, m = (classes.values.field(k).to_numpy() for k in range(2))
                    by = np.argsort(p)
                    p, m = p[by], m[by]
                    below = np.searchsorted(p, level_of_b)
                    terms, sums = (np.concatenate([[0], np.cumsum(x)]) for x in (m, m * p))
                    apart = (sums[-1] - 2 * sums[below]) - level_of_b * (terms[-1] - 2 * terms[below])
                    value = value + apart - terms[-1] * base
                columns = [pa.array([lang] * len(b), pa.string()), pa.array(np.full(len(b), i, np.int32)), pa.array(b), pa.array(value.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

    return groups.select("lang", "i", "z", "kept", "classes", "others").mapInArrow(compare, "lang string, a int, b int, value long")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """Rows of part ``pair`` (the other sources of the language) and ``term`` (terms above the language's level).

    lang, source, part, item, ``value`` long, ``rank`` int: from 1 for each lang, source and part, by value,
    the largest first, then by item.  Null text, lang and source count as empty strings, so null and
    empty are one group.  A group without terms has pairs all the same; where no term of a language is
    kept, the pairs' values are 0.  A language of one source has no pairs.  Every row counts, repeated
    or not; columns beside the three are ignored.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    parts = count_terms(docs, text, lang, source)
    # dealt by language and term once: both sums find their rows in place
    counts = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.collect_list(F.struct("source", "n")).alias("row")
    )
    kept = scratch.keep(kept.where(F.col("docs") >= least_docs).select("lang", F.col("term").cast("string").alias("term"), "all_n", "row"), "kept")
    entries = kept.select("lang", "term", "all_n", F.explode("row").alias("e")).select("lang", "term", "all_n", "e.*")

    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all_n").alias("lang_total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = groups.withColumn("z", level(F.lit(0).cast("long"), F.col("total"), F.col("kept")))
    groups = scratch.keep(groups.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "groups")

    known = groups.select("lang", "source", "i", "total", "kept", "lang_total", "z")
    levels = entries.join(known, ["lang", "source"]).select(
        "lang", "source", "term", "i", "z", level(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        level(F.col("all_n"), F.col("lang_total"), F.col("kept")).alias("q"),
    )
    levels = scratch.keep(levels, "levels")

    rows = levels.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("i", "p", "z"))).alias("path"))
    rows = rows.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("m"))
    both = tree_corrections(rows.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path"))
    classes = levels.groupBy("lang", "i", "p").agg(F.count(F.lit(1)).alias("m"))
    classes = classes.groupBy("lang", "i").agg(F.collect_list(F.struct("p", "m")).alias("classes"))
    others = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "z"))).alias("others"))
    one = zero_levels(groups.join(classes, ["lang", "i"], "left").join(others, "lang"))
    sums = one.unionByName(both).groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))
    pairs = sums.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.*", "value")
    named = groups.select("lang", "i", "source")
    pairs = pairs.join(named, ["lang", "i"]).join(named.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"])

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    above = levels.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= term_ranks)
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    columns = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(above, "term"))
