"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time.

The documents of a scan task become inverted shards of bounded size: for every term of the queries
the places and frequencies of the documents that hold it.  Corpus figures (documents, terms, document
frequencies) are sums over the shards.  Then every shard answers every query:

* Term at a time: the short lists are summed into one accumulator per document.  Its tenth best sum
  is a score that the final ones reach at least, so it is the first threshold.
* Document at a time: the accumulators are one more iterator, bounded by their largest sum, beside
  the long lists, bounded by their largest contribution.  Blocks of documents whose bounds, block by
  block, add up to less than the threshold are skipped.  In the others only documents in an essential
  iterator are candidates (the iterators with the least bounds, which together cannot reach the
  threshold, are not essential), and a candidate is dropped once what it has and what the lists still
  to be sought can add stays below the threshold.

Scores are integers, and only what lies strictly below the threshold is skipped, so that results and
ties are exact.  A task carries its best documents, and so the threshold, from shard to shard, and
returns at most ``k`` a query; a window over those gives the ranks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_terms import DIGITS, LETTERS, portions, term_table
from .common import Scratch, free_name, small_batches

TABLE = term_table(LETTERS + DIGITS)
#: Documents and postings of a shard, documents of a block, blocks looked at between two thresholds.
SHARD_DOCS, SHARD_POSTINGS, BLOCK, STRIDE = 8192, 1 << 21, 128, 8
#: Lists of at most this share of a shard's documents are short.
SHORT = 1 / 32
#: Queries go to the tasks in blocks of at most so many rows and (but for a single longer one) bytes of text.
ITEM_ROWS, ITEM_BYTES = 4096, 8 << 20
K = 10


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class ShardWriter:
    """Gathers documents and gives them out as one row: ids in order, terms in each, and postings by term and place."""

    def __init__(self, vocabulary: dict[bytes, int], id_type: pa.DataType):
        self.vocabulary, self.id_type = vocabulary, id_type
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.terms, self.counts, self.postings = [], [], [], [], 0

    def add(self, ids: pa.Array, texts: pa.Array) -> Iterator[dict]:
        rows, keys = [], self.vocabulary.keys()
        for i, text in enumerate(texts):
            found, n = Counter(), 0
            for words in portions(text.as_buffer().to_pybytes() if text.is_valid else b"", TABLE):
                n += len(words)
                found.update(words)
            if not n:
                continue
            held = found.keys() & keys
            rows.append(i)
            self.lengths.append(n)
            self.terms.append(np.fromiter((self.vocabulary[t] for t in held), "<i4", len(held)))
            self.counts.append(np.fromiter((found[t] for t in held), "<i4", len(held)))
            self.postings += len(held)
            if len(self.lengths) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS:
                self.ids.append(ids.take(pa.array(rows)))
                rows = []
                yield self.row()
        self.ids.append(ids.take(pa.array(rows, pa.int64())))

    def row(self) -> dict:
        ids = pa.chunked_array(self.ids, self.id_type).combine_chunks()
        order = pc.sort_indices(ids).to_numpy()  # nulls last
        place = np.empty(len(order), "<i4")
        place[order] = np.arange(len(order), dtype="<i4")
        sizes = np.array([len(x) for x in self.terms])
        terms, counts = np.concatenate(self.terms), np.concatenate(self.counts)
        docs = np.repeat(place, sizes)
        by = np.lexsort((docs, terms))
        terms, starts = np.unique(terms[by], return_index=True)
        out = {
            "ids": ids.take(pa.array(order)), "tokens": sum(self.lengths), "lengths": np.array(self.lengths, "<i8")[order].tobytes(),
            "terms": terms, "df": np.diff(starts, append=len(by)).astype("<i8"), "docs": docs[by].tobytes(), "tfs": counts[by].tobytes(),
        }
        self.clear()
        return out


def inverted(docs: DataFrame, id: str, text: str, vocabulary: list[bytes]) -> DataFrame:
    """A row per shard; documents without terms are in none."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            writer = writer or ShardWriter({t: i for i, t in enumerate(sent.value)}, id_type)
            yield from (as_batch(row, id_type) for row in writer.add(batch.column("id"), batch.column("text")))
        if writer and writer.lengths:
            yield as_batch(writer.row(), id_type)

    def as_batch(row: dict, id_type: pa.DataType) -> pa.RecordBatch:
        kinds = {"ids": pa.list_(id_type), "tokens": pa.int64(), "lengths": pa.binary(), "terms": pa.list_(pa.int32()), "df": pa.list_(pa.int64()), "docs": pa.binary(), "tfs": pa.binary()}
        ids = pa.ListArray.from_arrays(pa.array([0, len(row["ids"])], pa.int32()), row.pop("ids"))
        return pa.RecordBatch.from_arrays([ids, *[pa.array([v], kinds[c]) for c, v in row.items()]], names=list(kinds))

    slim = docs.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text"))
    return slim.mapInArrow(build, f"ids array<{kind}>, tokens long, lengths binary, terms array<int>, df array<long>, docs binary, tfs binary")


class Shard:
    """A shard with the contribution of every posting before its term's weight, and the largest by term and block."""

    def __init__(self, ids, lengths: bytes, terms: np.ndarray, df: np.ndarray, docs: bytes, tfs: bytes, n_docs: int, n_tokens: int):
        self.ids, self.terms = ids, terms
        self.docs = np.frombuffer(docs, "<i4")
        n = np.frombuffer(lengths, "<i8")
        m = 100 - 75 + (75 * n * n_docs) // n_tokens
        tf = np.frombuffer(tfs, "<i4").astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.docs])
        self.ends = np.cumsum(df)
        self.starts = self.ends - df
        self.size, self.blocks = len(n), -(-len(n) // BLOCK)
        self.most = np.maximum.reduceat(self.impact, self.starts) if len(df) else np.zeros(0, np.int64)
        self.long = df > max(1, int(SHORT * self.size))
        # postings are in order of (term, place): block by block they are runs
        key = np.repeat(np.arange(len(terms), dtype=np.int64), df) * self.blocks + self.docs // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        row = np.cumsum(self.long) - 1
        self.row, self.block_most = row, np.zeros((int(self.long.sum()), self.blocks), np.int64)
        if len(first):
            term, block = np.divmod(key[first], self.blocks)
            inside = self.long[term]
            self.block_most[row[term[inside]], block[inside]] = np.maximum.reduceat(self.impact, first)[inside]

    def answer(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the best ``k`` documents, those with equal scores by place, none below ``least`` (over 0)."""
        at = np.searchsorted(self.terms, terms)
        inside = at < len(self.terms)
        inside[inside] = self.terms[at[inside]] == terms[inside]
        at, weights = at[inside], weights[inside]
        acc = np.zeros(self.blocks * BLOCK, np.int64)
        for t, w in zip(at, weights):
            if not self.long[t]:
                s = slice(self.starts[t], self.ends[t])
                acc[self.docs[s]] += w * self.impact[s]
        if np.count_nonzero(acc) >= k:
            least = max(least, int(np.partition(acc, -k)[-k]))
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        longs = [(int(w * self.most[t]), int(w), t) for t, w in zip(at, weights) if self.long[t]]
        longs.sort(reverse=True)
        bound = acc.reshape(self.blocks, BLOCK).max(1)
        if longs:
            bound = bound + np.array([w for _, w, _ in longs]) @ self.block_most[self.row[[t for *_, t in longs]]]
        total, acc_most = sum(b for b, *_ in longs), int(acc.max())
        alive = np.flatnonzero(bound >= least)
        while len(alive):
            now, alive = alive[:STRIDE], alive[STRIDE:]
            lo, hi = int(now[0]) * BLOCK, (int(now[-1]) + 1) * BLOCK
            candidate = np.zeros(hi - lo, bool)
            for t in self.essential(longs, acc_most, least):
                if t is None:
                    candidate |= acc[lo:hi] > 0
                else:
                    d = self.docs[self.starts[t] : self.ends[t]]
                    candidate[d[slice(*np.searchsorted(d, (lo, hi)))] - lo] = True
            looked = np.zeros((hi - lo) // BLOCK, bool)
            looked[now - now[0]] = True
            places = np.flatnonzero(candidate & np.repeat(looked, BLOCK)) + lo
            scores, rest = acc[places], total
            for b, w, t in longs:
                places, scores = self.above(places, scores, rest, least)
                d = self.docs[self.starts[t] : self.ends[t]]
                i = np.searchsorted(d, places)
                hit = i < len(d)
                hit[hit] = d[i[hit]] == places[hit]
                scores[hit] += w * self.impact[self.starts[t] + i[hit]]
                rest -= b
            places, scores = self.above(places, scores, 0, least)
            if len(places):
                best = top(np.concatenate([best[0], places]), np.concatenate([best[1], scores]), k)
                if len(best[0]) == k:
                    least = max(least, int(best[1][-1]))
                    alive = alive[bound[alive] >= least]
        return best

    @staticmethod
    def essential(longs: list[tuple], acc_most: int, least: int) -> list:
        """Without the iterators of least bounds that together stay below ``least``; None stands for the accumulators."""
        out, total = [], 0
        for b, t in sorted([(b, int(t)) for b, _, t in longs] + [(acc_most, -1)]):
            total += b
            if total >= least:
                out.append(None if t < 0 else t)
        return out

    @staticmethod
    def above(places: np.ndarray, scores: np.ndarray, rest: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        keep = scores + rest >= least
        return places[keep], scores[keep]


def top(places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((places, -scores))[:k]
    return places[by], scores[by]


def search(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = K,
    item_rows: int = ITEM_ROWS, item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The ``k`` best documents of each item: item, ``rank`` (int), id, ``score``; scores over 0 only, ties by id, null ids last.

    Null and empty texts have no terms: such documents are never found and such items find nothing.
    Every row of ``docs`` is a document, also if its id is repeated or null.  Rows of ``items`` that
    repeat id and text are one item; an id with several texts is answered once for each.  Empty
    tables give no rows.  Extra columns are ignored.  Where the ids of both tables have one name, the
    documents' column gets underscores before it.  Items come to the driver and the tasks in blocks
    of bounded size, each block answered by a pass over the documents.
    """
    size = F.coalesce(F.octet_length(F.col(item_text)), F.lit(0))
    asked = items.select(F.col(item).alias("item"), F.col(item_text).cast("binary").alias("text"), size.alias("size")).distinct()
    n, longest = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks = max(1, -(-n // item_rows), -(-longest // item_bytes))
    out = None
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        found = _search_block(docs, block, id, text, k)
        out = found if out is None else out.unionByName(found)
    names = {"item": item, "id": id if id.lower() != item.lower() else free_name(items, id)}
    return out.select(F.col("item").alias(names["item"]), "rank", F.col("id").alias(names["id"]), "score")


def _search_block(docs: DataFrame, asked: DataFrame, id: str, text: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = [(r["item"], Counter(t for ts in portions(bytes(r["text"] or b""), TABLE) for t in ts)) for r in asked.select("item", "text").toLocalIterator()]
    vocabulary = sorted({t for _, c in rows for t in c})
    scratch = Scratch(spark, "lexical")
    shards = scratch.keep(inverted(docs, id, text, vocabulary), "shards")
    n_docs, n_tokens = shards.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    # one row for a term of the block at most
    sums = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in sums:
        weights[term] = weight(n_docs, df)
    number = {t: i for i, t in enumerate(vocabulary)}
    asks = []
    for key, counts in rows:
        terms = np.array(sorted(number[t] for t in counts), np.int64)
        w = weights[terms] * np.array([counts[vocabulary[t]] for t in terms], np.int64)
        asks.append((key, terms[w > 0], w[w > 0]))
    sent = spark.sparkContext.broadcast(asks)
    item_type, id_type = (d.schema[c].dataType for d, c in ((asked, "item"), (docs, id)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in sent.value]
        kind = None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i]  # noqa: E731, B023
                lists = [get(c).values.to_numpy(zero_copy_only=False) for c in ("terms", "df")]
                shard = Shard(get("ids").values, get("lengths").as_py(), *lists, get("docs").as_py(), get("tfs").as_py(), n_docs, n_tokens)
                for j, (_, terms, w) in enumerate(sent.value):
                    held = best[j]
                    places, scores = shard.answer(terms, w, k, -held[-1][0] if len(held) == k else 1)
                    if len(places):
                        ids = shard.ids.take(pa.array(places)).to_pylist()
                        best[j] = sorted(held + [(-s, x is None, x) for s, x in zip(scores.tolist(), ids)], key=order)[:k]
        if kind is not None:
            rows = [(j, x, -s) for j, held in enumerate(best) for s, _, x in held]
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["no", "id", "score"])

    found = shards.mapInArrow(find, f"no int, id {id_type.simpleString()}, score long")
    ranks = Window.partitionBy("no").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(j, a[0]) for j, a in enumerate(asks)], f"no int, item {item_type.simpleString()}")
    return ranked.join(F.broadcast(names), "no").select("item", "rank", "id", "score")


def order(x: tuple) -> tuple:
    """By score, then by id, null last."""
    return x[0], x[1], 0 if x[1] else x[2]
