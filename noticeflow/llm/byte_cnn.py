"""Quality classifier: a small byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks that overlap by the filter width less one, so that
every window of the document lies in exactly one chunk and none is skipped.  Each filter is a
learned table of one weight per byte and place in the window; a chunk keeps every filter's largest
response.  The mean and the largest of these over all chunks of the document go into one logistic
unit, whose output is the probability of label 1.

The network is trained on the driver from a sample of labelled rows outside the held-out fold, each with all
of its chunks: at most ``TRAIN_ROWS`` rows and ``TRAIN_BYTES`` bytes in all, taken in the order of a hash, among rows of
at most ``LONGEST`` bytes.  Scoring covers every byte of every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from .common import free_name, release_memory, small_batches

FILTERS, WIDTH, CHUNK = 24, 5, 512
#: Bounds of the training sample: rows, bytes in all, bytes of a row.
TRAIN_ROWS, TRAIN_BYTES, LONGEST = 4000, 8 << 20, 1 << 16
#: Least number of passes and of steps; rows and (but for a single longer one) chunks of a step.
EPOCHS, STEPS, BATCH, BATCH_CHUNKS = 8, 300, 64, 128
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Chunks whose responses are computed at once, and texts that are held as strings.
PORTION, ROWS = 256, 256


@dataclass
class Network:
    tables: np.ndarray  # (WIDTH, 256, FILTERS) float32
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,): of the mean, of the largest
    level: float

    def pooled(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each chunk of windows that begins at ``starts``."""
        n = len(data) - WIDTH + 1
        out = self.tables[0][data[:n]]
        for w in range(1, WIDTH):
            out += self.tables[w][data[w : n + w]]
        return np.maximum.reduceat(out, starts, axis=0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        n = len(texts)
        total, most, chunks = np.zeros((n, FILTERS)), np.full((n, FILTERS), -1.0), np.zeros(n)
        for docs, top in self.responses(texts):
            h = np.tanh(top + self.bias)
            np.add.at(total, docs, h)
            np.maximum.at(most, docs, h)
            np.add.at(chunks, docs, 1)
        z = np.concatenate((total / chunks[:, None], most), axis=1) @ self.weights + self.level if n else np.zeros(0)
        return 1 / (1 + np.exp(-z))

    def responses(self, texts):
        """(document of each chunk, responses of each chunk), in portions of bounded size."""
        held, docs, begins, size, pad = [], [], [], 0, b"\0" * (WIDTH - 1)
        for k, text in enumerate(texts):
            data = (text or "").encode("utf-8", "surrogatepass") + pad
            step = CHUNK * PORTION
            # each window of the document, and the one of an empty text, begins in one chunk
            for at in range(0, max(1, len(data) - WIDTH + 1), step):
                part = data[at : at + step + WIDTH - 1]
                part = part if len(part) >= WIDTH else part + b"\0"
                held.append(part)
                windows = len(part) - WIDTH + 1
                docs += [k] * -(-windows // CHUNK)
                begins.append(np.arange(size, size + windows, CHUNK))
                size += len(part)
                if size >= step:
                    yield self.portion(held, docs, begins)
                    held, docs, begins, size = [], [], [], 0
        if held:
            yield self.portion(held, docs, begins)

    def portion(self, held, docs, begins):
        # windows that reach from one part into the next are computed with the chunk before them,
        # unless they are cut off: each part's own windows end where its last WIDTH - 1 bytes begin
        data, lens = np.frombuffer(b"".join(held), np.uint8), np.fromiter(map(len, held), np.int64)
        ends = np.cumsum(lens)
        starts, counts = np.concatenate(begins), [len(b) for b in begins]
        cut = ends - (WIDTH - 1)
        marks = np.concatenate([np.append(b, c) for b, c in zip(begins, cut)])[:-1]
        own = np.ones(len(marks), bool)
        own[np.cumsum(np.array(counts) + 1)[:-1] - 1] = False
        top = self.pooled(data, marks)[own]
        if not len(top) == len(starts) == len(docs):
            raise RuntimeError("a portion's chunks do not fit its documents")
        return np.array(docs), top


def all_chunks(text: str | None) -> bytes:
    """The chunks of a text, each with its number of windows (two bytes), padded.

    The windows are those that scoring sees: the text ends in WIDTH - 1 zeros, and what pads a chunk
    beyond them is never looked at.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    size = CHUNK + WIDTH - 1
    windows = lambda i: int(min(CHUNK, max(1, len(data)) - i * CHUNK))
    n = max(1, -(-len(data) // CHUNK))
    return b"".join(windows(i).to_bytes(2, "little") + data[i * CHUNK : i * CHUNK + size].ljust(size, b"\0") for i in range(n))


def windows_and_chunks(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows and bytes of the chunks of ``all_chunks``."""
    rows = np.frombuffer(packed, np.uint8).reshape(-1, CHUNK + WIDTH + 1)
    return np.ascontiguousarray(rows[:, :2]).view("<u2")[:, 0].astype(np.int64), rows[:, 2:]


def chunk_responses(tables: np.ndarray, windows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Responses of each filter at each window (chunks, CHUNK, FILTERS), lowest beyond a chunk's own windows."""
    conv = tables[0][x[:, :CHUNK]]
    for w in range(1, WIDTH):
        conv += tables[w][x[:, w : w + CHUNK]]
    conv[np.arange(CHUNK) >= windows[:, None]] = -np.inf
    return conv


def train(samples: list[tuple[bytes, int]], seed: int = 3) -> Network:
    """Fits the network by Adam on (chunks, label) pairs; without rows every score is one half."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.full(FILTERS, -1.5), rng.normal(0, 0.3, 2 * FILTERS), 0.0
    )
    if not samples:
        net.weights[:] = 0
        return net
    drawn = [windows_and_chunks(b) for b, _ in samples]
    docs, all_windows = [x for _, x in drawn], [n for n, _ in drawn]
    labels = np.array([y for _, y in samples], float)
    params = {"tables": net.tables, "bias": net.bias, "weights": net.weights}
    first = {k: np.zeros_like(v, dtype=float) for k, v in params.items()} | {"level": 0.0}
    second = {k: np.zeros_like(v, dtype=float) for k, v in params.items()} | {"level": 0.0}
    epochs = max(EPOCHS, -(-STEPS // -(-len(docs) // BATCH)))
    passes = [batched(rng.permutation(len(docs)), [len(d) for d in docs]) for _ in range(epochs)]
    step, total = 0, sum(map(len, passes))
    for batches in passes:
        for batch in batches:
            x = np.concatenate([docs[i] for i in batch])
            counts = np.array([len(docs[i]) for i in batch])
            owner = np.repeat(np.arange(len(batch)), counts)
            bounds = np.concatenate(([0], np.cumsum(counts)[:-1]))
            conv = chunk_responses(net.tables, np.concatenate([all_windows[i] for i in batch]), x)
            place = conv.argmax(axis=1)  # (chunks, FILTERS)
            top = np.take_along_axis(conv, place[:, None, :], 1)[:, 0]
            h = np.tanh(top + net.bias)
            mean, most = np.add.reduceat(h, bounds, axis=0) / counts[:, None], np.maximum.reduceat(h, bounds, axis=0)
            features = np.concatenate((mean, most), axis=1)
            p = 1 / (1 + np.exp(-(features @ net.weights + net.level)))
            dz = (p - labels[batch]) / len(batch)
            df = dz[:, None] * net.weights
            dh = df[owner, :FILTERS] / counts[owner, None] + df[owner, FILTERS:] * (h == most[owner])
            dtop = dh * (1 - h * h)
            grads = {"weights": features.T @ dz + 1e-4 * net.weights, "bias": dtop.sum(axis=0), "level": dz.sum()}
            grads["tables"] = np.zeros(net.tables.shape)
            f = np.broadcast_to(np.arange(FILTERS), place.shape)
            rows = np.arange(len(x))[:, None]
            for w in range(WIDTH):
                np.add.at(grads["tables"][w], (x[rows, place + w], f), dtop)
            step += 1
            rate = 0.03 * (1 - step / (total + 1))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                if k == "level":
                    net.level -= move
                else:
                    params[k] -= move.astype(params[k].dtype)
    return net


def batched(order: np.ndarray, chunks: list[int]) -> list[np.ndarray]:
    """The rows in order, cut into steps of bounded rows and chunks."""
    out, held = [[]], 0
    for i in order:
        if out[-1] and (len(out[-1]) == BATCH or held + chunks[i] > BATCH_CHUNKS):
            out.append([])
            held = 0
        out[-1].append(i)
        held += chunks[i]
    return [np.array(b) for b in out]


def held_out(id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo FOLDS."""
    return F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """Trains on a bounded sample of the labelled rows of ``docs`` outside the held-out fold."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(id)))
        .groupBy(F.col(id).alias("id")).agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
    )
    own = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = own.select("id", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.max("size").alias("size"))
    sizes = sizes.where(F.col("size") <= LONGEST).orderBy(F.xxhash64("id"), "id").collect()  # TRAIN_ROWS at most
    room, taken = TRAIN_BYTES, []
    for r in sizes:
        room -= r["size"]
        if room < 0:
            break
        taken.append((r.id, r.label))
    chosen = docs.sparkSession.createDataFrame(taken, chosen.schema)
    drawn = F.arrow_udf(lambda texts: pa.array([all_chunks(t) for t in texts.to_pylist()], pa.binary()), BinaryType())
    rows = (
        own.join(F.broadcast(chosen), "id")
        .select("id", "label", drawn("text").alias("chunks"))
        .groupBy("id").agg(F.min("chunks").alias("chunks"), F.first("label").alias("label"))
    )
    net = train([(bytes(r.chunks), r.label) for r in sorted(rows.collect(), key=lambda r: r.id)])
    release_memory()  # the driver keeps running
    return net


def score_column(docs: DataFrame, net: Network, text: str = "text") -> Column:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # WIDTH * 256 * FILTERS weights

    def scores(texts: pa.Array) -> pa.Array:
        # some rows at a time: a batch holds thousands of texts
        parts = [shared.value.scores(texts.slice(at, ROWS).to_pylist()) for at in range(0, len(texts), ROWS)]
        return pa.array(np.concatenate([*parts, np.zeros(0)]), pa.float64())

    return F.arrow_udf(scores, DoubleType())(F.col(text))


def quality(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score``, ``predicted``.

    Null counts as empty, and an empty text has a score like any other.  A null id is not held out
    (false) and never learned from.  Only the text enters a score, so repeated rows score alike.
    Labels other than 0 and 1 are ignored; of several labels of an id the smallest counts.  Without
    labelled rows every score is one half.  An empty table gives no rows.
    """
    scored = docs.select(F.col(id), score_column(docs, fit(docs, labels, id, text, label), text).alias("score"))
    return scored.select(
        id, F.coalesce(held_out(F.col(id)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns."""
    score = free_name(docs, "score")
    net = fit(docs, labels, id, text, label)
    return docs.withColumn(score, score_column(docs, net, text)).where(F.col(score) >= threshold).drop(score)
