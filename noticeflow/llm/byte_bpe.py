"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is cut by the pre-tokenizer's pattern.  Pieces that are tokens as they stand need no merge.
The others are bucketed by length into padded matrices of token ids; in each round every row merges
its leftmost pair of least rank, found by a hash table over pairs, and rows without a pair left are
done and compacted away.  Each round shortens every remaining row by one column.  Pieces over
``MATRIX_BYTES`` bytes, such as a book without white space, would need as many rounds as bytes; such
a piece is a matrix of one row, and a round merges all places of its least pair from the left, up to
the first merge that makes a pair of lower rank, which is what single merges would do.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .common import release_memory, small_batches

#: Longest piece for the matrices, elements in a matrix, distinct pieces remembered by a worker.
MATRIX_BYTES, MATRIX_CELLS, REMEMBERED = 256, 1 << 20, 200_000
#: Characters of text whose pieces are held at once (a longer text is held alone).
PORTION = 1 << 20
#: Code points that newer Unicode data count as letters or numbers, and the published
#: tokenizer's data count as neither (first-last, hexadecimal).
NEWER = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd "
    "a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb "
    "11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 "
    "187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 "
    "1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 "
    "1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
WIDTHS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, MATRIX_BYTES)
NONE = np.int32(2**31 - 1)


class PairRanks:
    """Open-addressing hash table from a pair of ids to the id of their concatenation."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.values, self.probes = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), 0
        at = self.slot(keys)
        while len(keys):
            self.probes += 1
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of those that want one slot the last stays
            placed = free & (self.keys[at] == keys)
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it is no token or either id is padding (negative)."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        out = np.full(keys.shape, NONE, np.int32)
        flat, got = keys.reshape(-1), out.reshape(-1)
        todo = np.flatnonzero(flat >= 0)
        at = self.slot(flat[todo])
        for _ in range(self.probes):
            seen = self.keys[at]
            hit = seen == flat[todo]
            got[todo[hit]] = self.values[at[hit]]
            on = ~hit & (seen >= 0)
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
            if not len(todo):
                break
        return out


class Bpe:
    """Encoder and decoder of a rank file (lines of base64 token and rank)."""

    def __init__(self, data: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.fast = regex.compile(pattern).findall
        newer = "".join("\\U{:0>8}-\\U{:0>8}".format(*r.split("-")) for r in NEWER.split())
        self.newer = regex.compile(f"[{newer}]").search
        for kind in ("L", "N"):
            pattern = pattern.replace(rf" ?\p{{{kind}}}+", rf" ?[\p{{{kind}}}--[{newer}]]+")
        pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{newer}]]")
        self.exact = regex.compile(pattern, regex.V1).findall
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        keys, values = [], []
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(r)
        self.pairs = PairRanks(np.array(keys, np.int64), np.array(values, np.int32))
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The pieces of a text.  Only texts with characters beyond Latin-1 can hold newer letters."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.newer(text):
                return self.exact(text)
        return self.fast(text)

    def merge_matrix(self, pieces: list[bytes], width: int, out: list, where: list[int]) -> None:
        """Encodes pieces of 2 to ``width`` bytes; out[where[i]] becomes the i-th one's ids as bytes."""
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < lens[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        rows = np.array(where)
        while len(rows):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            low = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NONE)
            done = low == NONE
            if done.any():
                ended = ids[done]
                for r, x, k in zip(rows[done].tolist(), ended.astype("<u4"), (ended >= 0).sum(axis=1).tolist()):
                    out[r] = x[:k].tobytes()
                ids, rank, rows, at, low = ids[~done], rank[~done], rows[~done], at[~done], low[~done]
                if not len(rows):
                    break
            here, n, w = np.arange(len(rows)), len(rows), ids.shape[1]
            ids[here, at] = low
            stay = np.ones((n, w), bool)
            stay[here, at + 1] = False
            ids = ids[stay].reshape(n, w - 1)
            stay = np.ones((n, w - 1), bool)
            stay[here, at] = False
            rank = rank[stay].reshape(n, w - 2)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < w - 2))
                rank[ok, side[ok]] = self.pairs.find(ids[ok, side[ok]], ids[ok, side[ok] + 1])

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece: per round all places of the least pair, as far as order allows."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].astype(np.int64)
        rank = self.pairs.find(ids[:-1], ids[1:])
        while len(rank) and (low := rank.min()) != NONE:
            at = np.flatnonzero(rank == low)
            # places that follow each other share an id: from the left every second one is merged
            first = np.append(True, np.diff(at) > 1)
            at = at[(at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0]
            # what a merge has beside it at its turn: on the left merged places already, on the right none
            left = np.where(at > 0, ids[at - 1], -1)
            left[1:][np.diff(at) == 2] = low
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            merged = np.full(len(at), low, np.int64)
            sooner = np.minimum(self.pairs.find(left, merged), self.pairs.find(merged, right)) < low
            if sooner.any():
                at = at[: int(sooner.argmax()) + 1]
            ids[at] = low
            ids, rank = np.delete(ids, at + 1), np.delete(rank, at)
            here = at - np.arange(len(at))
            for side in (here - 1, here):
                side = side[(side >= 0) & (side < len(rank))]
                rank[side] = self.pairs.find(ids[side], ids[side + 1])
        return ids.astype("<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        out: list = [b""] * len(pieces)
        buckets: dict[int, list] = {}
        for k, piece in enumerate(pieces):
            b = piece.encode("utf-8", "surrogatepass")
            if (r := self.ranks.get(b)) is not None:
                out[k] = r.to_bytes(4, "little")
            elif len(b) > MATRIX_BYTES:
                out[k] = self.merge_long(b)
            else:
                buckets.setdefault(next(w for w in WIDTHS if w >= len(b)), []).append((k, b))
        for width, own in buckets.items():
            step = MATRIX_CELLS // width
            for i in range(0, len(own), step):
                part = own[i : i + step]
                self.merge_matrix([b for _, b in part], width, out, [k for k, _ in part])
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Texts are taken in portions of ``PORTION`` characters, whose new pieces share matrices.
        """
        out, at = [], 0
        while at < len(texts):
            held, size = [], 0
            while at < len(texts) and size < PORTION:
                held.append(self.split(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            used = set().union(*held)
            new = list(used.difference(self.known))
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = list(used)
            self.known.update(zip(new, self.encode_pieces(new)))
            out += [b"".join(map(self.known.__getitem__, pieces)) for pieces in held]
        return out

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


_models: dict[tuple, Bpe] = {}


def _model(key: tuple[str, str], shared) -> Bpe:
    """This worker's model for (file digest, pattern), built once from the broadcast file."""
    if key not in _models:
        _models.clear()
        _models[key] = Bpe(shared.value, key[1])
    return _models[key]


#: Largest rank file that the driver reads and broadcasts.
FILE_MAX = 64 << 20


def shared_ranks(spark: SparkSession, path: str, pattern: str):
    """Key of a model and the broadcast rank file, whose size is checked."""
    with open(path, "rb") as f:
        data = f.read(FILE_MAX + 1)
    if len(data) > FILE_MAX:
        raise ValueError(f"{path} is larger than {FILE_MAX} bytes")
    return (hashlib.sha256(data).hexdigest(), pattern), spark.sparkContext.broadcast(data)


def round_trip(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``docs`` with the token ids of its texts (binary, little-endian unsigned 32-bit) and the bytes decoded from them.

    Null counts as empty; an empty text has no ids.  Existing columns named ``ids`` or ``decoded``
    are replaced.  Rows are independent: repeated rows and any order are fine.
    """
    small_batches(docs.sparkSession)
    key, shared = shared_ranks(docs.sparkSession, path, pattern)
    kept = [c for c in docs.columns if c.lower() not in (ids.lower(), decoded.lower())]
    schema = StructType([docs.schema[c] for c in kept]).add(ids, BinaryType()).add(decoded, BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # both steps in one function: decode(encode(text)) beside encode(text) would encode twice;
        # and results leave in portions, since the ids of a whole batch are larger than its texts
        model = _model(key, shared)
        for batch in batches:
            for part in portions(batch, text):
                coded = model.encode_batch(part.column(text).to_pylist())
                back = pa.array(map(model.decode, coded), pa.binary(), size=len(coded))
                columns = [part.column(c) for c in kept] + [pa.array(coded, pa.binary()), back]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids, decoded])
        model.known.clear()
        release_memory()

    return docs.mapInArrow(run, schema)


def portions(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most PORTION bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, "right")))
        yield batch.slice(at, to - at)
        at = to


def digest(tokens: DataFrame, id: str, ids: str = "ids", decoded: str = "decoded", keep: tuple = ()) -> DataFrame:
    """Id, number of tokens and digests of ids and decoded bytes, and the columns in ``keep``."""
    return tokens.select(
        id,
        *keep,
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )
