"""Token ids packed into matrices: best-fit-decreasing with a segment tree over capacities.

Texts are encoded (special tokens' strings are ordinary text) and cut, losslessly, into pieces of at most ``seq_len`` tokens;
only the last piece of a text can be shorter. Full pieces fill a row of their own.
The others are gathered over a window of ``WINDOW_TOKENS`` tokens, or
``WINDOW_PIECES`` pieces, of a partition and packed longest first, each into the row with the least room that still holds
it. Rows are found by their room: a segment tree over the capacities 0..seq_len
marks which rooms are on offer, and one walk up and down finds the smallest that
is large enough. Windows bound memory and need no shuffle; only the last rows of a
window are not full.

A packed row holds the ids as little-endian integers, padded to seq_len (16 bits
where the vocabulary fits), the documents and piece numbers in order, cumulative
segment lengths, and the places where positions start anew. Reading the segments
by document and piece gives back each text's ids.

Defined results: a null or empty text is a segment of length 0, so every document
is in exactly one set of segments; a row has seq_len segments at most; a very long
text fills rows of its own, given out as they are cut; repeated documents are packed
as often as they come; of pieces of one length the earlier is packed first; null ids
are kept; an empty table gives no rows. Only doc_id and text are read, so that other
columns cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PATTERN, text_batches
from .runtime import ship_package

SEQ_LEN = 2048
WINDOW_TOKENS = 2_000_000
#: Pieces that a window has at most, however short.
WINDOW_PIECES = 200_000
PAD_ID = 0


class Capacities:
    """Which rooms 0..top are on offer, and by how many rows."""

    def __init__(self, top: int):
        self.size = 1
        while self.size < top + 1:
            self.size *= 2
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += by
            at //= 2

    def least(self, need: int) -> int:
        """The smallest room on offer that is at least need, or -1."""
        tree, at = self.tree, need + self.size
        if tree[at]:
            return need
        while at > 1:
            if at % 2 == 0 and tree[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return -1
        while at < self.size:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_decreasing(lengths: list[int], seq_len: int) -> list[list[int]]:
    """Items of each row: longest item first, into the fullest row that holds it; seq_len items at most in a row."""
    rooms, rows = Capacities(seq_len), []
    offered: list[list[int]] = [[] for _ in range(seq_len + 1)]
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = rooms.least(lengths[item])
        if room < 0:
            row, room = len(rows), seq_len
            rows.append([item])
        else:
            row = offered[room].pop()
            rooms.add(room, -1)
            rows[row].append(item)
        if len(rows[row]) < seq_len:
            offered[room - lengths[item]].append(row)
            rooms.add(room - lengths[item], 1)
    return rows


def read_ranks(path: str) -> dict[bytes, int]:
    """A byte-level vocabulary: per line a token in base64 and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(i) for token, i in map(bytes.split, f)}


_encodings: dict[int, tiktoken.Encoding] = {}


def _worker_encoding(shared) -> tiktoken.Encoding:
    key = id(shared.value)
    if key not in _encodings:
        _encodings.clear()
        _encodings[key] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
    return _encodings[key]


PACKED = (
    "shard int, row bigint, n_tokens int, doc_ids array<bigint>, pieces array<int>, "
    "cu_seqlens array<int>, position_resets array<int>, ids binary"
)
_NAMES = [x.split()[0] for x in PACKED.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]

Piece = tuple[int | None, int, np.ndarray]


def _rows(packed: Iterator[list[Piece]], shard: int, seq_len: int, dtype: str, size: int = 512) -> Iterator[pa.RecordBatch]:
    columns: list[list] = [[] for _ in _NAMES]
    number = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)

    for segments in packed:
        ids = np.full(seq_len, PAD_ID, dtype)
        ends = np.cumsum([0, *(len(s[2]) for s in segments)]).tolist()
        ids[: ends[-1]] = np.concatenate([s[2] for s in segments])
        starts = sorted({a for a, b in zip(ends, ends[1:], strict=False) if b > a})
        values = (shard, number, ends[-1], [s[0] for s in segments], [s[1] for s in segments], ends, starts, ids.tobytes())
        for c, v in zip(columns, values, strict=True):
            c.append(v)
        number += 1
        if len(columns[0]) == size:
            yield batch()
            columns = [[] for _ in _NAMES]
    if columns[0]:
        yield batch()


def pack(spark: SparkSession, docs: DataFrame, path: str, seq_len: int = SEQ_LEN, window: int = WINDOW_TOKENS) -> DataFrame:
    """Packed rows of the ids of docs (doc_id, text), tokenised with the ranks file at path."""
    ship_package(spark)
    ranks = read_ranks(path)
    dtype = "<u2" if max(ranks.values()) < 2**16 else "<u4"
    shared = spark.sparkContext.broadcast(ranks)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _worker_encoding(shared).encode_to_numpy

        def packed() -> Iterator[list[Piece]]:
            waiting: list[Piece] = []
            tokens = 0

            def flush() -> Iterator[list[Piece]]:
                for row in best_fit_decreasing([len(p[2]) for p in waiting], seq_len):
                    yield [waiting[i] for i in row]

            for b in batches:
                for first, texts in text_batches(b, "text"):
                    ids = b.column("doc_id").slice(first, len(texts)).to_pylist()
                    for doc, text in zip(ids, texts, strict=True):
                        x = encode(text or "", disallowed_special=()).astype(dtype)
                        whole = len(x) // seq_len
                        for k in range(whole):
                            yield [(doc, k, x[k * seq_len : (k + 1) * seq_len])]
                        if len(x) % seq_len or not whole:
                            waiting.append((doc, whole, x[whole * seq_len :].copy()))
                            tokens += len(x) % seq_len
                        if tokens >= window or len(waiting) >= WINDOW_PIECES:
                            yield from flush()
                            waiting, tokens = [], 0
            yield from flush()

        yield from _rows(packed(), TaskContext.get().partitionId(), seq_len, dtype)

    return rows.mapInArrow(run, PACKED)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; the ids of a file's rows are its id matrix."""
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def unpack(packed: list, seq_len: int = SEQ_LEN, dtype: str = "<u2") -> dict[int | None, np.ndarray]:
    """Ids per document from collected rows; documents must have ids of their own. For tests and small sets."""
    parts: dict[int | None, list[tuple[int, np.ndarray]]] = {}
    for r in packed:
        ids = np.frombuffer(bytes(r["ids"]), dtype)
        for doc, piece, a, b in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            parts.setdefault(doc, []).append((piece, ids[a:b]))
    return {d: np.concatenate([x for _, x in sorted(p, key=lambda y: y[0])]) for d, p in parts.items()}
