"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are cut into pre-tokens; the distinct new ones of a batch are merged
together. Their symbols stand in one flat array. A round looks up all adjacent
pairs by binary search over the sorted pair keys, takes each word's lowest rank,
merges that pair everywhere in the word, from left to right, and drops words that
have no pair left. Merging all places of one rank at once equals merging them one
after the other, as a pair made by a merge always has a higher rank than the merge.

Words of more than LONG_WORD symbols (one word may be a whole text without blanks)
have rounds of their own, as theirs are many: a round merges all places of the lowest
rank that any of them has left, and touches these places and their neighbours only.
Words don't depend on each other, so the order of ranks over all of them is the
order in each.

The vocabulary comes from a tokenizer file whose path is a parameter; it is read
by the driver, and its tables, which have a fixed size of about 50,000 entries,
go to the executors as a broadcast. A worker keeps the ids of up to CACHE_WORDS pre-tokens.

Defined results: a null text counts as empty and has no ids; special tokens of
the file are recognised in texts, as the tokenizers library does; decoding keeps
special tokens and replaces bytes that aren't UTF-8. A very long text is encoded
whole, on its own. Repeated rows are coded each, from the same cached words; of
overlapping places of one rank the leftmost merges. An empty table gives no rows.
The key travels as one column, so that its names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import ship_package

# Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cuts for texts without OTHER, from the standard library's engine, which is faster.
_FAST = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: And for plain ASCII.
_ASCII = re.compile(r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Numbers that aren't decimal digits, and characters that only one engine takes for blanks.
_OTHER = regex.compile(r"[\p{No}\p{Nl}\x1c-\x1f]")
LONG_WORD = 1024
#: Words that a worker keeps, in two generations.
CACHE_WORDS = 200_000
CACHED_CHARS = 64
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """The tables of a tokenizer file: plain arrays, to be broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids: dict[str, int] = file["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.array([ids[c] for c in letters], dtype=np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in file["model"]["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)  # by rank

    def __len__(self) -> int:
        return len(self.token_bytes)


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split = regex.compile(PATTERN)
        marks = sorted(vocabulary.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.searchsorted(self.v.keys, key)
        at[at == len(self.v.keys)] = 0
        return np.where(self.v.keys[at] == key, self.v.ranks[at], _NONE)

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as bytes."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbols), _NONE)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._pair_ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[:-1] != owner[1:]])
            lowest = np.minimum.reduceat(rank, first)
            of = np.repeat(lowest, np.diff(np.r_[first, len(symbols)]))
            done = of == _NONE
            finished.append((owner[done], symbols[done]))
            # In a run of overlapping hits every other one counts, from the left.
            where = np.flatnonzero((rank == of) & ~done)
            if not len(where):
                break
            fresh = np.r_[True, np.diff(where) != 1]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - begin) % 2 == 0]
            symbols[where] = self.v.merged[of[where]]
            keep = ~done
            keep[where + 1] = False
            touched = (np.cumsum(keep) - 1)[where]
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            # Only the pairs beside a merge have changed.
            at = np.r_[touched, touched[touched > 0] - 1]
            rank[at] = _NONE
            at = at[at + 1 < len(owner)]
            at = at[owner[at] == owner[at + 1]]
            rank[at] = self._pair_ranks(symbols[at], symbols[at + 1])
        owners, ids = (np.concatenate(x) for x in zip(*finished, strict=True))
        order = np.argsort(owners, kind="stable")
        flat = ids[order].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owners, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _merge_long(self, words: list[bytes]) -> list[bytes]:
        """Ids of each long word, as bytes, in rounds over one rank at a time."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.v.byte_ids[np.frombuffer(b"".join(words), np.uint8)].copy()
        n, ends = len(symbols), np.cumsum(lengths)
        # Neighbours in the flat array; place n stands for none.
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = n
        before[ends - lengths] = n
        rank = np.full(n + 1, _NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        ahead = np.zeros(len(self.v.merged), bool)  # ranks that wait; a merge only makes pairs of higher ones

        def offer(at: np.ndarray) -> None:
            """Rank the pairs that begin at these places, and note the places by rank."""
            rank[at] = _NONE
            at = at[after[at] < n]
            rank[at] = self._pair_ranks(symbols[at], symbols[after[at]])
            at = at[rank[at] != _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for group in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else ():
                r = int(rank[group[0]])
                ahead[r] = True
                waiting.setdefault(r, []).append(group)

        offer(np.arange(n))
        r = 0
        while waiting:
            r += int(np.argmax(ahead[r:]))
            ahead[r] = False
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # In a run of overlapping places every other one counts, from the left.
            fresh = np.r_[True, after[at[:-1]] != at[1:]]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            gone = after[at]
            symbols[at], symbols[gone], rank[gone] = self.v.merged[r], -1, _NONE
            after[at] = after[gone]
            before[after[at]] = at
            touched = np.r_[at, before[at]]
            offer(np.unique(touched[touched < n]))
        return [w[w >= 0].astype("<i4").tobytes() for w in np.split(symbols, ends[:-1])]

    def _words(self, text: str) -> list[str]:
        if text.isascii():  # engines differ over the separators, which Python's re takes for blanks in Unicode mode only
            return _ASCII.findall(text)
        return (self.split if _OTHER.search(text) else _FAST).findall(text)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids, as bytes, of each word."""
        raw = [w.encode() for w in words]
        short = [k for k, w in enumerate(raw) if len(w) <= LONG_WORD]
        merged = self._merge([raw[k] for k in short])
        ids = {words[k]: x for k, x in zip(short, merged, strict=True)}
        long = [k for k, w in enumerate(raw) if len(w) > LONG_WORD]
        return ids | {words[k]: x for k, x in zip(long, self._merge_long([raw[k] for k in long]), strict=True)}

    def _lookup(self, words: set[str]) -> dict[str, bytes]:
        """Ids, as bytes, of all words; the ones not known before are merged together."""
        known = {w: self.young[w] for w in words & self.young.keys()}
        words = words - known.keys()
        older = {w: self.old[w] for w in words & self.old.keys()}
        new = older | self._learn(list(words - older.keys()))
        if len(self.young) + len(new) > CACHE_WORDS // 2:
            self.young, self.old = {}, self.young
        self.young.update((w, x) for w, x in new.items() if len(w) <= CACHED_CHARS)
        return known | new

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (int32) of each text."""
        whole: list[list[str | int]] = []
        seen: set[str | int] = set()
        for text in texts:
            text = text or ""
            if self.marks is not None and self.marks.search(text):
                pieces: list[str | int] = []
                for part in self.marks.split(text):
                    pieces += [self.v.special[part]] if part in self.v.special else self._words(part)
            else:
                pieces = self._words(text)
            whole.append(pieces)
            seen.update(pieces)
        numbers = {p: np.array([p], "<i4").tobytes() for p in seen if isinstance(p, int)}
        known = self._lookup({p for p in seen if not isinstance(p, int)}) | numbers
        return [np.frombuffer(b"".join(map(known.__getitem__, pieces)), "<i4") for pieces in whole]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.v.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def worker_codec(shared) -> Codec:
    """This worker's codec for a broadcast vocabulary."""
    vocabulary = shared.value
    key = id(vocabulary)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def text_batches(batch: pa.RecordBatch, column: str, most_chars: int = 4_000_000, most_rows: int = 10_000) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of a batch with a bounded number of characters and rows (one text at least): first row and texts."""
    texts: list[str | None] = []
    first, chars = 0, 0
    values = batch.column(column)
    for i in range(batch.num_rows):
        text = values[i].as_py()
        if texts and (chars + len(text or "") > most_chars or len(texts) == most_rows):
            yield first, texts
            first, texts, chars = i, [], 0
        texts.append(text)
        chars += len(text or "")
    if texts:
        yield first, texts


def encode_decode(spark: SparkSession, docs: DataFrame, path: str, key: Column, text: Column) -> DataFrame:
    """key, ids, decoded of every row: the general operator."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(path))
    rows = docs.select(key.alias("key"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared)
        for batch in batches:
            for first, texts in text_batches(batch, "text"):
                ids = codec.encode_batch(texts)
                flat = pa.array(np.concatenate(ids) if ids else [], pa.int32())
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                decoded = pa.array([codec.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, len(texts)), pa.ListArray.from_arrays(offsets, flat), decoded], ["key", "ids", "decoded"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, decoded string")


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared)
        names = [str(i) for i in range(len(codec.v))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for first, texts in text_batches(batch, "text"):
                ids = codec.encode_batch(texts)
                columns = [
                    batch.column("doc_id").slice(first, len(texts)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([sha(",".join(map(names.__getitem__, x.tolist()))) for x in ids], pa.string()),
                    pa.array([sha(codec.decode(x)) for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in DIGESTS.split(", ")])

    return rows.mapInArrow(run, DIGESTS)
