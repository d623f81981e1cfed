"""Near-duplicate classes by DartMinHash and banded joining.

A document is the weighted set of its five-word shingles; a shingle's weight is
its count. DartMinHash (Christiani, 2020): darts fall on the plane of (element,
weight) x rank as a Poisson process that is a hash of the place; a set keeps the
darts in the region under its weights, up to a rank that yields enough of them,
hashes each dart to one of K coordinates, and keeps the earliest dart per
coordinate. Two sets agree in a coordinate with the probability of their weighted
Jaccard similarity. The plane is cut into strips of weight 1, each with darts at
the ranks of a unit-rate process, so a text with many shingles finds most strips
empty at once, and a short one takes several darts from each.

Signatures are joined in BANDS bands of ROWS coordinates. At similarity 0.8 two
documents share a band with probability 1 - (1 - 0.8**8)**44 = 0.9997, above it
more. Candidates are then compared exactly, on their shingle counts, and classes
are the connected components of the pairs of similarity 0.8 or more.

Nothing gathers or pairs off a band's documents:
* texts with the same words are one node;
* a node is compared with the first node of each of its bands only (first with
  the first of them; with the others as far as they lie in another component);
* the pairs this leaves out can only matter between components. Nodes of bands that
  still hold several are dealt into chunks of bounded size, and chunks that meet in
  a band are compared as wholes inside a task, which gives only links that join
  components; so no link within a shared band is lost, and no pair is emitted that
  isn't a link.
Before texts are compared, one bit of each coordinate must agree about as often
as similarity 0.8 makes it (a bound that such a pair misses once in 10**9).
Joins on a band or a class may have very frequent keys; they are plain joins of
narrow rows, which Spark splits when skewed. Components are labels passed along
links with pointer jumping, written to the shared folder in every round.

Defined results: words are runs of word characters, lower-cased; texts of fewer
than five words are one shingle; texts without any word are alike only if they
are equal (null counts as empty); a very long text is shingled whole, on its own; of a
class the row with the smallest doc_id stays, null last; of repeated rows one stays; an
empty table gives no rows; other columns travel in a struct, so that their names cannot
clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import text_batches
from .runtime import Spool, materialise, settings, shared_dir, ship_package

SHINGLE = 5
SIMILARITY = (4, 5)  # 0.8
BANDS, ROWS = 44, 8
K = BANDS * ROWS
SKETCH_LONGS = -(-K // 64)
#: Most of the K sketch bits that may differ: 6 standard deviations above the mean at similarity 0.8.
MOST_DIFFERENT = int(K * 0.1 + 6 * (K * 0.09) ** 0.5)
#: A component of so many nodes has chunks of its own; chunks hold about so many characters and nodes at most.
LARGE = 64
CHUNK_CHARS = 600_000
CHUNK_NODES = 256
_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
CACHE_WORDS = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _log_unit(x: np.ndarray) -> np.ndarray:
    """Gap of a unit-rate process from a hash."""
    return -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)


def darts(seeds: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strip, rank, dart id) of all darts on the strips with a rank below top."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live, rank, q = np.arange(len(seeds)), np.zeros(len(seeds)), 0
    while len(live):
        many = 1 if q < 6 else 64
        number = (np.arange(q + 1, q + 1 + many).astype(np.uint64) * _STEP)[None, :]
        s = seeds[live][:, None]
        ranks = rank[:, None] + np.cumsum(_log_unit(mix(s + number)), axis=1)
        low = ranks < top[live][:, None]
        i, j = np.nonzero(low)
        found.append((live[i], ranks[i, j], mix((seeds[live[i]] + number[0, j]) ^ _OTHER)))
        on = low[:, -1]
        live, rank, q = live[on], ranks[on, -1], q + many
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0), np.empty(0, np.uint64))


def signatures(seeds: np.ndarray, cover: np.ndarray, owner: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """n x k dart ids. A strip (seed) belongs to a set (owner) and is covered from below to a share (cover, up to 1)."""
    weight = np.bincount(owner, weights=cover, minlength=n)
    signature, best = np.zeros(n * k, np.uint64), np.full(n * k, np.inf)
    todo = weight > 0
    top = np.where(todo, k * (np.log(k) + 3) / np.where(todo, weight, 1), 0)
    while todo.any():
        mine = np.flatnonzero(todo[owner])
        strip, rank, dart = darts(seeds[mine], top[owner[mine]])
        strip = mine[strip]
        inside = cover[strip] >= 1
        if not inside.all():  # a strip covered in part holds the darts below its edge
            height = (mix(dart ^ _STEP) >> np.uint64(11)).astype(np.float64) / 2.0**53
            inside |= height < cover[strip]
            strip, rank, dart = strip[inside], rank[inside], dart[inside]
        at = owner[strip] * k + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(best, at, rank)
        won = rank == best[at]
        signature[at[won]] = dart[won]
        todo &= np.isinf(best.reshape(n, k)).any(axis=1)
        top = np.where(todo, top * 2, top)
    return signature.reshape(n, k)


class Shingler:
    """Shingle strips of texts; remembers the hashes of words."""

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        known = self.known
        try:
            raw = b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_digest(w)
            raw = b"".join([known[w] for w in words])
        return np.frombuffer(raw, "<u8")

    def strips(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(seed, owner): a strip for every shingle of every text; the k-th copy of a shingle has a strip of its own."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.concatenate([*words, np.zeros(SHINGLE, np.uint64)])
        starts = np.cumsum(np.r_[0, sizes])[:-1]
        counts = np.where(sizes > 0, np.maximum(1, sizes - SHINGLE + 1), 0)
        owner = np.repeat(np.arange(len(words)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
        left = np.repeat(starts + sizes, counts) - at  # words from here to the text's end
        h = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            h = mix(h + np.where(left > k, flat[at + k], 0).astype(np.uint64) + _STEP)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.empty(0, bool)
        nth = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.empty(0, int)
        return mix(h + nth.astype(np.uint64) * _OTHER), owner


def _signed(documents: DataFrame, text_col: str) -> DataFrame:
    """documents (rec) with key (of the words), bands and sketch."""
    kind = T.StructType([*documents.schema.fields, *T.StructType.fromDDL("key binary, bands array<bigint>, sketch array<bigint>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        salt = mix(np.arange(1, BANDS + 1).astype(np.uint64) * _STEP)
        for b in batches:
            own = pa.RecordBatch.from_arrays([b.column("rec").field(text_col)], ["text"])
            for first, texts in text_batches(own, "text", 2_000_000, 256):
                words = [shingler.words(t or "") for t in texts]
                seeds, owner = shingler.strips(words)
                signature = signatures(seeds, np.ones(len(seeds)), owner, len(texts))
                band = signature.reshape(len(texts), BANDS, ROWS)
                h = np.tile(salt, (len(texts), 1))
                for r in range(ROWS):
                    h = mix(h ^ band[:, :, r])
                bits = np.zeros((len(texts), SKETCH_LONGS * 64), np.uint8)
                bits[:, :K] = (signature & np.uint64(1)).astype(np.uint8)
                sketch = np.packbits(bits, axis=1).view("<i8")
                some = np.array([len(w) > 0 for w in words])
                keys = [
                    hashlib.blake2b(w.tobytes() if len(w) else b"\0" + (t or "").encode(), digest_size=16).digest() for w, t in zip(words, texts, strict=True)
                ]
                offsets = lambda width: pa.array(np.r_[0, np.cumsum(some * width)], pa.int32())  # noqa: E731, B023
                part = b.slice(first, len(texts))
                made = [
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(offsets(BANDS), pa.array(h.view(np.int64)[some].ravel(), pa.int64())),
                    pa.ListArray.from_arrays(offsets(SKETCH_LONGS), pa.array(sketch[some].ravel(), pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([part.column("rec"), *made], ["rec", "key", "bands", "sketch"])

    return documents.mapInArrow(run, kind)


def similar_enough(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of strips (sorted, distinct) have a weighted Jaccard similarity of 0.8 or more."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if SIMILARITY[1] * len(small) < SIMILARITY[0] * len(large):
        return False
    common = len(np.intersect1d(small, large, assume_unique=True))
    return SIMILARITY[1] * common >= SIMILARITY[0] * (len(a) + len(b) - common)


class Chunk:
    """Nodes with labels, sketches and strips."""

    def __init__(self, members: list[dict], shingler: Shingler):
        self.nodes = [m["node"] for m in members]
        self.labels = np.array([m["label"] for m in members], np.int64)
        self.sketches = np.array([m["sketch"] for m in members], np.int64).reshape(len(members), SKETCH_LONGS).view(np.uint64)
        self.sets = [np.sort(shingler.strips([shingler.words(m["text"])])[0]) for m in members]
        self.sizes = np.array([len(x) for x in self.sets], np.int64)


def _common(a: Chunk, b: Chunk, wanted: np.ndarray) -> np.ndarray:
    """Numbers of common strips: of all pairs by matrix products, or, if few are wanted, one by one."""
    out = np.zeros(wanted.shape, np.int64)
    if wanted.sum() <= 400:
        for i, j in np.argwhere(wanted):
            out[i, j] = len(np.intersect1d(a.sets[i], b.sets[j], assume_unique=True))
        return out
    strips = [(np.concatenate(c.sets), np.repeat(np.arange(len(c.sets)), c.sizes)) for c in (a, b)]
    both = np.intersect1d(strips[0][0], strips[1][0])
    at = []
    for values, owner in strips:
        place = np.searchsorted(both, values)
        place[place == len(both)] = 0
        known = both[place] == values if len(both) else np.zeros(len(values), bool)
        at.append((place[known], owner[known]))
    for first in range(0, len(both), 4096):
        parts = []
        for (place, owner), c in zip(at, (a, b), strict=True):
            here = (place >= first) & (place < first + 4096)
            x = np.zeros((len(c.sets), 4096), np.float32)
            x[owner[here], place[here] - first] = 1
            parts.append(x)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def joining_links(a: Chunk, b: Chunk) -> list[tuple[int, int]]:
    """Links between nodes of a and b that join components: enough of them to connect all that links connect."""
    differ = np.zeros((len(a.nodes), len(b.nodes)), np.int64)
    for k in range(SKETCH_LONGS):
        differ += np.bitwise_count(a.sketches[:, None, k] ^ b.sketches[None, :, k])
    wanted = (differ <= MOST_DIFFERENT) & (a.labels[:, None] != b.labels[None, :])
    if not wanted.any():
        return []
    common = _common(a, b, wanted)
    enough = SIMILARITY[1] * common >= SIMILARITY[0] * (a.sizes[:, None] + b.sizes[None, :] - common)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    links = []
    for i, j in np.argwhere(wanted & enough):
        x, y = find(int(a.labels[i])), find(int(b.labels[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            links.append((a.nodes[i], b.nodes[j]))
    return links


def _near(left: Column, right: Column) -> Column:
    """Whether few enough sketch bits differ."""
    differ = [F.bit_count(F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i)))) for i in range(SKETCH_LONGS)]
    return sum(differ[1:], differ[0]) <= MOST_DIFFERENT


class NearDuplicates:
    """One run over docs: the steps of the module's description."""

    def __init__(self, spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        ship_package(spark)
        self.spark, self.columns, self.id_col, self.text_col = spark, docs.columns, id_col, text_col
        rec = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec")
        self.spool = Spool(spark, _signed(docs.select(rec), text_col), shared_dir(spark, "near-spool"))
        self.nodes = materialise(self.spool.rows.groupBy("key").agg(F.min(F.struct("loc", "bands", "sketch")).alias("x")).select("key", "x.*"), "near-nodes")
        self.sketches = self.nodes.select(F.col("loc").alias("node"), "sketch")

    def _texts(self, pairs: DataFrame) -> DataFrame:
        """node, text of the nodes in pairs."""
        wanted = pairs.select(F.col("a").alias("loc")).union(pairs.select(F.col("b").alias("loc"))).distinct()
        found = self.spool.picked(wanted, "left_semi")
        return materialise(found.select(F.col("loc").alias("node"), F.coalesce(F.col(f"rec.`{self.text_col}`"), F.lit("")).alias("text")), "near-texts")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose texts are similar enough."""
        s = self.sketches
        pairs = pairs.join(s.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
        pairs = pairs.join(s.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
        pairs = materialise(pairs.filter(_near(F.col("sa"), F.col("sb"))).select("a", "b"), "near-candidates")
        if pairs.isEmpty():
            return pairs
        texts = self._texts(pairs)
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler()
            set_of = lambda t: np.sort(shingler.strips([shingler.words(t)])[0])
            last, right = None, np.empty(0, np.uint64)
            for batch in batches:
                a, b, ta, tb = (batch.column(c) for c in ("a", "b", "ta", "tb"))
                keep = []
                for i in range(batch.num_rows):
                    if b[i].as_py() != last:  # rows come in order of b, so frequent ones are read once
                        last, right = b[i].as_py(), set_of(tb[i].as_py())
                    keep.append(similar_enough(set_of(ta[i].as_py()), right))
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        with settings(self.spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}):
            return materialise(both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint"), "near-links")

    def _components(self, links: DataFrame) -> DataFrame:
        """node, label (the smallest node) of every node in links."""
        ways = materialise(links.union(links.select("b", "a")).distinct(), "near-ways")
        labels = materialise(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "near-labels")
        while True:
            # Along links: the smallest label of all neighbours.
            told = ways.join(labels, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "label")
            told = told.union(labels).groupBy("node").agg(F.min("label").alias("label"))
            told = materialise(told, "near-told")
            # Jump: the label of the label.
            up = told.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
            new = told.join(up, F.col("label") == F.col("_n"), "left").select("node", F.least("label", "_l").alias("label"))
            new = materialise(new, "near-labels")
            old = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
            if new.join(old, F.col("node") == F.col("_n")).filter("label <> _l").isEmpty():
                return new
            labels = new

    def labels(self) -> DataFrame:
        """node, label for the nodes that have links."""
        members = self.nodes.select(F.col("loc").alias("node"), F.explode("bands").alias("band"))
        crowds = members.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        crowded = materialise(members.join(crowds, "band"), "near-crowded")
        met = crowded.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
        met = materialise(met, "near-met")
        first = met.groupBy("a").agg(F.min("b").alias("b"))
        links = self._verified(first)
        labels = self._components(links)
        rest = self._apart(met.join(first, ["a", "b"], "left_anti"), labels)
        links = links.union(self._verified(rest))
        labels = self._components(links)
        more = self._between(crowded, labels)
        return labels if more.isEmpty() else self._components(links.union(more))

    def _between(self, crowded: DataFrame, labels: DataFrame) -> DataFrame:
        """Links between different components that share a band.

        The nodes of bands that hold several components are dealt into chunks of bounded size: large components
        have chunks of their own, other nodes share those of their fullest band. Chunks that meet in a band are
        compared as wholes, and give only links that join components. No pair is a row unless it is a link.
        """
        own = labels.select(F.col("node").alias("_n"), "label")
        here = crowded.join(own, F.col("node") == F.col("_n"), "left").select("band", "node", F.coalesce("label", "node").alias("label"))
        here = materialise(here, "near-here")
        held = here.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
        mixed = materialise(here.join(held.filter("k > 1").select("band", "n"), "band"), "near-mixed")
        if mixed.isEmpty():
            return labels.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
        nodes = mixed.groupBy("node", "label").agg(F.max(F.struct("n", "band")).alias("home"))
        sizes = nodes.groupBy(F.col("label").alias("_l")).agg(F.count(F.lit(1)).alias("size"))
        nodes = nodes.join(sizes, F.col("label") == F.col("_l")).select(
            "node", "label", F.when(F.col("size") >= LARGE, F.col("label")).alias("whole"), F.col("home.band").alias("home")
        )
        nodes = materialise(nodes.withColumn("grp", F.when(F.col("whole").isNotNull(), F.xxhash64(F.lit(1), "whole")).otherwise(F.xxhash64(F.lit(2), "home"))), "near-nodes2")
        texts = self._texts(nodes.select(F.col("node").alias("a"), F.col("node").alias("b")))
        nodes = nodes.join(texts.select(F.col("node").alias("_n"), F.length("text").alias("chars")), F.col("node") == F.col("_n")).drop("_n")
        parts = nodes.groupBy(F.col("grp").alias("_g")).agg(F.greatest(F.ceil(F.sum("chars") / CHUNK_CHARS), F.ceil(F.count(F.lit(1)) / CHUNK_NODES)).alias("parts"))
        part = F.pmod(F.xxhash64("node"), F.col("parts"))
        nodes = nodes.join(parts, F.col("grp") == F.col("_g")).select("node", "label", "whole", F.xxhash64("grp", part).alias("chunk"))
        nodes = materialise(nodes, "near-placed")
        member = F.struct("node", "label", "sketch", "text")
        chunks = nodes.join(self.sketches, "node").join(texts, "node").groupBy("chunk").agg(F.collect_list(member).alias("members"))
        chunks = materialise(chunks, "near-chunks")
        met = mixed.select("band", "node").join(nodes.select("node", "chunk", "whole"), "node").select("band", "chunk", "whole").distinct()
        met = materialise(met, "near-met-chunks")
        right = met.select(F.col("band").alias("_b"), F.col("chunk").alias("b"), F.col("whole").alias("wb"))
        same = F.coalesce(F.col("whole") == F.col("wb"), F.lit(False))
        pairs = met.join(right, (F.col("band") == F.col("_b")) & (F.col("chunk") <= F.col("b")) & ~same).select(F.col("chunk").alias("a"), "b").distinct()
        pairs = materialise(pairs, "near-chunk-pairs")
        both = pairs.join(chunks.select(F.col("chunk").alias("a"), F.col("members").alias("left")), "a")
        both = both.join(chunks.select(F.col("chunk").alias("b"), F.col("members").alias("right")), "b").select("a", "b", "left", "right")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler()
            last, kept = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    a, b = batch.column("a")[i].as_py(), batch.column("b")[i].as_py()
                    if b != last:  # rows come in order of b
                        last, kept = b, Chunk(batch.column("right")[i].as_py(), shingler)
                    links = joining_links(kept if a == b else Chunk(batch.column("left")[i].as_py(), shingler), kept)
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        with settings(self.spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):
            return materialise(both.mapInArrow(run, "a bigint, b bigint"), "near-links")

    def _apart(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs of nodes in different components."""
        for c in ("a", "b"):
            own = labels.select(F.col("node").alias("_n"), F.col("label").alias(f"l{c}"))
            pairs = pairs.join(own, F.col(c) == F.col("_n"), "left").drop("_n")
        return pairs.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")

    def classes(self) -> DataFrame:
        """loc, doc_id, class_id, class_size, kept of every document."""
        labels = self.labels().select(F.col("node").alias("_n"), "label")
        nodes = self.nodes.select(F.col("key").alias("_k"), F.col("loc").alias("node"))
        nodes = nodes.join(labels, F.col("node") == F.col("_n"), "left").select("_k", F.coalesce("label", "node").alias("label"))
        rows = self.spool.rows.select("loc", F.col(f"rec.`{self.id_col}`").alias("doc_id"), "key")
        rows = materialise(rows.join(nodes, F.col("key") == F.col("_k")).select("loc", "doc_id", "label"), "near-rows")
        # null ids last: the flag comes first in the order
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "loc")
        groups = rows.groupBy("label").agg(F.min(order).alias("low"), F.count(F.lit(1)).alias("class_size"))
        # Written first, so that the join is a plain one, which can be split where a class is large.
        groups = materialise(groups.select(F.col("label").alias("_l"), "low", "class_size"), "near-groups")
        joined = rows.join(groups, F.col("label") == F.col("_l"))
        return joined.select("loc", "doc_id", F.col("low.doc_id").alias("class_id"), "class_size", (F.col("loc") == F.col("low.loc")).alias("kept"))


def near_duplicate_classes(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size, kept: one row per document."""
    return NearDuplicates(spark, docs, **options).classes().drop("loc")


def representatives(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """One document of each class, with docs' columns."""
    run = NearDuplicates(spark, docs, **options)
    return run.spool.picked(run.classes().filter(~F.col("kept")), "left_anti").select("rec.*")


#: Classes by comparing all documents that share a shingle, in DuckDB's SQL.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [chr(1) || text] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
c AS MATERIALIZED (SELECT doc_id, s, count(*) AS n FROM s GROUP BY 1, 2),
t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN t a ON a.doc_id = x JOIN t b ON b.doc_id = y WHERE 5 * common >= 4 * (a.total + b.total - common)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM t UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE r.root < e.y),
k AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY 1)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM k
"""
