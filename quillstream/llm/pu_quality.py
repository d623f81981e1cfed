"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; the unlabelled set is web
text as it comes. The class prior is estimated from these two: a first network is
trained to tell positives from unlabelled documents, on half of both, and on the other
half the share of unlabelled documents above a score is divided by that of positives.
The least such ratio, with an allowance for chance, is the prior, as only positives
score that high (best bin estimation, Garg et al., 2021). The classifier, a network
with one hidden layer over text statistics, then minimises the non-negative unbiased
risk with logistic loss:

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

Where the second part falls below zero, the step goes against it (Kiryo et al.,
2017). Negative labels are not used. Only documents with crc32(doc_id as text) mod 5 other than 0 are learnt
from. Means and scales of the statistics are those of all of these. The risk takes
about TRAIN_ROWS positives and TRAIN_ROWS unlabelled documents, chosen by hash, and
twice that at most. All documents are then scored
in one pass over their whole texts, without a shuffle. Labels, lang, source and
doc_id are no inputs.

Defined results: a null text counts as empty, and empty texts get a score too; a very
long text is scored whole; repeated rows are scored each; a null id is never held out;
of repeated labels one counts; with no positives to learn from, every score is 0.5;
an empty table gives no rows. Only doc_id and text are read, and accepted documents
travel in a struct, so that other columns cannot clash.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import text_batches
from .runtime import ship_package

#: Positives, and unlabelled documents, that training reads.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
HIDDEN = 24
EPOCHS = 60
#: Passes of the networks that the prior is estimated with, and the chance of its bound to be too low.
PRIOR_EPOCHS, PRIOR_CHANCE = 30, 0.1
#: Characters that a worker looks at together.
SLICE = 1_000_000
BATCH = 512
#: Statistics are summed in parts of 1 / UNIT.
UNIT = 2**16

# Fixed value: groups of bytes whose shares are features.
BYTE_GROUPS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\r",
    "newline": b"\n",
    "stop": b".,;:'\"()-",
    "shout": b"!?",
    "bar": b"|/\\<>_=~^`{}[]",
    "symbol": b"*%&$#@+",
    "beyond": bytes(range(128, 256)),
}
_GROUP_OF = np.full(256, len(BYTE_GROUPS), np.uint8)
for _k, _v in enumerate(BYTE_GROUPS.values()):
    _GROUP_OF[list(_v)] = _k
N_FEATURES = len(BYTE_GROUPS) + 9


def _statistics(text: str) -> tuple[float, ...]:
    words, lines = text.split(), text.split("\n")
    n, m = max(1, len(words)), max(1, len(lines))
    same = sum(map(operator.eq, words, words[1:]))
    alone = sum(map((1).__eq__, map(len, words)))
    return (
        np.log1p(len(words)),
        same / n,
        len(set(words)) / n**0.75,
        1 - len(set(lines)) / m,
        alone / n,
        min(60.0, len(text) / n),
        min(400.0, n / m),
        max(map(len, words), default=0) ** 0.5,
        sum(map(str.isupper, words)) / n,
    )


def features(texts: list[str | None]) -> np.ndarray:
    """A row of statistics for each text."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) for r in raw])
    n = len(BYTE_GROUPS) + 1
    counts = np.array([np.bincount(_GROUP_OF[np.frombuffer(r, np.uint8)], minlength=n) for r in raw]).reshape(len(raw), n)[:, :-1]
    shares = counts / np.maximum(1, sizes)[:, None]
    words = np.array([_statistics(t or "") for t in texts], dtype=np.float64).reshape(len(texts), 9)
    return np.hstack([np.log1p(200 * shares), words]).astype(np.float32)


def _train_fold(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 != 0, F.lit(True))


class Model:
    def __init__(self, x: np.ndarray, seed: int = 3, spread: tuple[np.ndarray, np.ndarray] | None = None):
        rng = np.random.default_rng(seed)
        mean, deviation = spread or (x.mean(axis=0), x.std(axis=0))
        self.mean, self.scale = mean, deviation + 1e-3
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(z @ self.w[0] + self.w[1])
        return hidden, hidden @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(self.prepared(x.astype(np.float64)))[1])


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> float:
    """The non-negative unbiased risk of scores of positives and unlabelled documents."""
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    return prior * np.logaddexp(0, -gp).mean() + max(0.0, negative)


def step_of(gp: np.ndarray, gu: np.ndarray, prior: float) -> np.ndarray:
    """What training descends along: the risk's slope; where its second part is negative, against that part's."""
    if np.logaddexp(0, gu).mean() >= prior * np.logaddexp(0, gp).mean():
        return np.r_[prior * (-_sigmoid(-gp) - _sigmoid(gp)) / len(gp), _sigmoid(gu) / len(gu)]
    return np.r_[prior * _sigmoid(gp) / len(gp), -_sigmoid(gu) / len(gu)]


def telling_apart(gp: np.ndarray, gu: np.ndarray, prior: float) -> np.ndarray:
    """The slope of the logistic loss that takes all unlabelled documents for negatives."""
    return np.r_[-_sigmoid(-gp) / len(gp), _sigmoid(gu) / len(gu)]


def fit(
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    seed: int = 3,
    epochs: int = EPOCHS,
    spread: tuple[np.ndarray, np.ndarray] | None = None,
    slope: Callable[[np.ndarray, np.ndarray, float], np.ndarray] = step_of,
) -> Model:
    """Minimise the non-negative risk with Adam. Features are scaled by spread (means, deviations), else by their own."""
    rng = np.random.default_rng(seed)
    model = Model(np.vstack([positive, unlabelled]).astype(np.float64), seed, spread)
    p, u = model.prepared(positive.astype(np.float64)), model.prepared(unlabelled.astype(np.float64))
    first = [np.zeros_like(w) for w in model.w]
    second = [np.zeros_like(w) for w in model.w]
    step, steps = 0, max(1, len(u) // BATCH)
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        pu, uu = rng.permutation(len(p)), rng.permutation(len(u))
        for part in range(steps):
            xp, xu = p[np.take(pu, range(part * BATCH, (part + 1) * BATCH), mode="wrap")], u[uu[part::steps]]
            x = np.vstack([xp, xu])
            hidden, g = model.forward(x)
            d = slope(g[: len(xp)], g[len(xp) :], prior)
            dh = d[:, None] * model.w[2] * (1 - hidden**2)
            grads = [x.T @ dh + 1e-4 * model.w[0], dh.sum(axis=0), hidden.T @ d + 1e-4 * model.w[2], np.array([d.sum()])]
            step += 1
            for w, dw, a, b in zip(model.w, grads, first, second, strict=True):
                a += 0.1 * (dw - a)
                b += 0.001 * (dw * dw - b)
                w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return model


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior from held-back scores: the ratio of shares above a score, where its upper bound is least."""
    p, u = np.sort(positive), np.sort(unlabelled)
    above_p = 1 - np.arange(len(p)) / len(p)
    above_u = 1 - np.searchsorted(u, p, "left") / len(u)
    chance = np.sqrt(np.log(4 / PRIOR_CHANCE) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = np.argmin((above_u + chance) / above_p)
    return float(above_u[best] / above_p[best])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5, spread: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """Share of positives among the unlabelled: the mean of two estimates, each from the half the other learnt from."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    rng = np.random.default_rng(seed)
    p, u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
    found = []
    for k in (0, 1):
        model = fit(positive[p[k::2]], unlabelled[u[k::2]], 0.5, seed, PRIOR_EPOCHS, spread, telling_apart)
        found.append(best_bin(model.score(positive[p[1 - k :: 2]]), model.score(unlabelled[u[1 - k :: 2]])))
    return min(0.99, max(0.01, float(np.mean(found))))


def _run_features(spark: SparkSession, rows: DataFrame, most: int) -> np.ndarray:
    """Statistics of rows (id, text), `most` of them at most, in order of a hash of the id.

    Where there are more, a hash of id and text chooses, so that every run chooses the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_batches(batch, "text", SLICE):
                f = features(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * N_FEATURES, pa.int32()), pa.array(f.ravel(), pa.float32()))
                hashes = [batch.column(c).slice(first, len(texts)) for c in ("h", "r")]
                yield pa.RecordBatch.from_arrays([*hashes, lists], ["h", "r", "f"])

    text = F.coalesce("text", F.lit(""))
    hashed = rows.select(F.xxhash64(F.lit(7), "id").alias("h"), F.xxhash64(F.lit(8), "id", text).alias("r"), text.alias("text"))
    different = hashed.select("h", "r").distinct().count()
    if different > most:
        # A quarter more than needed, as the share is met only about.
        hashed = hashed.filter(F.shiftrightunsigned("r", 11).cast("double") / 2.0**53 < 1.25 * most / different + 1000 / different)
    # Copies are counted, so that the driver sees each document once.
    found = hashed.mapInArrow(run, "h bigint, r bigint, f array<float>").groupBy("r", "h").agg(F.min("f").alias("f"), F.count(F.lit(1)).alias("n"))
    got, left = [], most
    for r in sorted(found.collect(), key=lambda r: (r["r"] % 2**64, r["h"])):
        got += [(r["h"], r["f"])] * min(r["n"], left)
        left = most - len(got)
    return np.array([f for _, f in sorted(got)], dtype=np.float32).reshape(-1, N_FEATURES)


def _spread(docs: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """Number of docs (text), and means and deviations of the statistics of all of them.

    Sums are of whole numbers, so that they don't depend on the order of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, [0] * N_FEATURES, [0] * N_FEATURES
        for batch in batches:
            for _, texts in text_batches(batch, "text", SLICE):
                for part in range(0, len(texts), 4096):
                    f = np.rint(features(texts[part : part + 4096]).astype(np.float64) * UNIT).astype(np.int64)
                    n += len(f)
                    sums = [a + int(b) for a, b in zip(sums, f.sum(axis=0), strict=True)]
                    squares = [a + int(b) for a, b in zip(squares, (f * f).sum(axis=0), strict=True)]
        whole = pa.decimal128(28, 0)
        columns = [pa.array(map(Decimal, x), whole) for x in ([n] * N_FEATURES, sums, squares)]
        yield pa.RecordBatch.from_arrays([pa.array(range(N_FEATURES), pa.int32()), *columns], ["feature", "n", "sums", "squares"])

    parts = docs.select("text").mapInArrow(run, "feature int, n decimal(28,0), sums decimal(28,0), squares decimal(28,0)")
    rows = sorted(parts.groupBy("feature").agg(F.sum("n"), F.sum("sums"), F.sum("squares")).collect())
    totals = [[int(x) for x in r[1:]] for r in rows] or [[0, 0, 0]] * N_FEATURES
    mean = [s / max(1, n) / UNIT for n, s, _ in totals]
    deviation = [((n * q - s * s) / max(1, n * n)) ** 0.5 / UNIT for n, s, q in totals]
    return totals[0][0], (np.array(mean), np.array(deviation))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[Model | None, float]:
    """(model, prior) from docs (doc_id, text) and labels (doc_id, quality) of the training folds."""
    ship_package(spark)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & _train_fold(F.col("doc_id")))
    known = known.filter("quality = 1")
    if known.isEmpty():
        return None, 0.5
    hashed = F.xxhash64(F.lit(7), "id")
    trusted = known.select(F.col("doc_id").alias("id")).distinct().orderBy(hashed, "id").limit(train_rows)
    fold = docs.select(F.col("doc_id").alias("id"), "text").filter(_train_fold(F.col("id")))
    # At most train_rows ids, so their size is bounded.
    positive = _run_features(spark, fold.join(F.broadcast(trusted), "id"), 2 * train_rows)
    rows, spread = _spread(fold)
    share = min(1.0, train_rows / max(1, rows))
    chosen = fold.filter((F.shiftrightunsigned(hashed, 11).cast("double") / 2.0**53) < share)
    unlabelled = _run_features(spark, chosen, 2 * train_rows)
    if not len(positive) or not len(unlabelled):
        return None, 0.5
    prior = estimate_prior(positive, unlabelled, spread=spread)
    return fit(positive, unlabelled, prior, spread=spread), prior


def _score(texts: list[str | None], model: Model | None, prior: float) -> np.ndarray:
    return np.full(len(texts), prior) if model is None else model.score(features(texts))


def scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    model, prior = learn(spark, docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in text_batches(b, "text", SLICE):
                score = _score(texts, model, prior)
                ids = b.column("doc_id").slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, predicted int")
    return rows.withColumn("held_out", ~_train_fold(F.col("doc_id")))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with docs' columns."""
    model, prior = learn(spark, docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.RecordBatch.from_arrays([b.column("rec").field("text")], ["text"])
            for first, texts in text_batches(own, "text", SLICE):
                keep = pa.array(_score(texts, model, prior) >= THRESHOLD)
                yield b.slice(first, len(texts)).filter(keep)

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"))
    return whole.mapInArrow(run, whole.schema).select("rec.*")
