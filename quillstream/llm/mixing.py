"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source gets a target in words: its share of all words by weight, stopped at
``max_epochs`` times its own size, the excess reshared by weight until none is
above. A source is taken whole as often as its target allows; what is left of
the target, its quota of words, is met by a part of its documents. The mix is then
dealt over output shards that all sources share.

What is taken of a source:

* its documents are dealt by hash over blocks of about ``BLOCK_ROWS``, and the
  blocks over cells of about ``CELL_ROWS`` documents; the quota is split exactly over
  the cells by a tree of fan-out ``FAN_OUT``, each node drawing its children's shares
  from the multivariate hypergeometric law, as if the quota's words had been drawn
  without replacement;
* in a cell, documents stand in a random permutation around a circle of as many
  places as they have words, and the draw is a random arc of the quota's length: a
  document goes in where one place of it does, so that each has the probability
  quota / words whatever its length. Documents that fit into the difference are
  then added or dropped until the draw has the quota's words;
* a document longer than the quota is never dropped, and nothing shorter is taken
  beside it. The draws without such a document aim so much below the quota as those
  with one are above it, so that the quota is the mean.

Where it goes:

* every whole epoch of a source has all of its blocks, the part beyond as many as
  its share of the words makes; these are the source's block quota. The output
  shards hold ``SHARD_BLOCKS`` blocks each, of any source;
* a tree of fan-out ``FAN_OUT`` over the output shards holds at its root the block
  quotas of all sources; each node draws for each child, without replacement, as many
  blocks as the child's shards hold, by the multivariate hypergeometric law over
  sources, and hands each child the next blocks of each source's permutation. So every
  shard is full, every block is in one shard, and quotas add up exactly;
* rows are dealt by shard, and shuffled inside it.

Draws are hashes of seed, source, node and document, so reruns agree. No task needs
more than one cell's documents, or one node's children; a node has a number per source,
of the sources that still have blocks there. Everything is DataFrame expressions.

Defined results: a null text has size 0; a very long one is one document like
any other; null is a source of its own, ordered last; rows repeated as a whole are
taken together, into the same shards; sources without words have target 0 and are not
taken; ties in the permutation are broken by its hash alone, which repeated rows share;
empty tables give empty results; other columns travel in a struct, so that their names
cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import materialise

#: Documents of one cell, and of one block, on average; blocks of an output shard.
CELL_ROWS, BLOCK_ROWS, SHARD_BLOCKS = 2048, 16, 64
FAN_OUT = 16
#: Up to this spread a child's share is drawn by inversion; beyond, by rejection, exactly too.
EXACT_SIGMA = 500.0
#: Draws of the rejection before it gives up. About a quarter are rejected, so that chance comes to 1e-35.
TRIES = 64
#: What stands between words.
GAP = r"[\x20\x09-\x0D]+"


def _uniform(*key: Column) -> Column:
    """A number strictly between 0 and 1 from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 12).cast("double") + 0.5) / F.lit(2.0**52)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _lets(values: dict[str, Column], then: Callable[[Column], Column]) -> Column:
    """then(a struct of the values), with each evaluated once, and written once in the plan."""
    return _let(F.struct(*[v.alias(k) for k, v in values.items()]), then)


def _hypergeometric(total: Column, mine: Column, drawn: Column, *key: Column, bound: float = math.inf) -> Column:
    """How many of `drawn` items, out of `total`, fall on `mine` of them. total is at most `bound`."""

    def law(a: Column) -> Column:
        t, k, n = F.greatest(a["total"], F.lit(1)).cast("double"), a["mine"].cast("double"), a["drawn"].cast("double")
        least = F.greatest(F.lit(0).cast("long"), a["drawn"] - (a["total"] - a["mine"]))
        return _lets({"t": t, "k": k, "n": n, "mean": n * k / t, "least": least, "most": F.least(a["drawn"], a["mine"])}, spread)

    def spread(a: Column) -> Column:
        variance = a["mean"] * (a["t"] - a["k"]) / a["t"] * (a["t"] - a["n"]) / F.greatest(a["t"] - 1, F.lit(1.0))
        sigma = F.sqrt(F.greatest(F.lit(0.0), variance))
        fields = {c: a[c] for c in ("t", "k", "n", "mean", "least", "most")}
        return _lets(fields | {"sigma": sigma}, drawn_from)

    def drawn_from(a: Column) -> Column:
        exact = _by_inversion(a, *key)
        if bound**0.5 / 2 > EXACT_SIGMA:  # no spread exceeds half the root of the total
            exact = F.when(a["sigma"] <= EXACT_SIGMA, exact).otherwise(_by_rejection(a, *key))
        return F.when(a["least"] >= a["most"], a["most"]).otherwise(exact)

    return _lets({"total": total.cast("long"), "mine": mine.cast("long"), "drawn": drawn.cast("long")}, law).cast("long")


def _by_inversion(a: Column, *key: Column) -> Column:
    """A draw from the law of a: sums of the probabilities within 10 spreads of the mean."""
    zero = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
    around, width = F.floor(a["mean"]), F.ceil(a["sigma"] * 10) + 12

    def following(p: Column, x: Column) -> Column:
        x = x.cast("double")
        return p * ((a["k"] - x) * (a["n"] - x) / ((x + 1) * F.greatest(a["t"] - a["k"] - a["n"] + x + 1, F.lit(1.0))))

    def among(places: Column) -> Column:
        mass = F.aggregate(
            places, zero, lambda s, x: F.struct(following(s["p"], x).alias("p"), (s["sum"] + s["p"]).alias("sum")), lambda s: s["sum"]
        )
        start = F.struct(F.lit(1.0).alias("p"), (mass * _uniform(F.lit(1), *key)).alias("left"), F.element_at(places, 1).cast("long").alias("at"))
        return F.aggregate(
            places,
            start,
            lambda s, x: F.struct(
                following(s["p"], x).alias("p"), (s["left"] - s["p"]).alias("left"), F.when(s["left"] > 0, x).otherwise(s["at"]).alias("at")
            ),
            lambda s: s["at"],
        )

    return _let(F.sequence(F.greatest(a["least"], around - width), F.least(a["most"], around + width)), among)


def _log_weight(total: Column, mine: Column, drawn: Column, x: Column) -> Column:
    """Log of the hypergeometric probability of x less a constant, accurate where all four cells are large.

    log(c!) is c log c - c + log(2 pi c) / 2 and a series, and for what a cell c
    expects, e, c log(c / e) + e - c is a series in (c - e) / (c + e) (Loader's), so
    that no large numbers cancel.
    """

    def cell(c: Column, e: Column, off: Column) -> Column:
        def series(s: Column) -> Column:
            total = F.lit(0.0)
            for j in range(8, 0, -1):
                total = (total + 1.0 / (2 * j + 1)) * s["square"]
            c, v = s["c"], s["v"]
            return s["off"] * v + c * 2 * v * total + F.log(c) / 2 + F.lit(1 / 12) / c - F.lit(1 / 360) / (c * c * c)

        ratio = lambda s: _lets({"c": s["c"], "off": s["off"], "v": s["v"], "square": s["v"] * s["v"]}, series)
        return _lets({"c": c, "off": off, "v": off / (c + e)}, ratio)

    def four(a: Column) -> Column:
        t, k, n, x, mean = (a[c] for c in ("t", "k", "n", "x", "mean"))
        off = x - mean
        return -(cell(x, mean, off) + cell(k - x, k - mean, -off) + cell(n - x, n - mean, -off) + cell(t - k - n + x, t - k - n + mean, off))

    values = {"t": total.cast("double"), "k": mine.cast("double"), "n": drawn.cast("double"), "x": x.cast("double")}
    return _lets(values, lambda a: _lets({c: a[c] for c in values} | {"mean": a["n"] * a["k"] / a["t"]}, four))


def _by_rejection(a: Column, *key: Column) -> Column:
    """The same by ratio of uniforms (Stadlober's HRUA), for large spreads."""
    t, k, n = a["t"], a["k"], a["n"]

    def tried(h: Column) -> Column:
        def one(i: Column) -> Column:
            def accepted(x: Column) -> Column:
                # Beyond 16 spreads the probability is below 1e-50.
                near = (x >= a["least"]) & (x <= a["most"]) & (F.abs(x - h["centre"]) <= a["sigma"] * 16)
                return F.when(near, F.when(F.log(_uniform(F.lit(2), i, *key)) * 2 <= _log_weight(t, k, n, x) - h["top"], x))

            place = F.floor(h["centre"] + h["width"] * (_uniform(F.lit(3), i, *key) - 0.5) / _uniform(F.lit(2), i, *key)).cast("long")
            return _let(place, accepted)

        nothing = F.lit(None).cast("long")
        found = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), nothing, lambda s, i: F.when(s.isNotNull(), s).otherwise(one(i)))
        return F.coalesce(found, h["mode"])

    def hat(m: Column) -> Column:
        # The hat's width: 2 sqrt(2 / e) times the spread, and a constant for the skewness.
        width = F.sqrt(a["sigma"] * a["sigma"] + 0.5) * 1.7155277699214135 + 0.8989161620588988
        return _lets({"mode": m, "centre": a["mean"] + 0.5, "width": width, "top": _log_weight(t, k, n, m)}, tried)

    return _let(F.floor((k + 1) * ((n + 1) / (t + 2))).cast("long"), hat)


def sized(docs: DataFrame, seed: int, *more: str) -> DataFrame:
    """id, source, size and place in the permutation of every document."""
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), GAP), "")).cast("long")
    return docs.select("doc_id", "source", words.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("perm"), *more)


def targets(rows: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Per source: sid (1.. in code point order, null last), words, rows, target."""
    per = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    # One row per source from here on; the windows below see no documents.
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    per = per.withColumn("weight", (F.col("sid") - 1) % 3 + 1).withColumn("cap", F.col("words") * max_epochs)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    everything = Window.partitionBy()
    per = per.withColumn("all_words", F.sum("words").over(everything))
    per = per.withColumn("before", F.sum("cap").over(by_fill) - F.col("cap"))
    per = per.withColumn("rest", F.sum("weight").over(everything) - F.sum("weight").over(by_fill) + F.col("weight"))
    share = F.col("weight") * (F.col("all_words") - F.col("before")) / F.col("rest")
    fits = F.when(share <= F.col("cap"), F.struct(F.row_number().over(by_fill).alias("k"), "before", "rest"))
    per = per.withColumn("fits", fits).withColumn("at", F.min("fits").over(everything))
    level = F.col("weight") * (F.col("all_words") - F.col("at.before")) / F.col("at.rest")
    target = F.when(F.row_number().over(by_fill) >= F.col("at.k"), F.least(level, F.col("cap").cast("double"))).otherwise(F.col("cap").cast("double"))
    return per.select("source", "sid", "words", "rows", "weight", target.alias("target"))


def _split(quota: DataFrame, leaves: DataFrame, deepest: int, seed: int) -> DataFrame:
    """sid, cell, quota: each source's quota over its cells, by the tree."""
    if deepest == 0:
        return quota.select("sid", F.lit(0).cast("long").alias("cell"), "quota")
    levels = F.explode(F.sequence(F.lit(1), F.lit(deepest))).alias("level")
    node = F.floor(F.col("cell") / F.pow(F.lit(float(FAN_OUT)), F.lit(deepest) - F.col("level"))).cast("long")
    nodes = materialise(
        leaves.select("*", levels).groupBy("sid", "level", node.alias("node")).agg(F.sum("words").alias("words")), "mix-nodes"
    )
    at = quota.select("sid", F.lit(0).cast("long").alias("node"), "quota")
    for level in range(1, deepest + 1):
        children = (
            nodes.filter(F.col("level") == level)
            .groupBy("sid", F.floor(F.col("node") / FAN_OUT).alias("node"))
            .agg(F.sum("words").alias("total"), F.sort_array(F.collect_list(F.struct(F.col("node").alias("child"), "words"))).alias("children"))
        )
        empty = F.array().cast("array<struct<child:bigint,quota:bigint>>")

        def deal(a: Column, x: Column, level: int = level) -> Column:
            mine = _hypergeometric(a["total"], x["words"], a["quota"], F.lit(seed), F.lit(level), F.col("sid"), x["child"])
            # A struct of the draw first, so that it is made once.
            drawn = F.element_at(F.transform(F.array(mine), lambda m: F.struct(m.alias("m"))), 1)["m"]
            done = F.concat(a["out"], F.array(F.struct(x["child"].alias("child"), drawn.alias("quota"))))
            return F.struct((a["total"] - x["words"]).alias("total"), a["quota"].alias("quota"), done.alias("out"))

        def leave(a: Column) -> Column:
            """The quota less what the newest child took."""
            return F.struct(a["total"].alias("total"), (a["quota"] - F.element_at(a["out"], -1)["quota"]).alias("quota"), a["out"].alias("out"))

        joined = at.join(children, ["sid", "node"])
        start = F.struct(F.col("total").alias("total"), F.col("quota").alias("quota"), empty.alias("out"))
        dealt = F.aggregate("children", start, lambda a, x: F.element_at(F.transform(F.array(deal(a, x)), leave), 1), lambda a: a["out"])
        at = joined.select("sid", F.explode(dealt).alias("x")).select("sid", F.col("x.child").alias("node"), F.col("x.quota").alias("quota"))
    return at.withColumnRenamed("node", "cell")


def draws(rows: DataFrame, seed: int, max_epochs: int = 3) -> tuple[DataFrame, DataFrame]:
    """(sources, cells): per source its target, whole epochs, cells and blocks; per cell what it draws.

    A whole epoch of a source is `blocks` blocks, the part beyond `thin`. A cell's draw
    is a range of its permutation, round its end where `round` is set, with the
    documents of `more` and without those of `less`.
    """
    per = targets(rows, max_epochs)
    take = F.floor(F.col("target") + 0.5)
    per = per.withColumn("epochs", F.when(F.col("words") > 0, F.floor(take / F.col("words"))).otherwise(0).cast("long"))
    per = per.withColumn("quota", F.when(F.col("words") > 0, take - F.col("epochs") * F.col("words")).otherwise(0).cast("long"))
    per = per.withColumn("cells", F.ceil(F.col("rows") / CELL_ROWS)).withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS))
    thin = F.greatest(F.lit(1), F.round(F.col("blocks") * F.col("quota") / F.col("words"))).cast("long")
    per = per.withColumn("thin", F.when(F.col("quota") > 0, thin).otherwise(0).cast("long"))
    per = materialise(per, "mix-sources")
    placed = place(rows, per, seed)
    blocks = placed.groupBy("sid", "cell", "perm").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("sid", "cell").orderBy("perm").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    blocks = blocks.withColumn("before", before)
    block = F.struct("perm", "words", "before")
    cells = blocks.groupBy("sid", "cell").agg(F.sum("words").alias("words"), F.sort_array(F.collect_list(block)).alias("blocks"))
    cells = materialise(cells, "mix-cells")
    widest = per.agg(F.max("cells")).first()[0] or 1
    deepest = 0
    while FAN_OUT**deepest < widest:
        deepest += 1
    quota = _split(per.select("sid", "quota"), cells.select("sid", "cell", "words"), deepest, seed)
    drawn = cells.join(quota, ["sid", "cell"])
    # The arc's ends, and the part of a document before the place that decides on it.
    drawn = drawn.withColumn("from", _uniform(F.lit(seed), F.lit(4), "sid", "cell") * F.col("words"))
    drawn = drawn.withColumn("to", F.col("from") + F.col("quota")).withColumn("part", _uniform(F.lit(seed), F.lit(5), "sid", "cell"))
    drawn = drawn.withColumn("round", F.col("to") > F.col("words"))
    drawn = drawn.withColumn("to", F.when(F.col("round"), F.col("to") - F.col("words")).otherwise(F.col("to")))

    def at(b: Column) -> Column:
        return b["before"] + b["words"] * F.col("part")

    def perms(kept: Column) -> Column:
        return F.transform(kept, lambda b: b["perm"])

    drawn = drawn.withColumn("first", F.array_min(perms(F.filter("blocks", lambda b: at(b) >= F.col("from")))))
    drawn = drawn.withColumn("last", F.array_max(perms(F.filter("blocks", lambda b: at(b) < F.col("to")))))

    def longer(b: Column) -> Column:
        return b["words"] > F.col("quota")

    def words(kept: Column) -> Column:
        return F.aggregate(kept, F.lit(0).cast("long"), lambda a, b: a + b["words"])

    long = F.filter("blocks", longer)
    rest = (F.col("words") - words(long)) / F.greatest(F.col("words") - F.size(long) * F.col("quota"), F.lit(1))
    aim = F.when(F.exists("blocks", lambda b: longer(b) & _within(b["perm"])) | (F.size(long) == 0), F.col("quota"))
    drawn = drawn.withColumn("aim", F.when(F.col("quota") == 0, 0).otherwise(F.coalesce(aim, F.round(F.col("quota") * rest))).cast("long"))
    none = F.array().cast("array<bigint>")
    start = F.struct((F.col("aim") - words(F.filter("blocks", lambda b: _within(b["perm"])))).alias("left"), none.alias("more"), none.alias("less"))

    def mend(a: Column, b: Column) -> Column:
        inside, fits = _within(b["perm"]), ~longer(b) & (b["words"] > 0)
        add, drop = fits & ~inside & (b["words"] <= a["left"]), fits & inside & (b["words"] <= -a["left"])
        return F.struct(
            F.when(add, a["left"] - b["words"]).when(drop, a["left"] + b["words"]).otherwise(a["left"]).alias("left"),
            F.when(add, F.concat(a["more"], F.array(b["perm"]))).otherwise(a["more"]).alias("more"),
            F.when(drop, F.concat(a["less"], F.array(b["perm"]))).otherwise(a["less"]).alias("less"),
        )

    drawn = drawn.withColumn("drawn", F.aggregate("blocks", start, mend))
    left, more, less = F.col("drawn.left"), F.col("drawn.more"), F.col("drawn.less")

    def smallest(inside: bool) -> Column:
        changed = less if inside else more
        others = F.filter(
            "blocks", lambda b: (_within(b["perm"]) == inside) & ~longer(b) & (b["words"] > 0) & ~F.array_contains(changed, b["perm"])
        )
        return F.array_min(F.transform(others, lambda b: F.struct(b["words"], b["perm"].alias("perm"))))

    # One document more or fewer, the smallest, and others for what that is too much, if it brings the cell nearer to its aim.
    drawn = drawn.withColumn("least", F.when(left > 0, smallest(False)).when(left < 0, smallest(True)))
    one = F.array(F.col("least.perm"))
    again = F.struct(
        F.when(left > 0, left - F.col("least.words")).otherwise(left + F.col("least.words")).alias("left"),
        F.when(left > 0, F.concat(more, one)).otherwise(more).alias("more"),
        F.when(left < 0, F.concat(less, one)).otherwise(less).alias("less"),
    )
    drawn = drawn.withColumn("other", F.when(F.col("least").isNotNull(), F.aggregate("blocks", again, mend)))
    nearer = F.coalesce(F.abs(F.col("other.left")) < F.abs(left), F.lit(False))
    best = F.when(nearer, F.col("other")).otherwise(F.col("drawn"))
    return per, drawn.select("sid", "cell", "round", "first", "last", best["more"].alias("more"), best["less"].alias("less"))


def _within(perm: Column) -> Column:
    """Whether the place in the permutation is in the cell's range."""
    after, until = F.coalesce(perm >= F.col("first"), F.lit(False)), F.coalesce(perm <= F.col("last"), F.lit(False))
    return F.when(F.col("round"), after | until).otherwise(after & until)


def _block(blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), "perm"), blocks).cast("long")


def _cell_of(block: Column) -> Column:
    return F.floor(block * F.col("cells") / F.col("blocks")).cast("long")


def place(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """rows with their source's figures, their block and their cell."""
    keys = sources.select(F.col("source").alias("_source"), "sid", "words", "target", "epochs", "cells", "blocks", "thin")
    joined = rows.join(keys, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return joined.withColumn("block", _block(F.col("blocks"), seed)).withColumn("cell", _cell_of(F.col("block")))


def _dealt(sources: Column, need: Column, bound: int, *key: Column) -> Column:
    """(taken, left) of sources, an array of (n, lo, ...): need blocks drawn from them, and the others."""
    nothing = F.slice(sources, 1, 0)
    population = F.aggregate(sources, F.lit(0).cast("long"), lambda a, s: a + s["n"])

    def one(a: Column, s: Column) -> Column:
        def drawn(n: Column) -> Column:
            taken, left = s.withField("n", n), s.withField("n", s["n"] - n).withField("lo", s["lo"] + n)
            some = lambda many, x: F.when(many > 0, F.array(x)).otherwise(nothing)
            return F.struct(
                (a["population"] - s["n"]).alias("population"),
                (a["need"] - n).alias("need"),
                F.concat(a["taken"], some(n, taken)).alias("taken"),
                F.concat(a["left"], some(s["n"] - n, left)).alias("left"),
            )

        return _let(_hypergeometric(a["population"], s["n"], a["need"], *key, s["sid"], bound=bound), drawn)

    start = F.struct(population.alias("population"), need.cast("long").alias("need"), nothing.alias("taken"), nothing.alias("left"))
    return F.aggregate(sources, start, one, lambda a: F.struct(a["taken"].alias("taken"), a["left"].alias("left")))


def output_shards(sources: DataFrame, seed: int) -> DataFrame:
    """shard, sid, lo, n, ...: the blocks lo, lo + 1, ... lo + n - 1 of a source that an output shard takes, by the tree."""
    quota = (F.col("epochs") * F.col("blocks") + F.col("thin")).cast("long")
    taken = sources.withColumn("n", quota).filter("n > 0")
    total = taken.agg(F.sum("n")).first()[0] or 0
    many = max(1, -(-total // SHARD_BLOCKS))
    span = 1
    while span < many:
        span *= FAN_OUT
    own = F.struct("sid", "n", F.lit(0).cast("long").alias("lo"), "epochs", "blocks", "thin", "cells")
    # One number per source, as in targets().
    nodes = taken.agg(F.sort_array(F.collect_list(own)).alias("sources")).select(F.lit(0).cast("long").alias("first"), "sources")
    while span > 1:
        inner = span // FAN_OUT
        last = F.least(F.col("first") + span, F.lit(many))
        ends = lambda c: F.least(c + inner, F.lit(many).cast("long"))  # noqa: B023, E731
        before = lambda c: F.floor(c / F.lit(float(many)) * F.lit(total)).cast("long")
        children = F.sequence(F.col("first"), last - 1, F.lit(inner).cast("long"))

        def hand_out(a: Column, c: Column) -> Column:
            need = before(ends(c)) - before(c)  # noqa: B023
            return _let(
                _dealt(a["left"], need, total, F.lit(seed + 3), F.lit(inner), c),  # noqa: B023
                lambda d: F.struct(
                    d["left"].alias("left"), F.concat(a["out"], F.array(F.struct(c.alias("first"), d["taken"].alias("sources")))).alias("out")
                ),
            )

        none = F.slice(F.array(F.struct("first", "sources")), 1, 0)
        dealt = F.aggregate(children, F.struct(F.col("sources").alias("left"), none.alias("out")), hand_out, lambda a: a["out"])
        nodes = nodes.select(F.explode(dealt).alias("x")).select("x.first", "x.sources")
        span = inner
        if span > 1:
            nodes = nodes.repartition(max(1, min(4096, many // (16 * span))), "first")
    return nodes.select(F.col("first").alias("shard"), F.explode("sources").alias("x")).select("shard", "x.*")


def _shards_of_cells(sources: DataFrame, seed: int) -> DataFrame:
    """sid, cell, out: per block of the cell, the output shard of its copy in every epoch, and in the part beyond."""
    at = output_shards(sources, seed).withColumn("d", F.explode(F.sequence(F.col("lo"), F.col("lo") + F.col("n") - 1)))
    whole = F.col("epochs") * F.col("blocks")
    copy = F.when(F.col("d") < whole, F.floor(F.col("d") / F.col("blocks"))).otherwise(F.col("epochs")).cast("long")
    # A block of the part beyond has the documents taken from several of an epoch's.
    first = lambda k: F.ceil(k * F.col("blocks") / F.col("thin")).cast("long")
    part = F.col("d") - whole
    blocks = F.when(F.col("d") < whole, F.array(F.pmod(F.col("d"), F.col("blocks")))).otherwise(F.sequence(first(part), first(part + 1) - 1))
    at = at.select("sid", "cells", "blocks", copy.alias("copy"), "shard", F.explode(blocks).alias("block"))
    entry = F.struct("block", "copy", "shard")
    return at.groupBy("sid", _cell_of(F.col("block")).alias("cell")).agg(F.sort_array(F.collect_list(entry)).alias("out"))


def _taken(rows: DataFrame, sources: DataFrame, cells: DataFrame, seed: int) -> DataFrame:
    """rows, placed, with out_shards: the output shard of every copy that the mix takes."""
    joined = place(rows, sources, seed).join(cells, ["sid", "cell"], "left")
    perm = F.col("perm")
    extra = F.coalesce(_within(perm) & ~F.array_contains("less", perm) | F.array_contains("more", perm), F.lit(False))
    # Every block has an entry per epoch, and one for the part beyond if there is one, in that order.
    each = F.col("epochs") + (F.col("thin") > 0).cast("long")
    first = (F.col("block") - F.get("out", F.lit(0))["block"]) * each + 1
    mine = F.slice("out", first.cast("int"), (F.col("epochs") + extra.cast("long")).cast("int"))
    return joined.withColumn("out_shards", F.coalesce(F.transform(mine, lambda x: x["shard"]), F.array().cast("array<bigint>")))


def _plan(docs: DataFrame, seed: int, max_epochs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents' sizes, sources, cells with their draws and output shards): all that the mix needs to know."""
    rows = materialise(sized(docs, seed), "mix-sized")
    sources, drawn = draws(rows, seed, max_epochs)
    cells = drawn.join(_shards_of_cells(sources, seed), ["sid", "cell"])
    return rows, sources, materialise(cells, "mix-drawn")


def assignments(spark: SparkSession, docs: DataFrame, seed: int = 20, max_epochs: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, out_shards: one row per document."""
    rows, sources, cells = _plan(docs, seed, max_epochs)
    return _taken(rows, sources, cells, seed).select(
        "doc_id",
        "size",
        F.col("words").alias("source_size"),
        "target",
        (F.col("size") * F.size("out_shards")).alias("taken"),
        "out_shards",
    )


def mixed_documents(spark: SparkSession, docs: DataFrame, seed: int = 20, max_epochs: int = 3) -> DataFrame:
    """The mix itself: each document as often as it is taken, output shard by output shard, shuffled in each, with docs' columns."""
    _, sources, cells = _plan(docs, seed, max_epochs)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"), "doc_id", "source", "text")
    rows = _taken(sized(whole, seed, "rec"), sources, cells, seed)
    copies = rows.select("rec", "perm", F.posexplode("out_shards").alias("copy", "shard"))
    return copies.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed + 2), "perm", "copy")).select("rec.*")
