"""Mixing sources to target weights: temperature mixing.

A source's share of all tokens is raised to an exponent and normalised. The exponent is bisected:
the largest in [0, 1] at which the weights' entropy reaches a target, or the smallest at which no
source is repeated more often than a limit; the limit wins where both are given and conflict.
The weights are realised as block permutations: each source's rows are drawn in permutations (by a
hash), one after the other, until the source's budget of tokens is met, and each drawn row falls
into the block of the output that its place in the budget belongs to; within a block the order is
again by hash, so every block has the target weights.

By default the budget is as many tokens as make the source that is drawn least appear once, so
that no row is lost. Running sums are taken over hash ranges of a source's rows: totals of ranges
first, then within a range, so that a source of any size is spread over many tasks. A row is told apart by
its place in the stored files, which is part of the hash, so repeated rows and rows without id are
spread like all others; a stored table always gives the same draws, written anew it may give others.

The sources' totals come to the driver, where weights are bisected, and their plan goes to all executors:
at most ``MOST_SOURCES`` of them; more raise an error before anything is collected.

Defined results: a null source is a source of its own; a null or empty text has no token: it is drawn
once in each permutation that is begun before the budget is met, and a source of such rows alone is dealt
to blocks by hash; repeated rows are drawn each for itself; ties of the hash go to the lower id; an empty
table gives an empty result; other columns are ignored. Weights are rounded to twelve digits before use.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import ROW, cut, partitions, with_rows

#: The share of the largest possible entropy to reach, the most often that a row may be drawn,
#: tokens of a block, rows of a hash range, sources.
ENTROPY, REPEATS, BLOCK, RANGE, MOST_SOURCES = 0.97, 2.0, 1 << 20, 4096, 100_000


def weights(tokens: dict, entropy: float | None = ENTROPY, repeats: float | None = REPEATS) -> tuple[float, dict]:
    """The exponent, and each source's weight, from its tokens."""
    total = sum(tokens.values())
    if not total:
        return 1.0, {s: 1.0 / len(tokens) for s in tokens}

    def at(a: float) -> dict:
        w = {s: (n / total) ** a if n else 0.0 for s, n in tokens.items()}
        z = math.fsum(w.values())
        return {s: x / z for s, x in w.items()}

    def spread(a: float) -> float:
        return -math.fsum(x * math.log(x) for x in at(a).values() if x)

    def most(a: float) -> float:
        """How often the most repeated source is drawn when the least repeated is drawn once."""
        rates = [w * total / tokens[s] for s, w in at(a).items() if w]
        return max(rates) / min(rates)

    def bisect(holds, inside: float, outside: float) -> float:
        """The end, towards ``outside``, of the range from ``inside`` on in which ``holds`` is true."""
        if holds(outside):
            return outside
        for _ in range(60):
            mid = (inside + outside) / 2
            inside, outside = (mid, outside) if holds(mid) else (inside, mid)
        return inside

    positive = sum(1 for n in tokens.values() if n)
    exponent = 1.0 if repeats is None else 0.0
    if entropy is not None and positive > 1:
        goal = entropy * math.log(positive)
        exponent = bisect(lambda a: spread(a) >= goal, 0.0, 1.0)
    if repeats is not None:
        exponent = max(exponent, bisect(lambda a: most(a) <= repeats, 1.0, 0.0))
    return exponent, {s: round(w, 12) for s, w in at(exponent).items()}


def token_count(text: Column) -> Column:
    """Runs of other characters than white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*+(\S)\S*+|\s++", "$1")).cast("long")


def _placed(keyed: DataFrame, entropy: float | None, repeats: float | None, budget: int | None, block: int, seed: str) -> tuple[DataFrame, int]:
    """(row key, doc_id, source, tokens, epoch, block, h) of each drawn row, and the number of blocks."""
    rows = cut(keyed.select(*ROW, "doc_id", "source", token_count(F.col("text")).alias("tokens")), "tokens")
    found = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    stats = {r.source: (r.tokens, r.n) for r in found}
    _, w = weights({s: t for s, (t, _) in stats.items()}, entropy, repeats)
    total = budget if budget is not None else math.ceil(max([t / w[s] for s, (t, _) in stats.items() if w[s]], default=0))
    goal = {s: (round(w[s] * total) if budget is not None else max(t, round(w[s] * total))) for s, (t, _) in stats.items()}
    blocks = max(1, -(-total // block))
    plan = [(s, t, goal[s], max(1, -(-n // RANGE)), (max(1, -(-goal[s] // t)) if t else 1)) for s, (t, n) in stats.items()]
    plan = rows.sparkSession.createDataFrame(plan, "source string, own long, goal long, ranges long, epochs long")
    drawn = rows.join(F.broadcast(plan), rows.source.eqNullSafe(plan.source)).drop(plan.source).select("*", F.explode(F.sequence(F.lit(0), (F.col("epochs") - 1).cast("int"))).alias("epoch"))
    drawn = drawn.withColumn("h", F.xxhash64(F.lit(seed), "epoch", F.coalesce("doc_id", F.lit(-1)), *ROW)).withColumn("range", F.pmod(F.shiftrightunsigned("h", 20), "ranges"))
    sums = drawn.groupBy("source", "epoch", "range").agg(F.sum("tokens").alias("n"))
    group = F.floor(F.col("range") / 1024)
    coarse = sums.groupBy("source", "epoch", group.alias("group")).agg(F.sum("n").alias("n"))
    over = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("base", F.coalesce(F.sum("n").over(over("source", "epoch").orderBy("group")), F.lit(0))).drop("n")
    fine = sums.withColumn("group", group).withColumn("within", F.coalesce(F.sum("n").over(over("source", "epoch", "group").orderBy("range")), F.lit(0)))
    base = fine.alias("f").join(coarse.alias("c"), F.col("f.source").eqNullSafe(F.col("c.source")) & (F.col("f.epoch") == F.col("c.epoch")) & (F.col("f.group") == F.col("c.group"))).select(F.col("f.source").alias("s"), F.col("f.epoch").alias("e"), F.col("f.range").alias("r"), (F.col("within") + F.col("base")).alias("start"))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    own = drawn.withColumn("before", F.coalesce(F.sum("tokens").over(over("source", "epoch", "range").orderBy("h", "doc_id", *ROW)), F.lit(0))).withColumn("k", key)
    base = base.withColumn("k2", F.coalesce(F.concat(F.lit("="), "s"), F.lit("-")))
    placed = own.join(base, (F.col("k") == F.col("k2")) & (F.col("epoch") == F.col("e")) & (F.col("range") == F.col("r"))).withColumn("at", F.col("epoch") * F.col("own") + F.col("start") + F.col("before"))
    kept = placed.where((F.col("at") < F.col("goal")) | (F.col("epoch") == 0) & (F.col("own") <= F.col("goal")))
    by_budget = F.least(F.floor(F.col("at") * blocks / F.greatest(F.col("goal"), F.lit(1))), F.lit(blocks - 1))
    to_block = F.when(F.col("own") == 0, F.pmod("h", F.lit(blocks))).otherwise(by_budget).cast("long")
    return kept.select(*ROW, "doc_id", "source", "tokens", "epoch", to_block.alias("block"), F.xxhash64("h", "epoch").alias("h")), blocks


_WITHIN = ("h", "doc_id", "epoch", *ROW)


def mixture(docs: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: int | None = None, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """(doc_id, source, tokens, epoch, block, place) of each drawn row: the permutation of its
    source that it was drawn in, its block of the output and its place in that block.

    Only ids, sources and token counts are shuffled.
    """
    _, keyed = with_rows(docs, "doc_id", "source", "text")
    placed, _ = _placed(keyed, entropy, repeats, budget, block, seed)
    order = Window.partitionBy("block").orderBy(*_WITHIN)
    return placed.withColumn("place", F.row_number().over(order).cast("long") - 1).select("doc_id", "source", "tokens", "epoch", "block", "place")


def drawn(docs: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: int | None = None, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """``docs``, all columns, a row for each row of the mixture, in its order: partitions hold blocks one
    after the other, and rows lie in each by their places."""
    stored, keyed = with_rows(docs, "doc_id", "source", "text")
    placed, blocks = _placed(keyed, entropy, repeats, budget, block, seed)
    draws = placed.select(*ROW, F.col("epoch").alias("__epoch"), F.col("block").alias("__block"), F.col("h").alias("__h"))
    n = partitions(docs.sparkSession)
    rows = with_rows(stored)[1].join(draws.hint("shuffle_merge"), list(ROW))  # one plan at every size
    dealt = rows.repartitionById(n, F.floor(F.col("__block") * n / blocks).cast("int"))
    return dealt.sortWithinPartitions("__block", *["__" + c if c in ("h", "epoch") else c for c in _WITHIN]).select(*docs.columns)
