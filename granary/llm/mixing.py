"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length in each source. A source's target is met by whole rounds
over all its documents and a part of a further one: lengths give documents in proportion
(systematic rounding with a seeded start), and a bounded-knapsack dynamic program over the
lengths that are left fits the rest of the budget, exactly where lengths allow. Which documents
of a length are taken is a seeded order, ranked over salts.

Defined cases: null texts have size 0; a null source is a source of its own, last in order;
sources of size 0 have target 0; documents without words cost nothing and are taken once;
repeated rows are documents in their own right; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WORD_REGEX
from granary.plans.cluster import cut, rank_in_group

#: Fixed values of the mix: weights by order of source, share of all words, rounds at most.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: The dynamic program's budget in words: what is above is given to the longest documents that fit.
DP_WORDS = 1 << 16
#: Words that the program has to fit at least, where a source has them.
ROOM_WORDS = 1 << 14
#: A table of at most this many sources is broadcast.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """``share`` of all sizes dealt by weight; what is above ``most`` times a size is dealt anew."""
    out = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), share * sum(sizes)
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def choose(lengths: list[int], counts: list[int], budget: int, seed: int) -> list[int]:
    """How many documents of each length to take so that their words come nearest to ``budget``."""
    total = sum(a * b for a, b in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    if budget <= 0:
        return [0] * len(counts)
    start, share = random.Random(seed).random(), budget / total
    taken, seen = [], 0
    for n in counts:
        taken.append(min(n, math.floor((seen + n) * share + start) - math.floor(seen * share + start)))
        seen += n
    left = budget - sum(a * b for a, b in zip(lengths, taken))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:  # over budget: give back the longest that don't overshoot, then the shortest that do
        if left < 0:
            back = min(taken[i], -left // lengths[i])
            taken[i] -= back
            left += back * lengths[i]
    if left < 0:
        i = next(i for i in reversed(order) if taken[i] and lengths[i] >= -left)
        taken[i] -= 1
        left += lengths[i]
    for i in order:  # far below budget: the longest that fit
        if left > DP_WORDS:
            more = min(counts[i] - taken[i], (left - DP_WORDS) // lengths[i] + (lengths[i] <= DP_WORDS))
            more = min(more, left // lengths[i])
            taken[i] += more
            left -= more * lengths[i]
    # room for the program: some documents, one of each length in turn, are given back to it
    turn = list(order)
    random.Random(seed + 1).shuffle(turn)
    while left < ROOM_WORDS and any(taken[i] for i in turn):
        for i in turn:
            if left < ROOM_WORDS and taken[i]:
                taken[i] -= 1
                left += lengths[i]
    # bounded knapsack: bit b of `reach` is set if b words can be had; counts are split into powers of two
    reach, steps, wanted = 1, [], (1 << (2 * left + 1)) - 1
    for i in reversed(order):
        free, power = min(counts[i] - taken[i], 2 * left // lengths[i]), 1
        while free > 0 and not reach >> left & 1:
            n = min(power, free)
            steps.append((i, n, reach))
            reach = (reach | reach << n * lengths[i]) & wanted
            free, power = free - n, power * 2
    at = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    over = reach >> left
    if over and (above := left + (over & -over).bit_length() - 1) - left < left - at:
        at = above
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += n
            at -= n * lengths[i]
    return taken


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS, seed: int = 11) -> DataFrame:
    """``docs`` (doc_id, source, size long, ...) -> its columns, source_size, target, rounds (copies taken).

    The driver sees one row per source; histograms are fitted source by source on the executors.
    """
    spark = docs.sparkSession
    totals = docs.groupBy("source").agg(F.sum("size").alias("size"))
    found = sorted(((r["source"], int(r["size"])) for r in totals.collect()), key=lambda r: (r[0] is None, r[0] or ""))
    goals = targets([s for _, s in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
    plan = spark.createDataFrame([(name, size, goal) for (name, size), goal in zip(found, goals)], "source string, source_size long, target double")
    beside = F.broadcast if len(found) <= BROADCAST_SOURCES else (lambda df: df)
    if not found:
        return docs.withColumns({"source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "rounds": F.lit(0)})
    histogram = docs.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    named = histogram.join(beside(plan), histogram["source"].eqNullSafe(plan["source"])).select(histogram["source"], "size", "n", "source_size", "target")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        whole, goal = int(pdf["source_size"][0]), float(pdf["target"][0])
        rounds = min(int(goal // whole), int(most)) if whole else 0
        extra = choose(pdf["size"].tolist(), pdf["n"].tolist(), round(goal - rounds * whole), seed)
        return pdf.assign(rounds=rounds, extra=extra)[["source", "size", "rounds", "extra"]]

    chosen = named.groupBy("source").applyInPandas(fit, "source string, size long, rounds long, extra long")
    ranked = rank_in_group(docs, ["source", "size"], ["doc_id"], "_rank", seed)
    with_plan = ranked.join(beside(plan), ranked["source"].eqNullSafe(plan["source"])).select(ranked["*"], "source_size", "target")
    chosen = chosen.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "rounds", "extra")
    both = with_plan.join(chosen, with_plan["source"].eqNullSafe(F.col("_source")) & (with_plan["size"] == F.col("_size")), "left")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.coalesce(F.col("rounds") + F.when(F.col("_rank") < F.col("extra"), 1).otherwise(0), F.lit(0)))
    return both.select(*[both[c] for c in docs.columns], "source_size", "target", copies.cast("int").alias("rounds"))


def sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns with ``size``; narrow ones are cut, so texts are read once."""
    return cut(docs.select(*columns, word_count(F.col("text")).alias("size")))
