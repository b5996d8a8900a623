"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share
the whole word count; a target stops at ``max_epochs`` times its source's size
and the excess goes to the others by weight, which has one fixed point: the
level ``x`` at which the sum of ``min(cap, weight * x)`` is the total.

A source takes every document ``target // size`` times. What is left of its
budget is fitted on the counts of documents by exact length: each length gives
its proportional share of documents, longer lengths fill what rounding left, and
a bounded-knapsack dynamic programme over the unused documents, at every size,
brings the rest as near to zero as any choice of them can (``CELLS`` states to what
width sums are told apart in a budget of over a million units of the lengths' common divisor). The chosen number of documents of a length are
those of least seeded hash. Only counts by length meet in a task, never rows.

Edge cases: null and empty texts have size 0 and take nothing; a source of size
0 has target 0; equal rows are one length with more documents; null ``doc_id``
rows are hashed alike and drawn by their text's hash; an empty table gives an
empty result. Extra columns pass untouched through ``mixed_documents``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE_WORD, packed, staged

#: Documents of one (source, length) that are ranked in one sort.
RANKED = 50_000


def text_size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """source, source_size, target from (source, source_size): a row for each source.

    The windows run over sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", w.cast("double")).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    # sources by the level at which they reach their cap; those up to some place are capped
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    lower = ranked.withColumn("capped", F.sum("cap").over(by)).withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(by))
    lower = lower.withColumn("total", F.sum("source_size").over(everything))
    # the level if this source and those before it are capped; it holds while it is above their ratios
    level = F.when(F.col("open") > 0, (F.col("total") - F.col("capped")) / F.col("open"))
    lower = lower.withColumn("level", level).withColumn("holds", F.col("level") >= F.col("cap") / F.col("weight"))
    lower = lower.withColumn("place", F.row_number().over(by))
    lower = lower.withColumn("n_capped", F.max(F.when(F.col("holds"), F.col("place")).otherwise(0)).over(everything))
    start = F.col("total") / F.sum("weight").over(everything)
    chosen = F.coalesce(F.max(F.when(F.col("place") == F.col("n_capped"), F.col("level"))).over(everything), start)
    return lower.withColumn("x", chosen).select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("x")).alias("target"))


#: Sums that the knapsack tells apart up to its budget, and the words that are left to it.
CELLS, LEFT = 1 << 20, 1 << 17


def _set_bits(n: int) -> np.ndarray:
    raw = np.frombuffer(n.to_bytes(-(-n.bit_length() // 8), "little"), np.uint8)
    at = np.flatnonzero(raw)
    rows, bits = np.nonzero(np.unpackbits(raw[at, None], axis=1, bitorder="little"))
    return at[rows] * 8 + bits


def _halves(order: list[int], steps: np.ndarray, counts: np.ndarray, limit: int):
    """(k, n) for each kind of document: 1, 2, 4, ... of them, together all that fit below ``limit``."""
    for k in order:
        left, size = min(int(counts[k]), limit // int(steps[k])), 1
        while left > 0:
            n = min(size, left)
            yield k, n
            left, size = left - n, 2 * size


def _every_sum(order: list[int], steps: np.ndarray, counts: np.ndarray, goal: int, limit: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Reachable sums, the piece that first reached each, and the pieces. The sums are bits
    of one number, so a piece that reaches nothing new costs a shift."""
    held, mask = 1, (1 << (limit + 1)) - 1
    first = np.full(limit + 1, -1, np.int32)
    pieces: list[tuple[int, int]] = []
    for k, n in _halves(order, steps, counts, limit):
        if goal == 0 or first[goal] >= 0:
            break
        new = (held << n * int(steps[k])) & mask & ~held
        if new:
            first[_set_bits(new)] = len(pieces)
            pieces.append((k, n))
            held |= new
    sums = np.append(0, np.flatnonzero(first >= 0))
    return sums, first[sums], pieces


def _sum_a_cell(order: list[int], steps: np.ndarray, counts: np.ndarray, goal: int, limit: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """As ``_every_sum``, with one sum for each cell of goal / CELLS."""
    wide = -(-goal // CELLS)
    held = np.full(limit // wide + 1, -1, np.int64)
    held[0] = 0
    first = np.full(len(held), -1, np.int32)
    pieces: list[tuple[int, int]] = []
    for k, n in _halves(order, steps, counts, limit):
        if held[goal // wide] == goal:
            break
        sums = held[held >= 0] + n * int(steps[k])
        sums = sums[sums <= limit]
        sums = sums[held[sums // wide] < 0]
        if len(sums):
            held[sums // wide] = sums
            first[sums // wide] = len(pieces)
            pieces.append((k, n))
    return held[held >= 0], first[held >= 0], pieces


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of ``counts`` documents of each length to take for a sum near to
    ``budget``: bounded knapsack over sums, up to one document beyond the budget.

    Sums are counted in units of the lengths' common divisor, and the search ends at the
    unit next to the budget. The sum is the nearest of all if the budget has up to CELLS
    units. Of a larger one, each cell of budget / CELLS holds one sum, and the nearest of
    those is taken.
    """
    take = np.zeros(len(lengths), np.int64)
    usable = (counts > 0) & (lengths > 0) & (lengths <= 2 * budget)
    if budget <= 0 or not usable.any():
        return take
    unit = int(np.gcd.reduce(lengths[usable]))
    goal = (2 * budget + unit - 1) // (2 * unit)
    limit = (budget + int(min(budget, lengths[usable].max()))) // unit
    steps = lengths // unit
    order = [k for k in np.argsort(-lengths, kind="stable").tolist() if usable[k]]
    sums, first, pieces = (_every_sum if goal <= CELLS else _sum_a_cell)(order, steps, counts, goal, limit)
    came = dict(zip(sums.tolist(), first.tolist()))
    at = int(sums[np.argmin(np.abs(sums * unit - budget))])
    # a sum's piece is the first that reached it, so no piece is used twice on the way back
    while at:
        k, n = pieces[came[at]]
        take[k] += n
        at -= n * int(steps[k])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their sum comes near to
    ``budget``: each length's proportional share, longer lengths for what rounding
    left, and the knapsack over the unused documents for the last words. Where that
    misses by more than the lengths' common divisor explains, all is fitted again by
    the knapsack from nothing, and the nearer of the two is taken."""
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    budget = min(budget, total)
    take = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    rest = budget - int((take * lengths).sum())
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        if length and rest - length >= LEFT:
            n = min(int(counts[k] - take[k]), (rest - LEFT) // length)
            take[k] += n
            rest -= n * length
    take += knapsack(lengths, counts - take, rest)
    divisor = int(np.gcd.reduce(lengths[counts > 0]))
    missed = lambda x: abs(budget - int((x * lengths).sum()))
    if missed(take) > min(budget % divisor, -budget % divisor):
        take = min(take, knapsack(lengths, counts, budget), key=missed)
    return take


def plan(lengths: DataFrame, goals: DataFrame) -> DataFrame:
    """source, size, n, epochs, extra: of the ``n`` documents of a length, all are
    taken ``epochs`` times and ``extra`` of them once more."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        rows = rows.sort_values("size", kind="stable")
        epochs = int(target // whole) if whole else 0
        budget = int(round(target)) - epochs * whole
        if budget >= whole > 0:
            epochs, budget = epochs + 1, budget - whole
        rows["epochs"] = epochs
        rows["extra"] = fit(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), budget)
        return rows[["source", "size", "n", "source_size", "target", "epochs", "extra"]]

    g = goals.withColumnRenamed("source", "__s")
    joined = lengths.join(g, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    grouped = joined.withColumn("has", F.col("source").isNotNull()).groupBy("has", "source")
    return grouped.applyInPandas(one, "source string, size long, n long, source_size long, target double, epochs long, extra long")


def _ranked(rows: DataFrame, keys: list[str], spread: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` from 1 within ``keys``, whose groups have ``n`` rows.
    A group of over RANKED rows is ranked by parts of the integer ``spread``, and
    the sizes of the parts before are added."""
    rows = rows.withColumn("part", F.pmod(F.col(spread), F.ceil(F.col("n") / F.lit(RANKED))))
    local = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order))
    small, large = rows.where(F.col("n") <= RANKED), rows.where(F.col("n") > RANKED)
    before = large.groupBy(*keys, "part").agg(F.count("*").alias("held"))
    before = before.withColumn("before", F.sum("held").over(Window.partitionBy(*keys).orderBy("part")) - F.col("held"))
    before = before.select(*(F.col(c).alias(f"__{c}") for c in (*keys, "part", "before")))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, "part")))
    small = small.withColumn("rank", local)
    large = large.withColumn("rank", local).join(before, on).withColumn("rank", F.col("rank") + F.col("__before"))
    return small.union(large.select(*small.columns))


def assign(documents: DataFrame, seed: int = 42, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, times for each row."""
    rows = staged(
        documents.select(
            "doc_id", F.col("source").cast("string").alias("source"), text_size().alias("size"), F.xxhash64("text").alias("text_hash")
        ),
        "mix-sizes",
    )
    lengths = staged(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    chosen = staged(plan(lengths, targets(sizes, weights, max_epochs)), "mix-plan")
    p = chosen.withColumnRenamed("source", "__source").withColumnRenamed("size", "__size")
    drawn = rows.join(p, F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size"))).drop("__source", "__size")
    settled = drawn.where((F.col("extra") == 0) | (F.col("extra") == F.col("n"))).withColumn("times", F.col("epochs") + (F.col("extra") > 0).cast("long"))
    # rank by seeded hash within (source, size)
    open_ = drawn.where((F.col("extra") > 0) & (F.col("extra") < F.col("n"))).withColumn("h", F.xxhash64("doc_id", "text_hash", F.lit(seed)))
    ranked = _ranked(open_, ["source", "size"], "h", ["h", "doc_id", "text_hash"])
    ranked = ranked.withColumn("times", F.col("epochs") + (F.col("rank") <= F.col("extra")).cast("long"))
    out = ["doc_id", "text_hash", "source", "size", "source_size", "target", "times"]
    return settled.select(*out).union(ranked.select(*out))


def mix_report(documents: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row."""
    return assign(documents, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it. Rows that
    agree in doc_id, source and text share evenly what they were drawn."""
    names = ["doc_id", "text_hash", "source"]
    times = assign(documents, **options).groupBy(*names).agg(F.sum("times").alias("__times"), F.count("*").alias("n"))
    times = times.select(*(F.col(c).alias(f"__{c}") for c in names), "__times", F.col("n").alias("__n"))
    docs = packed(documents).select("doc", "doc.doc_id", F.xxhash64("doc.text").alias("text_hash"), F.col("doc.source").cast("string").alias("source"))
    on = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_hash") == F.col("__text_hash")) & F.col("source").eqNullSafe(F.col("__source"))
    joined = docs.join(times.where("__times > 0"), on).withColumnRenamed("__n", "n")
    whole = F.floor(F.col("__times") / F.col("n"))
    even = joined.where("__times % n = 0").select("doc", whole.alias("take"))
    odd = joined.where("__times % n > 0").select("doc", *names, "n", "__times", F.monotonically_increasing_id().alias("any"))
    odd = _ranked(odd, names, "any", ["any"])
    odd = odd.select("doc", (whole + (F.col("rank") <= F.col("__times") % F.col("n")).cast("long")).alias("take"))
    rows = even.union(odd).where("take > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("take").cast("long")))).select("doc.*")
