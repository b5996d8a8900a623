"""The budget fit against every reachable sum, its time, and the choice of documents."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from caselens.llm import mixing


def reachable(lengths, counts):
    sums = {0}
    for length, n in zip(lengths, counts):
        sums = {s + k * length for s in sums for k in range(n + 1)}
    return sums


def test_knapsack_is_nearest_of_all_sums():
    rng = random.Random(5)
    for _ in range(300):
        unit = rng.choice([1, 1, 2, 6, 35])
        lengths = sorted(rng.sample(range(1, 30), rng.randint(1, 5)))
        lengths = np.array(lengths, np.int64) * unit
        counts = np.array([rng.randint(0, 4) for _ in lengths], np.int64)
        sums = reachable(lengths.tolist(), counts.tolist())
        budget = rng.randint(1, max(sums) + 20)
        take = mixing.knapsack(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_a_cell_holds_one_sum(monkeypatch):
    """Beyond CELLS units two sums of a cell are not told apart: the first reached stays."""
    lengths, counts = np.array([100, 7], np.int64), np.array([9, 3], np.int64)
    assert mixing.knapsack(lengths, counts, 707).tolist() == [7, 1]
    monkeypatch.setattr(mixing, "CELLS", 8)
    assert mixing.knapsack(lengths, counts, 707).tolist() == [7, 0]


def test_budget_that_no_sum_meets_ends_early():
    lengths = np.arange(1, 20_001, dtype=np.int64) * 2
    counts = np.full(len(lengths), 3, np.int64)
    start = time.monotonic()
    budget = int((lengths * counts).sum()) // 2 | 1
    take = mixing.fit(lengths, counts, budget)
    assert abs(int((take * lengths).sum()) - budget) == 1
    # one odd document, too long for the budget's rest: the common divisor alone says nothing
    take = mixing.knapsack(np.append(lengths[:5_000], 262_143), np.append(counts[:5_000], 1), 131_071)
    assert abs(int((take[:-1] * lengths[:5_000]).sum()) + int(take[-1]) * 262_143 - 131_071) == 1
    assert time.monotonic() - start < 10


def test_choice_is_of_least_seeded_hash(spark):
    """Each document's count by the fit of its source's lengths and its place by hash."""
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 2, 3, 5, 5, 8, 40])), rng.choice(["a", "b", "b", "c", None])) for i in range(400)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {}
    for r in mixing.assign(docs).collect():
        got.setdefault((r.doc_id, r.source), []).append(r.times)
    hashed = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("t")).withColumn("h", F.xxhash64("doc_id", "t", F.lit(42))).collect()
    total = sum(len(r.text.split()) for r in hashed)
    # the water level, by bisection
    names = sorted({r.source for r in hashed}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(r.text.split()) for r in hashed if r.source == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    low, high = 0.0, float(3 * total)
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if sum(min(3 * size[s], weight[s] * x) for s in names) < total else (low, x)
    want = {}
    for s in names:
        target = min(3.0 * size[s], weight[s] * high)
        epochs, budget = divmod(round(target), size[s])
        by = {}
        for r in hashed:
            if r.source == s:
                by.setdefault(len(r.text.split()), []).append((r.h, r.doc_id, r.t))
        lengths = sorted(by)
        extra = mixing.fit(np.array(lengths, np.int64), np.array([len(by[n]) for n in lengths], np.int64), budget)
        for n, more in zip(lengths, extra.tolist()):
            for place, (_, doc_id, _) in enumerate(sorted(by[n])):
                want.setdefault((doc_id, s), []).append(epochs + (place < more))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
