"""Benchmark decontamination with a distributed positional inverted index.

The index holds the whole training corpus and knows nothing of the benchmark. It
is partitioned by document: each shard has a dictionary of its words and, for
every word, the sorted positions of its own documents' tokens (postings, as
gaps). It is written once to shared storage. A search reads each shard and
answers every benchmark window there: the posting lists of the window's terms
are intersected after subtracting each term's offset, starting from the term
that is rarest in the shard, which gives the exact phrase matches. Proximity
matches take the two rarest terms of a window, in any order, at most ``slop``
words apart in one document. Postings never cross the network and no list is
collected.

The benchmark is the query set: it is held by the tasks in blocks of at most
``block_words`` window words, whatever its size; every block is looked up in the
whole of the one index.

Edge cases: null and empty texts have no words and match nothing; repeated
``item_id`` rows form one item; a null ``item_id`` is an item written as the
empty string; repeated or null ``doc_id`` rows are searched each on its own;
an empty benchmark leaves every document clean; extra columns are ignored by
``contamination`` and kept by ``filter_documents``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import packed, scratch_path

WINDOW = 13
#: A-Z to a-z; digits, a-z and every byte of a non-ASCII character stay; the rest separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "rows array<bigint>, keys array<string>, starts binary, words binary, word_starts binary, gaps binary"
#: A shard ends with the document that reaches this many words.
SHARD_WORDS = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; the whole of fewer words; none of none."""
    if not words:
        return []
    return list(dict.fromkeys(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))))


class Queries:
    """A block of benchmark windows: term numbers of each, and the items that hold it."""

    def __init__(self, rows: list[tuple[str, list[bytes]]], size: int):
        self.terms: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in rows})
        number = {x: k for k, x in enumerate(self.items)}
        held: dict[tuple[bytes, ...], set[int]] = {}
        for item, window in rows:
            held.setdefault(tuple(window), set()).add(number[item])
        self.window_terms = np.full((len(held), size), -1, np.int64)
        self.lengths = np.zeros(len(held), np.int64)
        for k, window in enumerate(held):
            self.lengths[k] = len(window)
            self.window_terms[k, : len(window)] = [self.terms.setdefault(w, len(self.terms)) for w in window]
        counts = np.array([len(x) for x in held.values()], np.int64)
        self.item_starts = np.concatenate([[0], np.cumsum(counts)])
        self.item_of = np.array([i for x in held.values() for i in sorted(x)], np.int64)


def _blocks(benchmark: DataFrame, size: int, block_words: int) -> Iterator[Queries]:
    """The benchmark's windows in blocks; read through an iterator that holds one
    partition, of which ``block_words`` bounds what is kept."""
    rows, held = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        for window in windows_of(words_of(r.t), size):
            rows.append((r.i, window))
            held += len(window)
            if held >= block_words:
                yield Queries(rows, size)
                rows, held = [], 0
    if rows:
        yield Queries(rows, size)


def _shard_row(rows: list[int], keys: list[str | None], lengths: list[int], number: dict[bytes, int], ids: list[np.ndarray]) -> pa.RecordBatch:
    tokens = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    places = np.argsort(tokens, kind="stable")
    parts = (
        np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64).tobytes(),
        b" ".join(number),
        np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=len(number)))]).astype(np.int64).tobytes(),
        np.diff(places, prepend=0).astype(np.int32).tobytes(),
    )
    who = [pa.array([rows], pa.list_(pa.int64())), pa.array([keys], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*who, *(pa.array([p], pa.binary()) for p in parts)], names=["rows", "keys", "starts", "words", "word_starts", "gaps"])


def build_index(documents: DataFrame) -> DataFrame:
    """The written index of ``documents`` (``key`` string, ``text``), a row for each
    shard: document numbers and keys, where each document starts in the shard's run
    of positions, the shard's words, where each word's postings start, and all
    postings as gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, keys, lengths, ids, at = [], [], [], [], 0
        number: dict[bytes, int] = defaultdict(count().__next__)
        for batch in batches:
            for row, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = words_of(text.as_py())
                ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                rows.append(row)
                keys.append(key)
                lengths.append(len(words))
                at += len(words)
                if at >= SHARD_WORDS or len(rows) >= SHARD_WORDS:
                    yield _shard_row(rows, keys, lengths, number, ids)
                    rows, keys, lengths, ids, at = [], [], [], [], 0
                    number = defaultdict(count().__next__)
        if rows:
            yield _shard_row(rows, keys, lengths, number, ids)

    docs = documents.select(F.monotonically_increasing_id().alias("row"), "key", "text")
    spark, path = documents.sparkSession, scratch_path(documents.sparkSession, "phrase-index")
    # a row is some MB: pages and row groups are looked at after each row, not after the first hundred
    few = {"compression": "zstd", "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.row.count.limit": 16}
    docs.mapInArrow(run, INDEX).write.options(**few).mode("errorifexists").parquet(path)
    return spark.read.schema(INDEX).parquet(path)


class Shard:
    """The postings of some terms, numbered by their place in ``terms``, in one row of the index."""

    def __init__(self, terms: list[bytes], rows: list[int], keys: list[str | None], starts: bytes, words: bytes, word_starts: bytes, gaps: bytes):
        self.rows, self.names, self.starts = rows, keys, np.frombuffer(starts, np.int64)
        number = {w: k for k, w in enumerate(words.split())}
        held = np.array([number.get(w, -1) for w in terms], np.int64)
        names = np.flatnonzero(held >= 0)
        first = np.frombuffer(word_starts, np.int64)
        self.first, self.count = np.zeros(max(1, len(terms)), np.int64), np.zeros(max(1, len(terms)), np.int64)
        n = self.count[names] = np.diff(first)[held[names]]
        self.first[names] = np.cumsum(n) - n
        places = np.cumsum(np.frombuffer(gaps, np.int32), dtype=np.int64)
        self.positions = places[np.arange(n.sum()) + np.repeat(first[held[names]] - self.first[names], n)]
        self.span = int(self.starts[-1]) + 1
        #: (term, position) as one ascending number, for lookups in many lists at once
        self.keys = np.repeat(names, n) * self.span + self.positions

    def holds(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(terms), bool)
        key = terms * self.span + positions
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (positions >= 0) & (positions < self.span)

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``terms``, position) for each posting of each term."""
        n = self.count[terms]
        row = np.repeat(np.arange(len(terms)), n)
        return row, self.positions[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[terms], n)]

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        """The shard's document that holds each position; empty documents hold none."""
        return np.searchsorted(self.starts, position, side="right") - 1


def _by_rarity(shard: Shard, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Windows of which every term has postings here, and each one's offsets, rarest term first."""
    counts = np.where(q.window_terms >= 0, shard.count[q.window_terms], np.iinfo(np.int64).max)
    live = np.flatnonzero(counts.min(axis=1) > 0)
    return live, np.argsort(counts[live], axis=1, kind="stable")


def _chunks(sizes: np.ndarray, most: int = 1 << 21) -> Iterator[slice]:
    """Slices of at most ``most`` candidates, or one window."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield slice(at, to)
        at = to


def phrases(shard: Shard, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(window, start position) of all exact occurrences in the shard."""
    live, order = _by_rarity(shard, q)
    out = []
    rarest = q.window_terms[live, order[:, 0]] if len(live) else np.zeros(0, np.int64)
    for part in _chunks(shard.count[rarest]):
        row, position = shard.postings(rarest[part])
        window, by = live[part][row], order[part][row]
        start = position - by[:, 0]
        for k in range(1, q.window_terms.shape[1]):
            term = q.window_terms[window, by[:, k]]
            keep = (term < 0) | shard.holds(np.maximum(term, 0), start + by[:, k])
            window, start, by = window[keep], start[keep], by[keep]
        keep = (start >= 0) & (shard.doc_of(start) == shard.doc_of(start + q.lengths[window] - 1))
        out.append((window[keep], start[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def proximities(shard: Shard, q: Queries, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, position of its rarest term) where its two rarest terms stand
    within ``slop`` words of each other in one document."""
    live, order = _by_rarity(shard, q)
    many = q.lengths[live] > 1
    live, order = live[many], order[many]
    out = []
    rarest = q.window_terms[live, order[:, 0]] if len(live) else np.zeros(0, np.int64)
    for part in _chunks(shard.count[rarest]):
        row, position = shard.postings(rarest[part])
        window = live[part][row]
        other = q.window_terms[window, order[part][row, 1]]
        key = other * shard.span + position
        at = np.searchsorted(shard.keys, key)
        hit = np.zeros(len(window), bool)
        for side in (-1, 0, 1):  # before, at or after; at the term itself if a window repeats it
            near = shard.keys[np.clip(at + side, 0, len(shard.keys) - 1)]
            there = near - other * shard.span
            ok = (there >= 0) & (there < shard.span) & (there != position) & (np.abs(there - position) <= slop)
            hit |= ok & (shard.doc_of(np.clip(there, 0, shard.span)) == shard.doc_of(position))
        out.append((window[hit], position[hit]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _search(index: DataFrame, q: Queries, slop: int | None) -> DataFrame:
    """A row for each document: row, key, n_words, covered (start, end of merged exact
    spans, document-relative), items, near_items."""
    spread = index.sparkSession.sparkContext.broadcast(q)
    out = "row long, key string, n_words long, covered array<struct<s:long,e:long>>, items array<string>, near_items array<string>"

    def items_by_doc(shard: Shard, window: np.ndarray, position: np.ndarray) -> dict[int, set[int]]:
        got: dict[int, set[int]] = {}
        pairs = np.unique(np.stack([shard.doc_of(position), window]), axis=1) if len(window) else np.zeros((2, 0), np.int64)
        for d, w in pairs.T.tolist():
            got.setdefault(d, set()).update(spread.value.item_of[spread.value.item_starts[w] : spread.value.item_starts[w + 1]].tolist())
        return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = spread.value
        terms = list(q.terms)
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(terms, **batch.slice(k, 1).to_pylist()[0])
                window, start = phrases(shard, q)
                end = start + q.lengths[window]
                order = np.lexsort((end, start))
                spans: dict[int, list[list[int]]] = {}
                for d, s, e in zip(shard.doc_of(start[order]).tolist(), start[order].tolist(), end[order].tolist()):
                    held, base = spans.setdefault(d, []), int(shard.starts[d])
                    if held and s - base <= held[-1][1]:
                        held[-1][1] = max(held[-1][1], e - base)
                    else:
                        held.append([s - base, e - base])
                exact = items_by_doc(shard, window, start)
                near = items_by_doc(shard, *proximities(shard, q, slop)) if slop else {}
                named = lambda got, d: sorted(q.items[i] for i in got.get(d, ()))  # noqa: E731, B023
                docs = range(len(shard.rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.rows, pa.int64()),
                        pa.array(shard.names, pa.string()),
                        pa.array(np.diff(shard.starts)),
                        pa.array([[{"s": s, "e": e} for s, e in spans.get(d, ())] for d in docs], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                        pa.array([named(exact, d) for d in docs], pa.list_(pa.string())),
                        pa.array([named(near, d) for d in docs], pa.list_(pa.string())),
                    ],
                    names=["row", "key", "n_words", "covered", "items", "near_items"],
                )

    return index.mapInArrow(run, out)


def _covered_words(spans: Column) -> Column:
    """Words inside the union of half-open spans."""
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["to"]), F.lit(0).cast("long"))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a["n"])


def search(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_words: int = 4_000_000, slop: int | None = None) -> DataFrame:
    """For each row of ``documents`` (``key`` string, ``text``): key, n_words,
    n_hit, covered, items (exact phrase), near_items (proximity, if ``slop`` is given)."""
    index = build_index(documents.select("key", F.col("text").cast("string").alias("text")))
    parts = [_search(index, q, slop) for q in _blocks(benchmark, size, block_words)] or [_search(index, Queries([], size), slop)]
    found = parts[0]
    if len(parts) > 1:
        found = (
            reduce(DataFrame.union, parts)
            .groupBy("row", "key", "n_words")
            .agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("covered", "items", "near_items")))
        )
    return found.select("key", "n_words", _covered_words(F.col("covered")).alias("n_hit"), "covered", F.array_sort("items").alias("items"), F.array_sort("near_items").alias("near_items"))


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row."""
    found = search(documents.select(F.col("doc_id").cast("string").alias("key"), "text"), benchmark, **options)
    return found.select(
        F.col("key").cast("long").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def filter_documents(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that are not contaminated. The verdict depends on
    the text alone, so it is carried back by the text's digest."""
    digest = lambda c: F.md5(F.coalesce(F.col(c).cast("string"), F.lit("")))
    found = search(documents.select(digest("text").alias("key"), "text"), benchmark, **options)
    bad = found.where(contaminated()).select("key").distinct()
    return packed(documents).withColumn("key", digest("doc.text")).join(bad, "key", "left_anti").select("doc.*")
