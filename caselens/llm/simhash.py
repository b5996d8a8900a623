"""SimHash near-dedup by anchor-point covering.

A 64-bit fingerprint is cut into 23 + 23 + 18 bits. On each 23-bit part the
binary Golay code is perfect: every word lies within 3 bits of exactly one
codeword. Pairs of codewords are the anchors, so the covering radius is 3 in
each part. A fingerprint is at home at its one nearest anchor, and a guest at
every anchor within covering radius plus threshold: two fingerprints that
differ in ``i`` bits of the first part and ``j`` of the second, with
``i + j <= threshold``, meet where one of them is at home, since the other lies
within ``3 + i`` and ``3 + j`` there. Each home is compared with the guests of
its anchor over all 64 bits, so no link is missed and none is false.

Equal fingerprints are one vertex, so a group of exact copies costs one row.
The sides of the join are spread over 2**24 anchors and a large anchor is split
by the skew handling of the sort-merge join. Components come from alternating
large-star and small-star steps on written tables.

Edge cases: null and empty texts have no words and the fingerprint zero, linked
like any other; fewer words than a shingle make one shingle of them all; rows
with a null ``doc_id`` are fingerprinted and linked but never name a component
while another member has an id; repeated rows keep one result row each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import packed, staged

#: Fixed value: generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011
PART, RADIUS = 23, 3
#: Words of a shingle in the pipeline's rule of similarity.
RULE_WIDTH = 5

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """Hashes of the ``width``-word shingles, repeats included; none without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    shingles = [b" ".join(words)] if len(words) <= width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, seed) for x in shingles], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are set in more than half of the hashes."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def remixed(hashes: np.ndarray, view: int) -> np.ndarray:
    """Hashes of another, independent view; view 0 is the hashes themselves."""
    if not view:
        return hashes
    with np.errstate(over="ignore"):
        z = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * view & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        return (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def fingerprint(text: str | None, width: int = 3, seed: int = 42, view: int = 0) -> int:
    """SimHash of ``text``: zero without words."""
    return majority(remixed(shingle_hashes(text, width, seed), view))


def with_fingerprints(df: DataFrame, key: str, width: int = 3, seed: int = 42) -> DataFrame:
    """``key`` (long) and ``fp``, the signed 64-bit fingerprint; a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(text.as_py(), width, seed) for text in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[key, "fp"])

    return df.select(F.col(key).cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{key} long, fp long")


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().translate(_LOWER).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct ``width``-word shingles of hashed words, as sorted hashes; all
    words are one shingle if they are fewer, and none without words."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(width, len(words))):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[i : i + n]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(29)))


def minima(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of ``rows`` MinHash values: two sets agree in a band with
    the ``rows``-th power of their similarity. No shingles count as one, zero."""
    high = (shingles >> np.uint64(32)).astype(np.uint32) if len(shingles) else np.zeros(1, np.uint32)
    salt, odd = _permutations(bands * rows)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), 256):
        part = (high[at : at + 256, None] ^ salt) * odd
        np.minimum(least, (part ^ (part >> np.uint32(15))).min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in least.reshape(bands, rows)], np.uint64)


@lru_cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.array([xxhash.xxh32_intdigest(b"", k) for k in range(2 * n)], np.uint32)
    return drawn[:n], drawn[n:] | np.uint32(1)


def with_sketches(df: DataFrame, key: str, views: int, bands: int, rows: int, width: int) -> DataFrame:
    """``key`` (long) and ``marks``: a SimHash of the distinct ``width``-word shingles for
    each view, then a hash for each band of the five-word shingles; ``size``, how many of
    those there are, and ``prefix``, 32 bits of the least of them (``prefix_length``); a row for each row.

    A shingle counts once in a text, so filler that is repeated weighs no more than a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes, prefixes = [], [], []
            for text in batch.column(1):
                words = word_hashes(text.as_py())
                narrow, wide = shingle_set(words, width), rule_set(words)
                out.extend(majority(remixed(narrow, v + 1)) for v in range(views))
                if bands:
                    out.extend(minima(wide if len(words) else words, bands, rows).tolist())
                sizes.append(len(wide))
                prefixes.append((wide[: prefix_length(len(wide))] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            marks = np.array(out, np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(marks) + 1, views + bands, dtype=np.int32)), pa.array(marks))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes, pa.int32()), _lists(prefixes)], names=[key, "marks", "size", "prefix"])

    return df.select(F.col(key).cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{key} long, marks array<bigint>, size int, prefix array<int>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def rule_set(words: np.ndarray) -> np.ndarray:
    """The distinct five-word shingles of hashed words, in order; no words count as one
    shingle, as texts without words are alike."""
    return shingle_set(words, RULE_WIDTH) if len(words) else np.zeros(1, np.uint64)


def needed(size: int) -> int:
    """How many shingles of a set of ``size`` another one of similarity 0.8 has at least."""
    return (4 * size + 4) // 5


def prefix_length(size: int) -> int:
    """Two sets that share ``needed`` shingles share at least a tenth of the smaller one
    within the ``prefix_length`` first shingles of each, in any order that both follow."""
    return size - needed(size) + (size + 9) // 10


def with_rule_sets(df: DataFrame, key: str) -> DataFrame:
    """``key`` (long), ``size`` and ``shingles``, all of ``rule_set``; a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [rule_set(word_hashes(text.as_py())).view(np.int64) for text in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int32()), _lists(sets)], names=[key, "size", "shingles"])

    return df.select(F.col(key).cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{key} long, size int, shingles array<bigint>")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(PART - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


@lru_cache
def _errors(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error words of weight up to ``most`` by syndrome: (start of each of the
    2048 syndromes, error words, weights), lightest first."""
    words = np.arange(1 << PART, dtype=np.int64)
    weight = np.bitwise_count(words)
    words = words[weight <= most]
    weight = np.bitwise_count(words).astype(np.int64)
    syndrome = _syndromes(words)
    order = np.lexsort((words, weight, syndrome))
    return np.searchsorted(syndrome[order], np.arange(2049)), words[order], weight[order]


def _expand(parts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, codeword, distance) for every codeword within ``most`` bits of each part."""
    start, words, weight = _errors(most)
    s = _syndromes(parts)
    n = start[s + 1] - start[s]
    row = np.repeat(np.arange(len(parts)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[s], n)
    return row, parts[row] ^ words[at], weight[at]


def anchors(fps: np.ndarray, beyond: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fps, anchor, at home) for every anchor within the covering
    radius plus ``beyond`` bits of a fingerprint."""
    u = fps.view(np.uint64)
    low, high = (u & np.uint64(0x7FFFFF)).astype(np.int64), (u >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    r1, c1, d1 = _expand(low, RADIUS + beyond)
    r2, c2, d2 = _expand(high, RADIUS + beyond)
    n2 = np.bincount(r2, minlength=len(fps))
    s2 = np.cumsum(n2) - n2
    rep = n2[r1]
    left = np.repeat(np.arange(len(r1)), rep)
    right = np.arange(len(left)) - np.repeat(np.cumsum(rep) - rep, rep) + np.repeat(s2[r1], rep)
    over = np.maximum(d1[left] - RADIUS, 0) + np.maximum(d2[right] - RADIUS, 0)
    keep = over <= beyond
    left, right = left[keep], right[keep]
    return r1[left], c1[left] << PART | c2[right], (d1[left] <= RADIUS) & (d2[right] <= RADIUS)


def replicas(fps: DataFrame, beyond: int) -> DataFrame:
    """(anchor, fp, home) from distinct (``view``, ``fp``); the anchors of each view are its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views, values = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, len(values), 2000):
                part = values[at : at + 2000]
                row, anchor, home = anchors(part, beyond)
                anchor = anchor | views[at : at + 2000][row].astype(np.int64) << 2 * PART
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row]), pa.array(home)], names=["anchor", "fp", "home"])

    return fps.select(F.col("view").cast("long"), "fp").mapInArrow(run, "anchor long, fp long, home boolean")


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints that differ in at most ``threshold`` bits."""
    copies = staged(replicas(fps.select(F.lit(0).alias("view"), "fp"), threshold), "simhash-replicas")
    home = copies.where("home").select("anchor", F.col("fp").alias("x"))
    guest = copies.select("anchor", F.col("fp").alias("y"))
    pairs = home.hint("merge").join(guest, "anchor").where(F.expr(f"x <> y AND bit_count(x ^ y) <= {int(threshold)}"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 100, rows: int | None = None) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge (a, b), of
    which there are at most ``rows`` (None: any number); no round makes more of them.

    Alternating star contraction: each round joins every node's larger
    neighbours, then its smaller ones, to its smallest neighbour, until nothing
    changes; the number of rounds grows with the logarithm of the diameter. A
    neighbourhood is never collected: minima are aggregates joined back.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components", rows=rows)
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        # large star: neighbours above u go to the least of u and its neighbours
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct(), "components", rows=rows)
        # small star: u and its neighbours below go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = staged(small.select("e.u", "e.v").where("u <> v").distinct(), "components", rows=rows)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def dedup_groups(documents: DataFrame, threshold: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) for each row."""
    prints = staged(with_fingerprints(documents, "doc_id", width, seed), "simhash-prints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(distinct, threshold))
    classes = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("class"), "first_id")
    least = classes.groupBy("class").agg(F.min("first_id").alias("component_id"))
    named = classes.join(least, "class").select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def fingerprint_hex() -> Column:
    return F.lower(F.lpad(F.hex("fp"), 16, "0"))


def similar(pairs: DataFrame, texts: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose texts (``node``, ``text``) have at least
    ``similarity`` of their distinct five-word shingles in common; two texts
    without words do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = lru_cache(64)(lambda text: shingle_set(word_hashes(text), RULE_WIDTH))  # neighbours in the batch share a side
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = sets(x.as_py()), sets(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


class Groups:
    """Groups of nodes that grow by links: (node, root) for every node in one with another."""

    def __init__(self, nodes: DataFrame, texts: DataFrame):
        self.texts, self.read, self.size = texts, None, nodes.count()
        self.roots = nodes.select("node", F.col("node").alias("root"))

    def link(self, pairs: DataFrame) -> None:
        """Read those of ``pairs`` (a, b) not read before, and join the groups of similar ones."""
        fresh = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fresh = staged(fresh if self.read is None else fresh.join(self.read, ["a", "b"], "left_anti"), "simhash-pairs")
        self.read = fresh if self.read is None else self.read.union(fresh)
        wanted = fresh.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        # a pair brings two whole texts
        edges = staged(similar(fresh, self.texts.join(wanted, "node", "left_semi")), "simhash-linked", rows=fresh.count(), part=2_000)
        linked = edges.count()
        if not linked:
            return
        root = lambda c: self.roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        merged = components(edges.join(root("a"), "a").join(root("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), rows=linked)
        merged = merged.select(F.col("node").alias("root"), F.col("root").alias("over"))
        self.roots = staged(self.roots.join(merged, "root", "left").select("node", F.coalesce("over", "root").alias("root")), "simhash-roots", rows=self.size)

    def mixed(self, placed: DataFrame, keys: list[str]) -> DataFrame:
        """The rows of ``placed`` (node, keys) whose bucket holds several groups."""
        spread = placed.join(self.roots, "node").groupBy(*keys).agg(F.min("root").alias("low"), F.max("root").alias("high"))
        return placed.join(spread.where("low <> high").select(*keys), keys, "left_semi")

    def stars(self, placed: DataFrame, keys: list[str], draw: Column) -> DataFrame:
        """(node, head, keys) of the nodes of ``placed`` (node, by_text, keys) that are not in
        the group of their bucket's head, the node of least ``draw``. Heads are aggregates,
        so a bucket of any size gives a row for each member and never a pair of members."""
        at = placed.join(self.roots, "node")
        heads = at.groupBy(*keys).agg(F.min(F.struct(draw.alias("draw"), "node", "root")).alias("head"), F.min("root").alias("low"), F.max("root").alias("high"))
        heads = heads.where("low <> high").select(*keys, F.col("head.node").alias("head"), F.col("head.root").alias("head_root"))
        return at.join(heads, keys).where("root <> head_root").select("node", "head", *keys)


def _crossing(rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` (shingle, root) whose shingle is in several groups."""
    # a window, as an aggregate joined back would shuffle the rows twice
    of = Window.partitionBy("shingle")
    spread = rows.withColumns({"low": F.min("root").over(of), "high": F.max("root").over(of), "n": F.count("*").over(of)})
    return spread.where("low <> high").drop("low", "high")


def remaining_pairs(sketches: DataFrame, groups: Groups) -> DataFrame:
    """(a, b): pairs of texts of different groups, among them every one of similarity 0.8.

    Exact, by counts and by positions in an order that all sets follow:

    1. A text that has such a partner shares at least ``needed`` shingles with it, and so
       enough of its ``prefix`` (``sketches``: uid, size, prefix) with other groups. What
       has a near copy in its own group only, or none, ends here.
    2. Of the texts left, all shingles are looked at: at least ``needed`` of a text must be
       in other groups.
    3. Their shingles are ordered: first those of one group, then the rarer ones. A pair's first common
       shingle is so early in both that enough can follow (prefix and position filter);
       two texts of one group never meet, as groups meet by shingle before their members do.
    """
    roots = groups.roots
    need = lambda c: F.floor((F.lit(4) * F.col(c) + 4) / 5)
    placed = sketches.join(roots, F.col("uid") == F.col("node")).select("node", "root", "size", F.explode("prefix").alias("shingle"))
    # a tenth of the smaller set, which has at least ``needed`` shingles of the larger one
    enough = F.floor((need("size") + 9) / 10)
    live = _crossing(placed).groupBy("node", "root", "size").agg(F.count("*").alias("met")).where(F.col("met") >= enough)
    live = staged(live.select("node", "root"), "simhash-live")
    texts = groups.texts.join(live.select("node"), "node", "left_semi")
    whole = staged(with_rule_sets(texts, "node").join(live, "node").select("node", "root", "size", F.explode("shingles").alias("shingle")), "simhash-shingles")
    met = staged(_crossing(whole), "simhash-crossing")
    held = met.groupBy("node").agg(F.count("*").alias("met"))
    order = Window.partitionBy("node").orderBy("n", "shingle")
    at = met.join(held, "node").where(F.col("met") >= need("size"))
    at = at.withColumn("place", F.row_number().over(order) + F.col("size") - F.col("met"))
    # the larger text of a pair has its first common shingle among its last ``needed``, the smaller one among its last 8/9
    at = at.where(F.col("place") <= F.col("size") - need("size") + 1).withColumn("room", F.col("size") - F.col("place"))
    at = staged(at.select("shingle", "root", "node", "size", "room", (9 * (F.col("room") + 1) >= 8 * F.col("size")).alias("early")), "simhash-prefixes")
    sums = at.groupBy("shingle", "root").agg(F.max("room").alias("room"), F.min("size").alias("size"), F.bool_or("early").alias("early"))
    left = sums.select("shingle", F.col("root").alias("ra"), F.col("room").alias("xa"), F.col("size").alias("sa"))
    right = sums.where("early").select("shingle", F.col("root").alias("rb"), F.col("room").alias("xb"), F.col("size").alias("sb"))
    meet = left.join(right, "shingle").where("ra <> rb AND 9 * (least(xa, xb) + 1) >= 4 * (sa + sb)").select("shingle", "ra", "rb")
    side = lambda x: at.select("shingle", F.col("root").alias(f"r{x}"), F.col("node").alias(x), F.col("size").alias(f"s{x}"), F.col("room").alias(f"x{x}"), F.col("early").alias(f"e{x}"))
    both = meet.join(side("a"), ["shingle", "ra"]).join(side("b").where("eb"), ["shingle", "rb"])
    return both.where("sb <= sa AND 5 * sb >= 4 * sa AND 9 * (least(xa, xb) + 1) >= 4 * (sa + sb)").select("a", "b").distinct()


def near_groups(documents: DataFrame, threshold: int = 2, width: int = 2, views: int = 4, bands: int = 16, rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """(``doc``, ``uid``) of each row, and (``node``, ``root``, ``least``): the group of each
    distinct text, whose first row is ``uid`` = ``node`` with ``least`` = (no_id, id, digest, uid).

    Only exact copies (by a 128-bit digest and the length) are one node unread; all
    other links are pairs of texts that were read and have 0.8 of their five-word
    shingles in common. What is read, in this order, each time over what is left:

    * each member of a bucket with its least one; a bucket is an equal SimHash of a
      view or an equal band of MinHash values;
    * near SimHashes by anchor covering: both sides go to the anchors within radius
      plus half the threshold (a word halfway is that near to each), a group has one
      member at an anchor, and those of different groups are compared there;
    * each member of a bucket with a drawn one of another group, twice;
    * where a bucket still holds several groups, its members by each further band:
      those that agree in two sketches, with a drawn one of them, twice.

    * last, whatever these sketches missed: ``remaining_pairs`` has every pair of different
      groups that can still be a link, so the groups are those of all links.

    Every step but the anchors and the last is a star, so its pairs grow with the members of a
    bucket and not with their square; at an anchor they grow with near texts that
    were read and found to differ, in the last step with texts that are nearly links. Heads are drawn by a hash of the text (``by_text``),
    so the groups are the same however the rows are split or ordered.
    """
    rows_ = staged(packed(documents).withColumn("uid", F.monotonically_increasing_id()), "simhash-documents")
    sketches = staged(with_sketches(rows_.select("uid", "doc.text"), "uid", views, bands, rows, width), "simhash-sketches")
    # a node is a whole text: the uid of its first row
    content = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    digest = F.md5(content.cast("binary"))
    order = F.struct(F.col("doc.doc_id").isNull().alias("no_id"), F.col("doc.doc_id").alias("id"), digest.alias("digest"), "uid")
    copies = rows_.select(digest.alias("digest"), F.octet_length(content).alias("bytes"), order.alias("at"))
    first = copies.groupBy("digest", "bytes").agg(F.min("at").alias("least"))
    first = staged(first.select(F.col("least.uid").alias("node"), F.xxhash64("digest", "bytes").alias("by_text"), "least"), "simhash-first")
    whole = staged(sketches.select(F.col("uid").alias("node"), "marks").join(first.select("node", "by_text"), "node"), "simhash-nodes")
    named = whole.select("node", "by_text", F.posexplode("marks").alias("view", "mark"))
    shared = named.groupBy("view", "mark").agg(F.count("*").alias("n"), F.min(F.struct("by_text", "node"))["node"].alias("head"))
    placed = staged(named.join(shared.where("n > 1").select("view", "mark"), ["view", "mark"], "left_semi"), "simhash-placed")
    groups = Groups(first, rows_.select(F.col("uid").alias("node"), "doc.text"))

    groups.link(groups.stars(placed, ["view", "mark"], F.col("by_text")).select(F.col("node").alias("a"), F.col("head").alias("b")))
    groups.link(_anchored(shared.where(F.col("view") < views).select("view", F.col("mark").alias("fp"), "head"), groups.roots, threshold))
    for turn in range(2):
        groups.link(groups.stars(placed, ["view", "mark"], F.xxhash64("by_text", "view", F.lit(turn))).select(F.col("node").alias("a"), F.col("head").alias("b")))
    if bands:
        finer = groups.mixed(placed, ["view", "mark"]).join(whole.select("node", "marks"), "node").select("node", "by_text", "view", "mark", F.posexplode("marks").alias("by", "other")).where((F.col("by") >= views) & (F.col("by") > F.col("view")))
        finer = staged(finer.select("node", "by_text", F.xxhash64("view", "mark", "by", "other").alias("both")), "simhash-finer")
        for turn in range(2):
            groups.link(groups.stars(finer, ["both"], F.xxhash64("by_text", "both", F.lit(turn))).select(F.col("node").alias("a"), F.col("head").alias("b")))
    groups.link(remaining_pairs(sketches, groups))
    return rows_, first.join(groups.roots, "node").select("node", "root", "least")


def keep_first(documents: DataFrame, **settings) -> DataFrame:
    """The rows of ``documents`` without those whose group (``near_groups``) has an earlier
    one: the row of least doc_id stays (a null id only in a group without another; among
    rows of one id that of the least text digest)."""
    rows, classes = near_groups(documents, **settings)
    kept = classes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.uid").alias("uid"))
    return rows.join(kept, "uid", "left_semi").select("doc.*")


def _anchored(fps: DataFrame, roots: DataFrame, threshold: int) -> DataFrame:
    """(a, b): heads (``view``, ``fp``, ``head``) whose fingerprints differ in at most
    ``threshold`` bits, one of each group at an anchor."""
    heads = staged(fps.join(roots, fps["head"] == roots["node"]).select("view", "fp", "head", "root"), "simhash-heads")
    copies = staged(replicas(heads.select("view", "fp"), -(-threshold // 2)).select("anchor", "fp"), "simhash-replicas")
    # a view's anchors are its own
    at = copies.withColumn("view", F.shiftright("anchor", 2 * PART).cast("int")).join(heads, ["view", "fp"])
    one = staged(at.groupBy("anchor", "root").agg(F.min(F.struct("fp", "head")).alias("x")).select("anchor", "root", "x.fp", "x.head"), "simhash-anchored")
    left = one.select("anchor", F.col("root").alias("root_x"), F.col("fp").alias("x"), F.col("head").alias("a"))
    right = one.select("anchor", F.col("root").alias("root_y"), F.col("fp").alias("y"), F.col("head").alias("b"))
    near = left.hint("merge").join(right, "anchor").where(F.expr(f"root_x < root_y AND bit_count(x ^ y) <= {int(threshold)}"))
    return near.select("a", "b")
