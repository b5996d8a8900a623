"""The prefix trie of conversations, by union-find over neighbours' common prefixes.

Conversations are rebuilt, named by the digests of their turns, reduced to distinct
sequences with a count and the least id, and sorted. Neighbours in that order share the
longest prefixes: the common prefix length (LCP) of two neighbours is an edge. Inside a
block of the order the edges are taken by descending depth and a union-find merges
their components; each merge of components that are both deeper makes a branching node
at the edge's depth. The prefixes between a node and its parent have the node's
members, so they are written out from it.

A block's nodes are final but for the prefixes that it shares with the block before or
after. Those stay open: for each the block gives its share of the sums, contracted over
everything below, and shares of the same prefix are added up across boundaries. All
that is asked of a node is a sum or a minimum over its members, if a turn's words and a
child are counted where a prefix first comes up in the order, so blocks can be merged
in any order and none has to be walked again.

Texts become 128-bit digests at once and never move again. What is held in one piece is
a conversation's digests (16 bytes and a count for each turn), and a block of about
BLOCK turns.

Edge cases: turns are ordered by turn (null first), then role and digest; null roles and
texts are empty; a conversation with a null ``conv_id`` keeps its own turns, is a member
like any other, never the least beside one with an id, and stands in no list of ids;
``c - c % 20`` takes the sign of c; turnless rebuilt conversations end at the root;
repeated rows are turns of their own; an empty table has no trie, not even a root;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE_WORD, staged

#: Bytes of a turn's digest, turns of a block, and bits of conversation ids that are joined together.
DIGEST, BLOCK, IDS = 16, 1 << 16, 9
#: Fixed values of the contract: conversations of one start, and the most turns of it.
SHARED, HEAD = 20, 4
NO_IDS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, seq (the turns' digests, one after the other), words (of each turn)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    shown = F.concat(F.length("role").cast("string"), F.lit("\n"), F.col("role"), F.col("text"))
    digest = F.substring(F.sha2(shown, 256), 1, 2 * DIGEST)
    turns = rows.select("conv_id", "turn", "role", digest.alias("digest"), F.regexp_count("text", F.lit(SPACE_WORD)).alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    turns = turns.withColumn("at", F.row_number().over(order)).select("conv_id", F.struct("at", "digest", "words").alias("x"))
    head = F.coalesce(F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEAD)), F.lit(0))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("own")).withColumn("h", head)
    # the first turns of the conversation that each group of SHARED starts like
    starts = whole.where(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("__start"), F.slice("own", 1, HEAD - 1).alias("start"))
    both = whole.join(starts, (F.col("conv_id") - F.col("conv_id") % SHARED) == F.col("__start"), "left")
    later = F.filter("own", lambda x: x["at"] > F.col("h"))
    built = F.when(F.col("start").isNull(), later).otherwise(F.concat(F.filter("start", lambda x: x["at"] <= F.col("h")), later))
    seq = F.unhex(F.array_join(F.transform(built, lambda x: x["digest"]), ""))
    return both.select("conv_id", seq.alias("seq"), F.transform(built, lambda x: x["words"].cast("int")).alias("words"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with alike."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * DIGEST] == b[: mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


def name_of(prefix: bytes) -> bytes:
    return hashlib.sha256(prefix).digest()[:DIGEST]


class Forest:
    """Components of neighbouring sequences; each has the node at its top."""

    def __init__(self, depths: list[int], least: list[int | None]):
        n = len(depths)
        self.root, self.top = list(range(n)), list(range(n))
        self.depth, self.low, self.high = depths[:], list(range(n)), list(range(n))
        self.least, self.parent, self.children = least[:], [-1] * n, [0] * n

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def _over(self, v: int, depth: int) -> int:
        """A new node at ``depth`` above ``v``."""
        w = len(self.depth)
        self.depth.append(depth)
        self.low.append(self.low[v])
        self.high.append(self.high[v])
        self.least.append(self.least[v])
        self.parent.append(-1)
        self.children.append(1)
        self.parent[v] = w
        return w

    def merge(self, i: int, depth: int) -> None:
        """The edge of ``depth`` between the sequences ``i - 1`` and ``i``."""
        a, b = self.find(i - 1), self.find(i)
        v, w = self.top[a], self.top[b]
        if self.depth[v] > depth:  # two deeper ones: a branching node
            v = self._over(v, depth)
        if self.depth[w] > depth:
            self.parent[w] = v
            self.children[v] += 1
        else:  # the same prefix
            self.parent[w] = v
            self.depth[w] = -1
            self.children[v] += self.children[w]
        self.high[v] = self.high[w]
        self.least[v] = _least(self.least[v], self.least[w])
        self.root[b] = a
        self.top[a] = v

    def close(self) -> None:
        """A root above what is left, of depth 0."""
        v = self.top[self.find(0)]
        if self.depth[v] > 0:
            self._over(v, 0)

    def above(self, v: int) -> int:
        """The node over ``v``, past such as were found to be the same prefix."""
        p = self.parent[v]
        while p >= 0 and self.depth[p] < 0:
            p = self.parent[p]
        return p


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


NODE = (
    "block long, depth long, name binary, up binary, up_conv long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, open boolean, ends boolean"
)


def block_nodes(number: int, seqs: list[bytes], copies: list[int], least: list[int | None], words: list[list[int]], before: int, after: int) -> pa.RecordBatch:
    """The nodes of a block of the order: NODE.

    ``before`` and ``after`` are the turns shared with the sequences next to it, -1 where
    there is none. An open node's values are this block's share.
    """
    n = len(seqs)
    size = [len(s) // DIGEST for s in seqs]
    lcp = [before, *(common(a, b) for a, b in zip(seqs, seqs[1:])), after]
    forest = Forest(size, least)
    for i in sorted(range(1, n), key=lambda i: -lcp[i]):
        forest.merge(i, lcp[i])
    forest.close()

    summed = [np.concatenate([[0], np.cumsum(w)]).astype(np.int64).tolist() for w in words]
    upto = lambda x: np.concatenate([[0], np.cumsum(x)]).astype(np.int64).tolist()
    members, leaves = upto(copies), upto([lcp[i + 1] < size[i] for i in range(n)])
    held, once = upto([c * s[-1] for c, s in zip(copies, summed)]), upto([s[-1] for s in summed])
    shared = upto([s[max(x, 0)] for s, x in zip(summed, lcp)])
    out: dict[str, list] = {c.split()[0]: [] for c in NODE.split(", ")}

    def is_open(lo: int, hi: int, depth: int) -> bool:
        return depth == 0 or (lo == 0 and depth <= before) or (hi == n - 1 and depth <= after)

    for v, deepest in enumerate(forest.depth):
        if deepest < 0:
            continue
        p, lo, hi = forest.above(v), forest.low[v], forest.high[v]
        seq, own = seqs[lo], summed[lo]
        convs, first = members[hi + 1] - members[lo], lcp[lo]
        later = shared[hi + 1] - shared[lo + 1]  # words before the further sequences' own
        for depth in range(forest.depth[p] + 1 if p >= 0 else 0, deepest + 1):
            above = max(depth - 1, 0)
            opened = is_open(lo, hi, depth)
            ends = depth == deepest and size[lo] == depth
            up = None if depth == 0 else (lo, hi) if p < 0 or depth - 1 > forest.depth[p] else (forest.low[p], forest.high[p])
            up_open = up is not None and is_open(*up, depth - 1)
            children = forest.children[v] if depth == deepest else 1
            children -= lo == 0 and first > depth  # the block before has counted it
            saved = held[hi + 1] - held[lo] - convs * own[above] - (once[hi + 1] - once[lo] - later - own[max(first, above)])
            out["block"].append(number)
            out["depth"].append(depth)
            out["name"].append(name_of(seq[: depth * DIGEST]) if opened or ends else None)
            out["up"].append(name_of(seq[: (depth - 1) * DIGEST]) if up_open else None)
            out["up_conv"].append(None if up is None or up_open else forest.least[v] if up == (lo, hi) else forest.least[p])
            out["conv_id"].append(forest.least[v])
            out["n_convs"].append(convs)
            out["n_children"].append(children)
            out["n_leaves"].append(leaves[hi + 1] - leaves[lo])
            out["saved_tokens"].append(saved)
            out["open"].append(opened)
            out["ends"].append(ends)
    return pa.RecordBatch.from_pydict(out, schema=_NODE_SCHEMA)


_KINDS = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
_NODE_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in NODE.split(", ")])
BLOCKS = "part int, block int, first binary, last binary, prior binary, next binary, seqs array<binary>, copies array<long>, least array<long>, words array<array<int>>"
_BLOCK_SCHEMA = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in ("first", "last", "prior", "next")), ("seqs", pa.list_(pa.binary())), ("copies", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())), ("words", pa.list_(pa.list_(pa.int32())))]
)


def sorted_blocks(sequences: DataFrame, size: int = BLOCK) -> DataFrame:
    """The distinct ``sequences`` (seq, copies, least, words) in order, as rows of BLOCKS: a
    block knows its neighbours' nearest sequences, but for those of other partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seqs, copies, least, words, turns, number, prior = [], [], [], [], 0, 0, None

        def made(after: bytes | None) -> pa.RecordBatch:
            values = [[part], [number], [seqs[0]], [seqs[-1]], [prior], [after], [seqs], [copies], [least], [words]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _BLOCK_SCHEMA)], schema=_BLOCK_SCHEMA)

        part = 0
        for batch in batches:
            for seq, n, conv, held, part in zip(*(c.to_pylist() for c in batch.columns)):  # noqa: B007
                if seqs and turns + len(held) > size:
                    yield made(seq)
                    prior, number = seqs[-1], number + 1
                    seqs, copies, least, words, turns = [], [], [], [], 0
                seqs.append(seq)
                copies.append(n)
                least.append(conv)
                words.append(held)
                turns += len(held) + 1
        if seqs:
            yield made(None)

    n = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sequences.repartitionByRange(n, "seq").sortWithinPartitions("seq")
    return ordered.select("seq", "copies", "least", "words", F.spark_partition_id().alias("part")).mapInArrow(run, BLOCKS)


def nodes(blocks: DataFrame) -> DataFrame:
    """The nodes of every block: NODE."""
    # a row for each partition: what lies before its first block and after its last
    edges = blocks.groupBy("part").agg(F.min(F.struct("block", "first"))["first"].alias("head"), F.max(F.struct("block", "last"))["last"].alias("tail"))
    order = Window.orderBy("part")
    edges = edges.select(F.col("part").alias("__part"), F.lag("tail").over(order).alias("__prior"), F.lead("head").over(order).alias("__next"))
    placed = blocks.join(F.broadcast(edges), F.col("part") == F.col("__part"))
    number = F.shiftleft(F.col("part").cast("long"), 32) + F.col("block")
    rows = placed.select(number.alias("number"), "seqs", "copies", "least", "words", F.coalesce("prior", "__prior").alias("prior"), F.coalesce("next", "__next").alias("next"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, seqs, copies, least, words, prior, after = (c[r].as_py() for c in batch.columns)
                yield block_nodes(block, seqs, copies, least, words, -1 if prior is None else common(prior, seqs[0]), -1 if after is None else common(seqs[-1], after))

    return rows.mapInArrow(run, NODE)


def end_digests(conversations: DataFrame) -> DataFrame:
    """name, ends_sha256 for each distinct sequence of ``conversations`` (conv_id, seq): of
    the ids that have it. Ids are joined in order, 2**IDS at a time at most, and the joined parts of a
    sequence are read one after the other, as a digest needs; none is held longer."""
    ids = conversations.where("conv_id IS NOT NULL").select(F.substring(F.sha2("seq", 256), 1, 2 * DIGEST).alias("name"), "conv_id")
    parts = ids.withColumn("part", F.shiftright("conv_id", IDS)).groupBy("name", "part").agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != name:
                    if name is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], names=["name", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], names=["name", "ends_sha256"])

    return parts.repartition("name").sortWithinPartitions("name", "part").select("name", "ids").mapInArrow(run, "name string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256: a row for each distinct sequence of first turns. Blocks hold about ``size`` turns."""
    built = staged(rebuilt(conversations), "rebuilt")
    distinct = built.groupBy("seq").agg(F.count("*").alias("copies"), F.min("conv_id").alias("least"), F.first("words").alias("words"))
    made = staged(nodes(staged(sorted_blocks(distinct, size), "trie-blocks")), "trie-nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    # the shares of a prefix that blocks have in common
    shares = made.where("open")
    whole = staged(shares.groupBy("name", "depth", "up").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends")), "trie-open")
    known = whole.select(F.col("name").alias("__name"), F.col("conv_id").alias("__conv"))
    # a block's own nodes learn what lies over them by way of the block's share of it
    learnt = shares.select("block", "name").join(known, F.col("name") == F.col("__name")).select(F.col("block").alias("__block"), "__name", "__conv")
    under = made.where(~F.col("open"))
    under = under.join(learnt, (F.col("block") == F.col("__block")) & (F.col("up") == F.col("__name")), "left")
    closed = under.withColumn("parent_conv_id", F.coalesce("up_conv", "__conv"))
    opened = whole.join(known, F.col("up") == F.col("__name"), "left").withColumn("parent_conv_id", F.col("__conv"))
    columns = ["name", "ends", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    rows = closed.select(*columns).union(opened.select(*columns))
    ends = end_digests(built).select(F.upper("name").alias("__end"), "ends_sha256")
    # a key of its own for each node where nothing ends, so that these do not meet in one task
    at = F.when(F.col("ends"), F.hex("name")).otherwise(F.concat_ws("-", F.lit(""), "conv_id", "depth"))
    rows = rows.withColumn("__at", at).join(ends, F.col("__at") == F.col("__end"), "left")
    return rows.select(*columns[2:], F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))
