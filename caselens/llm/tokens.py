"""Token-ID output with a minimal perfect hash index over raw id payloads.

A store is two folders. ``payload`` holds blocks in ascending ``doc_id`` order:
raw little-endian ids of up to ``BLOCK`` ids (a longer document alone in one
block) and the number of ids of each document. ``index`` holds one minimal
perfect hash for each bucket of keys: a key's slot is found by testing one bit
for each level and counting the bits before it, and the slot has a 32-bit
fingerprint of the key, where its first document starts, how many ids follow and
in which blocks. A lookup reads one bucket and the blocks that it names, whatever
the size of the store; the payload itself is never searched for a key.

Texts are cut where white space follows something else, which the tokenizer's
own splitting rule never crosses: at spaces and line ends where white space stands
alone and before stops and commas that follow a letter or digit, and by ``PIECE`` in
texts where white space does not stand alone and in parts that are not one word. Parts met before are taken from a bounded cache, all others go through the
tokenizer. The ids are those of the whole text.

Edge cases: a null or empty text has only the end id; rows with a null
``doc_id`` come first; equal ``doc_id`` values are ordered by their texts' hash,
and the index has the first one's start and how many follow; an empty table
makes an empty store; strings of special tokens in a text are ordinary text;
extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import scratch_path

BLOCK = 1 << 20
#: Keys of one index bucket on average.
BUCKET = 4096
#: Unicode white space as the tokenizer's rule has it: Python's without 1C-1F.
WHITE = r"[^\S\x1c-\x1f]"
MARK = r"(?:[^\w\s]|[_\x1c-\x1f])"
#: The tokenizer's rule never crosses the place where white space follows
#: something else, nor that where a letter or digit is followed by neither.
PIECE = re.compile(rf"{WHITE}*[^\W_]+|{WHITE}*{MARK}+[^\W_]*|{WHITE}+")
#: White space beside white space: such a text is not cut at each space.
DOUBLE = re.compile(r"\s\s")
ALONE = re.compile(r"\S \S")
#: Parts of one generation of the cache, and characters of text encoded together.
LIMIT, GROUP = 150_000, 1 << 22


#: What separates the parts of a text; a stop or comma is one's start in texts where each follows a letter or digit.
CUT, STOP = "\x1e", re.compile(r"[.,](?<![^\W_][.,])")


def part_key(piece: str) -> str:
    """A part's name in the cache: without the space before it, and with one if it has none."""
    if piece[0] == " " and piece[1:2] not in (" ", "\n"):
        return piece[1:]
    return piece if piece[0] == "\n" else " " + piece


def part_text(key: str) -> str:
    return " " + key if not key or key[0] not in " \n" else key[1:] if key[0] == " " else key


def slices(text: str) -> Iterator[str]:
    """``text`` cut at spaces that stand alone, about GROUP characters each."""
    at = 0
    while at < len(text):
        cut = ALONE.search(text, at + GROUP)
        to = cut.start() + 1 if cut else len(text)
        yield text[at:to]
        at = to


class Encoder:
    """Ids of whole texts as little-endian bytes of ``width``."""

    def __init__(self, vocabulary: str, end_id: int, width: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype(f"<u{width}")
        self.end = np.array([end_id], self.kind).tobytes()
        names = self.tokenizer.get_vocab()
        # byte-level tokens that begin with a space or a line end
        self.opens = np.zeros(max(names.values()) + 1, bool)
        self.opens[[i for name, i in names.items() if name[0] in "\u0120\u010a"]] = True
        # two generations: what the young one lacks is looked for in the old one
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode_new(self, run: list[str], single: list[str]) -> dict[str, bytes]:
        """``run``, pieces that begin with white space and end without, keep their ids when
        written one after the other, so many go through the tokenizer as one text."""
        groups = [run[i : i + 256] for i in range(0, len(run), 256)]
        out: dict[str, bytes] = {}
        size = self.kind.itemsize
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(group):  # white space inside a piece, or a rule of another vocabulary
                single.extend(group)
                continue
            data = ids.tobytes()
            ends = [*(starts * size).tolist(), len(data)]
            out.update(zip(group, map(data.__getitem__, map(slice, ends, ends[1:]))))
        out.update((p, np.array(e.ids, self.kind).tobytes()) for p, e in zip(single, self.tokenizer.encode_batch_fast(single, add_special_tokens=False)))
        return out

    def _learn(self, keys: list[str]) -> None:
        """Make all of ``keys``, which are not young, young."""
        young, old = self.young, self.old
        held = list(map(old.get, keys))
        young.update({k: ids for k, ids in zip(keys, held) if ids is not None})
        keys = [k for k, ids in zip(keys, held) if ids is None]
        new = {" " + k: k for k in keys if k.isalpha()}
        run, single = list(new), []
        mixed: list[tuple[str, list[str]]] = []
        others: dict[str, str] = {}
        for k in keys:
            if k.isalpha():
                continue
            text = part_text(k)
            pieces = PIECE.findall(text)
            if len(pieces) == 1:
                others[text] = k
            else:
                mixed.append((k, list(map(part_key, pieces))))
        for k in {p for _, pieces in mixed for p in pieces}:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                elif (text := part_text(k)) not in new:
                    others[text] = k
        for text in others:
            (run if text[0] in " \n" and len(text) > 1 and not text[-1].isspace() else single).append(text)
        new |= others
        coded = self._encode_new(run, single)
        young.update(zip(map(new.__getitem__, coded), coded.values()))
        for k, pieces in mixed:
            young[k] = b"".join([young[p] for p in pieces])

    def _ids(self, keys: list[str]) -> list[bytes]:
        """The ids of each of ``keys``; new ones are encoded together."""
        found = list(map(self.young.get, keys))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        self._learn([keys[i] for i in gaps])
        for i in gaps:
            found[i] = self.young[keys[i]]
        if len(self.young) > LIMIT:
            self.young, self.old = {}, self.young
        return found

    def _joined(self, parts: pa.ListArray) -> list[bytes]:
        """The joined ids of each list of keys; a key is looked up once."""
        coded = parts.flatten().dictionary_encode()
        rows = pa.array(self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(coded.indices)
        _, offsets, data = rows.buffers()
        ends = np.frombuffer(offsets, np.int32)[parts.offsets.to_numpy()].tolist() if len(rows) else [0] * (len(parts) + 1)
        data = memoryview(data) if data else b""
        return [bytes(data[x:y]) for x, y in pairwise(ends)]

    def _texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without an end id."""
        plain = [CUT not in x and not DOUBLE.search(x) for x in texts]
        heads, rests = [], []
        for text, cut in zip(texts, plain):
            if cut:
                stops = not STOP.search(text)
                text = text.replace(" ", CUT).replace("\n", CUT + "\n")
                if stops:
                    text = text.replace(".", CUT + " .").replace(",", CUT + " ,")
            head, space, rest = text.partition(CUT) if cut else ("", "", "")
            heads.append(head)
            rests.append(rest if space else None)
        # before the first space is nothing, or a part without a space before it
        first = iter(self._ids([" " + h for h in heads if h]))
        after = self._joined(pc.split_pattern(pa.array(rests, pa.string()), CUT))
        other = iter(self._joined(pa.array([list(map(part_key, PIECE.findall(x))) for x, cut in zip(texts, plain) if not cut], pa.list_(pa.string()))))
        return [(next(first) if head else b"") + rest if cut else next(other) for head, rest, cut in zip(heads, after, plain)]

    def encode(self, texts: Iterator[str | None]) -> Iterator[bytes]:
        """The ids of each text and the end id, in the order given."""
        held: list[str] = []
        chars = 0
        for text in texts:
            text = text or ""
            if held and chars + len(text) > GROUP:
                yield from (x + self.end for x in self._texts(held))
                held, chars = [], 0
            if len(text) > GROUP:  # a bounded length at a time
                yield b"".join([self._texts([x])[0] for x in slices(text)]) + self.end
                continue
            held.append(text)
            chars += len(text)
        yield from (x + self.end for x in self._texts(held))


@lru_cache(maxsize=1)
def encoder(vocabulary: str, end_id: int, width: int) -> Encoder:
    """One for each worker process, whose tasks share what it has learnt."""
    return Encoder(vocabulary, end_id, width)


def write_payload(documents: DataFrame, path: str, vocabulary: str, end_id: int = 2, width: int = 2) -> None:
    """Blocks (shard, block, first, width, doc_ids, n_tokens, payload) at ``path``."""
    schema = "shard int, block int, first long, n_ids long, width int, doc_ids array<bigint>, n_tokens array<bigint>, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block, first = encoder(vocabulary, end_id, width).encode, 0, 0
        ids: list[int | None] = []
        parts: list[bytes] = []
        held, shard = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, ids, parts, held
            values = [[shard], [block], [first], [held], [width], [ids], [[len(p) // width for p in parts]], [b"".join(parts)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=[x.split()[0] for x in schema.split(", ")])
            block, first, ids, parts, held = block + 1, first + held, [], [], 0
            return out

        for batch in batches:
            for doc_id, data, shard in zip(batch.column(0).to_pylist(), encode(x.as_py() for x in batch.column(1)), batch.column(2).to_pylist()):  # noqa: B007
                if ids and held + len(data) // width > BLOCK:
                    yield flush()
                ids.append(doc_id)
                parts.append(data)
                held += len(data) // width
        if ids:
            yield flush()

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")
    ordered.select("doc_id", "text", F.spark_partition_id().alias("shard")).mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def placed_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``seq``, their number in the whole store, and ``at``, the ids before them."""
    blocks = spark.read.parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"), F.count("*").alias("blocks"))
    # a row for each shard, not for each document
    before = lambda c: F.sum(c).over(Window.orderBy("shard")) - F.col(c)
    bases = sizes.select(F.col("shard").alias("__shard"), before("ids").alias("ids_before"), before("blocks").alias("blocks_before"))
    placed = blocks.join(F.broadcast(bases), F.col("shard") == F.col("__shard"))  # at most one row for each shuffle partition
    return placed.withColumn("seq", F.col("blocks_before") + F.col("block")).withColumn("at", F.col("ids_before") + F.col("first"))


def places(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, seq of each document; no payload is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                seq, at, ids, n = (batch.column(i)[k] for i in range(4))
                n = n.values.to_numpy()
                start = at.as_py() + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(start), pa.array(n), pa.array(np.full(len(n), seq.as_py()))], names=["doc_id", "start", "n_tokens", "seq"])

    return placed_blocks(spark, path).select("seq", "at", "doc_ids", "n_tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, seq long")


def _mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit numbers for each salt (splitmix64's finisher)."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


FINGERPRINT_SALT = 1 << 20


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level sizes in bits, bits of all levels) for distinct integer ``keys``.

    On each level a key whose hashed bit no other key has keeps it; the rest go on.
    """
    sizes, levels = [], []
    level = 0
    while len(keys):
        m = -(-max(64, 2 * len(keys)) // 8) * 8
        at = (_mix(keys, level) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        sizes.append(m)
        levels.append(alone)
        keys = keys[~alone[at]]
        level += 1
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    return np.array(sizes, np.int64), np.packbits(bits, bitorder="little")


def mph_slots(sizes: np.ndarray, packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The slot of each key, or -1 where no level has its bit."""
    bits = np.unpackbits(packed, bitorder="little").astype(np.int64)
    rank = np.cumsum(bits) - bits
    slots, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, m in enumerate(sizes.tolist()):
        at = base + (_mix(keys[open_], level) % np.uint64(m)).astype(np.int64)
        hit = bits[at] == 1
        slots[open_[hit]] = rank[at[hit]]
        open_, base = open_[~hit], base + m
    return slots


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, FINGERPRINT_SALT) >> np.uint64(32)).astype(np.uint32)


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64(F.col("key"), F.lit(7)), F.lit(n))


#: What a slot says of its key's documents: start of the first, their number, their ids, first and last block.
SLOT = ("start", "copies", "ids", "low", "high")


def write_index(documents: DataFrame, path: str) -> None:
    """Buckets (bucket, sizes, bits, marks, a column for each of SLOT) over the distinct
    keys of ``documents`` (doc_id, start, n_tokens, seq); null keys are a field's own."""
    keys = documents.groupBy(F.col("doc_id").alias("key")).agg(
        F.min("start").alias("start"), F.count("*").alias("copies"), F.sum("n_tokens").alias("ids"), F.min("seq").alias("low"), F.max("seq").alias("high")
    )
    n = max(1, -(-documents.count() // BUCKET))

    def one(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        null = rows["key"].isna().to_numpy()
        own = rows[~null]
        k = own["key"].to_numpy(np.int64)
        sizes, bits = build_mph(k)
        order = np.argsort(mph_slots(sizes, bits, k))
        slots = {c: [own[c].to_numpy(np.int64)[order].tobytes()] for c in SLOT}
        null_key = struct.pack("<5q", *(int(rows[null][c].iloc[0]) for c in SLOT)) if null.any() else b""
        return pd.DataFrame({"bucket": [group[0]], "sizes": [sizes.tobytes()], "bits": [bits.tobytes()], "marks": [fingerprints(k)[order].tobytes()], **slots, "null_key": [null_key]})

    schema = "bucket long, sizes binary, bits binary, marks binary, " + ", ".join(f"{c} binary" for c in SLOT) + ", null_key binary"
    keys.withColumn("bucket", _bucket(n)).groupBy("bucket").applyInPandas(one, schema).withColumn("buckets", F.lit(n)).write.parquet(path)


def _find(index: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, a row of SLOT for each key) of integer ``keys`` in one bucket's row."""
    marks = np.frombuffer(index["marks"], np.uint32)
    slots = mph_slots(np.frombuffer(index["sizes"], np.int64), np.frombuffer(index["bits"], np.uint8), keys)
    found = slots >= 0
    if not len(marks):
        return found, np.zeros((len(keys), len(SLOT)), np.int64)
    at = np.maximum(slots, 0)
    found &= marks[at] == fingerprints(keys)
    return found, np.stack([np.frombuffer(index[c], np.int64)[at] for c in SLOT], 1)


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """key and the columns of SLOT for each distinct ``key`` that the index holds.

    A key that was never stored is told apart by its fingerprint, but for one in 2**32.
    """
    first = index.select("buckets").first()
    if first is None:
        return keys.select("key", *(F.lit(0).cast("long").alias(c) for c in SLOT)).where("false")
    n = first[0]

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"key": pd.array([], "Int64"), **{c: np.zeros(0, np.int64) for c in SLOT}})
        if not len(right) or not len(left):
            return out
        row = right.iloc[0]
        null = left["key"].isna().to_numpy()
        k = left["key"][~null].to_numpy(np.int64)
        found, slots = _find(row, k)
        rows = [pd.DataFrame({"key": pd.array(k[found], "Int64"), **dict(zip(SLOT, slots[found].T))})]
        if null.any() and len(row["null_key"]):
            rows.append(pd.DataFrame({"key": pd.array([pd.NA], "Int64"), **{c: [v] for c, v in zip(SLOT, struct.unpack("<5q", row["null_key"]))}}))
        return pd.concat(rows)

    asked = keys.select("key").distinct().withColumn("bucket", _bucket(n))
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(one, "key long, " + ", ".join(f"{c} long" for c in SLOT))


def get(spark: SparkSession, path: str, key: int) -> list[int] | None:
    """The ids of the first document stored under ``key``: one bucket and one block are read."""
    index = spark.read.parquet(f"{path}/index")
    first = index.select("buckets").first()
    if first is None:
        return None
    bucket = spark.range(1).select(F.lit(key).cast("long").alias("key")).select(_bucket(first[0]).alias("b")).first().b
    row = index.where(F.col("bucket") == bucket).first()
    if row is None:
        return None
    found, slots = _find(row.asDict(), np.array([key], np.int64))
    if not found[0]:
        return None
    slot = dict(zip(SLOT, slots[0].tolist()))
    block = placed_blocks(spark, f"{path}/payload").where(F.col("seq") == slot["low"]).select("at", "n_tokens", "width", "payload").first()
    starts = block.at + np.cumsum(block.n_tokens) - np.array(block.n_tokens)
    k = int(np.searchsorted(starts, slot["start"]))
    return np.frombuffer(block.payload, f"<u{block.width}")[slot["start"] - block.at :][: block.n_tokens[k]].tolist()


def write_store(documents: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = 2, width: int = 2) -> str:
    """Write payload and index; return the store's path."""
    path = path or scratch_path(documents.sparkSession, "tokens")
    write_payload(documents, f"{path}/payload", vocabulary or public_tokenizers.path("byte_bpe_50k.json"), end_id, width)
    write_index(places(documents.sparkSession, f"{path}/payload"), f"{path}/index")
    return path


def read_store(keys: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document stored under ``keys`` (``key``).

    The index says which blocks to read and where in them: the requests for a block
    (at most one for each of its documents) meet it, and each is answered with the
    ids that lie at its place. Nothing else in the payload says whose ids they are.
    """
    spark = keys.sparkSession
    runs = lookup(keys, spark.read.parquet(f"{path}/index"))
    asked = runs.select(F.explode(F.sequence("low", "high")).alias("seq"), F.struct("key", "start", "ids").alias("run"))
    asked = asked.groupBy("seq").agg(F.collect_list("run").alias("runs"))
    blocks = placed_blocks(spark, f"{path}/payload").select("seq", "at", "n_tokens", "width", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                at, n, width, payload, runs = (batch.column(i)[r] for i in range(5))
                n, at, runs = n.values.to_numpy(), at.as_py(), runs.values
                start = at + np.cumsum(n) - n
                keys, low, size = runs.field("key"), runs.field("start").to_numpy(), runs.field("ids").to_numpy()
                first, last = np.searchsorted(start, low), np.searchsorted(start, low + size)
                held = last - first
                row = np.repeat(np.arange(len(low)), held)
                doc = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held) + first[row]
                ids = np.frombuffer(payload.as_buffer(), f"<u{width.as_py()}").astype("<u4")
                crc = [zlib.crc32(ids[x:y]) for x, y in zip((start[doc] - at).tolist(), (start[doc] - at + n[doc]).tolist())]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(start[doc]), pa.array(n[doc]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    joined = blocks.join(asked, "seq").select("at", "n_tokens", "width", "payload", "runs")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
