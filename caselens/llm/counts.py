"""Token counts of texts without their ids.

A tokenizer cuts a text into pre-tokens and each pre-token into pieces, alike wherever
it stands. So a text's tokens are the sum, over its distinct pre-tokens, of how often
it holds one times that one's pieces. Texts are read in blocks: a block has its
distinct pre-tokens and, packed, how often each document holds which. Its pre-tokens lie
in SLICES by their hash; the like slices of all blocks meet in one task, which counts
the pieces of each distinct pre-token once, and each block's slice gets the counts back,
to be summed with the frequencies of each document. A slice holds its share of the
distinct pre-tokens of all texts, and no id is ever made into a column.

The vocabulary's own pre-tokenizer cuts the texts. As its rule never crosses the place
before one white space that something else follows, that runs once for each distinct
run of characters of a block, not for each place.

Vocabularies are ``.json`` files of tokenizers with a byte-level pre-tokenizer that adds
no prefix space, and without a normalizer (others raise). Special strings inside a text
are one token each, as the library does by default.

Edge cases: a null or empty text has no token and no byte; a text of any length is read
in slices whose frequencies are added up; rows with equal or null ``doc_id`` are counted
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged
from .tokens import WHITE

#: Characters of text whose pre-tokens are told apart together.
BLOCK = 1 << 24
#: A run: white space and what follows up to the next, or white space but for its last character.
RUN = re.compile(rf"{WHITE}?[\S\x1c-\x1f]+|{WHITE}+(?![\S\x1c-\x1f])")
#: Into how many slices pre-tokens are dealt.
SLICES = 2048
#: Runs whose pre-tokens a worker remembers.
REMEMBERED = 500_000


class Cutter:
    """Pre-tokens of texts and pieces of pre-tokens, by the library's own rules."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            rules = json.load(f)
        cut = rules["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        added = rules["added_tokens"]
        if rules["normalizer"] or not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{vocabulary}: not a plain byte-level vocabulary")
        self.cut, self.pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        # longest first, as the library looks for them at each place
        named = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, named))) if named else None
        self.known: dict[str, tuple[str, ...]] = {}

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """How often each run stands in ``text``, and the special strings in it."""
        parts = self.special.split(text) if self.special else [text]
        runs: Counter = Counter()
        for part in parts:
            for piece in _slices(part):
                runs.update(RUN.findall(piece))
        return runs, len(parts) - 1

    def pre_tokens(self, run: str) -> tuple[str, ...]:
        out = self.known.get(run)
        if out is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            out = self.known[run] = tuple(p for p, _ in self.cut(run))
        return out

    def count(self, pre_token: str) -> int:
        return len(self.pieces(pre_token))


@lru_cache(maxsize=1)
def cutter(vocabulary: str) -> Cutter:
    return Cutter(vocabulary)


def _slices(text: str) -> Iterator[str]:
    """``text`` in parts of about BLOCK characters, cut before a run."""
    at = 0
    while len(text) - at > BLOCK:
        cut = _ALONE.search(text, at + BLOCK)
        if cut is None:
            break
        yield text[at : cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


#: A space between two letters: no pre-token reaches across the place before it.
_ALONE = re.compile(r"[a-z] [a-z]")


def _squeezed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _spread(data: pa.Scalar, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data.as_buffer(), 4 * n, codec="zstd"), kind)


BLOCKS = "block long, doc_ids array<long>, n_bytes array<long>, special array<long>, held array<int>, which binary, times binary, slices array<string>"


def blocks(documents: DataFrame, vocabulary: str, size: int = BLOCK) -> DataFrame:
    """A row of BLOCKS for each block of ``documents``: ``held`` is how many distinct
    pre-tokens a document has, ``which`` and ``times`` their places in the block (as steps)
    and their frequencies, document after document, as compressed 32-bit numbers. Places
    go through the ``slices``, each the pre-tokens of one hash, joined by spaces, which a
    byte-level pre-token has none of."""

    def packed_block(number: int, ids: list, sizes: list, special: list, rows: list[tuple[np.ndarray, np.ndarray]], names: dict[str, int]) -> pa.RecordBatch:
        cut = cutter(vocabulary)
        place: dict[str, int] = {}
        parts = [[place.setdefault(p, len(place)) for p in cut.pre_tokens(r)] for r in names]
        held = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter((p for x in parts for p in x), np.int64, int(held.sum()))
        # places slice by slice
        names_ = np.array(list(place), object)
        slice_ = pd.util.hash_array(names_, categorize=False) % np.uint64(SLICES)
        order = np.argsort(slice_, kind="stable")
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        flat = moved[flat]
        ends = np.cumsum(np.bincount(slice_.astype(np.int64), minlength=SLICES))
        slices = [" ".join(x) for x in np.split(names_[order], ends[:-1])]
        start = np.cumsum(held) - held
        doc = np.repeat(np.arange(len(rows)), [len(w) for w, _ in rows])
        runs = np.concatenate([w for w, _ in rows]) if rows else np.zeros(0, np.int64)
        times = np.concatenate([t for _, t in rows]) if rows else np.zeros(0, np.int64)
        # each run of a document as the pre-tokens that it is made of
        n = held[runs]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[runs], n)
        pair, back = np.unique(np.repeat(doc, n) * max(1, len(place)) + flat[at], return_inverse=True)
        total = np.bincount(back, np.repeat(times, n), len(pair)).astype("<u4")
        per_doc = np.bincount(pair // max(1, len(place)), minlength=len(rows))
        which = pair % max(1, len(place))
        # a document's places ascend, and its first is told from the last of the one before
        steps = np.diff(which, prepend=0).astype("<i4")
        values = [[number], [ids], [sizes], [special], [per_doc.tolist()], [_squeezed(steps)], [_squeezed(total)], [slices]]
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cut, number = cutter(vocabulary), TaskContext.get().partitionId() << 32
        ids, sizes, special, rows, names, chars = [], [], [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if rows and chars + len(text) > size:
                    yield packed_block(number, ids, sizes, special, rows, names)
                    ids, sizes, special, rows, names, chars, number = [], [], [], [], {}, 0, number + 1
                runs, strings = cut.frequencies(text)
                known = names.setdefault
                which = np.fromiter((known(r, len(names)) for r in runs), np.int64, len(runs))
                rows.append((which, np.fromiter(runs.values(), np.int64, len(runs))))
                ids.append(doc_id)
                sizes.append(len(text.encode()))
                special.append(strings)
                chars += len(text)
        if rows:
            yield packed_block(number, ids, sizes, special, rows, names)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCKS)


def piece_counts(asked: DataFrame, vocabulary: str) -> DataFrame:
    """block, slice, pieces for each slice of a block (block, slice, names): of each
    pre-token in its order, as 32-bit numbers. A distinct one is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, at, known = cutter(vocabulary), None, {}
        for batch in batches:
            out = []
            for slice_, names in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if slice_ != at:
                    at, known = slice_, {}
                names = names.split(" ")
                for name in names:
                    if name not in known:
                        known[name] = cut.count(name)
                out.append(np.array([known[name] for name in names], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "slice", "pieces"])

    met = asked.repartition("slice").sortWithinPartitions("slice").select("block", "slice", "names")
    return met.mapInArrow(run, "block long, slice int, pieces binary")


def token_counts(documents: DataFrame, vocabulary: str | None = None, limit: int = 1024, size: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    made = staged(blocks(documents, vocabulary, size), "pre-tokens")
    asked = made.select("block", F.posexplode("slices").alias("slice", "names")).where("names <> ''")
    learnt = piece_counts(asked, vocabulary).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("slice", "pieces"))).alias("pieces"))
    learnt = learnt.withColumnRenamed("block", "__block")
    packed = made.select("block", "doc_ids", "n_bytes", "special", "held", "which", "times")
    both = packed.join(learnt, F.col("block") == F.col("__block"), "left").select("doc_ids", "n_bytes", "special", "held", "which", "times", "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, sizes, special, held, which, times, pieces = (batch.column(c)[r] for c in range(7))
                held = held.values.to_numpy()
                n = special.values.to_numpy().copy()
                if pieces.values is not None:
                    known = np.frombuffer(b"".join(pieces.values.field("pieces").to_pylist()), "<u4").astype(np.int64)
                    size = int(held.sum())
                    each = known[np.cumsum(_spread(which, size, "<i4"))] * _spread(times, size, "<u4")
                    upto = np.concatenate([[0], np.cumsum(each)])
                    ends = np.cumsum(held)
                    n += upto[ends] - upto[ends - held]
                yield pa.RecordBatch.from_arrays([ids.values, sizes.values, pa.array(n), pc.greater(pa.array(n), limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
