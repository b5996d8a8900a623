"""Phrase collocations by the stripes pattern.

The stripe of a word is an associative counter: what follows the word, up to
``max_words - 1`` words of the same piece, and how often. Each block of texts makes
one stripe for each of its words; the stripes of a word are merged elementwise. A
merged stripe gives, by sums over its own entries, the word's total, the counts of
all phrases that begin with the word, and with them the extensions of each prefix:
the maxima that decide whether a phrase is subsumed are taken over those counts.

A word that stands more often than ``MOST`` times has its stripe dealt by a hash of
the whole entry into as many sub-stripes as hold about ``MOST`` each, so no merge
sees more of a word, and the sub-stripes' sums are added afterwards. At most
``10**6`` words can be so frequent, as ``MOST`` grows with the corpus from then on,
and the sort of a partition streams: one stripe at a time is held.

Words are compared as strings throughout; arithmetic is on decimals of 38 digits.

Edge cases: a null ``lang`` is ``und``, an empty one a language of its own; a null
or empty text has no words; a piece shorter than a phrase adds to its shorter
phrases only; a text of any length is cut at separators into blocks (one piece is
never cut); repeated rows count as often as they stand; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged

#: Fixed values of the contract: what ends a piece, and white space between words.
SEPARATORS, WHITE = b".,;:!?\n\x0b\x0c\r", b"\x20\x09"
#: Bytes of text that make stripes together.
BLOCK = 1 << 23
#: Occurrences of a word from which its stripe is dealt into sub-stripes, and the most words that can have so many.
MOST, HOT_WORDS = 1 << 18, 10**6

_FOLD = bytearray(range(256))
for _b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_b] = _b + 32
for _b in SEPARATORS:
    _FOLD[_b] = 10
for _b in WHITE:
    _FOLD[_b] = 32
_FOLD = bytes(_FOLD)

STRIPE = "lang string, word string, entries string, counts array<long>, total long"


def _coded(data: bytes) -> tuple[np.ndarray, pa.Array]:
    """The words of folded text as codes from 1, 0 at the ends of pieces, and the words of the codes."""
    # a split is an Arrow array, so no word becomes a Python object
    flat = pc.split_pattern(pa.array([data.replace(b"\n", b" \n ")], pa.large_binary()), " ").flatten().dictionary_encode()
    names = pa.concat_arrays([pa.array([b"", b"\n"], pa.large_binary()), flat.dictionary]).dictionary_encode()
    code = names.indices.to_numpy()[2:][flat.indices.to_numpy()]
    code = code[code != 0]
    return code - 1, pa.concat_arrays([pa.array([b""], pa.large_binary()), names.dictionary[2:]]).cast(pa.binary()).view(pa.string())


def counted(columns: list[np.ndarray], kinds: int, weights: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each further column, the distinct prefixes up to it in order: the place of each in
    the level before (the value itself of the first column), its last code, and its count."""
    ids, levels = columns[0].astype(np.int64), []
    for column in columns[1:]:
        distinct, ids = np.unique(ids * kinds + column, return_inverse=True)
        levels.append((distinct // kinds, distinct % kinds))
    n = np.bincount(ids, weights, len(levels[-1][0])).astype(np.int64)
    out = []
    for parent, code in reversed(levels):
        out.append((parent, code, n))
        n = np.bincount(parent, n).astype(np.int64)
    return out[::-1]


def _joined(values: pa.Array, starts: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values), " ")


def block_stripes(lang: str, data: bytes, max_words: int) -> pa.RecordBatch:
    """A stripe for each distinct word of ``data``: its entries are ``max_words - 1`` words
    each, empty ones after a piece's end, all joined by spaces, with a count for each."""
    code, words = _coded(data)
    columns = [code]
    for k in range(1, max_words):
        after = np.concatenate([code[k:], np.zeros(min(k, len(code)), code.dtype)])
        columns.append(np.where(columns[-1] == 0, 0, after))
    inside = code != 0
    levels = counted([c[inside] for c in columns], len(words))
    entry = np.empty((len(levels[-1][0]), max_words - 1), np.int64)
    at = np.arange(len(entry))
    for k in range(max_words - 2, -1, -1):
        entry[:, k] = levels[k][1][at]
        at = levels[k][0][at]
    # the levels are in order, so a word's entries lie together
    first, starts = np.unique(at, return_index=True)
    ends = np.append(starts, len(entry)).astype(np.int64)
    counts = levels[-1][2]
    entries = _joined(words.take(pa.array(entry.ravel())), ends * (max_words - 1))
    totals = np.add.reduceat(counts, starts) if len(starts) else counts
    values = [pa.array([lang] * len(first), pa.string()), words.take(pa.array(first)), entries, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts)), pa.array(totals)]
    return pa.RecordBatch.from_arrays(values, names=[c.split()[0] for c in STRIPE.split(", ")])


def _cut(data: bytes, block: int) -> Iterator[bytes]:
    """``data`` in parts of about ``block`` bytes that end where a piece ends."""
    at = 0
    while at < len(data):
        to = data.find(b"\n", at + block) + 1 or len(data)
        yield data[at:to]
        at = to


def stripes(documents: DataFrame, max_words: int, block: int = BLOCK) -> DataFrame:
    """The stripes of every block of texts: STRIPE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                for part in _cut(b"\n".join(texts), block):
                    yield block_stripes(lang, part, max_words)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                folded = memoryview(text.as_buffer()).tobytes().translate(_FOLD)
                if size and size + len(folded) > block:
                    yield from flush()
                    held, size = {}, 0
                held.setdefault(lang, []).append(folded)
                size += len(folded)
        yield from flush()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text")).mapInArrow(run, STRIPE)


def _divided(stripes_: DataFrame, max_words: int) -> DataFrame:
    """Stripes with ``parts`` above 1 as that many sub-stripes (``part``), each entry in that of its hash."""
    width = max_words - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, word, entries, counts, parts = (batch.column(c) for c in ("lang", "word", "entries", "counts", "parts"))
            keep = pc.equal(parts, 1)
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (lang, word, entries, counts, parts)] + [pa.array(np.zeros(pc.sum(keep).as_py() or 0, np.int32))], names=names)
            for r in np.flatnonzero(~keep.to_numpy(zero_copy_only=False)).tolist():
                words = pc.split_pattern(entries[r : r + 1], " ").flatten()
                shown = _joined(words, np.arange(0, len(words) + 1, width))
                part = pd.util.hash_array(shown.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(parts[r].as_py())
                order = np.argsort(part, kind="stable")
                held, starts = np.unique(part[order], return_index=True)
                ends = np.append(starts, len(order))
                k = len(held)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang[r].as_py()] * k, pa.string()), pa.array([word[r].as_py()] * k, pa.string()), _joined(shown.take(pa.array(order)), ends),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), counts[r].values.take(pa.array(order))), pa.array([parts[r].as_py()] * k, pa.int32()), pa.array(held.astype(np.int32)),
                    ],
                    names=names,
                )

    names = ["lang", "word", "entries", "counts", "parts", "part"]
    return stripes_.select(*names[:5]).mapInArrow(run, "lang string, word string, entries string, counts array<long>, parts int, part int")


def merged(divided: DataFrame, max_words: int, least: int) -> DataFrame:
    """lang, phrase, words, n: the counts that the merged stripes hold, of phrases that stand
    ``least`` times or more; those of a sub-stripe are parts of a sum."""
    width = max_words - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the stripe that the next batch may go on with
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            if rows.num_rows:
                done, held = _merge(rows)
                yield done
        if held is not None:
            yield _phrases(held)

    def _merge(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """Phrases of all stripes but the last, and the last one merged."""
        key = [c.to_numpy(zero_copy_only=False) for c in (rows.column("lang").dictionary_encode().indices, rows.column("word").dictionary_encode().indices, rows.column("part"))]
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)])
        last = int(np.flatnonzero(new)[-1])
        tail = rows.slice(last)
        if tail.num_rows > 1:
            levels, words, _ = _levels(tail, np.zeros(tail.num_rows, np.int64))
            entry, at = np.empty((len(levels[-1][0]), width), np.int64), np.arange(len(levels[-1][0]))
            for k in range(width - 1, -1, -1):
                entry[:, k], at = levels[k][1][at], levels[k][0][at]
            whole = [_joined(words.take(pa.array(entry.ravel())), np.array([0, entry.size])), pa.ListArray.from_arrays(pa.array([0, len(entry)], pa.int32()), pa.array(levels[-1][2]))]
            values = [tail.column(0)[:1], tail.column(1)[:1], *whole, tail.column(4)[:1], tail.column(5)[:1]]
            tail = pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, tail.schema)], schema=tail.schema)
        return _phrases(rows.slice(0, last), new[:last]), tail

    def _levels(rows: pa.RecordBatch, group: np.ndarray) -> tuple[list, pa.Array, np.ndarray]:
        flat = pc.split_pattern(rows.column("entries"), " ").flatten().dictionary_encode()
        code = flat.indices.to_numpy().reshape(-1, width)
        counts = rows.column("counts")
        held = np.diff(counts.offsets.to_numpy())
        levels = counted([np.repeat(group, held), *code.T], len(flat.dictionary), counts.flatten().to_numpy())
        return levels, flat.dictionary, held

    def _phrases(rows: pa.RecordBatch, new: np.ndarray | None = None) -> pa.RecordBatch:
        if not rows.num_rows:
            return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.int64())], names=["lang", "phrase", "words", "n"])
        new = np.ones(1, bool) if new is None else new
        levels, words, _ = _levels(rows, np.cumsum(new) - 1)
        heads = rows.filter(pa.array(new))
        partial = heads.column("parts").to_numpy() > 1
        total = np.bincount(levels[0][0], levels[0][2], len(partial)).astype(np.int64)
        end = pc.index(words, "").as_py()
        kept = np.flatnonzero(partial | (total >= least))
        phrase, lang, out = heads.column("word").take(pa.array(kept)), heads.column("lang").take(pa.array(kept)), []
        out.append((lang, phrase, np.ones(len(kept), np.int32), total[kept]))
        place = np.full(len(total), -1)
        place[kept] = np.arange(len(kept))
        for k, (parent, code, n) in enumerate(levels):
            # whole entries of a sub-stripe are counted in full, shorter phrases in part
            few = n < least if k == width - 1 else ~partial[_top(levels, k)] & (n < least)
            kept = np.flatnonzero(~few & (code != end) & (place[parent] >= 0))
            above = pa.array(place[parent[kept]])
            phrase = pc.binary_join_element_wise(phrase.take(above), words.take(pa.array(code[kept])), " ")
            lang = lang.take(above)
            out.append((lang, phrase, np.full(len(kept), k + 2, np.int32), n[kept]))
            place = np.full(len(n), -1)
            place[kept] = np.arange(len(kept))
        values = [pa.concat_arrays([x[0] for x in out]), pa.concat_arrays([x[1] for x in out]), pa.array(np.concatenate([x[2] for x in out])), pa.array(np.concatenate([x[3] for x in out]))]
        return pa.RecordBatch.from_arrays(values, names=["lang", "phrase", "words", "n"])

    def _top(levels: list, k: int) -> np.ndarray:
        """The stripe of each prefix of level ``k``."""
        at = levels[k][0]
        for j in range(k - 1, -1, -1):
            at = levels[j][0][at]
        return at

    n = int(divided.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = divided.repartition(n, "lang", "word", "part").sortWithinPartitions("lang", "word", "part")
    return ordered.mapInArrow(run, "lang string, phrase string, words int, n long")


def phrase_counts(documents: DataFrame, max_words: int = 3, least: int = 10, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of 1 to ``max_words`` words that stand ``least``
    times or more, and (lang, n), the words of each language; both written tables."""
    made = staged(stripes(documents, max_words, block), "stripes")
    words = made.groupBy("lang", "word").agg(F.sum("total").alias("n"))
    sizes = staged(made.groupBy("lang").agg(F.sum("total").alias("n")), "lang-words")
    most = max(MOST, (sizes.agg(F.sum("n")).first()[0] or 0) // HOT_WORDS)
    # words with more than a millionth of all occurrences: at most a million rows
    hot = words.where(F.col("n") > most).select(F.col("lang").alias("__lang"), F.col("word").alias("__word"), F.ceil(F.col("n") / most).cast("int").alias("__parts"))
    parts = made.join(F.broadcast(hot), (F.col("lang") == F.col("__lang")) & (F.col("word") == F.col("__word")), "left").withColumn("parts", F.coalesce("__parts", F.lit(1)))
    sums = merged(_divided(parts, max_words), max_words, least).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return staged(sums.where(F.col("n") >= least), "phrases"), sizes


def collocations(documents: DataFrame, max_words: int = 3, least: int = 10, top: int = 2000, share: int = 50, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language.

    A phrase of 2 to ``max_words`` words scores by its weakest cut, and goes if a longer
    candidate around it stands ``share`` percent as often: one word longer is enough to
    look at, as every longer one holds such a one that stands no less often.
    """
    counts, sizes = phrase_counts(documents, max_words, least, block)
    candidates = counts.where("words > 1")
    cut = candidates.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - words)").alias("rest"))
    for side, name in (("first", "l"), ("rest", "r")):
        known = counts.select(F.col("lang").alias("__lang"), F.col("phrase").alias("__phrase"), F.col("n").alias(name))
        cut = cut.join(known, (F.col("lang") == F.col("__lang")) & (F.col(side) == F.col("__phrase"))).drop("__lang", "__phrase")
    wide = lambda c: f"cast({c} as decimal(16, 0))"
    score = F.expr(f"cast({wide('a')} * {wide('a')} * 1000000 as decimal(38, 0)) div cast({wide('l')} * {wide('r')} as decimal(38, 0))")
    weakest = cut.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"), F.first("a").alias("a"))
    inner = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))
    around = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    around = around.select(F.col("lang").alias("__lang"), F.col("phrase").alias("__phrase"), "most")
    kept = weakest.join(around, (F.col("lang") == F.col("__lang")) & (F.col("phrase") == F.col("__phrase")), "left")
    kept = kept.where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    # the first ones of each slice of a language, then of the language
    slices = kept.withColumn("slice", F.pmod(F.hash("phrase"), F.lit(64)))
    few = slices.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes.select(F.col("lang").alias("__lang"), F.col("n")), F.col("lang") == F.col("__lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
