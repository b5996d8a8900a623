"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text gets integer statistics. Per language and source, every statistic is
summarised by a log-linear bucket histogram: a quantile sketch whose relative
error is at most 1/32 and whose merge is addition of counts, so partial
aggregation on the map side is exact and reruns agree whatever the task order.
Quartiles of the sketches give outer fences (``q3 + k * iqr``), which replace
fixed cutoffs; the fences are joined back to the rows to filter them.

Edge cases: null or empty texts have no words and fail the base rule; null
``lang`` and ``source`` form groups of their own; a group with fewer than
``min_group`` accepted rows takes the fences of its language, and a language
with too few takes those of the whole corpus; repeated rows are judged each; an
empty table gives an empty result. Columns of the input other than
``doc_id, text, lang, source`` are not read by ``judge`` and pass untouched
through ``filter_documents``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import packed, staged

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

#: Statistic -> (fence below, fence above, slack added to a fence). Slack is in
#: the unit of the statistic and keeps groups without spread from rejecting
#: every row that differs at all.
METRICS = {
    "m_word_len": (True, True, 20),  # mean word length, hundredths of a character
    "m_symbols": (False, True, 50),  # symbols for 1000 words
    "m_dup_lines": (False, True, 350),  # repeated lines for 1000 lines
    "m_repeats": (False, True, 300),  # words in repeated windows for 1000 words
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The values of STATS for one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeats = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        seen, covered = Counter(windows), bytearray(len(words))
        for i, x in enumerate(windows):
            if seen[x] > 1:
                covered[i] = covered[i + 1] = covered[i + 2] = 1
        repeats = sum(covered)
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines)


def with_stats(df: DataFrame, inside: str | None = None) -> DataFrame:
    """``df`` and the STATS columns, a row for each row; ``text`` is a column or
    a field of the struct ``inside``."""
    names = STATS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text") if inside is None else batch.column(inside).field("text")
            rows = [text_stats(x.as_py()) for x in texts]
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names, *names]
            )

    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    return df.mapInArrow(run, schema)


def base_failed() -> Column:
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def _metric_columns() -> dict[str, Column]:
    c = F.col
    words, lines = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("n_lines"), F.lit(1))
    whole = lambda up, down: F.floor(up / down).cast("long")
    return {
        "m_word_len": whole(c("word_chars") * 100, words),
        "m_symbols": whole(c("n_symbols") * 1000, words),
        "m_dup_lines": whole(c("n_dup_lines") * 1000, lines),
        "m_repeats": whole(c("n_repeat_words") * 1000, words),
    }


def bucket(value: Column) -> Column:
    """Lower bound of the log-linear bucket of a non-negative integer: exact
    below 64, then 32 buckets for each power of two."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("long")
    return value - value % step


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, value, n): the sketch of each statistic in each
    group, over the rows that pass the base rule. Merge two by summing ``n``."""
    metrics = _metric_columns()
    pairs = F.array(*(F.struct(F.lit(k).alias("metric"), bucket(v).alias("value")) for k, v in metrics.items()))
    return (
        stats.where(~base_failed())
        .select("lang", "source", F.inline(pairs))
        .groupBy("lang", "source", "metric", "value")
        .agg(F.count("*").alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """q1, q3 and the number of rows of each (keys, metric)."""
    merged = sketch.groupBy(*keys, "metric", "value").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(by.orderBy("value"))).withColumn("total", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("value")))
    return ranked.groupBy(*keys, "metric").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("total").alias("total"))


def thresholds(sketch: DataFrame, k: float = 3.0, min_group: int = 50) -> DataFrame:
    """(lang, source, <metric>_low, <metric>_high): a row for each group of the sketch."""
    levels = []
    for keys in (["lang", "source"], ["lang"], []):
        wide = _quartiles(sketch, keys).groupBy(*keys).agg(
            F.max("total").alias("rows"),
            *(
                F.max(F.when(F.col("metric") == m, F.col("q3") + k * (F.col("q3") - F.col("q1")) + slack)).alias(f"{m}_high")
                for m, (_, _, slack) in METRICS.items()
            ),
            *(
                F.max(F.when(F.col("metric") == m, F.col("q1") - k * (F.col("q3") - F.col("q1")) - slack)).alias(f"{m}_low")
                for m, (low, _, slack) in METRICS.items()
                if low
            ),
        )
        levels.append(wide)
    fine, coarse, whole = levels
    limits = [c for c in fine.columns if c.endswith(("_high", "_low"))]
    a, b, c = fine.alias("a"), coarse.alias("b"), whole.alias("c")
    joined = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")), "left").join(F.broadcast(c), F.lit(True), "left")  # c: one row
    pick = lambda n: F.when(F.col("a.rows") >= min_group, F.col(f"a.{n}")).when(F.col("b.rows") >= min_group, F.col(f"b.{n}")).otherwise(F.col(f"c.{n}"))
    return joined.select("a.lang", "a.source", *(pick(n).alias(n) for n in limits))


def _verdict(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """``stats`` with ``__kept``. A hot (lang, source) lies on the side of the
    rows; the other side has one row for each group, so a skewed join can be split."""
    t = limits.withColumnRenamed("lang", "__lang").withColumnRenamed("source", "__source")
    joined = stats.join(t, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    metrics = _metric_columns()
    bad = base_failed()
    for m, (low, high, _) in METRICS.items():
        if high:
            bad = bad | (metrics[m] > F.col(f"{m}_high"))
        if low:
            bad = bad | (metrics[m] < F.col(f"{m}_low"))
    return joined.withColumn("__kept", ~F.coalesce(bad, F.lit(False))).drop(*t.columns)


def judge(documents: DataFrame, k: float = 3.0, min_group: int = 50) -> DataFrame:
    """doc_id, the statistics, base_failed and kept for each row of ``documents``."""
    stats = staged(with_stats(documents.select("doc_id", "lang", "source", "text")).drop("text"), "quality-stats")
    limits = thresholds(staged(sketches(stats), "quality-sketch"), k, min_group)
    return _verdict(stats, limits).select("doc_id", *STATS[:5], base_failed().alias("base_failed"), F.col("__kept").alias("kept"))


def filter_documents(documents: DataFrame, k: float = 3.0, min_group: int = 50) -> DataFrame:
    """The rows of ``documents`` that are kept, with their own columns only.

    The statistics are computed twice, once for the sketches and once beside
    the text, which is cheaper than keeping a second copy of all texts.
    """
    light = with_stats(documents.select("lang", "source", "text")).drop("text")
    limits = thresholds(staged(sketches(light), "quality-sketch"), k, min_group)
    rows = with_stats(packed(documents).select("doc", "doc.lang", "doc.source"), "doc")
    return _verdict(rows, limits).where("__kept").select("doc.*")
