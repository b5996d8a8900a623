"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A window starts at each line and ends with the line in which it reaches
``min_words`` words; what ends sooner is no window. The least line hash of a
window (the last of equals) is its fingerprint: equal windows select equal minima,
so two texts that share a run of lines with a window in it share a fingerprint.
Fingerprint values that occur at one place only are dropped. The positions of the
others are joined: by fingerprint and content, each window with the first place
that has it, so that a fingerprint of any number of places gives a row for each.

A match is then extended both ways, line by line. Before it, a line belongs to the
match if the window that starts there has an earlier place. After it, a line does
if the window that ends there, going back until it has ``min_words`` words, has
one; those windows are made only for lines in a match and the words after it.

So a line goes if and only if it lies in a run of lines with ``min_words`` words
or more that stands earlier: in an earlier document, or earlier in its own without
overlap. Order is doc_id (null first), then the text's hash, then the row, then
the line. The first occurrence always stays.

Edge cases: null stays null and an empty text empty; lines without a word belong
to no window and stay unless a deleted run surrounds them; repeated rows are
copies of which one stays whole; an empty table gives an empty result; extra
columns pass untouched, but for one called ``removed_runs``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE_WORD, packed, staged

#: Parts into which the rows of one value are split where they meet the value's first place.
SALTS = 16


def line_rows(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, uid, pos, ordinal, words, h, h2 and the words of the text
    ``before`` and up to ``after`` each line with a word."""
    lines = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "uid", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    words = F.regexp_count("line", F.lit(SPACE_WORD))
    rows = lines.select("doc_id", "text_hash", "uid", "pos", words.alias("words"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))
    running = Window.partitionBy("uid").orderBy("pos")
    rows = rows.where("words > 0").withColumn("ordinal", F.row_number().over(running)).withColumn("after", F.sum("words").over(running))
    return rows.withColumn("before", F.col("after") - F.col("words"))


def _content(frame: Window) -> list[Column]:
    """A 128-bit hash of the lines in ``frame``."""
    lines = F.collect_list(F.struct("h", "h2")).over(frame)
    return [F.xxhash64(lines).alias("gram"), F.xxhash64(F.lit(1), lines).alias("gram2")]


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """doc_id, text_hash, uid, first, last, mark (the fingerprint), mark_at, gram, gram2: a row for each window."""
    # the lines that begin within the next min_words words
    frame = Window.partitionBy("uid").orderBy("before").rangeBetween(0, min_words - 1)
    least = F.min(F.struct("h", (-F.col("pos")).alias("back"))).over(frame)
    rows = lines.select(
        "doc_id", "text_hash", "uid", F.col("pos").alias("first"), F.max("pos").over(frame).alias("last"),
        F.sum("words").over(frame).alias("held"), least.alias("least"), *_content(frame),
    )
    rows = rows.where(F.col("held") >= min_words).withColumn("mark", F.col("least.h")).withColumn("mark_at", -F.col("least.back"))
    return rows.drop("held", "least")


def end_windows(lines: DataFrame, min_words: int) -> DataFrame:
    """As ``windows``, without fingerprints: those that end at each of ``lines``, all of whose lines are there."""
    # the lines after which come less than min_words words up to this one
    frame = Window.partitionBy("uid").orderBy("after").rangeBetween(-(min_words - 1), 0)
    rows = lines.select(
        "doc_id", "text_hash", "uid", F.min("pos").over(frame).alias("first"), F.col("pos").alias("last"), F.sum("words").over(frame).alias("held"),
        (F.count("*").over(frame) == F.col("ordinal") - F.min("ordinal").over(frame) + 1).alias("whole"), *_content(frame),
    )
    return rows.where(F.col("whole") & (F.col("held") >= min_words)).drop("held", "whole")


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("uid", "first"), F.lit(SALTS)))


def _on_all_salts(values: DataFrame) -> DataFrame:
    return values.withColumn("salt", F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS)))))


def with_first_place(found: DataFrame, keys: list[str]) -> DataFrame:
    """uid, first, last, later of the windows whose ``keys`` stand at two places or
    more; ``later``: the first place is another, and does not overlap it."""
    places = found.groupBy(*keys).agg(F.min(F.struct("doc_id", "text_hash", "uid", "first", "last")).alias("o"), F.count("*").alias("n"))
    joined = _salted(found).join(_on_all_salts(places.where("n > 1").drop("n")), [*keys, "salt"])
    return joined.select("uid", "first", "last", F.expr("uid <> o.uid OR first > o.last").alias("later"))


def merged(spans: DataFrame) -> DataFrame:
    """uid, first, last of the runs that the spans (uid, first, last) make where they overlap or touch."""
    by = Window.partitionBy("uid").orderBy("first")
    reach = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", (reach.isNull() | (F.col("first") > reach + 1)).cast("int")).withColumn("run", F.sum("new").over(by))
    return marked.groupBy("uid", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def match_lines(lines: DataFrame, runs: DataFrame, min_words: int) -> DataFrame:
    """The rows of ``lines`` in a run (uid, first, last) or less than ``min_words`` words after it."""
    starts = runs.select("uid", F.col("first").alias("pos"), F.struct("first", "last").alias("begun"))
    latest = Window.partitionBy("uid").orderBy("pos")
    rows = lines.join(starts, ["uid", "pos"], "left").withColumn("begun", F.last("begun", ignorenulls=True).over(latest)).where("begun IS NOT NULL")
    end = F.max(F.when(F.col("pos") <= F.col("begun.last"), F.col("after"))).over(Window.partitionBy("uid", "begun.first"))
    return rows.withColumn("end", end).where(F.col("before") < F.col("end") + min_words).drop("begun", "end")


def repeated_runs(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """uid, runs (array of first and last line): what is to be deleted."""
    found = staged(windows(line_rows(documents), min_words), "line-windows")
    places = found.groupBy("mark").agg(F.min(F.struct("uid", "mark_at")).alias("a"), F.max(F.struct("uid", "mark_at")).alias("b"))
    near = _salted(found).join(_on_all_salts(places.where("a <> b").select("mark")), ["mark", "salt"], "left_semi").drop("salt")
    matches = staged(with_first_place(near, ["mark", "gram", "gram2"]), "line-matches")
    # extension past the last window of a match
    runs = merged(matches)
    lines = match_lines(line_rows(documents.join(runs.select("uid").distinct(), "uid", "left_semi")), runs, min_words)
    ends = staged(end_windows(lines, min_words), "line-ends")
    gone = merged(matches.union(with_first_place(ends, ["gram", "gram2"])).where("later"))
    return gone.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """``documents`` with ``text`` freed of repeated runs, and ``removed_runs``."""
    rows = staged(packed(documents).withColumn("uid", F.monotonically_increasing_id()), "line-documents")
    runs = repeated_runs(rows.select("doc.doc_id", "uid", "doc.text"), min_words).select(F.col("uid").alias("__uid"), "runs")
    lines = F.split("doc.text", "\n")
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(F.col("runs").isNull(), F.col("doc.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    joined = rows.join(runs, F.col("uid") == F.col("__uid"), "left")
    own = [text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in documents.columns if c != "removed_runs"]
    return joined.select(*own, F.coalesce("runs", F.array().cast("array<struct<first:int,last:int>>")).alias("removed_runs"))
