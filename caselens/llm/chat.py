"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every turn becomes one marked segment, ``<|turn|>role\\ntext<|end|>\\n``; a
conversation's segments in order are its stream. Every assistant turn becomes an
example of its own: all segments before it are the prompt, its escaped text is
the completion, and only that is trainable.

Escaping is reversible: a backslash is doubled, and a backslash goes after the
first character of every control string, so none is left inside a text; reading
back drops the backslash before any character.

An example is written with its whole context: all turns before, and the head of its
own. A context is cut into pieces in order, of less than three times PIECE characters,
and is one row where it is shorter, so that no row grows with a conversation. The
contexts of a conversation together take the square of its length; where that is not
wanted, ``write_chats(..., contexts=False)`` names each by its length in the stream,
and ``prompts`` writes out those of the examples that it is given.
Offsets are sums over blocks of turns, then inside a block, so a conversation of
any number of turns is never collected.

Edge cases: a null text or role is empty; a null ``turn`` comes first; rows with
equal turns are ordered by role and text; a null ``conv_id`` is a conversation; a
conversation without an assistant turn has a stream and no example; an empty table
gives empty outputs; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import scratch_path

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|>\n", "<|end|>\n"
#: Control strings of common chat templates. ``<|`` begins all of ours.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: Turns whose offsets are summed together.
BLOCK = 64
#: Characters of a stream in which the segments of a piece begin, and examples of a conversation that meet a copy of it.
PIECE, READERS = 1 << 15, 256


def escaped(text: Column) -> Column:
    after_first = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in CONTROL)
    return F.regexp_replace(text, rf"\\|{after_first}", r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "|[]<>/" else c for c in s)


def _null_first(name: str) -> Column:
    return F.col(name).asc_nulls_first()


def segments(conversations: DataFrame) -> DataFrame:
    """conv_id, ordinal (from 0), role, text (escaped), segment, at (characters
    of the stream before it): a row for each turn."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), escaped(empty("text")).alias("text"))
    turns = turns.withColumn("segment", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE), F.col("text"), F.lit(CLOSE)))
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy(_null_first("turn"), "role", "text")
    length = F.length("segment").cast("long")
    local = turns.withColumn("ordinal", F.row_number().over(inside) - 1).withColumn("at", F.sum(length).over(inside) - length)
    totals = turns.groupBy("conv_id", "block").agg(F.count("*").alias("held"), F.sum(length).alias("chars"))
    across = Window.partitionBy("conv_id").orderBy(_null_first("block"))
    totals = totals.select(
        F.col("conv_id").alias("__conv"), F.col("block").alias("__block"),
        (F.sum("held").over(across) - F.col("held")).alias("turns_before"), (F.sum("chars").over(across) - F.col("chars")).alias("chars_before"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("block").eqNullSafe(F.col("__block"))
    return local.join(totals, same).select(
        "conv_id", (F.col("ordinal") + F.col("turns_before")).cast("long").alias("ordinal"), "role", "text", "segment", (F.col("at") + F.col("chars_before")).alias("at")
    )


def head_chars() -> Column:
    """Characters of a segment before its text."""
    return F.instr("segment", MIDDLE) + len(MIDDLE) - 1


def examples(stream: DataFrame) -> DataFrame:
    """conv_id, ordinal, context_chars, completion (escaped): a row for each assistant turn."""
    return stream.where("role = 'assistant'").select("conv_id", "ordinal", (F.col("at") + head_chars()).alias("context_chars"), F.col("text").alias("completion"))


def prompts(chosen: DataFrame, stream: DataFrame) -> DataFrame:
    """``chosen`` examples with ``prompt``, written out from the segments before each."""
    s = stream.select(F.col("conv_id").alias("__conv"), F.col("at").alias("__at"), "segment")
    pieces = chosen.join(s, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("__at") < F.col("context_chars")))
    whole = pieces.groupBy(*chosen.columns).agg(F.array_sort(F.collect_list(F.struct("__at", "segment"))).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["segment"]), "")
    return whole.withColumn("prompt", F.substring(text, F.lit(1), F.col("context_chars").cast("int"))).drop("pieces")


def pieces(stream: DataFrame) -> DataFrame:
    """conv_id, piece, begin, body: the stream in runs of whole segments, a long segment in parts of its own.

    The last part of a segment has at least PIECE characters, so it holds the whole closing string.
    """
    parts = F.greatest(F.floor(F.length("segment") / PIECE), F.lit(1))
    cut = stream.select("conv_id", "at", "segment", parts.alias("parts"), F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part"))
    size = F.when(F.col("part") == F.col("parts") - 1, F.length("segment")).otherwise(PIECE).cast("int")
    cut = cut.select("conv_id", (F.col("at") + F.col("part") * PIECE).alias("at"), F.col("segment").substr(F.col("part") * PIECE + 1, size).alias("segment"))
    whole = cut.groupBy("conv_id", F.floor(F.col("at") / PIECE).alias("piece")).agg(F.min("at").alias("begin"), F.array_sort(F.collect_list(F.struct("at", "segment"))).alias("held"))
    return whole.select("conv_id", "piece", "begin", F.array_join(F.transform("held", lambda x: x["segment"]), "").alias("body"))


def written(stream: DataFrame) -> DataFrame:
    """conv_id, ordinal, piece, context, completion: the rows of an example in order of ``piece``
    have its context; the last has the completion (escaped), the others null.

    A piece is copied once for each READERS turns behind it, so that a join key has at
    most READERS examples, however long the conversation.
    """
    last = F.floor(F.col("at") / PIECE)
    made = stream.where("role = 'assistant'").select(
        F.col("conv_id").alias("__conv"), "ordinal", (F.col("at") + head_chars()).alias("context_chars"), F.col("text").alias("completion"), last.alias("last"),
        F.floor(F.col("ordinal") / READERS).alias("__readers"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("__piece"),
    )
    turns = stream.groupBy(F.col("conv_id").alias("__of")).agg(F.floor(F.max("ordinal") / READERS).alias("groups"))
    single = pieces(stream).join(turns, F.col("conv_id").eqNullSafe(F.col("__of")))
    copied = single.select("conv_id", "piece", "begin", "body", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups"))).alias("readers"))
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("piece") == F.col("__piece")) & (F.col("readers") == F.col("__readers"))
    ends = F.col("piece") == F.col("last")
    context = F.when(ends, F.col("body").substr(F.lit(1), (F.col("context_chars") - F.col("begin")).cast("int"))).otherwise(F.col("body"))
    return made.join(copied, same).select("conv_id", "ordinal", "piece", context.alias("context"), F.when(ends, F.col("completion")).alias("completion"))


def write_chats(conversations: DataFrame, path: str | None = None, contexts: bool = True) -> str:
    """Write ``stream`` and ``examples`` under one folder; return its path.

    The examples come from the written stream, with their contexts written out or named by their lengths.
    """
    spark = conversations.sparkSession
    path = path or scratch_path(spark, "chats")
    segments(conversations).select("conv_id", "ordinal", "segment", "at").write.parquet(f"{path}/stream")
    stream = parse(spark.read.parquet(f"{path}/stream"))
    (written(stream) if contexts else examples(stream)).write.parquet(f"{path}/examples")
    return path


def parse(stream: DataFrame) -> DataFrame:
    """The segments of a written stream with their role (unescaped) and text (escaped)."""
    body = F.col("segment").substr(F.lit(len(OPEN) + 1), F.length("segment") - (len(OPEN) + len(CLOSE)))
    middle = F.instr(body, MIDDLE)
    role, text = body.substr(F.lit(1), middle - 1), body.substr(middle + len(MIDDLE), F.length(body))
    return stream.withColumn("role", unescaped(role)).withColumn("text", text)


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, and, summed
    over its examples, context_turns and context_chars; all read from the files.

    Contexts are counted as they are written: their characters, and the closed turns in them.
    A context that is named by its length has the turns of the stream before the segment whose head ends there.
    A digest needs its conversation's whole text as one value: turns are joined in
    blocks of BLOCK first, so that a long conversation brings few rows together.
    """
    stream = parse(spark.read.parquet(f"{path}/stream"))
    shown = F.concat("role", F.lit("\n"), unescaped(F.col("text")), F.lit("\n"))

    def joined(rows: DataFrame, value: Column) -> DataFrame:
        rows = rows.select("conv_id", F.floor(F.col("ordinal") / BLOCK).alias("block"), F.struct("ordinal", value.alias("v")).alias("x"), *[c for c in ("chars",) if c in rows.columns])
        texts = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"]), "")
        n = F.sum("chars") if "chars" in rows.columns else F.lit(0)
        blocks = rows.groupBy("conv_id", "block").agg(texts("x").alias("v"), F.count("*").alias("n"), n.alias("chars"))
        return blocks.select("conv_id", F.struct("block", "v").alias("x"), "n", "chars").groupBy("conv_id").agg(texts("x").alias("whole"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))

    turns = joined(stream.withColumn("chars", F.length("segment").cast("long")), shown)
    made = spark.read.parquet(f"{path}/examples")
    full = "context" in made.columns
    loss = joined(made.where("completion IS NOT NULL"), unescaped(F.col("completion")))
    loss = loss.select(F.col("conv_id").alias("__conv"), F.col("whole").alias("loss"))
    if full:
        closed = F.regexp_count("context", F.lit(_quoted(CLOSE))).cast("long")
        read = made.select(F.col("conv_id").alias("__conv"), closed.alias("turns_before"), F.length("context").cast("long").alias("context_chars"))
    else:
        ends = stream.select(F.col("conv_id").alias("__conv"), F.col("ordinal").alias("turns_before"), (F.col("at") + head_chars()).alias("__end"))
        read = made.join(ends, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("context_chars") == F.col("__end")))
    contexts = read.groupBy(F.col("__conv").alias("__of")).agg(F.sum("turns_before").alias("context_turns"), F.sum("context_chars").alias("context_chars"))
    rows = turns.join(loss, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").withColumn("loss", F.coalesce("loss", F.lit("")))
    rows = rows.join(contexts, F.col("conv_id").eqNullSafe(F.col("__of")), "left")
    return rows.select(
        "conv_id", F.col("n").alias("n_turns"), F.sha2(F.encode("whole", "UTF-8"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"),
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("context_turns", "context_chars")),
    )
