"""Readers and writers of documents, cards, logs, rosters and profiles."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions import json as J
from caselens.functions import text as X

# Suffixes, encodings in the order tried, weights of mojibake marks.
SUFFIXES = ["pdf", "doc", "docx", "ppt", "pptx", "txt", "md", "html", "htm"]
ENCODINGS = ["utf-8-sig", "utf-8", "gb18030", "gbk", "big5", "utf-16", "utf-16-le", "utf-16-be", "latin-1"]
SAMPLED = ["utf-8-sig", "utf-8", "gb18030", "gbk", "utf-16"]
PENALTIES = {"�": 20, "锟斤拷": 10, "Ã": 5, "Â": 5, "\x00": 5}


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def discover(spark: SparkSession, path: str, suffixes: list[str] = SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """S1. (documents, skipped) among all files below ``path``, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name = F.lower(file_name(F.col("path")))
    hidden = name.isin(".ds_store", "desktop.ini") | name.startswith("._")
    wanted = F.regexp_extract(name, r"\.([^.]+)$", 1).isin(suffixes)
    return files.where(~hidden & wanted), files.where(~hidden & ~wanted)


def pending_inputs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """S16. Inputs (path) without an output of the same stem."""
    stem = F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", "")
    return inputs.withColumn("stem", stem).join(outputs.select(stem.alias("stem")).distinct(), "stem", "left_anti").drop("stem")


def decode(raw: bytes, encodings: list[str] = ENCODINGS) -> tuple[str, str]:
    """S10. (text, encoding): the first that decodes, else that with the least mojibake."""
    for name in encodings:
        try:
            return raw.decode(name), name
        except UnicodeError:
            continue
    tried = [(raw.decode(name, "replace"), name) for name in encodings]
    return min(tried, key=lambda x: sum(x[0].count(mark) * weight for mark, weight in PENALTIES.items()))


def office_text(raw: bytes) -> str:
    """S11. Text nodes of a DOCX body or of PPTX slides in name order, a line for each paragraph."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [n for n in z.namelist() if n == "word/document.xml"] or sorted(n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n))
        lines = []
        for n in names:
            for p in ElementTree.fromstring(z.read(n)).iter():
                if p.tag.endswith("}p"):
                    line = "".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")).strip()
                    if line:
                        lines.append(line)
        return "\n".join(lines)


def legacy_text(raw: bytes) -> str:
    """S13. Runs of at least six printable ASCII characters."""
    return "\n".join(x.decode() for x in re.findall(rb"[\x20-\x7e]{6,}", raw))


def unreadable(raw: bytes) -> bool:
    """P10. Empty, too many NUL bytes, or neither text in any encoding nor printable."""
    if not raw:
        return True
    head = raw[:4096]
    if head.count(0) / len(head) > 0.2:
        return True
    for name in SAMPLED:
        try:
            if sum(ch.isalnum() for ch in head.decode(name)) >= 8:
                return False
        except UnicodeError:
            continue
    return sum(32 <= b < 127 or b in (9, 10, 13) for b in head) / len(head) < 0.15


def _extracted(path: str, raw: bytes) -> tuple[str | None, str | None, str | None]:
    suffix = path.rsplit(".", 1)[-1].lower()
    try:
        if suffix in ("docx", "pptx"):
            return office_text(raw), suffix, None
        if suffix in ("doc", "ppt"):
            return legacy_text(raw), "ascii", None
        if unreadable(raw):
            return None, None, "unreadable"
        return *decode(raw), None
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
        return None, None, type(e).__name__


def extracted(files: DataFrame) -> DataFrame:
    """S10, S11, S13, P10. path, text, encoding, error of each of ``files`` (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                text, encoding, error = _extracted(name, raw)
                yield pa.RecordBatch.from_pydict({"path": [name], "text": pa.array([text], pa.string()), "encoding": pa.array([encoding], pa.string()), "error": pa.array([error], pa.string())})

    rows = files.select("path", "content").mapInArrow(run, "path string, text string, encoding string, error string")
    return rows.withColumn("text", F.when(F.lower("path").rlike(r"\.html?$"), X.html_text(F.col("text"))).otherwise(F.col("text")))


def read_documents(spark: SparkSession, path: str, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """path, text, encoding, error of every document below ``path``.

    HTML is reduced to its text with functions afterwards (S12).
    """
    glob = "*.{" + ",".join(suffixes) + "}"
    return extracted(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path))


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """S4. Cards from Markdown with front matter (flat values, inline lists); where
    a folder has none, from JSON."""
    md = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown}").text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    if not md.isEmpty():
        head = F.regexp_extract("value", r"(?s)^\s*---\s*\n(.*?)\n---", 1)
        one = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{k}\s*:\s*(.*)$", 1), "^[\"']|[\"']$", "")), F.lit(""))
        many = lambda k: X.trimmed(F.transform(F.split(F.regexp_replace(F.coalesce(one(k), F.lit("")), r"^\[|\]$", ""), ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")))
        body = F.regexp_replace("value", r"(?s)^\s*---\s*\n.*?\n---\s*|\s+$", "")
        stem = F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", "")
        return md.select(
            F.coalesce(one("card_id"), one("id"), stem).alias("card_id"), F.coalesce(one("name"), one("title"), stem).alias("name"), one("type").alias("type"), one("industry").alias("industry"),
            *(many(k).alias(k) for k in ("tags", "labels", "applicable_scenarios", "related_concepts", "rule_ids")), F.coalesce(one("description"), body).alias("description"), body.alias("text"),
        )
    schema = "card_id string, id string, name string, title string, type string, industry string, tags array<string>, labels array<string>, applicable_scenarios array<string>, related_concepts array<string>, rule_ids array<string>, rule_id string, description string"
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    empty = F.array().cast("array<string>")
    lists = lambda k: F.coalesce(k, empty).alias(k)
    return raw.where(F.coalesce("card_id", "id", "name").isNotNull()).select(
        F.coalesce("card_id", "id", "name").alias("card_id"), F.coalesce("name", "title", "card_id", "id").alias("name"), "type", "industry", *(lists(k) for k in ("tags", "labels", "applicable_scenarios", "related_concepts")),
        F.coalesce("rule_ids", F.when(F.col("rule_id").isNotNull(), F.array("rule_id")), empty).alias("rule_ids"), "description", F.col("description").alias("text"),
    )


def searchable(cards: DataFrame) -> DataFrame:
    """S5. card_id, title, summary (180 characters), text (normalised) of each card."""
    whole = F.concat_ws(" ", "name", "description", F.array_join("tags", " "), F.array_join("labels", " "), "text")
    return cards.select("card_id", F.col("name").alias("title"), F.substring(X.collapse(F.coalesce("description", "text")), 1, 180).alias("summary"), X.search_norm(whole).alias("text"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """S6, F12. The interaction table with ``rules``: the ids in its JSON column."""
    return spark.read.parquet(path).withColumn("rules", J.triggered_rules(F.col("triggered_rules"))).withColumn("class_name", F.lit("默认班级"))


def read_behaviour(spark: SparkSession, path: str) -> DataFrame:
    """S7. level, source_path, message, details (JSON text) of a JSONL log; lines
    that are no object are dropped."""
    lines = spark.read.text(path).where(F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull())
    get = lambda k: F.get_json_object("value", f"$.{k}").alias(k)
    return lines.select(get("level"), get("source_path"), get("message"), get("details"))


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """S8. uid, name, role, class_id of a CSV with either header; rows without uid go."""
    raw = spark.read.option("header", True).csv(path)
    names = {"uid": ["uid", "学号"], "name": ["name", "姓名"], "role": ["role"], "class_id": ["class_id", "班级"]}
    pick = lambda out, given: F.coalesce(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in given if c in raw.columns), F.lit(None)).alias(out)
    return raw.select(*(pick(o, g) for o, g in names.items())).where("uid IS NOT NULL").withColumn("role", F.coalesce("role", F.lit("student")))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """S9. Profiles of a folder; files that cannot be read are dropped."""
    schema = "user_id string, name string, role string, scores array<double>, projects array<string>, grade string, major string, interests array<string>"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).where("user_id IS NOT NULL")


def write_cards(cards: DataFrame, path: str) -> None:
    """S14. Cards as JSON by industry and type, the file name as a column."""
    cards.write.mode("append").partitionBy("industry", "type").json(path)


def write_failures(rows: DataFrame, path: str) -> None:
    """S15. Rows with an error, appended as JSON lines."""
    rows.where("error IS NOT NULL").select("path", "error", F.current_timestamp().alias("at")).write.mode("append").json(path)


def add_members(members: DataFrame, new: DataFrame) -> DataFrame:
    """S19. Members that a project does not have yet are added; who is there stays as is."""
    fresh = new.dropDuplicates(["project_id", "user_id"]).join(members, ["project_id", "user_id"], "left_anti")
    return members.unionByName(fresh.select(*members.columns))


def overwrite_scores(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """S19. ``projects`` (project_id, scores) with the scores of the last change (project_id,
    scores, seq) of each; a change of an unknown project is ignored."""
    last = changes.groupBy("project_id").agg(F.max_by(F.struct("scores"), "seq").alias("last"))
    joined = projects.join(last, "project_id", "left")
    return joined.withColumn("scores", F.when(F.col("last").isNull(), F.col("scores")).otherwise(F.col("last.scores"))).drop("last")


def append_log(rows: DataFrame, path: str) -> None:
    """S18."""
    rows.write.mode("append").parquet(path)
