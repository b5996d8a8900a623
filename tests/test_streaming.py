import zipfile
from datetime import datetime

from caselens.plans import streams
from caselens.streaming import jobs


def test_interventions_run_once(spark, tmp_path):
    schema = "id bigint, target_id string, content string, kind string, ts timestamp, seq bigint"
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    rows = [[(1, "a", "x", "insert", None, 1), (2, "a", "y", "insert", None, 2)], [(1, None, None, "execute", None, 3)], [(1, "a", "again", "insert", None, 4)]]
    for batch in rows:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        jobs.interventions(spark.readStream.schema(schema).parquet(src), out, state).awaitTermination()
    got = {r.id: (r.status, r.content) for r in jobs.queue(spark, out).collect()}
    assert got == {1: ("executed", "again"), 2: ("pending", "y")}


def test_file_drop(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, bad, state = (str(tmp_path / x) for x in ("out", "bad", "state"))
    (src / "a.txt").write_text("one")
    (src / "b.bin").write_bytes(b"\xff\xfe\x00")
    jobs.ingest_files(spark, str(src), out, bad, state).awaitTermination()
    (src / "c.txt").write_text("two")
    jobs.ingest_files(spark, str(src), out, bad, state).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["one", "two"] and spark.read.parquet(bad).count() == 1


def test_latest_state(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    assert streams.x4_latest_state(spark, sf_dir).count() == n


def test_file_drop_of_other_formats(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, bad, state = (str(tmp_path / x) for x in ("out", "bad", "state"))
    (src / "a.txt").write_bytes("创业项目的商业模式".encode("gbk"))
    (src / "b.html").write_text("<html><script>x</script><p>plain words</p></html>")
    with zipfile.ZipFile(src / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="urn:w"><w:p><w:t>office words</w:t></w:p></w:document>')
    (src / "d.docx").write_bytes(b"no archive")
    (src / "e.doc").write_bytes(b"\x00\x01legacy words\x00\x02")
    (src / "f.txt").write_bytes(b"")
    (src / "g.txt").write_bytes(b"\x00" * 20)
    jobs.ingest_files(spark, str(src), out, bad, state).awaitTermination()
    got = {r.path[-6:]: r.text.strip() for r in spark.read.parquet(out).collect()}
    assert got == {"/a.txt": "创业项目的商业模式", "b.html": "x\nplain words", "c.docx": "office words", "/e.doc": "legacy words"}
    # Spark lists no file of no bytes
    assert sorted(r.path[-6:] for r in spark.read.parquet(bad).collect()) == ["/g.txt", "d.docx"]


def test_watermark_drops_late_rows(spark, tmp_path):
    """A row behind the watermark changes no window, and a window comes once, when it is closed."""
    schema = "student bigint, seq bigint, ts timestamp, rule_id string"
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    at = lambda hour: datetime(2024, 1, 1, hour, 30)
    for hours in ((1, 2, 8), (1, 7, 9), (14,)):
        spark.createDataFrame([(1, h, at(h), "H1") for h in hours], schema).coalesce(1).write.mode("append").parquet(src)
        hits = jobs.windowed_hits(spark.readStream.schema(schema).parquet(src))
        hits.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    # 01:30 comes again behind the watermark of 06:30; 07:30 is late but within two hours
    assert sorted((r.start.hour, r.hits) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 1), (7, 1), (8, 1), (9, 1)]
