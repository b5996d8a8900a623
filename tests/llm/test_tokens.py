"""The token store's encoder against the tokenizer, and its index against what it points to."""

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from caselens.llm import tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "b", "é", "1", "2", " ", " ", " ", "\n", "\t", "'s", "'", "_", "-", "\x1c", "\x00", "<|endoftext|>", "中", "🙂", "　", "\r", "́", ".", "word"]


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_fuzz(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(40))) for _ in range(20_000)]
    want = whole_ids(texts)
    for group, limit in ((1 << 21, 250_000), (25, 50)):  # one group; long texts in slices, and a cache that ages
        monkeypatch.setattr(tokens, "GROUP", group)
        monkeypatch.setattr(tokens, "LIMIT", limit)
        encoder = tokens.Encoder(VOCABULARY, 2, 2)
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(iter(texts))] == want


def test_copies_over_blocks(spark, tmp_path, monkeypatch):
    """Many rows of one key lie in several blocks, and all are found."""
    monkeypatch.setattr(tokens, "BLOCK", 40)
    rows = spark.range(60).select(F.when(F.col("id") < 30, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text"))
    path = tokens.write_store(rows, f"file://{tmp_path}/s")
    assert spark.read.parquet(f"{path}/payload").count() > 5
    got = tokens.read_store(spark.createDataFrame([(7,), (45,), (1000,)], "key bigint"), path).collect()
    texts = [f"some text {k}" for k in [*range(30), 45]]
    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in whole_ids(texts)]
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == sorted((7 if k < 30 else 45, c) for k, c in zip([*range(30), 45], crc))
    assert sorted(r.start for r in got if r.doc_id == 7) == [r.start for r in sorted(got, key=lambda r: r.start)][:30]


def test_wrong_index_shows(spark, tmp_path):
    """The read goes where the index points: swapped slots give other documents' ids."""
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x y "), F.col("id").cast("int")).alias("text"))
    path = tokens.write_store(rows, f"file://{tmp_path}/s")
    keys = rows.select(F.col("doc_id").alias("key"))
    right = {r.doc_id: r.ids_crc32 for r in tokens.read_store(keys, path).collect()}
    index = spark.read.parquet(f"{path}/index").toPandas()
    for c in tokens.SLOT:
        index[c] = [np.frombuffer(x, np.int64)[::-1].tobytes() for x in index[c]]
    spark.createDataFrame(index, spark.read.parquet(f"{path}/index").schema).write.parquet(f"{path}/index", mode="overwrite")
    wrong = {r.doc_id: r.ids_crc32 for r in tokens.read_store(keys, path).collect()}
    assert len(right) == len(wrong) == 40 and right != wrong and sorted(right.values()) == sorted(wrong.values())


def test_clashing_columns(spark, tmp_path):
    names = ["key", "shard", "start", "seq", "block", "at", "runs", "n_tokens"]
    rows = spark.createDataFrame([(1, "a b"), (None, None), (2, "")], "doc_id bigint, text string").withColumns({c: F.lit(c) for c in names})
    path = tokens.write_store(rows, f"file://{tmp_path}/s")
    got = tokens.read_store(rows.select(F.col("doc_id").alias("key")), path).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in got) == [(0, None, 1), (1, 1, 3), (4, 2, 1)]


def test_a_word_before_a_stop_is_learnt_once():
    texts = ["heat, heat. heat.\nheat.42 heat", "a.b,c d.", ". a", "a .b", "a..b, c", "_. a", "é. 7, ß.", "a\x1e. b.", "a.  b, c", ".", "a,", "", "\n.a", "a.\n", "x, \ny."]
    encoder = tokens.Encoder(VOCABULARY, 2, 2)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == whole_ids(texts)
    assert "heat" in encoder.young and not {"heat.", "heat,", "heat.42"} & encoder.young.keys()
