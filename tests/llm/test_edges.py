"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from caselens.llm import chat, decontaminate, lines, mixing, quality, sharding, simhash, tokens, urls, warc
from tests.llm import brute

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
PROSE = " ".join(f"word{k}" for k in range(90))
DOCS = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \t\n", "en", "b"), (4, PROSE, "en", "a"), (5, PROSE, "en", "a"), (5, PROSE, "en", "a"), (None, PROSE + " end", None, "b"), (None, "x", "fr", None),
    (6, LONG, "en", "a"), (7, LONG + " more", "en", "a"), (8, "émoji 🙂 <|endoftext|> l'eau  double\n\nline\x1c odd", "fr", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
CLASH = ["doc", "uid", "fp", "n", "take", "key", "digest", "run", "kept", "shard", "n_words", "__times", "view", "node", "removed"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def wide(docs):
    return docs.withColumns({c: F.lit(c) for c in CLASH})


def test_tokens(spark, docs, tmp_path):
    path = tokens.write_store(docs, f"file://{tmp_path}/store")
    rows = tokens.read_store(docs.select(F.col("doc_id").alias("key")), path).orderBy("start").collect()
    assert len(rows) == len(DOCS)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {i: [] for i, *_ in DOCS}
    for i, text, *_ in DOCS:
        ids[i].append([*t.encode(text or "", add_special_tokens=False).ids, 2])
    want = sorted((i if i is not None else -1, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, v in ids.items() for x in v)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: -1 if x is None else x)
    assert tokens.get(spark, path, 8) == ids[8][0] and tokens.get(spark, path, 999) is None
    empty = tokens.write_store(docs.where("false"), f"file://{tmp_path}/empty")
    assert tokens.read_store(docs.select(F.col("doc_id").alias("key")), empty).count() == 0


def test_mph_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000))
    sizes, bits = tokens.build_mph(keys)
    assert sorted(tokens.mph_slots(sizes, bits, keys).tolist()) == list(range(len(keys)))


def test_token_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "BUCKET", 16)
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"))
    path = tokens.write_store(rows, f"file://{tmp_path}/s")
    got = tokens.read_store(rows.select(F.col("doc_id").alias("key")).where("key % 3 = 0"), path)
    assert got.count() == 167


def test_urls(spark):
    given = [(1, None), (2, "no scheme"), (3, "http://EXAMPLE.com/en/x?q#f"), (4, "http://a.example.com"), (4, "http://www.example.com/en/"), (5, "x://net/fr/://com/"), (6, "http://notexample.com/en/"), (7, "http://b.net/x/a.com/en/"), (8, "http://ÉX.com/🙂"), (9, "http://" + "a" * 5000 + ".net/es/" + "b" * 5000)]
    pages = spark.createDataFrame(given, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = sorted(tuple(r) for r in urls.judge(pages).collect())
    want = []
    for i, u in given:
        host, path = brute.url(u)
        rule = brute.url_rule(host, path, urls.RULES)
        want.append((i, host, path, rule and rule[1] + rule[2], rule[0] if rule else "allow"))
    assert got == sorted(want)
    assert sorted(tuple(r) for r in urls.judge(pages, block_rules=2).collect()) == sorted(want)
    assert urls.judge(pages.where("false")).count() == 0


def test_globs():
    a = urls.Automaton(["a*b", "?x", "**z", "a**/c", r"\*"])
    assert a.matches(["ab", "a/b", "axxb", "xx", "/x", "q/z", "a/b/c", "*", ""]).astype(int).tolist() == [
        [1, 0, 0, 0, 0], [0, 0, 0, 0, 0], [1, 0, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 1, 0], [0, 0, 0, 0, 1], [0, 0, 0, 0, 0],
    ]


def test_lines(spark, docs, wide):
    line = " ".join(f"q{k}" for k in range(30))
    given = [(1, f"head\n{line}\n\n{line} b\ntail"), (2, f"own\n{line}\n\n{line} b\nrest"), (3, f"{line}\n" * 6), (None, None), (4, ""), (5, "short\nshort")]
    rows = spark.createDataFrame(given, "doc_id bigint, text string").withColumn("uid", F.lit("u")).withColumn("runs", F.lit(1))
    got = {r.doc_id: r for r in lines.dedup(rows).collect()}
    want = brute.removed_lines(given)
    for i, text in given:
        removed = {k for r in got[i].removed_runs for k in range(r["first"], r["last"] + 1)}
        assert {k for k in removed if text.split("\n")[k].split()} == {k for k in want[i] if text.split("\n")[k].split()}
    assert got[2].text == "own\nrest" and got[None].text is None and got[4].text == "" and got[3].text == f"{line}\n{line}\n" and got[5].text == "short\nshort"
    assert lines.dedup(wide).count() == len(DOCS) and lines.dedup(docs.where("false")).count() == 0


def test_lines_past_the_last_window(spark):
    """Short lines before and behind a long one go with it, whatever the first place of each window."""
    long, t1, t2 = " ".join(f"p{k}" for k in range(60)), "two words", "three more words"
    five = [" ".join(f"f{i}x{k}" for k in range(n)) for i, n in enumerate((13, 13, 13, 13, 8))]
    given = [
        (0, f"alone\n{long}\nother"), (1, f"head a\n{t1}\n{long}\n{t2}\n{t1}\nend a"), (2, f"head b\n{t1}\n\n{long}\n{t2}\n{t1}\nend b"),
        (3, "\n".join(["x", *five, "y"])), (4, "\n".join(["z", *five, "w"])), (5, "\n".join([*five[:4], "v", *five[1:]])), (6, f"{long}\n{long}\n{long}\n{t1}"), (7, f"{t1}\n{t2}"),
    ]
    rows = spark.createDataFrame(given, "doc_id bigint, text string")
    got = {r.doc_id: r for r in lines.dedup(rows).collect()}
    assert got[0].text == given[0][1] and got[2].text == "head b\nend b" and got[4].text == "z\nw" and got[5].text == f"v\n{five[1]}\n{five[2]}\n{five[3]}\n{five[4]}"
    want = brute.removed_lines(given)
    for i, text in given:
        removed = {k for r in got[i].removed_runs for k in range(r["first"], r["last"] + 1)}
        assert {k for k in removed if text.split("\n")[k].split()} == {k for k in want[i] if text.split("\n")[k].split()}, i


@pytest.mark.parametrize("seed", range(3))
def test_lines_random(spark, seed):
    """Texts of few different lines, so that runs overlap, repeat and touch in every way."""
    rng = np.random.default_rng(seed)
    pool = [" ".join(f"{i}w{k}" for k in range(n)) for i, n in enumerate(rng.integers(1, 30, 12).tolist())] + [""]
    given = [(i, "\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(0, 40)))) for i in range(60)]
    got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(given, "doc_id bigint, text string").repartition(5)).collect()}
    want = brute.removed_lines(given)
    for i, text in given:
        removed = {k for r in got[i].removed_runs for k in range(r["first"], r["last"] + 1)}
        assert {k for k in removed if text.split("\n")[k].split()} == {k for k in want[i] if text.split("\n")[k].split()}, i


@pytest.mark.parametrize(("piece", "readers", "contexts"), [(1 << 15, 256, True), (64, 4, True), (1 << 15, 256, False)])
def test_chat(spark, tmp_path, monkeypatch, piece, readers, contexts):
    """Contexts written whole, in small pieces and named by length are all the turns before."""
    monkeypatch.setattr(chat, "PIECE", piece)
    monkeypatch.setattr(chat, "READERS", readers)
    odd = r"\ <|end|> <\|turn|> <|>" + "\n[INST]</s><<SYS>> <| \\\\| [/INST] <s>"
    given = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "user", None), (1, 3, "assistant", "second"), (2, 0, None, "x"), (2, 0, "a\n<|>b", "y"), (None, None, "assistant", "z"), (3, 5, "assistant", ""), (4, 0, "system", "only")]
    given += [(5, k, "assistant" if k % 2 else "user", f"turn {k} " + "x" * 50) for k in range(300)]
    given += [(6, 0, "user", "long " * 90), (6, 1, "assistant", odd * 20), (6, 2, "user", "\\" * 128), (6, 3, "assistant", "𝄞" * 200), (6, 4, "assistant", "after")]
    rows = spark.createDataFrame(given, "conv_id bigint, turn bigint, role string, text string")
    rows = rows.select("*", *(F.lit("clash").alias(c) for c in ("block", "piece", "at", "segment", "ordinal", "context", "completion", "last", "__conv", "held")))
    path = chat.write_chats(rows, f"file://{tmp_path}/c", contexts=contexts)
    read = chat.read_chats(spark, path).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read} == brute.conversation_rows(given)
    made = spark.read.parquet(f"{path}/examples")
    stream = chat.parse(spark.read.parquet(f"{path}/stream"))
    named = chat.examples(stream)
    full = {(r.conv_id, r.ordinal): r.prompt for r in chat.prompts(named, stream).collect()}
    if contexts:
        found = {}
        for r in made.orderBy("piece").collect():
            found.setdefault((r.conv_id, r.ordinal), []).append(r)
        assert {k: "".join(r.context for r in v) for k, v in found.items()} == full
        assert all([r.completion is None for r in v] == [True] * (len(v) - 1) + [False] for v in found.values())
        assert {k: v[-1].completion for k, v in found.items()} == {(r.conv_id, r.ordinal): r.completion for r in named.collect()}
        assert max(len(r.context) for r in made.collect()) < 3 * piece
        assert max(map(len, found.values())) > 100 or piece > 64
    segs = {c: [r.segment for r in stream.where(F.col("conv_id") == c).orderBy("ordinal").collect()] for c in (1, 5)}
    head = f"{chat.OPEN}assistant{chat.MIDDLE}"
    assert full[1, 3] == "".join(segs[1][:3]) + head and full[5, 299] == "".join(segs[5][:299]) + head and len(full) == named.count()
    for r in read:
        mine = [(k, p) for (c, k), p in full.items() if c == r.conv_id]
        assert (r.context_turns, r.context_chars) == (sum(k for k, _ in mine), sum(len(p) for _, p in mine))
    assert all(x not in r.completion for r in named.where("conv_id = 1").collect() for x in chat.CONTROL)
    empty = chat.write_chats(rows.where("false"), f"file://{tmp_path}/e")
    assert chat.read_chats(spark, empty).count() == 0


def test_decontaminate(spark, docs, wide):
    items = [(1, " ".join(f"word{k}" for k in range(20, 40))), (1, "w5x5 w6x6"), (None, "ÉMOJI eau"), (2, ""), (3, None), (4, "EAU  double, Line odd"), (5, "missing words here")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("key", F.lit(1))
    want = sorted(brute.contamination(t, [("" if i is None else str(i), x) for i, x in items])[:2] for _, t, *_ in DOCS)
    for words in (4_000_000, 30):  # one block, and many
        got = decontaminate.report(docs, bench, block_words=words).collect()
        assert sorted((r.n_words, r.n_hit) for r in got) == want
        assert {r.n_items for r in got if r.doc_id == 8} == {1} and {r.n_items for r in got if r.doc_id in (4, 5)} == {1}
    assert {r.doc_id for r in decontaminate.filter_documents(wide, bench).collect()} == {1, 2, 3, 6, 7, None} - set() and decontaminate.filter_documents(wide, bench).columns == wide.columns
    assert decontaminate.report(docs, bench.where("false")).where("n_hit > 0").count() == 0 and decontaminate.report(docs.where("false"), bench).count() == 0


def test_phrase_index(spark, docs, monkeypatch):
    """Every word of every document has its postings, whatever the shards, and one index answers any benchmark."""
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 40)
    keyed = docs.select(F.col("doc_id").cast("string").alias("key"), "text")
    index = decontaminate.build_index(keyed).collect()
    assert len(index) > spark.sparkContext.defaultParallelism or max(len(r.rows) for r in index) < len(DOCS)
    found = []
    for r in index:
        starts, words = np.frombuffer(r.starts, np.int64), r.words.split()
        shard = decontaminate.Shard(words, **r.asDict())
        text = {p: w for k, w in enumerate(words) for p in (shard.postings(np.array([k]))[1].tolist() if shard.span > 1 else [])}
        found += [(key, [text[p] for p in range(a, b)]) for key, a, b in zip(r.keys, starts, starts[1:])]
    want = [(None if i is None else str(i), decontaminate.words_of(t)) for i, t, *_ in DOCS]
    assert sorted(found, key=str) == sorted(want, key=str)
    bench = spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(20, 40))), (4, "EAU  double, Line odd")], "item_id bigint, text string")
    small = sorted((str(r.doc_id), r.n_words, r.n_hit, r.items_sha256) for r in decontaminate.report(docs, bench).collect())
    monkeypatch.undo()
    assert small == sorted((str(r.doc_id), r.n_words, r.n_hit, r.items_sha256) for r in decontaminate.report(docs, bench).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([("a", "alpha x x beta"), ("b", "beta alpha"), ("c", "alpha " + "x " * 40 + "beta"), ("d", "alpha")], "key string, text string")
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id bigint, text string")
    got = {r.key: (r.items, r.near_items) for r in decontaminate.search(docs, bench, slop=5).collect()}
    assert got == {"a": ([], ["1"]), "b": ([], ["1"]), "c": ([], []), "d": ([], [])}


def test_simhash(spark, docs, wide):
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.dedup_groups(docs).collect()}
    prints = {(i, brute.simhash(t)) for i, t, *_ in DOCS}
    assert {(i, fp & (2**64 - 1)) for i, fp, _ in got} == prints
    assert {c for i, _, c in got if i in (1, 2, 3)} == {1} and {c for i, _, c in got if i in (4, 5)} == {4}
    kept = simhash.keep_first(wide)
    # the long null row is a near copy of 4, the short one is in no group
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept.columns == wide.columns and [i for i, _ in rows] == [1, 4, 6, 8, None] and rows[-1][1] == "x"
    assert simhash.dedup_groups(docs.where("false")).count() == 0


def test_anchor_cover():
    rng = np.random.default_rng(7)
    x = rng.integers(-(2**63), 2**63 - 1, 300)
    for t, halved in ((1, False), (2, False), (2, True), (3, True)):
        for fp in x[:100]:
            y = np.array([fp]).view(np.uint64)
            for b in rng.choice(64, t, replace=False):
                y = y ^ np.uint64(1 << int(b))
            beyond = -(-t // 2) if halved else t
            _, a, home = simhash.anchors(np.array([fp]), beyond)
            _, b, _ = simhash.anchors(y.view(np.int64), beyond)
            assert set(a if halved else a[home]) & set(b) and home.sum() == 1


def test_components(spark):
    pairs = [(k, k + 1) for k in range(200)] + [(500, 501), (503, 501), (-9, -8)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500, 503: 500, -9: -9, -8: -9}


def test_sharding(spark, docs):
    tree = sharding.layout(16)
    got = sharding.with_slots(sharding.assign(docs, tree)).collect()
    assert len(got) == len(DOCS) and len({r.shard for r in got if r.doc_id is None}) == 1
    ids = spark.range(4000).select(F.col("id").alias("doc_id"))
    place = lambda t: {r.doc_id: r.s for r in ids.select("doc_id", sharding.shard_of(F.col("doc_id"), t).alias("s")).collect()}
    before = place(tree)
    heavy = [sharding.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in tree]
    after = place(heavy)
    rack = {s.shard: (s.region, s.rack) for s in tree}
    # at each level keys move only into the child on the changed path
    for k, s in after.items():
        was = before[k]
        if rack[s][0] != rack[was][0]:
            assert rack[s][0] == rack[5][0]
        elif rack[s] != rack[was]:
            assert rack[s] == rack[5]
        else:
            assert s in (was, 5)
    assert sum(s == 5 for s in after.values()) > 1.8 * sum(s == 5 for s in before.values())
    grown = place(sharding.grown(tree))
    assert {s for k, s in grown.items() if s != before[k]} == {16}


def plain_shard(key, tree):
    """The child of the least weighted draw, region by region, rack by rack."""
    h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    name, below = "", tree
    for level in ("region", "rack", "shard"):
        weights = {}
        for s in below:
            weights[getattr(s, level)] = weights.get(getattr(s, level), 0.0) + s.weight
        draw = lambda child: -math.log(((xxhash.xxh64_intdigest(f"{name}/{child}".encode(), h) >> 11) + 0.5) / 2**53) / weights[child]
        best = min(weights, key=draw)
        name, below = f"{name}/{best}", [s for s in below if getattr(s, level) == best]
    return below[0].shard


def test_sharding_placement(spark, docs, wide):
    """Each shard against a plain descent of the tree with the same draws; null text, empty table, clashing columns."""
    tree = [sharding.Shard(s.region, s.rack, s.shard, 1.0 + s.shard % 3) for s in sharding.layout(16)]
    more = spark.range(-500, 1500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for r in sharding.assign(more.union(docs.select("doc_id", "text")), tree).collect():
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, tree), plain_shard(r.doc_id, sharding.grown(tree)))
    got = sharding.with_slots(sharding.assign(wide, tree)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in got) == sorted((i is None, i, len((t or "").encode()) + 1) for i, t, *_ in DOCS)
    assert sharding.with_slots(sharding.assign(docs.where("false"), tree)).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_quality(spark, docs, wide):
    got = quality.judge(docs).collect()
    assert sorted(tuple(r[c] for c in quality.STATS[:5]) for r in got) == sorted(brute.text_stats(t) for _, t, *_ in DOCS)
    assert all(not r.kept for r in got if r.doc_id in (1, 2, 3))
    kept = quality.filter_documents(wide)
    assert kept.columns == wide.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert quality.judge(docs.where("false")).count() == 0


def test_quantile_sketch(spark):
    values = [int(x) for x in np.random.default_rng(3).lognormal(6, 1, 4000)]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select(F.col("v"), quality.bucket(F.col("v")).alias("b")).collect()
    assert all(r.b <= r.v <= r.b * (1 + 1 / 32) for r in rows) and all(r.b == r.v for r in rows if r.v < 64)


def test_warc(spark, tmp_path):
    big = "".join(f"<p>{k}é</p>" for k in range(9000))
    pages = [(3, "http://a/é\nx", big), (1, None, "same"), (2, "u", "same"), (4, "u", None), (5, "u", ""), (6, "u", big), (7, "u", "0\r\n\r\n")]
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    path = warc.write_archives(rows, f"file://{tmp_path}/w", segment_bytes=1000, file_bytes=20_000)
    got = warc.read_archives(spark, path).collect()
    assert all(r.complete for r in got)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute.archive_rows([(i, h) for i, _, h in pages])
    again = warc.write_archives(rows.union(rows), f"file://{tmp_path}/r", segment_bytes=1000)  # repeated rows, nulls among equal payloads
    assert sorted(r.page_id for r in warc.read_archives(spark, again).where("complete").collect()) == sorted([p[0] for p in pages] * 2)
    parts = warc.read_records(spark, path).where("number IS NOT NULL")
    assert parts.where("number = 1").count() == 1 and parts.count() > 50
    assert not warc.reassemble(parts.where("number <> 7")).first().complete and not warc.reassemble(parts.where("total IS NULL")).first().complete
    null = warc.write_archives(spark.createDataFrame([(None, "u", "a"), (None, "u", "a")], "page_id bigint, url string, html string"), f"file://{tmp_path}/n")
    assert [r.record_type for r in warc.read_archives(spark, null).collect()] == ["response"] * 2
    assert warc.read_archives(spark, warc.write_archives(rows.where("false"), f"file://{tmp_path}/e")).count() == 0
    with pytest.raises(ValueError, match="chunk"):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_mixing(spark, docs, wide):
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(DOCS) and sorted(r.size for r in got) == sorted(len(brute.SPACE_WORDS.findall(t or "")) for _, t, *_ in DOCS)
    mixed = mixing.mixed_documents(wide)
    assert mixed.columns == wide.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mix_report(docs.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_budget_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 900, 30))
    counts = rng.integers(1, 40, len(lengths))
    budget = int(rng.integers(1, int((lengths * counts).sum())))
    take = mixing.fit(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all() and abs(budget - int((take * lengths).sum())) <= 2
    small = mixing.fit(np.array([5, 7]), np.array([2, 1]), 14)
    assert (small * [5, 7]).sum() in (12, 17)
    few = np.array([149_999, 150_001, 160_000])
    assert mixing.fit(few, np.ones(3, np.int64), 300_000).tolist() == [1, 1, 0]
    huge = np.array([3_000_000, 3_000_001, 5_000_000])  # all unused documents are longer than the rest
    assert mixing.fit(huge, np.ones(3, np.int64), 5_900_000).tolist() == [1, 1, 0] and mixing.fit(huge, np.ones(3, np.int64), 3_000_002).tolist() == [0, 1, 0]
    tens = np.array([10, 20, 30])
    assert (mixing.fit(tens, np.full(3, 5), 53) * tens).sum() == 50
    for n in range(40):  # few documents: the nearest of all sums
        few, budget = rng.integers(1, 50, 6), int(rng.integers(1, 150))
        kinds, held = np.unique(few, return_counts=True)
        sums = {0}
        for x in few.tolist():
            sums |= {s + x for s in sums}
        got = int((mixing.fit(kinds, held, budget) * kinds).sum())
        assert abs(got - min(budget, sum(few))) == min(abs(s - min(budget, sum(few))) for s in sums)


def test_hot_rank(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 10)
    rows = spark.range(95).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source")).union(spark.range(200, 300).select("id", F.lit("a b"), F.lit("t")))
    got = mixing.mix_report(rows).collect()
    targets = {r.source_size: r.target for r in got}
    for size, target in targets.items():
        assert abs(sum(r.taken for r in got if r.source_size == size) - target) <= 3


def test_pipeline_stages(spark, wide, sf_dir):
    docs = wide.drop(*CLASH)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.where("false"), wide):
            assert stage(spark, given, sf_dir).columns == given.columns, name
            stage(spark, given, sf_dir).count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(DOCS)
