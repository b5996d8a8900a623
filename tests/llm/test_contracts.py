"""The registered queries against brute force on the whole small tables."""

import json
from collections import defaultdict

import public_tokenizers
import pytest

from caselens.llm import queries, urls
from tests.llm import brute


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()


def test_token_store(spark, sf_dir, documents):
    want = brute.token_rows([(d.doc_id, d.text) for d in documents], public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_store(spark, sf_dir).collect()}
    assert got == want


def test_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op2_url_filter(spark, sf_dir).collect()}
    assert len(got) == len(pages)
    for p in pages:
        host, path = brute.url(p.url)
        rule = brute.url_rule(host, path, urls.RULES)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule[1] + rule[2], rule[0] if rule else "allow")


def test_line_dedup(spark, sf_dir, documents):
    want = brute.removed_lines([(d.doc_id, d.text) for d in documents])
    got = queries.op3_line_dedup(spark, sf_dir).collect()
    assert len(got) == len(documents) and any(want.values())
    for r in got:
        runs = json.loads(r.removed_runs)
        lines = {k for x in runs for k in range(x["first"], x["last"] + 1)}
        text = documents[r.doc_id].text.split("\n")
        assert {k for k in lines if text[k].split()} == {k for k in want[r.doc_id] if text[k].split()}
        assert r.n_removed == len(lines)


def test_chat_examples(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", queries.CONTROL_TEXT), (-1, 1, "assistant", queries.CONTROL_TEXT)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op4_chat_examples(spark, sf_dir).collect()}
    assert got == brute.conversation_rows(rows)


def test_decontaminate(spark, sf_dir, documents):
    import hashlib

    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op5_decontaminate(spark, sf_dir).collect()}
    assert len(got) == len(documents) and any(r.contaminated for r in got.values())
    for d in documents:
        r = got[d.doc_id]
        if not r.n_hit and d.doc_id % 4:  # brute force over all items is slow
            continue
        n, hit, found = brute.contamination(d.text, items)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), digest, hit > 0 and 20 * hit >= n)


def test_simhash_dedup(spark, sf_dir, documents):
    prints = [(d.doc_id, brute.simhash(d.text)) for d in documents]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash_dedup(spark, sf_dir).collect()}
    roots = brute.groups(prints)
    assert got == {i: (f"{x:016x}", roots[i]) for i, x in prints}


def test_hash_tree(spark, sf_dir, documents):
    import zlib

    got = queries.op7_hash_tree(spark, sf_dir).collect()
    assert len(got) == len(documents)
    slots = defaultdict(list)
    for r in got:
        text = documents[r.doc_id].text
        assert (r.size, r.text_crc32, r.law) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "key")
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert any(r.grown_shard == 16 for r in got)


def test_quality_rules(spark, sf_dir, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op8_quality_rules(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    clean = []
    for d in documents:
        r = got[d.doc_id]
        want = brute.text_stats(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
        if labels.get(d.doc_id) == 1 and not r.base_failed:
            clean.append(r.kept)
    assert sum(clean) > 0.97 * len(clean)


def test_warc_segments(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = queries.op9_warc_segments(spark, sf_dir).collect()
    assert all(r.complete for r in got)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute.archive_rows(pages)


def test_budget_mix(spark, sf_dir, documents):
    sizes, by = {}, defaultdict(int)
    for d in documents:
        sizes[d.doc_id] = len(brute.SPACE_WORDS.findall(d.text or ""))
        by[d.source] += sizes[d.doc_id]
    want = brute.level_targets(dict(by))
    rows = queries.op10_budget_mix(spark, sf_dir).collect()
    assert sorted(rows) == sorted(queries.op10_budget_mix(spark, sf_dir).collect())
    taken = defaultdict(int)
    for r in rows:
        source = documents[r.doc_id].source
        assert (r.size, r.source_size) == (sizes[r.doc_id], by[source])
        assert r.target == pytest.approx(want[source])
        assert r.taken in {r.size * k for k in range(4)}
        taken[source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(2, 0.02 * target)
