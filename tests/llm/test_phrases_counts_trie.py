"""Collocations, token counts and the prefix trie against brute force, and their edges."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caselens.llm import counts, phrases, queries, trie
from tests.llm import brute

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, words int, n long, block long"
CONVS = "conv_id long, turn int, role string, text string, seq string, depth int"
COLLOCATION = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def invented(n, seed):
    """Texts of few words, so that phrases repeat, with hot words, ties and odd white space."""
    r = random.Random(seed)
    words = ["The", "the", "of", "é", "日本", "a|b", "x\x00y", "ZZ", *(f"w{k}" for k in range(12))]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", "\x0b"]
    return [(k, "".join(r.choice(words[: 3 if r.random() < 0.4 else None]) + r.choice(ends) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None, ""]), 1, 2, 3) for k in range(n)]


@pytest.fixture(scope="module")
def documents(spark):
    rows = invented(400, 5)
    rows += [(None, None, "en", 1, 2, 3), (1, "", None, 1, 2, 3), rows[7], rows[7], (9, ".", "fr", 1, 2, 3), (10, "one", "fr", 1, 2, 3)]
    return rows, spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize(("max_words", "most", "block"), [(3, 1 << 18, 1 << 23), (3, 50, 500), (4, 40, 900), (2, 30, 64)])
def test_collocations(documents, monkeypatch, max_words, most, block):
    rows, df = documents
    monkeypatch.setattr(phrases, "MOST", most)  # the hot words' stripes are dealt into many
    got = [tuple(r[c] for c in COLLOCATION) for r in phrases.collocations(df, max_words, least=10, top=40, share=50, block=block).collect()]
    want = brute.collocations([(r[2], r[1]) for r in rows], max_words, 10, 40, 50)
    assert len(got) == len(set(got)) and set(got) == want and len({g[0] for g in got}) == 4


def test_collocations_of_the_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()]
    got = {tuple(r[c] for c in COLLOCATION) for r in queries.op11_collocations(spark, sf_dir).collect()}
    assert got == brute.collocations(docs)


def test_products_over_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    table = spark.createDataFrame([("en", "a", 1, big + 5), ("en", "b", 1, big + 7), ("en", "a b", 2, big)], "lang string, phrase string, words int, n long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: (table, spark.createDataFrame([("en", 2 * big)], "lang string, n long")))
    row = phrases.collocations(table).first()
    assert row.score == 10**6 * big * big // ((big + 5) * (big + 7))


def test_no_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    assert phrases.collocations(empty).collect() == [] and counts.token_counts(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, 1, 2, 3)], DOCS)).collect() == []


@pytest.mark.parametrize("size", [1 << 24, 300])
def test_token_counts(spark, documents, size):
    rows, _ = documents
    rows = [*rows, (11, "a <|endoftext|> b<|endoftext|>", "en", 1, 2, 3), (12, "x" * 5000 + " \x1c\u00a0 \n\n 's'S  ", "en", 1, 2, 3), (13, ("lorem  ipsum\n " * 900), "en", 1, 2, 3)]
    t = Tokenizer.from_file(VOCABULARY)
    want = []
    for doc_id, text, *_ in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 64))
    got = [tuple(r) for r in counts.token_counts(spark.createDataFrame(rows, DOCS), limit=64, size=size).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_token_counts_of_the_table(spark, sf_dir):
    t = Tokenizer.from_file(VOCABULARY)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op12_token_counts(spark, sf_dir).collect()}
    want = {d.doc_id: len(t.encode(d.text or "", add_special_tokens=False).ids) for d in docs}
    assert got == {d.doc_id: (len((d.text or "").encode()), want[d.doc_id], want[d.doc_id] > 1024) for d in docs}


@pytest.mark.parametrize("block", [1 << 24, 6])
def test_cuts_are_the_librarys(monkeypatch, block):
    """Runs, pre-tokens and slices of random characters, many of them white space of some kind."""
    r = random.Random(3)
    monkeypatch.setattr(counts, "BLOCK", block)
    kinds = ["a", "b c", "B", "é", "  ", " ", "\n", "\t", "\x1c", "\x1f", "\u2003", "\u00a0", "'s", "'", "!", "1", "²", "<|endoftext|>", "<|", "日", "\u0301", "😀", "_", "\r\n", "\u0085", "\u200b", "ing"]
    cut, t = counts.cutter(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    texts = ["".join(r.choice(kinds) for _ in range(r.randint(0, 40))) for _ in range(5000)]
    for text, whole in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        runs, special = cut.frequencies(text)
        assert special + sum(n * sum(map(cut.count, cut.pre_tokens(x))) for x, n in runs.items()) == len(whole.ids), text


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        counts.Cutter(public_tokenizers.path("word_bpe_49k.json"))


def dialogues(seed, n=150):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-40, 2000), n):
        for k in range(r.choice([1, 2, 3, 4, 5, 9])):
            rows.append((c, None if k == 0 and r.random() < 0.1 else k, r.choice(["user", None, "assistant"]), r.choice(["hi", "hi  there", None, "", "a b c"]), "s", 1))
    return rows


def node_rows(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "size"), [(1, 1 << 16), (1, 7), (2, 1), (3, 25)])
def test_trie(spark, seed, size):
    rows = dialogues(seed)
    assert node_rows(trie.prefix_trie(spark.createDataFrame(rows, CONVS), size)) == brute.trie([r[:4] for r in rows])


def test_trie_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert node_rows(queries.op13_prefix_trie(spark, sf_dir)) == brute.trie(rows)


def test_trie_of_copies_and_one_long_conversation(spark):
    """Copies of one conversation, whose ids are joined in several parts, and a long one with its prefix."""
    rows = [(c, k, "user", f"t{k}", "s", 1) for c in range(0, 3000, 3) for k in range(3)] + [(7001, k, "user", f"t{k}", "s", 1) for k in range(700)]
    rows += [(None, k, "user", f"t{k}", "s", 1) for k in range(2)]
    got = node_rows(trie.prefix_trie(spark.createDataFrame(rows, CONVS), 100))
    assert got == brute.trie([r[:4] for r in rows])


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONVS)).collect() == []
    # conversation 1 starts like conversation 0, which there is not, so it may have no turn left
    lone = [(c, 0, "user", "x", "s", 1) for c in (21, 22, 23)]
    assert node_rows(trie.prefix_trie(spark.createDataFrame(lone, CONVS))) == brute.trie([r[:4] for r in lone])
