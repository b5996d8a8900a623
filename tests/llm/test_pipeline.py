"""The pipeline's stages on a whole small table, each against brute force on its own input."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from caselens.llm import quality
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(made.collect(), made.schema)
        seen.append(docs.collect())
    return seen


def test_quality(spark, sf_dir, stages):
    judged = {r.doc_id: r.kept for r in quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert {r.doc_id for r in stages[1]} == {i for i, k in judged.items() if k}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    long = [r for r in stages[0] if labels.get(r.doc_id) == 1 and len(r.text.split()) >= 50]
    assert sum(judged[r.doc_id] for r in long) > 0.97 * len(long)


def test_near_dedup(stages):
    def shingles(text):
        w = brute.SPACE_WORDS.findall(text.translate(brute.LOWER))
        return frozenset(zip(*(w[k:] for k in range(5)))) or frozenset([tuple(w)])

    sets = {r.doc_id: shingles(r.text) for r in stages[1]}
    near = defaultdict(set)
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            near[a].add(b)
            near[b].add(a)
    kept = {r.doc_id for r in stages[2]}
    # what goes has a near copy; the first of a group stays; no copy of a text stays beside it
    assert all(near[i] for i in sets.keys() - kept) and sets.keys() - kept
    for i in sets:
        group, queue = {i}, [i]
        while queue:
            new = near[queue.pop()] - group
            group |= new
            queue += new
        assert min(group) in kept
    assert max(Counter(r.text for r in stages[2]).values()) == 1


def test_decontamination(spark, sf_dir, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = set()
    for r in stages[2]:
        n, hit, _ = brute.contamination(r.text, items)
        if not (hit > 0 and 20 * hit >= n):
            want.add(r.doc_id)
    assert {r.doc_id for r in stages[3]} == want


def test_mixture(stages):
    size = {r.doc_id: len(brute.SPACE_WORDS.findall(r.text)) for r in stages[3]}
    by, taken = defaultdict(int), defaultdict(int)
    for r in stages[3]:
        by[r.source] += size[r.doc_id]
    for r in stages[4]:
        taken[r.source] += size[r.doc_id]
    assert max(Counter(r.doc_id for r in stages[4]).values()) <= 3
    for source, target in brute.level_targets(dict(by)).items():
        epochs = int(target // by[source]) if by[source] else 0
        sums = {0}
        for r in stages[3]:
            if r.source == source:
                sums |= {s + size[r.doc_id] for s in sums}
        best = min(abs(epochs * by[source] + s - target) for s in sums)
        assert abs(taken[source] - target) <= best + 1, source


def test_tokens(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = Counter()
    for r in stages[4]:
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 2]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in stages[5]) == want
    ends = sorted((r.start, r.n_tokens) for r in stages[5])
    assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(ends)) and ends[0][0] == 0
