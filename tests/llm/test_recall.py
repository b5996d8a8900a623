"""Near-dedup of the pipeline: what its rule must keep apart, and what it must link."""

import itertools
import random

from caselens.llm import _common, simhash


def words(rng, n):
    return [f"w{rng.getrandbits(40):x}" for _ in range(n)]


def shingles(w):
    return frozenset(zip(*(w[k:] for k in range(5)))) or frozenset([tuple(w)])


def jaccard(v, w):
    x, y = shingles(v), shingles(w)
    return len(x & y) / len(x | y)


def test_equal_fingerprints_of_different_texts(spark):
    """A filler pair that fixes every bit makes equal fingerprints, but no copies."""
    rng = random.Random(5)
    texts = [" ".join(["- -"] * 250 + words(rng, 500)) for _ in range(6)]
    assert len({simhash.fingerprint(t, 2) for t in texts}) == 1
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0], texts[1]])], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(rows).collect()) == list(range(6))


#: share of the words that an edit keeps, for the five-word similarity at its right
EDITS = {
    "appended 5 %": lambda rng, w: w + words(rng, len(w) // 20),
    "appended 15 %": lambda rng, w: w + words(rng, len(w) * 15 // 100),
    "appended 23 %": lambda rng, w: w + words(rng, len(w) * 23 // 100),
    "cut by 5 %": lambda rng, w: w[: len(w) * 95 // 100],
    "cut by 18 %": lambda rng, w: w[: len(w) * 82 // 100],
    "replaced block 5 %": lambda rng, w: w[:100] + words(rng, len(w) // 20) + w[100 + len(w) // 20 :],
    "replaced block 9 %": lambda rng, w: w[:100] + words(rng, len(w) * 9 // 100) + w[100 + len(w) * 9 // 100 :],
    "each 60th word": lambda rng, w: [words(rng, 1)[0] if k % 60 == 30 else x for k, x in enumerate(w)],
}


def test_recall_by_edit(spark):
    """Copies with one edit that leaves the five-word similarity at 0.8 or more."""
    rng = random.Random(7)
    rows, kinds, n = [], {}, 40
    for kind, edit in EDITS.items():
        for _ in range(n):
            base = words(rng, 400)
            copy = edit(rng, base)
            assert jaccard(base, copy) >= 0.8, kind
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
            kinds[len(rows) - 1] = kind
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()}
    assert all(i in kept for i in range(0, len(rows), 2))
    caught = {kind: sum(k == kind and i not in kept for i, k in kinds.items()) for kind in EDITS}
    print(caught)
    assert all(c >= 0.95 * n for c in caught.values()), caught


def test_members_of_a_bucket_meet(spark):
    """Copies of one another that are no copies of the least text of their bucket."""
    rng = random.Random(11)
    filler = ["- -"] * 250
    texts = [" ".join(filler + words(rng, 500)) for _ in range(3)]
    texts += [texts[1] + " the end", texts[2] + " the end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(rows, bands=0).collect()) == [0, 1, 2]


def recall(spark, texts):
    """(pairs of 0.8 or more, those of them in one group) of texts as word lists."""
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(8)
    made, groups = simhash.near_groups(rows)
    ids = {r.uid: r.doc_id for r in made.select("uid", "doc.doc_id").collect()}
    root = {ids[r.node]: r.root for r in groups.collect()}
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return len(pairs), sum(root[i] == root[j] for i, j in pairs)


def test_links_under_a_common_passage(spark):
    """Half of each text is one passage, so most buckets hold texts that are no copies;
    the copies among them are found all the same."""
    rng = random.Random(13)
    passage = words(rng, 60)
    texts = [passage + words(rng, 50) for _ in range(300)]
    texts += [t[:-8] + words(rng, rng.randrange(1, 9)) for t in texts[:100]]
    n, found = recall(spark, texts)
    assert n >= 90 and found >= 0.95 * n, (n, found)


def test_large_near_group_is_linear(spark, monkeypatch):
    """Near copies of one text: what is read grows with the group and not with its square."""
    rng = random.Random(17)
    base = words(rng, 200)
    counts = []
    real = simhash.similar

    def counted(pairs, texts, **k):
        counts.append(pairs.count())
        return real(pairs, texts, **k)

    monkeypatch.setattr(simhash, "similar", counted)
    texts = []
    for _ in range(400):
        t = list(base)
        for at in rng.sample(range(200), 2):
            t[at] = words(rng, 1)[0]
        texts.append(t)
    n, found = recall(spark, texts)
    assert n > 50_000 and found == n
    assert sum(counts) < 10 * len(texts), counts


def test_split_and_order_change_nothing(spark, monkeypatch):
    """The same rows in other partitions and another order: the same pairs are read and
    the same rows stay, also where rows share a doc_id."""
    rng = random.Random(23)
    passage = words(rng, 60)
    texts = [passage + words(rng, 50) for _ in range(60)]
    texts += [t[:-8] + words(rng, rng.randrange(1, 9)) for t in texts]
    rows = [(i // 2, " ".join(t)) for i, t in enumerate(texts)]
    real, seen = simhash.similar, []

    def noted(pairs, texts, **k):
        t = {r.node: r.text for r in texts.collect()}
        seen[-1].append(frozenset(frozenset((t[r.a], t[r.b])) for r in pairs.collect()))
        return real(pairs, texts, **k)

    monkeypatch.setattr(simhash, "similar", noted)
    kept = []
    for given, parts in ((rows, 1), (rows[::-1], 5)):
        seen.append([])
        made = spark.createDataFrame(given, "doc_id bigint, text string").repartition(parts)
        kept.append(sorted((r.doc_id, r.text) for r in simhash.keep_first(made).collect()))
    assert kept[0] == kept[1] and len(kept[0]) < len(rows)
    assert seen[0] == seen[1] and any(seen[0])


def test_no_link_is_lost(spark):
    """With sketches that find next to nothing, the exact step still finds every link: chains
    of texts at and just below 0.8, under a passage that all share, empty and short texts."""
    rng = random.Random(29)
    passage = words(rng, 80)
    texts = [[], [], ["a"], ["a", "b"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e", "f"]]
    for k in range(40):
        t = passage[: rng.randrange(0, 81)] + words(rng, rng.randrange(5, 120))
        for _ in range(4):
            texts.append(t)
            n = rng.randrange(1, 2 + len(t) // 8)
            t = rng.choice([t + words(rng, n), t[n:], t[: len(t) // 2] + words(rng, n) + t[len(t) // 2 :]])
    rng.shuffle(texts)
    rows = spark.createDataFrame([(i, (" " * (i + 1) if not t else "") + " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(8)
    made, groups = simhash.near_groups(rows, views=1, bands=0)
    ids = {r.uid: r.doc_id for r in made.select("uid", "doc.doc_id").collect()}
    root = {ids[r.node]: r.root for r in groups.collect()}
    sets = [shingles(t) for t in texts]
    over = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            over = [over[i] if x == over[j] else x for x in over]
    together = lambda key: {frozenset(i for i in root if key(i) == k) for k in map(key, root)}
    assert together(root.get) == together(lambda i: over[i])
    assert len(together(root.get)) < len(texts) - 40


def test_counts_that_the_exact_step_rests_on():
    """Sets of similarity 0.8 share the needed shingles, and enough within their prefixes."""
    rng = random.Random(31)
    for _ in range(3000):
        common = rng.randrange(1, 60)
        a, b = (rng.randrange(0, 1 + common // 4) for _ in range(2))
        if common < 0.8 * (common + a + b):
            continue
        every = rng.sample(range(1000), common + a + b)
        x, y = sorted(every[: common + a]), sorted(every[:common] + every[common + a :])
        assert common >= max(simhash.needed(len(x)), simhash.needed(len(y)))
        shared = set(x[: simhash.prefix_length(len(x))]) & set(y[: simhash.prefix_length(len(y))])
        assert len(shared) >= max((simhash.needed(len(z)) + 9) // 10 for z in (x, y))


def test_small_tables_of_the_loops_are_few_files(spark, monkeypatch, tmp_path):
    """Rounds over few rows write a file for each core at most, not one for each shuffle partition."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    monkeypatch.setattr(_common, "scratch_root", lambda _: f"file://{tmp_path}")
    rng = random.Random(5)
    rows = []
    for k in range(60):
        base = words(rng, 60)
        rows += [(3 * k + i, " ".join([*base, *words(rng, i)])) for i in range(3)]
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        kept = [r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id").collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sorted(kept) == list(range(0, 180, 3))
    for name in ("components", "simhash-linked", "simhash-roots"):
        files = [len(list(p.glob("part-*"))) for p in tmp_path.glob(f"{name}-*")]
        assert files and max(files) <= spark.sparkContext.defaultParallelism, (name, files)
