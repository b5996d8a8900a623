"""Names joined by rare bigrams against all pairs."""

import random
from difflib import SequenceMatcher

from caselens.operators import retrieval, similarity


def names(seed, n):
    r = random.Random(seed)
    out = {"".join(r.choice("abcd 渠") for _ in range(r.randint(1, 14))) for _ in range(n)}
    for s in list(out):
        i = r.randrange(len(s))
        out |= {s[:i] + r.choice("abx") + s[i:], s[:i] + s[i + 1 :], s[i:] + "kit"}
    return sorted(x for x in out if x)


def test_close_and_contained_are_all_pairs(spark):
    a, b = names(1, 60), names(2, 60) + names(1, 20)
    b = sorted(set(b))
    left, right = (spark.createDataFrame([(x,) for x in xs], "s string") for xs in (a, b))
    x, y = similarity.ordered_bigrams(left, right)
    long = [(p, q) for p in a for q in b if len(p) > 1 and len(q) > 1]
    assert {(r.a, r.b) for r in similarity.contained(x, y).collect()} == {(p, q) for p, q in long if p in q or q in p}
    for least in (0.5, 0.84, 1.0):
        want = {(p, q) for p, q in long if SequenceMatcher(None, p, q).ratio() >= least and set(p[i : i + 2] for i in range(len(p))) & set(q[i : i + 2] for i in range(len(q)))}
        got = {(r.a, r.b) for r in similarity.close(x, y, least).collect()}
        assert {(p, q) for p, q in got if p != q} <= want and (got >= want if least > 0.8 else True)


def test_alignment(spark):
    a, b = names(5, 50), names(6, 40) + names(5, 10)
    known = {s: k for k, s in reversed(list(enumerate(b)))}
    got = {r.name: (r.aligned, r.how) for r in retrieval.align(spark.createDataFrame([(x,) for x in [*a, None, a[0]]], "name string"), spark.createDataFrame(list(enumerate(b)), "pos int, name string")).collect()}
    assert set(got) == set(a)
    for s in a:
        inside = [q for q in known if len(s) > 1 and len(q) > 1 and (q in s or s in q)]
        near = [(SequenceMatcher(None, s, q).ratio(), -known[q], q) for q in known if len(s) > 1 and len(q) > 1]
        best = max(near, default=(0,))
        want = (s, "exact") if s in known else (min(inside, key=known.get), "contained") if inside else (best[2], "close") if best[0] >= 0.84 else (s, "itself")
        assert got[s] == want
