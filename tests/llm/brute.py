"""Plain one-process versions of the contracts, to compare results with."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def token_rows(docs, vocabulary):
    """doc_id -> (start, n, crc) for distinct ids."""
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = True
    out, at = {}, 0
    for i, text in sorted(docs, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def url(u):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    return host, path


def url_rule(host, path, rules):
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def contamination(text, items, size=13):
    """(n_words, n_hit, item ids) for one text; items: (id, text)."""
    words = FOLD_WORDS.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        own = FOLD_WORDS.findall((body or "").translate(LOWER))
        for k in range(max(1, len(own) - size + 1)) if own else ():
            w = own[k : k + size]
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
    return len(words), len(hit), found


def simhash(text):
    w = SPACE_WORDS.findall((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, threshold=2):
    """doc_id -> least doc_id reachable over fingerprints that are near; prints: (id, fp)."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, x) in enumerate(prints):
        for b, y in prints[:k]:
            if (x ^ y).bit_count() <= threshold:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in prints}


def text_stats(text):
    text = text or ""
    w = SPACE_WORDS.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def archive_rows(pages):
    """page_id -> (bytes, digest, type, refers_to) for distinct ids."""
    least = {}
    for i, html in pages:
        least[html or ""] = min(i, least.get(html or "", i))
    out = {}
    for i, html in pages:
        raw, first = (html or "").encode(), least[html or ""]
        out[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first)
    return out


def conversation_rows(rows):
    """conv_id -> (n, turns digest, loss chars, loss digest); rows: (conv, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def level_targets(sizes, weights=(1, 2, 3), cap=3):
    """source -> target by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, list(order), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return target


def removed_lines(docs, min_words=50):
    """doc_id -> deleted line numbers: those in a run of lines of ``min_words`` words or more
    that stands earlier, too, in another document or before the run in its own.
    docs: (id, text) with distinct ids. All places of a line are compared with all before."""
    placed, gone = {}, {}
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = [(k, x) for k, x in enumerate((text or "").split("\n")) if SPACE_WORDS.search(x)]
        sizes = [len(SPACE_WORDS.findall(x)) for _, x in lines]
        gone[doc] = set()
        runs, open_ = [], {}  # runs: (first line, last line, lines between it and its source or None)
        for j, (_, x) in enumerate([*lines, (0, None)]):
            here = {(e, i) for e, i in placed.get(x, ()) if e != doc or i < j} if x is not None else set()
            kept = {}
            for e, i in here:
                kept[e, i] = open_.pop((e, i - 1), j)
            runs += [(start, j - 1, j - 1 - i if e == doc else None) for (e, i), start in open_.items()]
            open_ = kept
            if x is not None:
                placed.setdefault(x, []).append((doc, j))
        for first, last, shift in runs:
            parts = [(first, last)] if shift is None else [(k, min(k + shift - 1, last)) for k in range(first, last + 1)]
            for a, b in parts:
                if sum(sizes[a : b + 1]) >= min_words:
                    gone[doc].update(range(lines[a][0], lines[b][0] + 1))
    return gone


def collocations(docs, max_words=3, least=10, top=2000, share=50):
    """(lang, rank, phrase, a, l, r, n, score) rows; docs: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = set()
    for p, a in cands.items():
        w = p[1:]
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                q = (p[0], *w[i : i + k])
                if q in cands and 100 * a >= share * cands[q]:
                    gone.add(q)
    rows = {}
    for p, a in cands.items():
        if p not in gone:
            cuts = [(10**6 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            rows.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return {(lang, i + 1, ph.decode(), -a, x, y, n[lang], -s) for lang, rs in rows.items() for i, (s, a, ph, x, y) in enumerate(sorted(rs)[:top])}


def trie(rows):
    """Rows of the prefix trie; rows: (conv, turn, role, text) with distinct turns."""
    own = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    members, ends = {}, {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        base = None if c is None else c - (c % 20 if c >= 0 else -(-c % 20))
        built = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(built) + 1):
            members.setdefault(built[:d], []).append(c)
        ends.setdefault(built, []).append(c)
    children = Counter(p[:-1] for p in members if p)
    first = lambda p: min((c for c in members[p] if c is not None), default=None)
    saved, leaves = Counter(), Counter()
    for p, held in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(held) - 1) * (len(SPACE_WORDS.findall(p[-1][1])) if p else 0)
            leaves[p[:d]] += not children[p]
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(c for c in ends.get(p, []) if c is not None)).encode()).hexdigest()
    return sorted(((first(p), len(p), first(p[:-1]) if p else None, len(held), children[p], leaves[p], saved[p], digest(p)) for p, held in members.items()), key=repr)
