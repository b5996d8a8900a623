r"""URL filters on a bit-parallel wildcard automaton.

Glob rules are packed, one bit for each character to be matched, into masks of
several 64-bit words. One Shift-And step moves all rules over one character:
``state = ((state << 1) & accepts[c]) | (state & loops[c])``. A batch of
canonical URLs is simulated together, a character of all of them at a time, the
longest first, so that finished ones leave the front of the arrays.

The canonical URL is ``.host/path``. In a rule ``*`` stands for any run without
``/``, ``**`` for any run, ``?`` for one character but ``/``; a rule of
(host, path) is the glob ``*.host`` + path + ``**``, which fits the host and all
its subdomains. The longest rule wins; without one the verdict is ``default``.

Edge cases: a null URL or one without ``://`` has empty host and path and fits
no rule; repeated rows are judged each; an empty table gives an empty result;
characters that no rule names share one mask; rules beyond ``block_rules`` are
simulated in blocks. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as columns."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    empty = lambda c: F.coalesce(c, F.lit(""))
    return empty(ascii_lower(host)), empty(path)


def rule_glob(host: str, path: str) -> str:
    special = lambda s: s.translate({ord(c): "\\" + c for c in "\\*?"})
    return "*." + special(host) + special(path) + "**"


class Automaton:
    """Masks of many globs. ``alphabet`` has the code points that rules name; all
    others share the last column, ``/`` always has its own."""

    def __init__(self, globs: list[str]):
        tokens = [self._tokens(g) for g in globs]
        named = sorted({ord("/")} | {ord(c) for t in tokens for kind, c in t if kind == "char"})
        self.alphabet = np.array(named, np.uint32)
        bits = sum(1 + sum(kind in ("char", "one") for kind, _ in t) for t in tokens)
        words = max(1, -(-bits // 64))
        self.accepts = np.zeros((len(named) + 1, words), np.uint64)
        self.loops = np.zeros((len(named) + 1, words), np.uint64)
        self.start = np.zeros(words, np.uint64)
        self.final = np.zeros(len(globs), np.int64)
        slash, at = named.index(ord("/")), 0
        for k, glob in enumerate(tokens):
            self.start[at // 64] |= np.uint64(1) << np.uint64(at % 64)
            for kind, c in glob:
                if kind in ("char", "one"):
                    at += 1
                word, bit = at // 64, np.uint64(1) << np.uint64(at % 64)
                if kind == "char":
                    self.accepts[named.index(ord(c)), word] |= bit
                    continue
                mask = self.accepts if kind == "one" else self.loops
                rows = np.ones(len(named) + 1, bool)
                rows[slash] = kind == "all"
                mask[rows, word] |= bit
            self.final[k] = at
            at += 1

    @staticmethod
    def _tokens(glob: str) -> list[tuple[str, str]]:
        out, i = [], 0
        while i < len(glob):
            if glob[i] == "\\":
                out.append(("char", glob[i + 1]))
                i += 2
            elif glob.startswith("**", i):
                out.append(("all", ""))
                i += 2
            else:
                out.append(({"*": "run", "?": "one"}.get(glob[i], "char"), glob[i]))
                i += 1
        return out

    def matches(self, urls: list[str]) -> np.ndarray:
        """(URL, rule) booleans."""
        raw = [np.frombuffer(u.encode("utf-32-le"), np.uint32) for u in urls]
        lengths = np.array([len(r) for r in raw], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([*raw, np.zeros(0, np.uint32)])
        place = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        column = np.where(self.alphabet[place] == flat, place, len(self.alphabet))
        first = (np.cumsum(lengths) - lengths)[order]
        left = lengths[order]
        state = np.tile(self.start, (len(urls), 1))
        live = len(urls)
        for p in range(int(left[0]) if len(urls) else 0):
            while live and left[live - 1] <= p:
                live -= 1
            c = column[first[:live] + p]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.accepts[c]) | (now & self.loops[c])
        hit = state[:, self.final // 64] >> (self.final % 64).astype(np.uint64) & np.uint64(1)
        out = np.zeros(hit.shape, bool)
        out[order] = hit.astype(bool)
        return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow", block_rules: int = 4096) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``."""
    ranked = sorted(dict.fromkeys(rules), key=lambda r: (len(r[1]) + len(r[2]), r))
    blocks = [ranked[i : i + block_rules] for i in range(0, len(ranked), block_rules)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [(b, Automaton([rule_glob(h, p) for _, h, p in b])) for b in blocks]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                hosts, paths = part.column(1).to_pylist(), part.column(2).to_pylist()
                rule: list[str | None] = [None] * len(hosts)
                verdict = [default] * len(hosts)
                urls = [f".{h}{p}" if h or p else "" for h, p in zip(hosts, paths)]
                for names, automaton in automata:  # later rules are longer
                    for u, r in zip(*(x.tolist() for x in np.nonzero(automaton.matches(urls)))):
                        verdict[u], rule[u] = names[r][0], names[r][1] + names[r][2]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = parts(F.col("url").cast("string"))
    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
