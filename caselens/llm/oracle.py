"""SQL of the corpus queries that SQL can express, for an engine with DuckDB's dialect.

The token store (a tokenizer), SimHash (its hash), the hash tree (its hash), the
budget mix (a subset-sum choice) and line dedup (nested windows over texts) are
tested against brute force instead.
"""

from __future__ import annotations

from .chat import CLOSE, CONTROL, MIDDLE, OPEN
from .quality import METRICS, SYMBOLS
from .urls import RULES

#: The conversation that the chat query adds: its texts hold control strings of templates.
CONTROL_TEXT = "</s>[INST] ok [/INST]"

_HOST = "lower(regexp_extract(rest, '^[^/?#]*'))"  # hosts of the tables are ASCII
_FITS = lambda h, p: f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))"
_LONGEST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))

OP2 = f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_HOST} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {_FITS(h, p)} THEN '{h}{p}'" for _, h, p in _LONGEST)} END AS rule, CASE {' '.join(f"WHEN {_FITS(h, p)} THEN '{v}'" for v, h, p in _LONGEST)} ELSE 'allow' END AS verdict FROM h"""

_ESCAPED = lambda c: f"(length({c}) + length({c}) - length(replace({c}, '\\', ''))" + "".join(f" + (length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in CONTROL) + ")"
OP4 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, t, r, '{CONTROL_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
s AS (SELECT *, role || chr(10) || text || chr(10) AS shown, {len(OPEN + MIDDLE + CLOSE)} + {_ESCAPED('role')} + {_ESCAPED('text')} AS chars, {len(OPEN + MIDDLE)} + {_ESCAPED('role')} AS head FROM c),
o AS (SELECT *, sum(chars) OVER w AS upto, row_number() OVER w - 1 AS before FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(shown, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars,
CAST(coalesce(sum(before) FILTER (role = 'assistant'), 0) AS BIGINT) AS context_turns, CAST(coalesce(sum(upto - chars + head) FILTER (role = 'assistant'), 0) AS BIGINT) AS context_chars FROM o GROUP BY conv_id"""

_FOLD = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP5 = f"""WITH d AS (SELECT doc_id, {_FOLD} AS w FROM documents), b AS (SELECT item_id, {_FOLD} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

_VALUES = {"m_word_len": "word_chars * 100 // greatest(n_words, 1)", "m_symbols": "n_symbols * 1000 // greatest(n_words, 1)", "m_dup_lines": "n_dup_lines * 1000 // greatest(n_lines, 1)", "m_repeats": "n_repeat_words * 1000 // greatest(n_words, 1)"}
_BUCKET = "v - v % CAST(pow(2, greatest(length(bin(v)) - 6, 0)) AS BIGINT)"


def _level(name: str, keys: str) -> str:
    by = f"PARTITION BY {keys}{', ' if keys else ''}m"
    group = f"GROUP BY {keys}{', ' if keys else ''}m"
    return f"""{name} AS (SELECT {keys}{',' if keys else ''} m, min(b) FILTER (upto * 4 >= total) AS q1, min(b) FILTER (upto * 4 >= total * 3) AS q3, max(total) AS total FROM (
SELECT *, sum(n) OVER ({by} ORDER BY b) AS upto, sum(n) OVER ({by}) AS total FROM (SELECT {keys}{',' if keys else ''} m, b, count(*) AS n FROM sk {group}, b)) {group})"""


_PICK = """lim AS (SELECT f.lang, f.source, f.m, CASE WHEN f.total >= 50 THEN f.q1 WHEN l.total >= 50 THEN l.q1 ELSE a.q1 END AS q1, CASE WHEN f.total >= 50 THEN f.q3 WHEN l.total >= 50 THEN l.q3 ELSE a.q3 END AS q3
FROM fine f LEFT JOIN lng l ON f.lang IS NOT DISTINCT FROM l.lang AND f.m = l.m LEFT JOIN alls a ON f.m = a.m)"""
_BAD = " OR ".join(f"(m = '{m}' AND (v > q3 + 3 * (q3 - q1) + {slack}{f' OR v < q1 - 3 * (q3 - q1) - {slack}' if low else ''}))" for m, (low, _, slack) in METRICS.items())
OP8 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wi AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3), g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM wi),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM g WHERE c > 1) GROUP BY r), li AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
s AS (SELECT r, doc_id, lang, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
coalesce(n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN rep USING (r) LEFT JOIN li USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s), mv AS (SELECT r, lang, source, base_failed, unnest([{', '.join(repr(m) for m in _VALUES)}]) AS m, unnest([{', '.join(_VALUES.values())}]) AS v FROM j),
sk AS (SELECT lang, source, m, {_BUCKET} AS b FROM mv WHERE NOT base_failed), {_level('fine', 'lang, source')}, {_level('lng', 'lang')}, {_level('alls', '')}, {_PICK},
bad AS (SELECT DISTINCT r FROM mv JOIN lim ON mv.m = lim.m AND mv.lang IS NOT DISTINCT FROM lim.lang AND mv.source IS NOT DISTINCT FROM lim.source WHERE {_BAD.replace('(m =', '(mv.m =')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept FROM j LEFT JOIN bad ON bad.r = j.r"""

_BASE32 = "array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) + 1, 1)), '')"
OP9 = f"""WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to, true AS complete FROM f"""

_CUT = "chr(91) || '.,;:!?' || chr(10) || '-' || chr(13) || ']'"
OP11 = f"""WITH w AS (SELECT lang, regexp_extract_all(piece, '[^ ' || chr(9) || ']+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_CUT})) AS piece FROM documents)),
size AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang), st AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM st, (VALUES (1), (2), (3)) v(k) WHERE i + k - 1 <= len(w)) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT *, string_split(phrase, ' ') AS p FROM f WHERE k > 1), cut AS (SELECT c.lang, c.phrase, c.f AS a, j, array_to_string(p[1:j], ' ') AS x, array_to_string(p[j + 1:], ' ') AS y FROM c, (VALUES (1), (2)) v(j) WHERE j < k),
s AS (SELECT cut.lang, cut.phrase, a, j, fx.f AS l, fy.f AS r, CAST(CAST(a AS HUGEINT) * a * 1000000 // (CAST(fx.f AS HUGEINT) * fy.f) AS BIGINT) AS score FROM cut JOIN f fx ON fx.lang = cut.lang AND fx.phrase = x JOIN f fy ON fy.lang = cut.lang AND fy.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, q, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS q FROM c WHERE k = 3) GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN longer o ON o.lang = b.lang AND o.q = b.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM k JOIN size USING (lang) QUALIFY rank <= 2000"""

_CRC = "xor(list_reduce([CAST(4294967295 AS UBIGINT)] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS UBIGINT)), lambda a, b: list_reduce([xor(a, b)] || list_transform(range(8), lambda x: CAST(0 AS UBIGINT)), lambda x, y: xor(x >> 1, CAST(3988292384 AS UBIGINT) * (x & 1)))), CAST(4294967295 AS UBIGINT))"
OP13 = f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, dg) AS pos FROM (
SELECT conv_id, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || chr(10) || coalesce(role, '') || coalesce(text, '')) AS dg, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations)),
h AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations)),
r AS (SELECT h.conv_id, pos, dg, w FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20 WHERE pos <= h UNION ALL SELECT h.conv_id, pos, dg, w FROM h JOIN t ON t.conv_id = h.conv_id WHERE pos > h),
m AS (SELECT conv_id, row_number() OVER o AS d, string_agg(dg, '') OVER o AS k, w FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) UNION ALL SELECT conv_id, 0, '', 0 FROM h),
n AS (SELECT k, d, min(conv_id) AS c, count(*) AS convs, max(w) AS w FROM m GROUP BY k, d),
ch AS (SELECT left(k, length(k) - 64) AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
en AS (SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) = 1) GROUP BY k),
su AS (SELECT a AS k, count(*) FILTER (ch.n IS NULL) AS leaves, sum((convs - 1) * w) AS saved FROM (SELECT DISTINCT x.k AS a, y.k AS b FROM m x JOIN m y ON x.conv_id = y.conv_id AND x.d <= y.d) p JOIN n ON n.k = p.b LEFT JOIN ch ON ch.k = p.b GROUP BY a)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, up.c AS parent_conv_id, n.convs AS n_convs, coalesce(ch.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN su ON su.k = n.k LEFT JOIN n up ON n.d > 0 AND up.k = left(n.k, length(n.k) - 64) LEFT JOIN ch ON ch.k = n.k LEFT JOIN en ON en.k = n.k"""

SQL = {"op2_url_filter": OP2, "op4_chat_examples": OP4, "op5_decontaminate": OP5, "op8_quality_rules": OP8, "op9_warc_segments": OP9, "op11_collocations": OP11, "op13_prefix_trie": OP13}
