"""SQL forms (DuckDB) of the results that SQL can express.  They take other
ways than the operators: recursion over sorted runs, all pairs of a small
table, sets of words without one letter."""

from __future__ import annotations

from salescope.llm.common import LOWER, UPPER


def crc32(s: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a string expression, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
      list_transform(range(0, octet_length(encode({s}))),
        lambda i: ('0x' || substr(hex(encode({s})), (2 * i + 1)::BIGINT, 2))::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


def _leaf(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
             for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


# A level at a time: every node keeps its run's digests; the groups by lang,
# then their subroots as one more group.  ``path`` collects what stands left
# and right of a row's node on each level.
OP11 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf('text')} AS leaf,
         CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0
              THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS n FROM d),
up AS (
  SELECT lang, 0 AS lv, i, n, leaf AS h FROM ranked
  UNION ALL
  SELECT lang, lv + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM up WHERE n > 1 GROUP BY lang, lv, i // 8),
subs AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lv, i, n, h FROM subs
  UNION ALL
  SELECT lv + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM top WHERE n > 1 GROUP BY lv, i // 8),
steps AS (
  SELECT r.doc_id, r.leaf, r.lang, r.i AS slot, u.lv,
         coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < r.i // (8 ** u.lv)::BIGINT), '') AS l,
         coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > r.i // (8 ** u.lv)::BIGINT), '') AS r
  FROM ranked r JOIN up u ON u.lang IS NOT DISTINCT FROM r.lang AND u.n > 1
       AND u.i // 8 = r.i // (8 ** (u.lv + 1))::BIGINT
  GROUP BY r.doc_id, r.leaf, r.lang, r.i, u.lv
  UNION ALL
  SELECT r.doc_id, r.leaf, r.lang, r.i, 100 + t.lv,
         coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < s.i // (8 ** t.lv)::BIGINT), ''),
         coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > s.i // (8 ** t.lv)::BIGINT), '')
  FROM ranked r JOIN subs s ON s.lang IS NOT DISTINCT FROM r.lang
  JOIN top t ON t.n > 1 AND t.i // 8 = s.i // (8 ** (t.lv + 1))::BIGINT
  GROUP BY r.doc_id, r.leaf, r.lang, r.i, t.lv),
proofs AS (
  SELECT lang, slot, string_agg(l || r, '' ORDER BY lv) AS whole,
         list(struct_pack(l := l, r := r) ORDER BY lv) AS path FROM steps GROUP BY lang, slot),
folded AS (
  SELECT r.*, coalesce(p.whole, '') AS whole, coalesce(
    list_reduce(list_concat([coalesce(r.changed, r.leaf)],
                list_transform(p.path, lambda x: x.l || '/' || x.r)),
      lambda a, b: sha256(split_part(b, '/', 1) || a || split_part(b, '/', 2))),
    coalesce(r.changed, r.leaf)) AS f
  FROM ranked r LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM r.lang AND p.slot = r.i)
SELECT f.doc_id, f.leaf, s.h AS subroot, t.h AS root, sha256(f.whole) AS proof_sha256,
       f.f AS folded_root, f.f = t.h AS verified
FROM folded f JOIN subs s ON s.lang IS NOT DISTINCT FROM f.lang
CROSS JOIN (SELECT h FROM top WHERE n = 1) t
"""

OP12 = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS no,
         list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.no, q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * c.c[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.no <> c.no AND len(q.c) = len(c.c) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""

OP13 = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'),
                     lambda x: translate(x, '{UPPER}', '{LOWER}'))) AS run FROM documents)
  GROUP BY doc_id, run),
hashed AS (SELECT *, {crc32("doc_id::VARCHAR || ':' || run")} AS h FROM runs),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 97 = 0 THEN
             substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT)
           ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cut AS (
  SELECT word, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
less AS (SELECT DISTINCT c.word, w.word AS other FROM cut c JOIN words w ON w.word = c.l || c.r),
near AS (
  SELECT word, other FROM less UNION SELECT other, word FROM less
  UNION SELECT a.word, b.word FROM cut a JOIN cut b ON a.l = b.l AND a.r = b.r AND a.word <> b.word),
best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(m := -n, w := other)) AS b
  FROM (SELECT near.word, near.other, words.n FROM near JOIN words ON words.word = near.other)
  GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN -b.m >= 2 * w.n THEN b.w END AS form,
         CASE WHEN -b.m >= 2 * w.n THEN -b.m END::BIGINT AS form_n
  FROM words w LEFT JOIN best USING (word)),
follow AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, p.root FROM forms f JOIN follow p ON f.form = p.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN follow USING (word)
"""
