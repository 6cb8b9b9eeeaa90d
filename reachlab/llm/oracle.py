"""DuckDB SQL for the queries that SQL can express, straight from their definitions.

Tokenisers, trained models, eigenvectors and pseudorandom draws have no SQL form: packing,
mixing, fertility, secrets, token files, token counts and whitening are tested by brute
force instead.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE: dict[str, str] = {}

ORACLE["op2_tag_path_text"] = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(h1|p|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a),
c AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(replace(
    x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&nbsp;', ' '),
    '&amp;?', '&', 'g') AS x
  FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

ORACLE["op3_warc_pages"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
  FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM f
"""

ORACLE["op5_line_windows"] = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, pos, line, lead(pos, 1) OVER d AS pos_2, lead(pos, 2) OVER d AS pos_3,
         lead(line, 1) OVER d AS line_2, lead(line, 2) OVER d AS line_3
  FROM l WHERE regexp_matches(line, '{_WORD}') WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
n AS (
  SELECT doc_id, pos, pos_2, pos_3, row_number() OVER (PARTITION BY line, line_2, line_3 ORDER BY doc_id, pos) AS k
  FROM w WHERE pos_3 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos_2, pos_3]) AS pos FROM n WHERE k > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, k.text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

ORACLE["op6_minhash_groups"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT pair.a, pair.b FROM pair JOIN sized x ON pair.a = x.doc_id JOIN sized y ON pair.b = y.doc_id
  WHERE 100 * pair.n >= 75 * (x.n + y.n - pair.n)),
reach(node, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON d.doc_id = c.node LEFT JOIN sized z ON d.doc_id = z.doc_id
"""

ORACLE["op7_segment_top_k"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL),
p AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE["op12_phrases"] = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w), (SELECT unnest([1, 2, 3, 4, 5]) AS k)
      WHERE i + k - 1 <= len(w)),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
inner_ AS (
  SELECT DISTINCT y.lang, y.phrase FROM f x, unnest([1, 2, 3, 4]) AS s(i), unnest([2, 3, 4]) AS t(len), f y
  WHERE x.k > t.len AND s.i + t.len - 1 <= x.k AND y.lang = x.lang
    AND y.phrase = array_to_string(x.w[s.i : s.i + t.len - 1], ' ') AND 100 * x.a >= 100 * y.a),
c AS (SELECT f.* FROM f ANTI JOIN inner_ USING (lang, phrase) WHERE k > 1),
cut AS (
  SELECT c.lang, c.phrase, c.a, s.i AS pos, l.a AS l, r.a AS r, n.n,
         CAST((1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM c, unnest([1, 2, 3, 4]) AS s(i), f l, f r, n
  WHERE s.i < c.k AND l.lang = c.lang AND r.lang = c.lang AND n.lang = c.lang
    AND l.phrase = array_to_string(c.w[1 : s.i], ' ') AND r.phrase = array_to_string(c.w[s.i + 1 : c.k], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM top WHERE rank <= 2000
"""
