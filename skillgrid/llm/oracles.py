"""SQL that each corpus query must equal, where SQL can express it."""

LLM_ORACLES: dict[str, str] = {}
PART_ORACLES: dict[str, str] = {}

LLM_ORACLES["op1_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM w
"""

# Resharing ends where target = min(3 * size, level * weight); the level is found by capping the sources one by one.
PART_ORACLES["mixing_targets"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w
  FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS k FROM s),
c AS (
  SELECT 0::BIGINT AS k, (SELECT sum(size) FROM d)::DOUBLE AS words, (SELECT sum(w) FROM s)::DOUBLE AS weight
  UNION ALL
  SELECT r.k, c.words - 3.0::DOUBLE * r.source_size, c.weight - r.w FROM c JOIN r ON r.k = c.k + 1
  WHERE c.words / c.weight * r.w > 3.0::DOUBLE * r.source_size),
l AS (SELECT words / weight AS level FROM c WHERE weight > 0 ORDER BY k DESC LIMIT 1)
SELECT d.doc_id, d.size, r.source_size, round(least(3.0::DOUBLE * r.source_size, coalesce(l.level, 0) * r.w), 6) AS target
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN l ON true
"""

PART_ORACLES["license_words"] = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (SELECT * FROM (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'),
                            (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) AS t(words, label)),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS n FROM d),
f AS (
  SELECT doc_id, n, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
h AS (
  SELECT doc_id, n, label FROM f JOIN p ON word = words[1] AND w1 = words[2]
    AND (len(words) = 2 OR (w2 = words[3] AND w3 = words[4])))
SELECT d.doc_id, len(ws)::BIGINT AS n_words, count(label) AS n_base, min(n)::BIGINT AS first_word,
       max(n)::BIGINT AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id, ws
"""

LLM_ORACLES["op9_line_dedup"] = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
v AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS v,
             len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 50 AS passage FROM l),
e AS (
  SELECT *, CASE WHEN (v + 31 * coalesce(lag(v) OVER w, 0)) % 3 = 0 OR lead(v) OVER w IS NULL OR passage
                   OR lead(passage) OVER w THEN 1 ELSE 0 END AS cut
  FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
c AS (
  SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS chunk FROM e),
g AS (
  SELECT doc_id, chunk, count(*) AS n_lines, count(*) >= 2 OR bool_or(passage) AS whole,
         string_agg(line, chr(10) ORDER BY n) AS body FROM c GROUP BY doc_id, chunk),
r AS (
  SELECT *, whole AND trim(body) <> ''
    AND row_number() OVER (PARTITION BY body, whole ORDER BY doc_id, chunk) > 1 AS gone FROM g),
o AS (
  SELECT doc_id, sum(n_lines)::BIGINT AS n_lines, coalesce(sum(n_lines) FILTER (gone), 0)::BIGINT AS removed_lines,
         count(*) FILTER (gone) AS removed_chunks,
         coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '') AS kept
  FROM r GROUP BY doc_id)
SELECT doc_id, n_lines, removed_lines, removed_chunks, md5(kept) AS text_md5, length(kept) AS kept_chars FROM o
"""

LLM_ORACLES["op7_vector_search"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id) QUALIFY row_number() OVER w <= 10
"""

LLM_ORACLES["op8_jaccard_join"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN
    list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

REPEATED_PASSAGES = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
w AS (SELECT *, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS pair FROM l),
p AS (
  SELECT doc_id, n, 2 AS k, pair AS body FROM w WHERE regexp_matches(pair, '[^\\x20\\x09-\\x0D]')
  UNION ALL
  SELECT doc_id, n, 1, line FROM w WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 50),
r AS (
  SELECT *, first_value(doc_id) OVER f AS first_id, first_value(n) OVER f AS first_n
  FROM p WINDOW f AS (PARTITION BY body, k ORDER BY doc_id, n)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(n, n + k)) AS n FROM r WHERE doc_id <> first_id OR n - first_n >= k),
m AS (SELECT l.*, g.n IS NOT NULL AS gone, h.n IS NOT NULL AS also FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.n = l.n
      LEFT JOIN gone h ON h.doc_id = l.doc_id AND h.n = l.n - 1),
o AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS removed_lines,
         count(*) FILTER (gone AND NOT also) AS removed_passages,
         coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT doc_id, n_lines, removed_lines, removed_passages, md5(kept) AS text_md5, length(kept) AS kept_chars FROM o
"""
