"""SQL for each registered query, over the same tables."""

from __future__ import annotations

from suite.inputs import SKILL_OF_WORD, TERMS

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"

POSTINGS = f"""
words AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part),
order_skills AS (
  SELECT l_orderkey, list_sort(list(DISTINCT word)) AS skills
  FROM lineitem JOIN words ON l_partkey = p_partkey GROUP BY l_orderkey),
postings AS (
  SELECT sha256(lower(concat_ws('|', o_orderpriority, o_orderkey, o_orderstatus || ' ' || c_mktsegment, c_name))) AS job_uid,
         o_orderpriority AS source, o_orderstatus || ' ' || c_mktsegment AS title, c_name AS company,
         n_name AS location, c_mktsegment AS role, array_to_string(skills, ' ') AS description,
         CAST(o_orderkey AS VARCHAR) AS url, {_ISO.format('o_orderdate')} AS scraped_at, o_orderdate AS ts, skills
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN order_skills ON l_orderkey = o_orderkey)"""

REQUESTS = """
returned AS (
  SELECT o_custkey, list_sort(list(DISTINCT word)) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) ON l_partkey = p_partkey
  WHERE l_returnflag = 'R' GROUP BY o_custkey),
raw_requests AS (
  SELECT c_custkey AS request_id, coalesce(w, ['hot', 'Welding']) AS w,
         CASE WHEN r_name = 'EUROPE' THEN 'astronaut' WHEN r_name = 'MIDDLE EAST' THEN ''
              WHEN r_name = 'ASIA' AND c_acctbal < 0 THEN '  ' ELSE c_mktsegment END AS role,
         CASE WHEN r_name = 'AMERICA' THEN 'Nobody Inc' WHEN r_name = 'MIDDLE EAST' THEN NULL
              WHEN r_name = 'EUROPE' AND c_acctbal < 0 THEN 'Nobody Inc' ELSE c_name END AS company,
         CASE WHEN r_name = 'ASIA' THEN 'atlantis' WHEN r_name = 'MIDDLE EAST' AND c_acctbal < 0 THEN NULL
              ELSE n_name END AS region,
         c_nationkey % 12 + 1 AS top_n, c_nationkey % 5 + 1 AS lim,
         greatest(1, least(180, c_nationkey * 20 + 10)) AS days
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN returned ON o_custkey = c_custkey),
requests AS (
  SELECT request_id, list_append(w, upper(w[-1])) AS resume, company AS company_raw,
         CASE WHEN role <> '' THEN lower(trim(role)) END AS role,
         CASE WHEN company <> '' THEN lower(trim(company)) END AS company,
         CASE WHEN region <> '' THEN lower(trim(region)) END AS region, top_n, lim, days
  FROM raw_requests)"""

DEMAND = """
demand AS (
  SELECT lower(trim(role)) AS role_norm, lower(trim(company)) AS company_norm, lower(trim(location)) AS location_norm,
         skill, count(*) AS demand_count
  FROM (SELECT role, company, location, unnest(skills) AS skill FROM postings) GROUP BY ALL)"""

RELAXED = """
levels AS (
  SELECT request_id, 1 AS lvl, 'snapshot_role_company_region' AS label, role, company, region FROM requests
  UNION ALL SELECT request_id, 2, 'snapshot_role_region', role, NULL, region FROM requests
    WHERE role IS NOT NULL AND company IS NOT NULL AND region IS NOT NULL
  UNION ALL SELECT request_id, 3, 'snapshot_role_company', role, company, NULL FROM requests
    WHERE role IS NOT NULL AND company IS NOT NULL
  UNION ALL SELECT request_id, 4, 'snapshot_role_only', role, NULL, NULL FROM requests WHERE role IS NOT NULL
  UNION ALL SELECT request_id, 5, 'snapshot_region_only', NULL, NULL, region FROM requests WHERE region IS NOT NULL
  UNION ALL SELECT request_id, 6, 'snapshot_global', NULL, NULL, NULL FROM requests),
tried AS (SELECT DISTINCT role, company, region FROM levels),
sums AS (
  SELECT t.role, t.company, t.region, d.skill, sum(d.demand_count) AS n
  FROM tried t JOIN demand d ON (t.role IS NULL OR d.role_norm = t.role)
   AND (t.company IS NULL OR d.company_norm = t.company) AND (t.region IS NULL OR d.location_norm = t.region)
  GROUP BY ALL),
backed AS (SELECT DISTINCT role, company, region FROM sums),
chosen AS (
  SELECT l.* FROM levels l JOIN backed b ON l.role IS NOT DISTINCT FROM b.role
   AND l.company IS NOT DISTINCT FROM b.company AND l.region IS NOT DISTINCT FROM b.region
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY lvl) = 1),
full_demand AS (
  SELECT c.request_id, c.label AS market_source, s.skill, CAST(s.n AS BIGINT) AS demand_count,
         CAST(row_number() OVER (PARTITION BY c.request_id ORDER BY s.n DESC, s.skill) AS INTEGER) AS rank
  FROM chosen c JOIN sums s ON s.role IS NOT DISTINCT FROM c.role AND s.company IS NOT DISTINCT FROM c.company
   AND s.region IS NOT DISTINCT FROM c.region),
relaxed AS (SELECT f.* FROM full_demand f JOIN requests r USING (request_id) WHERE f.rank <= r.top_n)"""

GAP = """
flags AS (
  SELECT d.*, r.resume, r.top_n, list_contains(list_transform(r.resume, lambda x: lower(x)), lower(d.skill)) AS has
  FROM relaxed d JOIN requests r USING (request_id)),
missing AS (
  SELECT request_id, skill, demand_count, top_n,
         CAST(row_number() OVER (PARTITION BY request_id ORDER BY rank) AS INTEGER) AS rank
  FROM flags WHERE NOT has),
matching AS (
  SELECT request_id, skill_shown AS skill, demand_count,
         CAST(row_number() OVER (PARTITION BY request_id ORDER BY demand_count DESC, first_at) AS INTEGER) AS rank
  FROM (SELECT f.request_id, f.demand_count, list_position(list_transform(f.resume, lambda x: lower(x)), lower(f.skill)) AS first_at,
               list_filter(f.resume, lambda x: lower(x) = lower(f.skill))[-1] AS skill_shown
        FROM flags f WHERE has))"""

MARKET = f"WITH {POSTINGS},{DEMAND}"
ASKED = f"WITH {POSTINGS},{REQUESTS},{DEMAND},{RELAXED}"
GAPS = f"{ASKED},{GAP}"

# None of the words in the given part names falls into a category; the rules are spelled out all the same.
CATEGORY = """CASE
  WHEN regexp_matches(lower(skill), 'python|java|c\\+\\+|c#|go|rust|ruby|php') THEN 'Programming Language'
  WHEN regexp_matches(lower(skill), 'aws|azure|gcp|cloud') THEN 'Cloud Platform'
  WHEN regexp_matches(lower(skill), 'sql|mongodb|redis|cassandra') THEN 'Database Technology'
  WHEN regexp_matches(lower(skill), 'machine learning|deep learning|tensorflow|pytorch|ai') THEN 'AI/Machine Learning'
  WHEN regexp_matches(lower(skill), 'docker|kubernetes|jenkins|terraform|ansible') THEN 'DevOps/Infrastructure'
  WHEN regexp_matches(lower(skill), 'react|angular|vue|django|flask|node') THEN 'Web Framework'
  WHEN regexp_matches(lower(skill), 'spark|kafka|airflow|hadoop|hive') THEN 'Data Engineering'
  ELSE '' END"""

# The same questions over skills of every category.
_SKILL_OF_WORD = "CASE w " + " ".join(f"WHEN '{w}' THEN '{k}'" for w, k in SKILL_OF_WORD.items()) + " ELSE w END"
_NAMED_PARTS = f"SELECT p_partkey, {_SKILL_OF_WORD} AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)"
NAMED_GAPS = GAPS.replace("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part", _NAMED_PARTS).replace(
    "c_nationkey % 12 + 1 AS top_n", "100 AS top_n")
FAR_REQUESTS = REQUESTS.replace(
    "  FROM raw_requests)", """  FROM (SELECT * REPLACE (CASE WHEN request_id % 2 = 0 THEN 'Nobody Inc' ELSE company END AS company,
                          CASE WHEN request_id % 2 = 0 THEN 'atlantis' ELSE region END AS region) FROM raw_requests))""")

COPIES = f"""
copies AS (
  SELECT job_uid, source, url, role || ' later' AS role, {_ISO.format("ts + INTERVAL 30 DAY")} AS scraped_at,
         ts + INTERVAL 30 DAY AS ts FROM postings WHERE source = '1-URGENT'
  UNION ALL SELECT job_uid, source, url, role || ' undated', 'not a date', NULL FROM postings WHERE source = '2-HIGH'),
every_copy AS (SELECT job_uid, source, url, role, scraped_at, ts FROM postings UNION ALL SELECT * FROM copies)"""
LATEST = f"""WITH {POSTINGS},{COPIES}
SELECT job_uid, role, scraped_at FROM every_copy
QUALIFY row_number() OVER (PARTITION BY job_uid ORDER BY ts DESC NULLS LAST, source, url, role) = 1"""

# Three batches: medium ones come again last, with a later date, without their first skill and written otherwise.
AFTER_BATCHES = f"""WITH {POSTINGS.replace('postings AS', 'first_copies AS')},
later_copies AS (
  SELECT job_uid, role || CASE WHEN source = '1-URGENT' THEN ' later' ELSE '' END AS role, company, location,
         CASE WHEN source = '3-MEDIUM' THEN skills[2:] ELSE skills END AS skills FROM first_copies),
postings AS (SELECT * FROM later_copies), {DEMAND.strip()}"""

# Letters outside ASCII count as word characters, other signs outside ASCII as blanks.
_MASK = r"regexp_replace(regexp_replace({}, '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TERM_ROWS = ", ".join(f"({i}, '{t}', '{t.title()}')" for i, t in enumerate(TERMS.terms))
TERMS_CTE = f"terms(position, term, skill) AS (VALUES {_TERM_ROWS})"


def _mentions(texts: str, key: str, text: str = "text") -> str:
    """CTE ``mentions`` over a table expression with a key and a text."""
    return rf"""{TERMS_CTE},
masked AS (SELECT {key}, {_MASK.format(f'lower({text})')} AS m FROM {texts}),
mentions AS (
  SELECT {key}, position, skill, CAST(len(regexp_extract_all(m, '\b' || term || '\b')) AS BIGINT) AS mentions
  FROM masked CROSS JOIN terms WHERE regexp_matches(m, '\b' || term || '\b'))"""


def _chunks(texts: str, keys: str, key: str, text: str = "text") -> str:
    return f"""split AS (SELECT {keys}, list_filter(regexp_split_to_array({text}, '{_SPACE}+'), lambda x: x <> '') AS w FROM {texts}),
chunks AS (
  SELECT {keys}, CAST((s - 1) // 610 AS INTEGER) AS chunk, array_to_string(w[s:s + 699], ' ') AS chunk_text
  FROM (SELECT {keys}, w, unnest(range(1, greatest(0, len(w) - 91) + 2, 610)) AS s FROM split WHERE len(w) > 0))"""


_UNPRINTABLE = (r"[\x00-\x09\x0B-\x1F\x7F-\x{9F}\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}"
                r"\x{205F}\x{3000}]")


def _clean(text: str) -> str:
    steps = [(r"\r\n?", "chr(10)"), (r"\t+", "' '"), (r"\n{3,}", "chr(10) || chr(10)"), (" {2,}", "' '"),
             (_UNPRINTABLE, "''")]
    for pattern, replacement in steps:
        text = f"regexp_replace({text}, '{pattern}', {replacement}, 'g')"
    return f"trim({text}, ' ' || chr(10))"


_LIST = "(SELECT string_agg({0}, ',' ORDER BY {0}) FROM {1})"

_CENTROIDS = f"""{TERMS_CTE},
vectors AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
means AS (
  SELECT label, list(mean ORDER BY pos) AS v FROM (
    SELECT label, pos, avg(x) AS mean FROM (
      SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)
    GROUP BY label, pos) GROUP BY label),
labelled AS (SELECT skill AS name, v FROM means JOIN terms ON label = position),
sims AS (
  SELECT doc_id, name, round_even(s, 4) AS score FROM (
    SELECT a.doc_id, b.name, list_cosine_similarity(a.v, b.v) AS s FROM vectors a CROSS JOIN labelled b)
  WHERE s >= 0.18 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, name) <= 3)"""


def _doc_mentions() -> str:
    return _mentions("documents", "doc_id").removeprefix(TERMS_CTE + ",\n")


# Titles, companies and places as the payload builder distorts them.
_PAYLOAD = """landed AS (
  SELECT *, CASE WHEN title LIKE 'F %' THEN 'Unknown' ELSE title END AS t,
         CASE WHEN title LIKE 'O %' THEN 'Unknown' ELSE company END AS c,
         CASE WHEN title LIKE 'P %' THEN NULL ELSE location END AS l,
         CASE WHEN role <> 'BUILDING' THEN role END AS searched, array_to_string(skills, ' ') AS d FROM postings)"""

ORACLES: dict[str, str] = {
    "posting_key": f"WITH {POSTINGS} SELECT url, job_uid FROM postings",
    "latest_posting": LATEST,
    "posting_upsert": LATEST,
    "first_posting": f"""WITH {POSTINGS},{COPIES},
        runs AS (SELECT job_uid, role, scraped_at, 2 AS run FROM postings
                 UNION ALL SELECT job_uid, role, scraped_at, 1 FROM copies)
        SELECT job_uid, role, run FROM runs
        QUALIFY row_number() OVER (PARTITION BY job_uid ORDER BY run, role, scraped_at) = 1""",
    "demand_after_upserts": f"""{AFTER_BATCHES} SELECT * FROM demand""",
    "segments_after_upserts": f"""{AFTER_BATCHES} SELECT kept, role_key, company_key, location_key, skill,
        CAST(sum(demand_count) AS BIGINT) AS demand_count FROM (
          SELECT mask AS kept, CASE WHEN mask >= 4 THEN role_norm ELSE '' END AS role_key,
                 CASE WHEN mask % 4 >= 2 THEN company_norm ELSE '' END AS company_key,
                 CASE WHEN mask % 2 = 1 THEN location_norm ELSE '' END AS location_key, skill, demand_count
          FROM demand CROSS JOIN (SELECT CAST(unnest(range(8)) AS INTEGER) AS mask)) GROUP BY ALL""",
    "demand_rollup": f"{MARKET} SELECT * FROM demand",
    "segment_demand_topn": f"""{MARKET} SELECT skill, CAST(sum(demand_count) AS BIGINT) AS demand_count FROM demand
        WHERE role_norm = 'building' AND location_norm = 'nation_3' GROUP BY skill
        ORDER BY demand_count DESC, skill LIMIT 10""",
    "demand_cube": f"""{MARKET} SELECT
          CAST(7 - grouping(role_norm, company_norm, location_norm) AS INTEGER) AS kept,
          coalesce(role_norm, '') AS role_key, coalesce(company_norm, '') AS company_key,
          coalesce(location_norm, '') AS location_key, skill, CAST(sum(demand_count) AS BIGINT) AS demand_count
        FROM demand GROUP BY skill, CUBE (role_norm, company_norm, location_norm)""",
    "demand_relaxed": f"{ASKED} SELECT request_id, market_source, rank, skill, demand_count FROM relaxed",
    "demand_exact": f"""{ASKED},
        own AS (
          SELECT r.request_id, r.top_n, s.skill, CAST(s.n AS BIGINT) AS demand_count,
                 CAST(row_number() OVER (PARTITION BY r.request_id ORDER BY s.n DESC, s.skill) AS INTEGER) AS rank
          FROM requests r JOIN sums s ON s.role IS NOT DISTINCT FROM r.role
           AND s.company IS NOT DISTINCT FROM r.company AND s.region IS NOT DISTINCT FROM r.region),
        baseline(rank, skill, demand_count) AS (VALUES (1, 'Python', 250), (2, 'SQL', 200), (3, 'AWS', 180),
          (4, 'Docker', 150), (5, 'Kubernetes', 120), (6, 'Java', 110), (7, 'React', 100), (8, 'Git', 90),
          (9, 'Machine Learning', 85), (10, 'TensorFlow', 70), (11, 'Spark', 65), (12, 'Kafka', 60))
        SELECT request_id, 'market_snapshot' AS market_source, rank, skill, demand_count FROM own WHERE rank <= top_n
        UNION ALL
        SELECT request_id, 'baseline_default', rank, skill, CAST(demand_count AS BIGINT) FROM requests
        CROSS JOIN baseline WHERE rank <= top_n AND request_id NOT IN (SELECT request_id FROM own)""",
    "gap_matching": f"{GAPS} SELECT request_id, rank, skill, demand_count FROM matching",
    "gap_missing": f"""{GAPS} SELECT request_id, rank, skill, demand_count FROM missing
        WHERE rank <= greatest(20, 2 * greatest(5, least(100, top_n)))""",
    "gap_score": f"""{GAPS} SELECT f.request_id, any_value(market_source) AS market_source,
          CAST(trunc(CAST(coalesce(sum(demand_count) FILTER (has), 0) AS DOUBLE) / CAST(sum(demand_count) AS DOUBLE)
               * 100) AS INTEGER) AS skill_score,
          CAST(any_value(len(resume)) AS INTEGER) AS resume_skill_count, CAST(count(*) AS INTEGER) AS market_skill_count,
          CAST(count(*) FILTER (has) AS INTEGER) AS match_count, CAST(count(*) FILTER (NOT has) AS INTEGER) AS gap_count
        FROM flags f GROUP BY f.request_id""",
    "gap_recommendations": f"""{GAPS}, labelled AS (SELECT *, {CATEGORY} AS category FROM missing)
        SELECT request_id, rank, skill, CASE WHEN rank <= 5 THEN 'High' ELSE 'Medium' END AS priority,
          CASE WHEN demand_count > 100 THEN 'Extremely high demand (' || demand_count || '+ job postings)'
               WHEN demand_count > 50 THEN 'Very high demand (' || demand_count || ' job postings)'
               WHEN demand_count > 20 THEN 'High demand (' || demand_count || ' job postings)'
               ELSE 'Moderate demand (' || demand_count || ' job postings)' END
          || CASE WHEN category <> '' THEN ' - ' || category ELSE '' END AS reason, demand_count
        FROM labelled WHERE rank <= greatest(5, least(100, top_n))""",
    "every_category_recommendations": f"""{NAMED_GAPS}, labelled AS (SELECT *, {CATEGORY} AS category FROM missing)
        SELECT request_id, rank, skill, CASE WHEN rank <= 5 THEN 'High' ELSE 'Medium' END AS priority,
          CASE WHEN demand_count > 100 THEN 'Extremely high demand (' || demand_count || '+ job postings)'
               WHEN demand_count > 50 THEN 'Very high demand (' || demand_count || ' job postings)'
               WHEN demand_count > 20 THEN 'High demand (' || demand_count || ' job postings)'
               ELSE 'Moderate demand (' || demand_count || ' job postings)' END
          || CASE WHEN category <> '' THEN ' - ' || category ELSE '' END AS reason, demand_count
        FROM labelled WHERE rank <= greatest(5, least(100, top_n))""",
    "category_gaps": f"""{GAPS}, labelled AS (SELECT *, coalesce(nullif({CATEGORY}, ''), 'Other') AS category FROM flags)
        SELECT request_id, category, CAST(count(*) AS INTEGER) AS total_skills,
          CAST(count(*) FILTER (has) AS INTEGER) AS has_skills, CAST(count(*) FILTER (NOT has) AS INTEGER) AS missing_skills,
          CAST(trunc(CAST(count(*) FILTER (has) AS DOUBLE) / count(*) * 100) AS INTEGER) AS coverage_percentage
        FROM labelled GROUP BY request_id, category""",
    "category_top_missing": f"""{GAPS}, labelled AS (SELECT *, coalesce(nullif({CATEGORY}, ''), 'Other') AS category FROM flags),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id, category, has ORDER BY rank) AS r FROM labelled)
        SELECT request_id, category,
          coalesce(string_agg(skill, ',' ORDER BY rank) FILTER (NOT has AND r <= 3), '') AS top_missing
        FROM ranked WHERE category IN ('Data Engineering', 'Other') GROUP BY request_id, category""",
    "every_category_gaps": f"""{NAMED_GAPS}, labelled AS (SELECT *, coalesce(nullif({CATEGORY}, ''), 'Other') AS category FROM flags),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id, category, has ORDER BY rank) AS r FROM labelled)
        SELECT request_id, category, CAST(count(*) AS INTEGER) AS total_skills,
          CAST(count(*) FILTER (has) AS INTEGER) AS has_skills, CAST(count(*) FILTER (NOT has) AS INTEGER) AS missing_skills,
          CAST(trunc(CAST(count(*) FILTER (has) AS DOUBLE) / count(*) * 100) AS INTEGER) AS coverage_percentage,
          coalesce(string_agg(skill, ',' ORDER BY rank) FILTER (NOT has AND r <= 3), '') AS missing_first
        FROM ranked GROUP BY request_id, category""",
    "demand_labels": f"""{ASKED.replace(REQUESTS, FAR_REQUESTS)},
        top_live AS (
          SELECT CAST(row_number() OVER (ORDER BY demand_count DESC, skill) AS INTEGER) AS rank, skill, demand_count FROM (
            SELECT skill, CAST(sum(demand_count) AS BIGINT) AS demand_count FROM demand WHERE role_norm = 'building' GROUP BY skill)
          QUALIFY rank <= 5),
        baseline(rank, skill, demand_count) AS (VALUES (1, 'Python', 250), (2, 'SQL', 200), (3, 'AWS', 180),
          (4, 'Docker', 150), (5, 'Kubernetes', 120), (6, 'Java', 110), (7, 'React', 100), (8, 'Git', 90),
          (9, 'Machine Learning', 85), (10, 'TensorFlow', 70), (11, 'Spark', 65), (12, 'Kafka', 60))
        SELECT 'stored' AS market, request_id, market_source, rank, skill, demand_count FROM relaxed
        UNION ALL SELECT 'live', request_id, 'live_stream', rank, skill, demand_count FROM requests CROSS JOIN top_live
        UNION ALL SELECT 'nothing', request_id, 'baseline_default', rank, skill, CAST(demand_count AS BIGINT)
        FROM requests CROSS JOIN baseline WHERE rank <= top_n""",
    "recommend_postings": f"""{ASKED},
        cand AS (
          SELECT r.request_id, r.lim, r.resume, p.job_uid, p.title, p.skills,
                 count(*) OVER (PARTITION BY r.request_id) AS in_window
          FROM requests r JOIN postings p ON (r.role IS NULL OR lower(p.role) = r.role)
           AND (r.company IS NULL OR lower(p.company) = r.company) AND (r.region IS NULL OR lower(p.location) = r.region)
          WHERE p.ts >= (SELECT max(ts) FROM postings) - to_days(CAST(r.days AS INTEGER))
          QUALIFY row_number() OVER (PARTITION BY r.request_id ORDER BY p.scraped_at DESC, p.job_uid) <= 800),
        pairs AS (
          SELECT *, list_sort(list_intersect(skills, list_transform(resume, lambda x: lower(x)))) AS matched FROM cand),
        aligned AS (
          SELECT request_id, job_uid, sum(d.demand_count) AS alignment
          FROM (SELECT request_id, job_uid, unnest(matched) AS skill FROM pairs) m
          JOIN full_demand d USING (request_id, skill) WHERE d.rank <= 100 GROUP BY ALL),
        scored AS (
          SELECT p.*, len(matched) AS m, least(100, CAST(round_even(len(matched) / len(skills) * 100, 0) AS INTEGER)
                   + least(15, 3 * len(matched))) AS fit, coalesce(a.alignment, 0) AS alignment
          FROM pairs p LEFT JOIN aligned a USING (request_id, job_uid) WHERE len(matched) > 0),
        ranked AS (
          SELECT *, count(*) OVER (PARTITION BY request_id) AS total, row_number() OVER (
            PARTITION BY request_id ORDER BY fit DESC, m DESC, alignment DESC, job_uid) AS rank FROM scored)
        SELECT request_id, CAST(total AS INTEGER) AS total, in_window AS candidates_in_window,
          CAST(least(800, in_window) AS INTEGER) AS candidates_scored, CAST(rank AS INTEGER) AS rank, job_uid, title,
          CAST(fit AS INTEGER) AS fit_score, CAST(m AS INTEGER) AS matched_count,
          CAST(alignment AS BIGINT) AS demand_alignment, CAST(len(skills) AS INTEGER) AS job_skill_count,
          array_to_string(matched, ',') AS matched_skills,
          array_to_string(list_sort(list_filter(skills, lambda x: NOT list_contains(matched, x)))[1:8], ',') AS missing_skills
        FROM ranked WHERE rank <= least(20, lim)""",
    "recommend_results": f"""WITH {POSTINGS},{REQUESTS},
        seen AS (
          SELECT r.request_id, count(p.job_uid) AS n FROM requests r LEFT JOIN postings p
            ON (r.role IS NULL OR lower(p.role) = r.role) AND (r.company IS NULL OR lower(p.company) = r.company)
           AND (r.region IS NULL OR lower(p.location) = r.region)
           AND p.ts >= (SELECT max(ts) FROM postings) - to_days(CAST(r.days AS INTEGER)) GROUP BY r.request_id)
        SELECT 'full' AS store, request_id, n AS candidates_in_window,
          CASE WHEN n > 0 THEN 'snapshot_ranked' ELSE 'snapshot_no_matches' END AS market_result FROM seen
        UNION ALL SELECT 'empty', request_id, 0, 'snapshot_empty' FROM seen
        UNION ALL SELECT 'missing', request_id, 0, 'snapshot_missing' FROM seen""",
    "recent_postings": f"""WITH {POSTINGS},{COPIES} SELECT job_uid, role, scraped_at FROM every_copy
        WHERE ts >= (SELECT max(ts) FROM every_copy) - INTERVAL 90 DAY""",
    "skill_jaccard": f"""WITH {POSTINGS},{REQUESTS},
        pairs AS (SELECT job_uid, skills, list_distinct(list_transform(resume, lambda x: lower(x))) AS own
                  FROM postings p JOIN customer ON c_name = p.company JOIN requests r ON r.request_id = c_custkey)
        SELECT job_uid, round_even(len(list_intersect(skills, own))
                 / (len(skills) + len(own) - len(list_intersect(skills, own))), 6) AS similarity FROM pairs""",
    "market_status": f"""WITH {POSTINGS} SELECT count(*) AS total_jobs, count(DISTINCT role) AS total_roles,
          count(DISTINCT company) AS total_companies, count(DISTINCT location) AS total_regions,
          max(scraped_at) AS last_scraped_at, count(*) > 0 AS snapshot_ready FROM postings""",
    "source_counts": f"WITH {POSTINGS} SELECT source, count(*) AS postings FROM postings GROUP BY source",
    "filter_options": f"""WITH {POSTINGS}, kept AS (SELECT * FROM postings WHERE lower(location) = 'nation_3'),
        vals AS (SELECT 'roles' AS kind, role AS value FROM kept UNION SELECT 'companies', company FROM kept
                 UNION SELECT 'regions', location FROM kept)
        SELECT kind, value, CAST(row_number() OVER (PARTITION BY kind ORDER BY value) AS INTEGER) AS position FROM vals
        QUALIFY position <= 20""",
    "top_titles_region": f"""WITH {POSTINGS}, n AS (SELECT lower(location) AS region, title AS name, count(*) AS postings
          FROM postings GROUP BY ALL)
        SELECT region, name, postings,
          CAST(row_number() OVER (PARTITION BY region ORDER BY postings DESC, name) AS INTEGER) AS rank FROM n
        QUALIFY rank <= 5""",
    "text_skill_mentions": f"WITH {_mentions('documents', 'doc_id')} SELECT doc_id, skill, mentions FROM mentions",
    "text_top_skills": f"""WITH {_mentions('documents', 'doc_id')} SELECT doc_id,
          CAST(row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, position) AS INTEGER) AS rank, skill, mentions
        FROM mentions QUALIFY rank <= 3""",
    "text_skill_list": f"""WITH {_mentions('documents', 'doc_id')} SELECT d.doc_id,
          coalesce(string_agg(skill, ',' ORDER BY skill), '') AS skills
        FROM documents d LEFT JOIN mentions m ON d.doc_id = m.doc_id GROUP BY d.doc_id""",
    "text_many_terms": rf"""WITH cut AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws,
         regexp_split_to_array(lower(text), '[\p{{L}}\p{{N}}_]+') AS ss FROM documents),
terms AS (SELECT DISTINCT term FROM (
  SELECT ws[1] AS term FROM cut WHERE len(ws) > 1 UNION ALL
  SELECT ws[1] || ss[2] || ws[2] FROM cut WHERE len(ws) > 1 AND ws[1] <> ws[2])),
grams AS (
  SELECT doc_id, unnest(ws) AS gram FROM cut UNION ALL
  SELECT doc_id, g[1] || g[2] || g[3] FROM (
    SELECT doc_id, unnest(list_zip(ws[:-2], ss[2:-2], ws[2:])) AS g FROM cut WHERE len(ws) > 1))
SELECT doc_id, term, count(*) AS mentions FROM grams JOIN terms ON gram = term GROUP BY ALL""",
    "required_skills": rf"""WITH needed(skill, pattern) AS (VALUES ('The', '\bthe\b'), ('by the', '\bby the\b'),
          ('rest', '\brest\b'), ('apache', '\bapache\b'), ('C++', '\bc\+\+\b'))
        SELECT doc_id, skill, regexp_matches(m, pattern) AS found
        FROM (SELECT doc_id, {_MASK.format('lower(text)')} AS m FROM documents) CROSS JOIN needed""",
    "resume_chunks_max": f"""WITH {_chunks('documents', 'doc_id', 'doc_id')},
        {_mentions('chunks', 'doc_id', 'chunk_text')}
        SELECT doc_id, skill, max(mentions) AS score FROM mentions GROUP BY ALL""",
    "resume_report": f"""WITH resumes AS (SELECT conv_id, {_clean('t')} AS text FROM (
          SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id)),
        {_chunks('resumes', 'conv_id', 'conv_id')}, {_mentions('chunks', 'conv_id', 'chunk_text')},
        found AS (SELECT conv_id, count(DISTINCT skill) AS n, string_agg(DISTINCT skill, ',' ORDER BY skill) AS skills
                  FROM mentions GROUP BY conv_id),
        sizes AS (SELECT conv_id, count(*) AS n FROM chunks GROUP BY conv_id)
        SELECT r.conv_id, CAST(length(text) AS INTEGER) AS text_length, CAST(coalesce(f.n, 0) AS INTEGER) AS skills_found,
          coalesce(skills, '') AS skills, substring(text, 1, 500) AS preview,
          CASE WHEN s.n > 0 THEN 'regex' ELSE 'empty' END AS extraction_mode,
          CASE WHEN s.n > 0 THEN {len(TERMS.terms)} ELSE 0 END AS taxonomy_size,
          CAST(coalesce(s.n, 0) AS INTEGER) AS chunks_processed
        FROM resumes r LEFT JOIN found f USING (conv_id) LEFT JOIN sizes s USING (conv_id)""",
    "extraction_summary": f"""WITH {_chunks('documents', 'doc_id, lang, source', 'doc_id')}
        SELECT doc_id, CASE WHEN count(*) > 1 THEN 'ml_hybrid+regex' ELSE 'ml_hybrid' END AS extraction_mode,
          any_value(CASE WHEN lang <> 'en' THEN source END) AS model_version, bool_or(chunk > 2) AS used_fallback,
          max(chunk * 10 + 12) AS taxonomy_size, CAST(1 + count(DISTINCT source || (chunk % 3)) AS INTEGER) AS skills_detected_total,
          count(*) AS chunks_processed FROM chunks GROUP BY doc_id""",
    "clean_text": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "decode_resume": f"""SELECT '/resumes/' || doc_id || CASE WHEN lang = 'de' THEN '.TXT' ELSE '.txt' END AS path,
          regexp_replace(regexp_replace(text, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS text
        FROM documents WHERE lang <> 'es' AND strlen(text) <= 5242880""",
    "resume_status": f"""WITH f AS (
          SELECT doc_id % 7 AS part, lang = 'es' AS other, text, '/resumes/' || doc_id || CASE
              WHEN doc_id % 7 < 3 THEN ['.PDF', '.doc', '.docx'][doc_id % 7 + 1] WHEN lang = 'de' THEN '.TXT'
              WHEN lang = 'es' THEN '.xls' ELSE '.txt' END AS path FROM documents),
        s AS (SELECT *, CASE WHEN part = 4 THEN 'too_large' WHEN part >= 3 AND other THEN 'unsupported'
              WHEN part IN (1, 2) THEN 'needs_text' WHEN part = 3 THEN 'empty' ELSE 'read' END AS status FROM f)
        SELECT path, status, CAST(CASE WHEN status <> 'read' THEN NULL WHEN part = 0 THEN length('text of ' || path)
          ELSE length(regexp_replace(regexp_replace(text, '^{_SPACE}+', ''), '{_SPACE}+$', '')) END AS INTEGER) AS text_length
        FROM s""",
    "normalize_skills": """WITH raw AS (
          SELECT p_partkey, string_split(p_name, ' ') AS w, p_type,
            CASE WHEN p_size < 10 THEN 'Kubernetes' WHEN p_size < 20 THEN 'PostgreSQL' WHEN p_size < 30 THEN 'Node.js'
                 WHEN p_size < 40 THEN 'D3.Js' END AS extra FROM part),
        named AS (SELECT p_partkey, list_filter(list_concat([extra, upper(p_type[1]) || lower(p_type[2:])],
            list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), ['Kubernetes']), lambda x: x IS NOT NULL) AS names FROM raw)
        SELECT p_partkey, array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), '|') AS normalized
        FROM named""",
    "parse_skills_cell": f"""WITH {POSTINGS} SELECT job_uid,
          CASE WHEN source = '4-NOT SPECIFIED' THEN '' ELSE array_to_string(skills, '|') END AS skills FROM postings""",
    "payload_normalise": f"""WITH {POSTINGS},{_PAYLOAD}
        SELECT CASE source WHEN '1-URGENT' THEN 'adzuna' WHEN '2-HIGH' THEN 'jooble' WHEN '5-LOW' THEN 'arbeitnow'
                 ELSE 'remotive' END AS source, t AS title, c AS company,
          coalesce(l, CASE WHEN source IN ('1-URGENT', '2-HIGH') THEN coalesce(searched, 'India') ELSE 'Remote' END) AS location,
          CASE WHEN source = '5-LOW' THEN ' Hot ' ELSE role END AS role, d AS description, url,
          '2024-05-01T00:00:00+00:00' AS scraped_at
        FROM landed WHERE source <> '5-LOW' OR contains(lower(t || ' ' || d), 'hot')""",
    "ingest_tagged": f"""WITH {POSTINGS},{_PAYLOAD},
        tags(skill, word) AS (VALUES ('Hot', 'hot'), ('Cold', 'cold'), ('Blue', 'blue'), ('Widget', 'widget'),
                                     ('Red', 'red'), ('Hot Gear', 'hot gear')),
        sources(source) AS (VALUES ('remotive'), ('jooble')),
        rows AS (SELECT s.source, url, t, c, d FROM landed CROSS JOIN sources s)
        SELECT sha256(lower(r.source || '|' || url || '|' || t || '|' || c)) AS job_uid, r.source, url,
          coalesce((SELECT string_agg(skill, ',' ORDER BY skill) FROM tags
                    WHERE contains(' ' || r.t || ' ' || r.d || ' ', ' ' || word || ' ')), '') AS skills
        FROM rows r""",
    "source_filter": f"WITH {POSTINGS} SELECT job_uid, source FROM postings WHERE source IN ('1-URGENT', '5-LOW')",
    "search_plan": """WITH texts AS (
          SELECT p_partkey AS role_position, 0 AS company_position, p_name AS query FROM part
          UNION ALL SELECT p_partkey, 1, p_name || ' Acme' FROM part
          UNION ALL SELECT p_partkey, 2, p_name || ' ACME ' FROM part
          UNION ALL SELECT p_partkey, 3, p_name || ' Globex' FROM part)
        SELECT * FROM texts QUALIFY row_number() OVER (
          PARTITION BY lower(trim(query)) ORDER BY role_position, company_position) = 1""",
    "listing_cards": r"""WITH cards AS (
          SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS card,
                 unnest(range(0, len(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)))) AS position FROM pages),
        parts AS (SELECT page_id, position, page_url, regexp_extract(card, 'href="([^"]*)"', 1) AS link,
                         regexp_extract(card, '(?s)<a [^>]*>(.*?)</a>', 1) AS label FROM cards)
        SELECT page_id, CAST(position AS INTEGER) AS position,
          trim(replace(replace(replace(label, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title,
          CASE WHEN link LIKE '/%' THEN 'https://example.org' || replace(link, '&amp;', '&') WHEN link = '' THEN page_url
               ELSE replace(link, '&amp;', '&') END AS url FROM parts""",
    "listing_postings": f"""WITH {POSTINGS}, twice(position) AS (VALUES (0), (1))
        SELECT CASE source WHEN '1-URGENT' THEN 'indeed' WHEN '2-HIGH' THEN 'wellfound' ELSE 'linkedin' END AS source,
          title, CASE WHEN source IN ('1-URGENT', '2-HIGH') THEN company ELSE company || ' & Sons' END AS company,
          CASE WHEN source = '2-HIGH' THEN 'Anywhere' ELSE location END AS location, role,
          CASE source WHEN '1-URGENT' THEN 'skills : ' || description WHEN '2-HIGH' THEN description ELSE '' END AS description,
          CASE source WHEN '1-URGENT' THEN 'https://www.indeed.com' WHEN '2-HIGH' THEN 'https://wellfound.com'
               ELSE 'https://jobs.example.org' END || '/job/' || url AS url, position
        FROM postings CROSS JOIN twice""",
    "batch_clean": "SELECT DISTINCT lang, lower(text) AS description FROM (SELECT DISTINCT lang, text FROM documents)",
    "vector_topk": f"WITH {_CENTROIDS} SELECT doc_id, name, score FROM sims",
    "vector_hybrid": f"""WITH {_CENTROIDS}, {_doc_mentions()},
        merged AS (SELECT doc_id, name, max(score) AS score FROM (
          SELECT doc_id, name, score FROM sims UNION ALL SELECT doc_id, skill, 0.18 FROM mentions) GROUP BY ALL)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) AS INTEGER) AS rank, name,
          CAST(score AS DOUBLE) AS score FROM merged QUALIFY rank <= 4""",
    "ensemble_tags": f"""WITH {_CENTROIDS}, {_doc_mentions()}
        SELECT doc_id, skill, max(v) AS value,
          CASE WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN 'ml_hybrid' ELSE 'regex' END AS extraction_mode,
          doc_id NOT IN (SELECT vec_id FROM embeddings) AS used_fallback FROM (
          SELECT doc_id, name AS skill, greatest(1, CAST(round_even(score * 100, 0) AS BIGINT)) AS v FROM sims
          UNION ALL SELECT doc_id, skill, mentions FROM mentions) GROUP BY doc_id, skill""",
    "stream_batch_counts": f"""WITH msgs AS (SELECT doc_id, lang || ' ' || text || CASE WHEN lang = 'en' THEN ' ' || source
          ELSE '' END AS t FROM documents), {_mentions('msgs', 'doc_id', 't')}
        SELECT skill, count(*) AS postings, CAST(sum(mentions) AS BIGINT) AS mentions FROM mentions GROUP BY skill""",
    "stream_batches": f"""WITH msgs AS (SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 3 ELSE 4 END AS batch_id,
          CASE WHEN lang = 'de' THEN 'zzz' ELSE text END AS t FROM documents), {_mentions('msgs', 'doc_id', 't')}
        SELECT CAST(batch_id AS BIGINT) AS batch_id, skill, count(*) AS postings, CAST(sum(mentions) AS BIGINT) AS mentions
        FROM mentions JOIN msgs USING (doc_id) GROUP BY batch_id, skill""",
    "live_demand": f"""WITH msgs AS (SELECT doc_id, lang || ' ' || text || CASE WHEN lang = 'en' THEN ' ' || source
          ELSE '' END AS t FROM documents), {_mentions('msgs', 'doc_id', 't')},
        n AS (SELECT skill, position, count(*) AS postings, CAST(sum(mentions) AS BIGINT) AS demand_count
              FROM mentions GROUP BY ALL)
        SELECT CAST(row_number() OVER (ORDER BY demand_count DESC, position) AS INTEGER) AS rank, skill, postings,
          demand_count FROM n QUALIFY rank <= 10""",
    "simple_term_counts": f"""WITH {TERMS_CTE} SELECT skill, count(*) AS postings FROM documents CROSS JOIN terms
        WHERE contains(lower(text), term) GROUP BY skill""",
    "replayed_rows": "SELECT doc_id, text FROM documents",
}

# The same answer without the cut at the newest 800.
ORACLES["recommend_all_postings"] = ORACLES["recommend_postings"].replace(
    "QUALIFY row_number() OVER (PARTITION BY r.request_id ORDER BY p.scraped_at DESC, p.job_uid) <= 800", "").replace(
    "least(800, in_window)", "in_window")
