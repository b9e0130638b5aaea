"""Demand relaxation and gaps against plain dictionaries; recommendations against a plain loop."""

import random

from pyspark.sql import functions as F

from skillgrid.functions.skills import BASELINE_DEMAND
from skillgrid.operators import demand as D, gap as G, spread
from skillgrid.plans import recommend as R
from skillgrid.plans.resume import analyze_gaps

ROLES, FIRMS, PLACES = ["data", "web", "ops"], ["acme", "globex"], ["paris", "rome"]
SKILLS = ["python", "sql", "spark", "git", "go", "aws"]
REQUEST = "request_id int, resume_skills array<string>, role string, company string, region string, top_n int"


def make_postings(seed=3, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        role = rng.choice(ROLES)
        # Some combinations never occur, so every relaxation step is used.
        firm = "acme" if role == "ops" else rng.choice(FIRMS)
        place = "paris" if firm == "globex" else rng.choice(PLACES)
        skills = sorted(rng.sample(SKILLS, rng.randint(0, 4)))
        day = rng.randint(1, 28)
        rows.append((f"u{i:03d}", "s", f"t{i}", firm.title(), f" {place} ".title(), role.upper(), "d", f"l{i}",
                     "bad" if i % 17 == 0 else f"2024-0{rng.randint(1, 6)}-{day:02d}T00:00:00+00:00", skills))
    return rows


POSTING = ("job_uid string, source string, title string, company string, location string, role string, "
           "description string, url string, scraped_at string, skills array<string>")


def make_requests():
    options = [(r, c, g) for r in ["data", "OPS ", "unknown", None, "", "  "] for c in ["acme", "globex", "nobody", None]
               for g in ["rome", " Paris", "mars", None]]
    return [(i, ["Python", "GIT", "git", "Cobol"], r, c, g, n)
            for i, ((r, c, g), n) in enumerate(zip(options, [1, 3, 200] * len(options)))]


def lookup(rows, role, company, region, top_n):
    counts = {}
    for p in rows:
        if role and p[5].strip().lower() != role.strip().lower():
            continue
        if company and p[3].strip().lower() != company.strip().lower():
            continue
        if region and p[4].strip().lower() != region.strip().lower():
            continue
        for s in p[9]:
            counts[s] = counts.get(s, 0) + 1
    return sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:top_n]


def relaxed(rows, role, company, region, top_n, live=()):
    steps = [(True, (role, company, region), "snapshot_role_company_region"),
             (role and company and region, (role, None, region), "snapshot_role_region"),
             (role and company, (role, company, None), "snapshot_role_company"),
             (role, (role, None, None), "snapshot_role_only"),
             (region, (None, None, region), "snapshot_region_only"),
             (True, (None, None, None), "snapshot_global")]
    for applies, filters, label in steps:
        found = lookup(rows, *filters, top_n) if applies else []
        if found:
            return found, label
    if live:
        return list(live), "live_stream"
    return BASELINE_DEMAND[:top_n], "baseline_default"


def segments(spark, rows):
    return D.demand_segments(D.demand_cube(D.demand_rollup(spark.createDataFrame(rows, POSTING))))


def test_relaxation_matches_a_plain_loop(spark):
    rows, requests = make_postings(), make_requests()
    answered = D.attach_demand(spark.createDataFrame(requests, REQUEST), segments(spark, rows)).collect()
    assert len(answered) == len(requests)
    for r in answered:
        want, label = relaxed(rows, r.role, r.company, r.region, r.top_n)
        assert ([(d.skill, d.demand_count) for d in r.demand], r.market_source) == (want, label), r


def test_exact_demand_live_and_baseline(spark):
    rows, requests = make_postings(), make_requests()
    df = spark.createDataFrame(requests, REQUEST)
    live = spark.createDataFrame([(1, "Rust", 9), (2, "Go", 4)], "rank int, skill string, demand_count bigint")
    for table, extra in ((None, ()), (live, (("Rust", 9), ("Go", 4)))):
        for r in D.attach_demand(df, segments(spark, rows), table, relax=False).collect():
            own = lookup(rows, r.role, r.company, r.region, r.top_n)
            want = (own, "market_snapshot") if own else (
                (list(extra), "live_stream") if extra else (BASELINE_DEMAND[:r.top_n], "baseline_default"))
            assert ([(d.skill, d.demand_count) for d in r.demand], r.market_source) == want


def test_no_market_data_at_all(spark):
    df = spark.createDataFrame(make_requests(), REQUEST)
    empty = segments(spark, [])
    live = spark.createDataFrame([(1, "Rust", 9)], "rank int, skill string, demand_count bigint")
    assert {r.market_source for r in D.attach_demand(df, empty).collect()} == {"baseline_default"}
    assert {(r.market_source, len(r.demand)) for r in D.attach_demand(df, empty, live).collect()} == {("live_stream", 1)}


def test_gap_requests_without_skills_are_turned_away(spark):
    df = spark.createDataFrame([(1, [], None, None, None, 5), (2, ["git"], None, None, None, None)], REQUEST)
    out = analyze_gaps(df, segments(spark, make_postings())).collect()
    assert [(r.request_id, r.top_n, r.market_source) for r in out] == [(2, 20, "snapshot_role_company_region")]


def test_null_keys_never_match_a_filter(spark):
    rows = [("u1", "s", "t", None, "Rome", "data", "d", "l", "x", ["python"])]
    cube = D.demand_cube(D.demand_rollup(spark.createDataFrame(rows, POSTING))).collect()
    assert {(c.kept, c.company_key) for c in cube} == {(0, ""), (4, ""), (1, ""), (5, "")}


def answered_baseline(spark, resume, top_n=12):
    demand = [(n, s) for s, n in BASELINE_DEMAND]
    return spark.createDataFrame(
        [(1, resume, top_n, demand)],
        "request_id int, resume_skills array<string>, top_n int, demand array<struct<demand_count:bigint,skill:string>>")


def test_gap_sample(spark):
    df = answered_baseline(spark, ["Python", "SQL", "Git", "Excel", "Tableau"])
    r = G.with_gap(df).first()
    # 540 of 1480.
    assert r.skill_score == 36
    assert (r.match_count, r.gap_count, r.resume_skill_count, r.market_skill_count) == (3, 9, 5, 12)
    assert [m.skill for m in r.matching_skills] == ["Python", "SQL", "Git"]
    assert [m.skill for m in r.missing_skills] == ["AWS", "Docker", "Kubernetes", "Java", "React", "Machine Learning",
                                                   "TensorFlow", "Spark", "Kafka"]
    assert [x.priority for x in r.recommendations][:8] == ["High"] * 5 + ["Medium"] * 3
    assert r.recommendations[0].reason == "Extremely high demand (180+ job postings) - Cloud Platform"
    assert r.recommendations[4].reason == "Very high demand (100 job postings) - Web Framework"


def test_gap_counts_spellings_once(spark):
    r = G.with_gap(answered_baseline(spark, ["git", "PYTHON", "Git"])).first()
    assert [m.skill for m in r.matching_skills] == ["PYTHON", "Git"]
    assert (r.resume_skill_count, r.match_count) == (3, 2)


def test_gap_caps(spark):
    demand = [(300 - i, f"s{i:03d}") for i in range(250)]
    schema = "request_id int, resume_skills array<string>, top_n int, demand array<struct<demand_count:bigint,skill:string>>"
    df = spark.createDataFrame([(1, ["x"], 3, demand), (2, ["x"], 150, demand)], schema)
    rows = {r.request_id: r for r in G.with_gap(df).collect()}
    assert [(len(r.recommendations), len(r.missing_skills), r.gap_count) for _, r in sorted(rows.items())] == [
        (5, 20, 250), (100, 200, 250)]


def test_category_report(spark):
    df = answered_baseline(spark, ["python", "KAFKA"])
    full = {r.category: r for r in G.category_gaps(df, ["request_id"]).collect()}
    assert full["Programming Language"].top_missing == ["Java"]
    assert (full["Data Engineering"].total_skills, full["Data Engineering"].coverage_percentage) == (2, 50)
    assert full["Other"].top_missing == ["Git"]
    strict = {r.category for r in G.category_gaps(df, ["request_id"], strict=True).collect()}
    assert strict == {"Data Engineering", "Other"}


def test_cube_makes_four_rows_of_a_rollup_row_not_eight(spark):
    """Open companies are summed from a rollup without companies; the rest is dealt over all tasks before it is expanded."""
    demand = spark.createDataFrame([("web", "acme", "rome", "Git", 2), ("web", None, "rome", "Git", 3), ("web", "zoo", None, "Go", -1)],
                                   "role_norm string, company_norm string, location_norm string, skill string, demand_count bigint")
    cube = D.demand_cube(demand)
    plan = cube._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand ") == 2 and "REPARTITION_BY_NUM" in plan
    want = {}
    for *keys, skill, n in map(tuple, demand.collect()):
        for mask in range(8):
            fixed = [k if mask & bit else "" for k, bit in zip(keys, (D.ROLE, D.COMPANY, D.LOCATION))]
            if None not in fixed:
                want[(mask, *fixed, skill)] = want.get((mask, *fixed, skill), 0) + n
    assert {tuple(r)[:5]: r.demand_count for r in cube.collect()} == want and cube.count() == len(want)


def best_jobs(rows, request, cap, limit, days):
    import datetime as dt

    def when(p):
        try:
            return dt.datetime.fromisoformat(p[8])
        except ValueError:
            return None

    newest = max(when(p) for p in rows if when(p))
    pool = [p for p in rows if when(p) and when(p) >= newest - dt.timedelta(days=days)]
    for value, at in ((request[2], 5), (request[3], 3), (request[4], 4)):
        if value:
            pool = [p for p in pool if p[at].strip().lower() == value.strip().lower()]
    pool = sorted(sorted(pool, key=lambda p: p[0]), key=lambda p: p[8], reverse=True)[:cap]
    mine = {s.lower().strip() for s in request[1]}
    demand, _ = relaxed(rows, *request[2:5], 100)
    demand = dict(demand)
    scored = []
    for p in pool:
        hit = sorted(s for s in p[9] if s in mine)
        if hit:
            fit = min(100, round(len(hit) / len(p[9]) * 100) + min(15, 3 * len(hit)))
            scored.append((-fit, -len(hit), -sum(demand.get(s, 0) for s in hit), p[0]))
    return len(scored), [(u, -f, -m, -a) for f, m, a, u in sorted(scored)][:limit]


def test_recommendations_match_a_plain_loop(spark):
    rows = make_postings(n=150)
    requests = [(i, s, r, c, g, 1 + i % 7, 20 + 40 * (i % 4))
                for i, (_, s, r, c, g, _) in enumerate(make_requests()) if r != "  "]
    df = spark.createDataFrame(requests, "request_id int, resume_skills array<string>, role string, company string, "
                                         "region string, limit int, max_age_days int")
    postings = spark.createDataFrame(rows, POSTING)
    for cap in (800, 5):
        answered = R.recommend_postings(df, postings, segments(spark, rows), candidate_cap=cap).collect()
        assert len(answered) == len(requests)
        by_id = {r[0]: r for r in requests}
        for r in answered:
            total, jobs = best_jobs(rows, by_id[r.request_id], cap, r.limit, r.max_age_days)
            got = [(j.job_uid, j.fit_score, j.matched_count, j.demand_alignment) for j in r.jobs]
            assert (r.total, got) == (total, jobs), r.request_id
            assert r.candidates_scored == min(cap, r.candidates_in_window)


def test_recommendations_over_the_whole_window(spark, monkeypatch):
    rows = make_postings(n=150)
    # Requests 0 and 1 come twice: each row has its own answer.
    requests = [(i % 2, ["Python", "GIT"], None, None, None, 1 + i, 40 * i + 20) for i in range(4)]
    requests += [(9, ["python"], "data", None, None, None, None), (10, ["python"], "unknown", None, None, 5, 90)]
    df = spark.createDataFrame(requests, "request_id int, resume_skills array<string>, role string, company string, "
                                         "region string, limit int, max_age_days int")
    postings = spark.createDataFrame(rows, POSTING)
    monkeypatch.setattr(R, "PART_SIZE", 7)
    answered = R.recommend_postings(df, postings, segments(spark, rows), candidate_cap=None).collect()
    assert len(answered) == len(requests)
    for r in answered:
        total, jobs = best_jobs(rows, tuple(r[:7]), None, r.limit or 8, r.max_age_days or 30)
        assert (r.total, [(j.job_uid, j.fit_score, j.matched_count, j.demand_alignment) for j in r.jobs]) == (total, jobs)
        assert [j.rank for j in r.jobs] == list(range(1, len(jobs) + 1))
        assert r.candidates_scored == r.candidates_in_window >= total
        assert r.market_result == ("snapshot_ranked" if r.candidates_scored else "snapshot_no_matches")
    assert max(r.candidates_scored for r in answered) > 5 * R.PART_SIZE
    assert R.recommend_postings(df, None, segments(spark, rows), candidate_cap=None).where(
        "market_result = 'snapshot_missing'").count() == len(requests)


def test_recommendations_with_hot_segments(spark, monkeypatch):
    rows = make_postings()
    df = spark.createDataFrame([(1, ["python"], "data", None, None, 5, 90), (2, ["sql"], None, None, None, 5, 90)],
                               "request_id int, resume_skills array<string>, role string, company string, "
                               "region string, limit int, max_age_days int")
    postings, found = spark.createDataFrame(rows, POSTING), segments(spark, rows)
    few = R.recommend_postings(df, postings, found, candidate_cap=800).orderBy("request_id").collect()
    monkeypatch.setattr(spread, "SMALLEST_PIECE", 1)
    monkeypatch.setattr(spread, "PIECES", 1)
    assert R.recommend_postings(df, postings, found, candidate_cap=800).orderBy("request_id").collect() == few


def test_equal_requests_and_equal_postings_are_scored_once(spark, monkeypatch):
    """Any number of postings and requests makes no more pairs than they have skill sets and questions."""
    rows = [(f"u{i // 2:03d}", "s", "t", None, "Rome", "data", "d", "l", f"2024-01-{1 + i % 28:02d}",
             [["git", "go"], ["go", "git"], ["sql", "git"], ["go"], []][i % 5]) for i in range(200)]
    requests = [(i, [["git", "SQL"], ["sql", "Git"], ["Go", "go"]][i % 3], None, None, "rome" if i % 2 else None, 1 + i % 20, 20)
                for i in range(60)]
    df = spark.createDataFrame(requests, "request_id int, resume_skills array<string>, role string, company string, "
                                         "region string, limit int, max_age_days int")
    met, best_sets = {}, R.best_sets

    def seen(asks, sets, *args):
        met.update(asks=asks.count(), sets=sets.count())
        return best_sets(asks, sets, *args)

    monkeypatch.setattr(R, "best_sets", seen)
    monkeypatch.setattr(R, "PART_SIZE", 2)
    monkeypatch.setattr(R, "ASKS_SIZE", 1)
    answered = R.recommend_postings(df, spark.createDataFrame(rows, POSTING), segments(spark, rows), candidate_cap=None)
    for r in answered.collect():
        total, jobs = best_jobs(rows, tuple(r[:7]), None, r.limit, r.max_age_days)
        assert (r.total, [(j.job_uid, j.fit_score, j.matched_count, j.demand_alignment) for j in r.jobs]) == (total, jobs)
        assert r.candidates_scored == r.candidates_in_window >= total
    assert met == {"asks": 4, "sets": 6}  # two questions in each of two segments, three sets in each


def test_untagged_postings_and_text_cells(spark):
    from skillgrid.taxonomy import Taxonomy

    rows = [("u1", "s", "Python job", "Acme", None, "data", "uses sql", None, "2024-01-02", "[]"),
            ("u2", "s", " ", None, "Rome", "data", "x", "l", "2024-01-01", '["Python", "Scala", "Zig"]')]
    postings = spark.createDataFrame(rows, POSTING.replace("array<string>", "string"))
    df = spark.createDataFrame([(1, [" PYTHON ", ""], None, None, None, 5, 30), (2, [" "], None, None, None, 5, 30)],
                               "request_id int, resume_skills array<string>, role string, company string, "
                               "region string, limit int, max_age_days int")
    taxonomy = Taxonomy.from_terms(["python", "sql"])
    out = R.recommend_postings(df, postings, segments(spark, []), taxonomy=taxonomy, candidate_cap=800).collect()
    assert [r.request_id for r in out] == [1]
    first, second = out[0].jobs
    assert (first.job_uid, first.matched_skills, first.missing_skills, first.location) == (
        "u1", ["Python"], ["Sql"], "Unknown location")
    assert (second.title, second.company, second.missing_skills) == ("Unknown title", "Unknown company", ["Scala", "Zig"])
    assert second.demand_alignment == 250


def test_spread_lookup_keeps_every_row_of_a_hot_key(spark, monkeypatch):
    asking = spark.range(3000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 > 0, F.lit("hot"))
                                      .otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"))
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "key string, v int")
    out = spread.spread_lookup(asking, table, ["key"], "n")
    assert out.count() == 3000 and out.select("n").distinct().count() == 3000
    want = asking.join(table, "key", "left").groupBy("v").count()
    assert {tuple(r) for r in out.groupBy("v").count().collect()} == {tuple(r) for r in want.collect()}
