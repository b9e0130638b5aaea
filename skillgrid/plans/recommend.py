"""Best-fitting postings for tables of resumes.

Per segment the newest postings are candidates (800, as the feature is defined), or all of the window. Under a cap they
travel as one bounded array per segment, so a request meets them in one row and is scored and ranked there. Without one,
fit, overlap and alignment depend on a posting's skills alone, so requests that ask the same and postings with the same
skills are scored once, in bounded tiles, and postings are looked up for the best sets only. No pairs are shuffled.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from skillgrid.functions.binding import bind
from skillgrid.functions.skills import clamp, fit_score
from skillgrid.functions.text import clean_items, parse_skill_cell, parse_stamp, shown_or_default, strip
from skillgrid.operators.demand import COMPANY, LOCATION, ROLE, SEGMENT, attach_demand, segment_sql, with_exact_segment
from skillgrid.operators.set_match import best_sets
from skillgrid.operators.spread import spread_lookup
from skillgrid.operators.tagging import skill_list, with_skill_hits
from skillgrid.operators.topk import top_per_group
from skillgrid.operators.unnest import unnest, unnest_structs
from skillgrid.session import stored
from skillgrid.sources.layout import is_typed, newest_ts, untyped
from skillgrid.sources.store import POSTINGS_SCHEMA
from skillgrid.taxonomy import Taxonomy

# Newest postings of a segment that are scored, as the feature is defined; how many there were is part of the answer.
CANDIDATE_CAP = 800

# Skill sets and requests in a tile where all postings are scored; a segment has as many tiles as it needs.
PART_SIZE = 4_000
ASKS_SIZE = 2_000

# The longest list that can be asked for.
LONGEST = 20

# What an answer can be, from no stored table to a ranked list.
RESULTS = ("snapshot_missing", "snapshot_empty", "snapshot_no_matches", "snapshot_ranked")

# No request reaches further back, so older postings are dropped before anything is shuffled.
MAX_AGE_DAYS = 180
DEMAND_DEPTH = 100
MISSING_SHOWN = 8


def _candidate_skills(postings: DataFrame, taxonomy: Taxonomy | None) -> DataFrame:
    """Stored skills (array or text cell); postings without any are tagged from their text."""
    is_text = isinstance(postings.schema["skills"].dataType, StringType)
    cell = parse_skill_cell(F.col("skills")) if is_text else clean_items(F.col("skills"))
    df = postings.withColumn("skills", F.coalesce(cell, F.array().cast("array<string>")))
    if taxonomy is None:
        return df
    untagged = F.when(F.size("skills") == 0, F.concat_ws(" ", strip(F.col("title")), strip(F.col("description"))))
    df = with_skill_hits(df.withColumn("_text", untagged), "_text", taxonomy)
    skills = F.when(F.size("skills") == 0, skill_list(F.col("hits"))).otherwise(F.col("skills"))
    return df.withColumn("skills", skills).drop("_text", "hits")


def newest_stamp(postings: DataFrame) -> Column:
    return postings.agg(F.max(parse_stamp(F.col("scraped_at"))).alias("t")).scalar()


def dated(postings: DataFrame, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Add the parsed date and the newest date of all postings; keep postings at most so many days older than it.

    Undated postings leave once any posting has a date, and all stay if none has one. Postings laid out by month are
    read from the months that are young enough only.
    """
    if not 1 <= int(max_age_days) <= MAX_AGE_DAYS:
        raise ValueError(f"max_age_days must be from 1 to {MAX_AGE_DAYS}, not {max_age_days}")
    if is_typed(postings):
        newest = newest_ts(postings)
        known = postings.select("*", F.col("scraped_ts").alias("_ts"), F.lit(newest).cast("timestamp").alias("_newest"))
        if newest is None:
            return untyped(known)
        oldest = newest - timedelta(days=int(max_age_days))
        return untyped(known.where((F.col("month") >= f"{oldest:%Y-%m}") & (F.col("scraped_ts") >= F.lit(oldest))))
    stamped = postings.withColumn("_ts", parse_stamp(F.col("scraped_at")))
    stamped = stamped.withColumn("_newest", newest_stamp(postings))
    days = F.lit(int(max_age_days))
    return stamped.where(F.col("_newest").isNull() | (F.col("_ts") >= F.col("_newest") - F.make_dt_interval(days)))


def recent_postings(postings: DataFrame, max_age_days: int = 30) -> DataFrame:
    """Postings at most so many days (1 to 180) older than the newest one; all of them if none has a date."""
    return dated(postings, max_age_days).drop("_ts", "_newest")


def _posting_segments() -> Column:
    """All eight segments a posting belongs to; a null key belongs only where that key is open."""
    names = (("_role", ROLE), ("_company", COMPANY), ("_location", LOCATION))
    options = []
    for mask in range(8):
        fixed = [name if mask & bit else None for name, bit in names]
        usable = " AND ".join(f"{name} IS NOT NULL" for name in fixed if name) or "true"
        options.append(f"CASE WHEN {usable} THEN struct({segment_sql(*fixed)}) END")
    return F.expr(f"array_compact(array({', '.join(options)}))")


def _by_segment(postings: DataFrame) -> DataFrame:
    """One row per posting and segment it belongs to."""
    keyed = postings.select("*", *[F.lower(strip(F.col(c))).alias(f"_{c}") for c in ("role", "company", "location")])
    return unnest_structs(keyed, postings.columns, _posting_segments())


def _shown() -> Column:
    return F.struct(
        "job_uid", "source", "title", "company", "location", "role", "url", "skills",
        F.array_distinct(F.transform("skills", F.lower)).alias("names"), F.col("_ts").alias("ts"))


def _age() -> Column:
    """Age in whole days, started days included; 0 if no posting has a date."""
    return F.coalesce(F.ceil((F.unix_micros("_newest") - F.unix_micros("_ts")) / 86_400_000_000), F.lit(0))


def newest_candidates(postings: DataFrame, wanted: DataFrame, cap: int) -> DataFrame:
    """One row per wanted segment with an array of its newest postings.

    Every segment is cut to its newest rows first and the join with the wanted ones follows, so no shuffle meets the full
    size of the all-open segment. ``_ages`` counts all postings of the segment by age in whole days, started days
    included, so that a request can tell how many the cut left out.
    """
    spread = _by_segment(postings)
    order = [F.col("_ts").desc_nulls_last(), F.col("scraped_at").desc_nulls_last(), F.col("job_uid").asc()]
    top = top_per_group(spread, SEGMENT, order, cap, "job_uid")
    top = top.join(wanted, SEGMENT, "left_semi")
    ages = spread.groupBy(*SEGMENT, _age().alias("age")).agg(F.count("*").alias("n"))
    ages = ages.groupBy(*SEGMENT).agg(F.collect_list(F.struct("age", "n")).alias("_ages"))  # one entry per day of age
    # At most ``cap`` entries per group.
    return top.groupBy(*SEGMENT).agg(F.collect_list(_shown()).alias("_candidates")).join(ages, SEGMENT)


def _last_spelling(skills: Column, name: Column) -> Column:
    return F.element_at(F.filter(skills, lambda s: F.lower(s) == name), -1)


def _job(rank: Column, p: Column, matched: Column, fit: Column, count: Column, aligned: Column) -> Column:
    """A ranked posting as it is shown."""
    missing = F.filter(p["names"], lambda n: ~F.array_contains(matched, n))
    return F.struct(
        rank.alias("rank"), p["job_uid"].alias("job_uid"),
        shown_or_default(p["title"], "Unknown title").alias("title"),
        shown_or_default(p["company"], "Unknown company").alias("company"),
        shown_or_default(p["location"], "Unknown location").alias("location"),
        F.coalesce(strip(p["role"]), F.lit("")).alias("role"), F.coalesce(strip(p["url"]), F.lit("")).alias("url"),
        fit.alias("fit_score"),
        F.transform(F.sort_array(matched), lambda n: _last_spelling(p["skills"], n)).alias("matched_skills"),
        F.slice(F.sort_array(F.transform(missing, lambda n: _last_spelling(p["skills"], n))), 1, MISSING_SHOWN)
        .alias("missing_skills"),
        count.alias("matched_count"), F.size(p["skills"]).alias("job_skill_count"),
        aligned.alias("demand_alignment"), F.coalesce(p["source"], F.lit("")).alias("source"),
    )


def score_candidates(df: DataFrame) -> DataFrame:
    """Score each row's ``_candidates`` since ``_cutoff`` against ``_mine``; adds ``total`` and the ranked ``jobs``."""
    df = df.withColumn("_fresh", F.filter("_candidates", lambda c: F.col("_cutoff").isNull()
                                          | (c["ts"] >= F.col("_cutoff"))))
    overlap = F.transform("_fresh", lambda c, i: F.struct(
        i.alias("i"), c["job_uid"].alias("job_uid"), F.size(c["names"]).alias("size"),
        F.array_intersect(c["names"], F.col("_mine")).alias("matched")))
    df = df.withColumn("_overlap", F.filter(overlap, lambda o: F.size(o["matched"]) > 0))
    limit = clamp(F.coalesce(F.col("limit"), F.lit(8)), 1, LONGEST)

    # Fit and overlap decide first. Only postings that reach the last shown place on these, ties included, can be
    # shown, so alignment is worked out for them alone.
    df = df.withColumn("_points", F.transform("_overlap", lambda o: (
        fit_score(F.size(o["matched"]), o["size"]).cast("bigint") * 2**32 + F.size(o["matched"]))))
    last = F.get(F.sort_array("_points", asc=False), F.least(limit, F.size("_points")) - 1)
    df = df.withColumn("_near", bind(last, lambda floor: F.filter(
        "_overlap", lambda o, i: F.get(F.col("_points"), i) >= floor)))

    def rank_key(o: Column) -> Column:
        count = F.size(o["matched"])
        aligned = F.aggregate(
            "_wanted", F.lit(0).cast("bigint"),
            lambda acc, d: acc + F.when(F.array_contains(o["matched"], d["name"]), d["demand_count"]).otherwise(0))
        return F.struct((-fit_score(count, o["size"])).alias("fit"), (-count).alias("count"),
                        (-aligned).alias("aligned"), o["job_uid"], o["i"], o["matched"])

    df = df.withColumn("_best", F.slice(F.sort_array(F.transform("_near", rank_key)), 1, limit))

    def job(s: Column, at: Column) -> Column:
        return _job(at + 1, F.get(F.col("_fresh"), s["i"]), s["matched"], -s["fit"], -s["count"], -s["aligned"])

    return df.withColumn("total", F.size("_overlap")).withColumn("jobs", F.transform("_best", job))


def recommend_postings(requests: DataFrame, postings: DataFrame | None, segments: DataFrame, live: DataFrame | None = None,
                       taxonomy: Taxonomy | None = None, *, candidate_cap: int | None) -> DataFrame:
    """One row per request (request_id, resume_skills, role, company, region, limit, max_age_days).

    Adds ``jobs`` (ranked structs), ``total`` (scored postings with any match) and ``market_result``. Of a segment the
    newest ``candidate_cap`` postings are scored: ``candidates_in_window`` and ``candidates_scored`` show what that left
    out. With ``None`` all postings in the window are scored and counted. Without a stored table (``None``), with an empty
    one, or without a posting in the window, ``market_result`` says so.
    ``postings`` and ``segments`` are read more than once and are best stored tables.
    """
    missing = postings is None
    if missing:
        postings = requests.sparkSession.createDataFrame([], POSTINGS_SCHEMA)
    mine = F.array_distinct(clean_items(F.transform("resume_skills", F.lower)))
    valid = requests.withColumn("_mine", mine).where(F.size("_mine") > 0)
    answered = attach_demand(valid.withColumn("top_n", F.lit(DEMAND_DEPTH)), segments, live)
    named = F.transform("demand", lambda d: F.struct(F.lower(d["skill"]).alias("name"), d["demand_count"]))
    wanted = F.filter(named, lambda d: F.array_contains("_mine", d["name"]))
    days = clamp(F.coalesce(F.col("max_age_days"), F.lit(30)), 1, MAX_AGE_DAYS)
    narrowed = answered.withColumn("_wanted", wanted).withColumn(
        "_cutoff", newest_stamp(postings) - F.make_dt_interval(days)).select(
        *requests.columns, "_mine", "_wanted", "_cutoff", days.alias("_days"))

    asked = with_exact_segment(requests.select("role", "company", "region")).select(*SEGMENT).distinct()
    recent, asking = dated(_candidate_skills(postings, taxonomy)), with_exact_segment(narrowed)
    if candidate_cap is None:
        scored = _scored_by_skill_set(asking, recent, asked, requests.columns)
    else:
        candidates = newest_candidates(recent, asked, candidate_cap)
        scored = score_candidates(spread_lookup(asking, candidates, SEGMENT, "request_id"))
        in_window = F.aggregate(
            F.filter(F.coalesce("_ages", F.array().cast("array<struct<age:bigint,n:bigint>>")),
                     lambda a: F.col("_cutoff").isNull() | (a["age"] <= F.col("_days"))),
            F.lit(0).cast("bigint"), lambda s, a: s + a["n"])
        scored = scored.select(
            *requests.columns, F.greatest(F.lit(0), F.col("total")).alias("total"), in_window.alias("candidates_in_window"),
            F.greatest(F.lit(0), F.size("_fresh")).alias("candidates_scored"), F.coalesce("jobs", F.array()).alias("jobs"))
    result = (
        F.when(F.lit(missing), F.lit(RESULTS[0]))
        .when(postings.agg(F.count("*")).scalar() == 0, F.lit(RESULTS[1]))
        .when(F.col("candidates_scored") == 0, F.lit(RESULTS[2])).otherwise(F.lit(RESULTS[3])))
    return scored.withColumn("market_result", result)


def _scored_by_skill_set(asking: DataFrame, postings: DataFrame, asked: DataFrame, columns: list[str]) -> DataFrame:
    """Every distinct question against every distinct skill set of its segment, then the postings of the best sets."""
    # Postings and requests are told apart by their rows, as keys may repeat; written, so that the numbers stay.
    postings = stored(postings.select(_shown().alias("p"), "role", "company", "location", _age().cast("int").alias("age"),
                                      F.monotonically_increasing_id().alias("_pid")), "recent_postings")
    weights = F.transform(F.sort_array("_mine"), lambda name: F.aggregate(
        "_wanted", F.lit(0).cast("bigint"),
        lambda acc, d: acc + F.when(d["name"] == name, d["demand_count"]).otherwise(0)))
    question = F.struct(*SEGMENT, "mine", "weights", "days")
    asking = stored(asking.select(
        *columns, *SEGMENT, F.sort_array("_mine").alias("mine"), weights.alias("weights"), F.col("_days").cast("int").alias("days"),
        F.monotonically_increasing_id().alias("_row")).withColumn("_ask", F.sha2(F.to_json(question), 256)), "asking")
    asks = stored(asking.select("_ask", *SEGMENT, "mine", "weights", "days").distinct(), "asks")

    # Null keys come first.
    uid = F.coalesce(F.concat(F.lit("1"), F.col("p.job_uid")), F.lit("0"))
    keyed = postings.select("role", "company", "location", "age", "_pid", uid.alias("_uid"), F.sort_array("p.names").alias("names"))
    spread = spread_lookup(_by_segment(keyed), asked.withColumn("_asked", F.lit(True)), SEGMENT, "_pid").where("_asked")
    cells = stored(spread.groupBy(*SEGMENT, "names", "age").agg(F.count("*").alias("n"), F.min("_uid").alias("first")), "cells")
    # One entry per day of age.
    sets = cells.groupBy(*SEGMENT, "names").agg(F.collect_list(F.struct("age", "n", "first")).alias("c"))
    sets = stored(sets.select(
        *SEGMENT, "names", F.monotonically_increasing_id().alias("set_id"), F.col("c.age").alias("ages"),
        F.col("c.n").alias("counts"), F.col("c.first").alias("firsts")), "skill_sets")
    met = stored(best_sets(asks, sets.where(F.size("names") > 0), SEGMENT, LONGEST, PART_SIZE, ASKS_SIZE), "best_sets")

    order = [F.col("fit").desc(), F.col("count").desc(), F.col("aligned").desc()]
    best = unnest_structs(met, ["_ask", "days"], "best")
    best = stored(top_per_group(best, ["_ask"], [*order, F.col("first").asc(), F.col("set_id").asc()], LONGEST, "set_id"), "asked_sets")
    needed = best.select("set_id", "days").distinct().join(sets.select("set_id", *SEGMENT, "names"), "set_id")
    members = top_per_group(spread, [*SEGMENT, "names", "age"], [F.col("_uid").asc(), F.col("_pid").asc()], LONGEST, "_pid")
    members = members.join(needed, [*SEGMENT, "names"]).where("age <= days").select("set_id", "days", "_uid", "_pid")
    members = top_per_group(members, ["set_id", "days"], [F.col("_uid").asc(), F.col("_pid").asc()], LONGEST, "_pid")
    # At most 20 entries per set and age, and per request below.
    lists = stored(members.groupBy("set_id", "days").agg(F.collect_list(F.struct("_uid", "_pid")).alias("m")), "set_postings")
    placed = unnest_structs(spread_lookup(best, lists, ["set_id", "days"], "_ask"), ["_ask", "fit", "count", "aligned"], "m")
    place = F.row_number().over(Window.partitionBy("_ask").orderBy(*order, F.col("_uid").asc(), F.col("_pid").asc()))
    placed = stored(placed.withColumn("_rank", place).where(F.col("_rank") <= LONGEST).drop("_uid"), "placed")
    shown = spread_lookup(placed.join(asks.select("_ask", "mine"), "_ask"), postings.select("_pid", "p"), ["_pid"], "_ask")
    job = _job(F.col("_rank"), F.col("p"), F.array_intersect("p.names", "mine"), F.col("fit"), F.col("count"), F.col("aligned"))
    lists = shown.select("_ask", job.alias("_job")).groupBy("_ask").agg(
        F.sort_array(F.collect_list("_job")).alias("_jobs"))  # by rank, the first field
    answers = stored(met.groupBy("_ask").agg(F.sum("total").cast("int").alias("_total")).join(lists, "_ask", "left"), "answers")

    # One entry per day of age.
    ages = cells.groupBy(*SEGMENT, "age").agg(F.sum("n").alias("n")).groupBy(*SEGMENT).agg(
        F.collect_list(F.struct("age", "n")).alias("_ages"))
    known = spread_lookup(spread_lookup(asking, answers, ["_ask"], "_row"), ages, SEGMENT, "_row")
    in_window = F.aggregate(F.filter(F.coalesce("_ages", F.array().cast(ages.schema["_ages"].dataType)),
                                     lambda a: a["age"] <= F.col("days")), F.lit(0).cast("bigint"), lambda s, a: s + a["n"])
    limit = clamp(F.coalesce(F.col("limit"), F.lit(8)), 1, LONGEST)
    return known.withColumn("_scored", in_window).select(
        *columns, F.coalesce("_total", F.lit(0)).alias("total"), F.col("_scored").alias("candidates_in_window"),
        F.col("_scored").cast("int").alias("candidates_scored"),
        F.slice(F.coalesce("_jobs", F.array().cast(answers.schema["_jobs"].dataType)), 1, limit).alias("jobs"))


def recommended_jobs(answered: DataFrame) -> DataFrame:
    """One row per request and recommended posting."""
    return unnest_structs(answered, ["request_id", "total", "candidates_in_window", "candidates_scored"], "jobs")
