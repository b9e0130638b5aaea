"""Every registered query: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skillgrid.functions import skills as S, text as X
from skillgrid.operators import dedupe, demand as D, gap as G, tagging as T, vectors as V
from skillgrid.operators.term_index import TermIndex, mentions_by_term
from skillgrid.plans import ingest, market as M, recommend as R, resume
from skillgrid.session import scratch_path, stored, widen_scan
from skillgrid.sources import files, listings, payloads
from skillgrid.sources.store import MarketStore
from skillgrid.streaming import counts as C
from suite import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SCRAPED_AT = "2024-05-01T00:00:00+00:00"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(column: str, separator: str = ","):
    return F.array_join(column, separator).alias(column)


# --- postings: identity, copies, store -------------------------------------------------------------------------

@query
def posting_key(spark, sf):
    return I.postings(spark, sf).select("url", "job_uid")


def _recopied(postings: DataFrame) -> DataFrame:
    """Postings and re-scraped copies: later ones of one source, undated ones of another."""
    later = F.date_format(F.to_timestamp("scraped_at") + F.make_dt_interval(F.lit(30)), "yyyy-MM-dd'T'HH:mm:ssxxx")
    urgent = postings.where("source = '1-URGENT'").withColumn("scraped_at", later).withColumn(
        "role", F.concat("role", F.lit(" later")))
    undated = postings.where("source = '2-HIGH'").withColumn("scraped_at", F.lit("not a date")).withColumn(
        "role", F.concat("role", F.lit(" undated")))
    return dedupe.union_all([urgent, undated])


@query
def latest_posting(spark, sf):
    p = I.postings(spark, sf)
    return dedupe.latest_postings(dedupe.union_all([p, _recopied(p)])).select("job_uid", "role", "scraped_at")


@query
def first_posting(spark, sf):
    p = I.postings(spark, sf)
    runs = dedupe.union_all([p.withColumn("run", F.lit(2)), _recopied(p).withColumn("run", F.lit(1))])
    return dedupe.first_postings(runs, ["run", "role", "scraped_at"]).select("job_uid", "role", "run")


@query
def posting_upsert(spark, sf):
    """A first load, then a merge of copies into the stored table; read back from the store."""
    name = f"market_{uuid.uuid4().hex[:12]}"
    store = MarketStore(spark, name, buckets=8, location=scratch_path(spark, "warehouse"),
                        snapshot_root=scratch_path(spark, "snapshots"))
    p = I.stored_postings(spark, sf)
    store.upsert_postings(p)
    store.upsert_postings(_recopied(p))
    return spark.read.parquet(f"{store.snapshot_root}/job_postings.parquet").select("job_uid", "role", "scraped_at")


def _three_batches(spark, sf) -> MarketStore:
    """A store after a load, a batch of copies, and a batch that takes skills away and moves postings."""
    store = MarketStore(spark, f"market_{uuid.uuid4().hex[:12]}", buckets=8, location=scratch_path(spark, "warehouse"))
    p = I.stored_postings(spark, sf)
    store.upsert_postings(p.where("source <> '5-LOW'"))
    store.upsert_postings(_recopied(p))
    later = F.date_format(F.to_timestamp("scraped_at") + F.make_dt_interval(F.lit(60)), "yyyy-MM-dd'T'HH:mm:ssxxx")
    fewer = p.where("source = '3-MEDIUM'").withColumns({
        "scraped_at": later, "skills": F.slice("skills", 2, 100), "location": F.concat(F.lit(" "), F.upper("location"))})
    store.upsert_postings(dedupe.union_all([p.where("source = '5-LOW'"), fewer]))
    return store


@query
def demand_after_upserts(spark, sf):
    """The stored rollup after three batches, kept by signed changes."""
    return _three_batches(spark, sf).table("skill_demand")


@query
def segments_after_upserts(spark, sf):
    """The stored segments after three batches, as rows."""
    segments = _three_batches(spark, sf).table("demand_segments")
    return segments.select("kept", "role_key", "company_key", "location_key", F.explode("demand").alias("d")).select(
        "kept", "role_key", "company_key", "location_key", "d.skill", "d.demand_count")


# --- demand ------------------------------------------------------------------------------------------------------

@query
def demand_rollup(spark, sf):
    return D.demand_rollup(I.postings(spark, sf))


@query
def segment_demand_topn(spark, sf):
    return D.segment_demand(D.demand_rollup(I.postings(spark, sf)), role=" Building ", region="NATION_3", top_n=10)


@query
def demand_cube(spark, sf):
    return D.demand_cube(D.demand_rollup(I.postings(spark, sf)))


@query
def demand_relaxed(spark, sf):
    segments = I.segments(I.postings(spark, sf))
    return D.demand_rows(D.attach_demand(I.requests(spark, sf), segments), ["request_id"])


@query
def demand_exact(spark, sf):
    segments = I.segments(I.postings(spark, sf))
    return D.demand_rows(D.attach_demand(I.requests(spark, sf), segments, relax=False), ["request_id"])


# --- gaps --------------------------------------------------------------------------------------------------------

def _gaps(spark, sf) -> DataFrame:
    return resume.analyze_gaps(I.requests(spark, sf), I.segments(I.postings(spark, sf)))


def _answered(spark, sf) -> DataFrame:
    return D.attach_demand(I.requests(spark, sf), I.segments(I.postings(spark, sf)))


@query
def gap_matching(spark, sf):
    return G.unfold(_gaps(spark, sf), ["request_id"], "matching_skills")


@query
def gap_missing(spark, sf):
    return G.unfold(_gaps(spark, sf), ["request_id"], "missing_skills")


@query
def gap_score(spark, sf):
    return _gaps(spark, sf).select(
        "request_id", "market_source", "skill_score", "resume_skill_count", "market_skill_count", "match_count",
        "gap_count")


@query
def gap_recommendations(spark, sf):
    return G.unfold(_gaps(spark, sf), ["request_id"], "recommendations")


@query
def category_gaps(spark, sf):
    return G.category_gaps(_answered(spark, sf), ["request_id"]).drop("top_missing")


@query
def category_top_missing(spark, sf):
    return G.category_gaps(_answered(spark, sf), ["request_id"], strict=True).select(
        "request_id", "category", joined("top_missing"))


def _named_answers(spark, sf) -> DataFrame:
    """As above, over skills of every category, without a cut by the request."""
    segments = I.segments(I.postings(spark, sf, I.SKILL_OF_WORD))
    asked = I.requests(spark, sf, I.SKILL_OF_WORD).withColumn("top_n", F.lit(100))
    return D.attach_demand(asked, segments)


@query
def every_category_gaps(spark, sf):
    return G.category_gaps(_named_answers(spark, sf), ["request_id"]).select(
        "request_id", "category", "total_skills", "has_skills", "missing_skills", "coverage_percentage",
        F.array_join("top_missing", ",").alias("missing_first"))


@query
def every_category_recommendations(spark, sf):
    segments = I.segments(I.postings(spark, sf, I.SKILL_OF_WORD))
    asked = I.requests(spark, sf, I.SKILL_OF_WORD).withColumn("top_n", F.lit(100))
    return G.unfold(resume.analyze_gaps(asked, segments), ["request_id"], "recommendations")


@query
def demand_labels(spark, sf):
    """Requests that end at each step: known roles of unknown firms and regions, and markets with live demand or none."""
    p = I.stored_postings(spark, sf)
    far = F.when(F.col("request_id") % 2 == 0, F.lit("atlantis"))
    asked = I.requests(spark, sf).withColumns({
        "company": F.when(F.col("request_id") % 2 == 0, F.lit("Nobody Inc")).otherwise(F.col("company")),
        "region": F.coalesce(far, F.col("region"))})
    segments = I.segments(p)
    live = D.segment_demand(D.demand_rollup(p), role="building", top_n=5).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("demand_count"), "skill")))
    answers = {"stored": D.attach_demand(asked, segments, live), "live": D.attach_demand(asked, segments.limit(0), live),
               "nothing": D.attach_demand(asked, segments.limit(0))}
    return dedupe.union_all([D.demand_rows(a, ["request_id"]).select(F.lit(market).alias("market"), "*")
                             for market, a in answers.items()])


# --- recommendations ---------------------------------------------------------------------------------------------

def _recommended(spark, sf, candidate_cap: int | None):
    postings = I.stored_postings(spark, sf)
    answered = R.recommend_postings(I.stored_requests(spark, sf), postings, I.segments(postings),
                                    candidate_cap=candidate_cap)
    return R.recommended_jobs(answered).select(
        "request_id", "total", "candidates_in_window", "candidates_scored", "rank", "job_uid", "title", "fit_score", "matched_count", "demand_alignment",
        "job_skill_count", joined("matched_skills"), joined("missing_skills"))


@query
def recommend_postings(spark, sf):
    return _recommended(spark, sf, R.CANDIDATE_CAP)


@query
def recommend_all_postings(spark, sf):
    """As above, with every posting of the window scored."""
    return _recommended(spark, sf, None)


@query
def recommend_results(spark, sf):
    """What every request is told by a full, an empty and a missing store."""
    postings = I.stored_postings(spark, sf)
    asked, segments = I.stored_requests(spark, sf), I.segments(postings)
    answers = [R.recommend_postings(asked, stored, segments, candidate_cap=R.CANDIDATE_CAP).select(
        F.lit(store).alias("store"), "request_id", "candidates_in_window", "market_result")
        for store, stored in (("full", postings), ("empty", postings.limit(0)), ("missing", None))]
    return dedupe.union_all(answers)


@query
def recent_postings(spark, sf):
    p = I.stored_postings(spark, sf)
    laid_out = I.by_month(dedupe.union_all([p, _recopied(p)]))
    return R.recent_postings(laid_out, 90).select("job_uid", "role", "scraped_at")


@query
def skill_jaccard(spark, sf):
    """Each posting of a customer against that customer's resume."""
    people = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_name").alias("company"))
    resumes = I.requests(spark, sf).select("request_id", "resume_skills").join(people, "request_id")
    return I.postings(spark, sf).join(resumes, "company").select(
        "job_uid", F.bround(S.jaccard(F.col("skills"), F.col("resume_skills")), 6).alias("similarity"))


# --- market ------------------------------------------------------------------------------------------------------

@query
def market_status(spark, sf):
    return M.market_status(I.postings(spark, sf))


@query
def source_counts(spark, sf):
    return M.source_counts(I.postings(spark, sf))


@query
def filter_options(spark, sf):
    return M.filter_options(I.by_month(I.postings(spark, sf)), region="nation_3", limit=20)


@query
def top_titles_region(spark, sf):
    return M.top_titles(I.postings(spark, sf), limit=5)


# --- texts -------------------------------------------------------------------------------------------------------

def _documents(spark, sf) -> DataFrame:
    return widen_scan(I.documents(spark, sf).select("doc_id", "text"))


@query
def text_skill_mentions(spark, sf):
    return T.skill_mentions(_documents(spark, sf), ["doc_id"], "text", I.TERMS)


@query
def text_top_skills(spark, sf):
    return T.top_skills(_documents(spark, sf), ["doc_id"], "text", I.TERMS, 3)


@query
def text_skill_list(spark, sf):
    tagged = T.with_skill_hits(_documents(spark, sf), "text", I.TERMS)
    return tagged.select("doc_id", F.array_join(T.skill_list(F.col("hits")), ",").alias("skills"))


@query
def text_many_terms(spark, sf):
    """Every text's first word and its first two words, where they differ, as terms: a table that grows with the texts."""
    docs = _documents(spark, sf)
    word = r"[\p{L}\p{N}_]+"
    opening = F.regexp_extract(F.lower("text"), rf"^[^\p{{L}}\p{{N}}_]*({word})([^\p{{L}}\p{{N}}_]+)({word})", 1)
    second = F.regexp_extract(F.lower("text"), rf"^[^\p{{L}}\p{{N}}_]*{word}([^\p{{L}}\p{{N}}_]+)({word})", 2)
    between = F.regexp_extract(F.lower("text"), rf"^[^\p{{L}}\p{{N}}_]*{word}([^\p{{L}}\p{{N}}_]+)({word})", 1)
    pair = F.when(opening != second, F.concat(opening, between, second))
    terms = docs.select(F.explode(F.array(opening, pair)).alias("term"))
    index = TermIndex.from_table(terms)
    return mentions_by_term(docs, ["doc_id"], "text", index).select("doc_id", "term", "mentions")


@query
def required_skills(spark, sf):
    return T.required_skills(_documents(spark, sf), ["doc_id"], "text", ["The", "by the", "rest", "apache", "C++"])


@query
def resume_chunks_max(spark, sf):
    return T.resume_skills(_documents(spark, sf), ["doc_id"], "text", I.TERMS)


@query
def resume_report(spark, sf):
    texts = I.resumes(spark, sf).select("conv_id", X.clean_text(F.col("text")).alias("text"))
    return T.resume_report(texts, ["conv_id"], "text", I.TERMS).select(
        "conv_id", "text_length", "skills_found", joined("skills"), "preview", "extraction_mode", "taxonomy_size",
        "chunks_processed")


@query
def extraction_summary(spark, sf):
    """Chunks of each document with per-chunk metadata taken from its columns."""
    docs = widen_scan(I.documents(spark, sf))
    chunks = T.chunk_texts(docs, ["doc_id", "lang", "source"], "text").select(
        "doc_id",
        F.when(F.col("chunk") == 0, F.lit("ml_hybrid")).otherwise(F.lit("regex")).alias("extraction_mode"),
        F.when(F.col("lang") != "en", F.col("source")).alias("model_version"),
        (F.col("chunk") > 2).alias("used_fallback"),
        (F.col("chunk") * 10 + 12).alias("taxonomy_size"),
        F.array(F.col("lang"), F.concat("source", (F.col("chunk") % 3).cast("string"))).alias("skills"),
    )
    return T.extraction_summary(chunks, ["doc_id"])


@query
def clean_text(spark, sf):
    return _documents(spark, sf).select("doc_id", X.clean_text(F.col("text")).alias("text"))


@query
def decode_resume(spark, sf):
    """Documents as file contents: one language is written as Latin-1, the others as UTF-8."""
    return files.resume_texts(_resume_files(spark, sf))


@query
def resume_status(spark, sf):
    """Every file with its status: known and unknown formats, blank and too large files, texts that came in extracted."""
    found = _resume_files(spark, sf)
    parts = F.pmod(F.regexp_extract("path", r"(\d+)", 1).cast("bigint"), F.lit(7))
    ending = F.element_at(F.array(*map(F.lit, [".PDF", ".doc", ".docx"])), (parts + 1).cast("int"))
    renamed = F.when(parts < 3, F.regexp_replace("path", r"\.\w+$", ending)).otherwise(F.col("path"))
    found = found.select(
        renamed.alias("path"), F.when(parts == 3, F.encode(F.lit(" \n "), "UTF-8")).otherwise(F.col("content")).alias("content"),
        F.when(parts == 4, F.lit(files.MAX_RESUME_BYTES + 1)).otherwise(F.col("length")).alias("length"))
    extracted = found.where("path LIKE '%.PDF'").select("path", F.concat(F.lit(" text of "), "path").alias("text"))
    return files.resume_status(found, extracted).select("path", "status", F.length("text").alias("text_length"))


def _resume_files(spark, sf) -> DataFrame:
    latin = F.encode(F.col("text"), "ISO-8859-1")
    docs = widen_scan(I.documents(spark, sf)).select(
        F.concat(F.lit("/resumes/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "de", F.lit(".TXT"))
                 .when(F.col("lang") == "es", F.lit(".xls")).otherwise(F.lit(".txt"))).alias("path"),
        F.when((F.col("lang") == "fr") & (F.decode(latin, "ISO-8859-1") == F.col("text")), latin)
        .otherwise(F.encode(F.col("text"), "UTF-8")).alias("content"))
    return docs.withColumn("length", F.length("content"))


@query
def normalize_skills(spark, sf):
    name = F.split("p_name", " ")
    extra = (F.when(F.col("p_size") < 10, F.lit("k8s")).when(F.col("p_size") < 20, F.lit(" Postgres "))
             .when(F.col("p_size") < 30, F.lit("NODE.js")).when(F.col("p_size") < 40, F.lit("d3.js")))
    raw = F.concat(F.array(extra, F.lit("  "), F.col("p_type")), name, F.array(F.upper(name[0]), F.lit("Kubernetes")))
    return I.table(spark, sf, "part").select(
        "p_partkey", F.array_join(S.normalize_skills(raw), "|").alias("normalized"))


@query
def parse_skills_cell(spark, sf):
    """Stored skills written in each accepted text form, by source."""
    source, items = F.col("source"), F.col("skills")
    quoted = F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))
    cell = (F.when(source == "1-URGENT", F.to_json(items)).when(source == "2-HIGH", quoted)
            .when(source == "3-MEDIUM", F.concat(F.lit("  "), F.array_join(items, " , ,")))
            .when(source == "5-LOW", F.array_join(items, ",")))
    return I.postings(spark, sf).select(
        "job_uid", F.array_join(X.parse_skill_cell(cell), "|").alias("skills"))


# --- sources -----------------------------------------------------------------------------------------------------

def _payload_rows(postings: DataFrame, source: str) -> DataFrame:
    """Postings as payloads of one source's layout; some fields missing, some empty, some padded."""
    title = F.when(F.col("title").startswith("F "), F.lit("")).otherwise(F.concat(F.lit("\t"), "title", F.lit(" ")))
    company = F.when(F.col("title").startswith("O "), F.lit(None)).otherwise(F.col("company"))
    place = F.when(F.col("title").startswith("P "), F.lit(None)).otherwise(F.col("location"))
    text = F.concat(F.lit(" "), F.array_join("skills", " \n "))
    fields = {
        "adzuna": [title.alias("title"), F.struct(company.alias("display_name")).alias("company"),
                   F.struct(place.alias("display_name")).alias("location"), text.alias("description"),
                   F.col("url").alias("redirect_url")],
        "jooble": [title.alias("title"), company.alias("company"), place.alias("location"), text.alias("snippet"),
                   F.col("url").alias("link")],
        "remotive": [title.alias("title"), company.alias("company_name"), place.alias("candidate_required_location"),
                     text.alias("description"), "url"],
        "arbeitnow": [title.alias("title"), company.alias("company_name"), place.alias("location"),
                      text.alias("description"), "url"],
    }[source]
    root = payloads.SHAPES[source].root
    wanted = F.when(F.lit(source == "arbeitnow"), F.lit(" Hot ")).otherwise(F.col("role"))
    return postings.select(
        wanted.alias("query"), F.when(F.col("role") != "BUILDING", F.col("role")).alias("location"),
        F.to_json(F.struct(F.array(F.struct(*fields)).alias(root))).alias("payload"),
    )


@query
def payload_normalise(spark, sf):
    p = I.stored_postings(spark, sf)
    frames = [payloads.postings_from_payloads(_payload_rows(p.where(F.col("source").isin(*of)), source), source,
                                              F.lit(SCRAPED_AT))
              for of, source in ((["1-URGENT"], "adzuna"), (["2-HIGH"], "jooble"),
                                 (["3-MEDIUM", "4-NOT SPECIFIED"], "remotive"), (["5-LOW"], "arbeitnow"))]
    return dedupe.union_all(frames).select(
        "source", "title", "company", "location", "role", "description", "url", "scraped_at")


@query
def ingest_tagged(spark, sf):
    """Two landed sources with overlapping copies, one denied source: filtered, keyed, first copy kept, tagged."""
    p = I.stored_postings(spark, sf)
    terms = I.Taxonomy.from_terms(["hot", "cold", "blue", "widget", "red", "hot gear"])
    frames = []
    for i, source in enumerate(("remotive", "jooble", "remotive", "adzuna")):
        landed = _payload_rows(p, source).withColumn("run", F.lit(i))
        frames.append(payloads.postings_from_payloads(landed, source, F.lit(SCRAPED_AT), keep=["run"]))
    tagged = ingest.ingest_postings(frames, terms, ["run", "role", "url", "position"], deny=[" Adzuna "])
    return tagged.select("job_uid", "source", "url", joined("skills"))


@query
def source_filter(spark, sf):
    return payloads.allowed_sources(I.postings(spark, sf), allow=[" 1-urgent", "2-HIGH", "5-low"], deny=["2-high"]) \
        .select("job_uid", "source")


@query
def search_plan(spark, sf):
    roles = I.table(spark, sf, "part").select(F.col("p_name").alias("role"), "p_partkey")
    return payloads.search_plan(roles, ["Acme", "ACME ", "Globex"], "p_partkey")


@query
def listing_cards(spark, sf):
    """Link cards of raw pages."""
    pages = I.table(spark, sf, "pages").withColumnRenamed("url", "page_url")
    layout = listings.ListingLayout(base="https://example.org", closed=True, title=(r"(?is)<a\b[^>]*>(.*?)</a>",),
                                    card=listings.LAYOUTS["linkedin"].card, link=(r"<a\b[^>]*>",))
    pages = pages.withColumn("query", F.lit("q")).withColumn("location", F.lit(None).cast("string"))
    cards = listings.postings_from_pages(widen_scan(pages), "pages", F.lit(SCRAPED_AT), layout, keep=["page_id"])
    return cards.select("page_id", "position", "title", "url")


def _listing_html(source: str):
    link = F.concat(F.lit("/job/"), "url")
    if source == "indeed":
        card = F.concat(F.lit('<div class="x job_seen_beacon"><a href="'), link, F.lit('"></a><h2 class="jobTitle"><span>'),
                        "title", F.lit('</span></h2>\n<span class="companyName">'), "company",
                        F.lit('</span><div class="companyLocation"> '), "location",
                        F.lit(' </div><div class="job-snippet"><b>skills</b>: <i>'), "description",
                        F.lit("</i></div></div>"))
    elif source == "wellfound":
        card = F.concat(F.lit('<section data-test="StartupResult"><h3>'), "company",
                        F.lit('</h3><h2>Open:<a class="t" href="'), link, F.lit('">'), "title",
                        F.lit('</a></h2><p>'), "description", F.lit("</p></section>"))
    else:
        card = F.concat(F.lit('<li><a class="base-card__full-link" href="https://jobs.example.org'), link,
                        F.lit('">go</a><h3> '), "title", F.lit(" </h3><h4>"), "company",
                        F.lit(' &amp; Sons</h4><span class="job-search-card__location">'), "location",
                        F.lit("</span></li>"))
    # The card twice, the second without its place in the page's data.
    return F.concat(F.lit("<html><body><ul>"), card, F.lit("\n"), card, F.lit("</ul></body></html>"))


@query
def listing_postings(spark, sf):
    """Pages of each known site layout, built from postings."""
    p = I.postings(spark, sf)
    frames = []
    for of, source in ((["1-URGENT"], "indeed"), (["2-HIGH"], "wellfound"),
                       (["3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "linkedin")):
        pages = p.where(F.col("source").isin(*of)).select(
            F.lit("https://example.org/search").alias("page_url"), F.col("role").alias("query"),
            F.lit("Anywhere").alias("location"), _listing_html(source).alias("html"))
        frames.append(listings.postings_from_pages(pages, source, F.lit(SCRAPED_AT)))
    return dedupe.union_all(frames).select(
        "source", "title", "company", "location", "role", "description", "url", "position")


@query
def batch_clean(spark, sf):
    """Documents through CSV: distinct rows, text in lower case, kept as Parquet."""
    source, target = scratch_path(spark, "jobs_csv"), scratch_path(spark, "jobs_parquet")
    docs = I.documents(spark, sf).select("lang", F.col("text").alias("Job Description"))
    files.write_jobs_csv(docs, source)
    files.clean_jobs_file(spark, source, target, "lang string, `Job Description` string")
    return spark.read.parquet(target).select("lang", F.col("Job Description").alias("description"))


# --- vectors -----------------------------------------------------------------------------------------------------

def _label_vectors(spark, sf) -> DataFrame:
    """One taxonomy vector per label: the mean of its vectors."""
    names = F.array(*[F.lit(t) for t in I.TERMS.terms])
    parts = I.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "mean"))).alias("v")).select(
        F.get(names, F.col("label")).alias("name"), F.transform("v", lambda e: e["mean"]).alias("vector"))


def _vector_hits(spark, sf, top_k=3) -> DataFrame:
    texts = widen_scan(I.table(spark, sf, "embeddings")).select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return V.similarity_hits(texts, "doc_id", _label_vectors(spark, sf), top_k=top_k)


@query
def vector_topk(spark, sf):
    return _vector_hits(spark, sf)


@query
def vector_hybrid(spark, sf):
    mentioned = T.skill_mentions(_documents(spark, sf), ["doc_id"], "text", I.TERMS)
    return V.hybrid_hits(_vector_hits(spark, sf), mentioned, "doc_id", top_k=4)


@query
def ensemble_tags(spark, sf):
    mentioned = T.skill_mentions(_documents(spark, sf), ["doc_id"], "text", I.TERMS)
    vectored = I.table(spark, sf, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("doc_id"))
    return V.ensemble_tags(_vector_hits(spark, sf), mentioned, "doc_id", vectored)


# --- streams -----------------------------------------------------------------------------------------------------

def _streamed(spark, sf) -> str:
    """Documents as JSON messages and some broken ones, run through the stream; the folder of its results."""
    source, out = scratch_path(spark, "messages"), scratch_path(spark, "stream")
    docs = widen_scan(I.documents(spark, sf))
    jobs = docs.select(F.col("lang").alias("Job Title"), F.col("text").alias("Job Description"),
                       F.when(F.col("lang") == "en", F.col("source")).alias("Key Skills"))
    broken = docs.where("lang = 'fr'").select(F.concat(F.lit('{"Job Title": "the of", "x'), "doc_id").alias("value"))
    files.as_messages(jobs).unionByName(broken).write.text(source)
    sink = C.SkillCountSink(out, I.TERMS)
    run = sink.attach(C.file_messages(spark, source), f"{out}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return out


@query
def stream_batch_counts(spark, sf):
    return C.batch_counts(spark, _streamed(spark, sf)).groupBy("skill").agg(
        F.sum("postings").alias("postings"), F.sum("mentions").alias("mentions"))


@query
def stream_batches(spark, sf):
    """Counts per batch id of a stream with an empty batch, one without hits, and one that is delivered again."""
    source, out = scratch_path(spark, "messages"), scratch_path(spark, "stream")
    docs = widen_scan(I.documents(spark, sf))
    known = F.col("lang").isin("en", "fr", "de")
    batches = [docs.where("lang = 'en'"), docs.where("lang = 'fr'"), docs.limit(0),
               docs.where("lang = 'de'").withColumn("text", F.lit("zzz")), docs.where(~known | F.col("lang").isNull())]
    sink = C.SkillCountSink(out, I.TERMS)
    for i, batch in enumerate(batches):
        # Each run takes what has landed since the last one as one batch.
        files.as_messages(batch.select(F.col("text").alias("Job Description"))).write.text(f"{source}/part={i}")
        messages = C.file_messages(spark, f"{source}/*")
        sink.attach(messages, f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    sink(spark.read.text(f"{source}/part=1").select("value"), 1)
    return C.batch_counts(spark, out).select("batch_id", "skill", "postings", "mentions")


@query
def live_demand(spark, sf):
    return C.live_demand(spark, _streamed(spark, sf)).select("rank", "skill", "postings", "demand_count")


@query
def simple_term_counts(spark, sf):
    messages = files.as_messages(widen_scan(I.documents(spark, sf)).select(F.col("text").alias("Job Description")))
    return C.count_terms(messages, list(I.TERMS.terms)).select("skill", "postings")


@query
def replayed_rows(spark, sf):
    """CSV rows as JSON messages, read back field by field."""
    source, target = scratch_path(spark, "jobs_csv"), scratch_path(spark, "messages")
    docs = I.documents(spark, sf).select(F.col("doc_id").cast("string").alias("Job Title"),
                                         F.col("text").alias("Job Description"))
    files.write_jobs_csv(docs, source)
    files.replay_jobs(spark, source, target, "`Job Title` string, `Job Description` string")
    return spark.read.schema("`Job Title` string, `Job Description` string").json(target).select(
        F.col("Job Title").cast("bigint").alias("doc_id"), F.col("Job Description").alias("text"))
