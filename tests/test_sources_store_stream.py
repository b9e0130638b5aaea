"""Landed data, stored tables and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from skillgrid.operators import dedupe, vectors as V
from skillgrid import session
from skillgrid.plans import ingest, market as M, resume
from skillgrid.sources import files, listings, payloads
from skillgrid.sources.store import POSTINGS_SCHEMA, MarketStore
from skillgrid.streaming import counts as C
from skillgrid.taxonomy import Taxonomy

AT = "2024-05-01T00:00:00+00:00"


def landed(spark, bodies, query="data engineer", location="Pune"):
    rows = [(query, location, b if isinstance(b, str) else json.dumps(b)) for b in bodies]
    return spark.createDataFrame(rows, "query string, location string, payload string")


def test_payload_shapes(spark):
    nested = {"results": [{"title": " T ", "company": {"display_name": "C"}, "location": {}, "description": "a \n b",
                           "redirect_url": " u "}, {"title": None, "company": None}]}
    rows = payloads.postings_from_payloads(landed(spark, [nested, "not json", {"results": None}, {}]), "adzuna",
                                           F.lit(AT)).orderBy("position").collect()
    assert [(r.title, r.company, r.location, r.description, r.url) for r in rows] == [
        ("T", "C", "Pune", "a b", "u"), ("Unknown", "Unknown", "Pune", "", "")]
    flat = {"data": [{"title": "Data Engineer", "company_name": " ", "location": "", "description": "x", "url": None},
                     {"title": "Cook", "company_name": "K", "location": "Rome", "description": "y"}]}
    rows = payloads.postings_from_payloads(landed(spark, [flat], " DATA "), "arbeitnow", F.lit(AT)).collect()
    assert [(r.title, r.company, r.location, r.role) for r in rows] == [("Data Engineer", "", "Remote", " DATA ")]
    jobs = {"jobs": [{"title": "A", "company": "B", "snippet": "s", "link": "l"}]}
    assert payloads.postings_from_payloads(landed(spark, [jobs], location=""), "jooble", F.lit(AT)).first().location == "India"


def test_source_filter_and_search_plan(spark):
    df = spark.createDataFrame([("Indeed",), ("jooble ",), (None,)], "source string")
    assert [r[0] for r in payloads.allowed_sources(df, [" INDEED "]).collect()] == ["Indeed"]
    assert payloads.allowed_sources(df, [], []).count() == 3
    roles = spark.createDataFrame([(1, "dev"), (2, "Dev"), (3, "ops")], "pos int, role string")
    plan = payloads.search_plan(roles, ["acme"], "pos").orderBy("role_position", "company_position")
    assert [r.query for r in plan.collect()] == ["dev", "dev acme", "ops", "ops acme"]


def test_listing_layouts(spark):
    page = """<ul><li><h3> Data <b>Eng</b> </h3><h4>A &amp; B</h4>
      <span class="job-search-card__location">Rome</span><a class="x base-card__full-link" href="https://e/1?a=1&amp;b=2">v</a></li>
      <li>no parts</li></ul>"""
    pages = spark.createDataFrame([("https://p", "q", "Milan", page)], "page_url string, query string, location string, html string")
    rows = listings.postings_from_pages(pages, "linkedin", F.lit(AT)).orderBy("position").collect()
    assert [(r.title, r.company, r.location, r.url) for r in rows] == [
        ("Data Eng", "A & B", "Rome", "https://e/1?a=1&b=2"), ("Unknown", "Unknown", "Milan", "https://p")]
    fallback = '<a class="tapItem" href="/x"><h2><a href="/y">T</a></h2></a>'
    pages = spark.createDataFrame([("https://p", "q", "Milan", fallback)], pages.schema)
    r = listings.postings_from_pages(pages, "indeed", F.lit(AT)).first()
    assert (r.title, r.url) == ("T", "https://www.indeed.com/x")
    detail = spark.createDataFrame([("https://e/1?a=1&b=2", '<div class="show-more-less-html__markup">Big\n <p>job</p></div>')],
                                   "url string, html string")
    filled = listings.with_detail_descriptions(listings.postings_from_pages(
        spark.createDataFrame([("https://p", "q", "Milan", page)], pages.schema), "linkedin", F.lit(AT)), detail)
    assert sorted(r.description for r in filled.collect()) == ["", "Big job"]


def test_resume_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(" résumé \n".encode())
    (tmp_path / "b.TXT").write_bytes("résumé".encode("latin-1"))
    (tmp_path / "c.xls").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b"x" * (files.MAX_RESUME_BYTES + 1))
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    found = files.read_resume_files(spark, str(tmp_path))
    texts = {r.path[-5:]: r.text for r in files.resume_texts(found).collect()}
    assert texts == {"a.txt": "résumé", "b.TXT": "résumé"}
    reports = {r.path[-5:]: r.skills for r in resume.read_resumes(found, Taxonomy.from_terms(["résumé"])).collect()}
    assert reports == {"a.txt": ["Résumé"], "b.TXT": ["Résumé"]}
    extracted = found.where("path LIKE '%.pdf'").selectExpr("path", "' one ' AS text")
    status = lambda e: {r.path[-5:]: r.status for r in files.resume_status(found, e).collect()}
    assert status(None) == {"a.txt": "read", "b.TXT": "read", "c.xls": "unsupported", "d.txt": "too_large", "e.pdf": "needs_text"}
    assert status(extracted)["e.pdf"] == "read"
    assert {r.path[-5:]: r.reason for r in files.rejected_resumes(found).collect()} == {
        "c.xls": "unsupported format", "d.txt": "file too large"}


def test_batch_clean_and_replay(spark, tmp_path):
    rows = [("A", 'Line "one",\nTwo  '), ("A", 'Line "one",\nTwo  '), ("B", None), ("C", " x\\ ")]
    df = spark.createDataFrame(rows, "`Job Title` string, `Job Description` string")
    files.write_jobs_csv(df, str(tmp_path / "csv"))
    assert files.clean_jobs_file(spark, str(tmp_path / "csv"), str(tmp_path / "out")) == 3
    got = {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"A": 'line "one",\ntwo  ', "B": None, "C": " x\\ "}
    assert files.lower_if_present(df, "missing").columns == df.columns
    files.replay_jobs(spark, str(tmp_path / "csv"), str(tmp_path / "msg"))
    sent = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "msg")).collect()]
    assert {"Job Title": "B"} in sent and len(sent) == 4


def posting(uid, at, role="r", skills=("Git",)):
    return (uid, "s", "t", "c", "l", role, "d", "u", at, list(skills))


def test_merge_equals_window_over_everything(spark):
    old = [posting("a", "2024-01-01"), posting("b", "bad"), posting("c", None), posting("d", "2024-01-05"), posting("e", "2024-01-01")]
    new = [posting("a", "2024-02-01", "n"), posting("a", "2024-01-15", "m"), posting("b", "2023-01-01", "n"), posting("c", "bad", "n"),
           posting("d", "2024-01-04", "n"), posting("e", "2024-01-01", "q"), posting("f", "x")]
    o, n = (spark.createDataFrame(x, POSTINGS_SCHEMA) for x in (old, new))
    merged = {r.job_uid: (r.role, r.scraped_at) for r in dedupe.merge_newest(o, n).collect()}
    window = {r.job_uid: (r.role, r.scraped_at) for r in dedupe.latest_postings(dedupe.union_all([o, n])).collect()}
    assert merged == window
    assert merged["a"] == ("n", "2024-02-01") and merged["d"][0] == "r" and merged["e"][0] == "q"


def test_store_upserts_and_reads_buckets_in_place(spark, tmp_path):
    store = MarketStore(spark, "market_test", buckets=4, snapshot_root=str(tmp_path))
    first = spark.createDataFrame([posting("a", "2024-01-01"), posting("b", "2024-01-01", skills=["Git", "Sql"])], POSTINGS_SCHEMA)
    assert store.upsert_postings(first) == 2
    second = spark.createDataFrame([posting("b", "2024-01-02", "n", ["Go"]), posting("c", "2024-01-01")], POSTINGS_SCHEMA)
    merged = dedupe.merge_newest(store.table("job_postings"), second)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    stored_side = plan[plan.index("Join"):].split("FileScan")[0]
    assert "SortMergeJoin" in plan and "Exchange" not in stored_side, plan
    assert store.upsert_postings(second.drop("description")) == 3
    assert {r.skill: r.demand_count for r in store.table("skill_demand").groupBy("skill").agg(
        F.sum("demand_count").alias("demand_count")).collect()} == {"Git": 2, "Go": 1}
    assert spark.read.parquet(f"{tmp_path}/skill_demand.parquet").count() == store.table("skill_demand").count()
    assert store.table("demand_segments").where("kept = 0").first().demand[0].skill == "Git"


def test_ingest_keeps_first_copy(spark):
    body = {"jobs": [{"title": "Python dev", "company_name": "A", "url": "u", "description": "git"}]}
    frames = [payloads.postings_from_payloads(landed(spark, [body], q).withColumn("n", F.lit(i)), "remotive", F.lit(AT), keep=["n"])
              for i, q in enumerate(["first", "second"])]
    rows = ingest.ingest_postings(frames, Taxonomy.from_terms(["python", "git"]), ["n", "position"]).collect()
    assert [(r.role, r.skills) for r in rows] == [("first", ["Git", "Python"])]


def test_market_questions_on_empty_and_null_rows(spark):
    empty = spark.createDataFrame([], POSTINGS_SCHEMA)
    r = M.market_status(empty).first()
    assert (r.snapshot_ready, r.total_jobs, r.last_scraped_at) == (False, 0, None)
    rows = [posting("a", AT)[:3] + (None, " Rome ", "nan", "d", "u", AT, []), posting("b", AT)]
    df = spark.createDataFrame(rows, POSTINGS_SCHEMA)
    assert {(r.kind, r.value) for r in M.filter_options(df).collect()} == {
        ("companies", "c"), ("regions", "Rome"), ("regions", "l"), ("roles", "r")}
    assert [r.name for r in M.top_titles(df.drop("title"), "ROME").collect()] == ["nan"]


def test_similarity_and_merging(spark):
    texts = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None)], "doc_id int, vector array<float>")
    terms = spark.createDataFrame([("sql", [2.0, 0.0]), ("go", [1.0, 1.0]), ("git", [0.0, -1.0])], "name string, vector array<double>")
    hits = V.similarity_hits(texts, "doc_id", terms, top_k=2)
    assert sorted(map(tuple, hits.collect())) == [(1, "Go", 0.7071), (1, "SQL", 1.0), (2, "Go", 0.7071)]
    mentioned = spark.createDataFrame([(1, "Sql", 120), (3, "Git", 2)], "doc_id int, skill string, mentions bigint")
    both = V.hybrid_hits(hits, mentioned, "doc_id", top_k=2)
    assert sorted((r.doc_id, r.rank, r.name, r.score) for r in both.collect()) == [
        (1, 1, "SQL", 1.0), (1, 2, "Go", 0.7071), (2, 1, "Go", 0.7071), (3, 1, "Git", 0.18)]
    vectored = texts.where("vector IS NOT NULL")
    tags = {tuple(r) for r in V.ensemble_tags(hits, mentioned, "doc_id", vectored).collect()}
    assert tags == {(1, "SQL", 120, "ml_hybrid", False), (1, "Go", 71, "ml_hybrid", False),
                    (2, "Go", 71, "ml_hybrid", False), (3, "Git", 2, "regex", True)}
    alone = {tuple(r)[:4] for r in V.ensemble_tags(hits, mentioned, "doc_id", vectored, use_text=False).collect()}
    assert alone == {(1, "SQL", 100, "ml"), (1, "Go", 71, "ml"), (2, "Go", 71, "ml"), (3, "Git", 2, "regex")}


def test_vectors_that_cannot_be_compared_are_listed(spark):
    texts = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [1.0, None]), (4, None), (5, [0.0, 1.0, 2.0])],
                                  "doc_id int, vector array<float>")
    terms = spark.createDataFrame([("sql", [0.5, 0.5]), ("SQL", [1.0, 0.0]), ("go", [0.0, 1.0])], "name string, vector array<double>")
    assert sorted(map(tuple, V.similarity_hits(texts, "doc_id", terms, top_k=3).collect())) == [(1, "SQL", 1.0)]
    assert sorted(r.doc_id for r in V.rejected_vectors(texts, "doc_id", terms).collect()) == [2, 3, 5]
    ragged = spark.createDataFrame([("sql", [0.5]), ("go", [0.0, 1.0])], "name string, vector array<double>")
    with pytest.raises(ValueError):
        V.similarity_hits(texts, "doc_id", ragged)


def test_limits_out_of_range_are_refused(spark):
    empty = spark.createDataFrame([], POSTINGS_SCHEMA)
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            M.filter_options(empty, limit=bad)
    with pytest.raises(ValueError):
        M.top_titles(empty, limit=31)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key.replace(".", "_"), default)

    class Session:
        conf = Conf(spark_master="spark://host:7077")

    with pytest.raises(ValueError):
        session.scratch_root(Session)
    Session.conf = Conf(spark_master="spark://host:7077", spark_checkpoint_dir="hdfs://shared/")
    assert session.scratch_root(Session) == "hdfs://shared"


@pytest.mark.parametrize("crash_at", ["after the old table left", "before the old table left"])
def test_store_survives_a_crash_during_a_swap(spark, tmp_path, crash_at):
    name = "crash_" + crash_at.split()[0]
    store = MarketStore(spark, name, buckets=4)
    store.upsert_postings(spark.createDataFrame([posting("a", "2024-01-01"), posting("b", "2024-01-01")], POSTINGS_SCHEMA))
    # The state in the middle of a swap: a complete successor beside the current or the retired table.
    third = spark.createDataFrame([posting(x, "2024-01-02", "n") for x in "abc"], POSTINGS_SCHEMA)
    third.write.bucketBy(store.buckets, "job_uid").sortBy("job_uid").saveAsTable(f"{name}.job_postings_staging_x")
    if crash_at.startswith("after"):
        spark.sql(f"ALTER TABLE {name}.job_postings RENAME TO {name}.job_postings_retired")
    again = MarketStore(spark, name, buckets=4)
    assert again.table("job_postings").count() == (3 if crash_at.startswith("after") else 2)
    assert again.upsert_postings(spark.createDataFrame([posting("d", "2024-01-01")], POSTINGS_SCHEMA)) == (
        4 if crash_at.startswith("after") else 3)
    assert {t.name for t in spark.catalog.listTables(name)} == {"job_postings", "skill_demand", "demand_segments"}


def test_store_takes_the_retired_table_back(spark):
    store = MarketStore(spark, "crash_lost", buckets=4)
    store.upsert_postings(spark.createDataFrame([posting("a", "2024-01-01"), posting("b", "2024-01-01")], POSTINGS_SCHEMA))
    spark.sql("ALTER TABLE crash_lost.job_postings RENAME TO crash_lost.job_postings_retired")
    assert MarketStore(spark, "crash_lost", buckets=4).upsert_postings(
        spark.createDataFrame([posting("c", "2024-01-01")], POSTINGS_SCHEMA)) == 3


def test_similarity_in_small_slices(spark, monkeypatch):
    texts = spark.range(500).select(F.col("id").alias("doc_id"), F.array(
        F.sin("id").cast("float"), F.cos("id").cast("float")).alias("vector"))
    terms = spark.createDataFrame([(f"t{i}", [1.0, i / 10]) for i in range(7)], "name string, vector array<double>")
    whole = sorted(map(tuple, V.similarity_hits(texts, "doc_id", terms, top_k=3).collect()))
    monkeypatch.setattr(V, "SCORES_AT_ONCE", 50)
    assert sorted(map(tuple, V.similarity_hits(texts, "doc_id", terms, top_k=3).collect())) == whole and len(whole) > 500


def run_stream(spark, source, out, sink):
    query = sink.attach(C.file_messages(spark, str(source), 1), f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_counts_live_demand_and_replay(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    batches = [['{"Job Title": "Python dev", "Job Description": "python and git"}', '{"Job Title": "broken'],
               ['{"Key Skills": "GIT", "Qualifications": ""}', "[1, 2]", '{"Job Title": 5}'],
               ['{"Job Title": "cook"}'], []]
    import os
    for i, lines in enumerate(batches):
        path = source / f"{i}.json"
        path.write_text("".join(f"{x}\n" for x in lines))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    sink = C.SkillCountSink(out, Taxonomy.from_terms(["git", "python"]))
    assert C.live_demand(spark, out).count() == 0
    run_stream(spark, source, out, sink)
    rows = {(r.batch_id, r.skill, r.postings, r.mentions) for r in C.batch_counts(spark, out).collect()}
    assert C.batch_counts(spark, out).select("run").distinct().count() == 1
    assert rows == {(0, "Python", 1, 2), (0, "Git", 1, 1), (1, "Git", 1, 1)}
    assert [(r.skill, r.demand_count, r.batch_id) for r in C.live_demand(spark, out).collect()] == [("Git", 1, 1)]
    assert [r.value for r in spark.read.parquet(f"{out}/rejected").where("batch_id = 0").collect()] == ['{"Job Title": "broken']
    # A batch delivered again replaces itself.
    sink(spark.read.text(str(source / "1.json")), 1)
    assert {(r.batch_id, r.skill, r.postings, r.mentions) for r in C.batch_counts(spark, out).collect()} == rows
    # A stream that starts over counts from batch 0 again: newer data is live, and older counts stay.
    again = C.SkillCountSink(out, Taxonomy.from_terms(["git", "python"]))
    query = again.attach(C.file_messages(spark, str(source)), f"{out}/checkpoint2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert C.batch_counts(spark, out).select("run").distinct().count() == 2
    assert [(r.skill, r.demand_count, r.batch_id) for r in C.live_demand(spark, out).collect()] == [("Git", 2, 0), ("Python", 2, 0)]


def test_simple_mode(spark):
    messages = spark.createDataFrame([('{"Job Title": "JavaScript", "Key Skills": "SQL"}',), ('{"Job Title": "java"}',)], "value string")
    got = {r.skill: (r.postings, r.mentions) for r in C.count_terms(messages).collect()}
    assert got == {"Java": (2, 2), "Sql": (1, 1)}
