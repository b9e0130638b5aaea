"""Stored tables after batches against tables made from zero, and what reaches the scans."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skillgrid.operators import demand as D
from skillgrid.plans import market as M, recommend as R
from skillgrid.sources import layout as L
from skillgrid.sources.store import LAYOUT, PENDING, POSTINGS_SCHEMA, MarketStore


def batch(spark, seed, n, months=6):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        at = rng.choice(["bad", None, *(f"2024-{m + 1:02d}-{rng.randint(1, 28):02d}T00:00:00+00:00" for m in range(months))])
        rows.append((f"u{rng.randint(0, 60)}", "s", "t", rng.choice(["Acme", " acme", None]), rng.choice(["Rome", "Paris", None, ""]),
                     rng.choice(["Web", "ops ", None]), "d", f"l{rng.randint(0, 9)}", at,
                     rng.sample(["Git", "Go", "Sql", "Aws"], rng.randint(0, 3))))
    return spark.createDataFrame(rows, POSTINGS_SCHEMA)


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def same_as_from_zero(store):
    postings = store.table("job_postings")
    rollup = D.demand_rollup(postings)
    assert rows(store.table("skill_demand")) == rows(rollup)
    assert rows(store.table("demand_segments")) == rows(D.demand_segments(D.demand_cube(rollup)))
    assert rows(store.table(LAYOUT)) == rows(L.typed_postings(postings))


def test_changes_equal_tables_made_from_zero(spark):
    store = MarketStore(spark, "changed_store", buckets=4, by_month=True)
    for seed, n in ((1, 80), (3, 1), (4, 60)):
        store.upsert_postings(batch(spark, seed, n, months=2 + seed))
        same_as_from_zero(store)
    store.upsert_postings(batch(spark, 5, 5).limit(0))
    same_as_from_zero(store)


def test_a_month_that_empties_leaves(spark):
    store = MarketStore(spark, "emptied_month", buckets=4, by_month=True)
    one = [("a", "s", "t", "c", "l", "r", "d", "u", "2024-01-05T00:00:00+00:00", ["Git"])]
    store.upsert_postings(spark.createDataFrame(one, POSTINGS_SCHEMA))
    store.upsert_postings(spark.createDataFrame([(*one[0][:8], "2024-03-05T00:00:00+00:00", ["Go"])], POSTINGS_SCHEMA))
    assert [r.month for r in store.table(LAYOUT).select("month").collect()] == ["2024-03"]
    assert [(r.skill, r.demand_count) for r in store.table("skill_demand").select("skill", "demand_count").collect()] == [("Go", 1)]


@pytest.mark.parametrize("step", ["added", "changed_segments"])
def test_a_batch_cut_short_is_made_good(spark, monkeypatch, step):
    """The postings are merged but demand is not: opening the store again rebuilds it."""
    name = f"cut_short_{step}"
    store = MarketStore(spark, name, buckets=4, by_month=True)
    store.upsert_postings(batch(spark, 1, 40))

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(f"skillgrid.sources.store.{step}", fail)
    with pytest.raises(RuntimeError):
        store.upsert_postings(batch(spark, 2, 40))
    monkeypatch.undo()
    assert store.exists(PENDING)
    again = MarketStore(spark, name, buckets=4)
    assert not again.exists(PENDING)
    same_as_from_zero(again)
    again.upsert_postings(batch(spark, 3, 20))
    same_as_from_zero(again)


def executed(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def by_month(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("months") / "postings")
    L.write_typed(batch(spark, 8, 200, months=12), path)
    return spark.read.option("basePath", path).parquet(path)


def test_recent_postings_read_the_months_they_need(spark, by_month):
    recent = R.recent_postings(by_month, 40)
    plan = executed(recent)
    scan = plan[plan.index("PartitionFilters"):]
    assert "month" in scan.split("PushedFilters")[0] and "2024-11" in scan.split("PushedFilters")[0]
    assert "GreaterThanOrEqual(scraped_ts" in scan
    plain = L.untyped(by_month)
    assert rows(recent) == rows(R.recent_postings(plain, 40))
    assert recent.columns == plain.columns


def test_filter_options_push_their_filters(spark, by_month):
    plan = executed(M.filter_options(by_month, region=" Rome", role="OPS"))
    assert "EqualTo(location_norm,rome)" in plan and "EqualTo(role_norm,ops)" in plan
    assert "description" not in plan[plan.index("ReadSchema"):].split("\n")[0]
    plain = L.untyped(by_month)
    assert rows(M.filter_options(by_month, region=" Rome")) == rows(M.filter_options(plain, region=" Rome"))
    assert rows(M.top_titles(by_month, region="rome")) == rows(M.top_titles(plain, region="rome"))


def test_layout_without_dates_and_refused_ages(spark, by_month, tmp_path):
    undated = batch(spark, 3, 20).withColumn("scraped_at", F.lit("none"))
    path = str(tmp_path / "undated")
    L.write_typed(undated, path)
    laid_out = spark.read.schema(L.typed_postings(undated).schema).parquet(path)
    assert R.recent_postings(laid_out, 30).count() == 20
    for days in (0, 181):
        with pytest.raises(ValueError):
            R.recent_postings(by_month, days)
    assert L.newest_ts(by_month) == by_month.agg(F.max("scraped_ts")).first()[0] and isinstance(L.newest_ts(by_month), datetime)
