"""Segment lists summed in blocks, against the cube and its lists made one by one."""

import random
import time
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from skillgrid.operators import demand as D, segment_lists as L
from skillgrid.operators.deltas import added, changed_segments, signed_rollup

ROLLUP = "role_norm string, company_norm string, location_norm string, skill string, demand_count bigint"


def rollup(spark, seed, n, signed=False):
    rng = random.Random(seed)
    keys = {}
    for _ in range(n):
        key = (rng.choice(["web", "", None]), rng.choice(["acme", "", None, "ab", "b"]), rng.choice(["rome", "", None, "é"]),
               rng.choice(["Git", "Go", "", None, "é", "Z", "\U0001f600", "￿"]))
        keys[key] = rng.choice([-1, 1, 2] if signed else [1, 2, 3])
    return spark.createDataFrame([(*k, n) for k, n in keys.items()], ROLLUP)


def rows(df):
    return sorted(map(repr, df.select(*D.SEGMENT, "demand").collect()))


def lists(rollup):
    return D.demand_segments(D.demand_cube(rollup))


def test_segments_of_odd_keys_equal_the_cubes_lists(spark):
    for seed, n in ((1, 120), (2, 5), (3, 0)):
        given = rollup(spark, seed, n)
        assert rows(D.cube_segments(given)) == rows(lists(given))


def test_changes_of_odd_skills_are_not_lost(spark):
    """A change of a skill without a name once left its list as it was."""
    for seed in (4, 5, 6):
        before, now = rollup(spark, seed, 100), rollup(spark, seed + 10, 60)
        change = now.unionByName(before.withColumn("demand_count", -F.col("demand_count"))).groupBy(
            *before.columns[:4]).agg(F.sum("demand_count").alias("demand_count")).where("demand_count <> 0")
        after = added(before, change)
        assert rows(changed_segments(lists(before), change)) == rows(lists(after)) == rows(lists(now))


def test_a_long_list_changes_in_proportion_to_its_length(spark):
    def seconds(n):
        given = spark.range(n, numPartitions=1).select(
            F.lit("web").alias("role_norm"), F.lit("acme").alias("company_norm"), F.lit("rome").alias("location_norm"),
            F.format_string("skill %05d", "id").alias("skill"), F.lit(1).cast("bigint").alias("demand_count"))
        start = time.perf_counter()
        changed = changed_segments(lists(given), given).select(F.explode("demand").alias("d")).agg(F.sum("d.demand_count"))
        assert changed.first()[0] == 8 * 2 * n
        return time.perf_counter() - start

    seconds(10)
    few = min(seconds(1_000) for _ in range(2))
    assert seconds(8_000) < 4 * few + 2


def test_blocks_of_any_size_give_the_same_segments(monkeypatch):
    rng = random.Random(7)
    names, given = ["", "Go", "Git", None], []
    for deal in range(40):
        for _ in range(rng.randint(1, 12)):
            keys = [rng.choice(["", "web", None]), f"c{deal}", rng.choice(["", "rome", None])]
            if rng.random() < 0.5:
                given.append((deal, L.WITH_COMPANY, *keys, rng.choice(names), rng.choice([-1, 1, 2]), []))
            else:
                some = rng.sample(names, 2)
                given.append((deal, 7, *[k or "" for k in keys], None, None, [
                    {"demand_count": rng.choice([-2, 1, 5]), "skill": s} for s in some]))
    entry = pa.list_(pa.struct([("demand_count", pa.int64()), ("skill", pa.string())]))
    schema = pa.schema([("_deal", pa.int64()), ("kept", pa.int32()), *((k, pa.string()) for k in L.KEYS),
                        ("skill", pa.string()), ("demand_count", pa.int64()), ("demand", entry)])
    whole = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in given], schema)

    def run(block, batch):
        monkeypatch.setattr(L, "BLOCK", block)
        done = [r for b in L._lists(iter(whole.to_batches(max_chunksize=batch))) for r in b.to_pylist()]
        assert len({(r["kept"], *(r[k] for k in L.KEYS)) for r in done}) == len(done)
        return sorted(map(repr, done))

    assert run(1, 1) == run(7, 3) == run(50, 16) == run(10**6, 10**6)


def test_a_change_is_counted_in_one_pass_over_what_differs(spark):
    """One sum, not three; lists with a skill twice, without skills or without a former posting count in full."""
    posting = "struct<role:string,company:string,location:string,skills:array<string>>"
    rng = random.Random(11)

    def side():
        if rng.random() < 0.2:
            return None
        return (rng.choice(["Web", " web", None]), rng.choice(["A", None]), rng.choice(["Rome", " ROME "]),
                rng.choice([None, [], rng.choices(["Git", "Go", None, "Sql"], k=rng.randint(1, 5))]))

    given = [(side() or ("Web", "A", "Rome", ["Git"]), side()) for _ in range(300)]
    change = signed_rollup(spark.createDataFrame(given, f"_new {posting}, _old {posting}"))
    expected = Counter()
    for pair in given:
        for some, sign in zip(pair, (1, -1)):
            role, company, location, skills = some or (None, None, None, None)
            for skill in skills or []:
                expected[(role and role.strip().lower(), company and company.lower(), location.strip().lower(), skill)] += sign
    assert {tuple(r)[:4]: r.demand_count for r in change.collect()} == {k: n for k, n in expected.items() if n}
    plan = change._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
