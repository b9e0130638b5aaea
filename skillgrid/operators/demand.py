"""Market demand: rollup by segment, cube over segments, and demand for tables of requests.

A segment is a choice of role, company and location, each fixed or open. ``kept`` says which are fixed, as a bit mask
(role 4, company 2, location 1); open keys hold the empty string, so a key that is really empty differs from an open
one by the mask alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skillgrid.functions.skills import BASELINE_DEMAND
from skillgrid.functions.text import filter_key, segment_key
from skillgrid.operators.segment_lists import DEMAND as DEMAND_ARRAY, WITH_COMPANY, summed_segments
from skillgrid.operators.unnest import unnest, unnest_structs

ROLE, COMPANY, LOCATION = 4, 2, 1
SEGMENT = ["kept", "role_key", "company_key", "location_key"]

# Labels of the steps tried in turn, most specific first.
LABELS = [
    "snapshot_role_company_region",
    "snapshot_role_region",
    "snapshot_role_company",
    "snapshot_role_only",
    "snapshot_region_only",
    "snapshot_global",
]
EXACT_LABEL, LIVE_LABEL, BASELINE_LABEL = "market_snapshot", "live_stream", "baseline_default"


def demand_rollup(postings: DataFrame) -> DataFrame:
    """Postings per role, company, location and skill; postings without skills drop out."""
    return (
        postings.select(
            segment_key(F.col("role")).alias("role_norm"),
            segment_key(F.col("company")).alias("company_norm"),
            segment_key(F.col("location")).alias("location_norm"),
            F.explode("skills").alias("skill"),
        )
        .groupBy("role_norm", "company_norm", "location_norm", "skill")
        .agg(F.count("*").alias("demand_count"))
    )


def _cube_sets(demand: DataFrame, masks: tuple[int, ...]) -> DataFrame:
    """Demand per skill for the combinations of fixed keys in ``masks``."""
    r, c, l = F.col("role_norm"), F.col("company_norm"), F.col("location_norm")
    sets = [[k for k, bit in ((r, ROLE), (c, COMPANY), (l, LOCATION)) if mask & bit] + [F.col("skill")]
            for mask in masks]
    kept = [F.when(F.grouping(k) == 0, F.lit(bit)).otherwise(F.lit(0))
            for k, bit in (("role_norm", ROLE), ("company_norm", COMPANY), ("location_norm", LOCATION))]
    cubed = demand.groupingSets(sets, r, c, l, F.col("skill")).agg(
        F.sum("demand_count").alias("demand_count"), (kept[0] + kept[1] + kept[2]).alias("kept"))
    usable = F.lit(True)
    for name, bit in (("role_norm", ROLE), ("company_norm", COMPANY), ("location_norm", LOCATION)):
        usable = usable & ((F.col("kept").bitwiseAND(bit) == 0) | F.col(name).isNotNull())
    return cubed.where(usable).select(
        "kept",
        *[F.coalesce(F.col(f"{k}_norm"), F.lit("")).alias(f"{k}_key") for k in ("role", "company", "location")],
        "skill",
        "demand_count",
    )


def _open_company(demand: DataFrame) -> DataFrame:
    """The cube's combinations with an open company, from a rollup without companies."""
    coarse = demand.groupBy("role_norm", "location_norm", "skill").agg(
        F.sum("demand_count").alias("demand_count"))
    coarse = coarse.withColumn("company_norm", F.lit(None).cast("string"))
    return _cube_sets(coarse, tuple(m for m in range(8) if not m & COMPANY))


def demand_cube(demand: DataFrame) -> DataFrame:
    """Demand per skill for every combination of fixed and open keys; a fixed key is never null.

    Combinations with an open company are summed from a rollup without companies. For the others the rows are dealt over
    all tasks first: each becomes four, hardly any of them fall together before the shuffle, and a task of a whole file
    split would hold more groups than fit into memory.
    """
    # The count is given, so adaptive execution does not merge small partitions again.
    parts = int(demand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fine = demand.where(F.col("company_norm").isNotNull()).repartition(
        parts, "role_norm", "company_norm", "location_norm", "skill")
    return _cube_sets(fine, tuple(m for m in range(8) if m & COMPANY)).unionByName(_open_company(demand))


def demand_segments(cube: DataFrame) -> DataFrame:
    """One row per segment with its ranked demand.

    The array has at most one entry per taxonomy term, so its length does not grow with the data. The cube is dealt by
    segment as plain rows: lists collected before that would have one entry each.
    """
    entry = F.struct((-F.col("demand_count")).alias("minus"), "skill")
    ranked = F.sort_array(F.collect_list(entry))
    return cube.repartition(*SEGMENT).groupBy(*SEGMENT).agg(
        F.transform(ranked, lambda e: F.struct((-e["minus"]).alias("demand_count"), e["skill"].alias("skill")))
        .alias("demand"))


def _segment_rows(demand: DataFrame) -> DataFrame:
    """The rows of a rollup, signed ones as well, as ``summed_segments`` takes them."""
    keys = [F.col(f"{k}_norm").alias(f"{k}_key") for k in ("role", "company", "location")]
    fine = demand.where(F.col("company_norm").isNotNull()).select(
        F.lit(WITH_COMPANY).alias("kept"), *keys, "skill", "demand_count")
    return fine.unionByName(_open_company(demand)).withColumn("demand", F.array().cast(DEMAND_ARRAY))


def cube_segments(demand: DataFrame, onto: DataFrame | None = None) -> DataFrame:
    """``demand_segments(demand_cube(demand))`` in one step, added to the segments ``onto`` if given.

    A rollup's rows are not expanded to the cube before the shuffle. Open-company combinations are summed on the map side.
    """
    rows = _segment_rows(demand)
    if onto is not None:
        rows = onto.select(*SEGMENT, F.lit(None).cast("string").alias("skill"),
                           F.lit(None).cast("bigint").alias("demand_count"), "demand").unionByName(rows)
    return summed_segments(rows)


def segment_demand(demand: DataFrame, role: str | None = None, company: str | None = None,
                   region: str | None = None, top_n: int = 20) -> DataFrame:
    """Most demanded skills of one segment; filters left out are open."""
    for column, value in (("role_norm", role), ("company_norm", company), ("location_norm", region)):
        if value:
            demand = demand.where(F.col(column) == value.lower().strip())
    return (
        demand.groupBy("skill").agg(F.sum("demand_count").alias("demand_count"))
        .orderBy(F.desc("demand_count"), "skill").limit(top_n)
    )


def segment_sql(role: str | None, company: str | None, region: str | None) -> str:
    """Fields of a segment as SQL, for filter columns that may be null (open) row by row; None is open for all."""
    parts = ((role, ROLE), (company, COMPANY), (region, LOCATION))
    mask = " + ".join(f"if({column} IS NULL, 0, {bit})" for column, bit in parts if column) or "0"
    keys = [f"coalesce({column}, '')" if column else "''" for column, _ in parts]
    return ", ".join(f"{value} AS {name}" for value, name in zip([mask, *keys], SEGMENT))


def with_exact_segment(requests: DataFrame) -> DataFrame:
    """Add the segment of a request's own filters."""
    filters = [filter_key(F.col(c)).alias(f"_{c}") for c in ("role", "company", "region")]
    fields = F.expr(f"struct({segment_sql('_role', '_company', '_region')})").alias("_segment")
    return requests.select("*", *filters).select(*requests.columns, fields).select(*requests.columns, "_segment.*")


def _levels() -> Column:
    """The segments to try for a filter triple, level 1 first; a level shows only if it applies."""
    role, company, region = "role_filter", "company_filter", "region_filter"
    steps = [
        ([], (role, company, region)),
        ([role, company, region], (role, None, region)),
        ([role, company], (role, company, None)),
        ([role], (role, None, None)),
        ([region], (None, None, region)),
        ([], (None, None, None)),
    ]
    options = []
    for level, (needed, filters) in enumerate(steps, start=1):
        applies = " AND ".join(f"{c} IS NOT NULL" for c in needed) or "true"
        options.append(f"CASE WHEN {applies} THEN struct({level} AS level, {segment_sql(*filters)}) END")
    return F.expr(f"array_compact(array({', '.join(options)}))")


def relaxation_levels(filters: DataFrame) -> DataFrame:
    """One row per distinct filter triple and level that applies to it."""
    return unnest_structs(filters, filters.columns, _levels())


def resolve_segments(requests: DataFrame, segments: DataFrame) -> DataFrame:
    """For each distinct filter triple the first segment of its relaxation that has any demand.

    Resolving triples rather than requests keeps popular filters from piling up on one key. The open segment is
    every triple's last resort and would be the hottest key of all; it has demand whenever any segment has, so it is
    taken without a join.
    """
    triples = ["role_filter", "company_filter", "region_filter"]
    filters = requests.select(*[filter_key(F.col(c)).alias(f"{c}_filter")
                                for c in ("role", "company", "region")]).distinct()
    levels = relaxation_levels(filters)
    backed = levels.where("kept > 0").join(segments.select(*SEGMENT), SEGMENT, "left_semi").select(*levels.columns)
    best = backed.unionByName(levels.where("kept = 0")).groupBy(*triples).agg(F.min("level").alias("level"))
    chosen = F.get(F.filter(_levels(), lambda s: s["level"] == F.col("level")), F.lit(0)).alias("_chosen")
    label = F.element_at(F.lit(LABELS), F.col("level")).alias("market_source")
    return best.select(*triples, chosen, label).select(*triples, *[f"_chosen.{c}" for c in SEGMENT], "market_source")


def _live_array(live: DataFrame | None) -> Column:
    """Demand of the last stream batch (a table of at most ten rows) as one array."""
    if live is None:
        return F.array().cast(DEMAND_ARRAY)
    ranked = live.agg(F.sort_array(F.collect_list(F.struct(
        F.col("rank"), F.col("demand_count").cast("bigint").alias("demand_count"), F.col("skill")))).alias("d"))
    entries = F.transform("d", lambda e: F.struct(e["demand_count"], e["skill"])).cast(DEMAND_ARRAY)
    return ranked.select(entries).scalar()


def _with_fallback(found: DataFrame, live: DataFrame | None) -> DataFrame:
    """Cut the demand at top_n; without any, take the live demand uncut, else the baseline cut at top_n."""
    baseline = F.array(*[F.struct(F.lit(n).cast("bigint").alias("demand_count"), F.lit(s).alias("skill"))
                         for s, n in BASELINE_DEMAND])
    found = found.withColumn("_live", _live_array(live))
    snapshot = F.size("_found") > 0
    stream = F.size("_live") > 0
    top_n = F.greatest(F.lit(0), F.col("top_n"))
    return found.withColumn(
        "demand",
        F.when(snapshot, F.slice("_found", 1, top_n)).when(stream, F.col("_live"))
        .otherwise(F.slice(baseline, 1, top_n)),
    ).withColumn(
        "market_source",
        F.when(snapshot, F.col("market_source")).when(stream, F.lit(LIVE_LABEL)).otherwise(F.lit(BASELINE_LABEL)),
    ).drop("_found", "_live")


def attach_demand(requests: DataFrame, segments: DataFrame, live: DataFrame | None = None,
                  relax: bool = True) -> DataFrame:
    """Add ``demand`` (ranked array) and ``market_source`` to requests (role, company, region, top_n, ...).

    With ``relax`` the filters are dropped step by step until a segment has demand; without, only the request's own
    segment counts. ``segments`` is best a stored table: it is read by key here, twice at most.
    """
    own = requests.columns
    if relax:
        keyed = requests.select("*", *[filter_key(F.col(c)).alias(f"{c}_filter")
                                       for c in ("role", "company", "region")])
        resolved = resolve_segments(requests, segments)
        same = F.lit(True)
        for c in ("role_filter", "company_filter", "region_filter"):
            same = same & keyed[c].eqNullSafe(resolved[c])
        located = keyed.join(resolved, same, "left").select(*[keyed[c] for c in own], *SEGMENT, "market_source")
    else:
        located = with_exact_segment(requests).withColumn("market_source", F.lit(EXACT_LABEL))
    found = located.join(segments.withColumnRenamed("demand", "_found"), SEGMENT, "left").select(
        *own, "market_source", F.coalesce("_found", F.array().cast(DEMAND_ARRAY)).alias("_found"))
    return _with_fallback(found, live)


def demand_rows(answered: DataFrame, keys: list[str]) -> DataFrame:
    """One row per request and demanded skill, with its rank."""
    return unnest(answered, [*keys, "market_source"], "demand").select(
        *keys, "market_source", (F.col("_at") + 1).alias("rank"), "_item.skill", "_item.demand_count")


def baseline_demand(spark, top_n: int | None = None) -> DataFrame:
    rows = [(i + 1, s, n) for i, (s, n) in enumerate(BASELINE_DEMAND)]
    table = spark.createDataFrame(rows, "rank int, skill string, demand_count bigint")
    return table if top_n is None else table.where(F.col("rank") <= top_n)
