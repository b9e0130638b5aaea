"""Postings, requests and texts derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skillgrid.functions.skills import lookup
from skillgrid.operators.dedupe import with_posting_key
from skillgrid.operators.demand import demand_cube, demand_rollup, demand_segments
from skillgrid.session import scratch_path, stored
from skillgrid.sources.layout import write_typed
from skillgrid.taxonomy import Taxonomy

# Common words of the given texts, so that text queries find something.
TERMS = Taxonomy.from_terms(["the", "of", "in", "is", "la", "le", "des", "der", "und", "que", "on the", "by the"])


# Part words that stand for a skill of each category, so that every category rule is reached.
SKILL_OF_WORD = {"hot": "python", "cold": "google cloud", "blue": "postgresql", "red": "deep learning", "gear": "kubernetes",
                 "rod": "vue", "bolt": "apache spark", "ring": "mongodb", "plate": "javascript", "old": "aws",
                 "new": "terraform", "gizmo": "kafka"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stamp(column: str):
    return F.date_format(F.col(column), "yyyy-MM-dd'T'HH:mm:ssxxx")


def distinct_words(column: str):
    """Sorted distinct words of a group's names; names come from a small vocabulary, so the set stays small."""
    return F.sort_array(F.array_distinct(F.split(F.array_join(F.collect_set(column), " "), " ")))


def _as_skills(words, skill_of: dict[str, str]):
    """Words as the skills they stand for, sorted; every word has a skill of its own."""
    if not skill_of:
        return words
    return F.sort_array(F.transform(words, lambda w: F.coalesce(lookup(skill_of, w), w)))


def postings(spark: SparkSession, sf_dir: str, skill_of: dict[str, str] = {}) -> DataFrame:
    """One posting per order with lines; its skills are the words of its parts' names."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").select("l_orderkey", "l_partkey")
    named = lines.join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    skills = named.groupBy("l_orderkey").agg(_as_skills(distinct_words("p_name"), skill_of).alias("skills"))
    places = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t("orders").join(places, F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.join(skills, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderpriority").alias("source"),
        F.concat_ws(" ", "o_orderstatus", "c_mktsegment").alias("title"),
        F.col("c_name").alias("company"),
        F.col("n_name").alias("location"),
        F.col("c_mktsegment").alias("role"),
        F.array_join("skills", " ").alias("description"),
        F.col("o_orderkey").cast("string").alias("url"),
        _stamp("o_orderdate").alias("scraped_at"),
        "skills",
    )
    return with_posting_key(rows)


def requests(spark: SparkSession, sf_dir: str, skill_of: dict[str, str] = {}) -> DataFrame:
    """One request per customer, with every kind of filter; the resume lists words of parts the customer returned."""
    t = lambda name: table(spark, sf_dir, name)
    returned = (
        t("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
        .join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("o_custkey").agg(_as_skills(distinct_words("p_name"), skill_of).alias("words"))
    )
    people = (
        t("customer")
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(returned, F.col("c_custkey") == F.col("o_custkey"), "left")
    )
    area = F.col("r_name")
    # Full match, unknown company, unknown region, unknown role, role and region open.
    role = F.when(area == "EUROPE", F.lit("astronaut")).when(area == "MIDDLE EAST", F.lit("")) \
        .when((area == "ASIA") & (F.col("c_acctbal") < 0), F.lit("  ")).otherwise(F.col("c_mktsegment"))
    company = F.when(area == "AMERICA", F.lit("Nobody Inc")).when(area == "MIDDLE EAST", F.lit(None)) \
        .when((area == "EUROPE") & (F.col("c_acctbal") < 0), F.lit("Nobody Inc")).otherwise(F.col("c_name"))
    region = F.when(area == "ASIA", F.lit("atlantis")) \
        .when((area == "MIDDLE EAST") & (F.col("c_acctbal") < 0), F.lit(None)).otherwise(F.col("n_name"))
    words = F.coalesce("words", F.array(F.lit("hot"), F.lit("Welding")))
    return people.select(
        F.col("c_custkey").alias("request_id"),
        # The last word comes again in capitals: one name, two spellings.
        F.concat(words, F.array(F.upper(F.element_at(words, -1)))).alias("resume_skills"),
        role.alias("role"), company.alias("company"), region.alias("region"),
        (F.col("c_nationkey") % 12 + 1).cast("int").alias("top_n"),
        (F.col("c_nationkey") % 5 + 1).cast("int").alias("limit"),
        (F.col("c_nationkey") * 20 + 10).cast("int").alias("max_age_days"),
    )


def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(postings(spark, sf_dir), "job_postings")


def by_month(of_postings: DataFrame) -> DataFrame:
    """Postings as the store lays them out: typed, one folder a month."""
    spark = of_postings.sparkSession
    path = scratch_path(spark, "postings_by_month")
    write_typed(of_postings, path)
    return spark.read.option("basePath", path).parquet(path)


def stored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(requests(spark, sf_dir), "requests")


def segments(of_postings: DataFrame) -> DataFrame:
    return stored(demand_segments(demand_cube(demand_rollup(of_postings))), "demand_segments")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resume per conversation: its turns in order."""
    turns = table(spark, sf_dir, "conversations")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("text"))
