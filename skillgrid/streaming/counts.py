"""Skill counts per micro-batch of job messages.

Each batch is read once, tagged and counted on the executors. Results are keyed by the stream's id and the batch id, so
a batch that is delivered again after a failure replaces its own rows and counts once, and a stream that starts over
with a new checkpoint does not touch what an earlier one left. The live demand is the list written last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from skillgrid.operators.tagging import with_skill_hits
from skillgrid.operators.unnest import unnest, unnest_structs
from skillgrid.taxonomy import Taxonomy

# The message fields that are read, and the terms of the simple mode.
MESSAGE_FIELDS = ["Job Title", "Job Description", "Key Skills", "Qualifications"]
SIMPLE_TERMS = [
    "python", "sql", "spark", "java", "scala", "aws", "azure", "gcp",
    "machine learning", "deep learning", "tensorflow", "pytorch", "docker",
    "kubernetes", "airflow", "kafka", "hadoop", "hive", "tableau", "power bi",
    "r programming", "pandas", "numpy", "scikit-learn", "git", "linux",
]
_MESSAGE_SCHEMA = "struct<" + ", ".join(f"`{f}`: string" for f in MESSAGE_FIELDS) + ", `_corrupt`: string>"
LIVE_SCHEMA = ("rank int, skill string, postings bigint, demand_count bigint, written_at timestamp, run string, "
               "batch_id bigint")


def kafka_messages(spark: SparkSession, servers: str, topic: str = "job_postings", starting: str = "earliest") -> DataFrame:
    """Message stream of a topic; needs the Kafka connector on the class path."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).option("startingOffsets", starting).load())
    return raw.select(F.col("value").cast("string").alias("value"))


def file_messages(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Message stream of JSON-line files."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder)


def parsed_messages(messages: DataFrame) -> DataFrame:
    """Add ``text`` (the filled fields, lower-cased) and ``rejected`` (not valid JSON)."""
    parsed = messages.withColumn("_job", F.from_json("value", _MESSAGE_SCHEMA,
                                                     {"columnNameOfCorruptRecord": "_corrupt"}))
    fields = [F.nullif(F.col(f"_job.`{f}`"), F.lit("")) for f in MESSAGE_FIELDS]
    rejected = F.col("_job").isNull() | F.col("_job._corrupt").isNotNull()
    return parsed.select("value", F.lower(F.concat_ws(" ", *fields)).alias("text"), rejected.alias("rejected"))


def count_skills(messages: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Per skill: postings that name it and how often it is named."""
    good = parsed_messages(messages).where(~F.col("rejected"))
    hits = unnest_structs(with_skill_hits(good.select("text"), "text", taxonomy), [], "hits")
    return hits.groupBy("skill", "position").agg(
        F.count("*").alias("postings"), F.sum("mentions").alias("mentions"))


def count_terms(messages: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Simple mode: postings whose text contains the term anywhere, also inside words."""
    good = parsed_messages(messages).where(~F.col("rejected"))
    listed = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(t).alias("term"), F.lit(t.title()).alias("skill"))
                       for i, t in enumerate(SIMPLE_TERMS if terms is None else terms)])
    found = F.filter(listed, lambda e: F.contains(F.col("text"), F.lower(e["term"])))
    return unnest_structs(good, [], found).groupBy("skill", "position").agg(
        F.count("*").alias("postings")).withColumn("mentions", F.col("postings"))


def top_of_batch(counts: DataFrame, top_n: int = 10) -> DataFrame:
    """The batch's leading skills by count, taxonomy order among equals."""
    top = counts.orderBy(F.desc("mentions"), "position").limit(top_n)
    ranked = top.agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("mentions")).alias("minus"), "position", "skill", "postings"))).alias("rows"))
    return unnest(ranked, [], "rows").select(
        (F.col("_at") + 1).alias("rank"), "_item.skill", "_item.postings",
        (-F.col("_item.minus")).alias("demand_count"))


class SkillCountSink:
    """Writes a batch's counts, its top list (the live demand) and its rejected messages."""

    def __init__(self, folder: str, taxonomy: Taxonomy, top_n: int = 10, simple: bool = False):
        self.folder, self.taxonomy, self.top_n, self.simple = folder.rstrip("/"), taxonomy, top_n, simple
        self.run = "direct"  # batches that no stream delivers

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or self.run
        batch = batch.persist()  # a source such as a topic is read once
        try:
            if not batch.isEmpty():
                self._write(batch, f"run={self.run}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    def _write(self, batch: DataFrame, part: str) -> None:
        counts = count_terms(batch) if self.simple else count_skills(batch, self.taxonomy)
        place = f"{self.folder}/counts/{part}"
        counts.write.mode("overwrite").parquet(place)
        written = batch.sparkSession.read.schema(counts.schema).parquet(place)
        # A batch without hits leaves the live demand as it is.
        if not written.isEmpty():
            top_of_batch(written, self.top_n).withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode(
                "overwrite").parquet(f"{self.folder}/live/{part}")
        parsed_messages(batch).where("rejected").select("value").write.mode("overwrite").parquet(
            f"{self.folder}/rejected/{part}")

    def attach(self, messages: DataFrame, checkpoint: str) -> DataStreamWriter:
        return (messages.writeStream.foreachBatch(self).outputMode("append")
                .option("checkpointLocation", checkpoint))


def batch_counts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("skill string, position int, postings bigint, mentions bigint, run string, batch_id bigint").parquet(
        f"{folder}/counts")


def live_demand(spark: SparkSession, folder: str) -> DataFrame:
    """Top list of the last batch that had hits."""
    try:
        lists = spark.read.schema(LIVE_SCHEMA).parquet(f"{folder}/live")
    except Exception as missing:  # no batch with hits yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], LIVE_SCHEMA)
    last = lists.agg(F.max("written_at").alias("last")).scalar()
    return lists.where(F.col("written_at") == last)
