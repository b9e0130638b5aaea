"""From resume files and requests to skills and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skillgrid.functions.text import clean_text
from skillgrid.operators.demand import attach_demand
from skillgrid.operators.gap import with_gap
from skillgrid.operators.tagging import resume_report
from skillgrid.sources.files import resume_status
from skillgrid.taxonomy import Taxonomy


def read_resumes(files: DataFrame, taxonomy: Taxonomy, extracted: DataFrame | None = None) -> DataFrame:
    """Resume files (path, length, content): one summary row per file that has text; ``resume_status`` lists the others.

    ``extracted`` (path, text) brings the text of formats that are not decoded here.
    """
    texts = resume_status(files, extracted).where("status = 'read'")
    return resume_report(texts.select("path", clean_text(F.col("text")).alias("text")), ["path"], "text", taxonomy)


def analyze_gaps(requests: DataFrame, segments: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Gap analysis of every request that lists at least one skill; 20 skills of demand unless it asks otherwise."""
    asked = requests.where(F.size("resume_skills") > 0)
    return with_gap(attach_demand(asked.withColumn("top_n", F.coalesce("top_n", F.lit(20))), segments, live))
