"""Landed payloads and pages to tagged postings, ready for the store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skillgrid.operators.dedupe import first_postings, union_all, with_posting_key
from skillgrid.operators.tagging import tag_postings
from skillgrid.sources.payloads import allowed_sources
from skillgrid.sources.store import POSTINGS_SCHEMA
from skillgrid.taxonomy import Taxonomy


def ingest_postings(frames: list[DataFrame], taxonomy: Taxonomy, arrival: list[str],
                    allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """All sources' postings, filtered by source, keyed, first copy kept, tagged.

    ``arrival`` names the columns that give the order of arrival (query, source, page, position).
    """
    kept = allowed_sources(union_all(frames), allow, deny)
    return tag_postings(first_postings(with_posting_key(kept), arrival), taxonomy).select(
        *POSTINGS_SCHEMA.fieldNames())
