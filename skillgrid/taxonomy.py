"""The skill taxonomy: a bounded list of terms that the caller supplies."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_RUN = re.compile(r"\w+|\W+")


@dataclass(frozen=True)
class Taxonomy:
    listed: tuple[str, ...]

    @classmethod
    def from_terms(cls, terms: Iterable[str]) -> Taxonomy:
        """A list in the program; tables and files of terms are a ``TermIndex``."""
        return cls(tuple(terms))

    @cached_property
    def terms(self) -> tuple[str, ...]:
        """Distinct lower-cased terms in list order."""
        return tuple(dict.fromkeys(t.lower() for t in self.listed if t))

    @cached_property
    def position(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.terms)}

    @staticmethod
    def runs(term: str) -> list[str]:
        return _RUN.findall(term)

    @classmethod
    def repeats_itself(cls, term: str) -> bool:
        """True if two matches of the term can share characters ("la la" in "la la la")."""
        runs = cls.runs(term)
        return any(runs[:n] == runs[-n:] for n in range(1, len(runs)))

    @cached_property
    def by_length(self) -> dict[int, list[str]]:
        """Terms that equal a sequence of runs, grouped by the number of runs."""
        groups: dict[int, list[str]] = {}
        for term in self.terms:
            if not self.repeats_itself(term):
                groups.setdefault(len(self.runs(term)), []).append(term)
        return groups

    @cached_property
    def self_overlapping(self) -> list[str]:
        return [t for t in self.terms if self.repeats_itself(t)]

    def display_list(self, spark: SparkSession) -> DataFrame:
        """Every listed entry in display form, sorted; entries listed twice appear twice."""
        rows = sorted((t.title(),) for t in self.listed)
        return spark.createDataFrame(rows, "skill string")
