"""All queries of the subpackage."""

from cohortlake.llm import (  # noqa: F401
    decontamination,
    exact_dedup,
    hard_negatives,
    jaccard_join,
    line_dedup,
    mixing,
    quality,
    secrets,
    spelling,
    substring_dedup,
    toxicity,
    url_filters,
    warc,
)
from cohortlake.llm.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
