"""Messages about what runs and what went wrong, through the standard logging under the name of the package."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("folioscope")


def enrichment_summary(records: DataFrame, changes: DataFrame) -> dict[str, int]:
    """Numbers of changed records and of records skipped for want of a DOI, logged and returned."""
    from .operators import enrich

    found = {"changed": enrich.changed_rows(changes).first()[0], "skipped": enrich.skipped_count(records).first()[0]}
    log.info("Total records changed: %(changed)d", found)
    log.info("Total rows with empty DOI: %(skipped)d", found)
    return found


def answer_summary(answers: DataFrame) -> DataFrame:
    """Answers of each provider by status, a failed request being 0; logged and returned (a row for each provider and status)."""
    counts = answers.groupBy("provider", F.col("status").cast("int").alias("status")).agg(F.count("*").alias("answers"))
    for r in counts.orderBy("provider", "status").collect():
        (log.info if r["status"] == 200 else log.warning)("%s: status %d, %d answers", r["provider"], r["status"], r["answers"])
    return counts
