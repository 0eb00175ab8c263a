"""Resumable incremental ingestion: take only work that is not completed yet, keep the completed keys.

The source system polls in batches and remembers the keys it has finished. Each call handles one batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitlens.operators.joins import skip_completed
from admitlens.operators.keyed import first_wins, null_safe_join


def pending(work: DataFrame, completed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return skip_completed(work, completed.select(*keys).distinct(), keys)


def merged_batch(stored: DataFrame, fetched: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """Stored records and the new ones that are not repeats of each other or of stored ones."""
    fresh = first_wins(null_safe_join(fetched, stored.select(*keys).distinct(), keys, "left_anti"), keys, line)
    return stored.unionByName(fresh)


def completed_keys(completed: DataFrame, handled: DataFrame, keys: Sequence[str], status: str) -> DataFrame:
    """Completed keys after a batch: only successful work counts, failed work is tried again."""
    done = handled.filter(F.col(status) == "success").select(*keys)
    return completed.select(*keys).unionByName(done).distinct()
