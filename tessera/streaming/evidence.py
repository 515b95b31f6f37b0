"""Per-file evidence over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.text import COUNTERS, line_count, matches
from tessera.operators.clones import winnow


def fingerprints(files: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Winnowed fingerprints; without state, so batch and stream give the same rows."""
    return winnow(files, id_col, text_col)


def hourly_habits(files: DataFrame, ts_col: str, text_col: str = "text", late: str = "1 hour") -> DataFrame:
    """(window, loc, <counter>...) per hour of arrival; rows later than `late` are left out."""
    rows = files.withWatermark(ts_col, late).select(ts_col, line_count(F.col(text_col)).alias("loc"), *(matches(F.col(text_col), p).alias(k) for k, p in COUNTERS.items()))
    return rows.groupBy(F.window(ts_col, "1 hour")).agg(F.sum("loc").alias("loc"), *(F.sum(k).alias(k) for k in COUNTERS))
