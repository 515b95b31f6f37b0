"""Change history: churn, ages, co-change, and the gate for young repositories.

commits has a row for each changed path: commit_id, ts, path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def repo_age(commits: DataFrame) -> DataFrame:
    """One row: commits, first, last, days; of the whole history, not a window."""
    out = commits.agg(F.count_distinct("commit_id").alias("commits"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.withColumn("days", F.datediff("last", "first").cast("long"))


def in_window(commits: DataFrame, days: int = 365) -> DataFrame:
    """Rows of the last `days` days before the last commit."""
    last = commits.agg(F.max("ts").alias("_last"))
    return commits.join(F.broadcast(last), F.col("ts") >= F.col("_last") - F.make_interval(days=F.lit(days))).drop("_last")


def churn(commits: DataFrame, days: int = 365) -> DataFrame:
    """(path, commits) in the window."""
    return in_window(commits, days).groupBy("path").agg(F.count_distinct("commit_id").alias("commits"))


def file_age(commits: DataFrame, days: int = 365) -> DataFrame:
    """(path, age_days): days from a path's first commit to the last of all; null if it is older than the window."""
    last = commits.agg(F.max("ts").alias("_last"))
    first = commits.groupBy("path").agg(F.min("ts").alias("_first")).crossJoin(F.broadcast(last))
    fresh = F.col("_first") >= F.col("_last") - F.make_interval(days=F.lit(days))
    return first.select("path", F.when(fresh, F.datediff("_last", "_first")).cast("long").alias("age_days"))


def is_young(commits: DataFrame, least_commits: int = 50, least_days: int = 30) -> DataFrame:
    """One row, young: under so many commits or days, as a whole."""
    return repo_age(commits).select(((F.col("commits") < least_commits) | (F.col("days") < least_days)).alias("young"))


def co_change(commits: DataFrame, least: int = 2, gate: bool = True) -> DataFrame:
    """(a, b, together): paths changed in the same commits at least that often; nothing for a young repository.

    Paths with fewer commits of their own can be in no such pair and go first, so a commit that adds or renames
    many files costs pairs only for those that changed again.  Commits of any width count.
    """
    changed = commits.select("commit_id", "path").distinct()
    often = changed.groupBy("path").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("path")
    changed = changed.join(often, "path", "left_semi")
    left, right = changed.withColumnRenamed("path", "a"), changed.withColumnRenamed("path", "b")
    pairs = left.join(right, "commit_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    if gate:
        pairs = pairs.join(F.broadcast(is_young(commits).where("NOT young")), how="cross").drop("young")
    return pairs
