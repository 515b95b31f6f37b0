"""What a scan missed: findings held against a list of expected problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.text import inside

#: The better of two answers is the one that comes first.
STATUSES = ("kept", "dismissed", "never raised")


def matched(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """Expectations joined to the findings that meet them, or to nulls.

    expected: path (a file or a directory), lines [first, last], category, note, keywords; only path
    is required.  Lines matter if both sides have them, and any keyword has to occur in the text.
    Every directory above a finding's path is a key, so this is an equi-join.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    f = findings.select(F.explode(above).alias("_at"), F.struct("*").alias("finding"))
    e = expected.withColumn("_e", F.rtrim("path", F.lit("/")))
    lo, hi = F.try_element_at("lines", F.lit(1)), F.try_element_at("lines", F.lit(2))
    meets = (F.col("_e") == F.col("_at")) & inside(F.col("finding.path"), F.col("path"))
    meets &= F.col("category").isNull() | (F.col("category") == F.col("finding.category"))
    meets &= lo.isNull() | F.col("finding.line_lo").isNull() | ((F.col("finding.line_lo") <= hi) & (F.col("finding.line_hi") >= lo))
    said = F.exists("keywords", lambda k: F.contains(F.lower("finding.text"), F.lower(k)))
    meets &= F.col("keywords").isNull() | (F.size("keywords") == 0) | said
    return e.join(f, meets, "left").drop("_e", "_at")


def recall(expected: DataFrame, findings: DataFrame, key: str = "note") -> DataFrame:
    """(key, path, answer, reason): whether each expectation was kept, found but dismissed (why), or never raised."""
    status = F.col("finding.status")
    rank = F.when(status == "kept", 0).when(status.isNotNull(), 1).otherwise(2)
    best = matched(expected, findings).groupBy(key, "path").agg(F.min(F.struct(rank.alias("rank"), F.col("finding.reason").alias("reason"))).alias("best"))
    answer = F.element_at(F.lit(list(STATUSES)), F.col("best.rank") + 1)
    return best.select(key, "path", answer.alias("answer"), F.when(F.col("best.rank") == 1, F.col("best.reason")).alias("reason"))
