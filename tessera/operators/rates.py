"""Habits as rates per module, held against the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.text import matches
from tessera.session import materialize
from tessera.sources import definitions


def counted(files: DataFrame, counters: dict[str, str], text_col: str = "text") -> DataFrame:
    """files with a column for each counter: how often its pattern occurs."""
    return files.select("*", *(matches(F.col(text_col), p).alias(k) for k, p in counters.items()))


def module_rates(files: DataFrame, module_col: str, counters: list[str], size_col: str, per: int = 1000) -> DataFrame:
    """(module_col, size, <counter>_rate...) with counts per `per` units of size; 0 for an empty module."""
    sums = files.groupBy(module_col).agg(F.sum(size_col).alias("size"), *(F.sum(c).alias(c) for c in counters))
    return sums.select(module_col, "size", *(F.round(F.coalesce(F.try_divide(F.col(c) * per, F.col("size")), F.lit(0.0)), 6).alias(f"{c}_rate") for c in counters))


def rate_flags(files: DataFrame, module_col: str, counters: list[str], size_col: str, times: float = 2.0, per: int = 1000) -> DataFrame:
    """(module_col, counter, rate, whole): rates at `times` that of the whole, or more.

    A counter that never occurs flags nothing.  Files are counted once: the whole is the sum of the modules' sums,
    one row, so it may be broadcast.
    """
    sums = materialize(files.groupBy(module_col).agg(F.sum(size_col).alias("size"), *(F.sum(c).alias(c) for c in counters)), "module-sums")
    whole = sums.agg(F.sum("size").alias("all"), *(F.sum(c).alias(f"all_{c}") for c in counters))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).alias("n"), F.col(f"all_{c}").alias("n_all")) for c in counters)))
    rows = sums.crossJoin(F.broadcast(whole)).select(module_col, "size", "all", each.alias("x")).select(module_col, "size", "all", "x.*")
    hit = (F.col("n_all") > 0) & (F.col("size") > 0) & (F.col("n") * F.col("all") >= F.lit(times) * F.col("n_all") * F.col("size"))
    return rows.where(hit).select(module_col, "counter", F.round(F.col("n") * per / F.col("size"), 6).alias("rate"), F.round(F.col("n_all") * per / F.col("all"), 6).alias("whole"))


def restated_comments(files: DataFrame, path_col: str = "path", text_col: str = "text", overlap: float = 0.6) -> DataFrame:
    """(path, line): comments of which at least that share of words is in the next line."""
    lines = files.select(path_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line", "code"))
    following = F.lead("code").over(Window.partitionBy(path_col).orderBy("line"))
    lines = lines.withColumn("next", following).where(F.col("code").rlike(r"^\s*(?:#|//)") & F.col("next").isNotNull())
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{2,}"), F.lit(0)))
    said = words(F.col("code"))
    share = F.try_divide(F.size(F.array_intersect(said, words(F.col("next")))), F.size(said))
    return lines.where(share >= overlap).select(path_col, (F.col("line") + 1).cast("long").alias("line"))


def long_functions(files: DataFrame, path_col: str = "path", text_col: str = "text", limit: int = 100) -> DataFrame:
    """(path, name, lines) of Python functions over the limit, read by indentation, also in files that do not parse."""
    found = definitions.definitions(files.select(F.col(path_col).alias("path"), F.lit("python").alias("lang"), F.col(text_col).alias("text")))
    return definitions.long_functions(found, limit).withColumnRenamed("path", path_col)
