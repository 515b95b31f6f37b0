"""Evidence as lines of text, for the prompts of the tiers that it concerns.

A note is a line about a file, a module or the whole.  Notes of one subject are put together in the
order of their text; a subject's notes are bounded by the number of evidence tables, or by the
subject's own lists (a module's routed copies, its flags).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import parent


def said(rows: DataFrame, subject: str, *parts: str | Column) -> DataFrame:
    """(subject, note): the parts, strings as they are and columns as text, with spaces between."""
    words = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return rows.select(F.col(subject).alias("subject"), F.concat_ws(" ", *words).alias("note"))


def gathered(notes: list[DataFrame]) -> DataFrame:
    """(subject, notes): all notes of a subject, a line each, equal ones once."""
    rows = reduce(DataFrame.unionByName, notes).where("subject IS NOT NULL").distinct()
    return rows.groupBy("subject").agg(F.array_join(F.sort_array(F.collect_list("note")), "\n").alias("notes"))


def partners(co_change: DataFrame, most: int = 5) -> DataFrame:
    """(path, other, together): of the files that change with each file the `most` that do so most often; equals by name."""
    both = co_change.select(F.col("a").alias("path"), F.col("b").alias("other"), "together")
    both = both.unionByName(co_change.select(F.col("b").alias("path"), F.col("a").alias("other"), "together"))
    first = Window.partitionBy("path").orderBy(F.col("together").desc(), "other")
    return both.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n")


def by_file(evidence: dict[str, DataFrame]) -> DataFrame:
    """(subject, notes) for each path: reach, importers, commits, age, what changes with it, copies, restated comments, long functions, seams."""
    made = []
    if "reach" in evidence:
        made.append(said(evidence["reach"].where("reach IS NOT NULL"), "path", "reach:", F.col("reach")))
    if "fan_in" in evidence:
        made.append(said(evidence["fan_in"], "dst", "imported by", F.col("fan_in"), "files"))
    if "churn" in evidence:
        made.append(said(evidence["churn"], "path", "commits in the window:", F.col("commits")))
    if "age" in evidence:
        made.append(said(evidence["age"].where("age_days IS NOT NULL"), "path", "created", F.col("age_days"), "days before the last commit"))
    if "co_change" in evidence:
        made.append(said(partners(evidence["co_change"]), "path", "changes with", F.col("other"), "in", F.col("together"), "commits"))
    if "copied" in evidence:
        made.append(said(evidence["copied"], "path", "copied tokens:", F.col("copied")))
    if "restated" in evidence:
        made.append(said(evidence["restated"], "path", "comments that restate the next line:", F.col("n")))
    if "long_functions" in evidence:
        made.append(said(evidence["long_functions"], "path", "long function", F.col("name"), "of", F.col("lines"), "lines"))
    if "seams" in evidence:
        made.append(said(evidence["seams"].where("seam"), "file", "separate callers:", F.col("a"), "and", F.col("b")))
        made.append(said(evidence["seams"].where("NOT seam"), "file", "used together:", F.col("a"), "and", F.col("b")))
    return gathered(made)


def by_module(evidence: dict[str, DataFrame]) -> DataFrame:
    """(subject, notes) for each module: flagged rates, its largest copies, parallel trees above its directories."""
    made = []
    if "flags" in evidence:
        made.append(said(evidence["flags"], "module", F.col("counter"), "at", F.col("rate"), "against", F.col("whole"), "in the whole"))
    if "module_copies" in evidence:
        made.append(said(evidence["module_copies"], "module", "copied tokens:", F.col("copied"), "in", F.col("path")))
    if "trees" in evidence:
        trees = evidence["trees"].withColumn("module", F.when(parent(F.col("dir_a")) == "", F.col("dir_a")).otherwise(F.substring_index("dir_a", "/", 1)))
        made.append(said(trees, "module", "parallel trees:", F.col("dir_a"), "and", F.col("dir_b"), "changed together in", F.col("together"), "commits"))
    return gathered(made)


def of_all(evidence: dict[str, DataFrame]) -> DataFrame:
    """(subject, notes) of one row: largest copies, parallel trees, cycles, what docs and configuration disagree on."""
    made = []
    if "largest_copies" in evidence:
        made.append(said(evidence["largest_copies"].withColumn("_all", F.lit("all")), "_all", "copied tokens:", F.col("copied"), "in", F.col("path")))
    if "trees" in evidence:
        made.append(said(evidence["trees"].withColumn("_all", F.lit("all")), "_all", "parallel trees:", F.col("dir_a"), "and", F.col("dir_b"), "changed together in", F.col("together"), "commits"))
    if "cycles" in evidence:
        sizes = evidence["cycles"].groupBy("cycle").agg(F.count("*").alias("n"))
        made.append(said(sizes.withColumn("_all", F.lit("all")), "_all", "import cycle of", F.col("n"), "files with", F.col("cycle")))
    if "disagreements" in evidence:
        made.append(said(evidence["disagreements"].withColumn("_all", F.lit("all")), "_all", F.col("side"), F.lit(":"), F.col("path")))
    return gathered(made)
