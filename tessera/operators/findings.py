"""Findings: validity, merging, decisions, priorities, grade.

findings: id, path, line_lo, line_hi, category, severity, effort, cost, text.
decisions: finding_id, tier, action, new_severity, merged_into, reason.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Own choices: order and weight of severities, order of tiers, letters of grades.
SEVERITIES = {"low": 1, "medium": 2, "high": 3, "critical": 4}
WEIGHTS = {"low": 0.25, "medium": 1.0, "high": 3.0, "critical": 10.0}
TIERS = ("editor", "appeal", "chief")
GRADES = ("A", "B", "C", "D", "F")
#: Index below which a grade holds, (severity, count, cap), copied share and cap.
BANDS = ((1.0, "A"), (2.0, "B"), (4.0, "C"), (8.0, "D"))
SERIOUS = (("critical", 1, "C"), ("high", 5, "B"), ("high", 10, "C"))
COPIED = ((0.05, "B"), (0.10, "C"), (0.20, "D"))
#: Evidence for keeping things together or apart, strongest first.
EVIDENCE = ("reason_to_change", "co_change", "static_structure")


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(values.items()))), key)


def severity_rank(severity: Column) -> Column:
    return _lookup(SEVERITIES, severity)


def _rank(grade: str) -> int:
    return GRADES.index(grade)


def finding_id(prefix: str, *parts: str) -> Column:
    """A stable id: prefix and eight hexadecimal digits of what identifies the finding."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.md5(F.concat_ws("\u0001", *parts)), 1, 8))


def valid(findings: DataFrame) -> DataFrame:
    """Findings with a known severity, a path, and a named maintenance cost; not from size alone."""
    named = F.trim(F.coalesce("cost", F.lit(""))) != ""
    return findings.where(F.col("path").isNotNull() & severity_rank(F.col("severity")).isNotNull() & named & (F.col("category") != "size"))


def merge(findings: DataFrame) -> DataFrame:
    """One finding of each (path, category, line_lo, line_hi): the most severe, then the least id; with merged, how many there were."""
    key = Window.partitionBy("path", "category", "line_lo", "line_hi")
    first = key.orderBy(severity_rank(F.col("severity")).desc(), "id")
    rows = findings.withColumn("merged", F.count("*").over(key)).withColumn("_n", F.row_number().over(first))
    return rows.where("_n = 1").drop("_n")


def lower_bar(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings in scripts and tests go one severity down, and leave below low."""
    soft = files.where("is_test OR is_script").select("path").distinct().withColumn("_soft", F.lit(True))
    rank = severity_rank(F.col("severity"))
    softer = F.get(F.lit(list(SEVERITIES)), F.greatest(rank - 2, F.lit(0)))
    rows = findings.join(soft, "path", "left").where(F.col("_soft").isNull() | (rank > 1))
    return rows.withColumn("severity", F.when(F.col("_soft"), softer).otherwise(F.col("severity"))).drop("_soft")


def rule_of_three(copies: DataFrame, lockstep: DataFrame, least: int = 3) -> DataFrame:
    """Copied blocks (fp, copies) with at least three copies, or whose copies change together (fp in lockstep)."""
    same = lockstep.select("fp").distinct().withColumn("_same", F.lit(True))
    return copies.join(same, "fp", "left").where((F.col("copies") >= least) | F.col("_same")).drop("_same")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The decision of the last tier that spoke on each finding; equal tiers by action, then reason."""
    rank = F.array_position(F.lit(list(TIERS)), F.col("tier"))
    order = Window.partitionBy("finding_id").orderBy(rank.desc(), "action", "reason", "new_severity", "merged_into")
    return decisions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def apply_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """findings with status (kept, dropped, merged), reason, and severity as decided.  Nothing is deleted, and effort has no say."""
    last = latest_decisions(decisions).select("finding_id", "action", "new_severity", "merged_into", "reason")
    rows = findings.join(last, findings["id"] == last["finding_id"], "left")
    status = F.when(F.col("action") == "drop", "dropped").when(F.col("action") == "merge", "merged").otherwise("kept")
    return rows.withColumn("status", status).withColumn("severity", F.coalesce(F.when(F.col("action") == "rerate", F.col("new_severity")), "severity")).drop("finding_id", "action", "new_severity")


def to_appeal(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, severity, action, reason) of findings of medium severity or more that an editor dropped or rated down."""
    by_editor = latest_decisions(decisions.where("tier = 'editor'"))
    rows = findings.join(by_editor, findings["id"] == by_editor["finding_id"])
    rank, new = severity_rank(F.col("severity")), severity_rank(F.col("new_severity"))
    hit = (F.col("action") == "drop") | ((F.col("action") == "rerate") & (new < rank))
    return rows.where((rank >= SEVERITIES["medium"]) & hit).select("id", "severity", "action", "reason")


def batches(rows: DataFrame, id_col: str, size: int = 10) -> DataFrame:
    """(batch, id_col): ids in order, `size` to a batch, as one worker session gets them."""
    n = F.row_number().over(Window.orderBy(id_col))
    return rows.select(F.floor((n - 1) / size).cast("long").alias("batch"), id_col)


def fix_first(findings: DataFrame, traffic: DataFrame, limit: int = 10) -> DataFrame:
    """The top findings: parallel implementations first, then by commits and fan-in of the file, new files before old, then severity and id.

    traffic: path, commits, fan_in, age_days (null for files older than the window).
    """
    rows = findings.join(traffic, "path", "left")
    priority = F.coalesce("commits", F.lit(0)) + F.coalesce("fan_in", F.lit(0)) + F.when(F.col("age_days").isNotNull(), F.coalesce("fan_in", F.lit(0))).otherwise(0)
    rows = rows.withColumn("first", F.col("category") == "parallel-implementations").withColumn("priority", priority.cast("long"))
    return rows.orderBy(F.col("first").desc(), F.col("priority").desc(), severity_rank(F.col("severity")).desc(), "id").limit(limit).select("id", "path", "severity", "priority")


def serious_grade(critical: Column, high: Column) -> Column:
    """The rank that critical and high findings cap the grade at, whatever the size."""
    out, counts = F.lit(0), {"critical": critical, "high": high}
    for severity, least, cap in SERIOUS:
        out = F.greatest(out, F.when(counts[severity] >= least, _rank(cap)).otherwise(0))
    return out


def index_grade(index: Column) -> Column:
    out = F.lit(_rank("F"))
    for below, grade in reversed(BANDS):
        out = F.when(index < below, _rank(grade)).otherwise(out)
    return out


def copied_grade(share: Column) -> Column:
    out = F.lit(0)
    for least, cap in COPIED:
        out = F.when(share >= least, _rank(cap)).otherwise(out)
    return out


def letter(rank: Column) -> Column:
    return F.element_at(F.lit(list(GRADES)), (rank + 1).cast("int"))


def graded(rows: DataFrame) -> DataFrame:
    """rows (weighted, loc, critical, high, copied_share, ...) with idx, grade and gate: the worst of three gates and which set it.

    Of gates that agree the first of index, serious, copied is named.
    """
    rows = rows.withColumn("idx", F.round(F.coalesce(F.try_divide(F.col("weighted") * 1000, F.col("loc")), F.lit(0.0)), 6))
    gates = {"index": index_grade(F.col("idx")), "serious": serious_grade(F.col("critical"), F.col("high")), "copied": copied_grade(F.col("copied_share"))}
    rows = rows.select("*", *(g.alias(f"_{k}") for k, g in gates.items()))
    worst = F.greatest("_index", "_serious", "_copied")
    gate = F.when(F.col("_index") == worst, "index").when(F.col("_serious") == worst, "serious").otherwise("copied")
    return rows.withColumn("grade", letter(worst)).withColumn("gate", gate).drop("_index", "_serious", "_copied")


def weighed(findings: DataFrame, by: list[str]) -> DataFrame:
    """(by..., weighted, critical, high) of findings that were kept."""
    one = lambda s: F.count_if(F.col("severity") == s)
    weight = F.sum(F.coalesce(_lookup(WEIGHTS, F.col("severity")), F.lit(0.0)))
    return findings.where("status = 'kept'").groupBy(*by).agg(weight.alias("weighted"), one("critical").alias("critical"), one("high").alias("high"))


def strongest_evidence(evidence: DataFrame) -> DataFrame:
    """(a, b, kind, together): of all evidence on a pair the strongest kind; equal kinds agree only if all do."""
    rank = F.array_position(F.lit(list(EVIDENCE)), F.col("kind"))
    rows = evidence.withColumn("_r", rank)
    best = rows.groupBy("a", "b").agg(F.min("_r").alias("_r"))
    return rows.join(best, ["a", "b", "_r"]).groupBy("a", "b", "kind").agg(F.bool_and("together").alias("together"))


def documented_and_launched(documented: DataFrame, launched: DataFrame) -> DataFrame:
    """(path, side): what only docs or only launch configuration names; the disagreement is the finding."""
    d, r = documented.select("path").distinct().withColumn("d", F.lit(True)), launched.select("path").distinct().withColumn("r", F.lit(True))
    both = d.join(r, "path", "full_outer")
    return both.where("d IS NULL OR r IS NULL").select("path", F.when(F.col("d"), "documented only").otherwise("launched only").alias("side"))


def habit_findings(flags: DataFrame, module_col: str) -> DataFrame:
    """A finding row for each flagged rate."""
    cost = F.concat_ws(" ", "counter", F.lit("at"), F.col("rate").cast("string"), F.lit("against"), F.col("whole").cast("string"))
    return flags.select(finding_id("HABIT", module_col, "counter").alias("id"), F.col(module_col).alias("path"), F.concat(F.lit("habit-"), "counter").alias("category"), F.lit("medium").alias("severity"), cost.alias("cost"))
