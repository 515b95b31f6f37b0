"""Planning: the tasks of each tier, with self-contained prompts.

A prompt is the role, the charter, the answer's contract, and the task: code with line numbers, or
what earlier tiers said, each with the evidence on its subject.  Notes are (subject, notes) of
`tessera.runner.notes`; without them a prompt has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.findings import batches
from tessera.operators.packing import shards

CHARTER = "\n".join((
    "Be pragmatic. Describe the system that runs; where docs and what is launched disagree, that is the finding.",
    "Two generations of one design are one finding of category parallel-implementations, before any refactor inside either.",
    "Keep together what changes for the same reasons. Strongest first: a reason to change, files that change in the same commits, static structure.",
    "Ownership or order that a reader cannot see is a finding even where all of it is one workflow.",
    "Name a concrete maintenance cost, else there is no finding. Size alone is none. Copies need three, unless they must change together.",
    "Scripts and tests have a lower bar. Severity is the pain, effort the fix: a large fix never lowers severity.",
))
_FINDING = '{"path", "line_lo", "line_hi", "category", "severity": "low|medium|high|critical", "effort", "cost", "text"}'
_DECISION = '{"finding_id", "action": "verify|merge|rerate|drop", "new_severity", "merged_into", "reason"}'
CONTRACTS = {
    "scout": f'{{"findings": [{_FINDING}], "cards": [{{"path", "role"}}], "summary": "..."}}',
    "architect": f'{{"findings": [{_FINDING}], "summary": "..."}}',
    "systems": f'{{"findings": [{_FINDING}], "themes": ["..."], "flows": [{{"name", "paths": ["..."]}}], "summary": "..."}}',
    "flow": f'{{"findings": [{_FINDING}], "summary": "..."}}',
    "editor": f'{{"decisions": [{_DECISION}]}}',
    "appeal": f'{{"decisions": [{_DECISION}]}}',
    "chief": '{"summary": "...", "themes": ["..."], "fix_first": ["<finding id>"]}',
}


def prompt(role: str, body: Column) -> Column:
    return F.concat_ws("\n\n", F.lit(f"Role: {role}"), F.lit(CHARTER), F.lit(f"Answer with one JSON object: {CONTRACTS[role]}."), body)


def numbered(path: Column, text: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line, i: F.concat((i + 1).cast("string"), F.lit("| "), line))
    return F.concat(F.lit("File: "), path, F.lit("\n"), F.array_join(lines, "\n"))


def excerpt(path: Column, text: Column, lo: Column, hi: Column, context: int = 20) -> Column:
    """Numbered lines lo to hi and `context` lines around them; all lines if lo is null."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line, i: F.concat((i + 1).cast("string"), F.lit("| "), line))
    first = F.greatest(lo - context, F.lit(1))
    some = F.slice(lines, first, F.greatest(F.coalesce(hi, lo), lo) + context - first + 1)
    return F.concat(F.lit("File: "), path, F.lit("\n"), F.array_join(F.when(lo.isNull(), lines).otherwise(some), "\n"))


def _noted(rows: DataFrame, key: str, notes: DataFrame | None) -> DataFrame:
    """rows with _notes: the notes on the key's value, or null."""
    if notes is None:
        return rows.withColumn("_notes", F.lit(None).cast("string"))
    told = notes.select(F.col("subject").alias("_subject"), F.concat(F.lit("Evidence:\n"), "notes").alias("_notes"))
    return rows.join(told, F.col(key) == F.col("_subject"), "left").drop("_subject")


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *parts)


def scouts(files: DataFrame, size: int = 1200, notes: DataFrame | None = None) -> DataFrame:
    """(tier, task_id, prompt): a task for each shard of a module's files in path order, with numbered code.

    A shard's code is gathered; it is bounded by the shard's size and its last file.
    """
    ranked = files.withColumn("_at", F.conv(F.substring(F.md5("path"), 1, 8), 16, 10).cast("long"))
    packed = shards(ranked, "module", "_at", "loc", size).select("module", "_at", "shard").distinct()
    rows = _noted(ranked.join(packed, ["module", "_at"]), "path", notes)
    shown = _joined(numbered(F.col("path"), F.col("text")), F.col("_notes")).alias("code")
    code = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", shown))), lambda f: f["code"]), "\n\n")
    grouped = rows.groupBy("module", "shard").agg(code.alias("code"))
    return grouped.select(F.lit("scout").alias("tier"), F.concat_ws("/", F.lit("scout"), "module", "shard").alias("task_id"), prompt("scout", F.col("code")).alias("prompt"))


def architects(files: DataFrame, notes: DataFrame | None = None, cards: DataFrame | None = None) -> DataFrame:
    """A task for each module, with its files, their sizes and the role that a scout's card (path, role) gives them."""
    if cards is None:
        rows = files.withColumn("role", F.lit(None).cast("string"))
    else:
        rows = files.join(cards.groupBy("path").agg(F.min("role").alias("role")), "path", "left")
    lines = F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "path", F.col("loc").cast("string"), "role"))), "\n")
    grouped = _noted(rows.groupBy("module").agg(lines.alias("lines")), "module", notes)
    return grouped.select(F.lit("architect").alias("tier"), F.concat_ws("/", F.lit("architect"), "module").alias("task_id"), prompt("architect", _joined(F.col("lines"), F.col("_notes"))).alias("prompt"))


def systems(files: DataFrame, notes: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """One task, with a line for each module and what its architect summed up (module, summary)."""
    sums = files.groupBy("module").agg(F.count("*").alias("n"), F.sum("loc").alias("loc"))
    if summaries is None:
        sums = sums.withColumn("summary", F.lit(None).cast("string"))
    else:
        sums = sums.join(summaries.groupBy("module").agg(F.min("summary").alias("summary")), "module", "left")
    lines = F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "module", F.col("n").cast("string"), F.col("loc").cast("string"), "summary"))), "\n")
    one = _noted(sums.agg(lines.alias("lines")).withColumn("_all", F.lit("all")), "_all", notes)
    return one.select(F.lit("systems").alias("tier"), F.lit("systems").alias("task_id"), prompt("systems", _joined(F.col("lines"), F.col("_notes"))).alias("prompt"))


def flows(steps: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """A task for each flow (flow, seq, path), its steps in order, with the code of the files that there are."""
    rows = steps.withColumn("_code", F.lit(None).cast("string"))
    if files is not None:
        rows = steps.join(files.select("path", numbered(F.col("path"), F.col("text")).alias("_code")), "path", "left")
    ordered = F.sort_array(F.collect_list(F.struct("seq", "path", "_code")))
    grouped = rows.groupBy("flow").agg(ordered.alias("s"))
    body = _joined(F.array_join(F.transform("s", lambda s: s["path"]), " -> "), F.array_join(F.array_distinct(F.filter(F.transform("s", lambda s: s["_code"]), lambda c: c.isNotNull())), "\n\n"))
    return grouped.select(F.lit("flow").alias("tier"), F.concat_ws("/", F.lit("flow"), "flow").alias("task_id"), prompt("flow", body).alias("prompt"))


def reviews(findings: DataFrame, tier: str, size: int = 10, files: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """Tasks of an editor or appeal tier: so many findings each, with their lines of code and the evidence on their file.

    A finding's `reason`, where findings have one, is what an editor said of it.
    """
    rows = _noted(findings.join(batches(findings, "id", size), "id"), "path", notes).withColumn("_code", F.lit(None).cast("string"))
    if files is not None:
        texts = files.select(F.col("path").alias("_path"), F.col("text").alias("_text"))
        rows = rows.drop("_code").join(texts, F.col("path") == F.col("_path"), "left")
        rows = rows.withColumn("_code", F.when(F.col("_path").isNotNull(), excerpt(F.col("path"), F.col("_text"), F.col("line_lo"), F.col("line_hi"))))
    reason = F.concat(F.lit("Editor: "), F.col("reason")) if "reason" in findings.columns else F.lit(None).cast("string")
    shown = _joined(F.concat_ws(" ", "id", "severity", "path", "text"), reason, F.col("_notes"), F.col("_code"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", shown.alias("shown")))), lambda f: f["shown"]), "\n\n")
    grouped = rows.groupBy("batch").agg(body.alias("body"))
    return grouped.select(F.lit(tier).alias("tier"), F.concat_ws("/", F.lit(tier), "batch").alias("task_id"), prompt(tier, F.col("body")).alias("prompt"))


def chief(findings: DataFrame, first: DataFrame | None = None, themes: DataFrame | None = None) -> DataFrame:
    """One task, with a line for each finding, what comes first (id), and the systems pass's themes (theme)."""
    line = F.concat_ws(" ", "id", "severity", "path", "category", "text")
    lines = findings.agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    for name, rows, column in (("First by traffic: ", first, "id"), ("Themes: ", themes, "theme")):
        if rows is not None:
            more = rows.agg(F.concat(F.lit(name), F.array_join(F.collect_list(column), ", ")).alias("more"))
            lines = lines.crossJoin(F.broadcast(more)).select(_joined(F.col("lines"), F.col("more")).alias("lines"))
    return lines.select(F.lit("chief").alias("tier"), F.lit("chief").alias("task_id"), prompt("chief", F.col("lines")).alias("prompt"))
