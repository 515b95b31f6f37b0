"""Markdown and HTML reports, and the finding and usage files.

What is rendered is the result of a scan, findings after merging, not its input.
"""

from __future__ import annotations

import html
import json
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.findings import SEVERITIES
from tessera.sources.state import gaps as gaps_of


def _rows(df: DataFrame, limit: int) -> list[dict]:
    return [r.asDict() for r in df.limit(limit).collect()]


def markdown(grade: dict, findings: list[dict], skipped: list[dict], summary: str = "", first: list[dict] = (), habits: list[dict] = ()) -> str:
    out = [f"# Maintainability: {grade['grade']}", "", f"Set by the {grade['gate']} gate; index {grade['idx']}, copied {100 * grade['copied_share']:.1f} %.", ""]
    if summary:
        out += [summary, ""]
    if first:
        out += ["## Fix first", "", *(f"{n}. **{f['severity']}** `{f['path']}` ({f['id']}; traffic {f['priority']})" for n, f in enumerate(first, 1)), ""]
    if habits:
        out += ["## Habits", "", *(f"- `{h['path']}` {h['cost']}" for h in habits), ""]
    if skipped:
        out += ["## Gaps", "", *(f"- {t['task_id']} was skipped" for t in skipped), ""]
    order = lambda f: (-SEVERITIES.get(f["severity"], 0), f["path"], f["id"])
    out += ["## Findings", ""]
    for f in sorted((f for f in findings if f["status"] == "kept"), key=order):
        out.append(f"- **{f['severity']}** `{f['path']}` {f['text']} ({f['id']}; effort {f['effort']}; cost: {f['cost']})")
    gone = [f for f in findings if f["status"] != "kept"]
    if gone:
        out += ["", "<details><summary>Dismissed</summary>", "", *(f"- {f['id']} `{f['path']}` {f['text']}: {f['status']}, {f['reason'] or 'no reason given'}" for f in sorted(gone, key=order)), "", "</details>"]
    return "\n".join(out) + "\n"


def page(text: str) -> str:
    """The Markdown report as one plain HTML page."""
    lines = []
    for line in text.split("\n"):
        if line.startswith(("<details", "</details")):
            lines.append(line)
        elif line.startswith("#"):
            level = len(line) - len(line.lstrip("#"))
            lines.append(f"<h{level}>{html.escape(line.lstrip('# '))}</h{level}>")
        elif line:
            lines.append(f"<p>{html.escape(line)}</p>")
    return "<!DOCTYPE html>\n<meta charset='utf-8'>\n<title>Report</title>\n" + "\n".join(lines) + "\n"


class _File:
    """A file of the work directory, wherever Hadoop's file systems find that."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        self.out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        self.out.close()

    def write(self, text: str) -> None:
        self.out.write(text.encode("utf-8", "surrogatepass"))


def _write_all(df: DataFrame, folder: str, name: str, at_once: int = 1000) -> None:
    """All rows as one JSON list, a partition at a time on the driver."""
    with _File(df.sparkSession, folder, name) as out:
        held, begun = [], False
        for row in df.toLocalIterator():
            held.append(json.dumps(row.asDict(), default=str, ensure_ascii=False))
            if len(held) == at_once:
                out.write((",\n" if begun else "[\n") + ",\n".join(held))
                held, begun = [], True
        out.write((",\n" if begun and held else "" if begun else "[\n") + ",\n".join(held) + "\n]")


def write(workdir: str, grade: DataFrame, findings: DataFrame, tasks: DataFrame, usage: DataFrame, limit: int = 10_000, summary: str = "", first: DataFrame | None = None, habits: DataFrame | None = None) -> None:
    """report.md, report.html, findings.json and usage.json in the work directory.

    Both JSON files have all rows.  At most `limit` findings and as many gaps are rendered, kept and severe findings
    first; the report says how many it leaves out.  Gaps are tasks that no run finished.
    """
    spark = findings.sparkSession
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITIES.items() for x in kv)), F.col("severity")).cast("double"), F.lit(0.0))
    found = _rows(findings.orderBy(F.when(F.col("status") == "kept", 0).otherwise(1), weight.desc(), "path", "id"), limit)
    gaps = gaps_of(tasks)
    top = _rows(first, limit) if first is not None else []
    flagged = _rows(habits.orderBy("path", "id"), limit) if habits is not None else []
    text = markdown(grade.first().asDict(), found, _rows(gaps.orderBy("task_id"), limit), summary, top, flagged)
    more = [("findings", findings.count() - limit), ("skipped tasks", gaps.count() - limit), ("habits", habits.count() - limit if habits is not None else 0)]
    for name, n in more:
        if n > 0:
            text += f"\n{n} more {name} are not shown here.\n"
    for name, shown in (("report.md", text), ("report.html", page(text))):
        with _File(spark, workdir, name) as out:
            out.write(shown)
    _write_all(findings, workdir, "findings.json")
    _write_all(usage, workdir, "usage.json")
