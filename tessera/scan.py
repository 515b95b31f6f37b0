"""A whole scan in steps, each written to a work directory, so that a scan goes on where it stopped.

    python -m tessera.scan scan <repository> --workdir W [--history LOG] [--worker module:function]
    python -m tessera.scan inventory|plan <tier>|run <tier>|report|status|recall --workdir W ...
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.text import CODE_TOKENS, COUNTERS, code_text
from tessera.operators import clones, findings as P, graph, history, rates
from tessera.operators.recall import recall
from tessera.report import render
from tessera.runner import notes, plan, pool
from tessera.sources import definitions, repository, state

TIERS = ("scout", "architect", "systems", "flow", "editor", "appeal", "chief")


@dataclass(frozen=True)
class Options:
    root: str = ""
    workdir: str = ""
    history_log: str | None = None
    no_tests: bool = False
    exclude: tuple[str, ...] = ()
    shard_loc: int = 1200
    history_days: int = 365
    deep: bool = False
    appeal_batch: int = 10
    settings: pool.Settings = field(default_factory=pool.Settings)


class Scan:
    def __init__(self, spark: SparkSession, options: Options, worker: Callable[[str, dict], str] = pool.stand_in):
        self.spark, self.options, self.worker = spark, options, worker

    def _has(self, stage: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.options.workdir}/{stage}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A stage as an earlier run left it, or made now."""
        if self._has(name):
            return self.spark.read.parquet(f"{self.options.workdir}/{name}")
        return state.save_stage(make(), self.options.workdir, name)

    # tier 0

    def files(self) -> DataFrame:
        def make() -> DataFrame:
            found = repository.excluding(repository.scan(self.spark, self.options.root), *self.options.exclude)
            return repository.without_tests(found) if self.options.no_tests else found

        return self.stage("files", make)

    def edges(self) -> DataFrame:
        def make() -> DataFrame:
            files = self.files()
            found = repository.edges(repository.imports(files), files, repository.aliases_of(files))
            more = repository.string_loads(files, files).withColumn("kind", F.lit("string")).unionByName(repository.package_edges(files).withColumn("kind", F.lit("package")))
            return found.unionByName(more).distinct()

        return self.stage("edges", make)

    def commits(self) -> DataFrame:
        if not self.options.history_log:
            return self.spark.createDataFrame([], "commit_id string, ts timestamp, path string")
        return self.stage("commits", lambda: repository.history(self.spark, self.options.history_log))

    def fingerprints(self) -> DataFrame:
        code = lambda: self.files().where(F.col("lang").isNotNull() & (F.col("lang") != "docs"))
        return self.stage("fingerprints", lambda: clones.fingerprint_rows(code(), "path", code_text(F.col("text"), F.col("lang")), CODE_TOKENS, wide=False))

    def co_change(self) -> DataFrame:
        return self.stage("co_change", lambda: history.co_change(self.commits()))

    def definitions(self) -> DataFrame:
        return self.stage("definitions", lambda: definitions.definitions(self.files()))

    def counts(self) -> DataFrame:
        """Files with the six counters of habits."""

        def make() -> DataFrame:
            files = self.files()
            each = lambda rows, name: rows.groupBy("path").agg(F.count("*").alias(name))
            restated = each(rates.restated_comments(files.where("lang IS NOT NULL AND lang <> 'docs'")), "restated_comments")
            long = each(self.stage("long_functions", lambda: definitions.long_functions(self.definitions())), "long_functions")
            counted = rates.counted(files, COUNTERS).drop("text").join(restated, "path", "left").join(long, "path", "left")
            return counted.fillna(0, ["restated_comments", "long_functions"])

        return self.stage("counts", make)

    def inventory(self) -> dict[str, DataFrame]:
        """All evidence that needs no judgement."""
        files, edges, commits, counted = self.files(), self.edges(), self.commits(), self.counts()
        habits = [*COUNTERS, "restated_comments", "long_functions"]
        copied = self.stage("copied", lambda: clones.copied_tokens(self.fingerprints(), "path"))
        linked = lambda: graph.with_header_importers(edges.where(F.col("kind") != "string"), files)
        routed = lambda: clones.routed(copied, files, "path", "module")
        roots = self.stage("entry_points", lambda: repository.entry_points(files))

        def seams() -> DataFrame:
            found = self.definitions()
            named = found.select(F.col("path").alias("file"), definitions.full_name().alias("name")).distinct()
            return graph.seams(graph.clusters(named, definitions.links(found)), definitions.calls(found, edges))

        return {
            "rates": self.stage("rates", lambda: rates.module_rates(counted, "module", habits, "loc")),
            "flags": self.stage("flags", lambda: rates.rate_flags(counted, "module", habits, "loc")),
            "restated": counted.where("restated_comments > 0").select("path", F.col("restated_comments").alias("n")),
            "long_functions": self.stage("long_functions", lambda: definitions.long_functions(self.definitions())),
            "copied": copied,
            "module_copies": self.stage("module_copies", lambda: routed()[0]),
            "largest_copies": self.stage("largest_copies", lambda: routed()[1]),
            "trees": self.stage("trees", lambda: clones.all_trees(files, commits, self.fingerprints())),
            "fan_in": self.stage("fan_in", lambda: graph.fan_in(linked())),
            "cycles": self.stage("cycles", lambda: graph.cycles(edges)),
            "seams": self.stage("seams", seams),
            "reach": self.stage("reach", lambda: graph.reach_labels(files, edges, roots)),
            "disagreements": self.stage("disagreements", lambda: P.documented_and_launched(roots.where("kind = 'docs'"), roots.where("kind = 'launched'"))),
            "churn": self.stage("churn", lambda: history.churn(commits, self.options.history_days)),
            "age": self.stage("age", lambda: history.file_age(commits, self.options.history_days)),
            "co_change": self.co_change(),
            "habits": self.stage("habits", lambda: P.habit_findings(rates.rate_flags(counted, "module", habits, "loc"), "module")),
        }

    def evidence_for(self, tier: str) -> DataFrame:
        """(subject, notes) for the prompts of a tier."""
        make = {"architect": notes.by_module, "systems": notes.of_all}.get(tier, notes.by_file)
        return self.stage({"architect": "notes-module", "systems": "notes-all"}.get(tier, "notes-file"), lambda: make(self.inventory()))

    def traffic(self) -> DataFrame:
        """(path, commits, fan_in, age_days) of all files that have any of them."""
        found = self.inventory()
        rows = found["churn"].join(found["fan_in"].withColumnRenamed("dst", "path"), "path", "full_outer")
        return rows.join(found["age"], "path", "full_outer")

    def first(self) -> DataFrame:
        """The kept findings to fix first."""
        return P.fix_first(self.decided().where("status = 'kept'").drop("merged"), self.traffic())

    # tiers of workers

    def plan(self, tier: str) -> DataFrame:
        """The tasks of a tier; later tiers need what earlier ones found."""
        files = self.files().where(F.col("lang").isNotNull() & (F.col("lang") != "docs"))

        def make() -> DataFrame:
            if tier == "scout":
                tasks = plan.scouts(files, self.options.shard_loc, self.evidence_for(tier))
            elif tier == "architect":
                tasks = plan.architects(files, self.evidence_for(tier), state.answered_cards(self.finished("scout")))
            elif tier == "systems":
                by = F.regexp_replace("task_id", "^architect/|/(?:" + "|".join(pool.LENSES) + ")$", "")
                told = self.finished("architect").select(by.alias("module"), state.answer(F.col("message"))["summary"].alias("summary"))
                tasks = plan.systems(files, self.evidence_for(tier), told)
            elif tier == "flow":
                steps = state.answered_flows(self.finished("systems")).select("flow", "seq", "path").distinct()
                tasks = plan.flows(steps, files)
            elif tier == "editor":
                tasks = plan.reviews(self.raised(), "editor", files=files, notes=self.evidence_for(tier))
            elif tier == "appeal":
                doubtful = P.to_appeal(self.raised(), self.decisions(("editor",))).select("id", "reason")
                tasks = plan.reviews(self.raised().join(doubtful, "id"), "appeal", self.options.appeal_batch, files, self.evidence_for(tier))
            else:
                themes = self.finished("systems").select(F.explode(state.answer(F.col("message"))["themes"]).alias("theme"))
                tasks = plan.chief(self.decided().where("status = 'kept'"), self.first(), themes)
            return pool.deep(tasks) if self.options.deep and tier in ("scout", "architect", "systems", "flow") else tasks

        return self.stage(f"plan-{tier}", make)

    def run(self, tier: str) -> DataFrame:
        return pool.resume_tier(self.plan(tier), self.worker, self.options.workdir, tier, self.options.settings)

    def results(self, tiers: tuple[str, ...]) -> DataFrame | None:
        out = None
        for tier in tiers:
            for part in pool.results_of(self.spark, self.options.workdir, tier):
                out = part if out is None else out.unionByName(part)
        return out

    def finished(self, *tiers: str) -> DataFrame:
        """(tier, task_id, message) of a tier's tasks that some run finished."""
        found = self.results(tiers)
        if found is None:
            return self.spark.createDataFrame([], "tier string, task_id string, message string")
        return found.where("status = 'done'").select("tier", "task_id", "message")

    def raised(self) -> DataFrame:
        """Valid findings of the first four tiers, duplicates merged, each with an id of its own."""
        found = state.answered_findings(self.finished(*TIERS[:4])).drop("tier", "task_id", "message", "id")
        found = found.withColumn("id", P.finding_id("FINDING", "path", "category", "line_lo", "text"))
        return P.lower_bar(P.merge(P.valid(found)), self.files().select("path", "is_test", (F.col("lang") == "shell").alias("is_script")))

    def decisions(self, tiers: tuple[str, ...] = ("editor", "appeal")) -> DataFrame:
        """What editors and appeals decided, from the `decisions` of their answers."""
        return state.answered_decisions(self.finished(*tiers)).select("tier", *state.DECISION.names)

    def decided(self) -> DataFrame:
        return P.apply_decisions(self.raised(), self.decisions())

    # report

    def grade(self) -> DataFrame:
        """One row; copied code counts in non-test files only."""
        code = self.files().where("NOT is_test AND lang IS NOT NULL AND lang <> 'docs'")
        tokens = self.fingerprints().groupBy("path").agg(F.max("n_tokens").alias("n"))
        copied = code.join(tokens, "path").join(self.inventory()["copied"], "path", "left").agg(F.sum("copied").alias("c"), F.sum("n").alias("n"))
        weights = P.weighed(self.decided().withColumn("_all", F.lit(1)), ["_all"]).drop("_all")
        weights = weights.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("weighted", "critical", "high")))
        loc = self.files().where("lang IS NOT NULL AND lang <> 'docs'").agg(F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"))
        share = F.coalesce(F.try_divide("c", "n"), F.lit(0.0)).alias("copied_share")
        return P.graded(weights.crossJoin(loc).crossJoin(copied.select(share)))

    def status(self) -> DataFrame:
        done = self.results(TIERS)
        return state.task_status(done) if done is not None else self.spark.createDataFrame([], "tier string, status string, tasks long")

    def report(self) -> None:
        tasks = self.results(TIERS)
        said = self.finished("chief").select(state.answer(F.col("message"))["summary"].alias("s")).where("s IS NOT NULL").agg(F.min("s").alias("s")).first()["s"]
        render.write(self.options.workdir, self.grade(), self.decided(), tasks, state.usage(tasks), summary=said or "", first=self.first(), habits=self.inventory()["habits"])

    def recall(self, expected: str) -> DataFrame:
        return recall(state.expectations(self.spark, expected), self.decided())

    def scan(self) -> None:
        self.inventory()
        for tier in TIERS:
            self.run(tier)
        self.report()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera.scan")
    parser.add_argument("step", choices=("scan", "inventory", "plan", "run", "report", "status", "recall"))
    parser.add_argument("target", nargs="?", default="", help="the repository, or the tier of plan and run")
    parser.add_argument("--workdir", required=True)
    parser.add_argument("--root", default="")
    parser.add_argument("--history", help="the output of git log --name-only --format=%%x01%%H%%x02%%cI")
    parser.add_argument("--expect")
    parser.add_argument("--worker", default="tessera.runner.pool:stand_in", help="module:function(prompt, settings) -> message")
    parser.add_argument("--no-tests", action="store_true")
    parser.add_argument("--exclude", action="append", default=[])
    parser.add_argument("--shard-loc", type=int, default=1200)
    parser.add_argument("--history-days", type=int, default=365)
    parser.add_argument("--deep", action="store_true")
    parser.add_argument("--appeal-batch", type=int, default=10)
    parser.add_argument("--parallel", type=int, default=6)
    parser.add_argument("--model", default="")
    parser.add_argument("--effort", default="medium")
    parser.add_argument("--timeout", type=int, default=600)
    a = parser.parse_args(argv)
    module, _, name = a.worker.partition(":")
    settings = pool.Settings(parallel=a.parallel, model=a.model, effort=a.effort, timeout=a.timeout)
    root = a.root or (a.target if a.step in ("scan", "inventory") else "")
    options = Options(root, a.workdir, a.history, a.no_tests, tuple(a.exclude), a.shard_loc, a.history_days, a.deep, a.appeal_batch, settings)
    scan = Scan(SparkSession.builder.getOrCreate(), options, getattr(importlib.import_module(module), name))
    if a.step == "recall":
        for r in scan.recall(a.expect).orderBy("path", "note").collect():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    elif a.step == "status":
        for r in scan.status().orderBy("tier", "status").collect():
            print(r.tier, r.status, r.tasks)
    elif a.step in ("plan", "run"):
        print(getattr(scan, a.step)(a.target).count(), "tasks")
    else:
        getattr(scan, a.step)()


if __name__ == "__main__":
    main()
