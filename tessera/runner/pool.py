"""Workers: one replaceable function per task, run where the task's row is.

A worker takes a prompt (and settings) and returns its final message.  What a language model would
answer is not part of this engine: `stand_in` answers from the prompt alone, for tests.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.sources.state import NEEDED, answered_findings, save_stage, unfinished

Worker = Callable[[str, dict], str]

#: The lenses of deep mode are three narrow ones.
LENSES = ("structure", "duplication", "clarity")
TIERS = ("scout", "architect", "systems", "flow", "editor", "appeal", "chief")


@dataclass(frozen=True)
class Settings:
    parallel: int = 6
    attempts: int = 3
    model: str = ""
    effort: str = "medium"
    timeout: int = 600


def shaped(message: str, tier: str = "scout") -> bool:
    """Does the message hold a JSON object with what the tier's contract needs?"""
    start, end = message.find("{"), message.rfind("}")
    try:
        found = json.loads(message[start : end + 1]) if 0 <= start < end else None
    except ValueError:
        return False
    return isinstance(found, dict) and all(isinstance(found.get(n), str if n == "summary" else list) for n in NEEDED.get(tier, ("findings",)))


def timed(worker: Worker, prompt: str, how: dict) -> str:
    """The worker's message, or TimeoutError after how['timeout'] seconds; a worker that hangs is left behind."""
    out: dict = {}

    def call() -> None:
        try:
            out["message"] = worker(prompt, how)
        except Exception as error:  # noqa: BLE001  raised again by whoever waits
            out["error"] = error

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    thread.join(how["timeout"] or None)
    if "error" in out:
        raise out["error"]
    if "message" not in out:
        raise TimeoutError(f"no answer within {how['timeout']} s")
    return out["message"]


def attempt(prompt: str, worker: Worker, settings: Settings, tier: str = "scout") -> tuple[str, str, int, int]:
    """(status, message, attempts, repairs): up to `attempts` tries, each with one repair call if the structure is wrong."""
    message, repairs = "", 0
    how = asdict(settings)
    for n in range(1, settings.attempts + 1):
        try:
            message = timed(worker, prompt, how)
            if not shaped(message, tier):
                repairs += 1
                message = timed(worker, f"{prompt}\n\nYour answer was not of the agreed structure. Give it again as one JSON object:\n{message}", how)
            if shaped(message, tier):
                return "done", message, n, repairs
        except Exception as error:  # noqa: BLE001  a worker may fail in any way; the gap is reported
            message = f"{type(error).__name__}: {error}"
    return "skipped", message, settings.attempts, repairs


def run_tier(tasks: DataFrame, worker: Worker, settings: Settings = Settings()) -> DataFrame:
    """(tier, task_id, attempt, status, repairs, message, tokens) of tasks (tier, task_id, prompt).

    `parallel` partitions are as many workers at a time, given as many slots.  A task that fails
    every time has status skipped.  Spark may run a task again when an executor is lost, so a worker
    has to be safe to call twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                status, message, attempts, repairs = attempt(row["prompt"] or "", worker, settings, row["tier"])
                rows.append({"tier": row["tier"], "task_id": row["task_id"], "attempt": attempts, "status": status, "repairs": repairs, "message": message, "tokens": len((row["prompt"] or "").split()) + len(message.split())})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    shape = pa.schema([("tier", pa.string()), ("task_id", pa.string()), ("attempt", pa.int32()), ("status", pa.string()), ("repairs", pa.int32()), ("message", pa.string()), ("tokens", pa.int64())])
    dealt = tasks.select("tier", "task_id", "prompt").repartition(settings.parallel, "task_id")
    return dealt.mapInArrow(run, "tier string, task_id string, attempt int, status string, repairs int, message string, tokens long")


def results_of(spark, workdir: str, tier: str) -> list[DataFrame]:
    """What each earlier run of a tier left, with `run`, counted from 0."""
    parts: list[DataFrame] = []
    while True:
        try:
            part = spark.read.parquet(f"{workdir}/tier-{tier}-{len(parts)}")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return parts
        parts.append(part.withColumn("run", F.lit(len(parts))))


def resume_tier(tasks: DataFrame, worker: Worker, workdir: str, tier: str, settings: Settings = Settings()) -> DataFrame:
    """All results of a tier: those of earlier runs, and of tasks that had none, added as another part."""
    done = None
    parts = results_of(tasks.sparkSession, workdir, tier)
    for part in parts:
        done = part if done is None else done.unionByName(part)
    todo = tasks.where(F.col("tier") == tier)
    todo = todo if done is None else unfinished(todo, done)
    fresh = save_stage(run_tier(todo, worker, settings), workdir, f"tier-{tier}-{len(parts)}").withColumn("run", F.lit(len(parts)))
    return fresh if done is None else done.where("status = 'done'").unionByName(fresh)


def deep(tasks: DataFrame, lenses: tuple[str, ...] = LENSES) -> DataFrame:
    """Three tasks, each with one narrow lens, in place of one."""
    each = F.explode(F.lit(list(lenses)))
    rows = tasks.select(*(F.col(c) for c in tasks.columns if c not in ("task_id", "prompt")), "task_id", "prompt", each.alias("_lens"))
    return rows.withColumn("task_id", F.concat_ws("/", "task_id", "_lens")).withColumn("prompt", F.concat_ws("\n", F.concat(F.lit("Lens: "), "_lens"), "prompt")).drop("_lens")


def findings_of(results: DataFrame) -> DataFrame:
    """Findings of finished tasks, with their tier and task; malformed items are dropped one by one."""
    return answered_findings(results.where("status = 'done'").select("tier", "task_id", "message")).drop("message")


def stand_in(prompt: str, settings: dict) -> str:
    """A deterministic worker: a finding for each line of the prompt that has TODO.  No model's judgement."""
    found, path = [], ""
    for line in prompt.split("\n"):
        if line.startswith("File: "):
            path = line[6:].strip()
        number, _, code = line.partition("| ")
        if "TODO" in code and number.strip().isdigit():
            n = int(number)
            found.append({"id": f"STAND-{len(found):04d}", "path": path, "line_lo": n, "line_hi": n, "category": "unfinished", "severity": "low", "effort": "small", "cost": "left undone", "text": code.strip()})
    return json.dumps({"findings": found, "decisions": [], "summary": f"{len(found)} findings"})
