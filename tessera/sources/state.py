"""A scan's own state: worker answers, expectations, stages, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


FINDING = T.StructType([T.StructField(n, T.IntegerType() if n.startswith("line_") else T.StringType()) for n in ("id", "path", "line_lo", "line_hi", "category", "severity", "effort", "cost", "text")])
DECISION = T.StructType(_strings("finding_id", "action", "new_severity", "merged_into", "reason"))
CARD = T.StructType(_strings("path", "role"))
FLOW = T.StructType([*_strings("name"), T.StructField("paths", T.ArrayType(T.StringType()))])
#: All that an answer of any tier may hold.
ANSWER = T.StructType([
    T.StructField("findings", T.ArrayType(FINDING)), T.StructField("summary", T.StringType()), T.StructField("decisions", T.ArrayType(DECISION)), T.StructField("cards", T.ArrayType(CARD)),
    T.StructField("flows", T.ArrayType(FLOW)), T.StructField("themes", T.ArrayType(T.StringType())), T.StructField("fix_first", T.ArrayType(T.StringType())),
])
#: What an answer of each tier must hold: lists by name, `summary` as text.
NEEDED = {"scout": ("findings",), "architect": ("findings",), "systems": ("findings",), "flow": ("findings",), "editor": ("decisions",), "appeal": ("decisions",), "chief": ("summary",)}
ACTIONS = ("verify", "merge", "rerate", "drop")
EXPECTED = T.StructType([T.StructField("path", T.StringType()), T.StructField("lines", T.ArrayType(T.IntegerType())), T.StructField("category", T.StringType()), T.StructField("note", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType()))])


def answer(message: Column) -> Column:
    """The JSON object in a worker's final message, parsed; null if there is none or its structure is wrong."""
    return F.from_json(F.regexp_extract(message, r"(?s)(\{.*\})", 1), ANSWER, {"mode": "PERMISSIVE"})


def _items(answers: DataFrame, part: str, shape: T.StructType, message_col: str) -> DataFrame:
    rows = answers.withColumn("_f", F.explode(answer(F.col(message_col))[part]))
    return rows.select(*(f"`{c}`" for c in answers.columns if c not in shape.names), "_f.*")


def answered_findings(answers: DataFrame, message_col: str = "message") -> DataFrame:
    """The columns of answers and a finding for each item that has a path and a known severity; other items are dropped one by one."""
    good = F.col("path").isNotNull() & F.col("severity").isin("low", "medium", "high", "critical")
    return _items(answers, "findings", FINDING, message_col).where(good)


def answered_decisions(answers: DataFrame, message_col: str = "message") -> DataFrame:
    """The columns of answers and a decision for each item that names a finding and a known action; other items are dropped one by one."""
    return _items(answers, "decisions", DECISION, message_col).where(F.col("finding_id").isNotNull() & F.col("action").isin(*ACTIONS))


def answered_cards(answers: DataFrame, message_col: str = "message") -> DataFrame:
    """The columns of answers and (path, role) for each file card with a path."""
    return _items(answers, "cards", CARD, message_col).where("path IS NOT NULL")


def answered_flows(answers: DataFrame, message_col: str = "message") -> DataFrame:
    """The columns of answers and (flow, seq, path) for each step of each flow that has a name."""
    rows = _items(answers, "flows", FLOW, message_col).where("name IS NOT NULL")
    return rows.select("*", F.posexplode("paths").alias("seq", "path")).withColumnRenamed("name", "flow").drop("paths").withColumn("seq", F.col("seq") + 1)


def expectations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPECTED).option("multiLine", True).json(path).where("path IS NOT NULL")


def unfinished(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks that no earlier run finished."""
    return tasks.join(done.where("status = 'done'").select("task_id").distinct(), "task_id", "left_anti")


def save_stage(df: DataFrame, workdir: str, stage: str) -> DataFrame:
    """df written as one stage of the work directory, and read back."""
    df.write.mode("overwrite").parquet(f"{workdir}/{stage}")
    return df.sparkSession.read.parquet(f"{workdir}/{stage}")


def usage(tasks: DataFrame) -> DataFrame:
    """(tier, tasks, tokens), the content of the usage file."""
    return tasks.groupBy("tier").agg(F.count_distinct("task_id").alias("tasks"), F.sum("tokens").alias("tokens"))


def last_status(tasks: DataFrame) -> DataFrame:
    """(tier, task_id, status) of each task's last attempt in its last run; rows without a run are of the first."""
    run = F.col("run") if "run" in tasks.columns else F.lit(0)
    return tasks.groupBy("tier", "task_id").agg(F.max_by("status", F.struct(run.alias("run"), "attempt", "status")).alias("status"))


def task_status(tasks: DataFrame) -> DataFrame:
    """(tier, status, tasks) by each task's last attempt in its last run."""
    return last_status(tasks).groupBy("tier", "status").agg(F.count("*").alias("tasks"))


def gaps(tasks: DataFrame) -> DataFrame:
    """(tier, task_id, status) of tasks that were skipped and that no later run finished."""
    return last_status(tasks).where("status = 'skipped'")
