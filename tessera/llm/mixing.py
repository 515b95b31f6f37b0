"""Mixing sources to target weights: repetition rates per source, then copies per document.

One aggregate per source gives its tokens.  The rates are found on that table alone, which has a
row per source, and each document then decides for itself: floor(rate) copies and one more when
a hash of its id and the seed, as a number in [0, 1), is below the fraction.  Nothing depends on
partitions or their order, so reruns and recomputed tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.rows import packed, set_aside, unpacked
from tessera.session import materialize

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; none in null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target) of rows (source, size).

    Sources in code point order, null last, take the weights in turn and share all sizes by them.
    No target is over `most` times its source's size: what is over is shared again by weight.
    The fixed point is min(most * size, level * weight) with the level at which the targets use
    everything up.  With sources ordered by most * size / weight it is where running sums cross,
    so it takes one ordered pass over the sources, not rounds.
    """
    sums = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    first = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = first.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levels = ranked.withColumn("_total", F.sum("source_size").over(everything))
    levels = levels.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    levels = levels.withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = levels.withColumn("_level", F.col("_left") / F.col("_weights"))
    # The first source, in this order, that its cap does not hold back sets the level of all after it.
    free = F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))
    levels = levels.withColumn("_at", F.first(free, ignorenulls=True).over(first.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.least("_cap", F.col("_at") * F.col("weight")), F.col("_cap"))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed only: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, **how) -> DataFrame:
    """docs, all columns, with _size, _source_size, _target and _copies.

    A text without words has size 0; a source whose texts all have none has target 0 and none of
    its documents are taken.  Null is a source of its own.  Rows that repeat an id draw alike.  Input columns of
    these four names are replaced, so the result may go in again.
    The join on source is left to adaptive execution, which broadcasts the table of sources only
    if it has found it small, and otherwise splits hot sources.
    """
    docs, restored = set_aside(docs, ("_source", "_rate"), ("_size", "_source_size", "_target", "_copies"), id_col, text_col, source_col)
    rows = docs.withColumn("_size", word_count(F.col(text_col)))
    sums = materialize(source_targets(rows.select(F.col(source_col).alias("source"), F.col("_size").alias("size")), **how), "targets")
    sums = sums.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    rows = rows.join(sums, F.col(source_col).eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    extra = unit(F.col(id_col), seed) < F.col("_rate") - F.floor("_rate")
    rows = rows.withColumn("_rate", rate)
    return restored(rows.withColumn("_copies", F.floor("_rate") + extra.cast("long")).drop("_rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its columns."""
    rows = mix_counts(packed(docs, id_col, text_col, source_col), id_col, text_col, source_col, **how).where("_copies > 0")
    return unpacked(rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))))
