"""Exact deduplication by progressive refinement: length, then a prefix's hash, then the full hash.

Each step reads only what the one before it left.  Lengths are counted over all rows; prefixes are hashed of
rows whose length another row has; whole texts are hashed of rows that share length and prefix with another.
The counts are combined before their shuffle and are over numbers only.  Shared lengths and shared
(length, prefix) keys go to the rows by broadcast while there are at most `max_broadcast_keys` of them (16 bytes
each).  Beyond that rows are hashed in the scan itself, which costs less than moving texts to keys would;
both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.rows import packed, set_aside, unpacked
from tessera.session import broadcast_if, materialize

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null as empty; every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def full_hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _length(text: Column) -> Column:
    return F.octet_length(normalised(text))


def _start(text: Column, prefix: int) -> Column:
    return F.xxhash64(F.substring(normalised(text), 1, prefix))


def shared_lengths(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(n): lengths that two rows or more have."""
    counts = docs.select(_length(F.col(text_col)).alias("n")).groupBy("n").agg(F.count("*").alias("rows"))
    return materialize(counts.where("rows > 1").select("n"), "shared-lengths")


def shared_prefixes(docs: DataFrame, lengths: DataFrame, text_col: str = "text", prefix: int = 256, max_broadcast_keys: int = 1_000_000) -> DataFrame:
    """(_shared): keys of (length, prefix) that two rows or more have, of rows with one of these lengths."""
    held = broadcast_if(lengths, max_broadcast_keys)
    text = F.col(text_col)
    if held is lengths:  # more lengths than that: 16 bytes a row move, no text
        rows = docs.select(_length(text).alias("n"), _start(text, prefix).alias("p")).join(held, "n", "left_semi")
    else:
        rows = docs.select(_length(text).alias("n"), text.alias("x")).join(held, "n", "left_semi").select("n", _start(F.col("x"), prefix).alias("p"))
    counts = rows.groupBy("n", "p").agg(F.count("*").alias("rows")).where("rows > 1")
    return materialize(counts.select(F.xxhash64("n", "p").alias("_shared")).distinct(), "shared-prefixes")


def hashed(docs: DataFrame, text_col: str = "text", prefix: int = 256, max_broadcast_keys: int = 1_000_000) -> DataFrame:
    """docs with `_hash`: the full hash of each text that shares its length and prefix; of others it may be null."""
    shared = shared_prefixes(docs, shared_lengths(docs, text_col), text_col, prefix, max_broadcast_keys)
    held = broadcast_if(shared, max_broadcast_keys)
    text = F.col(text_col)
    if held is shared:
        return docs.withColumn("_hash", full_hash(text))
    marked = docs.withColumn("_row_key", F.xxhash64(_length(text), _start(text, prefix)))
    marked = marked.join(held, F.col("_row_key") == F.col("_shared"), "left")
    return marked.withColumn("_hash", F.when(F.col("_shared").isNotNull(), full_hash(text))).drop("_row_key", "_shared")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_groups: int = 500_000, **how) -> DataFrame:
    """docs, all columns, with _keep_id, _group_size, _kept and _hash.

    Texts are equal when `normalised` makes them identical; null is equal to the empty text.
    _keep_id is the least non-null id of the equal texts (null if none has one), _group_size counts
    rows, and _kept marks the rows with that id: rows that repeat it are one document and stay
    together.  _hash is the full hash of texts that are equal to another row's, else null.  Groups of two rows or more (about 100 bytes each) are joined back to the rows, by
    broadcast up to max_broadcast_groups of them.  Beyond that only rows that have a hash are
    shuffled to them, by the hash, and adaptive execution splits hot groups.  Input columns of
    these four names are replaced; an empty table gives an empty result.
    """
    docs, restored = set_aside(docs, ("_row_key", "_shared", "_of", "_least", "_n"), ("_keep_id", "_group_size", "_kept", "_hash"), id_col, text_col)
    rows = hashed(docs, text_col, **how)
    groups = rows.where("_hash IS NOT NULL").groupBy("_hash").agg(F.min(id_col).alias("_least"), F.count("*").alias("_n")).where("_n > 1")
    groups = materialize(groups.select(F.col("_hash").alias("_of"), "_least", "_n"), "equal-texts")
    held = broadcast_if(groups, max_broadcast_groups)

    def told(some: DataFrame) -> DataFrame:
        joined = some.join(held, F.col("_hash") == F.col("_of"), "left")
        joined = joined.withColumn("_keep_id", F.when(F.col("_of").isNull(), F.col(id_col)).otherwise(F.col("_least")))
        return joined.withColumn("_group_size", F.coalesce("_n", F.lit(1))).drop("_of", "_least", "_n")

    if held is groups:
        alone = rows.where("_hash IS NULL").withColumn("_keep_id", F.col(id_col)).withColumn("_group_size", F.lit(1).cast("long"))
        out = alone.unionByName(told(rows.where("_hash IS NOT NULL")))
    else:
        out = told(rows)
    out = out.withColumn("_hash", F.when(F.col("_group_size") > 1, F.col("_hash")))
    return restored(out.withColumn("_kept", F.col(id_col).eqNullSafe(F.col("_keep_id"))))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, with their columns, that stay."""
    return unpacked(exact_groups(packed(docs, id_col, text_col), id_col, text_col, **how).where("_kept"))
