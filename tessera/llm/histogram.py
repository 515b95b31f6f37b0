"""Sharding by histogram sort: exact counts below candidate boundaries, then one exchange.

Rows are ordered by a key of 32 hexadecimal digits: a hash of the text, then a hash of the id.
The first pass counts rows and bytes under each of the 4,096 three-digit prefixes.  A cell that
holds a splitter is probed again by longer prefixes until the splitter's nearest cell edge is
within tolerance of its exact target; so is a cell that is far larger than its fair share, such as
the copies of one text.  Every pass returns a bounded number of counts to the driver (4,096 for
each cell probed, and at most some hundred cells qualify), whatever the number of rows.

Texts that are equal have one hash, so they stay in one shard unless they are more than
`group_tolerance` of a shard; only then does the second half of the key split them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.rows import set_aside
from tessera.session import materialize

#: Digits of the prefixes by pass; 16 digits are the whole text hash.
PROBES = (3, 6, 9, 12, 16, 19, 22, 25, 28, 32)
GROUP = 16


def byte_size(text: Column) -> Column:
    """UTF-8 bytes, none for null, and one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def sort_key(text: Column, doc_id: Column) -> Column:
    digits = [F.lpad(F.hex(F.xxhash64(c)), 16, "0") for c in (F.coalesce(text, F.lit("")), doc_id)]
    return F.concat(*digits)


def _histogram(keyed: DataFrame, digits: int, of: Iterable[str] | None = None) -> list[tuple[str, int, int]]:
    if of is not None:
        some = sorted(of)
        keyed = keyed.where(F.substring("key", 1, len(some[0])).isin(some))
    counts = keyed.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    return [(r["p"], r["b"], r["n"]) for r in counts.collect()]


def splitters(keyed: DataFrame, shards: int, tolerance: float, group_tolerance: float) -> tuple[list[tuple[str, int, int]], list[str]]:
    """Cells (prefix, bytes, rows) in key order, and the first key of each shard but shard 0."""
    cells = sorted(_histogram(keyed, PROBES[0]))
    if not cells:
        return [], []
    total, rows = sum(c[1] for c in cells), sum(c[2] for c in cells)
    large = max(20_000, 8 * rows // 4096)
    for at, digits in enumerate(PROBES):
        bounds, probe, below, edges = {}, set(), 0, []
        for prefix, size, _ in cells:
            edges.append(below)
            below += size
        for i in range(1, shards):
            target = total * i / shards
            k = max(0, bisect_right(edges, target) - 1)
            near, far = target - edges[k], (edges[k + 1] if k + 1 < len(cells) else below) - target
            bounds[i] = k if near <= far else k + 1
            finest = len(cells[k][0])
            most = (group_tolerance if finest >= GROUP else tolerance) * total / shards
            if min(near, far) > most and finest == digits:
                probe.add(cells[k][0])
        probe |= {p for p, _, n in cells if n > large and len(p) == digits}
        if not probe or at + 1 == len(PROBES):
            break
        finer = _histogram(keyed, PROBES[at + 1], probe)
        cells = sorted([c for c in cells if c[0] not in probe] + finer)
    return cells, [cells[k][0] if k < len(cells) else "g" for _, k in sorted(bounds.items())]


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, group_tolerance: float = 0.01) -> DataFrame:
    """docs, all columns, with _size, _shard and _slot.

    Shards hold nearly equal bytes: each splitter is within `tolerance` of a shard's size from its
    exact place, or `group_tolerance` where that keeps equal texts together, unless single rows
    are larger than that.  _slot counts from 0 without gaps inside a shard, in key order.  Rows
    that repeat both id and text cannot be told apart and stay in one shard.  Null texts count as
    empty.  An empty table gives an empty result.  Input columns of the three names are replaced.  The one exchange carries only the columns that
    the caller goes on to use.
    """
    spark = docs.sparkSession
    docs, restored = set_aside(docs, ("_key", "_prefix", "_before", "_inner", "_range", "_offset"), ("_size", "_shard", "_slot"), id_col, text_col)
    rows = docs.withColumn("_size", byte_size(F.col(text_col))).withColumn("_key", sort_key(F.col(text_col), F.col(id_col)))
    keyed = materialize(rows.select(F.col("_key").alias("key"), F.col("_size").alias("size")), "keys")
    cells, starts = splitters(keyed, shards, tolerance, group_tolerance)
    most = max(10_000, sum(c[2] for c in cells) // 4096)
    ranges: list[list] = []  # first key, shard, rows below in the shard, rows
    for prefix, _, n in cells:
        shard = bisect_right(starts, prefix)
        last = ranges[-1] if ranges else None
        if last and last[1] == shard and last[3] + n <= most:
            last[3] += n
        else:
            ranges.append([prefix, shard, last[2] + last[3] if last and last[1] == shard else 0, n])
    firsts = [r[0] for r in ranges]
    by_prefix = {}
    for i, first in enumerate(firsts):
        by_prefix.setdefault(first[: PROBES[0]], []).append((first, i))
    lookup = []
    for prefix in sorted({c[0][: PROBES[0]] for c in cells}):
        before = bisect_right(firsts, prefix) - 1
        inner = [first for first, i in by_prefix.get(prefix, []) if i > before]
        lookup.append((prefix, before, inner))
    # At most 4,096 rows, and a row for each range: bounded however large docs is.
    table = spark.createDataFrame(lookup, "_prefix string, _before int, _inner array<string>")
    places = spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(ranges)], "_range int, _shard int, _offset long")
    rows = rows.withColumn("_prefix", F.substring("_key", 1, PROBES[0])).join(F.broadcast(table), "_prefix")
    inside = F.size(F.filter("_inner", lambda first: first <= F.col("_key")))
    rows = rows.withColumn("_range", F.col("_before") + inside).join(F.broadcast(places), "_range")
    order = Window.partitionBy("_range").orderBy("_key", id_col)
    rows = rows.withColumn("_slot", F.col("_offset") + F.row_number().over(order) - 1)
    return restored(rows.drop("_key", "_prefix", "_before", "_inner", "_range", "_offset"))
