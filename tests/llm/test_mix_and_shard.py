import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import histogram, mixing


def water(sizes, weights=(1, 2, 3), most=3.0):
    """Shares by weight, the excess over each cap shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 2, None: 5}, {"z": 0, "y": 0}, {"é": 5, "z": 7, "Z": 11, None: 3, "a": 400, "b": 1}, {"only": 7}])
def test_targets_are_those_of_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(water(sizes))


def test_mix_of_odd_rows(odd, nothing):
    counts = mixing.mix_counts(odd)
    rows = counts.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["_size"] == len((r.text or "").split(None)) or not (r.text or "").isascii()
        assert 0 <= r["_copies"] <= 3
        rate = r["_target"] / r["_source_size"] if r["_source_size"] else 0
        assert r["_copies"] in (int(rate), int(rate) + (rate > int(rate)))
    again = {(r.doc_id, r.text): r["_copies"] for r in mixing.mix_counts(odd.repartition(7)).collect()}
    assert all(again[r.doc_id, r.text] == r["_copies"] for r in rows)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["_copies"] for r in rows)
    assert mixing.mix_counts(nothing).count() == 0


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, "abcde")), (F.col("id") % 5 + 1).cast("int")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    sums = mixing.mix_counts(docs).groupBy("source").agg(F.sum(F.col("_copies") * F.col("_size")).alias("taken"), F.max("_target").alias("target"))
    for r in sums.collect():
        assert abs(r.taken / r.target - 1) < 0.03


def test_shards_of_odd_rows(odd, nothing):
    rows = histogram.shard_by_bytes(odd, 3).collect()
    assert len(rows) == odd.count()
    for shard in range(3):
        slots = sorted(r["_slot"] for r in rows if r["_shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["_size"] == len((r.text or "").encode()) + 1 for r in rows)
    assert histogram.shard_by_bytes(nothing, 8).count() == 0


@pytest.mark.parametrize("hot", [0, 3000])
def test_shards_are_even_and_keep_small_groups_whole(spark, hot):
    random.seed(hot)
    rows = [(i, "same text " * 10 if i < hot else f"text {i % 2500} " * random.randint(1, 20)) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = histogram.shard_by_bytes(docs, 8).collect()
    sizes, shards = [0] * 8, {}
    for r in out:
        sizes[r["_shard"]] += r["_size"]
        shards.setdefault(r.text, set()).add(r["_shard"])
    assert max(sizes) / min(sizes) < 1.03
    assert sum(len(s) > 1 for s in shards.values()) <= (1 if hot else 0)
    for shard in range(8):
        slots = sorted(r["_slot"] for r in out if r["_shard"] == shard)
        assert slots == list(range(len(slots)))
    order = sorted(out, key=lambda r: (r["_shard"], r["_slot"]))
    keys = {(r.doc_id): r.k for r in docs.select("doc_id", histogram.sort_key(F.col("text"), F.col("doc_id")).alias("k")).collect()}
    assert [keys[r.doc_id] for r in order] == sorted(keys.values())


def test_results_go_in_again_and_other_columns_keep_their_values(odd):
    for apply, results in ((mixing.mix_counts, ["_size", "_source_size", "_target", "_copies"]), (histogram.shard_by_bytes, ["_size", "_shard", "_slot"])):
        once = apply(odd)
        again = apply(once)
        assert sorted(once.columns) == sorted(again.columns) == sorted({*odd.columns, *results})
        others = [c for c in odd.columns if c not in results and c.startswith("_")]
        assert {tuple(r) for r in again.select(others).collect()} == {("x",) * len(others)}
        assert sorted(map(repr, once.select("doc_id", "text", *results).collect())) == sorted(map(repr, again.select("doc_id", "text", *results).collect()))
