import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import exact, simhash


def plain_groups(rows):
    by = {}
    for doc_id, text in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    return by


@pytest.mark.parametrize("how", [{}, {"max_broadcast_keys": 0}, {"max_broadcast_groups": 0}, {"max_broadcast_keys": 0, "max_broadcast_groups": 0}, {"prefix": 1}])
def test_exact_groups_are_those_of_a_dictionary(spark, odd, how):
    by = plain_groups([(r.doc_id, r.text) for r in odd.collect()])
    out = exact.exact_groups(odd, **how).collect()
    assert len(out) == odd.count()
    for r in out:
        group = by[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")]
        named = [i for i in group if i is not None]
        assert r["_group_size"] == len(group)
        assert r["_keep_id"] == (min(named) if named else None)
        assert r["_kept"] == (r.doc_id == r["_keep_id"])
        assert (r["_hash"] is None) == (len(group) == 1)
        if len(group) > 1:
            assert r["_hash"] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()


def test_exact_dedup_keeps_columns_and_one_id_of_each_text(spark, odd, nothing):
    out = exact.exact_dedup(odd)
    assert out.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3, 5, 6, 8, 9, 9, 9, 10]
    assert exact.exact_dedup(nothing).count() == 0


def by_definition(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, ids):
    """Least id reachable, by union-find over all pairs."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    values = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3):
            parent[find(i + 1 + int(j))] = find(i)
    least = {}
    for i, doc_id in enumerate(ids):
        root = find(i)
        if doc_id is not None:
            least[root] = min(least.get(root, doc_id), doc_id)
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprints_follow_the_definition(odd):
    for r in odd.collect():
        if len(r.text or "") < 10_000:
            assert simhash.fingerprint_of(r.text) == by_definition(r.text)
    text = " ".join(f"W{i % 97} x{i % 13}" for i in range(2000))
    assert simhash.fingerprint_of(text) == by_definition(text)


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_fingerprints_do_not_depend_on_how_much_is_taken_at_once(monkeypatch, size):
    monkeypatch.setattr(simhash, "AT_ONCE", size)
    random.seed(size)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = "".join(f"{random.choice('ABcd')}{random.randrange(9)}{random.choice([' ', '  ', chr(10), chr(160)])}" for _ in range(n))
        assert simhash.fingerprint_of(text) == by_definition(text)


def test_components_of_odd_rows(odd, nothing):
    rows = odd.select("doc_id", "text").collect()
    fps = [simhash.fingerprint_of(r.text) for r in rows]
    want = sorted((r.doc_id or 0, f"{fp:016x}", c or 0) for r, fp, c in zip(rows, fps, brute(fps, [r.doc_id for r in rows])))
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in simhash.components(odd).collect())
    assert got == want
    assert simhash.components(nothing).count() == 0


def chains(seed):
    """Fingerprints in dense groups, long chains and alone, close ones across all bit positions."""
    random.seed(seed)
    out = [random.getrandbits(64) for _ in range(200)]
    for _ in range(6):
        at = random.getrandbits(64)
        for _ in range(25):
            at ^= sum(1 << b for b in random.sample(range(64), random.randint(1, 3)))
            out.append(at)
    centre = random.getrandbits(64)
    out += [centre ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 5))) for _ in range(200)]
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("blocks, most", [(None, simhash.BUCKET_ROWS), (None, 3), (5, simhash.BUCKET_ROWS), (6, 3), (7, simhash.BUCKET_ROWS)])
def test_links_connect_what_all_pairs_connect(spark, blocks, most):
    """most=3 sends nearly every bucket through the second split."""
    fps = chains(most)
    from tessera.operators.components import connected_components

    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.close_links(spark.createDataFrame([(s,) for s in signed], "fp long"), blocks=blocks, most=most)
    for r in links.collect():
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3
    found = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    want = brute(fps, signed)
    assert [found.get(s, s) for s in signed] == want


def test_blocks_grow_with_the_fingerprints():
    assert [simhash.fewest_blocks(n, 3) for n in (0, 1 << 13, 1 << 22, 1 << 29, 1 << 36)] == [4, 4, 5, 6, 8]
    for blocks in range(4, 9):
        masks = simhash.block_masks(blocks, 3)
        random.seed(blocks)
        for _ in range(200):
            flip = sum(1 << b for b in random.sample(range(64), 3))
            assert any(flip & m % (1 << 64) == 0 for m in masks)


def test_near_dedup_keeps_one_of_each_group(spark, nothing):
    base = "one two three four five six seven eight nine ten " * 30
    rows = [(5, base, "en", "a", 1), (3, base + "extra", "en", "a", 1), (9, "something else entirely " * 20, "en", "b", 1), (9, base, "en", "b", 2), (4, None, None, None, None), (7, "", None, None, None)]
    docs = spark.createDataFrame(rows, nothing.schema)
    for how in ({}, {"max_broadcast_rows": 0}):
        out = simhash.near_dedup(docs, **how)
        assert out.columns == docs.columns
        kept = sorted((r.doc_id, r.source or "") for r in out.collect())
        near = (simhash.fingerprint_of(base) ^ simhash.fingerprint_of(base + "extra")).bit_count() <= 3
        assert near and kept == [(3, "a"), (4, ""), (9, "b")]
    assert simhash.near_dedup(nothing).count() == 0


def test_hot_group_of_copies(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same old text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    assert simhash.components(docs).where("doc_id % 3 = 0").select("component_id").distinct().collect()[0][0] == 0
    assert exact.exact_groups(docs).where("_group_size > 1").count() == 1334


def test_each_step_of_refinement_reads_what_the_one_before_it_left(spark):
    texts = ["a", "b", "cc", "long text one", "long text two", "long tent one", "long text one", "alone of its length here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lengths = exact.shared_lengths(docs)
    assert sorted(r.n for r in lengths.collect()) == [1, 13]
    for most in (0, 10):
        assert exact.shared_prefixes(docs, lengths, prefix=8, max_broadcast_keys=most).count() == 1  # "long tex"; a and b differ at once
    found = exact.hashed(docs, prefix=8).where("_hash IS NOT NULL")
    assert sorted(r.doc_id for r in found.collect()) == [3, 4, 6]


@pytest.mark.parametrize("how", [{}, {"max_broadcast_groups": 0}])
def test_exact_groups_take_their_own_output(spark, odd, how):
    once = exact.exact_groups(odd, **how)
    again = exact.exact_groups(once, **how)
    assert sorted(once.columns) == sorted(again.columns) == sorted({*odd.columns, "_keep_id", "_group_size", "_kept", "_hash"})
    pick = ["doc_id", "text", "_keep_id", "_group_size", "_kept", "_KEY", "_n", "_of"]
    assert sorted(map(repr, once.select(pick).collect())) == sorted(map(repr, again.select(pick).collect()))
    assert {r["_n"] for r in again.collect()} == {"x"}


@pytest.mark.parametrize("blocks", [4, 5, 6, 7])
def test_finer_keys_leave_at_most_sixteen_bits(blocks):
    for mask in simhash.block_masks(blocks, 3):
        free = [b for b in range(64) if not (mask >> b) & 1]
        for finer in simhash.block_masks(simhash._finer_blocks(free, 3), 3, free):
            assert len(free) - (finer & (1 << 64) - 1).bit_count() <= 16
