"""SimHash near-duplicates: 64-bit fingerprints, linked where they differ in few bits.

Close pairs are found by pigeonhole.  With `blocks` parts and at most 3 differing bits, at least
`blocks` - 3 parts are equal, so every close pair shares one of the keys made of that many parts:
4 keys of 16 bits with 4 parts, 10 of about 25 with 5, 20 of 32 with 6, 35 of about 36 with 7.  The
fewest parts are taken whose keys are four times as many as the fingerprints, so chance hardly
brings any two together at any size.  Keys are aggregated natively: a key with two fingerprints is
verified at once from its minimum and maximum, only keys with more are gathered, as arrays of at
most `BUCKET_ROWS` distinct fingerprints.  A key with more than that is split again by parts of the
remaining bits, so many that at most 16 bits stay free and so at most 65,536 fingerprints: every
array has a bound that does not depend on the data, and no link is lost whatever is chosen.
Equal texts, and all texts with
equal fingerprints, are one row before any of this, however many copies there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.operators.components import connected_components
from tessera.session import broadcast_if, materialize

BUCKET_ROWS = 1 << 16
SEED = 42
AT_ONCE = 1 << 20
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of one text; zero for null and for texts without words.

    Words are runs without ASCII white space, A-Z lower-cased; shingles of `words` words keep
    their repeats; a text with fewer words is one shingle.
    """
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones, n, held = np.zeros(64, dtype=np.int64), 0, []
    for part in _parts_of((text or "").encode("utf-8", "surrogatepass").lower()):
        held += part
        if len(held) < words:
            continue
        hashes = [digest(join(s), SEED) for s in zip(*(held[i:] for i in range(words)), strict=False)]
        held = held[len(held) - words + 1 :]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).view(np.uint64).reshape(len(hashes), 8)
        n += len(hashes)
        for i in range(0, len(hashes), 255):  # byte-wise counters in 64-bit words; 255 rows cannot overflow one
            ones += bits[i : i + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    if not n:
        return digest(join(held), SEED) if held else 0
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _parts_of(data: bytes, size: int | None = None) -> Iterator[list[bytes]]:
    """The words of a text, some of it at a time, so that a very long one takes no more memory than its bytes."""
    size = size or AT_ONCE
    at = 0
    while at < len(data):
        space = WHITE.search(data, at + size)
        end = space.start() if space else len(data)
        yield data[at:end].split()
        at = end


def fingerprints(text: Column, words: int = 3) -> Column:
    """The fingerprint of each whole text as a signed long."""

    @F.arrow_udf(T.LongType())
    def simhash(texts: pa.Array) -> pa.Array:
        made = np.fromiter((fingerprint_of(t.as_py(), words) for t in texts), dtype=np.uint64, count=len(texts))
        return pa.array(made.view(np.int64))

    return simhash(text)


def _parts(bits: list[int], blocks: int) -> list[list[int]]:
    size, more = divmod(len(bits), blocks)
    ends = np.cumsum([size + (i < more) for i in range(blocks)])
    return [bits[e - size - (i < more) : e] for i, e in enumerate(ends)]


def _mask(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(blocks: int, distance: int, bits: list[int] | None = None) -> list[int]:
    """Signed 64-bit masks, one of which any two fingerprints within `distance` agree under."""
    parts = _parts(list(range(64)) if bits is None else bits, blocks)
    return [_mask(sum(some, [])) for some in combinations(parts, blocks - distance)]


def fewest_blocks(fingerprints: int, distance: int) -> int:
    """The fewest parts whose keys have at least two bits more than it takes to number the fingerprints."""
    blocks = distance + 1
    while blocks < 16 and 64 * (blocks - distance) // blocks < fingerprints.bit_length() + 2:
        blocks += 1
    return blocks


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected within `distance` among distinct fingerprints.

    A breadth-first search that compares each reached fingerprint with those not reached yet, so
    a dense group costs about its size and each fingerprint is linked once.
    """
    left, links = np.sort(fps.astype(np.uint64)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                reached = left[near]
                left = left[~near]
                links += [(int(at), int(x)) for x in reached]
                queue += list(reached)
    return links


_LINKS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def _forests(fps: Column, distance: int) -> Column:
    @F.arrow_udf(_LINKS)
    def linked(groups: pa.Array) -> pa.Array:
        groups = groups.combine_chunks() if isinstance(groups, pa.ChunkedArray) else groups
        out = []
        for group in groups:
            links = forest(group.values.to_numpy(zero_copy_only=False).view(np.uint64), distance)
            pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            out.append([{"a": int(a), "b": int(b)} for a, b in pairs])
        return pa.array(out, type=pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return linked(fps)


def _links(keyed: DataFrame, key: list[str], distance: int, most: int | None) -> tuple[DataFrame, DataFrame]:
    """Links inside the keys of (key..., fp), and the keys with more than `most` fingerprints."""
    sizes = keyed.groupBy(*key).agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes, "buckets")
    pairs = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    some = sizes.where("n > 2" + (f" and n <= {most}" if most else "")).select(*key)
    grouped = keyed.join(some, key).groupBy(*key).agg(F.collect_list("fp").alias("fps"))
    found = grouped.select(F.explode(_forests(F.col("fps"), distance)).alias("x")).select("x.a", "x.b")
    return pairs.unionByName(found), (sizes.where(f"n > {most}") if most else sizes.limit(0)).select(*key)


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))
    return fps.select("fp", F.explode(keys).alias("x")).select(F.col("x.t").alias("x_t"), F.col("x.k").alias("x_k"), "fp")


def _finer_blocks(free: list[int], distance: int) -> int:
    """The fewest parts of some bits of which the `distance` largest, those that a key leaves free, have at most 16."""
    blocks = distance + 1
    while sum(sorted(map(len, _parts(free, blocks)))[-distance:]) > 16:
        blocks += 1
    return blocks


def close_links(fps: DataFrame, distance: int = 3, blocks: int | None = None, most: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) links that join every connected group of the distinct long column `fp`; blocks are counted out if not given."""
    blocks = blocks or fewest_blocks(fps.count(), distance)
    masks = block_masks(blocks, distance)
    keyed = _keyed(fps, masks)
    links, crowded = _links(keyed, ["x_t", "x_k"], distance, most)
    crowded = materialize(crowded, "crowded")
    if crowded.isEmpty():
        return links
    finer = []
    for mask in masks:
        free = [b for b in range(64) if not (mask >> b) & 1]
        finer.append(F.array(*map(F.lit, block_masks(_finer_blocks(free, distance), distance, free))).cast("array<long>"))
    again = keyed.join(crowded, ["x_t", "x_k"]).select("x_t", "x_k", "fp", F.posexplode(F.get(F.array(*finer), F.col("x_t"))).alias("y_t", "mask"))
    again = again.select("x_t", "x_k", "y_t", F.col("fp").bitwiseAND(F.col("mask")).alias("y_k"), "fp")
    return links.unionByName(_links(again, ["x_t", "x_k", "y_t", "y_k"], distance, None)[0])


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, distance: int, most: int) -> DataFrame:
    """(id, t, fp, component_id) of every row; t is a hash of the text."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), fingerprints(text, words).alias("fp"))
    rows = materialize(rows, "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    linked = connected_components(close_links(fps.select("fp"), distance, most=most), "a", "b")
    rooted = fps.join(linked.select(F.col("node").alias("fp"), "component"), "fp")
    least = rooted.groupBy("component").agg(F.min("first").alias("least"))
    shared = rooted.join(least, "component").select("fp", "least")
    whole = fps.join(shared, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return rows.join(materialize(whole, "components"), "fp")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, most: int = BUCKET_ROWS) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row, by its fingerprint's component.

    component_id is the least id whose fingerprint can be reached over links of at most
    `distance` bits.  Null texts and texts without words have fingerprint zero and link like any
    other.  Repeated rows and equal ids each get their row.  Null ids never name a component
    unless the component has no other.  Columns besides these two are not looked at.
    """
    out = _components(docs, id_col, text_col, words, distance, most)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, most: int = BUCKET_ROWS, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs, all columns, whose id is the least of their component.

    Rows that repeat the surviving id within the component stay with it; rows without an id go
    unless their whole component has none.  What goes is told by id and text hash (24 bytes a row),
    by broadcast up to max_broadcast_rows of them, else by a shuffled join.
    """
    found = _components(docs, id_col, text_col, words, distance, most)
    gone = found.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("_gone"), F.col("t").alias("_text")).distinct()
    gone = broadcast_if(materialize(gone, "near-copies"), max_broadcast_rows)
    same = docs[id_col].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs[text_col]) == gone["_text"])
    return docs.join(gone, same, "left_anti")
