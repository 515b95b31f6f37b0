import random
from itertools import combinations

import pytest

import corpus_pipeline
from tessera.llm import near

SF = "/root/testdata/sf0.01"


def shingles(text, words=5):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)} or {tuple(found)}


def survivors(rows):
    """Ids left of (id, text) by union-find over all pairs, of which only those with a shingle in common can be linked."""
    sets, by, root = [shingles(t) for _, t in rows], {}, list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for a, b in {p for places in by.values() for p in combinations(places, 2)}:
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            root[find(a)] = find(b)
    groups = {}
    for i, (name, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(name)
    return sorted(min(g) for g in groups.values()), len(rows) - len(groups)


def test_the_near_stage_leaves_one_of_each_group(spark):
    docs = corpus_pipeline.exact_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).cache()
    want, gone = survivors([(r.doc_id, r.text) for r in docs.collect()])
    assert gone
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect()) == want


def test_drifting_copies_and_short_texts(spark, nothing):
    """Chains whose ends are not alike, so that a key's least text does not link all others."""
    random.seed(3)
    rows = []
    for n in (12, 40, 300):
        text = [f"w{random.randrange(3000)}" for _ in range(n)]
        for _ in range(30):
            rows.append(" ".join(text))
            text[random.randrange(n)] = f"x{random.randrange(3000)}"
    rows += ["one two", "One  two", "one two three", "", None, " "]
    random.shuffle(rows)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(rows)], nothing.schema)
    want, gone = survivors(list(enumerate(rows)))
    assert gone > 30
    for how in ({}, {"max_broadcast_rows": 0}):
        assert sorted(r.doc_id for r in near.near_dedup(docs, **how).collect()) == want


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_shingles_do_not_depend_on_how_much_is_taken_at_once(monkeypatch, size):
    from tessera.llm import simhash

    text = " ".join(f"w{i % 89} x{i % 13}" for i in range(500))
    want = near.shingle_set(text)
    monkeypatch.setattr(simhash, "AT_ONCE", size)
    monkeypatch.setattr(near, "AT_ONCE", size)
    assert (near.shingle_set(text) == want).all() and len(want) == len(shingles(text))
    assert (near.band_keys(want) == near.band_keys(want[::-1])).all()


def test_near_dedup_of_repeated_and_missing_ids(spark, nothing):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(5, base, "en", "a", 1), (3, base + " extra", "en", "a", 1), (9, "something else entirely", "en", "b", 1), (9, base, "en", "b", 2), (4, None, None, None, None), (7, "", None, None, None), (None, base, None, "c", None)]
    out = near.near_dedup(spark.createDataFrame(rows, nothing.schema))
    assert out.columns == nothing.columns
    assert sorted((r.doc_id, r.source or "") for r in out.collect()) == [(3, "a"), (4, ""), (9, "b")]
    assert near.near_dedup(nothing).count() == 0


@pytest.mark.parametrize("rows, size", [(2048, 1 << 18), (3, 1 << 18), (2048, 100)])
def test_crowded_keys_in_blocks_of_any_size(spark, nothing, monkeypatch, rows, size):
    """Many texts about one template, more and less alike, of which only some are linked, in blocks of a few or all of them."""
    monkeypatch.setattr(near, "BLOCK_ROWS", rows)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", size)
    random.seed(7)
    base, texts = [f"w{i}" for i in range(80)], []
    for n in range(120):
        text = list(base)
        for _ in range(1 + n % 4):
            text[random.randrange(len(text))] = f"x{random.randrange(9999)}"
        texts.append(" ".join(text))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], nothing.schema)
    want, gone = survivors(list(enumerate(texts)))
    assert gone > 30 and len(want) > 5
    assert sorted(r.doc_id for r in near.near_dedup(docs).collect()) == want


def test_joining_gives_as_many_links_as_it_joins_groups():
    import numpy as np

    random.seed(2)
    for _ in range(40):
        base = random.sample(range(1000), 30)
        rows = [(i, random.randrange(4), np.array(sorted(random.sample(base, random.randrange(22, 30)) + random.sample(range(1000, 2000), random.randrange(4))), dtype=np.int64)) for i in range(24)]
        a, b = rows[:9], rows[9:]

        def groups(links):
            root = {r[1]: r[1] for r in rows}
            for x, y in links:
                gx, gy = root[rows[x][1]], root[rows[y][1]]
                root = {k: gx if v == gy else v for k, v in root.items()}
            return root

        pairs = [(x[0], y[0]) for x in a for y in b if len(set(x[2]) & set(y[2])) / len(set(x[2]) | set(y[2])) >= 0.8]
        links = near.joining(a, b, 0.8)
        same = lambda root: {(p, q) for p in root for q in root if root[p] == root[q]}
        assert set(links) <= set(pairs) and same(groups(links)) == same(groups(pairs)) and len(links) <= 3


def test_the_near_stage_links_by_fingerprints(spark, nothing, monkeypatch):
    """Two alike texts are one document only if their SimHash fingerprints are within the distance."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words), None, None, None), (2, " ".join(words[:-1] + ["x"]), None, None, None)]
    docs = spark.createDataFrame(rows, nothing.schema)
    assert [r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect()] == [1]
    monkeypatch.setattr(near, "distance_of", lambda similarity: -1)
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect()) == [1, 2]


@pytest.mark.parametrize("marks", [3, 4, 5])
def test_texts_at_the_similarity_share_a_key_and_most_bits(marks):
    """Sets of exactly 0.8, of every size, where SimHash errs most; sets with nothing in common differ in half the bits."""
    import numpy as np

    draws = np.random.default_rng(5)
    for n in (4, 16, 80, 400):
        whole = [draws.integers(1 << 64, size=n * 5 // 4, dtype=np.uint64) for _ in range(100)]
        a, b = near.counters([s[:n] for s in whole]), near.counters(whole)
        differing = np.bitwise_count((near.kept_bits(a) ^ near.kept_bits(b)).view(np.uint64)).sum(axis=1)
        others = np.bitwise_count((near.kept_bits(a) ^ near.kept_bits(np.roll(b, 1, axis=0))).view(np.uint64)).sum(axis=1)
        assert differing.max() <= near.distance_of(0.8) < others.min()
        keys = near.mark_keys(a, marks), near.mark_keys(b, marks)
        assert all(set(x) & set(y) for x, y in zip(*keys, strict=True))


def test_more_texts_take_more_marks():
    assert [near.fewest_marks(n) for n in (0, 10_000, 200_000, 10_000_000, 10**9)] == [3, 3, 4, 5, 5]


@pytest.mark.parametrize("marks", [3, 5])
def test_any_number_of_marks_gives_the_same_rows(spark, marks):
    docs = corpus_pipeline.exact_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).cache()
    want, _ = survivors([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in near.near_dedup(docs, marks=marks).collect()) == want


def test_chance_and_large_groups_leave_few_pairs(spark, nothing, monkeypatch):
    """Unrelated texts become no pair that is joined with fingerprints; texts of a template at most a few each."""
    random.seed(11)
    seen, close = [], near._close

    def counting(pairs, *rest):
        seen.append(pairs.count())
        return close(pairs, *rest)

    monkeypatch.setattr(near, "_close", counting)
    unrelated = [" ".join(f"w{random.randrange(9999)}" for _ in range(20)) for _ in range(3000)]
    base, template = [f"v{i}" for i in range(100)], []
    for _ in range(200):
        text = list(base)
        for _ in range(2):
            text[random.randrange(100)] = f"x{random.randrange(9999)}"
        template.append(" ".join(text))
    for texts, most in ((unrelated, 30), (template, 5 * len(template))):
        seen.clear()
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], nothing.schema)
        want, _ = survivors(list(enumerate(texts)))
        assert sorted(r.doc_id for r in near.near_dedup(docs).collect()) == want
        assert sum(seen) <= most


def test_alike_covers_all_pairs_across_groups():
    import numpy as np

    draws = np.random.default_rng(1)
    for n, keys in ((0, 1), (5, 1), (60, 3), (300, 1), (300, 9), (700, 1)):
        rows = np.zeros(n, dtype=near._ENTRY)
        flips = np.bitwise_or.reduce(np.uint64(1) << draws.integers(0, 64, (n, 8)).astype(np.uint64), axis=1)
        some = draws.integers(1 << 64, size=4, dtype=np.uint64)[draws.integers(0, 4, n)] ^ flips
        rows["c"] = np.where(draws.random(n) < 0.5, draws.integers(1 << 64, size=n, dtype=np.uint64), some)
        rows["k"], rows["t"] = draws.integers(0, keys, n), draws.permutation(n)
        rows["g"] = np.where(draws.random(n) < 0.5, rows["t"], -draws.integers(1, 4, n))
        pairs, crowds = near.alike(np.concatenate([rows, rows]))
        least = dict(reversed(x) for x in near.stars(crowds))
        assert all(len({least.get(t, t) for t in crowd.tolist()}) == 1 < near.FEW < len(set(crowd)) for crowd in crowds)
        found = {tuple(x) for x in pairs.tolist()} | {p for crowd in crowds for p in combinations(crowd.tolist(), 2)}
        for x, y in combinations(sorted(rows.tolist(), key=lambda r: r[2]), 2):
            if x[0] == y[0] and x[3] != y[3] and (x[1] ^ y[1]).bit_count() <= near.ALIKE:
                assert (x[2], y[2]) in found


def test_each_text_has_all_its_keys_in_the_buckets(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(near, "PACKED", 1000)
    docs = spark.createDataFrame([(i, f"{i} b c d e f g h") for i in range(70)], "t long, x string")
    keyed = docs.select("t", near.prints(docs.x, marks=3).alias("p")).selectExpr("t", "p.keys", "p.checks", "-t AS g")
    for parts in (1, 4):
        rows = near._packed(keyed, 3, 5, parts).collect()
        assert len(rows) > 5 * parts and {r.bucket // parts for r in rows} == set(range(5))
        each = np.concatenate([np.frombuffer(r.data, dtype=near._ENTRY) for r in rows])
        bucket = np.repeat([r.bucket for r in rows], [len(r.data) // near._ENTRY.itemsize for r in rows])
        assert (each["g"] == -each["t"]).all()
        got = sorted(zip(each["t"].tolist(), (bucket // parts).tolist(), each["k"].tolist(), each["c"].astype(np.int64).tolist(), strict=True))
        assert got == sorted((r.t, i % 24, k, r.checks[i % 24]) for r in keyed.collect() for i, k in enumerate(r["keys"]) if i % 24 < 5)
        assert len({(b // parts, k, b) for b, k in zip(bucket.tolist(), each["k"].tolist(), strict=True)}) == len({(b // parts, k) for b, k in zip(bucket.tolist(), each["k"].tolist(), strict=True)})


@pytest.mark.parametrize("rows", [20, 1 << 13])
def test_crowds_are_compared_as_one_cluster_up_to_a_size(spark, nothing, monkeypatch, rows):
    """A text stands once in its cluster, however many keys it shares; in larger clusters once in each crowd."""
    monkeypatch.setattr(near, "CLUSTER_ROWS", rows)
    random.seed(13)
    seen, across = [], near._across
    monkeypatch.setattr(near, "_across", lambda rest, *args: seen.append(rest.count()) or across(rest, *args))
    base, texts = [f"w{i}" for i in range(100)], []
    for _ in range(150):
        text = list(base)
        for _ in range(3):
            text[random.randrange(100)] = f"x{random.randrange(9999)}"
        texts.append(" ".join(text))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], nothing.schema)
    want, _ = survivors(list(enumerate(texts)))
    assert sorted(r.doc_id for r in near.near_dedup(docs).collect()) == want
    assert seen and (seen[0] <= len(texts)) == (rows > 20)
