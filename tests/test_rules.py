import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import clones, components, findings as P, graph, history, packing, rates, recall as R
from tessera.plans import inline as I


@pytest.mark.parametrize("name, grade, gate", [
    ("clean", "A", "index"), ("just A", "A", "index"), ("B at 1", "B", "index"), ("C at 2", "C", "index"), ("D at 4", "D", "index"), ("F at 8", "F", "index"), ("one critical", "C", "serious"), ("four high", "A", "index"),
    ("five high", "B", "serious"), ("nine high", "B", "serious"), ("hundred high", "C", "serious"), ("copied 4.9", "A", "index"), ("copied 5", "B", "copied"), ("copied 10", "C", "copied"), ("copied 20", "D", "copied"), ("worst wins", "F", "index"),
])
def test_grade_is_the_worst_gate(spark, name, grade, gate):
    row = P.graded(I.SCORES.df(spark)).where(F.col("name") == name).first()
    assert (row.grade, row.gate) == (grade, gate)


def commits(spark, n, days):
    start = dt.datetime(2024, 1, 1)
    rows = [(str(i), start + dt.timedelta(days=days * i / max(1, n - 1)), p) for i in range(n) for p in ("a", "b")]
    return spark.createDataFrame(rows, "commit_id string, ts timestamp_ntz, path string")


@pytest.mark.parametrize("n, days, young", [(49, 400, True), (50, 400, False), (50, 29, True), (50, 30, False), (1318, 379, False)])
def test_young_is_the_whole_repository(spark, n, days, young):
    rows = commits(spark, n, days)
    assert history.is_young(rows).first().young is young
    assert history.co_change(rows).isEmpty() is young
    assert history.co_change(rows, gate=False).first().together == n


def test_ages_only_inside_the_window(spark):
    rows = spark.createDataFrame([("1", dt.datetime(2020, 1, 1), "old"), ("2", dt.datetime(2024, 1, 1), "new"), ("3", dt.datetime(2024, 6, 1), "old")], "commit_id string, ts timestamp_ntz, path string")
    assert {r.path: r.age_days for r in history.file_age(rows).collect()} == {"old": None, "new": 152}
    assert {r.path: r.commits for r in history.churn(rows).collect()} == {"old": 1, "new": 1}


@pytest.mark.parametrize("seed", range(3))
def test_cycles_and_components_of_random_graphs(spark, seed):
    random.seed(seed)
    n = 40
    pairs = {(random.randrange(n), random.randrange(n)) for _ in range(45)}
    edges = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}") for a, b in pairs], "src string, dst string")
    to = {a: {b for x, b in pairs if x == a} for a in range(n)}

    def reached(a):
        seen, todo = set(), [a]
        while todo:
            for b in to[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    closure = {a: reached(a) for a in range(n)}
    want = {f"n{a:02d}": f"n{min(b for b in closure[a] if a in closure[b]):02d}" for a in range(n) if a in closure[a]}
    assert {r.node: r.cycle for r in graph.cycles(edges).collect()} == want
    near = {a: to[a] | {x for x, b in pairs if b == a} for a in range(n)}
    to.update(near)
    both = {f"n{a:02d}": f"n{min(reached(a) | {a}):02d}" for a in range(n) if near[a] - {a}}
    assert {r.node: r.component for r in components.connected_components(edges, "src", "dst").collect()} == both


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1500)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {r.component for r in found.collect()} == {0, 1000} and found.count() == 301 + 500


def test_implementations_inherit_importers(spark):
    found = {r.dst: r.fan_in for r in graph.fan_in(graph.with_header_importers(I.IMPORTS.df(spark), I.FILES.df(spark))).collect()}
    assert found["src/stream.cpp"] == 1


def test_docs_never_launch_and_other_languages_are_not_analysed(spark):
    found = {r.path: r.reach for r in graph.reach_labels(I.FILES.df(spark), I.IMPORTS.df(spark), I.ROOTS.df(spark)).collect()}
    assert found["app/old_api.py"] == "manual" and found["src/main.cpp"] is None and found["app/orphan.py"] == "tests" and found["legacy/x.py"] == "none"


def test_effort_never_changes_severity(spark):
    rows = I.FINDINGS.df(spark)
    other = rows.withColumn("effort", F.lit("huge"))
    decided = [sorted((r.id, r.severity) for r in P.apply_decisions(f, I.DECISIONS.df(spark)).collect()) for f in (rows, other)]
    assert decided[0] == decided[1]


def test_applying_decisions_twice_changes_nothing(spark):
    once = P.apply_decisions(I.FINDINGS.df(spark), I.DECISIONS.df(spark))
    again = P.apply_decisions(once.drop("status", "merged_into", "reason"), I.DECISIONS.df(spark))
    assert sorted(map(str, once.select("id", "severity", "status").collect())) == sorted(map(str, again.select("id", "severity", "status").collect()))


def test_rule_of_three_unless_in_lockstep(spark):
    copies = spark.createDataFrame([("a", 2), ("b", 3), ("c", 2)], "fp string, copies long")
    kept = P.rule_of_three(copies, spark.createDataFrame([("c",)], "fp string"))
    assert sorted(r.fp for r in kept.collect()) == ["b", "c"]


def test_rates_at_twice_the_whole_and_none_without_any(spark):
    files = spark.createDataFrame([("a", 1000, 4, 0), ("b", 1000, 0, 0), ("c", 1000, 2, 0)], "module string, loc long, logs long, none long")
    assert [(r.module, r.counter) for r in rates.rate_flags(files, "module", ["logs", "none"], "loc").collect()] == [("a", "logs")]


def test_long_functions(spark):
    body = "\n".join(f"    x = {i}" for i in range(100))
    text = f"def short():\n    pass\n\ndef long(a):\n{body}\n\n    return a\n\nclass C:\n    def m(self):\n{body.replace('    x', '        x')}\n"
    found = rates.long_functions(spark.createDataFrame([("a.py", text), ("b.py", None)], "path string, text string"))
    assert sorted((r.name, r.lines) for r in found.collect()) == [("long", 103), ("m", 101)]


def test_winnowing_keeps_the_least_of_each_window(spark):
    import hashlib

    text = " ".join(f"w{i}" for i in range(40))
    words = text.split()
    hashes = [hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest() for i in range(36)]
    want = {min((hashes[j], j) for j in range(i, i + 4)) for i in range(33)}
    got = clones.winnow(spark.createDataFrame([(1, text), (2, None), (3, "too short")], "doc_id long, text string"))
    assert {(r.fp, r.pos) for r in got.collect()} == want


def test_similar_pairs_lose_none(spark):
    random.seed(5)
    base = [[f"w{random.randrange(3000)}" for _ in range(120)] for _ in range(12)]
    docs = []
    for b in base:
        for _ in range(4):
            d = list(b)
            for _ in range(random.randrange(4)):
                d[random.randrange(len(d))] = f"x{random.randrange(99)}"
            docs.append(" ".join(d))
    docs += [" ".join(["the same passage that all of them have in common here"] * 6 + [f"u{i}" for i in range(8)]) for _ in range(3)]
    rows = clones.winnow(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).cache()
    sets = {}
    for r in rows.collect():
        sets.setdefault(r.doc_id, set()).add(r.fp)
    least = {}
    for i in sorted(sets):
        least.setdefault(frozenset(sets[i]), i)
    reps = sorted(least.values())
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    pairs, member = clones.similar_pairs(rows, "doc_id")
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    assert {r.doc_id: r["class"] for r in member.collect()} == {i: least[frozenset(s)] for i, s in sets.items()}


def test_parallel_trees(spark):
    files = spark.createDataFrame([(f"web/{v}/{n}.ts",) for v in ("v1", "v2") for n in ("a", "b", "c")] + [("web/v3/a.ts",)], "path string")
    changes = spark.createDataFrame([("1", "web/v1/a.ts"), ("1", "web/v2/b.ts"), ("2", "web/v1/a.ts")], "commit_id string, path string")
    assert [tuple(r) for r in clones.parallel_trees(files, changes).collect()] == [("web/v1", "web/v2", 3, 1)]


def test_running_sums_in_blocks(spark):
    random.seed(1)
    rows = [(random.choice([None, "a", "b"]), i * 97, random.randrange(100)) for i in range(2000)]
    got = packing.running_sum(spark.createDataFrame(rows, "g string, i long, n long"), "g", "i", "n").collect()
    sums = {}
    for g, i, n in rows:
        sums[g] = sums.get(g, 0) + n
        assert next(r._sum for r in got if r.i == i) == sums[g] if i % 17 == 0 else True
    assert len(got) == 2000


def test_recall_wants_whole_directories(spark):
    found = {r.note: r.answer for r in R.recall(I.EXPECTED.df(spark), P.apply_decisions(I.FINDINGS.df(spark), I.DECISIONS.df(spark))).collect()}
    assert found["must not match src/ab"] == "never raised" and found["one buffer"] == "kept" and found["copied api"] == "dismissed" and found["other lines"] == "never raised"


@pytest.mark.parametrize("glob, path, hit", [("legacy/**", "legacy/a/b.py", True), ("legacy/**", "x/legacy/b.py", False), ("**/*.py", "b.py", True), ("*.py", "a/b.py", False), ("a/?.py", "a/b.py", True), ("a.b", "axb", False)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.search(T.glob_pattern(glob), path)) is hit


def test_lines(spark):
    rows = spark.createDataFrame([(None, 0), ("", 0), ("a", 1), ("a\n", 1), ("a\n\nb", 3), ("\n", 1)], "t string, n long")
    assert rows.where(T.line_count(F.col("t")) != F.col("n")).count() == 0


def test_code_clones_ignore_comments_and_literals(spark):
    one = "def f(a):\n    # add\n    total = a + 1\n    print('x', total)\n    return total * 2.5\n"
    two = "def f(a):\n    total = a + 99  # other\n    print('yy', total)\n    return total * 7\n"
    files = spark.createDataFrame([("a.py", one), ("b.py", two), ("c.py", one.replace("total", "sum"))], "path string, text string")
    rows = clones.fingerprint_rows(files, "path", T.code_text(F.col("text")), T.CODE_TOKENS).cache()
    pairs, member = clones.similar_pairs(rows, "path")
    assert {r.path: r["class"] for r in member.collect()} == {"a.py": "a.py", "b.py": "a.py", "c.py": "c.py"} and pairs.isEmpty()


def test_grade_is_never_better_than_a_gate(spark):
    random.seed(9)
    rows = [(str(i), random.choice([0.0, 1.0, 5.0, 40.0]) * random.random(), random.choice([0, 10, 1000, 90000]), random.choice([0, 0, 1, 3]), random.randrange(14), random.choice([0.0, 0.049, 0.05, 0.11, 0.3])) for i in range(300)]
    frame = spark.createDataFrame(rows, "name string, weighted double, loc long, critical long, high long, copied_share double")
    for r in P.graded(frame).collect():
        index = next((g for below, g in P.BANDS if r.idx < below), "F")
        serious = "C" if r.critical or r.high >= 10 else "B" if r.high >= 5 else "A"
        copied = "D" if r.copied_share >= 0.2 else "C" if r.copied_share >= 0.1 else "B" if r.copied_share >= 0.05 else "A"
        gates = {"index": index, "serious": serious, "copied": copied}
        assert r.grade == max(gates.values()) and gates[r.gate] == r.grade


def test_long_cycles_raise_and_are_never_cut(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 6}") for i in range(6)], "src string, dst string")
    with pytest.raises(RuntimeError):
        graph.cycles(edges, max_rounds=3).count()
    assert {r.cycle for r in graph.cycles(edges).collect()} == {"n0"}


def test_trees_by_names_or_by_copied_code(spark):
    common = [(f"web/{d}/__init__.py",) for d in ("v1", "v2", "v3", "v4")]
    files = spark.createDataFrame(common + [("web/v1/a.py",), ("web/v2/a.py",), ("web/v3/x.py",), ("web/v4/y.py",)], "path string")
    commits = spark.createDataFrame([("1", "web/v3/x.py"), ("1", "web/v4/y.py")], "commit_id string, path string")
    rows = spark.createDataFrame([("web/v3/x.py", i) for i in range(10)] + [("web/v4/y.py", i) for i in range(4, 14)] + [("web/v1/a.py", 1)], "path string, fp long")
    found = {(r.dir_a, r.dir_b): (r.shared_names, r.copied_share, r.together) for r in clones.all_trees(files, commits, rows, share=0.5).collect()}
    assert found == {("web/v1", "web/v2"): (2, 0.0, 0), ("web/v3", "web/v4"): (0, 0.6, 1), ("web/v1", "web/v3"): (0, 1.0, 0)}


def test_short_fingerprints_stand_for_wide_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    wide, short = clones.winnow(docs), clones.winnow(docs, wide=False)
    both = wide.select("doc_id", "pos", F.substring("fp", 1, 16).alias("x")).exceptAll(short.select("doc_id", "pos", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("x")))
    assert both.isEmpty() and wide.count() == short.count() > 0


def test_whole_shingles_give_every_document_a_class(spark):
    random.seed(11)
    base = [[f"w{random.randrange(900)}" for _ in range(60)] for _ in range(10)]
    texts = [None, "", "!!", "one two", "One, two", "one two three four five", "one two three four"]
    for b in base:
        for changes in (0, 0, 1, 1, 2, 3):
            d = list(b)
            for _ in range(changes):
                d[random.randrange(len(d))] = f"x{random.randrange(99)}"
            texts.append(" ".join(d))
    rows = clones.shingle_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    sets = {}
    for i, t in enumerate(texts):
        w = [x for x in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    assert rows.distinct().count() == sum(map(len, sets.values()))
    least = {}
    for i, s in sets.items():
        least.setdefault(s, i)
    reps = sorted(least.values())
    want = {(a, b, len(sets[a] & sets[b])) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    pairs, member = clones.similar_pairs(rows, "doc_id")
    assert {(r.a, r.b, r.shared) for r in pairs.collect()} == want and want
    assert {r.doc_id: r["class"] for r in member.collect()} == {i: least[s] for i, s in sets.items()}
    empty = clones.similar_pairs(rows.limit(0), "doc_id")
    assert empty[0].isEmpty() and empty[1].isEmpty()


def test_partners_are_the_most_frequent_of_each_file(spark):
    from tessera.runner import notes

    rows = spark.createDataFrame([("a", x, n) for x, n in (("b", 3), ("c", 9), ("d", 3))] + [("c", "d", 1)], "a string, b string, together long")
    found = {(r.path, r.other, r.together) for r in notes.partners(rows, 2).collect()}
    assert found == {("a", "c", 9), ("a", "b", 3), ("b", "a", 3), ("c", "a", 9), ("c", "d", 1), ("d", "a", 3), ("d", "c", 1)}
    assert {r.subject: r.notes for r in notes.by_file({"co_change": rows.where("a = 'c'")}).collect()} == {"c": "changes with d in 1 commits", "d": "changes with c in 1 commits"}
