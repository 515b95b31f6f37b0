import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import findings as P, graph
from tessera.plans import inline as I
from tessera.report import render
from tessera.runner import plan, pool
from tessera.sources import repository as S, state
from tessera.streaming import evidence

TREE = {
    ".github/workflows/ci.yml": "run: python app/ci.py\n",
    "app/ci.py": "pass\n",
    "Dockerfile": 'FROM python\nCMD ["python", "app/main.py"]\n',
    "README.md": "Run `app/old.py` by hand.\n",
    "app/__init__.py": "",
    "app/main.py": "from app import util\nimport os\nX = 'app/loaded.py'\n# TODO tidy\n",
    "app/util.py": "import json\n",
    "app/loaded.py": "pass\n",
    "app/old.py": "from app import util\n",
    "app/cli.py": "if __name__ == '__main__':\n    pass\n",
    "manage.py": "print(1)\n",
    "plugins/__init__.py": "import pkgutil\npkgutil.iter_modules(__path__)\n",
    "plugins/one.py": "pass\n",
    "tests/test_util.py": "from app import util\n",
    "web/tsconfig.json": json.dumps({"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["app/*"]}}}),
    "web/src/pages/index.ts": "import { v } from '@/view'\n",
    "src/stream.cpp": '#include "stream.h"\n',
    "src/stream.h": "\n",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "bad.py").write_bytes(b"x = '\xff'\n")
    return S.scan(spark, str(root)).cache()


def test_scan_reads_paths_modules_and_languages(files):
    found = {r.path: r for r in files.collect()}
    assert set(found) == set(TREE) | {"bad.py"}
    assert (found["app/main.py"].module, found["app/main.py"].lang, found["app/main.py"].loc) == ("app", "python", 4)
    assert found["manage.py"].module == "." and found["tests/test_util.py"].is_test and not found["app/main.py"].is_test


def test_entry_points(files):
    found = {(r.path, r.kind) for r in S.entry_points(files).select("path", "kind").distinct().collect()}
    assert {("app/main.py", "launched"), ("app/ci.py", "launched"), ("app/old.py", "docs"), ("manage.py", "launched"), ("app/cli.py", "manual"), ("tests/test_util.py", "tests"), ("web/src/pages/index.ts", "launched")} <= found
    assert ("app/old.py", "launched") not in found and ("app/main.py", "manual") not in found


def test_imports_aliases_and_loads(files):
    raw = {(r.src, r.raw) for r in S.imports(files).collect()}
    assert {("app/main.py", "app"), ("app/main.py", "os"), ("web/src/pages/index.ts", "@/view"), ("src/stream.cpp", "stream.h")} <= raw
    aliases = S.aliases_of(files)
    assert [tuple(r) for r in aliases.collect()] == [("web", "@/", "web/app/")]
    resolved = S.resolve_aliases(S.imports(files), aliases).where("target is not null").collect()
    assert [(r.src, r.target) for r in resolved] == [("web/src/pages/index.ts", "web/app/view")]
    assert ("app/main.py", "app/loaded.py") in {tuple(r) for r in S.string_loads(files, files).collect()}
    assert [tuple(r) for r in S.package_edges(files).collect()] == [("plugins/__init__.py", "plugins/one.py")]


def test_reach_of_a_tree(files):
    edges = S.string_loads(files, files).unionByName(S.package_edges(files))
    found = {r.path: r.reach for r in graph.reach_labels(files, edges, S.entry_points(files)).collect()}
    assert found["app/loaded.py"] == "launched" and found["app/cli.py"] == "manual" and found["app/old.py"] == "none" and found["src/stream.cpp"] is None


def test_history(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("\x01abc\x022024-01-02T03:04:05+00:00\n\na.py\nb.py\n\x01def\x022024-02-02T03:04:05+00:00\n\na.py\n")
    rows = sorted((r.commit_id, r.ts.month, r.path) for r in S.history(spark, str(log)).collect())
    assert rows == [("abc", 1, "a.py"), ("abc", 1, "b.py"), ("def", 2, "a.py")]


def test_options(files):
    kept = {r.path for r in S.without_tests(S.excluding(files, "app/**", "**/*.{md,json}")).collect()}
    assert "app/main.py" not in kept and "README.md" not in kept and "tests/test_util.py" not in kept and "manage.py" in kept


def failing(prompt, settings):
    """Wrong structure first in a, never right in b, an error in c."""
    if "task c" in prompt:
        raise RuntimeError("no answer")
    if "task b" in prompt or "task a" in prompt and "not of the agreed structure" not in prompt:
        return "no json here"
    return 'Here it is: {"findings": [{"id": "1", "path": "x", "severity": "high"}, {"id": "2", "severity": "high"}, {"id": "3", "path": "y", "severity": "odd"}], "summary": "s"}'


def test_runner_repairs_retries_and_skips(spark):
    tasks = spark.createDataFrame([("scout", t, f"task {t}") for t in "abcd"], "tier string, task_id string, prompt string")
    rows = {r.task_id: r for r in pool.run_tier(tasks, failing, pool.Settings(parallel=2)).collect()}
    assert (rows["a"].status, rows["a"].repairs, rows["a"].attempt) == ("done", 1, 1)
    assert rows["b"].status == rows["c"].status == "skipped" and rows["b"].attempt == 3 and "no answer" in rows["c"].message
    assert (rows["d"].status, rows["d"].repairs) == ("done", 0)
    found = pool.findings_of(pool.run_tier(tasks, failing))
    assert sorted((r.task_id, r.id) for r in found.collect()) == [("a", "1"), ("d", "1")]
    answers = spark.createDataFrame([(1, failing("task d", {})), (2, "nothing"), (3, None)], "n int, message string")
    assert [(r.n, r.path) for r in state.answered_findings(answers).collect()] == [(1, "x")]


def test_resume_runs_only_what_is_missing(spark, tmp_path):
    tasks = spark.createDataFrame([("scout", t, f"task {t}") for t in "abd"] + [("editor", "e", "task e")], "tier string, task_id string, prompt string")
    first = pool.resume_tier(tasks, failing, str(tmp_path), "scout")
    assert {r.task_id: r.status for r in first.collect()} == {"a": "done", "b": "skipped", "d": "done"}
    again = pool.resume_tier(tasks, pool.stand_in, str(tmp_path), "scout")
    assert {(r.task_id, r.status) for r in again.collect()} == {("a", "done"), ("b", "done"), ("d", "done")} and again.count() == 3
    assert spark.read.parquet(f"{tmp_path}/tier-scout-1").count() == 1
    assert {(r.tier, r.status, r.tasks) for r in state.task_status(again).collect()} == {("scout", "done", 3)}


def test_plans_of_each_tier(spark, files):
    scouts = plan.scouts(files.where("lang = 'python'"), 1200)
    assert "1| from app import util" in scouts.where("task_id like 'scout/app/%'").first().prompt
    found = pool.findings_of(pool.run_tier(scouts, pool.stand_in)).collect()
    assert [(r.path, r.line_lo) for r in found] == [("app/main.py", 4)]
    assert plan.architects(files).count() == files.select("module").distinct().count() and plan.systems(files).count() == 1
    flows = plan.flows(spark.createDataFrame([("f", 2, "b"), ("f", 1, "a")], "flow string, seq int, path string"))
    assert "a -> b" in flows.first().prompt
    assert plan.reviews(I.FINDINGS.df(spark), "editor", 4).count() == 3 and plan.chief(I.FINDINGS.df(spark)).count() == 1
    assert pool.deep(plan.architects(files)).count() == 3 * plan.architects(files).count()


def test_report_shows_what_was_dismissed(spark, tmp_path):
    found = P.apply_decisions(I.FINDINGS.df(spark), I.DECISIONS.df(spark))
    grade = P.graded(I.SCORES.df(spark).where("name = 'one critical'"))
    tasks = I.TASKS.df(spark)
    render.write(str(tmp_path), grade, found, tasks, state.usage(tasks), summary="All <fine>.")
    text = (tmp_path / "report.md").read_text()
    assert text.startswith("# Maintainability: C") and "serious gate" in text and "two copies only" in text and "s2 was skipped" in text
    assert "&lt;fine&gt;" in (tmp_path / "report.html").read_text()
    assert len(json.loads((tmp_path / "findings.json").read_text())) == 10 and json.loads((tmp_path / "usage.json").read_text())


def test_a_short_report_shows_the_worst_and_the_file_has_all(spark, tmp_path):
    found = spark.range(30).selectExpr("cast(id as string) AS id", "'p' AS path", "if(id = 29, 'critical', 'low') AS severity", "concat('finding ', id) AS text", "'kept' AS status", "'' AS effort", "'' AS cost", "cast(null as string) AS reason")
    tasks = I.TASKS.df(spark)
    render.write(str(tmp_path), P.graded(I.SCORES.df(spark).where("name = 'one critical'")), found, tasks, state.usage(tasks), limit=3)
    text = (tmp_path / "report.md").read_text()
    assert "finding 29" in text and "27 more findings" in text and text.count("finding ") == 3
    assert len(json.loads((tmp_path / "findings.json").read_text())) == 30
    render.write(str(tmp_path), P.graded(I.SCORES.df(spark).where("name = 'one critical'")), found.limit(0), tasks, state.usage(tasks))
    assert json.loads((tmp_path / "findings.json").read_text()) == []


def test_expectations_need_only_a_path(spark, tmp_path):
    path = tmp_path / "expected.json"
    path.write_text('[{"path": "src/a.cpp", "lines": [1, 9], "category": "coupling", "note": "n"}, {"path": "b"}, {"note": "no path"}]')
    rows = state.expectations(spark, str(path)).collect()
    assert [(r.path, r.lines, r.keywords) for r in rows] == [("src/a.cpp", [1, 9], None), ("b", None, None)]


def test_streams_give_what_batches_give(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    query = evidence.fingerprints(stream).writeStream.format("memory").queryName("fps").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = evidence.fingerprints(spark.read.parquet(str(tmp_path / "in")))
    assert spark.table("fps").exceptAll(batch).isEmpty() and spark.table("fps").count() == batch.count() > 0
    files = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.lit("2024-01-01 00:30:00").cast("timestamp"))
    query = evidence.hourly_habits(files, "ts").writeStream.format("memory").queryName("habits").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("habits").count() == 1


MORE = {
    "pkg/__init__.py": "from .core import run\n",
    "pkg/core.py": "from . import helper\nfrom pkg.sub import deep\nimport pkg.helper as h\n",
    "pkg/helper.py": "",
    "pkg/sub/__init__.py": "",
    "pkg/sub/deep.py": "from ..helper import x\n",
    "web/a.ts": "import x from './lib/b'\nimport y from '../shared/c'\nimport z from '@/d'\nimport r from 'react'\n",
    "web/lib/b.tsx": "",
    "shared/c/index.ts": "",
    "web/app/d.js": "",
    "src/x/one.cpp": '#include "one.h"\n#include "util/two.h"\n#include <vector>\n',
    "src/x/one.h": "",
    "include/util/two.h": "",
}


def test_imports_lead_to_files(spark):
    files = S.described(spark.createDataFrame(list(MORE.items()), "path string, text string"))
    aliases = spark.createDataFrame([("web", "@/", "web/app/")], "scope string, prefix string, target string")
    found = {(r.src, r.dst) for r in S.edges(S.imports(files), files, aliases).collect()}
    assert found == {
        ("pkg/__init__.py", "pkg/core.py"), ("pkg/core.py", "pkg/__init__.py"), ("pkg/core.py", "pkg/helper.py"), ("pkg/core.py", "pkg/sub/__init__.py"), ("pkg/core.py", "pkg/sub/deep.py"), ("pkg/sub/deep.py", "pkg/helper.py"),
        ("web/a.ts", "web/lib/b.tsx"), ("web/a.ts", "shared/c/index.ts"), ("web/a.ts", "web/app/d.js"), ("src/x/one.cpp", "src/x/one.h"), ("src/x/one.cpp", "include/util/two.h"),
    }


def judge(prompt, settings):
    """Raises a finding for each TODO, and as an editor drops what it is shown."""
    import re

    if "Role: editor" in prompt:
        return json.dumps({"decisions": [{"finding_id": i, "action": "drop", "reason": "a habit"} for i in re.findall(r"FINDING-[0-9a-f]{8}", prompt)]})
    answer = pool.stand_in(prompt, settings)
    return answer.replace('"severity": "low"', '"severity": "high"')


def test_wide_commits_count_in_a_scan(spark, tmp_path):
    from tessera.scan import Options, Scan

    paths = {i: ["a.py", "b.py"] if i > 1 else [f"f{k:03}.py" for k in range(201)] for i in range(60)}
    log = tmp_path / "log"
    log.write_text("".join(f"\x01c{i}\x022024-0{1 + i % 6}-02T03:04:05+00:00\n\n" + "".join(f"{p}\n" for p in paths[i]) for i in paths))
    found = Scan(spark, Options(workdir=str(tmp_path / "work"), history_log=str(log))).co_change()
    assert found.where("a = 'a.py'").first().together == 58
    assert found.where("together = 2").count() == 201 * 200 // 2


def test_a_whole_scan_resumes_and_reports(spark, tmp_path):
    from tessera.scan import Options, Scan

    root, work = tmp_path / "repo", tmp_path / "work"
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    log = tmp_path / "log"
    log.write_text("".join(f"\x01c{i}\x022024-0{1 + i % 6}-02T03:04:05+00:00\n\napp/main.py\napp/util.py\n" for i in range(60)))
    expected = tmp_path / "expected.json"
    expected.write_text('[{"path": "app", "note": "todo"}, {"path": "web", "note": "none"}]')
    scan = Scan(spark, Options(root=str(root), workdir=str(work), history_log=str(log)), judge)
    scan.scan()
    assert "# Maintainability: A" in (work / "report.md").read_text() and "a habit" in (work / "report.md").read_text()
    found = {r.path: r.reach for r in scan.inventory()["reach"].collect()}
    assert found["app/main.py"] == "launched" and found["app/util.py"] == "launched" and found["app/old.py"] == "none"
    assert {(r.a, r.b, r.together) for r in scan.inventory()["co_change"].collect()} == {("app/main.py", "app/util.py", 60)}
    assert {r.note: r.answer for r in scan.recall(str(expected)).collect()} == {"todo": "dismissed", "none": "never raised"}
    assert {(r.tier, r.status) for r in scan.status().collect()} >= {("scout", "done"), ("editor", "done"), ("chief", "done")}
    again = Scan(spark, Options(root=str(root), workdir=str(work)), judge)
    assert again.run("scout").count() == again.plan("scout").count()
    assert spark.read.parquet(f"{work}/tier-scout-1").count() == 0


def test_a_tier_needs_its_own_structure():
    decided = '{"decisions": [{"finding_id": "F", "action": "drop"}]}'
    for tier in ("editor", "appeal"):
        assert pool.attempt("", lambda p, h: decided, pool.Settings(), tier)[:1] == ("done",)
        assert pool.attempt("", lambda p, h: '{"findings": []}', pool.Settings(), tier)[0] == "skipped"
    assert pool.attempt("", lambda p, h: decided, pool.Settings(), "scout")[0] == "skipped"
    assert pool.shaped('{"summary": "s"}', "chief") and not pool.shaped('{"summary": []}', "chief") and not pool.shaped("{", "chief")


def test_a_worker_that_hangs_is_left_behind():
    import time

    status, message, attempts, _ = pool.attempt("", lambda p, h: time.sleep(60), pool.Settings(attempts=2, timeout=1))
    assert (status, attempts) == ("skipped", 2) and "within 1 s" in message


def test_answers_of_other_tiers(spark):
    message = json.dumps({"decisions": [{"finding_id": "F", "action": "drop", "reason": "r"}, {"action": "drop"}, {"finding_id": "G", "action": "odd"}], "flows": [{"name": "start", "paths": ["a", "b"]}, {"paths": ["c"]}], "cards": [{"path": "a", "role": "entry"}, {"role": "none"}]})
    rows = spark.createDataFrame([("t", message), ("u", None), ("v", "no")], "task_id string, message string")
    assert [(r.task_id, r.finding_id, r.action, r.reason) for r in state.answered_decisions(rows).collect()] == [("t", "F", "drop", "r")]
    assert sorted((r.flow, r.seq, r.path) for r in state.answered_flows(rows).collect()) == [("start", 1, "a"), ("start", 2, "b")]
    assert [(r.path, r.role) for r in state.answered_cards(rows).collect()] == [("a", "entry")]


def test_status_goes_by_the_last_run(spark):
    rows = [("scout", "a", 0, 3, "skipped"), ("scout", "a", 1, 1, "done"), ("scout", "b", 0, 3, "skipped"), ("scout", "c", 0, 1, "done")]
    tasks = spark.createDataFrame(rows, "tier string, task_id string, run int, attempt int, status string")
    assert {(r.status, r.tasks) for r in state.task_status(tasks).collect()} == {("done", 2), ("skipped", 1)}
    assert [r.task_id for r in state.gaps(tasks).collect()] == ["b"]


def test_prompts_carry_the_evidence_of_their_tier(spark, tmp_path):
    from tessera.scan import Options, Scan

    body = "".join(f"    x = {i}\n" for i in range(120))
    pasted = "def paste(rows):\n" + "".join(f"    total_{i} = sum(row.size_{i} for row in rows) + offset_{i}\n" for i in range(12))
    tree = {"a/main.py": f"from a import util\nfrom a.util import one\none()\n# TODO tidy\ndef long():\n{body}", "a/util.py": pasted + "def one():\n    pass\ndef two():\n    pass\n", "b/other.py": pasted + "from a import util\ndef use():\n    two()\n", "Dockerfile": "CMD python a/main.py\n", "c/big.py": "".join(f"y_{i} = {i}\n" for i in range(400))}
    root, work = tmp_path / "repo", tmp_path / "work"
    for name, text in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    asked = {}

    def worker(prompt, settings):
        role = prompt.split("\n")[0][6:]
        if role == "systems":
            return json.dumps({"findings": [], "themes": ["one theme"], "flows": [{"name": "start", "paths": ["a/main.py", "a/util.py"]}], "summary": "s"})
        if role == "scout":
            return json.dumps({**json.loads(pool.stand_in(prompt, settings)), "cards": [{"path": "a/util.py", "role": "shared helpers"}]})
        if role == "chief":
            return json.dumps({"summary": "All is well enough."})
        return pool.stand_in(prompt, settings)

    scan = Scan(spark, Options(root=str(root), workdir=str(work)), worker)
    scan.scan()
    for tier in ("scout", "architect", "systems", "flow", "editor", "chief"):
        asked[tier] = "\n".join(r.prompt for r in scan.plan(tier).collect())
    assert all(part in asked["scout"] for part in ("reach: launched", "imported by 2 files", "long function long of 121 lines", "copied tokens:", "reader cannot see"))
    assert all(part in asked["architect"] for part in ("shared helpers", "copied tokens:", "long_functions at"))
    assert "copied tokens:" in asked["systems"] and "a/main.py -> a/util.py" in asked["flow"] and "File: a/util.py" in asked["flow"]
    assert "4| # TODO tidy" in asked["editor"] and "imported by" not in asked["chief"] and "one theme" in asked["chief"] and "unfinished" in asked["chief"]
    report = (work / "report.md").read_text()
    assert "All is well enough." in report and "## Fix first" in report and "long_functions at" in report
    assert {c for c in scan.inventory()["rates"].columns if c.endswith("_rate")} == {f"{c}_rate" for c in ("swallowed_catches", "broad_catches", "logging_calls", "fallback_mentions", "restated_comments", "long_functions")}


def test_configurations_with_comments_long_imports_and_deep_paths(spark):
    from pyspark.sql import Row

    python = "from pkg.mod import (\n    one,  # first\n    two,\n)\nfrom pkg import three\n"
    files = S.described(spark.createDataFrame([("a/x.py", python), ("w/tsconfig.json", '{ // c\n "compilerOptions": {"paths": {"@/*": ["app/*"],}, "baseUrl": "."} /* "x" */ }')], "path string, text string"))
    assert {r.raw for r in S.imports(files).collect()} == {"pkg.mod", "pkg.mod.one", "pkg.mod.two", "pkg", "pkg.three"}
    assert [tuple(r) for r in S.aliases_of(files).collect()] == [("w", "@/", "w/app/")]
    deep = "/".join("abcdefghijkl")
    paths = {deep + "/../" * 1 + "m": "a/b/c/d/e/f/g/h/i/j/k/m", deep + "/.." * 12 + "/x.py": "x.py", "../a/./b": "../a/b", "a//b": "a/b", "../../x": "../../x", "a/../../x": "../x"}
    rows = spark.createDataFrame([Row(p=p) for p in paths]).select("p", S._plain(F.col("p")).alias("q")).collect()
    assert {r.p: r.q for r in rows} == paths


def test_comments_and_strings_by_language(spark):
    from tessera.functions.text import code_text

    rows = spark.createDataFrame([("python", "a // b + c"), ("javascript", "x = 'http://x.org/a' + y // z"), ("javascript", "a # b"), ("python", "s = '# no' # yes"), (None, None)], "lang string, text string")
    got = [" ".join(r.t.split()) for r in rows.select(code_text(F.col("text"), F.col("lang")).alias("t")).collect()]
    assert got == ["a // b + c", "x = STR + y", "a # b", "s = STR", ""]
