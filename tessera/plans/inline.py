"""Small fixed tables that both engines can read: for rules that the supplied tables have no data for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_SQL = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]"}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


@dataclass(frozen=True)
class Inline:
    name: str
    schema: str
    rows: tuple

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    @property
    def sql(self) -> str:
        """The table as a common table expression."""
        columns = [c.split(" ", 1) for c in self.schema.split(", ")]
        casts = ", ".join(f"CAST({n} AS {_SQL[t]}) AS {n}" for n, t in columns)
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {rows}) v({', '.join(n for n, _ in columns)}))"


FILES = Inline("files", "path string, module string, lang string, loc long, is_test boolean, is_script boolean", (
    ("app/main.py", "app", "python", 120, False, False), ("app/api.py", "app", "python", 300, False, False), ("app/old_api.py", "app", "python", 280, False, False),
    ("app/util.py", "app", "python", 60, False, False), ("app/worker.py", "app", "python", 90, False, True), ("app/orphan.py", "app", "python", 40, False, False),
    ("tests/test_api.py", "tests", "python", 80, True, False), ("web/index.ts", "web", "typescript", 50, False, False), ("web/view.ts", "web", "typescript", 70, False, False),
    ("src/stream.cpp", "src", "cpp", 900, False, False), ("src/stream.h", "src", "cpp", 40, False, False), ("src/main.cpp", "src", "cpp", 200, False, False),
    ("legacy/a/x.py", "legacy", "python", 10, False, False), ("legacy/x.py", "legacy", "python", 10, False, False), ("tools/run.sh", "tools", "shell", 12, False, True),
))
IMPORTS = Inline("imports", "src string, dst string, kind string", (
    ("app/main.py", "app/api.py", "import"), ("app/api.py", "app/util.py", "import"), ("app/util.py", "app/api.py", "import"), ("app/worker.py", "app/old_api.py", "import"),
    ("app/old_api.py", "app/util.py", "import"), ("tests/test_api.py", "app/api.py", "import"), ("tests/test_api.py", "app/orphan.py", "string"), ("web/index.ts", "web/view.ts", "import"),
    ("src/main.cpp", "src/stream.h", "include"), ("src/stream.cpp", "src/stream.h", "include"), ("app/main.py", "app/api.py", "string"),
    ("c1", "c2", "import"), ("c2", "c3", "import"), ("c3", "c1", "import"), ("c3", "d1", "import"), ("d1", "d2", "import"), ("d2", "d1", "import"), ("d2", "e1", "import"), ("e1", "e1", "import"), ("b0", "c1", "import"),
))
ROOTS = Inline("roots", "path string, kind string", (("app/main.py", "launched"), ("web/index.ts", "launched"), ("app/worker.py", "manual"), ("tests/test_api.py", "tests"), ("app/old_api.py", "docs")))
DEFINITIONS = Inline("definitions", "file string, name string", (("m.py", "open"), ("m.py", "close"), ("m.py", "read"), ("m.py", "parse"), ("m.py", "render"), ("m.py", "lonely"), ("n.py", "open")))
LINKS = Inline("links", "file string, a string, b string", (("m.py", "open", "close"), ("m.py", "close", "read"), ("m.py", "parse", "render")))
CALLS = Inline("calls", "file string, name string, caller string", (("m.py", "open", "x"), ("m.py", "read", "y"), ("m.py", "parse", "z"), ("m.py", "render", "w"), ("m.py", "lonely", "x")))
FINDINGS = Inline("findings", "id string, path string, line_lo int, line_hi int, category string, severity string, effort string, cost string, text string", (
    ("F-1", "src/queue.cpp", 310, 352, "coupling", "high", "large", "every fix needs three files", "two callers free one buffer by turns"),
    ("F-2", "src/queue.cpp", 310, 352, "coupling", "medium", "small", "two owners", "the buffer again"), ("F-3", "src/ab/x.cpp", 1, 20, "naming", "low", "small", "slow reading", "names differ"),
    ("F-4", "app/api.py", 10, 40, "duplication", "medium", "large", "changes twice", "pasted from old_api"), ("F-5", "app/old_api.py", None, None, "parallel-implementations", "high", "large", "two generations", "rewrite left half done"),
    ("F-6", "tests/test_api.py", 1, 5, "duplication", "low", "small", "noise", "copied setup"), ("F-7", "tests/test_api.py", 7, 9, "coupling", "high", "small", "brittle", "reaches inside"),
    ("F-8", "app/util.py", 1, 60, "size", "medium", "small", "long", "long file"), ("F-9", "app/util.py", 3, 4, "errors", "critical", "small", "", "swallowed"), ("F-10", "app/main.py", 3, 4, "errors", "critical", "small", "lost faults", "swallowed error"),
))
DECISIONS = Inline("decisions", "finding_id string, tier string, action string, new_severity string, merged_into string, reason string", (
    ("F-1", "editor", "rerate", "low", None, "fix is costly"), ("F-1", "appeal", "rerate", "high", None, "pain is not effort"), ("F-2", "editor", "merge", None, "F-1", "same place"),
    ("F-4", "editor", "drop", None, None, "two copies only"), ("F-5", "editor", "verify", None, None, None), ("F-7", "editor", "drop", None, None, "tests"), ("F-7", "appeal", "drop", None, None, "agreed"), ("F-3", "editor", "drop", None, None, "habit"),
))
EXPECTED = Inline("expected", "path string, lines array<int>, category string, note string, keywords array<string>", (
    ("src/queue.cpp", [340, 400], "coupling", "one buffer", None), ("src/a", None, None, "must not match src/ab", None), ("app/", None, None, "copied api", ["pasted", "copied"]),
    ("src", None, "naming", "names", ["NAMES"]), ("app/api.py", [41, 50], None, "other lines", None), ("web", None, None, "nothing there", None), ("app/old_api.py", [1, 2], None, "no lines on the finding", None),
))
CODE = Inline("code", "path string, text string", (
    ("a.py", "import os\nfrom app.util import x\ntry:\n    run()\nexcept Exception:\n    pass\nlogger.info('a')\n# set the total count\ntotal = count(items)\n"),
    ("b.ts", "import { v } from '@/view'\nimport z from \"@lib/z\"\ntry { go() } catch (e) {}\nconsole.log(1)\n// best-effort fallback\n"),
    ("c.py", "# fetch user by name\nuser = fetch_user(by_name)\nx = 'app/util.py'\n"), ("d.cpp", "#include \"stream.h\"\n#include <vector>\n"), ("e.py", ""),
))
ALIASES = Inline("aliases", "scope string, prefix string, target string", (("", "@/", "src/"), ("web", "@/", "web/app/"), ("web/legacy", "@/", "web/legacy/app/"), ("web", "@/ui/", "web/kit/"), ("", "~lib/", "lib/")))
RAW_IMPORTS = Inline("raw_imports", "src string, raw string", (("main.ts", "@/x"), ("web/a.ts", "@/x"), ("web/a.ts", "@/ui/button"), ("web/legacy/b.ts", "@/x"), ("web/legacy/b.ts", "~lib/y"), ("webx/c.ts", "@/x"), ("web/a.ts", "react")))
RUNS = Inline("runs", "tier string, task_id string, run int, attempt int, status string", (("scout", "s1", 0, 3, "skipped"), ("scout", "s1", 1, 1, "done"), ("scout", "s2", 0, 3, "skipped"), ("scout", "s2", 1, 3, "skipped"), ("scout", "s3", 0, 1, "done"), ("editor", "e1", 0, 2, "done"), ("editor", "e2", 0, 1, "done"), ("editor", "e2", 1, 3, "skipped")))
ANSWERS = Inline("answers", "task_id string, message string", (
    ("e1", 'Here: {"decisions": [{"finding_id": "F-1", "action": "drop", "reason": "habit"}, {"finding_id": "F-2", "action": "burn"}, {"action": "drop"}]}'), ("e2", '{"decisions": [{"finding_id": "F-3", "action": "rerate", "new_severity": "low", "reason": "small"}], "summary": "s"}'),
    ("s1", 'Done. {"findings": [{"id": "1", "path": "a.py", "line_lo": 3, "line_hi": 9, "severity": "high", "text": "t"}, {"id": "2", "severity": "high"}, {"id": "3", "path": "b.py", "severity": "dire"}, {"id": "4", "path": "c.py", "severity": "low"}]}'), ("s2", "no object at all"), ("s3", None),
))
SOURCES = Inline("sources", "path string, module string, lang string, loc long, text string", (
    ("a/x.py", "a", "python", 9, "def one():\n    # add to the total\n    total = add(total)\n    return total\n\ndef two(a):\n    return a\n\nx = 1\n"),
    ("a/y.py", "a", "python", 6, "class C:\n    def put(self):\n        try:\n            run()\n        except Exception:\n            pass\n"),
    ("b/z.py", "b", "python", 3, "logger.info('fallback')\ndef three():\n    return 3\n"), ("b/e.py", "b", "python", 0, ""), ("b/n.py", "b", "python", 0, None),
))
TREES = Inline("trees", "path string", (("web/v1/a.ts",), ("web/v1/b.ts",), ("web/v1/index.ts",), ("web/v2/a.ts",), ("web/v2/b.ts",), ("web/v2/index.ts",), ("web/v3/index.ts",), ("lib/v1/a.ts",), ("lib/v1/b.ts",), ("top.ts",)))
CHANGES = Inline("changes", "commit_id string, path string", (("1", "web/v1/a.ts"), ("1", "web/v2/b.ts"), ("2", "web/v1/a.ts"), ("3", "web/v2/a.ts"), ("3", "web/v1/b.ts"), ("3", "web/v1/a.ts"), ("4", "web/v3/index.ts")))
CONFIGS = Inline("configs", "path string, text string", (
    ("web/tsconfig.json", '{\n  // where things are\n  "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["app/*"], "~kit/*": ["kit/src/*", "kit/*"]}, /* more */ }\n}'), ("tsconfig.json", '{"compilerOptions": {"paths": {"lib/*": ["./shared/*"]}}}'),
    ("old/jsconfig.json", '{"compilerOptions": {"baseUrl": "src", "paths": {"#/*": ["js/*"]}}}'), ("web/package.json", '{"compilerOptions": {"paths": {"no/*": ["no/*"]}}}'), ("bad/tsconfig.json", "no json"),
))
PACKAGES = Inline("packages", "path string, text string", (
    ("plugins/__init__.py", "for m in pkgutil.iter_modules(__path__): pass"), ("plugins/one.py", None), ("plugins/deep/two.py", ""), ("web/main.ts", "const a = import.meta.glob('./routes/**/*.tsx')\nimport.meta.glob(['/shared/{x,y}.ts', '!/shared/y.ts'])"),
    ("web/routes/home.tsx", ""), ("web/routes/user/edit.tsx", ""), ("web/routes/user/edit.css", ""), ("web/routesx/no.tsx", ""), ("shared/x.ts", ""), ("shared/y.ts", ""), ("shared/z.ts", ""), ("shared/index.ts", "require.context('.', false, /ts$/)"),
))
DEPLOYED = Inline("deployed", "path string, text string, is_test boolean", (
    ("Dockerfile", "CMD python app/main.py --port 1", False), ("web/package.json", '{"scripts": {"start": "node ./server.cjs", "dev": "tsx src/dev.tsx"}}', False), ("Procfile", "web: gunicorn app.wsgi:application", False), ("README.md", "Run `python app/old.py`.", False),
    ("app/main.py", "run()", False), ("app/wsgi.py", "", False), ("app/old.py", "#!/usr/bin/env python", False), ("web/server.cjs", None, False), ("web/src/dev.tsx", "", False), ("app/tool.py", "if __name__ == '__main__':\n    run()", False), ("tests/test_a.py", "#!", True),
))
TASKS = Inline("tasks", "tier string, task_id string, attempt int, status string, tokens long", (("scout", "s1", 1, "failed", 10), ("scout", "s1", 2, "done", 20), ("scout", "s2", 3, "skipped", 30), ("editor", "e1", 1, "done", 5), ("scout", "s3", 1, "done", 7)))
DOCUMENTED = Inline("documented", "path string", (("app/main.py",), ("app/old_api.py",)))
EVIDENCE = Inline("evidence", "a string, b string, kind string, together boolean", (("x", "y", "static_structure", True), ("x", "y", "co_change", False), ("x", "z", "static_structure", True), ("u", "v", "reason_to_change", False), ("u", "v", "co_change", True)))
BLOCKS = Inline("blocks", "fp string, copies long", (("one", 1), ("pair", 2), ("tied pair", 2), ("three", 3), ("tied four", 4)))
LOCKSTEP = Inline("lockstep", "fp string", (("tied pair",), ("tied pair",), ("tied four",), ("elsewhere",), (None,)))
SCORES = Inline("scores", "name string, weighted double, loc long, critical long, high long, copied_share double", (
    ("clean", 0.0, 1000, 0, 0, 0.0), ("just A", 0.999, 1000, 0, 0, 0.0), ("B at 1", 1.0, 1000, 0, 0, 0.0), ("C at 2", 2.0, 1000, 0, 0, 0.0), ("D at 4", 4.0, 1000, 0, 0, 0.0), ("F at 8", 8.0, 1000, 0, 0, 0.0),
    ("one critical", 10.0, 289293, 1, 0, 0.0), ("four high", 12.0, 289293, 0, 4, 0.0), ("five high", 15.0, 289293, 0, 5, 0.0), ("nine high", 27.0, 289293, 0, 9, 0.0), ("hundred high", 300.0, 289293, 0, 100, 0.0),
    ("copied 4.9", 0.0, 1000, 0, 0, 0.049), ("copied 5", 0.0, 1000, 0, 0, 0.05), ("copied 10", 0.0, 1000, 0, 0, 0.10), ("copied 20", 0.0, 1000, 0, 0, 0.20), ("empty", 0.0, 0, 0, 0, 0.0), ("worst wins", 9.0, 1000, 1, 10, 0.2),
))
