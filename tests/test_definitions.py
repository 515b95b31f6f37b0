from tessera.sources import definitions as D

PYTHON = """import os
# def commented(): pass
def first(
    a,
):
    \'\'\'def inside(): a string\'\'\'
    return second(a)

class Store:
    size = 1

    def put(self, x):
        self.rows = x

    async def get(self):
        return self.rows

    def other(self):
        def inner():
            return 1
        return first(inner)

def second(a):
    return a
"""
SCRIPT = """// function commented() {
export function first(a) {
  if (a) { return second(a) }
  return `function text() {`
}
const second = async (a) => {
  return a
}
class Store {
  put(x) {
    this.rows = x
  }
  get() { return this.rows }
}
"""


def test_python_definitions_by_indentation():
    found = {(d["owner"], d["name"]): (d["start"], d["lines"]) for d in D.definitions_of(PYTHON, "python")}
    assert found == {("", "first"): (3, 5), ("Store", "put"): (12, 2), ("Store", "get"): (15, 2), ("Store", "other"): (18, 4), ("", "inner"): (19, 2), ("", "second"): (23, 2)}


def test_definitions_in_braces():
    found = {(d["owner"], d["name"]): (d["start"], d["lines"]) for d in D.definitions_of(SCRIPT, "typescript")}
    assert found == {("", "first"): (2, 4), ("", "second"): (6, 3), ("Store", "put"): (10, 3), ("Store", "get"): (13, 1)}
    code = "int add(int a, int b) {\\n  for (;;) { a++; }\\n  return a;\\n}\\nvoid Box::open() {\\n}\\n".replace("\\\\n", "\\n")
    assert [d["name"] for d in D.definitions_of("int add(int a, int b) {\n  for (;;) { a++; }\n  return a;\n}\n", "cpp")] == ["add"] and code


def test_empty_and_other_files():
    assert D.definitions_of(None, "python") == D.definitions_of("", "python") == D.definitions_of("def f(): pass", "docs") == D.definitions_of("x", None) == []
    assert D.definitions_of("}}}{{{ ) (", "c") == [] and D.definitions_of("def f(", "python")[0]["lines"] == 1


def test_links_calls_and_seams(spark):
    from tessera.operators import graph

    files = spark.createDataFrame([("s.py", "python", PYTHON), ("a.py", "python", "def run():\n    put(1)\n"), ("b.py", "python", "def go():\n    second(1)\n"), ("n.py", "python", None)], "path string, lang string, text string")
    found = D.definitions(files).cache()
    links = {(r.a, r.b) for r in D.links(found).where("file = 's.py'").collect()}
    assert ("first", "second") in links and ("Store.put", "Store.get") in links and ("Store.other", "first") in links
    edges = spark.createDataFrame([("a.py", "s.py"), ("b.py", "s.py")], "src string, dst string")
    calls = {(r.name, r.caller) for r in D.calls(found, edges).collect()}
    assert calls == {("Store.put", "a.py"), ("second", "b.py")}
    named = found.selectExpr("path AS file", "if(owner = '', name, concat(owner, '.', name)) AS name")
    seams = graph.seams(graph.clusters(named, D.links(found)), D.calls(found, edges)).collect()
    assert [(r.file, r.a, r.b, r.seam) for r in seams] == [("s.py", "Store.get", "Store.other", True)]


def test_long_functions_in_any_language(spark):
    body = "  x();\n" * 120
    files = spark.createDataFrame([("a.ts", "typescript", f"function long() {{\n{body}}}\nfunction short() {{}}\n")], "path string, lang string, text string")
    assert [(r.name, r.lines) for r in D.long_functions(D.definitions(files)).collect()] == [("long", 122)]
