"""Repositories as tables: files, history, entry points, aliases, imports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessera.functions.text import glob_pattern, line_count

#: Languages by extension, and paths that hold tests.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "java": "java", "kt": "kotlin", "cs": "csharp", "go": "go", "rs": "rust", "sh": "shell", "md": "docs", "rst": "docs"}
TESTS = r"(?:^|/)(?:tests?|__tests__|spec)/|(?:^|/)test_[^/]*$|[._-](?:test|spec)\.[^/.]+$"
#: Files that a framework runs because of where they are.
CONVENTIONS = {
    "next": ("**/pages/**/*.{js,jsx,ts,tsx}", "**/app/**/{page,layout,route}.{js,jsx,ts,tsx}", "**/middleware.{js,ts}"),
    "nuxt": ("**/pages/**/*.vue", "**/server/api/**/*.{js,ts}", "**/plugins/*.{js,ts}"),
    "sveltekit": ("**/routes/**/+{page,layout,server}*.{svelte,js,ts}",),
    "remix": ("**/app/routes/**/*.{jsx,tsx}", "**/app/root.tsx"),
    "astro": ("**/src/pages/**/*.{astro,js,ts}",),
    "tanstack": ("**/src/routes/**/*.tsx",),
    "nitro": ("**/server/{routes,api,middleware}/**/*.{js,ts}",),
    "tool config": ("**/*.config.{js,cjs,mjs,ts}", "**/conftest.py", "**/setup.py"),
    "django": ("**/manage.py", "**/{urls,settings,wsgi,asgi,apps,admin,models}.py", "**/management/commands/*.py", "**/migrations/*.py"),
    "celery": ("**/tasks.py", "**/celery.py"),
    "airflow": ("**/dags/**/*.py",),
    "ansible": ("**/{library,filter_plugins,action_plugins,callback_plugins}/*.py",),
}
#: Files that say what is launched.
LAUNCHERS = {
    "container": r"(?:^|/)(?:Dockerfile|Containerfile)[^/]*$",
    "compose": r"(?:^|/)(?:docker-)?compose[^/]*\.ya?ml$",
    "ci": r"(?:^|/)\.github/workflows/[^/]+\.ya?ml$|(?:^|/)\.gitlab-ci\.yml$",
    "procfile": r"(?:^|/)Procfile$",
    "makefile": r"(?:^|/)Makefile$",
    "package": r"(?:^|/)package\.json$",
    "setup": r"(?:^|/)(?:pyproject\.toml|setup\.(?:py|cfg))$",
    "shell": r"\.(?:sh|bash)$",
    "docs": r"\.(?:md|rst)$",
}


def braces(glob: str) -> list[str]:
    """A glob with {a,b} written out."""
    start, end = glob.find("{"), glob.find("}")
    if start < 0:
        return [glob]
    return [x for part in glob[start + 1 : end].split(",") for x in braces(glob[:start] + part + glob[end + 1 :])]


def language(path: Column) -> Column:
    pairs = [x for kv in LANGUAGES.items() for x in map(F.lit, kv)]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def scan(spark: SparkSession, root: str, module_depth: int = 1) -> DataFrame:
    """files(path, module, lang, loc, is_test, text) of a directory tree; paths are relative to root.

    Bytes that are not UTF-8 are replaced.  The module is the path's first directories.  Spark's
    reader passes over names that begin with `_` or `.`, such as __init__.py and .github: those are
    listed through Hadoop and read by Arrow's file systems.  Only .git itself is left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    raw = raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    top = store.makeQualified(at).toString()
    listed, passed = store.listFiles(at, True), []
    while listed.hasNext():
        name = listed.next().getPath().toString()
        below = name[len(top) :].strip("/").split("/")
        if below[0] != ".git" and any(part[0] in "_." for part in below):
            passed.append((name,))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, path = pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with files.open_input_stream(path) as f:
                    yield pa.RecordBatch.from_pydict({"path": [re.sub("^file:/+", "/", name)], "content": [f.read()]}, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    more = spark.createDataFrame(passed, "name string").mapInArrow(read, "path string, content binary")
    prefix = re.sub("^file:/+", "/", top).rstrip("/") + "/"
    text = F.make_valid_utf8(F.col("content").cast("string"))
    files = raw.unionByName(more).select(F.expr(f"substring(path, {len(prefix) + 1})").alias("path"), text.alias("text"))
    return described(files, module_depth)


def described(files: DataFrame, module_depth: int = 1) -> DataFrame:
    """files(path, text) with module, lang, loc and is_test."""
    folder = F.slice(F.split("path", "/"), 1, module_depth)
    module = F.when(F.contains("path", F.lit("/")), F.array_join(folder, "/")).otherwise(".")
    return files.select("path", module.alias("module"), language(F.col("path")).alias("lang"), line_count(F.col("text")).alias("loc"), F.col("path").rlike(TESTS).alias("is_test"), "text")


def excluding(files: DataFrame, *globs: str) -> DataFrame:
    """files whose path no glob matches."""
    for glob in globs:
        for one in braces(glob):
            files = files.where(~F.col("path").rlike(glob_pattern(one)))
    return files


def without_tests(files: DataFrame) -> DataFrame:
    return files.where(~F.col("is_test"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """commits(commit_id, ts, path) from the text of `git log --name-only --format=%x01%H%x02%cI`.

    Each line is one row of a file split by the commit mark, so a long log is read in pieces.
    """
    raw = spark.read.option("lineSep", "\u0001").text(path).where(F.contains("value", F.lit("\u0002")))
    commit, rest = F.substring_index("value", "\u0002", 1), F.substring_index("value", "\u0002", -1)
    lines = F.split(rest, "\n")
    rows = raw.select(commit.alias("commit_id"), F.to_timestamp(F.element_at(lines, 1)).alias("ts"), F.explode(F.slice(lines, 2, F.size(lines))).alias("path"))
    return rows.where("path <> ''")


def imports(files: DataFrame) -> DataFrame:
    """(src, raw, kind): what each file imports, as written.

    `from x import a, b` imports x, and x.a and x.b, which may be modules.
    """
    text = F.coalesce("text", F.lit(""))
    python = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(?:from[ \t]+[.\w]+[ \t]+import[ \t]+(?:\([^)]*\)|[\w, \t]+)|import[ \t]+[\w., \t]+)"), F.lit(0))
    script = F.regexp_extract_all(text, F.lit(r"(?:from\s+|import\s+|require\(\s*|import\(\s*)['\"]([^'\"]+)['\"]"), F.lit(1))
    include = F.regexp_extract_all(text, F.lit(r"(?m)^\s*#\s*include\s*[\"<]([^\">]+)[\">]"), F.lit(1))
    base = lambda s: F.regexp_extract(s, r"^\s*from\s+([.\w]+)", 1)
    names = lambda s: F.filter(F.transform(F.split(F.regexp_replace(F.regexp_extract(s, r"(?s)import\s+\(?(.*)$", 1), r"#[^\n]*", ""), ","), lambda n: F.regexp_extract(n, r"^\s*([.\w]+)", 1)), lambda n: n != "")
    joined = lambda s: F.concat(F.array(base(s)), F.transform(names(s), lambda n: F.concat(base(s), F.when(base(s).endswith("."), "").otherwise("."), n)))
    spelled = F.flatten(F.transform(python, lambda s: F.when(base(s) == "", names(s)).otherwise(joined(s))))
    raw = F.when(F.col("lang") == "python", spelled).when(F.col("lang").isin("javascript", "typescript"), script).when(F.col("lang").isin("c", "cpp"), include)
    return files.select(F.col("path").alias("src"), F.explode(raw).alias("raw"), F.col("lang").alias("kind")).distinct()


def _plain(path: Column) -> Column:
    """A path without ./ and with every dir/../ taken out; what leads above the root keeps its ../."""
    up = lambda done: (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
    step = lambda done, part: F.when((part == ".") | (part == ""), done).when((part == "..") & up(done), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def edges(raw: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(src, dst, kind): imports that lead to files of the repository.

    Python names are looked for from the root, from the importer's directory, and from any source
    root `src`; scripts by relative path or alias, with the usual extensions; includes beside the
    file, then anywhere by the path's end.  Of several candidates the first in that order is taken.
    """
    folder = F.regexp_extract("src", r"^(.*?)/?[^/]*$", 1)
    within = lambda path: F.concat_ws("/", F.when(folder != "", folder), path)
    rows = raw.join(resolve_aliases(raw.where(F.col("kind").isin("javascript", "typescript")), aliases), ["src", "raw"], "left")
    dots = F.length(F.regexp_extract("raw", r"^(\.*)", 1))
    name = F.replace(F.regexp_replace("raw", r"^\.+", ""), F.lit("."), F.lit("/"))
    relative = F.rtrim(within(F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), name)), F.lit("/"))
    module = F.when(dots > 0, F.array(relative)).otherwise(F.array(name, F.concat(F.lit("src/"), name), within(name)))
    python = F.flatten(F.transform(module, lambda m: F.array(F.concat(m, F.lit(".py")), F.concat(m, F.lit("/__init__.py")))))
    place = F.when(F.col("target").isNotNull(), F.col("target")).when(F.col("raw").startswith("."), within(F.col("raw")))
    ends = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".vue", ".svelte", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
    script = F.array(*(F.concat(place, F.lit(e)) for e in ends))
    beside = F.array(within(F.col("raw")), F.col("raw"))
    tries = F.when(F.col("kind") == "python", python).when(F.col("kind").isin("javascript", "typescript"), script).when(F.col("kind").isin("c", "cpp"), beside)
    asked = rows.select("src", "raw", "kind", F.posexplode(tries).alias("n", "path")).where("path IS NOT NULL").withColumn("path", _plain(F.col("path")))
    known = files.select("path")
    met = asked.join(known, "path").groupBy("src", "raw", "kind").agg(F.min_by("path", "n").alias("dst"))
    rest = raw.where(F.col("kind").isin("c", "cpp")).join(met, ["src", "raw", "kind"], "left_anti")
    last = F.regexp_extract("path", r"([^/]*)$", 1)
    named = rest.withColumn("_last", F.regexp_extract("raw", r"([^/]*)$", 1)).join(known.withColumn("_last", last), "_last")
    named = named.where(F.col("path").endswith(F.concat(F.lit("/"), F.regexp_replace("raw", r"^(?:\.\.?/)+", ""))))
    named = named.groupBy("src", "raw", "kind").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("dst"))
    return met.unionByName(named).where("src <> dst").select("src", "dst", "kind").distinct()


def resolve_aliases(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """(src, raw, target): imports with the alias of the nearest configuration above the file, the longest prefix first.

    aliases: scope (directory of the configuration), prefix, target.  Imports without one keep target null.
    Every directory above a file is a key, so this is an equi-join; alias tables are small, but
    that is left to adaptive execution to find.
    """
    parts = F.split("src", "/")
    scopes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = raw.select("src", "raw").distinct()
    met = rows.select("src", "raw", F.explode(scopes).alias("scope")).join(aliases, "scope").where(F.startswith("raw", "prefix"))
    best = met.groupBy("src", "raw").agg(F.max_by(F.concat("target", F.expr("substring(raw, length(prefix) + 1)")), F.struct(F.length("scope"), F.length("prefix"), "target")).alias("target"))
    return rows.join(best, ["src", "raw"], "left")


def without_comments(json: Column) -> Column:
    """JSON as configurations write it, without comments and commas before a closing bracket; what stands in strings stays."""
    string = r"(\"(?:[^\"\\]|\\.)*\")"
    plain = F.regexp_replace(json, string + r"|//[^\n]*|/\*[\s\S]*?\*/", "$1")
    return F.regexp_replace(plain, string + r"|,(?=\s*[}\]])", "$1")


def aliases_of(files: DataFrame) -> DataFrame:
    """aliases(scope, prefix, target) from `paths` and `baseUrl` of tsconfig.json and jsconfig.json, and `alias` of bundler configurations."""
    scope = F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1)
    shape = T.StructType([T.StructField("compilerOptions", T.StructType([T.StructField("baseUrl", T.StringType()), T.StructField("paths", T.MapType(T.StringType(), T.ArrayType(T.StringType())))]))])
    ts = files.where(F.col("path").rlike(r"(?:^|/)[jt]sconfig[^/]*\.json$")).select(scope.alias("scope"), F.from_json(without_comments(F.col("text")), shape).alias("c"))
    ts = ts.select("scope", F.coalesce("c.compilerOptions.baseUrl", F.lit(".")).alias("base"), F.explode("c.compilerOptions.paths").alias("k", "v"))
    ts = ts.select("scope", F.rtrim("k", F.lit("*")).alias("prefix"), F.concat_ws("/", "base", F.rtrim(F.element_at("v", 1), F.lit("*"))).alias("to"))
    bundler = files.where(F.col("path").rlike(r"(?:^|/)(?:vite|webpack|rollup|nuxt|astro)\.config\.[cm]?[jt]s$"))
    entry = F.regexp_extract_all("text", F.lit(r"['\"]?([@~][\w/-]*)['\"]?\s*:\s*[^,}\n]*?['\"](\.{0,2}/?[\w./-]+)['\"]"), F.lit(0))
    bundler = bundler.select(scope.alias("scope"), F.explode(entry).alias("e"))
    bundler = bundler.select("scope", F.concat(F.regexp_extract("e", r"([@~][\w/-]*)", 1), F.lit("/")).alias("prefix"), F.concat(F.rtrim(F.regexp_extract("e", r"['\"](\.{0,2}/?[\w./-]+)['\"][^'\"]*$", 1), F.lit("/")), F.lit("/")).alias("to"))
    both = ts.unionByName(bundler)
    target = F.regexp_replace(F.concat_ws("/", F.when(F.col("scope") != "", F.col("scope")), F.regexp_replace("to", r"^(?:\./)+", "")), r"(?:^|(?<=/))\./", "")
    return both.select("scope", "prefix", target.alias("target")).distinct()


def string_loads(files: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst): string literals that are a known file's path, or its module name with dots."""
    text = F.coalesce("text", F.lit(""))
    literal = F.regexp_extract_all(text, F.lit("['\"]([\\w./-]{3,})['\"]"), F.lit(1))
    said = files.select(F.col("path").alias("src"), F.explode(literal).alias("name")).distinct()
    named = known.select(F.col("path").alias("dst"), F.explode(F.array("path", F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), "/", "."))).alias("name"))
    return said.join(named, "name").where("src <> dst").select("src", "dst").distinct()


def _glob_pattern(glob: Column) -> Column:
    """glob_pattern for globs that are read from files."""
    plain = F.regexp_replace(glob, r"([.+^$()|\[\]\\])", r"\\$1")
    stars = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\*\*/", "\u0001"), r"\*\*", "\u0002"), r"\*", "[^/]*")
    any_of = F.replace(F.replace(F.replace(stars, F.lit("{"), F.lit("(?:")), F.lit("}"), F.lit(")")), F.lit(","), F.lit("|"))
    return F.concat(F.lit("^"), F.replace(F.replace(any_of, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".*")), F.lit("$"))


def package_edges(files: DataFrame) -> DataFrame:
    """(src, dst): files that a package or a bundler's glob loads.

    A package that imports its own directory reaches the modules beside it.  A literal in
    `import.meta.glob(...)`, of any file, reaches what it matches, seen from that file, or from the
    root where it begins with a slash; one that begins with `!` takes files out again.  Files are
    joined by the folder before the first wildcard.
    """
    folder = F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1)
    text = F.coalesce("text", F.lit(""))
    own = files.where(F.col("path").rlike(r"/(?:__init__\.py|index\.[jt]sx?)$") & text.rlike(r"iter_modules|walk_packages|import_module|require\.context"))
    beside = own.select(F.col("path").alias("src"), folder.alias("d")).join(files.select(F.col("path").alias("dst"), folder.alias("d")), "d").select("src", "dst")
    said = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"import\.meta\.glob(?:<[^>]*>)?\(\s*(\[[^\]]*\]|['\"`][^'\"`]*['\"`])"), F.lit(1)), lambda s: F.regexp_extract_all(s, F.lit("['\"`]([^'\"`]+)['\"`]"), F.lit(1))))
    globs = files.select(F.col("path").alias("src"), folder.alias("d"), F.explode(said).alias("said"))
    place = F.regexp_replace("said", "^!", "")
    place = F.when(place.startswith("/"), F.substr(place, F.lit(2))).otherwise(F.concat_ws("/", F.when(F.col("d") != "", F.col("d")), place))
    globs = globs.select("src", F.col("said").startswith("!").alias("out"), _plain(place).alias("glob"))
    globs = globs.select("src", "out", _glob_pattern(F.col("glob")).alias("pattern"), F.regexp_extract("glob", r"^([^*{]*?)/?[^/*{]*(?:[*{].*)?$", 1).alias("base"))
    parts = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    known = files.select(F.col("path").alias("dst"), F.explode(above).alias("base"))
    hit = globs.join(known, "base").where("dst rlike pattern").groupBy("src", "dst").agg(F.max("out").alias("out")).where("not out").select("src", "dst")
    return beside.unionByName(hit).where("src <> dst").distinct()


def entry_points(files: DataFrame) -> DataFrame:
    """(path, kind, by): files that configuration names or a framework runs; kind launched, tests, docs or manual.

    Files with a main guard that nothing names are manual.  Docs name files too, but launch none.
    """
    known = files.select("path")
    launcher = F.coalesce(*(F.when(F.col("path").rlike(p), F.lit(k)) for k, p in LAUNCHERS.items()))
    scripts = files.withColumn("by", launcher).where("by IS NOT NULL")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\w./-]+\.(?:py|[cm]?[jt]s|[jt]sx|sh)\b"), F.lit(0))
    module = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"-m\s+([\w.]+)|([\w.]+):\w+"), F.lit(0)), lambda s: F.concat(F.replace(F.regexp_replace(s, r"^-m\s+|:\w+$", ""), F.lit("."), F.lit("/")), F.lit(".py")))
    named = scripts.select("by", F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1).alias("d"), F.explode(F.concat(words, module)).alias("said"))
    place = F.regexp_replace("said", r"^(?:\./)+", "")
    named = named.select("by", F.explode(F.array_distinct(F.array(place, F.concat_ws("/", F.when(F.col("d") != "", F.col("d")), place)))).alias("path")).join(known, "path")
    named = named.select("path", F.when(F.col("by") == "docs", "docs").otherwise("launched").alias("kind"), "by")
    rules = [(k, glob_pattern(g)) for k, globs in CONVENTIONS.items() for one in globs for g in braces(one)]
    by_place = F.filter(F.array(*(F.when(F.col("path").rlike(p), F.lit(k)) for k, p in rules)), lambda x: x.isNotNull())
    framework = files.select("path", F.explode(F.array_distinct(by_place)).alias("by")).select("path", F.lit("launched").alias("kind"), "by")
    tests = files.where("is_test").select("path", F.lit("tests").alias("kind"), F.lit("test runner").alias("by"))
    guard = files.where(F.coalesce("text", F.lit("")).rlike(r"__name__\s*==\s*['\"]__main__['\"]|^#!")).select("path", F.lit("manual").alias("kind"), F.lit("main guard").alias("by"))
    found = named.unionByName(framework).unionByName(tests).unionByName(guard).distinct()
    automatic = found.where("kind IN ('launched', 'tests')").select("path").distinct()
    return found.where("kind <> 'manual'").unionByName(found.where("kind = 'manual'").join(automatic, "path", "left_anti"))
