"""Definitions in source code: functions, methods and classes, what they mention, who calls them.

No parser is needed: Python is read by indentation, languages with braces by their braces, once
comments and literals are gone.  Files that do not compile are read as well.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Languages whose blocks stand in braces.
BRACED = ("javascript", "typescript", "c", "cpp", "java", "kotlin", "csharp", "go", "rust")
#: Words before a parenthesis and a brace that begin no function.
NOT_NAMES = frozenset("if for while switch catch return else do try function sizeof match when using lock with".split())

_STRING = r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_HASHED = re.compile(f"{_STRING}|#[^\n]*")
_SLASHED = re.compile(r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|`(?:[^`\\]|\\[\s\S])*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)")
_BRACE_CLASS = re.compile(r"\b(?:class|struct|interface)\s+(\w+)[^;{}()]*$")
_BRACE_NAME = re.compile(r"([A-Za-z_$][\w$]*)\s*(?:=\s*(?:async\s*)?(?:function\b[^(]*)?)?\(")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_STATE = re.compile(r"\b(?:self|this)\s*(?:\.|->)\s*([A-Za-z_$][\w$]*)")

DEFINITION = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("owner", T.StringType()), T.StructField("start", T.LongType()), T.StructField("lines", T.LongType()),
    T.StructField("words", T.ArrayType(T.StringType())), T.StructField("state", T.ArrayType(T.StringType())),
])


def bare(text: str, lang: str) -> str:
    """Source code with comments and string literals blanked out; line feeds stay, so lines keep their numbers."""
    pattern = _HASHED if lang == "python" else _SLASHED
    return pattern.sub(lambda m: "\n" * m[0].count("\n") or " ", text)


def _python(lines: list[str]) -> list[tuple[str, str, int, int, bool]]:
    """(name, owner, first line, last line, is it a class?) of Python code, lines counted from 0.

    A definition runs to its last line that is indented deeper; lines that only close brackets end nothing.
    """
    found, open_ = [], []  # open_: [indent, name, owner, start, is class]
    last = 0
    for i, line in enumerate(lines):
        body = line.lstrip(" \t")
        if not body:
            continue
        indent = len(line) - len(body)
        if body[0] not in ")]}":
            while open_ and indent <= open_[-1][0]:
                _, name, owner, start, is_class = open_.pop()
                found.append((name, owner, start, last, is_class))
        at = _DEF.match(line)
        if at:
            owner = open_[-1][1] if open_ and open_[-1][4] else ""
            open_.append((indent, at[3], owner, i, at[2] == "class"))
        last = i
    found += [(name, owner, start, last, is_class) for _, name, owner, start, is_class in reversed(open_)]
    return sorted(found, key=lambda d: (d[2], -d[3]))


def _braced(text: str) -> list[tuple[str, str, int, int, bool]]:
    """The same of code with braces: a block belongs to the name before the parenthesis, or to the class, that precedes it."""
    found, open_ = [], []  # open_: (name, owner, start, is class) or None for any other block
    line, since, since_line = 0, 0, 0
    for at in re.finditer(r"[\n{};]", text):
        mark = at[0]
        if mark == "\n":
            line += 1
            continue
        if mark == "{":
            head = text[since : at.start()]
            entry, kind = None, _BRACE_CLASS.search(head.strip())
            names = [n for n in _BRACE_NAME.finditer(head) if n[1] not in NOT_NAMES]
            first = since_line + len(head[: len(head) - len(head.lstrip())].split("\n")) - 1
            if kind:
                entry = (kind[1], "", first, True)
            elif names and ("=>" in head or not re.search(r"=\s*$|\breturn\b|\bnew\b", head)) and not _WORD.match(head.strip().split("(")[0]) is None and head.strip().split("(")[0].split()[-1] not in NOT_NAMES:
                owner = next((o[0] for o in reversed(open_) if o and o[3]), "")
                entry = (names[0][1], owner, first, False)
            open_.append(entry)
        elif mark == "}" and open_:
            entry = open_.pop()
            if entry:
                found.append((entry[0], entry[1], entry[2], line, entry[3]))
        since, since_line = at.end(), line
    return sorted(found, key=lambda d: (d[2], -d[3]))


def definitions_of(text: str | None, lang: str | None) -> list[dict]:
    """What definitions() says of one file; nothing for null, empty texts and other languages."""
    if not text or lang != "python" and lang not in BRACED:
        return []
    code = bare(text, lang)
    lines = code.split("\n")
    out = []
    for name, owner, start, end, is_class in _python(lines) if lang == "python" else _braced(code):
        if not is_class:
            body = "\n".join(lines[start : end + 1])
            state = sorted(set(_STATE.findall(body)))
            words = sorted(set(_WORD.findall(body)) - {name})
            out.append({"name": name, "owner": owner, "start": start + 1, "lines": end - start + 1, "words": words, "state": state if owner else []})
    return out


def definitions(files: DataFrame) -> DataFrame:
    """(path, name, owner, start, lines, words, state) of the functions and methods of files (path, lang, text).

    owner is the class around a method, else empty.  words are the other names that the body mentions, state
    the names after `self.` or `this.` in a method.  Null and empty texts and languages that are not read have no
    rows; repeated files have their rows again.
    """

    @F.arrow_udf(T.ArrayType(DEFINITION))
    def run(texts: pa.Array, langs: pa.Array) -> pa.Array:
        rows = [definitions_of(t.as_py(), l.as_py()) for t, l in zip(texts, langs, strict=True)]
        kind = pa.list_(pa.struct([("name", pa.string()), ("owner", pa.string()), ("start", pa.int64()), ("lines", pa.int64()), ("words", pa.list_(pa.string())), ("state", pa.list_(pa.string()))]))
        return pa.array(rows, type=kind)

    return files.select("path", F.explode(run(F.col("text"), F.col("lang"))).alias("_d")).select("path", "_d.*")


def full_name() -> Column:
    return F.when(F.col("owner") == "", F.col("name")).otherwise(F.concat_ws(".", "owner", "name"))


def long_functions(found: DataFrame, limit: int = 100) -> DataFrame:
    """(path, name, lines) of definitions over the limit."""
    return found.where(F.col("lines") > limit).select("path", "name", "lines")


def links(found: DataFrame) -> DataFrame:
    """(file, a, b): definitions of a file that mention each other, or share state of their class.

    Users of one name after `self.` or `this.` are linked to the least of them and the method of that name,
    so a name that all methods use costs its users once.
    """
    rows = found.select(F.col("path").alias("file"), full_name().alias("a"), "owner", "name", "words", "state")
    plain = rows.where("owner = ''").select("file", F.col("name").alias("w"), F.col("a").alias("b")).distinct()
    said = rows.select("file", "a", F.explode("words").alias("w")).join(plain, ["file", "w"]).where("a <> b").select("file", "a", "b")
    used = rows.select("file", "owner", "a", F.explode("state").alias("w"))
    used = used.unionByName(rows.where("owner <> ''").select("file", "owner", "a", F.col("name").alias("w"))).distinct()
    least = used.groupBy("file", "owner", "w").agg(F.min("a").alias("b"))
    shared = used.join(least, ["file", "owner", "w"]).where("a <> b").select("file", "a", "b")
    return said.unionByName(shared).distinct()


def calls(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, name, caller): which importers (src, dst) of a file mention which of its definitions.

    A caller is a file; names are looked for in its definitions.
    """
    said = found.select(F.col("path").alias("caller"), F.explode("words").alias("short")).distinct()
    here = found.select(F.col("path").alias("file"), F.col("name").alias("short"), full_name().alias("name")).distinct()
    met = edges.select(F.col("src").alias("caller"), F.col("dst").alias("file")).distinct().join(here, "file")
    return met.join(said, ["caller", "short"]).select("file", "name", "caller").distinct()
