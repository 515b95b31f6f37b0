"""Columns over source text: tokens, lines, counters, paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Habits that are counted per module, as patterns over source text.
COUNTERS = {
    "swallowed_catches": r"except[^:\n]*:\s*pass\b|catch\s*(?:\([^)]*\))?\s*\{\s*\}",
    "broad_catches": r"except\s*:|except\s+(?:Base)?Exception\b|catch\s*\(\s*(?:\.\.\.|Exception|Throwable)",
    "logging_calls": r"\b(?:log|logger|logging|console)\.\w+\s*\(",
    "fallback_mentions": r"(?i)fallback|best[- _]effort",
}


def tokens(text: Column, pattern: str = "[a-z0-9]+") -> Column:
    """Lower-cased word tokens; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


#: Tokens of source code that code_text has prepared.
CODE_TOKENS = r"\w+|[^\w\s]"


_STRINGS = r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
#: How comments begin, by language; other languages have both kinds.
HASHED = ("python", "shell")
SLASHED = ("javascript", "typescript", "c", "cpp", "java", "kotlin", "csharp", "go", "rust")


def code_text(text: Column, lang: Column | None = None) -> Column:
    """Source code with comments dropped and literal values replaced by their kind.

    Strings and comments are found in one pass, so a mark of one inside the other is none; `//` is a comment and
    `#` is not, or the other way round, by the language.
    """
    plain = F.coalesce(text, F.lit(""))
    without = lambda comment: F.regexp_replace(plain, f"({_STRINGS})|{comment}", " $1 ")
    hashed, slashed = r"#[^\n]*", r"/\*[\s\S]*?\*/|//[^\n]*"
    if lang is None:
        plain = without(f"{slashed}|{hashed}")
    else:
        plain = F.when(lang.isin(*HASHED), without(hashed)).when(lang.isin(*SLASHED), without(slashed)).otherwise(without(f"{slashed}|{hashed}"))
    plain = F.regexp_replace(plain, _STRINGS, " STR ")
    return F.regexp_replace(plain, r"\b\d[\w.]*\b", " NUM ")


def line_count(text: Column) -> Column:
    """Lines of a text; an empty or null text has none, and a final line feed adds none."""
    plain = F.coalesce(text, F.lit(""))
    feeds = F.length(plain) - F.length(F.replace(plain, F.lit("\n")))
    return F.when(plain == "", 0).otherwise(feeds + F.when(plain.endswith("\n"), 0).otherwise(1)).cast("long")


def matches(text: Column, pattern: str) -> Column:
    """How often a pattern occurs; 0 in null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def glob_pattern(glob: str) -> str:
    """The regular expression of a path glob: ** crosses directories, * and ? do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in ".^$+{}[]()|\\" else glob[i]), i + 1
    return f"^{out}$"


def inside(path: Column, directory: Column) -> Column:
    """Is path the directory itself, or under it?  `src/ab` is not under `src/a`."""
    top = F.rtrim(directory, F.lit("/"))
    return (path == top) | path.startswith(F.concat(top, F.lit("/")))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)
