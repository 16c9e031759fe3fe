"""Column functions over identifiers, paths and text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_of(path: Column) -> Column:
    """All but the last part of a dotted identifier; the identifier itself if it has one part."""
    return F.regexp_replace(path, r"\.[^.]+$", "")


def depth_of(path: Column) -> Column:
    return F.size(F.split(path, r"\."))


def ancestors_of(path: Column) -> Column:
    """Proper prefixes of a dotted identifier that end before a dot, shortest first."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat_ws(".", F.slice(parts, F.lit(1), n)))


def suffixes_of(path: Column) -> Column:
    """Proper suffixes of a dotted identifier that start after a dot."""
    parts = F.split(path, r"\.")
    return F.when(
        F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.concat_ws(".", F.slice(parts, n, F.size(parts))))
    ).otherwise(F.array().cast("array<string>"))


def glob_regex(pattern: str) -> str:
    """The regular expression of a shell pattern (``*``, ``?``, ``[...]``), whole string."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches_glob(value: Column, pattern: str) -> Column:
    """Shell pattern over an identifier or a path; slashes in the pattern may stand for dots."""
    return value.rlike(glob_regex(pattern)) | value.rlike(glob_regex(pattern.replace("/", ".")))


def normalise_route(path: Column) -> Column:
    """``${x}``, ``{x}`` and ``:x`` become ``:param``; the query and a trailing slash go."""
    plain = F.regexp_replace(path, r"\?.*$", "")
    named = F.regexp_replace(plain, r"\$\{[^}]*\}|\{[^}]*\}", ":param")
    named = F.regexp_replace(named, r":[A-Za-z_]\w*", ":param")
    return F.when(F.length(named) > 1, F.rtrim(named, F.lit("/"))).otherwise(named)


def is_test_file(path: Column) -> Column:
    """Files of tests, which the mappers pass over."""
    name = F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)
    ends = F.lit(False)
    for e in (".test.ts", ".test.js", ".spec.ts", ".spec.js"):
        ends = ends | F.endswith(name, F.lit(e))
    return F.startswith(name, F.lit("test_")) | (name == "conftest.py") | ends | F.array_contains(F.split(F.coalesce(path, F.lit("")), "/"), "__tests__")


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def language_of(path: Column) -> Column:
    """Language by extension; null where it isn't supported."""
    # Extensions and their languages.
    languages = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".sql": "sql"}
    out = F.lit(None).cast("string")
    for suffix, language in languages.items():
        out = F.when(F.endswith(path, F.lit(suffix)), language).otherwise(out)
    return out


def any_of(value: Column, parts: list[str] | tuple[str, ...], how: str = "contains") -> Column:
    """True if one of ``parts`` is in, begins, ends or equals the value; false for none, or an empty value."""
    if not parts:
        return F.lit(False)
    if how == "exact":
        test = value.isin(list(parts))
    else:
        one = {"contains": F.contains, "prefix": F.startswith, "suffix": F.endswith}[how]
        test = F.lit(False)
        for p in parts:
            test = test | one(value, F.lit(p))
    return F.coalesce((value != "") & test, F.lit(False))
