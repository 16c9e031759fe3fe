"""Changes of sources: guards, patches, renames, line edits, validation."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import flat_map
from ..functions.text import occurrences


def update_guards(kind: Column, old: Column, new: Column) -> Column:
    """Why an update is refused: a large class or module as a whole, or a source that shrinks to less than a fifth; else null."""
    return F.when(kind.isin("class", "module") & (F.length(old) > 10_000), "container_too_large").when((F.length(old) > 2_000) & (F.length(new) < 0.2 * F.length(old)), "suspicious_shrink")


def patch(nodes: DataFrame, part: str, replacement: str, source: str = "source_code") -> DataFrame:
    """Sources with a fragment replaced where it occurs exactly once; status: patched, missing or ambiguous."""
    n = occurrences(F.col(source), part)
    status = F.when(n == 0, "missing").when(n > 1, "ambiguous").otherwise("patched")
    return nodes.withColumn("status", status).withColumn(source, F.when(n == 1, F.replace(F.col(source), F.lit(part), F.lit(replacement))).otherwise(F.col(source)))


def rename(nodes: DataFrame, edges: DataFrame, node_id: str, old: str, new: str) -> DataFrame:
    """(id, role, source_code) after a rename: the definition and its callers are rewritten, other sources that hold the name are listed for review."""
    word = r"\b\Q" + old + r"\E\b"
    callers = edges.filter(F.col("to_node") == node_id).select(F.col("from_node").alias("id")).distinct().withColumn("_caller", F.lit(True))
    role = F.when(F.col("id") == node_id, "definition").when(F.col("_caller"), "caller").otherwise("review")
    out = nodes.filter(F.col("source_code").rlike(word)).join(callers, "id", "left").withColumn("role", role)
    return out.select("id", "role", F.when(role != "review", F.regexp_replace("source_code", word, new)).otherwise(F.col("source_code")).alias("source_code"))


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, text, status) of files (path, text) after edits (path, start, end, text; lines from 1, closed).

    Edits of a file that overlap leave it as it was. They are applied from the bottom up; the new text takes the indent of
    what it replaces; an end before its start inserts.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for path, text in zip(left["path"], left["text"]):
            own = right.sort_values(["start", "end"])
            spans = list(zip(own["start"].tolist(), own["end"].tolist()))
            if any(b[0] <= a[1] for a, b in zip(spans, spans[1:])):
                rows.append((path, text, "overlap"))
                continue
            lines = text.split("\n")
            for (a, b), new in reversed(list(zip(spans, own["text"].tolist()))):
                indent = lines[a - 1][: len(lines[a - 1]) - len(lines[a - 1].lstrip())] if a - 1 < len(lines) else ""
                lines[a - 1 : max(b, a - 1)] = [indent + x if x else x for x in _dedent(new)]
            rows.append((path, "\n".join(lines), "edited" if len(own) else "unchanged"))
        return pd.DataFrame(rows, columns=["path", "text", "status"])

    return files.groupBy("path").cogroup(edits.groupBy("path")).applyInPandas(run, "path string, text string, status string")


def _dedent(text: str) -> list[str]:
    lines = text.rstrip("\n").split("\n") if text else []
    least = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return [x[least:] for x in lines]


def batch(files: DataFrame, edits: DataFrame) -> DataFrame:
    """As ``apply_edits``, all or nothing: if one file fails, all keep their texts and the status is rolled_back."""
    out = apply_edits(files, edits)
    failed = out.agg(F.max((F.col("status") == "overlap").cast("int")).alias("_failed"))
    both = out.withColumnRenamed("text", "_new").join(files.select("path", F.col("text").alias("_old")), "path").withColumn("_k", F.lit(1)).join(F.broadcast(failed.withColumn("_k", F.lit(1))), "_k")
    bad = F.col("_failed") == 1
    return both.select("path", F.when(bad, F.col("_old")).otherwise(F.col("_new")).alias("text"), F.when(bad & (F.col("status") != "overlap"), "rolled_back").otherwise(F.col("status")).alias("status"))


def _required(args: ast.arguments) -> list[str]:
    plain = [*args.posonlyargs, *args.args]
    plain = plain[: len(plain) - len(args.defaults)] if args.defaults else plain
    return [a.arg for a in plain] + [a.arg for a, d in zip(args.kwonlyargs, args.kw_defaults) if d is None]


def check_change(old: str, new: str) -> tuple[bool, str | None, list[str]]:
    """Whether a new source parses and is still what it was, the error, and warnings about its parameters."""
    import textwrap

    try:
        b = ast.parse(textwrap.dedent(new or "")).body
    except SyntaxError as e:
        return False, f"syntax: {e.msg} (line {e.lineno})", []
    try:
        a = ast.parse(textwrap.dedent(old or "")).body
    except SyntaxError:
        return True, None, []
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    if a and isinstance(a[0], (*functions, ast.ClassDef)):
        if not b:
            return False, "structure: nothing is defined", []
        if isinstance(a[0], ast.ClassDef) != isinstance(b[0], ast.ClassDef) or not isinstance(b[0], (*functions, ast.ClassDef)):
            return False, "structure: another kind of definition", []
    notes = []
    if a and b and isinstance(a[0], functions) and isinstance(b[0], functions):
        if a[0].name != b[0].name:
            notes.append(f"renamed: {a[0].name} to {b[0].name}")
        was = [x.arg for x in [*a[0].args.posonlyargs, *a[0].args.args, *a[0].args.kwonlyargs]]
        now = [x.arg for x in [*b[0].args.posonlyargs, *b[0].args.args, *b[0].args.kwonlyargs]]
        notes += [f"removed parameter: {x}" for x in was if x not in now]
        notes += [f"new required parameter: {x}" for x in _required(b[0].args) if x not in was]
    return True, None, notes


def validate(changes: DataFrame, key: str = "id", old: str = "old_source", new: str = "new_source") -> DataFrame:
    """(key, valid, error, warnings) of changes of Python sources."""
    kind = dict(changes.dtypes)[key]
    rows = changes.select(F.col(key).alias("key"), F.col(old).alias("old"), F.col(new).alias("new"))
    named = lambda r: [dict(zip((key, "valid", "error", "warnings"), (r["key"], *check_change(r["old"], r["new"]))))]
    return flat_map(rows, named, f"{key} {kind}, valid boolean, error string, warnings array<string>")
