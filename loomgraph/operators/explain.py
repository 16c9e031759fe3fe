"""Facts about functions read from their sources: what goes in and out, what may be raised, how complex they are, how to test them."""

from __future__ import annotations

import ast
import re
import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import flat_map
from .rules import EFFECTS, IO_MARKS

FACTS = (
    "inputs array<string>, outputs array<string>, raises array<string>, catches array<string>, effects array<string>, branches int, loops int, complexity string, "
    "purpose string, scenarios array<string>"
)
# What a name's first word says of a function.
PURPOSES = (
    ("get", "Retrieves"), ("fetch", "Retrieves"), ("load", "Loads"), ("read", "Reads"), ("find", "Finds"), ("create", "Creates"), ("build", "Builds"), ("make", "Creates"),
    ("validate", "Validates"), ("check", "Checks"), ("is", "Checks"), ("has", "Checks"), ("save", "Saves"), ("write", "Writes"), ("delete", "Deletes"), ("remove", "Removes"),
    ("update", "Updates"), ("send", "Sends"), ("parse", "Parses"), ("convert", "Converts"), ("format", "Formats"), ("handle", "Handles"), ("process", "Processes"), ("run", "Runs"),
    ("test", "Tests"), ("init", "Initializes"),
)


def _name(node: ast.AST | None) -> str:
    return "" if node is None else ast.unparse(node.func if isinstance(node, ast.Call) else node)


def _unique(items) -> list[str]:
    return list(dict.fromkeys(x for x in items if x))


def slug(text: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"\W+", "_", text.lower())).strip("_")[:40]


def facts(name: str, source: str) -> dict:
    """The columns of FACTS for one source; empty where it doesn't parse."""
    words = [w for w in (name or "").strip("_").split("_") if w]
    verb = dict(PURPOSES).get(words[0].lower()) if words else None
    purpose = f"{verb} {' '.join(words[1:]) or 'data'}" if verb else f"Performs {' '.join(words) or 'work'}"
    low = f"{name} {source}".lower()
    out = {"inputs": [], "outputs": [], "raises": [], "catches": [], "branches": 0, "loops": 0, "complexity": "simple", "purpose": purpose, "scenarios": []}
    out["effects"] = sorted(e for e, parts in EFFECTS if any(p in low for p in parts))
    try:
        tree = ast.parse(textwrap.dedent(source or ""))
    except SyntaxError:
        return out
    top = next((n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)), None)
    if top is not None:
        args = [*top.args.posonlyargs, *top.args.args, *top.args.kwonlyargs]
        out["inputs"] = [f"{a.arg}: {ast.unparse(a.annotation)}" if a.annotation else a.arg for a in args if a.arg not in ("self", "cls")]
        out["outputs"] = [ast.unparse(top.returns)] if top.returns else []
    inner = list(ast.walk(tree))
    if not out["outputs"]:
        out["outputs"] = _unique(ast.unparse(n.value) for n in inner if isinstance(n, ast.Return) and n.value)[:3]
    out["raises"] = _unique(_name(n.exc) for n in inner if isinstance(n, ast.Raise))
    out["catches"] = _unique(_name(n.type) for n in inner if isinstance(n, ast.ExceptHandler))
    ifs = [n for n in inner if isinstance(n, ast.If | ast.IfExp)]
    out["branches"] = len(ifs)
    out["loops"] = sum(isinstance(n, ast.For | ast.AsyncFor | ast.While) for n in inner)
    out["complexity"] = "complex" if len(ifs) > 5 or out["loops"] > 3 else "moderate" if len(ifs) > 2 or out["loops"] > 1 else "simple"
    cases = ["happy_path"] + [f"when_{slug(ast.unparse(n.test))}" for n in ifs if isinstance(n, ast.If)][:3]
    cases += [f"raises_{slug(r)}" for r in out["raises"]] + [f"handles_{slug(c)}" for c in out["catches"]]
    if out["loops"]:
        cases += ["empty_input"]
    if any(isinstance(n, ast.Return) and (n.value is None or (isinstance(n.value, ast.Constant) and n.value.value is None)) for n in inner):
        cases += ["returns_none"]
    out["scenarios"] = _unique(cases)
    return out


def explain(nodes: DataFrame) -> DataFrame:
    """(id, columns of FACTS) of nodes (id, name, source_code)."""
    rows = nodes.select("id", "name", "source_code")
    return flat_map(rows, lambda r: [{"id": r["id"], **facts(r["name"] or "", r["source_code"] or "")}], "id string, " + FACTS)


def to_mock(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, mock): callees of each node that do input or output, or aren't part of the project."""
    io = F.lit(False)
    for m in IO_MARKS:
        io = io | F.contains("source_code", F.lit(m))
    callees = edges.filter("type = 'calls'").select(F.col("from_node").alias("id"), F.col("to_node").alias("mock")).distinct()
    known = nodes.select(F.col("id").alias("mock"), io.alias("_io"))
    return callees.join(known, "mock", "left").filter(F.coalesce("_io", F.lit(True))).select("id", "mock")


def test_plan(nodes: DataFrame, edges: DataFrame, node_id: str | None = None) -> DataFrame:
    """(id, scenarios, mocks): what to test of each function (or of one), and what to replace. nodes: all of the project, so that
    its own callees are known as such."""
    mocks = to_mock(nodes, edges).groupBy("id").agg(F.array_sort(F.collect_set("mock")).alias("mocks"))
    own = nodes.filter(F.col("type").isin("function", "method"))
    own = own if node_id is None else own.filter(F.col("id") == node_id)
    return explain(own).select("id", "scenarios").join(mocks, "id", "left").withColumn("mocks", F.coalesce("mocks", F.array().cast("array<string>")))
