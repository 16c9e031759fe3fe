"""Python files to nodes and edges, by the standard library's parser, a file at a time."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import flat_map

ROWS = (
    "kind string, id string, type string, name string, file_path string, start_line int, end_line int, source_code string, docstring string, signature string, decorators string, "
    "from_node string, to_node string, line_number int, confidence string, seq long, error string"
)

# Annotations that name no class of the project.
PLAIN_TYPES = ("str", "int", "float", "bool", "None", "list", "dict", "set")


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a name, an attribute, or what is called or subscripted."""
    if isinstance(node, ast.Call):
        return dotted(node.func)
    if isinstance(node, ast.Subscript):
        return dotted(node.value)
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else None
    return None


def absolute(module: str | None, level: int, here: str) -> str:
    """The module that a relative import means, seen from module ``here``."""
    if not level:
        return module or ""
    parts = here.split(".")
    base = parts[: len(parts) - level] if level <= len(parts) else None
    return module or "" if base is None else ".".join([*base, *([module] if module else [])])


class Names:
    """Local names of a file and the qualified names that imports give them."""

    def __init__(self, here: str):
        self.here, self.known, self.stars = here, {}, []

    def learn(self, node: ast.Import | ast.ImportFrom) -> list[str]:
        """Targets of the import; a star has none."""
        if isinstance(node, ast.Import):
            for a in node.names:
                self.known[a.asname or a.name] = a.name
            return [a.name for a in node.names]
        module, out = absolute(node.module, node.level, self.here), []
        for a in node.names:
            if a.name == "*":
                self.stars.append(module)
                continue
            full = f"{module}.{a.name}" if module else a.name
            self.known[a.asname or a.name] = full
            out.append(full)
        return out

    def find(self, name: str) -> str | None:
        first, dot, rest = name.partition(".")
        if name in self.known:
            return self.known[name]
        if dot and first in self.known:
            return f"{self.known[first]}.{rest}"
        return f"{self.stars[0]}.{name}" if self.stars else None


def signature(f: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    back = f" -> {ast.unparse(f.returns)}" if f.returns else ""
    return f"{'async ' * isinstance(f, ast.AsyncFunctionDef)}def {f.name}({ast.unparse(f.args)}){back}"


class File:
    """Rows of one file."""

    def __init__(self, path: str, text: str):
        stem = path.rsplit(".", 1)[0].replace("/", ".")
        self.module = stem.removesuffix(".__init__")
        self.path, self.lines, self.rows = path, text.splitlines(), []
        self.names = Names(self.module)
        tree = ast.parse(text)
        self.node(self.module, "module", self.module.rsplit(".", 1)[-1], 1, max(len(self.lines), 1), ast.get_docstring(tree), None)
        self.body(tree, [(self.module, "module")])
        self.blocks(tree)

    def row(self, **values) -> None:
        self.rows.append({"file_path": self.path, "seq": len(self.rows), **values})

    def node(self, node_id: str, kind: str, name: str, start: int, end: int, doc: str | None, sig: str | None, marks: str | None = None) -> None:
        self.row(kind="node", id=node_id, type=kind, name=name, start_line=start, end_line=end, source_code="\n".join(self.lines[start - 1 : end]), docstring=doc, signature=sig, decorators=marks)

    def edge(self, a: str, b: str, kind: str, line: int, confidence: str = "resolved") -> None:
        self.row(kind="edge", from_node=a, to_node=b, type=kind, line_number=line, confidence=confidence)

    def target(self, name: str) -> tuple[str, str]:
        return self.names.find(name) or name, "inferred"

    def body(self, tree: ast.AST, scope: list[tuple[str, str]]) -> None:
        for child in ast.iter_child_nodes(tree):
            if isinstance(child, ast.Import | ast.ImportFrom):
                for t in self.names.learn(child):
                    self.edge(scope[-1][0], t, "imports", child.lineno)
            elif isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                self.definition(child, scope)
            else:
                self.body(child, scope)

    def definition(self, d, scope: list[tuple[str, str]]) -> None:
        parent, own = scope[-1], f"{scope[-1][0]}.{d.name}"
        is_class = isinstance(d, ast.ClassDef)
        kind = "class" if is_class else "method" if any(k == "class" for _, k in scope) else "function"
        marks = "\n".join("@" + ast.unparse(m) for m in d.decorator_list) or None
        self.node(own, kind, d.name, d.lineno, d.end_lineno or d.lineno, ast.get_docstring(d), None if is_class else signature(d), marks)
        if parent[1] in ("function", "method"):
            self.edge(parent[0], own, "contains", d.lineno)
        for base in d.bases if is_class else ():
            if name := dotted(base):
                self.edge(own, self.target(name)[0], "inherits", d.lineno, "inferred")
        for mark in d.decorator_list:
            if name := dotted(mark):
                self.edge(self.names.find(name) or name, own, "decorates", mark.lineno)
                if name.split(".")[-1] == "patch" and isinstance(mark, ast.Call) and mark.args and isinstance(mark.args[0], ast.Constant) and not is_class:
                    self.edge(own, str(mark.args[0].value), "mocks", mark.lineno, "inferred")
        if not is_class:
            self.annotations(d, own)
            self.calls(d, own, [s for s, k in scope if k == "class"])
        self.body(d, [*scope, (own, kind)])

    def annotations(self, d, own: str) -> None:
        every = [a.annotation for a in [*d.args.posonlyargs, *d.args.args, *d.args.kwonlyargs, d.args.vararg, d.args.kwarg] if a and a.annotation]
        for note in [*every, *([d.returns] if d.returns else [])]:
            for part in ast.walk(note):
                if isinstance(part, ast.Name) and part.id not in PLAIN_TYPES:
                    self.edge(own, self.target(part.id)[0], "uses", d.lineno, "inferred")

    def calls(self, d, own: str, classes: list[str]) -> None:
        """Calls anywhere below, so that those of an inner function count for it and for what is around it."""
        inner = list(ast.walk(d))
        for n in inner:
            if isinstance(n, ast.Import | ast.ImportFrom):
                self.names.learn(n)
        for n in inner:
            if not isinstance(n, ast.Call):
                continue
            name = dotted(n.func)
            if name is None:
                self.edge(own, "<dynamic>", "calls", n.lineno, "unresolved")
            elif classes and name.partition(".")[0] in ("self", "cls") and "." in name:
                self.edge(own, f"{classes[-1]}.{name.partition('.')[2]}", "calls", n.lineno, "inferred")
            else:
                self.edge(own, self.target(name)[0], "calls", n.lineno, "inferred")

    def blocks(self, tree: ast.Module) -> None:
        """Runs of top-level statements that define nothing: constants, the main guard, other code."""
        run: list[ast.stmt] = []
        for child in [*tree.body, None]:
            plain = child is not None and not isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef | ast.Import | ast.ImportFrom)
            if plain and not (isinstance(child, ast.Expr) and isinstance(child.value, ast.Constant)):
                run.append(child)
            elif run:
                first = run[0]
                if isinstance(first, ast.If) and "__name__" in ast.unparse(first.test):
                    name = "__main__"
                elif isinstance(first, ast.Assign | ast.AnnAssign) and (t := dotted(first.targets[0] if isinstance(first, ast.Assign) else first.target)):
                    name = t.replace(".", "_")
                else:
                    name = f"block_{first.lineno}"
                self.node(f"{self.module}.{name}", "block", name, first.lineno, run[-1].end_lineno or run[-1].lineno, None, None)
                run = []


def parse(files: DataFrame) -> DataFrame:
    """Node and edge rows (kind) of every file (path, text); a file that doesn't parse gives one error row."""

    def rows(r: dict) -> list[dict]:
        try:
            return File(r["path"], r["text"] or "").rows
        except (SyntaxError, ValueError, RecursionError) as e:
            return [{"kind": "error", "file_path": r["path"], "seq": 0, "error": str(e)}]

    return flat_map(files.select("path", "text"), rows, ROWS)


def imported_names(files: DataFrame) -> DataFrame:
    """(file, name, module): what each name that a file (path, text) imports stands for, dotted; relative ones from its folder."""

    def rows(r: dict) -> list[dict]:
        try:
            tree = ast.parse(r["text"] or "")
        except (SyntaxError, ValueError, RecursionError):
            return []
        package, out = r["path"].split("/")[:-1], []
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                out += [{"file": r["path"], "name": a.asname or a.name.rsplit(".", 1)[-1], "module": a.name} for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                base = package[: len(package) - n.level + 1] if n.level else []
                stem = ".".join([*base, *([n.module] if n.module else [])])
                out += [{"file": r["path"], "name": a.asname or a.name, "module": f"{stem}.{a.name}".strip(".")} for a in n.names]
        return out

    return flat_map(files.select("path", "text"), rows, "file string, name string, module string")


def module_files(names: DataFrame, files: DataFrame) -> DataFrame:
    """(file, name, module_file): the file that a name's module is, or whose object it is; also below the file's top folder."""
    slashed = lambda m: F.replace(m, F.lit("."), F.lit("/"))
    own, parent = slashed(F.col("module")), slashed(F.regexp_replace("module", r"\.[^.]+$", ""))
    bare = F.array(F.concat(own, F.lit(".py")), F.concat(own, F.lit("/__init__.py")), F.concat(parent, F.lit(".py")), F.concat(parent, F.lit("/__init__.py")))
    below = F.transform(bare, lambda p: F.concat(F.split("file", "/")[0], F.lit("/"), p))
    tried = names.select("file", "name", F.posexplode(F.concat(bare, below)).alias("at", "module_file"))
    known = tried.join(files.select(F.col("path").alias("module_file")).distinct(), "module_file", "left_semi")
    return known.groupBy("file", "name").agg(F.min_by("module_file", "at").alias("module_file"))


def nodes(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'node'").select("id", "type", "name", "file_path", "start_line", "end_line", "source_code", "docstring", "signature", "decorators", "seq")


def edges(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'edge'").selectExpr("seq", "from_node", "to_node", "type", "file_path", "line_number", "confidence", "'static' as source")
