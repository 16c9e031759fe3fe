"""JavaScript and TypeScript files to nodes and edges, by a small scanner: imports, functions, classes, methods, calls, components."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..functions.rows import flat_map
from .python_code import ROWS

TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|=>|[A-Za-z_$][\w$]*|\d[\w.]*|\s+|.", re.S)
# Words that look like calls or names but aren't.
NOT_CALLED = {"async", "if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "await", "super", "constructor", "import", "require"}


def tokens(text: str) -> list[tuple[str, int]]:
    """(token, line) without white space and comments."""
    out, line = [], 1
    for m in TOKEN.finditer(text):
        t = m.group()
        if not t.isspace() and not t.startswith(("//", "/*")):
            out.append((t, line))
        line += t.count("\n")
    return out


def module_of(path: str) -> str:
    return re.sub(r"\.index$", "", re.sub(r"\.[A-Za-z]+$", "", path).replace("/", "."))


def resolve(spec: str, here: str) -> tuple[str, str]:
    """Module that an import names, seen from a file, and how sure that is: what isn't relative is external."""
    if not spec.startswith("."):
        return spec, "external"
    parts = here.split("/")[:-1]
    for p in spec.split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in (".", ""):
            parts.append(p)
    return module_of("/".join(parts)), "resolved"


class Script:
    """Rows of one file."""

    def __init__(self, path: str, text: str):
        self.path, self.text, self.module, self.rows = path, text, module_of(path), []
        self.lines, self.toks, self.names = text.split("\n"), tokens(text), {}
        self.close = self.braces()
        self.node(self.module, "module", self.module.rsplit(".", 1)[-1], 1, len(self.lines))
        self.imports()
        self.block(0, len(self.toks), self.module, "module")

    def braces(self) -> dict[int, int]:
        """Place of the bracket that closes each opening one."""
        open_, out, pair = [], {}, {"{": "}", "(": ")", "[": "]"}
        for i, (t, _) in enumerate(self.toks):
            if t in pair:
                open_.append((i, pair[t]))
            elif open_ and t == open_[-1][1]:
                out[open_.pop()[0]] = i
        return out

    def node(self, node_id: str, kind: str, name: str, start: int, end: int) -> None:
        source = "\n".join(self.lines[start - 1 : end])
        self.rows.append({"kind": "node", "id": node_id, "type": kind, "name": name, "file_path": self.path, "start_line": start, "end_line": end, "source_code": source, "seq": len(self.rows)})

    def edge(self, a: str, b: str, kind: str, line: int, confidence: str) -> None:
        self.rows.append({"kind": "edge", "from_node": a, "to_node": b, "type": kind, "line_number": line, "confidence": confidence, "file_path": self.path, "seq": len(self.rows)})

    def at(self, i: int) -> str:
        return self.toks[i][0] if 0 <= i < len(self.toks) else ""

    def imports(self) -> None:
        for i, (t, line) in enumerate(self.toks):
            if t == "import" and self.at(i + 1) != "(":
                j, names = i + 1, []
                while j < len(self.toks) and self.at(j) not in (";", "=", "(") and self.at(j)[:1] not in "\"'":
                    names.append(self.at(j))
                    j += 1
                if self.at(j)[:1] not in ('"', "'"):
                    continue
                target, sure = resolve(self.at(j)[1:-1], self.path)
                self.learn([n for n in names if n != "from"], target)
                self.edge(self.module, target, "imports", line, sure)
            elif t == "export" and self.at(i + 1) in ("{", "*"):
                j = self.close.get(i + 1, i + 1) + 1
                if self.at(j) == "as":
                    j += 2
                if self.at(j) == "from" and self.at(j + 1)[:1] in ('"', "'"):
                    target, sure = resolve(self.at(j + 1)[1:-1], self.path)
                    self.edge(self.module, target, "imports", line, sure)
                    self.pass_on([self.at(k) for k in range(i + 2, j)], target)
            elif t == "require" and self.at(i + 1) == "(" and self.at(i + 2)[:1] in ('"', "'"):
                target, sure = resolve(self.at(i + 2)[1:-1], self.path)
                if self.at(i - 1) == "=" and self.at(i - 2).isidentifier():
                    self.names[self.at(i - 2)] = target
                self.edge(self.module, target, "imports", line, sure)

    def pass_on(self, names: list[str], target: str) -> None:
        """Names that the module exports from another: each stands for what it is there."""
        for k, n in enumerate(names):
            if n.isidentifier() and n not in ("as", "type", "default") and not (k + 1 < len(names) and names[k + 1] == "as"):
                source = names[k - 2] if k >= 2 and names[k - 1] == "as" else n
                self.names.setdefault(n, f"{target}.{source}")

    def learn(self, names: list[str], target: str) -> None:
        inside = False
        for k, n in enumerate(names):
            if n in "{}":
                inside = n == "{"
            elif n.isidentifier() and n not in ("as", "type") and not (k + 1 < len(names) and names[k + 1] == "as"):
                source = names[k - 2] if k >= 2 and names[k - 1] == "as" and names[k - 2] != "*" else n
                self.names[n] = f"{target}.{source}" if inside else target

    def body_of(self, i: int) -> int | None:
        """Place of the brace that opens a function's body, from the bracket of its parameters on."""
        j = self.close.get(i, i) + 1
        while j < len(self.toks) and self.at(j) not in ("{", ";", "=>", "}"):
            j += 1
        if self.at(j) == "=>":
            j += 1
        return j if self.at(j) == "{" else None

    def define(self, name: str, kind: str, start: int, open_: int | None, scope: str) -> int:
        end = self.close.get(open_, open_) if open_ is not None else start
        own = f"{scope}.{name}"
        self.node(own, kind, name, self.toks[start][1], self.toks[min(end, len(self.toks) - 1)][1])
        if open_ is not None:
            self.block(open_ + 1, end, own, kind)
        return end

    def block(self, a: int, b: int, scope: str, kind: str) -> None:
        i = a
        while i < b:
            t, line = self.toks[i]
            nxt = self.at(i + 1)
            if t == "class" and nxt.isidentifier():
                j = i + 2
                if self.at(j) == "extends":
                    base = self.at(j + 1)
                    self.edge(f"{scope}.{nxt}", self.names.get(base, f"{self.module}.{base}"), "inherits", line, "inferred")
                while j < b and self.at(j) != "{":
                    j += 1
                i = self.define(nxt, "class", i, j if j < b else None, scope)
            elif t == "function" and (nxt.isidentifier() or nxt == "*") and kind != "class":
                name, j = (nxt, i + 2) if nxt != "*" else (self.at(i + 2), i + 3)
                i = self.define(name, "function", i, self.body_of(j), scope)
            elif kind == "class" and t.isidentifier() and nxt == "(" and t not in NOT_CALLED - {"constructor"} and self.body_of(i + 1) is not None:
                i = self.define(t, "method", i, self.body_of(i + 1), scope)
            elif kind == "class" and t.isidentifier() and self.at(i - 1) in ("{", ";", "}", "static", "readonly", "private", "public", "protected") and (arrow := self.arrow(i + 1)) is not None:
                i = self.define(t, "method", i, arrow if self.at(arrow) == "{" else None, scope)  # a field that holds a function
            elif t in ("const", "let", "var") and nxt.isidentifier() and self.at(i + 2) == "=" and self.at(i + 3) == "{" and self.functions_in(i + 3):
                i = self.members(nxt, i, i + 3, scope)
            elif t in ("const", "let", "var") and nxt.isidentifier() and (arrow := self.arrow(i + 2)) is not None:
                i = self.define(nxt, "function", i, arrow if self.at(arrow) == "{" else None, scope)
            else:
                if t.isidentifier() and nxt == "(" and t not in NOT_CALLED:
                    self.call(i, scope, line)
                elif t == "<" and nxt[:1].isupper() and self.at(i - 1) in ("(", "return", ">", "=>", "?", ":", "{", "}"):
                    self.edge(scope, self.names.get(nxt, f"{self.module}.{nxt}"), "calls", line, "inferred")
                elif t == "=" and nxt == "{" and self.at(i + 2).isidentifier() and self.at(i + 3) == "}" and self.in_tag(i):
                    self.edge(scope, self.names.get(self.at(i + 2), f"{self.module}.{self.at(i + 2)}"), "uses", line, "inferred")
                i += 1
                continue
            i += 1

    def in_tag(self, i: int) -> bool:
        """Whether an equals sign stands in a component's tag: back over names, strings and closed braces to its opening."""
        opened = {b: a for a, b in self.close.items()} if not hasattr(self, "_opened") else self._opened
        self._opened = opened
        j = i - 1
        while j >= 0:
            t = self.at(j)
            if t == "<":
                return self.at(j + 1)[:1].isalpha()
            if t == "}" and j in opened:
                j = opened[j]
            elif not (t.isidentifier() or t[:1] in "\"'`=.-" or t.isdigit()):
                return False
            j -= 1
        return False

    def functions_in(self, a: int) -> list[tuple[str, int, int | None]]:
        """(name, place, opening brace) of the functions that an object holds: methods, arrows and function expressions."""
        out, i, end = [], a + 1, self.close.get(a, a)
        while i < end:
            t, nxt = self.at(i), self.at(i + 1)
            if t.isidentifier() and self.at(i - 1) in ("{", ",", "async"):
                if nxt == "(" and (body := self.body_of(i + 1)) is not None:
                    out.append((t, i, body))
                    i = self.close.get(body, body)
                elif nxt == ":":
                    j = i + 2 + (self.at(i + 2) == "async")
                    if self.at(j) == "function":
                        j += 1 + (self.at(j + 1) != "(")
                        if (body := self.body_of(j)) is not None:
                            out.append((t, i, body))
                            i = self.close.get(body, body)
                    else:
                        k = self.close.get(j, j) + 1 if self.at(j) == "(" else j + 1
                        if self.at(k) == "=>":
                            out.append((t, i, k + 1 if self.at(k + 1) == "{" else None))
                            i = self.close.get(k + 1, k + 1) if self.at(k + 1) == "{" else k
            if self.at(i) in ("(", "[", "{"):
                i = self.close.get(i, i)
            i += 1
        return out

    def members(self, name: str, start: int, a: int, scope: str) -> int:
        """Functions of an object are functions named after it; what else it holds belongs to the scope."""
        at, end = a + 1, self.close.get(a, a)
        for own, place, body in self.functions_in(a):
            self.block(at, place, scope, "object")
            at = self.define(f"{name}.{own}", "function", place, body, scope) + 1
            if body is None:
                at = place + 1
        self.block(at, end, scope, "object")
        return end

    def arrow(self, i: int) -> int | None:
        """Place after the arrow of ``= (...) =>`` or ``= x =>``; null if there is none."""
        if self.at(i) == ":":
            while self.at(i) not in ("=", ";", ""):
                i += 1
        if self.at(i) != "=":
            return None
        i += 1
        i += self.at(i) == "async"
        j = self.close.get(i, i) + 1 if self.at(i) == "(" else i + 1
        if self.at(j) == ":":
            while self.at(j) not in ("=>", ";", ""):
                j += 1
        return j + 1 if self.at(j) == "=>" else None

    def call(self, i: int, scope: str, line: int) -> None:
        parts, j = [self.at(i)], i
        while self.at(j - 1) == "." and (self.at(j - 2).isidentifier() or self.at(j - 2) == "this"):
            parts.insert(0, self.at(j - 2))
            j -= 2
        head, rest = parts[0], parts[1:]
        if head == "this":
            owner = scope.rsplit(".", 1)[0]
            self.edge(scope, ".".join([owner, *rest]), "calls", line, "inferred")
        elif head in self.names:
            self.edge(scope, ".".join([self.names[head], *rest]), "calls", line, "resolved")
        else:
            self.edge(scope, ".".join(parts) if rest else f"{self.module}.{head}", "calls", line, "inferred")


def parse(files: DataFrame) -> DataFrame:
    """Node and edge rows of every file (path, text), as of Python files."""

    def rows(r: dict) -> list[dict]:
        try:
            return Script(r["path"], r["text"] or "").rows
        except (ValueError, RecursionError, IndexError) as e:
            return [{"kind": "error", "file_path": r["path"], "seq": 0, "error": str(e)}]

    return flat_map(files.select("path", "text"), rows, ROWS)
