"""Scanners over source text, as JVM expressions: calls with their arguments, assignments, subscripts, string literals, classes.

A call is found with one replacement that marks it (receiver, name, arguments in a look-ahead), so that calls in another's
arguments are found too; the marked text is then cut. All loops in the patterns are possessive: no backtracking, no deep stacks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CUT, FIELD = "\x01", "\x02"
STRING = r""""[^"\n]*+"|'[^'\n]*+'|`[^`]*+`"""
_Q, _NOT_Q = "[\"'`]", "[^\"'`]"


def _arguments(depth: int = 5) -> str:
    """What stands between a call's parentheses: strings, and parentheses in so many levels."""
    inner = rf"(?:{STRING}|[^()\"'`]++|{_Q})*+"
    for _ in range(depth):
        inner = rf"(?:{STRING}|\({inner}\)|[^()\"'`]++|{_Q})*+"
    return inner


_CALL = rf"(?m)(^[ \t]*+@|(?<!@))((?:\.|(?<![\w$.]))(?:[\w$]++\??\.)*+)([\w$]++|(?<=\)))(?:<[^<>()\n]{{1,200}}+>)?[ \t]*+\((?=({_arguments()}))"


def code(text: Column) -> Column:
    """The text without lines that are comments as a whole (``#``, ``//``)."""
    return F.regexp_replace(text, r"(?m)^[ \t]*+(?:#|//)[^\n]*+$", "")


def calls(text: Column) -> Column:
    """Array of (decorator, receiver, name, args) in order of the text. receiver: dotted, without the last dot; ``.`` for a call on
    another's result. name: empty for a call of a call's result."""
    plain = F.translate(code(text), CUT + FIELD, "")
    marked = F.regexp_replace(plain, _CALL, CUT + FIELD.join(("$1", "$2", "$3", "$4")) + CUT)
    cut = F.filter(F.split(marked, CUT, -1), lambda x, i: i % 2 == 1)

    def one(piece: Column) -> Column:
        part = F.split(piece, FIELD, -1)
        receiver = F.get(part, F.lit(1))
        plain = F.when(F.startswith(receiver, F.lit(".")), ".").otherwise(F.regexp_replace(F.replace(receiver, F.lit("?"), F.lit("")), r"\.$", ""))
        return F.struct((F.get(part, F.lit(0)) != "").alias("decorator"), plain.alias("receiver"), F.get(part, F.lit(2)).alias("name"), F.get(part, F.lit(3)).alias("args"))

    return F.transform(cut, one)


def has_string(args: Column) -> Column:
    """Whether the first argument is a string."""
    return args.rlike(rf"^\s*+[a-zA-Z]?{_Q}")


def first_string(args: Column) -> Column:
    """The first argument, if it is a string; else empty."""
    return F.regexp_extract(args, r"(?s)^\s*+[a-zA-Z]?([\"'`])(.*?)\1", 2)


def second_string(args: Column) -> Column:
    return F.regexp_extract(args, rf"^[^,]*+,\s*+{_Q}({_NOT_Q}*+){_Q}", 1)


def first_word(args: Column) -> Column:
    """The identifier that the arguments begin with; of a dotted one the first part."""
    return F.regexp_extract(args, r"^\s*+([A-Za-z_$][\w$]*+)", 1)


def alone(args: Column) -> Column:
    """Whether there is one argument at most: no comma but in strings and brackets."""
    outer = F.regexp_replace(args, STRING, "")
    for _ in range(3):
        outer = F.regexp_replace(outer, r"\([^()]*+\)|\[[^\[\]]*+\]|\{[^{}]*+\}", "")
    return ~F.contains(outer, F.lit(","))


def option(args: Column, names: tuple[str, ...]) -> Column:
    """String value of an option (``name="x"``, ``name: 'x'``) of these names; empty without one."""
    return F.regexp_extract(args, rf"(?i)\b(?:{'|'.join(names)})\s*+[:=]\s*+{_Q}({_NOT_Q}*+){_Q}", 1)


def options(args: Column, names: tuple[str, ...]) -> Column:
    """String values of an option that holds a list."""
    inner = F.regexp_extract(args, rf"(?i)\b(?:{'|'.join(names)})\s*+[:=]\s*+[\[({{]([^\])}}]*+)", 1)
    return F.regexp_extract_all(inner, F.lit(rf"{_Q}({_NOT_Q}*+){_Q}"), F.lit(1))


def _both(text: Column, pattern: str, names: tuple[str, str], groups: tuple[int, int]) -> Column:
    first, second = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups)
    return F.zip_with(first, second, lambda a, b: F.struct(a.alias(names[0]), b.alias(names[1])))


def assignments(text: Column) -> Column:
    """Array of (name, value): names that get a string."""
    return _both(code(text), r"([\w$]++)\s*+=(?!=)\s*+([\"'])([^\"'\n]*+)\2", ("name", "value"), (1, 3))


def subscripts(text: Column) -> Column:
    """Array of (owner, key): string subscripts of dotted names."""
    return _both(code(text), r"([\w$]++(?:\.[\w$]++)*+)\s*+\[\s*+([\"'`])([\w$]++)\2\s*+\]", ("owner", "key"), (1, 3))


def members(text: Column) -> Column:
    """Array of (owner, key): dotted names with at least two dots, cut at the last."""
    return _both(code(text), r"(?<![\w$.])([\w$]++\.[\w$]++(?:\.[\w$]++(?=\.))*+)\.([\w$]++)", ("owner", "key"), (1, 2))


def classes(text: Column) -> Column:
    """Array of (name, bases) of class headers in parentheses."""
    return _both(code(text), r"\bclass\s++(\w++)\s*+\(([^()]*+)\)", ("name", "bases"), (1, 2))


def bases_of(header: Column) -> Column:
    return F.transform(F.split(header, ","), F.trim)


def modules(text: Column, found: Column | None = None) -> Column:
    """Module names after ``from``, and in ``require(...)`` and ``import(...)``. found: the text's ``calls``, if they are a column already."""
    plain = code(text)
    loaded = F.filter(calls(text) if found is None else found, lambda c: (c["receiver"] == "") & c["name"].isin("require", "import"))
    return F.concat(F.regexp_extract_all(plain, F.lit(rf"\bfrom\s++{_Q}({_NOT_Q}++){_Q}"), F.lit(1)), F.transform(loaded, lambda c: first_string(c["args"])))


def literals(text: Column) -> Column:
    """All string literals of the text, each ended by a semicolon."""
    found = F.regexp_extract_all(code(text), F.lit(rf"(?s)\"\"\".*?\"\"\"|'''.*?'''|{STRING}"), F.lit(0))
    return F.concat(F.array_join(F.transform(found, lambda s: F.regexp_replace(s, rf"^{_Q}++|{_Q}++$", "")), " ; "), F.lit(" ;"))
