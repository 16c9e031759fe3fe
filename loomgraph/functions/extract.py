"""Extraction from source text: routes, API calls, tables, environment variables, native bindings.

All of it reads what the scanners of ``scan`` find (calls with their own arguments, assignments, subscripts) and stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .text import normalise_route

# Names of functions, receivers, modules and options that the extraction knows.
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
CALL_VERBS = ("get", "post", "put", "delete", "patch")
ROUTE_VERBS = ("get", "post", "put", "delete", "patch", "options", "all")
HTTP_CLIENTS = ("axios", "client", "api", "http", "this.client", "this.api", "this.http")
FETCHERS = ("fetch", "apiRequest", "fetchApi", "request")
ROUTERS = ("APIRouter", "Blueprint")
PREFIX_OPTIONS = ("prefix", "url_prefix")
ENVIRONMENTS = ("os.environ", "environ", "process.env")
MEMBER_ENVIRONMENTS = ("process.env", "import.meta.env")
GETENV = ("os.getenv", "getenv", "os.environ.get", "environ.get")
ADDON_FOLDERS = ("native", "natives", "binding", "bindings", "addon", "addons")
CTYPES_LOADERS = ("ctypes.CDLL", "ctypes.WinDLL", "ctypes.OleDLL", "ctypes.PyDLL", "ctypes.cdll.LoadLibrary", "ctypes.windll.LoadLibrary")
WEBASSEMBLY_CALLS = ("instantiate", "instantiateStreaming", "compile")
PROCESS_MODULES = ("child_process", "node:child_process")
PROCESS_CALLS = ("spawn", "spawnSync", "execFile", "execFileSync", "exec", "execSync", "fork")
TABLE_NAMES, MODEL_BASES, DJANGO_BASES = ("__tablename__",), ("Base", "DeclarativeBase", "db.Model"), ("models.Model", "model.Model")
MANAGER_READS = ("filter", "exclude", "get", "all", "values", "values_list", "count", "exists", "aggregate", "annotate", "order_by", "first", "last")
MANAGER_WRITES = ("create", "update", "bulk_create", "bulk_update", "get_or_create", "update_or_create", "delete")
STATEMENT_READS, STATEMENT_WRITES = ("select",), ("insert", "update", "delete")
SESSIONS = ("db", "session", "sess", "async_session", "tx", "conn", "connection", "s", "db_session")
SESSION_WRITES, INSTANCE_WRITES = ("add", "delete", "merge"), ("save", "delete")
REST_TABLES, REST_WRITES = ("table", "from"), ("insert", "update", "upsert", "delete")
SETTINGS_BASE, FIELD_TYPES = "BaseSettings", ("str", "int", "float", "bool", "Literal")
UNKNOWN = "<unknown>"


def _last(dotted: Column) -> Column:
    return F.element_at(F.split(dotted, r"\."), -1)


def _full(call: Column) -> Column:
    """Dotted name of a call."""
    return F.when(call["receiver"] == "", call["name"]).otherwise(F.concat(call["receiver"], F.lit("."), call["name"]))


def _calls(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """One row for each call ``c`` of a source; ``n``: the call after it."""
    found = scan.calls(F.col(text))
    rows = df.select(F.col(key), *more, found.alias("_all")).select(key, *more, "_all", F.posexplode("_all").alias("_i", "c"))
    return rows.select(key, *more, "c", F.get("_all", F.col("_i") + 1).alias("n"), F.when(F.col("_i") > 0, F.get("_all", F.col("_i") - 1)).alias("p"))


def routes(nodes: DataFrame, key: str = "id", text: str = "source_code") -> DataFrame:
    """(key, method, path, raw, receiver) of routes that a source registers.

    Decorators at the start of a line by verb; ``.route`` gives a row for each method it lists, ANY without a list. Calls on
    any object by verb (ANY for ``all``) whose path is empty or starts with a slash, a star or a colon; a call on an HTTP
    client counts only if it has a handler too. Lines that are comments don't count; rows are distinct.
    """
    rows = _calls(nodes, key, text)
    c, args = F.col("c"), F.col("c.args")
    path, verb = scan.first_string(args), F.lower("c.name")
    listed = F.transform(scan.options(args, ("methods",)), F.upper)
    decorated = F.when(verb.isin(*VERBS), F.array(F.upper("c.name"))).when(verb == "route", F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("ANY"))))
    looks = (path == "") | F.substring(path, 1, 1).isin("/", "*", ":")
    handled = ~(c["receiver"].isin(*HTTP_CLIENTS) & scan.alone(args))
    called = F.when(verb.isin(*ROUTE_VERBS) & looks & handled, F.array(F.when(verb == "all", "ANY").otherwise(F.upper("c.name"))))
    methods = F.when(c["decorator"], decorated).otherwise(called)
    rows = rows.filter(scan.has_string(args) & ~c["receiver"].isin("", "."))
    rows = rows.select(key, F.explode(methods).alias("method"), path.alias("raw"), _last(c["receiver"]).alias("receiver"))
    return rows.select(key, "method", normalise_route(F.col("raw")).alias("path"), "raw", "receiver").distinct()


def api_calls(nodes: DataFrame, key: str = "id", text: str = "source_code") -> DataFrame:
    """(key, method, path, raw) of calls of an API: verbs of HTTP clients, and fetching functions, whose method is the ``method``
    option of the same call, else GET. Absolute addresses lose scheme and host; a path must start with a slash."""
    rows = _calls(nodes, key, text).filter(scan.has_string(F.col("c.args")) & ~F.col("c.decorator"))
    args, raw = F.col("c.args"), scan.first_string(F.col("c.args"))
    chosen = F.upper(scan.option(args, ("method",)))
    fetched = F.when(F.col("c.name").isin(*FETCHERS), F.when(chosen == "", "GET").otherwise(chosen))
    method = F.when(F.col("c.receiver").isin(*HTTP_CLIENTS) & F.lower("c.name").isin(*CALL_VERBS), F.upper("c.name")).otherwise(fetched)
    rows = rows.select(key, method.alias("method"), F.regexp_replace(raw, r"^https?://[^/]++", "").alias("path"), raw.alias("raw"))
    return rows.filter("method is not null and startswith(path, '/')").select(key, "method", normalise_route(F.col("path")).alias("path"), "raw").distinct()


def mounts(nodes: DataFrame, text: str = "source_code") -> DataFrame:
    """(receiver, prefix) of router variables that are mounted under a path: ``app.use("/prefix", router)``."""
    rows = _calls(nodes, text, text).filter((F.col("c.name") == "use") & scan.has_string(F.col("c.args")))
    router = F.regexp_extract("c.args", r"^\s*+[\"'`][^\"'`]*+[\"'`]\s*+,\s*+(\w++)", 1)
    return rows.select(router.alias("receiver"), F.rtrim(scan.first_string(F.col("c.args")), F.lit("/")).alias("prefix")).filter("receiver != ''").distinct()


def mounted(found: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Routes with the prefix that their receiver is mounted under, if any (one path for each mount)."""
    out = found.join(prefixes, "receiver", "left").withColumn("raw", F.concat(F.coalesce("prefix", F.lit("")), "raw"))
    return out.withColumn("path", normalise_route(F.col("raw"))).select(*found.columns).distinct()


def router_prefixes(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """(key, prefix): the prefix that a file's own router is made with; of several the first in order of the text."""
    rows = files.select(F.col(key), F.filter(scan.calls(F.col(text)), lambda c: c["name"].isin(*ROUTERS)).alias("_made"))
    rows = rows.select(key, F.transform("_made", lambda c: F.coalesce(F.nullif(scan.option(c["args"], PREFIX_OPTIONS), F.lit("")), scan.first_string(c["args"]))).alias("_made"))
    prefix = F.rtrim(F.get(F.filter("_made", lambda p: F.startswith(p, F.lit("/"))), F.lit(0)), F.lit("/"))
    return rows.select(key, prefix.alias("prefix")).filter("prefix is not null")


def router_includes(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """(key, router, prefix) of routers that a file mounts, by keyword or as a path and a router. router: the first part of a
    dotted name (``auth`` of ``auth.router``)."""
    rows = _calls(files, key, text)
    args, used = F.col("c.args"), F.col("c.name") == "use"
    router = F.when(F.col("c.name") == "include_router", scan.first_word(args)).when(used, F.regexp_extract(args, r"^\s*+[\"'`][^\"'`]*+[\"'`]\s*+,\s*+(\w++)", 1))
    prefix = F.when(used, scan.first_string(args)).otherwise(scan.option(args, ("prefix",)))
    return rows.select(key, router.alias("router"), F.rtrim(prefix, F.lit("/")).alias("prefix")).filter("router != ''").distinct()


def env_uses(df: DataFrame, key: str = "id", text: str = "source_code") -> DataFrame:
    """(key, name) of environment variables that a source reads: by a call, a string subscript or a member."""
    t = F.col(text)
    asked = F.transform(F.filter(scan.calls(t), lambda c: _full(c).isin(*GETENV)), lambda c: F.regexp_extract(c["args"], r"^\s*+[\"'](\w++)[\"']", 1))
    held = F.transform(F.filter(scan.subscripts(t), lambda s: s["owner"].isin(*ENVIRONMENTS)), lambda s: s["key"])
    named = F.transform(F.filter(scan.members(t), lambda m: m["owner"].isin(*MEMBER_ENVIRONMENTS)), lambda m: m["key"])
    return df.select(F.col(key), F.explode(F.array_distinct(F.concat(asked, held, named))).alias("name")).filter("name != ''")


def settings_fields(df: DataFrame, key: str = "id", text: str = "source_code") -> DataFrame:
    """(key, name) of variables that a settings class stands for: prefix and field name in capitals, or the field's own ``env``."""
    t = F.col(text)
    own = df.filter(F.exists(scan.classes(t), lambda k: F.exists(scan.bases_of(k["bases"]), lambda b: _last(b) == SETTINGS_BASE)))
    prefix = F.coalesce(F.get(F.transform(F.filter(scan.assignments(t), lambda a: a["name"] == "env_prefix"), lambda a: a["value"]), F.lit(0)), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"^ {4}\w++\s*+:"))
    kind = lambda x: F.regexp_extract(x, r":\s*+(?:Optional\s*+\[\s*+)?(\w++)", 1)
    fields = F.transform(F.filter(lines, lambda x: kind(x).isin(*FIELD_TYPES)), lambda x: F.upper(F.regexp_extract(x, r"^\s*+(\w++)", 1)))
    named = F.filter(F.transform(F.filter(scan.calls(t), lambda c: c["name"] == "Field"), lambda c: scan.option(c["args"], ("env",))), lambda x: x != "")
    return own.select(F.col(key), F.explode(F.array_distinct(F.concat(F.transform(fields, lambda f: F.concat(F.upper(prefix), f)), named))).alias("name"))


def _bridge(text: Column, calls: Column) -> Column:
    """Array of (bridge, raw) of a source, whose ``calls`` are a column of their own, so that they are scanned once."""
    tagged = lambda tag, values: F.transform(values, lambda x: F.struct(F.lit(tag).alias("bridge"), x.alias("raw")))
    modules = scan.modules(text, calls)
    strings = lambda test: F.transform(F.filter(calls, lambda c: test(c) & (scan.first_string(c["args"]) != "")), lambda c: scan.first_string(c["args"]))
    parts = lambda m: F.split(F.regexp_replace(m, "/index$", ""), "/")
    addon = lambda m: F.endswith(m, F.lit(".node")) | (F.startswith(m, F.lit(".")) & F.contains(m, F.lit("/")) & F.element_at(parts(m), -1).isin(*ADDON_FOLDERS))
    started = strings(lambda c: c["name"].isin(*PROCESS_CALLS))
    none = F.array().cast("array<string>")
    loaded = F.transform(F.filter(F.sequence(F.lit(1), F.size(calls)), lambda i: (F.get(calls, i)["name"] == "") & (F.get(calls, i - 1)["name"] == "require") & (scan.first_string(F.get(calls, i - 1)["args"]) == "bindings")), lambda i: scan.first_string(F.get(calls, i)["args"]))
    assembled = F.transform(F.filter(calls, lambda c: (c["receiver"] == "WebAssembly") & c["name"].isin(*WEBASSEMBLY_CALLS)), lambda c: F.lit("WebAssembly"))
    return F.concat(
        tagged("napi", F.filter(modules, addon)), tagged("koffi", strings(lambda c: _full(c) == "koffi.load")), tagged("ffi-napi", strings(lambda c: _full(c) == "ffi.Library")),
        tagged("wasm", F.concat(F.filter(modules, lambda m: F.endswith(m, F.lit(".wasm"))), assembled)),
        tagged("bindings", F.concat(strings(lambda c: (c["name"] == "bindings") & (c["receiver"] == "")), F.when(F.size(calls) > 0, loaded).otherwise(none))),
        tagged("ctypes", strings(lambda c: _full(c).isin(*CTYPES_LOADERS))), tagged("cffi", strings(lambda c: (c["name"] == "dlopen") & (c["receiver"] != ""))),
        tagged("child_process", F.when(F.exists(modules, lambda m: m.isin(*PROCESS_MODULES)), started).otherwise(none)),
    )


def bindings(df: DataFrame, key: str = "id", text: str = "source_code") -> DataFrame:
    """(key, bridge, module, raw, functions) of native libraries that a source loads; programs only where the module that starts
    them is imported. functions: sorted names that ``.func`` and ``.define`` bind in the source of a koffi library, else none."""
    bound = F.concat(
        F.transform(F.filter("_calls", lambda c: (c["name"] == "func") & (c["receiver"] != "")), lambda c: scan.second_string(c["args"])),
        F.transform(F.filter("_calls", lambda c: (c["name"] == "define") & (c["receiver"] != "")), lambda c: scan.first_string(c["args"])),
    )
    bound = F.array_sort(F.array_distinct(F.filter(bound, lambda x: x != "")))
    rows = df.select(F.col(key), F.col(text).alias("_text"), scan.calls(F.col(text)).alias("_calls"))
    rows = rows.select(key, bound.alias("_bound"), F.array_distinct(_bridge(F.col("_text"), F.col("_calls"))).alias("_found"))
    # outer: for an inner explode Spark infers a filter on its array and pushes it below, where all would be scanned again for each use
    rows = rows.select(key, "_bound", F.explode_outer("_found").alias("b")).filter("b is not null").select(key, "b.bridge", "b.raw", "_bound")
    parts = F.split(F.regexp_replace(F.split("raw", r"\s")[0], r"\.(node|wasm|so|dll|dylib)(\.\d+)*$", ""), "/")
    last = F.element_at(parts, -1)
    stem = F.when((last == "index") & (F.size(parts) > 1), F.get(parts, F.size(parts) - 2)).otherwise(last)
    functions = F.when(F.col("bridge") == "koffi", F.col("_bound")).otherwise(F.array().cast("array<string>"))
    return rows.select(key, "bridge", F.regexp_replace(stem, "^lib", "").alias("module"), "raw", functions.alias("functions")).distinct()


def binding_graph(found: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    node = F.concat(F.lit("native."), "bridge", F.lit("."), "module")
    nodes = found.select(node.alias("id"), F.lit("module").alias("type"), F.col("module").alias("name"), F.col("bridge").alias("file_path")).distinct()
    return nodes, found.select(F.col(key).alias("from_node"), node.alias("to_node"), F.lit("calls_native").alias("type")).distinct()


def model_tables(nodes: DataFrame, key: str = "id", text: str = "source_code", name: str = "name") -> DataFrame:
    """(key, model, table) of classes that stand for a table: by the name they state, Django's (class and an s), or the class's own."""
    t = F.col(text)
    stated = lambda names: F.get(F.transform(F.filter(scan.assignments(t), lambda a: a["name"].isin(*names)), lambda a: a["value"]), F.lit(0))
    derived = lambda bases: F.get(F.transform(F.filter(scan.classes(t), lambda k: F.exists(scan.bases_of(k["bases"]), lambda b: b.isin(*bases))), lambda k: F.lower(k["name"])), F.lit(0))
    rows = nodes.filter("type = 'class'").select(F.col(key), F.col(name).alias("model"), stated(TABLE_NAMES).alias("a"), stated(("db_table",)).alias("b"), derived(DJANGO_BASES).alias("d"), derived(MODEL_BASES).alias("s"))
    table = F.coalesce(F.col("a"), F.when(F.col("d").isNotNull(), F.coalesce("b", F.concat("d", F.lit("s")))), F.col("s"))
    return rows.select(key, "model", table.alias("table")).filter("table is not null")


def variable_models(df: DataFrame, key: str = "id", text: str = "source_code") -> DataFrame:
    """(key, variable, model): variables that a source binds to a new object or to the result of a query."""
    t = scan.code(F.col(text))
    bound = F.regexp_extract_all(t, F.lit(r"(?<![\w.])(\w++\s*+(?::\s*+[\w.]++\s*+)?=(?!=)[\s(]*+(?:await\s++)?[\w.]++\s*+\(\s*+\w*+)"), F.lit(1))
    rows = df.select(F.col(key), F.explode(F.array_distinct(bound)).alias("b"))
    call, arg = F.regexp_extract("b", r"([\w.]++)\s*+\(\s*+\w*+$", 1), F.regexp_extract("b", r"(\w*+)$", 1)
    model = F.when(F.col("call").rlike(r"\.(query|get)$"), F.col("arg")).when(F.col("call").rlike(r"^[A-Z]\w*$"), F.col("call"))
    rows = rows.select(key, F.regexp_extract("b", r"^(\w++)", 1).alias("variable"), call.alias("call"), arg.alias("arg"))
    return rows.select(key, "variable", model.alias("model")).filter(F.col("model").rlike("^[A-Z]")).distinct()


def _with_tables(found: DataFrame, models: DataFrame, key: str) -> DataFrame:
    """(key, op, table) of (key, op, model): the model's table, or for a capitalised name unknown its own with an s."""
    known = models.select("model", "table").dropDuplicates(["model"])
    table = F.coalesce("table", F.when(F.col("model").rlike("^[A-Z]"), F.concat(F.lower("model"), F.lit("s"))))
    return found.join(known, "model", "left").select(key, "op", table.alias("table")).filter("table is not null").distinct()


def orm_uses(nodes: DataFrame, models: DataFrame, key: str = "id", text: str = "source_code") -> DataFrame:
    """(key, op, table) of object-relational calls: managers, queries, statements of a model, and table calls of a REST client.

    A capitalised model that isn't known has the table of its name and an s.
    """
    rows = _calls(nodes, key, text)
    name, receiver, args = F.col("c.name"), F.col("c.receiver"), F.col("c.args")
    manager = F.regexp_extract(receiver, r"(?:^|\.)(\w++)\.objects$", 1)
    managed = F.when((manager != "") & name.isin(*MANAGER_READS), F.struct(F.lit("read").alias("op"), manager.alias("model"))).when((manager != "") & name.isin(*MANAGER_WRITES), F.struct(F.lit("write").alias("op"), manager.alias("model")))
    word = scan.first_word(args)
    statement = lambda test, op: F.when(test & word.rlike("^[A-Z]"), F.struct(F.lit(op).alias("op"), word.alias("model")))
    asked = F.coalesce(managed, statement((name == "query") & (receiver != ""), "read"), statement(name.isin(*STATEMENT_READS), "read"), statement(name.isin(*STATEMENT_WRITES) & (manager == ""), "write"))
    by_model = rows.select(key, asked.alias("u")).filter("u is not null").select(key, "u.op", "u.model")
    op = F.when((F.col("n.receiver") == ".") & F.col("n.name").isin(*REST_WRITES), "write").otherwise("read")
    by_client = rows.filter(name.isin(*REST_TABLES) & (receiver != "") & scan.has_string(args)).select(key, op.alias("op"), scan.first_string(args).alias("table"))
    return _with_tables(by_model, models, key).unionByName(by_client).distinct()


def session_writes(df: DataFrame, models: DataFrame, key: str = "id", text: str = "source_code") -> DataFrame:
    """(key, op, table) of ``session.add(x)`` and the like: x is a model, or was bound to one. What isn't known has the table
    ``<unknown>``: where the receiver is a session, for ``add_all``, and for an object's own ``save()`` and ``delete()``."""
    rows = _calls(df, key, text).filter("c.receiver != ''")
    name, args = F.col("c.name"), F.col("c.args")
    session = F.lower(_last(F.col("c.receiver"))).isin(*SESSIONS)
    given = rows.filter(name.isin(*SESSION_WRITES) & (scan.first_word(args) != "")).select(key, session.alias("session"), scan.first_word(args).alias("variable"))
    bound = given.join(variable_models(df, key, text), [key, "variable"], "left").withColumn("model", F.coalesce("model", "variable"))
    known = models.select("model", "table").dropDuplicates(["model"])
    table = F.coalesce("table", F.when(F.col("model").rlike("^[A-Z]"), F.concat(F.lower("model"), F.lit("s"))), F.when(F.col("session"), F.lit(UNKNOWN)))
    resolved = bound.join(known, "model", "left").select(key, table.alias("table")).filter("table is not null")
    loose = rows.filter((name == "add_all") | (name.isin(*INSTANCE_WRITES) & (F.trim(args) == "") & ~F.endswith("c.receiver", F.lit(".objects")) & (F.col("c.receiver") != "."))).select(key, F.lit(UNKNOWN).alias("table"))
    return resolved.unionByName(loose).select(key, F.lit("write").alias("op"), "table").distinct()


def script_settings(files: DataFrame) -> DataFrame:
    """(path, text) of the settings that hold path aliases: tsconfig.json, or jsconfig.json in folders without one."""
    name = F.element_at(F.split("path", "/"), -1)
    own = files.filter(name.isin("tsconfig.json", "jsconfig.json")).select("path", "text", F.regexp_replace("path", "[^/]*$", "").alias("_folder"))
    first = own.groupBy("_folder").agg(F.max_by(F.struct("path", "text"), F.element_at(F.split("path", "/"), -1)).alias("s"))  # t is after j
    return first.select("s.path", "s.text")


def aliases(configs: DataFrame, text: str = "text") -> DataFrame:
    """(prefix, targets) of the path aliases in TypeScript settings (``"@/*": ["src/*", "lib/*"]``), targets in their order."""
    paths = F.from_json(F.get_json_object(text, "$.compilerOptions.paths"), "map<string,array<string>>")
    base = F.coalesce(F.get_json_object(text, "$.compilerOptions.baseUrl"), F.lit("."))
    rows = configs.select(base.alias("base"), F.explode(paths).alias("alias", "targets"))
    folders = F.transform("targets", lambda t: F.regexp_replace(F.concat("base", F.lit("/"), t), r"^(\./)+|/?\*$", ""))
    return rows.select(F.regexp_replace("alias", r"\*$", "").alias("prefix"), folders.alias("targets"))


def resolve_alias(imports: DataFrame, known: DataFrame, spec: str = "spec") -> DataFrame:
    """Imports with ``paths``, the file paths that the longest alias of theirs may mean, and ``path``, the first of them; the spec
    itself without one.

    An alias is a spec's prefix up to a slash, so that prefixes of a spec are keys and the join is one of equality.
    """
    rows = imports.withColumn("_spec", F.col(spec))
    parts = F.split("_spec", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    hits = rows.select("_spec").distinct().select("_spec", F.explode(heads).alias("prefix"))
    best = hits.join(known, "prefix").groupBy("_spec").agg(F.max_by(F.struct("prefix", "targets"), F.length("prefix")).alias("b"))
    rest = F.expr("substring(_spec, length(b.prefix) + 1)")
    paths = F.when(F.col("b").isNotNull(), F.transform("b.targets", lambda t: F.concat(t, F.lit("/"), rest))).otherwise(F.array("_spec"))
    return rows.join(best, "_spec", "left").withColumn("paths", paths).withColumn("path", F.get("paths", F.lit(0))).drop("_spec", "b")


# What may follow an import's path in the file's name, in the order in which it is tried; what is never code.
PROBED = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
STYLES = (".css", ".scss", ".sass", ".less")


def probe(resolved: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, file) of resolved imports (key, paths): the first file there is, over the paths in their order and the endings in
    theirs; null if there is none, or for style sheets."""
    code = F.filter("paths", lambda p: ~F.regexp_extract(p, r"(\.[a-z]+)$", 1).isin(*STYLES))
    names = F.flatten(F.transform(code, lambda p: F.transform(F.array(*(F.lit(e) for e in PROBED)), lambda e: F.concat(p, e))))
    tried = resolved.select(key, F.posexplode(names).alias("at", "file"))
    there = tried.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    found = there.groupBy(key).agg(F.min_by("file", "at").alias("file"))
    return resolved.select(key).distinct().join(found, key, "left")


def env_definitions(services: DataFrame, builds: DataFrame, variables: DataFrame) -> DataFrame:
    """(name, origin) of variables that compose services, container builds and environment files define."""
    a = services.select(F.explode("env").alias("name"), F.concat(F.lit("service:"), "service").alias("origin"))
    b = builds.select(F.explode("env").alias("name"), F.concat(F.lit("build:"), "path").alias("origin"))
    return a.unionByName(b).unionByName(variables.select(F.col("key").alias("name"), F.concat(F.lit("file:"), "path").alias("origin"))).distinct()
