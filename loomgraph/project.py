"""A project's relations in one place, and the tools that answer questions over them by name."""

from __future__ import annotations

import builtins
import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import extract, scan
from .functions.text import is_test_file, normalise_route, parent_of
from .operators import aggregates as A
from .operators import explain as E
from .operators import filters as P
from .operators import graph as G
from .operators import incremental as U
from .operators import joins as J
from .operators import mutate as M
from .operators import rules as R
from .plans.tables import materialise
from .schema import CHANGES, NOTES, RULES
from .sources import config_files, files, python_code, script_code


VERSION = "2"  # of the parsers and mappers: a project that another one made is read anew
COMPOSE_FILES = r"(^|/)(docker-)?compose[^/]*\.ya?ml$"
BUILD_FILES = r"(^|/)(Dockerfile[^/]*|[^/]*\.[Dd]ockerfile)$"
RULE_COLUMNS = ("id", "type", "description", "from_pattern", "to_pattern", "pattern", "threshold")
# What each type of rule needs, and the modules of the Node runtime.
RULE_NEEDS = {"no_dependency": ("from_pattern", "to_pattern"), "max_class_methods": ("threshold",), "required_test": ("pattern",), "no_circular_imports": ()}
NODE_BUILTINS = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events",
    "fs", "http", "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream",
    "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)


@dataclass
class Project:
    """nodes, edges and the logs beside them; ``flat`` has the last of parallel edges."""

    nodes: DataFrame
    edges: DataFrame
    changes: DataFrame | None = None
    notes: DataFrame | None = None
    sources: DataFrame | None = None
    rules: list[dict] = field(default_factory=list)  # id, type, description, and what the type needs
    routes: DataFrame | None = None
    bindings: DataFrame | None = None
    version: str = VERSION

    @property
    def flat(self) -> DataFrame:
        return G.collapse(self.edges, ["seq", "type", "confidence"])


def _parsed(files_: DataFrame) -> DataFrame:
    scripts = files_.filter(F.col("path").rlike(r"\.(js|jsx|ts|tsx)$"))
    return python_code.parse(files_.filter("path like '%.py'")).unionByName(script_code.parse(scripts))


def _nodes(rows: DataFrame) -> DataFrame:
    return U.keep_last(python_code.nodes(rows), ["id"], ["file_path", "seq"]).withColumn("hash", F.sha2(F.coalesce("source_code", F.lit("")), 256))


def _innermost(found: Callable[[DataFrame], DataFrame], nodes: DataFrame, text: str) -> DataFrame:
    """What is found in functions, methods and blocks, and in modules where none of theirs has it (method and raw path alike)."""
    place = nodes.select("id", "file_path")
    inner = found(nodes.filter("type in ('function', 'method', 'block')").withColumn("source_code", F.expr(text))).join(place, "id")
    outer = found(nodes.filter("type = 'module'").withColumn("source_code", F.expr(text))).join(place, "id")
    return inner.unionByName(outer.join(inner.select("file_path", "method", "raw").distinct(), ["file_path", "method", "raw"], "left_anti"))


def _routes(nodes: DataFrame, every: DataFrame) -> DataFrame:
    """(id, method, path) of registered routes: decorators belong to the function below them; prefixes of routers, at any depth,
    in Python files, of mounts in scripts. Calls count in scripts only."""
    own = nodes.filter(~is_test_file(F.col("file_path")))
    python, scripts = own.filter("file_path like '%.py'"), own.filter("file_path not like '%.py'")
    decorated = extract.routes(python.filter("type in ('function', 'method')").withColumn("source_code", F.col("decorators"))).join(own.select("id", F.col("file_path").alias("file")), "id")
    sources = every.filter("path like '%.py'").select(F.col("path").alias("file"), "text")
    names = python_code.module_files(python_code.imported_names(every.filter("path like '%.py'")), every)
    prefixed = J.prefixed_routes(decorated.withColumn("path", F.col("raw")), extract.router_includes(sources), names, extract.router_prefixes(sources))
    called = extract.mounted(_innermost(extract.routes, scripts, "source_code").drop("file_path"), extract.mounts(scripts))
    return prefixed.select("id", "method", normalise_route(F.col("path")).alias("path")).unionByName(called.select("id", "method", "path")).distinct()


def _variables(p_nodes: DataFrame) -> DataFrame:
    return extract.env_uses(p_nodes.filter("type != 'module'")).unionByName(extract.settings_fields(p_nodes.filter("type = 'class'")))


def build(spark: SparkSession, root: str) -> Project:
    """Reads a tree of sources: parsers, then suffix normalisation, then the mappers, each over all files at once."""
    every = materialise(files.scan(spark, root, None), "files")
    rows = materialise(_parsed(every), "parsed")
    nodes = materialise(_nodes(rows), "nodes")
    edges = J.normalise_ends(python_code.edges(rows), nodes)
    found = [edges]

    def add(df: DataFrame) -> None:
        found.append(df.withColumn("confidence", F.lit("inferred")).withColumn("source", F.lit("static")).withColumn("seq", F.lit(1 << 40).cast("long")))

    models = extract.model_tables(nodes)
    holders = models.select(F.col("table"), "id").dropDuplicates(["table"])
    working = nodes.filter(F.col("type").isin("function", "method", "block") & ~is_test_file(F.col("file_path")))
    python = working.filter("file_path like '%.py'")
    uses = config_files.table_uses(working, "id", scan.literals(F.col("source_code"))).unionByName(extract.orm_uses(python, models))
    add(config_files.sql_edges(uses.unionByName(extract.session_writes(python, models)), "id", holders))
    sql_nodes, sql_edges = config_files.sql_files(every)
    add(sql_edges)
    services = config_files.compose(every.filter(F.col("path").rlike(COMPOSE_FILES)))
    service_nodes, service_edges = config_files.service_graph(services)
    add(service_edges)
    build_nodes, build_edges = config_files.build_graph(config_files.dockerfile(every.filter(F.col("path").rlike(BUILD_FILES))))
    add(build_edges)
    jobs = config_files.workflows(every.filter(F.col("path").rlike(r"\.github/workflows/[^/]+\.ya?ml$")))
    job_nodes, job_edges = config_files.workflow_graph(jobs)
    add(job_edges)
    loaded = materialise(extract.bindings(nodes.filter(F.col("type").isin("module") & ~is_test_file(F.col("file_path")))), "bindings")
    bridges, native = extract.binding_graph(loaded)
    add(native)
    add(_variables(nodes).select(F.col("id").alias("from_node"), F.concat(F.lit("env."), "name").alias("to_node"), F.lit("uses_env").alias("type")).distinct())
    routes = materialise(_routes(nodes, every), "routes")
    calls = _innermost(extract.api_calls, nodes.filter(~is_test_file(F.col("file_path")) & ~F.endswith("file_path", F.lit(".py"))), "source_code").select("id", "method", "path")
    handlers = routes.select(F.col("id").alias("handler"), F.col("method").alias("verb"), F.col("path").alias("route"))
    add(J.route_matches(calls, handlers, "path", "route", "method", "verb").select(F.col("id").alias("from_node"), F.col("handler").alias("to_node"), F.lit("calls_api").alias("type")).distinct())
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    for extra in (sql_nodes, service_nodes, build_nodes, job_nodes, bridges):
        nodes = nodes.unionByName(extra.drop("metadata"), allowMissingColumns=True)
    return Project(materialise(nodes, "nodes"), materialise(out, "edges"), spark.createDataFrame([], CHANGES), spark.createDataFrame([], NOTES), every, [], routes, loaded)


def _logged(old: Project, merged: DataFrame) -> DataFrame:
    done = merged.filter("status != 'unchanged'").join(old.nodes.select("id", F.col("hash").alias("old_hash")), "id", "left")
    action = F.when(F.col("status") == "added", "created").otherwise(F.col("status"))
    log = done.select(F.xxhash64("id", "hash", "old_hash").alias("id"), F.current_timestamp().alias("timestamp"), F.col("id").alias("node_id"), action.alias("action"), "old_hash", F.col("hash").alias("new_hash"), "file_path")
    return materialise(old.changes.unionByName(log, allowMissingColumns=True), "changes")


def sync(old: Project, root: str, whole: bool = False) -> tuple[Project, DataFrame]:
    """The project as the tree is now, and (id, status) of its nodes.

    Files that haven't changed since (by time and size) keep their nodes and edges; only the others are read and parsed. Edges
    of changed and into deleted nodes go, those of mappers and those seen at run time stay; annotations are carried over and
    every change is logged. ``whole``: everything is read anew, the mappers included.
    """
    spark = old.nodes.sparkSession
    if whole:
        new = build(spark, root)
        kept = _kept(old)
        merged = materialise(U.sync_nodes(old.nodes, _without_annotations(new.nodes, old, kept), kept), "synced")
        edges = materialise(U.replace_static(old.edges, new.edges), "edges")
        done = replace(new, nodes=merged.filter("status != 'deleted'").drop("status"), edges=edges, changes=_logged(old, merged), notes=old.notes, rules=old.rules)
        return done, merged.select("id", "status")
    changed = materialise(U.pending(files.scan(spark, root, None, text=False), old.sources), "pending")
    if changed.isEmpty():
        return old, old.nodes.select("id", F.lit("unchanged").alias("status"))
    read = materialise(files.scan(spark, root, None, only=changed.filter("status != 'gone'").select("path")), "changed")
    return _merge(old, read, changed.select("path"), materialise(_parsed(read), "parsed"))


def ensure(p: Project, root: str) -> Project:
    """The project as the tree is now: read anew if another version of the parsers made it, else synced where files changed."""
    return sync(p, root, whole=p.version != VERSION)[0]


def _kept(p: Project) -> list[str]:
    return [c for c in ("summary", "role", "side_effects", "annotation_hash") if c in p.nodes.columns]


def _without_annotations(nodes: DataFrame, old: Project, kept: list[str]) -> DataFrame:
    for c in kept:
        nodes = nodes.withColumn(c, F.lit(None).cast(old.nodes.schema[c].dataType))
    return nodes


def _merge(old: Project, read: DataFrame, paths: DataFrame, rows: DataFrame) -> tuple[Project, DataFrame]:
    """The project with some files (paths) replaced by what was read and parsed of them; a path that wasn't read is gone."""
    kept = _kept(old)
    sources = materialise(old.sources.join(paths, "path", "left_anti").unionByName(read), "files")
    rest = old.nodes.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_anti")
    fresh = materialise(rest.drop(*kept).unionByName(_nodes(rows), allowMissingColumns=True), "nodes")
    merged = materialise(U.sync_nodes(old.nodes, _without_annotations(fresh, old, kept), kept), "synced")
    found = J.normalise_ends(python_code.edges(rows), fresh)
    edges = materialise(U.sync_edges(old.edges, found, merged.select("id", "status")), "edges")
    done = replace(old, nodes=merged.filter("status != 'deleted'").drop("status"), edges=edges, changes=_logged(old, merged), sources=sources)
    return done, merged.select("id", "status")


def _one(p: Project, node_id: str) -> DataFrame:
    return P.get_node(p.nodes, node_id).select("id")


def _cyclic(p: Project) -> DataFrame:
    return G.strong_components(p.flat.filter("type = 'imports'")).select(F.col("id").alias("module"))


def _dead(p: Project, file_prefix: str | None = None) -> DataFrame:
    return G.dead_code_report(p.nodes, p.flat, file_prefix)


def _vibecheck(p: Project) -> DataFrame:
    """One row: the six shares and counts, the score and its grade."""
    own = p.nodes.filter("type in ('function', 'method')").filter(~G.is_test("D") & ~F.startswith("name", F.lit("test_")) & ~F.contains(F.coalesce("file_path", F.lit("")), F.lit("eval/")))
    tested = own.join(G.tested(p.nodes, p.flat, "C"), "id", "left_semi").agg(F.count("*").alias("tested"))
    dead = _dead(p).agg(F.count("*").alias("dead"))
    n = own.agg(F.count("*").alias("functions"), F.sum((F.coalesce("docstring", F.lit("")) != "").cast("long")).alias("documented")).na.fill(0)
    cycles = G.cycles(p.flat.filter("type = 'imports'")).agg(F.count("*").alias("cycles"))
    bad = R.check(p.nodes, p.flat, p.rules).agg(F.count("*").alias("violations"))
    out = n.withColumn("_k", F.lit(1))
    for df in (tested, dead, cycles, bad, A.confidence_gate(p.edges).select("pct")):
        out = out.join(df.withColumn("_k", F.lit(1)), "_k")
    score = R.health_score(
        A.percent(F.col("tested"), F.col("functions"), 0.0), A.percent(F.col("dead"), F.col("functions"), 0.0), F.col("cycles"), F.col("violations"),
        F.lit(bool(p.rules)), A.percent(F.col("documented"), F.col("functions")), F.col("pct"),
    )
    return out.drop("_k").withColumn("score", F.round(score)).withColumn("grade", R.grade(F.col("score")))


def _fix_plan(p: Project, limit: int = 20) -> DataFrame:
    issue = R.requirement_issues(p.nodes.filter("type in ('function', 'method')")).filter("rule = 'io_without_error_handling'").select("severity", "rule", "id", F.lit(1.0).alias("points"))
    n = max(p.nodes.filter("type in ('function', 'method')").count(), 1)
    untested = p.nodes.filter("type in ('function', 'method')").filter(~G.is_test("C")).join(G.tested(p.nodes, p.flat, "C"), "id", "left_anti")
    actions = [issue, untested.select(F.lit("HIGH").alias("severity"), F.lit("add_test").alias("rule"), "id", F.lit(25.0 / n).alias("points"))]
    actions.append(_dead(p).select(F.lit("MEDIUM").alias("severity"), F.lit("remove_dead").alias("rule"), "id", F.lit(100.0 / n).alias("points")))
    bare = p.nodes.filter("type in ('function', 'method', 'class') and coalesce(docstring, '') = ''")
    actions.append(bare.select(F.lit("LOW").alias("severity"), F.lit("add_docs").alias("rule"), "id", F.lit(10.0 / n).alias("points")))
    if p.rules:
        actions.append(R.check(p.nodes, p.flat, p.rules).select(F.lit("CRITICAL").alias("severity"), F.col("rule_type").alias("rule"), F.col("violation").alias("id"), F.lit(3.0).alias("points")))
    return R.fix_plan(actions, limit)


def _class_members(p: Project) -> DataFrame:
    return p.nodes.filter("type = 'method'").withColumn("owner", parent_of(F.col("id")))


def _class_metrics(p: Project) -> DataFrame:
    lines = F.col("end_line") - F.col("start_line") + 1
    return A.percentile_rank(A.class_metrics(_class_members(p), "owner", "name", lines, F.startswith("name", F.lit("_"))), "methods")


def _edges_to(p: Project, types: list[str], near: str, far: str) -> DataFrame:
    return A.grouped_list(p.edges.filter(F.col("type").isin(types)), near, far, distinct=True)


def _rule(rule: dict | tuple) -> dict:
    """A rule with an id and a type that is known; a tuple (id, from_pattern, to_pattern) forbids a dependency."""
    if isinstance(rule, tuple):
        rule = dict(zip(("id", "from_pattern", "to_pattern"), rule))
    rule = {"type": "no_dependency", **rule}
    rule.setdefault("id", uuid.uuid4().hex[:8])
    if rule["type"] not in RULE_NEEDS or any(not rule.get(c) for c in RULE_NEEDS[rule["type"]]):
        raise ValueError(f"a rule is one of {', '.join(f'{k} {v}' for k, v in RULE_NEEDS.items())}, got {rule}")
    return rule


def _delete(p: Project, node_id: str) -> DataFrame:
    """Takes a node and the edges at it out of the project; gives the edges that went."""
    one = materialise(_one(p, node_id), "gone")
    near = materialise(P.get_edges(p.edges, node_id, "both"), "gone")
    nodes, edges = U.delete_nodes(p.nodes, p.edges, one)
    p.nodes, p.edges = materialise(nodes, "nodes"), materialise(edges, "edges")
    return near


def _update(p: Project, node_id: str, source: str) -> DataFrame:
    """Puts a new source into a node's file, parses the file anew and takes nodes, edges and the log along: (id, status) of the
    file's nodes that changed. A guard, or a file that no longer parses, leaves all as it was: one row says why."""
    spark = p.nodes.sparkSession
    say = lambda status: spark.createDataFrame([(node_id, status)], "id string, status string")
    own = P.get_node(p.nodes, node_id).select("file_path", "start_line", "end_line", M.update_guards(F.col("type"), F.col("source_code"), F.lit(source)).alias("refused")).first()
    if own is None or own["refused"]:
        return say("not_found" if own is None else own["refused"])
    lines = F.split("text", "\n")
    spliced = F.concat(F.slice(lines, F.lit(1), F.lit(own["start_line"] - 1)), F.array(F.lit(source.rstrip("\n"))), F.slice(lines, F.lit(own["end_line"] + 1), F.size(lines)))
    read = materialise(p.sources.filter(F.col("path") == own["file_path"]).withColumn("text", F.array_join(spliced, "\n")), "changed")
    rows = materialise(_parsed(read), "parsed")
    if not rows.filter("kind = 'error'").isEmpty():
        return say("rolled_back")
    done, status = _merge(p, read, read.select("path"), rows)
    for f in fields(Project):
        setattr(p, f.name, getattr(done, f.name))
    return status.filter("status != 'unchanged'")


def _grep(p: Project, pattern: str, glob: str | None = None, limit: int = 50) -> DataFrame:
    """(path, line, content, id): matching lines with the smallest node around each, if there is one."""
    hits = P.grep(p.sources, pattern, glob, limit)
    spans = p.nodes.filter("type != 'module'").select("id", F.col("file_path").alias("path"), "start_line", "end_line")
    inside = J.containing(hits.select("path", "line"), spans, ["path"], "line", "start_line", "end_line", ["path", "line"], ["id"]).select("path", "line", "id")
    return hits.join(inside, ["path", "line"], "left").orderBy("path", "line")


def _dependencies(p: Project) -> DataFrame:
    """(package, kind, usages, places) of imports that aren't the project's, and of external edges."""
    package = F.split("to_node", r"[./]")[0]
    parts = p.nodes.filter("type = 'module'").select(F.explode(F.split("id", r"\.")).alias("package")).distinct()
    out = p.edges.withColumn("package", package)
    foreign = out.filter("type = 'imports'").join(parts, "package", "left_anti").unionByName(out.filter("confidence = 'external' and type != 'imports'"))
    kind = A.package_kind(package, dir(builtins), sorted(sys.stdlib_module_names), list(NODE_BUILTINS))
    return A.dependencies(foreign.drop("package"), "file_path", package, kind)


def _env_map(p: Project, name: str | None = None) -> DataFrame:
    """(name, origin, items, n, undefined) of environment variables: where each is defined last, and who uses it."""
    services = config_files.compose(p.sources.filter(F.col("path").rlike(COMPOSE_FILES)))
    builds = config_files.dockerfile(p.sources.filter(F.col("path").rlike(BUILD_FILES)))
    given = extract.env_definitions(services, builds, config_files.env_file(p.sources.filter(F.col("path").rlike(r"(^|/)\.env[^/]*$"))))
    used = p.edges.filter("type = 'uses_env'").select(F.regexp_replace("to_node", r"^env\.", "").alias("name"), F.col("from_node").alias("user"))
    out = A.variables(given, used)
    return out if name is None else out.filter(F.col("name") == name)


#: What each tool does: (project, parameters) to a DataFrame.
TOOLS: dict[str, Callable[..., DataFrame]] = {
    # core
    "list_nodes": lambda p, kind=None, file_prefix=None, name_part=None: P.get_nodes(p.nodes, kind, file_prefix, name_part),
    "get_node": lambda p, node_id: P.hide_large_sources(P.get_node(p.nodes, node_id)),
    "resolve": lambda p, query, k=5: P.resolve_id(p.nodes, query, k),
    "get_connections": lambda p, node_id, direction="both": P.get_edges(p.edges, node_id, direction),
    "search": lambda p, query, columns=("name", "source_code", "docstring"): P.search(p.nodes, query, list(columns)).orderBy("file_path", "start_line"),
    "get_structure": lambda p, kinds=("class", "function", "method", "block"): A.structure(p.nodes, list(kinds)),
    "context": lambda p, node_id, depth=1: G.context(p.flat, _one(p, node_id), depth),
    "grep": _grep,
    # changes
    "patch_node": lambda p, node_id, part, replacement: M.patch(P.get_node(p.nodes, node_id), part, replacement),
    "update_node": _update,
    "delete_node": _delete,
    "add_node": lambda p, rows: p.nodes.unionByName(rows, allowMissingColumns=True),
    "rename": lambda p, node_id, old, new: M.rename(p.nodes, p.edges, node_id, old, new),
    "batch": lambda p, edits: M.batch(p.sources.select("path", "text"), edits),
    # analysis
    "check_impact": lambda p, node_id, depth=2: G.impact_report(p.flat, _one(p, node_id), depth),
    "impact_nodes": lambda p, node_id, depth=2: G.impact(p.flat, _one(p, node_id), depth),
    "validate_change": lambda p, changes: M.validate(changes),
    "diff": lambda p, listing: U.tree_diff(listing, p.sources, p.nodes),
    "health": lambda p: A.health(p.nodes, p.edges),
    "dependencies": _dependencies,
    "dead_code": _dead,
    "find_usages": lambda p, node_id: A.usages(p.edges.filter(F.col("to_node") == node_id), p.nodes),
    "nodes_by_type": lambda p: A.count_by(p.nodes, "type"),
    "edges_by_confidence": lambda p: A.count_by(p.edges, "confidence"),
    "unresolved": lambda p, limit=20: A.unresolved_sample(p.edges, limit),
    "circular_imports": lambda p: G.cycles(p.flat.filter("type = 'imports'")),
    # quality
    "vibecheck": _vibecheck,
    "nfr_check": lambda p, node_id=None: R.requirement_issues(p.nodes if node_id is None else P.get_node(p.nodes, node_id)),
    "warnings": lambda p: R.warnings(p.nodes, p.flat, _cyclic(p)),
    "test_coverage": lambda p: G.tested(p.nodes, p.flat, "C"),
    "security_scan": lambda p, findings: J.containing(findings.withColumn("_key", F.monotonically_increasing_id()), p.nodes.select("id", "file_path", "start_line", "end_line"), ["file_path"], "line", "start_line", "end_line", ["_key"], ["id"]),
    "fix_plan": _fix_plan,
    "generate_test_skeleton": lambda p, node_id: E.test_plan(p.nodes, p.edges.filter(F.col("from_node") == node_id), node_id),
    # architecture
    "arch_rule_add": lambda p, rule: (p.rules.append(_rule(rule)), TOOLS["arch_rule_list"](p))[1],
    "arch_rule_list": lambda p: p.nodes.sparkSession.createDataFrame([{c: r.get(c) for c in RULE_COLUMNS} for r in p.rules], RULES),
    "arch_rule_delete": lambda p, rule_id: (p.rules.__setitem__(slice(None), [r for r in p.rules if r["id"] != rule_id]), TOOLS["arch_rule_list"](p))[1],
    "arch_check": lambda p, node_id=None: R.check(p.nodes, p.flat, p.rules) if node_id is None else R.check_node(p.nodes, p.flat, p.rules, node_id),
    "class_metrics": lambda p, owner=None: _class_metrics(p) if owner is None else _class_metrics(p).filter(F.col("owner") == owner),
    "project_metrics": lambda p: A.project_metrics(_class_metrics(p), "methods"),
    "largest_classes": lambda p, limit=10: _class_metrics(p).orderBy(F.desc("methods"), "owner").limit(limit),
    "compare_classes": lambda p, owners: _class_metrics(p).filter(F.col("owner").isin(owners)),
    "class_dependencies": lambda p: A.class_dependencies(p.edges, _class_members(p), "owner"),
    "components": lambda p: A.cohesion(p.edges, p.nodes.withColumn("component", F.regexp_replace("file_path", r"/?[^/]*$", "")), "component"),
    # annotations
    "annotate": lambda p, node_id: R.annotate(P.get_node(p.nodes, node_id).withColumn("role", F.lit(None).cast("string")).withColumn("side_effects", F.lit(None).cast("array<string>"))),
    "save_annotation": lambda p, updates, columns=("summary", "role"): U.save_annotations(p.nodes, updates, list(columns)),
    "annotate_batch": lambda p, **kw: P.needs_annotation(p.nodes, **kw),
    # sessions, history
    "session_write": lambda p, notes: U.write_note(p.notes, notes),
    "session_read": lambda p: p.notes.orderBy(F.desc("updated_at")),
    "handoff": lambda p: A.grouped_list(p.changes, "file_path", "description", "timestamp"),
    "resume": lambda p: A.grouped_list(p.changes, "file_path", "action", "timestamp"),
    "history": lambda p, **kw: U.history(p.changes, **kw),
    "hotspots": lambda p, limit=20: A.hotspots(p.changes, G.tested(p.nodes, p.flat, "D").withColumnRenamed("id", "node_id"), "node_id", "timestamp", "action", limit),
    "node_timeline": lambda p, node_id, commits, limit=50: U.timeline([("change", p.changes.filter(F.col("node_id") == node_id).select("timestamp", "action")), ("commit", commits)], "timestamp", limit),
    # version control: the feeds of loomgraph.sources.feeds
    "blame": lambda p, blame: blame.groupBy("author").agg(F.count("*").alias("lines")),
    "node_history": lambda p, node_id, log: log.join(P.get_node(p.nodes, node_id).select(F.col("file_path").alias("path")), "path"),
    "commit_scope": lambda p, ranges: J.overlapping(p.nodes.filter("type != 'module'").select("id", "type", "name", F.col("file_path").alias("path"), "start_line", "end_line"), ranges.select("path", "start", "end"), "start_line", "end_line", "start", "end", 200, ["path"]).select("path", "type", "name", "id").distinct(),
    "recent_changes": lambda p, log, limit=50: log.orderBy(F.desc("date"), "path").limit(limit),
    # infrastructure
    "api_map": lambda p: _edges_to(p, ["calls_api"], "to_node", "from_node"),
    "db_map": lambda p: _edges_to(p, ["reads_table", "writes_table", "migrates"], "to_node", "from_node"),
    "env_map": _env_map,
    "ffi_map": lambda p, bridge=None: A.bridges(p.bindings if bridge is None else p.bindings.filter(F.col("bridge") == bridge)),
    "infra_map": lambda p, focus=None: A.infrastructure(p.nodes, p.edges, focus),
    # traces, explanations
    "trace": lambda p, calls: U.upsert_runtime(p.flat.withColumn("runtime_calls", F.lit(None).cast("long")).select("from_node", "to_node", "source", "runtime_calls"), calls),
    "trace_stats": lambda p: A.trace_stats(p.edges),
    "explain": lambda p, node_id: E.explain(P.get_node(p.nodes, node_id)),
}


def call(project: Project, tool: str, **params) -> DataFrame:
    """The result of a tool by name."""
    if tool not in TOOLS:
        raise KeyError(f"no tool {tool!r}; there are {', '.join(sorted(TOOLS))}")
    return TOOLS[tool](project, **params)
