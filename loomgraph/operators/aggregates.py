"""Aggregations over nodes, edges and the change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parent_of
from ..plans.tables import materialise
from .graph import is_test
from .joins import public_members


def percent(part: Column, whole: Column, empty: float = 100.0) -> Column:
    """Part of the whole in percent, one decimal place."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 1)).otherwise(F.lit(empty))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sizes, share of internal edges that are resolved, share of definitions with a docstring."""
    definition = F.col("type").isin("function", "method", "class")
    a = nodes.agg(
        F.count("*").alias("nodes"), F.sum(definition.cast("long")).alias("definitions"),
        F.sum((definition & (F.coalesce("docstring", F.lit("")) != "")).cast("long")).alias("documented"),
    )
    b = edges.agg(
        F.count("*").alias("edges"), F.sum((F.col("confidence") != "external").cast("long")).alias("internal"),
        F.sum((F.col("confidence") == "resolved").cast("long")).alias("resolved"),
    )
    out = a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k").na.fill(0)
    return out.withColumn("resolved_pct", percent(F.col("resolved"), F.col("internal"))).withColumn("documented_pct", percent(F.col("documented"), F.col("definitions")))


def confidence_gate(edges: DataFrame, least: float = 70.0) -> DataFrame:
    """One row: (internal, resolved, pct, warn, band); ok from 90 %, warn from 70 %, else fail."""
    out = edges.agg(
        F.coalesce(F.sum((F.col("confidence") != "external").cast("long")), F.lit(0)).alias("internal"),
        F.coalesce(F.sum((F.col("confidence") == "resolved").cast("long")), F.lit(0)).alias("resolved"),
    ).withColumn("pct", percent(F.col("resolved"), F.col("internal")))
    return out.withColumn("warn", F.col("pct") < least).withColumn("band", F.when(F.col("pct") >= 90, "ok").when(F.col("pct") >= 70, "warn").otherwise("fail"))


def dependencies(edges: DataFrame, origin: str, package: Column, kind: Column) -> DataFrame:
    """(package, kind, usages, places): how often, and from how many distinct origins, a package is used."""
    rows = edges.withColumn("package", package).withColumn("kind", kind)
    return rows.groupBy("package", "kind").agg(F.count("*").alias("usages"), F.countDistinct(origin).alias("places"))


def package_kind(package: Column, builtins: list[str], stdlib: list[str], runtime: list[str]) -> Column:
    return F.when(package.isin(builtins), "builtin").when(package.isin(stdlib), "stdlib").when(package.isin(runtime), "node_builtin").otherwise("third-party")


def by_file(df: DataFrame, group: str, item: str, limit: int | None = None) -> DataFrame:
    """(group, items, n): sorted distinct items of each group, comma-separated, and their number."""
    return df.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(item)), ",").alias("items"), F.countDistinct(item).alias("n"))


def structure(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """(file_path, one count for each kind, total); the rolled-up total has a null path."""
    counts = [F.sum((F.col("type") == k).cast("long")).alias(k) for k in kinds]
    return nodes.rollup("file_path").agg(*counts, F.count("*").alias("total"))


def class_metrics(members: DataFrame, owner: str, name: str, lines: Column, private: Column) -> DataFrame:
    """(owner, methods, lines, public, private) of an owner's members."""
    return members.groupBy(owner).agg(
        F.count("*").alias("methods"), F.sum(lines).cast("long").alias("lines"), F.sum((~private).cast("long")).alias("public"), F.sum(private.cast("long")).alias("private")
    )


def class_dependencies(edges: DataFrame, members: DataFrame, owner: str, k: int = 20) -> DataFrame:
    """(owner, dependency_count, dependencies, internal_calls): distinct ends of edges that leave an owner's members (id, owner) for
    outside of it, the first k of them by name, and calls that stay inside."""
    out = edges.join(members.select(F.col("id").alias("from_node"), F.col(owner).alias("_owner")), "from_node")
    inside = F.startswith("to_node", F.concat("_owner", F.lit(".")))
    calls = out.groupBy("_owner").agg(F.sum((inside & (F.col("type") == "calls")).cast("long")).alias("internal_calls"))
    far = out.filter(~inside).select("_owner", "to_node").distinct()
    named = grouped_list(far, "_owner", "to_node", most=k).select("_owner", F.col("n").alias("dependency_count"), F.col("items").alias("dependencies"))
    both = calls.join(named, "_owner", "left").select(F.col("_owner").alias(owner), F.coalesce("dependency_count", F.lit(0)).alias("dependency_count"), F.coalesce("dependencies", F.lit("")).alias("dependencies"), "internal_calls")
    return both


def unresolved_sample(edges: DataFrame, k: int = 20) -> DataFrame:
    """(from_node, to_node, type): the first k edges whose end wasn't resolved."""
    return edges.filter("confidence = 'unresolved'").select("from_node", "to_node", "type").distinct().orderBy("from_node", "to_node", "type").limit(k)


def name_prefixes(members: DataFrame, owner: str, name: str, k: int = 10) -> DataFrame:
    """(owner, prefix, n): the commonest first words of the members' names, at most k of each owner."""
    counts = members.groupBy(owner, F.split(name, "_")[0].alias("prefix")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("n"), "prefix"))
    return counts.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def running_counts(df: DataFrame, value: str) -> DataFrame:
    """(value, _n, _up, _total): how often each distinct value occurs, rows up to it, and all rows.

    The distinct values are dealt out by range; each range sums up on its own, and the ranges' totals (one row each) meet.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    ranges = materialise(counts.repartitionByRange(value).withColumn("_range", F.spark_partition_id()), "ranges")
    every = Window.partitionBy(F.lit(0)).orderBy("_range")
    sums = ranges.groupBy("_range").agg(F.sum("_n").alias("_s")).select(
        "_range", (F.sum("_s").over(every) - F.col("_s")).alias("_before"), F.sum("_s").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total")
    )
    own = F.sum("_n").over(Window.partitionBy("_range").orderBy(value))
    return ranges.withColumn("_own", own).join(F.broadcast(sums), "_range").select(value, "_n", (F.col("_before") + F.col("_own")).alias("_up"), "_total")


def index_percentile(df: DataFrame, value: str, share: float, group: list[str] | None = None) -> DataFrame:
    """The value at place floor(n * share) of the sorted values (from 0), without interpolation; the last one at most.

    Values are first counted, so that windows run over distinct values, however many rows there are.
    """
    if group:
        part = Window.partitionBy(*group)
        counts = df.groupBy(*group, value).agg(F.count("*").alias("_n"))
        counts = counts.withColumn("_up", F.sum("_n").over(part.orderBy(value))).withColumn("_total", F.sum("_n").over(part))
    else:
        counts = running_counts(df, value)
    place = F.least(F.floor(F.col("_total") * F.lit(share)), F.col("_total") - 1)
    return counts.withColumn("_place", place).filter((F.col("_up") > F.col("_place")) & (F.col("_up") - F.col("_n") <= F.col("_place"))).select(*(group or []), value)


def median(df: DataFrame, value: str) -> DataFrame:
    """One row: the middle value, or the mean of the two in the middle, by running counts of distinct values."""
    counts = running_counts(df.filter(F.col(value).isNotNull()), value)
    holds = lambda place: ((F.col("_up") > place) & (F.col("_up") - F.col("_n") <= place)).cast("int")
    parts = holds(F.floor((F.col("_total") - 1) / 2)) + holds(F.floor(F.col("_total") / 2))
    return counts.agg((F.sum(F.col(value) * parts) / 2).alias("median"))


def project_metrics(df: DataFrame, value: str) -> DataFrame:
    """One row: n, mean and median (one place), smallest, largest, p90, p95."""
    base = df.agg(F.count(value).alias("n"), F.round(F.avg(value), 1).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    out = base.withColumn("_k", F.lit(1)).join(median(df, value).select(F.lit(1).alias("_k"), F.round("median", 1).alias("median")), "_k", "left")
    out = out.select("n", "mean", "median", "least", "most", "_k")
    for share, name in ((0.9, "p90"), (0.95, "p95")):
        out = out.join(index_percentile(df, value, share).select(F.lit(1).alias("_k"), F.col(value).alias(name)), "_k", "left")
    return out.drop("_k")


def percentile_rank(df: DataFrame, value: str) -> DataFrame:
    """Share of values below each one, in percent, one place. Values are counted first."""
    below = (F.col("_up") - F.col("_n")) * 100.0 / F.col("_total")
    ranks = running_counts(df, value).select(F.col(value).alias("_v"), F.round(below, 1).alias("percentile_rank"))
    return df.join(ranks, df[value] == ranks["_v"], "left").drop("_v")


def cohesion(edges: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """(group, internal, external, cohesion): edges out of a group's nodes that stay inside, or don't."""
    own = nodes.select("id", F.col(group).alias("_g"))
    both = edges.join(own.select(F.col("id").alias("from_node"), F.col("_g").alias("_from")), "from_node").join(own.select(F.col("id").alias("to_node"), F.col("_g").alias("_to")), "to_node", "left")
    inside = F.coalesce(F.col("_from") == F.col("_to"), F.lit(False))
    out = both.groupBy(F.col("_from").alias(group)).agg(F.sum(inside.cast("long")).alias("internal"), F.sum((~inside).cast("long")).alias("external"))
    return out.withColumn("cohesion", F.round(F.col("internal") / (F.col("internal") + F.col("external")), 2))


def component_members(edges: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """(group, id, public): the nodes of each group, and whether edges from another group lead to them."""
    seen = public_members(edges, nodes, group).withColumn("_public", F.lit(True))
    return nodes.select(F.col(group), "id").join(seen, [group, "id"], "left").select(group, "id", F.coalesce("_public", F.lit(False)).alias("public"))


def annotation_stats(nodes: DataFrame, annotated: Column, stale: Column) -> DataFrame:
    out = nodes.agg(F.count("*").alias("total"), F.coalesce(F.sum(annotated.cast("long")), F.lit(0)).alias("annotated"), F.coalesce(F.sum(stale.cast("long")), F.lit(0)).alias("stale"))
    return out.withColumn("coverage_pct", percent(F.col("annotated"), F.col("total"), 0.0))


def annotated_by(nodes: DataFrame, column: str) -> DataFrame:
    """(column, total, annotated): annotation by type, or by role; annotated: a summary or a role is there."""
    has = F.col("summary").isNotNull() | F.col("role").isNotNull()
    return nodes.groupBy(column).agg(F.count("*").alias("total"), F.sum(has.cast("long")).alias("annotated"))


def runtime_calls(edges: DataFrame) -> DataFrame:
    """One row: all calls that were counted at run time."""
    return edges.agg(F.coalesce(F.sum("runtime_calls"), F.lit(0)).alias("runtime_calls"))


def trace_stats(edges: DataFrame) -> DataFrame:
    """One row: edges by source, and how many static ones were seen at run time."""
    side = lambda s: F.coalesce(F.sum((F.col("source") == s).cast("long")), F.lit(0)).alias(s)
    out = edges.agg(side("static"), side("runtime"), side("both"))
    return out.withColumn("confirmed_pct", percent(F.col("both"), F.col("static") + F.col("both"), 0.0))


def busiest(edges: DataFrame, k: int = 10) -> DataFrame:
    """(id, degree): ends of edges by how often they stand there, the first k."""
    ends = edges.select(F.col("from_node").alias("id")).union(edges.select("to_node"))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(k)


def hotspots(changes: DataFrame, tested: DataFrame, node: str, time: str, action: str, k: int) -> DataFrame:
    """(node, changes, last, actions, tested, risk): the nodes changed most; a test lowers the risk to three tenths."""
    each = changes.groupBy(node, action).agg(F.count("*").alias("_n"), F.max(time).alias("_last"))
    actions = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(action), F.col("_n")))), ",")
    out = each.groupBy(node).agg(F.sum("_n").alias("changes"), F.max("_last").alias("last"), actions.alias("actions"))
    out = out.join(tested.select(node).distinct().withColumn("_t", F.lit(True)), node, "left").withColumn("tested", F.coalesce("_t", F.lit(False))).drop("_t")
    risk = F.round(F.col("changes") * F.when(F.col("tested"), 0.3).otherwise(1.0), 1)
    return out.withColumn("risk", risk).orderBy(F.desc("risk"), node).limit(k)


def first_paths(changes: DataFrame, node: str, time: str, path: str = "file_path") -> DataFrame:
    """(node, path): the oldest path that isn't empty of each node in the change log, ties by path."""
    known = changes.filter(F.coalesce(path, F.lit("")) != "")
    return known.groupBy(node).agg(F.min(F.struct(F.col(time), F.col(path))).alias("first")).select(node, F.col("first")[path].alias(path))


def coverage_grade(pct: Column) -> Column:
    return F.when(pct >= 80, "A").when(pct >= 60, "B").when(pct >= 40, "C").when(pct >= 20, "D").otherwise("F")


def usage_groups(edges: DataFrame, target: str = "to_node") -> DataFrame:
    """(target, callers, importers, inheritors, other): edges into each node by what they are."""
    kinds = (("callers", ["calls"]), ("importers", ["imports"]), ("inheritors", ["inherits"]))
    known = [k for _, ks in kinds for k in ks]
    sums = [F.sum(F.col("type").isin(ks).cast("long")).alias(n) for n, ks in kinds]
    return edges.groupBy(target).agg(*sums, F.sum((~F.col("type").isin(known)).cast("long")).alias("other"))


def usages(edges: DataFrame, nodes: DataFrame, target: str = "to_node", compact: int = 30) -> DataFrame:
    """(target, usage, n, tests, items): who uses a node, by what the edge is; tests: how many of them are tests; items: the users in
    order, without a list where there are more than ``compact``."""
    usage = F.when(F.col("type") == "calls", "callers").when(F.col("type") == "imports", "importers").when(F.col("type") == "inherits", "inheritors").otherwise("other")
    rows = edges.select(target, F.col("from_node").alias("id"), usage.alias("usage")).distinct()
    rows = rows.join(nodes.select("id", is_test("C").alias("_test")), "id", "left")
    counts = rows.groupBy(target, "usage").agg(F.count("*").alias("n"), F.sum(F.coalesce("_test", F.lit(False)).cast("long")).alias("tests"))
    few = counts.filter(F.col("n") <= compact).select(target, "usage")
    lists = rows.join(few, [target, "usage"]).groupBy(target, "usage").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("items"))
    return counts.join(lists, [target, "usage"], "left").select(target, "usage", "n", "tests", F.coalesce("items", F.lit("")).alias("items"))


def grouped_list(df: DataFrame, group: str, item: str, order: str | None = None, distinct: bool = False, most: int | None = None) -> DataFrame:
    """(group, items, n): the group's items in one string, in order, and their number. A group's string is one value; where groups
    may be very large, ``most`` lists the first so many only (n counts all), and the rows themselves are the whole answer."""
    if distinct:
        df = df.select(group, item).distinct()
    key = order or item
    if most is not None:
        rank = F.row_number().over(Window.partitionBy(group).orderBy(key, item))
        total = df.groupBy(group).agg(F.count("*").alias("n"))
        return grouped_list(df.withColumn("_rank", rank).filter(F.col("_rank") <= most), group, item, order).drop("n").join(total, group)
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(item).alias("v")))), lambda x: x["v"].cast("string")), ",")
    return df.groupBy(group).agg(items.alias("items"), F.count("*").alias("n"))


def bridges(bindings: DataFrame) -> DataFrame:
    """(bridge, module, callers, functions): native modules by bridge, how many sources load each and what they bind."""
    one = bindings.groupBy("bridge", "module").agg(F.countDistinct("id").alias("callers"))
    bound = bindings.select("bridge", "module", F.explode("functions").alias("f")).distinct().groupBy("bridge", "module").agg(F.array_join(F.array_sort(F.collect_list("f")), ",").alias("functions"))
    return one.join(bound, ["bridge", "module"], "left").na.fill("", ["functions"])


def infrastructure(nodes: DataFrame, edges: DataFrame, focus: str | None = None) -> DataFrame:
    """(category, type, nodes, n): infrastructure nodes by the first two parts of their ids, and their edges by type; with ``focus``
    only ids that contain it, and edges at one."""
    named = lambda c: F.contains(F.lower(c), F.lit((focus or "").lower()))
    category = lambda c: F.regexp_extract(c, r"^(\w+\.\w+)", 1)
    own = nodes.filter(F.col("id").rlike(r"^(infra|ci)\.")).filter(named("id")).groupBy(category("id").alias("category")).agg(F.count("*").alias("nodes"))
    out = edges.filter(F.col("from_node").rlike(r"^(infra|ci)\.")).filter(named("from_node") | named("to_node"))
    counts = out.groupBy(category("from_node").alias("category"), "type").agg(F.count("*").alias("n"))
    return own.join(counts, "category", "full").na.fill(0, ["nodes", "n"]).select("category", "type", "nodes", "n")


def variables(given: DataFrame, used: DataFrame) -> DataFrame:
    """(name, origin, items, n, undefined): variables with their last definition (name, origin; the largest origin stands) and their
    users (name, user), from one full outer join; undefined: used but nowhere defined."""
    last = given.groupBy("name").agg(F.max("origin").alias("origin"))
    users = grouped_list(used, "name", "user", distinct=True)
    return last.join(users, "name", "full").select("name", "origin", F.coalesce("items", F.lit("")).alias("items"), F.coalesce("n", F.lit(0)).alias("n"), F.col("origin").isNull().alias("undefined"))


def dedupe(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def components(nodes: DataFrame, path: str = "file_path", root: str = "root") -> DataFrame:
    """(component, members): folders with two modules, classes or functions at least."""
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(root)
    own = nodes.filter(F.col("type").isin("module", "class", "function")).withColumn("component", folder)
    return own.groupBy("component").agg(F.count("*").alias("members")).filter("members >= 2")


def owners(members: DataFrame, id_col: str = "id") -> DataFrame:
    return members.withColumn("owner", parent_of(F.col(id_col)))


def file_hotspots(commits: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(id, file_path, changes): nodes by the commits of their file, where there is no log of node changes; the first k."""
    counts = commits.groupBy("file_path").agg(F.countDistinct("commit").alias("changes"))
    return nodes.join(counts, "file_path").select("id", "file_path", "changes").orderBy(F.desc("changes"), "id").limit(k)


def table_usage(edges: DataFrame) -> DataFrame:
    """(table, readers, writers, n_readers, n_writers) of tables that edges read, write or migrate."""
    reads, writes = F.col("type") == "reads_table", F.col("type").isin("writes_table", "migrates")
    own = edges.filter(reads | writes).groupBy(F.col("to_node").alias("table")).agg(
        F.array_sort(F.collect_set(F.when(reads, F.col("from_node")))).alias("r"), F.array_sort(F.collect_set(F.when(writes, F.col("from_node")))).alias("w")
    )
    return own.select("table", F.array_join("r", ",").alias("readers"), F.array_join("w", ",").alias("writers"), F.size("r").alias("n_readers"), F.size("w").alias("n_writers"))


def severity_counts(findings: DataFrame, severity: str = "severity") -> DataFrame:
    """One row: findings of high, medium and low severity, and all."""
    one = lambda s: F.coalesce(F.sum((F.upper(severity) == s).cast("long")), F.lit(0)).alias(s.lower())
    return findings.agg(one("HIGH"), one("MEDIUM"), one("LOW"), F.count("*").alias("total"))


def parse_stats(files: DataFrame, nodes: DataFrame, edges: DataFrame, language: str = "language") -> DataFrame:
    """(language, files, nodes, internal, resolved, pct) of files (file_path, language), by the nodes and edges they gave."""
    n = nodes.groupBy("file_path").agg(F.count("*").alias("_n"))
    e = edges.groupBy("file_path").agg(F.sum((F.col("confidence") != "external").cast("long")).alias("_i"), F.sum((F.col("confidence") == "resolved").cast("long")).alias("_r"))
    own = files.join(n, "file_path", "left").join(e, "file_path", "left").na.fill(0, ["_n", "_i", "_r"])
    out = own.groupBy(language).agg(F.count("*").alias("files"), F.sum("_n").alias("nodes"), F.sum("_i").alias("internal"), F.sum("_r").alias("resolved"))
    return out.withColumn("pct", percent(F.col("resolved"), F.col("internal")))


#: What kinds of edges make each line of a summary.
EDGE_CATEGORIES = (
    ("calls", ("calls", "calls_api", "calls_native", "mocks")), ("structure", ("contains", "inherits", "decorates", "uses")), ("imports", ("imports",)),
    ("infrastructure", ("reads_table", "writes_table", "migrates", "depends_on", "uses_env")),
)


def edge_categories(edges: DataFrame) -> DataFrame:
    """(category, n, pct) of edges by what they are about."""
    kind = F.lit("other")
    for name, types in EDGE_CATEGORIES:
        kind = F.when(F.col("type").isin(*types), name).otherwise(kind)
    counts = edges.groupBy(kind.alias("category")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t")).withColumn("_k", F.lit(1))
    return counts.withColumn("_k", F.lit(1)).join(total, "_k").select("category", "n", percent(F.col("n"), F.col("_t")).alias("pct"))


def unparsed_extensions(paths: DataFrame, known: list[str], k: int = 6) -> DataFrame:
    """(extension, n) of files that no parser takes, the commonest k."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return paths.withColumn("extension", ext).filter((F.col("extension") != "") & ~F.col("extension").isin(known)).groupBy("extension").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension").limit(k)
