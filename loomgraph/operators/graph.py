"""Graph operators over an edge relation (from_node, to_node, type, seq, ...).

Depth-bounded walks are unrolled joins without an action. Closures run semi-naively: the frontier joins the edges, what is
new joins the result, and each round's frontier is a table in the shared folder. What has been seen is one table too, plus the
frontiers since it was last rewritten (``MERGE`` rounds at most), so that neither lineage nor plans grow with the rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import depth_of, parent_of
from ..plans.tables import counted, discard, materialise
from .filters import children, rule_test


LOCAL_EDGES = 50_000  # up to so many edges, counted first, a graph is small enough for one machine
MERGE = 8  # rounds after which the frontiers join the table of what has been seen


class Seen:
    """All rows that rounds have found, for anti-joins and as the result."""

    def __init__(self, first: DataFrame):
        self.whole, self.fresh = first, []

    def add(self, rows: DataFrame) -> None:
        self.fresh.append(rows)
        if len(self.fresh) >= MERGE:
            old = [self.whole, *self.fresh]
            self.whole, self.fresh = materialise(self.rows(), "seen"), []
            discard(*(t for t in old if hasattr(t, "written_to")))

    def latest(self, d: int) -> DataFrame:
        """The rows of round ``d``, the last one added."""
        return self.fresh[-1] if self.fresh else self.whole.filter(F.col("distance") == d)

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.fresh, self.whole)


def collapse(edges: DataFrame, order: list[str]) -> DataFrame:
    """One row for each (from_node, to_node): the last by ``order``."""
    rest = [c for c in edges.columns if c not in ("from_node", "to_node")]
    last = edges.groupBy("from_node", "to_node").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select("from_node", "to_node", *(F.col("last")[c].alias(c) for c in rest))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_node").alias("id")).union(edges.select("to_node")).distinct()


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that aren't nodes: external references."""
    return endpoints(edges).join(nodes.select("id"), "id", "left_anti")


def neighbours(edges: DataFrame, ids: DataFrame, direction: str) -> DataFrame:
    """(id, other, type, ...): edges out of, or into, some nodes."""
    near, far = ("to_node", "from_node") if direction == "in" else ("from_node", "to_node")
    return edges.withColumnsRenamed({near: "id", far: "other"}).join(ids.select("id").distinct(), "id", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) by one aggregation over both ends."""
    ends = edges.select(F.col("from_node").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("to_node", F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def impact(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, id, distance, kind) of nodes within ``depth`` reverse hops of each start (column id).

    kind: direct, inheritor (a first hop over an inherits edge) or indirect. A start is its own result only by a self-loop.
    depth below 1 counts as 1. edges: collapsed.
    """
    if depth > 1 and not hasattr(edges, "written_to"):
        edges = materialise(edges.select("from_node", "to_node", "type"), "edges")  # read once a hop
    back = edges.select(F.col("to_node").alias("at"), F.col("from_node").alias("id"), "type")
    first = starts.select(F.col("id").alias("start"), F.col("id").alias("at")).distinct().join(back, "at")
    kind = F.when(F.col("type") == "inherits", "inheritor").otherwise("direct")
    out = first.select("start", "id", F.lit(1).alias("distance"), kind.alias("kind"))
    if depth > 1:
        out = materialise(out, "impact")  # used twice in each further round
    frontier, seen = out.filter("id != start").select("start", "id"), Seen(out)
    for d in range(2, depth + 1):
        reached = frontier.select("start", F.col("id").alias("at")).join(back.select("at", "id"), "at").select("start", "id").distinct().filter("id != start")
        fresh = reached.join(seen.rows().select("start", "id"), ["start", "id"], "left_anti")
        fresh = fresh.select("start", "id", F.lit(d).alias("distance"), F.lit("indirect").alias("kind"))
        if d < depth:
            fresh, n = counted(fresh, "impact")
            if not n:
                break
        seen.add(fresh)
        frontier = seen.latest(d)
    return seen.rows()


def severity(total: Column, inheritors: Column, unresolved: Column) -> Column:
    return (
        F.when((total > 20) | (inheritors > 0), "CRITICAL").when((total > 10) | (unresolved > 0), "HIGH").when(total > 5, "MEDIUM").otherwise("LOW")
    )


def impact_report(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, direct, inheritors, indirect, total, unresolved, severity), zeros for nodes that nothing reaches."""
    edges = materialise(edges.select("from_node", "to_node", "type", "confidence"), "edges")
    counts = impact(edges, starts, depth).groupBy("start").agg(
        *(F.sum((F.col("kind") == k).cast("long")).alias(n) for k, n in (("direct", "direct"), ("inheritor", "inheritors"), ("indirect", "indirect"))), F.count("*").alias("total")
    )
    ids = starts.select(F.col("id").alias("start")).distinct()
    bad = edges.filter("confidence = 'unresolved' and type != 'inherits'").groupBy(F.col("to_node").alias("start")).agg(F.count("*").alias("unresolved"))
    out = ids.join(counts, "start", "left").join(bad, "start", "left").na.fill(0)
    return out.withColumn("severity", severity(F.col("total"), F.col("inheritors"), F.col("unresolved")))


def reachable(edges: DataFrame, starts: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, distance): all nodes that some start (column id) reaches, the starts with distance 0."""
    steps = materialise(edges.select("from_node", "to_node").distinct(), "steps")
    frontier, n = counted(starts.select("id").distinct().withColumn("distance", F.lit(0)), "frontier")
    seen, d = Seen(frontier), 0
    while n and (max_rounds is None or d < max_rounds):
        d += 1
        reached = frontier.select(F.col("id").alias("from_node")).join(steps, "from_node").select(F.col("to_node").alias("id")).distinct()
        frontier, n = counted(reached.join(seen.rows().select("id"), "id", "left_anti").withColumn("distance", F.lit(d)), "frontier")
        if n:
            seen.add(frontier)
            frontier = seen.latest(d)
    return seen.rows()


def dead_code(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Functions, methods and classes that no entry point reaches, by id."""
    own = nodes.filter(F.col("type").isin("function", "method", "class"))
    return own.join(reachable(edges, entries).select("id"), "id", "left_anti").orderBy("id")


def shortest_path(edges: DataFrame, start: str, goal: str) -> list[str]:
    """Nodes of one shortest path, ties by the smaller predecessor; empty if there is none. Only the path reaches the driver."""
    spark = edges.sparkSession
    steps = materialise(edges.select("from_node", "to_node").distinct(), "steps")
    level = materialise(spark.createDataFrame([(start, None)], "id string, via string").withColumn("distance", F.lit(0)), "level")
    seen, n, d = Seen(level), 1, 0
    while n:
        if not level.filter(F.col("id") == goal).isEmpty():
            path, found = [goal], seen.rows()
            for k in range(d, 0, -1):
                path.append(found.filter((F.col("distance") == k) & (F.col("id") == path[-1])).first()["via"])
            return path[::-1]
        d += 1
        reached = level.select(F.col("id").alias("from_node")).join(steps, "from_node").groupBy(F.col("to_node").alias("id")).agg(F.min("from_node").alias("via"))
        level, n = counted(reached.join(seen.rows().select("id"), "id", "left_anti").withColumn("distance", F.lit(d)), "level")
        seen.add(level)
        level = seen.latest(d)
    return []


def distances(edges: DataFrame, starts: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(start, id, distance) for every start, at most ``max_rounds`` hops (None: to the end); the frontier keeps the start."""
    steps = materialise(edges.select("from_node", "to_node").distinct(), "steps")
    frontier, n = counted(starts.select(F.col("id").alias("start"), "id").distinct().withColumn("distance", F.lit(0)), "frontier")
    seen, d = Seen(frontier), 0
    while n and (max_rounds is None or d < max_rounds):
        d += 1
        reached = frontier.select("start", F.col("id").alias("from_node")).join(steps, "from_node").select("start", F.col("to_node").alias("id")).distinct()
        frontier, n = counted(reached.join(seen.rows().select("start", "id"), ["start", "id"], "left_anti").withColumn("distance", F.lit(d)), "frontier")
        if n:
            seen.add(frontier)
            frontier = seen.latest(d)
    return seen.rows()


def prune_acyclic(edges: DataFrame) -> DataFrame:
    """Edges without those that can't be on a cycle: ends without a way in or out go, again and again, until none goes."""
    left, n = counted(edges, "cyclic")
    while True:
        onward = left.join(left.select(F.col("to_node").alias("from_node")).distinct(), "from_node", "left_semi")
        onward = onward.join(left.select(F.col("from_node").alias("to_node")).distinct(), "to_node", "left_semi")
        left, m = counted(onward, "cyclic")
        if m == n:
            return left
        n = m


def _spread(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(id, colour): the largest colour that reaches a node along the edges, its own included."""
    colours = materialise(colours, "colours")
    while True:
        offered = edges.join(colours.select(F.col("id").alias("from_node"), "colour"), "from_node").groupBy(F.col("to_node").alias("id")).agg(F.max("colour").alias("offer"))
        better = colours.join(offered, "id", "left").select("id", F.greatest("colour", "offer").alias("colour"), (F.col("offer") > F.col("colour")).alias("_up"))
        changed = Observation()
        colours = materialise(better.observe(changed, F.count_if("_up").alias("n")).drop("_up"), "colours")
        if not changed.get["n"]:
            return colours


def _local_components(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Strongly connected components of two nodes or more, (node, largest node), by one walk with low links."""
    after: dict[str, list[str]] = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    open_, on, out = [], set(), []
    for first in after:
        if first in number:
            continue
        walk = [(first, iter(after[first]))]
        number[first] = low[first] = len(number)
        open_.append(first)
        on.add(first)
        while walk:
            at, rest = walk[-1]
            for b in rest:
                if b not in number:
                    number[b] = low[b] = len(number)
                    open_.append(b)
                    on.add(b)
                    walk.append((b, iter(after[b])))
                    break
                if b in on:
                    low[at] = min(low[at], number[b])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[at])
                if low[at] == number[at]:
                    members = []
                    while not members or members[-1] != at:
                        members.append(open_.pop())
                        on.discard(members[-1])
                    if len(members) > 1:
                        head = max(members)
                        out += [(m, head) for m in members]
    return out


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) of nodes on cycles of two nodes or more: component is the largest node of the strongly connected one.

    A graph of at most ``local_edges`` edges, which are counted first, is walked on the driver. In larger ones colours spread
    forwards; a node whose colour is its own heads a component, whose members are those of its colour that reach it. They go,
    and what is left is coloured anew, until nothing is. Both ways give the same.
    """
    plain, n = counted(edges.select("from_node", "to_node").filter("from_node != to_node").distinct(), "steps")
    if n <= local_edges:
        found = _local_components([(r["from_node"], r["to_node"]) for r in plain.collect()])
        return edges.sparkSession.createDataFrame(found, "id string, component string")
    steps = prune_acyclic(plain)
    found: list[DataFrame] = []
    while True:
        colours = _spread(steps, endpoints(steps).select("id", F.col("id").alias("colour")))
        a = colours.select(F.col("id").alias("from_node"), F.col("colour").alias("_a"))
        b = colours.select(F.col("id").alias("to_node"), F.col("colour").alias("_b"))
        inside = materialise(steps.join(a, "from_node").join(b, "to_node").filter("_a = _b").select("from_node", "to_node", F.col("_a").alias("colour")), "inside")
        back = inside.select(F.col("to_node").alias("at"), F.col("from_node").alias("id"))
        frontier, n = counted(colours.filter("id = colour").join(inside.select("colour").distinct(), "colour", "left_semi").select("id", "colour", F.lit(0).alias("distance")), "heads")
        seen, d = Seen(frontier), 0
        while n:
            d += 1
            reached = frontier.select(F.col("id").alias("at"), "colour").join(back, "at").select("id", "colour").distinct()
            frontier, n = counted(reached.join(seen.rows().select("id"), "id", "left_anti").withColumn("distance", F.lit(d)), "heads")
            if n:
                seen.add(frontier)
                frontier = seen.latest(d)
        members = materialise(seen.rows().select("id", F.col("colour").alias("component")), "members")
        found.append(members)
        gone = members.select(F.col("id").alias("from_node"))
        left = steps.join(gone, "from_node", "left_anti").join(gone.withColumnRenamed("from_node", "to_node"), "to_node", "left_anti")
        steps = prune_acyclic(left)
        if steps.isEmpty():
            break
    every = reduce(DataFrame.unionByName, found)
    large = every.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return every.join(large, "component", "left_semi").select("id", "component")


def cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """(length, cycle): all simple cycles of two nodes or more, as node lists that begin with the smallest.

    Paths start at a cycle's smallest node, never go below it and stay in its strongly connected component; they are walked
    until none is left. The number of simple cycles can grow exponentially with a component: ``max_length`` stops there, and
    a column ``truncated`` then says of every row whether paths were left. Whether a node is on a cycle at all is cheap:
    ``strong_components``.
    """
    steps = edges.select("from_node", "to_node").filter("from_node != to_node").distinct()
    members = materialise(strong_components(steps), "components")
    a, b = (members.select(F.col("id").alias(end), F.col("component").alias(f"_{end}")) for end in ("from_node", "to_node"))
    steps = materialise(steps.join(a, "from_node").join(b, "to_node").filter("_from_node = _to_node").select("from_node", "to_node"), "steps")
    paths, left = counted(steps.filter("to_node > from_node").select(F.col("from_node").alias("start"), F.col("to_node").alias("last"), F.array("from_node", "to_node").alias("path")), "paths")
    found, n = paths.limit(0).select(F.lit(2).alias("length"), F.col("path").alias("cycle")), 2
    while left and (max_length is None or n <= max_length):
        walked = paths.join(steps, F.col("last") == F.col("from_node"))
        closed = walked.filter("to_node = start").select(F.lit(n).alias("length"), F.col("path").alias("cycle"))
        found = found.unionByName(closed)
        more = walked.filter("to_node > start").filter(~F.array_contains("path", F.col("to_node")))
        paths, left = counted(more.select("start", F.col("to_node").alias("last"), F.array_append("path", F.col("to_node")).alias("path")), "paths")
        n += 1
        if n % MERGE == 0:
            found = materialise(found, "cycles")
    return found if max_length is None else found.withColumn("truncated", F.lit(left > 0))


def dependency_tree(edges: DataFrame, start: DataFrame, max_depth: int = 3) -> DataFrame:
    """(parent, child, depth, type, truncated): the forward walk's first visits; a child at ``max_depth`` with edges of its own is truncated."""
    steps = materialise(edges.select(F.col("from_node").alias("parent"), F.col("to_node").alias("child"), "type"), "steps")
    seen = start.select("id").distinct()
    frontier, levels = seen, []
    for d in range(1, max_depth + 1):
        reached = frontier.select(F.col("id").alias("parent")).join(steps, "parent").join(seen.select(F.col("id").alias("child")), "child", "left_anti")
        first = reached.groupBy("child").agg(F.min_by(F.struct("parent", "type"), F.struct("parent", "type")).alias("by"))
        level = materialise(first.select("by.parent", "child", F.lit(d).alias("depth"), "by.type"), "tree")
        levels.append(level)
        frontier = level.select(F.col("child").alias("id"))
        seen = seen.union(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    inner = steps.select(F.col("parent").alias("child")).distinct().withColumn("_more", F.lit(True))
    return out.join(inner, "child", "left").select("parent", "child", "depth", "type", ((F.col("depth") == max_depth) & F.coalesce("_more", F.lit(False))).alias("truncated"))


def context(edges: DataFrame, starts: DataFrame, depth: int = 1, cap: int = 30) -> DataFrame:
    """(start, direction, id, distance, type): callers and callees up to ``depth`` hops, the first ``cap`` of each direction."""
    edges = materialise(edges.select("from_node", "to_node", "type"), "edges")  # read once a hop and direction
    found = []
    for direction, near, far in (("caller", "to_node", "from_node"), ("callee", "from_node", "to_node")):
        steps = edges.select(F.col(near).alias("at"), F.col(far).alias("id"), "type")
        seen = starts.select(F.col("id").alias("start"), "id").distinct()
        frontier = seen
        for d in range(1, depth + 1):
            reached = frontier.select("start", F.col("id").alias("at")).join(steps, "at").groupBy("start", "id").agg(F.min("type").alias("type"))
            level = reached.join(seen, ["start", "id"], "left_anti").select("start", F.lit(direction).alias("direction"), "id", F.lit(d).alias("distance"), "type")
            found.append(level)
            frontier = level.select("start", "id")
            seen = seen.unionByName(frontier)
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    rank = F.row_number().over(Window.partitionBy("start", "direction").orderBy("distance", "id"))
    return out.withColumn("_rank", rank).filter(F.col("_rank") <= cap).drop("_rank")


def related_tests(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id): tests that call a start, or are named ``test_<its name>``."""
    test = (F.startswith("name", F.lit("test_"))) | F.startswith("file_path", F.lit("test_"))
    tests = nodes.filter(test).select("id", "name")
    by_edge = edges.join(starts.select(F.col("id").alias("to_node")), "to_node", "left_semi").join(tests.select(F.col("id").alias("from_node")), "from_node").select(F.col("to_node").alias("start"), F.col("from_node").alias("id"))
    named = starts.select("id").join(nodes.select("id", "name"), "id").select(F.col("id").alias("start"), F.concat(F.lit("test_"), "name").alias("stem"))
    # every prefix of a test's name that ends at a word of it is a key, so that the join is one of equality
    parts = tests.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", "_"))), lambda n: F.array_join(F.slice(F.split("name", "_"), F.lit(1), n), "_"))).alias("stem"))
    return by_edge.union(named.join(parts, "stem").select("start", "id")).distinct()


# What makes a node an entry point. Category, field, test, values, types (none: all).
ENTRY_RULES = (
    ("main", "name", "exact", ("main", "__main__"), None),
    ("test", "name", "prefix", ("test_",), None),
    ("test", "file_path", "prefix", ("tests/",), None),
    ("structural", "type", "exact", ("block",), None),
    ("structural", "type", "exact", ("class",), None),
    ("cli", "name", "exact", ("cli", "app", "run", "main_cli"), None),
    ("cli", "name", "prefix", ("cmd_",), None),
    ("mcp", "file_path", "contains", ("mcp_server",), None),
    ("handler", "name", "prefix", ("handle_",), None),
    ("handler", "name", "exact", ("handle_tool_call",), None),
    ("web", "name", "contains", ("_handler", "_endpoint", "_view", "_route"), ("function",)),
    ("web", "file_path", "contains", ("/router", "/routes", "/views", "/api/", "router.py", "routes.py", "views.py", "endpoints.py"), ("function",)),
    ("web", "source_code", "contains", ("@app.", "@router.", "@bp.", "@api.", "@route", "@get", "@post", "@put", "@delete", "@patch", "@websocket", "Depends("), ("function",)),
    ("web", "source_code", "contains", ("@st.cache", "@st.experimental", "st.button(", "st.form("), ("function",)),
    ("web", "file_path", "contains", ("frontend",), ("function",)),
    ("migration", "name", "exact", ("upgrade", "downgrade", "run_migrations_online", "run_migrations_offline"), None),
    ("migration", "file_path", "contains", ("alembic",), ("function",)),
    ("migration", "file_path", "suffix", ("env.py",), ("function",)),
    ("migration", "file_path", "contains", ("/versions/", "/migrations/"), ("function",)),
    ("task_queue", "source_code", "contains", ("@celery.task", "@app.task", "@shared_task", "@celery_app.task", "celery.Task"), ("function",)),
    ("task_queue", "source_code", "contains", ("@job",), ("function",)),
    ("pytest", "source_code", "contains", ("@pytest.fixture",), ("function",)),
    ("pytest", "file_path", "suffix", ("conftest.py",), ("function",)),
    ("django", "file_path", "contains", ("/management/commands/",), None),
    ("django", "source_code", "contains", ("@receiver", "pre_save", "post_save", "pre_delete", "post_delete"), ("function",)),
    ("django", "file_path", "contains", ("admin.py",), ("class", "function")),
    ("sqlalchemy", "source_code", "contains", ("@event.listens_for", "event.listen"), ("function",)),
    ("dunder", "name", "exact", (
        "__init__", "__post_init__", "__new__", "__del__", "__repr__", "__str__", "__hash__", "__eq__", "__ne__", "__lt__", "__le__", "__gt__", "__ge__",
        "__len__", "__iter__", "__next__", "__getitem__", "__setitem__", "__contains__", "__call__", "__enter__", "__exit__", "__get__", "__set__", "__delete__",
        "from_dict", "to_dict",
    ), ("method",)),
    ("property", "name", "prefix", ("is_", "has_", "get_", "set_"), ("method",)),
    ("visitor", "name", "prefix", ("visit_",), None),
    ("visitor", "name", "exact", ("generic_visit",), None),
    ("helper", "name", "prefix", ("_detect_", "_compute_"), None),
    ("enum", "name", "suffix", ("Enum", "Role", "Type", "Confidence", "Source"), ("class",)),
    ("pydantic", "source_code", "contains", ("@validator", "@field_validator", "@root_validator", "@model_validator"), ("method",)),
    ("click", "source_code", "contains", ("@click.command", "@click.group", "@app.command", "@typer.command"), ("function",)),
)


def entry_category(rules=ENTRY_RULES, predicates: dict[str, Column] | None = None) -> Column:
    """Category of the first rule that a node fulfils, then of the predicates; null if none."""
    if predicates is None:
        predicates = {
            "init_top_level_function": F.endswith("file_path", F.lit("__init__.py")) & (F.col("type") == "function") & (depth_of(F.col("id")) == 2),
            "private_method": (F.col("type") == "method") & F.startswith("name", F.lit("_")) & ~F.startswith("name", F.lit("__")),
        }
    tests = [(c, rule_test(field, how, values, kinds)) for c, field, how, values, kinds in rules] + list(predicates.items())
    return F.coalesce(*(F.when(F.coalesce(t, F.lit(False)), c) for c, t in tests))


def entry_points(nodes: DataFrame, rules=ENTRY_RULES, predicates: dict[str, Column] | None = None) -> DataFrame:
    """(id, category) of nodes that some rule or predicate takes."""
    return nodes.select("id", entry_category(rules, predicates).alias("category")).filter("category is not null")


def public_api(nodes: DataFrame) -> DataFrame:
    """Direct children of modules whose source names what they export."""
    exporting = nodes.filter((F.col("type") == "module") & F.contains("source_code", F.lit("__all__")))
    return children(nodes, exporting).select("id")


def expand_entries(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries, then decorated functions, then methods of entry classes, then functions and classes inside entry functions."""
    decorated = nodes.filter("type = 'function'").join(edges.filter("type = 'decorates'").select(F.col("to_node").alias("id")).distinct(), "id", "left_semi").select("id")
    known = materialise(entries.select("id").union(decorated).distinct(), "entries")
    for kinds, holder in ((["method"], "class"), (["function", "class"], "function")):
        holders = nodes.filter(F.col("type") == holder).join(known, "id", "left_semi").select(F.col("id").alias("parent"))
        inner = nodes.filter(F.col("type").isin(kinds)).withColumn("parent", parent_of(F.col("id"))).filter("parent != id").join(holders, "parent", "left_semi").select("id")
        known = materialise(known.union(inner).distinct(), "entries")
    return known


def dead_code_report(nodes: DataFrame, edges: DataFrame, file_prefix: str | None = None) -> DataFrame:
    """Dead code from the entry points that rules find."""
    entries = expand_entries(nodes, edges, entry_points(nodes).select("id").union(public_api(nodes)).distinct())
    out = dead_code(nodes, edges, entries)
    return out if file_prefix is None else out.filter(F.startswith("file_path", F.lit(file_prefix)))


def is_test(variant: str = "A") -> Column:
    """Four tests of a test, which the tools keep apart."""
    name, path = F.startswith("name", F.lit("test_")), F.coalesce("file_path", F.lit(""))
    return {
        "A": name | F.contains(path, F.lit("test_")),
        "B": name | F.startswith(path, F.lit("test_")),
        "C": name | F.contains(F.lower(path), F.lit("test")),
        "D": F.contains(path, F.lit("test")),
    }[variant]


def tested(nodes: DataFrame, edges: DataFrame, variant: str = "A") -> DataFrame:
    """Ids of nodes that a test has an edge to."""
    tests = nodes.filter(is_test(variant)).select(F.col("id").alias("from_node"))
    return edges.join(tests, "from_node", "left_semi").select(F.col("to_node").alias("id")).distinct()


