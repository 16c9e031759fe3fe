import random

import pytest

from loomgraph.operators import graph as G

NODES = [
    ("main", "module", "main", "main.py", 1, 20), ("main.run", "function", "run", "main.py", 5, 10), ("service", "module", "service", "service.py", 1, 30),
    ("service.process", "function", "process", "service.py", 5, 15), ("service.validate", "function", "validate", "service.py", 17, 25),
    ("db.save", "function", "save", "db.py", 1, 10), ("unused.orphan", "function", "orphan", "unused.py", 1, 5),
]
EDGES = [("main.run", "service.process", "calls"), ("service.process", "service.validate", "calls"), ("service.process", "db.save", "calls"), ("main", "service", "imports")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(*n, "") for n in NODES], "id string, type string, name string, file_path string, start_line int, end_line int, source_code string")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a, b, t, "resolved", i) for i, (a, b, t) in enumerate(EDGES)], "from_node string, to_node string, type string, confidence string, seq long")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_impact(spark, nodes, edges):
    one = {(r.id, r.distance, r.kind) for r in G.impact(edges, ids(spark, "db.save"), 2).collect()}
    assert one == {("service.process", 1, "direct"), ("main.run", 2, "indirect")}
    report = {r.start: r for r in G.impact_report(edges, ids(spark, "db.save", "main.run", "unknown"), 2).collect()}
    assert report["db.save"].total == 2 and report["main.run"].total == 0 and report["unknown"].severity == "LOW"
    assert {r.id for r in G.impact(edges, ids(spark, "db.save"), 0).collect()} == {"service.process"}


def test_self_loop_counts_its_start(spark):
    loop = spark.createDataFrame([("a", "a", "calls"), ("b", "a", "inherits")], "from_node string, to_node string, type string")
    assert {(r.id, r.kind) for r in G.impact(loop, ids(spark, "a"), 2).collect()} == {("a", "direct"), ("b", "inheritor")}


def test_dead_code_and_paths(spark, nodes, edges):
    assert [r.id for r in G.dead_code(nodes, edges, ids(spark, "main.run")).collect()] == ["unused.orphan"]
    assert G.shortest_path(edges, "main.run", "db.save") == ["main.run", "service.process", "db.save"]
    assert G.shortest_path(edges, "unused.orphan", "main.run") == []
    tree = {(r.parent, r.child, r.depth) for r in G.dependency_tree(edges, ids(spark, "service.process"), 1).collect()}
    assert tree == {("service.process", "service.validate", 1), ("service.process", "db.save", 1)}


def test_cycles(spark, edges):
    assert G.cycles(edges.filter("type = 'imports'")).count() == 0
    ring = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "c"), ("d", "a")], "from_node string, to_node string")
    assert sorted(r.cycle for r in G.cycles(ring).collect()) == [["a", "b"], ["a", "b", "c"]]


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, "from_node string, to_node string")


def test_long_rings_are_found(spark):
    ring = [(f"n{i:02}", f"n{(i + 1) % 15:02}") for i in range(15)]
    found = G.cycles(rows_of(spark, [*ring, ("n00", "out"), ("in", "n03")])).collect()
    assert [(r.length, r.cycle) for r in found] == [(15, [f"n{i:02}" for i in range(15)])]
    cut = G.cycles(rows_of(spark, [*ring, ("n02", "n01")]), max_length=3).collect()
    assert [(r.cycle, r.truncated) for r in cut] == [(["n01", "n02"], True)]
    assert {r.id for r in G.strong_components(rows_of(spark, [*ring, ("n00", "out")])).collect()} == {f"n{i:02}" for i in range(15)}


def test_components_and_cycles_against_brute_force(spark):
    rng = random.Random(8)
    pairs = list({(f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}") for _ in range(26)})
    after = {}
    for a, b in pairs:
        if a != b:
            after.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in after.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    names = {x for p in pairs for x in p}
    reached = {x: reach(x) for x in names}
    want = {x: max(y for y in names if y in reached[x] and x in reached[y]) for x in names if x in reached[x]}
    for most in (0, 1000):  # over tables, and on the driver
        assert {r.id: r.component for r in G.strong_components(rows_of(spark, pairs), most).collect()} == want
    cycles, todo = set(), [(x, (x,)) for x in names]
    while todo:
        at, path = todo.pop()
        for y in after.get(at, ()):
            if y == path[0] and len(path) > 1:
                cycles.add(path)
            elif y > path[0] and y not in path:
                todo.append((y, (*path, y)))
    assert sorted(tuple(r.cycle) for r in G.cycles(rows_of(spark, pairs)).collect()) == sorted(cycles)


def test_long_walks(spark):
    chain = rows_of(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(11)])
    assert G.shortest_path(chain, "n00", "n11") == [f"n{i:02}" for i in range(12)]
    assert {r.id: r.distance for r in G.reachable(chain, ids(spark, "n00")).collect()} == {f"n{i:02}": i for i in range(12)}
    far = {(r.start, r.id): r.distance for r in G.distances(chain, ids(spark, "n00", "n05")).collect()}
    assert far["n00", "n11"] == 11 and far["n05", "n11"] == 6 and len(far) == 12 + 7
    some = G.reachable(chain, ids(spark, "n00"), 9)
    assert len(some.collect()) == 10
    plan = some._jdf.queryExecution().toString()
    assert plan.count("FileScan") <= G.MERGE + 2
    deep = G.impact(chain.selectExpr("*", "'calls' as type"), ids(spark, "n11"), 10).collect()
    assert {r.id: r.distance for r in deep} == {f"n{11 - d:02}": d for d in range(1, 11)}


def test_collapse_keeps_the_last(spark):
    many = spark.createDataFrame([("a", "b", "calls", 1), ("a", "b", "uses", 2), ("a", "c", "calls", 0)], "from_node string, to_node string, type string, seq long")
    assert {(r.from_node, r.to_node, r.type) for r in G.collapse(many, ["seq"]).collect()} == {("a", "b", "uses"), ("a", "c", "calls")}


def test_closure_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)]
    found = {r.id for r in G.reachable(spark.createDataFrame(pairs, "from_node string, to_node string"), ids(spark, "n0")).collect()}
    seen, todo = {"n0"}, ["n0"]
    while todo:
        at = todo.pop()
        for a, b in pairs:
            if a == at and b not in seen:
                seen.add(b)
                todo.append(b)
    assert found == seen


def test_entry_rules(spark, nodes, edges):
    found = {r.id: r.category for r in G.entry_points(nodes).collect()}
    assert found == {"main": "main", "main.run": "cli"}
    expanded = {r.id for r in G.expand_entries(nodes, edges, ids(spark, "main.run")).collect()}
    assert expanded == {"main.run"}


def test_context_and_tests(spark, nodes, edges):
    found = {(r.direction, r.id, r.distance) for r in G.context(edges, ids(spark, "service.process"), 1).collect()}
    assert found == {("caller", "main.run", 1), ("callee", "service.validate", 1), ("callee", "db.save", 1)}
    more = spark.createDataFrame([("t.test_save", "function", "test_save_all", "t.py", 1, 2, "")], nodes.schema)
    assert {(r.start, r.id) for r in G.related_tests(nodes.union(more), edges, ids(spark, "db.save")).collect()} == {("db.save", "t.test_save")}
