import random
import statistics

from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import aggregates as A
from loomgraph.operators import explain as E
from loomgraph.operators import filters as P
from loomgraph.operators import incremental as U
from loomgraph.operators import joins as J
from loomgraph.operators import mutate as M
from loomgraph.operators import rules as R


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, X.normalise_route(F.col("p")), p="/a/${x}/{id}/:name/?q=1") == "/a/:param/:param/:param"
    assert one(spark, X.parent_of(F.col("p")), p="a.b.c") == "a.b"
    assert one(spark, X.suffixes_of(F.col("p")), p="a.b.c") == ["b.c", "c"]
    assert one(spark, X.ancestors_of(F.col("p")), p="a.b.c") == ["a", "a.b"]
    assert one(spark, X.occurrences(F.col("p"), "ab"), p="abxabab") == 3
    assert one(spark, X.matches_glob(F.col("p"), "src/*.py"), p="src.a.py") is True
    for how, parts, hit in (("exact", ["ab"], False), ("prefix", ["x", "a"], True), ("suffix", ["c"], True), ("contains", ["b"], True), ("contains", [], False)):
        assert one(spark, X.any_of(F.col("p"), parts, how), p="abc") is hit
    assert one(spark, X.any_of(F.col("p"), [""], "contains"), p="") is False


def test_smallest_container(spark):
    spans = spark.createDataFrame([("f", "big", 1, 100), ("f", "small", 10, 20), ("g", "other", 1, 100)], "file string, id string, a int, b int")
    points = spark.createDataFrame([("f", 1, 15), ("f", 2, 50), ("f", 3, 200), ("g", 4, 15)], "file string, k int, line int")
    found = J.containing(points, spans, ["file"], "line", "a", "b", ["k"], ["id"])
    assert sorted((r.k, r.id) for r in found.collect()) == [(1, "small"), (2, "big"), (4, "other")]


def test_overlaps_against_brute_force(spark):
    a, b = [(i, i * 7 % 90, i * 7 % 90 + i % 13) for i in range(40)], [(i, i * 11 % 90, i * 11 % 90 + i % 29) for i in range(40)]
    left, right = spark.createDataFrame(a, "x int, a int, b int"), spark.createDataFrame(b, "y int, c int, d int")
    found = {(r.x, r.y) for r in J.overlapping(left, right, "a", "b", "c", "d", 10).collect()}
    assert found == {(x, y) for x, s, e in a for y, c, d in b if s <= d and c <= e}
    assert J.overlapping(left, right, "a", "b", "c", "d", 10).count() == len(found)


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 0, "c")], "k int, u int, v string")
    strict = {(r.k, r.t): r.v for r in J.next_after(left, right, ["k"], "t", "u", ["v"]).collect()}
    loose = {(r.k, r.t): r.v for r in J.next_after(left, right, ["k"], "t", "u", ["v"], strict=False).collect()}
    assert strict == {(1, 5): "b", (1, 10): None, (2, 1): None} and loose[1, 5] == "a"
    back = {(r.k, r.t): r.v for r in J.last_before(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert back == {(1, 5): None, (1, 10): "b", (2, 1): "c"}


def test_routes(spark):
    calls = spark.createDataFrame([("c1", "GET", "/api/users/7"), ("c2", "POST", "/api/users"), ("c3", "GET", "/:param/users/7")], "c string, m string, p string")
    routes = spark.createDataFrame([("r1", "GET", "/api/users/:param"), ("r2", "ANY", "/api/users"), ("r3", "GET", "/:param/x/7")], "r string, n string, q string")
    assert sorted((r.c, r.r) for r in J.route_matches(calls, routes, "p", "q", "m", "n").collect()) == [("c1", "r1"), ("c2", "r2"), ("c3", "r1")]


def test_as_of_over_one_key_is_one_pass(spark):
    import time

    df = spark.range(40_000).selectExpr("1 as k", "id as t")
    right = df.filter("t % 1000 = 0").selectExpr("k", "t as u", "t as v")
    began = time.perf_counter()
    found = J.next_after(df, right, ["k"], "t", "u", ["v"]).agg(F.sum("v")).first()[0]
    assert found == sum((t // 1000 + 1) * 1000 for t in range(39_000)) and time.perf_counter() - began < 8


def test_as_of_against_brute_force(spark):
    rng = random.Random(4)
    left = [(rng.randrange(3), rng.randrange(30), i) for i in range(60)]
    right = [(rng.randrange(3), rng.randrange(30), f"v{i:02}") for i in range(30)]
    a, b = spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, u int, v string")
    for join, strict in ((J.next_after, True), (J.next_after, False), (J.last_before, True), (J.last_before, False)):
        found = {r.i: r.v for r in join(a, b, ["k"], "t", "u", ["v"], strict).collect()}
        for k, t, i in left:
            ahead = join is J.next_after
            fits = [(u, v) for q, u, v in right if q == k and ((u > t if ahead else u < t) or (u == t and not strict))]
            edge = (min if ahead else max)((u for u, _ in fits), default=None)
            # of several at one time the first by value ahead, the last behind
            want = (min if ahead else max)((v for u, v in fits if u == edge), default=None)
            assert found[i] == want


def test_intervals_against_brute_force(spark):
    rng = random.Random(6)
    spans = [(rng.randrange(2), f"s{i}", a := rng.randrange(-50, 400), a + rng.choice([0, 3, 40, 300])) for i in range(60)]
    points = [(rng.randrange(2), rng.randrange(-60, 500), i) for i in range(120)]
    left, right = spark.createDataFrame(points, "f int, p int, k int"), spark.createDataFrame(spans, "f int, id string, a int, b int")
    inside = {k: [(b - a, i, a) for g, i, a, b in spans if g == f and a <= p <= b] for f, p, k in points}
    found = {r.k: r.id for r in J.containing(left, right, ["f"], "p", "a", "b", ["k"], ["id"]).collect()}
    assert found == {k: min(x)[1] for k, x in inside.items() if x}
    last = {r.k: r.id for r in J.latest_start(left, right, ["f"], "p", "a", "b", ["k"], "id").collect()}
    assert last == {k: max((a, i) for _, i, a in x)[1] for k, x in inside.items() if x}
    held = {r.id: r.covered for r in J.covered_counts(left, right, ["f"], "p", "a", "b", "id").collect()}
    assert held == {i: len({p for g, p, _ in points if g == f and a <= p <= b}) for f, i, a, b in spans}


def test_routes_against_brute_force(spark):
    rng = random.Random(7)
    part = lambda: rng.choice(["a", "b", ":param", ""])
    made = lambda n, tag: [(f"{tag}{i}", rng.choice(["GET", "POST", "ANY"]), "/".join(["", *(part() for _ in range(rng.randrange(0, 4)))])) for i in range(n)]
    calls, routes = made(80, "c"), made(80, "r")
    fits = lambda p, q: len(p) == len(q) and all(x == y or ":param" in (x, y) for x, y in zip(p, q))
    want = {(c, r) for c, m, p in calls for r, n, q in routes if (m == n or "ANY" in (m, n)) and fits(p.split("/"), q.split("/"))}
    found = [(r.c, r.r) for r in J.route_matches(spark.createDataFrame(calls, "c string, m string, p string"), spark.createDataFrame(routes, "r string, n string, q string"), "p", "q", "m", "n").collect()]
    assert set(found) == want and len(found) == len(want)


def test_median_and_capped_lists(spark):
    for values in ([1], [1, 2], [5, 1, 1, 9], [3, 3, 3, 4, 4], [None, 2, 8]):
        df = spark.createDataFrame([(v,) for v in values], "v int")
        assert A.project_metrics(df, "v").first()["median"] == round(statistics.median(v for v in values if v is not None), 1)
    df = spark.createDataFrame([("g", f"i{k:02}") for k in range(30)] + [("h", "x")], "g string, i string")
    assert sorted(map(tuple, A.grouped_list(df, "g", "i", most=2).collect())) == [("g", "i00,i01", 30), ("h", "x", 1)]


def test_rules_of_four_types(spark):
    nodes = spark.createDataFrame([("m.K", "class", "K", "m.py"), *((f"m.K.f{i}", "method", f"f{i}", "m.py") for i in range(5)), ("m.api_go", "function", "api_go", "m.py"), ("m.api_ok", "function", "api_ok", "m.py"), ("t.test_ok", "function", "test_ok", "t.py")], "id string, type string, name string, file_path string")
    edges = spark.createDataFrame([("t.test_ok", "m.api_ok", "calls"), ("ui.a", "db.b", "imports"), ("db.b", "ui.a", "imports")], "from_node string, to_node string, type string")
    rules = [
        {"id": "1", "type": "no_dependency", "from_pattern": "ui/*", "to_pattern": "db.*", "description": "layers"}, {"id": "2", "type": "max_class_methods", "threshold": 4},
        {"id": "3", "type": "required_test", "pattern": "api_*"}, {"id": "4", "type": "no_circular_imports"},
    ]
    found = {(r.rule_id, r.description, r.violation) for r in R.check(nodes, edges, rules).collect()}
    assert found == {("1", "layers", "ui.a → db.b"), ("2", "max_class_methods", "m.K"), ("3", "required_test", "m.api_go"), ("4", "no_circular_imports", "db.b → ui.a")}
    assert R.check(nodes, edges, []).count() == 0
    assert [r.rule_id for r in R.check_node(nodes, edges, rules, "ui.a").collect()] == ["1"] and [r.rule_id for r in R.check_node(nodes, edges, rules, "m.api_go").collect()] == ["3"]


def test_secret_names(spark):
    for text, kind in {
        "db_password = 'abc'": "hardcoded password", "x.api_key='123456'": "hardcoded API key", "TOKEN=\"12345678\"": "hardcoded token", "client_secret = 'abcdef'": "hardcoded secret",
        "password = 'ab'": None, "password == 'abcdef'": None, "token = get()": None, "passwords = 'abcdef'": None, "token = '1234567'": None,
    }.items():
        assert one(spark, R.first_secret(F.col("t")), t=text) == kind, text


def test_unique_suffixes(spark):
    ids = spark.createDataFrame([("a.b.c",), ("x.c",), ("x.d",)], "id string")
    edges = spark.createDataFrame([("b.c", "c"), ("d", "a.b.c")], "from_node string, to_node string")
    assert sorted(map(tuple, J.normalise_ends(edges, ids).select("from_node", "to_node").collect())) == [("a.b.c", "c"), ("x.d", "a.b.c")]


def test_resolve_tiers(spark):
    n = spark.createDataFrame([("a.run", "run"), ("b.run", "run"), ("b.runner", "runner")], "id string, name string")
    assert [r.id for r in P.resolve_id(n, "a.run").collect()] == ["a.run"]
    assert [r.id for r in P.resolve_id(n, "run").collect()] == ["a.run", "b.run"]
    assert [r.id for r in P.resolve_id(n, "unner").collect()] == ["b.runner"]


def test_percentiles(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "v int")
    assert A.index_percentile(df, "v", 0.9).first().v == 10
    row = A.project_metrics(df, "v").first()
    assert (row.n, row.mean, row.median, row.p90, row.p95) == (10, 5.5, 5.5, 10, 10)
    ranks = {r.v: r.percentile_rank for r in A.percentile_rank(df, "v").collect()}
    assert ranks[1] == 0 and ranks[10] == 90


def test_rules(spark):
    src = "def handler():\n" + "    x = 1\n" * 12 + "    requests.get('u')\n    password = 'hunter22'"
    n = spark.createDataFrame([("f", "delete_handler", src)], "id string, name string, source_code string")
    assert {r.rule for r in R.requirement_issues(n).collect()} == {"io_without_error_handling", "no_logging", "hardcoded_secret", "no_input_validation", "no_auth_check"}
    for name, kind, role in (("get_user", "function", "accessor"), ("UserService", "class", "orchestrator"), ("__enter__", "method", "handler"), ("_x", "method", "utility"), ("test_a", "function", "test")):
        assert one(spark, R.role_of(F.col("n"), F.col("k")), n=name, k=kind) == role
    assert one(spark, R.effects_of(F.col("n"), F.col("s")), n="save_it", s="print(1)") == ["console_output", "writes_database"]
    assert one(spark, R.health_score(F.lit(100.0), F.lit(0.0), F.lit(0), F.lit(0), F.lit(True), F.lit(100.0), F.lit(100.0)), z=1) == 100
    assert one(spark, R.grade(F.col("s")), s=76) == "B"


def test_upsert(spark):
    edges = spark.createDataFrame([("a", "b", "static", None), ("a", "c", "runtime", 2), ("a", "d", "both", 3), ("x", "y", "static", None)], "from_node string, to_node string, source string, runtime_calls long")
    calls = spark.createDataFrame([("a", "b", 1), ("a", "b", 4), ("a", "c", 7), ("a", "d", 9), ("n", "m", 1)], "from_node string, to_node string, n long")
    found = {(r.from_node, r.to_node): (r.source, r.runtime_calls, r.change) for r in U.upsert_runtime(edges, calls).collect()}
    assert found == {("a", "b"): ("both", 5, "upgraded"), ("a", "c"): ("runtime", 7, "counted"), ("a", "d"): ("both", 3, "kept"), ("x", "y"): ("static", None, "kept"), ("n", "m"): ("runtime", 1, "new")}


def test_sync_keeps_annotations_and_incoming_edges(spark):
    old = spark.createDataFrame([("u.helper", "h1", "note"), ("app.main", "h2", None), ("u.gone", "h3", "x")], "id string, hash string, summary string")
    new = spark.createDataFrame([("u.helper", "h9", None), ("app.main", "h2", None), ("u.fresh", "h4", None)], "id string, hash string, summary string")
    nodes = {r.id: (r.status, r.summary) for r in U.sync_nodes(old, new, ["summary"]).collect()}
    assert nodes == {"u.helper": ("modified", "note"), "app.main": ("unchanged", None), "u.fresh": ("added", None), "u.gone": ("deleted", None)}
    status = U.diff(old, new, "id", "hash")
    e = "from_node string, to_node string, type string"
    before = spark.createDataFrame([("app.main", "u.helper", "calls"), ("u.helper", "u.gone", "calls"), ("u.helper", "db.table.x", "reads_table"), ("app.main", "u.gone", "calls")], e)
    after = U.sync_edges(before, spark.createDataFrame([("u.helper", "u.fresh", "calls"), ("app.main", "ignored", "calls")], e), status)
    assert {(r.from_node, r.to_node) for r in after.collect()} == {("app.main", "u.helper"), ("u.helper", "db.table.x"), ("u.helper", "u.fresh")}


def test_pending_and_notes(spark):
    prints, listing = spark.createDataFrame([("a", 1.0, 5), ("b", 1.0, 5), ("c", 1.0, 5)], "path string, mtime double, size long"), spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, 5), ("d", 1.0, 1)], "path string, mtime double, size long")
    assert {(r.path, r.status) for r in U.pending(listing, prints).collect()} == {("b", "changed"), ("c", "gone"), ("d", "new")}
    notes = spark.createDataFrame([("k", "old", 1), ("z", "z", 1)], "key string, value string, updated_at int")
    assert {(r.key, r.value) for r in U.write_note(notes, spark.createDataFrame([("k", "new", 2)], notes.schema)).collect()} == {("k", "new"), ("z", "z")}


def test_edits(spark):
    files = spark.createDataFrame([("a.py", "one\n    two\nthree"), ("b.py", "x\ny")], "path string, text string")
    edits = spark.createDataFrame([("a.py", 2, 2, "2\n  2b"), ("a.py", 3, 3, "drei")], "path string, start int, end int, text string")
    assert {r.path: (r.text, r.status) for r in M.apply_edits(files, edits).collect()} == {"a.py": ("one\n    2\n      2b\ndrei", "edited"), "b.py": ("x\ny", "unchanged")}
    clash = edits.union(spark.createDataFrame([("b.py", 1, 2, "q"), ("b.py", 2, 2, "r")], edits.schema))
    assert {r.path: r.status for r in M.batch(files, clash).collect()} == {"a.py": "rolled_back", "b.py": "overlap"}


def test_validation_and_patch(spark):
    rows = [("a", "def f(x): pass", "def f(x, y): pass"), ("b", "def f(): pass", "class F: pass"), ("c", "x = 1", "x ="), ("d", "def f(x): pass", "def f(): pass")]
    found = {r.id: r for r in M.validate(spark.createDataFrame(rows, "id string, old_source string, new_source string")).collect()}
    assert found["a"].valid and found["a"].warnings == ["new required parameter: y"]
    assert not found["b"].valid and found["b"].error.startswith("structure") and not found["c"].valid and found["c"].error.startswith("syntax")
    assert found["d"].warnings == ["removed parameter: x"]
    n = spark.createDataFrame([("a", "x y x"), ("b", "x")], "id string, source_code string")
    assert {r.id: (r.status, r.source_code) for r in M.patch(n, "x", "z").collect()} == {"a": ("ambiguous", "x y x"), "b": ("patched", "z")}


def test_explain():
    f = E.facts("load_user", "def load_user(uid: int, db):\n    if not uid:\n        raise ValueError('x')\n    for r in db:\n        pass\n    return None\n")
    assert f["inputs"] == ["uid: int", "db"] and f["raises"] == ["ValueError"] and f["purpose"] == "Loads user" and f["complexity"] == "simple"
    assert f["scenarios"] == ["happy_path", "when_not_uid", "raises_valueerror", "empty_input", "returns_none"]
    assert E.facts("x", "def (")["inputs"] == []
