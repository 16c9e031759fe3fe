"""Queries of the sources' readers and writers, virtual nodes, rules, infrastructure and upkeep, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import extract
from ..operators import aggregates as A
from ..operators import explain as E
from ..operators import graph as G
from ..operators import incremental as U
from ..operators import mutate as M
from ..operators import rules as R
from ..sources import config_files, feeds, files, python_code, script_code
from ..streaming import events as S
from . import binding
from .binding import table
from .driver_queries import flat, query
from .source_queries import _stream, made, nations
from .tables import shared_dir


def _folder(s) -> str:
    return f"{shared_dir(s)}/feed-{uuid.uuid4().hex}"


def _documents(s, texts, column: str = "text") -> str:
    """A folder with one file for each text."""
    path = _folder(s)
    texts.select(column).write.option("maxRecordsPerFile", 1).text(path, lineSep="\n")
    return path


# ---- files


@query("SELECT 'src/a' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'x/lib/a' || p_partkey || '.ts' FROM part WHERE p_partkey % 5 = 3")
def s2_wanted(s, d):
    k = F.col("p_partkey").cast("string")
    names = ("src/a", ".py"), ("node_modules/a", ".js"), ("lib/a", ".py"), ("x/lib/a", ".ts"), ("src/my-venv/a", ".py")
    path = F.get(F.array(*(F.concat(F.lit(a), k, F.lit(b)) for a, b in names)), (F.col("p_partkey") % 5).cast("int"))
    return table(s, d, "part").select(path.alias("path")).filter(files.wanted(F.col("path")))


@query("SELECT 'f' || n_nationkey || '.py' AS file_path, unnest([n_nationkey, n_nationkey + 7])::BIGINT AS line FROM nation")
def s10_coverage(s, d):
    k, at = F.col("k"), (F.col("n_nationkey") + 7).cast("string")
    texts = made(nations(s, d), (k,), '{"files": {"f', k, '.py": {\n "executed_lines": [', k, ", ", at, "]}}}")
    return feeds.coverage(s, _documents(s, texts)).select("file_path", F.col("line").cast("long").alias("line"))


@query("SELECT 'a' || n_nationkey || '.py' AS file_path, n_nationkey::INTEGER AS line, CASE WHEN n_regionkey = 1 THEN 'HIGH' ELSE 'LOW' END AS severity, 'B' || n_nationkey AS rule FROM nation")
def s10_findings(s, d):
    k = F.col("k")
    texts = made(nations(s, d), (k,), '{"results": [{"filename": "a', k, '.py", "line_number": ', k, ', "issue_severity": "', F.when(F.col("n_regionkey") == 1, "HIGH").otherwise("LOW"), '", "issue_confidence": "LOW", "test_id": "B', k, '", "issue_text": "t"}]}')
    return feeds.security_findings(s, _documents(s, texts)).select("file_path", "line", "severity", "rule")


@query("SELECT 'p' || n_nationkey AS package, 'V-' || n_nationkey AS id, '2.' || n_nationkey AS detail FROM nation UNION ALL SELECT 'js' || n_nationkey, 'high', '<' || n_nationkey FROM nation")
def s10_audits(s, d):
    k = F.col("k")
    python = made(nations(s, d), (k,), '{"dependencies": [{"name": "p', k, '", "version": "1", "vulns": [{"id": "V-', k, '", "fix_versions": ["2.', k, '"]}]}]}')
    node = made(nations(s, d), (k,), '{"vulnerabilities": {"js', k, '": {"severity": "high", "range": "<', k, '"}}}')
    a = feeds.python_audit(s, _documents(s, python)).select("package", "id", F.col("fixed").alias("detail"))
    return a.unionByName(feeds.node_audit(s, _documents(s, node)).select("package", F.col("severity").alias("id"), F.col("range").alias("detail")))


@query("SELECT 'r' || n_nationkey AS id, 'no_dependency' AS type, lower(n_name) || '.*' AS from_pattern FROM nation")
def s12_rules(s, d):
    rules = nations(s, d).select(F.concat(F.lit("r"), "k").alias("id"), F.lit("no_dependency").alias("type"), F.concat("n", F.lit(".*")).alias("from_pattern"))
    path = _folder(s)
    files.write_rules(rules, path)
    return feeds.arch_rules(s, path, by_line=True).select("id", "type", "from_pattern")


@query("SELECT 'd' || doc_id AS path, (doc_id % 7)::DOUBLE AS mtime, length(text)::BIGINT AS size FROM documents")
def s12_fingerprints(s, d):
    listing = table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), (F.col("doc_id") % 7).cast("double").alias("mtime"), F.length("text").cast("long").alias("size"))
    path = _folder(s)
    files.write_fingerprints(listing, path)
    return feeds.fingerprints(s, path, by_line=True)


@query("SELECT 'a/p' || n_nationkey || '/package.json' AS path, 2::INTEGER AS depth, lower(n_name) AS name, n_nationkey % 2 = 0 AS has_modules FROM nation")
def s13_packages(s, d):
    n, k = nations(s, d), F.col("k")
    packages = made(n, ("a/p", k, "/package.json"), '{"name": "', F.col("n"), '"}')
    modules = made(n.filter("n_nationkey % 2 = 0"), ("a/p", k, "/node_modules/x/index.js"), "x")
    return files.packages(packages.unionByName(modules))


@query("SELECT NULL::VARCHAR AS id, NULL::VARCHAR AS type WHERE false")
def k2_empty(s, d):
    return files.empty(s, "id string, type string")


@query("""WITH m AS (SELECT count(p_size)::DOUBLE AS n, round(avg(p_size), 1)::DOUBLE AS mean, min(p_size)::DOUBLE AS least, max(p_size)::DOUBLE AS most FROM part)
SELECT 'n' AS key, n AS value FROM m UNION ALL SELECT 'mean', mean FROM m UNION ALL SELECT 'least', least FROM m UNION ALL SELECT 'most', most FROM m""")
def k5_project_metrics(s, d):
    metrics = A.project_metrics(table(s, d, "part"), "p_size").select("n", "mean", "least", "most")
    stored = U.save_metrics(s.createDataFrame([("n", "0")], "key string, value string"), metrics)
    return stored.select("key", F.col("value").cast("double").alias("value"))


@query("SELECT event_type AS action, count(*) AS n FROM events GROUP BY 1")
def k6_record_change(s, d):
    path, e = _folder(s), table(s, d, "events").select("event_id", F.col("event_type").alias("action"))
    files.append_log(e.filter("event_id % 2 = 0"), path)
    files.append_log(e.filter("event_id % 2 = 1"), path)
    return A.count_by(s.read.parquet(path), "action")


@query("SELECT l_suppkey::VARCHAR AS from_node, l_partkey::VARCHAR AS to_node, count(*) AS n FROM lineitem GROUP BY ALL")
def k8_trace(s, d):
    calls = U.call_counts(table(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("a"), F.col("l_partkey").cast("string").alias("b")).withColumn("b", F.concat(F.lit("p"), "b")), "a", "b")
    path = _folder(s)
    files.write_trace(calls.withColumn("to_node", F.expr("substring(to_node, 2)")), path)
    return feeds.traces(s, path, by_line=True)


@query("""SELECT 'infra.service.web' || n_nationkey AS id, 'block' AS type, 'web' || n_nationkey AS name FROM nation UNION ALL SELECT 'infra.build.d' || n_nationkey || '.Dockerfile', 'block', 'Dockerfile' FROM nation
UNION ALL SELECT 'ci.github.w' || n_nationkey, 'module', 'w' || n_nationkey FROM nation UNION ALL SELECT 'ci.github.w' || n_nationkey || '.go', 'block', 'go' FROM nation
UNION ALL SELECT 'sql.q' || n_nationkey, 'module', 'q' || n_nationkey || '.sql' FROM nation UNION ALL SELECT 'native.ctypes.x' || n_nationkey, 'module', 'x' || n_nationkey FROM nation""")
def k9_virtual_nodes(s, d):
    n, k = nations(s, d), F.col("k")
    found = [
        config_files.service_graph(config_files.compose(made(n, ("c", k, "/compose.yml"), "services:\n  web", k, ":\n    image: a\n")))[0],
        config_files.build_graph(config_files.dockerfile(made(n, ("d", k, "/Dockerfile"), "FROM a\nENV B=", k, "\n")))[0],
        config_files.workflow_graph(config_files.workflows(made(n, (".github/workflows/w", k, ".yml"), "on: push\njobs:\n  go:\n    runs-on: x\n")))[0],
        config_files.sql_files(made(n, ("q", k, ".sql"), "SELECT 1 FROM t", k))[0],
        extract.binding_graph(extract.bindings(n.select(k.alias("id"), F.concat(F.lit("ctypes.CDLL('libx"), k, F.lit(".so')")).alias("source_code"))))[0],
    ]
    out = found[0].select("id", "type", "name")
    for df in found[1:]:
        out = out.unionByName(df.select("id", "type", "name"))
    return out


# ---- entry points


NAMES = ("main", "test_x", "cmd_go", "handle_y", "a_view", "upgrade", "visit_z", "_detect_q", "get_a", "MyEnum", "plain", "__init__", "_hidden")
PLACES = ("src/plain.py", "tests/a.py", "app/router.py", "pkg/conftest.py", "pkg/__init__.py", "db/versions/v1.py", "admin.py")
BODIES = ("", "@app.get('/')", "@pytest.fixture", "pre_save", "@celery.task", "event.listen(x)", "@validator", "@click.command")
TYPES = ("function", "method", "class", "block")
_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
MIXED = f"""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'm.f' || p_partkey ELSE 'a.m.f' || p_partkey END AS id, {_list(NAMES)}[p_partkey % {len(NAMES)} + 1] AS name, {_list(PLACES)}[p_size % {len(PLACES)} + 1] AS file_path,
{_list(BODIES)}[(p_partkey + p_size) % {len(BODIES)} + 1] AS source_code, {_list(TYPES)}[p_partkey // 2 % {len(TYPES)} + 1] AS type FROM part"""


def mixed_nodes(s, d):
    pick = lambda xs, at: F.get(F.array(*(F.lit(x) for x in xs)), (at % len(xs)).cast("int"))
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(s, d, "part").select(
        F.concat(F.when(k % 3 == 0, "m.f").otherwise("a.m.f"), k).alias("id"), pick(NAMES, k).alias("name"), pick(PLACES, size).alias("file_path"),
        pick(BODIES, k + size).alias("source_code"), pick(TYPES, F.floor(k / 2)).alias("type"),
    )


def _rule_sql(field: str, how: str, values: tuple[str, ...], kinds: tuple[str, ...] | None) -> str:
    one = {"exact": "{f} = {v}", "prefix": "starts_with({f}, {v})", "suffix": "ends_with({f}, {v})", "contains": "contains({f}, {v})"}[how]
    test = " OR ".join(one.format(f=field, v="'" + v.replace("'", "''") + "'") for v in values)
    return f"({field} <> '' AND ({test}))" + (f" AND type IN ({', '.join(repr(k) for k in kinds)})" if kinds else "")


CATEGORY = "CASE " + " ".join(f"WHEN {_rule_sql(f, h, v, t)} THEN '{c}'" for c, f, h, v, t in G.ENTRY_RULES) + """
WHEN ends_with(file_path, '__init__.py') AND type = 'function' AND len(string_split(id, '.')) = 2 THEN 'init_top_level_function'
WHEN type = 'method' AND starts_with(name, '_') AND NOT starts_with(name, '__') THEN 'private_method' END"""


@query(f"SELECT id, category FROM (SELECT id, {CATEGORY} AS category FROM ({MIXED})) WHERE category IS NOT NULL")
def g10_shipped_rules(s, d):
    return G.entry_points(mixed_nodes(s, d))


@query(f"""SELECT id, CASE WHEN ends_with(file_path, '__init__.py') AND type = 'function' AND id LIKE 'm.%' THEN 'init_top_level_function' ELSE 'private_method' END AS category FROM ({MIXED})
WHERE (ends_with(file_path, '__init__.py') AND type = 'function' AND id LIKE 'm.%') OR (type = 'method' AND starts_with(name, '_') AND NOT starts_with(name, '__'))""")
def f12_predicates(s, d):
    return G.entry_points(mixed_nodes(s, d), ())


@query("SELECT 'R' || n_regionkey || '.N' || n_nationkey AS id FROM nation WHERE n_regionkey % 2 = 0")
def g9_public_api(s, d):
    n = binding.nodes(s, d)
    exports = F.when(F.col("id").rlike("^R[024]$"), "__all__ = []").otherwise("")
    return G.public_api(n.withColumn("source_code", exports)).filter("id like 'R%'")


# ---- infrastructure


@query("""WITH g AS (SELECT 'A' || n_nationkey % 9 AS name, 'service:web' || n_nationkey AS origin FROM nation UNION ALL SELECT 'B' || n_nationkey % 9, 'build:d' || n_nationkey FROM nation UNION ALL SELECT 'A' || n_nationkey % 11, 'file:' || n_nationkey || '.env' FROM nation),
u AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'C' END || p_partkey % 12 AS name, 'p' || p_partkey AS who FROM part)
SELECT name, max(origin) AS origin, coalesce(min(items), '') AS items, coalesce(min(n), 0) AS n, max(origin) IS NULL AS undefined
FROM (SELECT name, max(origin) AS origin FROM g GROUP BY name) FULL JOIN (SELECT name, string_agg(who, ',' ORDER BY who) AS items, count(*) AS n FROM u GROUP BY name) USING (name) GROUP BY name""")
def a17_variables(s, d):
    n, k = nations(s, d), F.col("k")
    services = config_files.compose(made(n, ("c", k, "/compose.yml"), "services:\n  web", k, ":\n    environment:\n      - A", (F.col("n_nationkey") % 9).cast("string"), "=1\n"))
    builds = config_files.dockerfile(made(n, ("d", k), "FROM a\nENV B", (F.col("n_nationkey") % 9).cast("string"), "=1\n"))
    env = config_files.env_file(made(n, (k, ".env"), "A", (F.col("n_nationkey") % 11).cast("string"), "=x"))
    text = F.concat(F.lit("os.getenv('"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("C"), F.col("p_partkey") % 12, F.lit("')"))
    used = extract.env_uses(table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), text.alias("source_code")))
    return A.variables(extract.env_definitions(services, builds, env), used.select("name", F.col("id").alias("user")))


@query("""SELECT 'A' || n_nationkey AS name, 'service:web' || n_nationkey AS origin FROM nation UNION ALL SELECT 'B' || n_nationkey, 'build:d' || n_nationkey FROM nation UNION ALL SELECT 'C' || n_nationkey, 'file:' || n_nationkey || '.env' FROM nation""")
def x14_env_definitions(s, d):
    n, k = nations(s, d), F.col("k")
    services = config_files.compose(made(n, ("c", k, "/compose.yml"), "services:\n  web", k, ":\n    environment:\n      A", k, ": 1\n"))
    return extract.env_definitions(services, config_files.dockerfile(made(n, ("d", k), "FROM a\n# ENV X=1\nENV B", k, "=1\n")), config_files.env_file(made(n, (k, ".env"), "C", k, "=x\nlower=1\n")))


@query("SELECT 'koffi' AS bridge, 'm' || p_size AS module, count(DISTINCT p_partkey) AS callers, string_agg(DISTINCT 'f' || p_partkey % 3, ',' ORDER BY 'f' || p_partkey % 3) AS functions FROM part GROUP BY p_size")
def a18_bridges(s, d):
    text = F.concat(F.lit("const l = koffi.load('./libm"), "p_size", F.lit(".so'); l.func('int', 'f"), F.col("p_partkey") % 3, F.lit("', []);"))
    return A.bridges(extract.bindings(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), text.alias("source_code"))))


@query("""WITH x AS (SELECT n_nationkey, 'web' || n_nationkey AS w, 'db' || n_nationkey AS b FROM nation), f AS (SELECT * FROM x WHERE contains(w, '1'))
SELECT 'infra.service' AS category, t AS type, (SELECT 2 * count(*) FROM f) AS nodes, (SELECT count(*) FROM f) AS n FROM (VALUES ('depends_on'), ('uses_env')) v(t)""")
def a19_infrastructure(s, d):
    k = F.col("k")
    services = config_files.compose(made(nations(s, d), ("c", k, "/compose.yml"), "services:\n  web", k, ":\n    depends_on: [db", k, "]\n    environment:\n      - A=1\n  db", k, ":\n    image: x\n"))
    return A.infrastructure(*config_files.service_graph(services), focus="1")


# ---- rules


def _rules() -> list[dict]:
    return [
        {"id": "a", "type": "no_dependency", "from_pattern": "R0.*", "to_pattern": "R1.*"}, {"id": "b", "type": "no_dependency", "from_pattern": "R2/*", "to_pattern": "P.*"},
        {"id": "c", "type": "max_class_methods", "threshold": 4}, {"id": "d", "type": "required_test", "pattern": "Supplier*1"}, {"id": "e", "type": "no_circular_imports"},
    ]


@query("""WITH i AS (SELECT from_node AS a, to_node AS b FROM g_edges WHERE type = 'imports'), walk(start, last, path) AS (SELECT a, b, [a, b] FROM i WHERE b > a
UNION ALL SELECT start, b, list_append(path, b) FROM walk JOIN i ON a = last WHERE b > start AND NOT list_contains(path, b))
SELECT DISTINCT 'a' AS rule_id, from_node || ' → ' || to_node AS violation FROM g_flat WHERE from_node LIKE 'R0.%' AND to_node LIKE 'R1.%'
UNION ALL SELECT DISTINCT 'b', from_node || ' → ' || to_node FROM g_flat WHERE from_node LIKE 'R2.%' AND to_node LIKE 'P.%'
UNION ALL SELECT 'c', regexp_replace(id, '[.][^.]+$', '') FROM g_nodes WHERE type = 'method' GROUP BY 2 HAVING count(*) > 4
UNION ALL SELECT 'd', id FROM g_nodes WHERE type = 'function' AND name LIKE 'Supplier%1'
UNION ALL SELECT 'e', array_to_string(path, ' → ') FROM walk JOIN i ON a = last AND b = start""")
def r2_check(s, d):
    return R.check(binding.nodes(s, d), flat(s, d), _rules()).select("rule_id", "violation")


@query("SELECT 'a' AS rule_id, 'R0.N0 → ' || to_node AS violation FROM g_flat WHERE from_node = 'R0.N0' AND to_node LIKE 'R0.N0.C%'")
def r3_check_node(s, d):
    rules = [{"id": "a", "type": "no_dependency", "from_pattern": "R0.*", "to_pattern": "R0.N0.C*"}, {"id": "c", "type": "max_class_methods", "threshold": 1}]
    return R.check_node(binding.nodes(s, d), flat(s, d), rules, "R0.N0").select("rule_id", "violation")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'given' ELSE 'accessor' END AS role, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE 'network_io' END AS effects FROM part")
def r10_annotate(s, d):
    k = F.col("p_partkey")
    given = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("x")))
    n = table(s, d, "part").select("p_partkey", F.lit("get_part").alias("name"), F.lit("function").alias("type"), F.lit("fetch(1)").alias("source_code"), F.when(k % 2 == 0, "given").alias("role"), given.alias("side_effects"))
    return R.annotate(n).select("p_partkey", "role", F.array_join("side_effects", ",").alias("effects"))


@query("SELECT 'm' || n_nationkey || '.f' AS id, 'm' || n_nationkey || '.h,requests.get' AS mocks FROM nation")
def r12_test_plan(s, d):
    n = nations(s, d)
    one = lambda name, body: n.select(F.concat(F.lit("m"), "k", F.lit(f".{name}")).alias("id"), F.lit("function").alias("type"), F.lit(name).alias("name"), F.lit(body).alias("source_code"))
    nodes = one("f", "def f(x):\n    return g(x) + h(x)\n").unionByName(one("g", "def g(x):\n    return x\n")).unionByName(one("h", "def h(x):\n    return open(x)\n"))
    to = F.explode(F.array(F.concat(F.lit("m"), "k", F.lit(".g")), F.concat(F.lit("m"), "k", F.lit(".h")), F.lit("requests.get")))
    edges = n.select(F.concat(F.lit("m"), "k", F.lit(".f")).alias("from_node"), to.alias("to_node"), F.lit("calls").alias("type"))
    return E.test_plan(nodes, edges).filter("id like '%.f'").select("id", F.array_join("mocks", ",").alias("mocks"))


# ---- parsers


@query("SELECT 'src.m' || s_suppkey || '.work' AS id, 'async def work(a, b: int=' || s_suppkey || ', *c, d=2, **e) -> list[str]' AS signature FROM supplier")
def x2_signatures(s, d):
    k = F.col("s_suppkey").cast("string")
    parsed = python_code.parse(made(table(s, d, "supplier"), ("src/m", k, ".py"), "async def work(a, b: int = ", k, ", *c, d = 2, **e) -> list[str]:\n    pass\n"))
    return python_code.nodes(parsed).filter("type = 'function'").select("id", "signature")


@query("SELECT 'src.m' || s_suppkey || '.' || b AS id, a::INTEGER AS start_line, z::INTEGER AS end_line FROM supplier, (VALUES ('LIMIT', 3, 4), ('block_7', 7, 7), ('__main__', 11, 12)) v(b, a, z)")
def x17_blocks(s, d):
    k = F.col("s_suppkey").cast("string")
    parsed = python_code.parse(made(table(s, d, "supplier"), ("src/m", k, ".py"), "'''text'''\nimport os\nLIMIT = ", k, "\nother = 2\ndef f():\n    pass\nprint(1)\ndef g():\n    pass\n\nif __name__ == '__main__':\n    f()\n"))
    return python_code.nodes(parsed).filter("type = 'block'").select("id", "start_line", "end_line")


@query("""SELECT 'web.m' || s_suppkey AS from_node, 'web.big' AS to_node, 'imports' AS type FROM supplier UNION ALL SELECT 'web.m' || s_suppkey, 'web.o', 'imports' FROM supplier
UNION ALL SELECT 'web.m' || s_suppkey || '.go', 'web.big.n' || s_suppkey % 250, 'calls' FROM supplier UNION ALL SELECT 'web.m' || s_suppkey || '.api.load', 'web.o.q', 'calls' FROM supplier""")
def s4_script_edges(s, d):
    k = F.col("s_suppkey").cast("string")
    names = ", ".join(f"n{i}" for i in range(250))
    text = made(table(s, d, "supplier"), ("web/m", k, ".ts"), f"import {{ {names} }} from './big';\nexport {{ q as r }} from './o';\nfunction go() {{ return n", (F.col("s_suppkey") % 250).cast("string"), "(); }\nconst api = { load: (x) => { return r(x); }, size: 1 };\n")
    return script_code.parse(text).filter("kind = 'edge'").select("from_node", "to_node", "type")


@query("""SELECT n_nationkey::VARCHAR AS id, op, CASE WHEN t = '<unknown>' THEN t ELSE t || lower(replace(n_name, ' ', '_')) END AS "table" FROM nation,
(VALUES ('read', 'a_'), ('write', 'b_'), ('read', 'c_'), ('write', 'd_'), ('write', '<unknown>')) v(op, t)""")
def x11_orm(s, d):
    n = nations(s, d).withColumn("t", F.replace("n", F.lit(" "), F.lit("_")))
    models = [n.select(F.concat(F.lit(m), "k").alias("model"), F.concat(F.lit(f"{m.lower()}_"), "t").alias("table")) for m in "ABCD"]
    known = models[0].unionByName(models[1]).unionByName(models[2]).unionByName(models[3])
    k = F.col("k")
    text = F.concat(F.lit("# A.objects.get(1)\nx = A"), k, F.lit(".objects.filter(a=(1)).first()\nB"), k, F.lit(".objects.create(x=')')\nselect(C"), k, F.lit(").where(1)\nitem = D"), k, F.lit("()\nsession.add(item)\nsession.add_all(xs)"))
    rows = n.select(k.alias("id"), text.alias("source_code"))
    return extract.orm_uses(rows, known).unionByName(extract.session_writes(rows, known))


# ---- upkeep


@query("""WITH st AS (SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'modified' WHEN s_suppkey % 5 = 1 THEN 'deleted' ELSE 'unchanged' END AS status FROM supplier),
o AS (SELECT DISTINCT 's' || l_suppkey AS from_node, CASE WHEN l_partkey % 4 = 0 THEN 's' || (l_partkey % 10 + 1) ELSE 'p' || l_partkey END AS to_node, CASE WHEN l_returnflag = 'A' THEN 'uses_env' ELSE 'calls' END AS type FROM lineitem),
gone AS (SELECT id FROM st WHERE status = 'deleted'), stale AS (SELECT id FROM st WHERE status <> 'unchanged')
SELECT * FROM o WHERE to_node NOT IN (SELECT id FROM gone) AND CASE WHEN type = 'uses_env' THEN from_node NOT IN (SELECT id FROM gone) ELSE from_node NOT IN (SELECT id FROM stale) END
UNION ALL SELECT id, 'new', 'calls' FROM st WHERE status = 'modified'""")
def u7_sync_edges(s, d):
    k = F.col("s_suppkey")
    status = table(s, d, "supplier").select(F.concat(F.lit("s"), k).alias("id"), F.when(k % 3 == 0, "modified").when(k % 5 == 1, "deleted").otherwise("unchanged").alias("status"))
    to = F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("s"), F.col("l_partkey") % 10 + 1)).otherwise(F.concat(F.lit("p"), "l_partkey"))
    old = table(s, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("from_node"), to.alias("to_node"), F.when(F.col("l_returnflag") == "A", "uses_env").otherwise("calls").alias("type")).distinct()
    new = status.select(F.col("id").alias("from_node"), F.lit("new").alias("to_node"), F.lit("calls").alias("type"))
    return U.sync_edges(old, new, status).select("from_node", "to_node", "type")


@query("SELECT DISTINCT user_id::VARCHAR AS queue, event_type AS id FROM events")
def u11_drain_once(s, d):
    live, state = _stream(s, d)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key, None)
    s.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return S.run_available(S.drain_once(live, "user_id", "event_type"), "q" + state[-14:-6].replace("-", "_"), "append", state)
    finally:
        s.conf.set(key, before) if before else s.conf.unset(key)


@query("""WITH a AS (SELECT doc_id, length(text) AS size FROM documents WHERE doc_id % 9 <> 0), b AS (SELECT doc_id, length(text) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 13 <> 0),
x AS (SELECT doc_id AS path, CASE WHEN a.size IS NULL THEN 'added' WHEN b.size IS NULL THEN 'deleted' WHEN a.size <> b.size THEN 'modified' END AS status FROM a FULL JOIN b USING (doc_id))
SELECT path, status, CASE WHEN status = 'deleted' AND path % 9 <> 0 THEN 2 ELSE 0 END::BIGINT AS deleted_nodes FROM x WHERE status IS NOT NULL""")
def u13_tree_diff(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.length("text").alias("size"), F.lit(0.0).alias("mtime"))
    listing = docs.filter("path % 13 != 0").withColumn("size", F.col("size") + F.when(F.col("path") % 5 == 0, 1).otherwise(0))
    nodes = docs.filter("path % 9 != 0").select(F.col("path").alias("file_path"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("id"))
    return U.tree_diff(listing, docs.filter("path % 9 != 0"), nodes)


@query("""SELECT 'f' || n_nationkey AS id, CASE WHEN n_nationkey = 0 THEN 'definition' WHEN n_nationkey % 2 = 0 THEN 'caller' ELSE 'review' END AS role,
CASE WHEN n_nationkey % 2 = 0 THEN 'new(x); older(y)' ELSE 'old(x); older(y)' END AS source_code FROM nation""")
def m4_rename(s, d):
    n = nations(s, d).select(F.concat(F.lit("f"), "k").alias("id"), F.lit("old(x); older(y)").alias("source_code"), "n_nationkey")
    edges = n.filter("n_nationkey % 2 = 0 and n_nationkey > 0").select(F.col("id").alias("from_node"), F.lit("f0").alias("to_node"))
    return M.rename(n, edges, "f0", "old", "new")


@query("SELECT n_nationkey::VARCHAR AS path, 'one' AS text, CASE WHEN n_nationkey = 3 THEN 'overlap' ELSE 'rolled_back' END AS status FROM nation")
def m5_batch(s, d):
    n = nations(s, d)
    edits = n.select(F.col("k").alias("path"), F.lit(1).alias("start"), F.lit(1).alias("end"), F.lit("two").alias("text"))
    return M.batch(made(n, (F.col("k"),), "one"), edits.unionByName(edits.filter("path = '3'")))


@query("SELECT count(*) AS n FROM g_nodes WHERE id NOT LIKE 'P.Brand#1%'")
def m3_delete(s, d):
    n = binding.nodes(s, d)
    left, _ = U.delete_nodes(n, binding.edges(s, d), n.filter("id like 'P.Brand#1%'"))
    return left.agg(F.count("*").alias("n"))


# ---- what the summaries show beside their counts


@query("SELECT type, count(*) AS n FROM g_nodes GROUP BY type")
def a1_nodes_by_type(s, d):
    return A.count_by(binding.nodes(s, d), "type")


@query("SELECT DISTINCT from_node, to_node, type FROM g_edges WHERE confidence = 'unresolved' ORDER BY ALL LIMIT 20")
def a1_unresolved_sample(s, d):
    return A.unresolved_sample(binding.edges(s, d))


@query("""WITH m AS (SELECT id, regexp_replace(id, '[.][^.]+$', '') AS owner FROM g_nodes WHERE type IN ('method', 'function')), x AS (SELECT owner, to_node, type, starts_with(to_node, owner || '.') AS inside FROM g_edges JOIN m ON from_node = id),
f AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY to_node) AS r FROM (SELECT DISTINCT owner, to_node FROM x WHERE NOT inside))
SELECT owner, (SELECT count(*) FROM f WHERE f.owner = o.owner) AS dependency_count, coalesce((SELECT string_agg(to_node, ',' ORDER BY to_node) FROM f WHERE f.owner = o.owner AND r <= 20), '') AS dependencies,
count(*) FILTER (inside AND type = 'calls') AS internal_calls FROM x o GROUP BY owner""")
def a5_class_dependencies(s, d):
    members = binding.nodes(s, d).filter("type in ('method', 'function')").withColumn("owner", F.regexp_replace("id", r"\.[^.]+$", ""))
    return A.class_dependencies(binding.edges(s, d), members, "owner")


@query("SELECT type, count(*) AS total, count(*) FILTER (name LIKE '%3') AS annotated FROM g_nodes GROUP BY type")
def a9_annotated_by(s, d):
    n = binding.nodes(s, d).withColumn("summary", F.when(F.endswith("name", F.lit("3")), F.col("name"))).withColumn("role", F.lit(None).cast("string"))
    return A.annotated_by(n, "type")


@query("SELECT sum(seq)::BIGINT AS runtime_calls FROM g_edges WHERE source = 'runtime'")
def a10_runtime_calls(s, d):
    return A.runtime_calls(binding.edges(s, d).withColumn("runtime_calls", F.when(F.col("source") == "runtime", F.col("seq"))))


@query("SELECT user_id, min_by(event_type, (ts, event_type)) AS file_path FROM events WHERE event_type <> 'view' GROUP BY user_id")
def a11_first_paths(s, d):
    log = table(s, d, "events").withColumn("file_path", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")))
    return A.first_paths(log, "user_id", "ts")


@query("""WITH x AS (SELECT DISTINCT to_node, from_node, CASE type WHEN 'calls' THEN 'callers' WHEN 'imports' THEN 'importers' WHEN 'inherits' THEN 'inheritors' ELSE 'other' END AS usage FROM g_edges)
SELECT to_node, usage, count(*) AS n, count(*) FILTER (lower(n.file_path) LIKE '%test%' OR n.name LIKE 'test~_%' ESCAPE '~') AS tests,
CASE WHEN count(*) <= 30 THEN string_agg(from_node, ',' ORDER BY from_node) ELSE '' END AS items FROM x LEFT JOIN g_nodes n ON n.id = from_node GROUP BY ALL""")
def a24_usage_lists(s, d):
    return A.usages(binding.edges(s, d), binding.nodes(s, d))


@query("SELECT file_path, g_nodes.id, count(f.id) > 0 AS public FROM g_nodes LEFT JOIN (SELECT n.id AS id, m.file_path AS origin, n.file_path AS home FROM g_edges e JOIN g_nodes n ON e.to_node = n.id JOIN g_nodes m ON e.from_node = m.id WHERE n.file_path <> m.file_path) f ON f.id = g_nodes.id GROUP BY ALL")
def a8_members(s, d):
    return A.component_members(binding.edges(s, d), binding.nodes(s, d), "file_path")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'src/a' || doc_id || '.ts' WHEN 1 THEN 'lib/a' || doc_id || '/index.js' END AS file FROM documents")
def x6_probe(s, d):
    settings = s.createDataFrame([("jsconfig.json", "{}"), ("tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["src/*", "lib/*"]}}}')], "path string, text string")
    k, docs = F.col("doc_id"), table(s, d, "documents")
    spec = F.concat(F.lit("@/a"), k, F.when(k % 4 == 3, ".css").otherwise(""))
    there = F.when(k % 4 == 0, F.array(F.concat(F.lit("src/a"), k, F.lit(".ts")), F.concat(F.lit("lib/a"), k, F.lit(".ts")))).when(k % 4 == 1, F.array(F.concat(F.lit("lib/a"), k, F.lit("/index.js")))).when(k % 4 == 3, F.array(F.concat(F.lit("src/a"), k, F.lit(".css"))))
    files_ = docs.select(F.explode(there).alias("path"))
    resolved = extract.resolve_alias(docs.select("doc_id", spec.alias("spec")), extract.aliases(extract.script_settings(settings)))
    return extract.probe(resolved, files_, "doc_id")
