"""Queries of the parsers, mappers, feeds and the operators on top of them: sources are made from the driver's rows, so that SQL knows the answer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import extract
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import explain as E
from ..operators import filters as P
from ..operators import graph as G
from ..operators import incremental as U
from ..operators import joins as J
from ..operators import mutate as M
from ..operators import rules as R
from ..sources import config_files, feeds, python_code, script_code
from ..streaming import events as S
from . import binding
from .binding import table
from .driver_queries import flat, query


def nations(s, d):
    return table(s, d, "nation").withColumn("n", F.lower("n_name")).withColumn("k", F.col("n_nationkey").cast("string"))


def made(df, path, *parts):
    """(path, text): a text of each row, of literals and columns."""
    piece = lambda p: p if isinstance(p, F.Column) else F.lit(p)
    return df.select(F.concat(*(piece(p) for p in path)).alias("path"), F.concat(*(piece(p) for p in parts)).alias("text"))


# ---- parsers


@query("""SELECT 'src.m' || s_suppkey || '.' || f AS id, t AS type FROM supplier, (VALUES ('K', 'class'), ('K.go', 'method'), ('work', 'function')) v(f, t)
UNION ALL SELECT 'src.m' || s_suppkey, 'module' FROM supplier""")
def s3_python_nodes(s, d):
    return python_code.nodes(_python(s, d)).select("id", "type")


def _python(s, d):
    p = table(s, d, "supplier").withColumn("k", F.col("s_suppkey").cast("string")).withColumn("o", (F.col("s_suppkey") % 7).cast("string"))
    k, o = F.col("k"), F.col("o")
    files = made(p, ("src/m", k, ".py"), "import os\nfrom src.m", o, " import work as other, K as Base\n\nclass K(Base):\n    def go(self):\n        return self.stop(other())\n\ndef work(x):\n    return len(x)\n")
    return python_code.parse(files)


@query("""WITH m AS (SELECT 'src.m' || s_suppkey AS a, 'src.m' || s_suppkey % 7 AS b FROM supplier)
SELECT a AS from_node, 'os' AS to_node, 'imports' AS type FROM m UNION ALL SELECT a, b || '.work', 'imports' FROM m UNION ALL SELECT a, b || '.K', 'imports' FROM m UNION ALL SELECT a || '.K', b || '.K', 'inherits' FROM m
UNION ALL SELECT a || '.K.go', a || '.K.stop', 'calls' FROM m UNION ALL SELECT a || '.K.go', b || '.work', 'calls' FROM m UNION ALL SELECT a || '.work', 'len', 'calls' FROM m""")
def x1_python_edges(s, d):
    return python_code.edges(_python(s, d)).select("from_node", "to_node", "type")


@query("""SELECT 'web.m' || s_suppkey || '.go' AS from_node, 'web.m' || s_suppkey % 5 || '.start' AS to_node FROM supplier UNION ALL SELECT 'web.m' || s_suppkey || '.start', 'web.m' || s_suppkey || '.go' FROM supplier""")
def s4_script_calls(s, d):
    p = table(s, d, "supplier").withColumn("k", F.col("s_suppkey").cast("string")).withColumn("o", (F.col("s_suppkey") % 5).cast("string"))
    files = made(p, ("web/m", F.col("k"), ".js"), "import { start as s } from './m", F.col("o"), "';\nconst go = (x) => { return s(x); };\nexport function start(a) { if (a) { return go(a); } }\n")
    return script_code.parse(files).filter("kind = 'edge' and type = 'calls'").select("from_node", "to_node")


@query("""WITH n AS (SELECT 'sql.q' || n_nationkey AS id, lower(n_name) AS t, n_nationkey FROM nation)
SELECT id AS from_node, 'db.table.' || t AS to_node, 'reads_table' AS type FROM n UNION ALL SELECT id, 'db.table.log_' || t, 'writes_table' FROM n UNION ALL SELECT id, 'db.table.new_' || t, 'migrates' FROM n""")
def s5_sql_files(s, d):
    n = nations(s, d)
    files = made(n, ("q", F.col("k"), ".sql"), "-- DROP TABLE nope;\nWITH t AS (SELECT a FROM ", F.col("n"), ") INSERT INTO log_", F.col("n"), " SELECT * FROM t;\n/* DELETE FROM other */ CREATE TABLE IF NOT EXISTS new_", F.col("n"), " (id int);")
    return config_files.sql_files(files)[1].select("from_node", "to_node", "type")


@query("""SELECT 'web' || n_nationkey AS service, 'img:' || n_nationkey AS image, 'db' || n_nationkey AS depends_on, 'A,B_URL' AS env FROM nation UNION ALL SELECT 'db' || n_nationkey, 'postgres', '', 'PW' FROM nation""")
def s6_compose(s, d):
    k = F.col("k")
    files = made(nations(s, d), ("c", k, "/docker-compose.yml"), "version: '3'\nservices:\n  web", k, ":\n    image: img:", k, "\n    depends_on:\n      - db", k, "\n    environment:\n      - A=1\n      - B_URL=x\n  db", k, ":\n    image: postgres\n    environment:\n      PW: y\n")
    return config_files.compose(files).select("service", "image", F.array_join("depends_on", ",").alias("depends_on"), F.array_join("env", ",").alias("env"))


@query("SELECT p_partkey::VARCHAR || '.env' AS path, 2::INTEGER AS line, 'KEY_' || p_partkey AS key, p_name AS value FROM part")
def s7_env_files(s, d):
    p = table(s, d, "part").withColumn("k", F.col("p_partkey").cast("string"))
    return config_files.env_file(made(p, (F.col("k"), ".env"), "# comment\nexport KEY_", F.col("k"), "='", F.col("p_name"), "'\nlower=1\n"))


@query("SELECT n_nationkey::VARCHAR AS path, 'base:' || n_nationkey || ',slim' AS images, 'build' AS stages, '80,443' AS ports, 'run ' || n_nationkey AS command FROM nation")
def s8_dockerfiles(s, d):
    k = F.col("k")
    files = made(nations(s, d), (k,), "FROM base:", k, " AS build\nRUN x\nfrom slim\nEXPOSE 80 443/tcp\nENV A=1\nCMD run ", k, "\n")
    join = lambda c: F.array_join(c, ",").alias(c)
    return config_files.dockerfile(files).select("path", join("images"), join("stages"), join("ports"), "command")


@query("""SELECT 'ci.github.w' || n_nationkey || '.test' AS from_node, t AS to_node, 'depends_on' AS type FROM nation, LATERAL (SELECT 'ci.github.w' || n_nationkey || '.build' AS t UNION ALL SELECT 'ci.action.a/b@v' || n_nationkey)
UNION ALL SELECT 'ci.github.w' || n_nationkey || '.test', 'env.secret.S' || n_nationkey, 'uses_env' FROM nation""")
def s9_workflows(s, d):
    k = F.col("k")
    files = made(nations(s, d), (".github/workflows/w", k, ".yml"), "on: [push]\njobs:\n  build:\n    runs-on: x\n    steps:\n      - run: |\n          needs: no\n  test:\n    needs: build\n    steps:\n      - uses: a/b@v", k, "\n      - run: echo ${{ secrets.S", k, " }}\n")
    return config_files.workflow_graph(config_files.workflows(files))[1].select("from_node", "to_node", "type")


@query("SELECT 'f' || n_nationkey AS file, 1::INTEGER AS line, n_name AS author, 'x = ' || n_nationkey AS content FROM nation UNION ALL SELECT 'f' || n_nationkey, 2, n_name, 'y' FROM nation")
def s11_blame(s, d):
    n = nations(s, d).withColumn("h", F.sha1("n_name"))
    text = made(n, ("f", F.col("k")), F.col("h"), " 1 1 2\nauthor ", F.col("n_name"), "\nauthor-time 1700000000\n\tx = ", F.col("k"), "\n", F.col("h"), " 2 2\n\ty\n").withColumnRenamed("path", "file")
    return feeds.blame(text).select("file", "line", "author", "content")


@query("SELECT 'd' || n_nationkey AS file, 'p' || n_nationkey || '.py' AS path, (n_nationkey + 1)::INTEGER AS \"start\", (n_nationkey + 3)::INTEGER AS \"end\" FROM nation")
def s11_changed_ranges(s, d):
    n = nations(s, d).withColumn("at", (F.col("n_nationkey") + 1).cast("string"))
    return feeds.changed_ranges(made(n, ("d", F.col("k")), "--- a/x\n+++ b/p", F.col("k"), ".py\n@@ -1,2 +", F.col("at"), ",3 @@\n+q\n").withColumnRenamed("path", "file"))


@query("SELECT n_name AS author, 2::BIGINT AS n FROM nation")
def a14_authors(s, d):
    n = nations(s, d).withColumn("h", F.sha1("n_name"))
    text = made(n, ("f", F.col("k")), F.col("h"), " 1 1 2\nauthor ", F.col("n_name"), "\nauthor-time 1700000000\n\tx\n", F.col("h"), " 2 2\n\ty\n").withColumnRenamed("path", "file")
    return A.count_by(feeds.blame(text), "author")


# ---- mappers


@query("""SELECT n_nationkey::VARCHAR AS id, m AS method, CASE WHEN p LIKE '%/' THEN p || lower(n_name) || s ELSE p END AS path FROM nation,
(VALUES ('GET', '/api/', '/:param'), ('PUT', '/api/', '/:param'), ('DELETE', '/del/', ''), ('ANY', '/plain/', ''), ('POST', '/add', ''), ('ANY', '/any/:param', ''), ('GET', '/c', '')) v(m, p, s)""")
def x7_routes(s, d):
    n, name = nations(s, d), F.col("n")
    text = F.concat(
        F.lit('@app.route("/api/'), name, F.lit('/{id}/", methods=["GET", "put"])\ndef f(): ...\n# @app.get("/no")\n    @app.delete(\n        "/del/'), name,
        F.lit("\")\ndef g(): map.get('key')\n@bp.route('/plain/"), name, F.lit("')\ndef h(): ...\nusers.post('/add', go(1)); router.all(\"/any/:k\", h); api.get('/c', h); axios.get('/call')\n// app.get('/no', h)"),
    )
    return extract.routes(n.select(F.col("k").alias("id"), text.alias("source_code"))).select("id", "method", "path")


@query("""SELECT n_nationkey::VARCHAR AS id, m AS method, CASE WHEN p LIKE '%/' THEN p || lower(n_name) ELSE p END AS path FROM nation,
(VALUES ('DELETE', '/a/:param'), ('PUT', '/b/'), ('GET', '/x/'), ('POST', '/y/:param'), ('GET', '/z')) v(m, p)""")
def x8_api_calls(s, d):
    n = F.col("n")
    text = F.concat(F.lit("fetch('/x/"), n, F.lit("'); fetch(`/y/${id}`, {\n  body: f(')'), method: 'post'});\naxios.delete(`/a/${id}?q=1`); this.client.put('/b/"), n, F.lit("', {method: 'GET'}); request<T>('https://h/z/')\n// fetch('/no')\nother.get('/no'); fetch('no/slash')"))
    return extract.api_calls(nations(s, d).select(F.col("k").alias("id"), text.alias("source_code"))).select("id", "method", "path")


@query("""SELECT page_id, CASE WHEN length(p) > 1 THEN rtrim(p, '/') ELSE p END AS path FROM (SELECT page_id, regexp_replace(regexp_extract(url, '://[^/]*([^?#]*)', 1), '[0-9]+', ':param') AS p FROM pages)""")
def x9_normalise(s, d):
    path = F.regexp_replace(F.regexp_extract("url", r"://[^/]*([^#]*)", 1), r"(?<=/)\d+", "\\${id}")
    return table(s, d, "pages").select("page_id", X.normalise_route(path).alias("path"))


@query("SELECT n_nationkey::VARCHAR AS id, CASE n_nationkey % 3 WHEN 0 THEN 't_' || n_nationkey WHEN 1 THEN lower(replace(n_name, ' ', '_')) || 's' ELSE lower(replace(n_name, ' ', '_')) END AS \"table\" FROM nation")
def x10_model_tables(s, d):
    n = nations(s, d).withColumn("n_name", F.replace("n_name", F.lit(" "), F.lit("_")))
    body = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("class A(Base):\n    __tablename__ = 't_"), "k", F.lit("'"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("class "), "n_name", F.lit("(models.Model): ...")))
    n = n.select(F.col("k").alias("id"), F.lit("class").alias("type"), F.col("n_name").alias("name"), F.coalesce(body, F.concat(F.lit("class "), "n_name", F.lit("(Base): ..."))).alias("source_code"))
    return extract.model_tables(n).select("id", "table")


@query("SELECT p_partkey::VARCHAR AS id, v AS name FROM part, LATERAL (SELECT 'A_' || p_partkey AS v UNION ALL SELECT 'B' UNION ALL SELECT 'C_' || p_size)")
def x13_env_uses(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("os.getenv('A_"), "p_partkey", F.lit("') or environ['B'] or process.env.C_"), "p_size").alias("source_code"))
    return extract.env_uses(p)


@query("""SELECT p_partkey::VARCHAR AS id, b AS bridge, CASE WHEN b = 'wasm' THEN m ELSE m || p_partkey END AS module, CASE WHEN b = 'koffi' THEN 'add,sub' || p_size ELSE '' END AS functions
FROM part, (VALUES ('ctypes', 'x'), ('napi', 'y'), ('koffi', 'z'), ('wasm', 'WebAssembly')) v(b, m)""")
def x15_bindings(s, d):
    k = F.col("p_partkey")
    text = F.concat(
        F.lit('ctypes.CDLL("./libx'), k, F.lit('.so.1"); require("../y'), k, F.lit('/index.node"); spawn("no")\n// koffi.load("no")\nconst z = koffi.load("libz'), k,
        F.lit("\"); z.func('int', 'add', []); z.define('sub"), "p_size", F.lit("', x); WebAssembly.compile(bytes)"),
    )
    part = table(s, d, "part").select("p_partkey", "p_size").repartition(int(s.conf.get("spark.sql.shuffle.partitions")))  # a few MB, so few splits, become far longer texts
    found = extract.bindings(part.select(k.cast("string").alias("id"), text.alias("source_code")))
    return found.select("id", "bridge", "module", F.array_join("functions", ",").alias("functions"))


@query("""SELECT 'env.' || v AS to_node, string_agg('n' || n_nationkey, ',' ORDER BY 'n' || n_nationkey) AS items, count(*) AS n FROM (SELECT n_nationkey, 'V' || n_nationkey % 4 AS v FROM nation) GROUP BY v""")
def a17_env_map(s, d):
    n = nations(s, d).select(F.concat(F.lit("n"), "k").alias("id"), F.concat(F.lit("os.environ['V"), F.col("n_nationkey") % 4, F.lit("']")).alias("source_code"))
    uses = extract.env_uses(n).select(F.concat(F.lit("env."), "name").alias("to_node"), "id")
    return A.grouped_list(uses, "to_node", "id")


# ---- rules, explanations, changes


@query("""WITH c AS (SELECT to_node AS id, count(DISTINCT from_node) AS n FROM g_flat GROUP BY 1), t AS (SELECT DISTINCT to_node AS id FROM g_flat JOIN g_nodes n ON n.id = from_node WHERE n.name LIKE '%7')
SELECT id, CASE WHEN n > 10 THEN 'high_impact' ELSE 'moderate_impact' END AS warning FROM g_nodes JOIN c USING (id) WHERE n > 5 UNION ALL SELECT id, 'no_tests' FROM g_nodes ANTI JOIN t USING (id)
UNION ALL SELECT id, 'circular_dependency' FROM g_nodes WHERE regexp_replace(id, '[.][^.]+$', '') = 'R0'""")
def r5_warnings(s, d):
    n = binding.nodes(s, d).withColumn("name", F.when(F.endswith("name", F.lit("7")), F.concat(F.lit("test_"), "name")).otherwise(F.col("name"))).withColumn("source_code", F.lit(""))
    return R.warnings(n, flat(s, d), s.createDataFrame([("R0",)], "module string"))


@query("SELECT p_partkey::VARCHAR AS id, 'limit: int,data' AS inputs, 'ValueError' AS raises, (p_size % 9)::INTEGER AS branches, CASE WHEN p_size % 9 > 5 THEN 'complex' WHEN p_size % 9 > 2 THEN 'moderate' ELSE 'simple' END AS complexity, 'Loads part' AS purpose FROM part")
def r11_explain(s, d):
    body = F.concat(F.lit("def load_part(limit: int, data):\n"), F.repeat(F.lit("    if limit:\n        limit -= 1\n"), (F.col("p_size") % 9).cast("int")), F.lit("    raise ValueError(limit)\n"))
    n = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("load_part").alias("name"), body.alias("source_code"))
    join = lambda c: F.array_join(c, ",").alias(c)
    return E.explain(n).select("id", join("inputs"), join("raises"), "branches", "complexity", "purpose")


@query("SELECT p_partkey AS id, p_size % 3 <> 2 AS valid, CASE p_size % 3 WHEN 1 THEN 'new required parameter: b' ELSE '' END AS warnings FROM part")
def r13_validate(s, d):
    kind = F.col("p_size") % 3
    new = F.when(kind == 0, "def f(a): return 1").when(kind == 1, "def f(a, b): return 1").otherwise("class f: ...")
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.lit("def f(a): pass").alias("old_source"), new.alias("new_source"))
    return M.validate(p).select("id", "valid", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT doc_id, CASE WHEN length(text) > 10000 AND lang = 'en' THEN 'container_too_large' WHEN length(text) > 2000 THEN 'suspicious_shrink' END AS refused FROM documents")
def m1_update_guards(s, d):
    kind = F.when(F.col("lang") == "en", "class").otherwise("function")
    return table(s, d, "documents").select("doc_id", M.update_guards(kind, F.col("text"), F.lit("x")).alias("refused"))


@query("SELECT n_nationkey::VARCHAR AS path, 'one' || chr(10) || '  ' || n_name || chr(10) || 'three' AS text, 'edited' AS status FROM nation")
def m6_apply_edits(s, d):
    n = nations(s, d)
    files = made(n, (F.col("k"),), "one\n  two\nthree")
    return M.apply_edits(files, n.select(F.col("k").alias("path"), F.lit(2).alias("start"), F.lit(2).alias("end"), F.col("n_name").alias("text")))


# ---- graph and upkeep


@query("SELECT e.to_node AS id, e.from_node AS other, e.type FROM g_flat e JOIN g_nodes n ON n.id = e.to_node WHERE n.type = 'class'")
def g13_neighbours(s, d):
    return G.neighbours(flat(s, d), binding.nodes(s, d).filter("type = 'class'"), "in").select("id", "other", "type")


@query("SELECT 'src.m' || s_suppkey || '.work' AS id FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey % 7 FROM supplier)")
def g12_dead_code_tool(s, d):
    rows = _python(s, d)
    return G.dead_code_report(python_code.nodes(rows), python_code.edges(rows)).select("id")


@query("""WITH a AS (SELECT doc_id, sha256(text) AS hash, source AS note FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, sha256(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS hash FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id AS id, CASE WHEN b.hash IS NOT NULL THEN a.note END AS note, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'deleted' WHEN a.hash <> b.hash THEN 'modified' ELSE 'unchanged' END AS status FROM a FULL JOIN b USING (doc_id)""")
def u5_sync_nodes(s, d):
    docs = table(s, d, "documents")
    old = docs.filter("doc_id % 10 != 0").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"), F.col("source").alias("note"))
    new = docs.filter("doc_id % 11 != 0").select(F.col("doc_id").alias("id"), F.sha2(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "!").otherwise("")), 256).alias("hash"), F.lit(None).cast("string").alias("note"))
    return U.sync_nodes(old, new, ["note"]).select("id", "note", "status")


@query("SELECT from_node, to_node, type FROM g_edges WHERE type = 'imports' UNION ALL SELECT from_node, to_node, type FROM g_edges WHERE source = 'runtime'")
def k1_replace_static(s, d):
    e = binding.edges(s, d)
    return U.replace_static(e.filter("type != 'imports'"), e.filter("type = 'imports'")).select("from_node", "to_node", "type")


@query("SELECT count(*) AS edges FROM g_edges WHERE NOT (from_node LIKE 'R1.%.C%' OR to_node LIKE 'R1.%.C%')")
def k3_delete_nodes(s, d):
    n = binding.nodes(s, d)
    return U.delete_nodes(n, binding.edges(s, d), n.filter("id like 'R1.%.C%'"))[1].agg(F.count("*").alias("edges"))


@query("SELECT doc_id AS id, coalesce(quality::VARCHAR, lang) AS role, quality IS NOT NULL AS noted FROM documents LEFT JOIN labels USING (doc_id)")
def k4_save_annotations(s, d):
    n = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("role"), F.lit("h").alias("hash"), F.lit(None).cast("string").alias("annotation_hash"))
    fresh = table(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("role"))
    return U.save_annotations(n, fresh, ["role"]).select("id", "role", F.col("annotation_hash").isNotNull().alias("noted"))


@query("SELECT CASE doc_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'sql' END AS lang, count(*) AS n FROM documents GROUP BY 1")
def f17_languages(s, d):
    path = F.concat(F.lit("f"), F.when(F.col("doc_id") % 3 == 0, ".py").when(F.col("doc_id") % 3 == 1, ".tsx").otherwise(".sql"))
    return A.count_by(table(s, d, "documents").select(X.language_of(path).alias("lang")), "lang")


@query("SELECT doc_id, n FROM (SELECT doc_id, (doc_id % 25)::BIGINT AS line, row_number() OVER (PARTITION BY doc_id ORDER BY hi - lo, i) AS r, i AS n FROM documents, (SELECT n_nationkey AS i, n_nationkey::BIGINT AS lo, (n_nationkey + n_nationkey % 5)::BIGINT AS hi FROM nation) WHERE doc_id % 25 BETWEEN lo AND hi AND doc_id % 4 = i % 4) WHERE r = 1")
def j15_findings(s, d):
    findings = table(s, d, "documents").select("doc_id", (F.col("doc_id") % 4).alias("file_path"), (F.col("doc_id") % 25).alias("line"))
    spans = table(s, d, "nation").select((F.col("n_nationkey") % 4).cast("long").alias("file_path"), F.col("n_nationkey").alias("n"), F.col("n_nationkey").cast("long").alias("lo"), (F.col("n_nationkey") + F.col("n_nationkey") % 5).cast("long").alias("hi"))
    return J.containing(findings, spans, ["file_path"], "line", "lo", "hi", ["doc_id"], ["n"]).select("doc_id", "n")


@query("SELECT CASE count(*) WHEN 0 THEN 'not_found' WHEN 1 THEN 'hit' ELSE 'ambiguous' END AS status, coalesce(string_agg(id, ',' ORDER BY id), '') AS candidates FROM (SELECT id FROM g_nodes WHERE id ILIKE '%.N1' LIMIT 5)")
def f7_resolve_status(s, d):
    return P.resolve_status(binding.nodes(s, d), "N1")


@query("SELECT event_type, event_type IN ('view', 'click') AS external, count(*) AS n FROM events GROUP BY ALL")
def f16_is_external(s, d):
    e = table(s, d, "events").withColumn("external", P.is_external(F.col("event_type"), ["view"], ["click"]))
    return e.groupBy("event_type", "external").agg(F.count("*").alias("n"))


@query("""SELECT 'main' || n_nationkey % 5 AS file, '/x' AS path FROM nation GROUP BY ALL UNION ALL SELECT 'mid' || n_nationkey, '/v' || n_nationkey % 5 || '/m/x' FROM nation
UNION ALL SELECT 'leaf' || n_nationkey, '/v' || n_nationkey % 5 || '/m/deep/x' FROM nation UNION ALL SELECT 'alone' || n_nationkey, '/own' || n_nationkey || '/x' FROM nation""")
def j18_router_prefixes(s, d):
    n, k, five = nations(s, d), F.col("k"), (F.col("n_nationkey") % 5).cast("string")
    mounts = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("app.include_router(m"), "k", F.lit(".router, prefix='/v"), five, F.lit("')")))), "\n")
    main = n.groupBy(F.concat(F.lit("main"), five).alias("file")).agg(mounts.alias("text"))
    mid = n.select(F.concat(F.lit("mid"), k).alias("file"), F.lit("router = APIRouter(prefix='/m')\nrouter.include_router(\n    leaf,\n    prefix='/deep/',\n)\n# router.include_router(no, prefix='/no')").alias("text"))
    alone = n.select(F.concat(F.lit("alone"), k).alias("file"), F.concat(F.lit("bp = Blueprint('x', url_prefix='/own"), k, F.lit("')")).alias("text"))
    sources = main.unionByName(mid).unionByName(alone)
    names = n.select(F.concat(F.lit("main"), five).alias("file"), F.concat(F.lit("m"), k).alias("name"), F.concat(F.lit("mid"), k).alias("module_file"))
    names = names.unionByName(n.select(F.concat(F.lit("mid"), k).alias("file"), F.lit("leaf").alias("name"), F.concat(F.lit("leaf"), k).alias("module_file")))
    every = sources.select("file").unionByName(n.select(F.concat(F.lit("leaf"), k).alias("file")))
    return J.prefixed_routes(every.withColumn("path", F.lit("/x")), extract.router_includes(sources), names, extract.router_prefixes(sources))


@query("""WITH c AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS changes FROM lineitem GROUP BY 1) SELECT 'n' || p_partkey AS id, p_partkey::VARCHAR AS file_path, changes FROM part JOIN c ON l_partkey = p_partkey ORDER BY changes DESC, id LIMIT 15""")
def a12_file_hotspots(s, d):
    commits = table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("file_path"), F.col("l_orderkey").alias("commit"))
    n = table(s, d, "part").select(F.concat(F.lit("n"), "p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("file_path"))
    return A.file_hotspots(commits, n, 15)


@query("""WITH u AS (SELECT DISTINCT 't' || l_partkey % 30 AS t, 's' || l_suppkey % 9 AS f, l_returnflag AS k FROM lineitem)
SELECT t AS "table", coalesce(string_agg(DISTINCT f, ',' ORDER BY f) FILTER (k = 'R'), '') AS readers, coalesce(string_agg(DISTINCT f, ',' ORDER BY f) FILTER (k <> 'R'), '') AS writers,
count(DISTINCT f) FILTER (k = 'R')::INTEGER AS n_readers, count(DISTINCT f) FILTER (k <> 'R')::INTEGER AS n_writers FROM u GROUP BY t""")
def a16_table_usage(s, d):
    kind = F.when(F.col("l_returnflag") == "R", "reads_table").when(F.col("l_returnflag") == "A", "writes_table").otherwise("migrates")
    e = table(s, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey") % 9).alias("from_node"), F.concat(F.lit("t"), F.col("l_partkey") % 30).alias("to_node"), kind.alias("type"))
    return A.table_usage(e)


@query("SELECT c_nationkey::VARCHAR AS lang, count(*) AS files, sum(n)::BIGINT AS nodes, sum(i)::BIGINT AS internal, sum(r)::BIGINT AS resolved, CASE WHEN sum(i) > 0 THEN round(100.0 * sum(r) / sum(i), 1) ELSE 100.0 END::DOUBLE AS pct FROM (SELECT c_custkey, c_nationkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus <> 'P') AS i, count(*) FILTER (o_orderstatus = 'F') AS r FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) GROUP BY ALL")
def a20_parse_stats(s, d):
    f = table(s, d, "customer").select(F.col("c_custkey").alias("file_path"), F.col("c_nationkey").cast("string").alias("lang"))
    o = table(s, d, "orders").select(F.col("o_custkey").alias("file_path"), F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "P", "external").otherwise("inferred").alias("confidence"))
    return A.parse_stats(f, o, o, "lang").withColumn("pct", F.col("pct").cast("double"))


@query("SELECT count(*) FILTER (o_orderpriority LIKE '1%') AS high, count(*) FILTER (o_orderpriority LIKE '3%') AS medium, count(*) FILTER (o_orderpriority LIKE '5%') AS low, count(*) AS total FROM orders")
def a21_severity_counts(s, d):
    p = F.substring("o_orderpriority", 1, 1)
    return A.severity_counts(table(s, d, "orders").select(F.when(p == "1", "high").when(p == "3", "MEDIUM").when(p == "5", "Low").otherwise("none").alias("severity")))


@query("SELECT CASE type WHEN 'calls' THEN 'calls' WHEN 'imports' THEN 'imports' ELSE 'structure' END AS category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM g_edges), 1)::DOUBLE AS pct FROM g_edges GROUP BY 1")
def a27_edge_categories(s, d):
    return A.edge_categories(binding.edges(s, d)).withColumn("pct", F.col("pct").cast("double"))


@query("SELECT n_nationkey::VARCHAR AS id, 'write' AS op, lower(n_name) AS \"table\" FROM nation WHERE n_nationkey % 2 = 0")
def x12_session_writes(s, d):
    n = nations(s, d)
    models = n.select(F.concat(F.lit("Model"), "k").alias("model"), F.col("n").alias("table"))
    bound = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("x = Model"), "k", F.lit("(a=1)\nsession.add(x)"))).when(F.col("n_nationkey") % 4 == 2, F.concat(F.lit("x = await db.get(Model"), "k", F.lit(", 1)\ndb.delete(x)")))
    return extract.session_writes(n.select(F.col("k").alias("id"), F.coalesce(bound, F.lit("xs = set()\nxs.add(x)")).alias("source_code")), models)


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'src/a' || doc_id WHEN 1 THEN 'lib/ui/b' || doc_id ELSE './c' || doc_id END AS path FROM documents")
def x6_aliases(s, d):
    config = s.createDataFrame([('{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@/ui/*": ["lib/ui/*"]}}}',)], "text string")
    spec = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("@/a"), "doc_id")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("@/ui/b"), "doc_id")).otherwise(F.concat(F.lit("./c"), "doc_id"))
    return extract.resolve_alias(table(s, d, "documents").select("doc_id", spec.alias("spec")), extract.aliases(config)).select("doc_id", "path")


# ---- streams, over all input there is


def _stream(s, d):
    """The events as a stream; the file is copied to a folder of the shared place by Spark, as a stream reads folders."""
    from .tables import shared_dir

    name = f"{shared_dir(s)}/events-{uuid.uuid4().hex[:8]}"
    batch = table(s, d, "events")
    batch.write.parquet(name)
    return S.read_events(s, name, batch.schema, "ts"), f"{name}-state"


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def u10_stream_windows(s, d):
    live, state = _stream(s, d)
    out = S.run_available(S.windowed_counts(live, ["event_type"], "ts", "1 day", late="60 days"), "w" + state[-14:-6].replace("-", "_"), "complete", state)
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


@query("SELECT from_node, to_node, max(n) AS n FROM (SELECT event_type AS from_node, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS to_node, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL")
def u14_stream_call_counts(s, d):
    live, state = _stream(s, d)
    calls = live.withColumn("side", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    out = S.run_available(S.call_pairs(calls, "event_type", "side"), "c" + state[-14:-6].replace("-", "_"), "complete", state)
    return out.groupBy("from_node", "to_node").agg(F.max("n").alias("n"))
