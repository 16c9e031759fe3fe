from pyspark.sql import functions as F

from loomgraph import project
from loomgraph.functions import extract, scan
from loomgraph.operators import joins
from loomgraph.schema import RULES
from loomgraph.sources import config_files, feeds, files, python_code, script_code

MODELS = '''"""Models."""
import os
from .util import slugify as slug
from unittest.mock import patch

LIMIT = 3

class User:
    __tablename__ = "users"
    def greet(self, other: "Admin") -> str:
        def inner():
            return slug(self.name)
        return self.shout(inner())
    def shout(self, x):
        return x.upper()

class Admin(User): ...

@patch("pkg.util.slugify")
def load(cursor):
    cursor.execute("SELECT * FROM users")
    return os.environ["DB_URL"]

if __name__ == "__main__":
    load(None)
'''
COMPOSE = """services:
  web:
    build: .
    ports: ["80:80"]
    depends_on: [db, redis]
    environment:
      - DB_URL=x
      - "DEBUG=1"
  db:
    image: postgres:15
    environment:
      POSTGRES_PASSWORD: y
  redis:
    image: redis
"""


def texts(spark, **named):
    return spark.createDataFrame([(k.replace("__dot__", ".").replace("__", "/"), v) for k, v in named.items()], "path string, text string")


def test_python(spark):
    parsed = python_code.parse(spark.createDataFrame([("pkg/models.py", MODELS), ("bad.py", "def ("), ("pkg/__init__.py", "")], "path string, text string")).collect()
    nodes = {(r.id, r.type) for r in parsed if r.kind == "node"}
    assert nodes == {
        ("pkg", "module"), ("pkg.models", "module"), ("pkg.models.LIMIT", "block"), ("pkg.models.User", "class"), ("pkg.models.User.greet", "method"), ("pkg.models.User.greet.inner", "method"),
        ("pkg.models.User.shout", "method"), ("pkg.models.Admin", "class"), ("pkg.models.load", "function"), ("pkg.models.__main__", "block"),
    }
    edges = {(r.from_node, r.to_node, r.type) for r in parsed if r.kind == "edge"}
    for e in (
        ("pkg.models", "pkg.util.slugify", "imports"), ("pkg.models.User.greet", "pkg.util.slugify", "calls"), ("pkg.models.User.greet.inner", "pkg.util.slugify", "calls"),
        ("pkg.models.User.greet", "pkg.models.User.shout", "calls"), ("pkg.models.Admin", "User", "inherits"), ("unittest.mock.patch", "pkg.models.load", "decorates"),
        ("pkg.models.load", "pkg.util.slugify", "mocks"), ("pkg.models.User.greet", "pkg.models.User.greet.inner", "contains"),
    ):
        assert e in edges
    assert [r.file_path for r in parsed if r.kind == "error"] == ["bad.py"]


def test_scripts(spark):
    source = 'import { api as call } from "./api";\nfunction greet(name) { return call(name); }\nconst add = (a, b) => { return greet(a); };\nclass V extends Base { render() { return this.draw(); } }\n'
    parsed = script_code.parse(spark.createDataFrame([("web/app.js", source)], "path string, text string")).collect()
    assert {(r.id, r.type) for r in parsed if r.kind == "node"} == {("web.app", "module"), ("web.app.greet", "function"), ("web.app.add", "function"), ("web.app.V", "class"), ("web.app.V.render", "method")}
    edges = {(r.from_node, r.to_node, r.type, r.confidence) for r in parsed if r.kind == "edge"}
    assert ("web.app", "web.api", "imports", "resolved") in edges and ("web.app.greet", "web.api.api", "calls", "resolved") in edges and ("web.app.V.render", "web.app.V.draw", "calls", "inferred") in edges


def test_compose_and_workflows(spark):
    found = {r.service: r for r in config_files.compose(spark.createDataFrame([("docker-compose.yml", COMPOSE)], "path string, text string")).collect()}
    assert set(found) == {"web", "db", "redis"} and found["db"].image == "postgres:15" and found["web"].depends_on == ["db", "redis"]
    assert found["web"].env == ["DB_URL", "DEBUG"] and found["db"].env == ["POSTGRES_PASSWORD"] and found["web"].ports == ["80:80"]
    for head, triggers in (("on: push", ["push"]), ("on: [push, pull_request]", ["push", "pull_request"]), ("on:\n  push:\n    branches: [main]\n  schedule:\n    - cron: x", ["push", "schedule"])):
        text = head + "\njobs:\n  a:\n    runs-on: ubuntu\n    steps:\n      - uses: actions/checkout@v4\n      - run: |\n          needs: nothing\n  b:\n    needs: [a]\n    env:\n      TOKEN: ${{ secrets.TOKEN }}\n"
        jobs = {r.job: r for r in config_files.workflows(spark.createDataFrame([(".github/workflows/ci.yml", text)], "path string, text string")).collect()}
        assert jobs["a"].triggers == triggers and jobs["a"].uses == ["actions/checkout@v4"] and jobs["b"].needs == ["a"] and jobs["b"].secrets == ["TOKEN"] and jobs["a"].needs == []


def test_plain_files(spark):
    env = config_files.env_file(spark.createDataFrame([(".env", "# c\nexport A_B=1\nlower=2\nC='x y'\n")], "path string, text string"))
    assert [(r.line, r.key, r.value) for r in env.collect()] == [(2, "A_B", "1"), (4, "C", "x y")]
    d = config_files.dockerfile(spark.createDataFrame([("Dockerfile", "FROM python:3 AS base\nFROM base\nEXPOSE 80 443/tcp\nENV A=1\nARG B\nCOPY --from=base /x /y\nCMD run it\n")], "path string, text string")).first()
    assert (d.images, d.stages, d.ports, d.env, d.args, d.copied_from, d.command) == (["python:3", "base"], ["base"], ["80", "443"], ["A"], ["B"], ["base"], "run it")
    nodes, edges = config_files.sql_files(spark.createDataFrame([("db/a.sql", "-- SELECT x FROM nope\nWITH t AS (SELECT 1 FROM b) INSERT INTO c SELECT * FROM t;\nCREATE INDEX i ON d (x);")], "path string, text string"))
    assert nodes.first().id == "sql.db.a"
    assert {(r.to_node, r.type) for r in edges.collect()} == {("db.table.b", "reads_table"), ("db.table.c", "writes_table"), ("db.table.d", "migrates")}


def pairs(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def one(spark, text, **more):
    return spark.createDataFrame([("x", text, *more.values())], "id string, source_code string" + "".join(f", {c} string" for c in more))


def test_routes_each_have_their_own_method(spark):
    text = '''
@app.route("/a", methods=["GET", "POST"])
def a(): ...

@app.route(
    "/b", methods=["DELETE"])
def b(): ...

@app.route("/plain")
def c(): ...

# @app.get("/commented")
    @router.put("/items/{id}/")
s = "@app.get('/in/text')"
'''
    assert pairs(extract.routes(one(spark, text)), "method", "path") == {("GET", "/a"), ("POST", "/a"), ("DELETE", "/b"), ("ANY", "/plain"), ("PUT", "/items/:param")}
    script = """
api.get("/c", h); users.post('/users/:id', async (req) => { fetch("/nested"); });
map.get("key"); env.get("VAR"); router.all(`*`, h); r.delete('', h);
// app.get("/commented", h)
axios.get("/call"); client.put("/call", x)
"""
    found = pairs(extract.routes(one(spark, script)), "method", "path", "receiver")
    assert found == {("GET", "/c", "api"), ("POST", "/users/:param", "users"), ("ANY", "*", "router"), ("DELETE", "", "r"), ("PUT", "/call", "client")}


def test_calls_each_have_their_own_method(spark):
    text = """
fetch("/x"); fetch("/y", {method: "POST", body: f(")")});
apiRequest<User>("/z", { method: 'delete' }); request(`/u/${id}/v?q=1`);
this.client.patch("/p", {method: "GET"}); axios.get("https://host/abs/"); fetch("no/slash"); axios
  .get("/far");
// fetch("/commented")
other.get("/not")
"""
    assert pairs(extract.api_calls(one(spark, text)), "method", "path") == {
        ("GET", "/x"), ("POST", "/y"), ("DELETE", "/z"), ("GET", "/u/:param/v"), ("PATCH", "/p"), ("GET", "/abs"),
    }


def test_mounts_and_prefixes(spark):
    script = one(spark, 'app.use("/users/", usersRouter); usersRouter.get("/:id", h); app.get("/x", h)')
    assert pairs(extract.mounted(extract.routes(script), extract.mounts(script)), "method", "path") == {("GET", "/users/:param"), ("GET", "/x")}
    files_ = spark.createDataFrame(
        [
            ("main.py", 'app.include_router(api.router, prefix="/api")\n# app.include_router(no, prefix="/no")'), ("api.py", "router = APIRouter(prefix='/v1')\nrouter.include_router(\n    users,\n    prefix='/users')"),
            ("users.py", 'bp = Blueprint("users", url_prefix="/u/")'), ("ring.py", 'r.include_router(ring2, prefix="/r")'), ("ring2.py", 'r.include_router(ring, prefix="/s")'),
        ],
        "file string, text string",
    )
    includes, own = extract.router_includes(files_), extract.router_prefixes(files_)
    assert pairs(includes, "file", "router", "prefix") == {("main.py", "api", "/api"), ("api.py", "users", "/users"), ("ring.py", "ring2", "/r"), ("ring2.py", "ring", "/s")}
    assert pairs(own, "file", "prefix") == {("api.py", "/v1"), ("users.py", "/u")}
    names = spark.createDataFrame([("main.py", "api", "api.py"), ("api.py", "users", "users.py"), ("ring.py", "ring2", "ring2.py"), ("ring2.py", "ring", "ring.py")], "file string, name string, module_file string")
    routes = spark.createDataFrame([(f, "/x") for f in ("main.py", "api.py", "users.py", "ring.py", "alone.py")], "file string, path string")
    found = pairs(joins.prefixed_routes(routes, includes, names, own), "file", "path")
    assert found == {("main.py", "/x"), ("api.py", "/api/v1/x"), ("users.py", "/api/v1/users/u/x"), ("ring.py", "/x"), ("alone.py", "/x")}


def test_orm_and_sessions(spark):
    models = spark.createDataFrame([("User", "users"), ("Order", "order_lines")], "model string, table string")
    text = """
User.objects.filter(a=1).first(); Order.objects.bulk_create([]); Stranger.objects.get(id=1)
db.query(Order); select(User).where(x); insert(Pet).values(); update(user)
client.table("t").insert(x); client.table("u").select("*"); sb.from('v')
"""
    assert pairs(extract.orm_uses(one(spark, text), models), "op", "table") == {
        ("read", "users"), ("write", "order_lines"), ("read", "strangers"), ("read", "order_lines"), ("write", "pets"), ("write", "t"), ("read", "u"), ("read", "v"),
    }
    for text, want in {
        "u = User(name=1)\nsession.add(u)": {"users"}, "x = (\n  db.query(Order).first())\ndb.delete(x)": {"order_lines"}, "o = await db.get(Order, 1)\ns.merge(o)": {"order_lines"},
        "session.add(User(a=1))": {"users"}, "session.add(what)": {"<unknown>"}, "seen.add(what)": set(), "session.add_all([a, b])": {"<unknown>"}, "obj.save()": {"<unknown>"},
        "xs.delete(1)": set(), "p = Pet()\ndb.add(p)": {"pets"},
    }.items():
        assert {r.table for r in extract.session_writes(one(spark, text), models).collect()} == want, text


def test_native_bindings(spark):
    text = """
const lib = koffi.load("./libmath.so"); const add = lib.func("int", "add", ["int"]); lib.define("sub", x);
require("bindings")("addon"); bindings('other'); new ffi.Library("libc", {}); WebAssembly.instantiate(bytes);
import x from "./calc.wasm"; import y from "../native/index"; import z from "./a.node"; import n from "native"
import { spawn } from "node:child_process"; spawn("ls -l"); cp.execFile('git', ['x']);
"""
    found = pairs(extract.bindings(one(spark, text)), "bridge", "module", "raw")
    assert found == {
        ("koffi", "math", "./libmath.so"), ("bindings", "addon", "addon"), ("bindings", "other", "other"), ("ffi-napi", "c", "libc"), ("wasm", "WebAssembly", "WebAssembly"),
        ("wasm", "calc", "./calc.wasm"), ("napi", "native", "../native/index"), ("napi", "a", "./a.node"), ("child_process", "ls", "ls -l"), ("child_process", "git", "git"),
    }
    assert {tuple(r.functions) for r in extract.bindings(one(spark, text)).filter("bridge = 'koffi'").collect()} == {("add", "sub")}
    assert pairs(extract.bindings(one(spark, 'import ctypes\nm = ctypes.cdll.LoadLibrary("libm.so.6")\nffi.dlopen("libz.so")\nspawn("no")')), "bridge", "module") == {("ctypes", "m"), ("cffi", "z")}


def test_bindings_scan_a_source_once(spark, capsys):
    text = 'require("bindings")("a"); require("bindings")("b"); ctypes.CDLL("libm.so.6"); const z = koffi.load("libz"); z.func("int", "add", [])'
    found = extract.bindings(one(spark, text))
    assert pairs(found, "bridge", "module") == {("bindings", "a"), ("bindings", "b"), ("ctypes", "m"), ("koffi", "z")}
    frame = spark.range(100).selectExpr("cast(id as string) AS id", "concat('ctypes.CDLL(\"lib', id, '.so\")') AS source_code")
    extract.bindings(frame).explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("translate(") == 1


def test_sql_statements(spark):
    for sql, want in {
        "SELECT a FROM t JOIN s.u ON x": {("read", "t"), ("read", "u")}, "with a as (select 1 from b), c as (delete from d) select * from a, c": {("read", "b"), ("write", "d")},
        'INSERT INTO "log" SELECT x FROM `src`': {("write", "log"), ("read", "src")}, "UPDATE users SET a = 1; update x where": {("write", "users")},
        "DELETE FROM gone WHERE id IN (SELECT id FROM kept)": {("write", "gone"), ("read", "kept")}, "DROP TABLE IF EXISTS old; ALTER TABLE b ADD c; CREATE TABLE IF NOT EXISTS d (x int)": {("migrate", "old"), ("migrate", "b"), ("migrate", "d")},
        "CREATE UNIQUE INDEX IF NOT EXISTS i ON e (x)": {("migrate", "e")}, "from os import path": set(), "SELECT 1 FROM information_schema": set(),
        "SELECT cron.schedule('0 0 * * *', $$DELETE FROM events WHERE x$$)": {("write", "events")},
    }.items():
        assert pairs(config_files.table_uses(one(spark, sql), "id", F.col("source_code")), "op", "table") == want, sql
    program = 'def f():\n    # select x from nope\n    from os import path\n    db.execute("""\n      SELECT a\n      FROM t""")\n    return "DELETE FROM u"\n'
    assert pairs(config_files.table_uses(one(spark, program), "id", scan.literals(F.col("source_code"))), "op", "table") == {("read", "t"), ("write", "u")}


def test_scanners_survive_long_and_unbalanced_sources(spark):
    many = "f(" + ", ".join(f'"a{i}"' for i in range(20_000)) + ")\n" + "g(" * 3000 + ")" * 10 + "\nlast('x')"
    found = one(spark, many).select(F.explode(scan.calls(F.col("source_code"))).alias("c")).select("c.*").collect()
    assert {r.name for r in found} == {"f", "g", "last"} and len(found) == 3002


def test_script_imports_have_no_limit():
    names = ", ".join(f"n{i}" for i in range(300))
    rows = script_code.Script("w/x.ts", f"import {{ {names} }} from './big';\nexport {{ q as r }} from './n';\nfunction w() {{ n299(); r(); }}\nconst api = {{ load(x) {{ return n1(x); }}, go: async (y) => {{ n2(y); }} }};\nclass K {{ f = () => {{ n3(); }}; }}\nconst A = () => {{ return <B onClick={{n4}} />; }};").rows
    edges = {(r["from_node"], r["to_node"], r["type"]) for r in rows if r["kind"] == "edge"}
    assert {("w.x", "w.big", "imports"), ("w.x", "w.n", "imports"), ("w.x.w", "w.big.n299", "calls"), ("w.x.w", "w.n.q", "calls"), ("w.x.api.load", "w.big.n1", "calls"), ("w.x.api.go", "w.big.n2", "calls"), ("w.x.K.f", "w.big.n3", "calls"), ("w.x.A", "w.big.n4", "uses")} <= edges


def test_extraction(spark):
    n = spark.createDataFrame(
        [
            ("app.get_users", "function", "get_users", '@app.get("/api/users/{id}")\ndef get_users(id): ...'), ("w.load", "function", "load", "fetch(`/api/users/${id}?x=1`, {method: 'POST'}); axios.get('/api/a/')"),
            ("m.User", "class", "User", "class User(models.Model):\n    pass"), ("m.A", "class", "A", 'class A(Base):\n    __tablename__ = "aa"'),
            ("q.f", "function", "f", "User.objects.filter(x=1); db.query(A); client.table('t').insert(x)"), ("s.S", "class", "S", "class S(BaseSettings):\n    env_prefix = 'P_'\n    url: str\n    key: str = Field(..., env='K')"),
            ("e.f", "function", "f", "os.getenv('A'); os.environ['B']; environ.get('C'); process.env.D"),
            ("n.f", "module", "n", 'require("../native/index.node"); ctypes.CDLL("libm.so.6"); spawn("ls")'),
        ],
        "id string, type string, name string, source_code string",
    )
    assert {(r.id, r.method, r.path) for r in extract.routes(n).collect()} == {("app.get_users", "GET", "/api/users/:param")}
    assert {(r.id, r.method, r.path) for r in extract.api_calls(n).filter("id = 'w.load'").collect()} == {("w.load", "POST", "/api/users/:param"), ("w.load", "GET", "/api/a")}
    models = extract.model_tables(n)
    assert {(r.model, r.table) for r in models.collect()} == {("User", "users"), ("A", "aa")}
    assert {(r.op, r.table) for r in extract.orm_uses(n, models).filter("id = 'q.f'").collect()} == {("read", "users"), ("read", "aa"), ("write", "t")}
    assert {r.name for r in extract.env_uses(n).filter("id = 'e.f'").collect()} == {"A", "B", "C", "D"}
    assert {r.name for r in extract.settings_fields(n).collect()} == {"P_URL", "P_KEY", "K"}
    assert {(r.bridge, r.module) for r in extract.bindings(n).collect()} == {("napi", "native"), ("ctypes", "m")}


def test_feeds(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path / name}"

    cov = feeds.coverage(spark, put("c.json", '{"files": {"a.py": {"executed_lines": [1, 2]}}}'))
    assert {(r.file_path, r.line) for r in cov.collect()} == {("a.py", 1), ("a.py", 2)}
    trace = feeds.traces(spark, put("t.json", '{"edges": [{"from": "a", "to": "b", "count": 3}], "total_calls": 3, "unique_edges": 1}'))
    assert [tuple(r) for r in trace.collect()] == [("a", "b", 3)]
    text = "a" * 40 + " 1 1 2\nauthor Ann\nauthor-time 1700000000\n\tx = 1\n" + "a" * 40 + " 2 2\n\ty = 2\n"
    blame = feeds.blame(spark.createDataFrame([("f.py", text)], "file string, text string")).orderBy("line").collect()
    assert [(r.line, r.author, r.content) for r in blame] == [(1, "Ann", "x = 1"), (2, "Ann", "y = 2")]
    log = feeds.log(spark.createDataFrame([("l", "abcdef1|Ann|2024-01-02|fix\n\na.py\nb.py\n1234567|Bo|2024-01-01|empty\n")], "file string, text string"))
    assert {(r.commit, r.path) for r in log.collect()} == {("abcdef1", "a.py"), ("abcdef1", "b.py"), ("1234567", None)}
    hunks = feeds.changed_ranges(spark.createDataFrame([("d", "--- a/x.py\n+++ b/x.py\n@@ -1 +2,3 @@\n+q\n@@ -9,0 +12 @@\n")], "file string, text string"))
    assert [(r.path, r.start, r.end) for r in hunks.orderBy("start").collect()] == [("x.py", 2, 4), ("x.py", 12, 12)]


def test_scan_and_project(spark, tmp_path):
    for name, text in {"pkg/__init__.py": "", "pkg/models.py": MODELS, "pkg/util.py": "def slugify(x):\n    return x\n", "node_modules/x.js": "x()", "lib/y.py": "y = 1", "a/lib/z.py": "z = 1", ".github/workflows/ci.yml": "on: push\njobs:\n  a:\n    steps:\n      - uses: b/c@v1\n", "docker-compose.yml": COMPOSE, "package.json": '{"name": "p"}'}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    root = f"file://{tmp_path}"
    assert {r.path for r in files.scan(spark, root).collect()} == {"pkg/__init__.py", "pkg/models.py", "pkg/util.py", "a/lib/z.py"}
    p = project.build(spark, root)
    edges = {(r.from_node, r.to_node, r.type) for r in p.edges.collect()}
    assert {("pkg.models.load", "pkg.models.User", "reads_table"), ("ci.github.ci.a", "ci.action.b/c@v1", "depends_on"), ("infra.service.web", "infra.service.db", "depends_on"), ("pkg.models.load", "env.DB_URL", "uses_env")} <= edges
    assert ("pkg.models.Admin", "pkg.models.User", "inherits") in edges
    assert project.call(p, "check_impact", node_id="pkg.util.slugify").first().total == 5
    assert project.call(p, "vibecheck").first().grade in "ABCDF"
    dead = {r.id for r in project.call(p, "dead_code").collect()}
    assert "pkg.models.load" not in dead and "pkg.models.User" not in dead


def test_sync_carries_annotations_over(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f():\n    return g()\n\ndef g():\n    return 1\n")
    root = f"file://{tmp_path}"
    p = project.build(spark, root)
    same, status = project.sync(p, root)
    assert same is p and {r.status for r in status.collect()} == {"unchanged"}
    p.nodes = project.call(p, "save_annotation", updates=spark.createDataFrame([("a.f", "does f", "io")], "id string, summary string, role string")) if "summary" in p.nodes.columns else p.nodes.selectExpr("*", "case when id = 'a.f' then 'does f' end as summary")
    (tmp_path / "a.py").write_text("def f():\n    return g()\n\ndef h():\n    return 1 + 1\n")
    now, status = project.sync(p, root)
    found = {r.id: r.status for r in status.collect()}
    assert (found["a.f"], found["a.g"], found["a.h"]) == ("unchanged", "deleted", "added")
    assert {r.id: r.summary for r in now.nodes.collect()}["a.f"] == "does f"
    assert {(r.node_id, r.action) for r in project.call(now, "history").collect()} >= {("a.g", "deleted"), ("a.h", "created")}


API = {
    "app/__init__.py": "", "app/main.py": "from app import users\nfrom fastapi import FastAPI\napp = FastAPI()\napp.include_router(users.router, prefix='/api')\n",
    "app/users.py": 'router = APIRouter(prefix="/users")\n\n@router.get("/{id}")\ndef get_user(id):\n    return slow(id)\n\n@router.route(\n    "/", methods=["POST", "PUT"])\ndef save(x):\n    """Saves."""\n    password = "hunter22"\n    return x\n\ndef slow(x):\n    return open(x)\n',
    "web/api.ts": "export const load = (id) => { return fetch(`/api/users/${id}`); };\nexport function put() { fetch('/api/users/', {method: 'PUT'}); fetch('/nowhere'); }\napp.use('/web', pages);\npages.get('/home', show);\n",
    "web/x.test.ts": "fetch('/api/users/1')\n", "Dockerfile": "FROM a\nENV MODE=1\nARG VERSION\n", ".env": "MODE=2\nUNUSED=1\n", "app/env.py": "import os\ndef mode():\n    return os.getenv('MODE') or os.environ['MISSING']\n",
    "app/native.py": "import ctypes\nlib = ctypes.CDLL('libm.so')\n",
}


def test_api_map_and_tools(spark, tmp_path):
    for name, text in API.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    p = project.build(spark, f"file://{tmp_path}")
    routes = pairs(p.routes, "id", "method", "path")
    assert routes >= {("app.users.get_user", "GET", "/api/users/:param"), ("app.users.save", "POST", "/api/users"), ("app.users.save", "PUT", "/api/users")}
    assert ("GET", "/web/home") in {(m, q) for _, m, q in routes}
    api = {(r.from_node, r.to_node) for r in p.edges.filter("type = 'calls_api'").collect()}
    assert api == {("web.api.load", "app.users.get_user"), ("web.api.put", "app.users.save")}
    env = {r.name: (r.origin, r.undefined) for r in project.call(p, "env_map").collect()}
    assert env["MODE"] == ("file:.env", False) and env["MISSING"] == (None, True) and env["VERSION"] == (None, True)
    assert pairs(project.call(p, "ffi_map"), "bridge", "module") == {("ctypes", "m")}
    infra = project.call(p, "infra_map", focus="docker").collect()
    assert [(r.category, r.type, r.nodes, r.n) for r in infra] == [("infra.build", "uses_env", 1, 2)]
    assert pairs(project.call(p, "grep", pattern="return slow("), "path", "line", "id") == {("app/users.py", 5, "app.users.get_user")}
    assert "app.users.slow" in project.call(p, "generate_test_skeleton", node_id="app.users.get_user").first().mocks
    kinds = {r.package: r.kind for r in project.call(p, "dependencies").collect()}
    assert kinds["os"] == "stdlib" and kinds["fastapi"] == "third-party" and "app" not in kinds
    project.call(p, "arch_rule_add", rule={"type": "required_test", "pattern": "get_*"})
    project.call(p, "arch_rule_add", rule=("x", "app.users.*", "app.users.slow"))
    assert pairs(project.call(p, "arch_check"), "rule_type", "violation") == {("required_test", "app.users.get_user"), ("no_dependency", "app.users.get_user → app.users.slow")}
    assert project.call(p, "arch_check", node_id="app.users.get_user").count() == 2 and project.call(p, "arch_rule_list").count() == 2
    assert project.call(p, "arch_rule_delete", rule_id="x").count() == 1
    before = p.nodes.count()
    gone = pairs(project.call(p, "delete_node", node_id="app.users.slow"), "from_node", "to_node")
    assert ("app.users.get_user", "app.users.slow") in gone and p.nodes.count() == before - 1 and p.edges.filter("to_node = 'app.users.slow'").count() == 0


def test_sync_parses_changed_files_only(spark, tmp_path, monkeypatch):
    (tmp_path / "a.py").write_text("def f():\n    return g()\n\ndef g():\n    return 1\n")
    (tmp_path / "b.py").write_text("from a import f\n\ndef h():\n    return f()\n")
    root = f"file://{tmp_path}"
    p = project.build(spark, root)
    parsed = []
    real = project._parsed
    monkeypatch.setattr(project, "_parsed", lambda df: (parsed.extend(sorted(r.path for r in df.select("path").collect())), real(df))[1])
    (tmp_path / "a.py").write_text("def f():\n    return 22\n\ndef k():\n    return f()\n")
    now, status = project.sync(p, root)
    assert parsed == ["a.py"]
    assert {r.id: r.status for r in status.collect()} == {"a": "modified", "a.f": "modified", "a.g": "deleted", "a.k": "added", "b": "unchanged", "b.h": "unchanged"}
    calls = {(r.from_node, r.to_node) for r in now.edges.filter("type = 'calls'").collect()}
    assert calls == {("a.k", "a.f"), ("b.h", "a.f")}
    (tmp_path / "b.py").unlink()
    last, status = project.sync(now, root)
    assert {r.id for r in last.nodes.collect()} == {"a", "a.f", "a.k"} and last.edges.filter("from_node = 'b.h'").count() == 0
    again, _ = project.sync(last, root, whole=True)
    assert {r.id for r in again.nodes.collect()} == {"a", "a.f", "a.k"}


def test_update_node(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f():\n    return g()\n\ndef g():\n    return 1\n")
    root = f"file://{tmp_path}"
    p = project.build(spark, root)
    assert pairs(project.call(p, "update_node", node_id="a.f", source="def f(:\n"), "id", "status") == {("a.f", "rolled_back")}
    assert pairs(project.call(p, "update_node", node_id="a.x", source="x"), "id", "status") == {("a.x", "not_found")}
    assert p.changes.count() == 0
    found = pairs(project.call(p, "update_node", node_id="a.f", source="def f():\n    return h()\n\ndef h():\n    return 2\n"), "id", "status")
    assert found == {("a", "modified"), ("a.f", "modified"), ("a.h", "added")}
    assert {(r.from_node, r.to_node) for r in p.edges.filter("type = 'calls'").collect()} == {("a.f", "a.h")}
    assert {r.id: r.start_line for r in p.nodes.filter("type = 'function'").collect()} == {"a.f": 1, "a.h": 4, "a.g": 7} and p.changes.count() == 3
    p.version = "0"
    assert {r.id for r in project.ensure(p, root).nodes.collect()} == {"a", "a.f", "a.g"}


def test_packages_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("package.json", '{"name": "top"}'), ("web/app/package.json", '{"name": "app"}'), ("web/app/node_modules/x/index.js", "x")], "path string, text string")
    assert [(r.path, r.depth, r.name, r.has_modules) for r in files.packages(rows).collect()] == [("package.json", 0, "top", False), ("web/app/package.json", 2, "app", True)]
    calls = spark.createDataFrame([("a", "b", 3), ("a", "c", 1)], "from_node string, to_node string, n long")
    files.write_trace(calls, str(tmp_path / "trace"))
    assert sorted(map(tuple, feeds.traces(spark, str(tmp_path / "trace"), by_line=True).collect())) == [("a", "b", 3), ("a", "c", 1)]
    many = spark.range(30_000).selectExpr("concat('a', id) as from_node", "'b' as to_node", "id as n")
    files.write_trace(many, str(tmp_path / "long"))
    assert feeds.traces(spark, str(tmp_path / "long"), by_line=True).agg({"n": "sum"}).first()[0] == 30_000 * 29_999 // 2
    assert spark.read.text(str(tmp_path / "long")).count() >= 3
    listing = spark.createDataFrame([("a.py", 1.5, 3), ("b.py", 2.0, 4)], "path string, mtime double, size long")
    files.write_fingerprints(listing, str(tmp_path / "prints"))
    assert sorted(map(tuple, feeds.fingerprints(spark, str(tmp_path / "prints"), by_line=True).collect())) == [("a.py", 1.5, 3), ("b.py", 2.0, 4)]
    rules = spark.createDataFrame([("r", "no_dependency", "d", "a.*", "b.*", None, None)], RULES)
    files.write_rules(rules, str(tmp_path / "rules"))
    assert [tuple(r) for r in feeds.arch_rules(spark, str(tmp_path / "rules"), by_line=True).collect()] == [("r", "no_dependency", "d", "a.*", "b.*", None, None)]
    first = files.publish(calls, str(tmp_path / "versions"), "1")
    assert spark.read.parquet(first).count() == 2 and files.empty(spark, "a int").count() == 0
