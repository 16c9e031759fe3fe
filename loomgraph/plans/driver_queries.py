"""One query for each operator over the driver's tables, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import graph as G
from ..operators import incremental as U
from ..operators import joins as J
from ..operators import rules as R
from . import binding
from .binding import SQL, table
from .tables import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; ``sql`` after WITH, with the graph's relations in front where it names them."""

    def add(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql if "g_" not in sql else ("WITH RECURSIVE " + SQL + (", " + sql.lstrip()[5:] if sql.lstrip().startswith("WITH ") else sql))
        return f

    return add


def flat(s: SparkSession, d: str) -> DataFrame:
    return G.collapse(binding.edges(s, d), ["seq", "type", "confidence", "source"])


# ---- sources and filters


@query("SELECT type, count(*) AS n, count(DISTINCT file_path) AS files FROM g_nodes GROUP BY type")
def s1_load_graph(s, d):
    return binding.nodes(s, d).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))


@query("SELECT id, type, name FROM g_nodes WHERE id = 'R2.N2'")
def f1_get_node(s, d):
    return P.get_node(binding.nodes(s, d), "R2.N2").select("id", "type", "name")


@query("SELECT id, type, start_line FROM g_nodes WHERE type = 'method' AND file_path ILIKE 'a%' AND name ILIKE '%7%'")
def f2_get_nodes(s, d):
    return P.get_nodes(binding.nodes(s, d), "method", "a", "7").select("id", "type", "start_line")


@query("SELECT from_node, to_node, type FROM g_edges WHERE from_node = 'R2.N2' OR to_node = 'R2.N2'")
def f3_get_edges(s, d):
    return P.get_edges(binding.edges(s, d), "R2.N2").select("from_node", "to_node", "type")


@query("SELECT from_node, to_node FROM g_edges WHERE type IN ('imports', 'uses')")
def f4_edges_by_types(s, d):
    return P.get_edges_by_types(binding.edges(s, d), ["imports", "uses"]).select("from_node", "to_node")


@query("SELECT doc_id, lang FROM documents WHERE text ILIKE '%token%' OR source ILIKE '%token%'")
def f5_search(s, d):
    return P.search(table(s, d, "documents"), "token", ["text", "source"]).select("doc_id", "lang")


@query("SELECT id, 1::INTEGER AS tier FROM g_nodes WHERE id ILIKE '%.C7' ORDER BY length(id), id LIMIT 5")
def f6_resolve_id(s, d):
    return P.resolve_id(binding.nodes(s, d), "C7")


@query("SELECT id FROM g_nodes")
def f8_all_ids(s, d):
    return P.all_ids(binding.nodes(s, d))


@query(r"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS content, unnest(range(1, len(l) + 1)) AS line FROM t)
SELECT doc_id AS path, line::INTEGER AS line, content FROM u WHERE regexp_matches(content, 'token = "[0-9a-f]{40}"') ORDER BY 1, 2 LIMIT 50""")
def f9_grep(s, d):
    return P.grep(table(s, d, "documents"), 'token = "[0-9a-f]{40}"', path="doc_id")


@query("SELECT id FROM g_nodes WHERE regexp_matches(id, '^R1[.]N.*[.]S.*$')")
def f10_glob(s, d):
    return binding.nodes(s, d).filter(X.matches_glob(F.col("id"), "R1.N*.S*")).select("id")


@query("SELECT id FROM g_nodes WHERE (type IN ('class', 'function') AND (name LIKE '%1' OR name LIKE '%A')) OR starts_with(name, 'Customer#00000001')")
def f11_rules(s, d):
    n = binding.nodes(s, d)
    return n.filter(P.rule_test("name", "suffix", ("1", "A"), ("class", "function")) | P.rule_test("name", "prefix", ("Customer#00000001",))).select("id")


@query("""WITH a AS (SELECT n.doc_id, sha256(n.text) AS hash, l.quality, CASE WHEN n.doc_id % 3 = 0 THEN sha256(n.text) ELSE 'x' END AS old
FROM documents n LEFT JOIN labels l USING (doc_id))
SELECT doc_id::VARCHAR AS id, quality IS NOT NULL AS annotated, quality IS NOT NULL AND old <> hash AS stale FROM a WHERE quality IS NOT NULL AND old <> hash""")
def f13_stale_annotations(s, d):
    own = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").withColumn("hash", F.sha2("text", 256))
    own = own.select(F.col("doc_id").cast("string").alias("id"), F.lit("function").alias("type"), F.lit(None).cast("string").alias("summary"), F.col("quality").cast("string").alias("role"), "hash", F.when(F.col("doc_id") % 3 == 0, F.col("hash")).otherwise("x").alias("annotation_hash"))
    return P.needs_annotation(own, stale_only=True).select("id", "annotated", "stale")


@query("SELECT id, regexp_replace(id, '[.][^.]+$', '') AS parent FROM g_nodes WHERE type IN ('method', 'function') AND regexp_replace(id, '[.][^.]+$', '') IN (SELECT id FROM g_nodes WHERE type = 'class')")
def f14_children(s, d):
    n = binding.nodes(s, d)
    return P.children(n, n.filter("type = 'class'")).select("id", "parent")


@query("SELECT doc_id, length(text) > 3000 AND lang = 'en' AS hidden FROM documents")
def f15_hide_large(s, d):
    own = table(s, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "class").otherwise("function").alias("type"), F.col("text").alias("source_code"))
    return P.hide_large_sources(own, 3000).select("doc_id", F.col("source_code").isNull().alias("hidden"))


# ---- joins


@query("""WITH w AS (SELECT 'day' AS span, 1 AS n UNION ALL SELECT 'week', 7 UNION ALL SELECT 'month', 31),
e AS (SELECT event_id, user_id, event_type, date_diff('day', DATE '2024-01-01', ts::DATE) AS day FROM events),
i AS (SELECT event_type, span, d AS lo, d + n - 1 AS hi FROM (SELECT DISTINCT event_type FROM events), w, (SELECT unnest(range(0, 31, 10)) AS d))
SELECT event_id, span, lo::BIGINT AS lo FROM (SELECT event_id, span, lo, row_number() OVER (PARTITION BY event_id ORDER BY hi - lo, lo) AS r FROM e JOIN i USING (event_type) WHERE day BETWEEN lo AND hi) WHERE r = 1""")
def j1_smallest_interval(s, d):
    e = table(s, d, "events").select("event_id", "event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long").alias("day"))
    w = s.createDataFrame([(k, lo, lo + n - 1) for k, n in (("day", 1), ("week", 7), ("month", 31)) for lo in (0, 10, 20, 30)], "span string, lo long, hi long")
    spans = e.select("event_type").distinct().join(F.broadcast(w))
    return J.containing(e, spans, ["event_type"], "day", "lo", "hi", ["event_id"], ["lo"]).select("event_id", "span", "lo")


@query("""WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS a, date_diff('day', DATE '1990-01-01', max(l_shipdate)::DATE) AS b
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate),
m AS (SELECT unnest(range(0, 6000, 30)) AS c)
SELECT o_orderkey, (c // 30)::BIGINT AS month FROM o JOIN m ON a <= c + 29 AND c <= b WHERE a <= b""")
def j2_overlaps(s, d):
    day = lambda c: F.datediff(F.to_date(c), F.lit("1990-01-01")).cast("long")
    last = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    o = table(s, d, "orders").join(last, "o_orderkey").select("o_orderkey", day("o_orderdate").alias("a"), day("last").alias("b")).filter("a <= b")
    m = s.range(0, 6000, 30).select(F.col("id").alias("c"), (F.col("id") + 29).alias("e"))
    return J.overlapping(o, m, "a", "b", "c", "e", 60).select("o_orderkey", F.floor(F.col("c") / 30).alias("month"))


@query("""SELECT f.type AS from_type, t.type AS to_type, e.type, count(*) AS n FROM g_edges e JOIN g_nodes f ON e.from_node = f.id JOIN g_nodes t ON e.to_node = t.id GROUP BY ALL""")
def j3_enrich(s, d):
    return J.enrich(binding.edges(s, d), binding.nodes(s, d), ["type"], "inner").groupBy("from_type", "to_type", "type").agg(F.count("*").alias("n"))


ROUTES = (("r1", "/:param/:param", "ANY"), ("r2", "/en/:param", "GET"), ("r3", "/fr/:param", "POST"), ("r4", "/de/:param/", "GET"), ("r5", "/es/:param", "ANY"))


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, regexp_extract(url, '://[^/]*([^?#]*)', 1) AS raw FROM pages),
q AS (SELECT page_id, method, CASE WHEN length(raw) > 1 THEN rtrim(raw, '/') ELSE raw END AS path FROM p),
r(route, pattern, verb) AS (VALUES ('r1', '/:param/:param', 'ANY'), ('r2', '/en/:param', 'GET'), ('r3', '/fr/:param', 'POST'), ('r4', '/de/:param', 'GET'), ('r5', '/es/:param', 'ANY')),
x AS (SELECT page_id, route, string_split(path, '/') AS a, string_split(pattern, '/') AS b FROM q JOIN r ON verb = 'ANY' OR verb = method)
SELECT page_id, route FROM x WHERE len(a) = len(b) AND len(list_filter(list_zip(a, b), lambda z: z[1] <> z[2] AND z[2] <> ':param' AND z[1] <> ':param')) = 0""")
def j4_routes(s, d):
    path = X.normalise_route(F.regexp_extract("url", r"://[^/]*([^?#]*)", 1))
    calls = table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST").alias("method"), path.alias("path"))
    routes = s.createDataFrame(ROUTES, "route string, pattern string, verb string").withColumn("pattern", X.normalise_route(F.col("pattern")))
    return J.route_matches(calls, routes, "path", "pattern", "method", "verb").select("page_id", "route")


@query("""WITH k AS (SELECT id, regexp_extract(id, '[^.]+$') AS s FROM g_nodes UNION ALL SELECT id, regexp_extract(id, '[^.]+[.][^.]+$') FROM g_nodes WHERE id LIKE '%.%.%'),
u AS (SELECT s, min(id) AS id FROM k WHERE s <> id GROUP BY s HAVING count(DISTINCT id) = 1),
e AS (SELECT c_id AS from_node, 'S' || s_suppkey AS to_node, c_custkey FROM g_cust JOIN g_supp ON c_custkey % 50 = s_suppkey % 50)
SELECT from_node, coalesce(u.id, to_node) AS to_node FROM e LEFT JOIN u ON u.s = to_node""")
def j5_unique_suffix(s, d):
    n = binding.nodes(s, d)
    c = n.filter("type = 'method'").select(F.col("id").alias("from_node"), (F.regexp_extract("id", r"C(\d+)$", 1).cast("long") % 50).alias("k"))
    p = n.filter("type = 'function'").select(F.regexp_extract("id", r"(S\d+)$", 1).alias("to_node"), (F.regexp_extract("id", r"S(\d+)$", 1).cast("long") % 50).alias("k"))
    return J.normalise_ends(c.join(p, "k").select("from_node", "to_node"), n, ("to_node",)).select("from_node", "to_node")


@query("SELECT a.id AS ancestor, count(*) AS n FROM g_nodes a JOIN g_nodes b ON starts_with(b.id, a.id || '.') GROUP BY a.id")
def j6_prefix(s, d):
    n = binding.nodes(s, d)
    return J.descendants(n, n).groupBy("ancestor").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, p_partkey FROM nation CROSS JOIN part ANTI JOIN (SELECT s_nationkey, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) ON l_partkey = p_partkey AND s_nationkey = n_nationkey WHERE n_nationkey = p_size % 25")
def j7_anti(s, d):
    sold = table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("p_partkey"), F.col("s_nationkey").alias("n_nationkey"))
    return J.without(table(s, d, "part").withColumn("n_nationkey", (F.col("p_size") % 25).cast("int")), sold, ["p_partkey", "n_nationkey"]).select("n_nationkey", "p_partkey")


@query("SELECT c_custkey FROM customer SEMI JOIN events ON user_id = c_custkey")
def j9_semi(s, d):
    return J.having(table(s, d, "customer"), table(s, d, "events").select(F.col("user_id").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("SELECT DISTINCT t.file_path, e.to_node AS id FROM g_edges e JOIN g_nodes t ON t.id = e.to_node JOIN g_nodes f ON f.id = e.from_node WHERE f.file_path <> t.file_path")
def j10_public_members(s, d):
    return J.public_members(binding.edges(s, d), binding.nodes(s, d), "file_path")


@query("SELECT p_partkey, coalesce(p.p_name, 'db.table.' || b.p_brand) AS p_name FROM part b LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_size < 20) p USING (p_partkey)")
def j11_lookup(s, d):
    part = table(s, d, "part")
    return J.lookup(part.select("p_partkey", "p_brand"), part.filter("p_size < 20"), "p_partkey", "p_name", F.concat(F.lit("db.table."), "p_brand")).select("p_partkey", "p_name")


@query("""WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' ELSE 'unchanged' END AS status FROM a FULL JOIN b USING (doc_id)""")
def j13_diff(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    old = docs.filter("doc_id % 10 != 0").select("doc_id", F.sha2("text", 256).alias("h"))
    new = docs.filter("doc_id % 11 != 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return J.diff(old, new, "doc_id", "h")


@query("""WITH p AS (SELECT DISTINCT l_suppkey, l_quantity::BIGINT AS q FROM lineitem), i AS (SELECT s_suppkey, (s_suppkey % 40)::BIGINT AS lo, (s_suppkey % 40 + 10)::BIGINT AS hi FROM supplier)
SELECT s_suppkey, count(q) AS covered FROM i LEFT JOIN p ON l_suppkey = s_suppkey AND q BETWEEN lo AND hi GROUP BY s_suppkey""")
def j14_covered_lines(s, d):
    points = table(s, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_quantity").cast("long").alias("q"))
    spans = table(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 40).alias("lo"), (F.col("s_suppkey") % 40 + 10).alias("hi"))
    return J.covered_counts(points, spans, ["s_suppkey"], "q", "lo", "hi", "s_suppkey")


@query("""SELECT e.event_id, min(p.ts) AS next_ts FROM (SELECT * FROM events WHERE event_type = 'error') e LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
ON p.user_id = e.user_id AND p.ts > e.ts GROUP BY e.event_id""")
def j16_next_after(s, d):
    e = table(s, d, "events")
    left, right = e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("next_ts"))
    return J.next_after(left, right, ["user_id"], "ts", "next_ts", ["next_ts"]).select("event_id", "next_ts")


@query("""SELECT e.event_id, max(p.ts) AS last_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') e LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p
ON p.user_id = e.user_id AND p.ts < e.ts GROUP BY e.event_id""")
def j17_last_before(s, d):
    e = table(s, d, "events")
    left, right = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("last_ts"))
    return J.last_before(left, right, ["user_id"], "ts", "last_ts", ["last_ts"]).select("event_id", "last_ts")


@query("""SELECT c_custkey, coalesce(a.s_name, b.s_name) AS s_name FROM customer LEFT JOIN supplier a ON a.s_suppkey = c_custkey LEFT JOIN supplier b ON b.s_suppkey = c_custkey % 20""")
def j19_tiers(s, d):
    c = table(s, d, "customer").select("c_custkey", F.col("c_custkey").alias("k1"), (F.col("c_custkey") % 20).alias("k2"))
    return J.tiers(c, table(s, d, "supplier"), ["k1", "k2"], "s_suppkey", "s_name").select("c_custkey", "s_name")


# ---- aggregations


@query("""WITH a AS (SELECT count(*) AS nodes, count(*) FILTER (type IN ('function', 'method', 'class')) AS definitions, count(*) FILTER (type IN ('function', 'method', 'class') AND name LIKE '%1%') AS documented FROM g_nodes),
b AS (SELECT count(*) AS edges, count(*) FILTER (confidence <> 'external') AS internal, count(*) FILTER (confidence = 'resolved') AS resolved FROM g_edges)
SELECT *, round(100.0 * resolved / internal, 1)::DOUBLE AS resolved_pct, round(100.0 * documented / definitions, 1)::DOUBLE AS documented_pct FROM a, b""")
def a1_health(s, d):
    n = binding.nodes(s, d).withColumn("docstring", F.when(F.contains("name", F.lit("1")), F.col("name")))
    return A.health(n, binding.edges(s, d))


@query("SELECT type, count(*) AS n FROM g_edges GROUP BY type")
def a1_edges_by_type(s, d):
    return A.count_by(binding.edges(s, d), "type")


@query("""SELECT p_brand AS package, CASE WHEN p_brand IN ('Brand#1', 'Brand#11') THEN 'builtin' WHEN p_brand IN ('Brand#2', 'Brand#22') THEN 'stdlib' ELSE 'third-party' END AS kind, count(*) AS usages, count(DISTINCT l_suppkey) AS places
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def a2_dependencies(s, d):
    e = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return A.dependencies(e, "l_suppkey", F.col("p_brand"), A.package_kind(F.col("p_brand"), ["Brand#1", "Brand#11"], ["Brand#2", "Brand#22"], ["none"]))


@query("SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_name) AS items, count(*) AS n FROM supplier GROUP BY s_nationkey")
def a3_by_file(s, d):
    return A.by_file(table(s, d, "supplier"), "s_nationkey", "s_name")


@query("""SELECT file_path, count(*) FILTER (type = 'class') AS class, count(*) FILTER (type = 'function') AS function, count(*) FILTER (type = 'method') AS method, count(*) AS total FROM g_nodes GROUP BY ROLLUP (file_path)""")
def a4_structure(s, d):
    return A.structure(binding.nodes(s, d), ["class", "function", "method"])


@query("""SELECT c_nationkey, count(*) AS methods, sum(length(c_name))::BIGINT AS lines, count(*) FILTER (c_acctbal >= 0) AS public, count(*) FILTER (c_acctbal < 0) AS private FROM customer GROUP BY c_nationkey""")
def a5_class_metrics(s, d):
    return A.class_metrics(table(s, d, "customer"), "c_nationkey", "c_name", F.length("c_name"), F.col("c_acctbal") < 0)


@query("""SELECT p_brand, prefix, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, prefix) AS r FROM (SELECT p_brand, split_part(p_type, '_', 1) AS prefix, count(*) AS n FROM part GROUP BY p_brand, prefix)) WHERE r <= 3""")
def a5_name_prefixes(s, d):
    return A.name_prefixes(table(s, d, "part"), "p_brand", "p_type", 3)


@query("""SELECT count(p_size) AS n, round(avg(p_size), 1) AS mean, round(median(p_size), 1)::DOUBLE AS median, min(p_size) AS least, max(p_size) AS most,
list_sort(list(p_size))[floor(count(*) * 0.9)::INT + 1] AS p90, list_sort(list(p_size))[floor(count(*) * 0.95)::INT + 1] AS p95 FROM part""")
def a6_project_metrics(s, d):
    return A.project_metrics(table(s, d, "part"), "p_size")


@query("""SELECT p_partkey, round((rank() OVER (ORDER BY p_size) - 1) * 100.0 / count(*) OVER (), 1)::DOUBLE AS percentile_rank FROM part""")
def a7_percentile_rank(s, d):
    return A.percentile_rank(table(s, d, "part"), "p_size").select("p_partkey", F.col("percentile_rank").cast("double").alias("percentile_rank"))


@query("""SELECT f.file_path, count(*) FILTER (t.file_path = f.file_path) AS internal, count(*) FILTER (t.file_path IS DISTINCT FROM f.file_path) AS external,
round(count(*) FILTER (t.file_path = f.file_path) / count(*), 2) AS cohesion FROM g_edges e JOIN g_nodes f ON e.from_node = f.id LEFT JOIN g_nodes t ON e.to_node = t.id GROUP BY f.file_path""")
def a8_cohesion(s, d):
    return A.cohesion(binding.edges(s, d), binding.nodes(s, d), "file_path")


@query("""SELECT count(*) AS total, count(quality) AS annotated, count(*) FILTER (quality = 0) AS stale, round(100.0 * count(quality) / count(*), 1)::DOUBLE AS coverage_pct FROM documents LEFT JOIN labels USING (doc_id)""")
def a9_annotation_stats(s, d):
    own = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return A.annotation_stats(own, F.col("quality").isNotNull(), F.coalesce(F.col("quality") == 0, F.lit(False)))


@query("""SELECT count(*) FILTER (source = 'static') AS static, count(*) FILTER (source = 'runtime') AS runtime, count(*) FILTER (source = 'both') AS both, 0.0::DOUBLE AS confirmed_pct FROM g_edges""")
def a10_trace_stats(s, d):
    return A.trace_stats(binding.edges(s, d))


@query("SELECT id, count(*) AS degree FROM (SELECT from_node AS id FROM g_edges UNION ALL SELECT to_node FROM g_edges) GROUP BY id ORDER BY 2 DESC, 1 LIMIT 10")
def a10_busiest(s, d):
    return A.busiest(binding.edges(s, d))


@query("""WITH e AS (SELECT user_id, event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL), t AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT user_id, sum(n)::BIGINT AS changes, max(last) AS last, string_agg(event_type || '=' || n, ',' ORDER BY event_type || '=' || n) AS actions, user_id IN (SELECT user_id FROM t) AS tested,
round(sum(n) * CASE WHEN user_id IN (SELECT user_id FROM t) THEN 0.3 ELSE 1.0 END, 1)::DOUBLE AS risk FROM e GROUP BY user_id ORDER BY risk DESC, user_id LIMIT 20""")
def a11_hotspots(s, d):
    e = table(s, d, "events")
    return A.hotspots(e, e.filter("event_type = 'purchase'"), "user_id", "ts", "event_type", 20).withColumn("risk", F.col("risk").cast("double"))


@query("""WITH c AS (SELECT lang, count(*) AS total, count(quality) AS covered FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, total, covered, round(100.0 * covered / total, 1)::DOUBLE AS pct, CASE WHEN round(100.0 * covered / total, 1) >= 80 THEN 'A' WHEN round(100.0 * covered / total, 1) >= 60 THEN 'B' WHEN round(100.0 * covered / total, 1) >= 40 THEN 'C' WHEN round(100.0 * covered / total, 1) >= 20 THEN 'D' ELSE 'F' END AS grade FROM c""")
def a13_coverage(s, d):
    c = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("total"), F.count("quality").alias("covered"))
    return c.withColumn("pct", A.percent(F.col("covered"), F.col("total")).cast("double")).withColumn("grade", A.coverage_grade(F.col("pct")))


@query("SELECT to_node, string_agg(DISTINCT from_node, ',' ORDER BY from_node) AS items, count(DISTINCT from_node) AS n FROM g_edges WHERE type = 'imports' GROUP BY to_node")
def a15_route_map(s, d):
    return A.grouped_list(binding.edges(s, d).filter("type = 'imports'"), "to_node", "from_node", distinct=True)


@query("""SELECT to_node, count(*) FILTER (type = 'calls') AS callers, count(*) FILTER (type = 'imports') AS importers, count(*) FILTER (type = 'inherits') AS inheritors, count(*) FILTER (type NOT IN ('calls', 'imports', 'inherits')) AS other FROM g_edges GROUP BY to_node""")
def a24_usage_groups(s, d):
    return A.usage_groups(binding.edges(s, d))


@query("""SELECT count(*) FILTER (confidence <> 'external') AS internal, count(*) FILTER (confidence = 'resolved') AS resolved, round(100.0 * count(*) FILTER (confidence = 'resolved') / count(*) FILTER (confidence <> 'external'), 1)::DOUBLE AS pct,
round(100.0 * count(*) FILTER (confidence = 'resolved') / count(*) FILTER (confidence <> 'external'), 1) < 70 AS warn,
CASE WHEN round(100.0 * count(*) FILTER (confidence = 'resolved') / count(*) FILTER (confidence <> 'external'), 1) >= 90 THEN 'ok' WHEN round(100.0 * count(*) FILTER (confidence = 'resolved') / count(*) FILTER (confidence <> 'external'), 1) >= 70 THEN 'warn' ELSE 'fail' END AS band FROM g_edges""")
def a23_confidence_gate(s, d):
    return A.confidence_gate(binding.edges(s, d)).withColumn("pct", F.col("pct").cast("double"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS items, count(*) AS n FROM conversations GROUP BY conv_id")
def a25_handoff(s, d):
    return A.grouped_list(table(s, d, "conversations"), "conv_id", "role", "turn")


@query("""SELECT id, count(*) FILTER (i) AS in_degree, count(*) FILTER (NOT i) AS out_degree FROM (SELECT to_node AS id, true AS i FROM g_flat UNION ALL SELECT from_node, false FROM g_flat) GROUP BY id""")
def a26_degrees(s, d):
    return G.degrees(flat(s, d))


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def a_dedupe_by_priority(s, d):
    return A.dedupe(table(s, d, "lineitem"), ["l_orderkey"], [F.desc("l_quantity"), "l_partkey", "l_suppkey", "l_linenumber"]).select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT regexp_replace(file_path, '/[^/]*$', '') AS component, count(*) AS members FROM g_nodes WHERE type IN ('module', 'class', 'function') AND file_path LIKE '%/%' GROUP BY 1 HAVING count(*) >= 2 UNION ALL SELECT 'root', count(*) FROM g_nodes WHERE type = 'module'")
def a8_components(s, d):
    return A.components(binding.nodes(s, d))


# ---- windows, sorts, set operations


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS signup FROM events")
def w4_carry_forward(s, d):
    e = table(s, d, "events").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return U.carry_forward(e, ["user_id"], "event_id", "mark", "signup").select("user_id", "event_id", "signup")


@query("""WITH e AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM e)
SELECT user_id, min(day)::INTEGER AS start, max(day)::INTEGER AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def w5_islands(s, d):
    e = table(s, d, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("day")).distinct()
    return U.islands(e, ["user_id"], "day")


@query("SELECT doc_id, lag(source) OVER (PARTITION BY lang ORDER BY doc_id) AS before, lead(source, 2) OVER (PARTITION BY lang ORDER BY doc_id) AS after FROM documents")
def w6_context(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy("doc_id")
    return table(s, d, "documents").select("doc_id", F.lag("source").over(w).alias("before"), F.lead("source", 2).over(w).alias("after"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def t2_per_group_top(s, d):
    return P.per_group_limit(table(s, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("SELECT id FROM g_nodes ORDER BY file_path, start_line, id LIMIT 25 OFFSET 50")
def t2_page(s, d):
    return P.page(P.get_nodes(binding.nodes(s, d)), 50, 25).select("id")


@query("""SELECT ts, kind, key FROM (SELECT o_orderdate AS ts, 'order' AS kind, o_orderkey AS key FROM orders UNION ALL SELECT l_shipdate, 'ship', l_orderkey FROM lineitem) ORDER BY ts DESC, kind, key LIMIT 100""")
def t4_timeline(s, d):
    o = table(s, d, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("key"))
    ship = table(s, d, "lineitem").select(F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("key"))
    return U.timeline([("order", o), ("ship", ship)], "ts", 100).select("ts", "kind", "key")


@query("SELECT DISTINCT * FROM (SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A')")
def u2_regressions(s, d):
    f = lambda flag: table(s, d, "lineitem").filter(f"l_returnflag = '{flag}'").select(F.col("l_suppkey").alias("k"))
    return U.regressions(f("R"), f("A"))


@query("SELECT user_id AS k FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' UNION SELECT user_id FROM events WHERE event_type = 'purchase'")
def u3_set_operations(s, d):
    f = lambda kind: table(s, d, "events").filter(f"event_type = '{kind}'").select(F.col("user_id").alias("k"))
    return f("signup").intersect(f("error")).union(f("purchase")).distinct()


# ---- graph


@query("SELECT from_node, to_node, type, confidence, source, seq FROM g_flat")
def g1_collapse(s, d):
    return flat(s, d)


@query("SELECT id FROM (SELECT from_node AS id FROM g_edges UNION SELECT to_node FROM g_edges) ANTI JOIN (SELECT id FROM g_nodes WHERE type <> 'block') USING (id)")
def g1_dangling(s, d):
    return G.dangling(binding.edges(s, d), binding.nodes(s, d).filter("type != 'block'"))


IMPACT = """WITH RECURSIVE starts AS (SELECT id FROM g_nodes WHERE type = 'function'),
walk(start, id, d) AS (SELECT s.id, e.from_node, 1 FROM starts s JOIN g_flat e ON e.to_node = s.id
  UNION SELECT w.start, e.from_node, w.d + 1 FROM walk w JOIN g_flat e ON e.to_node = w.id WHERE w.d < 2 AND w.id <> w.start),
best AS (SELECT start, id, min(d) AS d FROM walk WHERE id <> start OR d = 1 GROUP BY ALL),
c AS (SELECT start, count(*) FILTER (d = 1) AS direct, count(*) FILTER (d > 1) AS indirect, count(*) AS total FROM best GROUP BY start),
bad AS (SELECT to_node AS start, count(*) AS unresolved FROM g_flat WHERE confidence = 'unresolved' AND type <> 'inherits' GROUP BY 1)
SELECT s.id AS start, coalesce(direct, 0) AS direct, 0::BIGINT AS inheritors, coalesce(indirect, 0) AS indirect, coalesce(total, 0) AS total, coalesce(unresolved, 0) AS unresolved,
CASE WHEN coalesce(total, 0) > 20 THEN 'CRITICAL' WHEN coalesce(total, 0) > 10 OR coalesce(unresolved, 0) > 0 THEN 'HIGH' WHEN coalesce(total, 0) > 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM starts s LEFT JOIN c ON c.start = s.id LEFT JOIN bad ON bad.start = s.id"""


@query(IMPACT.replace("WITH RECURSIVE", "WITH "))
def g2_impact(s, d):
    return G.impact_report(flat(s, d), binding.nodes(s, d).filter("type = 'function'"), 2)


@query("""WITH walk(id) AS (SELECT 'R0' UNION SELECT to_node FROM walk JOIN g_edges ON from_node = id) SELECT id FROM g_nodes ANTI JOIN walk USING (id) WHERE type IN ('function', 'method', 'class')""")
def g5_dead_code(s, d):
    return G.dead_code(binding.nodes(s, d), binding.edges(s, d), s.createDataFrame([("R0",)], "id string")).select("id")


@query("""WITH e AS (SELECT from_node, to_node FROM g_edges WHERE type = 'imports'), walk(start, id, d) AS (SELECT DISTINCT from_node, from_node, 0 FROM e UNION SELECT start, to_node, d + 1 FROM walk JOIN e ON from_node = id WHERE d < 12)
SELECT start, id, min(d)::INTEGER AS distance FROM walk GROUP BY ALL""")
def g6_distances(s, d):
    e = materialise(binding.edges(s, d).filter("type = 'imports'"), "imports")
    return G.distances(e, e.select(F.col("from_node").alias("id")), 12)


@query("""WITH e AS (SELECT from_node AS a, to_node AS b FROM g_edges WHERE type = 'imports'), walk(start, last, path) AS (SELECT a, b, [a, b] FROM e WHERE b > a
UNION ALL SELECT start, b, list_append(path, b) FROM walk JOIN e ON a = last WHERE b > start AND NOT list_contains(path, b))
SELECT len(path)::INTEGER AS length, array_to_string(path, '>') AS cycle FROM walk JOIN e ON a = last AND b = start""")
def g7_cycles(s, d):
    return G.cycles(binding.edges(s, d).filter("type = 'imports'")).select("length", F.array_join("cycle", ">").alias("cycle"))


@query("""WITH walk(id, d) AS (SELECT 'R1', 0 UNION SELECT to_node, d + 1 FROM walk JOIN g_flat ON from_node = id WHERE d < 3), best AS (SELECT id, min(d) AS d FROM walk GROUP BY id)
SELECT min(struct_pack(p := e.from_node, t := e.type)).p AS parent, b.id AS child, b.d::INTEGER AS depth, min(struct_pack(p := e.from_node, t := e.type)).t AS type, b.d = 3 AND b.id IN (SELECT from_node FROM g_flat) AS truncated
FROM best b JOIN g_flat e ON e.to_node = b.id JOIN best p ON p.id = e.from_node AND p.d = b.d - 1 GROUP BY b.id, b.d""")
def g4_dependency_tree(s, d):
    return G.dependency_tree(flat(s, d), s.createDataFrame([("R1",)], "id string"), 3)


@query("""WITH st AS (SELECT id FROM g_nodes WHERE type = 'function'), x AS (
SELECT s.id AS start, 'caller' AS direction, from_node AS id, min(e.type) AS type FROM st s JOIN g_flat e ON to_node = s.id GROUP BY ALL UNION ALL
SELECT s.id, 'callee', to_node, min(e.type) FROM st s JOIN g_flat e ON from_node = s.id GROUP BY ALL)
SELECT start, direction, id, 1::INTEGER AS distance, type FROM (SELECT *, row_number() OVER (PARTITION BY start, direction ORDER BY id) AS r FROM x) WHERE r <= 30""")
def g8_context(s, d):
    return G.context(flat(s, d), binding.nodes(s, d).filter("type = 'function'"), 1, 30)


@query("SELECT id, CASE WHEN type IN ('block', 'class') THEN 'structural' ELSE 'named' END AS category FROM g_nodes WHERE type IN ('block', 'class') OR name LIKE '%#3%'")
def g10_entry_points(s, d):
    rules = (("structural", "type", "exact", ("block", "class"), None), ("named", "name", "contains", ("#3",), None))
    return G.entry_points(binding.nodes(s, d), rules, {})


@query("""WITH k AS (SELECT id FROM g_nodes WHERE type = 'class' AND id LIKE 'R1.%'), m AS (SELECT id FROM g_nodes WHERE type = 'method' AND regexp_replace(id, '[.][^.]+$', '') IN (SELECT id FROM k))
SELECT id FROM k UNION SELECT id FROM m""")
def g11_expand_entries(s, d):
    n = binding.nodes(s, d)
    return G.expand_entries(n, binding.edges(s, d), n.filter("type = 'class' and id like 'R1.%'").select("id"))


@query("SELECT DISTINCT to_node AS id FROM g_edges JOIN g_nodes ON id = from_node WHERE file_path LIKE '%test%' OR name LIKE 'Customer#00000001%'")
def j9_tested(s, d):
    n = binding.nodes(s, d).withColumn("name", F.when(F.startswith("name", F.lit("Customer#00000001")), F.concat(F.lit("test_"), "name")).otherwise(F.col("name")))
    return G.tested(n, binding.edges(s, d), "C")


# ---- rules


@query("""WITH r(rule, a, b) AS (VALUES ('no1', '^R1[.].*[.]C.*$', '^R2[.].*$'), ('no2', '^R0[.].*$', '^R0[.].*[.]S.*$'))
SELECT DISTINCT rule, from_node, to_node FROM g_edges JOIN r ON regexp_matches(from_node, a) AND regexp_matches(to_node, b)""")
def r2_forbidden_edges(s, d):
    return R.forbidden_pairs(binding.edges(s, d), [("no1", "R1.*.C*", "R2.*"), ("no2", "R0.*", "R0.*.S*")])


@query("SELECT c_nationkey, count(*) AS methods FROM customer GROUP BY 1 HAVING count(*) > 60")
def r2_large_classes(s, d):
    return R.large_classes(table(s, d, "customer"), "c_nationkey", 60)


@query(r"""WITH t AS (SELECT doc_id, text AS x, lang || '_' || source AS n FROM documents)
SELECT doc_id, severity, rule FROM (
SELECT doc_id, 'MEDIUM' AS severity, 'no_logging' AS rule FROM t WHERE len(string_split(x, chr(10))) > 10 AND NOT regexp_matches(x, 'logger[.]|logging[.]|log[.](info|error|warning|debug)')
UNION ALL SELECT doc_id, 'CRITICAL', 'hardcoded_secret' FROM t WHERE regexp_matches(x, '(?i)(password|passwd|pwd)\s*=\s*["''][^"'']{3,}["'']') OR regexp_matches(x, '(?i)(api_key|apikey|secret_key)\s*=\s*["''][^"'']{6,}["'']') OR regexp_matches(x, '(?i)(token)\s*=\s*["''][^"'']{8,}["'']') OR regexp_matches(x, '(?i)(secret)\s*=\s*["''][^"'']{6,}["'']')
UNION ALL SELECT doc_id, 'HIGH', 'io_without_error_handling' FROM t WHERE regexp_matches(x, 'open[(]|requests[.]|httpx[.]|aiohttp[.]|[.](execute|query|fetchone|fetchall|read_text|write_text|read_bytes|write_bytes|unlink)[(]|subprocess[.]|socket[.]|urllib[.]|shutil[.]') AND NOT (contains(x, 'try:') AND contains(x, 'except')))""")
def r4_requirements(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", F.concat_ws("_", "lang", "source").alias("name"))
    return R.requirement_issues(docs, "name", "text", "doc_id")


@query("""SELECT p_partkey, ['accessor', 'io', 'validator', 'handler', 'orchestrator', 'transformer', 'factory', 'test', 'utility'][p_partkey % 9 + 1] AS role FROM part""")
def r8_roles(s, d):
    verbs = F.array(*(F.lit(v) for v in ("get_", "save_", "is_", "handle_", "run_", "to_", "build_", "test_", "x_")))
    name = F.concat(F.get(verbs, (F.col("p_partkey") % 9).cast("int")), F.lower("p_type"))
    return table(s, d, "part").select("p_partkey", R.role_of(name, F.lit("function")).alias("role"))


@query("""SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(lower(text), 'email') THEN 'sends_email' END, CASE WHEN regexp_matches(lower(text), 'print') THEN 'console_output' END,
CASE WHEN regexp_matches(lower(text), 'log') THEN 'writes_log' END, CASE WHEN regexp_matches(lower(text), 'write') THEN 'writes_file' END, CASE WHEN regexp_matches(lower(text), 'notify') THEN 'sends_notification' END,
CASE WHEN regexp_matches(lower(text), 'save|store|insert|update') THEN 'writes_database' END, CASE WHEN regexp_matches(lower(text), 'delete|remove') THEN 'deletes_data' END,
CASE WHEN regexp_matches(lower(text), 'send|post|fetch|crawl|download|upload') THEN 'network_io' END], lambda x: x IS NOT NULL)), ',') AS effects FROM documents""")
def r9_side_effects(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(R.effects_of(F.lit(""), F.col("text")), ",").alias("effects"))


@query("""WITH t AS (SELECT count(*) AS n, count(*) FILTER (quality IS NOT NULL) AS k, count(*) FILTER (quality = 0) AS z FROM documents LEFT JOIN labels USING (doc_id)),
p AS (SELECT round(100.0 * k / n, 1)::DOUBLE AS tested, round(100.0 * z / n, 1)::DOUBLE AS dead FROM t), s AS (SELECT *, round(tested / 100 * 25) + greatest(0, 20 - dead) + 5 + 8 + round(0.5 * 10) + round(0.9 * 15) AS score FROM p)
SELECT tested, dead, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade FROM s""")
def r6_health_score(s, d):
    own = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    t = own.agg(F.count("*").alias("n"), F.count("quality").alias("k"), F.sum(F.coalesce((F.col("quality") == 0).cast("long"), F.lit(0))).alias("z"))
    p = t.select(A.percent(F.col("k"), F.col("n")).cast("double").alias("tested"), A.percent(F.col("z"), F.col("n")).cast("double").alias("dead"))
    score = R.health_score(F.col("tested"), F.col("dead"), F.lit(2), F.lit(0), F.lit(False), F.lit(50.0), F.lit(90.0))
    return p.withColumn("score", score.cast("double")).withColumn("grade", R.grade(F.col("score")))


@query("""WITH a AS (SELECT 'CRITICAL' AS severity, 'arch' AS rule, 'P' || p_partkey AS id, 3.0::DOUBLE AS points FROM part WHERE p_size = 50 UNION ALL SELECT 'MEDIUM', 'tests', 'C' || c_custkey, 0.5 FROM customer WHERE c_acctbal < 0)
SELECT severity, rule, id, points, (SELECT round(sum(points), 1) FROM a) AS total_points FROM a ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 ELSE 2 END, points DESC, rule, id LIMIT 20""")
def r7_fix_plan(s, d):
    a = table(s, d, "part").filter("p_size = 50").select(F.lit("CRITICAL").alias("severity"), F.lit("arch").alias("rule"), F.concat(F.lit("P"), "p_partkey").alias("id"), F.lit(3.0).alias("points"))
    b = table(s, d, "customer").filter("c_acctbal < 0").select(F.lit("MEDIUM").alias("severity"), F.lit("tests").alias("rule"), F.concat(F.lit("C"), "c_custkey").alias("id"), F.lit(0.5).alias("points"))
    return R.fix_plan([a, b], 20)


# ---- incremental


@query("""WITH e AS (SELECT from_node, to_node, CASE WHEN seq % 3 = 0 THEN 'runtime' WHEN seq % 3 = 1 THEN 'both' ELSE 'static' END AS source, CASE WHEN seq % 3 < 2 THEN seq END AS c FROM g_flat WHERE type = 'calls' AND seq % 5 <> 0),
n AS (SELECT from_node, to_node, count(*) AS n FROM g_edges WHERE type = 'calls' AND seq % 2 = 0 GROUP BY ALL)
SELECT from_node, to_node, CASE WHEN source IS NULL THEN 'runtime' WHEN n IS NOT NULL AND source = 'static' THEN 'both' ELSE source END AS source, CASE WHEN n IS NOT NULL AND (source IS NULL OR source <> 'both') THEN n ELSE c END AS runtime_calls,
CASE WHEN source IS NULL THEN 'new' WHEN n IS NOT NULL AND source = 'static' THEN 'upgraded' WHEN n IS NOT NULL AND source = 'runtime' THEN 'counted' ELSE 'kept' END AS change FROM e FULL JOIN n USING (from_node, to_node)""")
def u4_upsert_runtime(s, d):
    k = F.col("seq") % 3
    e = flat(s, d).filter("type = 'calls' and seq % 5 != 0").select("from_node", "to_node", F.when(k == 0, "runtime").when(k == 1, "both").otherwise("static").alias("source"), F.when(k < 2, F.col("seq")).alias("runtime_calls"))
    calls = binding.edges(s, d).filter("type = 'calls' and seq % 2 = 0").select("from_node", "to_node", F.lit(1).cast("long").alias("n"))
    return U.upsert_runtime(e, calls)


@query("""WITH a AS (SELECT doc_id, length(text) AS size FROM documents WHERE doc_id % 9 <> 0), b AS (SELECT doc_id, length(text) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 13 <> 0),
x AS (SELECT doc_id AS path, CASE WHEN a.size IS NULL THEN 'new' WHEN b.size IS NULL THEN 'gone' WHEN a.size <> b.size THEN 'changed' END AS status FROM a FULL JOIN b USING (doc_id))
SELECT path, status FROM x WHERE status IS NOT NULL""")
def u6_pending(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.length("text").alias("size"), F.lit(0.0).alias("mtime"))
    return U.pending(docs.filter("path % 13 != 0").withColumn("size", F.col("size") + F.when(F.col("path") % 5 == 0, 1).otherwise(0)), docs.filter("path % 9 != 0"))


@query("SELECT event_id AS id, user_id::VARCHAR AS node_id, event_type AS action FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-05' ORDER BY event_id DESC LIMIT 50")
def u12_history(s, d):
    log = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("node_id"), F.col("event_type").alias("action"))
    return U.history(log, "7", "2024-01-05").select("id", "node_id", "action")


@query("""SELECT user_id::VARCHAR AS key, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY user_id""")
def k7_notes(s, d):
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.struct("ts", "event_id").alias("updated_at"))
    return U.write_note(e.filter("updated_at.event_id % 2 = 0"), e.filter("updated_at.event_id % 2 = 1")).select("key", "value")


@query("SELECT prev AS from_node, event_type AS to_node, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) WHERE prev <> event_type GROUP BY ALL")
def u14_call_counts(s, d):
    from pyspark.sql import Window

    e = table(s, d, "events").withColumn("prev", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")))
    return U.call_counts(e, "prev", "event_type")


@query("""WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM y GROUP BY user_id, k""")
def u10_debounce(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return U.debounce(e, ["user_id"], "ts", "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderkey AS lo, o_orderkey + 40 AS hi FROM orders), y AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x)
SELECT o_custkey, o_orderkey FROM y WHERE p >= lo""")
def m6_overlapping_edits(s, d):
    e = table(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + 40).alias("hi"))
    return R.overlaps_before(e, "o_custkey", "lo", "hi").select("o_custkey", "o_orderkey")


@query("SELECT doc_id, ((length(text) - length(replace(text, 'the ', ''))) / 4)::INTEGER AS n, (length(text) - length(replace(text, 'the ', ''))) = 4 AS patchable FROM documents")
def m2_patchable(s, d):
    n = X.occurrences(F.col("text"), "the ")
    return table(s, d, "documents").select("doc_id", n.alias("n"), (n == 1).alias("patchable"))
