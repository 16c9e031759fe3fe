"""SQL, container, environment and workflow files to records, nodes and edges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import flat_map

# Words that stand where a table's name would, but are none.
NO_TABLES = (
    "select", "from", "where", "join", "inner", "left", "right", "outer", "on", "and", "or", "not", "null", "true", "false", "as", "in", "set", "values", "into",
    "table", "index", "create", "drop", "alter", "primary", "key", "foreign", "references", "constraint", "default", "autoincrement", "integer", "text", "real",
    "blob", "varchar", "char", "boolean", "timestamp", "date", "exists", "if", "the", "a", "an", "this", "that", "it", "is", "are", "was", "were", "disk", "file",
    "path", "directory", "folder", "tmp", "temp", "information_schema", "pg_catalog", "pg_stat", "pg_class", "sqlite_master", "sqlite_sequence",
    "sqlite_temp_master", "sys", "dual", "supabase", "firebase", "dynamo", "redis", "mongo", "postgres", "database", "storage", "server", "cloud",
)
EDGE_OF = {"read": "reads_table", "write": "writes_table", "migrate": "migrates"}


def plain_sql(text: Column) -> Column:
    """Without line and block comments."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")


def _tokens(text: Column) -> Column:
    """Array (statements) of arrays (tokens): lower-case names, dotted ones whole, brackets and commas. Quotes go, and so do
    IF EXISTS and IF NOT EXISTS."""
    plain = F.regexp_replace(F.lower(F.translate(text, "`\"'[]", "")), r"\bif\s++(?:not\s++)?exists\b", " ")
    return F.transform(F.split(plain, ";"), lambda s: F.regexp_extract_all(s, F.lit(r"\w++(?:\.\w++)*+|[(),]"), F.lit(0)))


def _uses(tokens: Column) -> Column:
    """Array of (op, table) of one statement: what a token is follows from the keywords before it."""

    def at(i: Column) -> Column:
        before = lambda k: F.get(tokens, i - k)
        one, two, three = before(1), before(2), before(3)
        selected = F.array_position(tokens, F.lit("select"))
        indexed = (one == "on") & ((three == "index") | (before(4) == "index") | ((two == "index")))
        return (
            F.when(((one == "from") & (two == "delete")) | ((one == "into") & (two == "insert")) | ((one == "update") & (F.get(tokens, i + 1) == "set")), "write")
            .when(((one == "from") & (selected > 0) & (selected <= i)) | (one == "join"), "read")
            .when(((one == "table") & two.isin("create", "alter", "drop")) | indexed, "migrate")
        )

    found = F.transform(tokens, lambda t, i: F.struct(at(i).alias("op"), F.regexp_extract(t, r"(\w++)$", 1).alias("table")))
    return F.filter(found, lambda u: u["op"].isNotNull() & (u["table"] != ""))


def _named(tokens: Column) -> Column:
    """Names of common table expressions: a name, AS, an opening bracket, after WITH, RECURSIVE or a comma."""
    starts = lambda i: F.get(tokens, i - 1).isin("with", "recursive", ",") & (F.get(tokens, i + 1) == "as") & (F.get(tokens, i + 2) == "(")
    return F.filter(F.transform(tokens, lambda t, i: F.when(starts(i), t)), lambda t: t.isNotNull())


def table_uses(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, op, table) of SQL statements in a text, each once; names of common table expressions and noise words are left out."""
    rows = df.select(F.col(key), _tokens(text).alias("_t")).select(key, F.flatten(F.transform("_t", _uses)).alias("_u"), F.flatten(F.transform("_t", _named)).alias("_c"))
    rows = rows.select(key, F.explode(F.array_distinct("_u")).alias("u"), "_c").filter(~F.array_contains("_c", F.col("u.table")))
    return rows.select(key, "u.op", "u.table").filter(~F.col("table").isin(*NO_TABLES)).distinct()


def sql_edges(uses: DataFrame, key: str, models: DataFrame | None = None) -> DataFrame:
    """(from_node, to_node, type): to the model that stands for a table (table, id), or to db.table.<name>; what is written
    without a known table goes to db.write.unknown."""
    kind = F.create_map(*(F.lit(x) for pair in EDGE_OF.items() for x in pair))
    out = uses.select(F.col(key).alias("from_node"), "table", F.element_at(kind, F.col("op")).alias("type"))
    if models is not None:
        out = out.join(models.select("table", F.col("id").alias("_id")), "table", "left")
    else:
        out = out.withColumn("_id", F.lit(None).cast("string"))
    return out.select("from_node", F.coalesce("_id", F.when(F.col("table") == "<unknown>", "db.write.unknown"), F.concat(F.lit("db.table."), "table")).alias("to_node"), "type").distinct()


def sql_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Virtual nodes and edges of .sql files (path, text); bodies of scheduled jobs count too."""
    own = files.filter(F.endswith("path", F.lit(".sql")))
    node = F.concat(F.lit("sql."), F.regexp_replace(F.regexp_replace("path", r"\.sql$", ""), "/", "."))
    nodes = own.select(node.alias("id"), F.lit("module").alias("type"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"))
    uses = table_uses(own.withColumn("id", node), "id", plain_sql(F.col("text")))
    return nodes, sql_edges(uses, "id")


def env_file(files: DataFrame) -> DataFrame:
    """(path, line, key, value) of KEY=value lines: upper-case keys, an optional export, quotes taken off."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    at = F.instr("line", "=")
    key = F.regexp_replace(F.trim(F.expr("substring(line, 1, instr(line, '=') - 1)")), r"^export\s+", "")
    value = F.trim(F.expr("substring(line, instr(line, '=') + 1)"))
    quoted = (F.length("value") > 1) & F.substring("value", 1, 1).isin("'", '"') & (F.substring("value", 1, 1) == F.substring("value", -1, 1))
    bare = F.when(quoted, F.expr("substring(value, 2, length(value) - 2)")).otherwise(F.col("value"))
    rows = lines.filter(at > 0).select("path", (F.col("at") + 1).alias("line"), key.alias("key"), value.alias("value"))
    return rows.filter(F.col("key").rlike(r"^[A-Z]\w*$") & (F.upper("key") == F.col("key"))).withColumn("value", bare)


def dockerfile(files: DataFrame) -> DataFrame:
    """(path, images, stages, ports, env, args, copied_from, command) of container build files."""
    every = lambda p, g=1: F.regexp_extract_all("text", F.lit("(?im)" + p), F.lit(g))
    first = F.regexp_extract("text", r"(?im)^\s*(?:ENTRYPOINT|CMD)\s+(.+?)\s*$", 1)
    return files.select(
        "path", every(r"^\s*FROM\s+(?:--\S+\s+)?(\S+)").alias("images"), every(r"^\s*FROM\s+(?:--\S+\s+)?\S+\s+AS\s+(\S+)").alias("stages"),
        F.transform(F.flatten(F.transform(every(r"^\s*EXPOSE\s+(.+?)\s*$"), lambda x: F.split(x, r"\s+"))), lambda p: F.regexp_replace(p, "/.*", "")).alias("ports"),
        every(r"^\s*ENV\s+([A-Za-z_]\w*)").alias("env"), every(r"^\s*ARG\s+([A-Za-z_]\w*)").alias("args"), every(r"^\s*COPY\s+--from=(\S+)").alias("copied_from"),
        F.when(first != "", first).alias("command"),
    )


def _scalar(text: str) -> str:
    text = re.sub(r"\s+#.*$", "", text).strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def _flow(text: str) -> list[str]:
    return [_scalar(x) for x in text.strip()[1:-1].split(",") if x.strip()]


def outline(text: str) -> list[tuple[int, str, str, int]]:
    """(indent, key, value, line) of a block-style YAML text; list items have the key ``-`` (and their own keys, two deeper)."""
    out, skip = [], None
    for number, raw in enumerate(text.split("\n"), 1):
        if not raw.strip() or raw.lstrip().startswith("#"):
            continue
        indent = len(raw) - len(raw.lstrip())
        if skip is not None and indent > skip:
            continue
        skip, line = None, raw.strip()
        while line.startswith("- ") or line == "-":
            rest = line[1:].lstrip()
            if not re.match(r"[\w.\-\"']+\s*:(\s|$)", rest) or re.match(r"[\"'].*[\"']$", rest):
                out.append((indent, "-", _scalar(rest), number))
                line = ""
            else:
                out.append((indent, "-", "", number))
                indent, line = indent + len(line) - len(rest), rest
        if m := re.match(r"([\w.\-\"'/]+)\s*:(?:\s+(.*))?$", line):
            value = (m[2] or "").strip()
            if value[:1] in "|>" and value:
                skip = indent
            out.append((indent, _scalar(m[1]), "" if value[:1] in "|>" and value else _scalar(value), number))
    return out


def _tree(text: str) -> dict:
    """Nested dictionaries and lists of the outline; plain strings at the leaves."""
    root: dict = {}
    stack: list[tuple[int, object]] = [(-1, root)]
    rows = outline(text)
    for i, (indent, key, value, _) in enumerate(rows):
        while len(stack) > 1 and (stack[-1][0] > indent or (stack[-1][0] == indent and not (key == "-" and isinstance(stack[-1][1], list)))):
            stack.pop()
        below = rows[i + 1] if i + 1 < len(rows) else None
        holder = stack[-1][1]
        if key == "-":
            if not isinstance(holder, list):
                continue
            if value:
                holder.append(value)
            else:
                holder.append({})
                stack.append((indent + 1, holder[-1]))
            continue
        if not isinstance(holder, dict):
            continue
        if value.startswith("[") and value.endswith("]"):
            holder[key] = _flow(value)
        elif value:
            holder[key] = value
        elif below and (below[0] > indent or (below[0] == indent and below[1] == "-")):
            holder[key] = [] if below[1] == "-" else {}
            stack.append((below[0] if below[1] == "-" else indent + 1, holder[key]))
        else:
            holder[key] = ""
    return root


def _list(x) -> list[str]:
    if isinstance(x, dict):
        return list(x)
    return [str(y) if not isinstance(y, dict) else next(iter(y), "") for y in x] if isinstance(x, list) else [x] if x else []


SERVICES = "path string, service string, image string, build string, ports array<string>, depends_on array<string>, env array<string>, line int"


def compose(files: DataFrame) -> DataFrame:
    """(path, service, image, build, ports, depends_on, env, line) of compose files."""

    def rows(r: dict) -> list[dict]:
        text = r["text"] or ""
        services, where, out = _tree(text).get("services"), {k: n for i, k, _, n in outline(text) if i > 0}, []
        for name, s in services.items() if isinstance(services, dict) else ():
            s = s if isinstance(s, dict) else {}
            build = s.get("build")
            out.append({
                "path": r["path"], "service": name, "image": s.get("image") or None, "build": build.get("context") if isinstance(build, dict) else build or None,
                "ports": _list(s.get("ports")), "depends_on": _list(s.get("depends_on")), "env": [e.split("=", 1)[0] for e in _list(s.get("environment"))], "line": where.get(name),
            })
        return out

    return flat_map(files.select("path", "text"), rows, SERVICES)


JOBS = "path string, workflow string, triggers array<string>, job string, runs_on string, needs array<string>, uses array<string>, secrets array<string>, env array<string>"


def workflows(files: DataFrame) -> DataFrame:
    """One row for each job of the workflow files: what triggers it, what it needs and uses, secrets and variables it names."""

    def rows(r: dict) -> list[dict]:
        text, out = r["text"] or "", []
        tree, stem = _tree(text), re.sub(r"\.ya?ml$", "", r["path"].rsplit("/", 1)[-1])
        jobs = tree.get("jobs") if isinstance(tree.get("jobs"), dict) else {}
        spans = _spans(text, list(jobs))
        for name, job in jobs.items():
            job = job if isinstance(job, dict) else {}
            own = spans.get(name, "")
            steps = [s for s in job["steps"] if isinstance(s, dict)] if isinstance(job.get("steps"), list) else []
            uses = [s["uses"] for s in [*steps, job] if isinstance(s.get("uses"), str) and s["uses"]]
            out.append({
                "path": r["path"], "workflow": stem, "triggers": _list(tree.get("on") or tree.get("true")), "job": name, "runs_on": ",".join(_list(job.get("runs-on"))),
                "needs": _list(job.get("needs")), "uses": uses, "secrets": sorted(set(re.findall(r"secrets\.([A-Za-z_]\w*)", own))),
                "env": sorted(set(re.findall(r"(?m)^\s+([A-Z][A-Z0-9_]{2,}):", own))),
            })
        return out

    return flat_map(files.select("path", "text"), rows, JOBS)


def _spans(text: str, jobs: list[str]) -> dict[str, str]:
    lines, at = text.split("\n"), {k: n for i, k, _, n in outline(text) if i > 0 and k in jobs}
    order = sorted((n, k) for k, n in at.items())
    return {k: "\n".join(lines[n - 1 : (order[i + 1][0] - 1 if i + 1 < len(order) else len(lines))]) for i, (n, k) in enumerate(order)}


def service_graph(services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Virtual nodes of services, and depends_on and uses_env edges."""
    own = F.concat(F.lit("infra.service."), "service")
    nodes = services.select(own.alias("id"), F.lit("block").alias("type"), F.col("service").alias("name"), F.col("path").alias("file_path"), F.col("line").alias("start_line"), F.to_json(F.struct("image", "build", "ports")).alias("metadata"))
    depends = services.select(own.alias("from_node"), F.explode("depends_on").alias("t")).select("from_node", F.concat(F.lit("infra.service."), "t").alias("to_node"), F.lit("depends_on").alias("type"))
    env = services.select(own.alias("from_node"), F.explode("env").alias("t")).select("from_node", F.concat(F.lit("env."), "t").alias("to_node"), F.lit("uses_env").alias("type"))
    return nodes, depends.unionByName(env).distinct()


def build_graph(builds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Virtual nodes of container build files, and edges to the variables they set."""
    own = F.concat(F.lit("infra.build."), F.replace("path", F.lit("/"), F.lit(".")))
    name = F.element_at(F.split("path", "/"), -1)
    nodes = builds.select(own.alias("id"), F.lit("block").alias("type"), name.alias("name"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"), F.to_json(F.struct("images", "stages", "ports", "command")).alias("metadata"))
    env = builds.select(own.alias("from_node"), F.explode(F.array_distinct(F.concat("env", "args"))).alias("t"))
    return nodes, env.select("from_node", F.concat(F.lit("env."), "t").alias("to_node"), F.lit("uses_env").alias("type")).distinct()


def workflow_graph(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Virtual nodes of workflows and jobs; edges to needed jobs, actions, secrets and variables."""
    flow, own = F.concat(F.lit("ci.github."), "workflow"), F.concat(F.lit("ci.github."), "workflow", F.lit("."), "job")
    nodes = jobs.select(flow.alias("id"), F.lit("module").alias("type"), F.col("workflow").alias("name"), F.col("path").alias("file_path")).distinct()
    nodes = nodes.unionByName(jobs.select(own.alias("id"), F.lit("block").alias("type"), F.col("job").alias("name"), F.col("path").alias("file_path")))

    def to(column: str, prefix: Column, kind: str) -> DataFrame:
        return jobs.select(own.alias("from_node"), flow.alias("_f"), F.explode(column).alias("t")).select("from_node", F.concat(prefix, F.col("t")).alias("to_node"), F.lit(kind).alias("type"))

    edges = to("needs", F.concat(F.col("_f"), F.lit(".")), "depends_on").unionByName(to("uses", F.lit("ci.action."), "depends_on"))
    return nodes, edges.unionByName(to("secrets", F.lit("env.secret."), "uses_env")).unionByName(to("env", F.lit("env.var."), "uses_env")).distinct()
