"""File trees as DataFrames, and sinks for the relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no sources of the project, suffixes of virtual environments, and extensions that are read.
SKIPPED = (
    ".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", "venv", "env", ".env", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", ".eggs", "site-packages", ".next", ".nuxt", "coverage", ".idea", ".vscode", "target", "vendor",
)
ENVIRONMENT_SUFFIXES = ("-env", "_env", "-venv", "_venv")
TRACE_ROWS = 10_000  # edges of one document
EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx")


def wanted(path: Column, extensions: tuple[str, ...] | None = EXTENSIONS) -> Column:
    """True for files (paths relative to the root) outside skipped folders; ``lib`` is skipped at the top only."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    skipped = F.exists(folders, lambda p: p.isin(*SKIPPED) | p.endswith(ENVIRONMENT_SUFFIXES[0]) | p.endswith(ENVIRONMENT_SUFFIXES[1]) | p.endswith(ENVIRONMENT_SUFFIXES[2]) | p.endswith(ENVIRONMENT_SUFFIXES[3]))
    top = F.get(folders, F.lit(0)).eqNullSafe(F.lit("lib"))
    out = ~skipped & ~top
    if extensions:
        known = F.lit(False)
        for e in extensions:
            known = known | F.endswith(path, F.lit(e))
        out = out & known
    return out


def hidden(spark: SparkSession, root: str) -> list[tuple[str, float, int, bytearray]]:
    """(path, mtime, size, content) of files that Spark's file index passes over: those with a name, or below a folder, that
    begins with a dot or an underscore (package and workflow files). Skipped folders aren't entered."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, todo = [], [(top, "", False)]
    while todo:
        folder, prefix, unseen = todo.pop()
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            mine = unseen or name.startswith((".", "_"))
            if status.isDirectory():
                if name not in SKIPPED and not name.endswith(ENVIRONMENT_SUFFIXES):
                    todo.append((status.getPath(), f"{prefix}{name}/", mine))
            elif mine:
                stream = fs.open(status.getPath())
                try:
                    content = bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
                finally:
                    stream.close()
                out.append((prefix + name, float(status.getModificationTime()) * 1000, int(status.getLen()), content))
    return out


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = EXTENSIONS, text: bool = True, only: DataFrame | None = None) -> DataFrame:
    """(path, mtime, size, text) of a project's files, paths relative to the root. Without ``text`` contents aren't read; ``only``:
    the files (path) that are wanted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + _quoted(base) + "/", "")
    files = files.select(relative.alias("path"), F.unix_micros("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"), "content")
    more = spark.createDataFrame(hidden(spark, root), "path string, mtime double, size long, content binary")
    every = files.unionByName(more).filter(wanted(F.col("path"), extensions))
    if only is not None:
        every = every.join(only.select("path").distinct(), "path", "left_semi")
    return every.select("path", "mtime", "size", F.decode("content", "UTF-8").alias("text")) if text else every.drop("content")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def packages(files: DataFrame, json: str = "text") -> DataFrame:
    """(path, depth, name, has_modules) of package.json files, the shallowest first; has_modules: a node_modules folder lies beside it."""
    own = files.filter(F.element_at(F.split("path", "/"), -1) == "package.json")
    folder = F.regexp_replace("path", r"/?package\.json$", "")
    out = own.select("path", folder.alias("folder"), (F.size(F.split("path", "/")) - 1).alias("depth"), F.get_json_object(json, "$.name").alias("name"))
    modules = files.filter(F.contains("path", F.lit("node_modules/"))).select(F.regexp_replace("path", r"/?node_modules/.*$", "").alias("folder")).distinct().withColumn("_m", F.lit(True))
    return out.join(modules, "folder", "left").select("path", "depth", "name", F.coalesce("_m", F.lit(False)).alias("has_modules")).orderBy("depth", "path")


def module_id(path: Column) -> Column:
    """Dotted identifier of a file: no extension, slashes to dots, the package file stands for its folder."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z]+$", ""), "/", ".")
    return F.regexp_replace(plain, r"\.(__init__|index)$", "")


def write_relation(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def publish(df: DataFrame, root: str, version: str) -> str:
    """Writes a new version beside the old ones; a reader that is given the returned path sees it whole or not at all."""
    path = f"{root.rstrip('/')}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_rules(rules: DataFrame, path: str) -> None:
    """Architecture rules as JSON, one to a line."""
    rules.write.mode("overwrite").json(path)


def write_fingerprints(listing: DataFrame, path: str) -> None:
    """(path, mtime, size) of files as JSON, one to a line; ``feeds.fingerprints`` reads it by line."""
    listing.select(F.create_map("path", F.struct("mtime", "size")).alias("fingerprints")).write.mode("overwrite").json(path)


def write_trace(calls: DataFrame, path: str) -> None:
    """Counted calls as JSON documents {edges, total_calls, unique_edges} of ``TRACE_ROWS`` edges at most, so that no task holds the whole
    trace; ``feeds.traces`` reads them by line."""
    edges = F.collect_list(F.struct(F.col("from_node").alias("from"), F.col("to_node").alias("to"), F.col("n").alias("count")))
    calls.groupBy(F.spark_partition_id().alias("_p"), F.floor(F.monotonically_increasing_id() % (1 << 33) / TRACE_ROWS).alias("_b")).agg(edges.alias("edges"), F.sum("n").alias("total_calls"), F.count("*").alias("unique_edges")).drop("_p", "_b").write.mode("overwrite").json(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
