"""Outputs of other tools as DataFrames: coverage, traces, scanners, version control, project settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import COVERAGE, RULES, TRACE


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, line) of executed lines."""
    raw = spark.read.schema(COVERAGE).option("multiLine", "true").json(path)
    return raw.select(F.explode("files").alias("file_path", "f")).select("file_path", F.explode("f.executed_lines").alias("line"))


def traces(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """(from_node, to_node, n) of traced calls; by_line: a document stands on each line, as ``write_trace`` makes them."""
    raw = spark.read.schema(TRACE).option("multiLine", not by_line).json(path)
    return raw.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("from_node"), F.col("e.to").alias("to_node"), F.col("e.count").alias("n"))


def security_findings(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, line, severity, confidence, rule, message) of a security scanner's report."""
    schema = "results array<struct<filename:string,line_number:int,issue_severity:string,issue_confidence:string,test_id:string,issue_text:string>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("results").alias("r"))
    return raw.select(F.col("r.filename").alias("file_path"), F.col("r.line_number").alias("line"), F.col("r.issue_severity").alias("severity"), F.col("r.issue_confidence").alias("confidence"), F.col("r.test_id").alias("rule"), F.col("r.issue_text").alias("message"))


def python_audit(spark: SparkSession, path: str) -> DataFrame:
    """(package, version, id, fixed) of vulnerable Python packages."""
    schema = "dependencies array<struct<name:string,version:string,vulns:array<struct<id:string,fix_versions:array<string>>>>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("dependencies").alias("d"))
    out = raw.select(F.col("d.name").alias("package"), F.col("d.version").alias("version"), F.explode("d.vulns").alias("v"))
    return out.select("package", "version", F.col("v.id").alias("id"), F.array_join("v.fix_versions", ",").alias("fixed"))


def node_audit(spark: SparkSession, path: str) -> DataFrame:
    """(package, severity, range) of vulnerable Node packages."""
    raw = spark.read.schema("vulnerabilities map<string,struct<severity:string,`range`:string>>").option("multiLine", "true").json(path)
    return raw.select(F.explode("vulnerabilities").alias("package", "v")).select("package", "v.severity", "v.range")


def arch_rules(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    return spark.read.schema(RULES).option("multiLine", not by_line).json(path)


def fingerprints(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """(path, mtime, size) of the files as of the last sync; by_line: as ``write_fingerprints`` makes them."""
    raw = spark.read.schema("fingerprints map<string,struct<mtime:double,size:bigint>>").option("multiLine", not by_line).json(path)
    return raw.select(F.explode("fingerprints").alias("path", "f")).select("path", "f.mtime", "f.size")


def lines(df: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """(key, at, line) of texts."""
    return df.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("at", "line"))


def blame(text: DataFrame) -> DataFrame:
    """(file, line, commit, author, time, content) of porcelain blame output (file, text).

    A header line opens each content line; author and time stand at a commit's first header only and are carried to its others.
    """
    rows = lines(text)
    header = r"^([0-9a-f]{40}) \d+ (\d+)"
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.when(F.col("line").rlike(header), F.regexp_extract("line", header, 1))).withColumn("_n", F.when(F.col("line").rlike(header), F.regexp_extract("line", header, 2).cast("int")))
    rows = rows.withColumn("commit", F.last("_c", True).over(w)).withColumn("number", F.last("_n", True).over(w))
    about = rows.groupBy("file", "commit").agg(
        F.max(F.when(F.startswith("line", F.lit("author ")), F.expr("substring(line, 8)"))).alias("author"),
        F.max(F.when(F.startswith("line", F.lit("author-time ")), F.substring("line", 13, 20).cast("long"))).alias("time"),
    )
    content = rows.filter(F.startswith("line", F.lit("\t"))).select("file", F.col("number").alias("line"), "commit", F.expr("substring(line, 2)").alias("content"))
    return content.join(about, ["file", "commit"]).select("file", "line", "commit", "author", F.timestamp_seconds("time").alias("time"), "content")


def log(text: DataFrame, separator: str = "|") -> DataFrame:
    """(commit, author, date, subject, path) of ``%H|%an|%ad|%s`` headers, each followed by the names of its files."""
    rows = lines(text).filter("trim(line) != ''")
    header = r"^([0-9a-f]{7,40})\|([^|]*)\|([^|]*)\|(.*)$".replace(r"\|", "[" + separator + "]")
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_h", F.when(F.col("line").rlike(header), F.col("line"))).withColumn("head", F.last("_h", True).over(w))
    part = lambda g: F.regexp_extract("head", header, g)
    every = rows.select(part(1).alias("commit"), part(2).alias("author"), part(3).alias("date"), part(4).alias("subject"), F.when(F.col("_h").isNull(), F.col("line")).alias("path"), "head")
    named = every.filter("path is not null")
    bare = every.filter("path is null").join(named.select("head").distinct(), "head", "left_anti")
    return named.unionByName(bare.select(*named.columns)).drop("head")


def changed_ranges(text: DataFrame) -> DataFrame:
    """(file, path, start, end) of the new side's hunks of a diff without context."""
    rows = lines(text)
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("path", F.last(F.when(F.startswith("line", F.lit("+++ ")), F.regexp_replace("line", r"^\+\+\+ (b/)?", "")), True).over(w))
    hunk = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"
    hunks = rows.filter(F.col("line").rlike(hunk)).select("file", "path", F.regexp_extract("line", hunk, 1).cast("int").alias("start"), F.regexp_extract("line", hunk, 2).alias("n"))
    n = F.when(F.col("n") == "", 1).otherwise(F.expr("try_cast(n as int)"))
    return hunks.withColumn("n", n).select("file", "path", "start", (F.col("start") + F.greatest(F.col("n"), F.lit(1)) - 1).alias("end"))
