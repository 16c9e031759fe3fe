"""Keeping the relations up to date: differences, refreshes, upserts, logs. Each returns the new version of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import diff

# Edges that mappers made; they outlive a file's refresh.
MAPPER_TYPES = ("calls_api", "reads_table", "writes_table", "migrates", "depends_on", "uses_env", "handles_route", "exposes_port", "calls_native")


def upsert_runtime(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """edges (from_node, to_node, source, runtime_calls) after calls (from_node, to_node, n) were seen; ``change`` says what became of each.

    static becomes both and takes the count; runtime takes the new count; both stays; a pair without an edge gets a runtime
    edge. Of parallel edges the first by source takes it.
    """
    rank = F.row_number().over(Window.partitionBy("from_node", "to_node").orderBy("source", F.col("runtime_calls").asc_nulls_first()))
    a = edges.withColumn("_rank", rank)
    b = calls.groupBy("from_node", "to_node").agg(F.sum("n").alias("_n")).withColumn("_rank", F.lit(1))
    both = a.join(b, ["from_node", "to_node", "_rank"], "full")
    static, runtime, fresh = F.col("source") == "static", F.col("source") == "runtime", F.col("source").isNull()
    seen = F.col("_n").isNotNull()
    return both.select(
        "from_node", "to_node",
        F.when(fresh, "runtime").when(seen & static, "both").otherwise(F.col("source")).alias("source"),
        F.when(seen & (fresh | static | runtime), F.col("_n")).otherwise(F.col("runtime_calls")).alias("runtime_calls"),
        F.when(fresh, "new").when(seen & static, "upgraded").when(seen & runtime, "counted").otherwise("kept").alias("change"),
    )


def sync_nodes(old: DataFrame, new: DataFrame, kept: list[str], key: str = "id", state: str = "hash") -> DataFrame:
    """The new nodes with the columns ``kept`` (annotations) carried over from the old ones, and a status; deleted nodes last."""
    status = diff(old, new, key, state)
    carried = new.drop(*kept).join(old.select(key, *kept), key, "left").join(status, key)
    gone = status.filter("status = 'deleted'")
    return carried.unionByName(gone, allowMissingColumns=True)


def sync_edges(old: DataFrame, new: DataFrame, status: DataFrame, key: str = "id") -> DataFrame:
    """Old edges but those out of changed or deleted nodes (mappers' stay) and into deleted ones, and new edges of changed nodes."""
    changed = status.filter("status in ('modified', 'added')").select(F.col(key).alias("from_node"))
    gone = status.filter("status = 'deleted'").select(F.col(key))
    stale = changed.union(gone.select(F.col(key).alias("from_node"))).distinct()
    mapped = old.filter(F.col("type").isin(*MAPPER_TYPES)).join(gone.select(F.col(key).alias("from_node")), "from_node", "left_anti")
    kept = old.filter(~F.col("type").isin(*MAPPER_TYPES)).join(stale, "from_node", "left_anti").unionByName(mapped)
    kept = kept.join(gone.select(F.col(key).alias("to_node")), "to_node", "left_anti")
    return kept.unionByName(new.join(changed.distinct(), "from_node", "left_semi"))


def replace_static(old: DataFrame, new: DataFrame) -> DataFrame:
    """A full sync's edges: the new ones, and old ones seen at run time only."""
    return new.unionByName(old.filter("source = 'runtime'"), allowMissingColumns=True)


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order)))).filter("_rank = 1").drop("_rank")


def pending(listing: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(path, status) of files that are new, changed (time or size) or gone since the fingerprints were taken."""
    a = fingerprints.select("path", F.struct("mtime", "size").alias("_was"))
    b = listing.select("path", F.struct("mtime", "size").alias("_is"))
    status = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "gone").when(F.col("_was") != F.col("_is"), "changed")
    return a.join(b, "path", "full").select("path", status.alias("status")).filter("status is not null")


def tree_diff(listing: DataFrame, fingerprints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, status, deleted_nodes): files added, modified or deleted since the fingerprints, and how many nodes go with a deleted one."""
    named = F.when(F.col("status") == "new", "added").when(F.col("status") == "changed", "modified").otherwise("deleted")
    found = pending(listing, fingerprints).withColumn("status", named)
    held = nodes.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("_n"))
    lost = F.when(F.col("status") == "deleted", F.coalesce("_n", F.lit(0))).otherwise(0).cast("long")
    return found.join(held, "path", "left").select("path", "status", lost.alias("deleted_nodes"))


def save_metrics(stored: DataFrame, metrics: DataFrame) -> DataFrame:
    """Key-value rows (key, value) after the columns of ``metrics`` (one row) were put in."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in metrics.columns)))
    fresh = metrics.select(pairs.alias("p")).select("p.key", "p.value")
    return stored.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def history(changes: DataFrame, node: str | None = None, since: str | None = None, limit: int = 50) -> DataFrame:
    """The change log, latest first."""
    out = changes
    if node is not None:
        out = out.filter(F.col("node_id") == node)
    if since is not None:
        out = out.filter(F.col("timestamp") >= F.lit(since))
    return out.orderBy(F.desc("id")).limit(limit)


def timeline(logs: list[tuple[str, DataFrame]], time: str, limit: int) -> DataFrame:
    """Logs of several kinds in one, latest first, ties by kind and all else."""
    out = None
    for kind, df in logs:
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    rest = [F.col(c) for c in sorted(set(out.columns) - {time, "kind"})]
    return out.orderBy(F.desc(time), "kind", *rest).limit(limit)


def write_note(notes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Key-value notes after an upsert: the latest of each key."""
    both = notes.unionByName(fresh)
    return both.groupBy("key").agg(F.max_by("value", "updated_at").alias("value"), F.max("updated_at").alias("updated_at"))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both relations without some nodes and the edges at them."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "from_node"), "from_node", "left_anti").join(ids.withColumnRenamed("id", "to_node"), "to_node", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left


def update_source(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with new sources (id, source_code) and their hashes."""
    fresh = changes.select("id", F.col("source_code").alias("_new"))
    out = nodes.join(fresh, "id", "left")
    return out.withColumn("source_code", F.coalesce("_new", "source_code")).withColumn("hash", F.sha2("source_code", 256)).drop("_new")


def save_annotations(nodes: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Nodes with annotations from updates (id, columns); their hash is noted, so that a later change makes them stale."""
    fresh = updates.select("id", *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_set"))
    out = nodes.join(fresh, "id", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out.withColumn("annotation_hash", F.when(F.col("_set"), F.col("hash")).otherwise(F.col("annotation_hash"))).drop("_set")


def call_counts(calls: DataFrame, caller: str, callee: str) -> DataFrame:
    """(from_node, to_node, n) of traced calls; calls of itself and of unknown functions go."""
    own = calls.filter(F.col(caller).isNotNull() & F.col(callee).isNotNull() & (F.col(caller) != F.col(callee)))
    return own.groupBy(F.col(caller).alias("from_node"), F.col(callee).alias("to_node")).agg(F.count("*").alias("n"))


def debounce(events: DataFrame, keys: list[str], time: str, gap: str) -> DataFrame:
    """(keys, start, end, n): bursts of events without a pause as long as ``gap``; the same plan serves a stream."""
    w = F.session_window(F.col(time), gap)
    out = events.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def regressions(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Failures that the baseline lacks."""
    return current.exceptAll(baseline).distinct()


def islands(df: DataFrame, group: list[str], order: str, gap: int = 1) -> DataFrame:
    """(group, start, end, n): runs of values that follow each other within ``gap``."""
    w = Window.partitionBy(*group).orderBy(order)
    fresh = F.coalesce((F.col(order) - F.lag(order).over(w)) > gap, F.lit(True)).cast("int")
    numbered = df.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "_island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("_island")


def carry_forward(df: DataFrame, group: list[str], order: str, column: str, out: str) -> DataFrame:
    """The last value that isn't null, up to each row."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(w))
