"""Projections, filters and search over nodes and edges."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, matches_glob, parent_of


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def get_nodes(nodes: DataFrame, kind: str | None = None, file_prefix: str | None = None, name_part: str | None = None) -> DataFrame:
    """Conjunction of what is given; text tests ignore case; by file and line."""
    out = nodes
    if kind:
        out = out.filter(F.col("type") == kind)
    if file_prefix:
        out = out.filter(F.col("file_path").ilike(file_prefix + "%"))
    if name_part:
        out = out.filter(F.col("name").ilike(f"%{name_part}%"))
    return out.orderBy("file_path", "start_line", "id")


def get_edges(edges: DataFrame, node_id: str, direction: str = "both") -> DataFrame:
    tests = {"outgoing": [F.col("from_node") == node_id], "incoming": [F.col("to_node") == node_id]}
    tests["both"] = tests["outgoing"] + tests["incoming"]
    return edges.filter(reduce(lambda a, b: a | b, tests[direction]))


def get_edges_by_types(edges: DataFrame, kinds: list[str]) -> DataFrame:
    return edges.filter(F.col("type").isin(kinds) if kinds else F.lit(False)).orderBy("from_node", "seq")


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows where one of the columns holds the query, whatever the case; ``%`` and ``_`` are wildcards."""
    return df.filter(reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{query}%") for c in columns)))


def resolve_id(nodes: DataFrame, query: str, k: int = 5) -> DataFrame:
    """(id, tier): exact, then dotted suffix, then part of the id, then part of the name; the first tier that has any,
    shortest ids first, at most k."""
    plain = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    tier = (
        F.when(F.col("id") == query, 0).when(F.col("id").ilike(f"%.{plain}"), 1).when(F.col("id").ilike(f"%{plain}%"), 2).when(F.col("name").ilike(f"%{plain}%"), 3)
    )
    found = nodes.select("id", tier.alias("tier")).filter("tier is not null")
    best = found.agg(F.min("tier").alias("best"))
    return found.join(F.broadcast(best), F.col("tier") == F.col("best")).select("id", "tier").orderBy(F.length("id"), "id").limit(k)


def all_ids(nodes: DataFrame) -> DataFrame:
    return nodes.select("id")


def usable(pattern: str) -> str:
    """The pattern, or its literal text where it is no regular expression."""
    try:
        re.compile(pattern)
    except re.error:
        return re.escape(pattern)
    return pattern


def grep(files: DataFrame, pattern: str, glob: str | None = None, limit: int = 50, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, content) of lines that match, in path and line order, the first ``limit``. A bad pattern is taken literally."""
    pattern = usable(pattern)
    rows = files if glob is None else files.filter(matches_glob(F.col(path), glob) | matches_glob(F.element_at(F.split(path, "/"), -1), glob))
    lines = rows.select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n")).alias("line", "content"))
    return lines.filter(F.col("content").rlike(pattern)).select("path", (F.col("line") + 1).alias("line"), "content").orderBy("path", "line").limit(limit)


def rule_test(field: str, how: str, values: tuple[str, ...], kinds: tuple[str, ...] | None = None) -> Column:
    """One rule over a node's field: exact, prefix, suffix or contains, any of the values, for some types only."""
    test = any_of(F.col(field), values, how)
    return test & F.col("type").isin(list(kinds)) if kinds else test


def needs_annotation(nodes: DataFrame, stale_only: bool = False, unannotated_only: bool = False, limit: int | None = None) -> DataFrame:
    """Functions, methods and classes to annotate; stale (the hash has changed since) beats unannotated."""
    annotated = F.col("summary").isNotNull() | F.col("role").isNotNull()
    stale = annotated & (F.coalesce("annotation_hash", F.lit("")) != "") & (F.col("annotation_hash") != F.col("hash"))
    out = nodes.filter(F.col("type").isin("function", "method", "class"))
    if stale_only:
        out = out.filter(stale)
    elif unannotated_only:
        out = out.filter(~annotated)
    out = out.withColumn("annotated", annotated).withColumn("stale", stale).orderBy("id")
    return out.limit(limit) if limit is not None else out


def children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Functions, methods and classes whose identifier is one part longer than a parent's: an equi-join on the parent's name."""
    own = nodes.filter(F.col("type").isin("function", "method", "class")).withColumn("parent", parent_of(F.col("id"))).filter("parent != id")
    return own.join(parents.select(F.col("id").alias("parent")), "parent", "left_semi").orderBy("parent", "start_line", "id")


def hide_large_sources(nodes: DataFrame, most: int = 10_000) -> DataFrame:
    large = F.col("type").isin("class", "module") & (F.length("source_code") > most)
    return nodes.withColumn("source_code", F.when(~F.coalesce(large, F.lit(False)), F.col("source_code")))


def per_group_limit(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    return df.offset(offset).limit(limit)


def resolve_status(nodes: DataFrame, query: str, k: int = 5) -> DataFrame:
    """(status, candidates): hit with one identifier, ambiguous with several, or not_found."""
    found = resolve_id(nodes, query, k).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    status = F.when(F.size("ids") == 0, "not_found").when(F.size("ids") == 1, "hit").otherwise("ambiguous")
    return found.select(status.alias("status"), F.array_join("ids", ",").alias("candidates"))


def is_external(name: Column, builtins: list[str], modules: list[str]) -> Column:
    """True for names of the language: a builtin, or anything below a module of its library."""
    return name.isin(builtins) | F.split(name, r"\.")[0].isin(modules)
