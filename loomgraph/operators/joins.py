"""Joins beyond plain equality: intervals, prefixes, suffixes, routes, as-of, differences.

Interval joins without an equality go over bins (``bin_width``), prefix joins over exploded ancestors: both become
equi-joins that shuffle by key and never nested loops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors_of, suffixes_of
from ..plans.tables import materialise


BIN = 64  # width of the bins that intervals and points meet in


def _around(points: DataFrame, spans: DataFrame, on: list[str], point: str, start: str, end: str, bin_width: int) -> DataFrame:
    """Points with all spans (closed, whole numbers) around them: besides ``on`` they share a bin, of which a span has one for
    each ``bin_width`` of its length."""
    floor = lambda c: F.floor(F.col(c) / bin_width)
    a = points.withColumn("_bin", floor(point))
    b = spans.filter(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(floor(start), floor(end))))
    return a.join(b, [*on, "_bin"]).filter((F.col(start) <= F.col(point)) & (F.col(point) <= F.col(end))).drop("_bin")


def containing(points: DataFrame, spans: DataFrame, on: list[str], point: str, start: str, end: str, key: list[str], order: list[str], bin_width: int = BIN) -> DataFrame:
    """For each point the smallest span around it (closed), ties by ``order``; points without a span go.

    key: columns that name a point; equality columns ``on`` are shared. Points and ends are whole numbers.
    """
    both = _around(points, spans, on, point, start, end, bin_width)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(end) - F.col(start), *order))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def overlapping(left: DataFrame, right: DataFrame, l_start: str, l_end: str, r_start: str, r_end: str, bin_width: int, on: list[str] | None = None) -> DataFrame:
    """All pairs of overlapping closed integer intervals, each once.

    Both sides are cut into bins; a pair is taken in the first bin that they share. bin_width: about the length of the longer
    side's intervals, so that few rows are copied.
    """
    floor = lambda c: F.floor(F.col(c) / bin_width)
    a = left.withColumn("_bin", F.explode(F.sequence(floor(l_start), floor(l_end))))
    b = right.withColumn("_bin", F.explode(F.sequence(floor(r_start), floor(r_end))))
    both = a.join(b, [*(on or []), "_bin"])
    first = F.greatest(floor(l_start), floor(r_start)) == F.col("_bin")
    return both.filter(first & (F.col(l_start) <= F.col(r_end)) & (F.col(r_start) <= F.col(l_end))).drop("_bin")


def covered_counts(points: DataFrame, spans: DataFrame, on: list[str], point: str, start: str, end: str, key: str, bin_width: int = BIN) -> DataFrame:
    """(key, covered): how many distinct points each span holds; 0 for none."""
    both = _around(points.select(*on, point).distinct(), spans, on, point, start, end, bin_width)
    hits = both.groupBy(key).agg(F.count("*").alias("covered"))
    return spans.select(key).join(hits, key, "left").select(key, F.coalesce("covered", F.lit(0)).alias("covered"))


def enrich(edges: DataFrame, nodes: DataFrame, columns: list[str], how: str = "left") -> DataFrame:
    """Edges with the columns of both ends, as from_<column> and to_<column>."""
    out = edges
    for side in ("from", "to"):
        own = nodes.select(F.col("id").alias(f"{side}_node"), *(F.col(c).alias(f"{side}_{c}") for c in columns))
        out = out.join(own, f"{side}_node", how)
    return out


def route_matches(calls: DataFrame, routes: DataFrame, call_path: str, route_path: str, call_method: str, route_method: str) -> DataFrame:
    """Calls with the routes that they fit: as many segments, each equal or a ``:param`` on either side; methods equal or ANY.

    Which segments are parameters is a path's mask; there are few masks for a length. Every path meets the other side's masks of
    its length, and the segments that are parameters in neither are the key: a join of equality alone.
    """
    free = lambda c: F.transform(c, lambda x: (x == ":param").cast("int"))
    a = calls.withColumn("_cs", F.split(call_path, "/")).withColumn("_cm", F.array_join(free(F.col("_cs")), ""))
    b = routes.withColumn("_rs", F.split(route_path, "/")).withColumn("_rm", F.array_join(free(F.col("_rs")), ""))
    a = a.withColumn("_n", F.size("_cs"))
    b = b.withColumn("_n", F.size("_rs"))
    masks_a, masks_b = a.select("_n", "_cm").distinct(), b.select("_n", "_rm").distinct()
    shared = lambda parts: F.transform(parts, lambda x, i: F.when((F.substring("_cm", i + 1, F.lit(1)) == "1") | (F.substring("_rm", i + 1, F.lit(1)) == "1"), F.lit(":param")).otherwise(x))
    a = a.join(masks_b, "_n").withColumn("_key", F.array_join(shared(F.col("_cs")), "/"))
    b = b.join(masks_a, "_n").withColumn("_key", F.array_join(shared(F.col("_rs")), "/"))
    same = (F.col(call_method) == F.col(route_method)) | (F.col(call_method) == "ANY") | (F.col(route_method) == "ANY")
    return a.join(b, ["_n", "_cm", "_rm", "_key"]).filter(same).drop("_cs", "_cm", "_rs", "_rm", "_n", "_key")


def unique_suffixes(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """(suffix, full): dotted suffixes that belong to one identifier alone."""
    every = ids.select(F.col(id_col).alias("full"), F.explode(suffixes_of(F.col(id_col))).alias("suffix"))
    return every.groupBy("suffix").agg(F.countDistinct("full").alias("n"), F.min("full").alias("full")).filter("n = 1").select("suffix", "full")


def normalise_ends(edges: DataFrame, ids: DataFrame, ends: tuple[str, ...] = ("from_node", "to_node"), id_col: str = "id") -> DataFrame:
    """Edge ends that aren't identifiers are replaced where they are the suffix of one identifier alone."""
    index = unique_suffixes(ids, id_col)
    known = ids.select(F.col(id_col).alias("_known")).distinct()
    out = edges
    for end in ends:
        out = out.join(known, F.col(end) == F.col("_known"), "left").join(index, F.col(end) == F.col("suffix"), "left")
        out = out.withColumn(end, F.when(F.col("_known").isNotNull(), F.col(end)).otherwise(F.coalesce("full", end))).drop("_known", "suffix", "full")
    return out


def descendants(groups: DataFrame, members: DataFrame, group_id: str = "id", member_id: str = "id") -> DataFrame:
    """(ancestor, descendant) of dotted identifiers, at any depth."""
    a = groups.select(F.col(group_id).alias("ancestor"))
    b = members.select(F.col(member_id).alias("descendant"), F.explode(ancestors_of(F.col(member_id))).alias("ancestor")).filter("ancestor != descendant")
    return a.join(b, "ancestor")


def next_after(left: DataFrame, right: DataFrame, on: list[str], at: str, right_at: str, take: list[str], strict: bool = True) -> DataFrame:
    """As-of, forward: each left row with the first right row after it (or at it), by one sort of both together."""
    return _as_of(left, right, on, at, right_at, take, True, strict)


def last_before(left: DataFrame, right: DataFrame, on: list[str], at: str, right_at: str, take: list[str], strict: bool = True) -> DataFrame:
    """As-of, backward: each left row with the last right row before it (or at it)."""
    return _as_of(left, right, on, at, right_at, take, False, strict)


def _as_of(left, right, on, at, right_at, take, forward, strict):
    """Both sides in one sort, the nearest right row so far at each place: one pass over a key's rows, forwards or backwards."""
    a = left.withColumn("_side", F.lit(0)).withColumn("_at", F.col(at)).withColumn("_take", F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType))
    b = right.select(*on, F.lit(1).alias("_side"), F.col(right_at).alias("_at"), F.struct(*take).alias("_take"))
    both = a.unionByName(b, allowMissingColumns=True)
    # what may match at the same time stands before the left row in the order of the pass, what may not behind it
    tie = F.col("_side").asc() if strict else F.col("_side").desc()
    json = F.to_json("_take")
    order = [F.col("_at").desc(), tie, json.desc()] if forward else [F.col("_at").asc(), tie, json.asc()]
    w = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("_found", F.last("_take", ignorenulls=True).over(w)).filter("_side = 0")
    return out.select(*left.columns, *(F.col("_found")[c].alias(c) for c in take))


def latest_start(points: DataFrame, spans: DataFrame, on: list[str], point: str, start: str, end: str, key: list[str], take: str, bin_width: int = BIN) -> DataFrame:
    """For each point the containing span that starts last."""
    both = _around(points, spans, on, point, start, end, bin_width)
    return both.groupBy(*key).agg(F.max_by(take, F.struct(F.col(start), F.col(take))).alias(take))


def without(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def having(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    return left.join(right, on, "left_semi")


def public_members(edges: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """(group, id): nodes that edges from another group lead to."""
    target = nodes.select(F.col("id").alias("to_node"), F.col(group).alias("_to"))
    origin = nodes.select(F.col("id").alias("from_node"), F.col(group).alias("_from"))
    crossing = edges.select("from_node", "to_node").join(target, "to_node").join(origin, "from_node", "left").filter(~F.col("_from").eqNullSafe(F.col("_to")))
    return crossing.select(F.col("_to").alias(group), F.col("to_node").alias("id")).distinct()


def lookup(left: DataFrame, right: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """Left join of one value, with a default for what isn't found."""
    own = right.select(F.col(key), F.col(value).alias("_value"))
    return left.join(own, key, "left").withColumn(value, F.coalesce("_value", default)).drop("_value")


def tiers(left: DataFrame, right: DataFrame, keys: list[str], right_key: str, value: str) -> DataFrame:
    """Lookup in tiers: the first of the left keys that the right side knows gives the value."""
    out = left
    for i, k in enumerate(keys):
        out = out.join(right.select(F.col(right_key).alias(k), F.col(value).alias(f"_v{i}")), k, "left")
    return out.withColumn(value, F.coalesce(*(F.col(f"_v{i}") for i in range(len(keys))))).drop(*(f"_v{i}" for i in range(len(keys))))


def diff(old: DataFrame, new: DataFrame, key: str, state: str) -> DataFrame:
    """(key, status): added, deleted, modified or unchanged, by one full outer join."""
    a = old.select(F.col(key), F.col(state).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(F.col(key), F.col(state).alias("_new"), F.lit(True).alias("_in_new"))
    status = (
        F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified").otherwise("unchanged")
    )
    return a.join(b, key, "full").select(key, status.alias("status"))


def prefixed_routes(routes: DataFrame, includes: DataFrame, imports: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Routes (file, path) under the prefixes of the routers that include them, at any depth.

    includes (file, router, prefix): a file mounts a router's name; imports (file, name, module_file): where the name comes
    from. A mount's own file counts where the name isn't imported. own (file, prefix): the prefix that a file's router is made
    with; it stands between the mount's and the route's. A router that is mounted twice has its routes twice. Mounts in a ring
    are followed until a file comes back.
    """
    mounts = includes.join(imports.select("file", F.col("name").alias("router"), "module_file"), ["file", "router"], "left")
    mounts = mounts.select(F.col("file").alias("parent"), F.coalesce("module_file", "file").alias("file"), F.coalesce("prefix", F.lit("")).alias("mount"))
    if own is not None:
        within = own.groupBy("file").agg(F.first("prefix").alias("_own"))
        mounts = mounts.join(within, "file", "left").withColumn("mount", F.concat("mount", F.coalesce("_own", F.lit("")))).drop("_own")
    mounts = materialise(mounts.distinct(), "mounts")
    inner = mounts.filter("parent != file").select("file").distinct()
    roots = mounts.select(F.col("parent").alias("file")).distinct().join(inner, "file", "left_anti")
    base = routes.select("file").unionByName(roots).distinct().join(inner, "file", "left_anti")
    if own is not None:
        base = base.join(within, "file", "left").select("file", F.coalesce("_own", F.lit("")).alias("prefix"))
    else:
        base = base.select("file", F.lit("").alias("prefix"))
    local = base.alias("b").join(mounts.filter("parent = file").select("file", "mount"), "file", "left").select("file", F.coalesce("mount", "prefix").alias("prefix"))
    level, found = base.withColumn("way", F.array("file")), [local]
    while True:
        step = level.select(F.col("file").alias("parent"), "prefix", "way").join(mounts.filter("parent != file"), "parent").filter(~F.array_contains("way", F.col("file")))
        level = materialise(step.select("file", F.concat("prefix", "mount").alias("prefix"), F.concat("way", F.array("file")).alias("way")).distinct(), "level")
        if level.isEmpty():
            break
        found.append(level.select("file", "prefix"))
    every = reduce(DataFrame.unionByName, found).distinct()
    return routes.join(every, "file", "left").withColumn("path", F.concat(F.coalesce("prefix", F.lit("")), F.col("path"))).drop("prefix")
