"""Exact duplicates of an incoming batch against an immutable snapshot.

The snapshot's digests are split into shards, and each shard has a static binary-fuse filter (three 8-bit cells a key). A
batch's digests, grouped among themselves first, are screened by their shard's filter. Negatives are new for certain;
positives join the snapshot's exact digests. Rows that thus meet are held against each other byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import counted, discard, fresh_name, materialise, row_key, salted_join, utf8

#: The letters that are lower-cased, and no others.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SHARD_KEYS = 1 << 18  # digests a shard, on average
SALT_ROWS = 64  # members of a group that meet one copy of the text that stays

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


class FuseFilter:
    """Static binary-fuse filter over distinct 64-bit keys: never a false negative, about 1 in 256 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @staticmethod
    def _cells(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, seed)
        first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        one = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        two = (first + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([first, one, two], 1).astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 1)
        segment = 1 << max(2, min(18, int(np.log(n) / np.log(3.33) + 2.25)))
        slack = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) + 0.02
        segments = max(1, -(-int(n * slack) // segment) - 2) + 1
        for seed in range(1, 200):
            places, prints = cls._cells(keys, seed, segment, segments)
            size = (segments + 2) * segment
            left, rounds = np.arange(len(keys)), []
            while len(left):
                at = places[left]
                alone = np.bincount(at.ravel(), minlength=size)[at] == 1
                peel = alone.any(1)
                if not peel.any():
                    break
                rounds.append((left[peel], alone[peel].argmax(1)))
                left = left[~peel]
            if len(left):
                continue
            cells = np.zeros(size, np.uint8)
            for which, column in reversed(rounds):
                at = places[which]
                own = at[np.arange(len(which)), column]
                cells[own] = 0
                cells[own] = prints[which] ^ np.bitwise_xor.reduce(cells[at], axis=1)
            return cls(seed, segment, segments, cells)
        raise RuntimeError("no filter found")

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        places, prints = self._cells(keys.astype(np.uint64), self.seed, self.segment, self.segments)
        return np.bitwise_xor.reduce(self.cells[places], axis=1) == prints


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, sha, key): SHA-256 of each normalised text, and 64 of its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [hashlib.sha256(x.lower()).digest() for x in utf8(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), pa.array(found, pa.binary()), pa.array(np.frombuffer(b"".join(x[:8] for x in found), "<i8"))],
                ["doc_id", "row", "sha", "key"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, sha binary, key long")


def _grouped(digests: DataFrame) -> DataFrame:
    return digests.groupBy("sha", "key").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("size"))


def filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """(shard, seed, segment, segments, cells): a filter for each shard of the snapshot's grouped digests."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(pdf["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "cells": [f.cells.tobytes()]})

    return (
        snapshot.select(_shard(shards), "key").groupBy("shard").applyInPandas(run, "shard int, seed int, segment int, segments int, cells binary")
    )


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")


def screen(batch: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """The batch's grouped digests with ``maybe``: false if the snapshot certainly lacks them."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(right):
            r = right.iloc[0]
            f = FuseFilter(int(r["seed"]), int(r["segment"]), int(r["segments"]), np.frombuffer(r["cells"], np.uint8))
            left["maybe"] = f.may_hold(left["key"].to_numpy(np.int64).view(np.uint64))
        else:
            left["maybe"] = False
        return left[["sha", "key", "keep_id", "size", "maybe"]]

    return (
        batch.withColumn("shard", _shard(shards)).groupBy("shard").cogroup(index.groupBy("shard"))
        .applyInPandas(run, "sha binary, key long, keep_id long, size long, maybe boolean")
    )


def merge_groups(snapshot: DataFrame, batch: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(sha, keep_id, size) over snapshot and batch."""
    screened = materialise(screen(batch, index, shards), "screened")
    positive, negative = screened.filter("maybe"), screened.filter("not maybe")
    theirs = positive.select("sha", F.col("keep_id").alias("new_id"), F.col("size").alias("more"))
    old = snapshot.join(theirs, "sha", "left").select(
        "sha", F.greatest("keep_id", "new_id").alias("keep_id"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")
    )
    columns = ["sha", "keep_id", "size"]
    return old.unionByName(positive.join(snapshot, "sha", "left_anti").select(columns)).unionByName(negative.select(columns))


def check_bytes(docs: DataFrame, digests: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> None:
    """Holds every member of a group of two or more against the text that stays, byte by byte; raises if one differs."""
    shared = groups.filter("size > 1")
    salts = F.ceil(F.col("size") / SALT_ROWS).cast("int")
    members = salted_join(digests, shared, "sha").select(
        F.col("doc_id").alias("own_id"), F.col("row").alias("own_row"), "sha", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays"), F.pmod(F.xxhash64("doc_id", "row", F.lit(7)), salts).cast("int").alias("salt"), salts.alias("salts")
    ).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("row"), ascii_lower(F.col(text_col)).alias("norm"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_row") == F.col("row"))
    named = materialise(members.join(texts, same).select("sha", "salt", "salts", "stays", "norm"), "texts")
    one = named.filter("stays").dropDuplicates(["sha"]).select("sha", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("norm").alias("kept"))
    differ = named.filter("not stays").join(one, ["sha", "salt"]).filter("norm != kept").count()
    if differ:
        raise RuntimeError(f"{differ} rows have the digest of another text")


def exact_groups(
    docs: DataFrame, incoming: Column | None = None, id_col: str = "doc_id", text_col: str = "text", verify: bool = True
) -> DataFrame:
    """(doc_id, row, keep_id, group_size, kept, sha) for every row of ``docs``.

    incoming: condition on doc_id that tells the batch's rows from the snapshot's; without one, the ids' hashes halve the
    rows. Texts are equal when their bytes are after lower-casing A-Z; null counts as empty. Of equal texts the largest
    doc_id stays (null below all others; all rows of that id and text count as kept). An empty table gives no rows.
    """
    if incoming is None:
        incoming = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    table = materialise(digest(docs, id_col, text_col).withColumn("incoming", F.coalesce(incoming, F.lit(False))), "digests")
    snapshot, kept = counted(_grouped(table.filter("not incoming")), "snapshot")
    batch, more = counted(_grouped(table.filter("incoming")), "batch")
    shards = max(1, -(-max(kept, more) // SHARD_KEYS))  # neither side of a shard outgrows a task
    index = materialise(filters(snapshot, shards), "filters")
    groups = materialise(merge_groups(snapshot, batch, index, shards), "groups")
    if verify:
        check_bytes(docs, table, groups, id_col, text_col)
    discard(snapshot, batch, index)
    return salted_join(table, groups, "sha").select(
        "doc_id", "row", "keep_id", F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha"
    )


@dataclass(frozen=True)
class Index:
    """A snapshot's grouped digests and their filters, by ``shards``."""

    snapshot: DataFrame
    filters: DataFrame
    shards: int


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Digests and filters of an immutable snapshot, written under ``path`` in a store that all executors share."""
    _grouped(digest(docs, id_col, text_col)).write.parquet(f"{path}/digests")
    snapshot = docs.sparkSession.read.parquet(f"{path}/digests")
    shards = max(1, -(-snapshot.count() // SHARD_KEYS))
    filters(snapshot, shards).withColumn("shards", F.lit(shards)).write.parquet(f"{path}/filters")
    return open_index(docs.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """What ``write_index`` wrote; an empty snapshot has one shard."""
    index = spark.read.parquet(f"{path}/filters")
    shards = index.agg(F.max("shards")).first()[0] or 1
    return Index(spark.read.parquet(f"{path}/digests"), index.drop("shards"), shards)


def against(batch: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, known, keep_id, group_size, sha) for every row of an incoming batch: known if the snapshot has its text, keep_id
    and group_size over both. Only digests that a filter lets through meet the snapshot. A shard of the batch is one task's, so
    that a batch should not be very much larger than the snapshot."""
    table = materialise(digest(batch, id_col, text_col), "digests")
    screened = materialise(screen(_grouped(table), index.filters, index.shards), "screened")
    old = index.snapshot.select("sha", F.col("keep_id").alias("_keep"), F.col("size").alias("_size"))
    there = screened.filter("maybe").join(old, "sha", "left")
    known = there.select("sha", F.col("_size").isNotNull().alias("known"), F.greatest("keep_id", "_keep").alias("keep_id"), (F.col("size") + F.coalesce("_size", F.lit(0))).alias("group_size"))
    new = screened.filter("not maybe").select("sha", F.lit(False).alias("known"), "keep_id", F.col("size").alias("group_size"))
    groups = materialise(known.unionByName(new), "groups")
    return salted_join(table, groups, "sha").select("doc_id", "row", "known", "keep_id", "group_size", "sha")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text (A-Z lower-cased), with the columns they came with.

    Of equal texts the row with the largest doc_id stays (a null one only if all are null); if that doc_id has the text in
    several spellings, the one with the smallest hash; of rows alike in both, any one. Null counts as empty; an empty table
    stays empty.
    """
    kept = exact_groups(docs, id_col=id_col, text_col=text_col).filter("kept")
    kept = kept.groupBy("sha").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.doc_id", "first.row")
    mine, row = fresh_name(docs, "_id"), fresh_name(docs, "_row")
    rows = docs.withColumn(mine, F.col(id_col).cast("long")).withColumn(row, row_key(F.col(text_col)))
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("row").alias("_kept_row"))
    joined = rows.join(kept, rows[mine].eqNullSafe(kept["_kept_id"]) & (rows[row] == kept["_kept_row"]), "left_semi")
    return joined.dropDuplicates([mine, row]).drop(mine, row)
