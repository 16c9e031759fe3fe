"""SimHash near-duplicates by generalised pigeonhole, and connected components of the links.

Fingerprint bits are grouped into partitions, correlated bits together. Two fingerprints within ``radius`` bits agree up
to t_i bits in some partition i, if the sum of (t_i + 1) exceeds the radius; the t_i, unequal, come from a dynamic
programme on estimated candidate counts. A fingerprint goes to the buckets that its partitions name (one for t = 0, one
for each bit left out for t = 1, the ball of half the threshold for t = 2 and 4). A bucket links its members by a spanning
forest, never by all pairs. A bucket with very many members is dealt out again by the same principle over the bits that its
members needn't share, until no bucket is that large or no bits are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, counted, discard, fresh_name, materialise, popcount, row_key, salted_join, shuffle_width, utf8

SEED = 42
#: Relative costs of a bucket row and of a candidate pair, measured.
ROW_COST, PAIR_COST = 2.0, 0.05
HOT = 4096  # members of a bucket from which it is split
SMALL = 8  # members of a bucket up to which pairs are compared side by side with other buckets'


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``size`` words, A-Z lower-cased; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends[size - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` times 64 bits, each set if it is in over half the hashes; words beyond the first see the hashes mixed anew."""
    out = np.zeros(words, np.uint64)
    n = len(hashes)
    if n:
        for k in range(words):
            h = hashes if k == 0 else _mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
            out[k] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text", empty: bool = True) -> DataFrame:
    """(doc_id, row, print array<long>) of every whole text; no words: zero, or without ``empty`` no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 4 << 20):
            hashes = [shingle_hashes(t, shingle) for t in utf8(part.column("text"))]
            if not empty:
                part = part.filter(pa.array([len(h) > 0 for h in hashes], pa.bool_()))
                hashes = [h for h in hashes if len(h)]
            found = np.array([fingerprint(h, words) for h in hashes], np.uint64).reshape(-1)
            prints = pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) + 1, words, dtype=np.int32)), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), prints], ["doc_id", "row", "print"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, print array<long>")


def correlations(prints: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Share of set bits, |correlation| of the 64 bits and number of rows, over all of ``prints`` (column fp)."""
    found, n = word_correlations(prints.select(F.array("fp").alias("print")), 1)
    return *found[0], n


def word_correlations(prints: DataFrame, words: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Share of set bits and |correlation| of the 64 bits of each word, and number of rows, over all of ``prints`` (column print)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((words, 64, 64), np.int64), 0
        for part in batches:
            own = part.column("print").flatten().to_numpy().view(np.uint64).reshape(-1, words)
            for k in range(words):
                bits = np.unpackbits(np.ascontiguousarray(own[:, k]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total[k] += np.rint(bits.T @ bits).astype(np.int64)
            n += len(own)
        place = np.append(np.arange(total.size), -1)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(np.append(total.ravel(), n))], ["place", "n"])

    rows = prints.select("print").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    found = {r["place"]: r["n"] for r in rows}
    n, out = max(found.get(-1, 0), 1), []
    for k in range(words):
        both = np.array([found.get(4096 * k + i, 0) for i in range(4096)], float).reshape(64, 64) / n
        p = both.diagonal().copy()
        spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p))) + 1e-9
        out.append((p, np.abs(both - np.outer(p, p)) / spread))
    return out, found.get(-1, 0)


def group_bits(correlated: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of the bits, each grown from the bit left that is most correlated to those left."""
    left, out = set(range(len(correlated))), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        rest = sorted(left)
        seed = max(rest, key=lambda b: (correlated[b, rest].sum(), -b))
        own = [seed]
        while len(own) < size:
            rest = sorted(left - set(own))
            own.append(max(rest, key=lambda b: (correlated[b, own].sum(), -b)))
        left -= set(own)
        out.append(sorted(own))
    return out


def within(p: np.ndarray, correlated: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0, 1, ... ``most`` of these bits, by as many independent bits as the
    correlated ones are worth: n over one plus the mean correlation to the others times (n - 1)."""
    n = len(p)
    mean = (correlated.sum() - np.trace(correlated)) / max(n * (n - 1), 1)
    worth = max(1, round(n / (1 + mean * (n - 1)))) if n else 0
    chance = np.zeros(most + 2)
    chance[0] = 1
    for q in np.full(worth, (2 * p * (1 - p)).mean() if n else 0.0):
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return np.cumsum(chance)[: most + 1]


def bucket_rows(width: int, t: int) -> int:
    return {-1: 0, 0: 1, 1: width, 2: 1 + width, 4: 1 + width + width * (width - 1) // 2}[t]


@dataclass(frozen=True)
class Probe:
    bits: tuple[int, ...]
    threshold: int


def probe_costs(p: np.ndarray, correlated: np.ndarray, group: list[int], n: int, row: float = ROW_COST, pair: float = PAIR_COST) -> dict[int, float]:
    """Estimated cost of each threshold for a partition, over n fingerprints; -1: it is left out."""
    chance = within(p[group], correlated[np.ix_(group, group)], 4)
    return {t: (bucket_rows(len(group), t) * n * row + chance[t] * n * n / 2 * pair) if t >= 0 else 0.0 for t in (-1, 0, 1, 2, 4)}


def allocate(p: np.ndarray, correlated: np.ndarray, n: int, radius: int, bits: list[int] | None = None) -> list[Probe]:
    """Partitions (of ``bits``, or all) and thresholds of the least estimated cost that find every pair within ``radius``."""
    bits = list(range(len(p))) if bits is None else bits
    best: tuple[float, list[Probe]] = (float("inf"), [])
    for parts in range(1, min(radius + 1, 8, len(bits)) + 1):
        groups = [[bits[k] for k in g] for g in group_bits(correlated[np.ix_(bits, bits)], parts)]
        costs = [probe_costs(p, correlated, g, n) for g in groups]
        table = {0: (0.0, ())}  # thresholds' sum so far, capped at what is needed
        for c in costs:
            fresh: dict[int, tuple[float, tuple[int, ...]]] = {}
            for got, (cost, chosen) in table.items():
                for t, more in c.items():
                    to = min(got + t + 1, radius + 1)
                    if to not in fresh or cost + more < fresh[to][0]:
                        fresh[to] = (cost + more, (*chosen, t))
            table = fresh
        if radius + 1 in table and table[radius + 1][0] < best[0]:
            cost, chosen = table[radius + 1]
            best = (cost, [Probe(tuple(g), t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


def flips(probe: Probe) -> tuple[int, list[int], list[int]]:
    """The partition's mask, masks of bits that are left out, and masks of bits that are turned."""
    one = [1 << b for b in probe.bits]
    mask, drop, turn = sum(one), [0], [0]
    if probe.threshold == 1:
        drop = one
    elif probe.threshold >= 2:
        turn = [0, *one]
        if probe.threshold >= 3:
            turn += [a | b for a, b in combinations(one, 2)]
    return mask, drop, turn


def bucket_keys(prints: np.ndarray, probes: list[Probe], start: int = 0) -> np.ndarray:
    """One line of bucket keys for each fingerprint; equal places in lists of equal probes share buckets, others practically don't.
    start: number of the first place."""
    columns = []
    for i, probe in enumerate(probes, start):
        mask, drop, turn = flips(probe)
        for j, d in enumerate(drop):
            kept = prints & np.uint64(mask & ~d)
            name = np.uint64(((i << 20) + (j << 8) + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            columns += [_mix((kept ^ np.uint64(t)) + name) for t in turn]
    return np.stack(columns, 1) if columns else np.zeros((len(prints), 0), np.uint64)


def bucket_masks(probes: list[Probe]) -> np.ndarray:
    """For each column of ``bucket_keys`` the bits that a bucket's members share for certain; of balls none."""
    out = []
    for probe in probes:
        mask, drop, turn = flips(probe)
        for d in drop:
            out += [mask & ~d if len(turn) == 1 else 0] * len(turn)
    return np.array(out, np.uint64)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return popcount(a ^ b).sum(-1, dtype=np.int64)


def forest(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each of these (distinct) fingerprints, the first one of its component under links of at most ``radius`` bits.

    Every fingerprint joins the first leader near it, or becomes one; only members of components still apart are then compared.
    """
    n = len(prints)
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left = np.arange(n)
    led: list[tuple[int, np.ndarray]] = []
    while len(left):  # the first one left leads all that are near it
        near = _distance(prints[left], prints[left[0]]) <= radius
        led.append((int(left[0]), left[near]))
        left = left[~near]
    for leader, own in led:
        parent[own] = leader
    top = np.array([root(i) for i in range(n)])
    for _ in range(n):
        tops, sizes = np.unique(top, return_counts=True)
        if len(tops) == 1:
            break
        merged = False
        for t in tops[np.argsort(sizes)][:-1].tolist():  # the largest component is met from the others
            own, rest = np.flatnonzero(top == t), np.flatnonzero(top != t)
            for block in np.array_split(own, -(-len(own) * len(rest) // 2_000_000)) if len(rest) else ():
                near = (_distance(prints[block][:, None], prints[rest][None]) <= radius).any(0)
                for other in np.unique(top[rest[near]]).tolist():
                    a, b = sorted((t, other))
                    top[top == b] = a
                    t, merged = a, True
                if merged:
                    break
            if merged:
                break
        if not merged:
            break
    return top


def bucket_links(key: np.ndarray, node: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of nodes that connect, within each run of equal keys, what is linked there."""
    n = len(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    out = []
    big = np.repeat(size > SMALL, size)
    for d in range(1, SMALL):
        at = np.flatnonzero((key[:-d] == key[d:]) & ~big[:-d]) if n > d else np.zeros(0, np.int64)
        if not len(at):
            break
        near = at[_distance(prints[at], prints[at + d]) <= radius]
        out.append(np.stack([node[near], node[near + d]], 1))
    for a, s in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
        top = forest(prints[a : a + s], radius)
        rest = np.flatnonzero(top != np.arange(s))
        out.append(np.stack([node[a + top[rest]], node[a + rest]], 1))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return np.unique(np.sort(pairs, 1), axis=0) if len(pairs) else pairs


def whole_buckets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, node, prints) of rows in order of their keys, cut where a bucket ends."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for part in batches:
        if not part.num_rows:
            continue
        key, node, prints = part.column("key").to_numpy(), part.column("node").to_numpy(), _prints(part, words)
        cut = np.flatnonzero(key != key[-1])
        cut = cut[-1] + 1 if len(cut) else 0
        if cut:
            held.append((key[:cut], node[:cut], prints[:cut]))
            yield tuple(np.concatenate(x) for x in zip(*held))
            held = []
        elif held and held[-1][0][-1] != key[0]:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held = []
        held.append((key[cut:], node[cut:], prints[cut:]))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def links(buckets: DataFrame, radius: int, words: int) -> DataFrame:
    """(a, b): buckets has key, node and print (binary), one row for each fingerprint and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, prints in whole_buckets(batches, words):
            found = bucket_links(key, node, prints, radius)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    width = shuffle_width(buckets.sparkSession)
    return buckets.repartition(width, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the component's smallest node.

    Each round, nodes go to their smallest neighbour, trees are cut to half their height, and edges are drawn anew between
    what is left, until none is. All of it stays in tables. A node with very many edges is pre-aggregated where its smallest
    neighbour is sought; in the joins its edges are the long side, which adaptive execution splits.
    """
    edges, n = counted(edges.filter("a != b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while n:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        near = materialise(near, "near")
        above = near.select(F.col("node").alias("up"), F.col("up").alias("top"))
        moved = materialise(near.join(above, "up").select("node", F.col("top").alias("root")), "moved")
        rounds.append(moved)
        left = moved.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = moved.select(F.col("node").alias("b"), F.col("root").alias("y"))
        old = edges
        edges, n = counted(
            edges.join(left, "a").join(right, "b").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges"
        )
        discard(old, near)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = rounds.pop()
    while rounds:
        known = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = materialise(rounds.pop().join(known, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
    return labels


BUCKETS = "key long, node long, mask long"


def deal(rows: DataFrame, probes: dict[int, list[Probe]]) -> DataFrame:
    """Bucket rows (key, node, mask) of fingerprints (fp) by the probes of mask 0, or of bucket rows that are dealt anew, each by
    the probes for its own mask and within its own bucket."""
    fresh = "fp" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            nodes = part.column("fp" if fresh else "node").to_numpy()
            masks = np.zeros(len(nodes), np.int64) if fresh else part.column("mask").to_numpy()
            for mask in np.unique(masks).tolist():
                own = np.flatnonzero(masks == mask)
                shared = bucket_masks(probes[mask]) | np.uint64(mask & 0xFFFFFFFFFFFFFFFF)
                for a in range(0, len(own), 4096):
                    at = own[a : a + 4096]
                    keys = bucket_keys(nodes[at].view(np.uint64), probes[mask])
                    if not fresh:
                        keys = _mix(keys ^ _mix(part.column("key").to_numpy()[at].view(np.uint64))[:, None])
                    n = keys.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(nodes[at], n)), pa.array(np.tile(shared, len(at)).view(np.int64))], ["key", "node", "mask"]
                    )

    return rows.mapInArrow(run, BUCKETS)


def split_hot(buckets: DataFrame, radius: int, hot: int = HOT, levels: int = 4) -> DataFrame:
    """``buckets`` without any of more than ``hot`` members: theirs are dealt to narrower buckets, over the bits that they needn't
    share, so that every pair within the radius still meets. After ``levels`` rounds, or without bits left, a bucket stays."""
    done: list[DataFrame] = []
    for level in range(levels):
        sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
        large, n = counted(sizes, "hot")
        if not n:
            break
        rows = materialise(buckets.join(large.select("key"), "key", "left_semi"), "dealt")
        p, correlated, total = correlations(rows.withColumnRenamed("node", "fp"))
        probes = {}
        for r in rows.select("mask").distinct().collect():  # as many as there are probes
            bits = [b for b in range(64) if not r["mask"] >> b & 1]
            if len(bits) > radius:
                probes[r["mask"]] = allocate(p, correlated, max(total // n, 1), radius, bits)
        splits = F.col("mask").isin(list(probes)) if probes else F.lit(False)
        done += [buckets.join(large.select("key"), "key", "left_anti"), rows.filter(~splits)]
        buckets = materialise(deal(rows.filter(splits), probes), "buckets")
    for part in done:
        buckets = buckets.unionByName(part)
    return buckets


def near_groups(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, fp, component_id): fp is the 64-bit fingerprint; component_id the smallest doc_id reachable over links of
    at most ``radius`` bits.

    Every pair within the radius is found. Texts without words have fingerprint zero and are linked like any other; null
    counts as empty; repeated rows share a fingerprint; an empty table gives no rows.
    """
    rows = materialise(fingerprints(docs, shingle, 1, id_col, text_col).select("doc_id", "row", F.col("print")[0].alias("fp")), "prints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    probes = allocate(*correlations(distinct), radius)

    found = links(split_hot(deal(distinct.select("fp"), {0: probes}), radius).withColumn("p0", F.col("node")), radius, 1)
    labels = components(found)
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(named.join(least, "root").select("fp", "component_id"), "classes")
    return salted_join(rows, classes, "fp").select("doc_id", "row", "fp", "component_id")


@dataclass(frozen=True)
class Wide:
    """For a similarity: the probes of each word of a long fingerprint. Of its first ``words`` words, radius: what a candidate differs
    in at most; cover: what one that is led by another does."""

    probes: tuple[tuple[Probe, ...], ...]
    radius: int
    cover: int
    words: int

    @property
    def certain(self) -> int:
        """Bits of the whole fingerprint up to which every pair shares a bucket."""
        return sum(p.threshold + 1 for own in self.probes for p in own) - 1

    def keys(self, prints: np.ndarray) -> np.ndarray:
        """One line of bucket keys for each line of words."""
        starts = np.cumsum([0, *(len(own) for own in self.probes)]).tolist()
        return np.concatenate([bucket_keys(prints[:, k], list(own), starts[k]) for k, own in enumerate(self.probes)], 1)


RECALL = 0.99  # chance to meet of two texts of just the similarity
#: Microseconds of a candidate pair in buckets that give forests (measured: 0.7 to 2.2) and of a word of a fingerprint (measured: 47), and
#: of a bucket row with its words, chosen above its time since rows fill the disk.
FOREST_COST, WORD_COST, WIDE_ROW_COST = 1.3, 47.0, 10.0
PARTS = (2, 3, 4, 5)  # partitions of a word
GAIN = 0.01  # unit in which the dynamic programme counts logarithms of the chance to be missed


def differ(similarity: float) -> float:
    """Chance that a bit differs: a Jaccard similarity s of shingle sets is a cosine of 2s/(1+s); bits differ with chance arccos(cosine)/pi."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def met(width: int, threshold: int, q: float) -> float:
    """Chance that two fingerprints whose bits differ with chance ``q`` meet in a partition; correlated bits make it greater."""
    return sum(comb(width, d) * q**d * (1 - q) ** (width - d) for d in range(threshold + 1))


def thresholds(groups: list[list[int]], costs: list[dict[int, float]], q: float, recall: float) -> tuple[float, list[int]]:
    """The least cost, and the thresholds of the partitions at that cost, at which two fingerprints whose bits differ with chance
    ``q`` meet with chance ``recall`` at least, by dynamic programming over partitions; infinite if there is no such choice."""
    need = int(np.ceil(-np.log(1 - recall) / GAIN))
    gained = {(size, t): int(-np.log(1 - met(size, t, q)) / GAIN) if t >= 0 else 0 for size in {len(g) for g in groups} for t in (-1, 0, 1, 2, 4)}
    table: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # gain so far, capped at what is needed
    for g, c in zip(groups, costs):
        fresh: dict[int, tuple[float, tuple]] = {}
        for got, (cost, chosen) in table.items():
            for t, more in c.items():
                to = min(got + gained[len(g), t], need)
                if to not in fresh or cost + more < fresh[to][0]:
                    fresh[to] = (cost + more, (chosen, t))
        table = fresh
    cost, chosen = table.get(need, (float("inf"), ()))
    out: list[int] = []
    while chosen:
        chosen, t = chosen
        out.append(t)
    return cost, out[::-1]


def fingerprint_words(n: int, similarity: float, recall: float) -> int:
    """How many words a fingerprint should have for n texts, if its bits were independent: more words cost time, fewer ask for greater thresholds."""
    p, none, costs = np.full(64, 0.5), np.zeros((64, 64)), {}
    for words in (8, 12, 16, 24, 32, 40, 48, 64):
        for parts in PARTS:
            own = [g.tolist() for g in np.array_split(np.arange(64), parts)]
            one = [probe_costs(p, none, g, n, WIDE_ROW_COST, FOREST_COST) for g in own]
            cost = thresholds(own * words, one * words, differ(similarity), recall)[0] + words * n * WORD_COST
            costs[words] = min(cost, costs.get(words, cost))
    return min(costs, key=lambda w: (costs[w], w))


def allocate_chance(found: list[tuple[np.ndarray, np.ndarray]], n: int, similarity: float, recall: float) -> tuple[tuple[Probe, ...], ...]:
    """For each word its partitions, correlated bits together, and their thresholds: of all choices that let two texts of that
    similarity meet with chance ``recall`` at least, the one of the least estimated cost."""
    best: tuple[float, list[tuple[int, list[int]]], list[int]] = (float("inf"), [], [])
    for parts in PARTS:
        groups = [(k, g) for k, (_, correlated) in enumerate(found) for g in group_bits(correlated, parts)]
        cost, chosen = thresholds([g for _, g in groups], [probe_costs(*found[k], g, n, WIDE_ROW_COST, FOREST_COST) for k, g in groups], differ(similarity), recall)
        if cost < best[0]:
            best = (cost, groups, chosen)
    return tuple(tuple(Probe(tuple(g), t) for (k, g), t in zip(*best[1:]) if k == word and t >= 0) for word in range(len(found)))


def wide_plan(found: list[tuple[np.ndarray, np.ndarray]], n: int, similarity: float, recall: float = RECALL, words: int = 4) -> Wide:
    """Of ``words`` * 64 bits, radius: three standard deviations above what the similarity makes likely, to be a candidate; cover: what
    0.9 makes likely (for 0.8), to be led by another."""
    bits, q = 64 * words, differ(similarity)
    probes = allocate_chance(found, max(n, 1), similarity, recall)
    return Wide(probes, int(bits * q + 3 * np.sqrt(bits * q * (1 - q))), int(bits * differ((1 + similarity) / 2)), words)


def spanning_forest(prints: np.ndarray, radius: int) -> np.ndarray:
    """(i, j, distance): a minimum spanning forest under distances of at most ``radius``. It has fewer edges than fingerprints, and
    connects at every smaller distance too what all pairs would."""
    left = np.arange(1, len(prints))
    best, link, out = _distance(prints[left], prints[0]), np.zeros(len(left), np.int64), []
    while len(left):
        k = int(best.argmin())
        at, last = int(left[k]), len(left) - 1
        if best[k] <= radius:
            out.append((int(link[k]), at, int(best[k])))
        for x in (left, best, link):
            x[k] = x[last]
        left, best, link = left[:last], best[:last], link[:last]
        far = _distance(prints[left], prints[at])
        nearer = far < best
        best[nearer], link[nearer] = far[nearer], at
    return np.array(out, np.int64).reshape(-1, 3)


def candidate_pairs(key: np.ndarray, node: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """(a, b, distance) of nodes within ``radius`` in each run of equal keys: all such pairs of small buckets, a spanning forest of
    the nearest ones of larger buckets, so that a bucket never gives more pairs than a few times its members."""
    n = len(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    big, out = np.repeat(size > SMALL, size), []
    for d in range(1, SMALL):
        at = np.flatnonzero((key[:-d] == key[d:]) & ~big[:-d]) if n > d else np.zeros(0, np.int64)
        if not len(at):
            break
        far = _distance(prints[at], prints[at + d])
        at, far = at[far <= radius], far[far <= radius]
        out.append(np.stack([node[at], node[at + d], far], 1))
    for a, s in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
        found = spanning_forest(prints[a : a + s], radius)
        out.append(np.stack([node[a + found[:, 0]], node[a + found[:, 1]], found[:, 2]], 1))
    pairs = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    pairs[:, :2] = np.sort(pairs[:, :2], 1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _prints(part: pa.RecordBatch, words: int) -> np.ndarray:
    return np.stack([part.column(f"p{i}").to_numpy() for i in range(words)], 1).view(np.uint64)


def peel(buckets: DataFrame, plan: Wide, hot: int = HOT, leaders: int = 64) -> tuple[DataFrame, list[DataFrame]]:
    """``buckets`` without members of hot ones that some leader covers, and the candidate pairs (a, b, d) found on the way.

    About ``leaders`` members of each hot bucket, by a hash of the node, are held against all its others, which are dealt over
    tasks by a salt of their own; a member pairs with the nearest leader alone. Rounds go on while any bucket is hot and rounds
    still take members away; what then stays in a hot bucket is one task's.
    """
    columns = [f"p{i}" for i in range(plan.words)]
    found, before = [], None
    while True:
        large, n = counted(buckets.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot), "hot")
        members = large.agg(F.sum("n")).first()[0]
        if not n or members == before:
            return buckets, found
        before = members
        rows = buckets.join(large, "key")
        chosen = F.pmod(F.xxhash64("node", F.lit(len(found))), F.ceil(F.col("n") / leaders)) == 0
        few = rows.filter(chosen).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", *columns))).alias("led"))
        joined = salted_join(rows.drop("n").withColumn("row", F.col("node")).withColumn("doc_id", F.lit(0)), few, "key").drop("row", "doc_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                node, prints = part.column("node").to_numpy(), _prints(part, plan.words)
                rows = []
                for i, led in enumerate(part.column("led").to_pylist()):
                    own = np.array([[x[c] for c in columns] for x in led], np.int64).reshape(-1, plan.words).view(np.uint64)
                    ids = np.array([x["node"] for x in led], np.int64)
                    far = _distance(own, prints[i])
                    lower = ids < node[i]
                    gone = bool((lower & (far <= plan.cover)).any())
                    far = np.where(ids == node[i], plan.words * 64 + 1, far)
                    k = int(far.argmin()) if len(far) else -1
                    near = k >= 0 and far[k] <= plan.radius
                    rows.append((gone, [{"a": min(int(ids[k]), int(node[i])), "b": max(int(ids[k]), int(node[i])), "d": int(far[k])}] if near else []))
                kept = part.select(["key", "node", *columns])
                pairs = pa.array([r[1] for r in rows], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("d", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([r[0] for r in rows], pa.bool_()), pairs], ["key", "node", *columns, "gone", "pairs"])

        schema = "key long, node long, " + ", ".join(f"{c} long" for c in columns) + ", gone boolean, pairs array<struct<a:long,b:long,d:long>>"
        round_ = materialise(joined.select("key", "node", *columns, "led").mapInArrow(run, schema), "peeled")
        found.append(round_.select(F.explode("pairs").alias("x")).select("x.*").distinct())
        buckets = buckets.join(large.select("key"), "key", "left_anti").unionByName(round_.filter("not gone").select(*buckets.columns))


def candidates(buckets: DataFrame, plan: Wide, hot: int = HOT) -> DataFrame:
    """(a, b, d): pairs of nodes that share a bucket and may be alike, each with its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, prints in whole_buckets(batches, plan.words):
            found = candidate_pairs(key, node, prints, plan.radius)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(3)], ["a", "b", "d"])

    buckets, peeled = peel(buckets, plan, hot)
    sent = buckets.repartition(shuffle_width(buckets.sparkSession), "key").sortWithinPartitions("key", "node")
    out = sent.mapInArrow(run, "a long, b long, d long")
    for more in peeled:
        out = out.unionByName(more)
    return out.groupBy("a", "b").agg(F.min("d").alias("d"))


HUB = 256  # members that meet one copy of their hub's text


def alike(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) have that Jaccard similarity of shingle sets at least.

    A pair's members come to the copies of its first text, one for each ``HUB`` of them, and are held against it one by one.
    """
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("copies"))
    hubs = degree.join(texts, degree["a"] == texts["node"]).select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(-1).cast("long").alias("b"), F.lit(0).alias("kind"), "text")
    members = pairs.join(degree, "a").join(texts, pairs["b"] == texts["node"]).select("a", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"), "b", F.lit(1).alias("kind"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for part in blocks(batches, "text", 4 << 20):
            out = []
            for a, b, kind, text in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), part.column("kind").to_pylist(), utf8(part.column("text"))):
                hashes = np.unique(shingle_hashes(text, shingle))
                if kind == 0:
                    own = hashes
                    continue
                both = len(np.intersect1d(own, hashes, assume_unique=True))
                if both and both >= similarity * (len(own) + len(hashes) - both) - 1e-9:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["a", "b"])

    width = shuffle_width(pairs.sparkSession)
    sent = hubs.unionByName(members).repartition(width, "a", "copy").sortWithinPartitions("a", "copy", "kind")
    return sent.mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, row, node, root): documents with one root are linked by pairs of that Jaccard similarity of word shingles, or more.

    A similarity of 0.8 differs in some 15 % of the bits: too many for thresholds that are certain to meet. So the fingerprint is
    longer, and its thresholds, unequal, come from a dynamic programme on estimated candidate counts that asks for
    the chance to meet; pairs within ``Wide.certain`` bits meet for certain. Pairs near enough are then decided by their shingles,
    each document's nearest first, the others where they would still connect something. So every link is a true one; a pair may
    be missed (see README for figures). Rows alike in id and text are one document. Texts without words, null ones too, and rows
    without a doc_id are left alone: each its own root.
    """
    rows = docs.filter(F.col(id_col).cast("long").isNotNull())
    words = fingerprint_words(max(docs.count(), 1), similarity, RECALL)
    prints = fingerprints(rows, shingle, words, id_col, text_col, empty=False).dropDuplicates(["doc_id", "row"])
    prints = materialise(prints.withColumn("node", F.monotonically_increasing_id()), "prints")
    plan = wide_plan(*word_correlations(prints, words), similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, 1024):
                own = part.slice(at, 1024)
                found = own.column("print").flatten().to_numpy().view(np.uint64).reshape(-1, words)
                keys = plan.keys(found)
                n = keys.shape[1]
                deciding = [pa.array(np.repeat(found[:, k].view(np.int64), n)) for k in range(plan.words)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(own.column("node").to_numpy(), n)), *deciding], ["key", "node", *(f"p{k}" for k in range(plan.words))])

    buckets = prints.select("node", "print").mapInArrow(run, "key long, node long, " + ", ".join(f"p{k} long" for k in range(plan.words)))
    pairs = materialise(candidates(buckets, plan, hot), "candidates")
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "d").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "d"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    wanted = prints.select("doc_id", "row", "node").join(ends.select("node").distinct(), "node", "left_semi")
    texts = materialise(source.join(wanted, ["doc_id", "row"]).select("node", "text"), "texts")
    nearest = ends.groupBy("node").agg(F.min(F.struct("d", "other")).alias("n")).select(F.least("node", "n.other").alias("a"), F.greatest("node", "n.other").alias("b")).distinct()
    nearest = materialise(nearest, "nearest")
    sure = materialise(alike(nearest, texts, similarity, shingle), "alike")
    known = materialise(components(sure), "known")
    end = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    apart = pairs.select("a", "b").join(nearest, ["a", "b"], "left_anti").join(end("a"), "a", "left").join(end("b"), "b", "left")
    apart = apart.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    more = materialise(alike(apart, texts, similarity, shingle), "alike")
    labels = materialise(components(sure.unionByName(more)), "labels")
    named = prints.select("doc_id", "row", "node").join(labels, "node", "left")
    return named.select("doc_id", "row", "node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the smallest doc_id, with the columns they came with.

    Of one doc_id with several texts in a group, that of the smallest hash stays; rows alike in id and text stay or go together. Null
    and empty texts and rows without a doc_id stay; an empty table stays empty.
    """
    groups = materialise(similar_groups(docs, similarity, shingle, id_col, text_col), "similar")
    first = groups.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    mine, row = fresh_name(docs, "_id"), fresh_name(docs, "_row")
    gone = salted_join(groups, first, "root").filter("struct(doc_id, row) != first").select(F.col("doc_id").alias(mine), F.col("row").alias(row))
    rows = docs.withColumn(mine, F.col(id_col).cast("long")).withColumn(row, row_key(F.col(text_col)))
    return rows.join(gone, [mine, row], "left_anti").drop(mine, row)
