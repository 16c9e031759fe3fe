"""Best-fit packing of tokenised documents into sequences, with vector capacities.

A piece is a vector: tokens, one document, attention cost (length squared). A sequence has a capacity for each. Pieces of
one length are alike, so the plan is made on the histogram of lengths (as many entries as a sequence has tokens, however
large the corpus is) and holds runs of equally filled sequences instead of single ones. Lengths are taken in falling
order; each piece goes to the open sequence with the smallest weighted norm of what is left (or the largest weighted dot
product with it) among those where every capacity holds. The pieces then find their places from their rank among the
pieces of their length, without meeting in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encode_merges
from .common import blocks, crc, materialise

PIECES = "chunk int, rank long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


@dataclass(frozen=True)
class Capacity:
    """tokens: of a sequence; documents: pieces of a sequence; attention: sum of squared lengths. None: as much as the tokens allow."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.1)
    by: str = "norm"

    @property
    def longest(self) -> int:
        """Tokens of the longest piece that every capacity holds; documents are cut there."""
        return min(self.tokens, isqrt(self.attention)) if self.attention else self.tokens

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


@dataclass
class Plan:
    """Runs of places, ordered by (length, first): ranks from ``first`` on get ``per`` places in each sequence from ``sequence`` on, at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces with this length and rank."""
        low, high = np.searchsorted(self.length, length), np.searchsorted(self.length, length, "right")
        while (low + 1 < high).any():
            mid = (low + high) // 2
            right = (self.first[np.minimum(mid, len(self.first) - 1)] <= rank) & (mid < high)
            low, high = np.where(right, mid, low), np.where(right, high, np.maximum(mid, low + 1))
        nth = rank - self.first[low]
        return self.sequence[low] + nth // self.per[low], self.offset[low] + nth % self.per[low] * length


def plan(histogram: dict[int, int], capacity: Capacity) -> Plan:
    """Best fit on the histogram {length: pieces}."""
    full = capacity.vector()
    scale = np.array(capacity.weights) / full.astype(float) ** 2
    left = np.zeros((64, 3), np.int64)  # of one sequence of each run
    many = np.zeros(64, np.int64)
    inside: list[list[tuple[int, int]]] = []  # (length, how many), in the order of their places
    n = 0

    def add(rest: np.ndarray, count: int, what: list[tuple[int, int]]) -> None:
        nonlocal n, left, many
        if n == len(many):
            left, many = np.concatenate([left, np.zeros_like(left)]), np.concatenate([many, np.zeros_like(many)])
        left[n], many[n] = rest, count
        inside.append(what)
        n += 1

    for length in sorted(histogram, reverse=True):
        todo, item = histogram[length], np.array([length, 1, length * length], np.int64)
        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens is over a capacity")
        while todo:
            fits = np.flatnonzero((left[:n] >= item).all(1) & (many[:n] > 0))
            if len(fits):
                rest = left[fits]
                score = ((rest - item) ** 2 * scale).sum(1) if capacity.by == "norm" else -(rest * item * scale).sum(1)
                at = fits[np.argmin(score)]
                # by norm a filled sequence stays the best one; by dot product the others of its run come first
                per = int((left[at] // item).min()) if capacity.by == "norm" else 1
                runs, base, what = min(int(many[at]), todo // per), left[at].copy(), inside[at]
                room = int(many[at])
                if runs:
                    many[at] -= runs
                    add(base - per * item, runs, [*what, (length, per)])
                    todo -= runs * per
                if todo and runs < room:
                    many[at] -= 1
                    add(base - todo * item, 1, [*what, (length, todo)])
                    todo = 0
            else:
                per = int((full // item).min())
                if runs := todo // per:
                    add(full - per * item, runs, [(length, per)])
                if todo % per:
                    add(full - todo % per * item, 1, [(length, todo % per)])
                todo = 0
    rows, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for i in range(n):
        if not many[i]:
            continue
        offset = 0
        for length, per in inside[i]:
            rows.append((length, used[length], per, sequence, offset))
            used[length] += per * int(many[i])
            offset += per * length
        sequence += int(many[i])
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*(np.ascontiguousarray(table[:, k]) for k in range(5)), sequence)


def pieces(docs: DataFrame, path: str, tokens: int, separator: int, keep_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """Tokenises every text, ends it with ``separator`` and cuts it into pieces; rank: among the pieces of its length in its chunk (the task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen = TaskContext.get().partitionId(), np.zeros(tokens + 1, np.int64)
        for part in blocks(batches, "text", 2 << 20):
            ids, before = encode_merges(path, [x or "" for x in part.column("text").to_pylist()])
            owner, number, start, length, sums, packed = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist())):
                data = np.empty(b - a + 1, "<u4")
                data[:-1], data[-1] = ids[a:b], separator
                at, cut = 0, len(data) % tokens or tokens
                for k in range(-(-len(data) // tokens)):
                    raw = data[at:cut].tobytes()
                    owner.append(i), number.append(k), start.append(at), length.append(cut - at), sums.append(crc(raw))
                    packed.append(raw if keep_ids else None)
                    at, cut = cut, cut + tokens
            size = np.array(length, np.int64)
            order = np.argsort(size, kind="stable")
            ordered = size[order]
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(size) else np.zeros(0, np.int64)
            run_of = np.diff(np.r_[first, len(size)])
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) - np.repeat(first, run_of) + seen[ordered]
            seen[ordered[first]] += run_of
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(size), chunk, np.int32)),
                    pa.array(rank),
                    part.column("doc_id").take(pa.array(owner, pa.int64())),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(size),
                    pa.array(sums, pa.int64()),
                    pa.array(packed, pa.binary()),
                ],
                ["chunk", "rank", "doc_id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pack(
    docs: DataFrame, path: str, capacity: Capacity | None = None, separator: int = 0, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset): every piece with its sequence and its place there.

    A null or empty text is one piece with the separator alone; repeated rows are packed each; pieces of one length take
    their places in the order of tasks and rows, so that ties need no rule; an empty table gives no rows. With the default
    capacity tokens alone decide; ``documents`` and ``attention`` below what the tokens allow cut too. ids (little-endian unsigned 32-bit) is null unless ``keep_ids``. The driver gets the histogram of lengths only:
    at most ``capacity.tokens`` rows.
    """
    capacity = capacity or Capacity()
    table = materialise(pieces(docs, path, capacity.longest, separator, keep_ids, id_col, text_col), "pieces")
    counts = table.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    layout = plan(histogram, capacity)
    before = counts.select("chunk", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = table.join(before, ["chunk", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("before") + F.col("rank")).alias("rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sequence, offset = layout.place(part.column("length").to_numpy(), part.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
