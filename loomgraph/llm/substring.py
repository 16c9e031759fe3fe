"""Repeated word windows across documents, by super-k-mer partitioning.

A window's minimiser is the rarest of its words (by counts over all documents, folded to a table of fixed size; ties by
hash). Consecutive windows that share it travel as one packed string to the minimiser's bucket, where the windows of all
strings are sorted and counted exactly. Within a block of documents equal strings are merged before they travel: the one
of the smallest doc_id goes, the others are known to be covered. So a passage in a third of all documents reaches its
bucket once a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Numbered
from .common import blocks, row_key, shuffle_width, utf8

CELLS = 4096
BLOCK = 8 << 20
BUCKET = 24 << 20  # bytes of strings a bucket, about
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of many texts in one buffer, each ended by a blank."""

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        joined = b" ".join([b" ".join(w) for w in split if w])
        self.buffer = joined + b" " if joined else b""
        raw = np.frombuffer(self.buffer + b"\0" * 8, np.uint8)
        self.ends = np.flatnonzero(raw == 0x20)
        self.starts = np.r_[0, self.ends[:-1] + 1] if len(self.ends) else self.ends
        self.before = np.r_[0, np.cumsum(self.counts)]
        self.raw = raw

    def hashes(self) -> np.ndarray:
        """A function of each word's length, first eight and last eight bytes."""
        if not len(self.ends):
            return np.zeros(0, np.uint64)
        eight = np.ndarray(len(self.raw) - 7, "<u8", self.raw.data, strides=(1,))
        size = self.ends - self.starts
        cut = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64))
        head = eight[self.starts] & cut
        tail = eight[np.maximum(self.ends - 8, self.starts)] & cut
        return _mix(head * _M + _mix(tail) + size.astype(np.uint64))


def cell_counts(docs: DataFrame) -> np.ndarray:
    """How many words fall into each cell, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for part in blocks(batches, "text", BLOCK):
            total += np.bincount((Words(utf8(part.column("text"))).hashes() % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS)), pa.array(total)], ["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    for r in docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def minimisers(hashes: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """The smallest order value among the words of each window (windows across documents too)."""
    rare = np.log2(counts + 1).astype(np.uint64)
    value = (rare[(hashes % np.uint64(CELLS)).astype(np.int64)] << np.uint64(56)) | (hashes >> np.uint64(8))
    size = 1
    while size * 2 <= window:
        value = np.minimum(value[:-size], value[size:])
        size *= 2
    if size < window:
        value = np.minimum(value[: len(value) - (window - size)], value[window - size :])
    return value


def _columns(*columns: np.ndarray) -> bytes:
    """Four columns, differences of the first two, one after the other."""
    one, two, three, four = columns
    return np.diff(one, prepend=0).astype("<i8").tobytes() + np.diff(two, prepend=0).astype("<i8").tobytes() + three.astype("<u4").tobytes() + four.astype("<u4").tobytes()


def _rows(raw: bytes) -> np.ndarray:
    n = len(raw) // 24
    wide, thin = np.frombuffer(raw, "<i8", 2 * n).reshape(2, n), np.frombuffer(raw, "<u4", 2 * n, 16 * n).reshape(2, n)
    return np.stack([*np.cumsum(wide, 1), *thin.astype(np.int64)], 1)


def _pack(parts: list[bytes]) -> bytes:
    head = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 * (n + 1), []
    for size in np.frombuffer(raw, "<i8", n, 8).tolist():
        out.append(raw[at : at + size])
        at += size
    return out


def cut_block(doc_id: np.ndarray, row: np.ndarray, texts: list[bytes], counts: np.ndarray, window: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed strings) of a block of documents sorted by doc_id.

    row: below 2**32. Of a packed string travel: the words, the places (string, doc_id, row, first word) of its documents, and runs already
    known to be covered (doc_id, row, first window, windows).
    """
    words = Words(texts)
    n = len(words.ends)
    if n < window:
        return
    value = minimisers(words.hashes(), counts, window)
    doc = np.repeat(np.arange(len(texts)), words.counts)
    inside = doc[: len(value)] == doc[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return
    fresh = np.r_[True, (value[at[1:]] != value[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]]) | (at[1:] != at[:-1] + 1)]
    first = at[fresh]
    size = np.diff(np.r_[np.flatnonzero(fresh), len(at)])
    begins, ends = words.starts[first].tolist(), words.ends[first + size + window - 2].tolist()
    owners: dict[bytes, int] = {}
    buffer, place, known = words.buffer, [], []
    docs = doc[first].tolist()
    ids = doc_id.tolist()
    string = np.empty(len(first), np.int64)
    for k, (a, b) in enumerate(zip(begins, ends)):
        s = buffer[a:b]
        o = owners.setdefault(s, k)
        string[k] = o
        (place if ids[docs[o]] == ids[docs[k]] else known).append(k)
    place, known = np.array(place, np.int64), np.array(known, np.int64)
    keys = np.fromiter(owners.values(), np.int64, len(owners))
    bucket = (_mix(value[first]) % np.uint64(buckets)).astype(np.int64)
    number = np.empty(len(first), np.int64)
    order = keys[np.argsort(bucket[keys], kind="stable")]
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    place = place[np.argsort(bucket[place], kind="stable")]
    place_cuts = np.searchsorted(bucket[place], np.arange(buckets + 1))
    start = first - words.before[doc[first]]
    if len(known):  # joined where they follow each other, then dealt out evenly
        same = (doc[first[known[1:]]] == doc[first[known[:-1]]]) & (start[known[1:]] == start[known[:-1]] + size[known[:-1]])
        head = np.flatnonzero(np.r_[True, ~same])
        many = np.add.reduceat(size[known], head)
        runs = known[head]
        d = doc[first[runs]]
        for part in np.array_split(np.arange(len(runs)), min(len(runs), 16)):
            spot = int(_mix(np.array([row[d[part[0]]]], np.int64).view(np.uint64))[0] % np.uint64(buckets))
            yield spot, _pack([b"", b"", _columns(start[runs[part]], doc_id[d[part]], row[d[part]], many[part])])
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[b] : cuts[b + 1]]
        number[own] = np.arange(len(own))
        here = place[place_cuts[b] : place_cuts[b + 1]]
        d = doc[first[here]]
        lines = b"\n".join([buffer[begins[k] : ends[k]] for k in own.tolist()])
        yield b, _pack([lines, _columns(number[string[here]], doc_id[d], row[d], start[here]), b""])


def covered(packed: list[bytes], window: int) -> np.ndarray:
    """Runs (doc_id, row, first window, windows) covered by a smaller doc_id, from all that reached one bucket."""
    lines, places, runs, n = [], [], [], 0
    for blob in packed:
        text, spots, known = _unpack(blob)
        if known:
            runs.append(_rows(known)[:, [1, 2, 0, 3]])
        if text:
            spot = _rows(spots)
            spot[:, 0] += n
            own = text.split(b"\n")
            n += len(own)
            lines += own
            places.append(spot)
    if lines:
        place = np.concatenate(places)
        sizes = np.fromiter((s.count(b" ") + 1 for s in lines), np.int64, n)
        index = Numbered()
        word = np.fromiter(map(index.__getitem__, b" ".join(lines).split()), np.int64, int(sizes.sum()))
        windows = sizes - window + 1
        string = np.repeat(np.arange(n), windows)
        offset = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = np.repeat(np.cumsum(sizes) - sizes, windows) + offset
        mixed = _mix(word.astype(np.uint64) + np.uint64(1))
        name = np.zeros(len(at), np.uint64)
        for k in range(window):
            name = name * np.uint64(0x100000001B3) + mixed[at + k]
        order = np.argsort(name, kind="stable")
        head = np.r_[True, name[order[1:]] != name[order[:-1]]]
        several = ~(head & np.r_[head[1:], True])
        order, head = order[several], head[several]
        least_of = np.empty(n, np.int64)  # a string's places are of one doc_id
        least_of[place[:, 0]] = place[:, 1]
        hit = np.zeros(len(at), bool)
        if len(order):
            follow = np.flatnonzero(~head)
            alike = np.ones(len(follow), bool)
            for k in range(window):
                alike &= word[at[order[follow]] + k] == word[at[order[follow - 1]] + k]
            group = np.cumsum(head) - 1
            if not alike.all():  # other windows with one hash: told apart by their words
                exact: dict[tuple, int] = {}
                group = np.array([exact.setdefault((g, *word[a : a + window].tolist()), len(exact)) for g, a in zip(group.tolist(), at[order].tolist())])
                again = np.argsort(group, kind="stable")
                order, group = order[again], group[again]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            ids = least_of[string[order]]
            least = np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.r_[starts, len(ids)]))
            hit[order[ids > least]] = True
        edge = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | (string[1:] != string[:-1])])
        stop = np.flatnonzero(hit & np.r_[~hit[1:] | (string[1:] != string[:-1]), True])
        if len(edge):
            # every place of a string has the string's covered runs
            by_string = np.searchsorted(string[edge], np.arange(n + 1))
            many = np.diff(by_string)[place[:, 0]]
            who = np.repeat(np.arange(len(place)), many)
            run = np.repeat(by_string[place[:, 0]] - (np.cumsum(many) - many), many) + np.arange(len(who))
            runs.append(np.stack([place[who, 1], place[who, 2], place[who, 3] + offset[edge[run]], stop[run] - edge[run] + 1], 1))
    return np.concatenate(runs) if runs else np.zeros((0, 4), np.int64)


def covered_runs(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, row, first, n): runs of covered windows; docs has doc_id, row and text."""
    spark = docs.sparkSession
    counts = cell_counts(docs)
    width = shuffle_width(spark)
    buckets = max(16 * width, int(counts.sum()) * 20 // BUCKET)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", BLOCK):
            part = part.filter(part.column("doc_id").is_valid()).sort_by("doc_id")
            if part.num_rows:
                found = list(cut_block(part.column("doc_id").to_numpy(), part.column("row").to_numpy(), utf8(part.column("text")), counts, window, buckets))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["bucket", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def out():
            found = covered(held, window)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(4)], ["doc_id", "row", "first", "n"])

        for part in batches:
            for bucket, packed in zip(part.column("bucket").to_pylist(), part.column("packed").to_pylist()):
                if bucket != now and held:
                    yield out()
                    held = []
                now = bucket
                held.append(packed)
        if held:
            yield out()

    # buckets follow the words, and partitions the buckets: a task's share doesn't grow with the input
    sent = docs.mapInArrow(cut, "bucket long, packed binary").repartition(max(width, buckets // 16), "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(count, "doc_id long, row long, first long, n long")


RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<first:long,n:long>>, kept_text string, kept_sha256 string"


def remove_repeats(docs: DataFrame, window: int = 13, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_text, kept_sha256) for every row of ``docs``.

    Removed is each word covered by a window of ``window`` consecutive words that also starts in a document of a smaller
    doc_id; removed: its spans (first word, words). Windows are judged on the input. kept_text (null unless ``texts``): the
    kept words joined by one blank. Null and empty texts have no words; rows that share a doc_id don't cover each other;
    rows without a doc_id neither cover nor are covered; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.pmod(row_key(F.col(text_col)), F.lit(1 << 32)).alias("row"), F.col(text_col).alias("text"))
    found = covered_runs(rows, window)
    runs = found.groupBy("doc_id", "row").agg(F.collect_set(F.shiftleft("first", 32) + F.col("n")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for doc_id, text, spans in zip(part.column("doc_id").to_pylist(), utf8(part.column("text")), part.column("runs").to_pylist()):
                words = text.split()
                total, removed = len(words), []
                if spans:
                    packed = np.array(spans, np.int64)
                    edge = np.zeros(total + 1, np.int64)
                    first = packed >> 32
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + (packed & 0xFFFFFFFF) + window - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    sides = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    removed = [{"first": a, "n": b - a} for a, b in zip(sides[::2].tolist(), sides[1::2].tolist())]
                    words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                kept = b" ".join(words)
                out.append((doc_id, total, total - len(words), removed, kept.decode() if texts else None, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())])), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_words", "n_removed", "removed", "kept_text", "kept_sha256"])

    joined = rows.join(runs, ["doc_id", "row"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(run, RESULT)
