"""Hashed maximum-entropy language model over words.

P(word | history) = P(group | history) * P(class | group, history) * P(word | class). Classes hold about equal shares of the
corpus, from frequent words to rare ones, and neighbouring classes make a group. The first two factors are softmaxes of summed
weights of n-gram and skip features: the word before, the one two back alone, the two before together, and the classes of
these two. Every feature, of every word, is hashed with its group into one table of weights. The third factor
follows from counts, add one. With all weights zero the model is the smoothed unigram model; gradient updates move it from
there: each task climbs the log-likelihood of its share of the corpus in mini-batches (seen minus expected, step sizes by the
squared gradients so far, weights drawn to zero), the tasks' weights are averaged by how often each touched a cell, and the
next share starts from the average.

Documents are turned into batches once: each has its own word list, whose counts in the whole corpus come back by batch,
so that no vocabulary is held anywhere as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Numbered
from .common import blocks, discard, doc_remainder, materialise, shuffle_width, trim, utf8
from .substring import Words, _mix

GROUPS = 8
CLASSES = 8 * GROUPS
SIDE = CLASSES // GROUPS  # classes of a group
CELLS = 1 << 18  # rows of GROUPS (or SIDE, as many) weights
FEATURES = 4
ROUNDS = 3  # each sees every ROUNDS-th batch, so that all together see the corpus once
RATE = 0.7  # of a step
CALM = 30.0  # squared gradient that each cell is taken to have seen: rare features move little
DECAY = 1e-2  # share of its weight that a cell loses by each token that has it
MINI = 1 << 16  # tokens of an update
RANGES = 64  # the table's ranges, by which tasks' updates are averaged
SPREAD = 32  # words that aren't frequent are dealt over classes by so many hash values of their last two bytes
BATCH = 2 << 20
BLOCK = 4096
BUCKET = 32 << 20  # bytes of text whose words a bucket gets, about
END_WORD = b"\n"  # can't be a word, nor can a blank be in one: lists are joined by blanks


@lru_cache(1)
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _press(x: np.ndarray | bytes) -> bytes:
    return _codec()[0].compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def _open(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_codec()[1].decompress(blob), kind)


def count_bin(counts: np.ndarray) -> np.ndarray:
    """Counts up to 1024 as they are, beyond in steps of a 64th of a doubling: a number of bins that hardly grows."""
    large = 1024 + np.floor(64 * (np.log2(np.maximum(counts, 1024)) - 10)).astype(np.int64)
    return np.where(counts <= 1024, counts, large)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """32 bits of each word: SPREAD values of its ending in the lowest bits, above them a hash of the whole. The end's are 0."""
    plain = [w for w in words if w != END_WORD]
    out = np.zeros(len(words), np.uint32)
    if plain:
        found = Words([b" ".join(plain)])
        ending = found.raw[found.ends - 1].astype(np.uint64) * np.uint64(256) + found.raw[np.maximum(found.ends - 2, found.starts)]
        both = (found.hashes() >> np.uint64(32)) // np.uint64(SPREAD) * np.uint64(SPREAD) + _mix(ending) % np.uint64(SPREAD)
        out[np.fromiter((w != END_WORD for w in words), bool, len(words))] = both.astype(np.uint32)
    return out


BATCHES = "batch long, doc_id binary, sizes binary, held binary, tokens binary, hashes binary, words array<struct<bucket:int,words:binary,counts:binary>>"


def batches(docs: DataFrame, buckets: int) -> DataFrame:
    """Batches of documents (columns doc_id, held, text): packed ids, token numbers, and the word list by bucket with the
    counts in documents to learn from."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in blocks(parts, "text", BATCH):
            index = Numbered()
            sizes, flat = [], []
            for t in utf8(part.column("text")):
                words = t.lower().split()
                flat += words
                flat.append(END_WORD)
                sizes.append(len(words) + 1)
            tokens = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
            listed = list(index)
            hashes = word_hashes(listed)
            bucket = (_mix(hashes.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            tokens = rank[tokens]
            held = np.asarray(part.column("held").fill_null(True))
            learn = np.repeat(~held, sizes)
            counts = np.bincount(tokens[learn], minlength=len(listed))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            lists = [
                {"bucket": b, "words": _press(b" ".join([listed[k] for k in order[cuts[b] : cuts[b + 1]].tolist()])), "counts": _press(counts[cuts[b] : cuts[b + 1]].astype("<i4"))}
                for b in np.flatnonzero(np.diff(cuts)).tolist()
            ]
            ids = pa.array(part.column("doc_id")).fill_null(np.iinfo(np.int64).min)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    *(pa.array([x], pa.binary()) for x in (
                        _press(np.asarray(ids).astype("<i8")), _press(np.array(sizes, "<i8")), _press(held.astype(np.uint8)),
                        _press(tokens.astype("<i4")), _press(hashes[order].astype("<u4")),
                    )),
                    pa.array([lists], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())]))),
                ],
                ["batch", "doc_id", "sizes", "held", "tokens", "hashes", "words"],
            )
            number += 1
        trim()

    return docs.mapInArrow(run, BATCHES)


def word_counts(table: DataFrame, buckets: int) -> DataFrame:
    """kind 0: (batch, bucket, packed): counts of a batch's words in the whole corpus. kind 1: (bin, spread, words, mass)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        now = None

        def out():
            index, at, sums = Numbered(), [], []
            for batch, words, counts in held:
                own = _codec()[1].decompress(words).split(b" ")
                at.append(np.fromiter(map(index.__getitem__, own), np.int64, len(own)))
                sums.append(_open(counts, "<i4"))
            total = np.bincount(np.concatenate(at), np.concatenate(sums), minlength=len(index)).astype(np.int64)
            spread = (word_hashes(list(index)) % np.uint32(SPREAD)).astype(np.int64)
            seen = total > 0
            cell, where = np.unique(count_bin(total[seen]) * SPREAD + spread[seen], return_inverse=True)
            n = len(held) + len(cell)
            pad = lambda x, front: pa.array(np.r_[np.zeros(n - len(x), np.int64), x] if front else np.r_[x, np.zeros(n - len(x), np.int64)])
            packed = [_press(total[a].astype("<i8")) for a in at] + [None] * len(cell)
            return pa.RecordBatch.from_arrays(
                [
                    pad(np.ones(len(cell), np.int64), True),
                    pad(np.array([b for b, _, _ in held], np.int64), False),
                    pad(np.full(len(held), now, np.int64), False),
                    pa.array(packed, pa.binary()),
                    pad(cell // SPREAD, True),
                    pad(cell % SPREAD, True),
                    pad(np.bincount(where, minlength=len(cell)), True),
                    pad(np.bincount(where, total[seen], minlength=len(cell)).astype(np.int64), True),
                ],
                ["kind", "batch", "bucket", "packed", "bin", "spread", "words", "mass"],
            )

        for part in parts:
            for bucket, batch, words, counts in zip(*(part.column(c).to_pylist() for c in ("bucket", "batch", "words", "counts"))):
                if bucket != now and held:
                    yield out()
                    held = []
                now = bucket
                held.append((batch, words, counts))
        if held:
            yield out()
        trim()

    rows = table.select("batch", F.explode("words").alias("w")).select("w.bucket", "batch", "w.words", "w.counts")
    sent = rows.repartition(max(shuffle_width(table.sparkSession), buckets // 4), "bucket").sortWithinPartitions("bucket", "batch")
    return sent.mapInArrow(run, "kind long, batch long, bucket long, packed binary, bin long, spread long, words long, mass long")


@dataclass
class Model:
    total: int  # tokens learned from
    kinds: int  # distinct ones
    bins: np.ndarray  # bin * SPREAD + spread, sorted, of words learned
    classes: np.ndarray  # their classes
    mass: np.ndarray  # sum of count + 1 in each class
    weights: np.ndarray  # CELLS x GROUPS, float32
    squares: np.ndarray  # sum of each cell's squared gradients, float32

    @property
    def prior(self) -> np.ndarray:
        """Natural logarithms of the shares of each group, then of each class in its group."""
        group = self.mass.reshape(GROUPS, SIDE).sum(1)
        return np.log(np.r_[group / group.sum(), (self.mass.reshape(GROUPS, SIDE) / group[:, None]).ravel()])

    def classify(self, counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Class of each word; unseen words are one word more, in the last class."""
        key = count_bin(counts) * SPREAD + (hashes % np.uint32(SPREAD)).astype(np.int64)
        at = np.minimum(np.searchsorted(self.bins, key), max(len(self.bins) - 1, 0))
        return np.where(counts > 0, self.classes[at] if len(self.bins) else 0, CLASSES - 1)


def make_classes(rows: list[tuple[int, int, int, int]]) -> Model:
    """rows: (bin, spread, words, mass). Frequent words are laid out by count, the others by ending and count, and all are cut
    into equal shares; words of one bin and ending stay together."""
    often = int(count_bin(np.array([max(2, sum(r[3] for r in rows) // (4 * CLASSES))]))[0])
    rows = sorted(rows, key=lambda r: (0, -r[0], r[1]) if r[0] >= often else (1, r[1], -r[0]))
    words, mass = (np.array([r[k] for r in rows], np.int64) for k in (2, 3))
    total, kinds = int(mass.sum()), int(words.sum())
    weight = mass + words
    middle = np.cumsum(weight) - weight / 2
    classes = np.minimum((middle / max(total + kinds + 1, 1) * CLASSES).astype(np.int64), CLASSES - 1)
    sums = np.bincount(classes, weight, minlength=CLASSES) if len(rows) else np.zeros(CLASSES)
    sums[CLASSES - 1] += 1  # the unseen word
    keys = np.array([r[0] * SPREAD + r[1] for r in rows], np.int64)
    order = np.argsort(keys)
    return Model(total, kinds, keys[order], classes[order], np.maximum(sums, 1e-9), np.zeros((CELLS, GROUPS), np.float32), np.zeros(CELLS, np.float32))


def feature_hashes(words: np.ndarray, classes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashes (FEATURES x tokens) of the features of each token; words, classes: hash and class of each; place: its number in
    its document. Before the first word stands a mark of its own."""
    n = len(words)

    def back(values: np.ndarray, k: int) -> np.ndarray:
        out = np.full(n, np.uint64(0xB05), np.uint64)
        out[k:] = np.where(place[k:] >= k, values[: n - k] + np.uint64(0x1000), np.uint64(0xB05))
        return out

    words, classes = words.astype(np.uint64), classes.astype(np.uint64)
    one, two = back(words, 1), back(words, 2)
    keys = (one, two, one * np.uint64(0x9E3779B97F4A7C15) + two, back(classes, 1) * np.uint64(0x10000) + back(classes, 2))
    return np.stack([_mix(key * np.uint64(8) + np.uint64(k)) for k, key in enumerate(keys)])


def cells(hashes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells that hold each feature's weights of the groups, and of the classes of ``group``."""
    mask = np.uint64(CELLS - 1)
    return (hashes & mask).astype(np.int32), (((hashes >> np.uint64(32)) + group.astype(np.uint64) * np.uint64(0x2545F)) & mask).astype(np.int32)


class Scorer:
    """A model's weights and priors, single precision."""

    def __init__(self, model: Model):
        self.weights = model.weights
        prior = model.prior.astype(np.float32)
        self.prior_groups, self.prior_classes = prior[:GROUPS], prior[GROUPS:].reshape(GROUPS, SIDE)

    def logits(self, of_groups: np.ndarray, of_classes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the groups, and of the classes of ``group``, for each token (columns of the cells); not normalised."""
        x, y = self.weights[of_groups[0]], self.weights[of_classes[0]]
        for row, inner in zip(of_groups[1:], of_classes[1:]):
            x += self.weights[row]
            y += self.weights[inner]
        x += self.prior_groups
        y += self.prior_classes[group]
        return x, y


@dataclass
class Batch:
    doc_id: np.ndarray
    sizes: np.ndarray
    held: np.ndarray
    tokens: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Batch:
        by = sorted(row["counts"], key=lambda x: x["bucket"])
        counts = np.concatenate([_open(x["packed"], "<i8") for x in by])
        return cls(_open(row["doc_id"], "<i8"), _open(row["sizes"], "<i8"), _open(row["held"], np.uint8) > 0, _open(row["tokens"], "<i4"), counts, _open(row["hashes"], "<u4"))

    def prepared(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of the words, feature hashes of the tokens, class of each token."""
        classes = model.classify(self.counts, self.hashes)
        place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        target = classes[self.tokens]
        return classes, feature_hashes(self.hashes[self.tokens], target, place), target


def gradient(scorer: Scorer, hashes: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the tokens' log-likelihood by the weights: how many tokens touched each cell, and the gradient of its weights (seen
    minus expected)."""
    group, side, n = target // SIDE, target % SIDE, len(target)
    own = cells(hashes, group)
    slope = np.zeros((CELLS, GROUPS), np.float32)
    chances = scorer.logits(*own, group)
    for chance, hit in zip(chances, (group, side)):
        np.exp(chance, chance)
        chance /= -chance.sum(1, keepdims=True)
        chance[np.arange(n), hit] += 1
    flat = np.concatenate([own[0].ravel(), own[1].ravel()]).astype(np.intp)  # counted into the whole table: no sorting
    for k in range(GROUPS):
        slope[:, k] = np.bincount(flat, np.concatenate([x for chance in chances for x in [chance[:, k]] * len(hashes)]), CELLS)
    return np.bincount(flat, minlength=CELLS), slope


def climb(model: Model, batch: Batch, touched: np.ndarray) -> None:
    """Updates ``model`` by the documents of ``batch`` to learn from; adds to each cell's count of tokens that had it."""
    _, hashes, target = batch.prepared(model)
    learn = np.repeat(~batch.held, batch.sizes)
    hashes, target = hashes[:, learn], target[learn]
    scorer = Scorer(model)
    for a in range(0, len(target), MINI):
        many, slope = gradient(scorer, hashes[:, a : a + MINI], target[a : a + MINI])
        touched += many
        slope -= (DECAY * many.astype(np.float32))[:, None] * model.weights
        model.squares += np.einsum("ij,ij->i", slope, slope) / GROUPS
        slope *= (RATE / np.sqrt(model.squares + CALM))[:, None]
        model.weights += slope


def score_batch(model: Model, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document: known tokens, unigram score, model score (log10)."""
    classes, hashes, target = batch.prepared(model)
    inside = np.log((batch.counts + 1) / model.mass[classes])[batch.tokens]
    logs = np.empty(len(batch.tokens))
    scorer = Scorer(model)
    for a in range(0, len(logs), BLOCK):
        group, side = target[a : a + BLOCK] // SIDE, target[a : a + BLOCK] % SIDE
        x, y = scorer.logits(*cells(hashes[:, a : a + BLOCK], group), group)
        each = np.arange(len(x))
        own = x[each, group].astype(float) + y[each, side]
        logs[a : a + BLOCK] = own - np.log(np.exp(x).sum(1)) - np.log(np.exp(y).sum(1))
    base = np.log10((batch.counts + 1) / (model.total + model.kinds + 1))[batch.tokens]
    first = np.cumsum(batch.sizes) - batch.sizes
    known = (batch.counts > 0)[batch.tokens].astype(np.int64)
    sums = [np.add.reduceat(x, first) if len(first) else x for x in (known, base, (logs + inside) / np.log(10))]
    return sums[0], sums[1], sums[2]


def _rows(part: pa.RecordBatch) -> Iterator[Batch]:
    for i in range(part.num_rows):
        yield Batch.of(part.slice(i, 1).to_pylist()[0])


#: A range's part of an update: cells (2 bytes each), tokens that touched them (4), squared gradients gained (4), weights gained (2 each).
UPDATE = "part long, packed binary"


def _pack_update(cell: np.ndarray, touched: np.ndarray, squares: np.ndarray, gained: np.ndarray) -> bytes:
    head = np.array([len(cell)], "<u4").tobytes()
    return _press(head + cell.astype("<u2").tobytes() + touched.astype("<u4").tobytes() + squares.astype("<f4").tobytes() + gained.astype("<f2").T.tobytes())


def _open_update(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = _codec()[1].decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    cell, touched, squares = np.frombuffer(raw, "<u2", n, 4), np.frombuffer(raw, "<u4", n, 4 + 2 * n), np.frombuffer(raw, "<f4", n, 4 + 6 * n)
    return cell, touched, squares, np.frombuffer(raw, "<f2", n * GROUPS, 4 + 10 * n).reshape(GROUPS, n).T.astype(np.float32)


def update(table: DataFrame, model: Model) -> None:
    """One round: every task climbs from ``model`` over its batches of ``table``; what they gained is averaged cell by cell, by
    the tokens that touched it. As many numbers as the model has reach the driver, whatever the input's size."""
    span = CELLS // RANGES

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replace(model, weights=model.weights.copy(), squares=model.squares.copy())
        touched = np.zeros(CELLS, np.int64)
        for part in parts:
            for batch in _rows(part):
                climb(own, batch, touched)
        gained = own.weights - model.weights
        rows = []
        for k in range(RANGES):
            at = np.flatnonzero(touched[k * span : (k + 1) * span])
            if len(at):
                here = at + k * span
                rows.append((k, _pack_update(at, np.minimum(touched[here], 0xFFFFFFFF), own.squares[here] - model.squares[here], gained[here])))
        del own, gained
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["part", "packed"])

    def average(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for part in parts:
            for k, packed in zip(part.column("part").to_pylist(), part.column("packed").to_pylist()):
                if k not in sums:
                    sums[k] = np.zeros(span, np.int64), np.zeros(span), np.zeros((span, GROUPS))
                cell, touched, squares, gained = _open_update(packed)
                for total, x in zip(sums[k], (touched, squares, gained * touched[:, None])):
                    total[cell] += x
        rows = []
        for k, (touched, squares, gained) in sums.items():
            at = np.flatnonzero(touched)
            rows.append((k, _pack_update(at, np.minimum(touched[at], 0xFFFFFFFF), squares[at], gained[at] / touched[at, None])))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["part", "packed"])

    spark = table.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, shuffle_width(spark) // 2)
    for r in table.coalesce(tasks).mapInArrow(run, UPDATE).repartition(RANGES, "part").mapInArrow(average, UPDATE).collect():
        cell, _, squares, gained = _open_update(r["packed"])
        here = cell.astype(np.int64) + r["part"] * span
        model.squares[here] += squares
        model.weights[here] += gained


def prepare(docs: DataFrame) -> tuple[DataFrame, Model]:
    """Table of batches with the corpus counts of their words, in one part a round, and the model's classes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * shuffle_width(docs.sparkSession), int(size) // BUCKET)
    table = materialise(batches(docs, buckets), "batches")
    counts = materialise(word_counts(table, buckets), "counts")
    rows = counts.filter("kind = 1").groupBy("bin", "spread").agg(F.sum("words").alias("words"), F.sum("mass").alias("mass")).collect()
    model = make_classes([(r["bin"], r["spread"], r["words"], r["mass"]) for r in rows])
    back = counts.filter("kind = 0").groupBy("batch").agg(F.collect_list(F.struct("bucket", "packed")).alias("counts"))
    ready = table.drop("words").join(back, "batch").withColumn("round", F.pmod(F.xxhash64("batch"), F.lit(ROUNDS)).cast("int"))
    out = materialise(ready, "ready", by="round")
    discard(table, counts)
    return out, model


def train(table: DataFrame, model: Model) -> Model:
    for k in range(ROUNDS):
        update(table.filter(F.col("round") == k), model)
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    The model learns from rows whose crc32(doc_id as text) mod ``modulus`` isn't ``remainder`` and scores all; rows without a
    doc_id are held out. Tokens: the words (any characters but white space, U+0000 too), A-Z lower-cased, and one end. A null
    or empty text has the end alone; repeated rows count each and score alike; an empty table gives no rows. The trained
    weights depend, slightly, on how the batches fall into tasks; the counts and base_score don't.
    """
    held = F.coalesce(doc_remainder(F.col(id_col).cast("long"), modulus) == remainder, F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held"), F.col(text_col).alias("text"))
    table, model = prepare(rows)
    model = train(table, model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch in _rows(part):
                known, base, found = score_batch(model, batch)
                none = batch.doc_id == np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(batch.doc_id, mask=none), pa.array(batch.held), pa.array(batch.sizes), pa.array(known),
                        pa.array(np.full(len(known), model.total)), pa.array(base), pa.array(found),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
        trim()

    return table.drop("round").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
