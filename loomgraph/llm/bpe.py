"""Byte-level BPE: pre-tokenisation by scans over code point classes, then cached, batched pair merging.

Every code point gets a class; look-ahead is folded into the class (a blank that joins the next run, an apostrophe that
opens a contraction). What is left is a finite automaton of eight states, whose transition functions are composed
associatively: strips of the text run side by side from every state, the strips' functions are folded, and a second run
from the states thus known marks the token starts. No regular expression is involved.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

# Classes of code points, and the symbols made of them.
L, N, O, J, W, X, Q1, Q2, END = range(9)
# States: nothing open, in letters, in digits, in other signs, in white space, after a joining blank, 2 or 1 letters of a contraction to come.
S0, SL, SN, SO, SW, SJ, C2, C1 = range(8)

# White space beyond the category Z*, and the suffixes of contractions.
EXTRA_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85)
SUFFIX_1 = "stmd"
SUFFIX_2 = ("re", "ve", "ll")


@lru_cache(1)
def classes() -> np.ndarray:
    """L, N, O or W of every code point."""
    table = np.full(0x110000, O, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        if k[0] == "L":
            table[c] = L
        elif k[0] == "N":
            table[c] = N
        elif k[0] == "Z":
            table[c] = W
    table[list(EXTRA_SPACE)] = W
    return table


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a token starts here", by state and symbol."""
    after = np.zeros((8, 9), np.uint8)
    opens = np.ones((8, 9), bool)
    run = {L: SL, N: SN, O: SO, W: SW, X: S0, J: SJ, Q1: C1, Q2: C2, END: S0}
    for s in range(8):
        for y, to in run.items():
            after[s, y] = to
    for s, y in ((SL, L), (SN, N), (SO, O), (SW, W), (SJ, L), (SJ, N), (SJ, O)):
        opens[s, y] = False
    for s in (SO, SJ):  # an apostrophe within a run of signs opens nothing
        for y in (Q1, Q2):
            after[s, y], opens[s, y] = SO, False
    after[C2, L], opens[C2, L] = C1, False
    after[C1, L], opens[C1, L] = S0, False
    return after, opens


AFTER, OPENS = _automaton()
STEP = (AFTER.astype(np.uint8) | (OPENS.astype(np.uint8) << 4)).ravel()  # by state * 9 + symbol
NEXT = AFTER.ravel()


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """points: code points of texts, each followed by one filler, whose places are ``ends``."""
    sym = classes()[points]
    sym[ends] = END
    space = sym == W
    after_space = np.empty_like(space)
    after_space[:-1] = space[1:]
    after_space[-1] = False
    at_end = np.zeros_like(space)
    at_end[ends[ends > 0] - 1] = True
    last = space & ~after_space & ~at_end  # ends its run, and something follows
    sym[last] = X
    sym[last & (points == 0x20)] = J
    quote = np.flatnonzero((points == 0x27) & (sym == O))
    if len(quote):
        one = points[np.minimum(quote + 1, len(points) - 1)]
        two = points[np.minimum(quote + 2, len(points) - 1)]
        inside = sym[np.minimum(quote + 1, len(points) - 1)] != END
        short = inside & np.isin(one, [ord(c) for c in SUFFIX_1])
        long = np.zeros_like(short)
        for a, b in SUFFIX_2:
            long |= inside & (one == ord(a)) & (two == ord(b))
        sym[quote[short]] = Q1
        sym[quote[long & ~short]] = Q2
    return sym


def starts(sym: np.ndarray, strips: int = 2048) -> np.ndarray:
    """Where tokens start (END places too)."""
    n = len(sym)
    width = max(1, -(-n // strips))
    rows = -(-n // width)
    grid = np.full(rows * width, END, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)  # one line for each step
    funcs = np.repeat(np.arange(8, dtype=np.uint8)[None, :], rows, 0)
    for line in grid:
        funcs = NEXT[funcs.astype(np.intp) * 9 + line[:, None]]
    state = np.zeros(rows, np.uint8)
    for i, f in enumerate(funcs[:-1].tolist()):  # folds the strips' functions, from the first on
        state[i + 1] = f[state[i]]
    marks = np.empty((width, rows), bool)
    for i, line in enumerate(grid):
        step = STEP[state.astype(np.intp) * 9 + line]
        marks[i] = step >> 4
        state = step & 15
    return np.flatnonzero(marks.T.ravel()[:n])


class Numbered(dict):
    """Gives each new key the next number and remembers it in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key):
        self.fresh.append(key)
        self[key] = at = len(self)
        return at


LONG = 256  # bytes from which a word is merged by a heap: passes over it would grow with its square


class Merger:
    """Merges pairs of tokens by rank, many words at once, long ones each by a heap, and keeps what it has merged."""

    def __init__(self, single: np.ndarray, pairs: dict[tuple[int, int], tuple[int, int]], vocabulary: dict[bytes, int], whole: bool, kept: int = 400_000, kept_letters: int = 32 << 20):
        """single: id of each byte; pairs: (a, b) to (rank, id); whole: a word that is a token is that token."""
        self.single, self.vocabulary, self.whole, self.kept, self.kept_letters = single, vocabulary, whole, kept, kept_letters
        self.table: dict[int, int] = {}  # of pairs, filled when a long word comes
        keys = np.array([(a << 32) | b for a, b in pairs], np.uint64)
        vals = np.array([(r << 32) | t for r, t in pairs.values()], np.uint64)
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.vals = np.zeros(1 << self.bits, np.uint64)
        slots, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):  # open addressing, placed in rounds
            self.probes += 1
            free = self.keys[slots[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            put = left[free]
            self.keys[slots[put]] = keys[put]
            won = self.keys[slots[left]] == keys[left]
            self.vals[slots[left[won]]] = vals[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
        self.clear()

    def clear(self) -> None:
        self.index = Numbered()
        self.letters = 0
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 32 | id of each pair; the largest value if it doesn't merge."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        out = np.full(len(keys), np.uint64(0xFFFFFFFFFFFFFFFF))
        slot, left = self._slot(keys), np.arange(len(keys))
        for _ in range(self.probes):
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.vals[slot[left[hit]]]
            left = left[~hit & (there != np.uint64(0xFFFFFFFFFFFFFFFF))]
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids for each word, and the ids."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        done: dict[int, int] = {}
        if self.whole:
            done = {i: t for i, w in enumerate(words) if (t := self.vocabulary.get(w)) is not None}
        owner_out = [np.fromiter(done, np.int64, len(done))]
        ids_out = [np.fromiter(done.values(), np.uint32, len(done))]
        todo = []
        for i, w in enumerate(words):
            if i in done:
                continue
            if len(w) < LONG:
                todo.append(i)
            else:
                ids_out.append(self.merge_long(w))
                owner_out.append(np.full(len(ids_out[-1]), i, np.int64))
        flat = self.single[np.frombuffer(b"".join([words[i] for i in todo]), np.uint8)]
        owner = np.repeat(np.array(todo, np.int64), [len(words[i]) for i in todo])
        ranks = self._pairs(flat, owner)
        none = np.uint64(0xFFFFFFFFFFFFFFFF)
        while len(flat):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(ranks, first)
            size = np.diff(np.r_[first, len(flat)])
            ended = np.repeat(best == none, size)
            if ended.any():
                owner_out.append(owner[ended])
                ids_out.append(flat[ended].astype(np.uint32))
                flat, owner, ranks = flat[~ended], owner[~ended], ranks[~ended]
                best = best[best != none]
                if not len(flat):
                    break
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                size = np.diff(np.r_[first, len(flat)])
            hit = np.flatnonzero(ranks == np.repeat(best, size))
            hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]  # the leftmost of each word
            flat[hit] = (ranks[hit] & np.uint64(0xFFFFFFFF)).astype(flat.dtype)
            stay = np.ones(len(flat), bool)
            stay[hit + 1] = False
            place = (np.cumsum(stay) - 1)[hit]
            flat, owner, ranks = flat[stay], owner[stay], ranks[stay]
            near = np.r_[place, place[place > 0] - 1]
            near_next = np.minimum(near + 1, len(flat) - 1)
            fresh = self._rank(flat[near], flat[near_next])
            fresh[(near + 1 >= len(flat)) | (owner[near_next] != owner[near])] = none
            ranks[near] = fresh
        owners, ids = np.concatenate(owner_out), np.concatenate(ids_out)
        order = np.argsort(owners, kind="stable")
        return np.bincount(owners, minlength=len(words)), ids[order]

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word, in about n log n steps: a heap of (rank, place) over a linked list of tokens; entries that no longer
        hold are passed over."""
        if not self.table:
            there = self.keys != np.uint64(0xFFFFFFFFFFFFFFFF)
            self.table = dict(zip(self.keys[there].tolist(), self.vals[there].tolist()))
        flat = self.single[np.frombuffer(word, np.uint8)]
        n, none, low = len(flat), -1, 0xFFFFFFFF
        first = self._pairs(flat, np.zeros(n, np.int64))
        merges = first != np.uint64(0xFFFFFFFFFFFFFFFF)
        found = np.where(merges, first, 0).astype(np.int64)
        found[~merges] = none
        at = np.flatnonzero(merges)
        heap = np.sort((found[at] >> 32 << 32) | at).tolist()  # sorted is a heap
        value, ids = found.tolist(), flat.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, pop, push = self.table.get, heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i = entry & low
            v = value[i]
            if v < 0 or v >> 32 != entry >> 32:
                continue
            j = after[i]
            ids[i] = own = v & low
            value[j] = ids[j] = none
            after[i] = k = after[j]
            v = none
            if k < n:
                before[k] = i
                v = get(own << 32 | ids[k], none)
                if v >= 0:
                    push(heap, v >> 32 << 32 | i)
            value[i] = v
            k = before[i]
            if k >= 0:
                value[k] = v = get(ids[k] << 32 | own, none)
                if v >= 0:
                    push(heap, v >> 32 << 32 | k)
        return np.array([x for x in ids if x >= 0], np.uint32)

    def _pairs(self, flat: np.ndarray, owner: np.ndarray) -> np.ndarray:
        out = np.full(len(flat), np.uint64(0xFFFFFFFFFFFFFFFF))
        if len(flat) > 1:
            same = np.flatnonzero(owner[1:] == owner[:-1])
            out[same] = self._rank(flat[same], flat[same + 1])
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in one array, ids before each text, pieces before each text, and each piece's place in its text."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1) - 1
        marks = starts(symbols(points, ends))
        is_end = np.zeros(len(points), bool)
        is_end[ends] = True
        stops = np.r_[marks[1:], len(points)]
        real = ~is_end[marks]
        marks, stops = marks[real], stops[real]
        pieces = [joined[a:b] for a, b in zip(marks.tolist(), stops.tolist())]
        if len(self.index) > self.kept or self.letters > self.kept_letters:
            self.clear()
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        if fresh := self.index.fresh:
            lengths, ids = self.merge([p.encode("utf-8", "replace") for p in fresh])
            self.lengths, self.ids = np.r_[self.lengths, lengths], np.r_[self.ids, ids]
            self.before = np.r_[0, np.cumsum(self.lengths)]
            self.letters += sum(map(len, fresh))
            self.index.fresh = []
        counts = self.lengths[at] if len(at) else np.zeros(0, np.int64)
        total = np.r_[0, np.cumsum(counts)]
        ids = self.ids[np.repeat(self.before[at] - total[:-1], counts) + np.arange(total[-1])] if len(at) else np.zeros(0, np.uint32)
        first = np.searchsorted(marks, np.r_[0, ends + 1])
        begin = np.r_[0, ends[:-1] + 1]
        return ids, total[first], first, marks - np.repeat(begin, np.diff(first))


def _single(vocabulary: dict[bytes, int]) -> np.ndarray:
    return np.array([vocabulary[bytes([b])] for b in range(256)], np.int64)


@lru_cache(2)
def from_ranks(path: str) -> tuple[Merger, list[bytes]]:
    """Of a file of base64 tokens and their ranks; also the tokens by id."""
    with open(path, "rb") as f:
        vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pairs = {}
    for token, rank in vocabulary.items():
        for i in range(1, len(token)):
            a, b = vocabulary.get(token[:i]), vocabulary.get(token[i:])
            if a is not None and b is not None:
                pairs[a, b] = (rank, rank)
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, rank in vocabulary.items():
        tokens[rank] = token
    return Merger(_single(vocabulary), pairs, vocabulary, whole=True), tokens


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in tokenizer files: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def from_merges(path: str) -> tuple[Merger, tuple[str, ...]]:
    """Of a tokenizers file with a byte-level BPE; also the texts of its added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    ids = {k: v for k, v in spec["model"]["vocab"].items()}
    pairs = {}
    for rank, merge in enumerate(spec["model"]["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        pairs[ids[a], ids[b]] = (rank, ids[a + b])
    vocabulary = {bytes(letters[c] for c in k): v for k, v in ids.items() if all(c in letters for c in k)}
    return Merger(_single(vocabulary), pairs, vocabulary, whole=False), tuple(t["content"] for t in spec.get("added_tokens", []))


@lru_cache(2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_merges(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids as the file's own library gives them without special tokens added, and ids before each text.

    Texts that hold the string of an added token go to the library itself.
    """
    merger, added = from_merges(path)
    odd = {i for i, t in enumerate(texts) if any(a in t for a in added)}
    ids, before, _, _ = merger.encode(["" if i in odd else t for i, t in enumerate(texts)])
    if odd:
        parts = [np.array(library(path).encode(texts[i], add_special_tokens=False).ids, np.uint32) if i in odd else ids[before[i] : before[i + 1]] for i in range(len(texts))]
        ids, before = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
    return ids, before


def decode(tokens: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


ENCODED = "doc_id long, ids binary, piece_starts array<int>, n_tokens long"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, piece_starts, n_tokens): each text's ids, packed as little-endian unsigned 32-bit integers, and the offsets
    (code points) at which its pieces start. Null counts as empty: no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, _ = from_ranks(path)
        for part in blocks(batches, "text", 2 << 20):
            texts = [x or "" for x in part.column("text").to_pylist()]
            ids, before, first, at = merger.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(before[:-1].tolist(), before[1:].tolist())], pa.binary()),
                    pa.array([at[a:b].astype(np.int32) for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.list_(pa.int32())),
                    pa.array(np.diff(before), pa.int64()),
                ],
                ["doc_id", "ids", "piece_starts", "n_tokens"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text: encoded, then decoded from the ids.

    Null and empty texts have no tokens and the digests of nothing; repeated rows each give a row, and an empty table none.
    Equal ranks can't be: of pairs of one rank in a word the leftmost merges first. Long runs without a boundary (a line of
    base64, unspaced script) take n log n steps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, tokens = from_ranks(path)
        for part in blocks(batches, "text", 2 << 20):
            texts = [x or "" for x in part.column("text").to_pylist()]
            ids, before, _, _ = merger.encode(texts)
            cuts = list(zip(before[:-1].tolist(), before[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(before), pa.int64()),
                    pa.array([hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in cuts]),
                    pa.array([hashlib.sha256(decode(tokens, ids[a:b])).hexdigest() for a, b in cuts]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
