"""Secret scan: candidate strings by shape, false positives removed by a random forest.

The forest sees a candidate's length, its character transitions, how much of it the corpus's own letter trigrams cover,
the document's path and the neighbouring words. It is trained in numpy from labelled findings: those that are given, or else
simulated ones together with a bounded sample of the corpus's own candidates, labelled where the cues are plain.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, utf8

# The shape of candidates; words that name secrets, harmless identifiers, placeholders and harmless paths.
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_\-]{16,}(?:\.[A-Za-z0-9+/_\-]{10,})*={0,2}")
NAMED = re.compile(rb"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s*[:=]\s*[\"']([^\s\"']{8,})[\"']")
SECRET_WORDS = (b"token", b"secret", b"passwd", b"password", b"pwd", b"apikey", b"api_key", b"api-key", b"access_key", b"private_key", b"credential", b"auth", b"bearer")
HARMLESS_WORDS = (b"sha", b"md5", b"commit", b"checksum", b"digest", b"uuid", b"guid", b"hash", b"etag", b"revision", b"version", b"http", b"www", b"isbn", b"phone", b"card")
PLACEHOLDERS = (b"example", b"xxxx", b"your", b"changeme", b"placeholder", b"dummy", b"sample", b"0000", b"1234")
HARMLESS_PATHS = ("test", "example", "doc", "sample", "fixture")
MASK = b"[SECRET]"
CORPUS_FINDINGS = 2000  # the corpus's candidates that the forest learns from, at most: a documented bound

LETTER = np.zeros(256, np.int64)
LETTER[97:123] = LETTER[65:91] = np.arange(1, 27)
KIND = np.full(256, 3, np.int64)  # lower, upper, digit, other
KIND[97:123], KIND[65:91], KIND[48:58] = 0, 1, 2
TRIGRAMS = 27**3
REACH = 40  # bytes of context on either side


def trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all documents (column text); 27 ** 3 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TRIGRAMS, np.int64)
        for part in blocks(batches, "text", 8 << 20):
            c = LETTER[np.frombuffer(b" ".join(utf8(part.column("text"))), np.uint8)]
            if len(c) > 2:
                total += np.bincount((c[:-2] * 27 + c[1:-1]) * 27 + c[2:], minlength=TRIGRAMS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    out = np.zeros(TRIGRAMS, np.int64)
    for r in docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def _lettered() -> np.ndarray:
    c = np.arange(TRIGRAMS)
    return (c % 27 > 0) & (c // 27 % 27 > 0) & (c // 729 > 0)


@dataclass(frozen=True)
class Finding:
    value: bytes
    before: bytes
    after: bytes
    path: str


def spans(text: bytes) -> list[tuple[int, int]]:
    """Where candidates stand: strings of the shape above, and shorter values that a name of secrets is given in quotes."""
    out = [m.span() for m in CANDIDATE.finditer(text)]
    ends = [b for _, b in out]
    for m in NAMED.finditer(text):
        a, b = m.span(1)
        k = bisect_right(ends, a)
        if k == len(out) or out[k][0] >= b:
            out.insert(k, (a, b))
            ends.insert(k, b)
    return out


def finding(text: bytes, a: int, b: int, path: str) -> Finding:
    return Finding(text[a:b], text[max(0, a - REACH) : a], text[b : b + REACH], path)


def weak_label(f: Finding) -> int:
    """1 for a random-looking string that a name of secrets is given; 0 for one without such a name that reads as a word, a number,
    an address or a digest; -1 where the cues are mixed."""
    low, left, near = f.value.lower(), f.before.lower(), (f.before + b" " + f.after).lower()
    raw = np.frombuffer(f.value, np.uint8)
    p = np.bincount(raw)
    p = p[p > 0] / len(raw)
    named = any(w in left for w in SECRET_WORDS) and f.before.rstrip(b"\"'` \t")[-1:] in (b"=", b":")
    doubtful = any(w in low or w in near for w in PLACEHOLDERS)
    if named and not doubtful and -(p * np.log2(p)).sum() > 3.2 and len(set(KIND[raw].tolist())) > 1:
        return 1
    plain = f.value.isalpha() or f.value.isdigit() or b"/" in f.value or b"_" in f.value or any(w in near for w in HARMLESS_WORDS)
    return 0 if plain and not any(w in left for w in SECRET_WORDS) else -1


def corpus_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", most: int = CORPUS_FINDINGS) -> tuple[list[Finding], np.ndarray]:
    """Candidates of ``docs`` with plain cues and their labels; of each label and cell of a hash the smallest, ``most`` / 2 cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 4 << 20):
            rows = []
            for t, path in zip(utf8(part.column("text")), part.column("path").to_pylist()):
                for a, b in spans(t):
                    f = finding(t, a, b, path or "")
                    if (label := weak_label(f)) >= 0:
                        rows.append((f.value[:400], f.before, f.after, f.path, label))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.int64()))], ["value", "before", "after", "path", "label"])

    rows = docs.select(F.col(text_col).alias("text"), _path(docs, path_col)).mapInArrow(run, "value binary, before binary, after binary, path string, label long")
    mixed = F.xxhash64("value", "before", "after")
    cells = rows.groupBy("label", F.pmod(mixed, F.lit(most // 2)).alias("cell")).agg(F.min(F.struct(mixed.alias("h"), "value", "before", "after", "path")).alias("f"))
    found = sorted(cells.collect(), key=lambda r: (r["label"], r["cell"]))
    return [Finding(bytes(r["f"]["value"]), bytes(r["f"]["before"]), bytes(r["f"]["after"]), r["f"]["path"]) for r in found], np.array([r["label"] for r in found], np.int64)


def _path(docs: DataFrame, path_col: str) -> Column:
    """The path's column; empty where there is none."""
    return (F.col(path_col).cast("string") if path_col in docs.columns else F.lit("")).alias("path")


def features(found: list[Finding], logs: np.ndarray) -> np.ndarray:
    """One line for each finding; logs: log10 share of each trigram."""
    out = np.zeros((len(found), 20), np.float32)
    for i, f in enumerate(found):
        raw = np.frombuffer(f.value, np.uint8)
        n, kind, letter = len(raw), KIND[raw], LETTER[raw]
        share = np.bincount(kind, minlength=4) / n
        counts = np.bincount(raw)
        p = counts[counts > 0] / n
        tri = (letter[:-2] * 27 + letter[1:-1]) * 27 + letter[2:]
        spelled = (letter[:-2] > 0) & (letter[1:-1] > 0) & (letter[2:] > 0)
        known = spelled & (logs[tri] > -4.3)
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : n - 2 + k] |= known
        turns = np.flatnonzero(kind[1:] != kind[:-1])
        low, near = f.value.lower(), (f.before + b" " + f.after).lower()
        left = f.before.lower()
        quote = f.before[-1:] in (b'"', b"'", b"`")
        out[i] = (
            n, share[0], share[1], share[2], share[3], len(turns) / n, np.diff(np.r_[-1, turns, n - 1]).max(), -(p * np.log2(p)).sum(),
            cover.mean(), logs[tri][spelled].mean() if spelled.any() else -9.0, not set(low) - set(b"0123456789abcdef"), n in (32, 40, 64),
            any(w in left for w in SECRET_WORDS), any(w in near for w in HARMLESS_WORDS), any(w in low or w in near for w in PLACEHOLDERS),
            f.before.rstrip(b"\"'` \t")[-1:] in (b"=", b":"), quote and f.after[:1] == f.before[-1:], f.before[-1:] in (b"/", b"@", b".") or f.after[:1] in (b"/", b"@", b"."),
            any(w in f.path.lower() for w in HARMLESS_PATHS), bool(re.fullmatch(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", f.value)),
        )
    return out


KINDS = ("words", "capitals", "numbers", "digests", "uuids", "placeholders", "paths", "identifiers", "keys", "unnamed keys", "passwords")


def simulated_findings(counts: np.ndarray, n: int = 3000, seed: int = 11) -> tuple[list[Finding], np.ndarray, np.ndarray]:
    """Labelled findings to start from where none are at hand, and their kinds (places in KINDS): random keys and passwords named
    as secrets, and what is often mistaken for them.

    Words are drawn from the corpus's trigrams, so that the harmless long strings look like its own.
    """
    rng = np.random.default_rng(seed)
    weight = np.where(_lettered(), counts, 0).reshape(729, 27).astype(float) + 1e-6
    weight[:, 0] = 0
    weight /= weight.sum(1, keepdims=True)
    begin = np.where(_lettered(), counts, 0).reshape(729, 27).sum(1) + 1e-6
    begin[[a * 27 + b for a in range(27) for b in range(27) if not a * b]] = 0
    begin = begin / begin.sum()

    def word(low: int, high: int) -> bytes:
        state = int(rng.choice(729, p=begin))
        letters = [state // 27, state % 27]
        for _ in range(int(rng.integers(low, high)) - 2):
            letters.append(int(rng.choice(27, p=weight[letters[-2] * 27 + letters[-1]])))
        return bytes(96 + c for c in letters)

    def drawn(alphabet: bytes, size: int) -> bytes:
        return bytes(alphabet[k] for k in rng.integers(0, len(alphabet), size))

    hexes, digits = b"0123456789abcdef", b"0123456789"
    mixed = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    names = [b"token", b"TOKEN", b"secret", b"password", b"api_key", b"API_KEY", b"access_key", b"auth_token", b"passwd", b"client_secret"]
    ties = [b' = "', b'="', b": ", b" = '", b"=", b': "']
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    found, labels, kinds = [], [], []
    for i in range(n):
        words, tail = word(3, 9) + b" " + word(3, 9) + b" ", b" " + word(3, 9)
        path = pick(["src", "lib/app.py", "config", "site", "tests/x", "docs/readme"])
        if i % 2 == 0:
            if i % 10 == 0:  # a password
                value = drawn(mixed + b"!@#%^&*-_", int(rng.integers(8, 16)))
                tie = pick([t for t in ties if t[-1:] in b"\"'"])
                found.append(Finding(value, (words + pick([b"password", b"passwd", b"pwd", b"db_password"]) + tie)[-REACH:], tie[-1:] + tail, path))
                labels.append(1), kinds.append(10)
                continue
            value = drawn(pick([hexes, hexes, hexes.upper(), mixed, mixed + b"+/"]), int(pick([20, 24, 32, 36, 40, 40, 40, 64])))
            tie = pick(ties)
            bare = rng.random() >= 0.92
            before = words + (b"" if bare else pick(names) + tie)
            found.append(Finding(value, before[-REACH:], (tie[-1:] if tie[-1:] in b"\"'" else b"") + tail, path))
            labels.append(1), kinds.append(9 if bare else 8)
            continue
        kind = int(rng.integers(8))
        before, after = words, tail
        if kind == 0:
            value = word(16, 34)
        elif kind == 1:
            value = word(16, 34).upper()
        elif kind == 2:
            value, before = drawn(digits, int(rng.integers(16, 21))), pick([words, words + b"card "])
        elif kind == 3:
            value, before = drawn(hexes, int(pick([32, 40, 64]))), words + pick([b"sha256:", b"commit ", b"md5 ", b"checksum: ", b"etag: ", b"revision "])
        elif kind == 4:
            u = drawn(hexes, 32)
            value, before = b"-".join([u[:8], u[8:12], u[12:16], u[16:20], u[20:]]), words + pick([b"uuid ", b"id=", b""])
        elif kind == 5:
            value, before = pick([b"your_api_key_goes_here", b"xxxxxxxxxxxxxxxxxxxxxxxx", b"EXAMPLE_TOKEN_1234567890", b"changeme-changeme-changeme", b"0000000000000000000000", b"changeme", b"your_password", b"password123"]), words + pick(names) + pick(ties)
        elif kind == 6:
            value, before = b"/".join(word(3, 9) for _ in range(4)), words + pick([b"http:/", b"see ", b""])
        else:
            value = b"_".join(word(4, 9) for _ in range(3)) + (drawn(digits, 2) if rng.random() < 0.3 else b"")
            before = words + pick([b"", b"key = ", b"def "])
        if len(value) >= 16 or kind == 5:
            found.append(Finding(value, before[-REACH:], after, path))
            labels.append(0), kinds.append(kind)
    return found, np.array(labels), np.array(kinds)


class Forest:
    """Random forest of binary trees; a tree is four arrays: feature, threshold, left child (the right one follows), share of secrets."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 8, least: int = 3, seed: int = 5) -> Forest:
        rng, grown = np.random.default_rng(seed), []
        tries = max(1, int(np.sqrt(x.shape[1])) + 2)
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            feature, threshold, child, share = [-1], [0.0], [0], [float(y[rows].mean())]
            todo = [(0, rows, 0)]
            while todo:
                at, own, level = todo.pop()
                target = y[own]
                if level == depth or len(own) < 2 * least or target.min() == target.max():
                    continue
                best = (target.var() * len(own) - 1e-9, -1, 0.0)
                for f in rng.permutation(x.shape[1])[:tries].tolist():
                    values = x[own, f]
                    for cut in np.unique(np.quantile(values, np.linspace(0.05, 0.95, 12), method="lower")).tolist():
                        left = values <= cut
                        k = int(left.sum())
                        if least <= k <= len(own) - least:
                            score = target[left].var() * k + target[~left].var() * (len(own) - k)
                            if score < best[0]:
                                best = (score, f, cut)
                if best[1] < 0:
                    continue
                left = x[own, best[1]] <= best[2]
                feature[at], threshold[at], child[at] = best[1], best[2], len(feature)
                for part in (own[left], own[~left]):
                    feature.append(-1), threshold.append(0.0), child.append(0), share.append(float(y[part].mean()))
                todo += [(child[at], own[left], level + 1), (child[at] + 1, own[~left], level + 1)]
            grown.append((np.array(feature), np.array(threshold, np.float32), np.array(child), np.array(share)))
        return cls(grown)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, threshold, child, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[at]
                at = np.where(inner, child[at] + right, at)
            out += share[at]
        return out / max(len(self.trees), 1)


@dataclass(frozen=True)
class Scanner:
    forest: Forest
    logs: np.ndarray
    least: float

    def scan(self, texts: list[bytes], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first byte, end and score of every candidate."""
        where, found = [], []
        for i, t in enumerate(texts):
            for a, b in spans(t):
                where.append((i, a, b))
                found.append(finding(t, a, b, paths[i]))
        place = np.array(where, np.int64).reshape(-1, 3)
        score = self.forest.predict(features(found, self.logs)) if found else np.zeros(0)
        return place[:, 0], place[:, 1], place[:, 2], score


def train(docs: DataFrame, labelled: tuple[list[Finding], np.ndarray] | None = None, least: float = 0.5, text_col: str = "text", path_col: str = "source") -> Scanner:
    """A scanner for these documents; labelled: findings and their labels (1: a secret). Without any, simulated ones and the
    corpus's own with plain cues; an empty table leaves the simulated ones."""
    counts = trigrams(docs.select(F.col(text_col).alias("text")))
    logs = np.log10((np.where(_lettered(), counts, 0) + 0.5) / (counts[_lettered()].sum() + 1))
    if labelled is None:
        found, labels, _ = simulated_findings(counts)
        own, own_labels = corpus_findings(docs, text_col=text_col, path_col=path_col)
        labelled = [*found, *own], np.r_[labels, own_labels]
    return Scanner(Forest.fit(features(labelled[0], logs), labelled[1]), logs.astype(np.float32), least)


def by_kind(scanner: Scanner, found: list[Finding], labels: np.ndarray, kinds: np.ndarray) -> dict[str, tuple[int, float]]:
    """For each kind of labelled findings how many there are and the share that the forest tells rightly: recall of secrets, and of
    the others the share that stays out (precision follows from both)."""
    said = scanner.forest.predict(features(found, scanner.logs)) >= scanner.least
    return {KINDS[k]: (int((kinds == k).sum()), float((said == labels.astype(bool))[kinds == k].mean())) for k in np.unique(kinds).tolist()}


def findings(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, start, length, value, score, secret): every candidate string of every whole text, start in code points.

    secret: the forest's verdict, at a share of ``least`` trees or more. Null and empty texts have none; a path that is null or
    isn't there is empty; repeated rows are each scanned; an empty table gives no rows.
    """
    scanner = scanner or train(docs, text_col=text_col, path_col=path_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 4 << 20):
            texts = utf8(part.column("text"))
            doc, a, b, score = scanner.scan(texts, [x or "" for x in part.column("path").to_pylist()])
            spans = list(zip(doc.tolist(), a.tolist(), b.tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(doc)),
                    pa.array([len(texts[i][:p].decode()) for i, p, _ in spans], pa.int64()),
                    pa.array(b - a),
                    pa.array([texts[i][p:q].decode() for i, p, q in spans], pa.string()),
                    pa.array(score),
                    pa.array(score >= scanner.least),
                ],
                ["doc_id", "start", "length", "value", "score", "secret"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _path(docs, path_col))
    return rows.mapInArrow(run, "doc_id long, start long, length long, value string, score double, secret boolean")


def redact(docs: DataFrame, scanner: Scanner | None = None, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``docs`` with every secret in its texts replaced by ``[SECRET]``; all rows and columns stay, a null text stays null.
    Repeated rows are treated alike; a path column needn't be there; an empty table stays empty."""
    scanner = scanner or train(docs, text_col=text_col, path_col=path_col)
    at, has_path = docs.columns.index(text_col), path_col in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text_col, 4 << 20):
            raw = part.column(text_col).cast(pa.binary()).to_pylist()
            paths = [str(x or "") for x in part.column(path_col).to_pylist()] if has_path else [""] * part.num_rows
            doc, a, b, score = scanner.scan([x or b"" for x in raw], paths)
            hit = np.flatnonzero(score >= scanner.least)
            for i, p, q in reversed(list(zip(doc[hit].tolist(), a[hit].tolist(), b[hit].tolist()))):
                raw[i] = raw[i][:p] + MASK + raw[i][q:]
            yield part.set_column(at, part.schema.field(at), pa.array(raw, pa.binary()).cast(part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
