"""Language identification by a bidirectional gated recurrent network over bytes.

Every position of a text gets a distribution over the languages, and a document's is the mean over its letters. The network
is trained in numpy by backpropagation through time. Long texts are cut into windows that overlap by ``CONTEXT`` bytes on
either side and run side by side; no byte is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, doc_remainder, utf8

HIDDEN = 8
WINDOW, CONTEXT = 240, 12  # bytes that a window labels, and those around them
SNIPPET = 200  # characters of a training sample
PER_LANGUAGE = 600  # training samples of a language, at most: documented bound on what the classifier learns from

#: Bytes that count as letters: ASCII letters and all of multi-byte characters.
IS_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
#: The case of ASCII letters is left out.
FOLD = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, x)
    np.exp(x, x)
    x += 1
    return np.reciprocal(x, x)


class Direction:
    """One gated recurrent layer; weights: input (256 x 3h), recurrent (h x 2h and h x h)."""

    def __init__(self, table: np.ndarray, gates: np.ndarray, cand: np.ndarray):
        self.table, self.gates, self.cand = table, gates, cand

    @classmethod
    def random(cls, hidden: int, rng: np.random.Generator) -> Direction:
        table = rng.normal(0, 0.4, (256, 3 * hidden)).astype(np.float32)
        return cls(table, *(rng.normal(0, 1 / np.sqrt(hidden), (hidden, k * hidden)).astype(np.float32) for k in (2, 1)))

    def states(self, steps: np.ndarray) -> np.ndarray:
        """steps: bytes, time x batch; the state after every step, time x batch x h."""
        h = len(self.cand)
        state = np.zeros((steps.shape[1], h), np.float32)
        out = np.empty((*steps.shape, h), np.float32)
        for t, column in enumerate(steps):
            x = self.table[column]
            g = _sigmoid(x[:, : 2 * h] + state @ self.gates)
            n = np.tanh(x[:, 2 * h :] + (g[:, h:] * state) @ self.cand)
            state = n + g[:, :h] * (state - n)
            out[t] = state
        return out

    def trace(self, steps: np.ndarray) -> tuple[np.ndarray, list]:
        h = len(self.cand)
        state = np.zeros((steps.shape[1], h), np.float32)
        out, kept = np.empty((*steps.shape, h), np.float32), []
        for t, column in enumerate(steps):
            x = self.table[column]
            g = _sigmoid(x[:, : 2 * h] + state @ self.gates)
            n = np.tanh(x[:, 2 * h :] + (g[:, h:] * state) @ self.cand)
            kept.append((state, g, n))
            state = n + g[:, :h] * (state - n)
            out[t] = state
        return out, kept

    def back(self, steps: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of table, gates and cand, given that of every state."""
        h = len(self.cand)
        table, gates, cand = np.zeros_like(self.table), np.zeros_like(self.gates), np.zeros_like(self.cand)
        carry = np.zeros_like(grad[0])
        for t in range(len(steps) - 1, -1, -1):
            state, g, n = kept[t]
            z, r = g[:, :h], g[:, h:]
            d = grad[t] + carry
            dn = d * (1 - z) * (1 - n * n)
            inner = dn @ self.cand.T
            dz = d * (state - n) * z * (1 - z)
            dr = inner * state * r * (1 - r)
            dg = np.concatenate([dz, dr], 1)
            carry = d * z + inner * r + dg @ self.gates.T
            cand += (r * state).T @ dn
            gates += state.T @ dg
            np.add.at(table, steps[t], np.concatenate([dg, dn], 1))
        return table, gates, cand


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    top: np.ndarray  # 2h x languages
    bias: np.ndarray

    def label(self, steps: np.ndarray) -> np.ndarray:
        """Distribution over the languages at every position; steps: time x batch."""
        h = len(self.forward.cand)
        logits = self.forward.states(steps).reshape(-1, h) @ self.top[:h]
        logits += self.backward.states(steps[::-1])[::-1].reshape(-1, h) @ self.top[h:]
        logits += self.bias
        np.exp(logits - logits.max(1, keepdims=True), logits)
        return (logits / logits.sum(1, keepdims=True)).reshape(*steps.shape, -1)

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean distribution over the letters of each text; zeros where there are none."""
        total, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(b"\0" * CONTEXT + (b"\0" * CONTEXT).join(texts) + b"\0" * (WINDOW + CONTEXT), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = CONTEXT + np.r_[0, np.cumsum(sizes + CONTEXT)[:-1]] if len(texts) else sizes
        cuts = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), cuts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = begin[owner] + nth * WINDOW
        stop = np.minimum(start + WINDOW, (begin + sizes)[owner])
        folded = FOLD[raw]
        order = np.argsort(stop - start, kind="stable")  # windows of like length side by side
        for part in np.array_split(order, max(1, -(-len(order) // 2048))):
            if not len(part):
                continue
            span = int((stop - start)[part].max())
            at = start[part] + np.arange(-CONTEXT, span + CONTEXT)[:, None]
            at = np.minimum(at, len(raw) - 1)
            own = (at >= start[part]) & (at < stop[part])
            # what lies before or after the text is another's
            inside = (at >= begin[owner[part]]) & (at < (begin + sizes)[owner[part]])
            chance = self.label(np.where(inside, folded[at], 0))
            use = own & IS_LETTER[raw[at]]
            np.add.at(total, owner[part], np.einsum("tbl,tb->bl", chance, use.astype(np.float32)))
            np.add.at(letters, owner[part], use.sum(0))
        return total / np.maximum(letters, 1)[:, None]


def train(samples: list[tuple[str, bytes]], rounds: int = 260, batch: int = 160, steps: int = 72, seed: int = 3, hidden: int = HIDDEN) -> Network:
    """Adam on the cross-entropy of every letter's label; samples: (language, bytes)."""
    rng = np.random.default_rng(seed)
    languages = sorted({k for k, _ in samples})
    forward, backward = Direction.random(hidden, rng), Direction.random(hidden, rng)
    net = Network(languages, forward, backward, rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    if not samples:
        return net
    by = [[t for k, t in samples if k == language] for language in languages]
    weights = [forward.table, forward.gates, forward.cand, backward.table, backward.gates, backward.cand, net.top, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for i in range(rounds):
        target = rng.integers(0, len(languages), batch)  # languages evenly
        x = np.zeros((steps, batch), np.uint8)
        for b, k in enumerate(target.tolist()):
            t = by[k][int(rng.integers(len(by[k])))]
            a = int(rng.integers(0, max(1, len(t) - steps + 1)))
            piece = np.frombuffer(t[a : a + steps], np.uint8)
            x[: len(piece), b] = piece
        mask = IS_LETTER[x].astype(np.float32)
        x = FOLD[x]
        fs, fk = forward.trace(x)
        bs, bk = backward.trace(x[::-1])
        both = np.concatenate([fs, bs[::-1]], 2)
        logits = both @ net.top + net.bias
        chance = np.exp(logits - logits.max(2, keepdims=True))
        chance /= chance.sum(2, keepdims=True)
        chance[:, np.arange(batch), target] -= 1
        chance *= mask[:, :, None] / max(mask.sum(), 1)
        d = chance @ net.top.T
        grads = [
            *forward.back(x, fk, d[:, :, :hidden]),
            *backward.back(x[::-1], bk, d[::-1, :, hidden:]),
            both.reshape(-1, 2 * hidden).T @ chance.reshape(-1, len(languages)),
            chance.sum((0, 1)),
        ]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1, (i + 1) / 20) * (1 - 0.9 * i / rounds)
        for w, g, m, v in zip(weights, grads, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** (i + 1))) / (np.sqrt(v / (1 - 0.99 ** (i + 1))) + 1e-8)
    return net


def samples(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """At most ``per_language`` snippets of SNIPPET characters of each language, from anywhere in the texts (columns doc_id, text, lang).

    Each of as many cells takes the row with the smallest hash, so that no task sees more than its cells.
    """
    known = docs.filter("lang is not null and text is not null and text != ''")
    mixed = F.xxhash64(F.col("doc_id"), F.lit(99))
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - SNIPPET, F.lit(1))).cast("int") + 1
    rows = known.select("lang", F.pmod(mixed, F.lit(per_language)).alias("cell"), F.struct(mixed.alias("order"), F.substring("text", at, F.lit(SNIPPET)).alias("text")).alias("s"))
    found = rows.groupBy("lang", "cell").agg(F.min("s").alias("s")).select("lang", "cell", "s.text").collect()
    return [(r["lang"], r["text"].encode()) for r in sorted(found, key=lambda r: (r["lang"], r["cell"]))]


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text; ``und`` with score 0 if it is null, has no letter, or no language was learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 3 << 20):
            raw = utf8(part.column("text"))
            chance = net.pool(raw) if net.languages else np.zeros((len(raw), 1))
            best, score = chance.argmax(1), chance.max(1)
            lettered = [any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in raw]
            names = [net.languages[k] if ok and s > 0 else "und" for k, ok, s in zip(best.tolist(), lettered, score.tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names, pa.string()), pa.array([min(s, 1.0) if n != "und" else 0.0 for n, s in zip(names, score.tolist())], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    It learns from rows whose crc32(doc_id as text) mod 3 is not 1 and whose language is known; rows of remainder 1 are held out,
    as are those without a doc_id. A null text, or one without a letter, is ``und``; of equal shares the first language by name
    wins; repeated rows are labelled alike; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    net = train(samples(rows.filter(doc_remainder(F.col("doc_id"), 3) != 1)))
    found = predict(rows, net)
    return found.select("doc_id", F.coalesce(doc_remainder(F.col("doc_id"), 3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score")
