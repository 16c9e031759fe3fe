"""Document quality by weak supervision.

Rules vote for or against a text, or abstain. Their accuracies, for good and for bad texts, come from expectation
maximisation over the counts of all vote patterns (at most 3 to the number of rules, however many documents there are);
the posterior probability of a good text decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Numbered
from .common import blocks, materialise, utf8

# Characters that count as symbols, and the white space that separates words.
SYMBOLS = "#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
TERMINAL = (b".", b"!", b"?", b":", b";", b'"', b"'", b")")
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Letters (and all beyond ASCII) to a, digits to 0, white space to a blank, all else to a full stop.
SHAPE = bytes(97 if chr(b).isalpha() or b > 127 else 48 if 48 <= b < 58 else 32 if b in SPACES else 46 for b in range(256))

#: Rules: (name, statistic, good from, good to, bad below, bad above); None: never.
RULES = (
    ("symbols", "symbol_rate", 0.0, 0.02, None, 0.10),
    ("repetition", "repeat_rate", 0.0, 0.10, None, 0.30),
    ("duplicate lines", "dup_line_rate", 0.0, 0.05, None, 0.30),
    ("capitals", "upper_rate", 0.0, 0.15, None, 0.40),
    ("word length", "word_length", 3.0, 9.0, 2.2, 14.0),
    ("exclamations", "shout_rate", 0.0, 0.02, None, 0.15),
    ("sentences", "stop_rate", 0.30, None, 0.05, None),
    ("letters", "letter_rate", 0.85, None, 0.70, None),
    ("signs for words", "sign_word_rate", 0.0, 0.03, None, 0.15),
    ("signs at words", "sign_rate", 0.0, 0.25, None, 0.60),
)

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[list[bytes]], window: int = 3) -> np.ndarray:
    """For each text, the words covered by windows that occur in it twice or more."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    index = Numbered()
    flat = np.fromiter((index[w] for t in words for w in t), np.int64, int(counts.sum()))
    doc = np.repeat(np.arange(len(words)), counts)
    n = len(flat) - window + 1
    if n < 1:
        return np.zeros(len(words), np.int64)
    keys = [flat[k : k + n] for k in range(window)]
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
    order = inside[np.lexsort([k[inside] for k in keys] + [doc[inside]])]
    same = doc[order[1:]] == doc[order[:-1]]
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    twice = np.r_[False, same] | np.r_[same, False]
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, order[twice[: len(order)]], 1)
    np.add.at(edge, order[twice[: len(order)]] + window, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=len(words))


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of STATS and the rates that rules look at."""
    words = [t.split() for t in texts]
    out = {"n_repeat_words": repeated_words(words), "n_words": np.fromiter(map(len, words), np.int64, len(words))}
    rows = []
    for t in texts:
        plain = t.decode("utf-8", "replace")
        seen: set[bytes] = set()
        lines = twice = stops = 0
        for line in t.split(b"\n"):
            if line.strip(SPACES):
                lines += 1
                stops += line.rstrip(SPACES).endswith(TERMINAL)
                if line in seen:
                    twice += 1
                seen.add(line)
        inked = len(plain) - (len(t) - len(t.translate(None, SPACES)))
        upper, lower = len(t) - len(t.translate(None, UPPER)), len(t) - len(t.translate(None, LOWER))
        beyond = len(plain) - len(plain.encode("ascii", "ignore"))
        shape = t.translate(SHAPE)
        signs = sum(b"a" not in w and b"0" not in w for w in shape.split()) if b"." in shape else 0
        rows.append((inked, sum(plain.count(c) for c in SYMBOLS), twice, lines, stops, upper, lower, beyond, t.count(b"!"), signs, shape.count(b".")))
    c = np.array(rows, np.int64).reshape(-1, 11).T
    out |= {"word_chars": c[0], "n_symbols": c[1], "n_dup_lines": c[2]}
    some = np.maximum(out["n_words"], 1)
    out |= {
        "symbol_rate": c[1] / some,
        "repeat_rate": out["n_repeat_words"] / some,
        "dup_line_rate": c[2] / np.maximum(c[3], 1),
        "upper_rate": c[5] / np.maximum(c[5] + c[6], 1),
        "word_length": c[0] / some,
        "shout_rate": c[8] / some,
        "stop_rate": c[4] / np.maximum(c[3], 1),
        "sign_word_rate": c[9] / some,
        "sign_rate": c[10] / some,
        "letter_rate": (c[5] + c[6] + c[7]) / np.maximum(c[0], 1),
    }
    return out


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """1 for good, -1 for bad, 0 where a rule abstains; a text without words gets no votes."""
    out = np.zeros((len(stats["n_words"]), len(RULES)), np.int8)
    for j, (_, name, low, high, below, above) in enumerate(RULES):
        x = stats[name]
        good = (x >= low) & (x <= high if high is not None else True)
        bad = np.zeros(len(x), bool)
        if below is not None:
            bad |= x < below
        if above is not None:
            bad |= x > above
        out[:, j] = np.where(bad, -1, np.where(good, 1, 0))
    out[stats["n_words"] == 0] = 0
    return out


def patterns(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1]))


def unpack(pattern: np.ndarray, rules: int) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(rules)) % 3 - 1


#: One-sided prior: rules seldom speak against a good text; at this rate in as many made-up good texts as there are texts.
FALSE_ALARM = 0.001


@dataclass(frozen=True)
class Fit:
    """Posterior of a good text for each pattern; for each rule the chances of a vote against a good and a bad text; the share of
    good texts."""

    good: np.ndarray
    against: np.ndarray
    share: float


def fit(pattern: np.ndarray, count: np.ndarray, rules: int, rounds: int = 500) -> Fit:
    """EM over the counts of vote patterns.

    Bad texts are of many kinds, each known to a rule or two, so that votes for a text say little about its kind and one
    vote against it may say much; how much, follows from the chances, which are all estimated: against good texts under the
    prior above, against bad ones freely (half a vote of each kind added). A rule is never taken to be worse than chance; that
    keeps the two classes from changing places. It starts from texts with a vote against them as mostly bad.
    """
    v = unpack(pattern, rules)
    is_vote = np.stack([v < 0, v > 0], 2).astype(float)  # pattern x rule x vote; who abstains says nothing
    good = np.where((v < 0).any(1), 0.1, np.where((v > 0).sum(1) * 2 > rules, 0.95, 0.5))
    total = float(count.sum())
    made_up = np.array([[FALSE_ALARM * total + 0.5, (1 - FALSE_ALARM) * total + 0.5], [0.5, 0.5]])
    against, share = np.zeros((2, rules)), 0.5
    for _ in range(rounds if len(v) else 0):
        w = np.stack([count * good, count * (1 - good)])
        share = float((w[0].sum() + 1) / (total + 2))
        n = np.einsum("yp,prv->yrv", w, is_vote) + made_up[:, None]
        against = n[:, :, 0] / n.sum(2)
        against[1] = np.maximum(against[1], against[0])
        says = np.stack([np.log(against[0] / against[1]), np.log((1 - against[0]) / (1 - against[1]))], 1)
        odds = np.log(share / (1 - share)) + np.einsum("prv,rv->p", is_vote, says)
        fresh = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(fresh - good).max() < 1e-9
        good = fresh
        if done:
            break
    return Fit(good, against, share)


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", pattern long"


def vote_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the counts of STATS, pattern): every row's whole text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 4 << 20):
            stats = statistics(utf8(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(stats[c].astype(np.int64)) for c in STATS), pa.array(patterns(votes(stats)))], ["doc_id", *STATS, "pattern"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def estimate(table: DataFrame) -> tuple[np.ndarray, np.ndarray, Fit]:
    """Vote patterns, their counts and what EM makes of them; fewer than 3 ** len(RULES) patterns reach the driver."""
    rows = table.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    pattern, count = (np.array([r[c] for r in rows], np.int64) for c in ("pattern", "n"))
    return pattern, count, fit(pattern, count, len(RULES))


def posteriors(table: DataFrame) -> dict[int, float]:
    """Posterior by vote pattern."""
    pattern, _, found = estimate(table)
    return dict(zip(pattern.tolist(), found.good.tolist()))


def accuracies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rule, false_alarm, hit, against): how often each rule is estimated to speak against a good and a bad text, and how many texts
    it speaks against. An empty table gives a line for each rule, without votes."""
    pattern, count, found = estimate(vote_table(docs, id_col, text_col))
    votes_against = ((unpack(pattern, len(RULES)) < 0) * count[:, None]).sum(0) if len(pattern) else np.zeros(len(RULES), np.int64)
    rows = [(r[0], float(found.against[0, k]), float(found.against[1, k]), int(votes_against[k])) for k, r in enumerate(RULES)]
    return docs.sparkSession.createDataFrame(rows, "rule string, false_alarm double, hit double, against long")


def judge(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts of STATS, base_failed, quality, kept) for every row of ``docs``.

    kept: at least ``least`` posterior probability of a good text (a tie stays), and the base rules hold (50 words; at most half
    of them repeated). Null and empty texts fail; repeated rows are judged alike; an empty table gives no rows.
    """
    table = materialise(vote_table(docs, id_col, text_col), "votes")
    known = sorted(posteriors(table).items())
    lookup = docs.sparkSession.createDataFrame(known, "pattern long, quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return table.join(F.broadcast(lookup), "pattern").select(
        "doc_id", *STATS, failed.alias("base_failed"), "quality", (~failed & (F.col("quality") >= least)).alias("kept")
    )


def keep_good(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with the columns they came with; texts are judged where they are, without a shuffle.

    Null and empty texts go, as do those under 50 words; repeated rows stay or go together; a posterior of just ``least`` stays;
    an empty table stays empty.
    """
    known = posteriors(vote_table(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text_col, 4 << 20):
            stats = statistics(utf8(part.column(text_col)))
            quality = np.array([known[p] for p in patterns(votes(stats)).tolist()])
            yield part.filter(pa.array(~base_failed(stats["n_words"], stats["n_repeat_words"]) & (quality >= least)))

    return docs.mapInArrow(run, docs.schema)
