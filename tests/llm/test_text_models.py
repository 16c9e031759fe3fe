import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import bpe, language_id, lm_score, packing, quality, secret_scan, url_filter

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = 10  # rows of odd()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, `_id` int"


def odd(spark):
    """Nulls, empty and long texts, control characters, repeated rows, columns with clashing names."""
    rows = [
        (1, None, None, None, None, "x", 1), (2, "", "en", "s", 0, None, 2), (3, "the the the " * 20000, "en", "a/test", 1, "y", 3), (None, "no id here", "en", "s", 1, "z", 4),
        (4, "same text twice.", "fr", "s", 1, "r", 5), (4, "same text twice.", "fr", "s", 1, "r", 5), (5, "\x0b \t\n", None, "s", 0, "", 6), (6, "x" * 100_000, "de", "s", 0, "q", 7),
        (7, "a\0b c d\x1c\x1d e\x85f \x01\x02\x7f \u2028 g\0", "en", "s", 0, "p", 8), (8, "hello a b \0 c", "en", "s", 0, "o", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(spark):
    return {r.doc_id: r.text for r in documents(spark).collect()}


@pytest.fixture(scope="module")
def encoding():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(encoding):
    merger, tokens = bpe.from_ranks(P.path("byte_bpe_50k.tiktoken"))
    rng = np.random.default_rng(0)
    letters = list("ab'srtevmld  \n\t1!.é　\x85\x1c½中😀")
    cases = ["", " ", "  ", "x  ", "it's 's don't", "''s!'s \n's", "a'rest'st", "I'VE", *("".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000))]
    ids, before, first, at = merger.encode(cases)
    for i, text in enumerate(cases):
        own = ids[before[i] : before[i + 1]]
        assert own.tolist() == encoding.encode_ordinary(text)
        assert bpe.decode(tokens, own) == text.encode()
        marks = at[first[i] : first[i + 1]].tolist()
        assert [text[a:b] for a, b in zip(marks, [*marks[1:], len(text)])] == [m.group() for m in __import__("regex").finditer(P.PATTERN, text)]


def test_bpe_of_long_runs(encoding):
    import time

    merger, tokens = bpe.from_ranks(P.path("byte_bpe_50k.tiktoken"))
    rng = np.random.default_rng(1)
    base64_run = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), 1_000_000))
    cjk = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 350_000))
    for text in ("x" * 1_000_000, base64_run, cjk, "=" * 300_000, "a" * (bpe.LONG - 1), "ab" * bpe.LONG):
        began = time.perf_counter()
        ids = merger.encode([text])[0]
        assert time.perf_counter() - began < 20
        assert bpe.decode(tokens, ids) == text.encode() and ids.tolist() == encoding.encode_ordinary(text)
    merger.clear()


def test_bpe_of_long_runs_by_merges():
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    rng = np.random.default_rng(2)
    for text in ("x" * 100_000, "".join(rng.choice(list("abcdefgh"), 100_000)), "".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 30_000))):
        assert bpe.encode_merges(path, [text])[0].tolist() == tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_bpe_query(spark, encoding):
    found = {r.doc_id: r for r in bpe.digests(documents(spark), P.path("byte_bpe_50k.tiktoken")).collect()}
    for i, text in texts(spark).items():
        ids = encoding.encode_ordinary(text)
        assert found[i].n_tokens == len(ids) and found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(odd(spark), P.path("byte_bpe_50k.tiktoken")).count() == ODD and bpe.digests(empty(spark), P.path("byte_bpe_50k.tiktoken")).count() == 0
    row = bpe.encode(odd(spark), P.path("byte_bpe_50k.tiktoken")).filter("doc_id = 1").first()
    assert row.n_tokens == 0 and row.piece_starts == []


def check_packing(rows, cap=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= cap
    return len(by)


def test_packing(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rows = packing.pack(documents(spark), path).collect()
    n, total = check_packing(rows), sum(r.length for r in rows)
    assert n <= math.ceil(total / 2048) + 1
    for i, text in texts(spark).items():
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows if r.doc_id == i)
        assert b"".join(o[4] for o in own) == ids.tobytes() and all(zlib.crc32(o[4]) == o[3] for o in own)
        assert [o[2] for o in own] == [len(ids) - 2048 * (len(own) - 1)] + [2048] * (len(own) - 1)
        assert [o[1] for o in own] == [0, *np.cumsum([o[2] for o in own])[:-1].tolist()]
    strange = packing.pack(odd(spark), path, keep_ids=False).collect()
    check_packing(strange)
    assert {r.length for r in strange if r.doc_id in (1, 2)} == {1} and packing.pack(empty(spark), path).count() == 0


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_packing_holds_every_capacity(by):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 5000)
    cap = packing.Capacity(100, documents=4, attention=6000 if by == "norm" else 10_000, by=by)
    lengths = np.minimum(lengths, 77) if by == "norm" else lengths
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = packing.plan(histogram, cap)
    used = np.zeros((plan.sequences, 3), np.int64)
    for length, n in histogram.items():
        s, _ = plan.place(np.full(n, length), np.arange(n))
        np.add.at(used, s, [length, 1, length * length])
    assert (used <= cap.vector()).all() and used[:, 1].sum() == 5000 and (used[:, 1] > 0).all()
    with pytest.raises(ValueError):
        packing.plan({101: 1}, cap)


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_packing_is_best_fit(by):
    """Against best fit, one piece at a time, over single sequences."""
    rng = np.random.default_rng(3)
    for tokens, documents, attention in ((100, 4, 5000), (60, None, None), (100, 7, 2500), (50, 3, None)):
        most = min(tokens, int((attention or tokens**2) ** 0.5))
        lengths = sorted(rng.integers(1, most + 1, 400).tolist(), reverse=True)
        cap = packing.Capacity(tokens, documents, attention, by=by)
        full, weights = cap.vector(), np.array(cap.weights)
        scale = weights / full.astype(float) ** 2
        rest, inside = np.zeros((0, 3), np.int64), []
        for n in lengths:
            item = np.array([n, 1, n * n])
            fits = np.flatnonzero((rest >= item).all(1))
            if len(fits):
                score = ((rest[fits] - item) ** 2 * scale).sum(1) if by == "norm" else -(rest[fits] * item * scale).sum(1)
                at = fits[np.argmin(score)]
            else:
                at, rest = len(rest), np.vstack([rest, full])
                inside.append([])
            rest[at] -= item
            inside[at].append(n)
        plan = packing.plan(dict(Counter(lengths)), cap)
        found: dict[int, list[int]] = {}
        for n, count in Counter(lengths).items():
            for sequence in plan.place(np.full(count, n), np.arange(count))[0].tolist():
                found.setdefault(sequence, []).append(n)
        assert plan.sequences == len(inside)
        assert sorted(sorted(x) for x in found.values()) == sorted(sorted(x) for x in inside)


def test_packing_under_every_capacity(spark):
    from loomgraph.llm import queries

    cap = packing.Capacity(2048, documents=12, attention=2048**2 // 2, by="dot")
    rows = queries.packing_under_capacities(spark, SF).collect()
    check_packing(rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r.length)
    assert max(r.length for r in rows) == cap.longest == 1448
    cost = [sum(n * n for n in x) for x in by.values()]
    assert max(map(len, by.values())) == 12 and max(cost) <= cap.attention and max(cost) > 0.95 * cap.attention and max(map(sum, by.values())) > 2000
    tokens = lambda rows: sorted((r.doc_id, r.start + r.length) for r in rows if r.doc_id is not None)
    plain = packing.pack(documents(spark), P.path("byte_bpe_50k.json"), keep_ids=False).collect()
    assert {i: max(n for k, n in tokens(rows) if k == i) for i, _ in tokens(rows)} == {i: max(n for k, n in tokens(plain) if k == i) for i, _ in tokens(plain)}


def test_quality_statistics(spark):
    found = {r.doc_id: r for r in quality.judge(documents(spark)).collect()}
    for i, text in texts(spark).items():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        windows = Counter(zip(words, words[1:], words[2:]))
        repeat = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines, seen = 0, set()
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                lines += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeat))
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_quality_verdicts(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [found[i].kept for i, q in labels.items() if q == 1 and not found[i].base_failed]
    bad = [found[i].kept for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.05
    strange = {r.doc_id: r.kept for r in quality.judge(odd(spark)).collect()}
    assert not any(strange.values()) and quality.judge(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).columns == empty(spark).columns
    assert quality.keep_good(odd(spark)).count() == 0


def test_quality_verdicts_by_brute_force(spark):
    """EM over single texts instead of counts of patterns, in plain Python."""
    docs = documents(spark)
    found = {r.doc_id: r for r in quality.judge(docs).collect()}
    ids = sorted(found)
    all_texts = texts(spark)
    votes = quality.votes(quality.statistics([all_texts[i].encode() for i in ids])).tolist()
    n, rules = len(ids), len(quality.RULES)
    good = [0.1 if -1 in v else 0.95 if 2 * v.count(1) > rules else 0.5 for v in votes]
    for _ in range(500):
        share = (sum(good) + 1) / (n + 2)
        against = [[0.0] * rules, [0.0] * rules]
        for y in (0, 1):
            for j in range(rules):
                weight = [(g if y == 0 else 1 - g) for g in good]
                bad = sum(w for w, v in zip(weight, votes) if v[j] < 0) + (quality.FALSE_ALARM * n if y == 0 else 0) + 0.5
                fine = sum(w for w, v in zip(weight, votes) if v[j] > 0) + ((1 - quality.FALSE_ALARM) * n if y == 0 else 0) + 0.5
                against[y][j] = bad / (bad + fine)
        against[1] = [max(a, b) for a, b in zip(*against)]
        fresh = []
        for v in votes:
            odds = math.log(share / (1 - share))
            for j, x in enumerate(v):
                odds += math.log(against[0][j] / against[1][j]) if x < 0 else math.log((1 - against[0][j]) / (1 - against[1][j])) if x > 0 else 0
            fresh.append(1 / (1 + math.exp(-max(-50, min(50, odds)))))
        done = max(abs(a - b) for a, b in zip(fresh, good)) < 1e-9
        good = fresh
        if done:
            break
    for i, g in zip(ids, good):
        assert math.isclose(found[i].quality, g, rel_tol=1e-6, abs_tol=1e-9) and found[i].kept == (not found[i].base_failed and g >= 0.5)


def test_em_finds_a_useless_rule():
    rng = np.random.default_rng(2)
    good = rng.random(20000) < 0.8
    v = np.stack([np.where(rng.random(20000) < np.where(good, 0.004, 0.6), -1, 1) for _ in range(5)], 1)
    pattern, count = np.unique(quality.patterns(v), return_counts=True)
    found = quality.fit(pattern, count, 5)
    post = dict(zip(pattern.tolist(), found.good))
    said = np.array([post[p] > 0.5 for p in quality.patterns(v).tolist()])
    assert (said == good).mean() > 0.97
    assert np.abs(found.against[0] - 0.004).max() < 0.003 and np.abs(found.against[1] - 0.6).max() < 0.05 and abs(found.share - 0.8) < 0.02


def test_em_estimates_what_the_labels_say(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.rule: r for r in quality.accuracies(docs).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in docs.select("doc_id", "text").collect() if r.doc_id in labels]
    v = quality.votes(quality.statistics([(r.text or "").encode() for r in rows]))
    good = np.array([labels[r.doc_id] == 1 for r in rows])
    for k, (name, *_) in enumerate(quality.RULES):
        seen = [(v[y, k] < 0).sum() / max((v[y, k] != 0).sum(), 1) for y in (good, ~good)]
        assert found[name].false_alarm < 0.01 and abs(found[name].false_alarm - seen[0]) < 0.005
        assert found[name].hit >= found[name].false_alarm and abs(found[name].hit - seen[1]) < 0.3
    assert quality.accuracies(empty(spark)).count() == len(quality.RULES)


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = language_id.identify(docs).collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    strange = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(odd(spark)).collect() if r.doc_id in (1, 2, 5)}
    assert strange == {(1, "und", 0.0), (2, "und", 0.0), (5, "und", 0.0)} and language_id.identify(empty(spark)).count() == 0


def test_language_by_brute_force():
    """A text's label from the network's formulas, byte by byte in plain Python."""
    net = language_id.train([("a", b"aba bab abba " * 20), ("b", b"xyz zyx yxz " * 20)], rounds=30)

    def walk(layer, data):
        h = len(layer.cand)
        state, out = [0.0] * h, []
        gates, cand = layer.gates.tolist(), layer.cand.tolist()
        for byte in data:
            x = layer.table[byte].tolist()
            g = [1 / (1 + math.exp(-(x[j] + sum(state[i] * gates[i][j] for i in range(h))))) for j in range(2 * h)]
            n = [math.tanh(x[2 * h + j] + sum(g[h + i] * state[i] * cand[i][j] for i in range(h))) for j in range(h)]
            state = [n[j] + g[j] * (state[j] - n[j]) for j in range(h)]
            out.append(state)
        return out

    def pooled(text):
        pad = b"\0" * language_id.CONTEXT
        data = pad + bytes(b + 32 if 65 <= b < 91 else b for b in text) + pad
        both = [f + b for f, b in zip(walk(net.forward, data), walk(net.backward, data[::-1])[::-1])]
        total, letters = [0.0] * len(net.languages), 0
        for at, byte in enumerate(text):
            if byte >= 128 or chr(byte).isalpha():
                logits = [sum(both[at + len(pad)][i] * float(net.top[i, k]) for i in range(2 * language_id.HIDDEN)) + float(net.bias[k]) for k in range(len(net.languages))]
                most = max(logits)
                share = [math.exp(x - most) for x in logits]
                total = [t + x / sum(share) for t, x in zip(total, share)]
                letters += 1
        return [t / max(letters, 1) for t in total]

    for text in (b"aba", b"ZYX 12 zyx", "é ab".encode(), b"1 2 3", b"abba xyz " * 20):
        assert np.allclose(net.pool([text])[0], pooled(text), atol=1e-4)
    long = b"aba bab abba xyz " * 60  # cut into windows, against one pass over the whole
    assert np.allclose(net.pool([long])[0], pooled(long), atol=0.02)
    together = net.pool([b"aba", b"", long, b"zyx zyx"])
    assert np.allclose(together[2], net.pool([long])[0], atol=1e-3) and not together[1].any()


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    layer = language_id.Direction.random(3, rng)
    layer.table, layer.gates, layer.cand = (w.astype(np.float64) for w in (layer.table, layer.gates, layer.cand))
    steps, weight = rng.integers(0, 4, (5, 2)), rng.normal(size=(5, 2, 3))
    loss = lambda: float((layer.trace(steps)[0] * weight).sum())
    _, kept = layer.trace(steps)
    for grad, w in zip(layer.back(steps, kept, weight), (layer.table, layer.gates, layer.cand)):
        for at in [(0, 0), (1, 2), (2, 1)]:
            old = w[at]
            w[at] = old + 1e-4
            up = loss()
            w[at] = old - 1e-4
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-4 - grad[at]) < 1e-3


def test_language_model(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: r for r in lm_score.score(docs).collect()}
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), b"\n"] for r in docs.collect()}
    counts = Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    strange = [r for r in lm_score.score(odd(spark)).collect()]
    assert len(strange) == ODD and {r.n_tokens for r in strange if r.doc_id in (1, 2, 5)} == {1} and lm_score.score(empty(spark)).count() == 0


def brute_score(model, words, counts, hashes, classes):
    """The model's log10 probability of one document, from its weights, token by token in plain Python."""
    full = (1 << 64) - 1

    def mix(h):
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & full
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & full
        return h ^ (h >> 31)

    mass = model.mass.tolist()
    shares = [sum(mass[g * 8 : g * 8 + 8]) for g in range(8)]
    total = 0.0
    for i, w in enumerate(words):
        word = lambda k: hashes[words[i - k]] + 0x1000 if i >= k else 0xB05  # noqa: B023, E731
        kind = lambda k: classes[words[i - k]] + 0x1000 if i >= k else 0xB05  # noqa: B023, E731
        keys = [word(1), word(2), word(1) * 0x9E3779B97F4A7C15 + word(2), kind(1) * 0x10000 + kind(2)]
        marks = [mix((key * 8 + k) & full) for k, key in enumerate(keys)]
        group, side = divmod(classes[w], 8)
        x = [math.log(shares[g] / sum(shares)) + sum(float(model.weights[m % lm_score.CELLS][g]) for m in marks) for g in range(8)]
        y = [math.log(mass[group * 8 + c] / shares[group]) + sum(float(model.weights[((m >> 32) + group * 0x2545F) % lm_score.CELLS][c]) for m in marks) for c in range(8)]
        total += x[group] - math.log(sum(map(math.exp, x))) + y[side] - math.log(sum(map(math.exp, y))) + math.log((counts[w] + 1) / mass[classes[w]])
    return total / math.log(10)


def test_language_model_scores_by_brute_force(spark):
    docs = documents(spark).union(odd(spark).select(documents(spark).columns)).filter("doc_id is not null")
    table, model = lm_score.prepare(docs.select("doc_id", (lm_score.doc_remainder(docs.doc_id, 7) == 2).alias("held"), "text"))
    model = lm_score.train(table, model)
    assert np.abs(model.weights).max() > 0.1
    batches = [lm_score.Batch.of(r.asDict(recursive=True)) for r in table.collect()]
    found = {(int(i), int(n)): s for b in batches for i, n, s in zip(b.doc_id, b.sizes, lm_score.score_batch(model, b)[2])}
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), lm_score.END_WORD] for r in docs.collect()}
    counts = Counter(w for i, t in {(r.doc_id, k): r for k, r in enumerate(docs.collect())}.items() if zlib.crc32(str(i[0]).encode()) % 7 != 2 for w in [*(t.text or "").encode().lower().split(), lm_score.END_WORD])
    listed = list({w for t in tokens.values() for w in t})
    hashes = lm_score.word_hashes(listed)
    classes = dict(zip(listed, model.classify(np.array([counts[w] for w in listed]), hashes).tolist()))
    hashes = dict(zip(listed, hashes.tolist()))
    for i, t in [x for x in tokens.items() if len(x[1]) < 2000][-60:]:
        assert math.isclose(found[i, len(t)], brute_score(model, t, counts, hashes, classes), rel_tol=1e-4)


def small_model():
    return lm_score.make_classes([(b, s, 3, 3 * b) for b in range(1, 40) for s in range(lm_score.SPREAD)])


def test_language_model_is_a_distribution():
    model = small_model()
    rng = np.random.default_rng(4)
    model.weights[:] = rng.normal(size=model.weights.shape) * 0.3
    counts, hashes = np.repeat(np.arange(1, 40), 3 * lm_score.SPREAD), np.tile(np.arange(lm_score.SPREAD, dtype=np.uint32), 39 * 3)
    counts, hashes = np.r_[counts, 0], np.r_[hashes, 0].astype(np.uint32)
    total = 0.0
    for w in range(len(counts)):
        batch = lm_score.Batch(np.array([1]), np.array([3]), np.array([False]), np.array([5, 7, w]), counts, hashes)
        two = lm_score.Batch(np.array([1]), np.array([2]), np.array([False]), np.array([5, 7]), counts, hashes)
        total += 10 ** (lm_score.score_batch(model, batch)[2][0] - lm_score.score_batch(model, two)[2][0])
    assert abs(total - 1) < 1e-4


def test_language_model_gradient_is_the_derivative():
    model = small_model()
    rng = np.random.default_rng(6)
    model.weights[:] = rng.normal(size=model.weights.shape) * 0.3
    n = 50
    counts, hashes = rng.integers(1, 40, n), rng.integers(0, 1 << 31, n).astype(np.uint32)
    batch = lm_score.Batch(np.array([1]), np.array([n]), np.array([False]), np.arange(n), counts, hashes)
    _, marks, target = batch.prepared(model)
    many, slope = lm_score.gradient(lm_score.Scorer(model), marks, target)
    cell = np.flatnonzero(many)
    assert many.sum() == 2 * lm_score.FEATURES * n

    def likelihood():
        group, side = target // lm_score.SIDE, target % lm_score.SIDE
        x, y = (z.astype(float) for z in lm_score.Scorer(model).logits(*lm_score.cells(marks, group), group))
        each = np.arange(n)
        return (x[each, group] - np.log(np.exp(x).sum(1)) + y[each, side] - np.log(np.exp(y).sum(1))).sum()

    for k in rng.choice(len(cell), 12, replace=False):
        for w in range(lm_score.GROUPS):
            old = model.weights[cell[k], w]
            model.weights[cell[k], w] = old + 0.05
            up = likelihood()
            model.weights[cell[k], w] = old - 0.05
            down = likelihood()
            model.weights[cell[k], w] = old
            assert abs((up - down) / 0.1 - slope[cell[k], w]) < 2e-2


def test_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    extra = spark.createDataFrame([(-1, None), (-2, "no scheme"), (-3, "HTTP://WWW.Example.COM/en/x?y"), (-4, "http://a.example.com/en/1"), (-5, "x://net"), (-6, "x://q.net/es/?"), (-7, "ftp://é.org#f")], "page_id long, url string")
    found = {r.page_id: r for r in url_filter.judge(pages.union(extra)).collect()}
    at = lambda i: (found[i].host, found[i].path, found[i].rule)
    assert at(-1) == at(-2) == ("", "", None) and at(-3) == ("www.example.com", "/en/x", "www.example.com/en/") and at(-4)[2] == "example.com/en/"
    assert at(-5) == ("net", "", None) and at(-6) == ("q.net", "/es/", "net/es/") and at(-7) == ("é.org", "", None)
    labelled = [(r.host + r.path, r.verdict == "allow") for r in found.values() if r.rule]
    counts, totals, kinds = ([Counter(), Counter()] for _ in range(3))
    for text, side in labelled:
        padded = "\x02" * 4 + text
        for i in range(len(text)):
            for k in range(5):
                counts[side][padded[i + 4 - k : i + 4], text[i]] += 1
    for side in (0, 1):
        for (c, _), n in counts[side].items():
            totals[side][c] += n
            kinds[side][c] += 1

    def chance(side, context, ch):
        low = chance(side, context[1:], ch) if context else 1 / 256
        rest = totals[side][context] + kinds[side][context]
        return (counts[side][context, ch] + kinds[side][context] * low) / rest if rest else low

    for r in found.values():
        text = r.host + r.path
        padded = "\x02" * 4 + text
        want = sum(math.log10(chance(1, padded[i : i + 4], text[i]) / chance(0, padded[i : i + 4], text[i])) for i in range(len(text))) / max(len(text), 1)
        assert math.isclose(r.score, want, abs_tol=1e-9)
    rules = {r.name: r.verdict for r in url_filter.RULES}
    score = {r.host + r.path: r.score for r in found.values()}
    sides = {side: [score[t] for t in sorted({t for t, x in labelled if x == side})] for side in (True, False)}
    mean = {k: sum(v) / len(v) for k, v in sides.items()}
    spread = {k: math.sqrt(sum((x - mean[k]) ** 2 for x in v) / len(v)) for k, v in sides.items()}
    cut = (mean[True] * spread[False] + mean[False] * spread[True]) / (spread[True] + spread[False])
    for r in found.values():
        assert r.verdict == (rules[r.rule] if r.rule else "allow" if r.score >= cut else "block") or abs(r.score - cut) < 1e-9
    assert url_filter.judge(pages.limit(0)).count() == 0
    again = pages.limit(3).union(pages.limit(3)).union(spark.createDataFrame([(-9, "http://long.example/" + "a/b" * 20_000)], "page_id long, url string")).withColumn("text", pages.url).withColumn("fit", pages.url)
    assert url_filter.judge(again).count() == 7


def test_secrets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scanner = secret_scan.train(docs)
    found = {(r.doc_id, r.start) for r in secret_scan.findings(docs, scanner).collect() if r.secret}
    rows = docs.collect()
    want = {(r.doc_id, m.start(1)) for r in rows for m in re.finditer(r'(?i)token\s*=\s*"([0-9a-f]{40})"', r.text)}
    assert want <= found and len(found - want) <= 2
    clean = secret_scan.redact(docs, scanner)
    assert clean.count() == len(rows) and clean.columns == docs.columns and clean.filter(clean.text.rlike('token = "[0-9a-f]{40}"')).count() == 0
    same = {r.doc_id: r.text for r in clean.collect()}
    assert all(same[r.doc_id] == r.text for r in rows if r.doc_id not in {i for i, _ in found})
    assert secret_scan.redact(odd(spark), scanner).count() == ODD and secret_scan.findings(empty(spark), scanner).count() == 0
    assert secret_scan.train(empty(spark)) is not None


def test_forest_learns():
    counts = np.ones(secret_scan.TRIGRAMS)
    logs = np.full(secret_scan.TRIGRAMS, -4.0)
    found, labels, _ = secret_scan.simulated_findings(counts, 1500, seed=1)
    forest = secret_scan.Forest.fit(secret_scan.features(found, logs), labels)
    held, truth, _ = secret_scan.simulated_findings(counts, 600, seed=2)
    x = secret_scan.features(held, logs)
    assert ((forest.predict(x) > 0.5) == truth).mean() > 0.95
    for row, score in list(zip(x, forest.predict(x)))[:40]:  # tree by tree, in plain Python
        total = 0.0
        for feature, threshold, child, share in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = child[at] + int(row[feature[at]] > threshold[at])
            total += share[at]
        assert math.isclose(score, total / len(forest.trees))


def test_secrets_held_out_by_kind(spark):
    scanner = secret_scan.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    counts = secret_scan.trigrams(documents(spark))
    found = secret_scan.by_kind(scanner, *secret_scan.simulated_findings(counts, 3000, seed=99))
    assert set(found) == set(secret_scan.KINDS)
    assert all(share > (0.8 if kind == "unnamed keys" else 0.93) for kind, (_, share) in found.items()), found


def test_secret_candidates_by_brute_force():
    shape = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
    text = b'x ' + b"a" * 16 + b" " + b"b" * 15 + b" c=" + b"d1" * 10 + b'== password = "short1!x" token: \'' + b"e" * 30 + b"' pwd='1234567' secret=\"" + b"f" * 16 + b'"'
    want, i = set(), 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in shape:
            j += 1
        if j - i >= 16:
            k = j
            while k < len(text) and k < j + 2 and text[k : k + 1] == b"=":
                k += 1
            want.add(text[i:k])
        i = max(j, i + 1)
    assert [text[a:b] for a, b in secret_scan.spans(text)] == sorted(want | {b"short1!x"}, key=text.index)
    assert secret_scan.spans(b"") == [] and secret_scan.spans(b"x" * 16 + b"." + b"y" * 10) == [(0, 27)]


def test_secrets_need_no_path_column(spark):
    docs = documents(spark).drop("source")
    assert secret_scan.redact(docs).count() == docs.count() and "secret" in secret_scan.findings(docs).columns
    given = secret_scan.simulated_findings(np.ones(secret_scan.TRIGRAMS), 400, seed=7)
    assert secret_scan.train(docs, labelled=given[:2]).forest.trees
