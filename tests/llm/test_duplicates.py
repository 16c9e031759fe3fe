import hashlib
import random

import numpy as np
import pytest
from test_text_models import ODD, documents, empty, odd, texts

from loomgraph.llm import exact_dedup, simhash, substring


def lower(text):
    return (text or "").encode().lower()


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 10, 100, 5000, 200_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        f = exact_dedup.FuseFilter.build(np.r_[keys, keys[: n // 2]])
        assert f.may_hold(keys).all()
        if n >= 5000:
            others = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
            assert f.may_hold(others).mean() < 0.01 and len(f.cells) < (1.6 if n < 100_000 else 1.25) * n


def check_exact(found, rows):
    by = {}
    for i, t in rows:
        by.setdefault(lower(t), []).append(i)
    assert len(found) == len(rows)
    for r in found:
        ids = next(v for k, v in by.items() if hashlib.sha256(k).digest() == bytes(r.sha))
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None) and r.kept == (r.doc_id == r.keep_id)


def test_exact_groups(spark):
    rows = list(texts(spark).items())
    rows += [(10_000 + i, t.upper() if t.isascii() else t) for i, t in rows[:40]] + [(20_000, "É"), (20_001, "é"), (20_002, None), (20_003, "")]
    check_exact(exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    check_exact(exact_dedup.exact_groups(odd(spark)).collect(), [(r.doc_id, r.text) for r in odd(spark).collect()])
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_exact_hot_group_and_other_batches(spark):
    rows = [(i, "hot text" if i % 3 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    from pyspark.sql import functions as F

    for incoming in (F.lit(True), F.lit(False), F.col("doc_id") >= 1500):
        found = exact_dedup.exact_groups(df, incoming).collect()
        check_exact(found, rows)


def test_stored_index_takes_many_batches(spark, tmp_path):
    known = [(i, f"text {i}") for i in range(500)] + [(600, "TEXT 7"), (None, "no id")]
    schema = "doc_id long, text string"
    exact_dedup.write_index(spark.createDataFrame(known, schema), f"file://{tmp_path}/index")
    index = exact_dedup.open_index(spark, f"file://{tmp_path}/index")
    for shift in (0, 400, 900):
        batch = [(1000 + i, f"Text {i + shift}") for i in range(200)] + [(2000, "text 0"), (2001, None), (2002, ""), (None, "no id")]
        found = {(r.doc_id, bytes(r.sha)): r for r in exact_dedup.against(spark.createDataFrame(batch, schema), index).collect()}
        assert len(found) == len(batch)
        for i, t in batch:
            r = found[i, hashlib.sha256(lower(t)).digest()]
            own = [x for x in known if lower(x[1]) == lower(t)]
            every = [x[0] for x in own + [y for y in batch if lower(y[1]) == lower(t)]]
            assert r.known == bool(own) and r.group_size == len(every) and r.keep_id == max((x for x in every if x is not None), default=None)
    exact_dedup.write_index(empty(spark), f"file://{tmp_path}/none")
    alone = exact_dedup.against(odd(spark), exact_dedup.open_index(spark, f"file://{tmp_path}/none")).collect()
    assert len(alone) == ODD and not any(r.known for r in alone)


def test_keep_one_text(spark):
    kept = exact_dedup.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 3, 4, 5, 6, 7, 8]
    assert exact_dedup.keep_one(empty(spark)).count() == 0
    spelled = spark.createDataFrame([(5, "Foo"), (5, "foo"), (5, "foo"), (4, "FOO"), (6, "bar")], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact_dedup.keep_one(spelled).collect()) == [5, 6]


def classes(rows, radius):
    ids = sorted(rows)
    prints = np.array([rows[i] for i in ids], np.uint64)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(prints[:k] ^ prints[k]) <= radius):
            a, b = sorted((root(ids[j]), root(i)))
            parent[b] = a
    return {i: root(i) for i in ids}


def test_near_groups(spark):
    found = simhash.near_groups(documents(spark)).collect()
    prints = {i: int(simhash.fingerprint(simhash.shingle_hashes(t.encode(), 4))[0]) for i, t in texts(spark).items()}
    want = classes(prints, 4)
    assert all(r.component_id == want[r.doc_id] and r.fp & ((1 << 64) - 1) == prints[r.doc_id] for r in found) and len(found) == len(want)
    strange = simhash.near_groups(odd(spark)).collect()
    assert len(strange) == ODD and {r.component_id for r in strange if r.doc_id in (1, 2, 5)} == {1} and simhash.near_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6])
def test_probes_lose_no_pair(radius):
    rng = np.random.default_rng(radius)
    p = np.full(64, 0.5)
    for n in (1000, 10**7, 10**9):
        probes = simhash.allocate(p, np.eye(64), n, radius)
        a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        b = a.copy()
        for i in range(300):
            for bit in rng.permutation(64)[: rng.integers(0, radius + 1)]:
                b[i] ^= np.uint64(1 << int(bit))
        x, y = simhash.bucket_keys(a, probes), simhash.bucket_keys(b, probes)
        assert all(set(x[i].tolist()) & set(y[i].tolist()) for i in range(300))


def test_forest_is_single_linkage():
    rng = np.random.default_rng(5)
    for n in (3, 40, 300):
        centre = rng.integers(0, 1 << 63, max(n // 20, 1)).astype(np.uint64)
        prints = centre[rng.integers(0, len(centre), n)]
        for _ in range(5):
            prints = prints ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
        prints = np.unique(prints)
        want = classes(dict(enumerate(prints.tolist())), 4)
        top = simhash.forest(prints[:, None], 4)
        assert len(set(zip(top.tolist(), want.values()))) == len(set(top.tolist())) == len(set(want.values()))


@pytest.mark.parametrize("hot", [40])
def test_hot_buckets_are_split_without_loss(spark, hot):
    """Near copies of one fingerprint, all in the same buckets, and others."""
    rng = np.random.default_rng(hot)
    prints = [rng.integers(0, 1 << 63, 300).astype(np.uint64)]
    centre = prints[0][0]
    for _ in range(700):
        turned = centre
        for bit in rng.choice([3, 7, 9, 12, 20, 33, 41, 50, 58, 60], rng.integers(0, 9), replace=False).tolist():
            turned = turned ^ np.uint64(1 << bit)
        prints.append(np.array([turned], np.uint64))
    prints = np.unique(np.concatenate(prints))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    probes = simhash.allocate(*simhash.correlations(df), 4)
    buckets = simhash.split_hot(simhash.deal(df, {0: probes}), 4, hot=hot)
    pairs = simhash.links(buckets.withColumn("p0", buckets.node), 4, 1)
    found = {r.node: r.root for r in simhash.components(pairs).collect()}
    want = classes(dict(enumerate(prints.tolist())), 4)
    ours = {i: found.get(int(x), int(x)) for i, x in enumerate(prints.view(np.int64).tolist())}
    assert len(set(zip(ours.values(), want.values()))) == len(set(ours.values())) == len(set(want.values()))


def shingle_sets(rows, size=5):
    out = {}
    for i, t in rows.items():
        w = (t or "").encode().lower().split()
        if w:
            out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}
    return out


def alike_pairs(rows, similarity=0.8):
    """Pairs of that Jaccard similarity, by an index from shingles to documents."""
    sets, holders = shingle_sets(rows), {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common = {}
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common[a, b] = common.get((a, b), 0) + 1
    return {p for p, n in common.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= similarity}


def check_similar(rows, groups, missed):
    """Every group is connected by true pairs, and of all true pairs so many are missed at most."""
    pairs, parent = alike_pairs(rows), {i: i for i in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    by = {}
    for i, g in groups.items():
        by.setdefault(g, set()).add(root(i))
    assert all(len(x) == 1 for x in by.values())
    assert sum(groups[a] != groups[b] for a, b in pairs) <= missed * max(len(pairs), 1)


def test_similar_documents_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    check_similar(rows, {r.doc_id: r.root for r in simhash.similar_groups(docs).collect()}, 0.02)


def test_hot_near_copies(spark):
    """A third of all rows near copies of one text: leaders take them out of their buckets."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(120)], {}
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(120)] = word()
        rows[i] = " ".join(copy)
    for i in range(300, 500):
        rows[i] = " ".join(word() for _ in range(80))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    check_similar(rows, {r.doc_id: r.root for r in simhash.similar_groups(docs, hot=30).collect()}, 0.0)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(100)] + [(5000, 4000 - i) for i in range(50)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert found == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_similar_documents(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(40):
        base = [word() for _ in range(300)]
        rows.append((10 * g, " ".join(base)))
        for k in range(1, 4):
            copy = list(base)
            for _ in range(k + 2):
                copy[rng.randrange(300)] = word()
            rows.append((10 * g + k, " ".join(copy)))
    rows += [(9000, "a b"), (9001, None), (9002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_similar(dict(rows), {r.doc_id: r.root for r in simhash.similar_groups(docs).collect()}, 0.0)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {10 * g for g in range(40)} | {9000, 9001, 9002}
    assert simhash.keep_one(odd(spark)).columns == odd(spark).columns and simhash.keep_one(empty(spark)).count() == 0


def removed(rows, window):
    least = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            least.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found_removed(df, window):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df, window).collect()), key=str)


def test_substrings(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert found_removed(documents(spark).repartition(5), 13) == removed(rows, 13)
    rng = random.Random(3)
    small = [(rng.randrange(60) if rng.random() < 0.95 else None, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for _ in range(60)]
    small = list({r[0]: r for r in small if r[0] is not None}.values()) + [r for r in small if r[0] is None]
    assert found_removed(spark.createDataFrame(small, "doc_id long, text string").repartition(4), 5) == removed(small, 5)
    strange = [(r.doc_id, r.text) for r in odd(spark).collect()]
    assert found_removed(odd(spark), 13) == removed(strange, 13) and substring.remove_repeats(empty(spark)).count() == 0
    row = next(r for r in substring.remove_repeats(spark.createDataFrame([(1, "a b c d"), (2, "x a b c y")], "doc_id long, text string"), 3).collect() if r.doc_id == 2)
    assert row.kept_text == "x y" and [(s["first"], s["n"]) for s in row.removed] == [(1, 3)]


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring, "_mix", lambda h: np.asarray(h, np.uint64) & np.uint64(1))
    texts = [b"a b c d e", b"f g h i j", b"q a b c d"]
    ids, counts = np.array([1, 2, 3]), np.ones(substring.CELLS, np.int64)
    packed = {}
    for bucket, blob in substring.cut_block(ids, ids, texts, counts, 3, 2):
        packed.setdefault(bucket, []).append(blob)
    runs = np.concatenate([substring.covered(v, 3) for v in packed.values()])
    gone = {int(r[0]) * 100 + int(r[2]) + k for r in runs for k in range(int(r[3]))}
    assert gone == {301, 302}


def test_clashing_columns_stay(spark):
    names = ["doc_id", "text", "_id", "_row", "_node", "_salt", "row", "node", "root", "sha", "keep_id"]
    docs = spark.createDataFrame([(1, "a b c", *names[2:]), (2, "A B C", *names[2:]), (3, "other", *names[2:])], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    for kept, ids in ((exact_dedup.keep_one(docs), {2, 3}), (simhash.keep_one(docs), {1, 3})):
        assert kept.columns == names and {r.doc_id for r in kept.collect()} == ids and {r["_row"] for r in kept.collect()} == {"_row"}


def test_long_fingerprints_by_generalised_pigeonhole():
    """Partitions hold correlated bits, thresholds are unequal and the cheapest that reach the recall, and what is near meets for certain."""
    rng = np.random.default_rng(5)
    bits = rng.random((3000, 2, 64)) < 0.5
    bits[:, 0, 1:20:2] = bits[:, 0, :1]  # ten bits of the first word follow its first one
    bits[:, 1, 40:] = rng.random((3000, 24)) < 0.03  # and some of the second hardly vary
    found = [(b.mean(0), np.abs(np.corrcoef(b.T.astype(float)))) for b in (bits[:, 0], bits[:, 1])]
    n, q = 20_000, simhash.differ(0.9)
    plan = simhash.wide_plan(found, n, 0.9, recall=0.9)
    probes = [(k, p) for k, own in enumerate(plan.probes) for p in own]
    for k in range(2):
        used = [b for j, p in probes if j == k for b in p.bits]
        assert len(used) == len(set(used))
    own = {0, *range(1, 20, 2)}
    assert sum(bool(own & set(p.bits)) for k, p in probes if k == 0) <= 2
    assert len({p.threshold for _, p in probes}) > 1
    missed = lambda ts: np.prod([1 - simhash.met(size, t, q) for size, t in ts if t >= 0])
    assert missed([(len(p.bits), p.threshold) for _, p in probes]) <= 0.1
    cost = sum(simhash.probe_costs(*found[k], list(p.bits), n, simhash.WIDE_ROW_COST, simhash.FOREST_COST)[p.threshold] for k, p in probes)
    for parts in simhash.PARTS:  # no equal thresholds are cheaper
        groups = [(k, g) for k in range(2) for g in simhash.group_bits(found[k][1], parts)]
        for t in (0, 1, 2, 4):
            if missed([(len(g), t) for _, g in groups]) <= 0.09:
                assert cost <= sum(simhash.probe_costs(*found[k], g, n, simhash.WIDE_ROW_COST, simhash.FOREST_COST)[t] for k, g in groups)
    a = rng.integers(0, 1 << 63, (400, 2)).astype(np.uint64)
    b = a.copy()
    for i in range(400):
        for at in rng.choice(128, plan.certain, replace=False).tolist():
            b[i, at // 64] ^= np.uint64(1 << at % 64)
    assert all(set(x) & set(y) for x, y in zip(plan.keys(a).tolist(), plan.keys(b).tolist()))


def test_more_texts_get_narrower_buckets():
    words = [simhash.fingerprint_words(n, 0.8, 0.99) for n in (1, 10_000, 10_000_000)]
    assert words == sorted(words) and words[0] < words[-1]
