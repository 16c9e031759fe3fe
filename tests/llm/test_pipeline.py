import pytest
from test_text_models import check_packing, empty, odd

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "SimHash near-dedup", "secret scans", "best-fit packing"]
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(pieces)
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    assert {tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()} == {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces}


def test_strange_rows_go_through_every_stage(spark):
    for docs in (odd(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
            stage(spark, docs, SF).count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_stages_by_brute_force(spark):
    """What each stage keeps, against plain Python over its own input."""
    import hashlib

    from test_duplicates import alike_pairs

    from loomgraph.llm import quality, secret_scan

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def after(name, df):
        out = stages[name](spark, df, SF).collect()
        return spark.createDataFrame(out, df.schema), {r.doc_id: r for r in out}

    before = {r.doc_id: r for r in docs.collect()}
    good, kept = after("quality rules", docs)
    assert set(kept) == {r.doc_id for r in quality.judge(docs).collect() if r.kept} and all(kept[i] == before[i] for i in kept)
    by = {}
    for i, r in kept.items():
        by.setdefault(hashlib.sha256((r.text or "").encode().lower()).digest(), []).append(i)
    unique, found = after("exact dedup", good)
    assert set(found) == {max(ids) for ids in by.values()}
    apart, left = after("SimHash near-dedup", unique)
    pairs, parent = alike_pairs({i: r.text for i, r in found.items()}), {i: i for i in found}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {root(i) for i in found}
    assert want <= set(left) and len(set(left) - want) <= 0.02 * len(pairs) + 1
    masked, done = after("secret scans", apart)
    hits = {r.doc_id for r in secret_scan.findings(apart).collect() if r.secret}
    assert set(done) == set(left) and {i for i in done if done[i].text != left[i].text} == hits and all("[SECRET]" in done[i].text for i in hits)
    check_packing(stages["best-fit packing"](spark, masked, SF).collect())
