from corpus import ITEMS, frame, rows

from logsift.llm import decontam


def test_stages_in_order():
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]


def test_pipeline_decisions_take_effect(spark, tmp_path):
    import corpus_pipeline
    from test_dedup import brute_groups
    from test_screens import brute_counts

    data = [r[:5] for r in rows()]
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    frame(spark).select(*cols).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in got}

    good = []
    for r in data:
        n, _, _, _, rep = brute_counts(r[1])
        if n >= 50 and 100 * rep <= 50 * n:
            good.append((r[0], r[1]))
    ones = {c for _, _, c in brute_groups(good, 4)}
    items = [decontam.normal(t) for _, t in ITEMS if decontam.normal(t)]
    leaked = {d for d, t in good if any(i in decontam.normal(t) for i in items)}
    # base rejections, copies and benchmark items are gone
    assert kept <= ones - leaked
    assert kept
    stage = dict(corpus_pipeline.STAGES)
    docs = frame(spark).select(*cols)
    for name in list(stage)[:-1]:
        docs = stage[name](spark, docs, str(tmp_path))
        assert docs.columns == cols, name


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    frame(spark, []).select(*cols).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_sql_matches_the_query(spark):
    import os

    import duckdb
    from logsift.llm.queries import ORACLES, QUERIES
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(ORACLES["op7_quality_rules"]).fetchall()
    got = QUERIES["op7_quality_rules"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(want)
