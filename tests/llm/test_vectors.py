import numpy as np
from pyspark.sql import types as T

from logsift.llm import embedding_dedup

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("cell", T.StringType()), T.StructField("cid", T.StringType()),
                       T.StructField("n_links", T.StringType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "x", "y", "z")
                                  for i, v, lab in rows], SCHEMA)


def planted(seed=3, n=900, dim=16):
    """Random vectors, chains of near copies, a dense group, exact copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    base = rng.normal(size=dim)
    x[100:400] = base + 0.08 * rng.normal(size=(300, dim))              # dense: a third of all rows
    x[400:430] = x[10]                                                  # exact copies
    for i in range(500, 560, 3):                                        # chains
        x[i + 1] = x[i] + 0.28 * rng.normal(size=dim)
        x[i + 2] = x[i + 1] + 0.28 * rng.normal(size=dim)
    return x.astype(np.float32)


def brute_links(ids, v, threshold=0.9):
    u = v.astype(float)
    cos = (u @ u.T) / np.outer(np.linalg.norm(u, axis=1), np.linalg.norm(u, axis=1))
    link = cos >= threshold
    np.fill_diagonal(link, False)
    root = np.arange(len(ids))
    while True:
        new = np.array([min(root[i], *(root[link[i]] if link[i].any() else [root[i]])) for i in range(len(ids))])
        if (new == root).all():
            break
        root = new
    return {ids[i]: (int(link[i].sum()), ids[root[i]], bool(root[i] == i)) for i in range(len(ids))}


def test_cells_find_what_brute_force_finds(spark):
    x = planted()
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1),
           (2004, [float("inf")] * 16, 1), (2005, [1.0] * 5, 1), (2006, [], None)]
    df = vectors(spark, [(i, v, 0) for i, v in enumerate(x.tolist())] + odd)
    want = brute_links(list(range(len(x))), x) | {i: (0, i, True) for i, *_ in odd}
    for options in ({}, {"cell_rows": 40, "block_rows": 32}):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, **options).collect()}
        assert got == want
    kept = embedding_dedup.keep_representatives(df, cell_rows=40)
    assert kept.columns == df.columns
    assert {r["vec_id"] for r in kept.collect()} == {i for i, w in want.items() if w[2]}


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine just above the threshold, in 64 dimensions without
    any structure: the hardest case for cells."""
    rng = np.random.default_rng(1)
    u = rng.normal(size=(2000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    pair = 0.901 * u + np.sqrt(1 - 0.901 ** 2) * w
    rows = [(2 * i, a, 0) for i, a in enumerate(u.tolist())] + [(2 * i + 1, a, 0) for i, a in enumerate(pair.tolist())]
    got = embedding_dedup.near_duplicates(vectors(spark, rows), cell_rows=64).collect()
    assert sum(r["n_links"] for r in got) / 4000 >= 0.97
    assert all(r["component_id"] in (r["vec_id"], r["vec_id"] - 1) for r in got)


def test_empty_repeated_and_missing_ids(spark):
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0
    same = [1.0, 2.0, 3.0]
    df = vectors(spark, [(5, same, 1), (5, same, 1), (None, same, 1), (7, [2.0, 4.0, 6.0], 1), (None, None, 1), (9, [-1.0, 0.0, 0.0], 1)])
    got = sorted([tuple(r) for r in embedding_dedup.near_duplicates(df).collect()], key=str)
    assert got == sorted([(5, 3, 5, True), (5, 3, 5, True), (None, 3, 5, False), (7, 3, 5, False), (None, 0, None, False), (9, 0, 9, True)], key=str)


def brute_negatives(rows, every=10, k=5):
    """All inner products; anchors are ids divisible by ``every``."""
    import math
    good = [(i, lab, [int(math.floor(256 * float(np.float32(x)))) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and len(v) == 16
            and all(x is not None and math.isfinite(x) for x in v)]
    m = np.array([v for *_, v in good], np.int64)
    out = []
    for i, lab, v in good:
        if i % every:
            continue
        s = (m @ np.array(v)).tolist()
        order = sorted(range(len(good)), key=lambda r: (-s[r], good[r][0]))
        for p in [r for r in order if good[r][1] == lab and good[r][0] != i][:k]:
            hits = [r for r in order if good[r][1] != lab and 80 * s[p] <= 100 * s[r] <= 100 * s[p]][:k]
            out += [(i, good[p][0], n + 1, good[r][0], s[p], s[r]) for n, r in enumerate(hits)]
    return sorted(out)


def test_tree_search_equals_all_products(spark):
    from pyspark.sql import functions as F

    from logsift.llm import hard_negatives
    from logsift.llm.vectors import finite
    x = planted(seed=9, n=700)
    x[400:520] = x[10]                                                   # ties by id, one value in many pages
    rng = np.random.default_rng(2)
    rows = [(i, v, int(rng.integers(0, 4))) for i, v in enumerate(x.tolist())]
    rows += [(800, None, 1), (810, [1.0] * 5, 1), (820, [None] + [1.0] * 15, 1), (830, [1.0] * 16, None), (None, [1.0] * 16, 1),
             (840, [float("nan")] * 16, 1), (850, [0.0] * 16, 1), (860, [2000.0] * 16, 3)]
    v = F.col("embedding").cast("array<double>")
    df = vectors(spark, rows).withColumn("embedding", F.when(finite(v), F.transform(v, lambda c: F.floor(256 * c).cast("double"))))
    for options in ({}, {"page_rows": 16, "shelf_pages": 9, "block_anchors": 20}):
        got = sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 10 == 0, **options).collect())
        assert got == brute_negatives(rows)
    assert hard_negatives.mine_hard_negatives(vectors(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine_hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_boxes_bound_every_product():
    from logsift.llm import hard_negatives
    rng = np.random.default_rng(5)
    v = rng.integers(-300, 300, (500, 6))
    pages = hard_negatives.tile(v, np.arange(500), [0, 1, 2], 32)
    assert sorted(np.concatenate(pages).tolist()) == list(range(500)) and max(map(len, pages)) <= 32
    shelf = hard_negatives.Shelf([{"ids": p.astype("<i8").tobytes(), "labels": p.astype("<i8").tobytes(),
                                   "vectors": v[p].astype("<i8").tobytes()} for p in pages], 6, np.float64)
    q = rng.integers(-300, 300, (20, 6)).astype(float)
    low, high = shelf.bounds(q)
    for n, p in enumerate(pages):
        s = q @ v[p].T
        assert (low[:, n] <= s.min(axis=1)).all() and (s.max(axis=1) <= high[:, n]).all()
    assert (high[:, shelf.root] >= (q @ v.T).max(axis=1)).all()
