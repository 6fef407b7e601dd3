import numpy as np
import pytest
import xxhash
from corpus import frame, repeated_bytes, repeated_words, rows, texts

from logsift.llm import simhash


def brute_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(docs, radius):
    fps = [brute_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, f"{fp:016x}", least[find(i)]) for i, ((d, _), fp) in enumerate(zip(docs, fps)))


def test_every_pair_within_the_radius_meets_in_a_table():
    rng = np.random.default_rng(3)
    masks = [m % (1 << 64) for m in simhash.masks()]
    assert len(masks) == 31
    for _ in range(3000):
        flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flip & m == 0 for m in masks)


def test_simhash_groups_match_brute_force(spark):
    got = sorted(tuple(r) for r in simhash.near_duplicates(frame(spark)).collect())
    assert got == brute_groups([(r[0], r[1]) for r in rows()], 4)


def test_dense_group_is_linked_across_leaders(spark):
    # fingerprints in a chain of 4-bit steps plus a far cluster: one component each
    chain = [(1 << (4 * i)) - 1 for i in range(12)]
    far = [(0xF0F0F0F0F0F0F0F0 ^ (1 << i)) - (1 << 64) for i in range(6)]
    fps = spark.createDataFrame([(x,) for x in chain + far], "fp long")
    got = {r["fp"]: r["root"] for r in simhash.links(fps).collect()}
    assert {got[x] for x in chain} == {0}
    assert len({got[x] for x in far}) == 1


def test_keep_one_keeps_the_least_id_of_each_group(spark):
    kept = simhash.keep_one(frame(spark))
    assert kept.columns == frame(spark).columns
    want = sorted({c for _, _, c in brute_groups([(r[0], r[1]) for r in rows()], 4)})
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_keep_one_tells_rows_of_missing_or_equal_ids_apart(spark):
    t = [r[1] for r in rows()]
    unlike = [t[i] for i in (11, 12, 13, 14, 15, 16)]
    assert len({c for _, _, c in brute_groups(list(enumerate(unlike)), 4)}) == 6
    a, b, c, d, e, f = unlike
    # three texts without an id (one twice), one whose group has an id; one id with three texts, the least of two groups
    data = [(None, a), (None, b), (None, c), (None, c), (None, d), (7, d), (3, d), (5, e), (5, f), (5, a + " tail"), (8, e), (9, f)]
    near = simhash.near_duplicates(frame(spark, [(0, a, "en", "s", 0, "", 0, ""), (1, a + " tail", "en", "s", 0, "", 0, "")]))
    same = near.select("component_id").distinct().count() == 1
    got = simhash.keep_one(frame(spark, [(i, x, "en", "s", 0, "", 0, "") for i, x in data])).collect()
    want = [(None, b), (None, c), (3, d), (5, e), (5, f), (5, a + " tail")] + ([] if same else [(None, a)])
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("window", [5, 35])
def test_repeated_windows_match_brute_force(spark, window):
    from logsift.llm.substring import drop_repeated_windows
    docs = [(r[0], r[1]) for r in rows()]
    got = drop_repeated_windows(frame(spark), window, block_bytes=4000, texts=window == 5).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(repeated_words(docs, window))


def test_repeated_strings_match_brute_force(spark):
    from logsift.llm.suffixes import drop_repeated_strings
    docs = [(r[0], r[1]) for r in rows()]
    docs_frame = frame(spark)
    got = [tuple(r) for r in drop_repeated_strings(docs_frame, block_bytes=3000).collect()]
    assert sorted(got) == sorted(repeated_bytes(docs, 100))


def test_byte_windows_hold_for_runs_and_overlaps(spark):
    from logsift.llm.suffixes import drop_repeated_strings
    t = ["ab" * 300, "a" * 400, "x" + "ab" * 60, None, "b" * 99, ("q" * 50 + "r" * 60) * 3, "r" * 60 + "q" * 50 + "r" * 60]
    data = [(i, x, "en", "s", 0, "", 0, "") for i, x in enumerate(t)]
    got = [tuple(r) for r in drop_repeated_strings(frame(spark, data), block_bytes=500, texts=True).collect()]
    assert sorted(g[:5] for g in got) == sorted(repeated_bytes([(d[0], d[1]) for d in data], 100))


def test_empty_tables(spark):
    from logsift.llm.substring import drop_repeated_windows
    from logsift.llm.suffixes import drop_repeated_strings
    none = frame(spark, [])
    assert drop_repeated_windows(none).count() == 0
    assert drop_repeated_strings(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0


def test_corpus_has_the_awkward_cases():
    t = texts()
    assert None in t and "" in t and max(len(x or "") for x in t) > 50_000


def test_keep_one_leaves_extra_columns_alone(spark):
    extra = ["_h1", "_h2", "_id", "_k1", "_n", "h1", "k2", "id", "n", "row", "root", "doc", "none", "a.b"]
    data = [(1, "one two three four five", *["x"] * len(extra)), (2, "one two three four five", *["y"] * len(extra)),
            (None, "something else entirely in this text", *["z"] * len(extra)), (4, None, *["w"] * len(extra))]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in extra)
    got = simhash.keep_one(spark.createDataFrame(data, schema))
    assert got.columns == ["doc_id", "text", *extra]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((data[0], data[2], data[3]), key=str)
