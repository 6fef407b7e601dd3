import random
import tempfile

from logsift.operators.groups import dedupe_cases, group_rollup
from logsift.streaming import groupstate as GS

SCHEMA = "case_id string, seq long, fingerprint string, signature string, failure_class string, business_code string, verdict string, seen_at long"


def cases(rng, n, start, seq):
    return [(f"c{rng.randrange(start, start + n)}", seq + i, f"f{min(rng.randrange(6), 3)}", rng.choice(["", "s1", "s2", None]),
             rng.choice(["A", "B", None]), rng.choice([None, "X1"]), rng.choice([None, "CORROBORATED", "PARTIAL"]), start + i) for i in range(n)]


def plain(df):
    return sorted((r.fingerprint, r.occurrence_count, r.first_seen, r.last_seen, r.signature, r.failure_class, r.business_code,
                   sorted(r.corroboration_history.items()), list(r.members)) for r in df.collect())


def test_batches_equal_one_rollup_and_replays_change_nothing(spark):
    base, rng = tempfile.mkdtemp(prefix="logsift-groups-"), random.Random(1)
    state, index = GS.group_table(spark, f"{base}/groups", buckets=4), GS.RedeliveryIndex(spark, f"{base}/seen", buckets=4)
    batches = [cases(rng, 40, 0, 0), cases(rng, 30, 100, 1000), cases(rng, 30, 100, 8000)]
    batches[1] += [(c, 5000 + i, *rest) for i, (c, _, *rest) in enumerate(batches[0][:10])]        # redelivered
    for n, b in enumerate(batches):
        GS.update_group_state(state, index, spark.createDataFrame(b, SCHEMA), n, member_cap=7)
    every = dedupe_cases(spark.createDataFrame([r for b in batches for r in b], SCHEMA))
    want = plain(group_rollup(every, member_cap=7))
    assert plain(GS.group_view(state)) == want
    GS.update_group_state(state, index, spark.createDataFrame(batches[2], SCHEMA), 2, member_cap=7)
    assert plain(GS.group_view(state)) == want


def test_a_death_before_the_ids_are_recorded(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="logsift-groups-")
    state, index = GS.group_table(spark, f"{base}/groups", buckets=4), GS.RedeliveryIndex(spark, f"{base}/seen", buckets=4)
    rows = spark.createDataFrame([("a", 1, "f", "s", "A", None, "PARTIAL", 1)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(index, "record", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        try:
            GS.update_group_state(state, index, rows, 0)
        except OSError:
            pass
    GS.update_group_state(state, index, rows, 0)
    GS.update_group_state(state, index, rows, 1)                   # a redelivery in another batch
    assert [r.occurrence_count for r in GS.group_view(state).collect()] == [1]


def test_old_batches_are_not_opened(spark):
    """A thousand recorded batches: new ids open next to no file, a
    redelivered id opens its own."""
    from pyspark.sql import functions as F
    base = tempfile.mkdtemp(prefix="logsift-seen-")
    index = GS.RedeliveryIndex(spark, f"{base}/seen", buckets=2)
    ids = spark.range(20000).select(F.concat(F.lit("c"), "id").alias("case_id"), (F.col("id") % 1000).alias("n"))
    hashed = index._hashed(ids).join(ids, "case_id")

    def bloom(g):
        import numpy as np
        import pandas as pd
        bits = max(64, GS.BITS_PER_ID * len(g))
        on = np.zeros(bits, bool)
        on[GS._slots(g["h1"].to_numpy(), g["h2"].to_numpy(), bits).reshape(-1).astype(np.int64)] = True
        return pd.DataFrame({"bits": [bits], "filter": [np.packbits(on).tobytes()], "bucket": [g["bucket"].iloc[0]], "batch_id": [g["n"].iloc[0]]})
    # the thousand batches in one write, as record() would leave them
    for name, df in (("ids", hashed.select("case_id", "bucket", F.col("n").alias("batch_id"))),
                     ("filters", hashed.groupBy("bucket", "n").applyInPandas(bloom, "bits long, filter binary, bucket int, batch_id long"))):
        df.repartition(4, "bucket", "batch_id").write.partitionBy("bucket", "batch_id").parquet(f"{base}/seen/{name}")
    fresh = spark.createDataFrame([(f"new{i}",) for i in range(5)], "case_id string")
    assert len(index.suspects(fresh, 5000)) <= 2000 * 5 * 0.03
    again = spark.createDataFrame([("c77",), ("new1",)], "case_id string")
    assert 77 in {n for _, n in index.suspects(again, 5000)}
    assert [r.case_id for r in index.unseen(again, 5000).collect()] == ["new1"]
    assert sorted(r.case_id for r in index.unseen(again, 77).collect()) == ["c77", "new1"]     # its own batch is a replay
