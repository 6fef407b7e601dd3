"""Shards of rows that share a line number."""

from logsift.operators.windows import greedy_segments


def test_repeated_rows_are_sharded_as_written(spark):
    rows = [("f", n // 10, n, 7 + n % 5) for n in range(60) for _ in range(1 + (n % 3 > 0))]
    df = spark.createDataFrame(rows, "file string, chunk int, line_no int, size int")
    for limit in (8, 20, 45):
        shard, held, wanted = 0, 0, []
        for _, _, n, size in rows:
            if held >= limit:
                shard, held = shard + 1, 0
            wanted.append((n, shard))
            held += size
        out = greedy_segments(df.repartition(3), "size", "file", "chunk", "line_no", limit, out="shard")
        assert sorted((r.line_no, r.shard) for r in out.collect()) == sorted(wanted)
