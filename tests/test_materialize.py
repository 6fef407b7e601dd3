"""Written intermediates: compressed Parquet that branches read by column."""

from pyspark.sql import functions as F

from logsift.session import materialize


def test_materialize_is_read_by_column(spark):
    df = spark.range(100).select("id", F.array(F.lit("x"), F.lit(None)).alias("tags"), F.lit("long text").alias("text"))
    out = materialize(df)
    assert out.inputFiles() and all(f.endswith(".parquet") for f in out.inputFiles())
    assert sorted(out.collect()) == sorted(df.collect())


def test_materialize_keeps_what_parquet_cannot_hold(spark):
    df = spark.range(3).select("id", F.lit(None).alias("nothing"))
    assert sorted(materialize(df).collect()) == sorted(df.collect())
