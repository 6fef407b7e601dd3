"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.staging import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsift.llm.simhash import near_duplicates
    return near_duplicates(documents(spark, sf_dir))


@_query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsift.llm.packing import pack
    return pack(documents(spark, sf_dir))


@_query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsift.llm.decontam import contaminated
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_query
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsift.llm.lm import lm_scores
    return lm_scores(documents(spark, sf_dir))


@_query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsift.llm.suffixes import drop_repeated_strings
    return drop_repeated_strings(documents(spark, sf_dir))


@_query
def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsift.llm.secrets import secret_report
    return secret_report(documents(spark, sf_dir))


@_query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsift.llm.quality import quality_verdicts
    return quality_verdicts(documents(spark, sf_dir))


@_query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsift.llm.substring import drop_repeated_windows
    return drop_repeated_windows(documents(spark, sf_dir))


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsift.llm.toxicity import toxicity
    scored = toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


@_query
def op10_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsift.llm.binary_output import token_round_trip
    return token_round_trip(documents(spark, sf_dir))


@_query
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsift.llm.alignment import align_tokenizers
    return align_tokenizers(documents(spark, sf_dir))


@_query
def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsift.llm.embedding_dedup import near_duplicates
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_query
def op13_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsift.llm.hard_negatives import mine_hard_negatives
    from logsift.llm.vectors import finite
    v = F.col("embedding").cast("array<double>")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.when(finite(v), F.transform(v, lambda x: F.floor(256 * x).cast("double"))).alias("embedding"))
    return mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)


# Quality rules in SQL: same counts, same buckets, same fences.
_RATIO_SQL = {"c": ("word_chars", 100, 100), "s": ("n_symbols", 1000, 100), "d": ("n_dup_lines", 1000, 20)}


def _bucket_sql(num: str, scale: int) -> str:
    v = f"({scale} * {num} // n_words)"
    drop = f"CAST(greatest(length(bin({v})) - 10, 0) AS INTEGER)"
    return f"(({v} >> {drop}) << {drop})"


def _quality_sql() -> str:
    levels = []
    for depth, keys in ((0, "lang, source, "), (1, "lang, "), (2, "")):
        levels.append(f"""l{depth} AS (
          SELECT {keys}metric, max(t) n, min(bucket) FILTER (100*c >= 10*t) a, min(bucket) FILTER (100*c >= 50*t) m,
                 min(bucket) FILTER (100*c >= 90*t) b
          FROM (SELECT {keys}metric, bucket, sum(n) OVER (PARTITION BY {keys}metric ORDER BY bucket) c,
                       sum(n) OVER (PARTITION BY {keys}metric) t
                FROM (SELECT {keys}metric, bucket, sum(n) n FROM sk GROUP BY ALL))
          GROUP BY {keys}metric)""")
    sketch = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' metric, {_bucket_sql(num, k)} bucket, {slack} slack FROM good"
        for m, (num, k, slack) in _RATIO_SQL.items())
    tests = " AND ".join(
        f"coalesce({_bucket_sql(num, k)} BETWEEN max(lo) FILTER (metric='{m}') AND max(hi) FILTER (metric='{m}'), false)"
        for m, (num, k, _) in _RATIO_SQL.items())
    return f"""
    WITH d AS (SELECT row_number() OVER () rid, doc_id, lang, source, coalesce(text, '') t FROM documents),
    w AS (SELECT rid, unnest(ws) w, generate_subscripts(ws, 1) i
          FROM (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') ws FROM d)),
    g AS (SELECT rid, i, w x, lead(w) OVER o y, lead(w, 2) OVER o z FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
    r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) k FROM g WHERE z IS NOT NULL) WHERE k > 1),
    rw AS (SELECT rid, count(DISTINCT p) n FROM (SELECT rid, unnest([i, i + 1, i + 2]) p FROM r) GROUP BY rid),
    ln AS (SELECT rid, count(*) - count(DISTINCT l) n FROM (SELECT rid, unnest(string_split(t, chr(10))) l FROM d)
           WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
    c AS (SELECT rid, doc_id, lang, source,
                 CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) n_words,
                 CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) word_chars,
                 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols,
                 CAST(coalesce(ln.n, 0) AS BIGINT) n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) n_repeat_words
          FROM d LEFT JOIN ln USING (rid) LEFT JOIN rw USING (rid)),
    v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) base_failed FROM c),
    good AS (SELECT * FROM v WHERE NOT base_failed),
    sk AS (SELECT lang, source, metric, slack, bucket, count(*) n FROM ({sketch}) GROUP BY ALL),
    sl AS (SELECT DISTINCT metric, slack FROM sk),
    {', '.join(levels)},
    f AS (SELECT lang, source, metric, m - 5 * (b - m) - slack lo, greatest(m + 5 * (m - a), 2 * b - m) + slack hi FROM (
            SELECT l0.lang, l0.source, l0.metric, slack,
                   CASE WHEN l0.n >= 100 THEN l0.a WHEN l1.n >= 100 THEN l1.a ELSE l2.a END a,
                   CASE WHEN l0.n >= 100 THEN l0.m WHEN l1.n >= 100 THEN l1.m ELSE l2.m END m,
                   CASE WHEN l0.n >= 100 THEN l0.b WHEN l1.n >= 100 THEN l1.b ELSE l2.b END b
            FROM l0 JOIN l1 ON l0.metric = l1.metric AND l0.lang IS NOT DISTINCT FROM l1.lang
            JOIN l2 ON l0.metric = l2.metric JOIN sl ON sl.metric = l0.metric))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           (NOT base_failed AND {tests}) kept
    FROM v LEFT JOIN f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source
    GROUP BY rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""


ORACLES["op7_quality_rules"] = _quality_sql()


ORACLES["op12_embedding_near_dedup"] = """
    WITH RECURSIVE v AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id x, b.vec_id y FROM v a JOIN v b ON a.vec_id <> b.vec_id
              WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    reach(vec_id, seen) AS (
      SELECT x, x FROM links UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.seen)
    SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) n_links, coalesce(c, e.vec_id) component_id,
           coalesce(c, e.vec_id) = e.vec_id kept
    FROM embeddings e
    LEFT JOIN (SELECT x, count(*) n FROM links GROUP BY x) l ON l.x = e.vec_id
    LEFT JOIN (SELECT vec_id, min(seen) c FROM reach GROUP BY vec_id) r ON r.vec_id = e.vec_id"""

ORACLES["op13_hard_negative_mining"] = """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label,
             list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) e
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id anchor_id, b.vec_id id, a.label = b.label same, CAST(list_inner_product(a.e, b.e) AS BIGINT) score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, id positive_id, score positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id negative_id, positive_score, score negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY rank <= 5"""
