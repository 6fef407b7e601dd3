"""Quality rules with adaptive thresholds, in DataFrame functions only.

Per document: word, symbol, repeated-line and repeated-window counts.  The
fixed base rule rejects short and self-repeating texts.  Three shape ratios
(word length, symbols per word, repeated lines per word) are then compared
with fences taken from each (lang, source): the ratios are binned into
integer buckets of about 0.2 % relative width, and the bucket counts are the
quantile sketch.  Sketches add up, so they are built by partial aggregation
whatever the size of a source, and a group with too few documents takes the
sum of its language (or of the corpus).  Fences lie ``spread`` times the
lower (upper) half-width from the median, so they follow the bulk of a
source and not its outliers.  The upper one lies at least an upper half-width
beyond the 90 % quantile, so that counts which are zero in most documents of
a source, and not in the others, have a fence of that source too.

Defined results: null or blank text has no words and fails the base rule;
null lang or source form groups of their own; repeated rows are judged row
by row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.staging import materialise

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: metric -> (numerator, denominator, scale, least half-width of the fence)
RATIOS = {
    "chars_per_word": ("word_chars", "n_words", 100, 100),
    "symbols_per_word": ("n_symbols", "n_words", 1000, 100),
    "dup_lines_per_word": ("n_dup_lines", "n_words", 1000, 20),
}
#: Thresholds table rows up to which it is broadcast; beyond, a shuffle join.
BROADCAST_ROWS = 100_000


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of every text; ``keep`` names columns to carry along."""
    cols = [F.col(c) for c in ("doc_id", "lang", "source", *keep)]
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, "[ \\t-\\r]+", -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    return docs.select(
        *cols, F.size(words).cast("long").alias("n_words"),
        (F.length(text) - _count_of(text, BLANKS)).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(_let(words, _windows), _repeat_words).cast("long").alias("n_repeat_words"))


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once: a lambda variable is not
    copied into its uses when the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), 0)


def _windows(w: Column) -> Column:
    """3-word windows sorted by hash: equal windows become neighbours."""
    n = F.size(w)
    return F.array_sort(F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))


def _repeat_words(s: Column) -> Column:
    """Words in the windows that have an equal neighbour."""
    n = F.size(s)
    twins = F.filter(
        F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.get(s, k)["h"] == F.get(s, k - 1)["h"])
    return F.size(F.array_distinct(F.flatten(F.transform(twins, lambda k: F.array(*[
        F.get(s, j)["i"] + x for j in (k, k - 1) for x in range(3)])))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bucket(num: str, den: str, scale: int) -> Column:
    """Integer ratio with its 10 leading bits kept: the sketch's bucket."""
    v = F.floor(F.lit(scale) * F.col(num) / F.nullif(F.col(den), F.lit(0))).cast("long")
    drop = F.greatest(F.length(F.bin(v)) - 10, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def fences(measured: DataFrame, min_docs: int = 100, spread: int = 5) -> DataFrame:
    """Low and high fence of every ratio for each (lang, source)."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(a, b, k).alias("bucket"))
                     for m, (a, b, k, _) in RATIOS.items()])
    # no filter on the counts: pushed below them, it would take them twice
    long = (measured.select("lang", "source", F.explode(F.when(~base_failed(), each)).alias("x"))
            .select("lang", "source", "x.*"))
    sketch = materialise(long.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n")),
                         "quality-sketch")
    levels = []
    for depth, keys in ((0, ["lang", "source"]), (1, ["lang"]), (2, [])):
        merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "metric")
        run = merged.withColumn("_c", F.sum("n").over(w.orderBy("bucket"))).withColumn("_t", F.sum("n").over(w))
        at = lambda q: F.min(F.when(100 * F.col("_c") >= q * F.col("_t"), F.col("bucket")))
        levels.append(run.groupBy(*keys, "metric").agg(
            F.max("_t").alias(f"_n{depth}"), at(10).alias(f"_a{depth}"), at(50).alias(f"_m{depth}"),
            at(90).alias(f"_b{depth}")))
    own, lang, whole = levels
    lang = lang.withColumnRenamed("lang", "_lang").withColumnRenamed("metric", "_metric")
    whole = whole.withColumnRenamed("metric", "_whole")
    every = (own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("metric") == F.col("_metric")))
             .join(F.broadcast(whole), F.col("metric") == F.col("_whole")))     # one row per ratio
    level = F.when(F.col("_n0") >= min_docs, 0).when(F.col("_n1") >= min_docs, 1).otherwise(2)
    pick = lambda x: F.when(level == 0, F.col(f"_{x}0")).when(level == 1, F.col(f"_{x}1")).otherwise(F.col(f"_{x}2"))
    slack = F.element_at(F.create_map(*[F.lit(y) for m, r in RATIOS.items() for y in (m, r[3])]), F.col("metric"))
    every = every.select("lang", "source", "metric", pick("a").alias("a"), pick("m").alias("m"),
                         pick("b").alias("b"), slack.alias("slack"))
    one = lambda m, c: F.max(F.when(F.col("metric") == m, c))
    low = F.col("m") - F.lit(spread) * (F.col("b") - F.col("m")) - F.col("slack")
    high = F.greatest(F.col("m") + F.lit(spread) * (F.col("m") - F.col("a")), 2 * F.col("b") - F.col("m")) + F.col("slack")
    return every.groupBy("lang", "source").agg(
        *[one(m, low).alias(f"_low_{m}") for m in RATIOS], *[one(m, high).alias(f"_high_{m}") for m in RATIOS])


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept: the filter joined to the fences of the
    document's own (lang, source)."""
    limits = limits.withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang"))
                           & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for m, (a, b, k, _) in RATIOS.items():
        v = bucket(a, b, k)
        inside = inside & (v >= F.col(f"_low_{m}")) & (v <= F.col(f"_high_{m}"))
    return (joined.withColumn("base_failed", base_failed())
            .withColumn("kept", F.when(base_failed(), F.lit(False)).otherwise(F.coalesce(inside, F.lit(False)))))


def quality_verdicts(docs: DataFrame, min_docs: int = 100, spread: int = 5) -> DataFrame:
    """Counts, base_failed and kept of every document."""
    measured = materialise(measure(docs), "quality-counts")
    limits = materialise(fences(measured, min_docs, spread), "quality-fences")
    return judge(measured, limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, min_docs: int = 100, spread: int = 5) -> DataFrame:
    """The documents that pass, with their own columns.  The texts are never
    shuffled: the counts are taken a second time beside them."""
    limits = materialise(fences(measure(docs), min_docs, spread), "quality-fences")
    rows = docs.withColumn("_row", F.struct(*[F.col(c) for c in docs.columns]))
    return judge(measure(rows, keep=("_row",)), limits).where("kept").select("_row.*")
