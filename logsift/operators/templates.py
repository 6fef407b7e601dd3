"""Log template mining and the per-flow / cross-flow template tables.

Mining keeps the published prefix-tree idea (token count + leading tokens
name a leaf, similar messages of a leaf share a template) and decides by
counts instead of by arrival order, so that every step is an aggregate that
merges and no leaf is ever held in one task:

1. mask variable tokens with built-in ``regexp_replace`` (JVM side);
2. reduce to DISTINCT masked messages (map-side partial aggregation -- a
   message repeated a million times is one row);
3. per leaf and position, count the messages that hold each token.  A token
   held by enough of the leaf's messages is common and stays, any other
   becomes ``<*>``; a message with enough common tokens is placed;
4. messages of a leaf that were not placed are counted among themselves in
   the next round, where the rarer kinds are no longer outnumbered; what no
   round places keeps its own text as template;
5. join the message -> template map back and aggregate per flow.

What is known of a leaf is at most 1/share tokens a position, whatever the
number of its messages; the messages of a leaf meet that summary in
``salts`` parts.  The result depends on the set of messages alone: not on
their order, their partitioning or which flow came first.  Template ids are
content hashes and stable across runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions.render import DECISION_VOCABULARY_RE, DECISION_WORDS, RARE_TEMPLATE_THRESHOLD
from logsift.operators.sift import sift, sifted
from logsift.session import materialize, written

# --- fixed values (must equal the behaviour being matched) -----------------
WILDCARD = "<*>"
EXAMPLES_PER_TEMPLATE = 3
BOILERPLATE_SHARE = 0.90
BOILERPLATE_WARN_SHARE = 0.40
MIN_PHRASE_CHARS = 10
# ---------------------------------------------------------------------------

SIMILARITY = 0.4          # share of a message's positions that must hold common tokens
COMMON_SHARE = 0.2        # share of a leaf's messages that makes a token common (at least two of them)
ROUNDS = 3                # rounds of counting; each looks at what the rounds before did not place
SALTS = 16                # parts in which a leaf's messages meet the leaf's summary, at most
PART = 1000               # messages of a leaf that share one part
USUAL = "informative"     # class of most templates
FILTER_BITS = 1 << 26     # of the filters that keep lines where they are (8 MB of words)
ID_CHARS = 32             # hex characters of a template id (128 bits)
BLANKS = r"[ \t\n\x0B\f\r]+"
MASKS = [
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", WILDCARD),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", WILDCARD),
    (r"\b0x[0-9a-fA-F]+\b", WILDCARD),
    (r"[-+]?\b\d+(?:[.,:]\d+)*\b", "<NUM>"),
]


def mask_message(msg: Column) -> Column:
    """Variable tokens replaced by placeholders; whitespace collapsed."""
    text = F.coalesce(msg, F.lit(""))
    m = text
    for pat, rep in MASKS:
        m = F.regexp_replace(m, pat, rep)
    # every mask holds a digit or a hyphen, every blank to replace is one of these
    some = reduce(Column.__or__, [text.contains(c) for c in (*"0123456789-\t\n\x0B\f\r", "  ")])
    return F.trim(F.when(some, F.regexp_replace(m, BLANKS, " ")).otherwise(text))


def _message_id(masked: Column) -> Column:
    """16 bytes that stand for a masked message in joins."""
    return F.unhex(F.md5(masked))


def _template_id(template: Column) -> Column:
    return F.concat(F.lit("t_"), F.substring(F.sha2(template, 256), 1, ID_CHARS))


def leaf_key(masked: Column) -> Column:
    blanks = F.length(masked) - F.length(F.replace(masked, F.lit(" "), F.lit("")))
    second = F.substring_index(F.substring_index(masked, " ", 2), " ", -1)
    def norm(t):
        return F.when(t.rlike(r"\d") | t.contains("<"), F.lit(WILDCARD)).otherwise(t)
    return F.concat_ws("\u0001", (blanks + 1).cast("string"), norm(F.substring_index(masked, " ", 1)),
                       F.when(blanks > 0, norm(second)).otherwise(F.lit("")))


def _percent(share: float) -> int:
    """Shares are compared in whole per cent, without rounding at the limit."""
    return round(share * 100)


def _salt(salts: int) -> Column:
    return F.pmod(F.xxhash64("masked"), F.lit(salts)).cast("int")


def _salted(summary: DataFrame, salts: int | Column) -> DataFrame:
    salts = salts if isinstance(salts, Column) else F.lit(salts)
    return summary.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))


def _parts(salts: int) -> Column:
    """Parts of a leaf of ``_n`` messages: a small leaf's summary is not
    repeated."""
    return F.least(F.lit(salts), F.floor(F.col("_n") / PART) + 1).cast("int")


def _common_tokens(live: DataFrame, share: float) -> DataFrame:
    """(leaf, _n, _common): per position, in order, the tokens that enough of
    the leaf's messages hold there -- at most 1/share of them."""
    tokens = live.select("leaf", "_n", F.posexplode(F.split("masked", " ")).alias("_p", "_t"))
    held = tokens.groupBy("leaf", "_p", "_t").agg(F.count(F.lit(1)).alias("_s"), F.max("_n").alias("_n"))
    common = (F.col("_s") >= 2) & (F.col("_s") * 100 >= F.col("_n") * _percent(share))
    places = held.groupBy("leaf", "_p").agg(F.collect_list(F.when(common, F.col("_t"))).alias("_tokens"), F.max("_n").alias("_n"))
    return places.groupBy("leaf").agg(F.max("_n").alias("_n"), F.transform(
        F.array_sort(F.collect_list(F.struct("_p", "_tokens"))), lambda x: x["_tokens"]).alias("_common"))


def _place(rest: DataFrame, threshold: float, share: float, salts: int) -> DataFrame:
    """One round over messages (masked, leaf): (masked, leaf, template); the
    template is null where the message has too few common tokens, and
    the only message left of a leaf keeps its text."""
    sizes = rest.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    parts = rest.withColumn("_salt", _salt(salts)).join(_salted(sizes, salts), ["leaf", "_salt"], "left")
    summary = _common_tokens(parts.where(F.col("_n").isNotNull()), share)
    mine = F.pmod(F.xxhash64("masked"), F.coalesce(_parts(salts), F.lit(1))).cast("int")
    joined = parts.withColumn("_salt", mine).drop("_n").join(
        _salted(summary, _parts(salts)).drop("_n"), ["leaf", "_salt"], "left")
    alone = F.col("_common").isNull()
    kept = F.transform(F.split("masked", " "), lambda t, i: F.when(
        F.array_contains(F.get(F.col("_common"), i), t), t).otherwise(F.lit(WILDCARD)))
    scored = joined.withColumn("_kept", F.when(~alone, kept))
    n_common = F.size(F.filter("_kept", lambda t: t != WILDCARD))
    template = (F.when(alone, F.col("masked"))
                .when(n_common * 100 >= F.size("_kept") * _percent(threshold), F.array_join("_kept", " ")))
    return scored.select("masked", "leaf", template.alias("template"))


def mine_templates(lines: DataFrame, message: str = "message", threshold: float = SIMILARITY,
                   share: float = COMMON_SHARE, rounds: int = ROUNDS, salts: int = SALTS) -> DataFrame:
    """Message -> template map: (masked, template, template_id), one row for
    each distinct masked message whose template is not the message itself
    (:func:`assign_templates` gives the others their own text).

    A null message counts as the empty one; no lines give an empty table.  A
    template has as many tokens as its message and equals it wherever it has
    no ``<*>``.  A first pass over the lines names the leaves that hold more
    than one message, from 8 bytes a message; only the texts of those leaves
    are moved, made distinct and counted.  What a round leaves is written to
    the checkpoint folder, as the next round reads it several times.
    """
    masked = lines.select(mask_message(F.col(message)).alias("masked")).withColumn("leaf", leaf_key(F.col("masked")))
    ids = masked.select("leaf", F.xxhash64("masked").alias("_id")).groupBy("leaf").agg(
        F.min("_id").alias("_least"), F.max("_id").alias("_greatest"))
    several = materialize(ids.where(F.col("_least") != F.col("_greatest")).select("leaf"))
    near = sift(masked, several, "leaf").distinct().withColumn("_salt", _salt(salts))
    rest = materialize(near.join(_salted(several, salts), ["leaf", "_salt"]).select("masked", "leaf"))
    done = []
    for _ in range(rounds):
        result = written(_place(rest, threshold, share, salts), "templates")
        done.append(result.where(F.col("template") != F.col("masked")).select("masked", "template"))
        rest = result.where(F.col("template").isNull()).select("masked", "leaf")
    return reduce(DataFrame.unionByName, done).withColumn("template_id", _template_id(F.col("template")))


def assign_templates(lines: DataFrame, mined: DataFrame, message: str = "message") -> DataFrame:
    """Attach template / template_id to every line: those of ``mined``, else
    the masked message itself.  Columns of these two names are replaced.
    Only lines whose message may be in ``mined`` are moved."""
    lines = lines.drop("template", "template_id")
    own = lines.withColumn("_own", mask_message(F.col(message))).withColumn("_id", _message_id(F.col("_own")))
    mapped = mined.select(_message_id(F.col("masked")).alias("_id"), "template", "template_id")
    near, others = sifted(own, mapped, "_id", FILTER_BITS)
    template = F.coalesce("template", "_own").alias("template")
    found = near.join(mapped.drop("template_id"), "_id", "left").select(*lines.columns, template)
    every = found.unionByName(others.select(*lines.columns, F.col("_own").alias("template")))
    return every.withColumn("template_id", _template_id(F.col("template")))


def flow_clusters(assigned: DataFrame, flow: str = "flow_id", seq: str = "seq", ts: str = "timestamp",
                  message: str = "message", examples: int = EXAMPLES_PER_TEMPLATE) -> DataFrame:
    """Per (flow, template): count, first_seen, last_seen (last in feed order)
    and the first ``examples`` messages; partial aggregates without texts plus
    a per-key top-N (trimmed before the shuffle) that brings them."""
    key = [flow, "template_id"]
    stats = assigned.groupBy(*key).agg(
        F.count(F.lit(1)).alias("count"),
        F.min_by(F.col(ts), F.col(seq)).alias("first_seen"), F.max_by(F.col(ts), F.col(seq)).alias("last_seen"),
        F.min(seq).alias("first_seq"))
    ranked = assigned.select(*key, "template", seq, message).withColumn(
        "_rk", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(seq))))
    ex = (ranked.where(F.col("_rk") <= max(1, examples)).groupBy(*key)
          .agg(F.max(F.when(F.col("_rk") == 1, F.col("template"))).alias("template"),
               F.transform(F.slice(F.array_sort(F.collect_list(F.struct("_rk", F.col(message).alias("m")))), 1, examples),
                           lambda x: x["m"]).alias("examples")))
    return stats.join(ex, key)


def brief(clusters: DataFrame) -> DataFrame:
    """Clusters of :func:`assign_templates` lines without what their examples
    tell: the template where it is the first message's own masked text, and
    the id.  :func:`in_full` brings both back."""
    own = mask_message(F.get("examples", F.lit(0)))
    return clusters.withColumn("template", F.nullif("template", own)).drop("template_id")


def in_full(clusters: DataFrame) -> DataFrame:
    """Clusters with the templates and ids that :func:`brief` left out."""
    template = F.coalesce("template", mask_message(F.get("examples", F.lit(0))))
    return clusters.withColumn("template", template).withColumn("template_id", _template_id(F.col("template")))


def template_catalog(clusters: DataFrame, requested_flows: DataFrame, flow: str = "flow_id",
                     decision_re: str = DECISION_VOCABULARY_RE) -> DataFrame:
    """Share of requested flows containing each template -> classification:
    decision-marker (vocabulary match, wins), boilerplate (>= 0.90 of flows),
    informative.  ``clusters`` has one row per flow and template; the
    denominator counts requested flows, with or without lines."""
    n = requested_flows.select(flow).distinct().agg(F.count(F.lit(1)).alias("_flows"))
    told = F.col("template").rlike(decision_re)
    if decision_re == DECISION_VOCABULARY_RE:             # plain words first: most templates hold none
        lower = F.lower("template")
        told = reduce(Column.__or__, [lower.contains(w) for w in DECISION_WORDS]) & told
    # the vocabulary is looked up before the shuffle: who needs the classes alone moves no text
    per = clusters.groupBy("template_id").agg(F.first("template").alias("template"),
                                              F.first(told).alias("_decision"),
                                              F.count(F.lit(1)).alias("flows"),
                                              F.sum("count").alias("total_count"))
    c = per.crossJoin(F.broadcast(n))
    pct = F.col("flows") / F.col("_flows")
    cls = (F.when(F.col("_decision"), F.lit("decision-marker"))
           .when(pct >= BOILERPLATE_SHARE, F.lit("boilerplate")).otherwise(F.lit(USUAL)))
    return c.select("template_id", "template", "flows", "total_count", F.round(pct, 4).alias("pct_flows"),
                    cls.alias("classification"))


def classify_clusters(clusters: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Template -> classification from the catalog, default ``unknown``.

    Ids alone are joined to find the templates that are not simply ``USUAL``
    (another class, none, or several rows in the catalog); these are written,
    and only the clusters that may be of one of them are moved."""
    if catalog is None:
        return clusters.withColumn("classification", F.lit("unknown"))
    unknown = F.lit("unknown")
    cat = catalog.groupBy("template_id").agg(F.collect_list(F.coalesce("classification", unknown)).alias("_classes"))
    classes = F.coalesce("_classes", F.array(unknown)).alias("_classes")
    other = materialize(clusters.select("template_id").distinct().join(cat, "template_id", "left")
                        .select(F.col("template_id").alias("_id"), classes).where(F.col("_classes") != F.array(F.lit(USUAL))))
    near, rest = sifted(clusters.withColumn("_id", F.col("template_id")), other, "_id", FILTER_BITS)
    near = near.drop("_id").join(other, F.col("template_id").eqNullSafe(F.col("_id")), "left").withColumn(
        "classification", F.explode(F.coalesce("_classes", F.array(F.lit(USUAL)))))
    return near.select(*clusters.columns, "classification").unionByName(
        rest.select(*clusters.columns, F.lit(USUAL).alias("classification")))


def apply_guardrails(clusters: DataFrame, rare_below: int = RARE_TEMPLATE_THRESHOLD) -> DataFrame:
    """Rare (count < 5) is relabelled and keeps examples (decided first);
    boilerplate loses its examples; everything else keeps them."""
    rare = F.col("count") < rare_below
    return clusters.withColumns({
        "classification": F.when(rare, F.lit("rare")).otherwise(F.col("classification")),
        "examples": F.when(~rare & (F.col("classification") == "boilerplate"), F.array().cast("array<string>"))
        .otherwise(F.col("examples")),
    })


def boilerplate_phrases(catalog: DataFrame, min_chars: int = MIN_PHRASE_CHARS) -> DataFrame:
    """Exclusion phrases: boilerplate templates without placeholders, kept
    when longer than ``min_chars``."""
    phrase = F.trim(F.regexp_replace(F.regexp_replace("template", r"<\*>|<NUM>", ""), r"\s+", " "))
    return (catalog.where(F.col("classification") == "boilerplate").select("template_id", phrase.alias("phrase"))
            .where(F.length("phrase") > min_chars))


def render_report(clusters: DataFrame, flow: str = "flow_id") -> DataFrame:
    """Reduced-report lines per flow, clusters in order of first appearance:
    ``  [tid] [Count:   n] [class] template`` + first/last seen + examples."""
    head = F.format_string("  [%s] [Count:%4d] [%s] %s", "template_id", "count", "classification", "template")
    seen = F.concat(F.lit("         first_seen="), F.coalesce(F.col("first_seen"), F.lit("")), F.lit("  last_seen="),
                    F.coalesce(F.col("last_seen"), F.lit("")))
    ex = F.transform(F.slice("examples", 1, 3), lambda e: F.concat(F.lit("         example: "), e))
    block = F.concat(F.array(head, seen), F.coalesce(ex, F.array().cast("array<string>")))
    return clusters.select(flow, F.col("first_seq").alias("order_key"), F.posexplode(block).alias("line_in_block", "line"))


def catalog_health(catalog: DataFrame, warn_share: float = BOILERPLATE_WARN_SHARE) -> DataFrame:
    """Share of catalog templates classified boilerplate, and the warning
    flag when it exceeds 0.40 (a catalog that hides too much)."""
    agg = catalog.agg(F.count(F.lit(1)).alias("templates"),
                      F.count_if(F.col("classification") == "boilerplate").alias("boilerplate"))
    share = F.when(F.col("templates") > 0, F.col("boilerplate") / F.col("templates")).otherwise(F.lit(0.0))
    return agg.withColumns({"boilerplate_share": share, "warn": share > warn_share})
