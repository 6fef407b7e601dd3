"""Registered queries: template mining over whole document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.operators import templates as TM
from logsift.plans import oracle_views as ov
from logsift.plans.registry import query
from logsift.plans.views import table, v_text_line
from logsift.session import written


def _sql_mask(text: str) -> str:
    for pattern, replacement in TM.MASKS:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return f"trim(regexp_replace({text}, '{TM.BLANKS}', ' ', 'g'), ' ')"


_LINES = f"""
v_text_line AS (
  SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS flow_id, CAST(place - 1 AS BIGINT) AS seq,
         lpad(CAST(place - 1 AS VARCHAR), 8, '0') AS timestamp, message
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS message,
               generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents)
  WHERE trim(message, ' ') <> ''),
ml AS (SELECT *, {_sql_mask('message')} AS masked FROM v_text_line),
rest0 AS (
  SELECT masked, toks, list_concat([CAST(len(toks) AS VARCHAR)], list_transform([toks[1], coalesce(toks[2], '')],
           lambda t: CASE WHEN regexp_matches(t, '[0-9]') OR contains(t, '<') THEN '{TM.WILDCARD}' ELSE t END)) AS leaf
  FROM (SELECT DISTINCT masked, string_split(masked, ' ') AS toks FROM ml))"""


def _sql_round(i: int) -> str:
    """Round ``i``: token by token, one row a message and position."""
    return f"""
n{i} AS (SELECT leaf, count(*) AS n FROM rest{i} GROUP BY leaf),
t{i} AS (SELECT masked, leaf, n, unnest(toks) AS t, generate_subscripts(toks, 1) AS p
         FROM rest{i} JOIN n{i} USING (leaf) WHERE n > 1),
c{i} AS (SELECT leaf, p, t FROM t{i} GROUP BY leaf, p, t, n
         HAVING count(*) >= 2 AND count(*) * 100 >= n * {TM._percent(TM.COMMON_SHARE)}),
k{i} AS (SELECT masked, string_agg(coalesce(c{i}.t, '{TM.WILDCARD}'), ' ' ORDER BY t{i}.p) AS template,
                count(c{i}.t) FILTER (WHERE c{i}.t <> '{TM.WILDCARD}') AS common, count(*) AS size
         FROM t{i} LEFT JOIN c{i} ON c{i}.leaf = t{i}.leaf AND c{i}.p = t{i}.p AND c{i}.t = t{i}.t GROUP BY masked),
placed{i} AS (SELECT masked, template FROM k{i} WHERE common * 100 >= size * {TM._percent(TM.SIMILARITY)}),
rest{i + 1} AS (SELECT masked, toks, leaf FROM rest{i} WHERE masked NOT IN (SELECT masked FROM placed{i}))"""


_MINED = ",".join([_LINES, *[_sql_round(i) for i in range(TM.ROUNDS)]]) + """,
mined AS (SELECT *, 't_' || substr(sha256(template), 1, %d) AS template_id FROM (%s
          UNION ALL SELECT masked, masked FROM rest%d)),
assigned AS (SELECT flow_id, seq, timestamp, message, template_id, template FROM ml JOIN mined USING (masked))""" % (
    TM.ID_CHARS, " UNION ALL ".join(f"SELECT * FROM placed{i}" for i in range(TM.ROUNDS)), TM.ROUNDS)

_CATALOG = f"""
cl AS (SELECT flow_id, template_id, any_value(template) AS template, count(*) AS count,
              arg_min(timestamp, seq) AS first_seen, arg_max(timestamp, seq) AS last_seen, min(seq) AS first_seq,
              list(message ORDER BY seq)[1:{TM.EXAMPLES_PER_TEMPLATE}] AS examples
       FROM assigned GROUP BY flow_id, template_id),
cat AS (SELECT template_id, any_value(template) AS template, count(*) AS flows, CAST(sum(count) AS BIGINT) AS total_count,
               count(*) / (SELECT count(DISTINCT doc_id) FROM documents) AS pct
        FROM cl GROUP BY template_id),
classed AS (SELECT template_id, template, flows, total_count, round(pct, 4) AS pct_flows,
                   CASE WHEN regexp_matches(template, '{TM.DECISION_VOCABULARY_RE}') THEN 'decision-marker'
                        WHEN pct >= {TM.BOILERPLATE_SHARE} THEN 'boilerplate' ELSE 'informative' END AS classification
            FROM cat),
guarded AS (SELECT cl.* EXCLUDE (examples),
                   CASE WHEN count < {TM.RARE_TEMPLATE_THRESHOLD} THEN 'rare' ELSE classification END AS classification,
                   CASE WHEN count >= {TM.RARE_TEMPLATE_THRESHOLD} AND classification = 'boilerplate' THEN [] ELSE examples END
                   AS examples
            FROM cl JOIN classed USING (template_id))"""


def _assigned(spark, sf_dir):
    lines = v_text_line(spark, sf_dir)
    return TM.assign_templates(lines, TM.mine_templates(lines))


def _flows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("flow_id"))


def _clusters(spark, sf_dir):
    """Clusters are written once: the catalog and the report both read them."""
    cl = TM.in_full(written(TM.brief(TM.flow_clusters(_assigned(spark, sf_dir))), "clusters"))
    return cl, TM.template_catalog(cl, _flows(spark, sf_dir))


@query("template_assignment", ov.with_views(_MINED) + """
SELECT flow_id, seq, template_id, template FROM assigned""")
def template_assignment(spark, sf_dir):
    """Every document line with its mined template (one template per line)."""
    return _assigned(spark, sf_dir).select("flow_id", "seq", "template_id", "template")


@query("template_clusters", ov.with_views(_MINED, _CATALOG) + """
SELECT flow_id, template_id, template, count, first_seen, last_seen, classification,
       array_to_string(examples, chr(10)) AS examples FROM guarded""")
def template_clusters(spark, sf_dir):
    """Per flow and template: count, first/last seen, examples, catalog class,
    then the evidence guardrails (rare / boilerplate)."""
    cl, cat = _clusters(spark, sf_dir)
    out = TM.apply_guardrails(TM.classify_clusters(cl, cat))
    return out.select("flow_id", "template_id", "template", "count", "first_seen", "last_seen", "classification",
                      F.array_join("examples", "\n").alias("examples"))


@query("template_catalog", ov.with_views(_MINED, _CATALOG) + """
SELECT template_id, template, flows, total_count, pct_flows, classification FROM classed""")
def template_catalog(spark, sf_dir):
    """Cross-flow catalog: share of flows per template and its class."""
    return TM.template_catalog(TM.flow_clusters(_assigned(spark, sf_dir)), _flows(spark, sf_dir))


@query("template_report", ov.with_views(_MINED, _CATALOG) + """
SELECT flow_id, first_seq AS order_key, 0 AS line_in_block,
       '  [' || template_id || '] [Count:' || lpad(CAST(count AS VARCHAR), CAST(greatest(4, length(CAST(count AS VARCHAR))) AS INTEGER), ' ') || '] ['
       || classification || '] ' || template AS line FROM guarded
UNION ALL SELECT flow_id, first_seq, 1, '         first_seen=' || first_seen || '  last_seen=' || last_seen FROM guarded
UNION ALL SELECT flow_id, first_seq, place + 1, '         example: ' || example
FROM (SELECT flow_id, first_seq, unnest(examples) AS example, generate_subscripts(examples, 1) AS place FROM guarded)""")
def template_report(spark, sf_dir):
    """Reduced-report lines per flow (clusters in order of first appearance)."""
    cl, cat = _clusters(spark, sf_dir)
    return TM.render_report(TM.apply_guardrails(TM.classify_clusters(cl, cat)))
