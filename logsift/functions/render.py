"""Rendering of log lines and report headers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the behaviour being matched) -----------------
ERROR_MARKER = " *** "
PLAIN_MARKER = "     "
FULL_TRACE_BELOW = 50          # flows with fewer lines are kept whole
ERROR_CONTEXT_BEFORE = 200
ERROR_CONTEXT_AFTER = 200
RARE_TEMPLATE_THRESHOLD = 5
DECISION_VOCABULARY_RE = (
    r"(?i)"
    r"(?:approved|rejected|denied|final.?decision|rule\s.*triggered"
    r"|score.?threshold|validation.?failed|dedup.*reject"
    r"|packet.*status|enrolment.*result|biometric.*match"
    r"|MAN_DEDUP|operator.*reject|quality.*check.*fail)"
)
#: Lower-case words of which every text that matches the vocabulary holds one.
DECISION_WORDS = ("approved", "reject", "denied", "decision", "triggered", "threshold", "validation", "packet",
                  "enrolment", "biometric", "man_dedup", "quality")
# ---------------------------------------------------------------------------


def origin(app: Column, pod: Column) -> Column:
    """``app@pod`` when a pod is known, else the app name."""
    app_s = F.coalesce(app, F.lit(""))
    return F.when(F.coalesce(pod, F.lit("")) != F.lit(""), F.concat(app_s, F.lit("@"), pod)).otherwise(app_s)


def trace_line(ts: Column, app: Column, pod: Column, level: Column, message: Column) -> Column:
    """``[timestamp] [origin] [LEVEL] message``."""
    return F.concat(F.lit("["), F.coalesce(ts, F.lit("")), F.lit("] ["), origin(app, pod),
                    F.lit("] ["), F.coalesce(level, F.lit("")), F.lit("] "), F.coalesce(message, F.lit("")))


def short_line(ts: Column, level: Column, message: Column) -> Column:
    """``  [timestamp] [LEVEL] message`` (boundary / decision sections)."""
    return F.concat(F.lit("  ["), F.coalesce(ts, F.lit("")), F.lit("] ["), F.coalesce(level, F.lit("")),
                    F.lit("] "), F.coalesce(message, F.lit("")))
