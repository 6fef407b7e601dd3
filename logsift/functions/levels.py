"""Log-level column expressions (line parsing helpers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the behaviour being matched) -----------------
# Recognised level words, longest alternatives first.
KNOWN_LEVELS = ["CRITICAL", "ERROR", "WARNING", "WARN", "INFO", "DEBUG", "TRACE", "FATAL"]
# Aliases folded onto the vocabulary the evidence stages use.
LEVEL_ALIASES = {"WARNING": "WARN", "FATAL": "ERROR", "CRITICAL": "ERROR", "SEVERE": "ERROR"}
# Only the first 80 characters of a plain line are scanned for a level word.
LEVEL_SCAN_CHARS = 80
# ---------------------------------------------------------------------------

LEVEL_TOKEN_RE = r"(?i)\b(" + "|".join(KNOWN_LEVELS) + r"|SEVERE)\b"


def normalise_level(raw: Column) -> Column:
    """Upper-case + trim, apply aliases; unknown or empty -> NULL."""
    up = F.upper(F.trim(raw))
    # Build as a single CASE: aliases first, then known words, else NULL.
    case = None
    for alias, target in LEVEL_ALIASES.items():
        case = F.when(up == alias, F.lit(target)) if case is None else case.when(up == alias, F.lit(target))
    case = case.when(up.isin(*KNOWN_LEVELS), up)
    return case.otherwise(F.lit(None).cast("string"))


def scan_level_token(text: Column) -> Column:
    """First whole-word level token in the first 80 characters, normalised."""
    window = F.substring(text, 1, LEVEL_SCAN_CHARS)
    tok = F.regexp_extract(window, LEVEL_TOKEN_RE, 1)
    return normalise_level(F.nullif(tok, F.lit("")))


def is_error(level: Column) -> Column:
    """The error-branch test: exact ERROR after upper-casing."""
    return F.coalesce(F.upper(level) == F.lit("ERROR"), F.lit(False))
