"""Canonical log-record preparation: level normalisation and redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions.levels import normalise_level
from logsift.functions.redact import counts_map, redact


def prepare_records(lines: DataFrame, level_col: str = "level_raw", message: str = "message",
                    allow: Sequence[str] = ("flow_id",), extra_patterns=None,
                    redact_enabled: bool = True, default_level: str = "INFO") -> DataFrame:
    """Normalise the level and redact the message of every line.

    ``allow`` names per-row columns holding correlation ids that must survive
    redaction.  Adds ``level`` (normalised, default INFO) and ``redactions``
    (MAP<label, hits>).  Redaction runs before anything is written.
    """
    text, counts = redact(F.col(message), [F.col(c) for c in allow], extra_patterns, redact_enabled)
    return lines.withColumns({
        "level": F.coalesce(normalise_level(F.col(level_col)), F.lit(default_level)),
        message: text,
        "redactions": counts_map(counts),
    })


def redaction_totals(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of per-line redaction counts per pattern label (optionally per key)."""
    ex = records.select(*by, F.explode("redactions").alias("label", "hits"))
    return ex.groupBy(*by, "label").agg(F.sum("hits").alias("redacted"))
