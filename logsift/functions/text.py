"""Small text / JSON / time column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the behaviour being matched) -----------------
RFC3339_RE = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})"
KUBELET_PREFIX_RE = r"^(" + RFC3339_RE + r")\s+"
LEADING_TS_RE = r"^\[?(" + RFC3339_RE + r")\]?[\s,]*"
# Name sanitisers: pod/directory names, and case-id parts.
POD_NAME_UNSAFE_RE = r"[^a-z0-9.-]+"
CASE_ID_UNSAFE_RE = r"[^A-Za-z0-9_.:-]"
# ---------------------------------------------------------------------------


# ASCII whitespace a Python str.strip() removes (besides the Unicode spaces).
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def strip_ws(c: Column) -> Column:
    """Strip leading/trailing whitespace (all ASCII kinds, not just spaces);
    a character-set trim, no regex."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.when(strip_ws(c) == F.lit(""), F.lit(None).cast("string")).otherwise(c)


def json_path(key: str) -> str:
    """A get_json_object path addressing one literal top-level key."""
    return "$['" + key.replace("'", "\\'") + "']"


def is_json_object(text: Column) -> Column:
    """True when ``text`` (already stripped) is a JSON object."""
    return F.coalesce(text.startswith("{") & F.json_object_keys(text).isNotNull(), F.lit(False))


def first_json_key(text: Column, keys: Sequence[str], nested: bool = False) -> Column:
    """First non-null, non-empty value among ``keys`` of a JSON object text.

    ``nested=True`` also resolves dotted keys as paths when the literal key is
    absent.
    """
    vals = []
    for k in keys:
        v = F.get_json_object(text, json_path(k))
        if nested and "." in k:
            v = F.coalesce(v, F.get_json_object(text, "$." + k))
        vals.append(F.nullif(v, F.lit("")))
    return F.coalesce(*vals)


def sanitise_pod_name(c: Column, fallback: str = "unknown") -> Column:
    cleaned = F.regexp_replace(F.lower(F.trim(c)), POD_NAME_UNSAFE_RE, "-")
    cleaned = F.regexp_replace(cleaned, r"^[-.]+|[-.]+$", "")
    return F.when(cleaned == F.lit(""), F.lit(fallback)).otherwise(cleaned)


def sanitise_case_part(c: Column) -> Column:
    return F.regexp_replace(c, CASE_ID_UNSAFE_RE, "-")


def to_ts(rfc3339: Column) -> Column:
    """RFC3339 (any fraction length, Z or offset) -> TIMESTAMP (micros, UTC)."""
    return F.try_to_timestamp(rfc3339)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def py_fixed(x: Column, digits: int = 2) -> Column:
    """``f"{x:.Nf}"`` as Python formats it: correctly rounded from the exact
    binary value, ties to even.  (Spark's format_number/format_string round
    the shortest decimal form, which differs on values like 0.855.)

    x * 10^N is split into the rounded product and its exact error term
    (Veltkamp split, Dekker's two-product), which decides exact ties.
    Non-negative inputs only.
    """
    scale = float(10 ** digits)

    def split(a):
        c = a * F.lit(134217729.0)
        hi = c - (c - a)
        return hi, a - hi
    p = x * F.lit(scale)
    a_hi, a_lo = split(x)
    b_hi, b_lo = split(F.lit(scale))
    err = ((a_hi * b_hi - p) + a_hi * b_lo + a_lo * b_hi) + a_lo * b_lo
    f = F.floor(p)
    frac = p - f
    up = (F.when(frac > 0.5, True).when(frac < 0.5, False)
          .when(err > 0, True).when(err < 0, False).otherwise(f % 2 == 1))
    n = (f + F.when(up, 1).otherwise(0)).cast("bigint")
    whole = (n / F.lit(int(scale))).cast("bigint").cast("string")
    if digits == 0:
        return F.when(x.isNotNull(), whole)
    return F.when(x.isNotNull(), F.concat(whole, F.lit("."), F.lpad((n % F.lit(int(scale))).cast("string"), digits, "0")))
