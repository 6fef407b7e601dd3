"""Reference catalogs: the reason-code CSV (header aliases, positional
fallback, last duplicate wins), reason codes extracted from source text, and
the rules-table schema drift check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.operators.windows import chunked_ffill

# --- fixed values (must equal the behaviour being matched) -----------------
CODE_COLUMNS = ["code", "reason_code", "reasoncode", "error_code", "errorcode", "business_code", "businesscode", "key"]
DESC_COLUMNS = ["description", "desc", "message", "reason", "text", "detail", "error_description"]
CATEGORY_COLUMNS = ["category", "reason_category", "error_reason_category"]
CATEGORY_SOURCE_COLUMNS = ["category_source", "categorysource"]
CLASS_COLUMNS = ["failure_class", "class", "failureclass"]
STAGE_COLUMNS = ["stage"]
NUMERIC_ID_COLUMNS = ["numeric_id", "id", "numericid"]
ENUM_RE = (r'^\s*([A-Z][A-Z0-9_]*)\s*\(\s*"([^"]+)"\s*,\s*"([^"]*)"\s*,\s*'
           r'((?:Error)?ReasonCategory)\.([A-Z_]+)\s*\)')
MAP_RE = (r'^\s*tempMap\.put\(\s*(\d+)\s*,\s*new ReasonCode\(\s*"([^"]+)"\s*,\s*'
          r'"([^"]*)"\s*\)\s*\)')
CHUNK_LINES = 10000
MAP_BLOCK_MARKER = "tempMap = new HashMap"
STAGE_RE = r"^//\s*##\s*(.+?)\s*$"
ID_PREFIX_CATEGORY = {"17": "BUSINESS_EXCEPTION", "37": "TECHNICAL_EXCEPTION", "12": "TECHNICAL_EXCEPTION"}
CATEGORY_CLASS = {"BUSINESS_VALIDATION_ERROR": "A", "BUSINESS_EXCEPTION": "A", "TECHNICAL_EXCEPTION": "C"}
# ---------------------------------------------------------------------------


def _pick(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The column whose name (trimmed, without BOM) is the best-ranked alias;
    of two such columns the later one."""
    rank = {alias: i for i, alias in reversed(list(enumerate(candidates)))}
    named = [(rank.get(c.strip().lower().lstrip("\ufeff")), -i) for i, c in enumerate(columns)]
    best = min((x for x in named if x[0] is not None), default=None)
    return None if best is None else columns[-best[1]]


def normalise_catalog(raw: DataFrame, order: str = "_row") -> DataFrame:
    """Catalog rows with columns found by alias (BOM tolerated), the first
    two columns as code/description when no alias matches, blanks as empty,
    last duplicate code wins."""
    cols = [c for c in raw.columns if c != order]
    code = _pick(cols, CODE_COLUMNS) or (cols[0] if cols else None)
    desc = _pick(cols, DESC_COLUMNS) or (cols[1] if len(cols) > 1 else None)
    pick = {"code": code, "description": desc, "category": _pick(cols, CATEGORY_COLUMNS),
            "category_source": _pick(cols, CATEGORY_SOURCE_COLUMNS), "failure_class": _pick(cols, CLASS_COLUMNS),
            "stage": _pick(cols, STAGE_COLUMNS), "numeric_id": _pick(cols, NUMERIC_ID_COLUMNS)}
    sel = [F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(k) if c else F.lit("").alias(k) for k, c in pick.items()]
    df = raw.select(*sel, F.col(order)).where(F.col("code") != "")
    last = df.groupBy("code").agg(F.max_by(F.struct(*[c for c in pick if c != "code"]), F.col(order)).alias("_r"))
    return last.select("code", "_r.*")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Reason-code CSV -> normalised catalog (reference-sized; broadcast it)."""
    raw = (spark.read.option("header", True).csv(path)
           .withColumn("_row", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                                        F.monotonically_increasing_id())))
    return normalise_catalog(raw)


def codes_from_source(lines: DataFrame, file: str = "file", line_no: str = "line_no", line: str = "line",
                      chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Reason codes declared in source text.

    Enum rows carry a declared category; id-keyed map rows infer one from the
    id's two-digit prefix; commented-out rows are skipped; the stage
    (``// ## Name``) and section (other ``//`` comments) in force are carried
    to the following rows and reset when the map block starts.  A code in
    both keeps the declared row and takes the map's numeric id.  A file is
    read in chunks of ``chunk_lines`` line numbers, so no file is one task.
    """
    st = F.trim(F.col(line))
    marker = F.col(line).contains(MAP_BLOCK_MARKER)
    # as structs, null files and line numbers equal each other in joins
    df = lines.withColumns({"_st": st, "_file": F.struct(F.col(file)),
                            "_chunk": F.struct(F.floor(F.col(line_no) / chunk_lines))})
    first = df.where(marker).groupBy("_file").agg(F.min(F.struct(line_no)).alias("_first"))   # one row a file
    df = df.join(F.broadcast(first), "_file", "left")
    first_marker = marker & F.coalesce(F.struct(line_no) == F.col("_first"), F.lit(False))
    is_comment = F.col("_st").startswith("//")
    commented_entry = is_comment & (F.col("_st").contains("tempMap.put")
                                    | F.regexp_replace(F.col("_st"), "^/+", "").rlike(ENUM_RE))
    stage_txt = F.regexp_extract(F.col("_st"), STAGE_RE, 1)
    clean = F.trim(F.substring_index(F.trim(F.regexp_replace(F.col("_st"), "^/+", "")), "::", 1))
    df = df.withColumns({
        "_stage_set": F.when(is_comment & ~commented_entry & (stage_txt != ""),
                             F.trim(F.substring_index(F.trim(stage_txt), "::", 1))),
        "_section_set": F.when(is_comment & ~commented_entry & (stage_txt == ""), clean),
        "_skip": first_marker | is_comment,
    })
    # the start of the map block clears both; a new stage clears the section
    cleared = F.when(first_marker, F.lit(""))
    df = df.withColumns({
        "_stage_at": F.coalesce(F.col("_stage_set"), cleared),
        "_section_at": F.coalesce(F.col("_section_set"), F.when(F.col("_stage_set").isNotNull(), F.lit("")), cleared)})
    df = chunked_ffill(df, ["_stage_at", "_section_at"], "_file", "_chunk", line_no)
    df = df.withColumns({"stage": F.coalesce("_stage_at", F.lit("")), "section": F.coalesce("_section_at", F.lit(""))})
    body = df.where(~F.col("_skip"))
    enum = body.where(F.col(line).rlike(ENUM_RE)).select(
        F.regexp_extract(line, ENUM_RE, 2).alias("code"), F.trim(F.regexp_extract(line, ENUM_RE, 3)).alias("description"),
        F.regexp_extract(line, ENUM_RE, 5).alias("category"), "stage", "section", file, line_no)
    mp = body.where(F.col(line).rlike(MAP_RE)).select(
        F.regexp_extract(line, MAP_RE, 2).alias("code"), F.trim(F.regexp_extract(line, MAP_RE, 3)).alias("description"),
        F.regexp_extract(line, MAP_RE, 1).alias("numeric_id"), "stage", "section", file, line_no)
    pos = F.struct(file, line_no)
    e = enum.groupBy("code").agg(F.max_by(F.struct("description", "category", "stage", "section"), pos).alias("_e"),
                                 F.min(pos).alias("_e_first"))
    m = mp.groupBy("code").agg(F.min_by(F.struct("description", "numeric_id", "stage", "section"), pos).alias("_m"),
                               F.max_by("numeric_id", pos).alias("_m_last_id"), F.min(pos).alias("_m_first"))
    j = e.join(m, "code", "full")
    prefix = F.substring(F.col("_m.numeric_id"), 1, 2)
    inferred = None
    for k, v in ID_PREFIX_CATEGORY.items():
        inferred = F.when(prefix == k, F.lit(v)) if inferred is None else inferred.when(prefix == k, F.lit(v))
    inferred = F.coalesce(inferred, F.lit(""))
    declared = F.col("_e").isNotNull()
    category = F.when(declared, F.col("_e.category")).otherwise(inferred)
    cls = None
    for k, v in CATEGORY_CLASS.items():
        cls = F.when(category == k, F.lit(v)) if cls is None else cls.when(category == k, F.lit(v))
    out = j.select(
        "code",
        F.when(declared, F.col("_e.description")).otherwise(F.col("_m.description")).alias("description"),
        category.alias("category"),
        F.when(declared, F.lit("declared")).when(inferred != "", F.lit("inferred")).otherwise(F.lit("")).alias("category_source"),
        F.coalesce(cls, F.lit("")).alias("failure_class"),
        F.when(declared, F.col("_e.stage")).otherwise(F.col("_m.stage")).alias("stage"),
        F.when(declared, F.col("_e.section")).otherwise(F.col("_m.section")).alias("section"),
        F.coalesce(F.col("_m_last_id"), F.lit("")).alias("numeric_id"),
        F.coalesce(F.col("_e_first"), F.col("_m_first")).alias("_order"))
    return out


def catalog_report(catalog: DataFrame) -> DataFrame:
    """Counts by (category, source) and by stage, plus uncategorised codes."""
    by_cat = catalog.groupBy(F.when(F.col("category") == "", "(none)").otherwise(F.col("category")).alias("category"),
                             F.when(F.col("category_source") == "", "-").otherwise(F.col("category_source"))
                             .alias("category_source")).agg(F.count(F.lit(1)).alias("codes"))
    return by_cat.withColumn("kind", F.lit("category"))


def column_drift(spark: SparkSession, columns: Sequence[str], expected: Sequence[str]) -> DataFrame:
    """One row per name: its column, and whether it is matched, unknown
    (present only) or missing (expected only)."""
    name = F.lower(F.trim("name"))
    table = lambda names, flag: (spark.createDataFrame([(n,) for n in names], "name string")
                                 .select(name.alias("name")).where("name <> ''").distinct().withColumn(flag, F.lit(True)))
    both = table(columns, "present").join(table(expected, "wanted"), "name", "full")
    return both.select("name", F.when(F.col("present") & F.col("wanted"), "matched")
                       .when(F.col("present"), "unknown").otherwise("missing").alias("state"))


def schema_drift(spark: SparkSession, columns: Sequence[str], expected: Sequence[str],
                 first_value: str | None = None) -> DataFrame:
    """One summary row: status (OK, DRIFT, or SINGLE_COLUMN when a wide table
    arrives as one column), broken_export (that one column holds a header),
    unknown and missing names."""
    drift = column_drift(spark, columns, expected)
    names = lambda state: F.array_sort(F.collect_list(F.when(F.col("state") == state, F.col("name"))))
    head = F.lower(F.trim(F.lit(first_value or "")))
    row = drift.agg(names("unknown").alias("unknown"), names("missing").alias("missing"),
                    F.count_if(F.col("state") != "missing").alias("_have"), F.count_if(F.col("state") != "unknown").alias("_want"),
                    F.bool_or((F.col("state") != "unknown") & (F.col("name") == head)).alias("_expected_name"),
                    F.bool_or((F.col("state") != "missing") & (F.col("name") == head)).alias("_own_name"))
    single = (F.col("_have") == 1) & (F.col("_want") > 1)
    none = F.array().cast("array<string>")
    return row.select(
        F.when(single, "SINGLE_COLUMN").when(F.size("unknown") + F.size("missing") > 0, "DRIFT").otherwise("OK").alias("status"),
        (single & (F.col("_expected_name") | F.col("_own_name"))).alias("broken_export"),
        F.when(single, none).otherwise(F.col("unknown")).alias("unknown"),
        F.when(single, none).otherwise(F.col("missing")).alias("missing"))
