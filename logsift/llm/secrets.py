"""Secret scan with corpus-wide ownership frequency.

Patterns find candidate spans in every text: assignments, access keys and
hex runs (the base kinds), and long mixed letter-digit words (kind
``mixed``, kept only when the corpus says they look live).  The value of each
candidate is hashed and counted over the corpus by distinct repositories
(documents) and distinct owners (sources).  A value that many owners or many
repositories hold is a copied example; one that stays with few owners and few
repositories is owner-specific and looks live.

Counting goes value -> (value, owner) -> value in partial aggregates, so a
value that a third of the documents hold is added up before it is shuffled.

Defined results: null and empty texts have no spans; positions are code
points, end exclusive; a null source is an owner of its own; rows of equal
doc_id stay separate rows (but one repository); an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.staging import materialise

KINDS = ("assign", "access", "hex", "mixed")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")            # a run of 24 or more is the whole run
MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
_HINT = re.compile(_KEYS)


def _mixed(v: str) -> bool:
    return any(c.isdigit() for c in v) and any(c.isupper() for c in v) and any(c.islower() for c in v)


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of every candidate, by start then kind."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    taken = [(a, e) for a, _, e, _ in out]
    out += [(m.start(), 3, m.end(), m[0]) for m in MIXED.finditer(text)
            if _mixed(m[0]) and not any(a < m.end() and m.start() < e for a, e in taken)]
    return sorted(out)


SPAN = "struct<start:long,kind:int,end:long,value:string>"


def candidates(docs: DataFrame) -> DataFrame:
    """One row per document with its candidate spans and a row number that
    tells equal rows apart."""
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string())]))
    names = ("doc_id", "source")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*names).schema)

    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            spans = [[{"start": a, "kind": k, "end": e, "value": hashlib.sha256(v.encode()).hexdigest()}
                      for a, k, e, v in find(t or "")] for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(range(row, row + b.num_rows), pa.int64()), pa.array(spans, kinds)],
                [*b.schema.names[:-1], "_row", "spans"])
            row += b.num_rows

    return docs.select(*names, F.col("text").cast("string").alias("_text")).mapInArrow(
        run, f"{fields}, _row long, spans array<{SPAN}>")


def ownership(found: DataFrame) -> DataFrame:
    """n_repos and n_owners of every candidate value."""
    held = found.select("doc_id", "source", F.explode(F.array_distinct(F.transform("spans", lambda s: s["value"]))).alias("value"))
    per_repo = held.groupBy("value", "source", "doc_id").agg(F.lit(1).alias("n"))
    return (per_repo.groupBy("value", "source").agg(F.sum("n").alias("n"))
            .groupBy("value").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners")))


def _live(example_owners: int, example_repos: int) -> F.Column:
    return (F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos)


def scan(docs: DataFrame, example_owners: int = 4, example_repos: int = 100) -> DataFrame:
    """Per document row: doc_id, _row and ``spans`` with kind, start, end,
    n_repos, n_owners and live (held by fewer than ``example_owners`` owners
    and fewer than ``example_repos`` repositories)."""
    found = materialise(candidates(docs), "secret-candidates")
    spans = found.where(F.size("spans") > 0)
    each = spans.select("_row", F.explode("spans").alias("s")).select("_row", "s.*")
    judged = (each.join(ownership(spans), "value")
              .withColumn("live", _live(example_owners, example_repos))
              .groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(
                  "start", "kind", "end", "n_repos", "n_owners", "live"))).alias("spans")))
    none = F.array().cast("array<struct<start:long,kind:int,end:long,n_repos:long,n_owners:long,live:boolean>>")
    return (found.select("doc_id", "_row").join(judged, "_row", "left")
            .withColumn("spans", F.coalesce("spans", none)))


def _listed(spans) -> F.Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, example_owners: int = 4, example_repos: int = 100) -> DataFrame:
    """Counts and spans per document; ``spans`` adds to the base kinds the
    mixed words that look live."""
    rows = scan(docs, example_owners, example_repos)
    base = F.filter("spans", lambda s: s["kind"] < 3)
    shown = F.filter("spans", lambda s: (s["kind"] < 3) | s["live"])
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(shown).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"))


def _marked(text, spans, mark: str) -> F.Column:
    """``text`` with every span of the sorted ``spans`` replaced by ``mark``
    (overlapping ones by one)."""
    none = F.array().cast("array<struct<start:long,end:long>>")
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    merged = F.aggregate(spans, none, lambda acc, s: F.when(
        last(acc)["end"] > s["start"],
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), F.transform(merged, lambda s: s["end"])),
        F.concat(F.transform(merged, lambda s: s["start"]), F.array(F.length(text).cast("long"))),
        lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.array_join(gaps, mark)


def redact(docs: DataFrame, example_owners: int = 4, mark: str = "<SECRET>", example_repos: int = 100) -> DataFrame:
    """The documents with every live-looking value's span replaced by
    ``mark`` (overlapping spans by one mark) and n_chars set anew where a
    text changed; copied examples stay.  One pass writes the documents with
    their candidate spans; only those that have some meet the verdicts, the
    texts of all others are not shuffled."""
    # the documents travel as one struct, so no column of theirs can clash
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    found = materialise(_with_spans(whole, docs.schema), "secret-documents")
    clean = found.where(F.size("spans") == 0).select("doc.*")
    held = found.where(F.size("spans") > 0)
    values = held.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), "spans")
    live = materialise(ownership(values).where(_live(example_owners, example_repos)).select("value"), "live-secrets")
    judged = (held.select("row", F.explode("spans").alias("s")).select("row", "s.*").join(live, "value")
              .groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("hits")))
    new = (held.join(judged, "row", "left")
           .withColumn("text", F.when(F.col("hits").isNotNull(), _marked(F.col("doc.text"), F.col("hits"), mark))))
    cols = [F.coalesce("text", "doc.text").alias("text") if c == "text"
            else F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("doc.n_chars")).cast("long").alias(c) if c == "n_chars"
            else F.col(f"doc.`{c}`").alias(c) for c in names]
    return clean.withColumns({"n_chars": F.col("n_chars").cast("long")} if "n_chars" in names else {}).unionByName(new.select(*cols))


def _with_spans(whole: DataFrame, schema) -> DataFrame:
    """(doc, row, spans) of documents held as structs."""
    place = schema.names.index("text")
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column(0).field(place).cast(pa.string()).to_pylist()
            spans = [[{"start": s, "kind": k, "end": e, "value": hashlib.sha256(v.encode()).hexdigest()}
                      for s, k, e, v in find(t or "")] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(range(row, row + b.num_rows), pa.int64()), pa.array(spans, kinds)], ["doc", "row", "spans"])
            row += b.num_rows

    return whole.mapInArrow(run, T.StructType([T.StructField("doc", schema), T.StructField("row", T.LongType()),
                                               T.StructField("spans", T.ArrayType(T.StructType([
                                                   T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()),
                                                   T.StructField("end", T.LongType()), T.StructField("value", T.StringType())])))]))
