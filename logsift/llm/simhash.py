"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64 bits, by majority over the XXH64 of all word shingles.
Two link at ``radius`` or fewer differing bits.  Each bit position i gets a
non-zero vector m(i) of radius + 1 bits; table v (every non-zero vector)
keeps the bits with <m(i), v> odd.  Any set of at most ``radius`` positions
spans less than the whole space, so some v is orthogonal to all of them: a
pair within the radius agrees on all kept bits of at least one of the
2^(radius+1) - 1 tables.  Nothing is missed, and every table keeps about
half the bits.

Only distinct fingerprints are linked.  Within a bucket all members first
try the bucket's least and greatest member (linear, and enough to join a
dense group of near copies); pairs are then compared only across members
that are still in different components.

Defined results: null, empty and blank texts have fingerprint zero and link
like any other; equal doc_ids give one row per input row; a null doc_id gets
the component of its fingerprint (null when no row of it has an id); an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.components import components
from logsift.llm.staging import materialise, shuffle_width

WORDS, RADIUS = 4, 4


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority SimHash of one UTF-8 text (unsigned 64 bits)."""
    import xxhash
    w = text.lower().split()          # bytes: A-Z only, and exactly the six ASCII blanks
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(w))
    h64 = xxhash.xxh64_intdigest
    n = len(w) - k + 1
    h = np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1:].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(h[i:i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long); ``keep`` names
    long columns to carry along."""
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t or b"", words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *keep])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *keep)
            .mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *keep))))


def masks(radius: int = RADIUS) -> list[int]:
    """Covering masks as signed longs, one per non-zero vector."""
    dim = radius + 1
    vectors = [1 + i % ((1 << dim) - 1) for i in range(64)]
    out = []
    for v in range(1, 1 << dim):
        kept = sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2)
        out.append(kept - (1 << 64) if kept >> 63 else kept)
    return out


def _near(a, b, radius):
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Component (its least member) of every fingerprint that links to
    another: columns fp, root."""
    spark = fps.sparkSession
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(masks(radius))])
    entries = (fps.select("fp", F.explode(tables).alias("x"))
               .select(F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp")
               .repartition(shuffle_width(spark), "t", "key"))
    ends = entries.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi")
    shared = materialise(entries.join(ends, ["t", "key"]), "simhash-buckets")
    stars = shared.select("fp", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("to")).where(
        (F.col("fp") != F.col("to")) & _near(F.col("fp"), F.col("to"), radius))
    first = materialise(components(stars.select("fp", "to")), "simhash-first")

    # second pass: buckets whose members are not yet one component
    named = (shared.select("t", "key", "fp")
             .join(first.withColumnsRenamed({"node": "fp", "component": "root"}), "fp", "left")
             .withColumn("root", F.coalesce("root", "fp")))
    named = materialise(named, "simhash-named")
    open_ = named.groupBy("t", "key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("t", "key")
    left = named.join(open_, ["t", "key"])
    right = left.select("t", "key", F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    across = (left.join(right, ["t", "key"])
              .where((F.col("root") < F.col("root2")) & _near(F.col("fp"), F.col("fp2"), radius))
              .select("root", "root2").distinct())
    second = materialise(components(across), "simhash-second")
    return (first.withColumnsRenamed({"node": "fp", "component": "root"})
            .join(second.withColumnsRenamed({"node": "root", "component": "root2"}), "root", "left")
            .select("fp", F.coalesce("root2", "root").alias("root"))
            .unionAll(second.join(first, "node", "left_anti")
                      .select(F.col("node").alias("fp"), F.col("component").alias("root"))))


def rooted(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of a table of distinct fingerprints with their component."""
    return (distinct.join(links(distinct.select("fp"), radius), "fp", "left")
            .withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the least doc_id that can be
    reached over links of ``radius`` or fewer differing bits."""
    prints = materialise(fingerprints(docs, words), "simhash-prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    linked = rooted(distinct, radius)
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = linked.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each group: the one with the least doc_id, a row
    without an id only when its group has none; among rows of that id the one
    with the least text key (any one of rows that repeat both).  Rows are
    known by doc_id and two hashes of the text, so equal or missing ids of
    unlike texts stay apart."""
    # the documents travel as one struct, so no column of theirs can clash
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    keyed = whole.select("doc", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"),
                         F.xxhash64("doc.text").alias("h1"), F.xxhash64(F.lit(1), "doc.text").alias("h2"))
    prints = materialise(fingerprints(keyed, words, ("h1", "h2")), "simhash-prints")
    counted = prints.groupBy("doc_id", "fp", "h1", "h2").agg(F.count("*").alias("n"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                   F.col("h1").alias("k1"), F.col("h2").alias("k2"), "n")
    distinct = materialise(counted.groupBy("fp").agg(F.min(row).alias("row")), "simhash-distinct")
    kept = materialise(rooted(distinct, radius).groupBy("root").agg(F.min("row").alias("row")).select("row.*"),
                       "simhash-kept")
    out = keyed.drop("text").join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h1") == F.col("k1"))
                                  & (F.col("h2") == F.col("k2")))
    if not kept.where("n > 1").limit(1).count():
        return out.select("doc.*")
    return out.where("n = 1").select("doc.*").unionAll(
        out.where("n > 1").dropDuplicates(["id", "k1", "k2"]).select("doc.*"))
