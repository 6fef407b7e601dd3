"""Document toxicity by multiple-instance learning.

A document is a bag of sentences; only the bag has a label.  Each sentence
gets p = sigmoid(b + w.x) from word and character-piece features, and the
document's score is the noisy-or over its sentences:
1 - (1 - leak) * prod(1 - p).  The weights are fitted through that product to
document labels alone, and the sentences with p >= 0.5 are the offending
ones.  A sentence without any feature cannot fire, so long clean texts do
not add up to a score.

The classifier is fitted on a bounded sample of the labelled rows
(``sample_docs``, chosen by a hash of the id); its vocabulary and weights
(``vocabulary`` features) are what is broadcast.  All documents are scored
over their whole texts beside the scan, without a shuffle.

Defined results: null and empty texts score the leak; repeated label rows
count once (toxic if any says so); repeated documents are scored row by row;
without usable labels the score is 0 everywhere; a null doc_id counts as
held out; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.staging import materialise

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
SPANS = "array<struct<start:long,end:long,p:double>>"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def grams(word: str) -> set[str]:
    """The word itself and its pieces of 3 to 6 characters, with its ends."""
    w = f"<{word}>"
    return {w} | {w[i:i + n] for n in (4, 5, 6) for i in range(len(w) - n + 1)}


def learners(docs: DataFrame, labels: DataFrame, sample_docs: int) -> DataFrame:
    """About ``sample_docs`` labelled documents (all, if there are fewer):
    toxic, text.  The chosen ids are what is broadcast, so the texts stay."""
    usable = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic")))
    n = usable.count()
    share = min(1.0, sample_docs / n) if n else 0.0
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = chosen.withColumnRenamed("doc_id", "_id")
    return (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
            .select(F.col("_toxic").alias("toxic"), "text"))


def vocabulary(sample: DataFrame, size: int, least_docs: int) -> dict[str, int]:
    """Features that toxic documents hold clearly more often, by z-score of
    their log odds.  Words are counted once per document; pieces add up the
    documents of their words."""
    def words(batches):
        for b in batches:
            tox, clean = {}, {}
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                into = tox if y else clean
                for w in set(WORD.findall((t or "").lower())):
                    into[w] = into.get(w, 0) + 1
            every = list(tox.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(every, pa.string()), pa.array([tox.get(w, 0) for w in every], pa.int64()),
                 pa.array([clean.get(w, 0) for w in every], pa.int64())], ["word", "a", "b"])

    def pieces(batches):
        for b in batches:
            sums: dict[str, list] = {}
            for w, x, y in zip(*[c.to_pylist() for c in b.columns]):
                for g in grams(w):
                    s = sums.setdefault(g, [0, 0])
                    s[0] += x
                    s[1] += y
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([s[0] for s in sums.values()], pa.int64()),
                 pa.array([s[1] for s in sums.values()], pa.int64())], ["gram", "a", "b"])

    total = sample.groupBy("toxic").count().collect()
    n = {bool(r["toxic"]): r["count"] for r in total}
    if not n.get(True) or not n.get(False):
        return {}
    counted = (sample.mapInArrow(words, "word string, a long, b long").groupBy("word")
               .agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    summed = (counted.mapInArrow(pieces, "gram string, a long, b long").groupBy("gram")
              .agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    # expected share of a gram's documents that are toxic if it says nothing
    rate = n[True] / (n[True] + n[False])
    seen = F.col("a") + F.col("b")
    z = (F.col("a") - seen * rate) / F.sqrt(seen * (rate * (1 - rate)))
    best = (summed.where(seen >= least_docs).where(z > 5)
            .orderBy(F.desc(z), "gram").limit(size).select("gram").collect())     # at most `size` rows
    return {r["gram"]: i for i, r in enumerate(best)}


class Words:
    """Word -> its vocabulary features, remembered per worker."""

    def __init__(self, vocab: dict[str, int], most: int = 500_000):
        self.vocab, self.most, self.known, self.tokens = vocab, most, {}, {}

    def __call__(self, word: str) -> tuple:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.most:
                self.known.clear()
            got = self.known[word] = tuple(sorted(self.vocab[g] for g in grams(word) if g in self.vocab))
        return got

    def token(self, token: str) -> bool:
        """Does a blank-separated token hold a word with features?"""
        got = self.tokens.get(token)
        if got is None:
            if len(self.tokens) >= self.most:
                self.tokens.clear()
            got = self.tokens[token] = any(map(self, WORD.findall(token)))
        return got

    def sentences(self, text: str):
        """(start, end, features) of the sentences that have any."""
        if not any(map(self.token, set(text.lower().split()))):
            return []
        out = []
        for m in SENTENCE.finditer(text):
            got = {f for w in WORD.findall(m[0].lower()) for f in self(w)}
            if got:
                out.append((m.start(), m.end(), sorted(got)))
        return out


def packed(bag: list) -> bytes:
    """A bag as compressed 32-bit numbers: each feature plus one, and a zero
    after each sentence."""
    return zlib.compress(np.array([x for s in bag for x in (*(f + 1 for f in s), 0)], "<u4").tobytes(), 1)


def sentences(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Document and kind of every sentence of packed bags, and the kinds:
    features of the distinct sentences."""
    known: dict[bytes, int] = {}
    docs, kinds = array("i"), array("i")
    for i, bag in enumerate(bags):
        raw, start = zlib.decompress(bag), 0
        for end in np.flatnonzero(np.frombuffer(raw, "<u4") == 0).tolist():
            docs.append(i)
            kinds.append(known.setdefault(raw[4 * start:4 * end], len(known)))
            start = end + 1
    return np.array(docs, np.intp), np.array(kinds, np.intp), [np.frombuffer(k, "<u4").astype(np.intp) - 1 for k in known]


def fit(bags: list[bytes], labels: np.ndarray, n_features: int, rounds: int = 300, l2: float = 2e-4, rate: float = 0.1):
    """Noisy-or likelihood over document labels, by Adam on all (packed)
    bags.  Equal sentences are worked out once, so what a round holds is a
    few numbers a sentence and the distinct sentences' features."""
    doc, kind, kinds = sentences(bags)
    quiet = np.bincount(doc, minlength=len(bags)) == 0
    leak = float((labels[quiet].sum() + 0.5) / (quiet.sum() + 100.0)) if len(bags) else 0.0
    leak = min(max(leak, 1e-4), 0.2)
    if not kinds:
        return np.zeros(n_features), 0.0, leak
    sent, feat = np.repeat(np.arange(len(kinds)), [len(k) for k in kinds]), np.concatenate(kinds)
    theta, m, v = np.zeros(n_features + 1), 0.0, 0.0
    theta[-1] = -1.0
    y = labels.astype(float)
    for step in range(1, rounds + 1):
        w, b = theta[:-1], theta[-1]
        a = np.clip(b + np.bincount(sent, w[feat], len(kinds)), -30, 30)
        p = 1 / (1 + np.exp(-a))
        none = np.log1p(-leak) + np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12))[kind], len(bags))
        fire = np.maximum(-np.expm1(none), 1e-9)
        # d loglik / d a_s = p * (y (1-P)/P - (1-y)), summed over equal sentences
        g_s = p * np.bincount(kind, (y * np.exp(none) / fire - (1 - y))[doc], len(kinds))
        grad = np.append(np.bincount(feat, g_s[sent], n_features), g_s.sum()) / len(bags) - l2 * np.append(w, 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta = theta + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-1], float(theta[-1]), leak


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 20_000, size: int = 2000, least_docs: int = 8) -> dict:
    sample = materialise(learners(docs, labels, sample_docs), "toxic-sample")
    vocab = vocabulary(sample, size, least_docs)
    if not vocab:
        return {"vocab": {}, "w": np.zeros(0), "b": 0.0, "leak": 0.0}

    def bags(batches):
        feats = Words(vocab)
        for b in batches:
            got = [packed([f for _, _, f in feats.sentences(t or "")]) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["toxic", "bag"])

    # at most about `sample_docs` rows of feature numbers, compressed
    rows = sorted((r["toxic"], bytes(r["bag"])) for r in sample.mapInArrow(bags, "toxic int, bag binary").collect())
    w, b, leak = fit([r[1] for r in rows], np.array([r[0] for r in rows]), len(vocab))
    return {"vocab": vocab, "w": w, "b": b, "leak": leak}


def score_text(text: str, feats: Words, model: dict) -> tuple[float, list]:
    stay, spans = math.log1p(-model["leak"]), []
    for a, e, f in feats.sentences(text):
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, model["b"] + float(model["w"][f].sum())))))
        stay += math.log1p(-min(p, 1 - 1e-12))
        if p >= 0.5:
            spans.append((a, e, p))
    return -math.expm1(stay), spans


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending sentences
    (code points, end exclusive, with their probability)."""
    model = train(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches):
        feats = Words(shared.value["vocab"])
        for b in batches:
            got = [score_text(t or "", feats, shared.value) for t in b.column(1).to_pylist()]
            spans = [[{"start": a, "end": e, "p": p} for a, e, p in s] for _, s in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array(spans, kinds)],
                ["doc_id", "score", "offending"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, f"doc_id long, score double, offending {SPANS}")
            .select("doc_id", held_out().alias("held_out"), "score",
                    F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "offending"))
