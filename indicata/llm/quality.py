"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (unigrams and bigrams of tokens, in
``2 ** BITS`` buckets) are counted: one of target text, the documents labelled good,
and one of raw text, all documents. A document's score is the log of the ratio of
the two models per n-gram; its importance weight is that ratio for ``SPAN`` n-grams.
Documents are then drawn without replacement by the Gumbel top-k trick: the k largest
values of log weight plus Gumbel noise, which comes from a hash of the id, so that a
rerun draws the same. Tokens are runs of letters and digits or of other marks, with
their case, since junk shows in both.

Scale: both counts are made in one pass over all documents, with one array per task
and an aggregate of at most ``2 ** BITS`` rows per task; the target ids are a bounded
sample of labelled rows (``max_fit``, smallest hashes first). The second pass scores.
The k-th largest key is found by histograms of ever narrower ranges, so no sort of all
rows and no large group is needed.

Edge cases: null and empty texts have score 0 and no tokens. Labels that are null
are left out; without good labels all scores are 0 and the draw is uniform. Ids that
repeat get equal noise; ties of the key are broken by id, then all rows of that id go
together, so a repeated row can make the draw a little larger than k. A null id has a
key like any other.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, pieces, settle, slices, texts_of

BITS = 16
MAX_FIT = 20_000
SPAN = 40
SEED = 17
#: Buckets of a histogram of keys, and rows that are few enough to sort on the driver.
BINS, FEW = 2048, 5_000


class Tokens(Words):
    """Runs of word bytes, and runs of other marks, as they are written."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + bytes(16), np.uint8)
        kind = _KIND[raw]
        cut = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
        ends = np.append(cut[1:], len(raw))
        live = kind[cut] > 0
        self.low, self.starts, self.ends = raw, cut[live], ends[live]
        self.first = np.searchsorted(self.starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
        self.data = raw.tobytes()


_KIND = np.full(256, 2, np.uint8)
_KIND[:0x21] = 0
_KIND[0x7F] = 0
_KIND[0x30:0x3A] = _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1


def ngrams(texts: list[bytes]):
    """Per slice of texts: its range, the buckets of all n-grams, and the text of each."""
    for a, b in slices([len(t) for t in texts]):
        tokens = Tokens(texts[a:b])
        h = tokens.hashes()
        doc = np.repeat(np.arange(a, b), np.diff(tokens.first))
        pair = mix(h[:-1], h[1:])
        inside = doc[:-1] == doc[1:]
        yield np.concatenate([h, pair[inside]]) >> np.uint64(64 - BITS), np.concatenate([doc, doc[:-1][inside]])


def _good_ids(labels: DataFrame, max_fit: int) -> list[int]:
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return [r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit).collect()]


def log_ratios(docs: DataFrame, labels: DataFrame, *, max_fit: int = MAX_FIT) -> np.ndarray:
    """log(target / raw) of each bucket, add-one smoothed."""
    good = docs.sparkSession.sparkContext.broadcast(frozenset(_good_ids(labels, max_fit)))

    def run(batches):
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in pieces(batches, 1):
            chosen = np.array([i in good.value for i in batch.column(0).to_pylist()], bool)
            for bucket, doc in ngrams(texts_of(batch.column(1))):
                bucket = bucket.astype(np.int64)
                raw += np.bincount(bucket, minlength=1 << BITS)
                target += np.bincount(bucket[chosen[doc]], minlength=1 << BITS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    counts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "bucket long, raw long, target long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # 2 ** BITS at most
    raw, target = np.ones(1 << BITS), np.ones(1 << BITS)
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if target.sum() == len(target):
        return np.zeros(1 << BITS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def gumbel(ids: list, seed: int = SEED) -> np.ndarray:
    """Noise by id: -log(-log(u)) of a hash in (0, 1)."""
    import xxhash

    u = np.array([xxhash.xxh64_intdigest(str(i), seed) for i in ids], np.uint64)
    return -np.log(-np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)))


def score(docs: DataFrame, ratios: np.ndarray, *, seed: int = SEED, span: float = SPAN) -> DataFrame:
    """One row per document: doc_id, n_ngrams, score, log_weight, key."""
    table = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        for batch in pieces(batches, 1):
            n, total = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for bucket, doc in ngrams(texts_of(batch.column(1))):
                n += np.bincount(doc, minlength=len(n))
                total += np.bincount(doc, table.value[bucket.astype(np.int64)], minlength=len(n))
            mean = total / np.maximum(n, 1)
            weight = span * mean
            key = weight + gumbel(batch.column(0).to_pylist(), seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(mean), pa.array(weight), pa.array(key)], names=["doc_id", "n_ngrams", "score", "log_weight", "key"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_ngrams long, score double, log_weight double, key double")


def kth_largest(keys: DataFrame, k: int) -> tuple[float, int | None] | None:
    """(key, doc_id) of the k-th largest key; ids break ties, the smaller first. None if k is 0."""
    if k <= 0:
        return None
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            rows = None
        else:
            bin_ = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)).cast("int")
            rows = sorted(inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect(), key=lambda r: -r["bin"])
        if rows is None:
            last = inside.orderBy(F.desc("key"), F.asc("doc_id")).select("key", "doc_id").limit(k).agg(F.min(F.struct(F.col("key"), -F.col("doc_id")))).first()[0]
            return last[0], None if last[1] is None else -last[1]
        for r in rows:
            if k <= r["n"]:
                low, high, n = r["lo"], r["hi"], r["n"]
                break
            k -= r["n"]
        if n <= FEW:
            few = keys.where((F.col("key") >= low) & (F.col("key") <= high)).select("key", "doc_id").collect()
            few.sort(key=lambda r: (-r["key"], r["doc_id"] is not None, r["doc_id"] or 0))
            return few[k - 1]["key"], few[k - 1]["doc_id"]


def resample(docs: DataFrame, labels: DataFrame, *, share: float | None = None, max_fit: int = MAX_FIT, seed: int = SEED, span: float = SPAN) -> DataFrame:
    """One row per document: doc_id, n_ngrams, score, log_weight, key, kept.

    ``share`` of the documents are drawn; by default, the share of good ones among
    all labelled documents. A part of a document counts as one, in exact numbers.
    """
    if share is None:
        good, known = labels.where("quality is not null").agg(F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0)), F.count("*")).first()
        part = Fraction(good, max(known, 1))
    else:
        part = Fraction(repr(share))
    scored = settle(score(docs, log_ratios(docs, labels, max_fit=max_fit), seed=seed, span=span))
    last = kth_largest(scored.select("key", "doc_id"), math.ceil(part * scored.count()))
    if last is None:
        return scored.withColumn("kept", F.lit(False))
    key, doc_id = last
    tie = (F.col("key") == key) & (F.col("doc_id").isNull() if doc_id is None else F.col("doc_id").isNull() | (F.col("doc_id") <= doc_id))
    return scored.withColumn("kept", (F.col("key") > key) | tie)
