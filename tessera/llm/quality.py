"""Quality by importance resampling.

Two generative models over hashed n-grams, one of target texts (labelled good)
and one of raw texts (the whole corpus), give each document two likelihoods.
N-grams are byte trigrams and repeats of a word within its last three, each
hashed to one of ``BUCKETS``.  A document's log importance weight is the log
ratio of its likelihoods, summed over all its n-grams, and nothing else.
Gumbel top-k draws the resample: the ``k`` documents of largest log weight plus
Gumbel noise, seeded by id, without replacement.

Labels choose the target texts and the size of the sample.  ``k`` is the
expected number of good documents: the sum over all documents of the chance
that a logistic curve over the weight alone (its inverse hyperbolic sine) gives.
Target model and curve are fitted on at most ``SAMPLE`` labelled rows, those of
smallest id hash: the curve on those with ``crc32(doc_id) mod 4 = 3``, the
target model on the others.  The raw model, the weights, ``k`` and the threshold cover every document
whole.  The k-th key is found by counting keys in bands; only one band is
ever ordered.

A null or empty text has weight zero.  Equal keys are taken together, so
repeated rows stay or go together and the sample may exceed ``k`` by such
ties.  Without labels of both kinds all documents are kept.  An empty table
gives an empty sample.  Further columns pass through ``keep_good`` and are
ignored by the query.  Filtering weighs each text a second time where it lies,
which is cheaper than moving it to its weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bucket_of, discard, fresh, in_arrow, materialize, table
from tessera.llm.regression import fit_logistic

SAMPLE = 20_000
BITS = 15
GRAMS, REPEATS = 1 << BITS, 8
BUCKETS = GRAMS + REPEATS
#: Pseudo-counts on both sides of a ratio.
PRIOR = 5.0
SEED = 29
_MIX = np.random.default_rng(7).integers(1, 1 << 62, 256, np.uint64) | np.uint64(1)
_PIECE = 1 << 22


def grams(text: str | None) -> np.ndarray:
    """The bucket of every n-gram of a whole text."""
    data = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass") + b" ", np.uint8)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    wide = data.astype(np.uint32)
    codes = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA6B) + wide[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
    gap = (data <= 32) & ((data == 32) | (data >= 9) & (data <= 13))
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    if not len(starts):
        return codes.astype(np.int64)
    place = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    weight = np.where(gap, 0, _MIX[data] * (2 * place + 1).astype(np.uint64))
    h = np.add.reduceat(weight, starts)
    lag = np.zeros(len(h), np.int64)
    for k in (3, 2, 1):
        lag[k:][h[k:] == h[:-k]] = k
    return np.r_[codes.astype(np.int64), GRAMS + lag]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of a task's texts, by the label beside each text."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = sums.setdefault(label, np.zeros(BUCKETS, np.int64))
            own += np.bincount(grams(text), minlength=BUCKETS)
    for label, own in sums.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label), pa.int32()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["label", "bucket", "n"])


def counts(texts: DataFrame) -> dict[int, np.ndarray]:
    """Counts of every bucket by label, of ``texts(label, text)``; at most ``BUCKETS`` rows a label reach the driver."""
    out: dict[int, np.ndarray] = {}
    for r in in_arrow(texts, _count, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r.label, np.zeros(BUCKETS))[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The log ratio of each bucket; where neither side expects a gram, its absence says nothing."""
    scaled = raw * (target.sum() / max(1.0, raw.sum()))
    return np.log((target + PRIOR) / (scaled + PRIOR))


def log_weight(text: str | None, ratio: np.ndarray) -> float:
    """log p_target - log p_raw of a whole text."""
    return float(ratio[grams(text)].sum())


@dataclass(frozen=True)
class Model:
    """The log ratio of each bucket, and the curve from a weight to the chance that a document is good."""

    ratio: np.ndarray
    curve: np.ndarray

    def chance(self, weight: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.asinh(weight) * float(self.curve[0]) + float(self.curve[1]))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE, where: Column | None = None) -> DataFrame:
    """``(doc_id, label, text)`` of at most ``most`` labelled rows, those of smallest id hash; their ids are a bounded broadcast.

    Of documents that repeat an id the smallest text is taken, so rows stay within the bound.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        rows = rows.where(where)
    ids = rows.select("doc_id", F.col(label).cast("int").alias("label")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The models, or None without labels of both kinds."""
    chosen = materialize(labelled_sample(docs, labels, "quality", sample))
    curved = bucket_of(F.col("doc_id"), 4) == 3
    kinds = {r.label for r in chosen.select("label").distinct().collect()}
    target = counts(chosen.where(~curved & (F.col("label") == 1)).select("label", "text")).get(1)
    if not kinds >= {0, 1} or target is None:
        return None
    raw = counts(docs.select(F.lit(0).alias("label"), "text")).get(0, np.zeros(BUCKETS))
    ratio = log_ratio(target, raw)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([log_weight(t, ratio) for t in batch.column(1).to_pylist()], pa.float64())], names=["label", "w"])

    seen = in_arrow(chosen.where(curved).select("label", "text"), measure, "label int, w double").toPandas().sort_values(["w", "label"])
    discard(chosen)
    return Model(ratio, fit_logistic(np.arcsinh(seen[["w"]].to_numpy()), seen["label"].to_numpy(float)))


def gumbel(doc_id: Column) -> Column:
    """Standard Gumbel noise from a seeded hash of the id."""
    u = (F.pmod(F.xxhash64(F.lit(SEED), doc_id), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, key: str, k: int, bands: int = 64, most: int = 10_000) -> float | None:
    """The ``k``-th largest of a column, or the smallest if there are fewer.

    Bands between approximate quantiles are counted, then the band that holds
    it is divided again, until at most ``most`` rows are left to be ordered.
    """
    left, inside, n = k, rows, rows.count()
    if k <= 0 or n == 0:
        return None
    left = min(k, n)
    while n > most:
        edges = sorted(set(inside.agg(F.percentile_approx(key, [i / bands for i in range(1, bands)], 100 * bands)).first()[0]))
        band = F.array_size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(key)))
        sizes = {r.band: r["count"] for r in inside.groupBy(band.alias("band")).count().collect()}
        if len(sizes) == 1:  # all bounds are the smallest value: it goes, and what is above it is divided
            inside = inside.where(F.col(key) > edges[0])
            n = inside.count()
            if left > n:
                return edges[0]
            continue
        for b in sorted(sizes, reverse=True):
            if sizes[b] >= left:
                break
            left -= sizes[b]
        inside, n = _between(inside, key, edges[b - 1] if b else None, edges[b] if b < len(edges) else None), sizes[b]
    grouped = inside.groupBy(key).count()
    run = grouped.select(key, F.sum("count").over(W.orderBy(F.desc(key))).alias("upto"))
    return run.where(F.col("upto") >= left).agg(F.max(key)).first()[0]


def _between(rows: DataFrame, key: str, low: float | None, high: float | None) -> DataFrame:
    if low is not None:
        rows = rows.where(F.col(key) >= low)
    return rows if high is None else rows.where(F.col(key) < high)


def weighed(docs: DataFrame, model: Model, into: str) -> DataFrame:
    """``docs`` with the log weight of each row in front, in one pass that moves no row."""
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = pa.array([log_weight(t, model.ratio) for t in batch.column(place).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([w, *batch.columns], names=[into, *names])

    return in_arrow(docs, run, T.StructType([T.StructField(into, T.DoubleType()), *docs.schema.fields]))


def draw(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, DataFrame, float | None]:
    """The model, ``(doc_id, log_weight, gumbel_key)`` of every document, and the least key drawn."""
    model = fit(docs, labels)
    if model is None:
        light = docs.select("doc_id", F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("gumbel_key"))
        return None, light, 0.0
    scored = weighed(docs.select("doc_id", "text"), model, "log_weight").drop("text")
    light = materialize(scored.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"))), docs.count(), dealt=True)
    k = round(light.agg(F.coalesce(F.sum(model.chance(F.col("log_weight"))), F.lit(0.0))).first()[0])
    return model, light, kth_largest(light, "gumbel_key", k)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the resample leaves out; each text is weighed again where it is, so none is shuffled."""
    model, _, least = draw(docs, labels)
    if model is None:
        return docs
    into = fresh(docs, "__log_weight")
    key = F.col(into) + gumbel(F.col("doc_id"))
    return weighed(docs, model, into).where(key >= least if least is not None else F.lit(False)).select(*docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the resample keeps, with their weights and keys."""
    _, light, least = draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return light.where(F.col("gumbel_key") >= least if least is not None else F.lit(False))
