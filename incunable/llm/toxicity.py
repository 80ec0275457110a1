"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the set of its words, word pairs and pairs with one or two words between, each hashed to 32 bits.
FTRL-proximal keeps a learning rate for each coordinate and its L1 term leaves most weights at exactly zero, so what is
broadcast to score the corpus is a short sorted list of hashes and weights.

Fitting reads a bounded sample of labelled rows (`per_class` of each class and `sample_mb` together, see labelled_sample).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WORDS, buffers, documents, id_text, materialize, mix, spans, word_hashes

ALPHA, BETA, L1, L2, EPOCHS, PER_CLASS, MIN_DOCS = 0.3, 1.0, 4.0, 1.0, 4, 4000, 3
SKIPS, SAMPLE_MB = (1, 2, 3), 40.0


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every n-gram and skip-gram of a buffer of texts, repeats included."""
    raw = LOWER[raw]
    starts, ends, first = spans(raw, offsets, WORDS)
    words = word_hashes(raw, starts, ends)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
    docs, keys = [owner], [(words >> np.uint64(32)).astype(np.uint32)]
    for skip in SKIPS:
        if len(words) > skip:
            same = owner[:-skip] == owner[skip:]
            pair = mix(words[:-skip] * np.uint64(2 * skip + 1) + (words[skip:] ^ np.uint64(skip)) * np.uint64(0x9E3779B97F4A7C15))
            docs.append(owner[:-skip][same])
            keys.append((pair[same] >> np.uint64(32)).astype(np.uint32))
    return np.concatenate(docs), np.concatenate(keys)


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, min_docs: int = MIN_DOCS) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted hashes, their weights, and the bias. No texts: no weights and a bias of 0."""
    sets = []
    for text in texts:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        sets.append(np.unique(features(raw, np.array([0, len(raw)], np.int64))[1]))
    every = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint32)
    edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, int)
    keys = every[edge][np.diff(np.append(edge, len(every))) >= min_docs]
    del every
    ids = []
    for s in sets:
        at = np.searchsorted(keys, s)
        at[at == len(keys)] = 0
        ids.append(np.append(at[keys[at] == s] + 1 if len(keys) else at[:0], 0).astype(np.int32))
    z, n = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)

    def weights(zi: np.ndarray, ni: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where((np.abs(zi) <= l1) & (at > 0), 0.0, -(zi - np.sign(zi) * l1 * (at > 0)) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.Generator(np.random.PCG64(7)).permutation
    for _ in range(epochs):
        for i in order(len(ids)):
            at = ids[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni, at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[at] = more
    every_at = np.arange(len(z))
    w = weights(z, n, every_at)
    kept = np.flatnonzero(w[1:])
    return keys[kept], w[1:][kept], float(w[0])


def score_texts(raw: np.ndarray, offsets: np.ndarray, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    keys, weights, bias = model
    total = np.full(len(offsets) - 1, bias)
    if len(keys) and len(total):
        docs, grams = features(raw, offsets)
        at = np.searchsorted(keys, grams)
        at[at == len(keys)] = 0
        met = keys[at] == grams
        pairs = np.unique(docs[met].astype(np.int64) * len(keys) + at[met])
        np.add.at(total, pairs // len(keys), weights[pairs % len(keys)])
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", sample_mb: float = SAMPLE_MB) -> list:
    """(doc_id, text, label) of a sample: the first `per_class` labelled ids of each class by a hash of the id, and of their rows, in that order, those that `sample_mb` has room for.

    At most 2 * per_class rows and sample_mb MB of text reach the driver, whatever the tables hold; a text that is too
    long for the room that is left is passed over, those behind it are not. An id that is labelled both ways is in both.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").distinct()
    picked = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    met = id_text(docs, id_col, text_col).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    met = materialize(met.withColumn("row", F.monotonically_increasing_id()).withColumn("bytes", F.octet_length("text")))
    room, rows_of = sample_mb * 1e6, []
    for r in met.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "text").select("row", "bytes").limit(2 * per_class).collect():
        if r["bytes"] <= room:
            room -= r["bytes"]
            rows_of.append((r["row"],))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(rows_of, "row long"))
    texts = met.join(chosen, "row", "left_semi").select("doc_id", "text", "y").collect()
    return sorted(((r["doc_id"], r["text"], r["y"]) for r in texts), key=lambda r: (hashlib.md5(str(r[0]).encode()).digest(), r[1], r[2]))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample_mb: float = SAMPLE_MB) -> DataFrame:
    """(doc_id, score): how likely each whole text is toxic, by a model fitted to `labels` (rows with a null label or id are not used).

    Null and empty texts get the bias's probability; without labels every score is 0.5. Repeated rows come back
    repeated. Only the named columns are read, and of the labels only to fit.
    """
    sample = labelled_sample(docs, labels, label, per_class, id_col, text_col, sample_mb)
    model = docs.sparkSession.sparkContext.broadcast(fit([r[1] for r in sample], [r[2] for r in sample]))

    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(raw, offsets, model.value))], names=["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def held_out(column: str, mod: int, rest: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod == rest


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 5, 0))
    out = toxicity(documents(spark, sf_dir), labels)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
