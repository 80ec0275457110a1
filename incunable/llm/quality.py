"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

Each block of BLOCK bytes of a text is compressed with the dictionary trained on good texts and with the one trained on
bad texts. The difference of the sizes, normalised by their sum, says which kind of text it resembles: that of all blocks
together, and those of the blocks that are most like bad and most like good text, so that a bad passage in a long text
still shows. Nothing else enters the score: a logistic regression fitted to the labelled sample turns these differences
into a probability.

Fitting reads a bounded sample of labelled rows (`per_class` of each class and `sample_mb` together, see labelled_sample).
The dictionaries are trained on every block of the sample; the calibration is fitted to differences from dictionaries
that were trained without the text in question (`FOLDS` folds).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, carried, documents, id_text
from .toxicity import SAMPLE_MB, held_out, labelled_sample

PER_CLASS, DICT_BYTES, LEVEL, BLOCK, FOLDS, THRESHOLD = 3000, 1 << 15, 3, 256, 3, 0.7


def _dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary, entropy tables included, trained on all blocks of the texts; the texts themselves where they are too few."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK) if len(t) - i >= 8]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, blocks)) // 8)), blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:size]


def _compressors(good: bytes, bad: bytes) -> list:
    out = []
    for data in (good, bad):
        d = zstandard.ZstdCompressionDict(data) if data else None
        if d:
            d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def differences(raw: np.ndarray, offsets: np.ndarray, compressors: list) -> np.ndarray:
    """For each text the normalised size difference of all its blocks, the least and the greatest of any; 0 for empty texts."""
    sizes = np.diff(offsets)
    n = -(-sizes // BLOCK)
    text = np.repeat(np.arange(len(n)), n)
    at = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * BLOCK
    size = np.minimum(BLOCK, offsets[1:][text] - at)
    out = np.zeros((len(n), 3))
    if not len(text):
        return out
    blocks = zstandard.BufferWithSegments(raw.tobytes(), np.stack([at, size], axis=1).astype(np.uint64).tobytes())
    good, bad = (np.fromiter(map(len, c.multi_compress_to_buffer(blocks, threads=1)), float, len(text)) for c in compressors)
    whole = np.bincount(text, good, len(n)), np.bincount(text, bad, len(n))
    has = n > 0
    out[has, 0] = ((whole[1] - whole[0]) / (whole[0] + whole[1] + 1e-9))[has]
    each = (bad - good) / (bad + good)
    heavy = size >= np.minimum(BLOCK, sizes)[text] * 0.5
    out[has, 1:] = 9, -9
    np.minimum.at(out[:, 1], text[heavy], each[heavy])
    np.maximum.at(out[:, 2], text[heavy], each[heavy])
    return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each halved until the loss falls."""

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + ridge / 2 * (w @ w)

    w, now = np.zeros(x.shape[1]), loss(np.zeros(x.shape[1]))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        while (after := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if now - after < 1e-9 * max(1.0, now):
            break
        w, now = w - step, after
    return w


def _expand(f: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((f - mean) / scale, -4, 4)
    return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)


def fit(rows: list[tuple[str, int]]) -> dict:
    """Dictionaries, calibration and scale, from (text, label) rows; a class with fewer than two rows leaves a constant score."""
    base = float(np.mean([y for _, y in rows])) if rows else 0.5
    of = {y: [t.encode() for t, c in rows if c == y] for y in (0, 1)}
    folds = min(FOLDS, len(of[0]), len(of[1]))
    if folds < 2:
        return {"constant": base}
    f, y = [], []
    for k in range(folds):
        compressors = _compressors(*(_dictionary([t for i, t in enumerate(of[c]) if i % folds != k]) for c in (1, 0)))
        for c in (1, 0):
            own = of[c][k::folds]
            f.append(differences(*_joined(own), compressors))
            y += [float(c)] * len(own)
    f, y = np.concatenate(f), np.array(y)
    mean, scale = f.mean(axis=0), f.std(axis=0) + 1e-9
    return {"good": _dictionary(of[1]), "bad": _dictionary(of[0]), "mean": mean, "scale": scale, "w": _logistic(_expand(f, mean, scale), y)}


def score(raw: np.ndarray, offsets: np.ndarray, model: dict, compressors: list | None) -> np.ndarray:
    if "constant" in model or len(offsets) < 2:
        return np.full(len(offsets) - 1, model.get("constant", 0.5))
    f = differences(raw, offsets, compressors)
    return 1 / (1 + np.exp(-np.clip(_expand(f, model["mean"], model["scale"]) @ model["w"], -35, 35)))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", carry: tuple = (), sample_mb: float = SAMPLE_MB) -> DataFrame:
    """(doc_id, score, and carry): how likely each whole text is good, by a model fitted to `labels` (rows with a null label or id are not used).

    Null texts count as empty and get the score of an empty text. Without two labels of each class every score is the
    share of good labels (0.5 without any). Repeated rows come back repeated. Only the named columns
    are read; those named in `carry` are handed through as a struct.
    """
    sample = labelled_sample(docs, labels, label, per_class, id_col, text_col, sample_mb)
    model = docs.sparkSession.sparkContext.broadcast(fit([(r[1], r[2]) for r in sample]))

    def run(batches):
        m = model.value
        compressors = None if "constant" in m else _compressors(m["good"], m["bad"])
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(raw, offsets, m, compressors)), *batch.columns[2:]], names=["doc_id", "score", *batch.schema.names[2:]])

    return id_text(docs, id_col, text_col, carry).mapInArrow(run, carried(docs, "doc_id long, score double", carry))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 4, 2))
    out = quality(documents(spark, sf_dir), labels)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
