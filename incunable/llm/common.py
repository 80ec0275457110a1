"""Shared pieces: session settings, tables cut from their lineage, byte kernels, word hashes.

Texts come to Python workers as Arrow string arrays and are worked on as one byte buffer with document offsets, so
that no Python object is made for each word.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_FROZEN: list[bool] = []


def tuned(spark: SparkSession) -> SparkSession:
    """Arrow batches small in rows and in bytes, as a document may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a session whose executors are threads of the driver gets a temporary folder; any other is refused,
    as its executors would each write to their own machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write the rows once into the shared folder and read them again: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/incunable-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean() -> None:
    """Give memory that this worker has freed back to the machine: workers are used again, and each would keep its peak."""
    gc.collect()
    if not _FROZEN:  # modules and what else is there the first time are not looked through again: that costs 10 ms a call
        gc.freeze()
        _FROZEN.append(True)
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """The two columns an operator works on, and the struct `carry` of those to hand through: no other can clash."""
    tuned(docs.sparkSession)
    more = [F.struct(*carry).alias("carry")] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def carried(docs: DataFrame, schema: str, carry: tuple) -> str:
    """An operator's output schema, with `carry` at its end if any columns are handed through."""
    return f"{schema}, carry {docs.select(F.struct(*carry)).schema[0].dataType.simpleString()}" if carry else schema


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return raw[first:last], (offsets - first if len(offsets) else np.zeros(1, np.int64))


_RNG = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: An odd multiplier for polynomial sums modulo 2^64, and odd ones to chain hashes with.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHAIN = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
#: The bytes of a lane that a word of so many bytes fills.
_FILLED = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG_WORD = 1024


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 23:
            _POWERS[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
WORDS = np.zeros(256, bool)
WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that `inside` allows) and each document's first word."""
    is_in = np.take(inside, raw)
    turns = np.flatnonzero(is_in[1:] != is_in[:-1]) + 1
    if len(raw) and is_in[0]:
        turns = np.concatenate([[0], turns])
    if len(turns) % 2:
        turns = np.append(turns, len(raw))
    starts, ends = turns[::2], turns[1::2]
    # a word that would go on into the next document ends at the border
    border = np.unique(offsets[(offsets > 0) & (offsets < len(raw))])
    border = border[is_in[border - 1] & is_in[border]]
    if len(border):
        starts, ends = (np.insert(x, np.searchsorted(x, border), border) for x in (starts, ends))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, at_once: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word, independent for each of two values of `which`; about `at_once` bytes are worked on at a time.

    Lanes of eight bytes are mixed in one after another, each by a bijection that is not linear; what is left of a word
    of over LONG_WORD bytes is hashed by XXH3 instead.
    """
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + at_once, "right")))
        part = np.concatenate([raw[base : ends[j - 1]], np.zeros(8, np.uint8)])
        out[i:j] = _lanes(part, starts[i:j] - base, ends[i:j] - starts[i:j], which)
        i = j
    return out


def _lanes(part: np.ndarray, at: np.ndarray, size: np.ndarray, which: int) -> np.ndarray:
    lane = np.ndarray(len(part) - 7, np.uint64, part.data, strides=(1,))
    h = mix((lane[at] & _FILLED[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _CHAIN[which] + _BASE))
    long, done = np.flatnonzero(size > 8), 8
    while len(long) and done < LONG_WORD:
        here = lane[at[long] + done] & _FILLED[np.minimum(size[long] - done, 8)]
        h[long] = mix((h[long] * _CHAIN[which]) ^ here)
        done += 8
        long = long[size[long] > done]
    for w in long.tolist():
        h[w] ^= np.uint64(xxhash.xxh3_64_intdigest(part[at[w] + done : at[w] + size[w]].tobytes(), which + 1))
    return h


def gram_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each k consecutive words, len(words) - k + 1 of them (document borders are the caller's).

    Hashes of 1, 2, 4, ... words are chained to k words, each step a mixing that is not linear.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    by, run, size, out, done = _CHAIN[which], words, 1, None, 0
    while True:
        if k & size:
            out = mix(run[:n] + by) if out is None else mix((out * by) ^ run[done : done + n])
            done += size
            if done == k:
                return out
        run = mix((run[:-size] * by) ^ run[size:])
        size *= 2


def within(offsets: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n starts have their k words in one document; offsets: each document's first word and the end."""
    ok = np.zeros(n, bool)
    if n:
        room = np.diff(offsets) - k + 1
        step = np.zeros(n + 1, np.int32)
        has = room > 0
        np.add.at(step, offsets[:-1][has], 1)
        np.add.at(step, offsets[:-1][has] + room[has], -1)
        ok = np.cumsum(step[:n]) > 0
    return ok


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places some interval [start, start + length) covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:n]) > 0


def member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array known."""
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x
