"""Benchmark decontamination by winnowing.

Each text keeps the least hash of every `window` consecutive `k`-word grams. A span of `window + k - 1` words that a
document shares with a benchmark item lies over `window` equal grams, so both keep the same least gram: no span of that
length or longer can be missed. Kept fingerprints of documents are joined with those of the items, and each hit is
extended to the full windows around it, which must then be equal word for word.

The benchmark's index goes to every task while it is small (its bytes are counted first); beyond `broadcast_mb`, the same
fingerprints are joined by shuffles instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WORDS, buffers, carried, documents, gram_hashes, id_text, materialize, member, spans, within, word_hashes

SPAN, GRAM, BROADCAST_MB = 10, 5, 16


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = buffers(column)
    raw = LOWER[raw]
    starts, ends, first = spans(raw, offsets, WORDS)
    return raw, starts, ends, first, word_hashes(raw, starts, ends)


def winnow(hashes: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept grams of all texts: places (rising) and hashes. hashes: of words; first: each text's first word."""
    grams = gram_hashes(hashes, k)
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = within(first, k + window - 1, n)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, window):  # the leftmost of equal ones
        less = grams[j : j + n] < best
        best[less] = grams[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    places = np.unique(at[whole])
    return places, grams[places]


def _index(items: pa.Table, span: int, gram: int) -> dict:
    """Fingerprints, windows and short items of the benchmark, as sorted arrays."""
    texts = items.column("text").combine_chunks() if items.num_rows else pa.array([], pa.string())
    ids = items.column("item_id").to_pylist()
    raw, starts, ends, first, hashes = _words(texts)
    _, kept = winnow(hashes, first, gram, span - gram + 1)
    out = {"kept": np.unique(kept), "windows": {}}
    for k in {span, *(int(x) for x in np.diff(first) if 0 < x < span)}:
        full = within(first, k, len(hashes) - k + 1) if len(hashes) >= k else np.zeros(0, bool)
        at = np.flatnonzero(full)
        owner = np.searchsorted(first, at, "right") - 1
        if k < span:
            keep = np.diff(first)[owner] == k
            at, owner = at[keep], owner[keep]
        found: dict[bytes, set] = {}
        for a, o in zip(at.tolist(), owner.tolist()):
            words = b" ".join(raw[starts[x] : ends[x]].tobytes() for x in range(a, a + k))
            found.setdefault(words, set()).add(str(ids[o]))
        if found:
            h = gram_hashes(hashes, k, 1)[at]
            out["windows"][k] = (np.unique(h), found)
    return out


def _row(doc_id, n: int, hit: np.ndarray, items: set) -> tuple:
    n_hit = int(hit.sum()) if len(items) else 0
    return doc_id, n, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]


def _candidates(hashes: np.ndarray, first: np.ndarray, places: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Starts of whole windows around the kept grams at places."""
    n = len(hashes) - span + 1
    if n <= 0 or not len(places):
        return np.zeros(0, np.int64)
    starts = np.unique((places[:, None] - np.arange(span - gram + 1)[None, :]).ravel())
    starts = starts[(starts >= 0) & (starts < n)]
    return starts[within(first, span, n)[starts]]


def _found(batch, index: dict, span: int, gram: int):
    """(start, length, item ids) of every window of an item in a batch of texts."""
    raw, starts, ends, first, hashes = batch
    places, kept = winnow(hashes, first, gram, span - gram + 1)
    places = places[member(kept, index["kept"])]
    for k, (known, found) in index["windows"].items():
        if k == span:
            at = _candidates(hashes, first, places, span, gram)
        else:
            at = np.flatnonzero(within(first, k, max(0, len(hashes) - k + 1)))
        h = gram_hashes(hashes, k, 1)
        at = at[member(h[at], known)]
        for a in at.tolist():
            items = found.get(b" ".join(raw[starts[x] : ends[x]].tobytes() for x in range(a, a + k)))
            if items:
                yield a, k, items


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_mb: float = BROADCAST_MB, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts words inside any occurrence of an item's window of `span` words (an item of fewer words, but not none,
    is one window). Null and empty texts have no words and no hits; null item texts are no items; repeated items and
    rows count as they come. Without items every row is clean. Only the named columns are read;
    those named in `carry` are handed through as a struct.
    """
    spark = docs.sparkSession
    bench = items.select(F.col(item_id_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if size <= broadcast_mb * 1e6:
        index = spark.sparkContext.broadcast(_index(bench.toArrow(), span, gram))

        def run(batches):
            for batch in batches:
                words = _words(batch.column(1))
                first, n = words[3], len(words[4])
                hits: dict[int, tuple[np.ndarray, set]] = {}
                for a, k, found in _found(words, index.value, span, gram):
                    d = int(np.searchsorted(first, a, "right")) - 1
                    mask, ids = hits.setdefault(d, (np.zeros(first[d + 1] - first[d], bool), set()))
                    mask[a - first[d] : a - first[d] + k] = True
                    ids |= found
                none = (np.zeros(0, bool), set())
                rows = [_row(i, int(first[d + 1] - first[d]), *hits.get(d, none)) for d, i in enumerate(batch.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, _TYPES)] + batch.columns[2:], names=[*_NAMES, *batch.schema.names[2:]])

        return id_text(docs, id_col, text_col, carry).mapInArrow(run, carried(docs, SCHEMA, carry))
    return _by_shuffle(docs, bench, span, gram, id_col, text_col, carry)


def _by_shuffle(docs: DataFrame, bench: DataFrame, span: int, gram: int, id_col: str, text_col: str, carry: tuple) -> DataFrame:
    """The same for a benchmark of any size: fingerprints, then windows around them, meet in shuffled joins."""
    keyed = materialize(id_text(docs, id_col, text_col, carry).withColumn("row", F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id())))
    lengths = [r[0] for r in bench.select(F.size(F.regexp_extract_all(F.col("text"), F.lit(r"([0-9A-Za-z\x{80}-\x{10FFFF}]+)"))).alias("n")).where(f"n > 0 and n < {span}").distinct().collect()]

    def kept(batches):
        for batch in batches:
            _, _, _, first, hashes = _words(batch.column("text"))
            places, h = winnow(hashes, first, gram, span - gram + 1)
            owner = np.searchsorted(first, places, "right") - 1
            rows = batch.column("row").take(pa.array(owner)) if len(owner) else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([rows, pa.array(places - first[owner]), pa.array(h.view(np.int64))], names=["row", "place", "fp"])

    def windows(ks, only_short: bool):
        def run(batches):
            for batch in batches:
                raw, starts, ends, first, hashes = _words(batch.column("text"))
                near = batch.column("places").to_pylist() if "places" in batch.schema.names else None
                ids = batch.column("row" if near is not None else "item_id").to_pylist()
                out = []
                for d, i in enumerate(ids):
                    a, b = int(first[d]), int(first[d + 1])
                    n = b - a
                    for k in ks:
                        if n < k or (only_short and k < span and n != k):
                            continue
                        if k == span and near is not None:
                            at = sorted({p - j for p in near[d] or [] for j in range(span - gram + 1) if 0 <= p - j <= n - k})
                        else:
                            at = range(n - k + 1)
                        for s in at:
                            words = b" ".join(raw[starts[x] : ends[x]].tobytes() for x in range(a + s, a + s + k))
                            out.append((i, s, k, hashlib.blake2b(words, digest_size=16).digest()))
                cols = list(zip(*out)) if out else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["id", "start", "k", "digest"])

        return run

    base = bench.select("item_id", "text")
    fps = base.withColumnRenamed("item_id", "row").mapInArrow(kept, "row string, place long, fp long").select("fp").distinct()
    near = keyed.select("row", "text").mapInArrow(kept, "row string, place long, fp long").join(fps, "fp", "left_semi").groupBy("row").agg(F.collect_list("place").alias("places"))
    ks = sorted({span, *lengths})
    theirs = base.mapInArrow(windows(ks, True), "id string, start long, k long, digest binary").select("digest", F.col("id").alias("item_id")).distinct()
    ours = keyed.join(near, "row", "left").where(F.lit(bool(lengths)) | F.col("places").isNotNull()).select("row", "text", "places").mapInArrow(windows(ks, False), "id string, start long, k long, digest binary")
    # words need to know only that a window is some item's; items are met once for each document and distinct window
    hit = ours.join(theirs.select("digest").distinct(), "digest", "left_semi")
    words = hit.select(F.col("id").alias("row"), F.explode(F.sequence("start", F.col("start") + F.col("k") - 1)).alias("w")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    met = ours.select(F.col("id").alias("row"), "digest").distinct().join(theirs, "digest").select("row", "item_id").distinct()
    which = met.groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))

    def count(batches):
        for batch in batches:
            first = _words(batch.column("text"))[3]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(np.diff(first))], names=["row", "doc_id", "n_words"])

    counted = keyed.select("row", "doc_id", "text").mapInArrow(count, "row string, doc_id long, n_words long")
    out = counted.join(words, "row", "left").join(which, "row", "left")
    if carry:
        out = out.join(keyed.select("row", "carry"), "row")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size(F.coalesce("items", F.array().cast("array<string>"))), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), *(["carry"] if carry else []))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
