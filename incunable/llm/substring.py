"""Substring dedup: repeated windows of words are removed, all but the first; a count-min sketch goes ahead of exact grouping.

Pass one: every chunk counts its windows in a sketch, cells by hash and counters that saturate at two, and sends each
shard of the cells the ones it has filled (sparse, delta-coded). The shard adds the chunks' sketches up; a merged
counter is never below a window's true count. Pass two: only windows whose counter reached two, within the chunk or
after merging, are grouped exactly, by a 128-bit digest whose halves come from independent hashes of the words, and each group's shard names the chunk that holds its first
occurrence. Pass three removes what every other occurrence covers. A window that repeats is never lost: its counter is
two at least.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ROWS, by_shard, heard, pack, round_of, shard_bits, squeeze, squeeze_sorted, told, unpack, unsqueeze, unsqueeze_sorted
from .common import SPACES, documents, gram_hashes, lean, spans, within, word_hashes

WINDOW, PER_SHARD, CELL_BITS = 20, 1 << 20, 25


def _windows(row: dict, window: int):
    ids, known, offsets, raw = unpack(row["blob"])
    starts, ends, first = spans(raw, offsets, SPACES)
    words = word_hashes(raw, starts, ends)
    at = np.flatnonzero(within(first, window, max(0, len(words) - window + 1)))
    return ids, known, raw, starts, ends, first, at, gram_hashes(words, window)[at]


def _cells(hashes: np.ndarray, bits: int, cell_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells filled, as (shard, cell) in one sorted integer, and each window's place among them."""
    return np.unique(hashes >> np.uint64(64 - bits - cell_bits), return_inverse=True)


def _split(cells: np.ndarray, bits: int, cell_bits: int):
    edges = np.searchsorted(cells, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(cell_bits))
    for shard in np.flatnonzero(np.diff(edges)):
        yield int(shard), int(edges[shard]), int(edges[shard + 1])


def _repeated(hashes: np.ndarray, answers: dict[int, bytes], bits: int, cell_bits: int) -> np.ndarray:
    """Windows whose counter is two or more."""
    cells, place = _cells(hashes, bits, cell_bits)
    hot = np.bincount(place, minlength=len(cells)) > 1
    for shard, a, b in _split(cells, bits, cell_bits):
        if shard in answers:
            hot[a:b] |= np.unpackbits(np.frombuffer(answers[shard], np.uint8), count=b - a).astype(bool)
    return hot[place]


def _groups(second: np.ndarray, at: np.ndarray, hashes: np.ndarray, hot: np.ndarray):
    """Of the windows that may repeat: places (rising), the distinct digests in order, and each window's digest."""
    pair = np.empty(int(hot.sum()), [("a", np.uint64), ("b", np.uint64)])
    pair["a"], pair["b"] = hashes[hot], second[at][hot]
    order = np.lexsort((np.arange(len(pair)), pair["b"], pair["a"]))
    new = np.ones(len(pair), bool)
    new[1:] = (pair["a"][order][1:] != pair["a"][order][:-1]) | (pair["b"][order][1:] != pair["b"][order][:-1])
    group = np.empty(len(pair), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]
    return at[hot], pair[first], group, first


def _parts(words_row: dict, window: int, bits: int, cell_bits: int, answers: dict[int, bytes]):
    ids, known, raw, starts, ends, first, at, hashes = _windows(words_row, window)
    hot = _repeated(hashes, answers, bits, cell_bits)
    second = gram_hashes(word_hashes(raw, starts, ends, 1), window, 1)
    return ids, known, raw, starts, ends, first, *_groups(second, at, hashes, hot)


def _merge_cells(cell_bits: int):
    def merge(chunks, payloads):
        total = np.zeros(1 << cell_bits, np.uint8)
        each = [unsqueeze_sorted(p) for p in payloads]
        for cells in each:
            seen = total[cells]
            total[cells] = np.minimum(seen, 1) + 1
        return [np.packbits(total[cells] > 1).tobytes() for cells in each]

    return merge


def _merge_digests(chunks, payloads):
    parts = []
    for i, p in enumerate(payloads):
        cut = [int.from_bytes(p[j : j + 4], "little") for j in (0, 4)]
        a, b, owner = unsqueeze_sorted(p[8 : 8 + cut[0]]), unsqueeze(p[8 + cut[0] : 8 + sum(cut)]), unsqueeze(p[8 + sum(cut) :])
        parts.append((a, b, owner, np.full(len(a), i, np.int32)))
    a, b, owner, which = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((which, owner, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    mine = np.zeros(len(a), bool)
    mine[order[new]] = True
    edges = np.cumsum([0] + [len(x[0]) for x in parts])
    return [np.packbits(mine[edges[i] : edges[i + 1]]).tobytes() for i in range(len(parts))]


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def dedup_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, per_shard: int = PER_SHARD, cell_bits: int = CELL_BITS, chunk_bytes: int | None = None, most_rows: int = ROWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): each document without the words of windows that occur earlier.

    Earlier is a smaller doc_id, or the same one and an earlier start (rows that repeat a doc_id count in the order in
    which they are read; null doc_ids come last). Words are runs of bytes other than white space; kept joins the rest by
    single spaces (null where `texts` is false). Null and empty texts have no words. An empty table gives no rows.
    """
    chunks = pack(docs, **({"chunk_bytes": chunk_bytes} if chunk_bytes else {}), id_col=id_col, text_col=text_col)
    size, n_chunks = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    bits = shard_bits(size // 6, per_shard)  # sizes the sketch only

    def cells(row):
        found, _ = _cells(_windows(row, window)[-1], bits, cell_bits)
        for shard, a, b in _split(found, bits, cell_bits):
            yield shard, squeeze_sorted((found[a:b] & np.uint64((1 << cell_bits) - 1)).astype(np.uint32))

    counted = round_of(chunks.select("chunk", "blob"), cells, _merge_cells(cell_bits), bits, n_chunks, most_rows)

    def digests(row):
        ids, known, _, _, _, first, at, pairs, _, leaders = _parts(row, window, bits, cell_bits, heard(row, 1)[0])
        doc = np.searchsorted(first, at[leaders], "right") - 1
        owner = np.where(known[doc], ids[doc], np.iinfo(np.int64).max)
        edges = by_shard(pairs["a"], bits)
        for shard in np.flatnonzero(np.diff(edges)):
            s = slice(edges[shard], edges[shard + 1])
            a, b, o = squeeze_sorted(np.ascontiguousarray(pairs["a"][s])), squeeze(np.ascontiguousarray(pairs["b"][s])), squeeze(np.ascontiguousarray(owner[s]))
            yield int(shard), len(a).to_bytes(4, "little") + len(b).to_bytes(4, "little") + a + b + o

    owners = round_of(told(chunks.select("chunk", "blob"), counted), digests, _merge_digests, bits, n_chunks, most_rows)

    def remove(batches):
        for batch in batches:
            for row in batch.to_pylist():
                one, two = heard(row, 2)
                ids, known, raw, starts, ends, first, at, pairs, group, leaders = _parts(row, window, bits, cell_bits, one)
                mine = np.zeros(len(pairs), bool)
                edges = by_shard(pairs["a"], bits)
                for shard, data in two.items():
                    a, b = edges[shard], edges[shard + 1]
                    mine[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a).astype(bool)
                keep = np.zeros(len(at), bool)
                keep[leaders[mine]] = True
                gone = np.zeros(len(starts) + 1, np.int32)
                np.add.at(gone, at[~keep], 1)
                np.add.at(gone, at[~keep] + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                data, out = raw.tobytes(), []
                s, e = starts.tolist(), ends.tolist()
                for d in range(len(ids)):
                    a, b = int(first[d]), int(first[d + 1])
                    left = b" ".join([data[s[i] : e[i]] for i in (np.flatnonzero(~gone[a:b]) + a).tolist()])
                    out.append((int(ids[d]) if known[d] else None, b - a, int(gone[a:b].sum()), hashlib.sha256(left).hexdigest(), left.decode() if texts else None))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
                lean()

    return told(chunks.select("chunk", "blob"), counted, owners).mapInArrow(remove, SCHEMA)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_windows(documents(spark, sf_dir), texts=False).drop("kept")
