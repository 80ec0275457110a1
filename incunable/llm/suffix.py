"""Suffix-array dedup: byte strings of `length` that start at two places or more, found by merging shard BWTs.

Only windows that can repeat meet. Every window of `length` bytes takes as anchor its least `gram`-byte hash, so equal
windows have their anchors at the same offset. Windows with one anchor are cut into blocks of `BLOCK` by that offset; a
block's piece is the bytes of its windows, and its core the bytes that all windows of a full block have in common: equal
windows lie in pieces with equal cores. Pieces that occur twice whole are repeated whole; for cores with more than one
piece, one copy of each piece goes to the core's shard.

There, pieces are dealt into sub-shards; each sorts its suffixes to a depth of `DEPTH` bytes, which gives its
(bounded-depth) BWT order. The orders are merged as sorted runs, and the interleave is refined from the right to the
left: each round follows the last-to-first step of two bytes, a stable counting sort on the two symbols of the BWT.
Blocks of equal order are the suffixes with a common prefix of the depth reached, so their borders are the common-prefix
array; a suffix alone in its block is done and leaves. The blocks left at depth `length` are the repeated intervals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .chunks import ROWS, by_shard, grow, heard, pack, round_of, shard_bits, shrink, squeeze, squeeze_sorted, told, unpack, unpack_carry, unsqueeze, unsqueeze_sorted
from .common import _BASE, _VALUES, _inverse, carried, documents, lean, mix, powers

LENGTH, GRAM, BLOCK, DEPTH, SUB_SHARD, PER_SHARD, BYTES_PER_SHARD, AT_ONCE = 400, 32, 128, 32, 1 << 17, 1 << 18, 4 << 20, 1 << 20
PAIR = np.dtype([("a", np.uint64), ("b", np.uint64)])
_NO_PIECES = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, PAIR))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive keys, len(keys) - width + 1 of them, in two running minima."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    fore = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[width - 1 : width - 1 + n])


def pieces(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int, block: int):
    """First and last window of each piece, its core's hash and its content's 128-bit digest, over a buffer of texts.

    The core's hash only brings pieces together; what is removed rests on the digest or on comparing bytes.
    """
    out = [_NO_PIECES]
    docs, d = len(offsets) - 1, 0
    while d < docs:
        stop = max(d + 1, int(np.searchsorted(offsets, offsets[d] + AT_ONCE, "right")) - 1)
        base = int(offsets[d])
        part, first = raw[base : offsets[stop]], offsets[d : stop + 1] - base
        out.append(tuple(x + base if i < 2 else x for i, x in enumerate(_pieces(part, first, length, gram, block))))
        d = stop
    return tuple(np.concatenate(x) for x in zip(*out))


def _pieces(raw: np.ndarray, first: np.ndarray, length: int, gram: int, block: int):
    n = len(raw)
    room = np.diff(first) - length + 1
    has = room > 0
    if not has.any():
        return _NO_PIECES
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first[:-1][has], 1)
    np.add.at(step, first[:-1][has] + room[has], -1)
    p = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    values = _VALUES[raw]
    total, inverse = np.zeros(n + 1, np.uint64), powers(_inverse(_BASE), n + 1)
    np.cumsum(values * powers(_BASE, n), out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    bits = max(1, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    anchor = (sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)[p] & low).astype(np.int64)
    where = (anchor - p) // block
    cut = np.ones(len(p), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (where[1:] != where[:-1]) | (np.diff(p) > 1)
    head = np.flatnonzero(cut)
    lo, hi = p[head], p[np.append(head[1:], len(p)) - 1]
    anchor, where = anchor[head], where[head]
    core = anchor - where * block
    keys = mix((total[core + length - block + 1] - total[core]) * inverse[core] + where.astype(np.uint64))
    data, content = raw.tobytes(), np.empty((len(head), 2), np.uint64)
    digest = xxhash.xxh3_128_digest
    content[:] = np.frombuffer(b"".join([digest(data[a:b], s) for a, b, s in zip(lo.tolist(), (hi + length).tolist(), (anchor - lo).tolist())]), np.uint64).reshape(-1, 2)
    return lo, hi, keys, content.view(PAIR).ravel()


def repeated_windows(text: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int = LENGTH, depth: int = DEPTH, sub_shard: int = SUB_SHARD) -> np.ndarray:
    """Which windows of `length` bytes occur twice or more: counts[i] windows begin at starts[i], starts[i] + 1, ...

    A flag for each window, in the order of the pieces.
    """
    n = int(counts.sum())
    flags = np.zeros(n, bool)
    if n < 2:
        return flags
    number = np.arange(n)
    window = np.repeat(starts - (np.cumsum(counts) - counts), counts) + number
    depth = min(depth, length) - (length - min(depth, length)) % 2
    at = window + (length - depth)
    prefix = np.lib.stride_tricks.sliding_window_view(text, depth)
    runs = []
    for s in range(0, n, sub_shard):  # each sub-shard's own order
        own = np.ascontiguousarray(prefix[at[s : s + sub_shard]]).view(f"S{depth}").ravel()
        runs.append(s + np.argsort(own, kind="stable"))
    order = np.concatenate(runs)
    keys = np.ascontiguousarray(prefix[at[order]]).view(f"S{depth}").ravel()
    merged = np.argsort(keys, kind="stable")  # a merge of the sorted runs
    keys, order = keys[merged], order[merged]
    border = np.ones(n, bool)
    border[1:] = keys[1:] != keys[:-1]
    del keys
    pair = (text[:-1].astype(np.uint16) << np.uint16(8)) | text[1:]
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    pos, group, border = at[order].astype(kind), np.cumsum(border, dtype=kind), None
    pos, group, number = _shared(pos, group, order.astype(kind))
    for _ in range((length - depth) // 2):
        if not len(pos):
            break
        pos = pos - kind(2)
        symbol = pair[pos]
        by = np.argsort(symbol, kind="stable")
        pos, group, number, symbol = pos[by], group[by], number[by], symbol[by]
        new = np.ones(len(pos), bool)
        new[1:] = (group[1:] != group[:-1]) | (symbol[1:] != symbol[:-1])
        pos, group, number = _shared(pos, np.cumsum(new, dtype=kind), number)
    flags[number] = True
    return flags


def _shared(pos: np.ndarray, group: np.ndarray, number: np.ndarray):
    """Without the suffixes that are alone in their group (groups are consecutive)."""
    same = np.zeros(len(group) + 1, bool)
    same[1:-1] = group[1:] == group[:-1]
    keep = same[1:] | same[:-1]
    return (pos, group, number) if keep.all() else (pos[keep], group[keep], number[keep])


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, spans array<struct<start:long,stop:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, chunk_bytes: int | None = None, bytes_per_shard: int = BYTES_PER_SHARD, carry: tuple = (), characters: bool = False, most_rows: int = ROWS) -> DataFrame:
    """One row for each document: n_bytes, n_removed, n_spans, kept_sha256, kept, spans.

    A byte is removed if a string of `length` bytes that covers it also starts anywhere else, in the same document or in
    another; documents that are copies lose all their long texts alike. Matches never cross documents; n_spans counts
    maximal removed runs, which are `spans`. kept is the rest as text, U+FFFD where a character was cut (null where
    `texts` is false, as are the spans); the digest is of the bytes themselves. With `characters` a character goes only if
    all its bytes would, so that no text holds a part of one. Null and empty texts have no bytes;
    texts under `length` bytes lose nothing. Repeated rows are copies. An empty table gives no rows. Columns
    named in `carry` are handed through as a struct.
    """
    if length < block + gram or gram < 1:
        raise ValueError("length must be at least block + gram")
    chunks = pack(docs, **({"chunk_bytes": chunk_bytes} if chunk_bytes else {}), id_col=id_col, text_col=text_col, carry=carry)
    size, n_chunks = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    bits, byte_bits = shard_bits(size // 80, PER_SHARD), shard_bits(size, bytes_per_shard)

    def found(row):
        """The chunk's pieces and the distinct ones among them, by (core, content)."""
        ids, known, offsets, raw = unpack(row["blob"])
        lo, hi, keys, content = pieces(raw, offsets, length, gram, block)
        order = np.lexsort((content["b"], content["a"], keys))
        new = np.ones(len(order), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (content[order][1:] != content[order][:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        one = order[new]
        return ids, known, offsets, raw, lo, hi, which, one, keys[one], content[one]

    def questions(row):
        *_, which, one, keys, content = found(row)
        twice = np.bincount(which, minlength=len(one)) > 1
        edges = by_shard(keys, bits)
        for shard in np.flatnonzero(np.diff(edges)):
            s = slice(edges[shard], edges[shard + 1])
            a, b = squeeze_sorted(keys[s]), squeeze(content[s].view(np.uint64))
            yield int(shard), len(a).to_bytes(4, "little") + len(b).to_bytes(4, "little") + a + b + np.packbits(twice[s]).tobytes()

    def merge(chunk_ids, payloads):
        parts = []
        for i, p in enumerate(payloads):
            x, y = (int.from_bytes(p[j : j + 4], "little") for j in (0, 4))
            keys = unsqueeze_sorted(p[8 : 8 + x])
            twice = np.unpackbits(np.frombuffer(p[8 + x + y :], np.uint8), count=len(keys))
            parts.append((keys, unsqueeze(p[8 + x : 8 + x + y]).view(PAIR), twice, np.full(len(keys), i, np.int32)))
        keys, content, twice, which = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((which, content["b"], content["a"], keys))
        k, c = keys[order], content[order]
        new_key = np.ones(len(k), bool)
        new_key[1:] = k[1:] != k[:-1]
        new = new_key.copy()
        new[1:] |= c[1:] != c[:-1]
        item = np.cumsum(new) - 1
        repeated = (np.bincount(item) + np.bincount(item, twice[order]) > 1)[item]
        several = (np.bincount(np.cumsum(new_key) - 1, new) > 1)[np.cumsum(new_key) - 1]
        out = np.zeros((len(k), 2), bool)
        out[order, 0], out[order, 1] = repeated, several & new
        edges = np.cumsum([0] + [len(x[0]) for x in parts])
        return [np.packbits(out[edges[i] : edges[i + 1]].ravel()).tobytes() for i in range(len(parts))]

    def learned(answers, keys):
        """Of a chunk's distinct pieces, which are repeated whole and which are to be sent."""
        out, edges = np.zeros((len(keys), 2), bool), by_shard(keys, bits)
        for shard, data in answers.items():
            a, b = edges[shard], edges[shard + 1]
            out[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=2 * (b - a)).reshape(-1, 2)
        return out[:, 0], out[:, 1]

    first = round_of(chunks.select("chunk", "blob"), questions, merge, bits, n_chunks, most_rows)

    def send(row):
        _, _, _, raw, lo, hi, _, one, keys, _ = found(row)
        repeated, sent = learned(heard(row, 1)[0], keys)
        edges = by_shard(keys, byte_bits)
        data = raw.tobytes()
        for shard in np.flatnonzero(np.diff(edges)):
            at = np.flatnonzero(sent[edges[shard] : edges[shard + 1]]) + edges[shard]
            if len(at):
                l, h = lo[one[at]], hi[one[at]]
                a = squeeze((h - l + 1).astype(np.uint16))
                b = np.packbits(~repeated[at]).tobytes()
                text = shrink(b"".join([data[x : y + length] for x, y in zip(l.tolist(), h.tolist())]))
                yield int(shard), len(a).to_bytes(4, "little") + len(b).to_bytes(4, "little") + a + b + text

    def compare(chunk_ids, payloads):
        counts, wanted, texts_of = [], [], []
        for p in payloads:
            x, y = (int.from_bytes(p[j : j + 4], "little") for j in (0, 4))
            counts.append(unsqueeze(p[8 : 8 + x]).astype(np.int64))
            wanted.append(np.unpackbits(np.frombuffer(p[8 + x : 8 + x + y], np.uint8), count=len(counts[-1])).astype(bool))
            texts_of.append(grow(p[8 + x + y :]))
        n, want = np.concatenate(counts), np.concatenate(wanted)
        text = np.frombuffer(b"".join(texts_of), np.uint8)
        del texts_of
        sizes = n + length - 1
        flags = repeated_windows(text, np.cumsum(sizes) - sizes, n, length)
        ends = np.cumsum(n)
        table = np.zeros((len(n), block), bool)
        table[np.repeat(np.arange(len(n)), n), np.arange(len(flags)) - np.repeat(ends - n, n)] = flags
        rows, edges = np.packbits(table, axis=1), np.cumsum([0] + [len(c) for c in counts])
        return [shrink(rows[edges[i] : edges[i + 1]][want[edges[i] : edges[i + 1]]].tobytes()) for i in range(len(counts))]

    second = round_of(told(chunks.select("chunk", "blob"), first), send, compare, byte_bits, n_chunks, most_rows)

    carry_type = to_arrow_type(docs.select(F.struct(*carry)).schema[0].dataType) if carry else None

    def remove(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, known, offsets, raw, lo, hi, which, one, keys, _ = found(row)
                answers, bitmaps = heard(row, 2)
                repeated, sent = learned(answers, keys)
                edges, compared = by_shard(keys, byte_bits), sent & ~repeated
                slot = np.cumsum(compared) - 1
                table = np.zeros((int(compared.sum()), block), bool)
                for shard, data in bitmaps.items():
                    at = slot[np.flatnonzero(compared[edges[shard] : edges[shard + 1]]) + edges[shard]]
                    got = np.frombuffer(grow(data), np.uint8).reshape(len(at), -(-block // 8))
                    table[at] = np.unpackbits(got, axis=1)[:, :block]
                step = np.zeros(len(raw) + 1, np.int32)
                whole, some = repeated[which], np.flatnonzero(compared[which])
                np.add.at(step, lo[whole], 1)
                np.add.at(step, hi[whole] + length, -1)
                piece, place = np.nonzero(table[slot[which[some]]])
                p = lo[some][piece] + place
                np.add.at(step, p, 1)
                np.add.at(step, p + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                if characters and len(raw):
                    opens = np.flatnonzero((raw & 0xC0) != 0x80)
                    whole = np.bitwise_and.reduceat(gone, opens)
                    gone = np.repeat(whole, np.diff(np.append(opens, len(raw))))
                data, keep, out = raw.tobytes(), ~gone, []
                for d in range(len(ids)):
                    a, b = int(offsets[d]), int(offsets[d + 1])
                    g = gone[a:b]
                    if g.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).view(np.int8))).reshape(-1, 2)
                        left = raw[a:b][keep[a:b]].tobytes()
                    else:
                        edge, left = np.zeros((0, 2), int), data[a:b]
                    spans_of = [{"start": int(x), "stop": int(y)} for x, y in edge] if texts else None
                    out.append((int(ids[d]) if known[d] else None, b - a, int(g.sum()), len(edge), hashlib.sha256(left).hexdigest(), left.decode(errors="replace") if texts else None, spans_of))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), _SPANS)
                more = [pa.array(unpack_carry(row["blob"]), carry_type)] if carry else []
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] + more, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans", *["carry"] * bool(carry)])
                lean()

    return told(chunks.select("chunk", "blob"), first, second).mapInArrow(remove, carried(docs, SCHEMA, carry))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(documents(spark, sf_dir), texts=False).drop("kept", "spans")
