"""Byte-level BPE encoding and decoding, by recursive DuckDB queries in each partition.

A text is cut into pieces by the tokenizer's pattern. The distinct pieces of a buffer of texts become rows (word,
position, token), one for each byte; a recursive query joins each row and its successor with the table of merges,
contracts every word's leftmost pair of least rank and ends where no word has a pair left. Decoding takes a document's
own sequence of ids, joins it with the vocabulary and aggregates the bytes in the order of the positions. Only the
vocabulary, whose size is fixed, is broadcast.

Spaces between two characters that are not white space always begin a new piece, so texts are first cut there, in place,
and only distinct strings meet the pattern. Strings and pieces that a worker has met are kept, up to a bound, as flat
arrays; they are told apart by two independent 64-bit hashes.
"""

from __future__ import annotations

import base64
import gc
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, carried, documents, id_text, word_hashes

KEPT, ROUNDS, WORDS_AT_ONCE, ROWS_AT_ONCE, BUFFER, DECODED_AT_ONCE = 1 << 20, 24, 20_000, 200_000, 4 << 20, 1 << 18
#: The characters with Unicode's White_Space property, which is what the pattern's \s means.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: A row holds its token, the next token and where that stands; -1 ends a word.
STEP = f"""
WITH RECURSIVE s AS (
  SELECT 0 AS step, w, p, t, nt, np FROM start
  UNION ALL
  SELECT s.step + 1, s.w, s.p, CASE WHEN s.p = e.p THEN e.r ELSE s.t END,
    CASE WHEN s.p = e.p THEN e.nt WHEN s.np = e.p THEN e.r ELSE s.nt END, CASE WHEN s.p = e.p THEN e.np ELSE s.np END
  FROM s JOIN (
    SELECT least.w, a.p, least.r, a.np AS gone, b.nt, b.np
    FROM (
      SELECT w, (key % 4294967296)::INTEGER AS p, (key // 4294967296)::INTEGER AS r
      FROM (SELECT s.w, min(m.r::BIGINT * 4294967296 + s.p) AS key FROM s JOIN merges m ON m.a = s.t AND m.b = s.nt GROUP BY s.w)
    ) least JOIN s a ON a.w = least.w AND a.p = least.p JOIN s b ON b.w = least.w AND b.p = a.np
  ) e ON e.w = s.w
  WHERE s.step < {ROUNDS} AND s.p <> e.gone
)
SELECT s.w, s.p, s.t, l.last FROM s JOIN (SELECT w, max(step) AS last FROM s GROUP BY w) l ON l.w = s.w AND l.last = s.step
ORDER BY s.w, s.p
"""
DECODE = "SELECT w, array_to_string(list(v.s ORDER BY p), '') AS s FROM ids JOIN vocab v ON v.t = ids.t GROUP BY w ORDER BY w"


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def expand(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each pair, one after another."""
    total = np.cumsum(sizes)
    kind = np.int32 if max(len(flat), total[-1] if len(total) else 0) < 1 << 31 else np.int64
    at = np.arange(total[-1] if len(total) else 0, dtype=kind)
    at += np.repeat((starts - (total - sizes)).astype(kind), sizes)
    return flat[at]


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A representative of each distinct pair of hashes, and each place's number among them."""
    code = pa.array(one).dictionary_encode().indices.to_numpy()
    rep = np.empty(int(code.max()) + 1 if len(code) else 0, np.int64)
    rep[code[::-1]] = np.arange(len(code))[::-1]
    if (two != two[rep][code]).any():  # equal first hashes of different strings: each stands for itself
        return np.arange(len(one)), np.arange(len(one))
    return rep, code


class Kept:
    """Ids of strings met before, by two hashes; beyond `most` strings it begins anew."""

    def __init__(self, most: int = KEPT):
        self.most = most
        self.clear()

    def clear(self):
        self.one, self.two, self.starts, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each string, -1 where it is new."""
        at = pc.fill_null(pc.index_in(pa.array(one), value_set=pa.array(self.one)), -1).to_numpy().astype(np.int64)
        if len(self.one):
            at[(at >= 0) & (self.two[at] != two)] = -1
        return at

    def add(self, one: np.ndarray, two: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        if len(self.one) > self.most:
            self.clear()
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.one, self.two, self.sizes, self.flat = (np.concatenate(x) for x in ((self.one, one), (self.two, two), (self.sizes, sizes), (self.flat, flat)))


def resolve(kept: Kept, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the strings raw[start:end], one after another, and how many each has; learn(starts, ends) gives those of new ones.

    Then a hash of each distinct string, and each string's place among these.
    """
    one, two = word_hashes(raw, starts, ends), word_hashes(raw, starts, ends, 1)
    rep, code = distinct(one, two)
    at = kept.find(one[rep], two[rep])
    new = rep[at < 0]
    flat, begin, sizes = kept.flat, np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64)
    old = at >= 0
    begin[old], sizes[old] = kept.starts[at[old]], kept.sizes[at[old]]
    if len(new):
        ids, n = learn(starts[new], ends[new])
        begin[~old], sizes[~old] = len(flat) + np.cumsum(n) - n, n
        flat = np.concatenate([flat, ids])
        kept.add(one[new], two[new], n, ids)
    return expand(flat, begin[code], sizes[code]), sizes[code], one[rep], code


class Codec:
    """One worker's DuckDB tables, pattern, and the strings and pieces it has met."""

    def __init__(self, data: bytes, pattern: str):
        import duckdb

        self.ranks = read_ranks(data)
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}", rf"[^{WHITE}\p{{L}}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, r = (pa.array(x, pa.int32()) for x in zip(*merges))
        # nothing is spilled: a worker's folder is its machine's own
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self._make("merges", pa.table({"a": a, "b": b, "r": r}))
        self._make("vocab", pa.table({"t": pa.array(list(self.ranks.values()), pa.int32()), "s": [t.decode("latin-1") for t in self.ranks]}))
        self.strings, self.pieces = Kept(), Kept()

    def _make(self, name: str, table: pa.Table) -> None:
        self.db.register("given", table)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pieces that stand one after another in data, and how many each has."""
        w = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        p = np.arange(len(w), dtype=np.int32)
        t = self.bytes[data]
        done_w, done_t = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        while len(w):
            ends = np.append(w[1:] != w[:-1], True)
            nt, after = (np.where(ends, -1, np.append(x[1:], -1)).astype(np.int32) for x in (t, p))
            self._make("start", pa.table({"w": w, "p": p, "t": t, "nt": nt, "np": after}))
            got = self.db.sql(STEP).to_arrow_table()
            w, p, t, last = (got.column(i).to_numpy() for i in range(4))
            done = last < ROUNDS
            done_w.append(w[done])
            done_t.append(t[done])
            w, p, t = w[~done], p[~done], t[~done]
        w, t = np.concatenate(done_w), np.concatenate(done_t)
        return t[np.argsort(w, kind="stable")], np.bincount(w, minlength=len(sizes))

    def learn_pieces(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, one after another, and how many each has; a piece that is a token is not merged."""
        data, n = raw.tobytes(), ends - starts
        whole = np.array([self.ranks.get(data[a:b], -1) for a, b in zip(starts.tolist(), ends.tolist())], np.int32)
        owner, ids = [np.flatnonzero(whole >= 0)], [whole[whole >= 0]]
        hard, i = np.flatnonzero(whole < 0), 0
        rows = np.cumsum(n[hard])
        while i < len(hard):
            j = int(np.searchsorted(rows, (rows[i - 1] if i else 0) + ROWS_AT_ONCE, "right"))
            part = hard[i : max(i + 1, min(j, i + WORDS_AT_ONCE))]
            t, many = self.merge(expand(raw, starts[part], n[part]), n[part])
            owner.append(np.repeat(part, many))
            ids.append(t)
            i += len(part)
        owner, ids = np.concatenate(owner), np.concatenate(ids)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(starts))

    def learn_strings(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new strings. Those that open with a space before a character and end with one are cut by the pattern as one text."""
        n = ends - starts
        plain = (raw[starts] == 0x20) & (n > 1) & _solid_after(raw, starts) & _solid_before(raw, ends)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        joined, sizes = expand(raw, starts[order], n[order]), n[order]
        cut = int(n[plain].sum())
        pieces = self.pattern.findall(joined[:cut].tobytes().decode())
        data, at = joined.tobytes(), cut
        for size in sizes[int(plain.sum()) :].tolist():
            pieces += self.pattern.findall(data[at : at + size].decode())
            at += size
        long = np.array(list(map(len, map(str.encode, pieces))), np.int64)
        stop = np.cumsum(long)
        ids, many, *_ = resolve(self.pieces, joined, stop - long, stop, lambda a, b: self.learn_pieces(joined, a, b))
        # pieces to strings: each string ends where a piece ends
        last = np.searchsorted(stop, np.cumsum(sizes))
        total = np.concatenate([[0], np.cumsum(many)])[last + 1]
        count = np.empty(len(order), np.int64)
        count[order] = here = np.diff(total, prepend=0)
        begin = np.empty(len(order), np.int64)
        begin[order] = total - here
        return expand(ids, begin, count), count

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a buffer of texts, and where each text's begin."""
        gc.disable()  # learning makes a great many small objects, none of them in cycles
        try:
            space = np.flatnonzero(raw == 0x20)
            inner = np.ones(len(raw) + 1, bool)
            inner[offsets] = inner[np.maximum(offsets - 1, 0)] = False
            space = space[inner[space]]
            space = space[_solid_after(raw, space) & _solid_before(raw, space)]
            full = offsets[:-1][np.diff(offsets) > 0]
            starts = np.sort(np.concatenate([full, space]))
            ends = np.append(starts[1:], len(raw)) if len(starts) else starts
            ids, sizes, *_ = resolve(self.strings, raw, starts, ends, lambda a, b: self.learn_strings(raw, a, b))
            return ids, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]
        finally:
            gc.enable()

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The bytes of each text, whose ids begin at first; an id that the vocabulary lacks is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.ranks)):
            raise ValueError("an id is not in the vocabulary")
        out = [b""] * (len(first) - 1)
        for a in range(0, len(ids), DECODED_AT_ONCE):
            part = ids[a : a + DECODED_AT_ONCE]
            p = np.arange(a, a + len(part))
            w = np.searchsorted(first, p, "right") - 1
            self._make("ids", pa.table({"w": w, "p": p, "t": part.astype(np.int32)}))
            got = self.db.sql(DECODE).to_arrow_table()
            for i, s in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
                out[i] += s.encode("latin-1")
        return out


_SOLID = np.ones(256, bool)
_SOLID[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = False
#: First bytes of the characters of WHITE that have two or three.
_TWO, _THREE = (0xC2,), (0xE1, 0xE2, 0xE3)


def _solid_after(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character after each place is surely not white space."""
    b = raw[np.minimum(at + 1, len(raw) - 1)]
    return _SOLID[b] & ~np.isin(b, (*_TWO, *_THREE))


def _solid_before(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is surely not white space."""
    return _SOLID[raw[at - 1]] & ~np.isin(raw[np.maximum(at - 2, 0)], _TWO) & ~np.isin(raw[np.maximum(at - 3, 0)], _THREE)


_CODECS: dict[bytes, Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """This worker's codec: made once, and used again by later tasks of the same worker."""
    key = hashlib.sha256(data + pattern.encode()).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data, pattern)
    return _CODECS[key]


def defaults() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def bpe(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """(doc_id, ids binary, decoded binary, and carry): each whole text's token ids (32-bit, little-endian) and the bytes they decode to.

    Null texts count as empty and have no ids; white-space-only, very long and repeated texts are encoded like any other.
    Only the named columns are read; those named in `carry` are handed through as a struct. An empty table gives no rows.
    """
    default_path, default_pattern = defaults()
    with open(ranks_path or default_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    pattern = pattern or default_pattern

    def run(batches):
        coder = codec(data.value, pattern)

        def done(held):
            raw, offsets = buffers(pa.concat_arrays([x.column(1).cast(pa.large_string()) for x in held]))
            ids, first = coder.encode(raw, offsets)
            back = coder.decode(ids, first)
            packed = pa.Array.from_buffers(pa.large_binary(), len(back), [None, pa.py_buffer(first.astype(np.int64) * 4), pa.py_buffer(ids.astype(np.uint32))])
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x.column(0) for x in held]), packed.cast(pa.binary()), pa.array(back, pa.binary()), *(pa.concat_arrays([x.column(2) for x in held]) for _ in carry[:1])], names=["doc_id", "ids", "decoded", *["carry"] * bool(carry)])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= BUFFER:
                yield done(held)
                held, size = [], 0
        if held:
            yield done(held)

    return id_text(docs, id_col, text_col, carry).mapInArrow(run, carried(docs, "doc_id long, ids binary, decoded binary", carry))


def decode(encoded: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) from a column of ids as bpe() makes them; null ids decode to nothing."""
    default_path, default_pattern = defaults()
    with open(ranks_path or default_path, "rb") as f:
        data = encoded.sparkSession.sparkContext.broadcast(f.read())
    pattern = pattern or default_pattern

    def run(batches):
        coder = codec(data.value, pattern)
        for batch in batches:
            ids = [np.frombuffer(x or b"", np.uint32) for x in batch.column(1).to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder.decode(flat, first), pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe(documents(spark, sf_dir))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
