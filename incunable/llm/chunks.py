"""Chunks of documents that ask shards of a hash space, for operators that compare every place of a corpus with every other.

Documents are packed, without a shuffle, into compressed chunks of a few megabytes that are written once. In a round of
questions each chunk sends each shard one row with all it asks there (distinct keys only, sorted, so they compress); a
shard merges the rows of all chunks and sends each chunk one row back, its answers in the order of its questions. What
moves grows with the distinct keys of the chunks, never with the number of pairs, and a key that occurs everywhere
costs one entry for each chunk.

Chunks and shards both grow with the corpus, and so would a row for each pair of them with its square. Beyond ROWS such
rows a round takes two hops each way: a chunk sends a row to each of about sqrt(shards) groups of shards; there the rows
of a batch of about as many chunks are dealt out again, one row to each shard. The answers are the same.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, id_text, lean, materialize

CHUNK_BYTES, TASKS, ROWS = 8 << 20, 8192, 1 << 22


def shrink(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def grow(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text", carry: tuple = (), made: str = "", make=None) -> DataFrame:
    """(chunk, bytes, blob): the documents in chunks, each in the order of doc_id (nulls last), with the columns `carry`.

    Where `made` names columns with their types, make(doc_ids, known, raw, offsets) gives their values once for each
    chunk, and the texts themselves are not kept.
    """
    names = [x.split()[0] for x in made.split(", ")] if made else []
    types = [pa.int64() if x.split()[1] == "long" else pa.binary() for x in made.split(", ")] if made else []

    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def emit():
            ids = pa.concat_arrays([x.column(0).cast(pa.int64()) for x in held])
            texts = pa.concat_arrays([x.column(1).cast(pa.large_string()) for x in held])
            order = np.argsort(ids.fill_null(np.iinfo(np.int64).max).to_numpy(), kind="stable")
            ids, texts = ids.take(pa.array(order)), texts.take(pa.array(order))
            raw, offsets = buffers(texts)
            known = ~np.asarray(ids.is_null())
            more = pa.concat_arrays([x.column(2) for x in held]).take(pa.array(order)).to_pylist() if carry else None
            ids = ids.fill_null(0).to_numpy()
            blob = shrink(pickle.dumps((ids, known, offsets, b"" if make else raw.tobytes(), more), 5), 3)
            values = make(ids, known, raw, offsets) if make else []
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + seq]), pa.array([len(raw)]), pa.array([blob], pa.binary()), *(pa.array([v], t) for v, t in zip(values, types))], names=["chunk", "bytes", "blob", *names])

        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= chunk_bytes:
                yield emit()
                seq, held, size = seq + 1, [], 0
                lean()
        if any(x.num_rows for x in held):
            yield emit()
            lean()

    return materialize(id_text(docs, id_col, text_col, carry).mapInArrow(run, "chunk long, bytes long, blob binary" + (f", {made}" if made else "")), "none")


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, which of them are known, offsets, and the bytes of all texts."""
    ids, known, offsets, raw, _ = pickle.loads(grow(blob))
    return ids, known, offsets, np.frombuffer(raw, np.uint8)


def unpack_carry(blob: bytes) -> list | None:
    return pickle.loads(grow(blob))[4]


def squeeze(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(4, "little") + values.dtype.str[1:].encode() + shrink(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    n, kind = int.from_bytes(data[:4], "little"), np.dtype(data[4:6].decode())
    planes = np.frombuffer(grow(data[6:]), np.uint8).reshape(kind.itemsize, n) if n else np.zeros((kind.itemsize, 0), np.uint8)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=values.dtype.type(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(steps := unsqueeze(data), dtype=steps.dtype)


def shard_bits(keys: int, per_shard: int) -> int:
    """Bits of a hash that name its shard, with about per_shard of so many keys in each."""
    return max(0, int(np.ceil(np.log2(max(1, keys / per_shard)))))


def by_shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard's hashes begin in the sorted array, and its end."""
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


QUESTION = "shard int, chunk long, payload binary"
ANSWER = "chunk long, shard int, payload binary, tally long"


def ask(chunks: DataFrame, questions) -> DataFrame:
    """Rows for each shard from each chunk; questions(row as dict of Python values) yields (shard, payload)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = list(questions(row))
                lean()
                if out:
                    shards, payloads = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([row["chunk"]] * len(out), pa.int64()), pa.array(payloads, pa.binary())], names=["shard", "chunk", "payload"])

    return chunks.mapInArrow(run, QUESTION)


def answer(questions: DataFrame, merge, shards: int) -> DataFrame:
    """merge(chunks, payloads) of one shard gives the payload for each chunk, or None; with a `tally` attribute of it, that of the shard too."""

    def run(key, table):
        chunks, payloads = table.column("chunk").to_pylist(), table.column("payload").to_pylist()
        order = sorted(range(len(chunks)), key=chunks.__getitem__)
        made = merge([chunks[i] for i in order], [payloads[i] for i in order])
        out = [(chunks[i], p) for i, p in zip(order, made) if p is not None]
        tally = [getattr(made, "tally", 0)] + [0] * max(0, len(out) - 1)
        return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "shard": pa.array([key[0].as_py()] * len(out), pa.int32()), "payload": pa.array([p for _, p in out], pa.binary()), "tally": pa.array(tally[: len(out)], pa.int64())})

    return materialize(questions.repartition(min(shards, TASKS), "shard").groupBy("shard").applyInArrow(run, ANSWER))


class Answers(list):
    """A shard's answers with a number that the driver may sum over all shards."""

    tally = 0


def round_of(chunks: DataFrame, questions, merge, bits: int, n_chunks: int, most_rows: int = ROWS) -> DataFrame:
    """The answers of 2^bits shards to all chunks, in one hop or in two: see the module's head."""
    if n_chunks << bits <= most_rows or bits < 2:
        return answer(ask(chunks, questions), merge, 1 << bits)
    low = bits // 2
    groups, batches = 1 << (bits - low), max(1, -(-n_chunks >> low))

    def out(names: dict, rows: list) -> pa.Table:
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(names.items(), columns)})

    def split(key, table):
        """The rows of a batch of chunks for a group of shards, as one row for each shard."""
        by: dict[int, list] = {}
        for chunk, payload in zip(table.column("chunk").to_pylist(), table.column("payload").to_pylist()):
            for shard, part in pickle.loads(payload):
                by.setdefault(shard, []).append((chunk, part))
        return out({"shard": pa.int32(), "batch": pa.int64(), "payload": pa.binary()}, [(s, key[1].as_py(), pickle.dumps(v, 5)) for s, v in sorted(by.items())])

    def decide(key, table):
        """A shard's answers, as one row for each batch."""
        parts = sorted(((chunk, part, batch) for batch, payload in zip(table.column("batch").to_pylist(), table.column("payload").to_pylist()) for chunk, part in pickle.loads(payload)), key=lambda x: x[0])
        made = merge([x[0] for x in parts], [x[1] for x in parts])
        by: dict[int, list] = {}
        for (chunk, _, batch), got in zip(parts, made):
            if got is not None:
                by.setdefault(batch, []).append((chunk, got))
        shard, tally = key[0].as_py(), [getattr(made, "tally", 0)] + [0] * len(by)
        return out({"group": pa.int32(), "batch": pa.int64(), "shard": pa.int32(), "payload": pa.binary(), "tally": pa.int64()}, [(shard >> low, b, shard, pickle.dumps(v, 5), t) for (b, v), t in zip(sorted(by.items()), tally)])

    def back(key, table):
        """The answers of a group of shards, as one row for each chunk of a batch; shard -1 - group marks such a row."""
        by: dict[int, list] = {}
        for shard, payload in zip(table.column("shard").to_pylist(), table.column("payload").to_pylist()):
            for chunk, part in pickle.loads(payload):
                by.setdefault(chunk, []).append((shard, part))
        tally = [sum(table.column("tally").to_pylist())] + [0] * len(by)
        return out({"chunk": pa.int64(), "shard": pa.int32(), "payload": pa.binary(), "tally": pa.int64()}, [(c, -1 - key[0].as_py(), pickle.dumps(v, 5), t) for (c, v), t in zip(sorted(by.items()), tally)])

    def grouped(row):
        by: dict[int, list] = {}
        for shard, payload in questions(row):
            by.setdefault(shard >> low, []).append((shard, payload))
        for group, parts in by.items():
            yield group, pickle.dumps(parts, 5)

    asked = ask(chunks, grouped).select(F.col("shard").alias("group"), F.pmod(F.xxhash64("chunk"), F.lit(batches)).alias("batch"), "chunk", "payload")
    hop, tasks = ("group", "batch"), min(groups * batches, TASKS)
    dealt = asked.repartition(tasks, *hop).groupBy(*hop).applyInArrow(split, "shard int, batch long, payload binary")
    decided = dealt.repartition(min(1 << bits, TASKS), "shard").groupBy("shard").applyInArrow(decide, "group int, batch long, shard int, payload binary, tally long")
    return materialize(decided.repartition(tasks, *hop).groupBy(*hop).applyInArrow(back, ANSWER))


def told(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """The chunks with all answers they got: column told, an array of (round, shard, payload)."""
    rows = [a.select("chunk", F.struct(F.lit(i).alias("round"), "shard", "payload").alias("x")) for i, a in enumerate(answers)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    # merged whatever the size of the answers: they grow with the corpus
    return chunks.hint("merge").join(every.groupBy("chunk").agg(F.collect_list("x").alias("told")), "chunk", "left")


def heard(row: dict, n: int) -> list[dict[int, bytes]]:
    """The payloads of each of n rounds by shard."""
    out: list[dict[int, bytes]] = [{} for _ in range(n)]
    for x in row["told"] or []:
        out[x["round"]].update(pickle.loads(x["payload"]) if x["shard"] < 0 else [(x["shard"], x["payload"])])
    return out
