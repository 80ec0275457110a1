"""SimHash near-duplicates: 64-bit fingerprints, links within a few bits, components.

Two fingerprints that differ in at most `bits` places agree on at least `blocks - bits` of `blocks` blocks (pigeonhole),
so each fingerprint is filed under every choice of that many blocks and only fingerprints filed together are compared.
A file holds distinct fingerprints; one of more than `crowd` of them is never compared pair by pair: all its
members are filed under each fingerprint within bits/2 places instead. Two members within `bits` share such a midpoint,
and any two that share one are within `bits`, so a star around the smallest gives the same components with rows in
proportion to the members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACES, buffers, documents, id_text, materialize, spans
from .components import components

BITS, BLOCKS, SHINGLE, SEED, CROWD = 4, 6, 4, 42, 4096


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one lower-cased text, as a signed 64-bit integer."""
    return int(_fingerprints(np.frombuffer(text, np.uint8), np.array([0, len(text)]), shingle, seed)[0])


def _fingerprints(raw: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    raw = LOWER[raw]
    starts, ends, first = spans(raw, offsets, SPACES)
    # words of the buffer, each followed by one space: the shingles are its slices
    lengths = ends - starts
    to = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(int(to[-1]), 0x20, np.uint8)
    place = np.ones(len(joined), bool)
    place[to[1:] - 1] = False
    joined[place] = raw[SPACES[raw]]
    data, h = joined.tobytes(), xxhash.xxh64_intdigest
    out = np.zeros(len(offsets) - 1, np.uint64)
    for d in range(len(out)):
        a, b = int(first[d]), int(first[d + 1])
        n = b - a
        if not n:
            continue
        begin, end = to[a : b - shingle + 1] if n >= shingle else to[a : a + 1], to[a + shingle : b + 1] - 1 if n >= shingle else to[b : b + 1] - 1
        hashes = np.array([h(data[x:y], seed) for x, y in zip(begin.tolist(), end.tolist())], np.uint64)
        ones = np.zeros(64, np.int64)
        for s in range(0, len(hashes), 1 << 16):
            part = hashes[s : s + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[d] = np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row for each document; a null text counts as empty, an empty one has fingerprint 0."""

    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            fp = _fingerprints(raw, offsets, shingle, seed) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _masks(blocks: int, bits: int) -> list[int]:
    """A mask for each choice of the blocks that must agree."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, bits: int = BITS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: links that join up exactly the distinct fingerprints in column fp that chains of links join.

    Null fingerprints take no part. Files of up to `crowd` fingerprints are compared pair by pair within the file.
    """
    one = fps.where("fp is not null").select("fp").distinct()
    keyed = one.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in _masks(blocks, bits)])).alias("m", "k"))
    files = keyed.groupBy("m", "k").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    files = materialize(files)

    def compare(key, table):
        """Edges from the least member of each component of one file to the rest of it."""
        rest = np.unique(table.column("fp").to_numpy())
        a, b = [], []
        while len(rest):
            root, rest, front = rest[0], rest[1:], [rest[0]]
            while front and len(rest):
                near = np.bitwise_count((rest ^ front.pop()).view(np.uint64)) <= bits
                front.extend(found := rest[near])
                a.extend([root] * len(found))
                b.extend(found)
                rest = rest[~near]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # a file of two is one comparison on the JVM; the rest are compared as arrays
    pairs = files.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    middling = files.where((F.col("n") > 2) & (F.col("n") <= crowd)).select("m", "k")
    more = keyed.join(middling, ["m", "k"], "left_semi").groupBy("m", "k").applyInArrow(compare, "a long, b long")
    out = pairs.unionByName(more)
    if files.where(F.col("n") > crowd).isEmpty():
        return out.distinct()
    if bits % 2:
        raise ValueError("crowded files need an even number of bits")
    crowded = keyed.join(files.where(F.col("n") > crowd).select("m", "k"), ["m", "k"], "left_semi").select("fp").distinct()
    flips = [0] + [sum(1 << i for i in c) for r in range(1, bits // 2 + 1) for c in combinations(range(64), r)]
    mid = crowded.select("fp", F.explode(F.array(*[F.lit(_signed(x)) for x in flips])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    star = mid.select(F.min("fp").over(Window.partitionBy("mid")).alias("a"), F.col("fp").alias("b")).where("a < b")
    return out.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, bits: int = BITS, blocks: int = BLOCKS, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links, the row's own included.

    Exact copies share a fingerprint and so one node; a null doc_id gets a fingerprint and its component, and is never
    the least unless alone. Repeated rows come back repeated; an empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, shingle, seed, id_col, text_col))
    nodes = components(links(fps, bits, blocks))
    least = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # tables of their own, so that a component or a fingerprint with very many rows is only ever the split side of a join
    linked = materialize(least.join(nodes, least.fp == nodes.node).select("fp", F.col("component").alias("root"), "least"))
    of_root = linked.groupBy("root").agg(F.min("least").alias("other"))
    roots = materialize(least.join(of_root, least.fp == of_root.root, "left").select("fp", F.col("root").isNotNull().alias("joins"), F.least("least", "other").alias("component_id")))
    members = linked.select("fp", "root").join(roots.where("joins").select(F.col("fp").alias("root"), "component_id"), "root").select("fp", "component_id")
    alone = roots.join(linked.select("fp"), "fp", "left_anti").select("fp", "component_id")
    by_fp = materialize(members.unionByName(alone))
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
