"""Nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard, results merged.

Vectors are dealt into shards of about `shard_rows` by a hash of their id. A shard keeps each distinct vector once (with
the ids that have it), lifts inner product to distance by one more coordinate, and inserts the vectors into its graph one
batch after another: each searches the graph as it stands, from the top level down, links to a varied choice of what it
found (and of the batch's earlier vectors), and the linked ones prune their links alike. Batches grow with the graph.
Neighbours are flat int32 arrays, one for each level. Queries come in blocks; each block meets each shard once, all its
queries walking the graph together. The nearest found are scored again in double precision on the original vectors.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import TASKS
from .common import materialize, tuned

SHARD_ROWS, BLOCK_QUERIES, M, EF, EF_BUILD, K, AT_ONCE, WIDE = 8192, 512, 16, 200, 100, 20, 256, 16


def _varied(x: np.ndarray, cand: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 for none), those nearer to the row than to any already chosen; then the nearest of the rest."""
    n, c = cand.shape
    out = np.full((n, most), -1, np.int32)
    for s in range(0, n, 256):
        at = cand[s : s + 256]
        v = x[np.maximum(at, 0)]
        between = v @ v.transpose(0, 2, 1)
        closer = between > near[s : s + 256, :, None]  # [i, j, k]: candidate j is nearer to candidate k than to the row
        chosen, count = np.zeros(at.shape, bool), np.zeros(len(at), int)
        for j in range(c):
            ok = (at[:, j] >= 0) & ~(closer[:, j, :] & chosen).any(axis=1) & (count < most)
            chosen[:, j] = ok
            count += ok
        rank = np.where(chosen, 0, 1) * c + np.arange(c)
        rank[at < 0] = 3 * c
        pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
        got = np.take_along_axis(at, pick, axis=1)
        out[s : s + 256, : got.shape[1]] = got
    return out


def _best(cand: np.ndarray, near: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's `keep` nearest candidates, nearest first."""
    order = np.argsort(-near, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(cand, order, axis=1), np.take_along_axis(near, order, axis=1)


def _greedy(x: np.ndarray, level: tuple, q: np.ndarray, now: np.ndarray) -> np.ndarray:
    """From a place for each query, step to the nearest neighbour while that is nearer."""
    place, graph = level
    now, best, moving = now.copy(), np.einsum("ij,ij->i", x[now], q), np.arange(len(q))
    while len(moving):
        near = graph[place[now[moving]]]
        sims = np.where(near >= 0, np.einsum("ijk,ik->ij", x[np.maximum(near, 0)], q[moving]), -np.inf)
        j = sims.argmax(axis=1)
        rows = np.arange(len(moving))
        better = sims[rows, j] > best[moving]
        moving, to, sim = moving[better], near[rows, j][better], sims[rows, j][better]
        now[moving], best[moving] = to, sim
    return now


def _beam(x: np.ndarray, level: tuple, q: np.ndarray, now: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest places (-1 for none) that a search of one level from a place for each query meets, nearest first."""
    (place, graph), rows = level, np.arange(len(q))
    seen = np.zeros((len(q), len(x)), bool)
    seen[rows, now] = True
    ids, val, done = np.full((len(q), ef), -1, np.int32), np.full((len(q), ef), -np.inf, np.float32), np.ones((len(q), ef), bool)
    ids[:, 0], val[:, 0], done[:, 0] = now, np.einsum("ij,ij->i", x[now], q), False
    active, wide = rows, min(WIDE, ef)
    while len(active):
        open_val = np.where(done[active], -np.inf, val[active])
        pick = np.argpartition(-open_val, wide - 1, axis=1)[:, :wide]
        ok = np.isfinite(np.take_along_axis(open_val, pick, axis=1))
        live = ok.any(axis=1)
        active, pick, ok = active[live], pick[live], ok[live]
        if not len(active):
            break
        done[active[:, None], pick] |= ok
        near = graph[place[np.maximum(ids[active[:, None], pick], 0)]]
        near = np.where(ok[:, :, None], near, -1).reshape(len(active), -1)
        r, c = np.nonzero(near >= 0)
        to = near[r, c]
        fresh = ~seen[active[r], to]
        r, c, to = r[fresh], c[fresh], to[fresh]
        seen[active[r], to] = True
        sims = np.full(near.shape, -np.inf, np.float32)
        sims[r, c] = np.einsum("ij,ij->i", x[to], q[active[r]])
        # a place that two of the expanded ones link to is kept once
        key = r.astype(np.int64) * len(x) + to
        _, first = np.unique(key, return_index=True)
        twice = np.ones(len(key), bool)
        twice[first] = False
        sims[r[twice], c[twice]] = -np.inf
        worst = val[active].min(axis=1, keepdims=True)
        sims[sims <= worst] = -np.inf
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_val = np.concatenate([val[active], sims], axis=1)
        all_done = np.concatenate([done[active], sims == -np.inf], axis=1)
        top = np.argpartition(-all_val, ef - 1, axis=1)[:, :ef]
        ids[active], val[active], done[active] = (np.take_along_axis(a, top, axis=1) for a in (all_ids, all_val, all_done))
    return _best(np.where(np.isfinite(val), ids, -1), val, ef)


def _link(x: np.ndarray, level: tuple, nodes: np.ndarray, links: np.ndarray) -> None:
    """Set the links of new nodes and add them to those that they link to, pruned to what a row holds."""
    place, graph = level
    most = graph.shape[1]
    graph[place[nodes], : links.shape[1]] = links
    r, c = np.nonzero(links >= 0)
    if not len(r):
        return
    u, v = links[r, c], nodes[r].astype(np.int32)
    sim = np.einsum("ij,ij->i", x[u], x[v])
    order = np.lexsort((-sim, u))
    u, v, sim = u[order], v[order], sim[order]
    met, start = np.unique(u, return_index=True)
    rank = np.arange(len(u)) - np.repeat(start, np.diff(np.append(start, len(u))))
    width = min(int(rank.max()) + 1, 2 * most)  # of new links to one node the nearest are tried
    keep = rank < width
    row = np.searchsorted(met, u)
    cand, near = np.full((len(met), most + width), -1, np.int32), np.full((len(met), most + width), -np.inf, np.float32)
    cand[:, :most] = have = graph[place[met]]
    near[:, :most] = np.where(have >= 0, np.einsum("ijk,ik->ij", x[np.maximum(have, 0)], x[met]), -np.inf)
    cand[row[keep], most + rank[keep]], near[row[keep], most + rank[keep]] = v[keep], sim[keep]
    cand, near = _best(cand, near, cand.shape[1])
    full = (cand >= 0).sum(axis=1) > most
    graph[place[met[~full]]] = cand[~full, :most]
    if full.any():
        graph[place[met[full]]] = _varied(x, cand[full], near[full], most)


def _insert(x: np.ndarray, height: np.ndarray, order: np.ndarray) -> tuple[list, int]:
    """The levels, as (row of each node, neighbours of each row), and the entry, after inserting all nodes in the order given."""
    levels = []
    for h in range(int(height.max()) + 1):
        nodes = np.flatnonzero(height >= h)
        place = np.full(len(x), -1, np.int32)
        place[nodes] = np.arange(len(nodes))
        levels.append((place, np.full((len(nodes), 2 * M if h == 0 else M), -1, np.int32)))
    entry, top, done = int(order[0]), int(height[order[0]]), 1
    while done < len(order):
        batch = order[done : done + min(AT_ONCE, done)]
        q, rise = x[batch], height[batch]
        among = q @ q.T
        among[np.triu_indices(len(batch))] = -np.inf  # the batch's earlier nodes are candidates too
        now = np.full(len(batch), entry)
        for h in range(max(top, int(rise.max())), -1, -1):
            joins = np.flatnonzero(rise >= h)
            if h <= top:
                passing = np.flatnonzero(rise < h)
                if len(passing):
                    now[passing] = _greedy(x, levels[h], q[passing], now[passing])
                if not len(joins):
                    continue
                cand, near = _beam(x, levels[h], q[joins], now[joins], EF_BUILD)
                now[joins] = cand[:, 0]
            else:
                cand, near = np.zeros((len(joins), 0), np.int32), np.zeros((len(joins), 0), np.float32)
            own = among[np.ix_(joins, joins)]
            cand = np.concatenate([cand, np.where(np.isfinite(own), batch[joins][None, :], -1).astype(np.int32)], axis=1)
            cand, near = _best(cand, np.concatenate([near, own], axis=1), EF_BUILD)
            _link(x, levels[h], batch[joins], _varied(x, np.where(np.isfinite(near), cand, -1), near, M))
        high = int(rise.argmax())
        if rise[high] > top:
            entry, top = int(batch[high]), int(rise[high])
        done += len(batch)
    return levels, entry


def build(ids: np.ndarray, vectors: np.ndarray, graph: bool = True) -> dict:
    """A shard's index: distinct vectors, their ids as one flat array with offsets, and the levels' neighbour arrays."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])
    # a repeated row of one id and vector counts once, before any cut at k
    once = np.concatenate([[True], new[1:] | (ids[1:] != ids[:-1])])
    ids, vectors, new = ids[once], vectors[once], new[once]
    offsets = np.append(np.flatnonzero(new), len(ids))
    distinct = vectors[new]
    norms = np.einsum("ij,ij->i", distinct.astype(float), distinct.astype(float))
    lift = np.sqrt(np.maximum(norms.max() - norms, 0))
    x = np.concatenate([distinct, lift[:, None]], axis=1).astype(np.float32)
    x /= max(np.sqrt(norms.max()), 1e-30)
    if not graph:
        return {"ids": ids, "offsets": offsets, "vectors": distinct, "x": x}
    rng = np.random.Generator(np.random.PCG64(1))
    height = np.floor(-np.log(1 - rng.random(len(x))) / np.log(M)).astype(int)
    levels, entry = _insert(x, height, rng.permutation(len(x)))
    return {"ids": ids, "offsets": offsets, "vectors": distinct, "x": x, "levels": levels, "entry": entry}


def _walk(index: dict, q: np.ndarray, ef: int) -> np.ndarray:
    """Places of the ef distinct vectors found for each query, nearest first, -1 for none."""
    now = np.full(len(q), index["entry"])
    for level in reversed(index["levels"][1:]):
        now = _greedy(index["x"], level, q, now)
    return _beam(index["x"], index["levels"][0], q, now, min(ef, len(index["x"])))[0]


def _every(index: dict, queries: np.ndarray, ef: int) -> np.ndarray:
    """What _walk looks for, by comparing every vector of the shard in double precision."""
    sims = queries.astype(float) @ index["vectors"].astype(float).T
    return np.argsort(-sims, axis=1, kind="stable")[:, :ef]


def search(index: dict, query_ids: np.ndarray, queries: np.ndarray, k: int = K, ef: int = EF, exact: bool = False) -> list[tuple]:
    """(query_id, vec_id, score) of the k nearest that the shard's graph yields for each query, of all where exact; ties to smaller ids."""
    q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    found = _every(index, queries, len(index["x"])) if exact else _walk(index, q, max(ef, 2 * k))
    ids, offsets, vectors = index["ids"], index["offsets"], index["vectors"].astype(float)
    out = []
    for i, (own, v) in enumerate(zip(query_ids.tolist(), queries.astype(float))):
        at = found[i][found[i] >= 0]
        scores = vectors[at] @ v
        order = np.argsort(-scores, kind="stable")
        rows, last = [], None
        for a, s in zip(at[order].tolist(), scores[order].tolist()):
            if len(rows) >= k and s < last:
                break
            # a vector's ids rise: of each vector, the first k other than the query's own can matter
            mine = ids[offsets[a] : offsets[a + 1]][: k + 1]
            rows += [(own, x, s) for x in mine.tolist() if x != own]
            if len(rows) >= k:
                last = sorted((r[2] for r in rows), reverse=True)[k - 1]
        out += sorted(rows, key=lambda r: (-r[2], r[1]))[:k]
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1)


def nearest(vectors: DataFrame, is_query, k: int = K, ef: int = EF, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that is_query marks, by inner product.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id; vectors
    of other lengths are not compared. Rows with the query's id are not its candidates; repeated rows of one id and
    vector count once. Fewer candidates than k give fewer rows; an empty table gives none. With `exact` every vector of
    each shard is compared, and no graph is built.
    """
    spark = tuned(vectors.sparkSession)
    clean = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec_col, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & clean)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), is_query.alias("q"), F.size(vec_col).alias("dim"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("q").alias("nq"))
    sizes = sizes.select("dim", F.ceil(F.col("n") / shard_rows).alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("nq") / BLOCK_QUERIES)).alias("blocks"))
    dealt = rows.join(sizes, "dim")

    def make(key, table):
        ids, v = table.column("id").to_numpy(), _matrix(table.column("v"))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), "index": [pickle.dumps(build(ids, v, not exact), 5)]})

    def block(key, table):
        ids, v = table.column("id").to_numpy(), _matrix(table.column("v"))
        _, first = np.unique(np.concatenate([ids[:, None].view(np.uint8).reshape(len(ids), -1), np.ascontiguousarray(v).view(np.uint8).reshape(len(ids), -1)], axis=1), axis=0, return_index=True)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "queries": [pickle.dumps((ids[first], v[first]), 5)]})

    # one shard to a task: more partitions than shards, and as many as asked for
    tasks = min(TASKS, 4 * (sizes.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0] or 1))
    shards = dealt.select("dim", F.pmod(F.xxhash64("id"), "shards").alias("shard"), "id", "v").repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(make, "dim int, shard long, index binary")
    blocks = dealt.where("q").select("dim", F.pmod(F.xxhash64("id", F.lit(1)), "blocks").alias("block"), "id", "v").groupBy("dim", "block").applyInArrow(block, "dim int, block long, queries binary")
    asked = blocks.join(sizes.select("dim", "shards"), "dim").select("dim", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "queries")
    met = asked.join(materialize(shards), ["dim", "shard"]).repartition("dim", "shard", "block").select("index", "queries")

    def run(batches):
        for batch in batches:
            for index, queries in zip(batch.column(0), batch.column(1)):
                found = search(pickle.loads(index.as_py()), *pickle.loads(queries.as_py()), k, ef, exact)
                cols = list(zip(*found)) if found else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    best = met.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
