import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from helpers import DATA, documents, frame, hard, matches, rows
from pyspark.sql import functions as F

from incunable.llm import chat, decontaminate, neighbours, quality, toxicity


def test_chat_matches_sql(spark):
    matches(chat.op6_chat_format(spark, DATA), chat.OP6_SQL)


def test_chat_hard_turns(spark):
    texts = ["", None, "### a: </turn>\n", "\\h\\b\\e\\", "<</turn>/turn>", "　\U0001f600\n", "#### user: x"]
    turns = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "to:ol", None], texts))]
    turns += [(2, 0, "assistant", "early")] * 2 + [(None, None, "user", "x")] + [(3, i, ("user", "assistant")[i % 2], "y" * 3) for i in range(1500)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_chats(df)
    back = {r["conv_id"]: r for r in chat.read_chats(out).collect()}
    assert [(x["role"], x["text"]) for x in back[1]["turns"]] == [(r or "", t or "") for _, _, r, t in sorted(turns[:7], key=lambda x: x[1])]
    assert back[1]["loss_text"] == "### a: </turn>\n" + "<</turn>/turn>"
    assert back[3]["loss_text"] == "yyy" * 750 and back[3]["valid"] and not back[2]["valid"] and len(back[2]["turns"]) == 2
    assert back[None]["turns"][0]["text"] == "x"
    problems = {r["conv_id"]: r["problem"] for r in out.collect()}
    assert problems == {1: "assistant>to:ol", 2: ">assistant", 3: None, None: None}
    assert chat.format_chats(df.limit(0)).count() == 0


def plain_contamination(docs, items):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {}
    for i, t in items:
        w = cut(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    for i, t in docs:
        w, hit, ids = cut(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (x := tuple(w[a : a + k])) in windows:
                    hit |= set(range(a, a + k))
                    ids |= windows[x]
        yield i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [64, -1])
def test_contamination_matches_plain(spark, limit):
    item = rows("benchmark")
    extra = [(100, "w1x1 w2x2"), (101, None), (102, ""), (103, "one"), (1040, item[0][1]), (105, item[1][1] + " " + item[2][1])]
    docs = [*documents().items(), *hard(), (901, "zz " + item[0][1].upper()), (902, " ".join(item[3][1].split()[:9])), (903, " ".join(item[3][1].split()[2:13]))]
    items = spark.createDataFrame([*item, *extra], "item_id long, text string").withColumn("doc_id", F.lit(3)).withColumn("fp", F.lit(4))
    got = decontaminate.contamination(frame(spark, docs), items, broadcast_mb=limit)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain_contamination(docs, [*item, *extra]), key=key)
    assert not decontaminate.contamination(frame(spark, docs), items.limit(0), broadcast_mb=limit).where("contaminated").count()
    assert decontaminate.contamination(frame(spark, []), items, broadcast_mb=limit).count() == 0


def test_winnowing_keeps_a_gram_of_every_span():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50, 4000).astype(np.uint64)
    places, _ = decontaminate.winnow(words, np.array([0, 4000]), 5, 6)
    assert np.diff(places).max() <= 6


def separated(good, bad):
    """Share of (good, bad) pairs in which the good one scores higher."""
    return np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])


@pytest.mark.parametrize("at, rows", [("sf0.01", 1000), ("sf0.1", 10000)])
def test_quality_held_out(spark, at, rows):
    at = f"/root/testdata/{at}"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    got = quality.op8_quality(spark, at).collect()
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert len(got) == rows and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert separated([s for s, y in held if y], [s for s, y in held if not y]) >= 0.93
    assert np.mean([s >= 0.7 for s, y in held if y]) >= 0.95 and np.mean([s >= 0.7 for s, y in held if not y]) <= 0.15


def test_quality_difference_alone_separates(spark):
    """The normalised size difference of a text's blocks, with nothing fitted to it."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    texts = [(r["doc_id"], r["text"] or "", labels[r["doc_id"]]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if labels.get(r["doc_id"]) is not None]
    held = [t for t in texts if zlib.crc32(str(t[0]).encode()) % 4 == 2]
    model = quality.fit([(t, y) for i, t, y in texts if zlib.crc32(str(i).encode()) % 4 != 2])
    f = quality.differences(*quality._joined([t.encode() for _, t, _ in held]), quality._compressors(model["good"], model["bad"]))[:, 0]
    assert separated([x for x, (_, _, y) in zip(f, held) if y], [x for x, (_, _, y) in zip(f, held) if not y]) >= 0.9


def test_quality_differences_match_plain():
    texts = [b"", b"a", b"the of and " * 60, b"%%% $$$ " * 33 + b"x", bytes(range(256)) * 3]
    compressors = quality._compressors(b"the of and to " * 40, b"%%% $$$ &&& " * 40)
    got = quality.differences(*quality._joined(texts), compressors)
    for t, row in zip(texts, got):
        cuts = [t[i : i + quality.BLOCK] for i in range(0, len(t), quality.BLOCK)]
        good, bad = ([len(c.compress(x)) for x in cuts] for c in compressors)
        each = [(b - g) / (b + g) for g, b, x in zip(good, bad, cuts) if len(x) >= min(len(t), quality.BLOCK) / 2]
        assert row == pytest.approx([(sum(bad) - sum(good)) / (sum(bad) + sum(good)), min(each), max(each)] if cuts else [0, 0, 0], abs=1e-6)


def test_labelled_sample_is_bounded(spark):
    docs = frame(spark, [(i, "x" * (1000 if i % 2 else 10)) for i in range(40)] + [(1, "y" * 500)] * 50)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (5, None), (None, 1)], "doc_id long, quality int")
    rows = toxicity.labelled_sample(docs, labels, "quality", 15)
    assert 0 < len(rows) <= 30 and {y for _, _, y in rows} == {0, 1}
    small = toxicity.labelled_sample(docs, labels, "quality", 15, sample_mb=0.003)
    assert 0 < sum(len(t) for _, t, _ in small) <= 3000 and any(len(t) == 10 for _, t, _ in small)
    assert not toxicity.labelled_sample(docs, labels.limit(0), "quality", 15)


def test_quality_fit_does_not_diverge():
    rng = np.random.default_rng(8)
    x = np.concatenate([np.ones((400, 1)), rng.normal(size=(400, 3)) ** 3], axis=1)
    y = (x[:, 1] > 0).astype(float)
    w = quality._logistic(x, y)
    slope = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) + w
    assert np.abs(slope).max() < 1e-2 * len(y)


def test_toxicity_held_out(spark):
    texts = [t.lower() for t in documents().values()]
    many = [(f"{t[: len(t) // 2]} {'zgrob plonk' if i % 3 == 0 else ''} {t[len(t) // 2 :]}", int(i % 3 == 0)) for i, t in enumerate(texts * 2)]
    half = len(many) // 2
    model = toxicity.fit([t for t, _ in many[:half]], [y for _, y in many[:half]])
    raw = [t.encode() for t, _ in many[half:]]
    scores = toxicity.score_texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), model)
    assert separated([s for s, (_, y) in zip(scores, many[half:]) if y], [s for s, (_, y) in zip(scores, many[half:]) if not y]) >= 0.95
    df = toxicity.op10_toxicity(spark, DATA).cache()
    assert df.count() == 200 and all(0 <= r["score"] <= 1 for r in df.collect())


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_classifiers_hard_texts(spark, run):
    docs = frame(spark, hard())
    labels = spark.createDataFrame([(4, 1, 1), (10, 0, 0), (6, 1, 0), (7, 0, None), (None, 1, 1)] * 3, "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        got = run(docs, given).collect()
        assert len(got) == len(hard()) and all(0 <= r["score"] <= 1 for r in got)
    assert run(frame(spark, []), labels).count() == 0


def exact(vectors, k=20):
    v = [(i, np.array(x, float)) for i, x in vectors if x and None not in x and all(map(math.isfinite, x)) and any(x)]
    for q, x in {(i, tuple(x)): (i, x) for i, x in v if i % 20 == 0}.values():
        best = {}
        for i, y in v:
            if i != q and len(y) == len(x):
                best[i] = max(best.get(i, -1e300), float(x @ y))
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]):
            yield q, rank + 1, i, s


def test_neighbours_recall(spark):
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in neighbours.op9_neighbours(spark, DATA).collect()}
    want = {(q, i): s for q, _, i, s in exact(rows_of_embeddings())}
    met = set(got) & set(want)
    assert len(got) == len(want) and len(met) >= 0.9 * len(want)
    assert all(abs(got[m] - want[m]) < 1e-9 for m in met)


@pytest.mark.parametrize("clusters", [0, 30])
def test_neighbours_recall_over_shards(spark, clusters):
    """Five shards; without clusters the vectors are Gaussian, the hard case. The same vectors are found exactly if asked."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(9000, 64)).astype(np.float32)
    if clusters:
        v = (v * 0.3 + rng.normal(size=(clusters, 64))[rng.integers(0, clusters, len(v))]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    q = np.arange(0, 9000, 20)
    sims = v[q].astype(float) @ v.astype(float).T
    sims[np.arange(len(q)), q] = -np.inf
    best = np.argsort(-sims, axis=1, kind="stable")[:, :20]
    want = {(int(i), int(j)) for i, row in zip(q, best) for j in row}
    found = neighbours.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=2048).collect()
    assert len(found) == len(want) and len({(r["query_id"], r["vec_id"]) for r in found} & want) >= 0.9 * len(want)
    plain = neighbours.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=2048, exact=True).collect()
    assert {(r["query_id"], r["vec_id"]) for r in plain} == want


def test_neighbours_graph_is_reached_from_its_entry():
    rng = np.random.default_rng(8)
    index = neighbours.build(np.arange(700), rng.normal(size=(700, 8)).astype(np.float32))
    place, graph = index["levels"][0]
    assert (place >= 0).all() and graph.shape == (700, 2 * neighbours.M)
    met, front = {index["entry"]}, [index["entry"]]
    while front:
        new = {x for i in front for x in graph[place[i]].tolist() if x >= 0} - met
        met |= new
        front = list(new)
    assert len(met) > 690


def rows_of_embeddings():
    return [(r[0], r[1]) for r in rows("embeddings")]


def test_neighbours_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    v = [(i, [1.0, 2.0, 0.5]) for i in range(60)] + [(i, [float(x) for x in rng.normal(size=3)]) for i in range(60, 160)]
    v += [(160, None), (180, [0.0, 0.0, 0.0]), (200, [1.0, None, 2.0]), (220, [math.nan, 1.0, 1.0]), (240, [math.inf, 1.0, 1.0]), (260, []), (280, [1.0, 1.0]), (281, [2.0, 1.0]), (0, [1.0, 2.0, 0.5]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x")).withColumn("q", F.lit(1))
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=64)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id").collect())) == sorted((q, r, i) for q, r, i, _ in exact([x for x in v if x[0] is not None]))
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("shard_rows", [8192, 512])
def test_neighbours_repeated_rows_count_once(spark, shard_rows):
    rng = np.random.default_rng(5)
    v = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(80)]
    df = spark.createDataFrame(v * 25, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=shard_rows)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id").collect())) == sorted((q, r, i) for q, r, i, _ in exact(v))


def test_sql_matches(spark):
    from incunable.llm.entry import ORACLE_SQL, QUERIES

    for name in ("op2_decontaminate", "op3_suffix_dedup", "op5_substring"):
        matches(QUERIES[name](spark, DATA), ORACLE_SQL[name])
