from collections import Counter

import pytest
from helpers import DATA, frame, rows
from test_corpus_ops import plain_simhash, shared_texts, tokens
from test_small_ops import plain_contamination

import corpus_pipeline as cp
from incunable.llm import quality, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    item = rows("benchmark")
    given = [*shared_texts(), (801, "before " + item[0][1]), (802, item[1][1]), (803, item[2][1] + " after")]
    return frame(spark, given).select(*cp.COLUMNS).cache()


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_quality_stage(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where(~toxicity.held_out("doc_id", 4, 2))
    want = Counter()
    scored = quality.quality(docs, labels, carry=("text",))
    for r in scored.collect():
        want[(r["doc_id"], r["carry"]["text"])] += r["score"] >= 0.7
    out = cp.quality_stage(spark, docs, DATA)
    assert out.columns == list(cp.COLUMNS) and Counter(pairs(out)) == +want


def test_near_duplicate_stage(spark, docs):
    given = pairs(docs)
    order = sorted(range(len(given)), key=lambda j: (given[j][0] is None, given[j][0] or 0))
    groups = plain_simhash([(n, given[j][1]) for n, j in enumerate(order)])
    want = Counter(given[order[n]][0] for (n, _, c), _ in groups.items() if n == c)
    out = cp.near_duplicate_stage(spark, docs, DATA)
    assert out.columns == list(cp.COLUMNS) and Counter(i for i, _ in pairs(out)) == want


def plain_kept(given, length=400):
    """Each text without the characters all of whose bytes a repeated string covers."""
    texts = [(t or "").encode() for _, t in given]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for (i, text), t in zip(given, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out, at = [], 0
        for c in text or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                out.append(c)
            at += n
        yield i, "".join(out)


def test_suffix_stage(spark, docs):
    accents = [(900 + i, "é" * i + "çà" * 260 + "ü" * i) for i in range(4)]
    given = docs.unionByName(frame(spark, accents).select(*cp.COLUMNS))
    out = cp.suffix_stage(spark, given, DATA)
    got = out.collect()
    assert out.columns == list(cp.COLUMNS) and Counter((r["doc_id"], r["text"]) for r in got) == Counter(plain_kept(pairs(given)))
    assert not any("\ufffd" in r["text"] for r in got)


def test_decontaminate_stage(spark, docs):
    given = pairs(docs)
    dirty = [x[-1] for x in plain_contamination(given, rows("benchmark"))]
    out = cp.decontaminate_stage(spark, docs, DATA)
    assert out.columns == list(cp.COLUMNS) and Counter(pairs(out)) == Counter(d for d, bad in zip(given, dirty) if not bad)


def test_encode_stage(spark, docs):
    given = pairs(docs)
    want = Counter((i, len(ids), t or "") for (i, t), ids in zip(given, tokens([t or "" for _, t in given])))
    assert Counter((r["doc_id"], r["n_tokens"], r["text"]) for r in cp.encode_stage(spark, docs, DATA).collect()) == want


def test_whole_run_matches_plain_versions(spark):
    given = pairs(cp.quality_stage(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA))
    groups = plain_simhash(given)
    kept = {c for _, _, c in groups}
    given = list(plain_kept([d for d in given if d[0] in kept]))
    dirty = {x[0] for x in plain_contamination(given, rows("benchmark")) if x[-1]}
    given = [d for d in given if d[0] not in dirty]
    want = Counter((i, len(ids), t) for (i, t), ids in zip(given, tokens([t for _, t in given])))
    got = cp.run(spark, DATA).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["text"]) for r in got) == want and len(cp.STAGES) == 5
    assert {"lang", "source", "n_chars"} <= set(got[0].asDict())


def test_stages_on_an_empty_table(spark):
    empty = spark.createDataFrame([], ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in cp.COLUMNS))
    for _, stage in cp.STAGES:
        assert stage(spark, empty, DATA).count() == 0
