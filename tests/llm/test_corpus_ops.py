import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DATA, documents, frame, hard
from pyspark.sql import functions as F

from incunable.llm import bpe, common, components, lm, simhash, substring, suffix

KEY = lambda r: tuple(map(str, r))


def shared_texts():
    """Copies, near copies, shared passages and periodic texts."""
    docs = documents()
    pick = [docs[i] for i in sorted(docs)[:60]]
    out = [(i, t) for i, t in enumerate(pick)]
    out += [(100 + i, pick[i]) for i in range(5)] + [(200 + i, pick[i][:300] + "X" + pick[i][301:]) for i in range(20)]
    out += [(300 + i, f"start {i} " + pick[3][100:900] + f" mid {i} " + pick[4][50:1200]) for i in range(8)]
    out += [(400, "To " * 700), (401, "a" * 1500), (402, "a" * 400), (403, "ab" * 300 + "ba" * 300), (404, pick[0] + pick[0])]
    return out + hard()


def plain_bytes(docs, length):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for (i, _), t in zip(docs, texts):
        gone = bytearray(len(t) + 1)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        gone = gone[: len(t)]
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        yield i, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()


@pytest.mark.parametrize(("length", "most_rows"), [(400, 1 << 22), (170, 1 << 22), (400, 0)])
def test_suffix_matches_plain(spark, length, most_rows):
    docs = shared_texts()
    got = suffix.dedup_bytes(frame(spark, docs), length, chunk_bytes=20_000, bytes_per_shard=50_000 if most_rows else 8_000, most_rows=most_rows)
    rows = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, rows), key=KEY) == sorted(plain_bytes(docs, length), key=KEY)
    assert suffix.dedup_bytes(frame(spark, []), length).count() == 0


def test_repeated_windows_matches_plain():
    rng = np.random.default_rng(5)
    for alphabet in (2, 200):
        parts = [rng.integers(0, alphabet, 90).astype(np.uint8) for _ in range(20)]
        parts += [p.copy() for p in parts[:6]] + [np.zeros(90, np.uint8)]
        parts[20][80] ^= 1
        text = np.concatenate(parts)
        starts, counts = np.arange(len(parts)) * 90, np.full(len(parts), 90 - 41)
        got = suffix.repeated_windows(text, starts, counts, length=42, depth=12, sub_shard=100)
        every = [text[s + i : s + i + 42].tobytes() for s, n in zip(starts, counts) for i in range(n)]
        seen = Counter(every)
        assert got.tolist() == [seen[w] > 1 for w in every]


def plain_windows(docs, k):
    order = sorted(range(len(docs)), key=lambda j: (docs[j][0] is None, docs[j][0] or 0, j))
    seen, out = set(), {}
    for j in order:
        w = (docs[j][1] or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            x = tuple(w[a : a + k])
            if x in seen:
                gone[a : a + k] = [True] * k
            seen.add(x)
        out[j] = (docs[j][0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return list(out.values())


@pytest.mark.parametrize(("chunk", "most_rows"), [(10_000, 1 << 22), (None, 1 << 22), (10_000, 0)])
def test_substring_matches_plain(spark, chunk, most_rows):
    docs = shared_texts()
    unique = [d for n, d in enumerate(docs) if d[0] is None or d[0] not in {x[0] for x in docs[:n]}]
    got = substring.dedup_windows(frame(spark, unique).coalesce(1), chunk_bytes=chunk, per_shard=20_000 if most_rows else 4_000, cell_bits=18, most_rows=most_rows)
    rows = got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, rows), key=KEY) == sorted(plain_windows(unique, 20), key=KEY)
    assert substring.dedup_windows(frame(spark, [])).count() == 0


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


def test_substring_tells_thue_morse_words_apart(spark):
    rest = " ".join(f"w{i}" for i in range(19))
    docs = [(1, f"{thue_morse(1024, 'a', 'b')} {rest}"), (2, f"{thue_morse(1024, 'b', 'a')} {rest}")]
    # sequences of words of the same kind, over windows that are longer than such a sequence
    one, two = thue_morse(16, "x ", "y "), thue_morse(16, "y ", "x ")
    docs += [(3, one + "a b c d"), (4, two + "a b c d"), (5, one + "a b c d")]
    got = {r["doc_id"]: r["n_removed"] for r in substring.dedup_windows(frame(spark, docs)).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 20}


def test_suffix_tells_thue_morse_bytes_apart(spark):
    docs = [(i, "z" * 300 + thue_morse(n, *ab) + "z" * 300) for i, (n, ab) in enumerate([(512, "ab"), (512, "ba"), (1024, "ab"), (1024, "ba")])]
    got = suffix.dedup_bytes(frame(spark, docs))
    rows = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, rows), key=KEY) == sorted(plain_bytes(docs, 400), key=KEY)


def test_suffix_removes_planted_passages_from_400_bytes_on(spark):
    """Passages of over 50 words, shorter and longer than the contract's 400 bytes, each in ten of two hundred documents."""
    rng = np.random.default_rng(11)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    text = lambda n: " ".join(word(int(k)) for k in rng.integers(2, 9, n))
    fit = lambda n: (text(n) + " " + word(n))[:n]
    passages = [fit(399), fit(400), " ".join(word(5) for _ in range(55)), " ".join(word(6) for _ in range(90))]
    assert all(len(p.split()) > 50 for p in passages) and [len(p) for p in passages] == [399, 400, 329, 629]
    docs, planted = [], {}
    for i in range(200):
        body = [f"{i} {text(60)} ", f" {text(80)} {i}"]
        if i % 20 < 8:
            planted[i] = passages[i % 4]
            mark = chr(65 + i // 20 * 2 + i % 20 // 4)  # another in each document that has the passage
            body.insert(1, mark + passages[i % 4] + mark)
        docs.append((i, "".join(body)))
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix.dedup_bytes(frame(spark, docs), chunk_bytes=30_000).collect()}
    for i, _ in docs:
        size = len(planted.get(i, ""))
        assert got[i] == ((size, 1) if size >= 400 else (0, 0))


def test_word_hashes_follow_the_words():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in [*range(1, 40), 8, 8, 9, 1023, 1024, 1025, 3000] for _ in range(6)]
    words += words[::3] + [b"a\0", b"a", b"a\0\0"]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    one, two = common.word_hashes(raw, starts, ends, at_once=100), common.word_hashes(raw, starts, ends, 1)
    for h in (one, two):
        assert len({*zip(words, h.tolist())}) == len({*words}) == len({*h.tolist()})
    assert not {*one.tolist()} & {*two.tolist()}
    for k in (1, 2, 5, 10, 19, 20):
        grams = common.gram_hashes(one, k)
        windows = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        assert len(grams) == len(windows) and len({*zip(windows, grams.tolist())}) == len({*windows}) == len({*grams.tolist()})


def tokens(texts):
    import tiktoken

    path, pattern = bpe.defaults()
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return [coder.encode_ordinary(t) for t in texts]


def test_bpe_matches_library_and_round_trips(spark):
    odd = ["a  b", "a   b  ", " x", "x\n y", "x \ny", "it's  they'll  'S", "1234 5678９", "　 a b  c", "x\x1c y \x1f", "\x00\x01", "é" * 300, "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3000)), "日本語 テキスト。", "<|endoftext|>"]
    docs = [*documents().items(), *hard(), *((500 + i, t) for i, t in enumerate(odd))]
    got = bpe.bpe(frame(spark, docs).coalesce(2)).collect()
    want = Counter((i, np.array(ids, np.uint32).tobytes(), (t or "").encode()) for (i, t), ids in zip(docs, tokens([t or "" for _, t in docs])))
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want
    back = bpe.decode(spark.createDataFrame([(r["doc_id"], r["ids"]) for r in got] + [(-1, None)], "doc_id long, ids binary")).collect()
    assert Counter(bytes(r["decoded"]) for r in back) == Counter([*(x[2] for x in want.elements()), b""])
    assert bpe.bpe(frame(spark, [])).count() == 0


def test_lm_baseline_and_probability(spark):
    docs = [*documents().items(), *hard()]
    got = lm.lm_scores(frame(spark, docs)).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    cut = lambda t: (t or "").encode().lower().split() + [None]
    count = Counter(w for i, t in docs if not held(i) for w in cut(t))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in docs:
        w = cut(t)
        want[(i, held(i), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 4))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)} & {r["score"] for r in got if r["doc_id"] is None}) == 1
    own = [r for r in got if r["held_out"] and r["doc_id"] is not None]
    assert own and sum(r["score"] for r in own) > 1.2 * sum(r["base_score"] for r in own)
    assert lm.lm_scores(frame(spark, [])).count() == 0


def test_lm_beats_the_base_on_held_out_texts(spark):
    got = lm.op1_lm_score(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert got["score"] > got["base"]


def test_lm_beats_the_base_where_all_words_are_known(spark):
    """The base gives every unseen word the same one share, the model spells it: on little text only known words compare."""
    known = lm.op1_lm_score(spark, "/root/testdata/sf0.01").where("held_out and n_known = n_tokens and n_tokens > 1")
    got = known.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.count("*").alias("n")).first()
    assert got["n"] >= 5 and got["score"] > got["base"]


def test_lm_word_counts_in_two_hops(spark):
    docs = frame(spark, [*documents().items(), *hard()]).repartition(9).cache()
    one, two = (lm.Corpus(docs, chunk_bytes=30_000, per_shard=2_000, most_rows=n) for n in (1 << 22, 0))
    assert one.n_chunks > 6 and [c.counted()[1:] for c in (one, two)] == [one.counted()[1:]] * 2
    m = lm.untrained(np.bincount([5, 6], minlength=one.vocab), np.array([6]), np.array([1]))
    rows = [sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_known"], round(r["base_score"], 6)) for r in c.scores(m).collect()) for c in (one, two)]
    assert rows[0] == rows[1]


COMMON, RARE = "the cat sat on the mat and the dog ran off", "zebra quartz violin jigsaw oxygen puzzle"


def per_id(got, doc_id):
    return next(r["score"] / r["n_ids"] for r in got if r["doc_id"] == doc_id)


def test_lm_learns_from_every_training_text(spark):
    ids = spark.range(2800).where("crc32(cast(cast(id AS string) AS binary)) % 7 != 2").orderBy(F.xxhash64("id"), "id")
    late = {r["id"] for r in ids.collect()[2000:]}  # beyond the first 2,000 by hash
    assert len(late) > 300
    docs = [(i, RARE if i in late else COMMON) for i in range(2800)]
    got = lm.lm_scores(frame(spark, [*docs, (None, RARE)])).collect()
    assert per_id(got, None) > -0.4


def test_lm_learns_from_texts_behind_a_very_long_one(spark):
    order = sorted((i for i in range(300) if zlib.crc32(str(i).encode()) % 7 != 2), key=lambda i: zlib.crc32(str(i).encode()))
    docs = [(i, COMMON * 110_000 if i == order[0] else RARE) for i in range(300)]
    got = lm.lm_scores(frame(spark, [*docs, (None, RARE)])).collect()
    assert per_id(got, None) > -1.5


def test_lm_every_text_gives_a_window_and_at_every_1_each_id_is_in_one():
    rng = np.random.default_rng(4)
    lengths = np.array([1, 5, 32, 33, 64, 700, 31])
    first = np.concatenate([[0], np.cumsum(lengths)])
    ids = rng.integers(0, 50, first[-1]).astype(np.int32)
    rows, real = lm.windows_of(ids, first, np.zeros(7, np.int64), 1, 99)
    assert real.sum() == len(ids)
    assert np.concatenate([r[1 : 1 + n] for r, n in zip(rows, real)]).tolist() == ids.tolist()
    assert [r[0] for r in rows] == [99 if p in first else ids[p - 1] for p in np.concatenate([np.arange(a, b, 32) for a, b in zip(first, first[1:])])]
    for every in (2, 8):
        rows, real = lm.windows_of(ids, first, rng.integers(0, 1000, 7), every, 99)
        n = -(-lengths // 32)
        assert (n / every - 1 < len(rows)).all() and len(rows) >= 7
    assert len(lm.windows_of(ids[:0], np.zeros(1, np.int64), np.zeros(0, np.int64), 8, 99)[0]) == 0


def test_lm_attention_trains_on_every_id_of_every_training_text(spark):
    """What the windows of all chunks predict, and after which id, are the pairs that were counted over all training texts."""
    docs = [*documents().items(), *hard()]
    corpus = lm.Corpus(frame(spark, docs), chunk_bytes=100_000)
    m = lm.untrained(np.bincount([5, 6], minlength=corpus.vocab), np.array([6]), np.array([1]))
    n_ids = [r["n_ids"] for r in corpus.scores(m).collect() if not r["held_out"]]
    assert corpus.n_chunks > 1 and corpus.windows == sum(-(-n // lm.SPAN) for n in n_ids)
    counted, trained = Counter(), Counter()
    for row in corpus.chunks.select("ids", "pairs").collect():
        keys, times = map(lm.unsqueeze, lm.pickle.loads(row["pairs"]))
        counted.update(dict(zip(np.cumsum(keys).tolist(), times.tolist())))
        rows, real = lm.training_windows(bytes(row["ids"]), corpus.vocab - 1)
        live = np.arange(lm.SPAN) < real[:, None]
        trained.update((rows[:, :-1].astype(np.int64) * corpus.vocab + rows[:, 1:])[live].tolist())
    assert sum(counted.values()) == sum(n_ids) and trained == counted


def test_lm_pair_counts():
    rng = np.random.default_rng(6)
    ids = rng.integers(0, 20, 500).astype(np.int32)
    first = np.array([0, 100, 101, 500])
    want = Counter((99 if i in (0, 100, 101) else int(ids[i - 1]), int(x)) for i, x in enumerate(ids))
    keys, times = lm.pair_counts(ids, first, 99)
    assert {(k // 100, k % 100): n for k, n in zip(keys.tolist(), times.tolist())} == want
    wide = np.arange(9000, dtype=np.int32)
    assert len(lm.pair_counts(wide, np.array([0, 9000]), 9999)[0]) == 9000


def small_model():
    rng = np.random.default_rng(2)
    ids = np.concatenate([np.append(rng.integers(0, 20, n), 30) for n in (70, 1, 0, 33, 400)]).astype(np.int32)
    first = np.array([0, 71, 73, 74, 108, 509])
    return lm.train(ids, first, 31, classes=8, every=1), ids, first


def plain_score(m, ids):
    """log10 probability of one text by loops in double precision, window by window as the module's head says."""
    f = {k: np.asarray(v, float) for k, v in m.items()}
    d, vocab = f["embed"].shape[1], len(m["class"])
    kept = dict(zip(m["keys"].tolist(), f["kept"]))
    before = [vocab - 1, *ids[:-1]]
    q, k, v, s = (f["embed"] @ f["w"][:, i * d : (i + 1) * d] for i in range(4))
    total = 0.0
    for t, x in enumerate(ids):
        start = max(0, t - t % lm.STRIDE - lm.STRIDE)
        at = range(start, t + 1)
        a = np.array([math.exp(q[before[t]] @ k[before[j]] + f["rel"][t - j]) for j in at])
        h = sum(w * v[before[j]] for w, j in zip(a / a.sum(), at)) + s[before[t]]
        add = h / (1 + np.abs(h)) @ f["wo"] + f["bo"]
        after = f["class_after"][before[t]]
        p_class = np.exp(add + after) / np.exp(add + after).sum()
        c = int(m["class"][x])
        p_pair = kept.get(before[t] * vocab + x, f["alone"][x] - f["less"][before[t]])
        total += math.log10(p_class[c]) + (p_pair - after[c]) / math.log(10)
    return total


def test_lm_score_matches_plain():
    m, ids, first = small_model()
    rng = np.random.default_rng(9)
    ids = np.concatenate([ids, rng.integers(0, 31, 60)]).astype(np.int32)
    first = np.append(first, len(ids))
    got = lm.Scorer(m).score(ids, first, at_once=3)
    want = [plain_score(m, ids[a:b].tolist()) for a, b in zip(first, first[1:])]
    assert np.abs(got - want).max() < 1e-2 and np.abs(got / want - 1).max() < 1e-4
    # few kept pairs: the others go by the id alone
    counts = np.bincount(ids, minlength=31)
    keys, times = lm.pair_counts(ids, first, 30)
    top = np.argsort(-times, kind="stable")[:10]
    few = lm.untrained(counts, keys[top], times[top], classes=8)
    want = [plain_score(few, ids[a:b].tolist()) for a, b in zip(first, first[1:])]
    assert np.abs(lm.Scorer(few).score(ids, first) / want - 1).max() < 1e-4


def test_lm_sums_to_one():
    m, _, _ = small_model()
    scorer, rng = lm.Scorer(m), np.random.default_rng(3)
    for prefix in ([], [3], list(rng.integers(0, 20, 16)), list(rng.integers(0, 20, 37))):
        n = len(prefix)
        ids = np.concatenate([[*prefix, i] for i in range(31)]).astype(np.int32)
        each = scorer.score(ids, np.arange(32) * (n + 1))
        base = scorer.score(np.array(prefix, np.int32), np.array([0, n]))[0] if n else 0.0
        assert abs((10 ** (each - base)).sum() - 1) < 1e-3


def test_lm_classes_all_have_ids_that_occur():
    ids = np.append(np.arange(60).repeat(3), 99).astype(np.int32)
    m = lm.train(ids, np.array([0, len(ids)]), 100, classes=12)
    assert set(m["class"]) == set(m["class"][ids])


def test_lm_scores_are_the_models(spark):
    """The query's rows are what its model gives each text's words and end."""
    docs = [*documents().items(), *hard()]
    corpus = lm.Corpus(frame(spark, docs))
    m = corpus.model()
    got = Counter((r["doc_id"], r["n_ids"], round(r["score"], 2)) for r in corpus.scores(m).collect())
    path, pattern = bpe.defaults()
    with open(path, "rb") as f:
        coder = lm.Ids(f.read(), pattern).coder
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    white = " \t\n\x0b\x0c\r"
    texts = [re.split(f"[{white}]+", (t or "").translate(low).strip(white)) for _, t in docs]
    ids = [np.array([x for w in words if w for x in coder.encode_ordinary(" " + w)] + [corpus.vocab - 1], np.int32) for words in texts]
    scorer = lm.Scorer(m)
    want = Counter((i, len(x), round(float(scorer.score(x, np.array([0, len(x)]))[0]), 2)) for (i, _), x in zip(docs, ids))
    near = lambda c: sorted(c.elements(), key=str)
    for a, b in zip(near(got), near(want)):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) <= 0.011 + 1e-6 * abs(a[2])


def plain_simhash(docs):
    import xxhash

    fp = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[j : j + 4]) for j in range(max(1, len(w) - 3))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fp.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)))
    root = {x: x for x in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in root:
        for y in root:
            if (x ^ y).bit_count() <= 4:
                root[find(x)] = find(y)
    least = {}
    for (i, _), x in zip(docs, fp):
        least[find(x)] = min(least.get(find(x), math.inf), math.inf if i is None else i)
    return Counter((i, x, None if least[find(x)] == math.inf else least[find(x)]) for (i, _), x in zip(docs, fp))


def test_simhash_matches_plain(spark):
    docs = [*documents().items(), *hard(), *((900 + i, "a b c d e f" + " x" * i) for i in range(12))]
    got = simhash.near_duplicates(frame(spark, docs)).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == plain_simhash(docs)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("crowd", [4096, 2])
def test_links_join_what_is_near(spark, crowd):
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(40)} | {int(x) for x in rng.integers(0, 1 << 62, 20)})
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in [*fps, fps[0], None]], "fp long"), crowd=crowd).collect()
    assert all(e["a"] < e["b"] for e in edges)

    def parts(pairs):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(y for y in fps if find(y) == find(x)) for x in fps}

    near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]
    assert parts([(e["a"], e["b"]) for e in edges]) == parts(near)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3), (900, 600), (900, 601)]
    got = components.components(spark.createDataFrame(chain, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {**{i: 0 for i in range(1, 201)}, 501: 500, 900: 600, 601: 600}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
