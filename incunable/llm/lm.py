"""Language-model scoring: a causal self-attention model trained in numpy on subword ids.

A text is its sequence of words (runs of bytes other than white space, A-Z lower-cased) and an end. A word's ids are those
that a public byte-level tokenizer gives it behind a space; the end has an id of its own. With prev the id before:

    P(id | all before) = P(class | all before) * P(id | class, prev)
    P(class | all before) = softmax over classes of (log P(class | prev) + attention(ids before))

so that the attention learns what the ids further back add to the last one. P(id | prev) is counted over every id of
every training text: pairs of ids, the `pairs` most frequent of them exactly, the others by the id alone. Classes and
embeddings come from the same counts (principal components and weighted k-means). One head of attention with relative
position biases, a skip connection and a softsign layer is trained by Adam on windows of 2 * STRIDE ids: those of all
training texts, so that every id of every one is predicted. In each of ROUNDS rounds the tasks go on from the same
parameters over their share of the windows, and what they changed is averaged as whole numbers, so that no order of
adding matters. Scoring cuts each text into windows of 2 * STRIDE ids that overlap by half and scores the ids of each
window's second half (all in the first), so every id is scored once, with batched, masked attention.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Kept, defaults, expand, read_ranks, resolve
from .chunks import ROWS, Answers, by_shard, grow, heard, pack, round_of, shard_bits, shrink, squeeze, squeeze_sorted, told, unpack, unsqueeze, unsqueeze_sorted
from .common import LOWER, SPACES, documents, lean, materialize, mix, spans

STRIDE, WIDTH, CLASSES, KAPPA, PAIRS, TOP = 16, 16, 32, 8.0, 1 << 20, 400
STEPS, BATCH, RATE, ROUNDS, UNIT, PER_SHARD = 1500, 128, 4e-3, 4, 1 << 20, 1 << 19
MOD, HELD, WORDS, CHUNK = 7, 2, 1 << 19, 4 << 20
SPAN = 2 * STRIDE


class Ids:
    """Words to ids, with a bounded store of the words met."""

    def __init__(self, data: bytes, pattern: str):
        import tiktoken

        ranks = read_ranks(data)
        self.end, self.kept = len(ranks), Kept(WORDS)
        self.coder = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(len(ranks), bool)
        self.opens[[r for t, r in ranks.items() if t[:1] == b" "]] = True

    def learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words, one after another, and how many each has."""
        data = raw.tobytes()
        words = [data[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        plain = np.array([not w[0].isspace() and not w[-1].isspace() for w in words], bool)
        many, ids, owner = np.flatnonzero(plain), [], []
        for i in range(0, len(many), 20_000):  # one call for many: only the first id of each begins with a space
            part = many[i : i + 20_000]
            got = np.array(self.coder.encode_ordinary(" " + " ".join([words[j] for j in part.tolist()])), np.int32)
            ids.append(got)
            owner.append(part[np.cumsum(self.opens[got]) - 1])
        for j in np.flatnonzero(~plain).tolist():
            got = np.array(self.coder.encode_ordinary(" " + words[j]), np.int32)
            ids.append(got)
            owner.append(np.full(len(got), j))
        owner, ids = np.concatenate(owner), np.concatenate(ids)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def of(self, raw: np.ndarray, offsets: np.ndarray):
        """(ids, each text's first, hashes of distinct words, each word's place among them, each text's first word)."""
        raw = LOWER[raw]
        starts, ends, first = spans(raw, offsets, SPACES)
        ids, sizes, hashes, code = resolve(self.kept, raw, starts, ends, lambda a, b: self.learn(raw, a, b))
        begin = np.concatenate([[0], np.cumsum(sizes)])[first]
        lengths = np.diff(begin)
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        mine = np.ones(len(ids) + len(lengths), bool)
        mine[begins[1:] - 1] = False
        out = np.full(len(mine), self.end, np.int32)
        out[mine] = ids
        return out, begins, hashes, code, first


_IDS: dict[int, Ids] = {}


def _ids(data: bytes, pattern: str) -> Ids:
    key = hash((data, pattern))
    if key not in _IDS:
        _IDS.clear()
        _IDS[key] = Ids(data, pattern)
    return _IDS[key]


def _kind(vocab: int):
    return np.uint16 if vocab <= 1 << 16 else np.uint32


def prevs(ids: np.ndarray, first: np.ndarray, end_id: int) -> np.ndarray:
    """The id before each, the end id where a text begins."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[first[:-1]] = end_id
    return out


def pair_counts(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (id before) * vocabulary + id, and how often each occurs."""
    got = pa.array(prevs(ids, first, end_id).astype(np.int64) * (end_id + 1) + ids).value_counts()
    keys, times = got.field(0).to_numpy(), got.field(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], times[order]


def windows_of(ids: np.ndarray, first: np.ndarray, phases: np.ndarray, every: int, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """One of `every` windows of SPAN ids from each text, one at least: rows of the id before and the ids, and how many are real. At 1, all."""
    n = -(-np.diff(first) // SPAN)
    phase = phases % np.minimum(every, np.maximum(n, 1))
    count = np.where(n > 0, (n - phase + every - 1) // every, 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = first[:-1][text] + (phase[text] + k * every) * SPAN
    padded = np.concatenate([ids[:1], ids, np.zeros(SPAN, ids.dtype)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, SPAN + 1)[at] if len(at) else np.zeros((0, SPAN + 1), ids.dtype)
    rows[at == first[:-1][text], 0] = end_id
    return rows, np.minimum(first[1:][text] - at, SPAN)


def training_windows(blob: bytes, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the training texts of a chunk's ids."""
    ids, lengths, trains = pickle.loads(blob)
    ids, lengths = unsqueeze(ids), unsqueeze(lengths)
    own = np.append(0, np.cumsum(lengths[trains]))
    return windows_of(ids[np.repeat(trains, lengths)], own, np.zeros(len(own) - 1, np.int64), 1, end_id)


_REL = np.arange(SPAN)[:, None] - np.arange(SPAN)[None, :]
_SCORED = _REL[STRIDE:]


def _classes(counts: np.ndarray, prev: np.ndarray, ids: np.ndarray, times: np.ndarray, classes: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id's class and embedding, from the counts of all ids and of pairs. Every class but the end's has an id that occurs."""
    vocab, seen = len(counts), np.flatnonzero(counts)
    embed = np.zeros((vocab, width), np.float32)
    if len(seen) <= 2:
        return np.zeros(vocab, np.int64), embed
    top = seen[np.argsort(-counts[seen], kind="stable")][:TOP]
    col, row = np.full(vocab, -1), np.full(vocab, -1)
    col[top], row[seen] = np.arange(len(top)), np.arange(len(seen))
    # which frequent ids follow and precede each id
    a, b = col[ids] >= 0, (col[prev] >= 0) & (row[ids] >= 0)
    a &= row[prev] >= 0
    r = np.concatenate([row[prev[a]], row[ids[b]]])
    c = np.concatenate([col[ids[a]], TOP + col[prev[b]]])
    n = np.concatenate([times[a], times[b]]).astype(float)
    value = np.sqrt(n / (np.bincount(r, n, len(seen)) + 5)[r]).astype(np.float32)
    weight = counts[seen].astype(np.float32)
    mean = (np.bincount(c, value * weight[r], 2 * TOP) / counts.sum()).astype(np.float32)
    order = np.argsort(r, kind="stable")
    r, c, value = r[order], c[order], value[order]

    def dense(at: int) -> np.ndarray:
        edge = np.searchsorted(r, [at, at + 4096])
        x = np.zeros((min(4096, len(seen) - at), 2 * TOP), np.float32)
        np.add.at(x, (r[edge[0] : edge[1]] - at, c[edge[0] : edge[1]]), value[edge[0] : edge[1]])
        return x - mean

    blocks = range(0, len(seen), 4096)
    spread = np.zeros((2 * TOP, 2 * TOP))
    for at in blocks:
        x = dense(at)
        spread += (x * np.minimum(weight[at : at + 4096], 1000)[:, None]).T @ x
    vec = np.linalg.eigh(spread)[1][:, ::-1][:, : max(width, 24)].astype(np.float32)
    y = np.concatenate([dense(at) @ vec for at in blocks])
    embed[seen] = y[:, :width] / (y[:, :width].std(axis=0) + 1e-6) * 0.5
    # weighted k-means; the end id keeps a class of its own, ids that no text has go to the heaviest class
    k = max(1, min(classes - 1, len(seen) - 1))
    centre = y[np.argsort(-weight, kind="stable")[:k]].copy()
    for _ in range(12):
        near = (y @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1)
        total = np.bincount(near, weight, k)
        for d in range(y.shape[1]):
            centre[:, d] = np.where(total > 0, np.bincount(near, weight * y[:, d], k) / np.maximum(total, 1e-9), centre[:, d])
    heavy = np.bincount(near[seen != vocab - 1], weight[seen != vocab - 1], k).argmax()
    klass = np.full(vocab, heavy)
    klass[seen] = near
    klass[vocab - 1] = k
    return np.unique(klass, return_inverse=True)[1].astype(np.int64), embed


def untrained(counts: np.ndarray, keys: np.ndarray, times: np.ndarray, classes: int = CLASSES, width: int = WIDTH) -> dict:
    """The model before its attention is trained: from counts of ids and of the pairs (id before) * vocabulary + id that are kept."""
    vocab = len(counts)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order].astype(np.int64), times[order].astype(float)
    prev, ids = keys // vocab, keys % vocab
    klass, embed = _classes(counts, prev, ids, times, classes, width)
    c = int(klass.max()) + 1
    single = (counts + 0.01) / (counts.sum() + 0.01 * vocab)
    follow = np.bincount(prev, times, vocab).astype(float)
    by_class = np.bincount(prev * c + klass[ids], times, vocab * c).reshape(vocab, c).astype(float)
    by_class += KAPPA * np.bincount(klass, single, c)
    by_class /= (follow + KAPPA)[:, None]
    m = {"class": klass, "embed": embed, "keys": keys, "class_after": np.log(by_class).astype(np.float32)}
    m["kept"] = np.log((times + KAPPA * single[ids]) / (follow[prev] + KAPPA)).astype(np.float32)
    m["alone"], m["less"] = np.log(KAPPA * single).astype(np.float32), np.log(follow + KAPPA).astype(np.float32)
    rng = np.random.Generator(np.random.PCG64(11))
    glorot = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    m["w"] = np.concatenate([glorot(width, width) * 0.5, glorot(width, width) * 0.5, glorot(width, width), glorot(width, width)], axis=1)
    m["wo"], m["bo"], m["rel"] = glorot(width, c) * 0.1, np.zeros(c, np.float32), (-0.05 * np.arange(SPAN)).astype(np.float32)
    return m


LEARNT = ("w", "wo", "bo", "rel")


def _product(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """x.T @ y over all places of windows, four windows at a time: tall products of a few columns are slow in one piece."""
    by = 4 if size % 4 == 0 else 1
    return np.matmul(x.reshape(size // by, by * SPAN, -1).transpose(0, 2, 1), y.reshape(size // by, by * SPAN, -1)).sum(axis=0)


def learn(m: dict, rows: np.ndarray, real: np.ndarray, rates: tuple = (RATE, RATE / 10), batch: int = BATCH) -> None:
    """Train the attention in place on windows, in the order given, at rates that fall from the first to the second."""
    d, klass, c = m["embed"].shape[1], m["class"], m["wo"].shape[1]
    one, two = np.zeros((2, sum(m[n].size for n in LEARNT)), np.float32)
    steps, size = -(-len(rows) // batch), 0
    causal, apart, ones = _REL >= 0, np.maximum(_REL, 0), np.ones(c, np.float32)
    for step in range(1, steps + 1):
        part = rows[(step - 1) * batch : step * batch].astype(np.int64)
        if len(part) != size:  # the same memory for every batch, as in Scorer; a last column of ones gives sums and biases
            size = len(part)
            new = lambda *shape: np.ones((size, SPAN, *shape), np.float32)
            e, every, back, v, dz, a, da, mixed, h, bend, p, after, dh = (new(x) for x in (d, 4 * d, 4 * d, d + 1, d + 1, SPAN, SPAN, d + 1, d + 1, d, c, c, d))
            q, k, skip = every[:, :, :d], every[:, :, d : 2 * d], every[:, :, 3 * d :]
            flat, p = h.reshape(-1, d + 1), p.reshape(-1, c)
        live = (np.arange(SPAN) < real[(step - 1) * batch : step * batch, None]).ravel().astype(np.float32)
        live /= max(1, live.sum())
        x, y = part[:, :-1], part[:, 1:].ravel()
        np.take(m["embed"], x, axis=0, out=e, mode="clip")
        np.matmul(e.reshape(-1, d), m["w"], out=every.reshape(-1, 4 * d))
        v[:, :, :d] = every[:, :, 2 * d : 3 * d]
        np.matmul(q, k.transpose(0, 2, 1), out=a)
        a += np.where(causal, m["rel"][apart], -1e9).astype(np.float32)
        if a.max() > 60 or a.reshape(size, -1)[:, :: SPAN + 1].min() < -60:  # else no exponential overflows and no sum vanishes
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        np.matmul(a, v, out=mixed)
        total = mixed[:, :, d:]
        mixed[:, :, :d] /= total
        np.add(mixed[:, :, :d], skip, out=h[:, :, :d])
        np.abs(h[:, :, :d], out=bend)
        bend += 1
        h[:, :, :d] /= bend
        np.matmul(flat, np.concatenate([m["wo"], m["bo"][None]]), out=p)
        np.take(m["class_after"], x, axis=0, out=after, mode="clip")
        p += after.reshape(-1, c)
        if np.abs(m["wo"]).sum(axis=0).max() + np.abs(m["bo"]).max() > 60:
            p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p *= (live / (p @ ones))[:, None]
        p.ravel()[np.arange(0, p.size, c) + klass[y]] -= live
        out = _product(flat, p, size)
        np.matmul(p, m["wo"].T, out=dh.reshape(-1, d))
        bend *= bend
        dh /= bend
        # of the weights a / total: a * (dz . v - dz . mixed), dz over total already
        np.divide(dh, total, out=dz[:, :, :d])
        np.einsum("ijk,ijk->ij", dz[:, :, :d], mixed[:, :, :d], out=dz[:, :, d])
        np.negative(dz[:, :, d], out=dz[:, :, d])
        np.matmul(dz, v.transpose(0, 2, 1), out=da)
        da *= a
        rel = np.bincount(apart.ravel(), (da.sum(axis=0) * causal).ravel(), SPAN)
        np.matmul(da, k, out=back[:, :, :d])
        np.matmul(da.transpose(0, 2, 1), q, out=back[:, :, d : 2 * d])
        np.matmul(a.transpose(0, 2, 1), dz[:, :, :d], out=back[:, :, 2 * d : 3 * d])
        back[:, :, 3 * d :] = dh
        grad = np.concatenate([_product(e, back, size).ravel(), out.ravel(), rel], dtype=np.float32)  # in the order of LEARNT
        rate = rates[0] + (rates[1] - rates[0]) * step / steps
        one *= 0.9
        one += 0.1 * grad
        two *= 0.99
        grad *= grad
        two += 0.01 * grad
        move, at = rate / (1 - 0.9**step) * one / (np.sqrt(two / (1 - 0.99**step)) + 1e-8), 0
        for n in LEARNT:
            m[n] -= move[at : at + m[n].size].reshape(m[n].shape)
            at += m[n].size


def epochs_for(windows: int) -> int:
    """All windows are met once; those of a small corpus up to twelve times."""
    return max(1, min(12, round(STEPS * BATCH / max(1, windows))))


def change(m: dict, rows: np.ndarray, real: np.ndarray, epochs: int, round_: int, rounds: int, seed: int) -> np.ndarray:
    """What training on one round's share of these windows changes, times the number of windows, in units of 1 / UNIT; that number follows."""
    order = np.concatenate([np.random.Generator(np.random.PCG64([11, seed, i])).permutation(len(rows)) for i in range(epochs)])[round_::rounds]
    new = m | {n: m[n].copy() for n in LEARNT}
    fall = lambda r: RATE * (1 - 0.9 * r / rounds)
    learn(new, rows[order], real[order], (fall(round_), fall(round_ + 1)))
    moved = np.concatenate([(new[n] - m[n]).ravel() for n in LEARNT]).astype(float) * len(order)
    return np.append(np.rint(moved * UNIT).astype(np.int64), len(order))


def changed(m: dict, total: np.ndarray) -> dict:
    """The model after a round, from the sum of change() over all tasks."""
    out, at, windows = dict(m), 0, max(1, int(total[-1]))
    for n in LEARNT:
        out[n] = (m[n] + total[at : at + m[n].size].reshape(m[n].shape) / UNIT / windows).astype(np.float32)
        at += m[n].size
    return out


def train(ids: np.ndarray, first: np.ndarray, vocab: int, classes: int = CLASSES, width: int = WIDTH, every: int = 1) -> dict:
    """The model of texts in memory, in one task; no ids give an untrained one."""
    m = untrained(np.bincount(ids, minlength=vocab), *pair_counts(ids, first, vocab - 1), classes, width)
    rows, real = windows_of(ids, first, np.zeros(len(first) - 1, np.int64), every, vocab - 1)
    return changed(m, change(m, rows, real, epochs_for(len(rows)), 0, 1, 0)) if len(rows) else m


class Scorer:
    """What scoring looks up: each id's query, key, value (with a one, whose sum normalises) and skip, and the kept pairs."""

    def __init__(self, m: dict):
        d = m["embed"].shape[1]
        by = m["embed"] @ m["w"]
        one = np.ones((len(by), 1), np.float32)
        self.m, self.query, self.key = m, np.ascontiguousarray(by[:, :d]), np.ascontiguousarray(by[:, d : 2 * d])
        self.value, self.skip = np.concatenate([by[:, 2 * d : 3 * d], one], axis=1), np.ascontiguousarray(by[:, 3 * d :])
        self.rel = np.where(_SCORED >= 0, m["rel"][np.maximum(_SCORED, 0)], -60).astype(np.float32)
        reach = np.sqrt((self.query**2).sum(axis=1).max() * (self.key**2).sum(axis=1).max()) + np.abs(m["rel"]).max()
        logit = np.abs(m["wo"]).sum(axis=0).max() + np.abs(m["bo"]).max()
        self.wild = bool(reach > 25), bool(logit > 60)
        # an open table of the kept pairs, at most half full
        self.mask = (1 << max(4, int(2 * len(m["keys"])).bit_length())) - 1
        self.slot, self.at = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        left, place = np.arange(len(m["keys"])), self._place(m["keys"])
        while len(left):
            free = self.slot[place] < 0
            self.slot[place[free]] = m["keys"][left[free]]
            mine = self.slot[place] == m["keys"][left]
            self.at[place[mine]] = left[mine]
            left, place = left[~mine], (place[~mine] + 1) & self.mask
        self.room: dict = {}

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def pairs(self, prev: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of P(id | id before)."""
        m, keys = self.m, prev.astype(np.int64) * len(self.m["class"]) + ids
        out = m["alone"][ids] - m["less"][prev]
        place = self._place(keys)
        left = np.arange(len(keys))
        while len(left):
            have = self.slot[place]
            hit = have == keys[left]
            out[left[hit]] = m["kept"][self.at[place[hit]]]
            on = ~hit & (have >= 0)
            left, place = left[on], (place[on] + 1) & self.mask
        return out

    def classes(self, inputs: np.ndarray, usable: np.ndarray, target: np.ndarray) -> np.ndarray:
        """What the attention adds to each target's log probability, for windows in a batch; usable marks the places of a window that exist."""
        m, own = self.m, np.ascontiguousarray(inputs[:, STRIDE:])
        n, d, c = len(inputs), self.query.shape[1], m["wo"].shape[1]
        if n not in self.room:  # the same memory for every batch: fresh arrays cost more than the arithmetic
            new = lambda *shape: np.empty(shape, np.float32)
            self.room = {n: (new(n, STRIDE, d), new(n, SPAN, d), new(n, SPAN, d + 1), new(n, STRIDE, SPAN), new(n, STRIDE, d + 1), new(n, STRIDE, d), new(n, STRIDE, d), new(n * STRIDE, c), new(n * STRIDE, c))}
        q, k, v, a, mixed, h, size, add, logits = self.room[n]
        np.take(self.query, own, axis=0, out=q, mode="clip")
        np.take(self.key, inputs, axis=0, out=k, mode="clip")
        np.take(self.value, inputs, axis=0, out=v, mode="clip")
        np.matmul(q, k.transpose(0, 2, 1), out=a)
        a += self.rel
        if self.wild[0]:
            np.clip(a, -60, 30, out=a)
        np.exp(a, out=a)
        some = np.flatnonzero(~usable[:, 0])
        a[some] *= usable[some, None, :]
        np.matmul(a, v, out=mixed)
        np.divide(mixed[:, :, :-1], mixed[:, :, -1:], out=h)
        np.take(self.skip, own, axis=0, out=q, mode="clip")
        h += q
        np.abs(h, out=size)
        size += 1
        h /= size
        np.matmul(h.reshape(-1, d), m["wo"], out=add)
        add += m["bo"]
        picked = add[np.arange(len(add)), m["class"][target].ravel()]
        np.take(m["class_after"], own.ravel(), axis=0, out=logits, mode="clip")
        logits += add
        if self.wild[1]:
            np.clip(logits, -80, 80, out=logits)
        np.exp(logits, out=logits)
        return picked - np.log(logits @ np.ones(c, np.float32))

    def score(self, ids: np.ndarray, first: np.ndarray, at_once: int = 256) -> np.ndarray:
        """log10 probability of each text, its end included."""
        end_id = len(self.m["class"]) - 1
        if len(first) < 2 or not len(ids):
            return np.zeros(len(first) - 1)
        before = prevs(ids, first, end_id)
        each = self.pairs(before, ids).astype(float)
        n = -(-np.diff(first) // STRIDE)
        begin, end = np.repeat(first[:-1], n), np.repeat(first[1:], n)
        at = begin + (np.arange(len(begin)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
        for s in range(0, len(at), at_once):
            w = slice(s, s + at_once)
            places = at[w, None] + np.arange(-STRIDE, STRIDE)
            usable, mine = places >= begin[w, None], places[:, STRIDE:]
            live, mine = mine < end[w, None], np.minimum(mine, len(ids) - 1)
            more = self.classes(before[np.clip(places, 0, len(ids) - 1)], usable, ids[mine]).reshape(live.shape)
            each[mine[live]] += more[live]
        return np.add.reduceat(each, first[:-1]) / np.log(10)


def _trains(doc_id, known, mod: int, held: int) -> bool:
    return bool(known) and zlib.crc32(str(doc_id).encode()) % mod != held


class Corpus:
    """The documents as ids and word hashes, packed in chunks; what is asked of it is asked of every chunk."""

    MADE = "texts long, words long, windows long, ids binary, hashes binary, pairs binary"

    def __init__(self, docs: DataFrame, mod: int = MOD, held: int = HELD, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", per_shard: int = PER_SHARD, most_rows: int = ROWS, chunk_bytes: int = CHUNK):
        self.spark, self.mod, self.held, self.per_shard, self.most_rows = docs.sparkSession, mod, held, per_shard, most_rows
        default_path, default_pattern = defaults()
        pattern = pattern or default_pattern
        with open(ranks_path or default_path, "rb") as f:
            text = f.read()
        data = self.spark.sparkContext.broadcast(text)
        self.vocab = vocab = len(read_ranks(text)) + 1
        kind = _kind(vocab)

        def make(doc_ids, known, raw, offsets):
            ids, first, hashes, code, first_word = _ids(data.value, pattern).of(raw, offsets)
            trains = np.array([_trains(i, k, mod, held) for i, k in zip(doc_ids.tolist(), known.tolist())], bool)
            distinct, back = np.unique(hashes, return_inverse=True)
            words = squeeze_sorted(distinct), squeeze(back.astype(np.int32)[code] if len(code) else np.zeros(0, np.int32)), squeeze(first_word.astype(np.int64))
            lengths = np.diff(first)
            own = expand(ids, first[:-1][trains], lengths[trains])
            own_first = np.concatenate([[0], np.cumsum(lengths[trains])])
            keys, times = pair_counts(own, own_first, vocab - 1) if len(own) else (np.zeros(0, np.int64),) * 2
            yield int(trains.sum())
            yield int(np.diff(first_word)[trains].sum())
            yield int((-(-lengths[trains] // SPAN)).sum())
            yield pickle.dumps((squeeze(ids.astype(kind)), squeeze(lengths), trains), 5)
            yield pickle.dumps(words, 5)
            yield pickle.dumps((squeeze_sorted(keys), squeeze(times.astype(np.int64))), 5)

        self.chunks = pack(docs, chunk_bytes, id_col, text_col, made=self.MADE, make=make)
        total = self.chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "texts", "words", "windows")), F.count("*")).first()
        self.size, self.texts, self.words, self.windows, self.n_chunks = (int(x) for x in total)

    def model(self, pairs: int = PAIRS) -> dict:
        """Train on every training text."""
        vocab = self.vocab

        def count(batches):
            keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

            def rows():
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], names=["pair", "n"])

            for batch in batches:
                for blob in batch.column(0):
                    k, n = pickle.loads(blob.as_py())
                    keys, back = np.unique(np.concatenate([keys, unsqueeze_sorted(k)]), return_inverse=True)
                    times = np.bincount(back, np.concatenate([times, unsqueeze(n)]), len(keys)).astype(np.int64)
                    if len(keys) > 1 << 20:
                        yield from rows()
                        keys, times = keys[:0], times[:0]
            yield from rows()

        # a pair of ids is a row here: the vocabulary bounds their number, whatever the corpus
        counted = self.chunks.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        table = materialize(counted)
        single = table.groupBy((F.col("pair") % vocab).alias("id")).agg(F.sum("n").alias("n")).toArrow()
        top = table.orderBy(F.desc("n"), "pair").limit(pairs).toArrow()
        counts = np.zeros(vocab)
        counts[single.column("id").to_numpy()] = single.column("n").to_numpy()
        m = untrained(counts, top.column("pair").to_numpy(), top.column("n").to_numpy())
        rounds, epochs, size = ROUNDS if self.windows else 0, epochs_for(self.windows), sum(m[n].size for n in LEARNT) + 1
        for r in range(rounds):
            given = {n: m[n] for n in (*LEARNT, "embed", "class", "class_after")}
            start = self.spark.sparkContext.broadcast(shrink(pickle.dumps(given, 5)))

            def go(batches, start=start, r=r):
                _IDS.clear()
                now = pickle.loads(grow(start.value))
                total = np.zeros(size, np.int64)
                held, seed = [], 0
                for batch in batches:
                    for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                        held.append((chunk, *training_windows(blob.as_py(), vocab - 1)))
                        if sum(len(x) for _, _, x in held) > 1 << 17:
                            total, held = total + done(now, held, r), []
                            lean()
                if held:
                    total, held = total + done(now, held, r), []
                    lean()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

            def done(now, held, r):
                rows, real = np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
                return change(now, rows, real, epochs, r, rounds, held[0][0]) if len(rows) else 0

            parts = self.chunks.select("chunk", "ids").mapInArrow(go, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
            total = np.zeros(size, np.int64)
            total[parts.column("i").to_numpy()] = parts.column("v").to_numpy()
            m = changed(m, total)
            start.unpersist()
        return m

    def _trains(self):
        mod, held = self.mod, self.held
        return lambda ids, known: np.array([_trains(i, k, mod, held) for i, k in zip(ids.tolist(), known.tolist())], bool)

    def counted(self) -> tuple[DataFrame, int, int]:
        """How often each chunk's words occur in all training texts, the shard bits, and the number of distinct words."""
        bits, trains_of = shard_bits(self.size // 12, self.per_shard), self._trains()

        def count(row):
            _IDS.clear()  # the words met while packing are not needed any more
            ids, known, _, _ = unpack(row["blob"])
            words, code, first = pickle.loads(row["hashes"])
            words, code, first = unsqueeze_sorted(words), unsqueeze(code), unsqueeze(first)
            here = np.bincount(code, np.repeat(trains_of(ids, known), np.diff(first)), len(words)).astype(np.uint32)
            edges = by_shard(words, bits)
            for shard in np.flatnonzero(np.diff(edges)):
                s = slice(edges[shard], edges[shard + 1])
                a = squeeze_sorted(words[s])
                yield int(shard), len(a).to_bytes(4, "little") + a + squeeze(here[s])

        def merge(chunk_ids, payloads):
            parts = []
            for p in payloads:
                cut = 4 + int.from_bytes(p[:4], "little")
                parts.append((unsqueeze_sorted(p[4:cut]), unsqueeze(p[cut:])))
            words, place = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
            total = np.bincount(place, np.concatenate([b for _, b in parts]), len(words)).astype(np.int64)
            edges = np.cumsum([0] + [len(a) for a, _ in parts])
            out = Answers(squeeze(total[place[edges[i] : edges[i + 1]]]) for i in range(len(parts)))
            out.tally = int((total > 0).sum())
            return out

        got = round_of(self.chunks.select("chunk", "blob", "hashes"), count, merge, bits, self.n_chunks, self.most_rows)
        return got, bits, int(got.agg(F.coalesce(F.sum("tally"), F.lit(0))).first()[0])

    def scores(self, m: dict) -> DataFrame:
        """The documents with their scores."""
        replies, bits, distinct = self.counted()
        trains_of, texts = self._trains(), self.texts
        n, v = self.words + texts, distinct + (texts > 0)
        less = np.log10(n + v + 1) if n else 0.0
        trained = self.spark.sparkContext.broadcast(shrink(pickle.dumps(m, 5)))

        def attend(batches):
            """Each chunk's scores: this needs the model and the ids, what follows needs the answers and the words."""
            _IDS.clear()
            lean()
            scorer = Scorer(pickle.loads(grow(trained.value)))
            for batch in batches:
                for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids, lengths = (unsqueeze(x) for x in pickle.loads(blob.as_py())[:2])
                    at = np.concatenate([[0], np.cumsum(lengths)])
                    # a few texts at a time, so that the working memory stays that of some windows
                    out, d = np.zeros(len(lengths)), 0
                    while d < len(lengths):
                        stop = max(d + 1, int(np.searchsorted(at, at[d] + (1 << 18), "right")) - 1)
                        out[d:stop] = scorer.score(ids[at[d] : at[stop]].astype(np.int32), at[d : stop + 1] - at[d])
                        d = stop
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([0], pa.int32()), pa.array([pickle.dumps((out, lengths), 5)], pa.binary())], names=["chunk", "shard", "payload"])
                    lean()

        scored = materialize(self.chunks.select("chunk", "ids").mapInArrow(attend, "chunk long, shard int, payload binary"))

        def final(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    doc_ids, known, _, _ = unpack(row["blob"])
                    words, code, first = pickle.loads(row["hashes"])
                    words, code, first = unsqueeze_sorted(words), unsqueeze(code), unsqueeze(first)
                    c, edges = np.zeros(len(words), np.int64), by_shard(words, bits)
                    answers, own = heard(row, 2)
                    out, lengths = pickle.loads(own[0])
                    for shard, payload in answers.items():
                        c[edges[shard] : edges[shard + 1]] = unsqueeze(payload)
                    has = np.flatnonzero(np.diff(first))
                    base, n_known = np.full(len(doc_ids), np.log10(texts + 1.0) - less), np.full(len(doc_ids), int(texts > 0))
                    if len(has):
                        base[has] += np.add.reduceat((np.log10(c + 1.0) - less)[code], first[has])
                        n_known[has] += np.add.reduceat((c > 0)[code].astype(np.int64), first[has])
                    columns = [pa.array(doc_ids, pa.int64(), mask=~known), pa.array(~trains_of(doc_ids, known)), pa.array(np.diff(first) + 1), pa.array(n_known), pa.array(np.full(len(doc_ids), n)), pa.array(base), pa.array(out), pa.array(lengths)]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])
                    lean()

        return told(self.chunks.select("chunk", "blob", "hashes"), replies, scored).mapInArrow(final, SCHEMA)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_ids long"


def lm_scores(docs: DataFrame, mod: int = MOD, held: int = HELD, ranks_path: str | None = None, pattern: str | None = None, pairs: int = PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: held_out, n_tokens, n_known, train_tokens, base_score, score, n_ids.

    Training texts are those with crc32(doc_id as text) mod `mod` other than `held`; a null doc_id trains nothing and
    counts as held out. Texts are lower-cased (A-Z); null texts count as empty and consist of their end. base_score is
    the smoothed word-frequency score, score the attention model's log10 probability of the same words and end. Without
    training texts both still are probabilities, of an untrained model. Repeated rows come back repeated; an empty table
    gives none.
    """
    corpus = Corpus(docs, mod, held, ranks_path, pattern, id_col, text_col)
    return corpus.scores(corpus.model(pairs))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
