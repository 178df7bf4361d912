"""Toxicity by a bidirectional gated recurrent network with attention, in numpy.

A word enters as a hashed word embedding next to the sum of hashed embeddings of its
character n-grams, its ends marked. Two gated recurrent layers read a window of words from
left and from right; attention pools their states; one logistic unit gives the window's
score. All windows of ``WINDOW`` words, each overlapping the next by half, are scored, and
a document scores as its highest window.

The network is fitted on the driver on at most ``SAMPLE`` documents of label 1 and
``PER_TOXIC`` times as many of label 0 (documented bounds of the fit; scoring has none).
Texts of up to ``SAMPLE_CHARS`` characters come first; where a label has too few of these,
longer ones enter with pieces of so many characters together, spread over the whole text.
Only documents are labelled, so each pass learns from a document's highest window, and for label 0 also from a random one;
each pass takes all documents of label 1 and some of label 0.

Defined results: a null text, an empty one, and one without words score 0; without rows of
both labels all score 0; labelled rows of both kinds from which no network can be fitted, all
of one kind being wordless, are an error; a repeated label row counts once, the larger label winning; rows
of equal text get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failurelens.llm.common import prepare, text_slices

SAMPLE = 1000
PER_TOXIC = 4
SAMPLE_CHARS = 8_000
PIECES = 20
WINDOW = 32
STEP = 16
WORD_BUCKETS = 1 << 13
GRAM_BUCKETS = 1 << 15
GRAMS = (3, 4, 5, 6, 7)
WORD_DIM, GRAM_DIM, STATE = 8, 16, 10
#: A longer run of letters is read in parts of so many, each n-gram whole in one of them.
MAX_CHARS = 24
EPOCHS = 12
#: Training ends with the pass in which this many batches are reached.
ENOUGH_STEPS = 320
BATCH = 128
#: Words kept with their gate inputs by a worker.
WORD_MEMO = 120_000
CHUNK = 4096

_find_runs = re.compile(r"[^\W\d_]+").findall


def find_words(text: str) -> list[str]:
    """The runs of letters; one of over MAX_CHARS in overlapping parts, each a word."""
    runs = _find_runs(text)
    if not runs or len(max(runs, key=len)) <= MAX_CHARS:
        return runs
    shared = max(GRAMS) - 1
    return [w[i:i + MAX_CHARS] for w in runs for i in range(0, max(1, len(w) - shared), MAX_CHARS - shared)]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, n-gram buckets, word of each n-gram) of distinct words; an n-gram counts once for each place."""
    parts = [_features(words[i:i + CHUNK]) for i in range(0, max(1, len(words)), CHUNK)]  # hashing takes much more room
    for i, (_, _, owners) in enumerate(parts):
        owners += i * CHUNK
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out_word = np.zeros(len(words), np.int64)
    grams, owners = [], []
    by_length: dict[int, list[int]] = {}
    cut = [f"<{w}>" for w in words]
    for i, w in enumerate(cut):
        by_length.setdefault(len(w), []).append(i)
    for n, at in by_length.items():
        codes = np.frombuffer("".join([cut[i] for i in at]).encode("utf-32-le"), np.uint32).reshape(len(at), n)
        codes = codes.astype(np.uint64) + np.uint64(1)
        for size in (*(g for g in GRAMS if g < n), n):
            width = n - size + 1
            h = np.full((len(at), width), np.uint64(size))
            for k in range(size):
                h = h * np.uint64(0x100000001B3) + codes[:, k:k + width]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            if size == n:
                out_word[at] = (h[:, 0] % np.uint64(WORD_BUCKETS)).astype(np.int64)
            else:
                grams.append((h % np.uint64(GRAM_BUCKETS)).astype(np.int32).ravel())
                owners.append(np.repeat(np.array(at, np.int32), width))
    if not grams:
        return out_word, np.zeros(0, np.int32), np.zeros(0, np.int32)
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return out_word, grams[order], owners[order]


def windows_of(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of all overlapping windows of documents with these word counts."""
    count = np.where(n_words > 0, 1 + np.maximum(0, -(-(n_words - WINDOW) // STEP)), 0)
    doc = np.repeat(np.arange(len(n_words)), count)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STEP
    return doc, first, np.minimum(WINDOW, n_words[doc] - first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.exp(-x)
    out += 1
    return np.reciprocal(out, out=out)


class Network:
    """Parameters as arrays, forward and backward passes over batches of windows."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        put = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        self.words, self.grams = put(WORD_BUCKETS, WORD_DIM, scale=0.1), put(GRAM_BUCKETS, GRAM_DIM, scale=0.1)
        dim = WORD_DIM + GRAM_DIM
        self.w = {}
        for side in "fb":
            self.w["x" + side] = put(dim, 3 * STATE, scale=dim ** -0.5)
            self.w["h" + side] = put(STATE, 3 * STATE, scale=STATE ** -0.5)
            self.w["c" + side] = np.zeros(3 * STATE, np.float32)
        self.w |= {"a": put(2 * STATE, STATE, scale=0.3), "v": put(STATE, scale=0.3),
                   "u": put(2 * STATE, scale=0.3), "o": np.full(1, -1.5, np.float32)}
        self.ready = True

    # words ---------------------------------------------------------------
    def inputs(self, feats: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """A row for each distinct word: word embedding, then the n-grams' sum by the root of their number."""
        bucket, grams, owner = feats
        x = np.zeros((len(bucket), WORD_DIM + GRAM_DIM), np.float32)
        x[:, :WORD_DIM] = self.words[bucket]
        if len(grams):
            has, start, n = np.unique(owner, return_index=True, return_counts=True)
            for i in range(0, len(has), CHUNK):  # the n-grams' rows take much more room than their sums
                part = slice(start[i], start[i + CHUNK] if i + CHUNK < len(has) else None)
                sums = np.add.reduceat(self.grams[grams[part]], start[i:i + CHUNK] - start[i])
                x[has[i:i + CHUNK], WORD_DIM:] = sums / np.sqrt(n[i:i + CHUNK])[:, None]
        return x

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {side: x @ self.w["x" + side] + self.w["c" + side] for side in "fb"}

    # windows -------------------------------------------------------------
    def _read(self, side: str, g: np.ndarray, at: np.ndarray, mask: np.ndarray | None, keep: bool):
        """States of one direction over (windows, places); ``keep`` saves what backward needs."""
        n, places = at.shape
        u = self.w["h" + side]
        h = np.zeros((n, STATE), np.float32)
        states = np.empty((places, n, STATE), np.float32)
        saved = []
        by_place = np.ascontiguousarray(at.T)
        for t in range(places) if side == "f" else range(places - 1, -1, -1):
            gx, gh = np.take(g, by_place[t], axis=0), h @ u
            rz = _sigmoid(gx[:, :2 * STATE] + gh[:, :2 * STATE])
            r, z = rz[:, :STATE], rz[:, STATE:]
            c = np.tanh(gx[:, 2 * STATE:] + r * gh[:, 2 * STATE:])
            new = c + z * (h - c)
            if mask is not None:
                new = np.where(mask[:, t:t + 1], new, h)
            if keep:
                saved.append((t, h, r, z, c, gh[:, 2 * STATE:]))
            h = states[t] = new
        return states, saved

    def forward(self, g: dict[str, np.ndarray], at: np.ndarray, length: np.ndarray, keep: bool = False):
        """Scores of windows; ``at``: the gate row of each place, any row beyond ``length``."""
        mask = None if (length == at.shape[1]).all() else np.arange(at.shape[1]) < length[:, None]
        left, saved_f = self._read("f", g["f"], at, mask, keep)
        right, saved_b = self._read("b", g["b"], at, mask, keep)
        h = np.concatenate([left, right], 2)
        key = np.tanh(h @ self.w["a"])
        e = key @ self.w["v"]
        if mask is not None:
            e = np.where(mask.T, e, -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * h).sum(0)
        p = _sigmoid(pooled @ self.w["u"] + self.w["o"])
        return (p, (h, key, a, pooled, mask, saved_f, saved_b)) if keep else p

    def backward(self, at: np.ndarray, y: np.ndarray, weight: np.ndarray, p: np.ndarray, cache, n_rows: int):
        """Gradients of the weighted log loss: parameters, and gate rows by side."""
        h, key, a, pooled, mask, saved_f, saved_b = cache
        d_logit = ((p - y) * weight).astype(np.float32)
        grads = {"u": pooled.T @ d_logit, "o": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.w["u"]
        d_a = (h * d_pooled).sum(2)
        d_e = a * (d_a - (a * d_a).sum(0))
        d_key = d_e[:, :, None] * self.w["v"] * (1 - key ** 2)
        grads["v"] = np.tensordot(d_e, key, ([0, 1], [0, 1]))
        grads["a"] = np.tensordot(h, d_key, ([0, 1], [0, 1]))
        d_h = a[:, :, None] * d_pooled + d_key @ self.w["a"].T
        rows = {}
        for side, saved, part in (("f", saved_f, d_h[:, :, :STATE]), ("b", saved_b, d_h[:, :, STATE:])):
            u = self.w["h" + side]
            d_u, back = np.zeros_like(u), np.zeros((len(at), STATE), np.float32)
            rows[side] = np.zeros((n_rows, 3 * STATE), np.float32)
            for t, before, r, z, c, gc in reversed(saved):
                total = back + part[t]
                live = total if mask is None else np.where(mask[:, t:t + 1], total, 0)
                d_c = live * (1 - z) * (1 - c ** 2)
                d_z = live * (before - c) * z * (1 - z)
                d_r = d_c * gc * r * (1 - r)
                d_g = np.concatenate([d_r, d_z, d_c], 1)
                d_gh = np.concatenate([d_r, d_z, d_c * r], 1)
                np.add.at(rows[side], at[:, t], d_g)
                d_u += before.T @ d_gh
                back = live * z + d_gh @ u.T + (0 if mask is None else np.where(mask[:, t:t + 1], 0, total))
            grads["h" + side] = d_u
        return grads, rows

    def score_windows(self, g: dict[str, np.ndarray], ids: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Scores of windows of the word sequence ``ids`` that start at ``first``."""
        out = np.empty(len(first), np.float32)
        order = np.argsort(-length, kind="stable")  # full windows need no mask
        for i in range(0, len(first), CHUNK):
            part = order[i:i + CHUNK]
            width = int(length[part].max())
            at = ids[np.minimum(first[part, None] + np.arange(width), len(ids) - 1)]
            out[part] = self.forward(g, at, length[part])
        return out


class Scorer:
    """Scores texts with a network, keeping the gate inputs of words seen."""

    def __init__(self, network: Network):
        self.net = network
        self.memo: dict[str, int] = {}
        self.rows = {side: np.zeros((0, 3 * STATE), np.float32) for side in "fb"}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        found = [find_words(raw.decode().lower()) for raw in texts]
        n_words = np.array([len(w) for w in found])
        if not self.net.ready or not n_words.sum():
            return out
        if len(self.memo) > WORD_MEMO:
            self.memo, self.rows = {}, {side: rows[:0] for side, rows in self.rows.items()}
        memo = self.memo
        new = [w for w in dict.fromkeys(chain.from_iterable(found)) if w not in memo]
        if new:
            gates = self.net.gates(self.net.inputs(features(new)))
            memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
            self.rows = {side: np.concatenate([self.rows[side], gates[side]]) for side in "fb"}
        ids = np.fromiter(map(memo.__getitem__, chain.from_iterable(found)), np.int64, int(n_words.sum()))
        doc, first, length = windows_of(n_words)
        base = np.cumsum(n_words) - n_words
        p = self.net.score_windows(self.rows, ids, base[doc] + first, length)
        np.maximum.at(out, doc, p)
        return out


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit a network on whole labelled texts."""
    net, rng = Network(seed), np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    numbers = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in find_words(t.decode().lower())], np.int32)
               for t in texts]
    kept = [i for i, w in enumerate(numbers) if len(w)]
    y = np.asarray(labels, np.float32)[kept]
    if not len(kept) or y.min() == y.max():
        net.ready = False
        return net
    ids = np.concatenate(numbers)
    n_words = np.array([len(numbers[i]) for i in kept])
    base = np.cumsum(n_words) - n_words
    feats = features(list(vocabulary))
    bucket, grams, owner = feats
    gram_start = np.searchsorted(owner, np.arange(len(vocabulary) + 1))
    doc, first, length = windows_of(n_words)
    start = base[doc] + first
    doc_first = np.searchsorted(doc, np.arange(len(kept)))
    n_windows = np.bincount(doc, minlength=len(kept))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    seen_words, seen_grams = np.full(WORD_BUCKETS, 1e-6, np.float32), np.full(GRAM_BUCKETS, 1e-6, np.float32)
    steps = 0
    for epoch in range(epochs):
        if steps >= ENOUGH_STEPS:
            break
        # at first only documents of few windows tell which window their label means
        used = np.flatnonzero(n_windows <= (3, 6, 12)[epoch]) if epoch < 3 else np.arange(len(kept))
        clean = rng.permutation(used[y[used] == 0])[:2 * int(y.sum()) + 200]
        used = np.sort(np.concatenate([used[y[used] == 1], clean]))
        pool = np.flatnonzero(np.isin(doc, used))
        p = net.score_windows(net.gates(net.inputs(feats)), ids, start[pool], length[pool])
        order = np.lexsort((-p, doc[pool]))
        top = pool[order[np.flatnonzero(np.diff(doc[pool][order], prepend=-1))]]
        random = doc_first[clean] + rng.integers(0, n_windows[clean])
        picked = rng.permutation(np.concatenate([top, random]))
        rate = 0.02 * (1 - epoch / epochs) + 0.002
        for i in range(0, len(picked), BATCH):
            batch = picked[i:i + BATCH]
            width = int(length[batch].max())
            words, at = np.unique(ids[np.minimum(start[batch, None] + np.arange(width), len(ids) - 1)], return_inverse=True)
            at = at.reshape(len(batch), width)
            n_grams = gram_start[words + 1] - gram_start[words]
            flat = np.repeat(gram_start[words], n_grams) + np.arange(n_grams.sum()) - np.repeat(
                np.cumsum(n_grams) - n_grams, n_grams)
            mine = (bucket[words], grams[flat], np.repeat(np.arange(len(words)), n_grams))
            x = net.inputs(mine)
            g = net.gates(x)
            p_batch, cache = net.forward(g, at, length[batch], keep=True)
            grads, rows = net.backward(at, y[doc[batch]], np.full(len(batch), 1 / len(batch)), p_batch, cache, len(words))
            d_x = np.zeros_like(x)
            for side in "fb":
                grads["x" + side] = x.T @ rows[side]
                grads["c" + side] = rows[side].sum(0)
                d_x += rows[side] @ net.w["x" + side].T
            steps += 1
            for k, grad in grads.items():
                m, v = moment[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad ** 2 - v)
                net.w[k] -= rate * (m / (1 - 0.9 ** steps)) / (np.sqrt(v / (1 - 0.999 ** steps)) + 1e-8)
            d_gram = d_x[mine[2], WORD_DIM:] / np.sqrt(n_grams[mine[2]])[:, None]
            _adagrad(net.words, seen_words, mine[0], d_x[:, :WORD_DIM], 0.05)
            _adagrad(net.grams, seen_grams, mine[1], d_gram, 0.05)
    return net


def _adagrad(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """One step for the rows of an embedding table that a batch touched."""
    held, place = np.unique(rows, return_inverse=True)
    total = np.zeros((len(held), table.shape[1]), np.float32)
    np.add.at(total, place.ravel(), grad)
    seen[held] += (total ** 2).mean(1)
    table[held] -= rate * total / np.sqrt(seen[held])[:, None]


def pieces(text: Column, size: int) -> Column:
    """Up to ``size`` characters of a text: all of it, or ``PIECES`` spans at even distances over it."""
    n, each = F.length(text), size // PIECES
    starts = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.floor(i * (n - each) / (PIECES - 1)) + 1)
    spans = F.transform(starts, lambda s: F.substring(text, s.cast("int"), F.lit(each)))
    return F.when(n <= size, text).otherwise(F.array_join(spans, "\n"))


def fit(docs: DataFrame, labels: DataFrame, chosen: Column, label: str = "toxic", sample: int = SAMPLE) -> Network:
    """Train on a sample of the labelled rows for which ``chosen`` holds, taken by a hash of their id."""
    known = labels.filter(F.col(label).isNotNull() & chosen).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = known.join(texts.select("doc_id", F.length("text").alias("n")), "doc_id").groupBy("doc_id", "label").agg(F.min("n").alias("n"))
    by_hash = lambda y, n: (sizes.filter(F.col("label") == y)
                            .orderBy(F.col("n") > SAMPLE_CHARS, F.xxhash64("doc_id"), "doc_id").limit(n))
    some = by_hash(1, sample).unionByName(by_hash(0, PER_TOXIC * sample))
    # of rows that repeat an id, a shortest text
    held = (texts.join(F.broadcast(some), "doc_id").filter(F.length("text") == F.col("n"))
            .select("doc_id", "label", pieces(F.col("text"), SAMPLE_CHARS).alias("text"))
            .groupBy("doc_id", "label").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id"))
    network = train([t.encode() for t in held["text"]], held["label"].to_numpy())
    if not network.ready and held["label"].nunique() == 2:
        raise ValueError("all labelled documents of one kind are wordless: no network can be fitted")
    return network


def score(docs: DataFrame, network: Network, held: Column, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    found = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), network)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def with_score(docs: DataFrame, network: Network, name: str = "score") -> DataFrame:
    """``docs`` with the score of its column ``text``; no shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(network)
    kept = [f for f in docs.schema.fields if f.name != name]
    names = [f.name for f in kept]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for start, texts in text_slices(batch):
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in map(part.schema.get_field_index, names)]
                    + [pa.array(scorer.scores(texts), pa.float64())], [*names, name])

    return docs.mapInArrow(scored, T.StructType([*kept, T.StructField(name, T.DoubleType())]))
