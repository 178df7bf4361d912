"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's term vector counts hashed byte trigrams and a few style terms (words that repeat
the word before, repeated lines, capitals, digits, symbols and so on), damped by a
logarithm and weighted by rarity. Truncated singular vectors of the labelled sample's
centred term matrix map it to a latent vector of unit length.

The labelled vectors (at most ``SAMPLE`` of them, a documented bound on the classifier's
fit) are broadcast; each document is compared with all of them by exact products in
blocks, and its nearest ``NEIGHBOURS`` vote with weights that grow with their cosine.

Defined results: null and empty texts have the empty term vector and are scored like any
other; without labelled rows every score is 0.5; a repeated label row counts once, the
larger label winning; ties among neighbours go to the one first in the sample, which is
in order of id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failurelens.llm.common import prepare, text_slices

SAMPLE = 4096
NEIGHBOURS = 15
DIMENSIONS = 48
TRIGRAMS = 1024
#: Counts by which a text's style is told: see ``style``.
STYLE = 10
#: A style term weighs as much as so many trigrams.
STYLE_WEIGHT = 8.0
#: Neighbours' weight is their cosine, where positive, to this power.
SHARPNESS = 4


def style(raw: bytes) -> list[float]:
    """Shares (0 to 1, by a thousandth and up on a log scale) that no trigram count shows."""
    words = raw.split()
    lines = raw.split(b"\n")
    n, chars = max(1, len(words)), max(1, len(raw))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    letters = sum(map(raw.count, (b"e", b"n", b"a", b"t", b"i", b"r", b"s", b"o")))
    upper = sum(w.isupper() for w in words)
    with_end = raw.count(b".") + raw.count(b"?") + raw.count(b"!")
    shares = [same / n, 1 - len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)), upper / n,
              sum(map(raw.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / chars,
              sum(map(raw.count, (b"#", b"$", b"%", b"&", b"*", b"|", b"@", b"<", b"{"))) / chars,
              letters / chars, with_end / n, len(lines) / n, min(1.0, n / 1000)]
    return [float(np.log1p(1000 * s)) for s in shares]


def term_vectors(texts: list[bytes]) -> np.ndarray:
    """(documents, TRIGRAMS + STYLE): damped trigram counts per length, and the style terms."""
    out = np.zeros((len(texts), TRIGRAMS + STYLE), np.float32)
    held = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    size = np.array([len(t) for t in texts])
    if len(held) > 2:
        code = (held[:-2] << np.uint32(16)) | (held[1:-1] << np.uint32(8)) | held[2:]
        bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - 10)
        owner = np.repeat(np.arange(len(texts)), size)
        whole = owner[:-2] == owner[2:]
        where = owner[:-2][whole] * TRIGRAMS + bucket[whole]
        counts = np.bincount(where, minlength=len(texts) * TRIGRAMS).reshape(len(texts), TRIGRAMS)
        out[:, :TRIGRAMS] = np.log1p(counts * (2000 / np.maximum(size, 200))[:, None])
    for i, raw in enumerate(texts):
        out[i, TRIGRAMS:] = style(raw)
    return out


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` greatest of each row, of equal ones the first."""
    last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1:k]
    above, tied = cosine > last, cosine == last
    free = k - above.sum(1, keepdims=True)
    if (tied.sum(1, keepdims=True) > free).any():
        tied &= np.cumsum(tied, axis=1, dtype=np.int32) <= free
    return np.nonzero(above | tied)[1].reshape(len(cosine), k)


class Neighbours:
    """The fitted space and the labelled vectors in it."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        if not len(labels):
            return
        seen = (terms[:, :TRIGRAMS] > 0).sum(0)
        weight = np.log((1 + len(labels)) / (1 + seen)) + 0.3
        spread = terms[:, TRIGRAMS:].std(0) + 1e-3
        self.weight = np.concatenate([weight, STYLE_WEIGHT / spread]).astype(np.float32)
        self.mean = terms.mean(0)
        x = (terms - self.mean) * self.weight
        _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS], np.float32)
        self.vectors = self.latent(terms)

    def latent(self, terms: np.ndarray) -> np.ndarray:
        z = ((terms - self.mean) * self.weight) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[bytes], block: int = 256) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest, in blocks of documents."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out, k = [], min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(texts), block):
            cosine = self.latent(term_vectors(texts[i:i + block])) @ self.vectors.T
            near = nearest(cosine, k)
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3) ** SHARPNESS
            out.append((weight * self.labels[near]).sum(1) / weight.sum(1))
        return np.clip(np.concatenate(out).astype(np.float64), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", sample: int = SAMPLE) -> Neighbours:
    """Fit on at most ``sample`` labelled rows for which ``train`` holds, chosen by a hash of their id."""
    prepare(docs.sparkSession)
    known = (labels.filter(F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch):
                part = batch.slice(start, len(texts))
                flat = pa.array([v.tobytes() for v in term_vectors(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), flat], ["doc_id", "label", "terms"])

    held = rows.mapInArrow(terms, "doc_id bigint, label int, terms binary").toPandas()
    held = held.sort_values(["doc_id", "terms"]).drop_duplicates("doc_id")
    matrix = np.frombuffer(b"".join(held["terms"]), np.float32).reshape(len(held), TRIGRAMS + STYLE)
    return Neighbours(matrix, held["label"].to_numpy())


def score(docs: DataFrame, model: Neighbours, held: Column, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch):
                part = batch.slice(start, len(texts))
                found = sent.value.scores(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return rows.mapInArrow(vote, "doc_id bigint, held_out boolean, score double, predicted int")
