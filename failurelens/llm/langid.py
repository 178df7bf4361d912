"""Language by segmentation-marginalised unigrams over a public piece vocabulary.

A word's probability in a language is the sum, over all ways to cut it into vocabulary
pieces, of the product of the pieces' probabilities: a forward pass over the word's
characters. Probabilities are learned by expectation: each training word's segmentations
under a neutral start model are weighed by a forward-backward pass, and the expected
piece counts are summed over **all** training documents. A task sends at most one row for
each language and piece, so what is shuffled and collected is bounded by the vocabulary.

Characters outside the vocabulary are pieces of a byte-like class of their own, so every
word has a segmentation. All pieces of letters count, and words of any length are summed
whole: the sums are rescaled on the way, and a long word's pieces are looked up in blocks.
Distinct words are processed together, by length; a task of the fit counts its words first
and takes each through the passes once for every WORD_MEMO distinct ones.

Defined results: ``und`` with score 0 for a null text, one without letters, and any text if
no document could be learned from; rows without a language are not learned from; ties go
to the language that sorts first; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failurelens.llm.common import prepare, text_slices

UNKNOWN = "und"
#: Bits of a hash that rule out most substrings before the search.
MAYBE_BITS = 18
#: Places of a word whose pieces are looked up at once.
BLOCK = 4096
#: Sums are rescaled at every place that is a multiple of this.
RESCALE = 16
#: Words kept with their scores, or their counts in the fit, by a Python worker.
WORD_MEMO = 150_000
#: Added to each expected piece count.
SMOOTHING = 0.5
START = "▁"

_BASE = np.uint64(0x9E3779B97F4A7C15)
find_words = regex.compile(r"\p{L}+").findall


def piece_vocabulary(path: str) -> list[str]:
    """The letter pieces, in lower case, of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p and regex.fullmatch(rf"{START}?\p{{L}}*", p))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Pieces:
    """Finds the pieces at all places of many words at once, by hashes of substrings."""

    def __init__(self, vocabulary: list[str]):
        self.size = len(vocabulary) + 1  # the last stands for any other character
        by_length: dict[int, list[tuple[str, int]]] = {}
        for i, p in enumerate(vocabulary):
            by_length.setdefault(len(p), []).append((p, i))
        self.keys, self.ids, self.maybe = {}, {}, {}
        for n, held in by_length.items():
            keys = next(h for k, h in self.hashes(self.codes([p for p, _ in held], n), 1) if k == n)[:, 0]
            order = np.argsort(keys)
            self.keys[n], self.ids[n] = keys[order], np.array([i for _, i in held], np.int32)[order]
            if len(np.unique(keys)) != len(keys):
                raise ValueError("two pieces share a hash")
            self.maybe[n] = np.zeros(1 << MAYBE_BITS, bool)
            self.maybe[n][keys >> np.uint64(64 - MAYBE_BITS)] = True
        self.texts = dict(enumerate(vocabulary))
        self.longest = max(by_length, default=1)

    @staticmethod
    def codes(words: list[str], n: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n)

    @staticmethod
    def hashes(codes: np.ndarray, places: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, hashes of the substrings of that length at the first ``places`` starts) in turn."""
        longer = np.zeros((len(codes), min(places, codes.shape[1])), np.uint64)
        for n in range(1, codes.shape[1] + 1):
            longer = longer[:, :codes.shape[1] - n + 1]
            width = longer.shape[1]
            longer = longer * _BASE + codes[:, n - 1:n - 1 + width].astype(np.uint64) + np.uint64(1)
            yield n, _mix(longer + np.uint64(n))

    def at(self, codes: np.ndarray, places: int) -> list[tuple[int, int, np.ndarray]]:
        """(start, length, piece ids or -1 by word) at the first ``places`` starts, in order."""
        out = {}
        for n, h in self.hashes(codes, places):
            if n > self.longest:
                break
            if n not in self.keys:
                continue
            keys = self.keys[n]
            rows, starts = np.nonzero(self.maybe[n][h >> np.uint64(64 - MAYBE_BITS)])  # few others pass
            asked = h[rows, starts]
            where = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            right = keys[where] == asked
            ids = np.full(h.shape, -1, np.int32)
            ids[rows[right], starts[right]] = self.ids[n][where[right]]
            for start in np.flatnonzero((ids >= 0).any(0)).tolist():
                out[start, n] = ids[:, start]
        for start in range(places):  # a character that is no piece
            one = out.get((start, 1), np.full(len(codes), -1, np.int32))
            out[start, 1] = np.where(one < 0, self.size - 1, one)
        return [(start, n, ids) for (start, n), ids in sorted(out.items(), key=lambda e: e[0])]

    def blocks(self, codes: np.ndarray, backward: bool = False) -> Iterator[tuple[int, list]]:
        """(first place, what ``at`` finds) of consecutive blocks of places, or from the last one back."""
        firsts = range(0, codes.shape[1], BLOCK)
        for first in reversed(firsts) if backward else firsts:
            places = min(BLOCK, codes.shape[1] - first)
            yield first, self.at(codes[:, first:first + places + self.longest - 1], places)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, characters) of the words with their start marked, for each length."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w) + 1, []).append(i)
    for n, at in groups.items():
        yield np.array(at), Pieces.codes([START + words[i] for i in at], n)


def _rescale(sums: np.ndarray, log: np.ndarray) -> None:
    """Divide pending sums (places, words, models) by their largest; ``log`` takes its logarithm."""
    top = sums.max(0)
    sums /= top
    log += np.log(top)


def forward(pieces: Pieces, codes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations, (words, models). ``p``: (pieces, models)."""
    n_words, length = codes.shape
    log = np.zeros((n_words, p.shape[1]))
    ahead = pieces.longest + 1
    tail = np.zeros((ahead, n_words, p.shape[1]))  # sums at a block's first place and the next ones
    tail[0] = 1
    for first, found in pieces.blocks(codes):
        places = min(BLOCK, length - first)
        alpha = np.zeros((places + ahead, n_words, p.shape[1]))
        alpha[:ahead] = tail
        last = -1
        for start, n, ids in found:
            if start != last and start % RESCALE == 0 and start + first:
                _rescale(alpha[start:start + ahead], log)
            last = start
            if n == 1:  # every word has an entry
                alpha[start + 1] += alpha[start] * p[ids]
            else:
                hit = np.flatnonzero(ids >= 0)
                alpha[start + n][hit] += alpha[start][hit] * p[ids[hit]]
        tail = alpha[places:places + ahead]
    return np.log(tail[0]) + log


def word_scores(pieces: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """log probability of each word in each model."""
    out = np.zeros((len(words), p.shape[1]))
    for at, codes in by_length(words):
        out[at] = forward(pieces, codes, p)
    return out


def expected_counts(pieces: Pieces, words: list[str], weights: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Expected piece counts under ``start``; ``weights``: (words, languages).

    The forward pass keeps each place's sums with the logarithm of their scale; the backward
    pass holds only what the longest piece reaches."""
    out = np.zeros((pieces.size, weights.shape[1]))
    p, ahead = start[:, None], pieces.longest + 1
    for at, codes in by_length(words):
        n_words, length = codes.shape
        alpha = np.zeros((length + ahead, n_words, 1))
        alpha[0] = 1
        log, scales = np.zeros((n_words, 1)), [np.zeros((n_words, 1))]
        held = list(pieces.blocks(codes)) if length <= BLOCK else None
        for first, found in held or pieces.blocks(codes):
            last = -1
            for begin, n, ids in found:
                here = first + begin
                if begin != last and here % RESCALE == 0 and here:
                    _rescale(alpha[here:here + ahead], log)
                    scales.append(log.copy())
                last = begin
                hit = np.flatnonzero(ids >= 0)
                alpha[here + n][hit] += alpha[here][hit] * p[ids[hit]]
        total = np.log(alpha[length]) + log
        beta = np.zeros((ahead, n_words, 1))  # beta[i]: the place i behind the present one
        beta[1] = 1
        back = np.zeros((n_words, 1))
        for first, found in held or pieces.blocks(codes, backward=True):
            last = None
            for begin, n, ids in reversed(found):
                here = first + begin
                if begin != last:
                    if last is not None or here < length - 1:
                        beta[1:] = beta[:-1].copy()
                    beta[0] = 0
                    if here % RESCALE == RESCALE - 1:
                        _rescale(beta[1:], back)
                    factor = alpha[here] * np.exp(scales[here // RESCALE] + back - total)
                    last = begin
                hit = np.flatnonzero(ids >= 0)
                onward = p[ids[hit]] * beta[n][hit]
                beta[0][hit] += onward
                share = (factor[hit] * onward)[:, 0]
                for k in range(weights.shape[1]):
                    out[:, k] += np.bincount(ids[hit], share * weights[at[hit], k], pieces.size)
    return out


def neutral_start(pieces: Pieces) -> np.ndarray:
    """Longer pieces are likelier than the product of their parts."""
    length = np.array([len(pieces.texts[i]) for i in range(pieces.size - 1)] + [1])
    p = np.exp(-1.5 * length.astype(float))
    p[-1] *= 1e-3
    return p / p.sum()


class Model:
    """Languages, their piece probabilities and their shares of the training words."""

    def __init__(self, vocabulary: list[str], languages: list[str], counts: np.ndarray):
        self.vocabulary, self.languages = vocabulary, languages
        held = counts + SMOOTHING
        self.p = held / held.sum(0)


def learn(docs: DataFrame, vocabulary: list[str], lang: str = "lang", text: str = "text") -> Model:
    """Expected piece counts of all rows with a language; collects vocabulary * languages numbers."""
    spark = docs.sparkSession
    prepare(spark)
    known = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(known.value)
        start = neutral_start(pieces)
        sums: dict[str, np.ndarray] = {}
        words: dict[str, int] = {}
        seen: dict[str, np.ndarray] = {}  # by language, how often each word came

        def flush() -> None:
            weights = np.stack([np.pad(n, (0, len(words) - len(n))) for n in seen.values()], axis=1)
            counts = expected_counts(pieces, list(words), weights.astype(float), start)
            for i, name in enumerate(seen):
                sums[name] = sums.get(name, 0) + counts[:, i]
            words.clear()
            seen.clear()

        for batch in batches:
            for first, texts in text_slices(batch, "text"):
                langs = batch.column(1).slice(first, len(texts)).to_pylist()
                ids: dict[str, list[int]] = {}
                for raw, name in zip(texts, langs, strict=True):
                    ids.setdefault(name, []).extend(
                        [words.setdefault(w, len(words)) for w in find_words(raw.decode().lower())])
                for name, mine in ids.items():
                    n = np.bincount(np.asarray(mine, np.int64), minlength=len(words))
                    old = seen.get(name, n[:0])
                    n[:len(old)] += old
                    seen[name] = n
                if len(words) > WORD_MEMO:
                    flush()
        if seen:
            flush()
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])],
                ["lang", "piece", "n"])

    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sums = rows.mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    held = sums.orderBy("lang", "piece").toPandas()
    languages = sorted(held["lang"].unique())
    counts = np.zeros((len(vocabulary) + 1, len(languages)))
    for k, name in enumerate(languages):
        mine = held[held["lang"] == name]
        counts[mine["piece"].to_numpy(), k] = mine["n"].to_numpy()
    return Model(vocabulary, languages, counts)


def predict(docs: DataFrame, model: Model, held: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row: the likeliest language and its share."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast((model.vocabulary, model.languages, model.p))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, languages, p = sent.value
        pieces = Pieces(vocabulary)
        memo: dict[str, int] = {}
        scores = np.zeros((0, len(languages)))
        for batch in batches:
            for first, texts in text_slices(batch, "text"):
                found = [find_words(raw.decode().lower()) if languages else [] for raw in texts]
                if len(memo) > WORD_MEMO:
                    memo, scores = {}, scores[:0]
                new = [w for w in dict.fromkeys(chain.from_iterable(found)) if w not in memo]
                if new:
                    memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
                    scores = np.concatenate([scores, word_scores(pieces, new, p)])
                names, shares = [], []
                for words in found:
                    if not words:
                        names.append(UNKNOWN)
                        shares.append(0.0)
                        continue
                    total = scores[np.fromiter(map(memo.__getitem__, words), np.int64, len(words))].sum(0)
                    best = int(np.argmax(total))
                    names.append(languages[best])
                    shares.append(float(1 / np.exp(total - total[best]).sum()))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(shares, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return rows.mapInArrow(label, "doc_id bigint, held_out boolean, lang_pred string, score double")
