"""Periodic runs: stretches of words that repeat with a period, four times or more.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), of at least ``max(6, 4 * q)`` words, that no neighbouring word extends keeping q.

* Periods up to ``SHORT`` are found by comparing the words with themselves q places on.
* Longer ones by minimizers, one scale g = 16, 32, 64, ... for the periods in (g/2, g]: the
  places whose hash of g words is least in some window of g/2 places. Inside a run the
  window minima repeat at distance q, since words q apart are identical, and no minimum in
  between has the same hash, since a factor of q or more words occurs only at multiples of
  the smallest period. So each run of the scale has neighbouring equal minimizers at
  distance q; such pairs are extended by comparing words, which also settles the bounds.

Stretches found under several periods are kept with the smallest. Work and memory of a scale
grow with the words of the texts that are long enough for it. A minimizer's hash has 64
bits; pairs are verified, so equal hashes of different words add no run.

Defined results: words are the runs of bytes other than ASCII white space; null and empty
texts have no words and no runs; a row's result depends on its text alone, so repeated rows
have equal results and an empty table an empty one; extra columns stay, but for the four
that are added. Texts are read whole, a few at a time, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failurelens.llm.common import prepare, text_slices
from failurelens.llm.shingles import mix

#: Lags that are compared directly.
SHORT = 8
#: A run has this many periods, and this many words, at least.
TIMES, WORDS = 4, 6
#: A slice of texts is this many bytes or one text.
BYTES = 1 << 20

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
ADDED = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
         T.StructField("n_kept", T.LongType()), T.StructField("collapsed", T.StringType())]
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def lag_runs(ids: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the longest stretches with period ``q`` that are long enough for a run."""
    same = np.flatnonzero(ids[q:] == ids[:-q])
    need = max(WORDS, TIMES * q) - q
    if len(same) < need:
        return same[:0], same[:0]
    full = np.flatnonzero(same[need - 1:] - same[:len(same) - need + 1] == need - 1)
    if not len(full):
        return full, full
    first = np.flatnonzero(np.diff(full, prepend=-2) > 1)
    last = np.append(first[1:], len(full)) - 1
    return same[full[first]], same[full[last] + need - 1] + q + 1


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` (a power of two) neighbours."""
    at = 1
    while at < width:
        values = np.minimum(values[:-at], values[at:])
        at *= 2
    return values


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places whose value is the least of some ``width`` neighbours; equal least ones all count."""
    least = window_least(grams, width)
    pad = np.full(width - 1, ~np.uint64(0))
    # the greatest least value of the windows around a place is its own value, or less
    greatest = ~window_least(np.concatenate([pad, ~least, pad]), width)
    return np.flatnonzero(greatest == grams)


def equal_pairs(grams: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of neighbouring equal minimizers whose distance belongs to the scale."""
    at = minimizers(grams, scale // 2)
    at = at[np.argsort(grams[at], kind="stable")]
    distance = np.where(grams[at[1:]] == grams[at[:-1]], np.diff(at), 0)
    near = np.flatnonzero((distance > scale // 2) & (distance <= scale))
    order = np.lexsort((at[near], distance[near]))
    return at[near][order], distance[near][order]


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries of ``a`` and ``b`` are equal."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        differ = a[done:done + step][:n - done] != b[done:done + step][:n - done]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done += len(differ)
        step *= 2
    return n


def scale_runs(ids: np.ndarray, grams: np.ndarray, scale: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs whose period belongs to the scale."""
    period, reached = 0, 0
    for at, q in zip(*map(np.ndarray.tolist, equal_pairs(grams, scale)), strict=True):
        if q == period and at + q < reached:
            continue
        start = at - agreeing(ids[:at][::-1], ids[q:at + q][::-1])
        end = at + q + agreeing(ids[at:], ids[at + q:])
        period, reached = q, end
        if end - start >= TIMES * q:
            yield start, end, q


def find_runs(ids: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], int]:
    """{(start, end): period} of all runs in texts laid one behind the other.

    Text i has the words ``ids[bounds[i]:bounds[i + 1] - 1]``; the last entry of each is a
    number that occurs once, which no run can hold.
    """
    found: dict[tuple[int, int], int] = {}
    for q in range(1, min(SHORT, len(ids) - 1) + 1):
        for run in zip(*map(np.ndarray.tolist, lag_runs(ids, q)), strict=True):
            found.setdefault(run, q)
    sizes = np.diff(bounds)
    scale, place = 2 * SHORT, np.arange(len(ids))
    grams, width = mix(ids.astype(np.uint64)), 1
    while True:
        # the least run of the scale has TIMES * (scale / 2 + 1) words
        long = sizes > TIMES * (scale // 2 + 1)
        if not long.any():
            return found
        if not long.all():
            mine = np.repeat(long, sizes)
            reach = len(grams)
            ids, place = ids[mine], place[mine]
            # what is left of a text's hashes at its end reaches into the next: it meets nothing
            grams = np.append(grams, np.zeros(len(mine) - reach, np.uint64))[mine][:len(ids) - width + 1]
            sizes = sizes[long]
        while width < scale:
            grams = mix(grams[:-width] * _NEXT + grams[width:])
            width *= 2
        for start, end, q in scale_runs(ids, grams, scale):
            run = int(place[start]), int(place[end - 1]) + 1
            if run not in found or found[run] > q:
                found[run] = q
        scale *= 2


def _texts_runs(texts: list[bytes]) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """(words, runs as (start, length, period) in order) of each text."""
    words = [t.split() for t in texts]
    names: dict[bytes, int] = {}
    bounds = np.cumsum([0, *(len(w) + 1 for w in words)])
    ids = np.empty(bounds[-1], np.int64)
    for i, mine in enumerate(words):
        ids[bounds[i]:bounds[i + 1] - 1] = [names.setdefault(w, len(names)) for w in mine]
    ids[bounds[1:] - 1] = len(names) + np.arange(len(words))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for (start, end), q in sorted(find_runs(ids, bounds).items()):
        i = int(np.searchsorted(bounds, start, "right")) - 1
        runs[i].append((start - int(bounds[i]), end - start, q))
    return words, [sorted(r, key=lambda run: (run[0], run[2])) for r in runs]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(change)[:-1].tolist(), strict=True) if not inside]


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, runs (start, length, period), n_kept and collapsed, the kept words joined by spaces."""
    prepare(docs.sparkSession)
    added = [f.name for f in ADDED]
    kept = [f for f in docs.schema.fields if f.name not in added]
    names = [f.name for f in kept]
    rows = docs.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text}`").alias("_" + "_".join(names + added)))
    read = rows.columns[-1]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch, read, BYTES):
                words, runs = _texts_runs(texts)
                left = [collapse(w, r) for w, r in zip(words, runs, strict=True)]
                flat = np.array([run for r in runs for run in r], np.int64).reshape(-1, 3)
                spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                ends = pa.array(np.cumsum([0, *map(len, runs)]).astype(np.int32))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in range(len(names))]
                    + [pa.array(list(map(len, words)), pa.int64()), pa.ListArray.from_arrays(ends, spans),
                       pa.array(list(map(len, left)), pa.int64()),
                       pa.array([b" ".join(w) for w in left], pa.binary()).cast(pa.string())],
                    names + added)

    return rows.mapInArrow(found, T.StructType(kept + ADDED))


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts in which the report looks, with known repetitions put into a tenth.

    h = crc32(doc_id as text). If h % 10 = 0 and the text has n > 0 words, each word i >= a
    becomes word a + (i - a) % p of the same text, with g = h div 10, a = g % n and
    p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(
        h % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).alias("words"))
    n = F.size("words").cast("long")
    rows = rows.withColumn("n", F.when(n > 0, n)).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.col("g") % F.col("n"))
    rows = rows.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    again = F.expr("transform(words, (w, i) -> if(i < a, w, words[int(a + (i - a) % p)]))")
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties by start, then period (null: no run)."""
    def better(best: Column, run: Column) -> Column:
        # runs come by start, then period, so the first of equal ones stays
        wins = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | wins, run).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words, n_kept)."""
    told = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("best")
    return with_runs(docs).withColumn("best", strongest(F.col("runs"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
        "n_words", "n_kept")
