"""Repeated passages across documents, by compressed FM-indexes of content-made shards.

A window of ``width`` words has one *anchor*: the least hash among its runs of ``GRAM``
words. Equal windows have equal anchors, so whatever repeats can be found shard by shard,
each shard holding some anchors' surroundings:

1. all documents' anchors are gathered by hash, and those that only one text has are
   dropped; nothing repeats there;
2. the surroundings of the others (all windows that share the anchor, as one segment of at
   most 2 * width - GRAM words) are dealt by anchor. Equal segments are one, with the
   smallest id of a document that has it;
3. a task cuts its segments, in order of anchor, into shards of about ``SHARD_WORDS`` words
   and builds a compressed FM-index of each. The segments are streamed against it: backward
   search over wavelet matrices gives their matching statistics, and each place with a
   match of a whole window gets the smallest id among the index's documents that have it;
4. windows that a smaller id has too go back to their documents as intervals.

Copies of one whole text are taken once, under their smallest id: all windows of the
others repeat. An anchor that occurs in several texts of a slice is known to repeat, so
the slice sends one row for it and spreads its places by hash: a passage that a third of
all documents hold makes no large group.

Defined results: a null or wordless text has no words, and of fewer than ``width`` words
nothing is removed; a null id counts as larger than any other; rows of one id never make
each other's windows repeat; repeated rows get equal results; extra columns are ignored.
Texts are told apart by two hashes of 64 bits with different seeds. Where texts agree in
the first alone, all anchors of theirs count as repeating, so nothing is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failurelens.llm.common import prepare, row_key, shared_table, text_slices
from failurelens.llm.fm_index import FmIndex
from failurelens.llm.shingles import mix, sequence_hashes, word_hashes

WIDTH = 13
GRAM = 5
SHARD_WORDS = 250_000
#: First hashes that stand for several texts; more are an error.
MAX_SHARED = 10_000
#: Low bits of a run's hash that give way to its place within a piece, so that the least is also the first.
PLACE_BITS = 24


def _first_least(grams: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of each ``span`` consecutive hashes, of a piece whose places fit PLACE_BITS."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    n = 1
    while n < span:
        step = min(n, span - n)
        least = np.minimum(least[:-step], least[step:])
        n += step
    return (least & low).astype(np.int64)


def anchors(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place of each window, distinct places, their hashes) of hashed words.

    A longer text is taken in pieces that overlap by a window; within a piece the order of
    places is that of the text, so the anchors are those of the text taken at once.
    """
    grams = sequence_hashes(words, GRAM)
    span = width - GRAM + 1
    if len(grams) < span:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64)
    piece = (1 << PLACE_BITS) - span + 1
    of = np.concatenate([_first_least(grams[i:i + piece + span - 1], span) + i for i in range(0, len(grams) - span + 1, piece)])
    places = of[np.flatnonzero(np.diff(of, prepend=-1))]
    return of, places, grams[places]


def _several(keys: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by key and text, whether each row in that order has a key of several texts)."""
    order = np.lexsort((texts, keys))
    k, t = keys[order], texts[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    ends = np.append(starts[1:], len(k))
    return order, np.repeat(t[starts] != t[ends - 1], ends - starts)


def anchor_rows(rows: DataFrame, width: int) -> DataFrame:
    """(key, text_key, place): place -1 only witnesses that the text has the anchor; below -1 the
    anchor is known to repeat, the place is -2 - place and the key any number. The anchors of
    rows that are ``shared`` (their key is that of different texts) count as known."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch):
                ids, shared = (batch.column(c).slice(start, len(texts)).to_pylist() for c in (0, 2))
                once = {(i, raw if s else None): raw for i, raw, s in zip(ids, texts, shared, strict=True)}  # a text once
                found = [anchors(words, width)[1:] for words in word_hashes(list(once.values()))]
                keys = np.concatenate([k for _, k in found]).view(np.int64)
                if not len(keys):
                    continue
                places = np.concatenate([p for p, _ in found])
                sizes = [len(p) for p, _ in found]
                owners = np.repeat(np.array([i for i, _ in once], np.int64), sizes)
                order, known = _several(keys, owners)
                keys, places, owners = keys[order], places[order], owners[order]
                if any(shared):
                    known |= np.repeat([raw is not None for _, raw in once], sizes)[order]
                # a known key's first and last row, which are of different texts, witness it
                edge = keys[1:] != keys[:-1]
                witness = known & (np.concatenate([[True], edge]) | np.concatenate([edge, [True]]))
                spread = mix(owners.view(np.uint64) + places.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.where(known, spread, keys), keys[witness]])),
                     pa.array(np.concatenate([owners, owners[witness]])),
                     pa.array(np.concatenate([np.where(known, -2 - places, places),
                                              np.full(witness.sum(), -1)]).astype(np.int32))],
                    ["key", "text_key", "place"])

    return rows.select("text_key", "text", "shared").mapInArrow(scan, "key bigint, text_key bigint, place int")


def repeated_places(found: DataFrame) -> DataFrame:
    """(text_key, places): the anchors of each text that other texts have too."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of key; the last key of a batch waits for the next."""
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]

        def told(rows: list[np.ndarray]) -> pa.RecordBatch:
            order, several = _several(rows[0], rows[1])
            kept = order[several & (rows[2][order] >= 0)]
            return pa.RecordBatch.from_arrays([pa.array(rows[1][kept]), pa.array(rows[2][kept])], ["text_key", "place"])

        for batch in batches:
            key, text, place = (c.to_numpy() for c in batch.columns)
            known = place < -1
            yield pa.RecordBatch.from_arrays([pa.array(text[known]), pa.array(-2 - place[known])], ["text_key", "place"])
            rows = [np.concatenate([h, v[~known]]) for h, v in zip(held, (key, text, place), strict=True)]
            if len(rows[0]):
                cut = np.searchsorted(rows[0], rows[0][-1])
                if cut:
                    yield told([v[:cut] for v in rows])
                held = _fewer([v[cut:] for v in rows])
        if len(held[0]):
            yield told(held)

    def _fewer(rows: list[np.ndarray]) -> list[np.ndarray]:
        """Equal rows of the waiting key once."""
        order = np.lexsort((rows[2], rows[1]))
        text, place = rows[1][order], rows[2][order]
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] != place[:-1])])
        return [v[order][new] for v in rows]

    merged = found.repartition("key").sortWithinPartitions("key").mapInArrow(merge, "text_key bigint, place int")
    return merged.distinct().groupBy("text_key").agg(F.collect_list("place").alias("places"))


PLACES = "doc_key bigint, text_key bigint, check_key bigint, anchor bigint, words_key bigint, start int"
#: What tells a row from others: its id and two hashes of its text.
ROW = ["doc_key", "text_key", "check_key"]
DISTINCT = "anchor bigint, words_key bigint, words binary, first bigint, last bigint"


def segments(held: DataFrame, width: int, distinct: bool) -> DataFrame:
    """The segments around the anchors ``places`` of each text.

    Either where they are (PLACES), or each once for a slice, with the least and greatest
    id that has it (DISTINCT), so that a slice sends one row for a segment however many
    of its documents share it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch):
                out: list[tuple] = []
                seen: dict[tuple[int, bytes], list[int]] = {}
                for j, (raw, hashed) in enumerate(zip(texts, word_hashes(texts), strict=True), start):
                    of, places, keys = anchors(hashed, width)
                    wanted = np.isin(places, batch.column(4)[j].values.to_numpy())
                    if not wanted.any():
                        continue
                    row, words = tuple(batch.column(c)[j].as_py() for c in range(3)), raw.split()
                    first = np.searchsorted(of, places[wanted]).tolist()
                    last = (np.searchsorted(of, places[wanted], "right") - 1 + width).tolist()
                    for key, b, e in zip(keys[wanted].view(np.int64).tolist(), first, last, strict=True):
                        segment = b" ".join(words[b:e])
                        if distinct:
                            ends = seen.setdefault((key, segment), [row[0], row[0]])
                            ends[0], ends[1] = min(ends[0], row[0]), max(ends[1], row[0])
                        else:
                            out.append((*row, key, _words_key(segment), b))
                if distinct:
                    out = [(key, _words_key(words), words, *ends) for (key, words), ends in seen.items()]
                fields = (DISTINCT if distinct else PLACES).split(", ")
                columns = list(zip(*out, strict=True)) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[f.split()[1]]) for c, f in zip(columns, fields, strict=True)],
                                                 [f.split()[0] for f in fields])

    # all columns go in, for both kinds to share one shuffle of the texts
    return held.select(*ROW, "text", "places", "doc_id").mapInArrow(cut, DISTINCT if distinct else PLACES)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _words_key(segment: bytes) -> int:
    """Names a segment beside its anchor, as a signed 64-bit hash."""
    return xxhash.xxh64_intdigest(segment) - (1 << 63)


def repeats(parts: DataFrame, width: int) -> DataFrame:
    """(anchor, words_key, least): for each window of a segment the smallest id that has it."""
    # dealt by anchor once: equal segments merge where their shard is made
    distinct = (parts.repartition("anchor").groupBy("anchor", "words_key", "words")
                .agg(F.min("first").alias("first"), F.max("last").alias("last")))

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        hashed = word_hashes([r[2] for r in rows])
        lengths = np.array([len(h) for h in hashed])
        numbers = np.unique(np.concatenate(hashed), return_inverse=True)[1].ravel() + 1
        # after each segment a separator
        text = np.zeros(len(numbers) + len(rows), np.int64)
        owner = np.repeat(np.arange(len(rows)), lengths + 1)
        text[np.arange(len(numbers)) + np.repeat(np.arange(len(rows)), lengths)] = numbers
        index = FmIndex(text, width)
        least = index.least(np.array([r[3] for r in rows])[owner], width)
        queries = np.zeros((len(rows), int(lengths.max())), np.int64)
        queries[np.arange(queries.shape[1]) < lengths[:, None]] = numbers
        match, where = index.matching_statistics(queries, lengths)
        found = np.where(match >= width, least[where], np.iinfo(np.int64).max)
        wanted = [f[:n - width + 1] for f, n in zip(found, lengths, strict=True)]
        some = [i for i, (f, r) in enumerate(zip(wanted, rows, strict=True)) if (f < r[4]).any()]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in some], pa.int64()), pa.array([rows[i][1] for i in some], pa.int64()),
             pa.array([wanted[i] for i in some], pa.list_(pa.int64()))], ["anchor", "words_key", "least"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= SHARD_WORDS and row[0] != rows[-1][0]:
                    yield shard(rows)
                    rows, held = [], 0
                rows.append(row)
                held += row[2].count(b" ") + 2
        if rows:
            yield shard(rows)

    return (distinct.sortWithinPartitions("anchor")
            .select("anchor", "words_key", "words", "first", "last")
            .mapInArrow(search, "anchor bigint, words_key bigint, least array<bigint>"))


def _check_key(text: Column) -> Column:
    """A second hash of a text, from another seed."""
    return F.xxhash64(F.lit("check"), text)


def removed_words(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text, copy, starts) of every row: whether all its windows repeat, or else where those begin that do."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(),
                       F.coalesce("text", F.lit("")).alias("text")).withColumn("check_key", _check_key(F.col("text")))
    firsts = shared_table(rows.groupBy("text_key", "check_key").agg(F.min("doc_key").alias("first")), "first-ids")
    clash = firsts.groupBy("text_key").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("text_key")
    # 64-bit keys of different texts: 300 among 10^11 texts; were there many, the keys would be no hashes
    clash = [r[0] for r in clash.limit(MAX_SHARED + 1).collect()]
    if len(clash) > MAX_SHARED:
        raise ValueError(f"over {MAX_SHARED} text keys stand for several texts")
    known = rows.withColumn("shared", F.col("text_key").isin(clash) if clash else F.lit(False))
    places = shared_table(repeated_places(anchor_rows(known, width)).join(firsts, "text_key")
                          .select(F.col("first").alias("doc_key"), "text_key", "check_key", "places"), "anchor-places")
    # one shuffle of the texts by row serves both the segments and the result
    dealt = rows.repartition(*ROW)
    held = dealt.join(places, ROW).select(*ROW, "doc_id", "text", "places")
    least = repeats(segments(held, width, distinct=True), width)
    back = (segments(held, width, distinct=False).join(least, ["anchor", "words_key"])
            .withColumn("starts", F.filter(
                F.transform("least", lambda v, i: F.when(v < F.col("doc_key"), F.col("start") + i)), lambda s: s.isNotNull()))
            .filter(F.size("starts") > 0)
            .groupBy(*ROW).agg(F.flatten(F.collect_list("starts")).alias("starts")))
    copies = (rows.select(*ROW).join(firsts, ["text_key", "check_key"]).filter("doc_key > first")
              .select(*ROW).distinct().withColumn("copy", F.lit(True)))
    return (dealt.join(back, ROW, "left").join(copies, ROW, "left")
            .select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts"))


def report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row; ``kept`` is the text that stays."""

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch):
                counts, gone, kept = [], [], []
                for j, raw in enumerate(texts, start):
                    words = raw.split()
                    n, starts = len(words), batch.column(3)[j].values
                    if batch.column(2)[j].as_py() and n >= width:
                        words = []
                    elif starts is not None and len(starts):
                        edge = np.zeros(n + 1, np.int32)
                        at = np.unique(starts.to_numpy())
                        edge[at] += 1
                        edge[at + width] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                    counts.append(n)
                    gone.append(n - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return removed_words(docs, width).mapInArrow(
        strike, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


ORACLE = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - {WIDTH - 2})) AS i,
         unnest(list_transform(range(1, len(w) - {WIDTH - 2}), lambda j: array_to_string(w[j:j + {WIDTH - 1}], ' '))) AS g
  FROM w WHERE len(w) >= {WIDTH}
), first AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS k FROM win JOIN first USING (g) WHERE f < doc_id
), gone_of AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda v, p: NOT list_contains(coalesce(ks, []), p)), ' ')) AS kept_sha256
FROM w LEFT JOIN gone_of USING (doc_id)
"""
