"""Benchmark passages in training documents, by a distributed positional inverted index.

The index is partitioned by document: each row is the inverted index of one shard (the
consecutive documents that hold some 2 MB of text): for each test term its sorted
positions, on one scale with a gap between documents. It is written once to the shared
folder; term counts over all shards tell each window's rarest terms.

A window (consecutive words of a benchmark item) is found by intersecting its terms'
position lists, each moved back by the term's place in the window, from the rarest list
on. Lists of a shard are intersected where they lie: nothing is shuffled by term, so a
term or passage that a third of all documents hold makes no hot partition.

Benchmark texts are taken in blocks of at most ``BLOCK_BYTES``; each block's terms and
windows are broadcast, and its index holds its own terms only.

Defined results: a null or wordless document has no words and no hits; an item without
words, or with a null id, matches nothing; items of one id count as one item; repeated
documents are each reported; with no benchmark no document is hit; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failurelens.llm.common import prepare, row_key, shared_table, text_slices, unused

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Positions between the documents of a shard; a proximity span must be shorter.
GAP = 256

INDEX = ("doc_ids array<bigint>, text_keys array<bigint>, n_words array<int>, "
         "terms array<int>, counts array<int>, positions array<int>")
FOUND = "doc_id bigint, text_key bigint, n_words bigint, words array<int>, items array<string>"
NEAR = "doc_id bigint, item_id string, start int, length int"

#: A-Z becomes a-z; ASCII that is neither letter nor digit separates words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
                   for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


@dataclass
class Block:
    """Some benchmark items: their terms, and their distinct windows with the items that have them."""

    terms: dict[bytes, int] = field(default_factory=dict)
    windows: dict[tuple[int, ...], set[str]] = field(default_factory=dict)
    whole: dict[str, list[tuple[int, ...]]] = field(default_factory=dict)

    def add(self, item_id: str, text: str | None, width: int) -> None:
        ids = tuple(self.terms.setdefault(w, len(self.terms)) for w in words_of((text or "").encode()))
        if ids:
            self.whole.setdefault(item_id, []).append(ids)
            for i in range(max(1, len(ids) - width + 1)):
                self.windows.setdefault(ids[i:i + width], set()).add(item_id)


def blocks(benchmark: DataFrame, width: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_bytes`` of text, dealt by the items' hash."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        block = Block()
        for item_id, text in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toLocalIterator():
            block.add(item_id, text, width)
        yield block


def build_index(docs: DataFrame, block: Block) -> DataFrame:
    """The positional index of ``docs`` for the terms of ``block``, one row for each shard, written once."""
    spark = docs.sparkSession
    prepare(spark)
    terms = spark.sparkContext.broadcast(block.terms)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch in batches:
            for start, texts in text_slices(batch):
                n_words, ids, at, base = [], [], [], 0
                for raw in texts:
                    words = words_of(raw)
                    found = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
                    where = np.flatnonzero(found >= 0)
                    ids.append(found[where])
                    at.append((where + base).astype(np.int32))
                    n_words.append(len(words))
                    base += len(words) + GAP
                ids, at = np.concatenate(ids), np.concatenate(at)
                order = np.argsort(ids, kind="stable")
                held, counts = np.unique(ids, return_counts=True)
                part = batch.slice(start, len(texts))
                row = [part.column(0).to_pylist(), part.column(1).to_pylist(), n_words,
                       held.astype(np.int32), counts.astype(np.int32), at[order]]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], pa.list_(t)) for v, t in zip(row, types, strict=True)],
                    [c.split()[0] for c in INDEX.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key()[1], "text")
    return shared_table(rows.mapInArrow(shards, INDEX), "positions")


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Occurrences of each term over all shards; as many numbers as the block has terms."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    sums = pairs.groupBy("t.terms").agg(F.sum("t.counts").alias("n")).collect()
    out = np.zeros(n_terms, np.int64)
    for term, n in sums:
        out[term] = n
    return out


class Shard:
    """One row of the index, opened."""

    def __init__(self, row: dict, n_terms: int):
        self.doc_ids, self.text_keys = row["doc_ids"], row["text_keys"]
        self.n_words = np.asarray(row["n_words"], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.n_words + GAP)])
        held, counts = np.asarray(row["terms"], np.int64), np.asarray(row["counts"], np.int64)
        self.positions = np.asarray(row["positions"], np.int64)
        self.first = np.zeros(n_terms, np.int64)
        self.count = np.zeros(n_terms, np.int64)
        self.first[held] = np.cumsum(counts) - counts
        self.count[held] = counts
        self.term_at = np.full(self.base[-1] + GAP, -1, np.int32)
        self.term_at[self.positions] = np.repeat(held, counts)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The position lists of ``terms`` one after the other, and which of them each position is from."""
        n = self.count[terms]
        which = np.repeat(np.arange(len(terms)), n)
        skip = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return self.positions[self.first[terms][which] + skip], which

    def phrases(self, terms: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, phrase) of all occurrences. ``terms``, ``places``: a row for each phrase, rarest first, -1 ends it."""
        present = np.flatnonzero(((self.count[terms] > 0) | (terms < 0)).all(1))
        if not len(present):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        start, which = self.lists(terms[present, 0])
        which = present[which]
        start = start - places[which, 0]
        ok = start >= 0
        start, which = start[ok], which[ok]
        for k in range(1, terms.shape[1]):
            more = terms[which, k] >= 0
            # a start stays if the next term's list, moved back by its place, holds it
            ok = ~more | (self.term_at[np.where(more, start + places[which, k], 0)] == terms[which, k])
            start, which = start[ok], which[ok]
        return start, which


def _rarest_first(phrases: list[tuple[int, ...]], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, terms, places) of the phrases whose terms all occur, each from its rarest term on."""
    width = max(map(len, phrases), default=1)
    terms = np.full((len(phrases), width), -1, np.int32)
    for i, p in enumerate(phrases):
        terms[i, :len(p)] = p
    n = np.where(terms >= 0, counts[terms], np.iinfo(np.int64).max)
    which = np.flatnonzero((n > 0).all(1))
    places = np.argsort(n[which], axis=1, kind="stable")
    return which, np.take_along_axis(terms[which], places, 1), places.astype(np.int32)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].values.to_numpy(zero_copy_only=False) if name not in ("doc_ids", "text_keys")
                   else column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def phrase_hits(index: DataFrame, block: Block) -> DataFrame:
    """For each document its words inside an occurrence of a window, and the items of these windows."""
    spark = index.sparkSession
    windows = list(block.windows)
    which, terms, places = _rarest_first(windows, term_counts(index, max(1, len(block.terms))))
    query = spark.sparkContext.broadcast(
        (max(1, len(block.terms)), terms, places, np.array([len(windows[i]) for i in which], np.int64),
         [sorted(block.windows[windows[i]]) for i in which]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms, terms, places, length, items = query.value
        for row in _rows_of(batches):
            shard = Shard(row, n_terms)
            start, found = shard.phrases(terms, places)
            doc = np.searchsorted(shard.base, start, "right") - 1
            size = length[found]
            flat = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            flat = np.unique(flat)
            owner = np.searchsorted(shard.base, flat, "right") - 1
            ends = np.searchsorted(owner, np.arange(len(shard.n_words) + 1))
            named: dict[int, set[str]] = {}
            for d, w in set(zip(doc.tolist(), found.tolist(), strict=True)):
                named.setdefault(d, set()).update(items[w])
            words = [(flat[ends[d]:ends[d + 1]] - shard.base[d]).astype(np.int32) for d in range(len(shard.n_words))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.doc_ids, pa.int64()), pa.array(shard.text_keys, pa.int64()), pa.array(shard.n_words),
                 pa.array(words, pa.list_(pa.int32())),
                 pa.array([sorted(named.get(d, ())) for d in range(len(words))], pa.list_(pa.string()))],
                [c.split()[0] for c in FOUND.split(", ")])

    return index.mapInArrow(search, FOUND)


def proximity_matches(index: DataFrame, block: Block, span: int) -> DataFrame:
    """(doc_id, item_id, start, length): each occurrence of an item's rarest term whose shortest
    stretch with all the item's terms, in any order, is at most ``span`` words long."""
    if span > GAP:
        raise ValueError(f"span {span} exceeds {GAP}")
    sets = [(item, tuple(sorted(set(ids)))) for item, texts in sorted(block.whole.items()) for ids in texts]
    sets = [(item, ids) for item, ids in sets if len(ids) <= span]
    which, terms, _ = _rarest_first([ids for _, ids in sets], term_counts(index, max(1, len(block.terms))))
    query = index.sparkSession.sparkContext.broadcast((max(1, len(block.terms)), terms, [sets[i][0] for i in which]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms, terms, items = query.value
        for row in _rows_of(batches):
            shard, out = Shard(row, n_terms), []
            for i in np.flatnonzero(((shard.count[terms] > 0) | (terms < 0)).all(1)):
                lists = [shard.positions[shard.first[t]:shard.first[t] + shard.count[t]] for t in terms[i] if t >= 0]
                for p in lists[0].tolist():
                    best = shortest_stretch(p, lists[1:], span)
                    if best:
                        doc = int(np.searchsorted(shard.base, best[0], "right")) - 1
                        out.append((shard.doc_ids[doc], items[i], best[0] - int(shard.base[doc]), best[1] - best[0] + 1))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             [c.split()[0] for c in NEAR.split(", ")])

    return index.mapInArrow(search, NEAR)


def shortest_stretch(p: int, lists: list[np.ndarray], span: int) -> tuple[int, int] | None:
    """The shortest (first, last) around ``p`` with a position of each list, at most ``span`` long; the first if tied."""
    near = [x[np.searchsorted(x, p - span + 1):np.searchsorted(x, p + span)] for x in lists]
    if any(not len(x) for x in near):
        return None
    best = None
    for first in sorted({p, *(int(v) for x in near for v in x if v < p)}):
        after = [x[np.searchsorted(x, first):] for x in near]
        if any(not len(x) for x in after):
            break
        last = max(p, *(int(x[0]) for x in after)) if after else p
        if last - first < span and (best is None or last - first < best[1] - best[0]):
            best = (first, last)
    return best


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of ``docs``: doc_id, text_key, n_words, words (places of hit words), items (ids found)."""
    parts = [phrase_hits(build_index(docs, block), block) for block in blocks(benchmark, width, block_bytes)]
    if len(parts) == 1:
        return parts[0]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    merged = found.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        (F.count(F.lit(1)) / len(parts)).cast("int").alias("rows"))
    return (merged.withColumn("row", F.explode(F.sequence(F.lit(1), "rows")))
            .select("doc_id", "text_key", "n_words", "words", "items"))


def report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The contract's columns, one row for each document."""
    found = contamination(docs, benchmark, width)
    return found.select(
        "doc_id", "n_words", F.size("words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("words") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, all columns as they were."""
    bad = contamination(docs, benchmark, width).filter(F.size("words") > 0)
    own, named, key = (unused(docs, c) for c in ("own_key", "bad_id", "bad_key"))
    bad = bad.select(F.col("doc_id").alias(named), F.col("text_key").alias(key)).distinct()
    tagged = docs.withColumn(own, row_key()[1])
    same = tagged["doc_id"].cast("long").eqNullSafe(bad[named]) & (tagged[own] == bad[key])
    return tagged.join(bad, same, "left_anti").drop(own)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS iid, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT iid, least(len(w), {WINDOW}) AS n,
         unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2),
                               lambda i: array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM bw
), d AS (SELECT doc_id, {_WORDS} AS w FROM documents
), grams AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i,
         unnest(list_transform(range(1, len(w) - n + 2), lambda j: array_to_string(w[j:j + n - 1], ' '))) AS g
  FROM d, lens WHERE len(w) >= n
), hit AS (
  SELECT doc_id, i, n, iid FROM grams JOIN bw USING (n, g)
), hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(iid, ',' ORDER BY iid) AS ids
  FROM (SELECT DISTINCT doc_id, iid FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
