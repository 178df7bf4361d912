"""Exact n-gram Jaccard join by token-combination prefixes.

Tokens are hashed word shingles. All documents' tokens are counted in 2**18 classes (by
hash); tokens are ordered by their class's count, rarest first. Two sets with Jaccard
similarity of at least t share a token among the first n - ceil(t n) + 1 of each, and two
tokens among the first n - ceil(t n) + 2. So if the first token they share is

* of a rare class, the index entry of this single token brings them together;
* of a frequent class, so are all others they share (the order puts these last): sets of
  up to ``PAIR_SIZE`` tokens meet in an entry for two tokens at once, larger sets in the
  single token's entry. Sets near that size have both, so a pair always has a kind in common.

Frequent tokens thus bring together only sets that share two of them.

Sets that are equal are one class, represented by its smallest id. Links are found in two
rounds, so that a group of near copies costs about its size, not its square:

1. each entry's members are compared with its smallest member (the hub);
2. components are formed; where an entry still holds members of different components, they
   are compared as a matrix inside a task. Of the near pairs only a spanning forest over the
   components goes on to be verified, the nearest pairs first, so an entry sends fewer pairs
   than it has members (``TURNS`` of these; later ones take pairs by hash). In entries that held
   more near pairs, those of members that are then still apart, mostly sets that do not
   link, are verified pair by pair, so no link is lost. Only these grow with the square of a
   group: one of sets that are near by their bitmaps and yet not linked, not even by others.

A pair is compared exactly: size and position bounds, then the distance of parity bitmaps
(a lower bound on the symmetric difference), then the sets themselves.

Defined results: null, empty and wordless texts have no shingles and no links; a null id
has a null component and no links; rows that share an id are one document, linked if any
of their texts is; copies share a component; other columns are ignored or kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failurelens.llm.common import prepare, shared_table, text_slices, unused
from failurelens.llm.shingles import mix, shingle_set, word_hashes

#: Token classes, and the parts in which their counts are summed.
CLASSES = 1 << 18
PARTS = 64
#: A class is frequent if its count is over this many times the mean, and standard deviations above it.
FREQUENT_TIMES, FREQUENT_SIGMAS = 1.5, 6
#: Up to this size, sets are indexed by pairs of frequent tokens.
PAIR_SIZE = 60
BITMAP_BITS = 2048
#: A smaller bitmap goes with the members of entries that are compared as a matrix.
SMALL_BITS = 512
#: Up to so many ids (8 bytes each) of documents to compare are broadcast.
BROADCAST_IDS = 500_000
#: Members of an entry that are compared as one matrix, and turns in which it sends a spanning forest.
BLOCK, TURNS = 1024, 1
#: n and position in one number.
PLACE = 1 << 24


@dataclass(frozen=True)
class Rule:
    """Sets of ``k``-word shingles link if intersection * den >= num * union."""

    k: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: int) -> int:
        """How many of the first tokens of a set of ``n`` suffice to meet every partner once."""
        return n - -(-self.num * n // self.den) + 1

    def most_apart(self, total: np.ndarray) -> np.ndarray:
        """The largest symmetric difference that two linked sets of ``total`` tokens together can have."""
        return total * (self.den - self.num) // (self.den + self.num)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common * self.den >= self.num * (len(a) + len(b) - common)


def _word_sets(batch: pa.RecordBatch, k: int):
    for start, texts in text_slices(batch):
        yield start, [shingle_set(words, k) for words in word_hashes([raw.lower() for raw in texts])]


def _parity(tokens: np.ndarray, bits: int = BITMAP_BITS) -> bytes:
    """A bit for each residue of the tokens: whether an odd number has it."""
    residue = (tokens >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(residue, minlength=bits) & 1).tobytes()


def profile(docs: DataFrame, rule: Rule) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, digest and parity bitmap of the set) of every row, and the token counts by class."""
    prepare(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES, np.int64)
        names = ["doc_id", "n_shingles", "digest", "bitmap", "small", "part", "counts"]
        for batch in batches:
            for start, sets in _word_sets(batch, rule.k):
                every = np.concatenate(sets)
                counts += np.bincount((every & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
                n, digests = len(sets), [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(digests, pa.binary()), pa.array([_parity(s) for s in sets], pa.binary()),
                     pa.array([_parity(s, SMALL_BITS) for s in sets], pa.binary()),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if counts.any():
            rows = [c.tobytes() for c in counts.reshape(PARTS, -1)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.binary()),
                 pa.nulls(PARTS, pa.binary()), pa.nulls(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(rows, pa.binary())], names)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(raw.as_buffer(), np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                ["part", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = shared_table(rows.mapInArrow(scan, "doc_id bigint, n_shingles bigint, digest binary, bitmap binary, small binary, part int, "
                                              "counts binary"), "shingle-profile")
    sums = (seen.filter("part is not null").select("part", "counts").repartition(PARTS, "part")
            .mapInArrow(add_up, "part int, counts binary").collect())
    counts = np.zeros((PARTS, CLASSES // PARTS), np.int64)
    for part, raw in sums:
        counts[part] = np.frombuffer(raw, np.int64)
    return seen.filter("part is null").drop("part", "counts"), counts.ravel()


def index_entries(docs: DataFrame, rule: Rule, counts: np.ndarray) -> DataFrame:
    """(key, id, place): the index entries of each document; place holds the set's size and the token's rank."""
    mean = counts.mean()
    frequent = max(FREQUENT_TIMES * mean, mean + FREQUENT_SIGMAS * mean ** 0.5) + 2
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def entries_of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = sent.value[(tokens & np.uint64(CLASSES - 1)).astype(np.int64)]
        n, first = len(tokens), rule.prefix(len(tokens))
        order = np.lexsort((tokens, count))[:first + 1]
        tokens, rare = tokens[order], count[order] <= frequent
        rank = np.arange(len(order))
        alone = (rank < first) & (rare | (n > PAIR_SIZE))
        keys, places = [tokens[alone]], [rank[alone]]
        if n * rule.num <= PAIR_SIZE * rule.den:
            often = tokens[~rare]
            i, j = np.triu_indices(len(often), 1)
            low, high = np.minimum(often[i], often[j]), np.maximum(often[i], often[j])
            keys.append(mix(low * np.uint64(3) + mix(high)))
            places.append(np.full(len(i), PLACE - 1))
        return np.concatenate(keys).view(np.int64), np.concatenate(places) + n * PLACE

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, sets in _word_sets(batch, rule.k):
                ids = batch.column(0).slice(start, len(sets)).to_numpy(zero_copy_only=False)
                found = [(i, *entries_of(s)) for i, s in zip(ids, sets, strict=True) if len(s)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([k for _, k, _ in found])),
                         pa.array(np.repeat([i for i, _, _ in found], [len(k) for _, k, _ in found])),
                         pa.array(np.concatenate([p for _, _, p in found]))], ["key", "id", "place"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return rows.mapInArrow(scan, "key bigint, id bigint, place bigint")


def shared_entries(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """The entries whose key brings different classes together, by class: (key, rep, place), written once."""
    spread = entries.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    # copies meet in every key: only what holds different sets goes on
    some = entries.join(spread.select("key"), "key").join(classes, "id").select("key", "rep", "place").distinct()
    held = shared_table(some, "shared-entries")
    spread = held.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("high")).filter("hub < high")
    return held.join(spread.select("key", "hub"), "key")


def texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, text) of the documents in ``pairs``, written once. Up to BROADCAST_IDS ids are broadcast
    to the scan; more are joined by a shuffle."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    few = len(ids.limit(BROADCAST_IDS + 1).select(F.lit(1)).take(BROADCAST_IDS + 1)) <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return shared_table(rows.join(F.broadcast(ids) if few else ids, "id", "left_semi"), "pair-texts")


def near_enough(a: str, b: str, rule: Rule):
    """Whether two places (size and rank of a shared token) allow the similarity."""
    n_a, n_b = F.expr(f"{a} div {PLACE}"), F.expr(f"{b} div {PLACE}")
    r_a, r_b = F.expr(f"{a} % {PLACE}"), F.expr(f"{b} % {PLACE}")
    sizes = (F.least(n_a, n_b) * rule.den >= F.greatest(n_a, n_b) * rule.num)
    most = F.least(r_a, r_b) + 1 + F.least(n_a - r_a, n_b - r_b) - 1
    ranked = (r_a == PLACE - 1) | (r_b == PLACE - 1)
    return sizes & (ranked | (most * (rule.num + rule.den) >= (n_a + n_b) * rule.num))


def near_bitmaps(pairs: DataFrame, profiles: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow the similarity."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, map_a, map_b = batch.columns
            bits = [np.frombuffer(b"".join(m.to_pylist()), np.uint64).reshape(-1, BITMAP_BITS // 64) for m in (map_a, map_b)]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64)
            kept = pa.array(apart <= rule.most_apart(n_a.to_numpy() + n_b.to_numpy()))
            yield pa.RecordBatch.from_arrays([a.filter(kept), b.filter(kept)], ["a", "b"])

    side = lambda c: profiles.select(
        F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("bitmap").alias(f"bitmap_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b")
    return both.mapInArrow(near, "a bigint, b bigint").distinct()


def verified(close: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sets, of their whole texts, link."""

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hub, held, kept = None, None, []  # rows of one b mostly follow each other
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != hub:
                    hub, held = b, {}
                sets = []
                for text in (x, y):
                    raw = (text.as_py() or "").encode()
                    key = hashlib.blake2b(raw, digest_size=16).digest()
                    if key not in held:
                        held[key] = shingle_set(word_hashes([raw.lower()])[0], rule.k)
                    sets.append(held[key])
                    if len(held) > 64:
                        held = {}
                kept.append(rule.linked(*sets))
            kept = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    close = shared_table(close, "close-pairs")
    texts = texts_of(docs, close)
    text = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    whole = (close.join(text("a"), "a").join(text("b"), "b")
             .select("a", "b", "text_a", "text_b").mapInArrow(by_text, "a bigint, b bigint"))
    return shared_table(whole.distinct(), "links")


def spanning(labels: np.ndarray, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> list[int]:
    """The places in ``order`` of a forest: pairs (i, j) of members that join labels not yet joined."""
    names, local = np.unique(labels, return_inverse=True)
    parent, left, kept = list(range(len(names))), len(names) - 1, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for e, x, y in zip(order.tolist(), local[i[order]].tolist(), local[j[order]].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            kept.append(e)
            left -= 1
            if not left:
                break
    return kept


def across_labels(told: DataFrame, profiles: DataFrame, rule: Rule, turn: int | None) -> DataFrame:
    """(key, a, b): pairs with a common entry and different labels that sizes, ranks and bitmaps allow.

    An entry's members meet in blocks of about ``BLOCK``; a larger entry's blocks meet two
    by two in groups of their own. A group is compared as a matrix. With a ``turn`` only a
    spanning forest of its near pairs leaves it, and the keys of groups that held more come
    as rows without a pair; without, all near pairs do. Pairs have a null key.
    """
    spread = (told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("m"))
              .filter("low < high").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (told.join(spread, "key").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                     "own", "rep", "label", "place"))
    maps = profiles.select(F.col("doc_id").alias("rep"), "small").filter("doc_id is not null")
    grouped = (dealt.join(maps, "rep").withColumn("at", F.xxhash64("key", "low", "high"))
               .repartition("at").sortWithinPartitions("at", "key", "low", "high")
               .select("key", "low", "high", "own", "rep", "label", "place", "small"))

    def meet(group: tuple) -> tuple[np.ndarray, np.ndarray, bool]:
        """Pairs of the group, and whether it held more."""
        (low, high, own, rep, label, place), bits = group[:6], group[6]
        if label.min() == label.max():
            return rep[:0], rep[:0], False
        n, rank = place // PLACE, place % PLACE
        cross = low[0] != high[0]
        found = [(np.zeros(0, np.int64),) * 3]
        for i in range(len(rep) - 1):
            rest = slice(i + 1, None)
            ok = label[rest] != label[i]
            if cross:  # pairs within a block meet in that block's own group
                ok &= own[rest] != own[i]
            total, least = n[rest] + n[i], np.minimum(n[rest], n[i])
            ok &= least * rule.den >= (total - least) * rule.num
            most = np.minimum(rank[rest], rank[i]) + np.minimum(n[rest] - rank[rest], n[i] - rank[i])
            ok &= (rank[rest] == PLACE - 1) | (rank[i] == PLACE - 1) | (most * (rule.num + rule.den) >= total * rule.num)
            at = np.flatnonzero(ok)
            if len(at):
                apart = np.bitwise_count(bits[i + 1 + at] ^ bits[i]).sum(1, dtype=np.int64)
                near = apart <= rule.most_apart(total[at])
                found.append((np.full(near.sum(), i), at[near] + i + 1, apart[near]))
        x, y, apart = (np.concatenate(side) for side in zip(*found, strict=True))
        a, b = np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])
        if turn is None or not len(a):
            return a, b, False
        if turn:
            apart = mix(a.astype(np.uint64) * np.uint64(2 * turn + 1) + mix(b.astype(np.uint64)))
        kept = spanning(label, x, y, np.argsort(apart, kind="stable"))
        return a[kept], b[kept], len(kept) < len(a)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last group of a batch waits for the next

        def told_of(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            key, *group = parts[0] if len(parts) == 1 else (np.concatenate(side) for side in zip(*parts, strict=True))
            a, b, more = meet(tuple(group))
            if len(a):
                none = [None] * len(a)
                keys, a, b = ([*none, int(key[0])], [*a.tolist(), None], [*b.tolist(), None]) if more else (none, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (keys, a, b)], ["key", "a", "b"])

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns[:7]]
            bits = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(-1, SMALL_BITS // 64)
            new = np.zeros(batch.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
            starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for x, y in zip(starts, starts[1:], strict=False):
                part = (*(c[x:y] for c in columns), bits[x:y])
                if held and any(held[-1][k][0] != part[k][0] for k in range(3)):
                    yield from told_of(held)
                    held = []
                if y > x:
                    held.append(part)
        if held:
            yield from told_of(held)

    return grouped.mapInArrow(scan, "key bigint, a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all linked ids, the component being its smallest id.

    Each turn takes the least label among a node's neighbours and then that label's own
    label; the turns needed grow with the logarithm of a chain's length.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = shared_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
                          .select(F.col("a").alias("id"), "label"), "labels")
    while True:
        of = labels.select(F.col("id").alias("b"), F.col("label").alias("other"))
        near = both.join(of, "b").groupBy("a").agg(F.min("other").alias("other"))
        best = labels.join(near.withColumnRenamed("a", "id"), "id").select(
            "id", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        turned = shared_table(best.join(jump, "label").select("id", "old", F.least("label", "next").alias("label")), "labels")
        labels = turned.select("id", "label")
        if turned.filter("label < old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def similarity_components(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    rows, counts = profile(docs, rule)
    reps = rows.filter("doc_id is not null and n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = shared_table(rows.filter("doc_id is not null and n_shingles > 0").join(reps, "digest")
                           .select(F.col("doc_id").alias("id"), "rep").distinct(), "classes")
    members = shared_entries(index_entries(docs, rule, counts), classes)
    members = shared_table(members, "members")

    # rows of one id with different texts are one node: their classes are linked from the start
    same = (classes.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b")
            .select("a", "b").unionByName(
                classes.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))))
    hubs = members.filter("rep = hub").select("key", F.col("place").alias("hub_place"))
    first = (members.filter("rep > hub").join(hubs, "key").filter(near_enough("hub_place", "place", rule))
             .select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    links = verified(near_bitmaps(first, rows, rule), docs, rule)
    found = components(links.unionByName(same))

    linked, tried, rest = links.unionByName(same), first, members
    for turn in [*range(TURNS), None]:
        told = rest.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
            "key", "rep", "place", F.coalesce("component", "rep").alias("label"))
        met = shared_table(across_labels(shared_table(told, "told"), rows, rule, turn), "met")
        pairs = shared_table(met.filter("a is not null").select("a", "b").join(tried, ["a", "b"], "left_anti"), "met-pairs")
        more = None if pairs.isEmpty() else verified(near_bitmaps(pairs, rows, rule), docs, rule)
        if more is not None and not more.isEmpty():
            linked = linked.unionByName(more)
            found = components(linked)
        held = met.filter("key is not null").select("key").distinct()
        if turn is None or held.isEmpty():
            break
        tried, rest = tried.unionByName(pairs), members.join(held, "key", "left_semi")
    return rows.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns as they were; null ids stay."""
    found = similarity_components(docs, rule).filter("component_id <> doc_id")
    name = unused(docs, "gone_id")
    gone = found.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach(id, other) AS (
  SELECT x, y FROM edge UNION SELECT r.id, e.y FROM reach r JOIN edge e ON r.other = e.x
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(min(r.other), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.id = w.doc_id GROUP BY w.doc_id, n.n
"""
