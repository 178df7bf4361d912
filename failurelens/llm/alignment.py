"""Alignment of two tokenizers' tokens, by an associative monoid of fragments.

Two tokenizers cut the same bytes at different places. Where tokens of both end, the text
is cut into groups; within a group, tokens whose byte ranges overlap are linked.

A stretch of a text is a fragment: either open (no common end in it: just its tokens), or
an open prefix up to its first common end, its closed groups, and an open suffix after its
last common end. Joining two neighbours closes one group, the left one's suffix with the
right one's prefix; this is associative, with the empty open fragment as its unit. A text of
over ``CHUNK`` bytes goes as chunks of that size, by the tokens' ends, to Spark tasks of
their own; their fragments are joined ``FAN`` at a time, level by level, so no task before the
last joins more than its part of a very long text.

A shorter text is joined inside its task from the fragments of its words, which are kept from
text to text. A word begins at a space that follows anything but white space; there tokens of
both sides end, if the first vocabulary splits by the byte-level pattern and no piece of the
second goes on with a space after another letter. Both is looked up when the files are
loaded (``cuts_at_words``); for other files such texts are encoded whole.

How often a pair of ids is linked is counted over all texts, once for each text. The most
frequent ``HOT`` pairs are looked up by a broadcast, the others by a shuffle, so no pair of
the shuffle has more than one link in ``HOT`` of all.

Defined results: the first tokenizer (a ``tokenizers`` file) gets a space and the text, the second
(a ``sentencepiece`` file) the text, to which it adds the space; strings of special tokens are
plain text. Texts that are null or empty, or whose tokens' bytes differ from a space and
the text, have no tokens: zeros and empty results, and they count for no pair. Repeated
rows are texts of their own; an empty table gives an empty result; other columns, whatever
their names, do not matter. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failurelens.llm.common import prepare, shared_table, text_slices

#: Texts of more bytes go in chunks of so many; so many fragments are joined at a time.
CHUNK, FAN = 1 << 16, 8
#: So many pairs, the most frequent ones, are broadcast.
HOT = 100_000
#: A worker forgets its words when it has met so many; new ones are encoded so many at a time.
WORDS, TOGETHER = 150_000, 256


def byte_level_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as it is, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokens:
    """One vocabulary: encoding of texts and the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads
        self.pieces = path.endswith(".model")
        if self.pieces:
            import sentencepiece
            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            size = self.model.get_piece_size()
            self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                          for i, p in enumerate(map(self.model.id_to_piece, range(size)))]
        else:
            import tokenizers
            self.model = tokenizers.Tokenizer.from_file(path)
            self.model.encode_special_tokens = True
            self.model.no_truncation()
            self.model.no_padding()
            letters = byte_level_letters()
            self.bytes = [b""] * self.model.get_vocab_size()
            for token, i in self.model.get_vocab().items():
                self.bytes[i] = bytes(letters[c] for c in token) if set(token) <= letters.keys() else token.encode()
        self.length = np.array(list(map(len, self.bytes)), np.int64)

    def cuts_at_words(self) -> bool:
        """Whether a token ends before each space that follows anything but white space."""
        if self.pieces:
            return not any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(len(self.bytes)))
        told = json.loads(self.model.to_str())
        split = told["pre_tokenizer"] or {}
        return told["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of a space and each text."""
        if self.pieces:
            return self.model.encode(texts, num_threads=1)
        return [e.ids for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def decoded(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Pair:
    """Both vocabularies, and the written forms of their ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Tokens(path_a), Tokens(path_b)
        self.size_b = len(self.b.bytes)
        self.span = len(self.a.bytes) * self.size_b
        most = max(len(self.a.bytes), self.size_b)
        self.written = [f"{i}{mark}" for i in range(most) for mark in MARKS]
        self.words = Words(self) if self.a.cuts_at_words() and self.b.cuts_at_words() else None

    def tokens(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both sides' ids of each text; none if it is empty or their bytes differ from a space and the text."""
        found = zip(*(t.encode([x.decode() for x in texts]) for t in (self.a, self.b)), texts, strict=True)
        return [(np.array(a, np.int64), np.array(b, np.int64))
                if x and self.a.decoded(a) == self.b.decoded(b) == b" " + x else (NO_IDS, NO_IDS) for a, b, x in found]

    def closed(self, texts: list[bytes]) -> list[Closed]:
        """The groups of each text, all its tokens at once."""
        ids, found = self.tokens(texts), [Closed() for _ in texts]
        some = [i for i, (a, _) in enumerate(ids) if len(a)]
        if some:
            bounds = np.cumsum([0, *(len(texts[i]) + 1 for i in some)])
            done = closed_groups(self, *(np.concatenate([ids[i][k] for i in some]) for k in (0, 1)), bounds)
            for i, c in zip(some, done, strict=True):
                found[i] = c
        return found


#: What follows an id: another of its side, the other side, the next group, nothing.
MARKS = (",", "|", ";", "")
NO_IDS = np.zeros(0, np.int64)
_WORKER: dict[tuple[str, str], Pair] = {}


def vocabularies(paths: tuple[str, str]) -> Pair:
    """The worker's tokenizers, loaded once; the files are where ``paths`` says on every machine."""
    if paths not in _WORKER:
        _WORKER.clear()
        _WORKER[paths] = Pair(*paths)
    return _WORKER[paths]


@dataclass
class Closed:
    """Groups that are closed at both ends: their text, numbers, and distinct pairs with their links."""

    groups: str = ""
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    pairs: np.ndarray = field(default_factory=lambda: NO_IDS)
    times: np.ndarray = field(default_factory=lambda: NO_IDS)

    def __add__(self, other: Closed) -> Closed:
        if not (self.n_a and other.n_a):
            return self if self.n_a else other
        pairs, where = np.unique(np.concatenate([self.pairs, other.pairs]), return_inverse=True)
        times = np.bincount(where, np.concatenate([self.times, other.times])).astype(np.int64)
        return Closed(f"{self.groups};{other.groups}", self.n_a + other.n_a, self.n_b + other.n_b,
                      self.n_groups + other.n_groups, self.n_links + other.n_links, pairs, times)


@dataclass
class Lines:
    """The groups of texts laid one behind the other: ids with their marks, and a pair for each link."""

    words: list[str]
    numbers: np.ndarray  # of each text: n_a, n_b, n_groups, n_links
    links: np.ndarray

    def groups(self) -> list[str]:
        stops = np.cumsum(self.numbers[:, 0] + self.numbers[:, 1]).tolist()
        return ["".join(self.words[i:j]) for i, j in zip([0, *stops], stops)]


def lines(v: Pair, a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> Lines:
    """Text i has the bytes from ``bounds[i]`` to ``bounds[i + 1]``, which the ids ``a`` and ``b`` of both sides cover."""
    at_a, at_b = np.zeros((2, bounds[-1] + 1), bool)
    ends_a, ends_b = np.cumsum(v.a.length[a]), np.cumsum(v.b.length[b])
    at_a[ends_a], at_b[ends_b] = True, True
    before_a, before_b = np.cumsum(at_a) - at_a, np.cumsum(at_b) - at_b  # tokens that end before a byte
    both_end = at_a & at_b
    cuts = np.flatnonzero(both_end)
    parts = np.flatnonzero(at_a | at_b)  # each part between neighbouring ends is one link
    links = a[before_a[parts]] * v.size_b + b[before_b[parts]]

    group = np.cumsum(both_end) - both_end  # of each end
    done_a, done_b = before_a[cuts] + 1, before_b[cuts] + 1  # tokens up to the end of each group
    line = np.empty(len(a) + len(b), np.int64)
    final = np.zeros(bounds[-1] + 1, bool)
    final[bounds[1:]] = True
    line[np.arange(len(a)) + np.append(0, done_b)[group[ends_a]]] = a * len(MARKS) + at_b[ends_a]
    line[np.arange(len(b)) + done_a[group[ends_b]]] = b * len(MARKS) + np.where(final[ends_b], 3, 2 * at_a[ends_b])
    ends = [np.searchsorted(x, bounds[1:], "right") for x in (ends_a, ends_b, cuts, parts)]
    return Lines([v.written[code] for code in line.tolist()], np.stack([np.diff(e, prepend=0) for e in ends], 1), links)


def distinct(links: np.ndarray, n_links: np.ndarray, span: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct links of each text and how often it has them; the texts' links lie one behind the other."""
    key = np.sort(np.repeat(np.arange(len(n_links)), n_links) * span + links)
    new = np.flatnonzero(np.diff(key, prepend=-1))
    owner, pairs = np.divmod(key[new], span)
    times = np.diff(np.append(new, len(key)))
    of = np.searchsorted(owner, np.arange(len(n_links) + 1))
    return [(pairs[i:j], times[i:j]) for i, j in zip(of, of[1:])]


def closed_groups(v: Pair, a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> list[Closed]:
    """The same as one ``Closed`` for each text."""
    found = lines(v, a, b, bounds)
    return [Closed(groups, *map(int, n), *links) for groups, n, links in zip(
        found.groups(), found.numbers, distinct(found.links, found.numbers[:, 3], v.span), strict=True)]


#: Before a space that follows anything but white space.
WORD = re.compile(r"(?<=\S)(?= )")


class Words:
    """The groups of words met before, to join texts from them."""

    def __init__(self, v: Pair):
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.first = np.zeros(1, np.int64)  # of each word's links, one entry for each link
        self.links = NO_IDS

    def learn(self, words: list[str]) -> None:
        """``words`` are new, each with its leading space; they are encoded many at a time."""
        v = self.v
        words = sorted(words, key=lambda w: w[-1].isspace())
        inner = sum(not w[-1].isspace() for w in words)
        runs = ["".join(words[i:min(i + TOGETHER, inner)]) for i in range(0, inner, TOGETHER)] + words[inner:]
        bounds = np.cumsum([0, *(len(w.encode()) for w in words)])
        ids = []
        for side in (v.a, v.b):
            found = side.encode([r[1:] for r in runs])
            ids.append(np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found))))
        whole = "".join(runs).encode()
        if all(side.decoded(mine.tolist()) == whole for side, mine in zip((v.a, v.b), ids, strict=True)):
            new = lines(v, *ids, bounds)
            groups, numbers, links = new.groups(), new.numbers, new.links
        else:  # some word's bytes differ
            found = v.closed([w[1:].encode() for w in words])
            groups = [c.groups for c in found]
            numbers = np.array([(c.n_a, c.n_b, c.n_groups, c.n_links) for c in found], np.int64)
            links = np.concatenate([np.repeat(c.pairs, c.times) for c in found])
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.groups += groups
        self.numbers = np.concatenate([self.numbers, numbers])
        self.links = np.concatenate([self.links, links])
        self.first = np.append(0, np.cumsum(self.numbers[:, 3]))

    def closed(self, texts: list[bytes]) -> list[Closed]:
        """The groups of texts, joined from those of their words."""
        parts = [WORD.split(" " + x.decode()) if x else [] for x in texts]
        for words in parts:
            if len(words) > 1 and words[-1].isspace():
                words[-2:] = ["".join(words[-2:])]  # white space at the end is no word of its own
        if len(self.at) > WORDS:
            self.forget()
        new = [w for w in dict.fromkeys(chain.from_iterable(parts)) if w not in self.at]
        if new:
            self.learn(new)
        where = [np.fromiter(map(self.at.__getitem__, words), np.int64, len(words)) for words in parts]
        # a word without tokens leaves its text without
        where = [w if self.numbers[w, 0].all() else NO_IDS for w in where]
        flat = np.concatenate([*where, NO_IDS])
        n_links = self.numbers[flat, 3]
        ends = np.cumsum(n_links)
        links = self.links[np.arange(n_links.sum()) + np.repeat(self.first[flat] - (ends - n_links), n_links)]
        numbers = np.array([self.numbers[w].sum(0) for w in where], np.int64).reshape(-1, 4)
        groups = self.groups
        return [Closed(";".join([groups[i] for i in w.tolist()]), *map(int, n), *mine) for w, n, mine in zip(
            where, numbers, distinct(links, numbers[:, 3], self.v.span), strict=True)]


@dataclass
class Fragment:
    """A stretch of a text. Not ``cut``: ``prefix`` holds all its tokens and the rest is empty."""

    cut: bool = False
    prefix: tuple[np.ndarray, np.ndarray] = (NO_IDS, NO_IDS)
    body: Closed = field(default_factory=Closed)
    suffix: tuple[np.ndarray, np.ndarray] = (NO_IDS, NO_IDS)


def both(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])


def one_group(v: Pair, ids: tuple[np.ndarray, np.ndarray]) -> Closed:
    """An open part that is closed at both ends now."""
    return closed_groups(v, *ids, np.array([0, v.a.length[ids[0]].sum()]))[0]


def fragment(v: Pair, a: np.ndarray, b: np.ndarray, base_a: int, base_b: int) -> Fragment:
    """The fragment of a chunk whose first tokens begin at the bytes ``base_a`` and ``base_b`` of the text."""
    ends_a, ends_b = base_a + np.cumsum(v.a.length[a]), base_b + np.cumsum(v.b.length[b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    if not len(cuts):
        return Fragment(prefix=(a, b))
    (i, j), (k, m) = (np.searchsorted(e, cuts[[0, -1]], "right") for e in (ends_a, ends_b))
    body = closed_groups(v, a[i:j], b[k:m], np.array([0, cuts[-1] - cuts[0]]))[0] if j > i else Closed()
    return Fragment(True, (a[:i], b[:k]), body, (a[j:], b[m:]))


def joined(v: Pair, left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring stretches; associative."""
    if not left.cut:
        return Fragment(right.cut, both(left.prefix, right.prefix), right.body, right.suffix)
    if not right.cut:
        return Fragment(True, left.prefix, left.body, both(left.suffix, right.prefix))
    middle = one_group(v, both(left.suffix, right.prefix))
    return Fragment(True, left.prefix, left.body + middle + right.body, right.suffix)


def whole(v: Pair, f: Fragment) -> Closed:
    """The groups of a whole text, whose two ends are common ends."""
    return one_group(v, f.prefix) + f.body


def chunks(v: Pair, a: np.ndarray, b: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(a, b, first byte of a, first byte of b) for each ``size`` bytes of a text; tokens go by their ends."""
    ends_a, ends_b = np.cumsum(v.a.length[a]), np.cumsum(v.b.length[b])
    borders = np.append(np.arange(size, ends_a[-1], size), ends_a[-1])
    i = k = 0
    for j, m in zip(np.searchsorted(ends_a, borders, "right"), np.searchsorted(ends_b, borders, "right"), strict=True):
        yield a[i:j], b[k:m], int(ends_a[i - 1]) if i else 0, int(ends_b[k - 1]) if k else 0
        i, k = j, m


_IDS = T.ArrayType(T.LongType())
CLOSED = [T.StructField("groups", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")],
          T.StructField("pairs", _IDS), T.StructField("times", _IDS)]
OPEN = [T.StructField("cut", T.BooleanType()), *[T.StructField(n, _IDS) for n in ("prefix_a", "prefix_b", "suffix_a", "suffix_b")]]
PLACE = [T.StructField("row", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("chunks", T.LongType())]
_LIST = pa.list_(pa.int64())
_ARROW = {"groups": pa.string(), "cut": pa.bool_(), **{f.name: _LIST for f in [*CLOSED, *OPEN] if f.dataType == _IDS}}


def closed_columns(items: list[Closed]) -> list[pa.Array]:
    return [pa.array([getattr(c, f.name) for c in items], _ARROW.get(f.name, pa.int64())) for f in CLOSED]


def open_columns(items: list[Fragment]) -> list[pa.Array]:
    return [pa.array([f.cut for f in items], pa.bool_()),
            *[pa.array([side[k] for side in sides], _LIST)
              for sides in ([f.prefix for f in items], [f.suffix for f in items]) for k in (0, 1)]]


def held_fragment(row: dict[str, pa.Array], i: int) -> Fragment:
    """The fragment in row ``i`` of a table's columns."""
    def ids(name: str) -> np.ndarray:
        return np.asarray(row[name][i].values, np.int64)
    body = Closed(row["groups"][i].as_py(), *[row[n][i].as_py() for n in ("n_a", "n_b", "n_groups", "n_links")],
                  ids("pairs"), ids("times"))
    return Fragment(row["cut"][i].as_py(), (ids("prefix_a"), ids("prefix_b")), body, (ids("suffix_a"), ids("suffix_b")))


def alignments(docs: DataFrame, paths: tuple[str, str], digests: bool = False, chunk: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: row (a number), own (its columns), groups, n_a, n_b, n_groups, n_links, pairs, times.

    ``groups`` is written ``a1,a2|b1;a3|b2,b3``, or with ``digests`` the SHA-256 of that (without
    tokens ''). ``pairs`` are the distinct linked pairs as a * (size of b's vocabulary) + b, with
    ``times`` links each. The result is a table in the shared folder.
    """
    spark = docs.sparkSession
    prepare(spark)
    size = chunk or CHUNK
    own = T.StructField("own", T.StructType(docs.schema.fields))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"),
                       F.monotonically_increasing_id().alias("row"), F.col("text").alias("read"))
    raw = [T.StructField("base_a", T.LongType()), T.StructField("base_b", T.LongType())]
    fields = [own, *PLACE, *raw, *OPEN, *CLOSED]

    def shown(items: list[Closed]) -> list[Closed]:
        if digests:
            for c in items:
                c.groups = c.groups and hashlib.sha256(c.groups.encode()).hexdigest()
        return items

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(paths)
        for batch in batches:
            for first, texts in text_slices(batch, "read"):
                short = [i for i, x in enumerate(texts) if len(x) < size]
                items = [Closed() for _ in texts]
                for i, c in zip(short, (v.words or v).closed([texts[i] for i in short]), strict=True):
                    items[i] = c
                long = [i for i, x in enumerate(texts) if len(x) >= size]
                ids = dict(zip(long, v.tokens([texts[i] for i in long]), strict=True))
                yield from pieces(v, batch.slice(first, len(texts)), shown(items), ids)

    def pieces(v, part, items, ids):
        """The finished texts in one batch, then the chunks of each long one; ``ids`` has the tokens of these."""
        numbers = part.column(1)
        at = [i for i in range(len(items)) if i not in ids or not len(ids[i][0])]
        yield batch_of(part.column(0), numbers, at, [(0, 1, 0, 0)] * len(at), [Fragment(True)] * len(at), [items[i] for i in at])
        for i, mine in ids.items():
            if len(mine[0]):
                cut = list(chunks(v, *mine, size))
                for k, (a, b, base_a, base_b) in enumerate(cut):
                    yield batch_of(part.column(0), numbers, [i], [(k, len(cut), base_a, base_b)],
                                   [Fragment(prefix=(a, b))], [Closed()])

    def batch_of(owns, numbers, at, places, fragments, items):
        # a row's own columns go with its first chunk
        mine = owns.take(pa.array([i if p[0] == 0 else None for i, p in zip(at, places, strict=True)], pa.int64()))
        place = [pa.array([p[k] for p in places], pa.int64()) for k in range(4)]
        return pa.RecordBatch.from_arrays(
            [mine, numbers.take(pa.array(at, pa.int64())), *place, *open_columns(fragments), *closed_columns(items)],
            [f.name for f in fields])

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks to their fragments."""
        v = vocabularies(paths)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                cols = {f.name: row.column(k) for k, f in enumerate(fields)}
                a, b = (np.asarray(cols[n][0].values, np.int64) for n in ("prefix_a", "prefix_b"))
                f = fragment(v, a, b, cols["base_a"][0].as_py(), cols["base_b"][0].as_py())
                yield pa.RecordBatch.from_arrays([*row.columns[:6], *open_columns([f]), *closed_columns([f.body])],
                                                 [f.name for f in fields])

    def level(table: pa.Table) -> pa.Table:
        """Up to ``FAN`` neighbouring fragments of a text to one; a text that is done stays."""
        if table.column("chunks")[0].as_py() == 1:
            return table
        v = vocabularies(paths)
        table = table.sort_by("chunk").combine_chunks()
        cols = {n: table.column(n).chunk(0) for n in table.column_names}
        f = reduce(lambda x, y: joined(v, x, y), [held_fragment(cols, i) for i in range(table.num_rows)])
        chunk_no = cols["chunk"][0].as_py() // FAN
        left = -(-cols["chunks"][0].as_py() // FAN)
        if left == 1:
            f = Fragment(True, body=shown([whole(v, f)])[0])
        head = [cols["own"].slice(0, 1), cols["row"].slice(0, 1), pa.array([chunk_no], pa.int64()), pa.array([left], pa.int64()),
                pa.array([0], pa.int64()), pa.array([0], pa.int64())]
        return pa.Table.from_arrays([*head, *open_columns([f]), *closed_columns([f.body])], [f.name for f in fields])

    schema = T.StructType(fields)
    table = shared_table(rows.mapInArrow(encoded, schema), "alignment")
    results = [f.name for f in [own, PLACE[0], *CLOSED]]
    most = table.agg(F.max("chunks")).first()[0] or 1
    if most == 1:
        return table.select(*results)
    long = table.filter("chunks > 1")
    tree = long.repartition("row", "chunk").mapInArrow(started, schema)
    while most > 1:
        tree = tree.groupBy("row", F.expr(f"chunk div {FAN}")).applyInArrow(level, schema)
        most = -(-most // FAN)
        tree = tree if most == 1 else shared_table(tree, "alignment-level")
    done = shared_table(tree.select(*results), "alignment-long")
    return table.filter("chunks = 1").select(*results).unionByName(done)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, n, best): the number of texts that hold the pair, and whether it is the highest of its a."""
    counts = shared_table(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
                          .withColumn("a", F.expr(f"pair div {size_b}")), "alignment-pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of the vocabulary at most
    return shared_table(counts.join(F.broadcast(most), "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best")),
                        "alignment-counts")


def link_sums(aligned: DataFrame, counts: DataFrame, hot: int | None = None) -> DataFrame:
    """(row, n_best, count_sum) of each row with links."""
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    first = F.broadcast(counts.orderBy(F.desc("n"), "pair").limit(hot or HOT).select("pair", "n", "best"))
    sums = [F.sum(F.expr("if(best, times, 0L)")).alias("n_best"), F.sum(F.expr("times * n")).alias("count_sum")]
    often = links.join(first, "pair").groupBy("row").agg(*sums)
    rare = links.join(first.select("pair"), "pair", "left_anti").join(
        counts.join(first.select("pair"), "pair", "left_anti").select("pair", "n", "best"), "pair").groupBy("row").agg(*sums)
    return often.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def report(docs: DataFrame, paths: tuple[str, str], chunk: int | None = None, hot: int | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of ``docs``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned = alignments(narrow, paths, digests=True, chunk=chunk)
    sums = link_sums(aligned, pair_counts(aligned, len(vocabularies(paths).b.bytes)), hot)
    return aligned.join(sums, "row", "left").select(
        "own.doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), F.col("groups").alias("groups_sha256"))
