"""Byte-pair encoding without merge loops, and decoding by an offset table.

The tokenizer file's merges define for each token the pair it was made from. A sequence
of tokens is what the merges give exactly if each neighbouring pair is *compatible*: no
earlier merge would have joined pieces across their border. So a word is encoded by
taking at each position the longest token that an Aho-Corasick automaton found there,
and stepping back to a shorter token, or the previous position, where a pair is not
compatible. A position once left is not tried again, hence linear time.

Decoding gathers from one buffer of all tokens' bytes by their offsets.

Defined results: null or empty text has no tokens and decodes to an empty text; the file's
special tokens are recognised in a text as its library does; equal rows give equal
results; extra columns stay as they are unless named like a result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from failurelens.llm.common import prepare, text_slices

NO_LIMIT = 1 << 60
WORD_MEMO = 200_000
PAIR_MEMO = 300_000
#: The white space of the file's pattern engine: Unicode separators and these controls.
SPACE = r"[\t-\r\x85\p{Z}]"


def printable_bytes() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeTables:
    """The tokenizer file as lookup tables; plain data, so Spark can send it to tasks."""

    #: marks the end of a word inside byte strings held as Latin-1 text
    END = "Ā"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word_pattern = split["pattern"]["Regex"].replace(r"[^\s", "[^" + SPACE[1:-1])
        size = max([*vocab.values(), *self.special.values()]) + 1

        to_byte = printable_bytes()
        self.strings: dict[int, str] = {}
        for token, i in vocab.items():
            ends = token.endswith(suffix) and token != suffix
            raw = "".join(chr(to_byte[c]) for c in (token[:-len(suffix)] if ends else token))
            self.strings[i] = raw + self.END if ends else raw
        self.parts = {i: (i, i) for i in self.strings}
        self.pairs: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pairs.setdefault((left, right), whole)
            if self.parts[whole] == (whole, whole):
                self.parts[whole] = (left, right)

        names = {i: t.encode() for t, i in [*vocab.items(), *self.special.items()]}
        # without a decoder in the file, decoding writes tokens with a space between them
        pieces = [names.get(i, b"") + b" " for i in range(size)]
        self.buffer = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)


class WordMemo(dict):
    """Words' ids as bytes, found when first asked for; starts anew when it is full."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORD_MEMO:
            self.clear()
        as_bytes = self.encoder.as_bytes
        found = self.encoder.word_ids(word.encode().decode("latin-1") + BpeTables.END)
        self[word] = ids = b"".join([as_bytes[i] for i in found])
        return ids


class Encoder:
    """Encodes texts with ``BpeTables``; one for each Python worker."""

    def __init__(self, tables: BpeTables):
        self.t = tables
        self.compatible_memo: dict[tuple[int, int], bool] = {}
        self.length = {i: len(s) for i, s in tables.strings.items()}
        self.finder = ahocorasick.Automaton()
        self.by_text: dict[str, int] = {}
        for i, s in tables.strings.items():
            left, right = tables.parts[i]
            if left == i or self.compatible(left, right, made=i):
                self.finder.add_word(s, (i, len(s) - 1))
                self.by_text[s] = i
        self.finder.make_automaton()
        #: the longest token that is a shorter prefix of a token
        self.shorter: dict[int, int] = {}
        for s, i in self.by_text.items():
            self.shorter[i] = next((self.by_text[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.by_text), -1)
        self.as_bytes = {i: i.to_bytes(4, "little") for i in tables.strings}
        self.words = WordMemo(self)
        self.find_words = regex.compile(tables.word_pattern).findall
        self.find_special = regex.compile("(" + "|".join(map(regex.escape, tables.special)) + ")")

    def compatible(self, a: int, b: int, made: int = NO_LIMIT) -> bool:
        """Whether merging leaves ``a`` and ``b`` apart; or joins them first as ``made``."""
        pairs, parts = self.t.pairs, self.t.parts
        limit = NO_LIMIT
        while True:
            joined = pairs.get((a, b))
            if joined is not None and joined < limit and joined != made:
                return False
            # undo the later of the two merges; only merges before it can have come first
            if a > b:
                limit, a = a, parts[a][1]
                if a != limit:
                    continue
                limit, b = b + 1, parts[b][0]
                if b + 1 == limit:
                    return True
            else:
                limit, b = b + 1, parts[b][0]
                if b + 1 != limit:
                    continue
                limit, a = a, parts[a][1]
                if a == limit:
                    return True

    def word_ids(self, word: str) -> list[int]:
        """Tokens of one word (bytes as Latin-1 text, END last)."""
        whole = self.by_text.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        longest = [-1] * (n + 1)  # by start; ends come in rising order
        for end, (token, back) in self.finder.iter(word):
            longest[end - back] = token
        length, shorter, memo = self.length, self.shorter, self.compatible_memo
        open_at = [True] * (n + 1)
        open_at[n - 1] = False  # END goes with the byte before it
        out: list[int] = []
        pos, last, token = 0, -1, longest[0]
        while pos < n:
            while token >= 0:
                end = pos + length[token]
                if open_at[end]:
                    if last < 0:
                        break
                    pair = (last, token)
                    fits = memo.get(pair)
                    if fits is None:
                        if len(memo) > PAIR_MEMO:
                            memo.clear()
                        fits = memo[pair] = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                last, pos, token = token, end, longest[end]
            else:
                open_at[pos] = False
                token = shorter[out.pop()]
                pos -= length[last]
                last = out[-1] if out else -1
        return out

    def _plain(self, text: str, out: list[bytes]) -> None:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # letter by letter: no final sigma
        out.extend(map(self.words.__getitem__, self.find_words(text.lower())))

    def encode(self, text: str) -> np.ndarray:
        """Token ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        if "<|" not in text:
            self._plain(text, out)
        else:
            for i, part in enumerate(self.find_special.split(text)):
                if i % 2:
                    out.append(np.array([self.t.special[part]], "<u4").tobytes())
                else:
                    self._plain(part, out)
        return np.frombuffer(b"".join(out), "<u4")


def decode_bytes(tables: BpeTables, ids: np.ndarray) -> bytes:
    """The text of ``ids`` in UTF-8: one gather from the token buffer."""
    if not len(ids):
        return b""
    start = tables.offsets[ids]
    length = tables.offsets[ids.astype(np.int64) + 1] - start
    ends = np.cumsum(length)
    where = np.arange(ends[-1]) + np.repeat(start - (ends - length), length)
    return tables.buffer[where].tobytes()[:-1]


#: What ``tokenize`` can add, by name.
RESULTS = {
    "ids": (T.ArrayType(T.LongType()), lambda t, ids: ids.astype(np.int64)),
    "n_tokens": (T.LongType(), lambda t, ids: len(ids)),
    "ids_sha256": (T.StringType(), lambda t, ids: hashlib.sha256(ids.tobytes()).hexdigest()),
    "decoded": (T.StringType(), lambda t, ids: decode_bytes(t, ids).decode()),
    "decoded_sha256": (T.StringType(), lambda t, ids: hashlib.sha256(decode_bytes(t, ids)).hexdigest()),
}
ARROW = {"ids": pa.list_(pa.int64()), "n_tokens": pa.int64()}

_WORKER: dict[str, Encoder] = {}


def _encoder(tables) -> Encoder:
    """The worker's encoder, kept over its tasks; ``tables`` is a broadcast."""
    if tables.id not in _WORKER:
        _WORKER.clear()
        _WORKER[tables.id] = Encoder(tables.value)
    return _WORKER[tables.id]


class _Broadcast:
    """A broadcast with a name of its own, which keeps one encoder to each."""

    def __init__(self, spark, value):
        self.id = uuid.uuid4().hex
        self._held = spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._held.value


def tokenize(docs: DataFrame, path: str, add: list[str], text: str = "text") -> DataFrame:
    """``docs`` with the columns ``add`` of ``RESULTS`` for its column ``text``; no shuffle."""
    prepare(docs.sparkSession)
    tables = _Broadcast(docs.sparkSession, BpeTables(path))
    kept = [f for f in docs.schema.fields if f.name not in add]
    schema = T.StructType(kept + [T.StructField(a, RESULTS[a][0]) for a in add])
    names = [f.name for f in kept]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tables)
        for batch in batches:
            for start, texts in text_slices(batch, text):
                columns: list[list] = [[] for _ in add]
                for raw in texts:
                    ids = enc.encode(raw.decode())
                    for column, name in zip(columns, add, strict=True):
                        column.append(RESULTS[name][1](enc.t, ids))
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(names_at) for names_at in map(part.schema.get_field_index, names)]
                    + [pa.array(c, ARROW.get(a, pa.string())) for c, a in zip(columns, add, strict=True)],
                    names + add)

    return docs.mapInArrow(encoded, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``tokens`` with the text of the ids in column ``ids``; null ids give null."""
    prepare(tokens.sparkSession)
    tables = _Broadcast(tokens.sparkSession, BpeTables(path))
    kept = [f for f in tokens.schema.fields if f.name != into]
    names = [f.name for f in kept]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids))
            texts = [None if not r.is_valid else
                     decode_bytes(tables.value, np.asarray(r.values.to_numpy(zero_copy_only=False), np.int64)).decode()
                     for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(texts, pa.string())],
                [*names, into])

    return tokens.mapInArrow(decoded, T.StructType([*kept, T.StructField(into, T.StringType())]))
