"""Byte-pair encoding by walking a trie of distinct words, and decoding.

The encoding of a word's prefix is fixed by its last token: the tokens before it are
the encoding of the prefix without it.  A token that ends a prefix is the right last
one if merging would leave it and the last token before it as they are, and just one
token is.  So each trie node needs only its last token, found from states higher on
its path, and words that share a prefix share its states.  The sorted distinct words
of a chunk are their trie in depth-first order; the path's states are a stack.

Whether two tokens stay apart is decided by undoing merges at their border, latest
first, and asking each time whether the border pair would have merged sooner.

Defined results: a null text is read as an empty one and has no tokens; repeated
rows, null and repeated doc_ids give a result for each row; a very long text is a chunk of its
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import BYTE_BPE, CHUNK, PreTokens, WordCache, byte_characters, read_vocabulary, special_tokens, token_bytes
from .textvec import chunks, held, map_texts


PAIRS, WORDS = 500_000, 250_000  # remembered at most; a worker with full ones took 236 MB


class Merges:
    """A vocabulary with its merges."""

    def __init__(self, vocabulary: dict):
        to_byte = byte_characters()
        names = vocabulary["model"]["vocab"]
        self.bytes = token_bytes(vocabulary)
        self.ids = {bytes(to_byte[c] for c in t): i for t, i in names.items() if all(c in to_byte for c in t)}
        self.longest = max(map(len, self.ids))
        self.merged: dict[tuple[int, int], int] = {}  # rank of a pair's merge
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}  # of the merge that makes a token; tokens of one byte have none
        for rank, pair in enumerate(vocabulary["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = names[left], names[right], names[left + right]
            self.merged.setdefault((a, b), rank)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (a, b), rank
        self._apart: dict[int, bool] = {}

    def apart(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, are left as they are."""
        key = a << 32 | b
        if (known := self._apart.get(key)) is not None:
            return known
        if len(self._apart) > PAIRS:
            self._apart.clear()
        known = self._apart[key] = self._stay(a, b)
        return known

    def _stay(self, a: int, b: int) -> bool:
        merged, rank, before = self.merged, self.rank, float("inf")
        while True:
            if merged.get((a, b), before) < before:
                return False
            made_a, made_b = rank.get(a, -1), rank.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:  # a was made last: could its right part have merged with b before that?
                before, a = made_a, self.parts[a][1]
            else:  # at equal ranks the merge further left goes first
                before, b = made_b + 1, self.parts[b][0]

    @functools.cached_property
    def whole(self) -> set[int]:
        """Tokens whose own bytes are encoded as themselves."""
        return {t for t in self.ids.values() if t not in self.parts or self._reached(t)}

    def _reached(self, token: int) -> bool:
        a, b = self.parts[token]
        return all(x not in self.parts or self._reached(x) for x in (a, b)) and self._stays_until(a, b, self.rank[token])

    def _stays_until(self, a: int, b: int, last: int) -> bool:
        """Whether no merge across the border of a and b comes before both are made, other than the one that joins them."""
        merged, rank, before = self.merged, self.rank, float("inf")
        first = True
        while True:
            if not first and merged.get((a, b), before) < before:
                return False
            first = False
            made_a, made_b = rank.get(a, -1), rank.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                before, a = made_a, self.parts[a][1]
            else:
                before, b = made_b + 1, self.parts[b][0]


def encode_words(words: list[bytes], merges: Merges) -> list[list[int]]:
    """Token ids of each word, by one depth-first walk of the words' trie."""
    ids, whole, longest, apart = merges.ids, merges.whole, merges.longest, merges.apart
    out: list[list[int]] = [[] for _ in words]
    last: list[int] = [-1]  # the last token of each prefix on the path
    size: list[int] = [0]
    before = b""
    for k in sorted(range(len(words)), key=words.__getitem__):
        word = words[k]
        shared, most = 0, min(len(before), len(word))
        while shared < most and before[shared] == word[shared]:
            shared += 1
        del last[shared + 1 :], size[shared + 1 :]
        for d in range(shared + 1, len(word) + 1):
            for n in range(min(d, longest), 0, -1):
                token = ids.get(word[d - n : d])
                if token is not None and (token in whole if n == d else token in whole and apart(last[d - n], token)):
                    break
            else:
                raise ValueError(f"no token ends {word[:d]!r}")
            last.append(token)
            size.append(n)
        tokens, d = out[k], len(word)
        while d:
            tokens.append(last[d])
            d -= size[d]
        tokens.reverse()
        before = word
    return out


class Codec:
    """Encoder and decoder of one vocabulary, with a cache of words; made once in each Python worker."""

    def __init__(self, vocabulary: str):
        parsed = json.loads(vocabulary)
        self.special = special_tokens(parsed)
        self.merges = Merges(parsed)
        self.cache = WordCache(self._encode, WORDS)
        size = max(self.merges.bytes) + 1
        pieces = [self.merges.bytes.get(i, b"") for i in range(size)]
        self.piece_size = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.pieces = np.frombuffer(b"".join(pieces), np.uint8)

    def _encode(self, words: list[str]) -> list[list[int]]:
        plain = [w.encode() if w not in self.special else b"" for w in words]
        return [[self.special[w]] if w in self.special else ids for w, ids in zip(words, encode_words(plain, self.merges), strict=True)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's offset in them (and the number of all last)."""
        tokens = PreTokens(column, self.special)
        values, to = self.cache.lookup(tokens)
        return values.astype("<u4"), to[tokens.first]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        sizes = self.piece_size[ids]
        index = np.repeat(self.piece_start[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.pieces[index].tobytes()


def codec(vocabulary: str) -> Codec:
    return held(("bpe", vocabulary), lambda: Codec(vocabulary))


def _prepared(documents: DataFrame, doc_id: str, text: str, vocabulary: str):
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))  # a file of some MB, whatever the corpus
    return docs, docs.schema["doc_id"].dataType.simpleString(), shared


def encode(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = BYTE_BPE) -> DataFrame:
    """A row for each document: doc_id, ids (array<int>)."""
    docs, kind, shared = _prepared(documents, doc_id, text, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            for part in chunks(batch, most=CHUNK):
                ids, to = own.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return map_texts(docs, run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = BYTE_BPE) -> DataFrame:
    """A row for each document: doc_id, text; bytes that are not UTF-8 become replacement characters; null ids become a null text."""
    rows, kind, shared = _prepared(encoded, doc_id, ids, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            texts = [None if not x.is_valid else own.decode(np.asarray(x.values, np.int64)).decode("utf-8", "replace") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_texts(rows, run, f"doc_id {kind}, text string")


def round_trip(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = BYTE_BPE) -> DataFrame:
    """The columns of the query: doc_id, n_tokens, and sha256 of the ids and of the text decoded from them."""
    docs, kind, shared = _prepared(documents, doc_id, text, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            for part in chunks(batch, most=CHUNK):
                ids, to = own.encode(part.column("text"))
                each = [ids[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]
                columns = [
                    part.column("doc_id"),
                    pa.array(np.diff(to)),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in each], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in each], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
