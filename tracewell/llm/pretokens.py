"""Vocabulary files, pre-tokens of the byte-level BPE pattern, and a cache of what is computed for each distinct one.

The pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`
cuts a text into runs of letters, numbers, other characters and white space.  Where
the cuts are depends on character classes next to each place alone, so they are
found for all documents of a chunk at once; the contractions are the one exception
and are put right afterwards.  Special tokens in a text are pieces of their own.
"""

from __future__ import annotations

import functools
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from tokenizers.pre_tokenizers import ByteLevel

from .textvec import fresh_key, hash_ranges, text_buffers

BYTE_BPE = "byte_bpe_50k.json"
LETTER, NUMBER, OTHER, WHITE = 1, 2, 3, 4
#: Unicode's White_Space characters (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CACHE_WORDS = 500_000
CHUNK = 2 << 20
COMPARED = 4 << 20  # bytes of pre-tokens compared at a time
_KEY = fresh_key()  # of this Python worker: hashes of pre-tokens don't leave it


def read_vocabulary(path: str) -> str:
    """The text of a vocabulary file, given by path or by its name in the installed collection; read once, on the driver."""
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    with open(path, encoding="utf-8") as file:
        return file.read()


@functools.cache
def character_classes() -> np.ndarray:
    """The pattern's class of each code point.

    Letters and numbers differ between versions of Unicode.  Where an older one (Python's) and a newer one
    (the regex module's) disagree, the tokenizers library is asked, so that cuts fall where it makes them.
    """
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    newer = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for name, kind in kinds.items():
        for run in regex.finditer(rf"\p{{{name}}}+", every):
            newer[np.frombuffer(run[0].encode("utf-32-le"), np.uint32)] = kind
    cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for c in np.flatnonzero(table != newer):
        if not 0xD800 <= c < 0xE000:
            table[c] = next((kind for kind, sign in ((LETTER, "a"), (NUMBER, "1")) if len(cut(sign + chr(c))) == 1), OTHER)
    table[WHITE_SPACE] = WHITE
    return table


@functools.cache
def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable Latin-1, else the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def token_bytes(vocabulary: dict) -> dict[int, bytes]:
    """Bytes of each token id, special tokens included."""
    to_byte = byte_characters()
    known = {i: bytes(to_byte[c] for c in t) for t, i in vocabulary["model"]["vocab"].items() if all(c in to_byte for c in t)}
    return known | {t["id"]: t["content"].encode() for t in vocabulary["added_tokens"]}


class PreTokens:
    """Pre-tokens of a chunk: byte starts and ends, and each document's first one's number (and the count last)."""

    def __init__(self, column: pa.Array, special: Iterable[str] = ()):
        self.data, offsets = text_buffers(column)
        size = len(self.data)
        raw = self.data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((self.data & 0xC0) != 0x80)  # each character's first byte
        borders, inside = np.searchsorted(at, offsets), []
        for name in special:
            name, p = name.encode(), -1
            while (p := raw.find(name, p + 1)) >= 0:
                if np.searchsorted(offsets, p, "right") == np.searchsorted(offsets, p + len(name), "left"):
                    inside.append((p, p + len(name)))
        edges = borders
        if inside:
            inside.sort()
            edges = np.unique(np.concatenate([borders, np.searchsorted(at, np.array(inside).ravel())]))
        begin = self._starts(points, edges)
        for p, q in inside:
            a, b = np.searchsorted(at, [p, q])
            begin[a + 1 : b] = False
        starts = np.flatnonzero(begin)
        self.starts = at[starts]
        self.ends = np.append(self.starts[1:], size) if len(starts) else self.starts
        self.first = np.searchsorted(self.starts, offsets)
        self.offsets = offsets

    @staticmethod
    def _starts(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        n = len(points)
        if not n:
            return np.zeros(0, bool)
        kind = character_classes()[points]
        new = np.zeros(n + 1, bool)
        new[edges] = True
        joined = ~new[:n]  # has a character before it in its own text
        joined[0] = False
        follows = ~new[1:]  # has one after it
        white = kind == WHITE
        before = np.empty(n, np.uint8)
        before[0], before[1:] = 0, kind[:-1]
        after = np.empty(n, np.uint8)
        after[-1], after[:-1] = WHITE, kind[1:]
        blank = np.empty(n, bool)
        blank[0], blank[1:] = False, points[:-1] == 0x20
        begin = ~joined | (before != kind)
        begin &= ~(~white & joined & blank)  # a blank goes with what follows it
        begin |= white & follows & (after != WHITE)
        quote = np.flatnonzero((points == 0x27) & begin)
        if len(quote):
            ends = np.append(edges[edges > 0], n)
            limit = ends[np.searchsorted(ends, quote, "right")]
            for q, end in zip(quote.tolist(), limit.tolist(), strict=True):
                tail = "".join(map(chr, points[q + 1 : min(q + 3, end)].tolist()))
                length = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail in ("re", "ve", "ll") else 0
                if length and tail:
                    begin[q + 1] = False
                    if length == 2:
                        begin[q + 2] = False
                    if q + 1 + length < end:
                        begin[q + 1 + length] = True
        return begin

    def distinct(self) -> tuple[np.ndarray, list[bytes]]:
        """For each pre-token the number of its bytes, and the bytes of each number; hashes group them, and their bytes are compared."""
        codes, hashes = pd.factorize(hash_ranges(self.data, self.starts, self.ends, _KEY))
        first = np.full(len(hashes), -1)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        alike = first[codes]
        if not self._equal(alike):
            every = np.empty(len(codes), object)
            every[:] = self._bytes(np.arange(len(codes)))
            codes, known = pd.factorize(every)
            return codes, list(known)
        return codes, self._bytes(first)

    def _bytes(self, at: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]

    def _equal(self, alike: np.ndarray) -> bool:
        """Whether each pre-token has the bytes of the one whose number is given."""
        sizes = self.ends - self.starts
        if not (sizes == sizes[alike]).all():
            return False
        a = 0
        while a < len(sizes):  # pre-tokens follow each other without gaps
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + COMPARED)))
            lo, hi = self.starts[a], self.ends[b - 1]
            index = np.repeat(self.starts[alike[a:b]] - self.starts[a:b], sizes[a:b]) + np.arange(lo, hi)
            if not (self.data[index] == self.data[lo:hi]).all():
                return False
            a = b
        return True


Flat = tuple[np.ndarray, np.ndarray]


def flat(lists: Iterable[list[int]]) -> Flat:
    """All values in order, and the lists' sizes."""
    lists = list(lists)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


class WordCache:
    """Integers computed for each distinct pre-token (its token ids, or their number), kept for a bounded number of words.

    compute gives a list for each word, or flat() of these.
    When it is full, words met in one chunk only are forgotten, and of the others the half met in most chunks stays.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable[list[int]] | Flat], most: int = CACHE_WORDS):
        self.compute, self.most = compute, most
        self.slot: dict[bytes, int] = {}
        self.values, self.offsets, self.met = array("I"), array("q", [0]), array("I")

    def _forget(self) -> None:
        met, offsets, values = np.array(self.met), np.array(self.offsets), np.array(self.values)
        kept = np.flatnonzero(met > 1)
        if len(kept) > self.most // 2:
            kept = np.sort(kept[np.argsort(-met[kept].astype(np.int64), kind="stable")[: self.most // 2]])
        sizes = offsets[kept + 1] - offsets[kept]
        to = np.concatenate([[0], np.cumsum(sizes)])
        index = np.repeat(offsets[kept] - to[:-1], sizes) + np.arange(to[-1])
        new = np.full(len(met), -1)
        new[kept] = np.arange(len(kept))
        self.slot = {key: k for key, old in self.slot.items() if (k := int(new[old])) >= 0}
        self.values, self.offsets, self.met = array("I", values[index].tobytes()), array("q", to.tobytes()), array("I", met[kept].tobytes())

    def lookup(self, tokens: PreTokens) -> tuple[np.ndarray, np.ndarray]:
        """All values in order, and the offset of each pre-token's first (and the number of all last)."""
        codes, keys = tokens.distinct()
        if len(self.slot) > self.most:
            self._forget()
        own = np.fromiter(map(self.slot.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(own < 0)
        if len(new):
            missing = [keys[k] for k in new.tolist()]
            found = self.compute([key.decode() for key in missing])
            values, sizes = found if isinstance(found, tuple) else flat(found)
            if len(sizes) != len(missing):
                raise ValueError("not as many results as words")
            known = len(self.met)
            own[new] = np.arange(known, known + len(new))
            self.offsets.frombytes((self.offsets[-1] + np.cumsum(sizes)).astype(np.int64).tobytes())
            self.values.frombytes(values.astype(np.uint32).tobytes())
            self.met.frombytes(bytes(4 * len(new)))
            self.slot.update(zip(missing, range(known, known + len(new)), strict=True))
        np.frombuffer(self.met, np.uint32)[own] += 1
        offsets = np.frombuffer(self.offsets, np.int64)
        starts, sizes = offsets[own][codes], np.diff(offsets)[own][codes]
        to = np.concatenate([[0], np.cumsum(sizes)])
        index = np.repeat(starts - to[:-1], sizes) + np.arange(to[-1])
        return np.frombuffer(self.values, np.uint32)[index], to


def special_tokens(vocabulary: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
