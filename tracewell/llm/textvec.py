"""Vectorised splitting and hashing of UTF-8 text columns.

An Arrow string column is one byte buffer with offsets.  Word classes used by the
operators are all decided by ASCII bytes (every byte of a multi-byte character is
>= 0x80), so words can be found on bytes with a 256-entry table, for all documents
of a batch at once.  A word's hash takes eight of its bytes at a time through a keyed
permutation of 64-bit integers (words over LONG bytes go through keyed BLAKE2b), so no
words can be made to collide without the key: jobs that take equal hashes for equal words
draw a new key each (`fresh_key`).

Null texts are read as empty ones.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

U = np.uint64
CHUNK_BYTES = 1 << 20  # work on about this much text at a time; one longer text is one chunk

KEY = 0x9E3779B97F4A7C15  # where hashes decide what is returned, such as where a unit ends
LONG = 64
_random = np.random.Generator(np.random.PCG64(20240611))
GRAM_FACTOR = _random.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of eight

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_bytes = np.arange(256, dtype=np.uint8)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
#: 0 marks a byte outside words.  NUL is a word character between spaces, so it is given a byte that UTF-8 never has.
_RAW = np.where(_bytes == 0, 255, _bytes).astype(np.uint8)
RAW_WORDS = np.where(SPACE, 0, _RAW).astype(np.uint8)
LOWER_WORDS = np.where(SPACE, 0, np.where(_bytes == 0, 255, LOWER)).astype(np.uint8)
_alnum = (LOWER >= 97) & (LOWER <= 122) | (_bytes >= 48) & (_bytes <= 57) | (_bytes >= 128)
ALNUM_WORDS = np.where(_alnum, LOWER, 0).astype(np.uint8)


_held: dict = {}


def release() -> None:
    """Give memory that is free in this Python worker back to the machine: workers idle between tasks, and the executor's limit counts what they keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def held(key: tuple, make: Callable[[], object]) -> object:
    """What make returns, kept in this Python worker until another operator keeps something: tables and caches of several operators would add up."""
    if key not in _held:
        _held.clear()
        release()
        _held[key] = make()
    return _held[key]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which maps a partition's batches, with free memory released at the partition's end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def map_texts(frame: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow for rows with texts, whose batches are bounded by the session's rows and bytes; run cuts them into chunks()."""
    return frame.mapInArrow(tidy(run), schema)


def fresh_key() -> int:
    """A key for one job's hashes, drawn on the driver and sent with the job's functions, so that repeated tasks hash alike."""
    return secrets.randbits(64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and the rows' offsets in them (one more than rows)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most that many bytes of text, or one row."""
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = KEY) -> np.ndarray:
    """Hashes of byte ranges of a buffer, by their bytes and length."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + mix(np.array([key], np.uint64)))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at = 0
    while len(live):
        out[live] = mix(out[live] ^ eight[starts[live] + at] & _KEPT[np.minimum(size[live] - at, 8)])
        at += 8
        live = live[size[live] > at]
    long = np.flatnonzero(size > LONG)
    if len(long):
        secret = key.to_bytes(8, "little")
        digests = [hashlib.blake2b(data[a:b], digest_size=8, key=secret).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        out[long] = np.frombuffer(b"".join(digests), "<u8")
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes that don't cross documents."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[cuts] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


class Words:
    """Words of a chunk: byte starts and ends, 64-bit hashes, and each document's first word's number (and the count last)."""

    def __init__(self, column: pa.Array, table: np.ndarray, key: int = KEY):
        self.raw, self.offsets = text_buffers(column)
        mapped = table[self.raw]
        self.inside = mapped != 0
        self.starts, self.ends = runs(self.inside, self.offsets)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hash = hash_ranges(mapped, self.starts, self.ends, key)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def select(self, keep: np.ndarray) -> Words:
        """The words of some of the documents, without looking for them again."""
        sizes, counts, new = np.diff(self.offsets), self.counts(), Words.__new__(Words)
        of_byte, of_word = np.repeat(keep, sizes), np.repeat(keep, counts)
        new.raw, new.inside, new.hash = self.raw[of_byte], self.inside[of_byte], self.hash[of_word]
        new.offsets, new.first = (np.concatenate([[0], np.cumsum(n[keep])]) for n in (sizes, counts))
        moved = np.repeat(self.offsets[:-1][keep] - new.offsets[:-1], counts[keep])
        new.starts, new.ends = self.starts[of_word] - moved, self.ends[of_word] - moved
        return new

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    return mix(mix(a + U(KEY)) ^ b)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on, whatever documents they are in; n - 1 fewer than words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    total = hashes[:size] * GRAM_FACTOR[0]
    for k in range(1, n):
        total = total + hashes[k : k + size] * GRAM_FACTOR[k]
    return mix(total + U(n))


def grams_at(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """grams() at some places only."""
    total = np.zeros(len(starts), np.uint64)
    for k in range(n):
        total = total + hashes[starts + k] * GRAM_FACTOR[k]
    return mix(total + U(n))
