"""Removal of repeated passages by hashing lines and sentences.

A text is cut into units: lines, cut again after sentence ends, and, where sixteen
words pass without an end, after words chosen by their hash.  Cuts depend on the words
around them alone, so a passage is cut alike wherever it stands.  Units are normalised (ASCII
lower case, single blanks).  From each unit on, as many units as make `least_words`
words are one passage; its digest is grouped globally, the occurrence in the document
with the least id (then the first place) is kept, and all others are removed.  Single
short sentences, which recur by chance, are never passages.  Removed ranges are
returned in code points of the original text.

Where units are too long to show what two texts share, runs of WINDOW words are compared
besides: those in which no line or sentence ends among the first or the last GAP words.
Of each such run the least hash of ANCHOR words is chosen, so equal runs choose alike
wherever they stand; runs whose choice occurs twice are grouped like passages, every run
from every word on, so what repeats goes up to its true ends.  A run that overlaps the
kept one (a text of one word over and over) is no repeat of it.  Which choices occur twice is told to the
executors as a map of bits of a bounded size, which may name too many but never too few.

Grouping takes a partial minimum per digest before the shuffle, and only digests that
occur twice or more are joined back, so a passage that a third of the documents share
is one aggregated row and a skewed join that can be split.

Documents are ranked by doc_id (null ones first) and, where rows of different texts share
one, by a hash of the text.

Defined results: a null or wordless text has no units; passages may repeat within a
document; rows that repeat a doc_id and its text count as one document and are returned
once each, rows that repeat a doc_id with other texts, or have none, are documents of their own;
texts under `least_words` words have no passage; a very long text is a chunk of its own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, written
from .textvec import LOWER_WORDS, U, Words, chunks, map_texts, mix, pair

LEAST_WORDS = 14
GAP = 16
ONE_IN = 8
WINDOW = 51
ANCHOR = 14
MOST_BITS = 28  # of the places in the map of choices: 32 MB
_END = np.zeros(256, bool)
_END[list(b".!?\"')]")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def line_ends(words: Words) -> np.ndarray:
    """Whether a line or sentence ends after each word."""
    n = len(words.starts)
    ends = np.zeros(n, bool)
    if not n:
        return ends
    last = words.raw[words.ends - 1]
    before = words.raw[np.maximum(words.ends - 2, words.starts)]
    ends |= _STOP[last] | _END[last] & _STOP[before]
    newlines = np.concatenate([[0], np.cumsum(words.raw == 10)])
    follows = np.append(words.starts[1:], len(words.raw))
    ends |= newlines[follows] > newlines[words.ends]
    final = words.first[1:][words.counts() > 0] - 1
    ends[final] = True
    return ends


def cuts(words: Words) -> np.ndarray:
    """Whether a unit ends after each word."""
    n = len(words.starts)
    ends = line_ends(words)
    if not n:
        return ends
    # Words with no end among the GAP words up to them.
    at = np.where(ends, np.arange(n), -1)
    latest = np.maximum.accumulate(at)
    begin = np.repeat(words.first[:-1], words.counts())
    bare = np.arange(n) - np.maximum(latest, begin - 1) >= GAP
    return ends | bare & (words.hash % U(ONE_IN) == 0)


def passages(column: pa.Array, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """First word, word after the last, and digest of the passage from each unit on; and the words."""
    words = Words(column, LOWER_WORDS)
    n = len(words.starts)
    ends = np.flatnonzero(cuts(words)) + 1  # unit k is words [ends[k-1], ends[k])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    to = np.searchsorted(ends, starts + least_words)
    ok = to < len(ends)
    starts, to = starts[ok], ends[to[ok]]
    document = words.document()
    inside = document[starts] == document[to - 1] if n else np.zeros(0, bool)
    starts, to = starts[inside], to[inside]
    return starts, to, Digests(words)(starts, to), words


class Digests:
    """Digests of ranges of words, equal for equal ranges; those of another kind differ.

    Hashes of 1, 2, 4, ... words from each word on are made from each other when first needed; a range is two of them, which overlap.
    """

    def __init__(self, words: Words):
        self.levels = [words.hash]

    def __call__(self, starts: np.ndarray, to: np.ndarray, kind: int = 0) -> np.ndarray:
        size, out = to - starts, np.zeros(len(starts), np.uint64)
        level = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            while len(self.levels) <= k:
                half = 1 << len(self.levels) - 1
                self.levels.append(pair(self.levels[-1][:-half], self.levels[-1][half:]))
            at = level == k
            out[at] = pair(self.levels[k][starts[at]], self.levels[k][to[at] - (1 << k)])
        return pair(out, size.astype(np.uint64) * U(4) + U(kind))


def windows(words: Words, digests: Digests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the runs of WINDOW words that are compared, the digest that each chooses, and the places (first words) of what is chosen."""
    size = len(words.starts) - WINDOW + 1
    if size < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(line_ends(words))])
    last = WINDOW - 1  # what follows a run decides whether its last word ends a line
    bare = (ends[GAP : GAP + size] == ends[:size]) | (ends[last : last + size] == ends[last - GAP : last - GAP + size])
    document = words.document()
    bare &= document[:size] == document[WINDOW - 1 :]
    starts = np.arange(size + WINDOW - ANCHOR)
    hashes = digests(starts, starts + ANCHOR, 1)
    least = hashes[:size].copy()
    for k in range(1, WINDOW - ANCHOR + 1):
        np.minimum(least, hashes[k : k + size], out=least)
    chosen = np.zeros(len(hashes), bool)
    for k in range(WINDOW - ANCHOR + 1):
        chosen[k : k + size] |= bare & (hashes[k : k + size] == least)
    return np.flatnonzero(bare), least[bare], np.flatnonzero(chosen)


def find_repeats(documents: DataFrame, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_words, removed (ranges [start, end) in code points, apart), n_removed_words, from_docs (documents that keep the passages)."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                starts, to, digest, words = passages(part.column("text"), least_words)
                yield _located(part, words, starts, to, digest)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"), LOWER_WORDS)
                digests = Digests(words)
                places = windows(words, digests)[2]
                yield pa.RecordBatch.from_arrays([pa.array(digests(places, places + ANCHOR, 1).view(np.int64))], names=["digest"])

    first = F.col("doc_id").eqNullSafe(F.col("keep_doc")) & (F.col("text_hash") == F.col("keep_hash"))
    units = written(map_texts(docs, run, f"doc_id {kind}, {_PLACE}"), "passages")
    repeated = written(_repeated(units), "repeated")
    again = written(units.join(repeated, "digest").where(~(first & (F.col("word") == F.col("keep_word")))).drop("digest", "keep_hash", "keep_word"), "again")
    drop(units)
    drop(repeated)
    twice = map_texts(docs.select("text"), choose, "digest long").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    shared = docs.sparkSession.sparkContext.broadcast(_bits(written(twice, "choices")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"), LOWER_WORDS)
                digests = Digests(words)
                starts, least, _ = windows(words, digests)
                place = least & U(64 * len(shared.value) - 1)
                starts = starts[shared.value[place >> U(6)] >> (place & U(63)) & U(1) == 1]
                yield _located(part, words, starts, starts + WINDOW, digests(starts, starts + WINDOW, 2))

    runs = written(map_texts(docs, compare, f"doc_id {kind}, {_PLACE}"), "windows")
    alike = written(_repeated(runs), "alike")
    again = again.unionByName(runs.join(alike, "digest").where(~(first & (F.col("word") < F.col("keep_word") + WINDOW))).drop("digest", "keep_hash", "keep_word"))
    span = F.struct("start", "end", "word", (F.col("word") + F.col("words")).alias("to"))
    by_doc = again.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set("keep_doc")).alias("from_docs"))
    by_doc = by_doc.mapInArrow(_merged, f"doc_id {kind}, text_hash long, removed {_RANGES}, n_removed_words long, from_docs array<{kind}>")
    counts = docs.select("doc_id", "text_hash", _n_words(F.col("text")).alias("n_words"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    return counts.alias("a").join(by_doc.alias("b"), same, "left").select(
        "a.doc_id", "n_words", F.coalesce("b.removed", F.expr(f"cast(array() as {_RANGES})")).alias("removed"),
        F.coalesce("n_removed_words", F.lit(0).cast("long")).alias("n_removed_words"),
        F.coalesce("b.from_docs", F.expr(f"cast(array() as array<{kind}>)")).alias("from_docs"),
    )


_RANGES = "array<struct<start:int,end:int>>"
_PLACE = "text_hash long, digest long, word int, words int, start int, end int"


def _located(part: pa.RecordBatch, words: Words, starts: np.ndarray, to: np.ndarray, digest: np.ndarray) -> pa.RecordBatch:
    """Rows of ranges of words with their document, number and code points."""
    document = words.document()[starts] if len(starts) else starts
    points = np.concatenate([[0], np.cumsum((words.raw & 0xC0) != 0x80)])
    zero = points[words.offsets[:-1]]
    number = starts - words.first[document]
    columns = [
        *(part.column(c).take(pa.array(document)) for c in ("doc_id", "text_hash")), pa.array(digest.view(np.int64)), pa.array(number.astype(np.int32)), pa.array((to - starts).astype(np.int32)),
        pa.array((points[words.starts[starts]] - zero[document]).astype(np.int32)), pa.array((points[words.ends[to - 1]] - zero[document]).astype(np.int32)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "digest", "word", "words", "start", "end"])


def _repeated(places: DataFrame) -> DataFrame:
    """Digests of more places than one, with the first of them."""
    place = F.struct("doc_id", "text_hash", "word")
    grouped = places.groupBy("digest").agg(F.min(place).alias("keep"), F.max(place).alias("other")).where("keep <> other")
    return grouped.select("digest", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.text_hash").alias("keep_hash"), F.col("keep.word").alias("keep_word"))


def _bits(digests: DataFrame) -> np.ndarray:
    """A bit set for each digest's low bits, in a map with 32 places a digest or of MOST_BITS bits."""
    n = digests.count()
    size = 1 << min(max(6, (32 * n).bit_length()), MOST_BITS)
    place = F.col("digest").bitwiseAND(F.lit(size - 1))
    rows = digests.select(F.shiftright(place, 6).alias("at"), F.expr("shiftleft(1L, cast(digest & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ranges with those that meet in a word made one."""
    for batch in batches:
        spans = batch.column("spans")
        sizes = np.diff(np.asarray(spans.offsets))
        start, end, word, to = (np.asarray(x, np.int64) for x in spans.flatten().flatten())
        row = np.repeat(np.arange(len(sizes)), sizes)
        apart = row << 32  # ranges of one row lie below those of the next
        reach = np.maximum.accumulate(to + apart) if len(row) else apart
        begin = np.flatnonzero(np.concatenate([[True], (word + apart)[1:] > reach[:-1]])) if len(row) else row
        of_row, zero = row[begin], np.zeros(0, np.int64)
        first, last = start[begin], np.maximum.reduceat(end, begin) if len(begin) else zero
        words = np.maximum.reduceat(to, begin) - word[begin] if len(begin) else zero
        ranges = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["start", "end"])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of_row, minlength=len(sizes)))])
        removed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ranges)
        total = np.bincount(of_row, words, len(sizes)).astype(np.int64)
        columns = [batch.column("doc_id"), batch.column("text_hash"), removed, pa.array(total), batch.column("from_docs")]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "removed", "n_removed_words", "from_docs"])


def without(text: Column, removed: Column) -> Column:
    """The text without the removed ranges."""

    def step(acc: Column, x: Column) -> Column:
        return F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"])).alias("out"))

    return F.aggregate(removed, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def digest(documents: DataFrame) -> DataFrame:
    """The columns of the query: counts, the removed ranges as text, and the documents that keep what is removed."""
    found = find_repeats(documents)
    ranges = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_removed_words", ranges.alias("removed"), "from_docs", (F.col("n_removed_words") > 0).alias("repeats"))
