"""Benchmark decontamination by winnowing.

Both sides' texts become word hashes.  Of the K-word-gram hashes in each run of W
consecutive ones the smallest is kept as a fingerprint, so two texts that share
K + W - 1 words share a fingerprint.  Fingerprints are joined, and each one that both
sides have is extended to the windows of K + W - 1 words around it: those that an item
has as well are hit, and hits that meet are one longer run.  With K + W - 1 = window no
shared window can be missed.  Items of fewer words than a window are matched as whole
grams of their own length.  Extension looks up at most W windows for each fingerprint, so
texts of one word over and over cost no more than others.

A benchmark of at most `block_bytes` bytes of text (measured first) goes to the
executors whole: one pass over the documents, no shuffle.  A larger one is never
collected: fingerprints of both sides are joined by a shuffle, then windows around the
ones in common.

Defined results: a null or empty text has no words and no hits; items without words
never occur; items with a null id hit words but are not listed; repeated rows give
repeated equal results, and rows that share a doc_id, or have none, are judged by their own
texts; a very long text is a chunk of its own; an empty table on either side gives no rows or no hits; other columns
of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, written
from .textvec import ALNUM_WORDS, Words, chunks, fresh_key, grams, grams_at, map_texts

BLOCK_BYTES = 32 << 20


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places whose hash is the smallest of one of the runs of w hashes around it."""
    size = len(hashes) - w + 1
    if size < 1:
        return np.zeros(0, np.int64)
    least, place = hashes[:size].copy(), np.zeros(size, np.int64)
    for k in range(1, w):
        now = hashes[k : k + size]
        less = now <= least  # of equal ones the rightmost
        least[less], place[less] = now[less], k
    return np.unique(np.arange(size) + place)


def _around(at: np.ndarray, w: int, n: int) -> np.ndarray:
    """The first words, of n, of the windows that hold one of the grams at some places."""
    near = np.zeros(n, bool)
    for k in range(w):
        near[np.maximum(at - k, 0)] = True
    return np.flatnonzero(near)


def _within(starts: np.ndarray, n: int, document: np.ndarray) -> np.ndarray:
    """Those of some first words whose n words are all in one document."""
    starts = starts[starts + n <= len(document)]
    return starts[document[starts] == document[starts + n - 1]]


class Items:
    """Fingerprints and windows of benchmark items, ready for lookups; items of the same words are one."""

    def __init__(self, ids: list, texts: list, window: int, k: int, key: int):
        words = Words(pa.array(texts, pa.large_string()), ALNUM_WORDS, key)
        self.window, self.k, self.w = window, k, window - k + 1
        counts, prints = words.counts(), []
        found: dict[int, tuple[list, list]] = {}  # by length: windows and their owners
        same: dict[bytes, int] = {}
        self.ids: list[set] = [set() for _ in ids]  # the ids of each item that stands for those of its words
        for i in np.flatnonzero(counts):
            own_words = words.hash[words.first[i] : words.first[i + 1]]
            own = same.setdefault(own_words.tobytes(), int(i))
            if ids[i] is not None:
                self.ids[own].add(ids[i])
            if own != i:
                continue
            n = min(int(counts[i]), window)
            if n == window:
                g = grams(own_words, k)
                prints.append(g[winnow(g, self.w)])
            windows, owners = found.setdefault(n, ([], []))
            windows.append(np.unique(grams(own_words, n)))
            owners.append(np.full(len(windows[-1]), i))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        # Windows in the same items share one list of them.
        self.lists: list[tuple] = []
        known: dict[bytes, int] = {}
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, (windows, owners) in found.items():
            every, who = np.concatenate(windows), np.concatenate(owners)
            order = np.argsort(every, kind="stable")
            hashes, first = np.unique(every[order], return_index=True)
            lists = np.empty(len(hashes), np.int64)
            for x, group in enumerate(np.split(who[order], first[1:])):
                lists[x] = known.setdefault(group.tobytes(), len(self.lists))
                if lists[x] == len(self.lists):
                    self.lists.append(tuple(group.tolist()))
            self.windows[n] = hashes, lists

    def hits(self, words: Words) -> tuple[np.ndarray, list[set]]:
        """Whether items cover each word of a chunk, and for each document the ids of the items that occur in it."""
        document, size = words.document(), len(words.hash)
        edge, listed = np.zeros(size + 1, np.int64), [set() for _ in range(len(words.first) - 1)]
        for n, (hashes, lists) in self.windows.items():
            starts = self._candidates(words) if n == self.window else np.arange(size)
            starts = _within(starts, n, document)
            g = grams_at(words.hash, starts, n)
            slot = np.minimum(np.searchsorted(hashes, g), len(hashes) - 1)
            hit = hashes[slot] == g
            starts, slot = starts[hit], slot[hit]
            edge[starts] += 1
            edge[starts + n] -= 1
            pairs = np.unique(document[starts] * len(self.lists) + lists[slot])
            for d, x in zip((pairs // len(self.lists)).tolist(), (pairs % len(self.lists)).tolist(), strict=True):
                listed[d].update(*(self.ids[i] for i in self.lists[x]))
        return np.cumsum(edge)[:size] > 0, listed

    def _candidates(self, words: Words) -> np.ndarray:
        g = grams(words.hash, self.k)
        at = winnow(g, self.w)
        slot = np.minimum(np.searchsorted(self.prints, g[at]), len(self.prints) - 1)
        return _around(at[self.prints[slot] == g[at]], self.w, len(words.hash))


def _size(benchmark: DataFrame) -> int:
    return benchmark.select(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0))).alias("n")).first()["n"] or 0


def _shared(items: DataFrame, window: int, k: int, key: int) -> Broadcast[Items]:
    """The items of a benchmark whose size was checked."""
    rows = items.collect()
    return items.sparkSession.sparkContext.broadcast(Items([r["item"] for r in rows], [r["text"] for r in rows], window, k, key))


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null").distinct()


def _runs(covered: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of covered words within documents: document, first word and end, counted within it."""
    document = words.document()
    breaks = np.concatenate([[True], document[1:] != document[:-1]]) if len(document) else covered
    first = np.flatnonzero(covered & (breaks | ~np.concatenate([[False], covered[:-1]])))
    last = np.flatnonzero(covered & np.concatenate([breaks[1:] | ~covered[1:], [True]])) if len(document) else first
    d = document[first]
    return d, first - words.first[d], last + 1 - words.first[d]


RUNS = "array<struct<first:long,end:long>>"


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    k: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, runs (hit word runs [first, end)), items (ids that occur, sorted as strings)."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items, key = _items(benchmark, item_id, item_text), fresh_key()
    if _size(items) > block_bytes:
        return _by_shuffle(docs, items, window, k, key)
    shared = _shared(items, window, k, key)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"), ALNUM_WORDS, key)
                covered, listed = known.hits(words)
                total = np.concatenate([[0], np.cumsum(covered)])
                owner, first, end = _runs(covered, words)
                spans = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(end, pa.int64())], names=["first", "end"])
                offsets = np.searchsorted(owner, np.arange(part.num_rows + 1))
                columns = [
                    part.column("doc_id"), pa.array(words.counts()), pa.array(np.diff(total[words.first])),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans), pa.array([sorted(x) for x in listed], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "runs", "items"])

    return map_texts(docs, scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, runs {RUNS}, items array<string>")


def _item_windows(items: DataFrame, window: int, k: int, key: int) -> DataFrame:
    """For each window of an item: its words' number n, its fingerprint (itself, if it is short), its hash, and the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"), ALNUM_WORDS, key)
                counts, names = words.counts(), part.column("item").to_pylist()
                for i in np.flatnonzero(counts):
                    own, n = words.hash[words.first[i] : words.first[i + 1]], min(int(counts[i]), window)
                    prints = hashes = grams(own, n)
                    if n == window:
                        g = grams(own, k)
                        prints = np.min([g[j : j + len(hashes)] for j in range(window - k + 1)], axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(hashes), n, np.int32)), pa.array(prints.view(np.int64)), pa.array(hashes.view(np.int64)), pa.array([names[i]] * len(hashes), pa.string())],
                        names=["n", "print", "window", "item"],
                    )

    return map_texts(items, run, "n int, print long, window long, item string").distinct()


def _hits(docs: DataFrame, items: DataFrame, window: int, k: int, key: int) -> tuple[DataFrame, DataFrame]:
    """Windows of documents (doc_id, text_hash, n, window, start) that items have, and the items' windows; all by shuffles."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    windows = written(_item_windows(items, window, k, key), "windows")
    lengths = [r["n"] for r in windows.select("n").distinct().collect()]  # at most as many as a window has words
    w = window - k + 1

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"), ALNUM_WORDS, key)
                document = words.document()
                for n in lengths:
                    size = k if n == window else n
                    g = grams(words.hash, size)
                    at = _within(winnow(g, w) if n == window else np.arange(len(g)), size, document)
                    pairs = np.unique(np.rec.fromarrays([document[at], g[at].view(np.int64)]))
                    owner = pa.array(pairs["f0"])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(owner), part.column("text_hash").take(owner), pa.array(np.full(len(pairs), n, np.int32)), pa.array(pairs["f1"])], names=["doc_id", "text_hash", "n", "print"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"), ALNUM_WORDS, key)
                document, rows = words.document(), part.column("found").to_pylist()
                for n in lengths:
                    size = k if n == window else n
                    g = grams(words.hash, size)
                    at = _within(winnow(g, w) if n == window else np.arange(len(g)), size, document)
                    pairs = np.array([(d, x["print"]) for d, row in enumerate(rows) for x in row if x["n"] == n], np.int64).reshape(-1, 2)
                    known = np.unique(np.rec.fromarrays([pairs[:, 0], pairs[:, 1]]))
                    at = at[np.isin(np.rec.fromarrays([document[at], g[at].view(np.int64)]), known)]
                    starts = _within(_around(at, w, len(document)) if n == window else at, n, document)
                    owner = pa.array(document[starts])
                    hashes = grams_at(words.hash, starts, n).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(owner), part.column("text_hash").take(owner), pa.array(np.full(len(starts), n, np.int32)), pa.array(hashes), pa.array(starts - words.first[document[starts]])],
                        names=["doc_id", "text_hash", "n", "window", "start"],
                    )

    row = f"doc_id {kind}, text_hash long, n int"
    found = map_texts(docs, prints, f"{row}, print long").join(windows.select("n", "print").distinct(), ["n", "print"], "left_semi")
    found = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("n", "print")).alias("found"))
    chosen = docs.alias("d").join(found.alias("f"), _same_row("d", "f")).select("d.*", "found")
    near = map_texts(chosen, around, f"{row}, window long, start long").distinct()
    return written(near.join(windows.select("n", "window").distinct(), ["n", "window"], "left_semi"), "hits"), windows


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.text_hash").eqNullSafe(F.col(f"{b}.text_hash"))


def _by_shuffle(docs: DataFrame, items: DataFrame, window: int, k: int, key: int) -> DataFrame:
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    hits, windows = _hits(docs, items, window, k, key)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for row in batch.column("spans").to_pylist():
                out: list[dict] = []
                for x in row:  # by start
                    if out and x["start"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], x["start"] + x["n"])
                    else:
                        out.append({"first": x["start"], "end": x["start"] + x["n"]})
                runs.append(out)
            n_hit = [sum(x["end"] - x["first"] for x in row) for row in runs]
            kinds = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n_hit, pa.int64()), pa.array(runs, kinds)], names=["doc_id", "text_hash", "n_hit", "runs"])

    spans = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"))
    runs = spans.mapInArrow(unite, f"doc_id {kind}, text_hash long, n_hit long, runs {RUNS}")
    listed = hits.select("doc_id", "text_hash", "n", "window").distinct().join(windows.select("n", "window", "item").distinct(), ["n", "window"])
    listed = listed.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    out = docs.select("doc_id", "text_hash", n_words.alias("n_words")).alias("d").join(runs.alias("r"), _same_row("d", "r"), "left").join(listed.alias("l"), _same_row("d", "l"), "left")
    return out.select(
        "d.doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("runs", F.expr(f"cast(array() as {RUNS})")).alias("runs"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def clean(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    k: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents, rows and columns as they are, without those in which a window of an item occurs.

    With a benchmark of at most block_bytes rows are judged where they are, and nothing is shuffled.
    """
    items, key = _items(benchmark, item_id, item_text), fresh_key()
    if _size(items) > block_bytes:
        docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
        hits, windows = _hits(docs, items, window, k, key)
        drop(windows)
        own = documents.withColumns({"__id": F.col(doc_id), "__hash": F.xxhash64(text)}).alias("d")
        hit = hits.select("doc_id", "text_hash").distinct().alias("h")
        left = own.join(hit, F.col("d.__id").eqNullSafe(F.col("h.doc_id")) & F.col("d.__hash").eqNullSafe(F.col("h.text_hash")), "left_anti")
        return left.select([F.col(f"d.`{c}`") for c in documents.columns])
    shared = _shared(items, window, k, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                words = Words(part.column(text), ALNUM_WORDS, key)
                covered, _ = shared.value.hits(words)
                total = np.concatenate([[0], np.cumsum(covered)])
                yield part.filter(pa.array(np.diff(total[words.first]) == 0))

    return map_texts(documents, run, documents.schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts, the sorted ids' sha256, and whether any word is hit."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
