"""Near-duplicate documents by HyperMinHash sketches and verified links.

1. Each text becomes the set of its n-word shingles (64-bit hashes).  A set's hashes
   fall into k buckets; a bucket keeps its least hash compressed to a leading-zero
   count and ten mantissa bits (16 bits in all), and empty buckets borrow from others
   in an order that depends on the bucket only, so that two sets agree in a register
   with the probability of their Jaccard similarity.
2. Equal sets are one class from here on, whatever the number of copies.
3. Registers are banded; classes that agree in a whole band meet in a bucket.  Bands
   are as long as they can be with a chance of under one in a million that two sets
   right at the threshold share none.  A bucket is led by the class that meets most
   others, so that the buckets of a family of near copies have few leaders; all
   classes in buckets of one leader are its group.
4. A group is dealt into blocks of bounded size, its leader being in each.  Within a
   block classes are compared by registers, corrected for chance collisions, and,
   when the estimate is within six standard deviations of the threshold, by their
   full sets, unless links found before connect them already.  Only links that join
   two components are kept.  This is linear in the size of a group.
5. Only groups of several blocks that still hold several components go on.  A group's
   core are the shingles of half of its classes and more.  A class has to share so many
   shingles outside the core with any class it links with as its own part of the core is
   short of the threshold; so two such classes have one in common among the first of
   these (in order of hash, as many as may all be missing, and one).  Classes are dealt
   by these shingles, which a family of texts from one template doesn't share, and those
   that share one are compared in blocks, as are classes that consist of the core nearly.
   So every pair that shares a band is connected or compared, or is shown not to link.

A class is known by a 128-bit digest of its set, and rows by doc_id and a hash of the
text, so no result rests on doc_ids being there or being different.

Defined results: a null or wordless text has an empty set and stays alone; a text of
fewer words than a shingle is one shingle; rows that repeat a doc_id with the same
text share their result; rows that repeat a doc_id with other texts are judged by their own;
a null doc_id is no least one (a component without ids has none, and its rows are
kept: one_of_each() judges rows); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import drop, written
from .textvec import GRAM_FACTOR, KEY, LOWER_WORDS, U, Words, chunks, fresh_key, grams, map_texts, mix

REGISTERS = 192
MANTISSA_BITS = 10
MISS = 1e-6
BLOCK = 256


def band_rows(threshold: float, registers: int = REGISTERS, miss: float = MISS) -> int:
    """The most registers a band can have while sets at the threshold share a band with probability 1 - miss."""
    return max([1, *(r for r in range(1, 17) if (1 - threshold**r) ** (registers // r) <= miss)])


def shingle_sets(column: pa.Array, n: int, key: int = KEY) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, ascending."""
    words = Words(column, LOWER_WORDS, key)
    every, counts = grams(words.hash, n), words.counts()
    sets = []
    for d, count in enumerate(counts):
        lo = words.first[d]
        if count >= n:
            sets.append(np.unique(every[lo : lo + count - n + 1]))
        elif count:
            sets.append(grams(words.hash[lo : lo + count], int(count)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _probe(attempt: int, k: int) -> np.ndarray:
    return (mix(np.arange(k, dtype=np.uint64) + U(attempt * 65536 + 7)) % U(k)).astype(np.int64)


def sketch(sets: list[np.ndarray], k: int = REGISTERS) -> np.ndarray:
    """Register matrix (16 bits: leading zeros and mantissa of each bucket's least hash); empty sets have zeros."""
    registers = np.zeros((len(sets), k), np.uint16)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return registers
    h = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    low, high = h & U(0xFFFFFFFF), h >> U(32)
    bucket = ((high * U(k) + ((low * U(k)) >> U(32))) >> U(32)).astype(np.int64)
    cell = owner * k + bucket
    first = np.concatenate([[True], cell[1:] != cell[:-1]])  # hashes ascend, so a bucket's least comes first
    rest = h[first] * U(k)  # the hash's place within its bucket, as a fraction of 2**64
    zeros = 64 - np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    zeros = np.clip(zeros, 0, 50)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> U(64 - MANTISSA_BITS)
    registers.ravel()[cell[first]] = (((zeros + 1).astype(np.uint64) << U(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    full = registers.copy()
    row, column = np.nonzero((registers == 0) & (sizes > 0)[:, None])
    attempt = 0
    while len(row):
        source = full[row, _probe(attempt, k)[column]]
        registers[row, column] = source
        empty = source == 0
        row, column, attempt = row[empty], column[empty], attempt + 1
    return registers


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each document and band."""
    bands = registers.shape[1] // rows
    cells = registers[:, : bands * rows].reshape(len(registers), bands, rows).astype(np.uint64)
    keys = (cells * GRAM_FACTOR[:rows]).sum(axis=2, dtype=np.uint64)
    return mix(keys + mix(np.arange(bands, dtype=np.uint64))).view(np.int64)


def estimate(matches: np.ndarray, k: int = REGISTERS) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for unequal hashes that agree in a register.

    Two independent least hashes agree in the leading zeros with probability 1/3 and then in the mantissa with 2**-bits.
    """
    chance = 2.0**-MANTISSA_BITS / 3
    return (matches / k - chance) / (1 - chance)


def least_estimate(threshold: float, k: int = REGISTERS) -> float:
    return threshold - 6 * math.sqrt(threshold * (1 - threshold) / k)


def _sketches(docs: DataFrame, n: int, rows: int, k: int, key: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part.column("text"), n, key)
                names = ["doc_id", "text_hash", "n_shingles", "digest", "bands"]
                columns = [
                    part.column("doc_id"),
                    part.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array(list(band_keys(sketch(sets, k), rows)), pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_texts(docs, run, f"doc_id {kind}, text_hash long, n_shingles long, digest binary, bands array<long>")


def _digest(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def _bodies(docs: DataFrame, rows: DataFrame, n: int, k: int, key: int) -> DataFrame:
    """Registers and full sets (8-byte hashes, ascending) of the classes of some rows (doc_id, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            # The join sorts rows, so those that repeat the same text follow each other: one is enough.
            texts = np.asarray(batch.column("text_hash"))
            new = np.concatenate([[before is None or texts[0] != before], texts[1:] != texts[:-1]]) if len(texts) else np.zeros(0, bool)
            before = texts[-1] if len(texts) else before
            for part in chunks(batch.filter(pa.array(new))):
                sets = shingle_sets(part.column("text"), n, key)
                columns = [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([r.tobytes() for r in sketch(sets, k)], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "registers", "set"])

    chosen = docs.alias("d").hint("merge").join(rows.alias("r").hint("merge"), same_row("d", "r"), "left_semi")
    return map_texts(chosen, run, "id binary, registers binary, set binary")


def same_row(a: str, b: str) -> Column:
    """Rows of two relations with the same doc_id, or none, and the same text."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.text_hash").eqNullSafe(F.col(f"{b}.text_hash"))


def new_links(left: pd.DataFrame, right: pd.DataFrame | None, threshold: Fraction, k: int) -> list[tuple]:
    """Verified links between left and right (or within left) that connect what no earlier one connects.

    Columns: id, component, registers, set; rows of one component count as connected.
    """
    over, under, limit = threshold.numerator, threshold.denominator, float(threshold)
    rows = left if right is None else pd.concat([left, right], ignore_index=True)
    ids, registers = rows["id"].to_numpy(), np.frombuffer(b"".join(rows["registers"]), np.uint16).reshape(-1, k)
    sets = [np.frombuffer(s, np.uint64) for s in rows["set"]]
    sizes = np.array([len(s) for s in sets], np.int64)
    component = pd.factorize(rows["component"])[0]
    least, found = least_estimate(limit, k), []
    for x in range(len(left)):
        start = x + 1 if right is None else len(left)
        other = np.arange(start, len(rows))
        other = other[(component[other] != component[x]) & (np.minimum(sizes[other], sizes[x]) >= (limit - 1e-9) * np.maximum(sizes[other], sizes[x]))]
        if not len(other):
            continue
        other = other[estimate((registers[other] == registers[x]).sum(axis=1), k) >= least]
        for y in other:
            if component[y] != component[x]:
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if under * both >= over * (sizes[x] + sizes[y] - both):
                    component[component == component[y]] = component[x]
                    found.append((ids[x], ids[y]))
    return found


def _linked(dealt: DataFrame, threshold: Fraction, k: int) -> DataFrame:
    """Links found in each block of a bucket (i = j), or between two of its blocks."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        # The leader goes first, as it is near most of its group.
        group = group.drop_duplicates("id").sort_values("id", key=lambda x: x != group["leader"].iloc[0], kind="stable")
        right = (group["block"] == group["j"]) & (group["i"] != group["j"])
        links = new_links(group[~right], group[right] if right.any() else None, threshold, k)
        return pd.DataFrame({"u": pd.Series([u for u, _ in links], dtype=object), "v": pd.Series([v for _, v in links], dtype=object)})

    return dealt.groupBy("leader", "key", "i", "j").applyInPandas(run, "u binary, v binary")


def _core(members: DataFrame) -> DataFrame:
    """For each leader the shingles of half of its classes and more: at most twice as many as its sets have on average."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaders, numbers = np.unique(np.array(batch.column("leader").to_pylist(), object), return_inverse=True)
            sets = [np.frombuffer(s, np.uint64) for s in batch.column("set").to_pylist()]
            for k, leader in enumerate(leaders):
                shingles, n = np.unique(np.concatenate([sets[x] for x in np.flatnonzero(numbers == k)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([leader] * len(n), pa.binary()), pa.array(shingles.view(np.int64)), pa.array(n)], names=["leader", "shingle", "n"])

    sizes = members.groupBy("leader").agg(F.count("*").alias("m"))
    counted = members.select("leader", "set").mapInArrow(count, "leader binary, shingle long, n long").groupBy("leader", "shingle").agg(F.sum("n").alias("n"))
    return counted.join(sizes, "leader").where("2 * n >= m").groupBy("leader").agg(F.collect_list("shingle").alias("core"))


def _by_shingle(members: DataFrame, threshold: Fraction) -> DataFrame:
    """leader, id, component and key: the shingles outside the core of which two classes that link share one; null for a class of core nearly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = [], []
            for x, (body, core) in enumerate(zip(batch.column("set").to_pylist(), batch.column("core"), strict=True)):
                own = np.frombuffer(body, np.uint64)
                common = np.isin(own, np.asarray(core.values).view(np.uint64)) if core.is_valid else np.zeros(len(own), bool)
                rest = own[~common].view(np.int64)
                need = -(-threshold.numerator * len(own) // threshold.denominator) - int(common.sum())
                if need < 1:
                    at.append([x])
                    keys.append(pa.nulls(1, pa.int64()))
                rest = rest[: len(rest) - max(need, 1) + 1]
                at.append(np.full(len(rest), x))
                keys.append(pa.array(rest))
            some = batch.select(["leader", "id", "component"]).take(pa.array(np.concatenate(at) if at else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.concat_arrays(keys) if keys else pa.nulls(0, pa.int64())], names=["leader", "id", "component", "key"])

    return members.join(_core(members), "leader", "left").select("leader", "id", "component", "set", "core").mapInArrow(run, "leader binary, id binary, component binary, key long")


def _later_links(groups: DataFrame, bodies: DataFrame, component: DataFrame, threshold: Fraction, k: int) -> DataFrame:
    """Links between the blocks of groups that still hold several components."""
    large = groups.where("blocks > 1").join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = large.groupBy("leader").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("leader")
    members = written(large.join(split, "leader").select("leader", "id", "component").join(bodies.select("id", "set"), "id"), "members")
    keyed = written(_by_shingle(members, threshold), "keyed")
    drop(members)
    buckets = keyed.groupBy("leader", "key").agg(F.count("*").alias("n"), F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
    buckets = buckets.select("leader", "key", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    same = (F.col("x.leader") == F.col("y.leader")) & F.col("x.key").eqNullSafe(F.col("y.key"))
    rows = keyed.alias("x").join(buckets.alias("y"), same).select("x.leader", "x.key", "id", "component", "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.select("leader", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component")
    links = written(_linked(dealt.join(bodies, "id"), threshold, k), "links")
    drop(keyed)
    return links


def _judged(documents: DataFrame, shingle: int, threshold: str, doc_id: str, text: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text_hash, n_shingles, digest: null without words) and classes (id: their digest, row: the first of their rows, class_id, root: a digest for each component)."""
    limit, key = Fraction(threshold), fresh_key()
    rows = band_rows(float(limit), k)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    sketches = written(_sketches(docs, shingle, rows, k, key), "sketches")
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row")
    made = sketches.where(F.col("digest").isNotNull()).groupBy(F.col("digest").alias("id")).agg(row, F.min("doc_id").alias("class_id"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    classes = written(made, "classes")
    # Sets that differ reach the threshold only from so many shingles on.
    least_n = math.ceil(limit / (1 - limit)) if limit < 1 else 1
    banded = classes.where(F.col("n") >= least_n).select("id", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = written(banded.join(sizes, "key"), "buckets")
    degree = buckets.groupBy("id").agg(F.sum("m").alias("degree"))
    leaders = buckets.join(degree, "id").groupBy("key").agg(F.max_by("id", F.struct("degree", "id")).alias("leader"))
    groups = buckets.select("key", "id").join(leaders, "key").groupBy("leader", "id").agg(F.lit(1).alias("one")).drop("one")
    blocks = groups.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    groups = written(groups.join(blocks, "leader").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")), "groups")
    drop(buckets)
    chosen = classes.join(groups.select("id").distinct(), "id", "left_semi").select("row.doc_id", "row.text_hash")
    bodies = written(_bodies(docs, chosen, shingle, k, key), "bodies")
    # A leader is in every block of its group.
    in_blocks = groups.withColumn("i", F.explode(F.when(F.col("id") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    in_blocks = in_blocks.select("leader", F.lit(None).cast("long").alias("key"), "i", F.col("i").alias("j"), "block", "id", F.col("id").alias("component"))
    links = written(_linked(in_blocks.join(bodies, "id"), limit, k), "links")
    component = connected_components(links)
    later = _later_links(groups, bodies, component, limit, k)
    if not later.isEmpty():
        component = connected_components(links.unionByName(later))
    for table in (bodies, groups, links, later):
        drop(table)
    roots = classes.select("id", "row", "class_id").join(component, "id", "left").withColumn("root", F.coalesce("component", "id")).drop("component")
    return sketches, roots


def near_duplicates(
    documents: DataFrame,
    shingle: int = 5,
    threshold: str = "0.8",
    doc_id: str = "doc_id",
    text: str = "text",
    registers: int = REGISTERS,
) -> DataFrame:
    """A row for each document: doc_id, n_shingles, class_id (least doc_id with the same set), component_id, kept."""
    sketches, roots = _judged(documents, shingle, threshold, doc_id, text, registers)
    least = roots.groupBy("root").agg(F.min("class_id").alias("component_id"))
    of_class = roots.drop("row").join(least, "root").withColumnRenamed("id", "digest")
    out = sketches.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(
    documents: DataFrame,
    shingle: int = 5,
    threshold: str = "0.8",
    doc_id: str = "doc_id",
    text: str = "text",
    registers: int = REGISTERS,
) -> DataFrame:
    """The documents, columns as they are, with one row of each component, and all rows without words.

    It is the row with the least doc_id (one with an id if there is any, then the least hash of the text); of
    rows that repeat its id and text, any one.
    """
    sketches, roots = _judged(documents, shingle, threshold, doc_id, text, registers)
    # Classes know the first row of each component, so no row is joined by its class or component, which may hold a third of all.
    rows = sketches.where(F.col("digest").isNotNull()).select("doc_id", "text_hash", F.lit(1).alias("n"), F.lit(False).alias("stays"))
    best = roots.groupBy("root").agg(F.min("row").alias("row")).select("row.doc_id", "row.text_hash", F.lit(0).alias("n"), F.lit(True).alias("stays"))
    members = rows.unionByName(best).groupBy("doc_id", "text_hash").agg(F.sum("n").alias("n"), F.max("stays").alias("stays"))
    decided = written(members.where("n > 1 or not stays").select("doc_id", "text_hash", "stays"), "decided")
    drop(sketches)
    given = documents.columns
    own = documents.withColumns({"__id": F.col(doc_id), "__hash": F.xxhash64(text)}).alias("d")

    def joined(rows: DataFrame, how: str) -> DataFrame:
        # Decided rows grow with the documents, so they are never broadcast.
        return own.hint("merge").join(rows.alias("r").hint("merge"), F.col("d.__id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.__hash") == F.col("r.text_hash")), how)

    kept = joined(decided, "left_anti").select([F.col(f"d.`{c}`") for c in given])
    repeated = decided.where("stays")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(joined(repeated, "left_semi").dropDuplicates(["__id", "__hash"]).select(given))
