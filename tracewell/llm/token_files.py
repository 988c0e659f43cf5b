"""Token-id files: Parquet with a delta-encoded list column, in ascending order of doc_id.

Rows: doc_id, part, part_start (ids before the document within its part), n_tokens and
ids.  Documents are dealt to parts by ranges of doc_id, then a hash of the text and the place in
the input (so that rows of one id, or equal rows, are no single task's), and sorted within them, so parts
follow each other.  Ids are written with the DELTA_BINARY_PACKED encoding (dictionaries are
off for them, page version 2), in row groups and pages of set sizes with page indexes:
a reader of single documents or of the counts alone skips the pages of all other ids.
A document's global start is its part's start plus part_start; parts' totals are read
from the metadata columns alone.

Defined results: a null text is read as an empty one and has the end id alone; null
doc_ids come first; rows that repeat a doc_id follow each other in order of the text's hash;
a very long text is encoded as a chunk of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pretokens import BYTE_BPE, CHUNK, Flat, PreTokens, WordCache, flat, read_vocabulary, special_tokens, token_bytes
from .store import new_path
from .textvec import chunks, held, map_texts

OPTIONS = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary#ids.list.element": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}


JOINED = 100


class LibraryEncoder:
    """Ids by the tokenizers library. Each distinct pre-token is encoded once.

    Pre-tokens that begin with a blank stay apart when they are put together, so many are encoded
    as one text and told apart by the tokens that begin with a blank (without offsets and word numbers,
    which the library takes longer for than for the ids); the others are encoded one by one.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        parsed = json.loads(vocabulary)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = list(special_tokens(parsed))
        tokens = token_bytes(parsed)
        self.begins = np.zeros(max(tokens) + 1, bool)
        self.begins[[i for i, t in tokens.items() if t[:1] == b" "]] = True
        self.cache = WordCache(self._encode)

    def _ids(self, texts: list[str]) -> Flat:
        return flat(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _encode(self, words: list[str]) -> Flat:
        special = {w for w in self.special if w[:1] == " "}
        joined = np.fromiter((w[0] == " " and len(w) > 1 and not w[1].isspace() and w not in special for w in words), bool, len(words))
        apart, others = np.flatnonzero(joined), np.flatnonzero(~joined)
        some = [words[k] for k in apart.tolist()]
        ids, _ = self._ids(["".join(some[lo : lo + JOINED]) for lo in range(0, len(some), JOINED)])
        cuts = np.flatnonzero(self.begins[ids])
        if len(cuts) != len(some):  # each has one blank, its first character
            raise ValueError("pre-tokens did not stay apart")
        more, more_sizes = self._ids([words[k] for k in others.tolist()])
        values, own = np.concatenate([ids, more]), np.concatenate([np.diff(np.append(cuts, len(ids))), more_sizes])
        order = np.concatenate([apart, others])
        sizes, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        sizes[order], starts[order] = own, np.cumsum(own) - own
        return values[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(values))], sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        tokens = PreTokens(column, self.special)
        values, to = self.cache.lookup(tokens)
        return values, to[tokens.first]


def write_token_files(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = BYTE_BPE, end_id: int = 2, parts: int | None = None) -> None:
    """Encode the documents, each with end_id appended, into token files under path."""
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))  # a file of some MB, whatever the corpus
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, done, part_number = held(("library", shared.value), lambda: LibraryEncoder(shared.value)), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in chunks(batch, most=CHUNK):
                ids, to = encoder.encode(part.column("text"))
                n = part.num_rows
                ended = np.insert(ids, to[1:], end_id).astype(np.int32)
                to = to + np.arange(n + 1)
                columns = [part.column("doc_id"), pa.array(np.full(n, part_number, np.int32)), pa.array(done + to[:-1]), pa.array(np.diff(to)), pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(ended))]
                done += int(to[-1])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "part_start", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed, order = docs.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()}), ["doc_id", "hash", "place"]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    encoded = map_texts(ordered.select("doc_id", "text"), run, f"doc_id {kind}, part int, part_start long, n_tokens long, ids array<int>")
    encoded.write.options(**OPTIONS).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    files = spark.read.parquet(path)
    # One row of two numbers for each part (as many as write_token_files was given), so it can be broadcast: 16 MB for a million parts.
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(F.col("part"), before.alias("before"))
    return files.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def token_counts_of(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and n_tokens of all documents, from these columns' pages alone."""
    return spark.read.parquet(path).select("doc_id", "n_tokens")


def tokens_of(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """doc_id, n_tokens and ids of some documents (a stated list); only the pages that may hold them are read."""
    return spark.read.parquet(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """The columns of the query: doc_id, start, n_tokens, and crc32 of the ids as little-endian 32-bit integers."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.asarray(ids.values).astype("<u4").tobytes()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_texts(tokens, run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def through_files(documents: DataFrame) -> DataFrame:
    """Write the documents' token files into the shared folder and read all of them back."""
    spark = documents.sparkSession
    path = new_path(spark, "tokens")
    write_token_files(documents, path)
    return checksums(read_token_files(spark, path))
