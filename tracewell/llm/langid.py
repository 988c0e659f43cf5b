"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram's vector is its letters'
vectors, each permuted (rotated) by its place, multiplied together; a text's or a
language's vector is the sum of its trigrams' vectors, and texts are given to the
language with the largest cosine.  Letters are a to z and classes of other letters
by their code point, word borders count as a letter, so there are at most 48**3
trigrams; a language's vector is made from its trigram counts over all learning
documents, which are summed before they are shuffled.

Defined results: a null text, one without letters, or any text when nothing could be
learned is `und` with score 0; equal cosines go to the language first in order;
repeated rows give repeated equal results; a null doc_id is not held out; a very long text is
a chunk of its own; an empty table gives no rows; more than MOST_LANGUAGES languages are an error.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .textvec import chunks, held, map_texts, text_buffers

DIMENSIONS = 1024
ALPHABET = 48  # a word border, a to z, and 21 classes of other letters
GRAMS = ALPHABET**3
FLUSH_LANGUAGES = 64
MOST_LANGUAGES = 4096  # 8 KB each on the driver and in a broadcast
ENOUGH = 20  # texts of a length to tell what is typical of it


@functools.cache
def letter_classes() -> np.ndarray:
    """The letter number of each code point, 0 for what is no letter; both cases are one letter."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = ord(chr(c).lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % (ALPHABET - 27)
    return table


class GramVectors:
    """Trigrams' vectors, made when first needed."""

    def __init__(self, dimensions: int = DIMENSIONS):
        letters = np.random.Generator(np.random.PCG64(7)).integers(0, 2, (ALPHABET, dimensions), dtype=np.int8) * 2 - 1
        self.by_place = [np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters]
        self.row = np.full(GRAMS, -1, np.int32)
        self.rows = np.zeros((1024, dimensions), np.int8)
        self.n = 0

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        new = grams[self.row[grams] < 0]
        if len(new):
            while self.n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            a, b, c = new // ALPHABET**2, new // ALPHABET % ALPHABET, new % ALPHABET
            self.rows[self.n : self.n + len(new)] = self.by_place[0][a] * self.by_place[1][b] * self.by_place[2][c]
            self.row[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
        return self.rows[self.row[grams]]


def vectors() -> GramVectors:
    return held(("trigrams",), GramVectors)


def trigrams(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct trigrams of each text and their counts; none if it has no letter."""
    data, offsets = text_buffers(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    kinds, out = letter_classes()[points], []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        own = np.concatenate([[0], kinds[a:b], [0]]).astype(np.int64)
        own = own[np.concatenate([[True], (own[1:] != 0) | (own[:-1] != 0)])]  # borders in a row are one
        grams = own[:-2] * ALPHABET**2 + own[1:-1] * ALPHABET + own[2:]
        out.append(np.unique(grams, return_counts=True))
    return out


def bundle(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the trigrams' vectors; in slices, as a language has all of them."""
    total = np.zeros(DIMENSIONS, np.float64)
    for k in range(0, len(grams), 4096):
        total += counts[k : k + 4096].astype(np.float32) @ vectors()(grams[k : k + 4096]).astype(np.float32)
    return total


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(documents: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit vectors, from all rows of documents that have a language."""
    rows = documents.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, total in sums.items():
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])], names=["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            for part in chunks(batch):
                for name, (grams, counts) in zip(part.column("lang").to_pylist(), trigrams(part.column("text")), strict=True):
                    if name not in sums:
                        if len(sums) >= FLUSH_LANGUAGES:
                            yield from flush()
                        sums[name] = np.zeros(GRAMS, np.int64)
                    sums[name][grams] += counts
        yield from flush()

    counted = map_texts(rows, count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def sum_up(group: pd.DataFrame) -> pd.DataFrame:  # at most GRAMS rows
        group = group.sort_values("gram")
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "vector": [bundle(group["gram"].to_numpy(), group["n"].to_numpy())]})

    made = counted.groupBy("lang").applyInPandas(sum_up, "lang string, vector array<double>").orderBy("lang").limit(MOST_LANGUAGES + 1).collect()  # one row a language
    if len(made) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    matrix = np.array([r["vector"] for r in made], np.float64).reshape(len(made), DIMENSIONS)
    return [r["lang"] for r in made], matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def identify(documents: DataFrame, languages: list[str], profiles: np.ndarray, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents with two columns more: the predicted language and its cosine, at least 0."""
    shared = documents.sparkSession.sparkContext.broadcast((languages, profiles.astype(np.float32)))  # 4 KB a language
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            for part in chunks(batch, batch.schema.names[at]):
                found, cosines = [], []
                for grams, counts in trigrams(part.column(at)):
                    best, cosine = "und", 0.0
                    if len(grams) and names:
                        own = bundle(grams, counts)
                        near = matrix @ own / max(np.linalg.norm(own), 1e-12)
                        k = int(np.argmax(near))
                        best, cosine = names[k], float(min(max(near[k], 0), 1))
                    found.append(best)
                    cosines.append(cosine)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(cosines, pa.float64())], names=[*part.schema.names, pred, score])

    schema = StructType([*documents.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])
    return map_texts(documents, run, schema)


def length_band(text: Column) -> Column:
    """Half to whole powers of two of a text's length."""
    return F.floor(F.log2(F.coalesce(F.length(text), F.lit(0)) + 1.0)).cast("int")


def least_scores(documents: DataFrame, languages: list[str], profiles: np.ndarray, share: float = 1 / 3, lang: str = "lang", text: str = "text") -> list[float]:
    """For each length band the score under which a text is in none of the languages: a share of the median score of the band's documents that have a language, all of which count.

    Short texts are less like their language than long ones, so the bound rises with the length.  A band with fewer than ENOUGH
    documents takes the bound of the next shorter one that has enough, or 0.
    """
    texts = documents.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"))
    scored = identify(texts, languages, profiles).where("lang_pred <> 'und'").groupBy(length_band(F.col("text")).alias("band"))
    typical = {r["band"]: r["typical"] for r in scored.agg(F.count("*").alias("n"), F.percentile_approx("score", 0.5, 10_000).alias("typical")).where(f"n >= {ENOUGH}").collect()}  # at most 32 rows
    out, bound = [], 0.0
    for band in range(32):
        bound = typical[band] * share if band in typical else bound
        out.append(bound)
    return out


def in_a_language(documents: DataFrame, languages: list[str], profiles: np.ndarray, least: list[float], text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that are in some language, columns as they are; where lang is null it is the predicted one."""
    names = {"pred": "pred", "score": "score"}
    for key in names:
        while names[key] in documents.columns:
            names[key] += "_"
    bounds = F.array(*[F.lit(x) for x in least])
    found = identify(documents, languages, profiles, text, names["pred"], names["score"])
    found = found.where((F.col(names["pred"]) != "und") & (F.col(names["score"]) >= F.element_at(bounds, length_band(F.col(text)) + 1)))
    kind = documents.schema[lang].dataType
    return found.withColumn(lang, F.coalesce(F.col(lang), F.col(names["pred"]).cast(kind))).select(documents.columns)


def cross_checked(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The columns of the query: learns from the documents that are not held out and predicts all."""
    languages, profiles = learn(documents.where(~held_out(F.col(doc_id))), lang, text)
    docs = documents.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return identify(docs, languages, profiles).drop("text")
