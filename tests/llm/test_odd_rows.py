"""Null and repeated doc_ids, texts longer than a chunk, and equal rows, in every operator that answers row by row."""

import hashlib
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from tracewell.llm import bpe, decontam, quality, resharding, secret_scan, token_counts, token_files
from tracewell.llm.pretokens import CHUNK, read_vocabulary


@pytest.fixture(scope="module")
def rows():
    long = "some words here, again. " * (CHUNK // 20) + "the end"
    return [(None, "null id one"), (None, "another null id"), (5, "five"), (5, "five again, other text"), (5, "five"), (6, long), (7, None)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def counted(found, *columns):
    return Counter(tuple(r) for r in found.select(*columns).collect())


def test_tokens(frame, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(read_vocabulary("byte_bpe_50k.json"))
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(x), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for (i, t), x in zip(rows, ids, strict=True))
    assert counted(bpe.round_trip(frame), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    want = Counter((i, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for (i, _), x in zip(rows, ids, strict=True))
    found = token_files.through_files(frame)
    assert counted(found, "doc_id", "n_tokens", "ids_crc32") == want
    at = 0
    for r in sorted(found.collect(), key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert sorted(r["doc_id"] or 0 for r in token_counts.token_counts(frame).collect()) == sorted(i or 0 for i, _ in rows)


def test_counts_spans_and_shards(spark, frame, rows):
    found = counted(quality.base_digest(frame), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert found == Counter((i, *brute.quality(t)) for i, t in rows)
    assert counted(secret_scan.digest(frame), "doc_id", "n_assign") == Counter((i, 0) for i, _ in rows)
    items = [(1, "five again other text"), (2, "again some words")]
    found = decontam.digest(decontam.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string")))
    want = brute.contamination([t for _, t in rows], items)
    assert counted(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == Counter((i, *x) for (i, _), x in zip(rows, want, strict=True))
    shards = resharding.digest(spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, source string"))
    assert counted(shards, "doc_id", "size") == Counter((i, len((t or "").encode()) + 1) for i, t in rows)
