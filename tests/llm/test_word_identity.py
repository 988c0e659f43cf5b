"""Words, lines and passages that a polynomial hash modulo a power of two takes for each other."""

import hashlib
from fractions import Fraction

import brute
import numpy as np
import pytest

from tracewell.llm import bpe, decontam, near_dedup, quality, substring_dedup, token_counts, token_files
from tracewell.llm.pretokens import read_vocabulary


def thue_morse(n, one, other):
    """n letters, and the same with the two exchanged."""
    odd = [bin(k).count("1") % 2 for k in range(n)]
    return [one if x else other for x in odd], [other if x else one for x in odd]


@pytest.fixture(scope="module", params=[512, 1024, 2048, 8192])
def words(request):
    return ["".join(x) for x in thue_morse(request.param, "a", "b")]


def frame_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)


def test_lines_and_shingles(spark, words):
    a, b = words
    texts = [f"{a}\n{b}\n{a}", f"x {a} y {b} x {b} y {a}"]
    found = {r["doc_id"]: r for r in quality.base_digest(frame_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert (found[i]["n_dup_lines"], found[i]["n_repeat_words"]) == brute.quality(t)[3:5]


def test_near_duplicates_and_decontamination(spark, words):
    texts = [f"one two {w} four five six seven eight nine ten eleven" for w in words]
    for n, limit in ((3, "0.85"), (5, "0.8")):
        found = near_dedup.near_duplicates(frame_of(spark, texts), n, limit)
        component, _ = brute.components(dict(enumerate(texts)), n, Fraction(limit).numerator, Fraction(limit).denominator)
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == component
    items = [(0, texts[0])]
    found = decontam.digest(decontam.decontaminate(frame_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"))).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in found} == dict(enumerate(brute.contamination(texts, items)))


def test_tokens(spark, words):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(read_vocabulary("byte_bpe_50k.json"))
    texts = [*words, words[1] + " " + words[0], words[0][:-1]]
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    ids = {r["doc_id"]: r["ids_sha256"] for r in bpe.round_trip(frame_of(spark, texts)).collect()}
    assert ids == {i: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for i, x in want.items()}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_files.through_files(frame_of(spark, texts)).collect()}
    assert counts == {i: len(x) + 1 for i, x in want.items()}
    alone = [token_counts.token_counts(frame_of(spark, [t])).first()["n_tokens"] for t in texts]
    assert [r["n_tokens"] for r in token_counts.token_counts(frame_of(spark, texts)).orderBy("doc_id").collect()] == alone


def test_passages_of_words(spark):
    """Lines of many words without any end in them, which differ in every word."""
    texts = [" ".join(x) for n in (512, 1024, 4096) for x in thue_morse(n, "ab", "cd")]
    found = substring_dedup.Digests
    from tracewell.llm.textvec import LOWER_WORDS, Words

    import pyarrow as pa

    words = Words(pa.array(texts), LOWER_WORDS)
    whole = found(words)(words.first[:-1], words.first[1:])
    assert len(set(whole.tolist())) == len(texts)
    twice = Words(pa.array([texts[3], texts[2], texts[3]]), LOWER_WORDS)
    whole = found(twice)(twice.first[:-1], twice.first[1:])
    assert whole[0] == whole[2] != whole[1]
