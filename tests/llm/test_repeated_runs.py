"""Shared words without line or sentence ends, against a brute force that knows no units."""

import random

import pytest

from tracewell.llm import substring_dedup


def repeats(docs, n=51):
    """The words (by number) of runs of n words that an earlier place has too and doesn't overlap."""
    first, out = {}, {i: set() for i in docs}
    for i in sorted(docs):
        w = docs[i].lower().split()
        for k in range(len(w) - n + 1):
            at = first.setdefault(tuple(w[k : k + n]), (i, k))
            if at[0] != i or k >= at[1] + n:
                out[i] |= set(range(k, k + n))
    return out


def removed(frame):
    """The numbers of the removed words, by doc_id."""
    out = {}
    for r in frame.select("doc_id", "text").join(substring_dedup.find_repeats(frame), "doc_id").collect():
        ends = [x for x, c in enumerate(r["text"] + " ") if c == " "]
        out[r["doc_id"]] = {k for k, e in enumerate(ends) if any(s < e <= t for s, t in r["removed"])}
    return out


def planted(lengths, sentence):
    """Pairs of documents that share a passage inside a line; sentences have that many words, or there are none."""
    rng, docs = random.Random(7), {}
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    text = lambda n: [word() + ("." if sentence and rng.random() < 1 / sentence else "") for _ in range(n)]
    for k in range(300):
        passage = text(lengths[k % len(lengths)])
        for i in (2 * k, 2 * k + 1):
            docs[i] = " ".join(text(rng.randint(20, 90)) + passage + text(rng.randint(20, 90)))
    return docs


def frame_of(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)


def test_unpunctuated_passages_go_whole(spark):
    docs = planted((51, 52, 60, 100, 50), None)
    docs |= {1000: "und " * 80, 1001: "a b c " * 60, 1002: " ".join(docs[0].split()[:70]) + " x " + docs[0]}
    docs = {i: t.strip() for i, t in docs.items()}
    want, found = repeats(docs), removed(frame_of(spark, docs))
    # Units may find passages of 50 words and, in the text of one word, what overlaps.
    for i in docs:
        assert found[i] >= want[i]
        if len(want[i]) and i < 1000:
            assert found[i] == want[i]


@pytest.mark.parametrize("sentence", [15, 35])
def test_no_passage_of_51_words_is_missed(spark, sentence):
    docs = planted((51, 60), sentence)
    want, found = repeats(docs), removed(frame_of(spark, docs))
    missed = [i for i in docs if want[i] and not found[i] & want[i]]
    assert not missed and sum(map(bool, want.values())) == 300
    assert all(found[i] <= want[i] for i in docs)
