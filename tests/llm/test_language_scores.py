"""Cosines by brute force, ties, ids that are null, and what the pipeline's bound drops."""

import random

import numpy as np
import pytest

from tracewell.llm import langid

EN = "the and then thing with that is of on at her our would there about which".split()
FR = "le la que nous avec dans une plus pour tout bien cette leurs fait".split()


def profile(texts):
    letters = np.random.Generator(np.random.PCG64(7)).integers(0, 2, (langid.ALPHABET, langid.DIMENSIONS), dtype=np.int8) * 2 - 1
    table, total = langid.letter_classes(), np.zeros(langid.DIMENSIONS)
    for text in texts:
        kinds = [0]
        for c in text:
            k = int(table[ord(c)])
            if k or kinds[-1]:
                kinds.append(k)
        if kinds[-1]:
            kinds.append(0)
        for a, b, c in zip(kinds, kinds[1:], kinds[2:]):
            total += np.roll(letters[a], 2).astype(float) * np.roll(letters[b], 1) * letters[c]
    return total / max(np.linalg.norm(total), 1e-12)


@pytest.fixture(scope="module")
def learning(spark):
    rng = random.Random(1)
    return [(k, " ".join(rng.choice(EN if k % 2 else FR) for _ in range(rng.choice([1, 3, 10, 60]))), "en" if k % 2 else "fr") for k in range(400)]


def test_cosines(spark, learning):
    frame = spark.createDataFrame(learning, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in langid.cross_checked(frame).collect()}
    known = {lang: profile([t for i, t, x in learning if x == lang and not found[i]["held_out"]]) for lang in ("en", "fr")}
    for i, t, _ in learning[:60]:
        near = {lang: max(0.0, float(profile([t]) @ p)) for lang, p in known.items()}
        best = max(sorted(near), key=near.get)
        assert found[i]["lang_pred"] == best and found[i]["score"] == pytest.approx(near[best], abs=1e-5)


def test_ties_null_ids_and_nothing_to_learn(spark):
    same = [(None, "abc def", "zz"), (None, "abc def", "aa"), (2, "12", "aa")]
    found = langid.cross_checked(spark.createDataFrame(same, "doc_id long, text string, lang string")).collect()
    assert [(r["lang_pred"], r["held_out"]) for r in found if r["doc_id"] is None] == [("aa", False)] * 2
    bare = spark.createDataFrame([(None, "12 34", "aa"), (1, "abc", None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.cross_checked(bare).collect()} <= {("und", 0.0), ("aa", 0.0)}
    assert [r["lang_pred"] for r in langid.cross_checked(bare.where("doc_id = 1")).collect()] == ["und"]


def test_what_is_in_no_language_goes(spark, learning):
    rng = random.Random(4)
    gibberish = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(100)) for _ in range(40)]
    foreign = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(150)) for _ in range(40)] + [" ".join("".join(chr(rng.randint(0x3B1, 0x3C9)) for _ in range(6)) for _ in range(60)) for _ in range(40)]
    rows = [*learning, *((1000 + k, t, None) for k, t in enumerate([*gibberish, *foreign, "12 34", None, " ".join(EN), " ".join(FR)]))]
    frame = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, score double, pred string")
    learn = frame.where(~langid.held_out(frame.doc_id))
    languages, profiles = langid.learn(learn)
    least = langid.least_scores(learn, languages, profiles)
    assert least == sorted(least[:4]) + least[4:] and len(least) == 32
    kept = langid.in_a_language(frame, languages, profiles, least)
    assert kept.columns == frame.columns
    kept = {r["doc_id"]: r for r in kept.collect()}
    clean = sum(i in kept for i, *_ in learning) / len(learning)
    assert clean > 0.99 and all(r["score"] == 1.0 and r["pred"] == "x" for r in kept.values())
    gone = [k for k in range(1000, 1000 + 120) if k not in kept]
    assert len(gone) >= 114 and 1120 not in kept and 1121 not in kept
    assert kept[1122]["lang"] == "en" and kept[1123]["lang"] == "fr"
