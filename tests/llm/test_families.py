"""Families of near texts: those that meet and never link, and rows without ids or with others' ids."""

from fractions import Fraction

import brute
import numpy as np

from tracewell.llm import near_dedup, substring_dedup


def test_a_family_that_meets_and_never_links(spark, monkeypatch):
    """Texts of one template, similar to 0.7: later comparisons are of those that share what is their own, not of all blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng, template = np.random.default_rng(1), [f"w{k}" for k in range(200)]
    texts = {i: " ".join(template + [f"own{i}x{k}" for k in range(40)]) for i in range(150)}
    twins = {1000 + i: " ".join(template + [f"own{i}x{k}" for k in range(38)] + ["changed", "end"]) for i in range(0, 150, 10)}
    texts |= twins
    seen = []
    real = near_dedup._linked

    def counted(dealt, threshold, k):
        seen.append(dealt.groupBy("leader", "key", "i", "j").count().agg({"count": "sum"}).first()[0] or 0)
        return real(dealt, threshold, k)

    monkeypatch.setattr(near_dedup, "_linked", counted)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = near_dedup.near_duplicates(frame, 3, "0.85").collect()
    component, _ = brute.components(texts, 3, 85, 100)
    assert {r["doc_id"]: r["component_id"] for r in found} == component
    assert len(set(component.values())) == 150 and rng is not None
    assert len(seen) == 2 and seen[1] < 4 * len(texts)  # not blocks times classes


def test_rows_without_ids_or_with_others_ids(spark):
    rng = np.random.default_rng(2)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10_000, 60))
    a, b, c = text(), text(), text()
    rows = [(None, a), (4, a), (4, b), (4, b), (None, c), (None, c), (9, a + " more"), (9, None), (None, "")]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, "0.85").collect()
    limit = Fraction("0.85")
    sizes = [len(brute.shingles(t, 3)) for _, t in rows]
    assert limit and sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == sorted((str(i), n, str(x)) for (i, _), n, x in zip(rows, sizes, [4, 4, 4, 4, None, None, 4, 9, None], strict=True))


def test_ranges_of_rows_that_share_an_id(spark):
    """(2, another text) repeats nothing and loses nothing; a null id ranks first."""
    long = " ".join(f"word{k}" for k in range(30)) + "."
    rows = [(1, f"Alone here.\n{long}"), (2, f"Other start.\n{long}"), (2, "A text of quite different words in one line that nobody else has, at all."), (None, f"{long}\nNull."), (None, None)]
    found = substring_dedup.find_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    removed = sorted((str(r["doc_id"]), r["n_words"], r["n_removed_words"]) for r in found)
    assert removed == [("1", 32, 30), ("2", 15, 0), ("2", 32, 30), ("None", 0, 0), ("None", 31, 0)]
    assert all(r["from_docs"] in ([], [None]) or r["n_removed_words"] for r in found)
