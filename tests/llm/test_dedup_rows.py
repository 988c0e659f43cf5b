"""Near-dedup in the pipeline judges rows: null and repeated doc_ids."""

import random

import corpus_pipeline


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a, 0), (7, a, 1), (None, a, 2), (None, b, 3), (None, b, 4), (9, c, 5), (9, c, 6), (9, d, 7), (3, c, 8), (3, e, 9), (5, e + " more", 10), (11, text(), 11), (None, text(), 12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = corpus_pipeline.deduplicated(spark, frame, "").collect()
    assert all(set(r.asDict()) == {"doc_id", "text", "n"} for r in kept)
    numbers = sorted(r["n"] for r in kept)
    # a: the one with an id; b: either; c: id 3; d shares an id with what goes and stays; e: id 3 once more.
    assert numbers in ([1, 3, 7, 8, 9, 11, 12], [1, 4, 7, 8, 9, 11, 12])
