"""The pipeline's stages against brute force, each on what the one before kept."""

import brute
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    prose = {"en": "the and then thing with that is of on at her our", "fr": "le la que nous avec dans une été plus pour tout bien"}
    import random

    rng = random.Random(3)
    text = lambda lang, n: " ".join(rng.choice(prose[lang].split()) + str(rng.randint(0, 99)) for _ in range(n))
    item = text("en", 15)
    docs = [(k, text("en" if k % 2 else "fr", 80), "en" if k % 2 else "fr") for k in range(40)]
    docs += [(100, None, "en"), (101, "12 34", "en"), (102, docs[4][1], "fr"), (103, docs[5][1] + " more", "en"), (104, text("en", 20) + " " + item, "en"), (105, text("fr", 30) + " password = hunter22 x", "fr")]
    frame = spark.createDataFrame([(i, t, lang, "s", len(t or ""), True) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long, kept boolean")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == frame.columns
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = {r["doc_id"]: r for r in now.collect()}
    all_ids = {i for i, *_ in docs}
    assert set(kept["language ID"]) == all_ids - {100, 101}
    component, _ = brute.components({i: r["text"] for i, r in kept["language ID"].items()}, 5, 4, 5)
    assert set(kept["MinHash near-dedup"]) == {i for i, c in component.items() if i == c} == all_ids - {100, 101, 102, 103}
    assert set(kept["benchmark decontamination"]) == set(kept["MinHash near-dedup"]) - {104}
    redacted = kept["secret scans"]
    assert set(redacted) == set(kept["benchmark decontamination"])
    assert redacted[105]["text"].endswith(" [secret] x") and redacted[105]["n_chars"] == len(redacted[105]["text"])
    assert all(redacted[i]["text"] == r["text"] for i, r in kept["benchmark decontamination"].items() if i != 105)
    assert set(kept["BPE encoding and decoding"]) == set(redacted)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(redacted)
