"""Reading some documents, or the counts alone, reads little of the token files."""

from tracewell.llm import token_files


def scan_rows(frame):
    """Rows that the Parquet reader gave out, and the columns it read."""
    rows = frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return rows, leaf.metrics().get("numOutputRows").get().value(), leaf.requiredSchema().fieldNames()


def test_selective_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('text ', id % 7, ' and ', id) as text")
    token_files.write_token_files(docs, path, parts=2)
    rows, read, columns = scan_rows(token_files.tokens_of(spark, path, [7, 19_990]))
    assert sorted(r["doc_id"] for r in rows) == [7, 19_990] and read <= 4 * 2000
    rows, read, columns = scan_rows(token_files.token_counts_of(spark, path))
    assert len(rows) == 20_000 and list(columns) == ["doc_id", "n_tokens"]


def test_rows_of_one_id_are_dealt_out(spark, tmp_path):
    path = str(tmp_path / "t")
    docs = spark.range(4000).selectExpr("if(id % 3 = 0, null, 5L) as doc_id", "if(id % 2 = 0, 'same text', concat('text ', id)) as text").repartition(4)
    token_files.write_token_files(docs, path, parts=4)
    parts = spark.read.parquet(path).groupBy("part").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 1600
    found = token_files.read_token_files(spark, path).orderBy("start").collect()
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in found] == [None] * 1334 + [5] * 2666
