"""The stored index: blocks built by the tasks that hold their ranges, queries in several blocks."""

import random

from kgspark.operators import search as R
from kgspark.operators import textindex as I


def test_index_in_batches_and_blocks_of_queries(spark, monkeypatch, tmp_path):
    """Ranges that span batches, repeated rows, text ids and several blocks of queries give the rows of the search without an index."""
    monkeypatch.setattr(I, "BLOCK", 4)
    monkeypatch.setattr(I, "RUN", 3)
    monkeypatch.setattr(I, "PAIRS", 8)
    rng = random.Random(8)
    vocabulary, weights = [f"w{k}" for k in range(150)], [1 / (k + 2) for k in range(150)]
    rows = [(f"d{k}", " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 2, 9, 60])))) for k in range(700)] + [("same", "W3 w4 w77")] * 2 + [("none", None), (None, "w3 w9")]
    queries = [(f"q{k}", " ".join(rng.choices(vocabulary, k=3))) for k in range(11)] + [("nothing", "zzz"), ("empty", ""), ("both", "w77 zzz w3")]
    docs, asked = spark.createDataFrame(rows, "id string, text string"), spark.createDataFrame(queries, "query_id string, query string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        index = I.write_index(docs, "id", "text", f"file://{tmp_path}/index", size=16, buckets=8)
        got = {tuple(r) for r in I.indexed_search(spark, index, asked, 6, buckets=8).select("query_id", "id", "score", "rank").collect()}
        none = I.indexed_search(spark, index, asked.filter("query_id IN ('nothing', 'empty')"), 6, buckets=8).count()
        nobody = I.indexed_search(spark, index, asked.limit(0), 6, buckets=8).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {tuple(r) for r in R.fulltext_search(docs, asked, "id", "text", 6).select("query_id", "id", "score", "rank").collect()}
    assert got == want and len(want) > 60 and none == nobody == 0
    blocks = spark.read.parquet(index.path)
    assert blocks.groupBy("term", "range").count().filter("count > 1").count() == 0 and blocks.filter("rows > 16 OR rows <> size(ids) OR rows <> size(impacts)").count() == 0
    assert blocks.select("range").distinct().count() <= 704 // 16 + 4 + 1
    alone = I.write_index(docs.filter("id = 'none'"), "id", "text", f"file://{tmp_path}/alone", buckets=8)
    assert alone.n == 1 and I.indexed_search(spark, alone, asked, 6, buckets=8).count() == 0
