"""Queries of stories."""

from fabula.plans import stories


def test_token_places_counts_no_bytes(spark, sf, tmp_path):
    """A token at the end of a long text costs no walk from its front."""
    docs = spark.createDataFrame([(1, "é word 😀\nend.  x"), (2, ""), (3, None), (4, "a " * 5000)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = stories.token_places(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(1, 0), (4, 0)]
    assert "substring(text" not in out._jdf.queryExecution().optimizedPlan().toString()
