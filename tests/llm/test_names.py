"""Helper columns get out of the way of input columns."""

from fabula.llm.decontaminate import clean
from fabula.llm.names import unused
from fabula.llm.sharding import shuffle_into_shards
from fabula.llm.simhash import keep_one


def test_unused():
    assert unused(["a", "_A", "b"], "A", "c", "c") == ["__A", "c", "_c"]


def test_clashing_columns_stay_as_they_were(spark):
    text = "one two three four five six seven eight nine ten"
    schema = "doc_id long, text string, _print string, _key long, _of int, n int, _r int, _matches array<int>, _fabula_bucket int"
    rows = [(k, t, f"p{k}", k, k, k, k, [k], k) for k, t in enumerate([text, text, "other words " * 9, "and more of these here", text])]
    docs = spark.createDataFrame([*rows, rows[0]], schema)
    key = lambda df: sorted(df.collect(), key=str)
    kept = keep_one(docs)
    assert kept.columns == docs.columns and key(kept) == key(spark.createDataFrame([rows[0], rows[2], rows[3]], schema))
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    left = clean(docs, items)
    assert left.columns == docs.columns and key(left) == key(spark.createDataFrame([rows[2], rows[3]], schema))
    shards = shuffle_into_shards(docs, shards=2).drop("size", "shard", "slot")
    assert shards.columns == docs.columns and key(shards) == key(docs)
