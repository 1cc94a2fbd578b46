"""Two-pass external shuffle of records into shards.

Pass one scatters the records uniformly into memory-sized buckets by a seeded
hash; pass two brings a bucket into a canonical order, Fisher-Yates shuffles it
with a generator seeded by (seed, bucket) and hands out consecutive positions.
Law ``rows``: shard sizes differ by one row at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fabula.llm.names import unused
from fabula.session import new_folder, shuffles_dropped

LAW = "rows"


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of 0..n-1; numpy's shuffle is the Fisher-Yates walk."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
    return order


def shard_of(position: np.ndarray, total: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global positions when the first ``total % shards``
    shards hold one row more than the others."""
    q, r = divmod(total, shards)
    wide = r * (q + 1)
    late = position >= wide
    shard = np.where(late, r + (position - wide) // max(q, 1), position // (q + 1))
    start = np.where(late, wide + (shard - r) * q, shard * (q + 1))
    return shard.astype(np.int32), (position - start).astype(np.int64)


def shuffle_into_shards(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 16, seed: int = 20240, bucket_bytes: int = 24 << 20
) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``shard`` and ``slot`` added.

    size is the UTF-8 length of the text (null: 0) plus 1. Slots are gapless
    from 0 in each shard. The order depends on the rows' keys and texts and on
    ``seed`` alone, not on how the input was partitioned. Null keys and texts
    are rows like any other; rows with equal key and text are interchangeable;
    an empty table gives an empty one; an input column named size, shard or
    slot is replaced, all others stay, whatever their names. Texts of any length are moved whole. A bucket holds ``bucket_bytes`` on average, whatever the
    input's size, and one task at a time works on one bucket.
    """
    base = docs.drop("size", "shard", "slot").withColumn("size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)
    total, n = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, math.ceil(total / bucket_bytes))
    (in_bucket,) = unused(base.columns, "_fabula_bucket")
    scattered = base.withColumn(
        in_bucket, F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), F.lit(buckets)).cast("int")
    )
    counts = scattered.groupBy(in_bucket).count()
    before = Window.orderBy(in_bucket).rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    starts = counts.select(in_bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    names = base.columns

    def second_pass(k: tuple, rows: pa.Table, start: pa.Table) -> pa.Table:
        bucket = k[0].as_py()
        rows = rows.select(names)
        order = pc.sort_indices(rows, sort_keys=[(key, "ascending"), ("size", "ascending"), (text, "ascending")])
        canonical = rows.take(order)
        mixed = canonical.take(pa.array(fisher_yates(rows.num_rows, seed, bucket)))
        position = start.column("_start")[0].as_py() + np.arange(rows.num_rows, dtype=np.int64)
        shard, slot = shard_of(position, n, shards)
        return mixed.append_column("shard", pa.array(shard)).append_column("slot", pa.array(slot))

    out = base.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).schema
    # A partition per bucket, so that no task grows with the input.
    dealt = scattered.repartition(buckets, in_bucket)
    return dealt.groupBy(in_bucket).cogroup(starts.groupBy(in_bucket)).applyInArrow(second_pass, out)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; files hold consecutive slots in order."""
    with shuffles_dropped(sharded.sparkSession):
        sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all shards that were written with this schema."""
    return spark.read.schema(schema).parquet(path)


def written_shards(docs: DataFrame, **options) -> DataFrame:
    """``shuffle_into_shards``, written to the shared folder and read back."""
    sharded = shuffle_into_shards(docs, **options)
    path = new_folder(docs.sparkSession, "shards")
    write_shards(sharded, path)
    return read_shards(docs.sparkSession, path, sharded.schema)


def digest(sharded: DataFrame, *, text: str = "text") -> DataFrame:
    return sharded.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
