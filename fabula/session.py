"""Session, table and shared-folder helpers used by every operator."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fabula")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Spark's reader alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none (single-process tests) one is made and
    set, so that ``checkpoint()`` and written tables agree on the place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="fabula-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_dir(spark)}/fabula-{what}-{uuid.uuid4().hex}"


#: Spark drops a query's shuffle files when it ends, if this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries that start inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, what: str = "table", compression: str | None = None, **options: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet in the shared folder and
    read back. Cuts the lineage and survives the loss of any executor. Options
    are those of Spark's writer."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    with shuffles_dropped(spark):
        df.write.options(**options | ({"compression": compression} if compression else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder, for loops that must converge."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
