"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "foldline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="foldline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage_table(df: DataFrame, name: str, partition_by: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For tables that several jobs scan (joins, hashes and splits behind every
    pass of a fit): the work is done once, the lineage is cut, a lost executor
    costs one re-read, and each job still prunes columns and partitions. The
    folder is scratch space of the run. ``dense``: for wide copies of all rows,
    files take less room and a little more time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd") if dense else df.write
    writer.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


STAGED = re.compile(r".*/[^/]+-[0-9a-f]{32}(?=/)")


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more, so that copies of all rows do not add up over a run."""
    spark, found = df.sparkSession, {m.group() for f in df.inputFiles() if (m := STAGED.match(f))}
    for folder in found:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_and_release(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Stage a large table densely and drop the shuffle files of its joins as soon as it is written, which else stay until the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(RELEASE, "false")
    conf.set(RELEASE, "true")
    try:
        return stage_table(df, name, partition_by, dense=True)
    finally:
        conf.set(RELEASE, before)


def sized(df: DataFrame) -> DataFrame:
    """Write a join side that is expected to be small, so that Spark knows its size.

    An aggregate's size is unknown when a join is planned, and the large side
    would be shuffled for it. Read from files, the side is broadcast if it is
    under Spark's own threshold, and joined by a shuffle if it is not.
    """
    return stage_table(df, "side")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table that arrives in fewer pieces than there are cores.

    A small table in one file is one task otherwise. Large tables come in many
    pieces and pass through unchanged, without a shuffle.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
