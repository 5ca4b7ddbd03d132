"""What the operators share: staging, words, column checks."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foldline.session import stage_table

# Setting, its default, and its value while a table is staged.
WHILE_STAGING = [
    ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false", "true"),
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives a lost executor.

    Shuffle files of the write are dropped as soon as it ends, for the files
    that were written replace them. Whole texts travel to Python in small
    batches meanwhile.
    """
    conf = df.sparkSession.conf
    before = {key: conf.get(key, default) for key, default, _ in WHILE_STAGING}
    for key, _, value in WHILE_STAGING:
        conf.set(key, value)
    try:
        return stage_table(df, name)
    finally:
        for key, value in before.items():
            conf.set(key, value)


def n_parts(df: DataFrame) -> int:
    """Shuffle partitions as the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def row_digest(text: str = "text") -> Column:
    """Tells rows of one id apart: equal text, equal digest; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def rows(columns: Sequence, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
