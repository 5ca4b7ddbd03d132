"""Reading input tables and writing report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from foldline.functions.numeric import clean
from foldline.session import stage_table

# The columns of a score table, in their order.
SCORE_COLUMNS = ("target", "dataset", "MAE", "RMSE", "R2")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, format: str | None = None) -> DataFrame:
    """A CSV file with header, or Parquet, by ``format`` or else by suffix; a missing path is an error.

    Give a schema for large CSV input: inferring one costs an extra scan. NaN
    becomes NULL, so that both count as missing.
    """
    if (format or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")) == "parquet":
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.parquet(path)
    else:
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        df = reader.csv(path)
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[clean(F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


CORRUPT = "_corrupt_record"


def read_checked_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sample: float = 0.01, header: bool = True) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(good rows, corrupt records, counts) of a CSV file.

    Without a schema the types are inferred from a share of the rows and then
    hold for all. A row is corrupt if it has more or fewer fields than the
    schema, or a field that is not of its type; its text is kept. The file is
    parsed once: both tables are read from what that pass wrote, and the counts
    ``n_rows`` and ``n_corrupt`` were observed in it.
    """
    if schema is None:
        schema = spark.read.option("header", header).option("inferSchema", True).option("samplingRatio", sample).csv(path).schema
    known = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if CORRUPT in known.names:
        raise ValueError(f"{CORRUPT} is the name of the corrupt records")
    reader = spark.read.schema(T.StructType([*known.fields, T.StructField(CORRUPT, T.StringType())]))
    parsed = reader.option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    seen = Observation("checked")
    staged = stage_table(parsed.observe(seen, F.count("*").alias("n_rows"), F.count(CORRUPT).alias("n_corrupt")), "checked")
    good = staged.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    floats = {f.name for f in known.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    good = good.select(*[clean(F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in good.columns])
    return good, staged.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record")), {k: int(v) for k, v in seen.get.items()}


def write_scores(df: DataFrame, path: str, columns: Sequence[str] = SCORE_COLUMNS, bom: bool = False) -> None:
    """A score table as CSV with header in fixed column order; maps are written as JSON text.

    ``bom`` puts a UTF-8 byte-order mark before the first header name.
    """
    maps = {f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)}
    out = df.select(*[F.to_json(c).alias(c) if c in maps else F.col(c) for c in columns])
    if bom:
        out = out.withColumnRenamed(columns[0], "﻿" + columns[0])
    out.write.mode("overwrite").option("header", True).csv(path)
