"""One-hot columns of any width: a dictionary table, a join, and one sparse vector."""

from __future__ import annotations

import uuid

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldline.operators.scans import row_numbers
from foldline.session import shared_dir


def save_dictionary(values: DataFrame) -> tuple[str, int]:
    """Number distinct values 0, 1, ... in order of (MD5, value) and write them; (path, how many).

    Numbers are counted inside buckets of the hash, so no task sorts them all.
    The table belongs to the fitted model: keep the folder as long as the model.
    """
    path = f"{shared_dir(values.sparkSession)}/dictionary-{uuid.uuid4().hex}"
    hashed = values.select("value", F.md5("value").alias("h"))
    numbered = row_numbers(hashed, [], F.substring("h", 1, 3), ["h", "value"], "number")
    numbered.select("value", (F.col("number") - 1).cast("double").alias("place")).write.parquet(path)
    return path, values.sparkSession.read.parquet(path).count()


class DictionaryIndex(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the place of an expression's value in a dictionary table; ``size`` where it is not there."""

    expression = Param(Params._dummy(), "expression", "SQL of the value", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of the place", TypeConverters.toString)
    dictionary = Param(Params._dummy(), "dictionary", "path of the table (value, place)", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "values in the dictionary", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, expression: str | None = None, outputCol: str | None = None, dictionary: str | None = None, size: int | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        """A left join on the value: the table is read from files, so Spark broadcasts it under its own threshold and splits hot values beyond it."""
        name = self.getOrDefault(self.outputCol)
        table = SparkSession.active().read.parquet(self.getOrDefault(self.dictionary)).select(F.col("value").alias(f"__value_{name}"), F.col("place").alias(f"__place_{name}"))
        joined = df.withColumn(f"__own_{name}", F.expr(self.getOrDefault(self.expression))).join(table, F.col(f"__own_{name}") == F.col(f"__value_{name}"), "left")
        place = F.coalesce(F.col(f"__place_{name}"), F.lit(float(self.getOrDefault(self.size))))
        return joined.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name))


def wide_one_hot(expression: str, output: str, dictionary: str, size: int) -> list:
    """Stages that add ``output``, a sparse vector of ``size`` places, all zero for a value that is not in the dictionary."""
    spark = SparkSession.active()
    place = f"{output}__place"
    # The encoder only learns the number of places from its input; its last one, of unknown values, is dropped.
    highest = spark.range(1).select(F.lit(float(size - 1)).alias(place))
    encoder = OneHotEncoder(inputCols=[place], outputCols=[output], handleInvalid="keep", dropLast=True).fit(highest)
    return [DictionaryIndex(expression=expression, outputCol=place, dictionary=dictionary, size=size), encoder]
