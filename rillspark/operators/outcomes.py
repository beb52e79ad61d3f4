"""Errors beside the data: attempts whose failures are rows with a message, a type and the input, and what may be done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR = "_error"
ERROR_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("message", "type", "input")])


def attempt(df: DataFrame, name: str, tried: Column, source: Column, message: str, kind: str = "ValueError") -> DataFrame:
    """df with column `name`; where `source` is not null but `tried`, a try_ expression, is, the row is an error."""
    failed = source.isNotNull() & tried.isNull()
    error = F.when(failed, F.struct(F.lit(message).alias("message"), F.lit(kind).alias("type"), source.cast("string").alias("input")))
    return df.withColumn(name, tried).withColumn(ERROR, F.coalesce(F.col(ERROR), error) if ERROR in df.columns else error.cast(ERROR_TYPE))


def good(df: DataFrame) -> DataFrame:
    """The rows that are no errors, without the error column."""
    return df.where(F.col(ERROR).isNull()).drop(ERROR) if ERROR in df.columns else df


def bad(df: DataFrame) -> DataFrame:
    """(message, type, input) of the rows that are errors."""
    if ERROR not in df.columns:
        return df.sparkSession.createDataFrame([], ERROR_TYPE)
    return df.where(F.col(ERROR).isNotNull()).select(f"{ERROR}.*")
