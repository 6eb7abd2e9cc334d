"""Sinks for forecasts, diagnostics and reports as text, and their way back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ending of a column that holds another one as JSON text.
ENDING = "_json"


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def to_text(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text under their name and _json; null stays null."""
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name + ENDING) if _nested(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def from_text(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of schema out of what to_text made, read from text or not; text that is no JSON of its kind is null."""
    return df.select(*[
        (F.from_json(f"`{f.name}{ENDING}`", f.dataType) if _nested(f.dataType) else F.col(f"`{f.name}`").cast(f.dataType)).alias(f.name) for f in schema.fields
    ])


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV folder with header; nested columns are JSON text in it."""
    to_text(df).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return from_text(spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path), schema)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a report as JSON lines in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
