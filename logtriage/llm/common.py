"""Helpers that several operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtriage.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have yet, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_of_id(doc_id: Column) -> Column:
    """Unsigned crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def with_fields(schema: T.StructType, fields: str) -> T.StructType:
    return T.StructType(schema.fields + T.StructType.fromDDL(fields).fields)


def bounded_sample(ids: DataFrame, most: int) -> DataFrame:
    """Distinct non-null ids of a one-column table, about `most` at most: those whose hash falls below a fitting mark.

    Nothing is sorted, and the same ids are chosen whatever the partitions.
    """
    name = ids.columns[0]
    distinct = ids.where(F.col(name).isNotNull()).distinct()
    n = distinct.count()
    if n <= most:
        return distinct
    return distinct.where(F.pmod(F.xxhash64(name), F.lit(1 << 31)) < int((1 << 31) * most / n))
