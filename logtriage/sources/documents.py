"""Loading documents for indexing: single files or whole folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.functions.text import drop_invalid_utf8


def load_documents(
    spark: SparkSession, document: str | None = None, directory: str | None = None
) -> DataFrame:
    """(file, text): one row per document. Logs are read line by line with scan_logs instead."""
    if not directory and not document:
        raise ValueError("either a directory or a document is needed")
    found = spark.read.text(directory or document, wholetext=True, recursiveFileLookup=bool(directory))
    return found.select(
        F.col("_metadata.file_path").alias("file"), drop_invalid_utf8(F.col("value")).alias("text")
    )
