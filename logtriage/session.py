"""Session helpers: settings, shared scratch space, and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its bytes were measured below this.
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 64
# Only for sessions that name no shared folder.
_OWN_FOLDERS: dict[str, str] = {}


def local_session(cores: str = "*", app: str = "logtriage") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: the session's spark.checkpoint.dir.

    Where a session on one machine names none, a fresh folder is used; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN_FOLDERS:
            _OWN_FOLDERS[application] = tempfile.mkdtemp(prefix="logtriage-")
        folder = _OWN_FOLDERS[application]
    return folder.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several steps read, and read it back: computed once, survives lost executors."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def measured_bytes(df: DataFrame, size: Column) -> int:
    """Total of a per-row size expression, as one number."""
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long")).first()[0]


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    size: Column,
    spread: Column,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Inner equi-join of a large side with a side that is usually small.

    The small side is measured first. Below the limit it is broadcast and the large side stays
    where it is. Above it, both sides are shuffled with a salt: the large side takes the salt from
    `spread`, the small side is repeated once per salt, so that one hot key is spread over many
    tasks and the result stays whole.
    """
    if measured_bytes(small, size) <= limit:
        return big.join(F.broadcast(small), on)
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    salted_small = small.withColumn("_salt", F.explode(salts))
    return salted_big.join(salted_small, [*on, "_salt"]).drop("_salt")
