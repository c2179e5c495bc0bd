"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that every contract counts as white space: space and 0x09-0x0D.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary one is made and set under a local master; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strata-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage: what follows survives the loss of any executor without recomputing ``df``. The files go when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strata-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of a column's text, modulo ``modulus``; a null counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


def sampled(df: DataFrame, key: str, rate: Column | float, salt: str = "sample") -> DataFrame:
    """Rows whose hashed key falls under ``rate``: the same rows on every run, chosen without a shuffle."""
    unit = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    return df.where(unit < rate)


def no_clash(lead: list[str], *made: str) -> None:
    """Refuse kept columns that would stand twice in the result; names compare as Spark compares them, without case."""
    low = [c.lower() for c in lead]
    if bad := [c for k, c in enumerate(lead) if c.lower() in made or c.lower() in low[:k]]:
        raise ValueError(f"columns {bad} have an output's name: rename or pack them before")


#: Rows of one key from which on it counts as hot, and the keys that may be hot: the limit rises with the table.
HOT_ROWS, HOT_KEYS = 2000, 100_000


def join_sizes(big: DataFrame, small: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, whose ``n`` is the number of rows of ``big`` that a key has; ``n`` goes.

    Keys of more than ``HOT_ROWS`` rows, and of more than ``total / HOT_KEYS``, are at most ``HOT_KEYS``, so they are
    broadcast, and their rows stay where they are; the others are shuffled. No task gets a hot key's rows.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = small.where(F.col("n") > limit).drop("n")
    here = big.join(F.broadcast(hot), key)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.where(F.col("n") <= limit).drop("n"), key, how)
    return here.unionByName(rest)
