"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boundwell.shared import remove, scratch


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and go on from its files, so that a lost executor costs no rework and later steps read only their columns."""
    path = scratch(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing unfinished reads any more."""
    for t in tables:
        remove(t.sparkSession, t.cut_path)


def width(spark: SparkSession) -> int:
    """The number of partitions that a shuffle is dealt to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def apart(key: str) -> Column:
    """A long key as an expression of its own.

    A table that is grouped by a key and joined back to its rows by it would share their exchange, and adaptive execution can't
    split a hot key there. Joined by this, it gets an exchange of its own, and the hot key's rows are split.
    """
    return F.col(key).bitwiseXOR(F.lit(0))


#: Bits of a sieve, as a power of two: 2**SIEVE / 64 words of 8 bytes at most, whatever the number of keys.
SIEVE = 26


def _bit(key: str) -> tuple[Column, Column]:
    """A key's word in a sieve, and its bit there."""
    at = f"pmod(xxhash64(`{key}`), {1 << SIEVE}L)"
    return F.expr(f"shiftright({at}, 6)"), F.expr(f"shiftleft(1L, cast({at} & 63 AS INT))")


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of a column's hashes, as words (_word, _bits).

    Its size has a bound that doesn't depend on the keys, so it can be broadcast: 2**20 rows. A full one lets everything pass,
    which costs a shuffle and no row.
    """
    word, bit = _bit(key)
    return keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def sifted(rows: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """The rows whose key may be in the sieve: all that are, and few others."""
    word, bit = _bit(key)
    return rows.join(F.broadcast(words), (word == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0)).select(*rows.columns)


def parted(rows: DataFrame, key: str, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be in the sieve, and those whose key isn't."""
    word, bit = _bit(key)
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    both = rows.join(F.broadcast(words), word == F.col("_word"), "left")
    return both.where(hit).select(*rows.columns), both.where(~hit).select(*rows.columns)


#: Rows of an Arrow batch of texts, where the session has Spark's own default of 10,000.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Texts of some kilobytes make Arrow batches of Spark's default size large, in the JVM and in Python workers; a session that names a size keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(TEXT_ROWS))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that have been cut: it does so once the driver's JVM has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
