"""Tables as files: counts with their key columns, metadata, barcodes and lists; and folders for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all machines share; a local one only where a single machine runs
    everything and none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="readloom-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt anew, by keys or in turn, to all cores and in no fewer parts than a shuffle has: where few rows mean much work each,
    one block of a file or what adaptive execution has put together would be a single task."""
    n = max(2 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


#: Rows of a part of by_key().
ROWS = 1 << 20


def by_key(df: DataFrame, size: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys to as many parts as ``size``, the table they come from, has millions of rows (and no fewer than a
    shuffle has), so what a task sorts or holds does not grow with the table. What is grouped and joined by these keys stays in its part."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size.count() // ROWS)), *keys)


def write_table(table: DataFrame, path: str, digits: int = 6, by: tuple[str, ...] = ()) -> None:
    """CSV with a header, fractions rounded, in folders by key columns if there are any."""
    rounded = table.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in table.dtypes])
    writer = rounded.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that write_table wrote; its schema is stated, never guessed."""
    return spark.read.schema(schema).option("header", True).csv(path)


def melt(table: DataFrame, key: list[str], name: str = "rel", value: str = "n") -> DataFrame:
    """One column for each relationship (or cluster) as rows: key, name, value."""
    rest = [c for c in table.columns if c not in key]
    return table.unpivot(key, rest, name, value)


def widen(table: DataFrame, key: list[str], names: list[str], name: str = "rel", value: str = "n") -> DataFrame:
    """The reverse of melt, for the names given; what is not there is 0."""
    return table.groupBy(*key).pivot(name, names).agg(F.sum(value)).na.fill(0, names)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of samples or references: a header, the first column the key, types inferred."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def add_metadata(table: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """The table with the metadata's columns. Where both have a column, the table's own value wins if the metadata has
    none; it raises when it runs if they differ, or if the metadata has a key twice."""
    shared = [c for c in metadata.columns if c in table.columns and c != key]
    once = metadata.groupBy(key).agg(F.count("*").alias("_rows"), *[F.first(c).alias(f"_m_{c}") for c in metadata.columns if c != key])
    joined = table.join(once, key, "left")

    def merged(c: str) -> Column:
        own, other = F.col(c), F.col(f"_m_{c}")
        differ = own.isNotNull() & other.isNotNull() & (own.cast("string") != other.cast("string"))
        return F.when(differ, F.raise_error(F.concat(F.lit(f"two values of {c} for "), F.col(key).cast("string")))).otherwise(F.coalesce(own, other))

    single = F.when(F.col("_rows") > 1, F.raise_error(F.concat(F.lit("metadata twice for "), F.col(key).cast("string")))).otherwise(F.col(key))
    own = [single.alias(c) if c == key else merged(c).alias(c) if c in shared else F.col(c) for c in table.columns]
    return joined.select(*own, *[F.col(f"_m_{c}").alias(c) for c in metadata.columns if c != key and c not in shared])


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """name, ref, seq, end5, end3, pos of barcodes given as sequences or by where they lie in a reference; not both."""
    raw = spark.read.schema("name string, ref string, seq string, end5 int, end3 int, pos int").option("header", True).csv(path)
    both, none = F.col("seq").isNotNull() & F.col("end5").isNotNull(), F.col("seq").isNull() & (F.col("end5").isNull() | F.col("end3").isNull())
    return raw.withColumn("name", F.when(both | none, F.raise_error(F.concat(F.lit("a barcode needs a sequence or its ends: "), "name"))).otherwise(F.col("name")))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """key, n of the keys that come more than once; empty where each is there once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def same_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """key, side of those keys that only one of two tables has; empty where both have the same."""
    x, y = a.select(*key).distinct(), b.select(*key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("a")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("b")))
