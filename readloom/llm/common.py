"""What the operators of this subpackage share: tables, scratch tables, word hashes."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_SCRATCH: list[tuple[SparkSession, str]] = []
_KEPT: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given tables with Spark's reader, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where none is set on a single machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="readloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str, keep: bool = True) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and any
    executor can read the result again after another one is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/readloom-{name}-{uuid.uuid4().hex}"
    gc.collect()
    spark._jvm.System.gc()  # lets Spark's cleaner delete the shuffle files of what was written before
    df.write.parquet(path)
    (_KEPT if keep else _SCRATCH).append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def materialize(df: DataFrame, name: str) -> DataFrame:
    """A scratch table, written and read back."""
    return written(df, name, keep=False)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # its session has ended; the folder is scratch
        pass


def release(paths: list | None = None) -> None:
    """Delete the scratch tables written so far. Call it only when no result still reads them;
    the pipeline does so once a stage's output is on disk."""
    paths = _SCRATCH if paths is None else paths
    while paths:
        _delete(*paths.pop())


def discard(*tables: DataFrame) -> None:
    """Delete these scratch tables, which nothing reads any more, and the shuffle files of what read them."""
    for df in tables:
        entry = (df.sparkSession, df._scratch)
        _SCRATCH.remove(entry)
        _delete(*entry)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


atexit.register(release)
atexit.register(release, _KEPT)


def with_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text, null text as empty, whatever other columns there are."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def row_key(doc_id: Column, text: Column) -> Column:
    """A 64-bit key of a row from its doc_id and whole text (null as empty), the same wherever and however often it
    is computed. Rows that agree in both are one document; a null or repeated doc_id with another text is another."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("|"), F.coalesce(text, F.lit("")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def every(n: int, sample: int) -> int:
    """One row in how many to look at, to learn what is very common: ``sample`` rows of a small table, a thousandth
    of a large one. What is seen ``least`` times has some 1000 x ``least`` entries at most in any table, however large."""
    return min(1000, max(1, n // sample))


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8. bytes.lower and bytes.split
    know ASCII alone, which is just this definition."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class WordHash:
    """64-bit hashes of words, remembered; the memory is dropped when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __missing(self, word: bytes) -> int:
        if len(self.known) >= self.limit:
            self.known.clear()
        value = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def __call__(self, ws: list[bytes]) -> np.ndarray:
        get, missing = self.known.get, self.__missing
        return np.fromiter((get(w) or missing(w) for w in ws), U64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_ODD = [U64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def shingle_set(ws: list[bytes], hasher: WordHash, k: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; fewer words make one shingle, none makes none."""
    h = hasher(ws)
    if not len(h):
        return h
    size = min(k, len(h))
    total = np.full(len(h) - size + 1, U64(size))
    for i in range(size):
        total = total + h[i : len(h) - size + 1 + i] * (_ODD[i % 5] + U64(2 * (i // 5)))
    return np.unique(mix(total))
