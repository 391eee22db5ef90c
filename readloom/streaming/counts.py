"""Running counts over mutations that arrive as files or topics: the sums of the batch tables, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes


def position_counts(muts: DataFrame, patterns: dict | None = None) -> DataFrame:
    """pos, base and per pattern the informative and fitting mutations so far. Sums are kept per position."""
    sums = []
    for name, pat in (patterns or codes.named()).items():
        info, fit = codes.informative(F.col("base"), F.col("rel"), pat)
        sums += [F.count_if(info).alias(f"{name}_info".replace("-", "_")), F.count_if(fit).alias(f"{name}_fit".replace("-", "_"))]
    return muts.groupBy("pos", "base").agg(*sums)


def end_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy("end5", "end3").agg(F.count("*").alias("n"))


def windowed(events: DataFrame, time: str, size: str, late: str, key: list[str]) -> DataFrame:
    """Counts by window of event time; rows later than ``late`` are left out and state is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *key).agg(F.count("*").alias("n"))


def run_available(counts: DataFrame, path: str, mode: str = "complete") -> None:
    """Process all input that is there now; each micro-batch replaces the table at ``path``/table, so that a
    restart from the checkpoint beside it ends in the same table."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table")

    counts.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(replace).start().awaitTermination()
