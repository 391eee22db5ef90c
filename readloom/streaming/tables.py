"""Position, pair and read tables kept up to date while reads arrive, each batch counted exactly once.

Every table is made of parts, one for each micro-batch, in a folder named by the batch's id. A batch that comes again after a
failure overwrites its own parts, so nothing counts twice. Parts are merged into one from time to time; the
merged part says up to which batch it goes, and parts up to there are not read any more.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import reads
from ..sources.tables import by_key

#: Keys of each table; all other columns are counts, which add up. Reads are each in one batch, whole.
KEYS = {"position": ["pos", "base", "rel"], "pair": ["pos_a", "pos_b"], "read": ["read"], "ends": ["end5", "end3"]}


@dataclasses.dataclass(frozen=True)
class Tables:
    """Running tables in a shared folder: positions of the region, pattern, gaps of the pairs that are counted, and which tables
    are kept."""

    path: str
    positions: DataFrame
    pattern: tuple
    min_gap: int = 0
    max_gap: int | None = None
    kept: tuple[str, ...] = tuple(KEYS)

    def _spark(self) -> SparkSession:
        return self.positions.sparkSession

    def _of(self, batch: DataFrame) -> dict[str, DataFrame]:
        """What the reads of a batch (read, segs, muts, where muts have pos, base, rel) add to each table."""
        segments = batch.select("read", F.posexplode("segs").alias("seg", "s")).select("read", "seg", "s.*")
        muts = batch.select("read", F.explode("muts").alias("m")).select("read", "m.*")
        made = {
            "position": lambda: reads.codes_per_position(segments, muts, self.positions),
            "pair": lambda: reads.confusion(segments, muts, self.positions, self.pattern, self.min_gap, self.max_gap),
            "read": lambda: reads.read_table(segments, muts, self.positions),
            "ends": lambda: reads.end_counts(segments),
        }
        return {name: made[name]() for name in self.kept}

    def add(self, batch: DataFrame, number: int) -> None:
        """Count a batch; the same number again replaces what it counted before."""
        held = f"{self.path}/reads/batch={number}"
        batch.write.mode("overwrite").parquet(held)  # four tables read it
        batch = self._spark().read.schema(batch.schema).parquet(held)
        batch = by_key(batch, batch, "read")  # what is grouped by reads stays in its part
        for name, part in self._of(batch).items():
            part.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def run(self, stream: DataFrame, **trigger) -> None:
        """Count all that is there now (or as ``trigger`` says), from the checkpoint beside the tables on."""
        writer = stream.writeStream.foreachBatch(lambda batch, number: self.add(batch, number))
        writer.option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start().awaitTermination()

    def _folders(self, name: str) -> dict[int, str]:
        """Parts of a table by batch. Only the names of folders are listed."""
        jvm, conf = self._spark()._jvm, self._spark()._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = root.getFileSystem(conf)
        if not files.exists(root):
            return {}
        found = [x.getPath() for x in files.listStatus(root)]
        return {int(p.getName().partition("=")[2]): p.toString() for p in found if "=" in p.getName() and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}

    def parts(self, name: str) -> list[str]:
        """Folders whose rows make up the table: the last merged part, and those of later batches."""
        merged, single = self._folders(f"merged-{name}"), self._folders(name)
        upto = max(merged, default=-1)
        return ([merged[upto]] if merged else []) + [single[i] for i in sorted(single) if i > upto]

    def table(self, name: str) -> DataFrame:
        """The table as of the last batch: position (by relationship), pair, read or ends."""
        parts = self.parts(name)
        if not parts:
            raise FileNotFoundError(f"no batch has been counted in {self.path}")
        rows = self._spark().read.parquet(*parts)
        counts = [c for c in rows.columns if c not in KEYS[name]]
        return rows.groupBy(*KEYS[name]).agg(*(F.sum(c).alias(c) for c in counts))

    def position_table(self) -> DataFrame:
        """Counts of the ten relationships by position, as reads.position_table() gives them."""
        patterns = codes.named()
        found = reads.fit_counts(self.table("position"), patterns, ["pos", "base"])
        columns = [F.coalesce(F.col(f"{n}_fit"), F.lit(0)).cast("long").alias(n.replace("-", "_")) for n in patterns]
        return self.positions.join(found, ["pos", "base"], "left").select("pos", "base", *columns).withColumn("Informative", F.col("Matched") + F.col("Mutated"))

    def merge(self) -> None:
        """One part in place of those that there are. It counts once it is whole, so a failure in between changes nothing."""
        for name in self.kept:
            single = self._folders(name)
            upto = max(single, default=-1)
            if upto > max(self._folders(f"merged-{name}"), default=-1):
                self.table(name).write.mode("overwrite").parquet(f"{self.path}/merged-{name}/upto={upto}")
