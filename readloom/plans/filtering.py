"""The filter step: rounds of read and position filters until no position changes."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions import codes
from ..operators import reads
from ..sources.tables import scratch_path


@dataclasses.dataclass(frozen=True)
class FilterConfig:
    """Limits of the filters. Masks of bases and runs come before the rounds; ``max_rounds`` 0: until nothing changes."""

    mask_bases: str = "GT"
    mask_poly: int = 5
    min_cov: int = 1
    min_info_share: float = 0.0
    max_mut_share: float = 1.0
    min_gap: int = 4
    merge_close: bool = False
    min_info_pos: int = 1
    max_mut_pos: float = 1.0
    max_rounds: int = 0
    drop_discontiguous: bool = True


#: What chemical probes need. Bases masked, runs of A masked, gap, and whether close mutations are merged.
PROBES = {
    "DMS": FilterConfig("GT", 5, 1, 0.95, 1.0, 4, False, 1000, 1.0),
    "SHAPE": FilterConfig("", 5, 1, 0.95, 1.0, 2, True, 1000, 1.0),
    "ETC": FilterConfig("AC", 5, 1, 0.95, 1.0, 2, True, 1000, 1.0),
    "none": FilterConfig("", 0, 1, 0.95, 1.0, 0, False, 1000, 1.0),
}


@dataclasses.dataclass
class Filtered:
    segments: DataFrame
    muts: DataFrame
    positions: DataFrame
    rounds: int


def start(positions: DataFrame, config: FilterConfig, by: Sequence[str] = ()) -> DataFrame:
    """Positions that the static masks leave."""
    masks = [reads.mask_bases(positions, tuple(config.mask_bases))]
    if config.mask_poly:
        masks.append(reads.mask_poly(positions, "A", config.mask_poly, by))
    return reads.unmask(positions, *masks, by=by)


def filter_reads(segments: DataFrame, muts: DataFrame, positions: DataFrame, config: FilterConfig | None = None, pattern: tuple | None = None, by: Sequence[str] = (), masked: DataFrame | None = None, dropped: DataFrame | None = None, path: str | None = None) -> Filtered:
    """Rounds of read filters and position filters until no position changes.

    Each round only the positions that are left are kept, written to the shared folder ``path`` (one of our own under
    spark.checkpoint.dir unless given); reads are filtered anew from the input by these, so the plan does not grow with the
    rounds. The input is written there once as well. ``masked``: further positions to leave out; ``dropped``: reads to leave out.
    """
    config = config or FilterConfig()
    pattern = pattern or codes.pattern()
    spark = segments.sparkSession
    path = path or scratch_path(spark, "filter")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    if dropped is not None:
        segments, muts = reads.drop_listed(segments, muts, dropped, by)
    if config.drop_discontiguous:
        segments, muts = reads.drop_listed(segments, muts, reads.discontiguous(segments, by), by)
    segments, muts = kept(segments, "segments"), kept(muts, "muts")
    now = start(positions, config, by)
    if masked is not None:
        now = reads.unmask(now, masked, by=by)
    now = kept(now, "positions-0")
    n = now.count()
    done = 0
    while True:
        done += 1
        some, found, passing = reads.filter_pass(segments, muts, now, pattern, config.min_cov, config.min_info_share, config.max_mut_share, config.min_gap, config.min_info_pos, config.max_mut_pos, config.merge_close, by)
        now = kept(passing, f"positions-{done}")
        left = now.count()
        if left == n or done == config.max_rounds:  # positions only ever go
            return Filtered(segments.join(some, [*by, "read"], "left_semi"), found.join(now.select(*by, "pos"), [*by, "pos"], "left_semi"), now, done)
        n = left
