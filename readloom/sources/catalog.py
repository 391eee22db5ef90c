"""A catalogue of steps: what each has written, from what, with which parameters; and datasets put together from it.

A step's tables are Parquet folders, and an entry in the manifest names them together with the entries that the
step came from. A dataset is made of the tables of its step and of those before it, lazily, so
nothing is stored twice: a filter step keeps only which reads and positions passed, a cluster step only weights.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import regions

SCHEMA = "id string, step string, keys map<string,string>, inputs array<string>, tables map<string,string>, parameters string, at timestamp"
#: Tables that each step writes; a step that needs others can be added to LOADERS.
READ = ["sample", "ref", "read"]


def _identify(own: dict[str, DataFrame], before: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    return own


def _filter(own: dict[str, DataFrame], before: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Segments and mutations of the step before, of the reads and positions (by their common keys) that passed."""
    (data,) = before
    shared = lambda a, b: [c for c in a.columns if c in b.columns and c in ("sample", "ref", "read", "pos")]
    kept = {name: data[name].join(own["reads"], shared(own["reads"], data[name]), "left_semi") for name in ("segments", "muts")}
    kept["muts"] = kept["muts"].join(own["positions"], shared(own["positions"], kept["muts"]), "left_semi")
    return {**data, **kept, "positions": own["positions"]}


def _cluster(own: dict[str, DataFrame], before: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The dataset of the step before, and weights of its reads."""
    (data,) = before
    return {**data, **own}


def _pool(own: dict[str, DataFrame], before: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Several datasets as one; reads are told apart by the number of their input."""
    parts = [{name: df.withColumn("read", F.concat(F.lit(f"{i}/"), F.col("read").cast("string"))) if "read" in df.columns else df for name, df in data.items()} for i, data in enumerate(before)]
    names = set.intersection(*(set(p) for p in parts))
    out = {name: reduce(DataFrame.unionByName, [p[name] for p in parts]) for name in names}
    if "positions" in out:  # those that all inputs have
        tagged = reduce(DataFrame.unionByName, [p["positions"].withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
        key = [c for c in out["positions"].columns if c not in ("pos", "base")]
        if key:
            out["positions"] = regions.intersect_masked(tagged.select(*key, "_part").distinct(), tagged, key, "_part")
        else:
            all_ = tagged.withColumn("_one", F.lit(1))
            out["positions"] = regions.intersect_masked(all_.select("_one", "_part").distinct(), all_, ["_one"], "_part").drop("_one")
    return {**out, **own}


#: How the dataset of a step is made of its own tables and the datasets it came from.
LOADERS: dict[str, Callable] = {"identify": _identify, "filter": _filter, "cluster": _cluster, "pool": _pool}


class Catalog:
    """Steps below a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, step: str, tables: dict[str, DataFrame], keys: dict[str, str] | None = None, inputs: list[str] | None = None, parameters: dict | None = None) -> str:
        """Write a step's tables and its entry; the entry comes last, so one that is there is whole. Returns its id."""
        if step not in LOADERS:
            raise ValueError(f"no such step: {step}")
        known = {r["id"] for r in self.entries().select("id").collect()} if inputs else set()
        if missing := [i for i in inputs or [] if i not in known]:
            raise ValueError(f"no such entries: {missing}")
        entry = f"{step}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{step}/{entry}/{name}")
        row = (entry, step, {k: str(v) for k, v in (keys or {}).items()}, list(inputs or []), {name: df.schema.json() for name, df in tables.items()}, json.dumps(parameters or {}, sort_keys=True, default=str))
        schema = SCHEMA.rpartition(", ")[0]
        self.spark.createDataFrame([row], schema).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return entry

    def entries(self, step: str | None = None, **keys: str) -> DataFrame:
        """The manifest, or those entries of it that are of a step and have these keys."""
        try:
            found = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/manifest")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = self.spark.createDataFrame([], SCHEMA)  # nothing has been added yet
        if step is not None:
            found = found.where(F.col("step") == step)
        for name, value in keys.items():
            found = found.where(F.col("keys")[name] == str(value))
        return found

    def _lineage(self, entry: str) -> dict[str, dict]:
        """The entry and all it came from. Only these are collected, step by step."""
        found, wanted = {}, {entry}
        while wanted:
            rows = {r["id"]: r.asDict(recursive=True) for r in self.entries().where(F.col("id").isin(sorted(wanted))).collect()}
            if missing := wanted - set(rows):
                raise KeyError(f"no such entries: {sorted(missing)}")
            found |= rows
            wanted = {i for r in rows.values() for i in r["inputs"]} - set(found)
        return found

    def lineage(self, entry: str) -> DataFrame:
        """id, step, inputs, parameters of an entry and of all it came from."""
        return self.spark.createDataFrame([(r["id"], r["step"], r["inputs"], r["parameters"]) for r in self._lineage(entry).values()], "id string, step string, inputs array<string>, parameters string")

    def _tables(self, row: dict) -> dict[str, DataFrame]:
        from pyspark.sql.types import StructType

        return {name: self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{self.path}/{row['step']}/{row['id']}/{name}") for name, schema in row["tables"].items()}

    def dataset(self, entry: str) -> dict[str, DataFrame]:
        """Tables of a step, whichever it is: its loader is found by the kind of step, and what it came from is joined lazily."""
        rows, made = self._lineage(entry), {}

        def build(i: str) -> dict[str, DataFrame]:
            if i not in made:
                made[i] = LOADERS[rows[i]["step"]](self._tables(rows[i]), [build(j) for j in rows[i]["inputs"]])
            return made[i]

        return build(entry)

    def latest(self, step: str, **keys: str) -> str:
        """The newest entry of a step with these keys."""
        found = self.entries(step, **keys).orderBy(F.desc("at"), F.desc("id")).select("id").first()
        if found is None:
            raise KeyError(f"no {step} with {keys}")
        return found["id"]
