"""Runs stored whole: several tables written together, seen together."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


class RunStore:
    """Tables of runs under one folder. A run's tables are staged beside each other and named by one small file,
    whose rename makes all of them visible at once; a run that is saved again replaces what it saved before, and one
    that fails on the way leaves nothing to be seen."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, path: str):  # noqa: ANN202
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def save(self, run: int, tables: dict[str, DataFrame]) -> None:
        stage = f"{self.path}/stage/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{stage}/{name}")
        old = self.current(run)
        fs, draft = self._file(f"{self.path}/runs/.{run}-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"stage": stage, "tables": sorted(tables)}).encode()))
        out.close()
        _, named = self._file(f"{self.path}/runs/{run}.json")
        fs.delete(named, False)
        if not fs.rename(draft, named):
            raise OSError(f"run {run} can't be named")
        if old:
            self._file(old["stage"])[0].delete(self._file(old["stage"])[1], True)

    def current(self, run: int) -> dict | None:
        fs, named = self._file(f"{self.path}/runs/{run}.json")
        if not fs.exists(named):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/runs/{run}.json", wholetext=True).first()[0])

    def read(self, run: int, table: str) -> DataFrame:
        now = self.current(run)
        if not now or table not in now["tables"]:
            raise KeyError(f"run {run} has no table {table}")
        return self.spark.read.parquet(f"{now['stage']}/{table}")


def decomposition(groups: DataFrame, topics: DataFrame) -> dict[str, DataFrame]:
    """The three tables of a run: groups (without their members and topics), topics and the junction of groups and sections.

    ``groups`` (group, version_id, label, members array<long>), ``topics`` (group, phrase); a group's key is a hash
    of its version and number, so that a run that is repeated writes the same keys.
    """
    keyed = groups.withColumn("id", F.xxhash64("version_id", "group"))
    key = keyed.select("version_id", "group", "id")
    members = keyed.select(F.col("id").alias("concept_group_id"), F.explode(F.array_distinct("members")).alias("section_id"))
    children = topics.join(key, ["version_id", "group"]).withColumnRenamed("id", "concept_group_id").drop("version_id", "group")
    return {"groups": keyed.drop("members", "group"), "topics": children, "members": members}
