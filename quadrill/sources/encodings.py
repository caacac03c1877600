"""A store of node encodings between runs: keyed by node, time, relation and a version of what was read, refreshed only where that changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.functions.naming import stable_hash
from quadrill.operators.event_model import EventModel, encoded_events
from quadrill.operators.time_model import with_events
from quadrill.sources.readers import exists

#: Changes whenever a stored vector would no longer be the one that the code gives.
FORMAT = 1
ROWS = "s LONG, t LONG, r INT, version STRING, vector ARRAY<DOUBLE>"


class EncodingStore:
    """Encodings of one model, below ``root`` under the hash of its weights, its options and the format.

    A row's version is a digest of the events that the encoder reads, so facts that come late change the version of those nodes and times whose last events
    they are, and of no others. Every run adds a folder of its own, which counts only once it is complete; a run that was cut off leaves nothing behind that is read.
    """

    def __init__(self, spark: SparkSession, root: str, model: EventModel):
        if model.config.cross:
            raise ValueError("encodings of pairs are not stored")
        self.spark, self.model = spark, model
        self.path = f"{root.rstrip('/')}/{stable_hash({'format': FORMAT, 'model': model.to_json()})}"

    def runs(self) -> list[str]:
        """Folders of complete runs."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [str(f.getPath()) for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(f for f in found if exists(self.spark, f"{f}/_SUCCESS"))

    def rows(self) -> DataFrame:
        """(s, t, r, version, vector) of all complete runs."""
        runs = self.runs()
        return self.spark.read.schema(ROWS).parquet(*runs) if runs else self.spark.createDataFrame([], ROWS)

    def wanted(self, asked: DataFrame, quads: DataFrame) -> DataFrame:
        """(s, t, r, nodes, rels, ages, version) of what is asked for; ``r`` is null without a gate."""
        c = self.model.config
        rel = F.col("r").cast("int").alias("r") if c.gate else F.lit(None).cast("int").alias("r")
        keys = asked.select("s", "t", rel).distinct()
        return keys.join(with_events(keys, quads, c.events), ["s", "t"]).withColumn("version", F.md5(F.to_json(F.struct("nodes", "rels", "ages")).cast("binary")))

    def missing(self, asked: DataFrame, quads: DataFrame) -> DataFrame:
        """Rows of ``wanted`` that no run holds in this version."""
        rows, kept = self.wanted(asked, quads), self.rows()
        same = (rows["s"] == kept["s"]) & (rows["t"] == kept["t"]) & rows["r"].eqNullSafe(kept["r"]) & (rows["version"] == kept["version"])
        return rows.join(kept, same, "left_anti")

    def refresh(self, asked: DataFrame, quads: DataFrame) -> int:
        """Encode what is missing and keep it; how many rows that were."""
        at = f"{self.path}/{uuid.uuid4().hex}"
        encoded_events(self.missing(asked, quads), self.model, ("version",)).select("s", "t", "r", "version", "vector").write.parquet(at)
        return self.spark.read.schema(ROWS).parquet(at).count()

    def get(self, asked: DataFrame, quads: DataFrame) -> DataFrame:
        """(s, t, r, vector) of what is asked for, refreshed first. Two runs at a time may both have encoded a row; one of its copies counts."""
        self.refresh(asked, quads)
        rows = self.wanted(asked, quads).select("s", "t", F.col("r").alias("r_"), "version")
        kept = self.rows().groupBy("s", "t", "r", "version").agg(F.first("vector").alias("vector"))
        same = (rows["s"] == kept["s"]) & (rows["t"] == kept["t"]) & rows["r_"].eqNullSafe(kept["r"]) & (rows["version"] == kept["version"])
        return rows.join(kept, same).select(rows["s"], rows["t"], "r", "vector")
