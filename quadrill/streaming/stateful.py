"""Streaming forms of the keyed states, and a fold of snapshots for the state that pulls from other nodes.

Decayed frequencies and last events depend on their key alone and run as keyed state. The multi-hop state reads other
nodes' rows, so micro-batches are folded into a state table instead, snapshot by snapshot.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quadrill.operators import ppr as P
from quadrill.sources.readers import exists
from quadrill.sources.stores import read_json, write_json

SHARES = "s long, r int, o long, t long, weight double"
RECENT = "node long, place int, event_t long, r int, neighbor long"


def decayed_stream(events: DataFrame, decay: float) -> DataFrame:
    """After each micro-batch, the decayed shares of every (s, r) that it touched. Weights are kept relative to the bucket's latest time, so they never overflow."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, targets, weights = state.get if state.exists else (None, [], [])
        kept = dict(zip(targets, weights, strict=True))
        for pdf in batches:
            for o, t in zip(pdf["o"], pdf["t"], strict=True):
                o, t = int(o), int(t)
                if last is None:
                    last = t
                if t > last:
                    scale = 2.0 ** (-decay * (t - last))
                    kept = {k: v * scale for k, v in kept.items()}
                    last = t
                kept[o] = kept.get(o, 0.0) + 2.0 ** (-decay * (last - t))
        state.update((last, list(kept), list(kept.values())))
        total = sum(kept.values())
        yield pd.DataFrame({"s": key[0], "r": key[1], "o": list(kept), "t": last, "weight": [v / total for v in kept.values()]})

    return events.select("s", "r", "o", "t").groupBy("s", "r").applyInPandasWithState(run, SHARES, "last long, targets array<long>, weights array<double>", "update", GroupStateTimeout.NoTimeout)


def recent_stream(events: DataFrame, k: int) -> DataFrame:
    """After each micro-batch, the last k events of every source that it touched, newest first; later rows of one time count as newer."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            rows += list(zip(pdf["t"].astype(int), pdf["eid"].astype(int), pdf["r"].astype(int), pdf["o"].astype(int), strict=True))
            rows = sorted(rows, reverse=True)[:k]
        rows = [tuple(int(x) for x in r) for r in rows]
        state.update(tuple(list(c) for c in zip(*rows, strict=True)))
        yield pd.DataFrame({"node": key[0], "place": range(1, len(rows) + 1), "event_t": [r[0] for r in rows], "r": [r[2] for r in rows], "neighbor": [r[3] for r in rows]})

    schema = "ts array<long>, eids array<long>, rs array<long>, os array<long>"
    return events.select("s", "eid", "r", "o", "t").groupBy("s").applyInPandasWithState(run, RECENT, schema, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time_col: str = "ts", lateness: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events of each relation in windows of event time; rows later than the watermark are dropped, as the watermark promises."""
    window = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return events.withWatermark(time_col, lateness).groupBy(window.alias("window"), "r").agg(F.count("*").alias("n"))


class SnapshotFold:
    """Folds micro-batches into the multi-hop state; pass ``write`` to ``foreachBatch``.

    A batch holds whole snapshots in time order; a batch that goes back in time is refused. All that the fold knows lies in ``folder``,
    which all executors share: the state, how many snapshots each source has had, which nodes it has met, and a document that names
    them together with the last batch. The document is written last, so a batch that is replayed after a failure, or
    met again after a restart of the driver, starts from what the batch before it left, and one that was folded already is skipped.
    """

    def __init__(self, spark: SparkSession, folder: str, cfg: P.PprConfig, transitions: DataFrame | None = None):
        self.spark, self.folder, self.cfg, self.transitions = spark, folder.rstrip("/"), cfg, transitions
        self.done = read_json(spark, self._marker()) if exists(spark, self._marker()) else {"batch": -1, "last": None, "at": None, "before": None}

    def _marker(self) -> str:
        return f"{self.folder}/fold.json"

    def _table(self, name: str, schema: str) -> DataFrame:
        at = self.done["at"]
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{at}/{name}") if at else self.spark.createDataFrame([], schema)

    @property
    def state(self) -> DataFrame:
        return self._table("state", P.STATE)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.done["batch"]:
            return
        rows = P.stored(batch.select("t", "s", "r", "o", "eid"))
        times = sorted(r[0] for r in rows.select("t").distinct().collect())
        if times and self.done["last"] is not None and times[0] <= self.done["last"]:
            raise ValueError(f"snapshot {times[0]} came after snapshot {self.done['last']}")
        state, met, seen = self.state, self._table("met", "node long"), self._table("seen", "s long, n long")
        for t in times:
            now = P.Schedule.after(rows.where(F.col("t") == t), self.cfg, seen, met)
            m = self.transitions.where(F.col("t") == t) if self.transitions is not None else None
            state = P.step(state, now, self.cfg, m)
            seen = P.stored(seen.unionByName(now.sources.select("s", F.lit(1).cast("long").alias("n"))).groupBy("s").agg(F.sum("n").alias("n")))
            met = P.stored(met.unionByName(now.born.select("node")))
        at = f"batch={batch_id}"
        for name, table in (("state", state), ("met", met), ("seen", seen)):
            table.write.mode("overwrite").parquet(f"{self.folder}/{at}/{name}")
        old = self.done["before"]
        self.done = {"batch": batch_id, "last": times[-1] if times else self.done["last"], "at": at, "before": self.done["at"]}
        write_json(self.spark, self._marker(), self.done)
        if old and old != at:
            P.remove(self.spark, f"{self.folder}/{old}")


def start_fold(events: DataFrame, fold: SnapshotFold, checkpoint: str, **trigger: Any):
    """Run the fold over a stream; by default over what is there now."""
    return events.writeStream.foreachBatch(fold.write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
