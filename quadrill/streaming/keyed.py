"""Keyed state in parts: decayed frequencies as a map by target, last events as a list.

A batch reads and writes only the targets that it names, so a source with many targets costs as much as any other. Both run on
``transformWithStateInPandas``, which needs a state store of columns: call ``use_rocksdb`` before the stream starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

VALUES = "s long, r int, o long, t long, value double, total double"
RECENT = "node long, place int, event_t long, r int, neighbor long"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Decayed(StatefulProcessor):
    """Each target's decayed count as of its own latest time, and the bucket's sum as of the bucket's."""

    def __init__(self, decay: float):
        self.decay = decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.targets = handle.getMapState("targets", "o long", "value double, t long")
        self.bucket = handle.getValueState("bucket", "total double, t long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[int, int], int] = {}
        for pdf in rows:  # rows of one target and time count together
            for (o, t), n in pdf.groupby(["o", "t"]).size().items():
                counts[int(o), int(t)] = counts.get((int(o), int(t)), 0) + int(n)
        if not counts:
            return
        total, last = self.bucket.get() if self.bucket.exists() else (0.0, min(t for _, t in counts))
        now = max(last, *(t for _, t in counts))
        fade = lambda t: 2.0 ** (-self.decay * (now - t))
        total *= fade(last)
        new: dict[int, float] = {}
        for (o, t), n in counts.items():
            new[o] = new.get(o, 0.0) + n * fade(t)  # what comes late counts as old as it is
            total += n * fade(t)
        for o, value in new.items():
            if self.targets.containsKey((o,)):
                before, t = self.targets.getValue((o,))
                new[o] = value + before * fade(t)
            self.targets.updateValue((o,), (new[o], now))
        self.bucket.update((total, now))
        yield pd.DataFrame({"s": key[0], "r": key[1], "o": list(new), "t": now, "value": list(new.values()), "total": total})

    def close(self) -> None:
        pass


class Recent(StatefulProcessor):
    """A node's last k events, newest first."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", "t long, eid long, r int, o long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(map(int, x)) for x in self.events.get()] if self.events.exists() else []
        for pdf in rows:
            newest = pdf.nlargest(self.k, ["t", "eid"])
            kept = sorted([*kept, *(tuple(map(int, x)) for x in newest[["t", "eid", "r", "o"]].itertuples(index=False))], reverse=True)[: self.k]
        self.events.put(kept)
        yield pd.DataFrame({"node": key[0], "place": range(1, len(kept) + 1), "event_t": [x[0] for x in kept], "r": [x[2] for x in kept], "neighbor": [x[3] for x in kept]})

    def close(self) -> None:
        pass


def decayed_values(events: DataFrame, decay: float) -> DataFrame:
    """After each micro-batch, (s, r, o, t, value, total) of the targets that it touched: decayed counts at t, the latest time of (s, r).

    A share is ``value`` over ``total``. A target that the batch doesn't touch keeps its last row; its share at a later time t' is that value
    times 2^(-decay * (t' - t)) over the total of t'.
    """
    return events.select("s", "r", "o", "t").groupBy("s", "r").transformWithStateInPandas(Decayed(decay), VALUES, "Update", "None")


def latest_shares(values: DataFrame, decay: float) -> DataFrame:
    """(s, r, o, weight) at the latest time of every (s, r), from all rows that the stream has given."""
    last = values.groupBy("s", "r", "o").agg(F.max_by(F.struct("value", "t"), F.struct("t", "total", "value")).alias("own"))
    now = values.select(F.col("s").alias("s_"), F.col("r").alias("r_"), F.struct("t", "total").alias("now_")).groupBy("s_", "r_").agg(F.max("now_").alias("now"))
    fade = F.pow(F.lit(2.0), F.lit(-float(decay)) * (F.col("now")["t"] - F.col("own")["t"]))
    return last.join(now, (F.col("s") == F.col("s_")) & (F.col("r") == F.col("r_"))).select("s", "r", "o", (F.col("own")["value"] * fade / F.col("now")["total"]).alias("weight"))


def recent_events(events: DataFrame, k: int) -> DataFrame:
    """After each micro-batch, the last k events of every source that it touched, newest first; later ids of one time count as newer."""
    return events.select("s", "t", "eid", "r", "o").groupBy("s").transformWithStateInPandas(Recent(k), RECENT, "Update", "None")
