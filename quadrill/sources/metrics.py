"""Figures of a run: rows, rates and seconds of its phases, observed while the data passes, and the progress of streams."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

SCHEMA = "phase string, metric string, value double"


class RunMetrics:
    """Sums and seconds by phase. Counts come from Spark's observations, so nothing is computed twice for them.

    Phases may be entered again; their seconds and sums add up. Metrics whose name ends in ``_rate`` are made of two others when they are read.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.seconds: dict[str, float] = {}
        self.watched: list[tuple[str, Observation]] = []
        self.sums: dict[tuple[str, str], float] = {}
        self.current = "run"

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        """Time what runs inside, and count what is watched inside under this name."""
        before, self.current, began = self.current, name, time.monotonic()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began
            self.current = before

    def watch(self, df: DataFrame, **sums: Column) -> DataFrame:
        """``df``, which counts its rows and adds up ``sums`` when an action reads it. Read it by one action: each further one counts again."""
        seen = Observation()
        self.watched.append((self.current, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(n) for n, c in sums.items()))

    def add(self, metric: str, value: float, phase: str | None = None) -> None:
        key = (phase or self.current, metric)
        self.sums[key] = self.sums.get(key, 0.0) + value

    def values(self, rates: dict[str, tuple[str, str]] | None = None) -> dict[tuple[str, str], float]:
        """Values by (phase, metric). What is watched must have been read. ``rates`` names quotients of two metrics of a phase."""
        for phase, seen in self.watched:
            for metric, value in seen.get.items():
                self.add(metric, float(value), phase)
        self.watched = []
        out = dict(self.sums) | {(phase, "seconds"): value for phase, value in self.seconds.items()}
        for name, (a, b) in (rates or {}).items():
            out |= {(phase, name): out.get((phase, a), 0.0) / total for (phase, metric), total in list(out.items()) if metric == b and total}
        return out

    def table(self, rates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
        """(phase, metric, value)."""
        return self.spark.createDataFrame(sorted((p, m, v) for (p, m), v in self.values(rates).items()), SCHEMA)


class StreamProgress(StreamingQueryListener):
    """Batches, input rows and milliseconds of every stream by its name; register with ``spark.streams.addListener``."""

    def __init__(self):
        self.names: dict[str, str] = {}
        self.totals: dict[str, dict[str, float]] = {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        own = self.totals.setdefault(p.name or str(p.id), {"batches": 0, "rows": 0, "ms": 0, "state_rows": 0})
        own["batches"] += 1
        own["rows"] += p.numInputRows
        own["ms"] += p.durationMs.get("triggerExecution", 0)
        own["state_rows"] = max([own["state_rows"], *(s.numRowsTotal for s in p.stateOperators)])

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.names.pop(str(event.id), None)
