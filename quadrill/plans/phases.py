"""Phases of a prequential run: which snapshots only warm the state up, and which are scored.

A score at t reads facts before t alone, so a phase is a set of times: all snapshots are folded in order, and those of the phases asked
for are scored before they are folded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.graph import TemporalGraph, last_snapshots
from quadrill.operators import history as H
from quadrill.operators import negatives as K
from quadrill.operators import ranking as R
from quadrill.operators.ppr import stored
from quadrill.plans import temporal as T
from quadrill.plans.catalog import query

PHASES = ("train", "val", "test")


@dataclass(frozen=True)
class RunConfig:
    """What a run scores: the last ``train_ratio`` of training snapshots, validation (unless ``skip_val_eval``: folded only) and test."""

    train_ratio: float = 0.3
    skip_val_eval: bool = False
    q: int = 20
    seed: int = 42

    def __post_init__(self):
        if not 0 <= self.train_ratio <= 1 or self.q < 1:
            raise ValueError("train_ratio lies in [0, 1], q is positive")


def scored(g: TemporalGraph, run: RunConfig) -> DataFrame:
    """The queries of a run with their ``phase``; all other facts only warm the state up."""
    out = last_snapshots(g.quads.where("split = 'train'"), run.train_ratio).withColumn("phase", F.lit("train"))
    for split in ("val", "test"):
        if split == "test" or not run.skip_val_eval:
            out = out.unionByName(g.quads.where(F.col("split") == split).withColumn("phase", F.lit(split)))
    return out


def warm_up(g: TemporalGraph, phase: str, run: RunConfig) -> DataFrame:
    """The facts that the state has seen when a phase begins."""
    if phase not in PHASES:
        raise ValueError(f"unknown phase {phase!r}")
    train = g.quads.where("split = 'train'")
    if phase == "train":
        return train.join(last_snapshots(train, run.train_ratio).select("t").distinct(), "t", "left_anti")
    return train if phase == "val" else train.unionByName(g.quads.where("split = 'val'"))


def phase_metrics(g: TemporalGraph, run: RunConfig, score) -> DataFrame:
    """Ranking metrics of each phase; ``score`` adds ``score`` to candidates, from facts before their time."""
    queries = scored(g, run)
    cands = stored(K.sampled_candidates(g, queries, run.q, run.seed))
    ranks = R.positive_ranks(score(cands)).join(queries.select(F.col("eid").alias("qid"), "phase"), "qid")
    return R.metrics(ranks, ["phase"])


_SPLIT = "(split <> 'train' OR t IN (SELECT t FROM tail))"


@query("phase_mrr", T.sql(
    "days AS (SELECT t, row_number() OVER (ORDER BY t DESC) AS back, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM quads WHERE split = 'train')), tail AS (SELECT t FROM days WHERE back <= floor(n * 0.3))",
    T.NEGATIVES.replace("split = 'test'", _SPLIT), T.DSH, "scored AS (SELECT qid, cand_idx, round(score, 9) AS score FROM dsh)", T.RANKS,
    select="SELECT split AS phase, count(*) AS queries, round(avg(1.0 / strict), 6) AS mrr_strict, round(avg(1.0 / loose), 6) AS mrr_loose FROM ranks JOIN quads ON eid = qid GROUP BY split",
))
def phase_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.event_graph(spark, sf_dir)
    out = phase_metrics(g, RunConfig(), lambda c: H.decayed_scores(c, g.quads, T.DECAY).withColumn("score", F.round("score", 9)))
    return R.rounded(out.select("phase", "queries", "mrr_strict", "mrr_loose"))
