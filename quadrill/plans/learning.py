"""Queries of learnt scores: networks over events, out-of-fold scores for the ranker, rescue by a fitted model."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.graph import TemporalGraph, inverse_augment, last_snapshots
from quadrill.operators import event_model as E
from quadrill.operators import features as X
from quadrill.operators import history as H
from quadrill.operators import negatives as K
from quadrill.operators import ppr as P
from quadrill.operators import ranking as R
from quadrill.operators import rerank as L
from quadrill.operators import time_model as N
from quadrill.plans import temporal as T
from quadrill.plans.catalog import query

#: Training of the registered queries: bounds of the sample, and how long it is learnt from.
CONFIG = E.EventConfig(epochs=6, most_queries=1000, most_candidates=16, windows=(3, 10))
SUFFIX = 0.3
#: Candidates of a query that the fitted model may order anew. It must exceed 10: reordering the first ten alone moves no target into or out of them.
RESCUED = 100


def parts(spark: SparkSession, sf_dir: str) -> tuple[TemporalGraph, DataFrame, dict[str, DataFrame]]:
    """The graph, its facts with inverses (so that targets have events too), and the queries of training prefix and suffix, validation and test."""
    g = T.event_graph(spark, sf_dir)
    train = g.quads.where("split = 'train'")
    tail = P.stored(last_snapshots(train, SUFFIX))
    queries = {"prefix": train.join(tail.select("t").distinct(), "t", "left_anti"), "suffix": tail} | {s: g.quads.where(F.col("split") == s) for s in ("val", "test")}
    return g, inverse_augment(g.quads, g.num_rels), queries


def candidates(g: TemporalGraph, queries: DataFrame) -> DataFrame:
    return P.stored(K.sampled_candidates(g, queries, T.Q, T.SEED))


def _learnt(name: str, **options) -> None:
    @query(name)
    def run(spark, sf_dir):
        """The network fitted on the training suffix, stopped by validation queries; metrics of the test queries."""
        g, quads, q = parts(spark, sf_dir)
        config = replace(CONFIG, **options)
        train, val = (candidates(g, N.sampled_queries(q[n], config, salt)) for n, salt in (("suffix", 0), ("val", 1)))  # the others are never read
        model = E.fit(train, val, quads, 2 * g.num_rels, config)
        return R.metrics(R.positive_ranks(E.event_scores(candidates(g, q["test"]), quads, model)))


_learnt("event_mixer_mrr", encoder="mixer")
_learnt("event_attention_mrr", encoder="attention", gate="channel")
_learnt("event_cross_mrr", encoder="attention", cross="events", windows=())


def with_struct(g: TemporalGraph, cands: DataFrame) -> DataFrame:
    """Candidates with the decayed-frequency score ``struct``, written once, for the learnt score reads them several times."""
    return P.stored(H.decayed_scores(cands, g.quads, T.DECAY).withColumnRenamed("score", "struct"))


def in_reach(scored: DataFrame) -> DataFrame:
    """Of candidates with ``struct`` those of the queries that a rescue ranker reads."""
    queries = P.stored(X.rescue_rows(scored, RESCUED, score="struct", fair=True).select("qid").distinct())
    return scored.join(L.read_queries(queries, "qid"), "qid", "left_semi").select(*scored.columns)


def learnt_scores(spark: SparkSession, sf_dir: str, rescue: bool = False) -> tuple[TemporalGraph, dict[str, DataFrame]]:
    """The graph and the scores ``struct`` (decayed frequency) and ``time`` (learnt, out of fold) of suffix, validation and test candidates.

    Of suffix and validation only the queries that the ranker reads are there: for ``rescue`` those are chosen among the queries whose true target it can reach.
    """
    g, quads, q = parts(spark, sf_dir)
    early, late = E.fold_models(q["prefix"], q["suffix"], q["val"], quads, 2 * g.num_rels, CONFIG, lambda some: candidates(g, some))
    read = lambda n: P.stored(in_reach(with_struct(g, candidates(g, q[n])))) if rescue else with_struct(g, candidates(g, L.read_queries(q[n])))
    scored = {n: E.event_scores(df, quads, model).withColumnRenamed("score", "time") for n, df, model in (("suffix", read("suffix"), early), ("val", read("val"), late), ("test", with_struct(g, candidates(g, q["test"])), late))}
    return g, {n: P.stored(df) for n, df in scored.items()}


def learnt_features(g: TemporalGraph, scores: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Features of the scores with fair ranks; those that are learnt from are written once, for they are read twice."""
    f = {n: X.hybrid_features(df, g.num_rels, fair=True) for n, df in scores.items()}
    return {n: df if n == "test" else P.stored(df) for n, df in f.items()}


@query("recommender_oof")
def recommender_oof(spark, sf_dir):
    """List-wise boosting over all 32 columns, the learnt time score out of fold among them; metrics of the test queries."""
    f = learnt_features(*learnt_scores(spark, sf_dir))
    return R.metrics(R.positive_ranks(L.rerank_listwise(f["suffix"], f["val"], f["test"])))


@query("rescue_model")
def rescue_model(spark, sf_dir):
    """Rescue by a fitted ranker: the six counters, and the metrics before and after."""
    g, scores = learnt_scores(spark, sf_dir, rescue=True)
    f = learnt_features(g, scores)
    done, _ = L.rescue((scores["suffix"], f["suffix"]), (scores["val"], f["val"]), (scores["test"], f["test"]), RESCUED, "struct")
    done = P.stored(done)
    before = R.metrics(R.positive_ranks(scores["test"], "struct")).select(F.col("mrr_strict").alias("mrr_strict_before"), F.col("mrr_average").alias("mrr_average_before"))
    after = R.metrics(R.positive_ranks(done, "final")).select(F.col("mrr_strict").alias("mrr_strict_after"), F.col("mrr_average").alias("mrr_average_after"))
    return X.rescue_stats(done).crossJoin(F.broadcast(before)).crossJoin(F.broadcast(after))
