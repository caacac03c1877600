"""Queries of time encodings, word graphs and stores, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrill.functions import encoding as E
from quadrill.functions import entities as W
from quadrill.graph import last_snapshots
from quadrill.operators import features as X
from quadrill.operators import history as H
from quadrill.operators import negatives as K
from quadrill.operators import ppr as P
from quadrill.operators import ranking as R
from quadrill.operators import time_model as N
from quadrill.operators.rerank import rerank, rerank_listwise
from quadrill.plans import temporal as T
from quadrill.plans.catalog import query
from quadrill.sources.stores import ScoreStore

SCALES = E.multiscale_frequencies(8, 1.0, 30.0)
PERIODS = E.periodic_frequencies([7.0, 30.0], 2)


def _encoded_sql(frequencies, of: str) -> str:
    return ", ".join([f"round(sin({of} * {f!r}), 6) + 0.0 AS sin_{i}" for i, f in enumerate(frequencies)] + [f"round(cos({of} * {f!r}), 6) + 0.0 AS cos_{i}" for i, f in enumerate(frequencies)])


@query("time_encoding_multiscale", T.sql(T.PAST, select=f"SELECT node, t, CAST(place AS INTEGER) AS place, {_encoded_sql(SCALES, 'CAST(delta AS DOUBLE)')} FROM past_events WHERE place <= 5"))
def time_encoding_multiscale(spark, sf_dir):
    df = T.recent(spark, sf_dir, 5)
    return R.rounded(df.select("node", "t", "place", *E.encoded(F.col("delta").cast("double"), SCALES)))


@query("time_encoding_periodic", T.sql(select=f"SELECT eid, {_encoded_sql(PERIODS, 'CAST(t AS DOUBLE)')} FROM quads"))
def time_encoding_periodic(spark, sf_dir):
    return R.rounded(T.events(spark, sf_dir).select("eid", *E.encoded(F.col("t").cast("double"), PERIODS)))


NAMES = "names AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' (' || p_brand || ')' END AS name, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' (' || p_brand || '@' || p_type || ')' ELSE '' END AS typed FROM part)"


def _names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")
    inner = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    typed = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" ("), "p_brand", F.lit("@"), "p_type", F.lit(")"))).otherwise(""))
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(inner).alias("name"), typed.alias("typed"))


EDGES = "edges AS (SELECT id, 0 AS role, trim(split_part(name, '(', 1)) AS word FROM names WHERE name LIKE '%(%)%' UNION ALL SELECT id, 1, split_part(split_part(name, '(', 2), ')', 1) FROM names WHERE name LIKE '%(%)%' UNION ALL SELECT id, 2, name FROM names WHERE name NOT LIKE '%(%)%')"


@query("word_graph", f"WITH {NAMES}, {EDGES}, ids AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT word FROM edges)) SELECT id, role, word_id FROM edges JOIN ids USING (word)")
def word_graph(spark, sf_dir):
    return W.word_graph(W.word_edges(_names(spark, sf_dir)))


@query("word_graph_typed", f"""WITH {NAMES}, b AS (SELECT id, trim(split_part(typed, '(', 1)) AS outer_, split_part(split_part(typed, '(', 2), ')', 1) AS inner_ FROM names WHERE typed LIKE '%(%)%')
SELECT id, 0 AS role, unnest(list_filter(string_split(trim(split_part(inner_, '@', 1)), ' '), lambda x: x <> '')) AS word FROM b UNION ALL SELECT id, 1, unnest(list_filter(string_split(trim(split_part(inner_, '@', 2)), ' '), lambda x: x <> '')) FROM b
UNION ALL SELECT id, 2, outer_ FROM b UNION ALL SELECT id, 2, typed FROM names WHERE typed NOT LIKE '%(%)%'""")
def word_graph_typed(spark, sf_dir):
    return W.typed_word_edges(_names(spark, sf_dir), "id", "typed")


@query("word_statistics", f"""WITH {NAMES}, {EDGES}, b AS (SELECT split_part(split_part(name, '(', 2), ')', 1) AS inner_ FROM names WHERE name LIKE '%(%)%')
SELECT (SELECT count(DISTINCT word) FROM edges) AS words, (SELECT count(*) FROM names) AS entities, (SELECT count(*) FROM b) / (SELECT count(*) FROM names) AS bracketed,
  (SELECT count(*) FROM b WHERE inner_ NOT IN (SELECT name FROM names)) / (SELECT count(*) FROM b) AS missing""")
def word_statistics(spark, sf_dir):
    return W.word_statistics(_names(spark, sf_dir))


@query("score_store_roundtrip", T.sql(T.NEGATIVES, T.DSH, select="SELECT qid, cand_idx, round(CAST(CAST(score AS FLOAT) AS DOUBLE), 5) + 0.0 AS score FROM dsh"))
def score_store_roundtrip(spark, sf_dir):
    g, cands = T.test_candidates(spark, sf_dir)
    store = ScoreStore(spark, f"{P.shared_folder(spark)}/quadrill-store-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}")
    store.write(H.decayed_scores(cands, g.quads, T.DECAY), "test")
    return R.rounded(store.dense("test").withColumn("score", F.col("score").cast("double")), 5)


def _split_features(spark, sf_dir):
    """Feature tables of two scores for the training suffix, validation and test queries.

    Ordinal ranks put the true target first among ties, which a ranker would learn to see; features made from them are left out.
    """
    g = T.event_graph(spark, sf_dir)
    parts = {"train": last_snapshots(g.quads.where("split = 'train'"), 0.3)} | {s: g.quads.where(F.col("split") == s) for s in ("val", "test")}
    out = {}
    for split, queries in parts.items():
        cands = P.stored(K.sampled_candidates(g, queries, T.Q, T.SEED))
        two = H.recency_scores(H.decayed_scores(cands, g.quads, T.DECAY).withColumnRenamed("score", "struct"), g.quads).withColumnRenamed("score", "time")
        table = X.hybrid_features(two, g.num_rels)
        table = table.drop(*(c for c in table.columns if "rank" in c or "top" in c))
        out[split] = table if split == "test" else P.stored(table)  # learners read theirs several times
    return out


@query("recommender_rerank")
def recommender_rerank(spark, sf_dir):
    """List-wise boosting fitted on all queries of the training suffix, stopped by all validation queries; metrics of the test queries."""
    parts = _split_features(spark, sf_dir)
    return R.metrics(R.positive_ranks(rerank_listwise(parts["train"], parts["val"], parts["test"], most_queries=None)))


@query("recommender_pointwise")
def recommender_pointwise(spark, sf_dir):
    """The pointwise ranker on the same tables."""
    parts = _split_features(spark, sf_dir)
    return R.metrics(R.positive_ranks(rerank(parts["train"], parts["test"])))


@query("time_model_mrr")
def time_model_mrr(spark, sf_dir):
    """The learnt time score: fitted on the training suffix, stopped by validation queries; metrics of the test queries."""
    g = T.event_graph(spark, sf_dir)
    parts = {"train": last_snapshots(g.quads.where("split = 'train'"), 0.3)} | {s: g.quads.where(F.col("split") == s) for s in ("val", "test")}
    parts |= {name: N.sampled_queries(parts[name], N.TimeConfig(), salt) for name, salt in (("train", 0), ("val", 1))}  # the others are never read
    cands = {name: P.stored(K.sampled_candidates(g, q, T.Q, T.SEED)) for name, q in parts.items()}
    model = N.fit(cands["train"], cands["val"], g.quads, g.num_rels)
    return R.metrics(R.positive_ranks(N.time_scores(cands["test"], g.quads, model)))
