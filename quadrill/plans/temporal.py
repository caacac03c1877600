"""Queries over the quad view of the events table and their SQL: data layer, candidates, history, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill import graph as G
from quadrill.operators import history as H
from quadrill.operators import negatives as K
from quadrill.operators import ppr as P
from quadrill.operators import ranking as R
from quadrill.operators import relations as M
from quadrill.plans.catalog import query

DECAY, WINDOW, Q, SEED = 0.3, 5, 20, 42

#: The quad view in SQL.
QUADS = """quads AS (
  SELECT event_id AS eid, user_id AS s, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS r, CAST(json_extract(props, '$.k') AS BIGINT) AS o,
    date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, CASE WHEN date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) < 20 THEN 'train'
    WHEN date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) < 25 THEN 'val' ELSE 'test' END AS split FROM events
)"""
#: Negatives of the test queries: the walk of each (t, s, r) over the targets, tier by tier.
NEGATIVES = f"""asked AS (SELECT DISTINCT t, s, r FROM quads WHERE split = 'test'),
size AS (SELECT max(o) + 1 AS n FROM quads),
pos_r AS (SELECT DISTINCT t, r, o FROM quads), pos_sr AS (SELECT DISTINCT t, s, r, o FROM quads),
walks AS (SELECT t, s, r, n, md5(concat_ws('|', '{SEED}', t, s, r)) AS h FROM asked, size),
steps AS (SELECT t, s, r, place, (([{", ".join(map(str, K.STRIDES))}][1 + (('0x' || substr(h, 9, 2))::BIGINT % {len(K.STRIDES)})] % n) * place + ('0x' || substr(h, 1, 8))::BIGINT) % n AS cand
  FROM (SELECT *, unnest(range(0, n)) AS place FROM walks)),
left_ AS (SELECT steps.*, CASE WHEN p.o IS NULL THEN 0 ELSE 1 END AS tier FROM steps LEFT JOIN pos_r p ON p.t = steps.t AND p.r = steps.r AND p.o = cand
  WHERE NOT EXISTS (SELECT 1 FROM pos_sr x WHERE x.t = steps.t AND x.s = steps.s AND x.r = steps.r AND x.o = cand)),
ranked AS (SELECT t, s, r, cand, row_number() OVER w AS rn FROM left_ WINDOW w AS (PARTITION BY t, s, r ORDER BY tier, place)),
negs AS (SELECT t, s, r, CAST(rn AS INTEGER) AS neg_idx, cand FROM ranked WHERE rn <= {Q}),
cands AS (SELECT eid AS qid, s, r, t, 0 AS cand_idx, o AS cand FROM quads WHERE split = 'test'
  UNION ALL SELECT eid, q.s, q.r, q.t, neg_idx, cand FROM quads q JOIN negs USING (t, s, r) WHERE split = 'test')"""
#: Decayed shares of the candidates.
DSH = f"""past AS (SELECT c.s, c.r, c.t, h.o, h.t AS p FROM (SELECT DISTINCT s, r, t FROM cands) c JOIN quads h ON h.s = c.s AND h.r = c.r AND h.t < c.t),
weights AS (SELECT s, r, t, o, sum(pow(2.0, {DECAY} * (p - t))) AS w FROM past GROUP BY ALL),
shares AS (SELECT s, r, t, o AS cand, w / sum(w) OVER (PARTITION BY s, r, t) AS share FROM weights),
dsh AS (SELECT c.*, coalesce(share, 0.0) AS score FROM cands c LEFT JOIN shares USING (s, r, t, cand))"""
RECENCY = """ranked_past AS (SELECT c.s, c.t, h.o AS cand, c.t - h.t AS age, row_number() OVER (PARTITION BY c.s, c.t ORDER BY h.t DESC, h.eid DESC) AS place
  FROM (SELECT DISTINCT s, t FROM cands) c JOIN quads h ON h.s = c.s AND h.t < c.t),
recency_sums AS (SELECT s, t, cand, sum(exp(-age / 5.0)) AS share FROM ranked_past WHERE place <= 20 GROUP BY ALL),
recency AS (SELECT c.*, coalesce(share, 0.0) AS score FROM cands c LEFT JOIN recency_sums USING (s, t, cand))"""


def sql(*parts: str, select: str) -> str:
    return f"WITH {', '.join([QUADS, *parts])} {select}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.from_events(spark, sf_dir)


def event_graph(spark: SparkSession, sf_dir: str) -> G.TemporalGraph:
    """The graph; its facts are parsed once and kept."""
    return G.graph_of(P.stored(events(spark, sf_dir)))


def test_candidates(spark: SparkSession, sf_dir: str) -> tuple[G.TemporalGraph, DataFrame]:
    """The graph and the candidate table of its test queries, which is written once, for scores read it several times."""
    g = event_graph(spark, sf_dir)
    return g, P.stored(K.sampled_candidates(g, g.quads.where("split = 'test'"), Q, SEED))


def test_lists(spark: SparkSession, sf_dir: str) -> tuple[G.TemporalGraph, DataFrame]:
    """The graph and the candidates of its test queries as lists, for scores that read them once."""
    g = event_graph(spark, sf_dir)
    return g, K.candidate_lists(g, g.quads.where("split = 'test'"), Q, SEED)


@query("quads", sql(select="SELECT eid, s, r, o, t, split FROM quads"))
def quads(spark, sf_dir):
    return events(spark, sf_dir)


@query("inverse_augment", sql(select="SELECT eid, s, r, o, t, split, 0 AS inverse FROM quads UNION ALL SELECT eid, o, r + 5, s, t, split, 1 FROM quads"))
def inverse_augment(spark, sf_dir):
    return G.inverse_augment(events(spark, sf_dir), 5)


@query("inverse_relation", sql(select="SELECT eid, r, CAST((r + 5) % 10 AS INTEGER) AS r_inv FROM quads"))
def inverse_relation(spark, sf_dir):
    return events(spark, sf_dir).select("eid", "r", G.inverse_relation(F.col("r"), 10).cast("int").alias("r_inv"))


@query("time_ordinal", sql(select="SELECT eid, t * t AS t, dense_rank() OVER (ORDER BY t * t) - 1 AS t_norm FROM quads"))
def time_ordinal(spark, sf_dir):
    return G.ordinal_time(events(spark, sf_dir).withColumn("t", F.col("t") * F.col("t"))).select("eid", "t", "t_norm")


@query("time_step", sql("f AS (SELECT min(t) AS a FROM quads)", select="SELECT eid, t * 86400 AS t, CAST(ceil((t - a) * 86400 / 86400.0) AS BIGINT) AS t_norm FROM quads, f"))
def time_step(spark, sf_dir):
    return G.step_time(events(spark, sf_dir).withColumn("t", F.col("t") * 86400)).select("eid", "t", "t_norm")


@query("time_step_irregular", sql("f AS (SELECT min(t * t) AS a, (max(t * t) - min(t * t)) / (count(DISTINCT t) - 1.0) AS step FROM quads)", select="SELECT eid, t * t AS t, CAST(ceil((t * t - a) / step) AS BIGINT) AS t_norm FROM quads, f"))
def time_step_irregular(spark, sf_dir):
    return G.step_time(events(spark, sf_dir).withColumn("t", F.col("t") * F.col("t"))).select("eid", "t", "t_norm")


@query("snapshot_stats", sql(select="SELECT split, count(DISTINCT t) AS snapshots, count(*) AS events, max(greatest(s, o)) AS max_node, max(r) AS max_rel, min(t) AS first_t, max(t) AS last_t FROM quads GROUP BY split"))
def snapshot_stats(spark, sf_dir):
    return G.snapshot_stats(events(spark, sf_dir))


@query("split_suffix", sql("x AS (SELECT t, row_number() OVER (ORDER BY t DESC) AS b, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM quads WHERE split = 'train'))", select="SELECT eid, t FROM quads WHERE split = 'train' AND t IN (SELECT t FROM x WHERE b <= floor(n * 0.3))"))
def split_suffix(spark, sf_dir):
    return G.last_snapshots(events(spark, sf_dir).where("split = 'train'"), 0.3).select("eid", "t")


@query("quick_val_suffix", sql("x AS (SELECT t, sum(count(*)) OVER (ORDER BY t DESC) - count(*) AS a, sum(count(*)) OVER () AS n FROM quads WHERE split = 'val' GROUP BY t)", select="SELECT eid, t FROM quads WHERE split = 'val' AND t IN (SELECT t FROM x WHERE a < ceil(n * 0.4))"))
def quick_val_suffix(spark, sf_dir):
    return G.suffix_with(events(spark, sf_dir).where("split = 'val'"), fraction=0.4).select("eid", "t")


@query("val_tail", sql("x AS (SELECT eid, row_number() OVER (ORDER BY eid) - 1 AS i, count(*) OVER () AS n FROM quads WHERE split = 'val')", select="SELECT eid FROM x WHERE i >= CAST(floor(n * (1 - 0.25)) AS BIGINT)"))
def val_tail(spark, sf_dir):
    return G.val_tail(events(spark, sf_dir).where("split = 'val'"), 0.25, "eid").select("eid")


@query("positive_map_query", sql(select="SELECT t, s, r, CAST(list_sort(list(DISTINCT o)) AS VARCHAR) AS positives FROM quads GROUP BY t, s, r"))
def positive_map_query(spark, sf_dir):
    p = K.positives(events(spark, sf_dir), ["t", "s", "r"])
    return p.withColumn("positives", F.concat(F.lit("["), F.array_join(F.transform("positives", lambda x: x.cast("string")), ", "), F.lit("]")))


@query("positive_map_time_rel", sql(select="SELECT t, r, CAST(list_sort(list(DISTINCT o)) AS VARCHAR) AS positives FROM quads GROUP BY t, r"))
def positive_map_time_rel(spark, sf_dir):
    p = K.positives(events(spark, sf_dir), ["t", "r"])
    return p.withColumn("positives", F.concat(F.lit("["), F.array_join(F.transform("positives", lambda x: x.cast("string")), ", "), F.lit("]")))


@query("available_negatives", sql("d AS (SELECT max(o) + 1 AS n FROM quads), x AS (SELECT n - count(DISTINCT o) AS left_ FROM quads, d GROUP BY t, s, r, n)", select="SELECT count(*) AS queries, min(left_) AS fewest, count(*) FILTER (left_ < 99) AS short FROM x"))
def available_negatives(spark, sf_dir):
    g = event_graph(spark, sf_dir)
    return K.available_negatives(g.quads, g.num_dst, 99)


@query("negatives_tiered", sql(NEGATIVES, select="SELECT * FROM negs"))
def negatives_tiered(spark, sf_dir):
    g = event_graph(spark, sf_dir)
    return K.tiered(g, g.quads.where("split = 'test'"), Q, SEED)


@query("negatives_full", sql("asked AS (SELECT DISTINCT t, s, r FROM quads WHERE split = 'test'), dst AS (SELECT unnest(range(0, (SELECT max(o) + 1 FROM quads))) AS cand)", select="SELECT t, s, r, cand FROM asked, dst WHERE NOT EXISTS (SELECT 1 FROM quads q WHERE q.t = asked.t AND q.s = asked.s AND q.r = asked.r AND q.o = cand)"))
def negatives_full(spark, sf_dir):
    g = event_graph(spark, sf_dir)
    return K.full(g, g.quads.where("split = 'test'"))


def _train_hard_sql(q: int, ratio: float) -> str:
    return sql(
        "seen AS (SELECT r, o, min(t) AS first_t FROM quads GROUP BY r, o), size AS (SELECT max(o) + 1 AS n FROM quads)",
        f"walks AS (SELECT eid AS qid, t, s, r, n, md5(concat_ws('|', '{SEED}', eid, t, s, r)) AS h FROM quads, size WHERE split = 'val')",
        f"steps AS (SELECT qid, t, s, r, place, (([{', '.join(map(str, K.STRIDES))}][1 + (('0x' || substr(h, 9, 2))::BIGINT % {len(K.STRIDES)})] % n) * place + ('0x' || substr(h, 1, 8))::BIGINT) % n AS cand FROM (SELECT *, unnest(range(0, n)) AS place FROM walks))",
        "pos AS (SELECT DISTINCT t, s, r, o FROM quads)",
        "kept AS (SELECT k.qid, k.place, k.cand, CASE WHEN first_t < k.t THEN 1 ELSE 0 END AS hard FROM steps k LEFT JOIN seen ON seen.r = k.r AND seen.o = k.cand LEFT JOIN pos p ON p.t = k.t AND p.s = k.s AND p.r = k.r AND p.o = k.cand WHERE p.o IS NULL)",
        "own AS (SELECT *, row_number() OVER (PARTITION BY qid, hard ORDER BY place) AS own_rank FROM kept)",
        f"few AS (SELECT qid, cand, hard, row_number() OVER (PARTITION BY qid ORDER BY hard DESC, place) AS i FROM own WHERE hard = 0 OR own_rank <= {int(q * ratio)} QUALIFY i <= {q})",
        "sized AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, count(*) FILTER (hard = 0) OVER (PARTITION BY qid) AS others FROM few)",
        "fill AS (SELECT *, CASE WHEN others > 0 THEN others ELSE n END AS many, CASE WHEN others > 0 THEN i - (n - others) ELSE i END AS nth FROM sized WHERE hard = 0 OR others = 0)",
        select=f"""SELECT qid, CAST(i AS INTEGER) AS neg_idx, cand, hard FROM few UNION ALL SELECT qid, CAST(unnest(range(n + nth, {q} + 1, many)) AS INTEGER), cand, hard FROM fill
UNION ALL SELECT eid, CAST(range + 1 AS INTEGER), o, 0 FROM quads, range({q}) WHERE split = 'val' AND eid NOT IN (SELECT qid FROM few)""",
    )


@query("negatives_train_hard", _train_hard_sql(Q, 0.5))
def negatives_train_hard(spark, sf_dir):
    g = event_graph(spark, sf_dir)
    return K.train_hard(g, g.quads.where("split = 'val'"), Q, 0.5, SEED)


WIDE = 99


@query("negatives_no_repeat", sql(NEGATIVES.replace(f"rn <= {Q})", f"rn <= {WIDE})"), select="SELECT * FROM negs"))
def negatives_no_repeat(spark, sf_dir):
    """Lists longer than some queries have targets for: these stay short."""
    g = event_graph(spark, sf_dir)
    return K.tiered(g, g.quads.where("split = 'test'"), WIDE, SEED, repeat=False)


@query("negative_counts", sql(NEGATIVES.replace(f"rn <= {Q})", f"rn <= {WIDE})"), select=f"SELECT t, s, r, count(*) AS n FROM negs GROUP BY t, s, r HAVING count(*) <> {WIDE}"))
def negative_counts(spark, sf_dir):
    return K.check_counts(negatives_no_repeat(spark, sf_dir), WIDE)


@query("negatives_full_if_short", sql("asked AS (SELECT DISTINCT t, s, r FROM quads WHERE split = 'val'), dst AS (SELECT unnest(range(0, (SELECT max(o) + 1 FROM quads))) AS cand)", select="SELECT t, s, r, cand, CAST(row_number() OVER (PARTITION BY t, s, r ORDER BY cand) AS INTEGER) AS neg_idx FROM asked, dst WHERE NOT EXISTS (SELECT 1 FROM quads q WHERE q.t = asked.t AND q.s = asked.s AND q.r = asked.r AND q.o = cand)"))
def negatives_full_if_short(spark, sf_dir):
    """More negatives are asked for than there are targets, so every query gets all of its own."""
    g = event_graph(spark, sf_dir)
    return K.full_if_short(g, g.quads.where("split = 'val'"), g.num_dst, SEED)


@query("negatives_train_padded", _train_hard_sql(WIDE, 0.3))
def negatives_train_padded(spark, sf_dir):
    """Longer lists than targets are left for some queries, which fill them up."""
    g = event_graph(spark, sf_dir)
    return K.train_hard(g, g.quads.where("split = 'val'"), WIDE, 0.3, SEED)


@query("negatives_train_fast", sql(
    "firsts AS (SELECT r, o, min(t) AS first_t FROM quads GROUP BY r, o), numbered AS (SELECT r, o AS cand, row_number() OVER (PARTITION BY r ORDER BY first_t, o) - 1 AS nth FROM firsts), size AS (SELECT max(o) + 1 AS n FROM quads)",
    f"draws AS (SELECT eid AS qid, q.r, q.o, i.range + 1 AS neg_idx, ('0x' || substr(md5(concat_ws('|', '{SEED}', eid, i.range + 1)), 1, 12))::BIGINT AS draw, (SELECT count(*) FROM firsts f WHERE f.r = q.r AND f.first_t < q.t) AS had FROM quads q, range({Q}) i WHERE split = 'val')",
    "moved AS (SELECT d.*, own.nth AS own, CASE WHEN own.nth = draw % had THEN (draw % had + 1) % had ELSE draw % had END AS nth FROM draws d LEFT JOIN numbered own ON own.r = d.r AND own.cand = d.o)",
    f"hard AS (SELECT a.qid, a.neg_idx, n.cand FROM moved a JOIN numbered n ON n.r = a.r AND n.nth = a.nth WHERE neg_idx <= {int(Q * 0.5)} AND had > 0 AND n.cand <> a.o)",
    select="""SELECT qid, CAST(neg_idx AS INTEGER) AS neg_idx, cand, 1 AS hard FROM hard UNION ALL
SELECT qid, CAST(neg_idx AS INTEGER), CASE WHEN draw % n = o THEN (draw % n + 1) % n ELSE draw % n END, 0 FROM draws, size WHERE NOT EXISTS (SELECT 1 FROM hard h WHERE h.qid = draws.qid AND h.neg_idx = draws.neg_idx)""",
))
def negatives_train_fast(spark, sf_dir):
    g = event_graph(spark, sf_dir)
    return K.train_fast(g, g.quads.where("split = 'val'"), Q, 0.5, SEED)


@query("dsh_state", sql(f"w AS (SELECT s, r, o, sum(pow(2.0, {DECAY} * (t - 25))) AS w FROM quads WHERE t < 25 GROUP BY s, r, o)", select="SELECT s, r, o, round(w / sum(w) OVER (PARTITION BY s, r), 6) AS weight FROM w"))
def dsh_state(spark, sf_dir):
    return H.decayed_state(events(spark, sf_dir), DECAY, until=25).withColumn("weight", F.round("weight", 6))


@query("dsh_scores", sql(NEGATIVES, DSH, select="SELECT qid, cand_idx, cand, round(score, 6) AS score FROM dsh"))
def dsh_scores(spark, sf_dir):
    g, cands = test_candidates(spark, sf_dir)
    return H.decayed_scores(cands, g.quads, DECAY).select("qid", "cand_idx", "cand", F.round("score", 6).alias("score"))


RANKS = "ranks AS (SELECT qid, 1 + count(*) FILTER (cand_idx > 0 AND score > p) AS loose, 1 + count(*) FILTER (cand_idx > 0 AND score >= p) AS strict FROM (SELECT *, max(CASE WHEN cand_idx = 0 THEN score END) OVER (PARTITION BY qid) AS p FROM scored) GROUP BY qid)"
METRICS = "SELECT count(*) AS queries, " + ", ".join(
    [f"round(avg(1.0 / ({e})), 6) AS mrr_{n}" for n, e in R.POLICIES.items()] + [f"round(avg(CASE WHEN ({e}) <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hit{k}_{n}" for n, e in R.POLICIES.items() for k in R.HITS]
) + " FROM ranks"


@query("dsh_mrr", sql(NEGATIVES, DSH, "scored AS (SELECT qid, cand_idx, round(score, 9) AS score FROM dsh)", RANKS, select=METRICS))
def dsh_mrr(spark, sf_dir):
    g, cands = test_candidates(spark, sf_dir)
    scores = H.decayed_scores(cands, g.quads, DECAY).withColumn("score", F.round("score", 9))
    return R.rounded(R.metrics(R.positive_ranks(scores)))


def recency_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, lists = test_lists(spark, sf_dir)
    scores = H.recency_lists(lists, g.quads)
    return R.list_ranks(scores.withColumn("scores", F.transform("scores", lambda x: F.round(x, 9))))


@query("positive_ranks", sql(NEGATIVES, RECENCY, "scored AS (SELECT qid, cand_idx, round(score, 9) AS score FROM recency)", RANKS, select="SELECT qid, loose, strict, (loose + strict) / 2.0 AS average FROM ranks"))
def positive_ranks(spark, sf_dir):
    return recency_ranks(spark, sf_dir)


@query("rank_metrics", sql(NEGATIVES, RECENCY, "scored AS (SELECT qid, cand_idx, round(score, 9) AS score FROM recency)", RANKS, select=METRICS))
def rank_metrics(spark, sf_dir):
    return R.rounded(R.metrics(recency_ranks(spark, sf_dir)))


SIM = f"""pairs AS (SELECT a.r AS x, b.r AS y FROM quads a JOIN quads b ON a.s = b.s AND a.o = b.o AND ((a.t < b.t AND b.t - a.t < {WINDOW}) OR (a.t = b.t AND a.eid < b.eid))),
sim AS (SELECT r_i, r_j, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT x AS r_i, y AS r_j FROM pairs UNION ALL SELECT y, x FROM pairs) GROUP BY r_i, r_j)"""
TRANS = f"""trans AS (SELECT e.r AS r_i, h.r AS r_j, sum(exp(-0.2 * (e.t - h.t))) AS cnt FROM quads e JOIN quads h ON h.s = e.o AND h.t < e.t AND e.t - h.t < {WINDOW} GROUP BY e.r, h.r)"""
GRID = "grid AS (SELECT CAST(a.range AS INTEGER) AS r_i, CAST(b.range AS INTEGER) AS r_j FROM range(5) a, range(5) b)"


@query("sim_counts", sql(SIM, select="SELECT r_i, r_j, cnt FROM sim"))
def sim_counts(spark, sf_dir):
    return M.similarity_counts(events(spark, sf_dir), WINDOW)


@query("sim_matrix", sql(SIM, GRID,
    "c AS (SELECT r_i, r_j, coalesce(cnt, 0) + 1.0 AS c FROM grid LEFT JOIN sim USING (r_i, r_j))",
    "l AS (SELECT r_i, r_j, (c / sum(c) OVER ()) / ((sum(c) OVER (PARTITION BY r_i) / sum(c) OVER ()) * (sum(c) OVER (PARTITION BY r_j) / sum(c) OVER ()) + 1e-8) AS lift FROM c)",
    select="SELECT r_i, r_j, round(0.5 + 0.5 / (1 + exp(-ln(lift + 1e-8))), 6) AS val FROM l"))
def sim_matrix(spark, sf_dir):
    return M.similarity_matrix(M.similarity_counts(events(spark, sf_dir), WINDOW), 5).withColumn("val", F.round("val", 6))


@query("trans_counts", sql(TRANS, select="SELECT r_i, r_j, round(cnt, 4) AS cnt FROM trans"))
def trans_counts(spark, sf_dir):
    return M.transition_counts(events(spark, sf_dir), WINDOW, 0.2).withColumn("cnt", F.round("cnt", 4))


@query("trans_matrix", sql(TRANS, GRID, "c AS (SELECT r_i, r_j, coalesce(cnt, 0.0) AS c FROM grid LEFT JOIN trans USING (r_i, r_j))",
    "m AS (SELECT *, min(c) OVER (PARTITION BY r_i) AS a, max(c) OVER (PARTITION BY r_i) AS b FROM c)",
    select="SELECT r_i, r_j, round(CASE WHEN b - a >= 1e-9 THEN 0.2 + 0.8 * (c - a) / (b - a) ELSE 0.2 END, 6) AS val FROM m"))
def trans_matrix(spark, sf_dir):
    return M.transition_matrix(M.transition_counts(events(spark, sf_dir), WINDOW, 0.2), 5).withColumn("val", F.round("val", 6))


TIMELINE = "b AS (SELECT c.qid, c.cand_idx, c.cand, (SELECT count(*) FROM quads h WHERE h.r = c.r AND h.o = c.cand AND h.t < c.t) AS b_count, (SELECT count(*) FROM quads h WHERE h.r = c.r AND h.t < c.t) AS b_rel FROM cands c)"


@query("b_timeline_continuous", sql(NEGATIVES, TIMELINE, "n AS (SELECT max(greatest(s, o)) + 1 AS n FROM quads)", select="SELECT qid, cand_idx, cand, b_count, round((b_count + 1.0) / (b_rel + 1.0 * n), 8) AS b_score FROM b, n"))
def b_timeline_continuous(spark, sf_dir):
    g, cands = test_candidates(spark, sf_dir)
    return H.timeline_scores(cands, g.quads, num_nodes=g.num_nodes).select("qid", "cand_idx", "cand", "b_count", F.round("b_score", 8).alias("b_score"))


@query("b_timeline_binary", sql(NEGATIVES, TIMELINE, select="SELECT qid, cand_idx, cand, CASE WHEN b_count > 0 THEN 1.0 ELSE 0.1 END::DOUBLE AS b_score FROM b"))
def b_timeline_binary(spark, sf_dir):
    g, cands = test_candidates(spark, sf_dir)
    return H.timeline_scores(cands, g.quads, "binary", unseen=0.1).select("qid", "cand_idx", "cand", "b_score")


_COUNT = "(SELECT count(*) FROM quads h WHERE {} AND h.t < c.t)"
CAUSAL = ", ".join(
    [f"{_COUNT.format(w)} AS {n}" for n, w in {"tail_count": "h.o = c.cand", "rel_tail_count": "h.r = c.r AND h.o = c.cand", "source_count": "h.s = c.s", "rel_count": "h.r = c.r", "source_rel": "h.s = c.s AND h.r = c.r", "exact_sro": "h.s = c.s AND h.r = c.r AND h.o = c.cand", "source_tail": "h.s = c.s AND h.o = c.cand"}.items()]
    + [f"{_COUNT.format('h.s = c.cand')} + {_COUNT.format('h.o = c.cand')} AS incident_count"]
)
COUNTERS = ["tail_count", "incident_count", "rel_tail_count", "source_count", "rel_count", "source_rel", "exact_sro", "source_tail"]


@query("causal_history", sql(NEGATIVES, select=f"SELECT qid, cand_idx, cand, {CAUSAL} FROM cands c"))
def causal_history(spark, sf_dir):
    g, cands = test_candidates(spark, sf_dir)
    return H.causal_features(cands, g.quads).select("qid", "cand_idx", "cand", *COUNTERS)


@query("running_counts", sql(select="SELECT s, r, t, count(*) AS n, CAST(coalesce(sum(count(*)) OVER (PARTITION BY s, r ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM quads GROUP BY s, r, t"))
def running_counts(spark, sf_dir):
    return H.running(events(spark, sf_dir), ["s", "r"])


@query("relation_object_history", sql(select="SELECT r, o, min(t) AS first_t FROM quads GROUP BY r, o"))
def relation_object_history(spark, sf_dir):
    return H.relation_history(events(spark, sf_dir))


PAST = "asked_nodes AS (SELECT DISTINCT s AS node, t FROM quads WHERE split = 'test'), past_events AS (SELECT a.node, a.t, h.t AS event_t, h.r, h.o AS neighbor, a.t - h.t AS delta, row_number() OVER (PARTITION BY a.node, a.t ORDER BY h.t DESC, h.eid DESC) AS place FROM asked_nodes a JOIN quads h ON h.s = a.node AND h.t < a.t)"


def recent(spark, sf_dir, k):
    q = events(spark, sf_dir)
    return H.recent_events(q.where("split = 'test'").select(F.col("s").alias("node"), "t"), q, k)


@query("recent_k", sql(PAST, select="SELECT node, t, CAST(place AS INTEGER) AS place, event_t, r, neighbor, delta FROM past_events WHERE place <= 10"))
def recent_k(spark, sf_dir):
    return recent(spark, sf_dir, 10)


@query("multi_window_recent", sql(PAST, select="SELECT node, t, " + ", ".join(f"count(*) FILTER (place <= {w}) AS n_{w}, round(avg(delta) FILTER (place <= {w}), 6) AS age_{w}, count(DISTINCT r) FILTER (place <= {w}) AS rels_{w}" for w in (5, 15, 30)) + " FROM past_events WHERE place <= 30 GROUP BY node, t"))
def multi_window_recent(spark, sf_dir):
    out = H.multi_window(recent(spark, sf_dir, 30), [5, 15, 30])
    return out.withColumns({f"age_{w}": F.round(f"age_{w}", 6) for w in (5, 15, 30)})


@query("recency_scores", sql(NEGATIVES, RECENCY, select="SELECT qid, cand_idx, cand, round(score, 6) AS score FROM recency"))
def recency_scores(spark, sf_dir):
    g, lists = test_lists(spark, sf_dir)
    return K.laid_out(H.recency_lists(lists, g.quads), {"scores": "score"}).select("qid", "cand_idx", "cand", F.round("score", 6).alias("score"))


ORDERS = """last_user AS (SELECT max(o_custkey) AS m FROM orders), ranks_p AS (SELECT o_orderkey, o_custkey, o_orderdate, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS r FROM orders),
thg AS (SELECT l_orderkey * 8 + l_linenumber AS eid, o_custkey AS s, r, l_suppkey + m + 1 AS o, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS t FROM ranks_p JOIN lineitem ON o_orderkey = l_orderkey, last_user)"""


@query("thg_quads", f"WITH {ORDERS} SELECT eid, s, r, o, t, CASE WHEN t < 60 THEN 'train' WHEN t < 66 THEN 'val' ELSE 'test' END AS split FROM thg")
def thg_quads(spark, sf_dir):
    return G.from_orders(spark, sf_dir)


@query("thg_decayed_state", f"WITH {ORDERS}, w AS (SELECT s, r, o, sum(pow(2.0, 0.1 * (t - 80))) AS w FROM thg GROUP BY s, r, o) SELECT s, r, o, round(w / sum(w) OVER (PARTITION BY s, r), 6) AS weight FROM w")
def thg_decayed_state(spark, sf_dir):
    return H.decayed_state(G.from_orders(spark, sf_dir), 0.1).withColumn("weight", F.round("weight", 6))
