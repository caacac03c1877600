"""Queries of windows per query, selections, feature tables and rescue, over two scores of the test candidates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.graph import TemporalGraph
from quadrill.operators import features as X
from quadrill.operators import history as H
from quadrill.operators import ranking as R
from quadrill.plans import multihop
from quadrill.plans import temporal as T
from quadrill.plans.catalog import query

PLACES = 9
#: Two scores of each candidate, rounded so that both engines break ties alike.
TWO = f"""both_scores AS MATERIALIZED (SELECT d.qid, d.s, d.r, d.t, d.cand_idx, d.cand, round(d.score, {PLACES}) AS struct, round(e.score, {PLACES}) AS time
  FROM dsh d JOIN recency e ON e.qid = d.qid AND e.cand_idx = d.cand_idx)"""
W = "(PARTITION BY qid)"


def sql(*parts: str, select: str) -> str:
    return T.sql(T.NEGATIVES, T.DSH, T.RECENCY, TWO, *parts, select=select)


def two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the decayed-frequency score ``struct`` and the recency score ``time``."""
    g, cands = T.test_candidates(spark, sf_dir)
    return both_scores(g, cands)


def both_scores(g: TemporalGraph, cands: DataFrame) -> DataFrame:
    """Recency comes first, for decayed scores read what it is joined to twice: its join falls away where only keys are asked for."""
    a = H.recency_scores(cands, g.quads).withColumnRenamed("score", "time")
    return H.decayed_scores(a, g.quads, T.DECAY).withColumnRenamed("score", "struct").withColumns({"struct": F.round("struct", PLACES), "time": F.round("time", PLACES)})


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the components of the structure model, the recency score ``time``, and their counters."""
    g = T.event_graph(spark, sf_dir)
    df = H.recency_scores(multihop.components(spark, sf_dir), g.quads).withColumnRenamed("score", "time").withColumn("time", F.round("time", PLACES))
    return H.causal_features(df, g.quads)


#: ``rows``: the components with recency and counters.
ROWS = [*multihop.COMPONENTS, T.RECENCY, f"rows AS MATERIALIZED (SELECT c.*, round(e.score, {PLACES}) AS time, {T.CAUSAL} FROM comps c JOIN recency e ON e.qid = c.qid AND e.cand_idx = c.cand_idx)"]


def _rank(c: str) -> str:
    return f"row_number() OVER (PARTITION BY qid ORDER BY {c} DESC, cand_idx)"


@query("ordinal_rank", sql(select=f"SELECT qid, cand_idx, {_rank('struct')} AS rank FROM both_scores"))
def ordinal_rank(spark, sf_dir):
    return two_scores(spark, sf_dir).select("qid", "cand_idx", R.ordinal_rank("struct").cast("long").alias("rank"))


def _windowed(name: str, expr: str, column):
    @query(name, sql(select=f"SELECT qid, cand_idx, round({expr}, 6) AS value FROM both_scores"))
    def run(spark, sf_dir):
        return two_scores(spark, sf_dir).select("qid", "cand_idx", F.round(column(), 6).alias("value"))


_windowed("maxnorm_per_query", f"CASE WHEN max(time) OVER {W} > 0 THEN time / max(time) OVER {W} ELSE 0 END", lambda: R.max_norm("time"))
_windowed("zscore_per_query", f"(time - avg(time) OVER {W}) / CASE WHEN var_pop(time) OVER {W} <= 1e-12 THEN 1 ELSE sqrt(var_pop(time) OVER {W}) END", lambda: R.z_score("time"))
_windowed("zscore_floor_per_query", f"(time - avg(time) OVER {W}) / sqrt(greatest(var_pop(time) OVER {W}, 1e-12))", lambda: R.z_score("time", floor_std=True))
_windowed("minmax_per_query", f"(time - min(time) OVER {W}) / greatest(max(time) OVER {W} - min(time) OVER {W}, 1e-12)", lambda: R.min_max("time"))
_windowed("base_scores", f"0.5 * ((struct - min(struct) OVER {W}) / greatest(max(struct) OVER {W} - min(struct) OVER {W}, 1e-12) + (time - min(time) OVER {W}) / greatest(max(time) OVER {W} - min(time) OVER {W}, 1e-12))", lambda: X.hybrid_base())

BROKEN = "broken AS (SELECT qid, cand_idx, CASE WHEN qid % 7 = 0 OR cand_idx % 11 = 3 THEN 'NaN'::DOUBLE WHEN cand_idx % 11 = 5 THEN 'Infinity'::DOUBLE WHEN cand_idx % 11 = 7 THEN '-Infinity'::DOUBLE ELSE time END AS x FROM both_scores)"


def _broken(spark, sf_dir):
    x = F.when((F.col("qid") % 7 == 0) | (F.col("cand_idx") % 11 == 3), float("nan")).when(F.col("cand_idx") % 11 == 5, float("inf")).when(F.col("cand_idx") % 11 == 7, float("-inf")).otherwise(F.col("time"))
    return two_scores(spark, sf_dir).select("qid", "cand_idx", x.alias("x"))


@query("sanitize_scores", sql(BROKEN, "lim AS (SELECT *, min(CASE WHEN isfinite(x) THEN x END) OVER (PARTITION BY qid) AS a, max(CASE WHEN isfinite(x) THEN x END) OVER (PARTITION BY qid) AS z FROM broken)",
    select="SELECT qid, cand_idx, round(CASE WHEN isfinite(x) THEN x WHEN x = 'Infinity'::DOUBLE THEN coalesce(z + greatest(z - a, 1), 1) ELSE coalesce(a - greatest(z - a, 1), -1) END, 6) AS value FROM lim"))
def sanitize_scores(spark, sf_dir):
    return _broken(spark, sf_dir).select("qid", "cand_idx", F.round(R.sanitized("x"), 6).alias("value"))


@query("non_finite_counts", sql(BROKEN, select="SELECT count(*) FILTER (NOT isfinite(x)) AS x FROM broken"))
def non_finite_counts(spark, sf_dir):
    return R.non_finite(_broken(spark, sf_dir), ["x"])


@query("linear_combo", sql(select="SELECT qid, cand_idx, cand, round(0.7 * struct + (1 - 0.7) * time, 6) AS score FROM both_scores"))
def linear_combo(spark, sf_dir):
    g, cands = T.test_candidates(spark, sf_dir)
    a, b = (df.withColumn("score", F.round("score", PLACES)) for df in (H.decayed_scores(cands, g.quads, T.DECAY), H.recency_scores(cands, g.quads)))
    return X.linear_combo(a, b, 0.7).withColumn("score", F.round("score", 6))


@query("top_direct_mask", sql(select=f"SELECT qid, cand_idx, {_rank('struct')} <= 5 AS in_top FROM both_scores"))
def top_direct_mask(spark, sf_dir):
    return X.top_direct(two_scores(spark, sf_dir), 5, "struct").select("qid", "cand_idx", "in_top")


@query("select_train_rows", sql(f"x AS (SELECT *, least({_rank('struct')}, {_rank('time')}) AS best FROM both_scores)", "y AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM x WHERE best <= 4 OR cand_idx = 0)", select="SELECT qid, cand_idx FROM y WHERE n > 1"))
def select_train_rows(spark, sf_dir):
    return X.training_rows(two_scores(spark, sf_dir), ["struct", "time"], 3).select("qid", "cand_idx")


@query("one_positive_violations", sql("x AS (SELECT qid, count(*) FILTER (cand_idx = 0) AS positives FROM both_scores GROUP BY qid)", select="SELECT qid, positives FROM x WHERE positives <> 1"))
def one_positive_violations(spark, sf_dir):
    return X.one_positive(two_scores(spark, sf_dir))


@query("group_metrics", sql("scored AS (SELECT qid, cand_idx, struct AS score FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM both_scores) WHERE n > 1)", T.RANKS, select=T.METRICS))
def group_metrics(spark, sf_dir):
    return R.rounded(R.group_metrics(two_scores(spark, sf_dir), "struct"))


RESCUE = f"""rk AS (SELECT *, {_rank('struct')} AS rank_ FROM both_scores), own AS (SELECT *, max(CASE WHEN cand_idx = 0 THEN rank_ END) OVER (PARTITION BY qid) AS own_ FROM rk)"""


@query("rescue_select", sql(RESCUE, "c AS (SELECT * FROM own WHERE rank_ <= 10 AND own_ <= 10)", "n AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS place FROM (SELECT DISTINCT qid FROM c))",
    select="SELECT qid, cand_idx, rank_ AS structure_rank FROM c JOIN n USING (qid) WHERE place % 3 = 0"))
def rescue_select(spark, sf_dir):
    return X.rescue_rows(two_scores(spark, sf_dir), 10, stride=3, score="struct").select("qid", "cand_idx", F.col("structure_rank").cast("long").alias("structure_rank"))


ORDER = f"""placed AS (SELECT *, rank_ <= 8 AS chosen FROM rk), pl AS (SELECT *, row_number() OVER (PARTITION BY qid, chosen ORDER BY time DESC, struct DESC, cand_idx) AS place, count(*) FILTER (chosen) OVER (PARTITION BY qid) AS n, coalesce(max(CASE WHEN NOT chosen THEN struct END) OVER (PARTITION BY qid), 0.0) AS floor_ FROM placed),
done AS (SELECT qid, cand_idx, cand, rank_ AS before_rank, CASE WHEN chosen THEN floor_ + 1 + (n - place + 1) / n ELSE struct END AS score FROM pl), scored AS (SELECT * FROM done)"""


def _rescued(spark, sf_dir):
    return X.rescued(two_scores(spark, sf_dir), 8, "time", "struct")


@query("rescue_order", sql(RESCUE, ORDER, select="SELECT qid, cand_idx, before_rank, round(score, 6) AS final FROM done"))
def rescue_order(spark, sf_dir):
    return _rescued(spark, sf_dir).select("qid", "cand_idx", F.col("before_rank").cast("long").alias("before_rank"), F.round("final", 6).alias("final"))


@query("rescue_stats", sql(RESCUE, ORDER, T.RANKS, select="""SELECT count(*) FILTER (b <= 10) AS pos_in_top10_before, count(*) FILTER (b > 10 AND b <= 100) AS pos_11_100_before, count(*) FILTER (b > 100) AS pos_after_top100_before,
  count(*) FILTER (strict <= 10) AS pos_in_top10_after, count(*) FILTER (strict <= 10 AND b > 10 AND b <= 100) AS rescued_11_100_to_top10, count(*) FILTER (strict > 10 AND b <= 10) AS dropped_top10
  FROM ranks JOIN (SELECT qid, before_rank AS b FROM done WHERE cand_idx = 0) USING (qid)"""))  # fmt: skip
def rescue_stats(spark, sf_dir):
    return X.rescue_stats(_rescued(spark, sf_dir))


@query("top10_payload", sql(RESCUE, ORDER, "tops AS (SELECT qid, cand, cand_idx, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cand_idx) AS rank FROM done)",
    select="SELECT qid, string_agg(rank || ':' || cand || CASE WHEN cand_idx = 0 THEN '*' ELSE '' END, ',' ORDER BY rank) AS top FROM tops WHERE rank <= 10 GROUP BY qid"))
def top10_payload(spark, sf_dir):
    text = lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), x["candidate_id"].cast("string"), F.when(x["is_positive"], "*").otherwise(""))
    return X.top_candidates(_rescued(spark, sf_dir)).select("qid", F.array_join(F.transform("top", text), ",").alias("top"))


#: All that a record holds, from one pass of windows over the placed candidates.
RECORDS = """finals AS MATERIALIZED (SELECT qid, cand_idx, cand, struct, time, rank_, CASE WHEN chosen THEN floor_ + 1 + (n - place + 1) / n ELSE struct END AS score FROM pl),
tops AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cand_idx) AS rank, max(CASE WHEN cand_idx = 0 THEN score END) OVER (PARTITION BY qid) AS own, max(CASE WHEN cand_idx = 0 THEN rank_ END) OVER (PARTITION BY qid) AS before_rank FROM finals),
counted AS (SELECT *, 1 + count(*) FILTER (cand_idx > 0 AND score >= own) OVER (PARTITION BY qid) AS strict, 1 + count(*) FILTER (cand_idx > 0 AND score > own) OVER (PARTITION BY qid) AS loose FROM tops)"""


@query("top10_records", sql(RESCUE, ORDER.partition(",\ndone AS")[0], RECORDS, select="""SELECT q.eid AS query_index, q.s, q.r, q.o, q.t AS t_norm, q.t AS t_orig, before_rank AS structure_rank_before, strict AS strict_rank, loose AS loose_rank, CAST(rank AS INTEGER) AS rank, cand AS candidate_id, cand_idx = 0 AS is_positive,
  round(score, 6) AS hybrid_score, round(time, 6) AS model_score, round(struct, 6) AS structure_score, round(time, 6) AS time_score FROM counted JOIN quads q ON q.eid = qid WHERE rank <= 10"""))  # fmt: skip
def top10_records(spark, sf_dir):
    """The payload's ten candidates, one row each; the time score stands for a model's."""
    done = _rescued(spark, sf_dir).withColumns({"pred": F.col("time"), "structure_raw": F.col("struct")})
    out = X.payload(done, T.events(spark, sf_dir).where("split = 'test'")).select("*", F.explode("top10").alias("top")).drop("top10").select("*", "top.*").drop("top")
    out = out.withColumns({c: F.round(c, 6) for c in ("hybrid_score", "model_score", "structure_score", "time_score")})
    return out.withColumns({c: F.col(c).cast("long") for c in ("structure_rank_before", "strict_rank", "loose_rank")})


def _minmax(c: str) -> str:
    return f"({c} - min({c}) OVER {W}) / greatest(max({c}) OVER {W} - min({c}) OVER {W}, 1e-12)"


def _z(c: str, floor: bool = False) -> str:
    return f"({c} - avg({c}) OVER {W}) / " + (f"sqrt(greatest(var_pop({c}) OVER {W}, 1e-12))" if floor else f"CASE WHEN var_pop({c}) OVER {W} <= 1e-12 THEN 1 ELSE sqrt(var_pop({c}) OVER {W}) END")


def _hybrid_select(firsts: bool) -> str:
    names = ("struct", "time", "base")
    out: dict[str, str] = {}
    for c in names:
        out |= {f"{c}_score": c, f"{c}_z": _z(c, firsts), f"{c}_minmax": _minmax(c), f"{c}_rank_log": f"ln(1 + {c}_rank)", f"{c}_rank_recip": f"1.0 / {c}_rank"}
    out |= {"struct_minus_time": "struct - time", "abs_struct_minus_time": "abs(struct - time)", "struct_times_time": "struct * time", "score_mean": "(struct + time) / 2", "score_max": "greatest(struct, time)", "score_min": "least(struct, time)"}
    out |= {"rank_min": "least(struct_rank, time_rank)", "rank_gap": "abs(struct_rank - time_rank)"}
    for k in (10, 50):
        out |= {f"both_top{k}": f"struct_rank <= {k} AND time_rank <= {k}", f"either_top{k}": f"struct_rank <= {k} OR time_rank <= {k}"}
    if firsts:
        out |= {f"{c}_top1": f"{c}_rank <= 1" for c in names}
    out |= {"relation_is_inverse": "r >= 2", "candidate_is_source": "cand = s"}
    return "SELECT qid, cand_idx, cand, " + ", ".join(f"round(CAST({e} AS DOUBLE), 5) + 0.0 AS {n}" for n, e in out.items()) + " FROM ranked_scores"


HYBRID = [f"based AS (SELECT *, 0.5 * ({_minmax('struct')} + {_minmax('time')}) AS base FROM both_scores)", f"ranked_scores AS (SELECT *, {', '.join(f'{_rank(c)} AS {c}_rank' for c in ('struct', 'time', 'base'))} FROM based)"]


@query("features_hybrid", sql(*HYBRID, select=_hybrid_select(True)))
def features_hybrid(spark, sf_dir):
    return R.rounded(X.hybrid_features(two_scores(spark, sf_dir), 5), 5)


@query("features_hybrid_plain", sql(*HYBRID, select=_hybrid_select(False)))
def features_hybrid_plain(spark, sf_dir):
    return R.rounded(X.hybrid_features(two_scores(spark, sf_dir), 5, firsts=False), 5)


def _mean(names) -> str:
    return f"(({' + '.join(names)}) / {len(names)})"


def _std(names) -> str:
    return f"sqrt(({' + '.join(f'({c} - {_mean(names)}) * ({c} - {_mean(names)})' for c in names)}) / {len(names)})"


_HISTORY = {X.HISTORY_NAMES.get(c, f"{c}_log1p"): f"ln(1 + {c})" for c in X.COUNTERS}


def _structure_select() -> str:
    out: dict[str, str] = {}
    for c in X.COMPONENTS:
        out |= {f"{c}_score": c, f"{c}_log1p": f"ln(1 + greatest({c}, 0))", f"{c}_max_norm": f"CASE WHEN max({c}) OVER {W} > 0 THEN {c} / max({c}) OVER {W} ELSE 0 END", f"{c}_z": _z(c), f"{c}_rank_log": f"ln(1 + {c}_rank)", f"{c}_rank_recip": f"1.0 / {c}_rank"}
    six = ["dsh", "dmh", "shared", "direct", "structure_raw", "b"]
    out |= {"dsh_minus_dmh": "dsh - dmh", "direct_minus_shared": "direct - shared", "structure_minus_b": "structure_raw - b", "dsh_times_dmh": "dsh * dmh", "direct_times_shared": "direct * shared", "structure_times_b": "structure_raw * b"}
    out |= {"component_mean": _mean(six), "component_max": f"greatest({', '.join(six)})", "component_std": _std(six), "b_count_log1p": "ln(1 + b_count)", "b_seen": "b_count > 0"}
    out |= _HISTORY | {"relation_is_inverse": "r >= 2", "candidate_is_source": "cand = s", "relation_id": "r", "source_id": "s", "candidate_id": "cand"}
    return "SELECT qid, cand_idx, cand, " + ", ".join(f"round(CAST({e} AS DOUBLE), 5) + 0.0 AS {n}" for n, e in out.items()) + " FROM ranked_comps"


@query("features_structure", T.sql(*ROWS, f"ranked_comps AS (SELECT *, {', '.join(f'{_rank(c)} AS {c}_rank' for c in X.COMPONENTS)} FROM rows)", select=_structure_select()))
def features_structure(spark, sf_dir):
    return R.rounded(X.structure_features(components(spark, sf_dir), 5), 5)


NINE = ("structure_raw", "time", "dsh", "dmh", "direct", "shared", "b", "base", "time_structure_base")


def _rescue_select() -> str:
    out: dict[str, str] = {}
    for c in NINE:
        out |= {f"{c}_score": c, f"{c}_z": _z(c), f"{c}_minmax": _minmax(c), f"{c}_rank_log": f"ln(1 + {c}_rank)", f"{c}_rank_recip": f"1.0 / {c}_rank"} | {f"{c}_top{k}": f"{c}_rank <= {k}" for k in (10, 50, 100)}
    out |= {f"{n}_minus_time": f"{c} - time" for n, c in {"structure": "structure_raw", "direct": "direct", "dsh": "dsh", "dmh": "dmh", "shared": "shared", "b": "b"}.items()}
    eight = list(NINE[:8])
    out |= {"abs_structure_minus_time": "abs(structure_raw - time)", "structure_times_time": "structure_raw * time", "direct_times_time": "direct * time", "component_mean": _mean(eight), "component_max": f"greatest({', '.join(eight)})", "component_min": f"least({', '.join(eight)})", "component_std": _std(eight)}
    out |= {"rank_min_structure_time": "least(structure_raw_rank, time_rank)", "rank_gap_structure_time": "abs(structure_raw_rank - time_rank)", "rank_gap_direct_time": "abs(direct_rank - time_rank)"}
    for k in (10, 50):
        out |= {f"structure_and_time_top{k}": f"structure_raw_rank <= {k} AND time_rank <= {k}", f"structure_or_time_top{k}": f"structure_raw_rank <= {k} OR time_rank <= {k}"}
    out |= {"b_count_log1p": "ln(1 + b_count)", "b_seen": "b_count > 0"} | _HISTORY | {"relation_is_inverse": "r >= 2", "candidate_is_source": "cand = s"}
    return "SELECT qid, cand_idx, cand, " + ", ".join(f"round(CAST({e} AS DOUBLE), 5) + 0.0 AS {n}" for n, e in out.items()) + " FROM ranked_comps"


@query("features_rescue", T.sql(*ROWS, f"tsb AS (SELECT *, round(0.5 * ({_minmax('structure_raw')} + {_minmax('time')}), {PLACES}) AS time_structure_base FROM rows)", f"ranked_comps AS (SELECT *, {', '.join(f'{_rank(c)} AS {c}_rank' for c in NINE)} FROM tsb)", select=_rescue_select()))
def features_rescue(spark, sf_dir):
    return R.rounded(X.rescue_features(components(spark, sf_dir), 5), 5)
