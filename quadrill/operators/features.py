"""Feature tables for re-rankers, and the selections that decide which candidates are learnt from or re-ranked.

Inputs are long candidate tables (qid, s, r, cand_idx, cand) with one column for each component score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrill.operators import ranking as R

#: Component scores of the structure model, counters, and the names of three counters among the features.
COMPONENTS = ("dsh", "dmh", "shared", "direct", "structure_raw", "b", "base")
COUNTERS = ("tail_count", "incident_count", "rel_tail_count", "source_count", "rel_count", "source_rel", "exact_sro", "source_tail")
HISTORY_NAMES = dict(zip(("source_rel", "exact_sro", "source_tail"), ("source_rel_log1p", "exact_sro_log1p", "source_tail_log1p"), strict=True))


def combined(w: float, gamma: float = 0.0, dsh: str = "dsh", dmh: str = "dmh", shared: str = "shared") -> Column:
    """w * dsh + (1 - w) * dmh + gamma * shared; parts of weight 0 aren't read at all."""
    direct = F.col(dsh) if w == 1 else F.col(dmh) if w == 0 else w * F.col(dsh) + (1 - w) * F.col(dmh)
    return direct if abs(gamma) <= 1e-12 else direct + gamma * F.col(shared)


def structure_base() -> Column:
    """Mean of the max-normalised dsh, dmh, shared and b."""
    return sum((R.max_norm(c) for c in ("dmh", "shared", "b")), R.max_norm("dsh")) / 4.0


def hybrid_base(a: str = "struct", b: str = "time") -> Column:
    """Mean of two min-max scaled scores."""
    return (R.min_max(a) + R.min_max(b)) * 0.5


def linear_combo(a: DataFrame, b: DataFrame, w: float) -> DataFrame:
    """Two score stores over the candidates that both have: w * a + (1 - w) * b."""
    both = a.select("qid", "cand_idx", "cand", F.col("score").alias("a_")).join(b.select("qid", "cand_idx", F.col("score").alias("b_")), ["qid", "cand_idx"])
    return both.select("qid", "cand_idx", "cand", (w * F.col("a_") + (1 - w) * F.col("b_")).alias("score"))


def flag(c: Column) -> Column:
    return c.cast("double")


def _ranked(df: DataFrame, names: list[str], fair: bool = False) -> DataFrame:
    """Add each score's rank (``fair``: ties by hash, not by index), and its extremes, mean and variance over the query: one window for all of these."""
    w = R.per_query()
    stats = {f"{n}_{k}_": f(n).over(w) for n in names for k, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("var", F.var_pop))}
    return df.withColumns(stats).withColumns({f"{n}_rank": R.fair_rank(n) if fair else R.ordinal_rank(n) for n in names})


def _min_max(c: str) -> Column:
    return (F.col(c) - F.col(f"{c}_min_")) / F.greatest(F.col(f"{c}_max_") - F.col(f"{c}_min_"), F.lit(1e-12))


def _max_norm(c: str) -> Column:
    top = F.greatest(F.col(f"{c}_max_"), F.lit(0.0))
    return F.when(top > 0, F.col(c) / F.nullif(top, F.lit(0.0))).otherwise(0.0)


def _z(c: str, floor_std: bool = False) -> Column:
    var = F.col(f"{c}_var_")
    std = F.sqrt(F.greatest(var, F.lit(1e-12))) if floor_std else F.when(var <= 1e-12, 1.0).otherwise(F.sqrt(var))
    return (F.col(c) - F.col(f"{c}_avg_")) / std


def _context(num_rels: int) -> dict[str, Column]:
    return {"relation_is_inverse": flag(F.col("r") >= num_rels // 2), "candidate_is_source": flag(F.col("cand") == F.col("s"))}


def _history() -> dict[str, Column]:
    return {HISTORY_NAMES.get(c, f"{c}_log1p"): F.log1p(F.greatest(F.col(c), F.lit(0))) for c in COUNTERS}


KEY = ("qid", "cand_idx", "cand")


def _spread(names: list[str]) -> Column:
    """Population deviation of several columns about ``mean_``."""
    off = [F.col(c) - F.col("mean_") for c in names]
    return F.sqrt(sum((x * x for x in off[1:]), off[0] * off[0]) / len(names))


def structure_features(df: DataFrame, num_rels: int) -> DataFrame:
    """66 columns: six of each component, their combinations, counters, and three ids."""
    six = ["dsh", "dmh", "shared", "direct", "structure_raw", "b"]
    df = _ranked(df, list(COMPONENTS)).withColumn("mean_", R.row_mean(six))
    out: dict[str, Column] = {}
    for c in COMPONENTS:
        rank = F.col(f"{c}_rank")
        out |= {f"{c}_score": F.col(c), f"{c}_log1p": F.log1p(F.greatest(F.col(c), F.lit(0.0))), f"{c}_max_norm": _max_norm(c), f"{c}_z": _z(c), f"{c}_rank_log": F.log1p(rank), f"{c}_rank_recip": 1.0 / rank}
    out |= {
        "dsh_minus_dmh": F.col("dsh") - F.col("dmh"), "direct_minus_shared": F.col("direct") - F.col("shared"), "structure_minus_b": F.col("structure_raw") - F.col("b"),
        "dsh_times_dmh": F.col("dsh") * F.col("dmh"), "direct_times_shared": F.col("direct") * F.col("shared"), "structure_times_b": F.col("structure_raw") * F.col("b"),
        "component_mean": F.col("mean_"), "component_max": F.greatest(*six), "component_std": _spread(six),
        "b_count_log1p": F.log1p("b_count"), "b_seen": flag(F.col("b_count") > 0),
    }
    out |= _history() | _context(num_rels) | {"relation_id": F.col("r").cast("double"), "source_id": F.col("s").cast("double"), "candidate_id": F.col("cand").cast("double")}
    return df.select(*KEY, *(c.alias(n) for n, c in out.items()))


def hybrid_features(df: DataFrame, num_rels: int, firsts: bool = True, fair: bool = False) -> DataFrame:
    """32 columns of structure, time and base scores; 29 without ``firsts``, the flags of first places. A ranker learns from ``fair`` ranks only."""
    names = ["struct", "time", "base"]
    df = _ranked(df.withColumn("base", hybrid_base()), names, fair)
    out: dict[str, Column] = {}
    for c in names:
        rank = F.col(f"{c}_rank")
        out |= {f"{c}_score": F.col(c), f"{c}_z": _z(c, firsts), f"{c}_minmax": _min_max(c), f"{c}_rank_log": F.log1p(rank), f"{c}_rank_recip": 1.0 / rank}
    s, t, sr, tr = F.col("struct"), F.col("time"), F.col("struct_rank"), F.col("time_rank")
    out |= {"struct_minus_time": s - t, "abs_struct_minus_time": F.abs(s - t), "struct_times_time": s * t, "score_mean": (s + t) * 0.5, "score_max": F.greatest(s, t), "score_min": F.least(s, t)}
    out |= {"rank_min": F.least(sr, tr).cast("double"), "rank_gap": F.abs(sr - tr).cast("double")}
    for k in (10, 50):
        out |= {f"both_top{k}": flag((sr <= k) & (tr <= k)), f"either_top{k}": flag((sr <= k) | (tr <= k))}
    if firsts:
        out |= {f"{c}_top1": flag(F.col(f"{c}_rank") <= 1) for c in names}
    out |= _context(num_rels)
    return df.select(*KEY, *(c.alias(n) for n, c in out.items()))


def rescue_features(df: DataFrame, num_rels: int, fair: bool = False) -> DataFrame:
    """104 columns: eight of each of nine score families, and 32 of their combinations and counters."""
    names = ["structure_raw", "time", "dsh", "dmh", "direct", "shared", "b", "base", "time_structure_base"]
    eight = ["structure_raw", "time", "dsh", "dmh", "direct", "shared", "b", "base"]
    df = _ranked(df.withColumn("time_structure_base", F.round(hybrid_base("structure_raw", "time"), 9)), names, fair).withColumn("mean_", R.row_mean(eight))
    out: dict[str, Column] = {}
    for c in names:
        rank = F.col(f"{c}_rank")
        out |= {f"{c}_score": F.col(c), f"{c}_z": _z(c), f"{c}_minmax": _min_max(c), f"{c}_rank_log": F.log1p(rank), f"{c}_rank_recip": 1.0 / rank}
        out |= {f"{c}_top{k}": flag(rank <= k) for k in (10, 50, 100)}
    t = F.col("time")
    out |= {f"{n}_minus_time": F.col(c) - t for n, c in {"structure": "structure_raw", "direct": "direct", "dsh": "dsh", "dmh": "dmh", "shared": "shared", "b": "b"}.items()}
    sr, tr, dr = (F.col(f"{c}_rank") for c in ("structure_raw", "time", "direct"))
    out |= {
        "abs_structure_minus_time": F.abs(F.col("structure_raw") - t), "structure_times_time": F.col("structure_raw") * t, "direct_times_time": F.col("direct") * t,
        "component_mean": F.col("mean_"), "component_max": F.greatest(*eight), "component_min": F.least(*eight), "component_std": _spread(eight),
        "rank_min_structure_time": F.least(sr, tr).cast("double"), "rank_gap_structure_time": F.abs(sr - tr).cast("double"), "rank_gap_direct_time": F.abs(dr - tr).cast("double"),
    }
    for k in (10, 50):
        out |= {f"structure_and_time_top{k}": flag((sr <= k) & (tr <= k)), f"structure_or_time_top{k}": flag((sr <= k) | (tr <= k))}
    out |= {"b_count_log1p": F.log1p("b_count"), "b_seen": flag(F.col("b_count") > 0)} | _history() | _context(num_rels)
    return df.select(*KEY, *(c.alias(n) for n, c in out.items()))


def top_direct(df: DataFrame, n: int, direct: str = "direct") -> DataFrame:
    """``in_top``: whether the candidate is among the query's n best by direct score; -1 for all."""
    if n == 0 or n < -1:
        raise ValueError("n must be positive, or -1 for all candidates")
    return df.withColumn("in_top", F.lit(True) if n == -1 else R.ordinal_rank(direct) <= n)


def training_rows(df: DataFrame, names: list[str], topk: int) -> DataFrame:
    """The true target and candidates ranked up to topk + 1 by any of the scores; queries with one row left are dropped. topk < 0 keeps all."""
    if topk >= 0:
        best = [R.ordinal_rank(n) for n in names]
        df = df.withColumn("best_", F.least(*best) if len(best) > 1 else best[0]).where((F.col("best_") <= topk + 1) | (F.col("cand_idx") == 0)).drop("best_")
    return df.withColumn("n_", F.count("*").over(R.per_query())).where("n_ > 1").drop("n_")


def one_positive(df: DataFrame) -> DataFrame:
    """Queries that don't have exactly one true target."""
    return df.groupBy("qid").agg(F.count_if(F.col("cand_idx") == 0).alias("positives")).where("positives <> 1")


def rescue_rows(df: DataFrame, topk: int, low: int = 1, high: int = 100, include_top10: bool = True, stride: int = 1, most: int = 0, score: str = "structure_raw", fair: bool = False) -> DataFrame:
    """Candidates of the topk of queries whose true target is in reach; every ``stride``-th query, ``most`` at most (0: all). ``fair``: ties go by hash, not by index.

    Queries are numbered in blocks of ids, so no window runs over all of them.
    """
    ranked = df.withColumn("rank_", R.fair_rank(score) if fair else R.ordinal_rank(score))
    own = F.max(F.when(F.col("cand_idx") == 0, F.col("rank_"))).over(R.per_query())
    chosen = ranked.withColumn("own_", own).where(F.col("rank_") <= topk).where((F.col("own_") <= min(high, topk)) & (F.lit(include_top10) | (F.col("own_") >= low)))
    chosen = chosen.withColumn("n_", F.count("*").over(R.per_query())).where("n_ > 1")
    if stride > 1 or most:
        queries = chosen.select("qid").distinct().withColumn("block_", F.floor(F.col("qid") / 100_000))
        ahead = queries.groupBy("block_").agg(F.count("*").alias("c_")).withColumn("ahead_", F.coalesce(F.sum("c_").over(Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        place = queries.withColumn("in_", F.row_number().over(Window.partitionBy("block_").orderBy("qid"))).join(ahead, "block_")
        place = place.select("qid", (F.col("ahead_") + F.col("in_") - 1).alias("place_")).where(F.col("place_") % stride == 0)
        chosen = chosen.join(place.where((F.col("place_") / stride).cast("long") < most) if most else place, "qid").drop("place_")
    return chosen.withColumn("structure_rank", F.col("rank_")).drop("rank_", "own_", "n_")


def rescued(df: DataFrame, topk: int, pred: str = "pred", score: str = "structure_raw", fair: bool = False) -> DataFrame:
    """``final``: the topk by structure score stand above all others, among each other by the model's score, then raw score, then place (``fair``: then a hash)."""
    df = df.withColumn("rank_", R.fair_rank(score) if fair else R.ordinal_rank(score)).withColumn("chosen_", F.col("rank_") <= topk)
    floor = F.coalesce(F.max(F.when(~F.col("chosen_"), F.col(score))).over(R.per_query()), F.lit(0.0))
    n = F.count_if(F.col("chosen_")).over(R.per_query())
    place = F.row_number().over(Window.partitionBy("qid", "chosen_").orderBy(F.desc(pred), F.desc(score), *([F.xxhash64("qid", "cand")] if fair else []), "cand_idx"))
    out = df.withColumns({"floor_": floor, "n_": n, "place_": place})
    final = F.when(F.col("chosen_"), F.col("floor_") + 1.0 + (F.col("n_") - F.col("place_") + 1) / F.col("n_")).otherwise(F.col(score))
    return out.withColumns({"final": final, "before_rank": F.col("rank_")}).drop("rank_", "chosen_", "floor_", "n_", "place_")


def rescue_stats(done: DataFrame, topk: int = 100) -> DataFrame:
    """How many true targets were where before and after: six counters, whose names are fixed values."""
    before = done.where("cand_idx = 0").select("qid", "before_rank")
    both = R.positive_ranks(done, "final").select("qid", "strict").join(before, "qid")
    b, a = F.col("before_rank"), F.col("strict")
    return both.agg(
        F.count_if(b <= 10).alias("pos_in_top10_before"), F.count_if((b > 10) & (b <= topk)).alias("pos_11_100_before"), F.count_if(b > topk).alias("pos_after_top100_before"),
        F.count_if(a <= 10).alias("pos_in_top10_after"), F.count_if((a <= 10) & (b > 10) & (b <= topk)).alias("rescued_11_100_to_top10"), F.count_if((a > 10) & (b <= 10)).alias("dropped_top10"),
    )


def top_candidates(done: DataFrame, k: int = 10, by: str = "final", carry: tuple[str, ...] = ()) -> DataFrame:
    """(qid, top): the k best candidates as an array of (rank, candidate_id, is_positive, score, carried scores)."""
    ranked = done.withColumn("rank_", R.ordinal_rank(by)).where(F.col("rank_") <= k)
    one = F.struct(F.col("rank_").alias("rank"), F.col("cand").alias("candidate_id"), (F.col("cand_idx") == 0).alias("is_positive"), F.col(by).alias("score"), *carry)
    return ranked.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("top"))


def payload(done: DataFrame, queries: DataFrame, k: int = 10, scores: dict[str, str] | None = None) -> DataFrame:
    """One row for each query: its fact and times, the true target's rank before and its strict and loose rank after, and the k best candidates with their scores.

    ``scores`` names the score columns of ``done`` that are carried along, under the names they get.
    """
    named = scores or {"hybrid_score": "final", "model_score": "pred", "structure_score": "structure_raw", "time_score": "time"}
    ranked = done.withColumn("rank_", R.ordinal_rank("final")).where(F.col("rank_") <= k)
    one = F.struct(F.col("rank_").alias("rank"), F.col("cand").alias("candidate_id"), (F.col("cand_idx") == 0).alias("is_positive"), *(F.col(c).alias(n) for n, c in named.items()))
    best = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias(f"top{k}"))
    before = done.where("cand_idx = 0").select("qid", F.col("before_rank").alias("structure_rank_before"))
    after = R.positive_ranks(done, "final").select("qid", F.col("strict").alias("strict_rank"), F.col("loose").alias("loose_rank"))
    facts = queries.select(F.col("eid").alias("qid"), "s", "r", "o", F.col("t").alias("t_norm"), (F.col("t_orig") if "t_orig" in queries.columns else F.col("t")).alias("t_orig"))
    return facts.join(before, "qid").join(after, "qid").join(best, "qid").withColumnRenamed("qid", "query_index")
