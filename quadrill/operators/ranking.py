"""Ranks of the true target under three tie policies, metrics, and window functions per query.

Score tables are long: (qid, cand_idx, cand, score) with index 0 for the true target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HITS = (1, 3, 5, 10, 20, 50, 100)
POLICIES = {"loose": "loose", "strict": "strict", "average": "(loose + strict) / 2.0"}


def per_query() -> Window:
    return Window.partitionBy("qid")


def positive_ranks(scores: DataFrame, score: str = "score") -> DataFrame:
    """(qid, loose, strict, average): ties below, above, and between. A query's candidates are brought together once."""
    own = F.max(F.when(F.col("cand_idx") == 0, F.col(score))).over(per_query())
    seen = scores.select("qid", "cand_idx", F.col(score).alias("x"), own.alias("own"))
    neg = F.col("cand_idx") > 0
    out = seen.groupBy("qid").agg((1 + F.count_if(neg & (F.col("x") > F.col("own")))).alias("loose"), (1 + F.count_if(neg & (F.col("x") >= F.col("own")))).alias("strict"))
    return out.withColumn("average", (F.col("loose") + F.col("strict")) / 2.0)


def list_ranks(lists: DataFrame, scores: str = "scores") -> DataFrame:
    """``positive_ranks`` of arrays of scores, the true target's first; one row for each list."""
    own, rest = F.get(scores, F.lit(0)), F.slice(scores, 2, F.greatest(F.size(scores) - 1, F.lit(0)))
    above = lambda beats: (1 + F.size(F.filter(rest, beats))).cast("long")
    out = lists.select("qid", above(lambda x: x > own).alias("loose"), above(lambda x: x >= own).alias("strict"))
    return out.withColumn("average", (F.col("loose") + F.col("strict")) / 2.0)


def metrics(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Queries, mean reciprocal rank and Hit@k of each policy; sums are pre-aggregated. No query gives zeros."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    aggs = [F.count("*").alias("queries")]
    aggs += [zero(F.avg(1.0 / F.col(n))).alias(f"mrr_{n}") for n in POLICIES]
    aggs += [zero(F.avg((F.col(n) <= k).cast("double"))).alias(f"hit{k}_{n}") for n in POLICIES for k in HITS]
    return (ranks.groupBy(*by) if by else ranks.groupBy()).agg(*aggs)


def group_metrics(scores: DataFrame, score: str = "score") -> DataFrame:
    """Metrics over queries with more than one candidate."""
    many = scores.withColumn("n_", F.count("*").over(per_query())).where("n_ > 1").drop("n_")
    return metrics(positive_ranks(many, score))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def ordinal_rank(score: Column | str) -> Column:
    """1, 2, ... by descending score; ties go to the smaller index, so to the true target first."""
    return F.row_number().over(per_query().orderBy(F.desc(score), "cand_idx"))


def fair_rank(score: Column | str) -> Column:
    """1, 2, ... by descending score; ties go by a hash of query and candidate, so the true target has no place of its own among them."""
    return F.row_number().over(per_query().orderBy(F.desc(score), F.xxhash64("qid", "cand"), "cand"))


def max_norm(x: Column | str) -> Column:
    """x over the query's largest value; 0 where that isn't positive."""
    c = F.col(x) if isinstance(x, str) else x
    top = F.greatest(F.max(c).over(per_query()), F.lit(0.0))
    return F.when(top > 0, c / F.nullif(top, F.lit(0.0))).otherwise(0.0)


def z_score(x: Column | str, floor_std: bool = False) -> Column:
    """Population z-score. A variance up to 1e-12 gives a deviation of 1, or of 1e-6 with ``floor_std``."""
    c = F.col(x) if isinstance(x, str) else x
    mean, var = F.avg(c).over(per_query()), F.var_pop(c).over(per_query())
    std = F.sqrt(F.greatest(var, F.lit(1e-12))) if floor_std else F.when(var <= 1e-12, 1.0).otherwise(F.sqrt(var))
    return (c - mean) / std


def min_max(x: Column | str) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    low, high = F.min(c).over(per_query()), F.max(c).over(per_query())
    return (c - low) / F.greatest(high - low, F.lit(1e-12))


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != float("inf"))


def sanitized(x: Column | str) -> Column:
    """Infinite and undefined scores just outside the query's finite ones: above by their span for +inf, below otherwise; +1 and -1 where none is finite."""
    c = F.col(x) if isinstance(x, str) else x
    good = F.when(finite(c), c)
    low, high = F.min(good).over(per_query()), F.max(good).over(per_query())
    span = F.greatest(high - low, F.lit(1.0))
    return F.when(finite(c), c).when(c == float("inf"), F.coalesce(high + span, F.lit(1.0))).otherwise(F.coalesce(low - span, F.lit(-1.0)))


def non_finite(scores: DataFrame, cols: list[str]) -> DataFrame:
    """Count of undefined or infinite values of each column."""
    return scores.agg(*(F.count_if(~finite(F.col(c))).alias(c) for c in cols))


def row_mean(cols: list[str]) -> Column:
    return sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols)


def row_std(cols: list[str]) -> Column:
    mean = row_mean(cols)
    return F.sqrt(sum(((F.col(c) - mean) * (F.col(c) - mean) for c in cols[1:]), (F.col(cols[0]) - mean) * (F.col(cols[0]) - mean)) / len(cols))
