"""Relation matrices: similarity from facts of the same pair, transitions along chains, and their normalisations.

Range joins become equi-joins: a time falls into a bucket as long as the window, and a fact meets
the buckets that its window can reach. Facts are first counted by (s, r, o, t), so repeated facts are joined once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _counted(quads: DataFrame) -> DataFrame:
    return quads.groupBy("s", "r", "o", "t").agg(F.count("*").alias("n"))


def similarity_counts(quads: DataFrame, window: int, by_time: bool = False) -> DataFrame:
    """([t,] r_i, r_j, cnt): pairs of facts with the same (s, o) less than ``window`` apart, both ways.

    Facts of one snapshot pair once each; a pair within one relation adds 2 to the diagonal.
    """
    n = _counted(quads)
    old = n.select("s", "o", F.col("r").alias("r_old"), F.col("t").alias("t_old"), F.col("n").alias("n_old"), F.explode(F.array(F.floor(F.col("t") / window), F.floor(F.col("t") / window) + 1)).alias("bucket"))
    new = n.withColumn("bucket", F.floor(F.col("t") / window))
    both = new.join(old, ["s", "o", "bucket"]).where(F.col("t") - F.col("t_old") < window)
    earlier = both.where("t_old < t").select("t", F.col("r_old").alias("r_i"), F.col("r").alias("r_j"), (F.col("n") * F.col("n_old")).alias("c"))
    same = both.where("t_old = t AND r_old < r").select("t", F.col("r_old").alias("r_i"), F.col("r").alias("r_j"), (F.col("n") * F.col("n_old")).alias("c"))
    own = n.where("n > 1").select("t", F.col("r").alias("r_i"), F.col("r").alias("r_j"), F.expr("n * (n - 1) div 2").alias("c"))
    at = ["t"] if by_time else []
    one = earlier.unionByName(same).unionByName(own).groupBy(*at, "r_i", "r_j").agg(F.sum("c").alias("c"))
    two = one.unionByName(one.select(*at, F.col("r_j").alias("r_i"), F.col("r_i").alias("r_j"), "c"))
    return two.groupBy(*at, "r_i", "r_j").agg(F.sum("c").alias("cnt"))


def transition_counts(quads: DataFrame, window: int, decay: float, by_time: bool = False) -> DataFrame:
    """([t,] r_i, r_j, cnt): for facts (s, r_i, o, t), earlier facts (o, r_j, ., t') within the window, weighing exp(-decay (t - t'))."""
    n = _counted(quads)
    new = n.groupBy("o", "r", "t").agg(F.sum("n").alias("n")).withColumnRenamed("o", "node").withColumn("bucket", F.floor(F.col("t") / window))
    old = n.groupBy("s", "r", "t").agg(F.sum("n").alias("n_old")).select(F.col("s").alias("node"), F.col("r").alias("r_old"), F.col("t").alias("t_old"), "n_old", F.explode(F.array(F.floor(F.col("t") / window), F.floor(F.col("t") / window) + 1)).alias("bucket"))
    both = new.join(old, ["node", "bucket"]).where((F.col("t_old") < F.col("t")) & (F.col("t") - F.col("t_old") < window))
    return both.groupBy(*(["t"] if by_time else []), F.col("r").alias("r_i"), F.col("r_old").alias("r_j")).agg(F.sum(F.col("n") * F.col("n_old") * F.exp(F.lit(-float(decay)) * (F.col("t") - F.col("t_old")))).alias("cnt"))


def dense_grid(counts: DataFrame, num_rels: int) -> DataFrame:
    """All num_rels^2 cells, for each t if the counts have one; the grid is as large as the relation vocabulary squared."""
    if "t" in counts.columns:
        return counts
    grid = counts.sparkSession.range(num_rels * num_rels).select((F.col("id") / num_rels).cast("int").alias("r_i"), F.expr(f"CAST(id % {num_rels} AS INT)").alias("r_j"))
    return grid.join(counts.select(F.col("r_i").cast("int"), F.col("r_j").cast("int"), F.col("cnt").cast("double").alias("cnt")), ["r_i", "r_j"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0.0)))


def similarity_matrix(counts: DataFrame, num_rels: int, alpha: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """(r_i, r_j, val) in [0.5, 1]: smoothed pointwise mutual information through a sigmoid."""
    g = dense_grid(counts, num_rels).withColumn("c", F.col("cnt") + alpha)
    at = ["t"] if "t" in g.columns else []
    row, col, every = (F.sum("c").over(Window.partitionBy(*at, *k)) for k in (["r_i"], ["r_j"], []))
    lift = (F.col("c") / every) / ((row / every) * (col / every) + eps)
    return g.select(*at, "r_i", "r_j", (0.5 + 0.5 / (1.0 + F.exp(-F.log(lift + eps)))).alias("val"))


def transition_matrix(counts: DataFrame, num_rels: int) -> DataFrame:
    """(r_i, r_j, val): each row scaled to [0.2, 1] between its smallest and largest cell; a flat row is 0.2."""
    g = dense_grid(counts, num_rels)
    at = ["t"] if "t" in g.columns else []
    w = Window.partitionBy(*at, "r_i")
    low, high = F.min("cnt").over(w), F.max("cnt").over(w)
    return g.select(*at, "r_i", "r_j", F.when(high - low >= 1e-9, 0.2 + 0.8 * (F.col("cnt") - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.lit(0.2)).alias("val"))


def matrices_by_time(counts: DataFrame, times: list[int], num_rels: int, matrix, strictly: bool) -> DataFrame:
    """(t, r_i, r_j, val) for each time: the matrix of all counts before it (``strictly``) or up to it; ``counts`` has a t."""
    spark = counts.sparkSession
    grid = spark.createDataFrame([(t,) for t in times], "t long")
    cells = spark.range(num_rels * num_rels).select((F.col("id") / num_rels).cast("int").alias("r_i"), F.expr(f"CAST(id % {num_rels} AS INT)").alias("r_j"))
    own = counts.select("t", F.col("r_i").cast("int"), F.col("r_j").cast("int"), F.col("cnt").cast("double").alias("cnt"))
    full = grid.crossJoin(cells).join(own, ["t", "r_i", "r_j"], "left")  # snapshots times relations squared
    w = Window.partitionBy("r_i", "r_j").orderBy("t").rowsBetween(Window.unboundedPreceding, -1 if strictly else 0)
    return matrix(full.select("t", "r_i", "r_j", F.coalesce(F.sum("cnt").over(w), F.lit(0.0)).alias("cnt")), num_rels)
