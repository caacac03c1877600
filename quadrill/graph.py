"""The quad table: facts (eid, s, r, o, t, split), its metadata and its transformations.

Snapshots are the rows of one time; nothing is grouped into objects. Times are integers.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrill.operators.ppr import stored

QUAD = ["eid", "s", "r", "o", "t", "split"]


@dataclass(frozen=True)
class TemporalGraph:
    """Facts and metadata; ``first_dst`` and ``last_dst`` bound the ids that may be targets."""

    quads: DataFrame
    num_nodes: int
    num_rels_raw: int
    num_rels: int
    first_dst: int
    last_dst: int

    @property
    def num_dst(self) -> int:
        return self.last_dst - self.first_dst + 1

    def with_quads(self, quads: DataFrame, **more) -> TemporalGraph:
        return replace(self, quads=quads, **more)


def bounds(quads: DataFrame) -> tuple[int, int, int]:
    """(largest node, largest relation, largest target), one row whatever the input."""
    r = quads.agg(F.max(F.greatest("s", "o")), F.max("r"), F.max("o")).first()
    return int(r[0] if r[0] is not None else -1), int(r[1] if r[1] is not None else -1), int(r[2] if r[2] is not None else -1)


def graph_of(quads: DataFrame, first_dst: int = 0, last_dst: int | None = None) -> TemporalGraph:
    node, rel, target = bounds(quads)
    return TemporalGraph(quads, node + 1, rel + 1, rel + 1, first_dst, target if last_dst is None else last_dst)


def split_by_time(t: Column, val_from: int, test_from: int) -> Column:
    return F.when(t < val_from, "train").when(t < test_from, "val").otherwise("test")


def coded(df: DataFrame, name: str, code: str) -> DataFrame:
    """Add a dense integer code of a dictionary column; the dictionary is as large as its distinct values.

    It is written once, so Spark knows its size and sends it to the rows, where it is small, instead of dealing all rows by their words.
    """
    words = df.select(name).distinct().withColumn(code, (F.row_number().over(Window.orderBy(name)) - 1).cast("int"))
    return df.join(stored(words), name)


def from_events(spark: SparkSession, sf_dir: str, val_from: int = 20, test_from: int = 25) -> DataFrame:
    """Quads of the events table: user, event type, key of the properties, day since 2024-01-01."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts", "props")
    o = F.get_json_object("props", "$.k").cast("long")
    t = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    out = coded(e, "event_type", "r").select(F.col("event_id").alias("eid"), F.col("user_id").alias("s"), "r", o.alias("o"), t.alias("t"))
    return out.withColumn("split", split_by_time(F.col("t"), val_from, test_from))


def from_orders(spark: SparkSession, sf_dir: str, val_from: int = 60, test_from: int = 66) -> DataFrame:
    """Heterogeneous quads: customer, order priority, supplier (ids after the customers'), month of the order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey")
    users = orders.agg(F.max("o_custkey").alias("last_user"))
    t = ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1).cast("long")
    out = coded(orders, "o_orderpriority", "r").join(items, F.col("o_orderkey") == F.col("l_orderkey")).crossJoin(F.broadcast(users))  # one row
    out = out.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("eid"), F.col("o_custkey").alias("s"), "r", (F.col("l_suppkey") + F.col("last_user") + 1).alias("o"), t.alias("t"))
    return out.withColumn("split", split_by_time(F.col("t"), val_from, test_from))


def inverse_augment(quads: DataFrame, num_rels_raw: int) -> DataFrame:
    """Facts and their inverses (o, r + num_rels_raw, s); ``inverse`` tells them apart within an eid."""
    inv = quads.select("eid", F.col("o").alias("s"), (F.col("r") + num_rels_raw).cast("int").alias("r"), F.col("s").alias("o"), *[c for c in quads.columns if c not in ("eid", "s", "r", "o")], F.lit(1).alias("inverse"))
    return quads.withColumn("inverse", F.lit(0)).unionByName(inv)


def inverse_relation(r: Column, num_rels: int) -> Column:
    """The relation of the inverse fact: half of the relations away."""
    return F.pmod(r + num_rels // 2, F.lit(num_rels))


def ordinal_time(quads: DataFrame, col: str = "t") -> DataFrame:
    """``t_norm``: place among all distinct times. The window runs over distinct times only."""
    times = quads.select(col).distinct().withColumn("t_norm", (F.row_number().over(Window.orderBy(col)) - 1).cast("long"))
    return quads.join(times, col)


def time_step(quads: DataFrame, col: str = "t", coarse: float | None = None) -> float:
    """Spacing of distinct times: their smallest difference if all are equal, else ``coarse``, else the mean; 0 for one time."""
    times = quads.select(col).distinct()
    d = times.select((F.col(col) - F.lag(col).over(Window.orderBy(col))).alias("d")).agg(F.min("d"), F.max("d"), F.avg("d")).first()
    if d[0] is None:
        return 0.0
    return float(d[0]) if d[0] == d[1] else float(coarse if coarse is not None else d[2])


def step_time(quads: DataFrame, col: str = "t", coarse: float | None = None) -> DataFrame:
    """``t_norm`` = ceil((t - first) / step)."""
    step = time_step(quads, col, coarse)
    first = quads.agg(F.min(col).alias("first_"))
    value = F.lit(0) if not step else F.ceil((F.col(col) - F.col("first_")) / F.lit(step))
    return quads.crossJoin(F.broadcast(first)).withColumn("t_norm", value.cast("long")).drop("first_")  # one row


def last_snapshots(quads: DataFrame, ratio: float, col: str = "t") -> DataFrame:
    """Rows of the last int(n * ratio) snapshots."""
    times = quads.select(col).distinct()
    ranked = times.select(col, F.row_number().over(Window.orderBy(F.desc(col))).alias("back"), F.count("*").over(Window.partitionBy()).alias("n"))
    return quads.join(ranked.where(F.col("back") <= F.floor(F.col("n") * ratio)).select(col), col, "left_semi")


def suffix_with(quads: DataFrame, limit: int | None = None, fraction: float | None = None, col: str = "t") -> DataFrame:
    """Rows of the fewest last snapshots that hold at least ``limit`` events (or that fraction of all)."""
    sizes = quads.groupBy(col).agg(F.count("*").alias("n"))
    after = F.coalesce(F.sum("n").over(Window.orderBy(F.desc(col)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    most = F.lit(limit) if limit is not None else F.ceil(total * F.lit(fraction))
    kept = sizes.select(col, after.alias("after"), most.alias("most")).where("after < most")
    return quads.join(kept.select(col), col, "left_semi")


def snapshot_stats(quads: DataFrame) -> DataFrame:
    """For each split: snapshots, events, largest ids, first and last time."""
    return quads.groupBy("split").agg(
        F.countDistinct("t").alias("snapshots"), F.count("*").alias("events"), F.max(F.greatest("s", "o")).alias("max_node"), F.max("r").alias("max_rel"),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"),
    )


def val_tail(queries: DataFrame, fraction: float, qid: str = "qid", block: int = 100_000) -> DataFrame:
    """Queries from place int(total * (1 - fraction)) on, in the order of their ids.

    The place is found by counts of blocks of ids; only the ids of the block that it falls into are sorted.
    """
    sizes = queries.groupBy(F.floor(F.col(qid) / block).alias("block_")).agg(F.count("*").alias("n_"))
    ahead = F.coalesce(F.sum("n_").over(Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n_").over(Window.partitionBy())
    skip = F.floor(total * F.lit(1 - fraction))
    found = sizes.select("block_", "n_", ahead.alias("ahead_"), skip.alias("skip_")).where("ahead_ <= skip_ AND skip_ < ahead_ + n_").first()
    if found is None:
        return queries.limit(0)
    first = queries.where(F.floor(F.col(qid) / block) == found["block_"]).select(qid).orderBy(qid).offset(int(found["skip_"] - found["ahead_"])).limit(1).first()[0]
    return queries.where(F.col(qid) >= F.lit(first))
