"""Mixing sources to target weights by hierarchical budgeting.

Leaves of a domain-language-source tree have a supply: their tokens times the epochs allowed. A token budget runs
down the tree in proportion to weights; what a node can't spend for want of supply goes to its siblings in proportion
to theirs, and only what a whole family can't spend goes up to the siblings of its parent. A node of weight 0 spends
nothing, so its supply counts nowhere above it. Each leaf then takes the prefix of its budget from seeded epochs: in
every epoch its documents stand in the order of a seeded hash of their ids (ties: id, then the text's digest).

A document belongs to the prefix if the tokens before it are fewer than the budget. The tree is a table and is worked out level
by level with one sort of each family's children, so it may have any number of leaves. Texts are tokenised into
a slim table (path, id, digest, tokens) first; leaves are cut into buckets of the hash there, so the running sums need one
window over bucket totals and one inside the bucket in which a leaf's budget ends, whatever the leaf's size. What
reaches the texts again is one row for each leaf: how many epochs it takes whole, and the last document of the next.

Null keys are nodes of their own; null and empty texts have no token and are never taken; rows of one id and text stand
together and are all taken or all left; other rows of one id are documents of their own. Null ids stand as empty ones.
Nodes without a weight weigh 1. Texts of any length are counted whole. An empty table gives no rows. Columns of
the input named like an output column (``mix_leaf``, ``mix_epoch``, ``mix_tokens``) are replaced; names that end in _ and start
with ``mix_`` are used inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrill.llm.common import table, written

#: Documents that a bucket of a leaf holds on average.
BUCKET = 2000
#: Leaves (some 100 bytes each) up to which budgets are broadcast; beyond, they are joined, with ``SALTS`` copies of each.
MOST_BROADCAST, SALTS = 200_000, 16
#: Bits of the place of a document in its epoch.
PLACES = 40
_NULL = "\x00null"


def words(text: Column) -> Column:
    """Tokens of a text: runs of anything but white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def place_of(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The seeded place of a document in an epoch, from 0 to 2^40."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(h, 1, PLACES // 4), 16, 10).cast("long")


def weight_of(weights: dict[tuple, float], levels: list[str]) -> Column:
    """The weight of the node that the levels name: a parameter's entry, 1 if there is none; negative ones count as 0."""
    named = {k: max(float(v), 0.0) for k, v in weights.items() if len(k) == len(levels)}
    if not named:
        return F.lit(1.0)
    entries = [x for k, v in named.items() for x in (F.lit("\x1f".join(_NULL if p is None else str(p) for p in k)), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*entries), F.concat_ws("\x1f", *levels)), F.lit(1.0))


def allocate(supply: DataFrame, levels: list[str], weights: dict[tuple, float], budget: float) -> DataFrame:
    """``supply`` (levels..., supply) with ``quota``: the budget of each leaf.

    Children that their share would more than fill are those with the least supply for their weight, so one sort of a family and
    its running sums show where the others' common level lies.
    """
    trees = [supply.select(*levels, F.col("supply").cast("double").alias("c_"), weight_of(weights, levels).alias("w_"))]
    for d in range(len(levels) - 1, 0, -1):
        up = trees[0].where("w_ > 0").groupBy(*levels[:d]).agg(F.sum("c_").alias("c_"))
        trees.insert(0, up.withColumn("w_", weight_of(weights, levels[:d])))
    amounts = None
    for d, nodes in enumerate(trees, 1):
        nodes = nodes.where("w_ > 0")
        parent = levels[: d - 1]
        given = nodes.withColumn("x_", F.lit(float(budget))) if amounts is None else nodes.join(amounts.withColumnRenamed("quota", "x_"), parent)
        family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        order = family.orderBy(F.col("c_") / F.col("w_"), levels[d - 1])
        filled = F.coalesce(F.sum("c_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        mass = F.sum("w_").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        given = given.withColumn("level_", F.greatest(F.col("x_") - filled, F.lit(0.0)) / mass)
        common = F.min(F.when(F.col("level_") * F.col("w_") < F.col("c_"), F.struct((F.col("c_") / F.col("w_")).alias("at"), levels[d - 1], F.col("level_").alias("level")))).over(family)
        given = given.withColumn("common_", common["level"])
        amounts = given.select(*levels[:d], F.when(F.col("common_").isNull(), F.col("c_")).otherwise(F.least("c_", F.col("common_") * F.col("w_"))).alias("quota"))
    out = supply.join(amounts, levels, "left")
    return out.withColumn("quota", F.round(F.coalesce("quota", F.lit(0.0)), 3))


def mix(
    docs: DataFrame,
    path: list[Column],
    weights: dict[tuple, float] | None = None,
    share: float = 0.5,
    budget: float | None = None,
    epochs: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents taken, once for each epoch, with ``mix_leaf``, ``mix_epoch`` (from 1) and ``mix_tokens``.

    ``budget`` is in tokens, by default ``share`` of all.
    """
    levels = [f"mix_level{i}_" for i in range(len(path))]
    docs = docs.drop("mix_leaf", "mix_epoch", "mix_tokens")
    keys = [F.coalesce(c.cast("string"), F.lit(_NULL)).alias(n) for c, n in zip(path, levels, strict=True)]
    own = [F.col(id_col).alias("mix_id_"), F.md5(F.col(text_col).cast("binary")).alias("mix_digest_")]
    slim = docs.select(*keys, *own, words(F.col(text_col)).alias("mix_tokens")).where("mix_tokens > 0")
    slim = written(slim.groupBy(*levels, "mix_id_", "mix_digest_").agg(F.sum("mix_tokens").alias("mix_tokens")), "sizes")

    leaves = written(slim.groupBy(*levels).agg(F.sum("mix_tokens").alias("have_"), F.count("*").alias("n_")), "leaves")
    limit = budget if budget is not None else share * (leaves.agg(F.sum("have_")).first()[0] or 0)
    plan = allocate(leaves.withColumn("supply", F.col("have_") * epochs), levels, weights or {}, limit)
    whole = F.least(F.floor(F.col("quota") / F.col("have_")), F.lit(epochs)).cast("int")
    plan = plan.withColumn("mix_whole_", whole).withColumn("mix_rest_", F.when(whole < epochs, F.col("quota") - whole * F.col("have_")).otherwise(0.0))
    plan = written(plan.select(*levels, "mix_whole_", F.when(F.col("mix_rest_") > 1e-6, F.col("mix_rest_")).otherwise(0.0).alias("mix_rest_"), F.greatest(F.lit(1), F.ceil(F.col("n_") / BUCKET)).alias("mix_buckets_")), "budgets")
    few = plan.count() <= MOST_BROADCAST

    def with_plan(df: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
        if few:
            return df.join(F.broadcast(side), levels, how)
        # a leaf may hold a third of all rows: its rows are spread over SALTS keys
        salted = side.withColumn("mix_salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return df.withColumn("mix_salt_", F.pmod(F.xxhash64("mix_id_", "mix_digest_"), F.lit(SALTS)).cast("int")).join(salted, [*levels, "mix_salt_"], how).drop("mix_salt_")

    place = place_of(seed, F.col("mix_whole_") + 1, F.col("mix_id_"))
    ranked = with_plan(slim, plan.where("mix_rest_ > 0")).withColumn("mix_place_", place)
    ranked = ranked.withColumn("mix_bucket_", F.floor(F.col("mix_place_") / F.lit(float(1 << PLACES)) * F.col("mix_buckets_")))
    sums = ranked.groupBy(*levels, "mix_bucket_").agg(F.sum("mix_tokens").alias("t_"), F.first("mix_rest_").alias("rest_"))
    before = F.sum("t_").over(Window.partitionBy(*levels).orderBy("mix_bucket_").rowsBetween(Window.unboundedPreceding, -1))
    marks = sums.withColumn("mix_before_", F.coalesce(before, F.lit(0))).where("mix_before_ < rest_")
    edges = written(marks.groupBy(*levels).agg(F.max("mix_bucket_").alias("mix_bucket_"), F.max_by("mix_before_", "mix_bucket_").alias("mix_before_")), "edges")
    # the one bucket in which the budget ends; it is small whatever the leaf
    edge = with_plan(ranked.drop("mix_buckets_"), edges.withColumnRenamed("mix_bucket_", "mix_edge_")).where("mix_bucket_ = mix_edge_")
    order = [F.col("mix_place_"), F.col("mix_id_"), F.col("mix_digest_")]
    running = F.sum("mix_tokens").over(Window.partitionBy(*levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.withColumn("mix_so_far_", F.coalesce(running, F.lit(0))).where("mix_before_ + mix_so_far_ < mix_rest_")
    last = edge.groupBy(*levels).agg(F.max(F.struct("mix_place_", F.coalesce(F.col("mix_id_").cast("string"), F.lit("")).alias("id"), "mix_id_", "mix_digest_")).alias("mix_last_"))
    plan = written(plan.join(last, levels, "left").where("mix_whole_ > 0 OR mix_last_ IS NOT NULL"), "plan")

    full = with_plan(docs.select(*docs.columns, *keys, *own), plan)
    one = place.alias("mix_place_")
    lower = F.col("mix_last_.mix_place_")
    same = F.col("mix_place_") == lower
    # ids come before nulls here as in the order above: a null id is the first
    smaller_id = (F.col("mix_id_").isNull() & F.col("mix_last_.mix_id_").isNotNull()) | F.coalesce(F.col("mix_id_") < F.col("mix_last_.mix_id_"), F.lit(False))
    in_prefix = (F.col("mix_place_") < lower) | (same & (smaller_id | (F.col("mix_id_").eqNullSafe(F.col("mix_last_.mix_id_")) & (F.col("mix_digest_") <= F.col("mix_last_.mix_digest_")))))
    full = full.withColumn("mix_place_", one).withColumn("mix_takes_", F.col("mix_whole_") + F.coalesce(in_prefix, F.lit(False)).cast("int")).where("mix_takes_ > 0")
    full = full.withColumn("mix_tokens", words(F.col(text_col))).where("mix_tokens > 0")
    return full.select(*docs.columns, F.to_json(F.array(*levels)).alias("mix_leaf"), F.explode(F.sequence(F.lit(1), F.col("mix_takes_"))).alias("mix_epoch"), "mix_tokens")


def document_path() -> list[Column]:
    """Domain, language and source of ``documents``: the domain is the source's number modulo 4."""
    number = F.expr("try_cast(right(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), 9) AS long) % 4")
    return [F.concat(F.lit("domain"), F.coalesce(number.cast("string"), F.lit("?"))), F.col("lang"), F.col("source")]


#: Target weights of the registered query: two domains count double, one language half; all else is equal.
WEIGHTS = {("domain0",): 2.0, ("domain1",): 2.0, ("domain0", "es"): 0.5, ("domain1", "es"): 0.5}
SHARE, EPOCHS, SEED = 0.5, 3, 17


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mix(docs, document_path(), WEIGHTS, SHARE, epochs=EPOCHS, seed=SEED).select("doc_id", "lang", "source", "mix_epoch", "mix_tokens")


def _fill_sql(nodes: str, parent: str, child: str, amounts: str) -> str:
    """One level of the tree: how a family's amount ``x`` is split among its nodes (c: what they can spend, w: weight)."""
    by = f"PARTITION BY {parent}" if parent else ""
    keys = f"{parent}, {child}" if parent else child
    source = f"{nodes} JOIN {amounts} USING ({parent})" if parent else f"{nodes}, {amounts}"
    return f"""SELECT {keys}, CASE WHEN level IS NULL THEN c ELSE least(c, level * w) END AS x FROM (
    SELECT *, min_by(l, nth) FILTER (l * w < c) OVER ({by}) AS level FROM (
      SELECT *, row_number() OVER ({by} ORDER BY c / w, {child}) AS nth, greatest(x - coalesce(sum(c) OVER ({by} ORDER BY c / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)
        / sum(w) OVER ({by} ORDER BY c / w, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM {source}))"""


def _weight_sql(depth: int) -> str:
    cases = " ".join("WHEN " + " AND ".join(f"k{i} = '{p}'" for i, p in enumerate(k)) + f" THEN {w}" for k, w in WEIGHTS.items() if len(k) == depth)
    return f"CAST(CASE {cases} ELSE 1 END AS DOUBLE)" if cases else "1.0::DOUBLE"


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, source, md5(text) AS digest, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS tokens,
    'domain' || coalesce(CAST(try_cast(right(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), 9) AS BIGINT) % 4 AS VARCHAR), '?') AS k0, coalesce(lang, chr(0) || 'null') AS k1, coalesce(source, chr(0) || 'null') AS k2
  FROM documents
), t AS (SELECT * FROM d WHERE tokens > 0),
n2 AS (SELECT k0, k1, k2, sum(tokens)::DOUBLE AS have, {EPOCHS} * sum(tokens)::DOUBLE AS c, {_weight_sql(3)} AS w FROM t GROUP BY k0, k1, k2),
n1 AS (SELECT k0, k1, sum(c) AS c, {_weight_sql(2)} AS w FROM n2 WHERE w > 0 GROUP BY k0, k1),
n0 AS (SELECT k0, sum(c) AS c, {_weight_sql(1)} AS w FROM n1 WHERE w > 0 GROUP BY k0),
root AS (SELECT {SHARE} * sum(tokens) AS x FROM t),
x0 AS ({_fill_sql("n0", "", "k0", "root")}),
x1 AS ({_fill_sql("n1", "k0", "k1", "x0")}),
x2 AS ({_fill_sql("n2", "k0, k1", "k2", "x1")}),
plan AS (SELECT k0, k1, k2, have, round(x, 3) AS quota, CAST(least(floor(round(x, 3) / have), {EPOCHS}) AS INTEGER) AS whole FROM x2 JOIN n2 USING (k0, k1, k2)),
e AS (SELECT t.*, whole, CASE WHEN whole < {EPOCHS} THEN quota - whole * have ELSE 0 END AS rest,
    ('0x' || substr(md5(concat_ws('|', '{SEED}', whole + 1, coalesce(CAST(doc_id AS VARCHAR), ''))), 1, {PLACES // 4}))::BIGINT AS place FROM t JOIN plan USING (k0, k1, k2)),
r AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY k0, k1, k2 ORDER BY place, doc_id NULLS FIRST, digest RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS before FROM e)
SELECT doc_id, lang, source, CAST(unnest(range(1, whole + 1 + CASE WHEN rest > 0.000001 AND before < rest THEN 1 ELSE 0 END)) AS INTEGER) AS mix_epoch, tokens AS mix_tokens FROM r
"""
