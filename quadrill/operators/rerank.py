"""Re-rankers on feature tables: list-wise boosting on all queries or on a bounded number, a pointwise regression, and searches over options."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product
from typing import Any
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrill.operators import features as X
from quadrill.operators import ranking as R
from quadrill.operators.boosting import Ranker, RankerConfig, gradients, strict_hits
from quadrill.operators.ppr import remove, shared_folder

KEY = ("qid", "cand_idx", "cand")
#: Rows of a block of whole queries, trees after which scores are stored anew, and what a derivative of 1 counts: sums of whole numbers don't depend on their order.
BLOCK_ROWS, STORE_EVERY, ONE = 50_000, 15, float(1 << 28)
BLOCK = "starts binary, bins binary, scores binary, held boolean"


def feature_names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in KEY]


def fit(train: DataFrame, names: list[str], reg: float = 1e-3, rounds: int = 30):
    """A model of P(true target); true targets weigh as much as all other candidates of their query."""
    many = F.count("*").over(R.per_query())
    rows = train.withColumn("label", (F.col("cand_idx") == 0).cast("double")).withColumn("weight", F.when(F.col("cand_idx") == 0, many - 1).otherwise(1).cast("double"))
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    return LogisticRegression(maxIter=rounds, regParam=reg, weightCol="weight").fit(vectors)


def predict(model, rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows' keys and ``score``."""
    out = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    return out.select(*KEY, vector_to_array("probability")[1].alias("score"))


def _read(qid: str, n: int, most_queries: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), qid), F.lit(1 << 30)) / F.lit(float(1 << 30)) < min(1.0, most_queries / max(n, 1))


def read_queries(queries: DataFrame, qid: str = "eid", most_queries: int = 2000, seed: int = 5) -> DataFrame:
    """The queries that ``matrix`` reads: features of these alone give the rows that features of all queries give."""
    return queries.where(_read(qid, queries.count(), most_queries, seed))


def matrix(features: DataFrame, names: list[str], most_queries: int = 2000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(rows, first row of each query and the total) of about ``most_queries`` queries chosen by a hash of their id; the true target comes first.

    A query without exactly one true target is an error. So many queries times their candidates reach the driver.
    """
    n = features.where("cand_idx = 0").count()
    pdf = features.where(_read("qid", n, most_queries, seed)).select("qid", "cand_idx", *(F.col(c).cast("double").alias(c) for c in names)).toPandas().sort_values(["qid", "cand_idx"])
    starts = np.flatnonzero(np.r_[True, np.diff(pdf["qid"].to_numpy()) != 0]) if len(pdf) else np.zeros(0, int)
    first = pdf["cand_idx"].to_numpy() == 0
    if len(pdf) and (first.sum() != len(starts) or not first[starts].all()):
        raise ValueError("every query must have exactly one true target")
    return pdf[names].to_numpy(float), np.r_[starts, len(pdf)].astype(int)


def fit_listwise(train: DataFrame, val: DataFrame | None, names: list[str], config: RankerConfig = RankerConfig(), most_queries: int | None = 2000) -> Ranker:
    """Boosted trees on training queries, on all of them if ``most_queries`` is None; validation queries, if given, say when to stop."""
    if most_queries is None:
        return fit_all(train, val, names, config)
    x, starts = matrix(train, names, most_queries)
    return Ranker(names, config).fit(x, starts, matrix(val, names, most_queries) if val is not None else None)


def _blocks(df: DataFrame, names: list[str], cuts: list[np.ndarray], held: bool) -> DataFrame:
    """Whole queries in blocks: where each starts, each feature's bin as a byte, and scores of 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in _and_none(batches):
            rows = left if batch is None else pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            if rows is None or not rows.num_rows or (batch is not None and rows.num_rows < BLOCK_ROWS):
                left = rows
                continue
            qid = rows["qid"].to_numpy()
            starts = np.flatnonzero(np.r_[True, qid[1:] != qid[:-1]])
            end = len(qid) if batch is None else starts[-1]  # the last query may go on
            left, starts, rows = rows.slice(end), starts[starts < end], rows.slice(0, end)
            if not end:
                continue
            first = rows["cand_idx"].to_numpy() == 0
            if first.sum() != len(starts) or not first[starts].all():
                raise ValueError("every query must have exactly one true target")
            bins = np.stack([np.searchsorted(cut, rows[c].to_numpy(), side="left").astype(np.uint8) for c, cut in zip(names, cuts, strict=True)])
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (np.r_[starts, end].astype(np.int64), bins, np.zeros(end))] + [pa.array([held])], ["starts", "bins", "scores", "held"])

    picked = df.select("qid", "cand_idx", *(F.col(c).cast("double").alias(c) for c in names))
    return picked.repartition("qid").sortWithinPartitions("qid", "cand_idx").mapInArrow(run, BLOCK)


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _at(tree: list[list[float]], places: list[int], bins: np.ndarray) -> np.ndarray:
    """The node that each row of ``bins`` [features, rows] reaches; ``places`` are the nodes' cuts by number."""
    table = np.array(tree)
    feature, left, cut = table[:, 0].astype(int), table[:, 2].astype(int), np.array(places)
    at, rows = np.zeros(bins.shape[1], int), np.arange(bins.shape[1])
    while (inner := feature[at] >= 0).any():
        at = np.where(inner, left[at] + (bins[np.maximum(feature[at], 0), rows] > cut[at]), at)
    return at


def _opened(row: dict[str, bytes], many: int, trees: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, bins, scores with these trees) of a block."""
    bins, scores = np.frombuffer(row["bins"], np.uint8).reshape(many, -1), np.frombuffer(row["scores"]).copy()
    for tree, places in trees:
        scores += np.array(tree)[:, 3][_at(tree, places, bins)]
    return np.frombuffer(row["starts"], np.int64), bins, scores


def fit_all(train: DataFrame, val: DataFrame | None, names: list[str], config: RankerConfig = RankerConfig()) -> Ranker:
    """``fit_listwise`` on all queries: rows stay on the executors as blocks of bytes, a job sums a level's derivatives, and the driver sees these sums only.

    Cuts are approximate quantiles of all rows (to a hundred-thousandth of them). Derivatives are summed as whole numbers, so neither blocks nor tasks change the trees.
    """
    c, r, many, spark = config, np.random.default_rng(config.seed), len(names), train.sparkSession
    if c.bins > 256:
        raise ValueError("at most 256 bins")
    model, shares = Ranker(names, config), np.linspace(0, 1, c.bins + 1)[1:-1].tolist()
    seen = train.agg(*(F.percentile_approx(F.col(x).cast("double"), shares, 100_000).alias(f"q{i}") for i, x in enumerate(names)), *(F.count_if(F.col(x).isNull() | ~R.finite(F.col(x).cast("double"))).alias(f"b{i}") for i, x in enumerate(names))).first()
    if bad := sum(seen[f"b{i}"] for i in range(many)):
        raise ValueError(f"{bad} feature values are undefined or infinite")
    cuts = [np.unique(np.array(seen[f"q{i}"] or [], float)) for i in range(many)]
    root = f"{shared_folder(spark)}/quadrill-ranker-{uuid4().hex}"
    rows = _blocks(train, names, cuts, False)
    (rows if val is None else rows.unionByName(_blocks(val, names, cuts, True))).write.parquet(f"{root}/0")
    kept, path, stored_at = [], f"{root}/0", 0  # (tree, places of its cuts)
    blocks = spark.read.schema(BLOCK).parquet(path)

    def sums(tree: list[list[float]], places: list[int], nodes: list[int], first: bool) -> tuple[np.ndarray, int, int]:
        """Derivatives and rows of each open node, feature and bin; with ``first``, held-out queries and how many of them the trees so far place in the first ten."""
        done, turn = kept[stored_at:], len(kept)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, hits, queries = np.zeros((3, len(nodes), many, c.bins)), 0, 0
            slot_of = np.full(len(tree), -1)
            slot_of[nodes] = np.arange(len(nodes))
            for row in (x for b in batches for x in b.to_pylist()):
                if row["held"]:
                    if first:
                        starts, _, scores = _opened(row, many, done)
                        hits, queries = hits + round(strict_hits(scores, starts) * (len(starts) - 1)), queries + len(starts) - 1
                    continue
                starts, bins, scores = _opened(row, many, done)
                grad, hess = (np.rint(x * ONE) for x in gradients(scores, starts))
                slot = slot_of[_at(tree, places, bins)]
                own = slot >= 0
                if c.rows < 1:
                    own &= np.random.default_rng([c.seed, turn, len(scores), int(starts[1])]).random(len(scores)) < c.rows
                slot, grad, hess = slot[own] * c.bins, grad[own], hess[own]
                for j in range(many):
                    at = slot + bins[j][own]
                    for k, weight in enumerate((grad, hess, None)):
                        total[k, :, j] += np.bincount(at, weight, len(nodes) * c.bins).reshape(len(nodes), c.bins)
            yield pa.record_batch([pa.array([total.astype(np.int64).tobytes()], pa.binary()), pa.array([hits]), pa.array([queries])], ["total", "hits", "queries"])

        got = blocks.mapInArrow(run, "total binary, hits long, queries long").collect()  # a row a task
        total, hits, queries = np.zeros((3, len(nodes), many, c.bins), np.int64), 0, 0
        for x in got:
            total, hits, queries = total + np.frombuffer(x["total"], np.int64).reshape(total.shape), hits + x["hits"], queries + x["queries"]
        return total, hits, queries

    best, top, since = 0, -1.0, 0

    def judged(hits: int, queries: int) -> bool:
        """Whether held-out queries say to stop."""
        nonlocal best, top, since
        if val is None or not kept:
            return False
        hit = hits / queries if queries else 0.0
        best, top, since = (len(kept), hit, 0) if hit > top + 1e-12 else (best, top, since + 1)
        return since >= c.patience

    stopped = False
    for _ in range(c.rounds):
        cols = np.sort(r.choice(many, max(1, round(c.columns * many)), replace=False))
        tree, places, nodes = [[-1, 0.0, 0, 0.0]], [0], [0]
        for depth in range(c.depth):
            total, hits, queries = sums(tree, places, nodes, depth == 0)
            if depth == 0 and (stopped := judged(hits, queries)):
                break
            grad, hess, n = total[0] / ONE, total[1] / ONE, total[2]
            nodes_below = []
            for i, node in enumerate(nodes):
                g, h, size = grad[i, cols[0]].sum(), hess[i, cols[0]].sum(), n[i, cols[0]].sum()
                tree[node][3] = float(c.rate * g / (h + c.penalty))
                found = (c.least_gain + 1e-12, -1, 0)
                for j in cols if size >= 2 * c.least_rows else ():
                    if not len(cuts[j]):
                        continue
                    gl, hl, nl = (x[i, j].cumsum()[: len(cuts[j])] for x in (grad, hess, n))
                    gain = gl**2 / (hl + c.penalty) + (g - gl) ** 2 / (h - hl + c.penalty) - g**2 / (h + c.penalty)
                    gain[(nl < c.least_rows) | (size - nl < c.least_rows)] = -1
                    k = int(gain.argmax())
                    if gain[k] > found[0]:
                        found = (float(gain[k]), int(j), k)
                if found[1] < 0:
                    continue
                _, j, k = found
                tree[node][:3], places[node] = [j, float(cuts[j][k]), len(tree)], k
                gl, hl = grad[i, j, : k + 1].sum(), hess[i, j, : k + 1].sum()
                nodes_below += [len(tree), len(tree) + 1]
                tree += [[-1, 0.0, 0, float(c.rate * x / (y + c.penalty))] for x, y in ((gl, hl), (g - gl, h - hl))]
                places += [0, 0]
            nodes = nodes_below
            if not nodes:
                break
        if stopped:
            break
        kept.append((tree, places))
        if len(kept) % STORE_EVERY == 0 and len(kept) < c.rounds:
            done = kept[stored_at:]

            def again(batches: Iterator[pa.RecordBatch], done: list[tuple] = done) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    scores = pa.array([_opened(row, many, done)[2].tobytes() for row in b.to_pylist()], pa.binary())
                    yield b.set_column(2, "scores", scores)

            blocks.mapInArrow(again, BLOCK).write.parquet(f"{root}/{len(kept)}")
            remove(spark, path)
            path, stored_at = f"{root}/{len(kept)}", len(kept)
            blocks = spark.read.schema(BLOCK).parquet(path)
    if not stopped:
        judged(*sums([[-1, 0.0, 0, 0.0]], [0], [0], True)[1:])
    remove(spark, root)
    model.trees, model.best = [tree for tree, _ in kept], best if val is not None and kept else len(kept)
    return model


def predict_listwise(model: Ranker, rows: DataFrame) -> DataFrame:
    """The rows' keys and ``score``; an undefined or infinite feature is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[model.names].to_numpy(float)
            if not np.isfinite(x).all():
                raise ValueError(f"{int((~np.isfinite(x)).sum())} feature values are undefined or infinite")
            yield pdf[list(KEY)].assign(score=model.predict(x))

    kinds = dict(rows.dtypes)
    picked = rows.select(*KEY, *(F.col(c).cast("double").alias(c) for c in model.names))
    return picked.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", score double")


def rerank_listwise(train: DataFrame, val: DataFrame | None, test: DataFrame, config: RankerConfig = RankerConfig(), most_queries: int | None = 2000) -> DataFrame:
    return predict_listwise(fit_listwise(train, val, feature_names(train), config, most_queries), test)


def rescue(train: tuple[DataFrame, DataFrame], val: tuple[DataFrame, DataFrame] | None, test: tuple[DataFrame, DataFrame], topk: int, score: str = "structure_raw", config: RankerConfig = RankerConfig(), most_queries: int = 2000, **selection: Any) -> tuple[DataFrame, Ranker]:
    """Test rows with ``pred`` and ``final``, and the model: each pair is (scores, features) of the same candidates.

    The model learns from the topk rows by ``score`` of training queries that have their true target among them (``selection`` says which; see
    ``features.rescue_rows``), and stops by the same rows of validation queries. Only the topk rows of a test query are predicted; they are set in the model's
    order above all others, which keep their score. Whether a test query's true target is among them plays no part, and ties give it no place of its own.
    """

    def rows(pair: tuple[DataFrame, DataFrame], **options: Any) -> DataFrame:
        return pair[1].join(X.rescue_rows(pair[0], topk, score=score, fair=True, **options).select("qid", "cand_idx"), ["qid", "cand_idx"], "left_semi")

    model = fit_listwise(rows(train, **selection), rows(val) if val is not None else None, feature_names(train[1]), config, most_queries)
    top = test[0].withColumn("rank_", R.fair_rank(score)).where(F.col("rank_") <= topk).select("qid", "cand_idx")
    pred = predict_listwise(model, test[1].join(top, ["qid", "cand_idx"], "left_semi")).select("qid", "cand_idx", F.col("score").alias("pred"))
    return X.rescued(test[0].join(pred, ["qid", "cand_idx"], "left"), topk, "pred", score, fair=True), model


def rerank(train: DataFrame, test: DataFrame, **options: Any) -> DataFrame:
    names = feature_names(train)
    return predict(fit(train, names, **options), test, names)


def grid(space: dict[str, list]) -> list[dict[str, Any]]:
    """All combinations of the options."""
    return [dict(zip(space, values, strict=True)) for values in product(*space.values())]


def sampled(space: dict[str, list | tuple], n: int, seed: int = 0) -> list[dict[str, Any]]:
    """n random combinations: one of a list, or a number between the two of a pair (log-uniform if both are positive and a factor of 10 apart; whole if both are)."""
    r = np.random.default_rng(seed)

    def draw(v: list | tuple) -> Any:
        if isinstance(v, list):
            return v[int(r.integers(len(v)))]
        low, high = v
        x = float(np.exp(r.uniform(np.log(low), np.log(high)))) if low > 0 and high >= 10 * low else float(r.uniform(low, high))
        return int(round(x)) if isinstance(low, int) and isinstance(high, int) else x

    return [{k: draw(v) for k, v in space.items()} for _ in range(n)]


class Parzen:
    """Search by the ratio of two densities: options of good records against options of all others.

    Of the records so far the best ``share`` are good. Each option of the next try is drawn from kernels around the good values and kept where that density is
    highest against the one of the other records; a broad kernel over the whole range stays in both. Ranges are pairs, as in ``sampled``; lists are choices.
    """

    def __init__(self, space: dict[str, list | tuple], metric: str, seed: int = 0, first: int = 10, share: float = 0.1, drawn: int = 24):
        self.space, self.metric, self.seed, self.first, self.share, self.drawn = space, metric, seed, first, share, drawn

    def scale(self, name: str) -> tuple[bool, float, float]:
        """(logarithmic, low, high) of a range, as it is searched."""
        low, high = self.space[name]
        log = low > 0 and high >= 10 * low
        return log, *((np.log(low), np.log(high)) if log else (float(low), float(high)))

    def next(self, records: list[dict[str, Any]]) -> dict[str, Any]:
        """The options to try after ``records``; the same records give the same options, so a search goes on from what is stored."""
        r = np.random.default_rng([self.seed, len(records)])
        if len(records) < self.first:
            return sampled(self.space, 1, int(r.integers(1 << 31)))[0]
        ordered = [x["options"] for x in best_records(records, self.metric, len(records))]
        n = max(1, int(np.ceil(self.share * len(ordered))))
        return {name: self.choice(r, name, ordered[:n], ordered[n:]) if isinstance(v, list) else self.number(r, name, ordered[:n], ordered[n:]) for name, v in self.space.items()}

    def choice(self, r: np.random.Generator, name: str, good: list[dict], rest: list[dict]) -> Any:
        values = self.space[name]
        a, b = (np.array([1 + sum(x[name] == v for x in part) for v in values], float) for part in (good, rest))
        a, b = a / a.sum(), b / b.sum()
        tries = r.choice(len(values), self.drawn, p=a)
        return values[int(tries[(a / b)[tries].argmax()])]

    def number(self, r: np.random.Generator, name: str, good: list[dict], rest: list[dict]) -> float | int:
        log, low, high = self.scale(name)
        at = lambda part: np.array([np.log(x[name]) if log else float(x[name]) for x in part])

        def density(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
            wide = (high - low) / max(2.0, len(centres) ** 0.5 * 2)
            near = np.exp(-0.5 * ((x[:, None] - centres) / wide) ** 2) / wide
            return (near.sum(1) + 1 / (high - low)) / (len(centres) + 1)

        g, b = at(good), at(rest)
        centre = np.r_[g, r.uniform(low, high)][r.integers(len(g) + 1, size=self.drawn)]
        tries = np.clip(centre + r.normal(0, (high - low) / max(2.0, len(g) ** 0.5 * 2), self.drawn), low, high)
        x = float(tries[(density(tries, g) / density(tries, b)).argmax()])
        x = float(np.exp(x)) if log else x
        return int(round(x)) if all(isinstance(v, int) for v in self.space[name]) else x

    def search(self, evaluate: Callable[[dict[str, Any]], dict[str, float]], n: int, records: list[dict[str, Any]] | None = None, keep: Callable[[list[dict[str, Any]]], None] | None = None) -> list[dict[str, Any]]:
        """Records of n tries, ``records`` among them; ``keep`` is called after each new one, so that a search that was cut off can go on."""
        records = list(records or [])
        while len(records) < n:
            options = self.next(records)
            records.append({"options": options} | evaluate(options))
            if keep is not None:
                keep(records)
        return records


def best_records(records: list[dict[str, Any]], metric: str, k: int = 1) -> list[dict[str, Any]]:
    """The k records of the best metric; equal ones in the order in which they were tried."""
    return sorted(records, key=lambda r: -r[metric])[:k]


def staged(stages: list[Callable[[list[dict[str, Any]]], list[dict[str, Any]]]], evaluate: Callable[[dict[str, Any]], dict[str, float]], metric: str = "mrr_strict", keep: int = 3) -> list[dict[str, Any]]:
    """Records of all options tried, stage by stage: each stage names options, given the best of those before it; none is tried twice."""
    records: list[dict[str, Any]] = []
    for stage in stages:
        for options in stage(best_records(records, metric, keep)):
            if not any(r["options"] == options for r in records):
                records.append({"options": options} | evaluate(options))
    return records


def select(train: DataFrame, val: DataFrame, space: dict[str, list], metric: str = "mrr_strict") -> tuple[dict[str, Any], float]:
    """The options that do best on validation queries; test queries take no part in the choice."""
    best: tuple[dict[str, Any], float] = ({}, float("-inf"))
    for options in grid(space):
        value = R.metrics(R.positive_ranks(rerank(train, val, **options))).first()[metric]
        if value > best[1]:
            best = (options, value)
    return best
