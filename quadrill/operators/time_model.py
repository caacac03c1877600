"""A learnt time score: recent events of the source encoded by a small network, scored against candidates relation by relation.

The network sees a source's last events (target, relation, age) before the query: each event's embeddings and time encoding go through
one layer, their mean through another, and the result is multiplied with a diagonal of the query's relation and the candidate's
embedding. It is trained in numpy, by hand-written backpropagation of a softmax or a margin loss, on a bounded number of queries
and candidates that hashes choose; validation queries stop it. Targets share embeddings by hash, so the model doesn't grow with the graph. A source is encoded
once for each time that is asked for, whatever the number of its candidates.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrill.functions.encoding import multiscale_frequencies
from quadrill.operators.history import recent_events


@dataclass(frozen=True)
class TimeConfig:
    dim: int = 16
    events: int = 10
    time_dim: int = 8
    longest: float = 30.0
    buckets: int = 4096
    loss: str = "softmax"
    margin: float = 1.0
    age_decay: float = 0.0
    epochs: int = 12
    batch: int = 128
    rate: float = 0.01
    clip: float = 5.0
    patience: int = 3
    most_queries: int = 2000
    most_candidates: int = 256
    seed: int = 3

    def __post_init__(self):
        if self.loss not in ("softmax", "margin"):
            raise ValueError(f"unknown loss {self.loss!r}")
        if min(self.dim, self.events, self.buckets, self.epochs, self.batch, self.patience, self.most_queries, self.most_candidates - 1) < 1 or self.time_dim % 2 or self.rate <= 0:
            raise ValueError("sizes are positive, time_dim is even")


def listwise_loss(s: np.ndarray, there: np.ndarray, weight: np.ndarray, c: Any) -> tuple[float, np.ndarray]:
    """Weighted mean loss of scores [n, c] whose first is the true target's, and its derivative; places not in ``there`` are padding."""
    weight = weight / weight.sum()
    s = np.where(there, s, -np.inf)
    if c.loss == "softmax":
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = float(-(weight * np.log(p[:, 0] + 1e-12)).sum())
        p[:, 0] -= 1
        return loss, p * weight[:, None]
    ds, rows = np.zeros_like(s), np.arange(len(s))
    if s.shape[1] < 2:
        return 0.0, ds
    worst = 1 + s[:, 1:].argmax(1)  # the hardest negative
    gap = np.where(there[rows, worst], c.margin - s[:, 0] + s[rows, worst], 0.0)  # a query may have no negative
    on = weight * (gap > 0)
    ds[rows, worst] = on
    ds[:, 0] -= on
    return float((weight * np.maximum(gap, 0)).sum()), ds


#: Queries whose gradient is worked out at once; a batch, or all validation queries, take no more memory than these.
PIECE = 32


class Trainable:
    """Training of any model with ``config``, ``weights`` and ``gradient``."""

    def loss(self, b: dict[str, np.ndarray]) -> float:
        """Weighted mean loss of a batch."""
        return self.gradient(b)[0]

    @staticmethod
    def pieces(b: dict[str, np.ndarray]) -> Iterator[tuple[float, dict[str, np.ndarray]]]:
        """(share of the batch's weight, part) of parts of ``PIECE`` queries: means over parts add up to the mean over the batch."""
        total = b["weight"].sum()
        for i in range(0, len(b["weight"]), PIECE):
            part = {k: v[i : i + PIECE] for k, v in b.items()}
            if (own := part["weight"].sum()) > 0:
                yield float(own / total), part

    def whole_loss(self, b: dict[str, np.ndarray]) -> float:
        return sum(share * self.loss(part) for share, part in self.pieces(b))

    def whole_gradient(self, b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for share, part in self.pieces(b):
            for k, g in self.gradient(part)[1].items():
                out[k] = out[k] + share * g if k in out else share * g
        return out

    def fit(self, train: dict[str, np.ndarray], val: dict[str, np.ndarray] | None = None) -> Any:
        """Adam with clipped gradients; the weights of the epoch that does best on ``val`` are kept."""
        c, r = self.config, np.random.default_rng(self.config.seed + 1)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        best, since, step, n = (np.inf, self.weights), 0, 0, len(train["rel"])
        for _ in range(c.epochs if n else 0):
            order = r.permutation(n)
            for i in range(0, n, c.batch):
                grad = self.whole_gradient({k: v[order[i : i + c.batch]] for k, v in train.items()})
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step += 1
                for k, g in grad.items():
                    g = g * min(1.0, c.clip / max(size, 1e-12))
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.weights[k] = self.weights[k] - c.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if val is not None and len(val["rel"]):
                loss = self.whole_loss(val)
                if loss < best[0] - 1e-6:
                    best, since = (loss, {k: v.copy() for k, v in self.weights.items()}), 0
                else:
                    since += 1
                    if since >= c.patience:
                        break
        if best[0] < np.inf:
            self.weights = best[1]
        return self


@dataclass
class TimeModel(Trainable):
    num_rels: int
    config: TimeConfig = field(default_factory=TimeConfig)
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self) -> TimeModel:
        c, r = self.config, np.random.default_rng(self.config.seed)
        wide = 2 * c.dim + c.time_dim
        self.weights = {
            "node": r.normal(0, 0.3, (c.buckets, c.dim)), "rel": r.normal(0, 0.3, (self.num_rels, c.dim)), "diag": 1 + r.normal(0, 0.1, (self.num_rels, c.dim)), "bias": np.zeros(c.buckets),
            "w1": r.normal(0, wide**-0.5, (wide, c.dim)), "b1": np.zeros(c.dim), "w2": r.normal(0, c.dim**-0.5, (c.dim, c.dim)), "b2": np.zeros(c.dim),
        }
        return self

    def encode(self, nodes: np.ndarray, rels: np.ndarray, ages: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Vectors [n, dim] of sources from their events [n, k]; a relation of -1 is no event."""
        w, c = self.weights, self.config
        mask = (rels >= 0)[:, :, None]
        turn = ages[:, :, None] * np.array(multiscale_frequencies(c.time_dim, 1.0, c.longest)) if c.time_dim else np.zeros((*ages.shape, 0))
        x = np.concatenate([w["node"][nodes % c.buckets], w["rel"][np.maximum(rels, 0)], np.sin(turn), np.cos(turn)], 2)
        a = np.tanh(x @ w["w1"] + w["b1"])
        n = np.maximum(mask.sum(1), 1)
        mean = (a * mask).sum(1) / n
        h = np.tanh(mean @ w["w2"] + w["b2"])
        if kept is not None:
            kept |= {"x": x, "a": a, "mask": mask, "n": n, "mean": mean}
        return h

    def score(self, h: np.ndarray, rel: np.ndarray, cands: np.ndarray) -> np.ndarray:
        """Scores [n, c] of candidates [n, c]."""
        w, at = self.weights, cands % self.config.buckets
        return np.einsum("nd,ncd->nc", h * w["diag"][rel], w["node"][at]) + w["bias"][at]

    def gradient(self, b: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean loss of a batch, whose first candidate is the true target, and its gradient."""
        w, c, kept = self.weights, self.config, {}
        h = self.encode(b["nodes"], b["rels"], b["ages"], kept)
        at = b["cands"] % c.buckets
        loss, ds = listwise_loss(self.score(h, b["rel"], b["cands"]), b["there"], b["weight"], c)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        diag, vec = w["diag"][b["rel"]], w["node"][at]
        np.add.at(g["bias"], at, ds)
        np.add.at(g["node"], at, ds[:, :, None] * (h * diag)[:, None, :])
        pulled = np.einsum("nc,ncd->nd", ds, vec)
        np.add.at(g["diag"], b["rel"], pulled * h)
        dm = pulled * diag * (1 - h * h)
        g["w2"], g["b2"] = kept["mean"].T @ dm, dm.sum(0)
        da = ((dm @ w["w2"].T) / kept["n"])[:, None, :] * kept["mask"] * (1 - kept["a"] ** 2)
        g["w1"], g["b1"] = np.einsum("nki,nkj->ij", kept["x"], da), da.sum((0, 1))
        dx = da @ w["w1"].T
        np.add.at(g["node"], b["nodes"] % c.buckets, dx[:, :, : c.dim])
        np.add.at(g["rel"], np.maximum(b["rels"], 0), dx[:, :, c.dim : 2 * c.dim])
        return loss, g

    def to_json(self) -> str:
        return json.dumps({"format": "quadrill_time_v1", "num_rels": self.num_rels, "config": asdict(self.config), "weights": {k: v.tolist() for k, v in self.weights.items()}})

    @staticmethod
    def from_json(text: str) -> TimeModel:
        d = json.loads(text)
        if d.get("format") != "quadrill_time_v1":
            raise ValueError(f"unknown format {d.get('format')!r}")
        return TimeModel(d["num_rels"], TimeConfig(**d["config"]), {k: np.array(v) for k, v in d["weights"].items()})


def with_events(asked: DataFrame, quads: DataFrame, k: int) -> DataFrame:
    """(s, t, nodes, rels, ages): for each source and time asked for its last k events before it, newest first; none is null."""
    keys = asked.select("s", "t").distinct()
    recent = recent_events(keys.withColumnRenamed("s", "node"), quads, k)
    lists = recent.groupBy(F.col("node").alias("s"), "t").agg(F.array_sort(F.collect_list(F.struct("place", "neighbor", "r", "delta"))).alias("events"))
    return keys.join(lists, ["s", "t"], "left").select("s", "t", F.col("events")["neighbor"].alias("nodes"), F.col("events")["r"].alias("rels"), F.col("events")["delta"].alias("ages"))


def arrays(pdf: pd.DataFrame, k: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Events as arrays [n, k]; a relation of -1 is no event."""
    lists = pdf[f"{prefix}nodes"]
    sizes = np.array([0 if x is None or np.ndim(x) == 0 else min(len(x), k) for x in lists], np.int64)
    out = np.zeros((len(pdf), k), np.int64), np.full((len(pdf), k), -1), np.zeros((len(pdf), k))
    own = np.flatnonzero(sizes)
    if len(own):
        rows = np.repeat(own, sizes[own])
        places = np.arange(len(rows)) - np.repeat(np.cumsum(np.r_[0, sizes[own][:-1]]), sizes[own])
        for values, c in zip(out, ("nodes", "rels", "ages"), strict=True):
            column = pdf[f"{prefix}{c}"]
            values[rows, places] = np.concatenate([np.asarray(column.iloc[i])[: sizes[i]] for i in own])
    return out


def _chosen(config: Any, salt: int, qid: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(config.seed + salt), qid), F.lit(1 << 30)) / F.lit(float(1 << 30)) < min(1.0, config.most_queries / max(n, 1))


def sampled_queries(queries: DataFrame, config: Any, salt: int = 0, qid: str = "eid") -> DataFrame:
    """The queries that ``sampled_lists`` chooses: candidates of these alone give the sample that candidates of all queries give."""
    return queries.where(_chosen(config, salt, qid, queries.count()))


def sampled_lists(cands: DataFrame, config: Any, salt: int = 0) -> DataFrame:
    """(qid, s, r, t, cands): about ``most_queries`` queries chosen by a hash of their id, each with its true target and at most ``most_candidates`` - 1 others, also chosen by a hash."""
    n = cands.where("cand_idx = 0").count()
    order = Window.partitionBy("qid").orderBy(F.col("cand_idx") > 0, F.xxhash64(F.lit(config.seed + salt), "qid", "cand"), "cand_idx")
    few = cands.where(_chosen(config, salt, "qid", n)).withColumn("place_", F.row_number().over(order)).where(F.col("place_") <= config.most_candidates)
    return few.groupBy("qid", "s", "r", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("cand_idx", "cand"))), lambda x: x["cand"]).alias("cands"))


def padded_lists(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Candidates [n, widest] and which of them are there; shorter lists are padded."""
    sizes = np.array([len(x) for x in lists], np.int64)
    there = np.arange(sizes.max(initial=1)) < sizes[:, None]
    out = np.zeros(there.shape, np.int64)
    if len(sizes):
        out[there] = np.concatenate([np.asarray(x, np.int64) for x in lists])
    return out, there


def examples(cands: DataFrame, quads: DataFrame, config: TimeConfig, salt: int = 0) -> dict[str, np.ndarray]:
    """Arrays of the sampled queries; queries with fewer candidates than others are padded."""
    lists = sampled_lists(cands, config, salt)
    pdf = lists.join(with_events(lists, quads, config.events), ["s", "t"]).toPandas().sort_values("qid")
    nodes, rels, ages = arrays(pdf, config.events)
    age = pdf["t"].max() - pdf["t"].to_numpy(float) if len(pdf) else np.zeros(0)
    stacked, there = padded_lists(pdf["cands"])
    return {"nodes": nodes, "rels": rels, "ages": ages, "rel": pdf["r"].to_numpy(np.int64), "cands": stacked, "there": there, "weight": np.exp(-config.age_decay * age)}


def fit(train: DataFrame, val: DataFrame | None, quads: DataFrame, num_rels: int, config: TimeConfig = TimeConfig()) -> TimeModel:
    """A model of candidates (qid, s, r, t, cand_idx, cand), index 0 the true target; events before each query's time are read from ``quads``."""
    return TimeModel(num_rels, config).start().fit(examples(train, quads, config), examples(val, quads, config, 1) if val is not None else None)


def time_scores(cands: DataFrame, quads: DataFrame, model: TimeModel) -> DataFrame:
    """Candidates with ``score``: sources are encoded once for each time, then joined to their candidates."""
    k = model.config.events

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"s": pdf["s"], "t": pdf["t"], "vector_": list(model.encode(*arrays(pdf, k)))})

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = np.stack(pdf["vector_"].to_numpy()) if len(pdf) else np.zeros((0, model.config.dim))
            yield pdf.drop(columns="vector_").assign(score=model.score(h, pdf["r"].to_numpy(np.int64), pdf["cand"].to_numpy(np.int64)[:, None])[:, 0])

    vectors = with_events(cands, quads, k).mapInPandas(encoded, "s long, t long, vector_ array<double>")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cands.schema if f.name != "score")
    return cands.drop("score").join(vectors, ["s", "t"]).select(*[c for c in cands.columns if c != "score"], "vector_").mapInPandas(scored, f"{schema}, score double")
