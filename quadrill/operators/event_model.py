"""Learnt scores of source and candidate from the last events of both: mixer and attention encoders, nested windows, gates, cross attention.

A node's last events before the query become tokens (time encoding of the age, relation, neighbour, calendar phases), which an encoder
turns into a vector: ``mixer`` mixes along the events and along the channels, ``attention`` lets events and a class token attend to each
other, ``mean`` averages. Places without an event are masked everywhere. With ``windows``, the same encoder reads several nested prefixes of the events,
and learnt weights combine its vectors; with ``shared=False`` each window has an encoder of its own and vectors are laid side by side. A ``gate``
weighs each event by its relation and the query's. With ``cross``, the source's tokens attend to the candidate's
events (``events``) or to their mean (``mean``) before they are pooled.

Without ``cross`` a node is encoded once for each time (and relation, if there is a gate) and joined to all candidate rows that need
it. With it, a pair can't be scored from two vectors: candidate rows carry the events of both ends to Arrow batches, and each batch encodes
what it has in common once. Training reads a bounded number of queries and candidates, as in ``time_model``.

A node without events has the encoding of no events. Queries may have different numbers of candidates. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrill.functions.encoding import multiscale_frequencies, periodic_frequencies
from quadrill.operators import tape as A
from quadrill.operators.ppr import stored
from quadrill.operators.tape import Var
from quadrill.operators.time_model import Trainable, arrays, listwise_loss, padded_lists, sampled_lists, sampled_queries, with_events


#: Most encoded targets, or targets with events, that are sent to all executors, after they were counted.
FEW_ENDS = 50_000
#: Nodes or pairs that go through the network at once; a task takes no more memory than these, whatever Arrow's batches hold.
AT_ONCE = 500


def asked_ends(ends: DataFrame, base: DataFrame, by: list[str]) -> DataFrame:
    """The rows of ``ends`` that some candidate asks for, written once; where they are few, candidates meet them without a shuffle."""
    df = stored(ends.join(base.select(*by).distinct(), by, "left_semi"))
    return F.broadcast(df) if df.count() <= FEW_ENDS else df


@dataclass(frozen=True)
class EventConfig:
    dim: int = 16
    events: int = 10
    time_dim: int = 8
    longest: float = 30.0
    periods: tuple[float, ...] = ()
    harmonics: int = 1
    buckets: int = 4096
    neighbours: bool = True
    places: bool = True
    encoder: str = "mixer"
    layers: int = 1
    heads: int = 2
    event_growth: float = 0.5
    channel_growth: float = 2.0
    windows: tuple[int, ...] = ()
    shared: bool = True
    gate: str = ""
    cross: str = ""
    predictor: str = "diag"
    hidden: int = 32
    loss: str = "softmax"
    margin: float = 1.0
    age_decay: float = 0.0
    epochs: int = 12
    batch: int = 128
    rate: float = 0.01
    clip: float = 5.0
    patience: int = 3
    most_queries: int = 2000
    most_candidates: int = 64
    seed: int = 3

    def __post_init__(self):
        for name, known in (("encoder", ("mean", "mixer", "attention")), ("gate", ("", "scalar", "channel")), ("cross", ("", "mean", "events")), ("predictor", ("diag", "concat")), ("loss", ("softmax", "margin"))):
            if getattr(self, name) not in known:
                raise ValueError(f"unknown {name} {getattr(self, name)!r}")
        sizes = (self.dim, self.events, self.buckets, self.layers, self.heads, self.hidden, self.epochs, self.batch, self.patience, self.most_queries, self.most_candidates - 1)
        if min(sizes) < 1 or self.time_dim < 2 or self.time_dim % 2 or self.rate <= 0:
            raise ValueError("sizes are positive, time_dim is even")
        if self.dim % self.heads:
            raise ValueError("heads must divide dim")
        if any(not 0 < w <= self.events for w in self.windows):
            raise ValueError("windows lie between 1 and events")

    @property
    def lengths(self) -> tuple[int, ...]:
        """The windows that are read; all events are one."""
        return self.windows or (self.events,)

    @property
    def wide(self) -> int:
        """Components of an encoded node."""
        return self.dim if self.shared else self.dim * len(self.lengths)


@dataclass
class EventModel(Trainable):
    num_rels: int
    config: EventConfig = field(default_factory=EventConfig)
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self) -> EventModel:
        c, r = self.config, np.random.default_rng(self.config.seed)
        w: dict[str, np.ndarray] = {"node": r.normal(0, 0.3, (c.buckets, c.dim)), "rel": r.normal(0, 0.3, (self.num_rels, c.dim))}

        def linear(name: str, a: int, b: int) -> None:
            w[f"{name}.w"], w[f"{name}.b"] = r.normal(0, a**-0.5, (a, b)), np.zeros(b)

        def norm(name: str, n: int) -> None:
            w[f"{name}.g"], w[f"{name}.c"] = np.ones(n), np.zeros(n)

        d, wide = c.dim, c.time_dim + c.dim + (c.dim if c.neighbours else 0) + 2 * len(c.periods) * c.harmonics
        if c.gate:
            linear("gate1", 2 * d, d)
            norm("gate", d)
            linear("gate2", d, d if c.gate == "channel" else 1)
        for i, k in enumerate([c.events] if c.shared else c.lengths):
            linear(f"e{i}.in", wide, d)
            norm(f"e{i}.in", d)
            if c.places:
                w[f"e{i}.place"] = r.normal(0, 0.1, (k, d))
            for layer in range(c.layers if c.encoder != "mean" else 0):
                at, tall = f"e{i}.{layer}", max(1, int(c.channel_growth * d))
                norm(f"{at}.a", d)
                norm(f"{at}.b", d)
                if c.encoder == "mixer":
                    few = max(1, int(c.event_growth * k))
                    linear(f"{at}.t1", k, few)
                    linear(f"{at}.t2", few, k)
                else:
                    for part in "qkvo":
                        linear(f"{at}.{part}", d, d)
                linear(f"{at}.c1", d, tall)
                linear(f"{at}.c2", tall, d)
            if c.encoder == "attention":
                w[f"e{i}.class"] = r.normal(0, 0.1, (1, d))
            norm(f"e{i}.out", d)
            linear(f"e{i}.out", d, d)
            if c.cross:
                norm(f"e{i}.x", d)
                for part in "qkvo":
                    linear(f"e{i}.x{part}", d, d)
        if c.shared and c.windows:
            w["window"] = np.zeros(len(c.windows))
        if c.predictor == "diag":
            linear("diag", d, c.wide)
            norm("diag", c.wide)
        linear("p1", 2 * c.wide + 3 * d, c.hidden)
        norm("p", c.hidden)
        linear("p2", c.hidden, 1)
        self.weights = w
        return self

    # one node's events to tokens, tokens to a vector

    def tokens(self, w: dict[str, Var], at: str, nodes: np.ndarray, rels: np.ndarray, ages: np.ndarray, mask: np.ndarray, times: np.ndarray, query_rel: np.ndarray) -> tuple[Var, Var | None]:
        """(tokens [n, k, d], class token [n, d] if the encoder has one)."""
        c, on = self.config, mask[:, :, None].astype(float)
        turn = ages[:, :, None] * np.array(multiscale_frequencies(c.time_dim, 1.0, c.longest))
        rel = w["rel"][np.maximum(rels, 0)]
        parts = [Var(np.concatenate([np.sin(turn), np.cos(turn)], 2)), rel]
        if c.periods:
            phase = (times[:, None] - ages)[:, :, None] * np.array(periodic_frequencies(list(c.periods), c.harmonics))
            parts.append(Var(np.concatenate([np.sin(phase), np.cos(phase)], 2)))
        if c.neighbours:
            parts.append(w["node"][nodes % c.buckets])
        x = normed(w, f"{at}.in", line(w, f"{at}.in", A.concat(parts)))
        if c.gate:
            q = Var(np.ones((1, rels.shape[1], 1))) * w["rel"][query_rel].reshape(len(rels), 1, c.dim)
            x = x * A.sigmoid(line(w, "gate2", A.relu(normed(w, "gate", line(w, "gate1", A.concat([q, rel]))))))
        if c.places:
            x = x + w[f"{at}.place"][: rels.shape[1]]
        x = x * on
        if c.encoder == "mean":
            return A.tanh(x) * on, None
        if c.encoder == "attention":
            first = Var(np.ones((len(rels), 1, 1))) * w[f"{at}.class"]
            both = np.concatenate([np.ones((len(rels), 1), bool), mask], 1)
            x = A.concat([first.swap(1, 2), x.swap(1, 2)]).swap(1, 2)
            for layer in range(c.layers):
                name = f"{at}.{layer}"
                y = normed(w, f"{name}.a", x)
                x = x + attend(w, f"{name}.", y, y, both, c.heads)
                x = x + line(w, f"{name}.c2", A.gelu(line(w, f"{name}.c1", normed(w, f"{name}.b", x))))
            return x[:, 1:] * on, x[:, 0]
        for layer in range(c.layers):
            name = f"{at}.{layer}"
            y = normed(w, f"{name}.a", x).swap(1, 2)
            x = (x + line(w, f"{name}.t2", A.gelu(line(w, f"{name}.t1", y))).swap(1, 2)) * on
            x = (x + line(w, f"{name}.c2", A.gelu(line(w, f"{name}.c1", normed(w, f"{name}.b", x))))) * on
        return x, None

    def windows(self, w: dict[str, Var], nodes: np.ndarray, rels: np.ndarray, ages: np.ndarray, times: np.ndarray, query_rel: np.ndarray) -> list[tuple[str, Var, Var | None, np.ndarray]]:
        """(encoder, tokens, class token, mask) of each window."""
        c, out = self.config, []
        for i, k in enumerate(c.lengths):
            at = "e0" if c.shared else f"e{i}"
            cut = slice(None) if c.shared else slice(k)  # a shared encoder has one width; what lies beyond the window is masked
            mask = ((rels >= 0) & (np.arange(rels.shape[1]) < k))[:, cut]
            out.append((at, *self.tokens(w, at, nodes[:, cut], rels[:, cut], ages[:, cut], mask, times, query_rel), mask))
        return out

    def pooled(self, w: dict[str, Var], at: str, tokens: Var, first: Var | None, mask: np.ndarray) -> Var:
        """The class token, or the mean of the tokens that are there."""
        mean = first if first is not None else tokens.sum(1) * (1 / np.maximum(mask.sum(1, keepdims=True), 1))
        return line(w, f"{at}.out", normed(w, f"{at}.out", mean))

    def combined(self, w: dict[str, Var], vectors: list[Var]) -> Var:
        if not self.config.shared:
            return A.concat(vectors)
        if len(vectors) == 1:
            return vectors[0]
        return (A.stack(vectors) * A.softmax(w["window"]).reshape(1, len(vectors), 1)).sum(1)

    def encoded(self, w: dict[str, Var], nodes: np.ndarray, rels: np.ndarray, ages: np.ndarray, times: np.ndarray, query_rel: np.ndarray) -> Var:
        return self.combined(w, [self.pooled(w, at, x, first, mask) for at, x, first, mask in self.windows(w, nodes, rels, ages, times, query_rel)])

    # pairs

    def predicted(self, w: dict[str, Var], hs: Var, hd: Var, rel: np.ndarray, s: np.ndarray, cand: np.ndarray) -> Var:
        """Scores [n] of pairs of encoded nodes."""
        c, r = self.config, w["rel"][rel]
        if c.predictor == "diag":
            hs = hs * normed(w, "diag", line(w, "diag", r))
        x = A.concat([hs, hd, r, w["node"][s % c.buckets], w["node"][cand % c.buckets]])
        return line(w, "p2", A.relu(normed(w, "p", line(w, "p1", x)))).reshape(len(rel))

    def crossed(self, w: dict[str, Var], source: list, target: list, own: np.ndarray, other: np.ndarray) -> tuple[Var, Var]:
        """Vectors of pairs (row ``own`` of the sources, row ``other`` of the targets): source tokens attend to the target's before they are pooled."""
        hs, hd = [], []
        for (at, xs, _, ms), (_, xd, _, md) in zip(source, target, strict=True):
            xs, ms, xd, md = xs[own], ms[own], xd[other], md[other]
            keys, seen = (xd, md) if self.config.cross == "events" else ((xd.sum(1) * (1 / np.maximum(md.sum(1, keepdims=True), 1))).reshape(len(own), 1, self.config.dim), md.any(1, keepdims=True))
            across = attend(w, f"{at}.x", normed(w, f"{at}.x", xs), keys, seen, self.config.heads) * md.any(1)[:, None, None].astype(float)
            hs.append(self.pooled(w, at, (xs + across) * ms[:, :, None].astype(float), None, ms))
            hd.append(self.pooled(w, at, xd, None, md))
        return self.combined(w, hs), self.combined(w, hd)

    def pairs(self, w: dict[str, Var], source: tuple, target: tuple, own: np.ndarray, other: np.ndarray, rel: np.ndarray, s: np.ndarray, cand: np.ndarray) -> Var:
        """Scores of pairs of rows of ``source`` and ``target`` (nodes, rels, ages, times, query relations)."""
        if self.config.cross:
            hs, hd = self.crossed(w, self.windows(w, *source), self.windows(w, *target), own, other)
        else:
            hs, hd = self.encoded(w, *source)[own], self.encoded(w, *target)[other]
        return self.predicted(w, hs, hd, rel, s, cand)

    def forward(self, w: dict[str, Var], b: dict[str, np.ndarray]) -> tuple[float, np.ndarray, Var]:
        """Weighted mean loss of a batch, whose first candidate is the true target, its derivative by the scores, and the scores of all pairs that are there."""
        there, (n, m) = b["there"], b["there"].shape
        own, place = np.nonzero(there)
        target = tuple(b[f"c_{x}"][own, place] for x in ("nodes", "rels", "ages")) + (b["t"][own], b["rel"][own])
        source = (b["nodes"], b["rels"], b["ages"], b["t"], b["rel"])
        flat = self.pairs(w, source, target, own, np.arange(len(own)), b["rel"][own], b["s"][own], b["cands"][own, place])
        scores = np.zeros((n, m))
        scores[own, place] = flat.value
        loss, ds = listwise_loss(scores, there, b["weight"], self.config)
        return loss, ds[own, place], flat

    def loss(self, b: dict[str, np.ndarray]) -> float:
        return self.forward(self.frozen(), b)[0]

    def gradient(self, b: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean loss of a batch and its gradient."""
        w = {k: Var(v) for k, v in self.weights.items()}
        loss, ds, flat = self.forward(w, b)
        A.backward((flat * ds).sum(0))
        return loss, {k: v.grad if v.grad is not None else np.zeros_like(v.value) for k, v in w.items()}

    def frozen(self) -> dict[str, Var]:
        return {k: Var(v) for k, v in self.weights.items()}

    def to_json(self) -> str:
        return json.dumps({"format": "quadrill_events_v1", "num_rels": self.num_rels, "config": asdict(self.config), "weights": {k: v.tolist() for k, v in self.weights.items()}})

    @staticmethod
    def from_json(text: str) -> EventModel:
        d = json.loads(text)
        if d.get("format") != "quadrill_events_v1":
            raise ValueError(f"unknown format {d.get('format')!r}")
        config = d["config"] | {k: tuple(d["config"][k]) for k in ("periods", "windows")}
        return EventModel(d["num_rels"], EventConfig(**config), {k: np.array(v) for k, v in d["weights"].items()})


def line(w: dict[str, Var], name: str, x: Var) -> Var:
    return x @ w[f"{name}.w"] + w[f"{name}.b"]


def normed(w: dict[str, Var], name: str, x: Var) -> Var:
    return A.norm(x, w[f"{name}.g"], w[f"{name}.c"])


def attend(w: dict[str, Var], name: str, x: Var, keys: Var, seen: np.ndarray, heads: int) -> Var:
    """Multi-head attention of x [n, a, d] to keys [n, b, d], of which only those in ``seen`` [n, b] are there."""
    n, a, d = x.shape
    split = lambda v: v.reshape(n, v.shape[1], heads, d // heads).swap(1, 2)
    q, k, v = (split(line(w, f"{name}{part}", y)) for part, y in (("q", x), ("k", keys), ("v", keys)))
    weight = A.softmax((q @ k.swap(2, 3)) * (d // heads) ** -0.5, seen[:, None, None, :])
    return line(w, f"{name}o", (weight @ v).swap(1, 2).reshape(n, a, d))


def examples(cands: DataFrame, quads: DataFrame, config: EventConfig, salt: int = 0) -> dict[str, np.ndarray]:
    """Arrays of the sampled queries, with the events of sources and of candidates."""
    lists = sampled_lists(cands, config, salt).persist()
    asked = lists.select("s", "t").unionByName(lists.select(F.explode("cands").alias("s"), "t"))
    events = with_events(asked, quads, config.events).toPandas()
    pdf = lists.toPandas().sort_values("qid")
    lists.unpersist()
    row = {key: i for i, key in enumerate(zip(events["s"], events["t"], strict=True))}
    nodes, rels, ages = arrays(events, config.events)
    stacked, there = padded_lists(pdf["cands"])
    t = pdf["t"].to_numpy(np.int64)
    own = np.array([row[key] for key in zip(pdf["s"], pdf["t"], strict=True)], np.int64)
    other = np.zeros(there.shape, np.int64)
    n, place = np.nonzero(there)
    other[n, place] = np.array([row[key] for key in zip(stacked[n, place].tolist(), t[n].tolist(), strict=True)], np.int64)
    age = t.max() - t if len(t) else t
    out = {"s": pdf["s"].to_numpy(np.int64), "t": t, "rel": pdf["r"].to_numpy(np.int64), "cands": stacked, "there": there, "weight": np.exp(-config.age_decay * age)}
    return out | {k: v[own] for k, v in (("nodes", nodes), ("rels", rels), ("ages", ages))} | {f"c_{k}": v[other] for k, v in (("nodes", nodes), ("rels", rels), ("ages", ages))}


def fit(train: DataFrame, val: DataFrame | None, quads: DataFrame, num_rels: int, config: EventConfig = EventConfig()) -> EventModel:
    """A model of candidates (qid, s, r, t, cand_idx, cand), index 0 the true target; events before each query's time are read from ``quads``."""
    return EventModel(num_rels, config).start().fit(examples(train, quads, config), examples(val, quads, config, 1) if val is not None else None)


def encodings(asked: DataFrame, quads: DataFrame, model: EventModel) -> DataFrame:
    """(s, t, r, vector) of nodes and times; ``r`` is the query's relation, null without a gate. ``asked`` has s, t and r."""
    gated = bool(model.config.gate)
    keys = asked.select("s", "t", F.col("r").cast("int").alias("r") if gated else F.lit(None).cast("int").alias("r")).distinct()
    return encoded_events(keys.join(with_events(keys, quads, model.config.events), ["s", "t"]), model)


def encoded_events(rows: DataFrame, model: EventModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """(s, t, r, carried columns, vector) of rows with the lists nodes, rels and ages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = model.frozen()
        for pdf in batches:
            for i in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[i : i + AT_ONCE]
                h = model.encoded(w, *arrays(part, model.config.events), part["t"].to_numpy(np.int64), part["r"].fillna(0).to_numpy(np.int64)).value
                yield part[["s", "t", "r", *carry]].assign(vector=list(h))

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("s", "t", "r", *carry)) + ", vector array<double>")


def event_scores(cands: DataFrame, quads: DataFrame, model: EventModel, vectors: DataFrame | None = None) -> DataFrame:
    """Candidates with ``score``. ``vectors`` are encodings of all their ends, if a store has them."""
    base = cands.drop("score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", score double"
    ends = lambda v: v.select(F.col("s").alias("cand"), "t", *(F.col(c).alias(f"c_{c}") for c in v.columns if c not in ("s", "t")))
    k = model.config.events

    if not model.config.cross:
        asked = base.select("s", "t", "r").unionByName(base.select(F.col("cand").alias("s"), "t", "r"))
        v = stored(encodings(asked, quads, model)) if vectors is None else vectors
        v = v.withColumnRenamed("r", "q_")
        gate = F.col("r") == F.col("q_") if model.config.gate else F.lit(True)
        joined = base.join(v, (base["s"] == v["s"]) & (base["t"] == v["t"]) & gate).select(base["*"], "vector")
        u = asked_ends(ends(v).withColumnRenamed("c_q_", "r"), base, ["cand", "t", *(["r"] if model.config.gate else [])]).withColumnsRenamed({"cand": "n_", "t": "at_", "r": "q_"})
        joined = joined.join(u, (F.col("cand") == F.col("n_")) & (F.col("t") == F.col("at_")) & gate).select(*base.columns, "vector", "c_vector")

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = model.frozen()
            for b in (batch.slice(i, AT_ONCE) for batch in batches for i in range(0, len(batch), AT_ONCE)):
                if len(b):
                    hs, hd = (Var(b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)) for c in ("vector", "c_vector"))
                    score = model.predicted(w, hs, hd, *(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("r", "s", "cand"))).value
                    yield b.drop_columns(["vector", "c_vector"]).append_column("score", pa.array(score))

        return joined.mapInArrow(scored, schema)

    events = stored(with_events(base.select("s", "t").unionByName(base.select(F.col("cand").alias("s"), "t")), quads, k))
    names = base.columns
    joined = base.join(events, ["s", "t"]).join(asked_ends(ends(events), base, ["cand", "t"]), ["cand", "t"])

    def crossed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = model.frozen()
        for pdf in batches:
            for i in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[i : i + AT_ONCE]
                sides, at = [], []
                for end, prefix in (("s", ""), ("cand", "c_")):
                    code = part.groupby([end, "t", "r"], sort=False).ngroup().to_numpy()
                    _, first = np.unique(code, return_index=True)
                    one = part.iloc[first]
                    sides.append((*arrays(one, k, prefix), one["t"].to_numpy(np.int64), one["r"].to_numpy(np.int64)))
                    at.append(code)
                score = model.pairs(w, *sides, *at, *(part[c].to_numpy(np.int64) for c in ("r", "s", "cand"))).value
                yield part[names].assign(score=score)

    return joined.select(*base.columns, "nodes", "rels", "ages", "c_nodes", "c_rels", "c_ages").mapInPandas(crossed, schema)


def out_of_fold(prefix: DataFrame, suffix: DataFrame, later: list[DataFrame], quads: DataFrame, num_rels: int, config: Any = EventConfig()) -> list[DataFrame]:
    """Scores of ``suffix`` (candidates of training snapshots) and of each table in ``later`` that leak nothing.

    A model fitted on the candidates of the snapshots before the suffix scores the suffix; the last of its own snapshots say when it stops. The
    ranker that learns from these scores therefore sees scores of the kind it gets for validation and test queries, which a model
    fitted on prefix and suffix together gives.
    """
    early, late = fold_models(prefix, suffix, later[0] if later else None, quads, num_rels, config)
    return [event_scores(suffix, quads, early), *(event_scores(df, quads, late) for df in later)]


def fold_models(prefix: DataFrame, suffix: DataFrame, val: DataFrame | None, quads: DataFrame, num_rels: int, config: Any = EventConfig(), candidates: Callable[[DataFrame], DataFrame] | None = None) -> tuple[EventModel, EventModel]:
    """The models of ``out_of_fold``: of the prefix alone, and of prefix and suffix together.

    With ``candidates``, the tables hold queries (eid, s, r, o, t), and it makes the candidates of those that are learnt from, and of no others; the models are the same.
    """
    part = lambda df, salt: df if candidates is None or df is None else candidates(sampled_queries(df, config, salt))
    first = suffix.agg(F.min("t")).first()[0]
    if first is not None and (last := prefix.agg(F.max("t")).first()[0]) is not None and last >= first:
        raise ValueError("the prefix must end before the suffix")
    times = [r["t"] for r in prefix.groupBy("t").count().orderBy("t").collect()]
    border = times[int(0.8 * len(times))] if len(times) > 1 else None
    own, stop = (prefix, None) if border is None else (prefix.where(F.col("t") < border), prefix.where(F.col("t") >= border))
    early = fit(part(own, 0), part(stop, 1), quads, num_rels, config)
    return early, fit(part(prefix.unionByName(suffix.select(*prefix.columns)), 0), part(val, 1), quads, num_rels, config)
