"""Ranker, time model, searches, phases and payloads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrill import graph as G
from quadrill.operators import boosting as B
from quadrill.operators import features as X
from quadrill.operators import history as H
from quadrill.operators import negatives as K
from quadrill.operators import ranking as R
from quadrill.operators import rerank as L
from quadrill.operators import time_model as N
from quadrill.plans import phases


def loss(scores, starts):
    """The pairwise loss whose gradient the ranker follows, with swaps taken as they stand."""
    out = 0.0
    for a, b in zip(starts[:-1], starts[1:]):
        own = scores[a:b]
        rank = np.argsort(np.argsort(-own, kind="stable"), kind="stable") + 1
        for j in range(1, b - a):
            out += abs(1 / np.log2(1 + rank[0]) - 1 / np.log2(1 + rank[j])) * np.log1p(np.exp(own[j] - own[0]))
    return out


def test_ranking_gradient():
    r = np.random.default_rng(2)
    starts, s = np.array([0, 4, 9]), r.normal(size=9)
    grad, hess = B.gradients(s, starts)
    for i in range(9):
        e = np.zeros(9)
        e[i] = 1e-6
        assert -(loss(s + e, starts) - loss(s - e, starts)) / 2e-6 == pytest.approx(grad[i], abs=1e-4)
    assert (hess > 0).all() and grad[starts[:-1]].min() > 0


def made(n, seed, width=12):
    """Queries whose true target is the one of most a * b, which no single column shows."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width, 4))
    best = (x[:, :, 0] * x[:, :, 1]).argmax(1)
    x[np.arange(n), 0], x[np.arange(n), best] = x[np.arange(n), best].copy(), x[np.arange(n), 0].copy()
    return x.reshape(-1, 4), np.arange(0, n * width + 1, width)


def test_ranker_learns_and_stops():
    (x, starts), (v, vs) = made(400, 1, 40), made(200, 2, 40)
    model = B.Ranker(list("abcd"), B.RankerConfig(rounds=80, patience=10)).fit(x, starts, (v, vs))
    first = lambda s: B.strict_hits(s, vs, 1)
    assert first(model.predict(v)) > 0.5 and first(v[:, 0]) < 0.3 and 1 <= model.best <= len(model.trees)
    again = B.Ranker.from_json(model.to_json())
    assert (again.predict(v) == model.predict(v)).all()
    with pytest.raises(ValueError):
        B.Ranker(["a"]).fit(np.array([[np.nan], [1.0]]), np.array([0, 2]))
    with pytest.raises(ValueError):
        B.Ranker.from_json("{}")
    assert B.strict_hits(np.array([1.0, 1.0, 0.0]), np.array([0, 3]), 1) == 0.0  # a tie counts against the true target


def test_listwise_on_tables(spark):
    x, starts = made(150, 3)
    rows = [(int(i // 12), int(i % 12), int(i), *map(float, row)) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "qid long, cand_idx int, cand long, a double, b double, c double, d double")
    model = L.fit_listwise(df, None, ["a", "b", "c", "d"], B.RankerConfig(rounds=30))
    got = {(r.qid, r.cand_idx): r.score for r in L.predict_listwise(model, df).collect()}
    want = model.predict(x)
    assert all(got[int(i // 12), int(i % 12)] == pytest.approx(want[i]) for i in range(len(x)))
    few, bounds = L.matrix(df, ["a"], most_queries=40)
    assert 15 < len(bounds) - 1 < 70 and len(few) == bounds[-1]
    with pytest.raises(ValueError):
        L.matrix(df.where("cand_idx > 0 OR qid <> 7"), ["a"])
    with pytest.raises(Exception, match="undefined or infinite"):
        L.predict_listwise(model, df.withColumn("a", F.lit(float("inf")))).collect()


def test_searches():
    space = {"rate": (0.001, 0.3), "depth": (2, 6), "loss": ["x", "y"]}
    drawn = L.sampled(space, 30, seed=1)
    assert drawn == L.sampled(space, 30, seed=1) and all(0.001 <= d["rate"] <= 0.3 and isinstance(d["depth"], int) and d["loss"] in "xy" for d in drawn)
    tried = []
    evaluate = lambda o: tried.append(o) or {"mrr_strict": -abs(o["a"] - 7)}
    records = L.staged([lambda best: [{"a": a} for a in (0, 5, 10)], lambda best: [{"a": best[0]["options"]["a"] + d} for d in (-1, 0, 1, 2)]], evaluate)
    assert [r["options"]["a"] for r in L.best_records(records, "mrr_strict", 2)] == [7, 6] and len(tried) == 6


def time_batch(r, n, k, c, rels):
    rel = r.integers(-1, rels, (n, k))
    return {"nodes": r.integers(0, 40, (n, k)), "rels": rel, "ages": r.uniform(0, 9, (n, k)), "rel": r.integers(0, rels, n), "cands": r.integers(0, 40, (n, c)), "there": np.arange(c) < r.integers(1, c + 1, n)[:, None], "weight": r.uniform(0.5, 1, n)}


@pytest.mark.parametrize("kind", ["softmax", "margin"])
def test_time_gradient(kind):
    r = np.random.default_rng(4)
    model = N.TimeModel(3, N.TimeConfig(dim=4, events=3, buckets=17, loss=kind)).start()
    b = time_batch(r, 6, 3, 5, 3)
    _, grad = model.gradient(b)
    for k, w in model.weights.items():
        at = np.unravel_index(np.abs(grad[k]).argmax(), w.shape)
        old, e = w[at], 1e-5
        w[at] = old + e
        up = model.gradient(b)[0]
        w[at] = old - e
        down = model.gradient(b)[0]
        w[at] = old
        assert (up - down) / (2 * e) == pytest.approx(grad[k][at], rel=1e-3, abs=1e-7), k


def test_time_model_learns(spark):
    """A source goes where it went last time; the model finds that among twenty targets."""
    rnd = random.Random(1)
    rows, last, eid = [], {}, 0
    for t in range(60):
        for s in range(12):
            o = last.get(s) if s in last and rnd.random() < 0.85 else rnd.randrange(12, 32)
            last[s] = o
            rows.append((eid, s, 0, o, t, "train" if t < 45 else "val" if t < 50 else "test"))
            eid += 1
    g = G.graph_of(spark.createDataFrame(rows, "eid long, s long, r int, o long, t long, split string"), first_dst=12)
    cands = {x: K.candidates(q, K.tiered(g, q, 10)) for x in ("train", "val", "test") for q in [g.quads.where(F.col("split") == x)]}
    model = N.fit(cands["train"], cands["val"], g.quads, 1, N.TimeConfig(events=3, dim=24, epochs=40, rate=0.02, patience=6))
    done = N.time_scores(cands["test"].withColumn("score", F.lit("x")), g.quads, model)
    found = R.metrics(R.positive_ranks(done)).first()
    assert done.count() == cands["test"].count() and found["mrr_strict"] > 0.6  # chance gives 0.27
    again = N.TimeModel.from_json(model.to_json())
    assert sorted(r.score for r in N.time_scores(cands["test"], g.quads, again).collect()) == pytest.approx(sorted(r.score for r in done.collect()))
    # facts at or after a query's time change nothing
    late = g.quads.unionByName(g.quads.where("t >= 55").withColumn("o", F.lit(20).cast("long")))
    some = cands["test"].where("t = 55")
    assert sorted(map(tuple, N.time_scores(some, late, model).collect())) == sorted(map(tuple, N.time_scores(some, g.quads, model).collect()))
    assert N.fit(cands["train"].limit(0), None, g.quads, 1).weights and N.time_scores(some.limit(0), g.quads, model).count() == 0
    with pytest.raises(ValueError):
        N.TimeConfig(loss="other")


def test_listwise_on_all_queries(spark, monkeypatch):
    """Without a bound the ranker learns from every query, in blocks, and grows the trees that one process grows on all rows."""
    x, starts = made(150, 3)
    x = np.round(x, 2)
    rows = [(int(i // 12), int(i % 12), int(i), *map(float, row)) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "qid long, cand_idx int, cand long, a double, b double, c double, d double").repartition(3)
    monkeypatch.setattr(L, "STORE_EVERY", 2)
    got = L.fit_listwise(df, df, list("abcd"), B.RankerConfig(rounds=5, bins=200), None)
    want = B.Ranker(list("abcd"), B.RankerConfig(rounds=5, bins=200)).fit(x, starts, (x, starts))
    assert len(got.trees) == len(want.trees) and got.best == want.best
    assert np.corrcoef(got.predict(x), want.predict(x))[0, 1] > 0.98
    again = L.fit_listwise(df.repartition(7), df, list("abcd"), B.RankerConfig(rounds=5, bins=200), None)
    assert again.trees == got.trees
    with pytest.raises(Exception, match="exactly one true target"):
        L.fit_listwise(df.where("cand_idx > 0 OR qid <> 7"), None, ["a"], B.RankerConfig(rounds=1), None)


def test_phases(spark):
    rows = [(t * 4 + i, i, 0, (i + t) % 4, t, "train" if t < 10 else "val" if t < 13 else "test") for t in range(16) for i in range(4)]
    g = G.graph_of(spark.createDataFrame(rows, "eid long, s long, r int, o long, t long, split string"))
    count = lambda df: {r.phase: r["count"] for r in df.groupBy("phase").count().collect()}
    assert count(phases.scored(g, phases.RunConfig())) == {"train": 12, "val": 12, "test": 12}
    assert count(phases.scored(g, phases.RunConfig(0.0, skip_val_eval=True))) == {"test": 12}
    seen = {p: phases.warm_up(g, p, phases.RunConfig()).agg(F.max("t")).first()[0] for p in phases.PHASES}
    assert seen == {"train": 6, "val": 9, "test": 12}
    got = phases.phase_metrics(g, phases.RunConfig(q=2), lambda c: H.decayed_scores(c, g.quads, 0.3)).collect()
    assert {r.phase: r.queries for r in got} == {"train": 12, "val": 12, "test": 12}
    for bad in (lambda: phases.RunConfig(2.0), lambda: phases.warm_up(g, "x", phases.RunConfig())):
        with pytest.raises(ValueError):
            bad()


def test_payload(spark):
    rows = [(5, i, 100 + i, 1.0 - 0.1 * i, 0.5, float(i)) for i in range(4)]
    done = spark.createDataFrame(rows, "qid long, cand_idx int, cand long, structure_raw double, time double, pred double")
    done = X.rescued(done, 3)
    facts = spark.createDataFrame([(5, 1, 0, 100, 3, 30)], "eid long, s long, r int, o long, t long, t_orig long")
    one = X.payload(done, facts, k=2).first()
    assert (one.query_index, one.s, one.o, one.t_norm, one.t_orig, one.structure_rank_before, one.strict_rank) == (5, 1, 100, 3, 30, 1, 3)
    assert [(x["rank"], x.candidate_id, x.is_positive, x.model_score) for x in one.top2] == [(1, 102, False, 2.0), (2, 101, False, 1.0)]
