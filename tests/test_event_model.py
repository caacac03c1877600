"""Networks over the events of source and candidate: derivatives, masks, windows, planted tasks, tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrill import graph as G
from quadrill.operators import event_model as E
from quadrill.operators import negatives as K
from quadrill.operators import ranking as R
from quadrill.operators import tape as A

SMALL = {"dim": 4, "events": 3, "time_dim": 4, "buckets": 11, "hidden": 5}
KINDS = [
    {"encoder": "mean"}, {"encoder": "mixer", "layers": 2}, {"encoder": "attention", "layers": 2}, {"encoder": "attention", "windows": (1, 3)}, {"encoder": "mixer", "windows": (2, 3), "shared": False},
    {"gate": "scalar"}, {"gate": "channel", "encoder": "attention"}, {"cross": "events", "encoder": "mixer"}, {"cross": "mean", "encoder": "attention", "gate": "channel"}, {"cross": "events", "windows": (1, 3), "predictor": "concat"},
    {"predictor": "concat", "periods": (7.0, 30.0), "harmonics": 2, "places": False}, {"neighbours": False, "loss": "margin", "encoder": "attention"},
]


def batch(r, n=5, k=3, m=4, rels=3):
    def events(*size):
        rel = r.integers(0, rels, (*size, k))
        return r.integers(0, 40, (*size, k)), np.where(np.arange(k) < r.integers(0, k + 1, (*size, 1)), rel, -1), r.uniform(0, 9, (*size, k))

    out = {"s": r.integers(0, 40, n), "t": r.integers(20, 40, n), "rel": r.integers(0, rels, n), "cands": r.integers(0, 40, (n, m)), "there": np.arange(m) < r.integers(2, m + 1, n)[:, None], "weight": r.uniform(0.5, 1, n)}
    return out | dict(zip(("nodes", "rels", "ages"), events(n), strict=True)) | dict(zip(("c_nodes", "c_rels", "c_ages"), events(n, m), strict=True))


def test_operations_have_the_right_derivatives():
    r = np.random.default_rng(1)
    a, b, g, c = r.normal(size=(2, 3, 4)), r.normal(size=(4, 4)), r.normal(size=4), r.normal(size=4)
    mask = np.array([[True, True, False, True], [False] * 4])[:, None, :]

    def value(a, b, g, c):
        x = A.norm(A.gelu(a @ b), g, c)
        y = A.softmax(x, mask) * A.tanh(a) - A.sigmoid(x[:, [0, 0, 2]])
        z = A.concat([y, A.relu(x)]).swap(1, 2).reshape(2, 24)
        return (A.stack([z, z * z])[np.array([0, 1, 1])].sum(1).sum(0) * np.arange(24.0)).sum(0)

    leaves = [A.Var(x.copy()) for x in (a, b, g, c)]
    A.backward(value(*leaves))
    for i, at in itertools.product(range(4), range(4)):
        place = np.unravel_index((7 * at + 1) % leaves[i].value.size, leaves[i].value.shape)
        ends = []
        for e in (1e-6, -1e-6):
            moved = [x.value.copy() for x in leaves]
            moved[i][place] += e
            ends.append(float(value(*map(A.Var, moved)).value))
        assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(leaves[i].grad[place], rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("kind", KINDS, ids=lambda k: "-".join(map(str, k.values())))
def test_gradient(kind):
    r = np.random.default_rng(4)
    model = E.EventModel(3, E.EventConfig(**(SMALL | kind))).start()
    b = batch(r)
    _, grad = model.gradient(b)
    assert set(grad) == set(model.weights)
    for k, w in model.weights.items():
        at = np.unravel_index(np.abs(grad[k]).argmax(), w.shape)
        old, ends = w[at], []
        for e in (1e-5, -1e-5):
            w[at] = old + e
            ends.append(model.gradient(b)[0])
        w[at] = old
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(grad[k][at], rel=2e-3, abs=1e-7), k


@pytest.mark.parametrize("kind", KINDS, ids=lambda k: "-".join(map(str, k.values())))
def test_padding_changes_nothing(kind):
    """What stands in masked events, and further candidates that aren't there, change no score and no derivative."""
    r = np.random.default_rng(5)
    model = E.EventModel(3, E.EventConfig(**(SMALL | kind))).start()
    b = batch(r)
    other = dict(b)
    for prefix in ("", "c_"):
        gone = b[f"{prefix}rels"] < 0
        other[f"{prefix}nodes"] = np.where(gone, 7, b[f"{prefix}nodes"])
        other[f"{prefix}ages"] = np.where(gone, 3.0, b[f"{prefix}ages"])
    other["cands"] = np.where(b["there"], b["cands"], 33)
    first, second = model.gradient(b), model.gradient(other)
    assert first[0] == pytest.approx(second[0], abs=1e-12)
    assert all(np.allclose(first[1][k], second[1][k], atol=1e-12) for k in first[1])


@pytest.mark.parametrize("encoder", ["mean", "mixer", "attention"])
def test_one_window_is_the_plain_encoder(encoder):
    plain = E.EventModel(3, E.EventConfig(**SMALL, encoder=encoder)).start()
    one = E.EventModel(3, E.EventConfig(**SMALL, encoder=encoder, windows=(3,)), plain.weights | {"window": np.zeros(1)})
    b = batch(np.random.default_rng(6))
    assert plain.gradient(b)[0] == one.gradient(b)[0]
    many = E.EventModel(3, E.EventConfig(**SMALL, encoder=encoder, windows=(1, 3)), plain.weights | {"window": np.array([0.0, 60.0])})
    assert many.gradient(b)[0] == pytest.approx(plain.gradient(b)[0])


def same_relations(n, seed):
    """The true target is node 30 if a source's last two relations are the same, 31 otherwise; ages say nothing."""
    r = np.random.default_rng(seed)
    b = batch(r, n, 3, 2)
    b |= {"rels": r.integers(0, 3, (n, 3)), "nodes": r.integers(0, 9, (n, 3)), "ages": np.ones((n, 3)), "s": r.integers(0, 9, n), "rel": np.zeros(n, int), "there": np.ones((n, 2), bool), "c_rels": np.full((n, 2, 3), -1)}
    same = b["rels"][:, 0] == b["rels"][:, 1]
    b["cands"] = np.where(same[:, None], [[30, 31]], [[31, 30]])
    return b


def accuracy(model, b):
    own, place = np.nonzero(b["there"])
    target = tuple(b[f"c_{x}"][own, place] for x in ("nodes", "rels", "ages")) + (b["t"][own], b["rel"][own])
    s = model.pairs(model.frozen(), (b["nodes"], b["rels"], b["ages"], b["t"], b["rel"]), target, own, np.arange(len(own)), b["rel"][own], b["s"][own], b["cands"][own, place]).value.reshape(-1, 2)
    return float((s[:, 0] > s[:, 1]).mean())


def test_encoders_see_what_a_mean_cannot():
    """Without places in the tokens, a mean can't tell which two of three events are the last; mixing along the events and positions can."""
    found = {}
    for kind in ({"encoder": "mean", "places": False}, {"encoder": "mixer", "places": False, "event_growth": 2.0}, {"encoder": "attention"}):
        config = E.EventConfig(dim=8, events=3, time_dim=2, buckets=64, hidden=16, epochs=60, rate=0.02, patience=60, **kind)
        model = E.EventModel(3, config).start().fit(same_relations(600, 1), same_relations(200, 2))
        found[kind["encoder"]] = accuracy(model, same_relations(400, 3))
    assert found["mixer"] > 0.9 and found["attention"] > 0.95 and found["mean"] < 0.85, found


def history(n=40):
    """Sources that go where they went last time, and targets that answer."""
    rnd, rows, last, eid = random.Random(1), [], {}, 0
    for t in range(n):
        for s in range(12):
            o = last.get(s) if s in last and rnd.random() < 0.85 else rnd.randrange(12, 32)
            last[s] = o
            split = "train" if t < 0.75 * n else "val" if t < 0.85 * n else "test"
            rows += [(eid, s, 0, o, t, split), (eid + 1, o, 1, s, t, split)]
            eid += 2
    return rows


def graph(spark):
    g = G.graph_of(spark.createDataFrame(history(), "eid long, s long, r int, o long, t long, split string"))
    ask = lambda where: g.quads.where(where).where("r = 0")
    return g, {x: K.candidates(q, K.tiered(g, q, 8)) for x, q in {"prefix": ask("t < 20"), "suffix": ask("t >= 20 AND split = 'train'"), "val": ask("split = 'val'"), "test": ask("split = 'test'")}.items()}


@pytest.mark.parametrize("kind", [{"encoder": "mixer"}, {"encoder": "attention", "gate": "channel", "windows": (2, 4)}, {"encoder": "attention", "cross": "events"}], ids=["mixer", "gated", "cross"])
def test_scores_of_tables(spark, kind):
    g, c = graph(spark)
    train = c["prefix"].unionByName(c["suffix"])
    config = E.EventConfig(events=4, dim=12, epochs=10, rate=0.02, most_candidates=9, **kind)
    model = E.fit(train, c["val"], g.quads, g.num_rels, config)
    done = E.event_scores(c["test"].withColumn("score", F.lit("x")), g.quads, model)
    assert done.count() == c["test"].count() and R.metrics(R.positive_ranks(done)).first()["mrr_strict"] > 0.5  # chance gives 0.31
    some = c["test"].where("t = 37")
    rows = lambda df: {(r.qid, r.cand_idx): r.score for r in df.collect()}
    again = rows(E.event_scores(some, g.quads, E.EventModel.from_json(model.to_json())))
    late = rows(E.event_scores(some, g.quads.unionByName(g.quads.where("t >= 37").withColumn("o", F.lit(20).cast("long"))), model))
    assert again == pytest.approx(rows(done.where("t = 37"))) and late == pytest.approx(again)
    # the training examples' own arrays give the same scores
    b = E.examples(some, g.quads, config)
    own, place = np.nonzero(b["there"])
    target = tuple(b[f"c_{x}"][own, place] for x in ("nodes", "rels", "ages")) + (b["t"][own], b["rel"][own])
    plain = model.pairs(model.frozen(), (b["nodes"], b["rels"], b["ages"], b["t"], b["rel"]), target, own, np.arange(len(own)), b["rel"][own], b["s"][own], b["cands"][own, place]).value
    assert sorted(plain) == pytest.approx(sorted(again.values()))
    assert E.event_scores(some.limit(0), g.quads, model).count() == 0


def test_queries_of_different_length_are_all_learnt_from(spark):
    g, c = graph(spark)
    ragged = c["prefix"].where("cand_idx <= qid % 9")
    b = E.examples(ragged, g.quads, E.EventConfig(events=4, most_candidates=6))
    assert len(b["rel"]) == ragged.select("qid").distinct().count()
    assert sorted(b["there"].sum(1)) == sorted(min(6, r["n"]) for r in ragged.groupBy("qid").agg(F.count("*").alias("n")).collect())
    for loss in ("softmax", "margin"):
        assert np.isfinite(E.EventModel(2, E.EventConfig(events=4, loss=loss)).start().gradient(b)[0])


def test_out_of_fold_scores_do_not_leak(spark):
    g, c = graph(spark)
    config = E.EventConfig(events=3, dim=8, epochs=2, most_queries=300, most_candidates=5)
    suffix, test = E.out_of_fold(c["prefix"], c["suffix"], [c["val"], c["test"]], g.quads, g.num_rels, config)[::2]
    assert suffix.count() == c["suffix"].count() and test.count() == c["test"].count()
    # which target is the true one, and what happens at or after a time, changes no score of the suffix at that time
    turned = c["suffix"].withColumn("cand_idx", 8 - F.col("cand_idx"))
    later = g.quads.withColumn("o", F.when((F.col("t") >= 24) & (F.col("r") == 0), F.lit(13)).otherwise(F.col("o")))
    other = E.out_of_fold(c["prefix"], turned, [], later, g.num_rels, config)[0]
    rows = lambda df: sorted((r.qid, r.cand, r.score) for r in df.where("t <= 24").collect())
    assert [x[:2] for x in rows(suffix)] == [x[:2] for x in rows(other)] and [x[2] for x in rows(suffix)] == pytest.approx([x[2] for x in rows(other)])
    with pytest.raises(ValueError):
        E.out_of_fold(c["suffix"], c["prefix"], [], g.quads, g.num_rels, config)


def test_options_are_checked():
    for bad in ({"encoder": "x"}, {"gate": "x"}, {"cross": "x"}, {"predictor": "x"}, {"loss": "x"}, {"dim": 5}, {"windows": (0,)}, {"windows": (99,)}, {"time_dim": 3}, {"epochs": 0}):
        with pytest.raises(ValueError):
            E.EventConfig(**bad)
    with pytest.raises(ValueError):
        E.EventModel.from_json("{}")


def test_pieces_bound_memory_and_change_nothing():
    """A batch is worked out in pieces: none is larger than PIECE, and loss and gradient are those of the whole."""
    from quadrill.operators import time_model as N

    r = np.random.default_rng(4)
    config = E.EventConfig(encoder="attention", gate="channel", dim=4, events=3, buckets=16, hidden=4, time_dim=2)
    n, m, k = 2 * N.PIECE + 5, 4, 3
    shape = lambda *at: (r.integers(0, 30, (*at, k)), r.integers(-1, 4, (*at, k)), r.random((*at, k)) * 9)
    b = {"s": r.integers(0, 30, n), "t": r.integers(5, 9, n), "rel": r.integers(0, 4, n), "cands": r.integers(0, 30, (n, m)), "there": np.ones((n, m), bool), "weight": r.random(n) + 0.1}
    b |= dict(zip(("nodes", "rels", "ages"), shape(n), strict=True)) | dict(zip(("c_nodes", "c_rels", "c_ages"), shape(n, m), strict=True))
    model = E.EventModel(4, config).start()
    loss, grad = model.gradient(b)
    assert max(len(part["s"]) for _, part in model.pieces(b)) == N.PIECE
    assert model.whole_loss(b) == pytest.approx(loss)
    assert all(np.allclose(model.whole_gradient(b)[k], g) for k, g in grad.items())


def test_encoding_takes_no_more_memory_than_a_piece():
    """A batch of Arrow, however long, goes through the network in pieces, and vectors stay those of the whole."""
    import tracemalloc

    import pandas as pd

    class Rows:
        dtypes = [("s", "bigint"), ("t", "bigint"), ("r", "int")]

        def mapInPandas(self, run, schema):
            return run

    model, r, n = E.EventModel(10, E.EventConfig(encoder="attention", gate="channel", windows=(3, 10))).start(), np.random.default_rng(1), 3000
    lists = {name: list(r.integers(0, top, (n, 10))) for name, top in (("nodes", 99), ("rels", 9), ("ages", 9))}
    pdf = pd.DataFrame({"s": np.arange(n), "t": 5, "r": 1, **lists})
    run = E.encoded_events(Rows(), model)
    tracemalloc.start()
    got = np.concatenate([np.stack(part["vector"]) for part in run(iter([pdf]))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    arrays = (np.stack(pdf[c]) for c in ("nodes", "rels", "ages"))
    assert peak < 120e6 and np.allclose(got, model.encoded(model.frozen(), *arrays, pdf["t"].to_numpy(), pdf["r"].to_numpy()).value)
