"""Golden graphs, plain-Python recurrences and metamorphic properties."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrill import graph as G
from quadrill.operators import history as H
from quadrill.operators import negatives as K
from quadrill.operators import ppr as P
from quadrill.operators import ranking as R
from quadrill.operators import relations as M
from quadrill.plans import multihop, registered, reranking

TINY = [(0, 0, 0, 1, 0), (1, 0, 0, 1, 0), (2, 1, 1, 2, 0), (3, 0, 0, 2, 1), (4, 2, 1, 2, 1), (5, 1, 0, 0, 2), (6, 0, 1, 1, 2), (7, 2, 0, 0, 3), (8, 0, 0, 1, 3), (9, 1, 1, 2, 3)]


def quads(spark, rows):
    return spark.createDataFrame([(e, s, r, o, t, "train") for e, s, r, o, t in rows], "eid long, s long, r int, o long, t long, split string")


def randoms(n=120, nodes=8, rels=3, times=6, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.randrange(nodes), rnd.randrange(rels), rnd.randrange(nodes), t) for i, t in enumerate(sorted(rnd.randrange(times) for _ in range(n)))]


def test_decayed_state_by_hand(spark):
    got = {(r.s, r.r, r.o): r.weight for r in H.decayed_state(quads(spark, TINY), 1.0).collect()}
    # (0, 0): twice o=1 at 0, o=2 at 1, o=1 at 3, in powers of 2 from time 3
    assert got[0, 0, 1] == pytest.approx((2 * 2**-3 + 1) / (2 * 2**-3 + 2**-2 + 1))
    assert got[2, 1, 2] == 1.0


def test_decayed_state_survives_long_spans(spark):
    rows = [(0, 0, 0, 1, 0), (1, 0, 0, 2, 100_000)]
    got = {r.o: r.weight for r in H.decayed_state(quads(spark, rows), 5.0).collect()}
    assert got[2] == 1.0 and got[1] == 0.0


def test_no_leak(spark):
    rows = randoms()
    ask = quads(spark, rows).where("t = 3").select(F.col("eid").alias("qid"), "s", "r", "t", F.lit(0).alias("cand_idx"), F.col("o").alias("cand"))
    late = [(1000 + i, s, r, o, t) for i, s, r, o, t in rows if t >= 3]
    for score in (lambda q: H.decayed_scores(ask, q, 0.3).select("qid", "score"), lambda q: H.causal_features(ask, q).select("qid", "tail_count", "exact_sro")):
        a = sorted(map(tuple, score(quads(spark, rows)).collect()))
        b = sorted(map(tuple, score(quads(spark, rows + late)).collect()))
        assert a == b


def brute_similarity(rows, w):
    out = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[1] == b[1] and a[3] == b[3] and abs(b[4] - a[4]) < w:
                out[a[2], b[2]] = out.get((a[2], b[2]), 0) + 1
                out[b[2], a[2]] = out.get((b[2], a[2]), 0) + 1
    return out


@pytest.mark.parametrize("w", [1, 2, 5])
def test_similarity_counts(spark, w):
    rows = randoms(200, 4)
    got = {(r.r_i, r.r_j): r.cnt for r in M.similarity_counts(quads(spark, rows), w).collect()}
    assert got == brute_similarity(rows, w)
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    assert got == {(r.r_i, r.r_j): r.cnt for r in M.similarity_counts(quads(spark, shuffled), w).collect()}


def test_transition_counts(spark):
    import math

    rows = randoms(150, 5)
    want = {}
    for _, _, r, o, t in rows:
        for _, s2, r2, _, t2 in rows:
            if s2 == o and 0 < t - t2 < 3:
                want[r, r2] = want.get((r, r2), 0.0) + math.exp(-0.2 * (t - t2))
    got = {(r.r_i, r.r_j): r.cnt for r in M.transition_counts(quads(spark, rows), 3, 0.2).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    flat = {(r.r_i, r.r_j): r.val for r in M.transition_matrix(M.transition_counts(quads(spark, []), 3, 0.2), 3).collect()}
    assert set(flat.values()) == {0.2} and len(flat) == 9


def brute_ppr(rows, cfg, trans):
    """The recurrence, one source after another, reading the state before the snapshot."""
    state, norm = {}, {}
    for t in sorted({r[4] for r in rows}):
        now = [r for r in rows if r[4] == t]
        for _, s, _, o, _ in now:
            for n in (s, o):
                if n not in state:
                    state[n] = {n: {-1: 1.0}} if cfg.mode == "per_rel" else {n: (1.0, -1, 0.0)}
                    norm[n] = 0.0
        new = {}
        for s in dict.fromkeys(r[1] for r in now):
            own = [r for r in now if r[1] == s]
            n = norm[s]
            n2 = cfg.beta * n + cfg.beta
            s1, s2 = (1 - cfg.alpha) * cfg.beta * n / n2, (1 - cfg.alpha) * cfg.beta / n2
            norm_new = n2
            if cfg.mode == "per_rel":
                temp = {k: {r: v * s1 for r, v in m.items()} for k, m in state[s].items()} if s1 > 0 else {}
                for _, _, r, o, _ in own:
                    c = {k: sum(v * (1 if q == -1 else trans[r, q]) for q, v in m.items()) for k, m in state[o].items()}
                    total = sum(c.values())
                    for k, v in c.items():
                        m = temp.setdefault(k, {})
                        m[r] = m.get(r, 0.0) + s2 / len(own) * v / total
                m = temp.setdefault(s, {})
                m[-1] = m.get(-1, 0.0) + cfg.alpha
                temp = {k: dict(sorted(m.items(), key=lambda x: (-x[1], x[0]))[: cfg.top_relations]) for k, m in temp.items()}
                top = sorted(temp, key=lambda k: (-sum(temp[k].values()), k))[: cfg.top_keys]
                total = sum(sum(temp[k].values()) for k in top)
                new[s] = {k: {r: v / total for r, v in temp[k].items()} for k in top}
            else:
                temp = {k: [v * s1, tag, (v if cfg.mode == "tag_max" else ts) * s1] for k, (v, tag, ts) in state[s].items()} if s1 > 0 else {}
                for _, _, r, o, _ in own:
                    c = {k: v * (1 if tag == -1 else trans[r, tag]) for k, (v, tag, _) in state[o].items()}
                    total = sum(c.values())
                    for k, v in c.items():
                        gain = s2 / len(own) * v / total
                        if cfg.mode == "tag_max":
                            if k not in temp or gain > temp[k][0]:
                                temp[k] = [gain, r, gain]
                        else:
                            x = temp.setdefault(k, [0.0, r, -1.0])
                            x[0] += gain
                            if k != s and gain > x[2]:
                                x[1:] = [r, gain]
                x = temp.setdefault(s, [0.0, -1, 0.0])
                x[0], x[1] = x[0] + cfg.alpha, -1
                top = sorted(temp, key=lambda k: (-temp[k][0], k))[: cfg.top_keys]
                total = sum(temp[k][0] for k in top) if len(temp) > cfg.top_keys else 1.0
                new[s] = {k: (temp[k][0] / total, temp[k][1], temp[k][2] / total) for k in top}
            norm[s] = norm_new
        state |= new
    return state


@pytest.mark.parametrize("mode", ["tag_sum", "tag_max", "per_rel"])
@pytest.mark.parametrize("top_keys", [1000, 4])
def test_ppr(spark, mode, top_keys):
    rows = randoms(60, 7, 3, 4, seed=5)
    cfg = P.PprConfig(mode, 0.1, 0.9, top_keys, 2)
    trans = {(i, j): 0.2 + 0.1 * ((2 * i + j) % 5) for i in range(3) for j in range(3)}
    table = spark.createDataFrame([(t, i, j, v) for t in range(4) for (i, j), v in trans.items()], "t long, r_i int, r_j int, val double")
    last = None
    for _, state in P.prequential(quads(spark, rows), cfg, table):
        last = state
    want, got = brute_ppr(rows, cfg, trans), {}
    for r in last.collect():
        if mode == "per_rel":
            got.setdefault(r.node, {}).setdefault(r.key, {})[r.rel] = r.score
        else:
            got.setdefault(r.node, {})[r.key] = (r.score, r.tag)
    assert got.keys() == want.keys()
    for n in want:
        assert got[n].keys() == want[n].keys()
        for k in want[n]:
            if mode == "per_rel":
                assert got[n][k] == pytest.approx(want[n][k])
            else:
                assert got[n][k][0] == pytest.approx(want[n][k][0]) and got[n][k][1] == want[n][k][1]
        if mode != "tag_max":
            assert sum(sum(v.values()) if mode == "per_rel" else v[0] for v in want[n].values()) == pytest.approx(1.0)


def test_shared_by_hand(spark):
    state = spark.createDataFrame([(0, 5, -1, 0.5, 0, 0.0), (0, 6, -1, 0.5, -1, 0.0), (1, 5, -1, 0.25, 1, 0.0), (1, 6, -1, 0.75, 1, 0.0)], P.STATE)
    sim = spark.createDataFrame([(i, j, 0.5 + 0.1 * i + 0.01 * j) for i in range(4) for j in range(4)], "r_i int, r_j int, val double")
    cand = spark.createDataFrame([(9, 0, 1, 3, 1, 1)], "qid long, s long, r int, t long, cand_idx int, cand long")
    one = lambda w: P.shared_scores(cand, state, sim, w, 0, 4).first()["shared"]
    val = lambda i, j: 0.5 + 0.1 * i + 0.01 * j
    assert one("unweighted") == pytest.approx(0.5 * 0.25 + 0.5 * 0.75)
    assert one("dual_msim") == pytest.approx(0.125 * val(0, 1) * val(1, 3) + 0.375 * val(1, 3))
    assert one("cross_msim") == pytest.approx(0.125 * val(0, 1) + 0.375)


def test_tie_policies(spark):
    rows = [(1, 0, 0, 0.5), (1, 1, 1, 0.5), (1, 2, 2, 0.9), (1, 3, 3, 0.1)]
    df = spark.createDataFrame(rows, "qid long, cand_idx int, cand long, score double")
    r = R.positive_ranks(df).first()
    assert (r.loose, r.strict, r.average) == (2, 3, 2.5)
    assert df.withColumn("k", R.ordinal_rank("score")).where("cand_idx = 0").first()["k"] == 2
    zero = R.metrics(R.positive_ranks(df.limit(0))).first()
    assert zero["queries"] == 0 and zero["mrr_strict"] == 0.0


def test_sparse_targets_repeat(spark):
    rows = [(i, 0, 0, i, 0) for i in range(4)] + [(4, 1, 0, 4, 0), (5, 1, 1, 5, 0)]
    g = G.graph_of(quads(spark, rows))
    got = K.tiered(g, g.quads.where("eid = 0"), 5).collect()
    assert len(got) == 5 and {r.cand for r in got} == {4, 5} and K.check_counts(K.tiered(g, g.quads, 5), 5).count() == 0
    assert [r.cand for r in sorted(got, key=lambda r: r.neg_idx)][0] == 5  # 4 is a positive of (t, r), so it comes second
    assert K.full_if_short(g, g.quads, 5).where("s = 0").count() == 2


def test_ordinal_and_step_times(spark):
    q = quads(spark, [(0, 0, 0, 1, 10), (1, 0, 0, 1, 13), (2, 0, 0, 1, 20)])
    assert sorted((r.t, r.t_norm) for r in G.ordinal_time(q).collect()) == [(10, 0), (13, 1), (20, 2)]
    assert sorted((r.t, r.t_norm) for r in G.step_time(q).collect()) == [(10, 0), (13, 1), (20, 2)]
    assert sorted((r.t, r.t_norm) for r in G.step_time(q, coarse=2.0).collect()) == [(10, 0), (13, 2), (20, 5)]
    assert G.step_time(q.limit(1)).first()["t_norm"] == 0


def brute_shares(rows, ask, decay):
    """Shares of each candidate by the definition, relative to the latest earlier fact of (s, r)."""
    out = {}
    for q, s, r, t, c in ask:
        past = [(o, u) for _, a, b, o, u in rows if a == s and b == r and u < t]
        if past:
            top = max(u for _, u in past)
            w = [(o, 2.0 ** (decay * (u - top))) for o, u in past]
            out[q] = sum(v for o, v in w if o == c) / sum(v for _, v in w)
        else:
            out[q] = 0.0
    return out


@pytest.mark.parametrize(("decay", "times"), [(0.3, 40), (5.0, 4000), (0.7, 100_000), (0.0, 50)])
def test_decayed_scores_over_long_spans(spark, decay, times):
    """As-of sums against the definition where spans cover many epochs, with facts on both sides of their bounds."""
    rnd = random.Random(int(decay * 10) + times)
    span = max(1, int(400 / decay)) if decay else times
    near = [x for e in range(0, times, span) for x in (e - 1, e, e + 1) if 0 <= x < times][:200]
    pick = lambda: rnd.choice(near) if near and rnd.random() < 0.5 else rnd.randrange(times)
    rows = [(i, rnd.randrange(3), rnd.randrange(2), rnd.randrange(4), pick()) for i in range(150)]
    ask = [(i, rnd.randrange(3), rnd.randrange(2), pick(), rnd.randrange(4)) for i in range(200)]
    cands = spark.createDataFrame([(q, s, r, t, 0, c) for q, s, r, t, c in ask], "qid long, s long, r int, t long, cand_idx int, cand long")
    got = {x.qid: x.score for x in H.decayed_scores(cands, quads(spark, rows), decay).collect()}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in brute_shares(rows, ask, decay).items()}


def test_recent_events_of_a_hub(spark):
    rnd = random.Random(2)
    rows = [(i, 0 if rnd.random() < 0.7 else rnd.randrange(4), 0, i, rnd.randrange(20)) for i in range(300)]
    ask = spark.createDataFrame([(s, t) for s in range(6) for t in range(0, 25, 3)], "node long, t long")
    got = {}
    for x in H.recent_events(ask, quads(spark, rows), 7).collect():
        got.setdefault((x.node, x.t), {})[x.place] = (x.neighbor, x.delta)
    for s in range(6):
        for t in range(0, 25, 3):
            past = sorted(((u, e, o) for e, a, _, o, u in rows if a == s and u < t), reverse=True)[:7]
            assert got.get((s, t), {}) == {i + 1: (o, t - u) for i, (u, _, o) in enumerate(past)}


def test_train_negatives_fill_up(spark):
    """Targets 0 to 3; relation 0 has had all but one, relation 1 has none left but positives."""
    rows = [(0, 0, 0, 1, 0), (1, 0, 0, 2, 0), (2, 0, 0, 0, 1), (3, 1, 1, 0, 1), (4, 1, 1, 1, 1), (5, 1, 1, 2, 1), (6, 1, 1, 3, 1)]
    g = G.graph_of(quads(spark, rows))
    got = {}
    for x in K.train_hard(g, g.quads.where("t = 1"), 6, 0.5).collect():
        got.setdefault(x.qid, {})[x.neg_idx] = (x.cand, x.hard)
    assert all(sorted(v) == [1, 2, 3, 4, 5, 6] for v in got.values()) and set(got) == {2, 3, 4, 5, 6}
    assert {got[2][i] for i in (1, 2)} == {(1, 1), (2, 1)} and {got[2][i] for i in (3, 4, 5, 6)} == {(3, 0)}
    assert {got[4][i] for i in range(1, 7)} == {(1, 0)}  # all targets are positives: its own
    with pytest.raises(ValueError):
        K.train_hard(g, g.quads, 5, 1.5)
    fast = K.train_fast(g, g.quads.where("t = 1"), 8, 0.5).collect()
    own = {e: o for e, _, _, o, _ in rows}
    assert len(fast) == 40 and all(x.cand != own[x.qid] and 0 <= x.cand <= 3 for x in fast)
    assert {x.cand for x in fast if x.hard} == {1, 2}


def test_walks_go_on_only_for_the_short(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.randrange(3), 0 if i < 700 else 1, rnd.randrange(400), rnd.randrange(3)) for i in range(800)]
    g = G.graph_of(quads(spark, rows))
    got = {}
    for x in K.tiered(g, g.quads, 10).collect():
        got.setdefault((x.t, x.s, x.r), {})[x.neg_idx] = x.cand
    known = {}
    for _, _, r, o, t in rows:
        known.setdefault((t, r), set()).add(o)
    assert all(len(set(v.values())) == 10 and not set(v.values()) & known[k[0], k[2]] for k, v in got.items())


def test_val_tail_by_blocks(spark):
    ids = [3 * i + (i % 2) for i in range(101)]
    q = spark.createDataFrame([(i,) for i in ids], "qid long")
    for fraction in (0.0, 0.1, 0.5, 0.99, 1.0):
        want = ids[int(len(ids) * (1 - fraction)) :]
        assert sorted(r.qid for r in G.val_tail(q, fraction, block=7).collect()) == want
    assert G.val_tail(q.limit(0), 0.5).count() == 0


def test_state_in_buckets(spark, monkeypatch):
    """Many buckets give the state that one gives, and replaced ones go."""
    rows = randoms(90, 12, 2, 8, seed=7)
    for _, state in P.prequential(quads(spark, rows), P.PprConfig()):
        whole = sorted(map(tuple, state.collect()))
    monkeypatch.setattr(P, "BUCKET_NODES", 2)
    made = []
    old = P.remove
    monkeypatch.setattr(P, "remove", lambda s, p: (made.append(p), old(s, p)))
    for _, state in P.prequential(quads(spark, rows), P.PprConfig()):
        parts = sorted(map(tuple, state.collect()))
    key = lambda r: (r[0], r[1], r[2], round(r[3], 10), r[4])
    assert list(map(key, parts)) == list(map(key, whole)) and made


def test_lists_and_joined_steps_give_the_same_negatives(spark, monkeypatch):
    g = G.graph_of(quads(spark, randoms(150, 30, 3, 5, 11)), 0, 79)
    ask = g.quads.where("t >= 3")
    found = []
    for most in (2000, 9, 0):  # arrays for all, for some relations, for none
        monkeypatch.setattr(K, "AS_LIST", most)
        found.append([sorted(map(tuple, df.collect())) for df in (K.tiered(g, ask, 6), K.tiered(g, ask, 70, repeat=False), K.train_hard(g, ask, 4, 0.5).select("qid", "neg_idx", "cand", "hard"))])
    assert found[0] == found[1] == found[2]


def test_hard_targets_far_along_the_walk_are_found(spark):
    rows = [(i, i % 5, 0, 1000 * i, 0) for i in range(5)] + [(9, 1, 0, 7, 1)]
    g = G.graph_of(quads(spark, rows), 0, 9999)
    got = K.train_hard(g, g.quads.where("t = 1"), 8, 0.5).collect()
    assert len(got) == 8 and sum(x.hard for x in got) == 4 and {x.cand for x in got if x.hard} <= {0, 1000, 2000, 3000, 4000}


def test_candidates_of_lists(spark):
    g = G.graph_of(quads(spark, randoms(60, 12, 2, 4, 5)), 0, 39)
    ask = g.quads.where("t = 3")
    assert sorted(map(tuple, K.sampled_candidates(g, ask, 5).collect())) == sorted(map(tuple, K.candidates(ask, K.tiered(g, ask, 5)).collect()))


def test_packed_state_is_the_state_of_joins(spark, monkeypatch):
    """One row a node; merging arrays of whole nodes, in cuts of any size, gives what Spark's joins and aggregates give, repeated facts included."""
    rows = randoms(70, 9, 3, 5, seed=3)
    rows += [(1000 + i, *x[1:]) for i, x in enumerate(rows[::3])]
    for cfg in (P.PprConfig("tag_sum", 0.1, 0.9, 4), P.PprConfig("tag_max", 0.1, 0.9)):
        found = []
        for small, merged in ((500_000, 400_000), (500_000, 3), (-1, 1)):  # the last: too much to send, so joins
            monkeypatch.setattr(P, "SMALL", small)
            monkeypatch.setattr(P, "MERGED", merged)
            for _, state in P.prequential(quads(spark, rows), cfg):
                last = state
            found.append(sorted((x.node, x.key, round(x.score, 10), x.tag) for x in last.collect()))
        assert found[0] == found[1] == found[2] and len(found[0]) > 9


def test_packed_rows_are_whole_nodes():
    batch = lambda *nodes: pa.record_batch({"node": pa.array(nodes, pa.int64()), "s1": pa.nulls(len(nodes), pa.float64()), "r": pa.nulls(len(nodes), pa.int32()), "eid": pa.nulls(len(nodes), pa.int64()), "n": pa.nulls(len(nodes), pa.int64()), "part": pa.nulls(len(nodes), pa.float64()), "keys": pa.array([[n] for n in nodes], pa.list_(pa.int64())), "scores": pa.array([[1.0]] * len(nodes)), "tags": pa.array([[-1]] * len(nodes), pa.list_(pa.int32())), "tag_scores": pa.array([[0.0]] * len(nodes))})
    out = [x.to_pydict() for x in P.merged_sources(iter([batch(1, 2), batch(3)]), P.PprConfig())]
    assert [n for x in out for n in x["node"]] == [1, 2, 3] and all(x["keys"] == [[n] for n in x["node"]] for x in out)
    with pytest.raises(ValueError):
        list(P.merged_sources(iter([batch(2, 1)]), P.PprConfig()))


def test_nothing_is_folded_or_joined_that_is_not_read(spark, monkeypatch):
    """No snapshot is folded after the last that is asked for, and shared scores alone need no mass of the candidates; both give the same shared scores."""
    g = G.graph_of(quads(spark, randoms(rels=2)))
    asked = g.quads.where("t IN (3, 5)")
    cands = P.stored(K.sampled_candidates(g, asked, 4))
    folded, joined, advance, dmh = [], [], P.advance, P.dmh_scores
    monkeypatch.setattr(P, "advance", lambda *a: folded.append(a[4]) or advance(*a))
    monkeypatch.setattr(P, "dmh_scores", lambda *a: joined.append(1) or dmh(*a))
    both = [multihop.structure_parts(g, cands, P.PprConfig(), "unweighted", dmh=d) for d in (True, False)]
    assert folded == [f"t={t}" for t in range(5)] * 2 and len(joined) == 2
    rows = [{(r["qid"], r["cand_idx"]): r["shared"] for r in df.collect()} for df in both]
    assert rows[0] == pytest.approx(rows[1]) and len(rows[0]) == cands.count() and "dmh" not in both[1].columns


def test_scores_read_the_stored_candidates(spark):
    """Two scores deal candidates fewer times than decayed scores read by recency ones do, with the same rows."""
    g = G.graph_of(quads(spark, randoms()))
    cands = P.stored(K.sampled_candidates(g, g.quads.where("t > 3"), 4))
    other = H.recency_scores(H.decayed_scores(cands, g.quads, 0.3).withColumnRenamed("score", "struct"), g.quads).withColumnRenamed("score", "time")
    own = reranking.both_scores(g, cands)
    dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    rows = lambda df: {(r["qid"], r["cand_idx"]): (round(r["struct"], 9), round(r["time"], 9)) for r in df.collect()}
    assert dealt(own) < dealt(other) and rows(own) == rows(other)


def test_facts_are_not_dealt_by_what_is_asked(spark):
    """Dictionaries, times and relations asked for are sent to facts of unknown size; only queries meet their own lists by a shuffle of both."""
    facts = quads(spark, randoms())
    g = G.graph_of(facts)
    asked = g.quads.where("t > 3")
    merges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")
    assert merges(G.coded(facts, "split", "code")) == 0
    assert merges(K.tiered_lists(g, asked, 4)) == 0
    assert merges(K.train_hard(g, asked, 4, 0.5)) == 1


def test_recency_of_lists(spark):
    """Scores of lists are those of rows and of plain Python, and so are their ranks; a query without a past has zeros, a null source too."""
    rows = [(i, 0 if i % 3 else s, r, o, t) for i, s, r, o, t in randoms(200)]
    facts = quads(spark, [*rows, (900, None, 0, 1, 2), (901, None, 0, 1, 4)])
    g = G.graph_of(facts)
    lists = P.stored(K.candidate_lists(g, g.quads.where("t IN (0, 3, 5)").unionByName(g.quads.where("eid = 901")), 4))
    mine = H.recency_lists(lists, g.quads, 6, 2.0)
    assert mine.columns == [*lists.columns, "scores"]
    got = {(x["qid"], x["cand_idx"]): (x["s"], x["t"], x["cand"], x["score"]) for x in K.laid_out(mine, {"scores": "score"}).collect()}
    assert len(got) == 5 * (lists.count() - 1) + 1 and {s for s, *_ in got.values()} >= {0, None}  # no negatives without a source
    for s, t, cand, score in got.values():
        past = sorted(((u, e, o) for e, a, _, o, u in rows if a == s and u < t), reverse=True)[:6]
        assert score == pytest.approx(sum(math.exp(-(t - u) / 2.0) for u, _, o in past if o == cand))
    long = H.recency_scores(K.laid_out(lists, {}), g.quads, 6, 2.0)
    assert {(x["qid"], x["cand_idx"]): x["score"] for x in long.collect()} == {k: pytest.approx(v[3]) for k, v in got.items()}
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(R.list_ranks(mine)) == same(R.positive_ranks(K.laid_out(mine, {"scores": "score"})))


def test_candidates_stay_in_their_query(spark, data):
    """Recency and its ranks deal facts and lists by source, and no rows of candidates by query or target."""
    plan = lambda name: registered.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    for name in ("recency_scores", "positive_ranks", "rank_metrics"):
        dealt = [x for x in plan(name).splitlines() if "Exchange hashpartitioning" in x]
        assert dealt and not [x for x in dealt if "qid" in x.split("ENSURE")[0] or "neighbor" in x or "cand#" in x]


@pytest.mark.parametrize("mode", ["per_rel", "tag_sum", "tag_max"])
def test_sources_folded_one_by_one_give_the_state_of_snapshots(spark, monkeypatch, mode):
    """Few nodes are targets: the driver folds these, tasks fold each other source by itself, and no snapshot rewrites the state."""
    from quadrill.operators import fold

    r = random.Random(5)
    rows = [(i, r.randrange(40), r.randrange(3), r.randrange(6), i // 40) for i in range(160)] + [(160, 3, 1, 2, 3), (161, 3, 1, 2, 3)]
    cfg = P.PprConfig(mode, top_keys=4, top_relations=2)
    table = spark.createDataFrame([(t, a, b, 0.2 + 0.1 * (a + 2 * b)) for t in range(4) for a in range(3) for b in range(3)], "t long, r_i int, r_j int, val double")
    state = lambda df: {(x.node, x.key, x.rel, x.tag): x.score for x in df.collect()}
    monkeypatch.setattr(fold, "AT_ONCE", 7)
    folded = []
    with monkeypatch.context() as m:
        m.setattr(P, "advance", lambda *a: folded.append(a))
        got = {t: state(df) for t, df in P.prequential(quads(spark, rows), cfg, table, {2})}
    assert not folded and set(got) == {2, -1}
    monkeypatch.setattr(fold, "TARGETS", 5)
    for t, df in P.prequential(quads(spark, rows), cfg, table, {2}):
        assert got[t] == pytest.approx(state(df), abs=1e-12)
