"""Rescue by a fitted model, search by densities, encoding and score stores, figures of a run."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrill import graph as G
from quadrill.operators import boosting as B
from quadrill.operators import event_model as E
from quadrill.operators import features as X
from quadrill.operators import negatives as K
from quadrill.operators import ranking as R
from quadrill.operators import rerank as L
from quadrill.operators import time_model as N
from quadrill.plans import learning
from quadrill.sources.encodings import EncodingStore
from quadrill.sources.metrics import RunMetrics, StreamProgress
from quadrill.sources.stores import ScoreStore, both_stores, read_json, write_json


def scored(spark, seed, queries=300, width=15):
    """Structure scores that put the true target second or third of fifteen, and a time score that finds it."""
    r = random.Random(seed)
    rows = []
    for q in range(queries):
        s = [r.random() * 0.5 for _ in range(width)]
        s[0] = 0.6
        for i in (3, 7)[: 1 + q % 2]:
            s[i] = 0.7 + 0.1 * r.random()
        if q % 10 == 9:
            s[0] = 0.0  # out of reach
        rows += [(q, 1, 0, i, 100 + i, s[i], (0.9 if i == 0 else 0.3) + 0.3 * r.random()) for i in range(width)]
    return spark.createDataFrame(rows, "qid long, s long, r int, cand_idx int, cand long, struct double, time double")


def test_rescue_by_a_model(spark):
    train, val, test = (scored(spark, i) for i in (1, 2, 3))
    pair = lambda df: (df, X.hybrid_features(df, 2, fair=True))
    done, model = L.rescue(pair(train), pair(val), pair(test), 4, "struct", B.RankerConfig(rounds=30))
    before, after = (R.metrics(R.positive_ranks(df, c)).first() for df, c in ((test, "struct"), (done, "final")))
    assert before["hit1_strict"] == 0 and after["hit1_strict"] > 0.85 and done.count() == test.count()
    rows = done.collect()
    assert {r["qid"] % 10 for r in rows if r["cand_idx"] == 0 and r["before_rank"] > 4} == {9}  # chosen whatever the true target's place
    assert all((r["pred"] is None) == (r["before_rank"] > 4) for r in rows)
    assert all(r["final"] == r["struct"] for r in rows if r["before_rank"] > 4)
    by = {}
    for r in rows:
        by.setdefault(r["qid"], []).append(r)
    for own in by.values():
        top = sorted((r for r in own if r["before_rank"] <= 4), key=lambda r: -r["final"])
        assert [r["pred"] for r in top] == sorted((r["pred"] for r in top), reverse=True) and min(r["final"] for r in top) > max(r["struct"] for r in own if r["before_rank"] > 4)
    stats = X.rescue_stats(done).first().asDict()
    assert stats["pos_in_top10_before"] + stats["pos_11_100_before"] == 300
    # learnt from training queries in reach only, and every third of them if asked for
    few, _ = L.rescue(pair(train), None, pair(test), 4, "struct", B.RankerConfig(rounds=5), stride=3, most=50)
    assert few.count() == test.count()


def test_registered_rescue_moves_targets_into_the_first_ten(spark):
    """With as many candidates as the query reorders, a target that stands fifteenth can be rescued, and the counters say so."""

    def late(seed):
        r = random.Random(seed)
        rows = [(q, 1, 0, i, 100 + i, 0.5 if i == 0 else (0.9 if i <= 14 else 0.1) + 0.05 * r.random(), (0.9 if i == 0 else 0.3) + 0.3 * r.random()) for q in range(60) for i in range(21)]
        df = spark.createDataFrame(rows, "qid long, s long, r int, cand_idx int, cand long, struct double, time double")
        return df, X.hybrid_features(df, 2, fair=True)

    done, _ = L.rescue(late(1), None, late(2), learning.RESCUED, "struct", B.RankerConfig(rounds=5))
    stats = X.rescue_stats(done).first()
    assert stats["pos_11_100_before"] == 60 and stats["rescued_11_100_to_top10"] > 50


def test_fair_ranks_hide_the_true_target(spark):
    df = spark.createDataFrame([(q, i, 1000 + (q * 31 + i * 17) % 97, 0.5) for q in range(400) for i in range(5)], "qid long, cand_idx int, cand long, x double")
    first = df.withColumns({"rank": R.ordinal_rank("x"), "fair": R.fair_rank("x")}).where("cand_idx = 0").agg(F.avg(F.col("rank") * 1.0), F.avg(F.col("fair") * 1.0)).first()
    assert first[0] == 1 and 2.7 < first[1] < 3.3


SPACE = {"a": (0.0, 10.0), "rate": (1e-4, 1.0), "depth": (1, 9), "kind": ["x", "y", "z"]}


def hill(o):
    return {"score": -((o["a"] - 7.3) ** 2) / 10 - (np.log10(o["rate"]) + 2) ** 2 - (o["depth"] - 4) ** 2 / 8 - (o["kind"] != "y")}


def test_density_search_beats_chance():
    found, chance = [], []
    for seed in range(10):
        found.append(L.best_records(L.Parzen(SPACE, "score", seed).search(hill, 60), "score")[0]["score"])
        chance.append(max(hill(o)["score"] for o in L.sampled(SPACE, 60, seed)))
    assert np.mean(found) > np.mean(chance) + 0.15 and sum(a > b for a, b in zip(found, chance)) >= 8, (found, chance)


def test_density_search_goes_on(spark, tmp_path):
    kept, path = [], f"file://{tmp_path}/records.json"
    search = lambda: L.Parzen(SPACE, "score", 5)
    whole = search().search(hill, 20, keep=lambda r: kept.append(len(r)))
    assert kept == list(range(1, 21)) and all(0 <= r["options"]["a"] <= 10 and 1 <= r["options"]["depth"] <= 9 and isinstance(r["options"]["depth"], int) for r in whole)
    search().search(hill, 12, keep=lambda r: write_json(spark, path, {"records": r}))
    assert search().search(hill, 20, read_json(spark, path)["records"]) == whole


def facts(spark, late=False):
    rows = [(10 * t + i, i, 0, 5 + (i + t) % 4, t, "train") for t in range(12) for i in range(5)] + ([(999, 2, 0, 8, 9, "train")] if late else [])
    return G.inverse_augment(spark.createDataFrame(rows, "eid long, s long, r int, o long, t long, split string"), 1)


@pytest.mark.parametrize("gate", ["channel"])
def test_encodings_are_refreshed_where_facts_changed(spark, tmp_path, gate):
    quads = facts(spark)
    g = G.graph_of(quads.where("r = 0"))
    cands = K.candidates(g.quads.where("t IN (8, 11)"), K.tiered(g, g.quads.where("t IN (8, 11)"), 3))
    asked = cands.select("s", "t", "r").unionByName(cands.select(F.col("cand").alias("s"), "t", "r"))
    model = E.EventModel(2, E.EventConfig(events=3, dim=4, gate=gate)).start()
    store = EncodingStore(spark, f"file://{tmp_path}", model)
    distinct = asked.select("s", "t").distinct().count()
    assert store.refresh(asked, quads) == distinct and store.refresh(asked, quads) == 0
    scores = lambda df: sorted(tuple(r) for r in df.select("qid", "cand_idx", F.round("score", 9)).collect())
    assert scores(E.event_scores(cands, quads, model, store.get(asked, quads))) == scores(E.event_scores(cands, quads, model))
    # a late fact of time 9 changes what nodes 2 and 8 look like at 11, and nothing at 8
    late = facts(spark, late=True)
    changed = {(r["s"], r["t"]) for r in store.missing(asked, late).collect()}
    assert changed == {(2, 11), (8, 11)} & {(r["s"], r["t"]) for r in asked.collect()} and changed
    assert scores(E.event_scores(cands, late, model, store.get(asked, late))) == scores(E.event_scores(cands, late, model))
    # another model has a store of its own, and runs that were cut off are not read
    assert EncodingStore(spark, f"file://{tmp_path}", E.EventModel(2, E.EventConfig(events=3, dim=4, gate=gate, seed=9)).start()).path != store.path
    runs = len(store.runs())
    (tmp_path / store.path.rsplit("/", 1)[1] / "halfway").mkdir()
    assert len(store.runs()) == runs
    with pytest.raises(ValueError):
        EncodingStore(spark, f"file://{tmp_path}", E.EventModel(2, E.EventConfig(cross="mean")))


def test_two_stores_must_agree(spark, tmp_path):
    rows = [(q, i, 10 * q + i, 0.1 * i) for q in range(4) for i in range(3)]
    schema = "qid long, cand_idx int, cand long, score double"
    put = lambda name, x: (lambda s: (s.write(spark.createDataFrame(x, schema), "test"), s)[1])(ScoreStore(spark, f"file://{tmp_path}/{name}"))
    a, b = put("a", rows), put("b", [(*r[:3], 1 - r[3]) for r in rows])
    got = {(r["qid"], r["cand_idx"]): (r["cand"], round(r["struct"], 6), round(r["time"], 6)) for r in both_stores(a, b, "test").collect()}
    assert got == {(q, i): (c, round(x, 6), round(1 - x, 6)) for q, i, c, x in rows}
    narrow = put("n", [r for r in rows if r[:2] != (1, 2)])
    with pytest.raises(ValueError, match="1 queries of test have other numbers"):
        both_stores(a, narrow, "test")
    assert both_stores(a, narrow, "test", same_width=False).count() == 11
    with pytest.raises(ValueError, match="1 queries of test are in"):
        both_stores(a, put("f", [r for r in rows if r[0] != 3]), "test")
    with pytest.raises(ValueError, match="other candidates"):
        both_stores(a, put("o", [(*r[:2], r[2] + (r[:2] == (2, 1)), r[3]) for r in rows]), "test")
    with pytest.raises(FileNotFoundError):
        both_stores(a, b, "val")


def test_figures_of_a_run(spark):
    run = RunMetrics(spark)
    for _ in range(2):
        with run.phase("score"):
            run.watch(spark.range(100), hits=(F.col("id") % 4 == 0).cast("int")).collect()
            run.add("jobs", 1)
    with run.phase("empty"):
        run.watch(spark.range(0), hits=F.col("id")).collect()
    rates = {"hit_rate": ("hits", "rows")}
    got = {(r["phase"], r["metric"]): r["value"] for r in run.table(rates).collect()}
    assert got["score", "rows"] == 200 and got["score", "hits"] == 50 and got["score", "hit_rate"] == 0.25 and got["score", "jobs"] == 2
    assert got["empty", "rows"] == 0 and ("empty", "hit_rate") not in got and got["score", "seconds"] > 0


def test_progress_of_streams(spark, tmp_path):
    seen = StreamProgress()
    spark.streams.addListener(seen)
    try:
        for i in range(3):
            spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").groupBy("id").count().writeStream.queryName("counted").outputMode("complete").format("memory").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(50):
            if seen.totals.get("counted", {}).get("rows") == 30:
                break
            __import__("time").sleep(0.2)
        assert seen.totals["counted"]["rows"] == 30 and seen.totals["counted"]["batches"] >= 3 and seen.totals["counted"]["state_rows"] == 30
    finally:
        spark.streams.removeListener(seen)


def test_candidates_of_sampled_queries_give_the_same_sample(spark):
    """Queries are chosen before their candidates are made: no candidate is made that nothing learns from."""
    rows = [(i, i % 7, i % 2, (3 * i) % 11, i // 40, "train") for i in range(200)]
    g = G.graph_of(spark.createDataFrame(rows, "eid long, s long, r int, o long, t long, split string"))
    config = N.TimeConfig(most_queries=30)
    few = N.sampled_queries(g.quads, config, 1)
    lists = [sorted(map(str, N.sampled_lists(K.sampled_candidates(g, q, 5), config, 1).collect())) for q in (g.quads, few)]
    assert lists[0] == lists[1] and 10 < few.count() == len(lists[0]) < 60


def test_rankers_make_candidates_of_what_they_read_only(spark, data, monkeypatch):
    """Learnt scores of a split are made for the queries that the ranker reads; scores, features and the ranker's rows stay those of all queries."""
    config = E.EventConfig(epochs=1, most_queries=40, most_candidates=5, events=3, dim=4, time_dim=4)
    monkeypatch.setattr(learning, "CONFIG", config)
    monkeypatch.setattr(L.read_queries, "__defaults__", ("eid", 30, 5))
    made, whole = [], learning.candidates
    monkeypatch.setattr(learning, "candidates", lambda g, q: made.append(q.count()) or whole(g, q))
    g, quads, q = learning.parts(spark, data)
    _, scores = learning.learnt_scores(spark, data)
    assert len(made) == 7 and max(made[:6]) < 80 < made[6] == q["test"].count()
    every = {n: whole(g, df) for n, df in q.items()}
    full = dict(zip(("suffix", "val", "test"), E.out_of_fold(every["prefix"], every["suffix"], [every["val"], every["test"]], quads, 2 * g.num_rels, config), strict=True))
    rows = lambda df, time: {(r["qid"], r["cand_idx"], r["cand"]): r[time] for r in df.collect()}
    for n, df in full.items():
        own, all_ = rows(scores[n], "time"), rows(df, "score")
        assert own == pytest.approx({k: all_[k] for k in own}) and (n != "test" or len(own) == len(all_))
        if n != "test":
            plain = df.withColumn("x", F.col("cand").cast("double"))
            assert L.matrix(plain, ["x"], 30)[0].tolist() == L.matrix(scores[n].withColumn("x", F.col("cand").cast("double")), ["x"], 30)[0].tolist()
    # a rescue ranker chooses among the queries that it can reach
    _, reached = learning.learnt_scores(spark, data, rescue=True)
    struct = learning.with_struct(g, every["suffix"])
    pick = lambda df: L.matrix(X.rescue_rows(df, learning.RESCUED, score="struct", fair=True), ["struct"], 30)
    assert all((a == b).all() for a, b in zip(pick(struct), pick(reached["suffix"]), strict=True)) and reached["suffix"].select("qid").distinct().count() < 80
