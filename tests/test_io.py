"""Readers, stores, names and streams."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quadrill.functions import encoding, naming
from quadrill.operators import history as H
from quadrill.operators import ppr as P
from quadrill.sources import readers, stores
from quadrill.streaming import stateful as S


def test_tkg_files(spark, tmp_path):
    (tmp_path / "stat.txt").write_text("4 2 0\n")
    (tmp_path / "train.txt").write_text("0\t0\t1\t0\t9\n1 1 2 24\n\n")
    (tmp_path / "valid.txt").write_text("2 0 3 48\n")
    (tmp_path / "test.txt").write_text("3 1 0 72\n")
    g = readers.load(spark, "tkg", f"file://{tmp_path}")
    assert (g.num_nodes, g.num_rels_raw, g.num_rels) == (4, 2, 4)
    rows = sorted((r.s, r.r, r.o, r.t, r.split, r.inverse) for r in g.quads.collect())
    assert len(rows) == 8 and (0, 0, 1, 0, "train", 0) in rows and (0, 3, 3, 3, "test", 1) in rows
    with pytest.raises(ValueError):
        readers.load(spark, "nothing", "x")


def test_thg_files(spark, tmp_path):
    for s, rows in (("train", "0,0,5,1\n1,1,6,2\n"), ("valid", "0,1,6,3\n"), ("test", "1,0,5,4\n")):
        (tmp_path / f"{s}_events.csv").write_text("user_id,rel_id,business_id,ts\n" + rows)
    (tmp_path / "model_input_stats.json").write_text(json.dumps({"num_entities_user_business_disjoint": 7, "num_relations": 2, "business_id_range": [5, 6], "relation2id": {}}))
    g = readers.load(spark, "thg", f"file://{tmp_path}")
    assert (g.first_dst, g.last_dst, g.num_dst, g.quads.count()) == (5, 6, 2, 4)
    assert readers.read_friend_edges(spark, f"file://{tmp_path}/none.csv").count() == 0


def test_score_store(spark, tmp_path):
    rows = [(1, 0, 7, 1e-15), (1, 1, 8, 0.0), (1, 2, 9, 0.5), (2, 0, 7, 0.25), (2, 1, 8, 0.125)]
    df = spark.createDataFrame(rows, "qid long, cand_idx int, cand long, score double")
    store = stores.ScoreStore(spark, f"file://{tmp_path}/store")
    assert not store.complete(["test"])
    with pytest.raises(FileNotFoundError):
        store.read("test")
    store.write(df, "test")
    assert store.complete(["test"]) and store.read("test").count() == 4
    assert sorted((r.qid, r.cand_idx, r.score) for r in store.dense("test").collect())[1] == (1, 1, 0.0)
    assert store.read("test", first=2).count() == 2 and store.dense("test", width=2).count() == 4
    assert store.evaluate("test").first()["hit1_strict"] == 0.5
    store.copy(f"file://{tmp_path}/copy", "test")
    assert stores.ScoreStore(spark, f"file://{tmp_path}/copy").dense("test").count() == 5
    with pytest.raises(ValueError):
        store.write(df.withColumn("score", F.lit(float("nan"))), "bad")


def test_documents_and_cache(spark, tmp_path):
    path = f"file://{tmp_path}/c.json"
    stores.write_json(spark, path, {"format": "x1", "b": 1, "a": [2]})
    assert stores.read_json(spark, path, ("a", "b"), "x1")["_hash"] == naming.stable_hash({"a": [2], "format": "x1", "b": 1})
    with pytest.raises(ValueError):
        stores.read_json(spark, path, ("c",))
    cache, calls = stores.ResultCache(spark, f"file://{tmp_path}/cache"), []
    make = lambda: calls.append(1) or spark.range(3)
    assert cache.get({"k": 1}, make).count() == cache.get({"k": 1}, make).count() == 3 and len(calls) == 1


def test_names():
    assert naming.metric_key("MRR") == "mrr_strict" and naming.metric_key("HR@1") == "hit1_strict" and naming.metric_key("hit@10_loose") == "hit10_loose"
    with pytest.raises(ValueError):
        naming.metric_key("auc")
    assert naming.run_name({"b": 2, "a": 1}) == "a=1_b=2" and len(naming.run_name({"k": "x" * 300})) < 120
    assert naming.parse_overrides(["a=true", "b=[1, 2]", "c=none", "d=x"]) == {"a": True, "b": [1, 2], "c": None, "d": "x"}


def test_calendar_periods():
    assert encoding.calendar_periods(864_000.0) == pytest.approx([86_400.0, 604_800.0, 2_592_000.0, 31_536_000.0])  # a raw clock in seconds
    assert encoding.calendar_periods(5.0) == [1.0, 7.0, 30.0, 365.0]  # in days
    assert encoding.calendar_periods(864_000.0, 10.0) == pytest.approx([1.0, 7.0, 30.0, 365.0])  # ten days as ten steps
    assert encoding.calendar_periods(200.0, 1.0) == pytest.approx([1 / 200, 7 / 200, 30 / 200, 365 / 200])  # the whole span as one
    assert encoding.calendar_periods(200.0, 200.0) == encoding.calendar_periods(0.0, 0.0) == [1.0, 7.0, 30.0, 365.0]
    assert encoding.multiscale_frequencies(2, 1, 10) == pytest.approx([2 * 3.141592653589793 / 10]) and encoding.multiscale_frequencies(6, 1.0, 100.0)[-1] == pytest.approx(2 * 3.141592653589793)
    for bad in (lambda: encoding.multiscale_frequencies(3), lambda: encoding.periodic_frequencies([]), lambda: encoding.periodic_frequencies([7], 0)):
        with pytest.raises(ValueError):
            bad()


@pytest.fixture
def stream(spark, tmp_path):
    """The same facts as a stream of snapshots, a file each, and as a table."""
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(5), rnd.randrange(2), rnd.randrange(5), t) for i, t in enumerate(sorted(rnd.randrange(3) for _ in range(40)))]
    path, schema = f"file://{tmp_path}/in", "eid long, s long, r int, o long, t long"
    for t in range(3):
        spark.createDataFrame([r for r in rows if r[4] == t], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


def test_decayed_stream(spark, stream):
    live, batch = stream
    q = S.decayed_stream(live, 0.5).writeStream.outputMode("update").format("memory").queryName("shares").start()
    q.processAllAvailable()
    q.stop()
    last = {(r.s, r.r, r.o): (r.t, r.weight) for r in spark.table("shares").orderBy("t").collect()}
    want = {(r.s, r.r, r.o): r.weight for r in H.decayed_state(batch, 0.5).collect()}
    assert {k: pytest.approx(v[1]) for k, v in last.items()} == want


def rows_of(df):
    return sorted((r.node, r.key, round(r.score, 9), r.tag) for r in df.collect())


def test_snapshot_fold(spark, stream, tmp_path):
    """The fold of a stream is the fold of its table; a driver that starts anew goes on where the last one ended."""
    live, batch = stream
    cfg = P.PprConfig(alpha=0.1, beta=0.9)
    fold = S.SnapshotFold(spark, f"file://{tmp_path}/fold", cfg)
    S.start_fold(live, fold, f"file://{tmp_path}/ck").awaitTermination()
    for _, state in P.prequential(batch, cfg):
        want = state
    assert rows_of(fold.state) == rows_of(want)
    more = spark.createDataFrame([(100 + i, i % 5, i % 2, (i + 1) % 5, 3) for i in range(9)], "eid long, s long, r int, o long, t long")
    more.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    again = S.SnapshotFold(spark, f"file://{tmp_path}/fold", cfg)
    assert rows_of(again.state) == rows_of(want)
    S.start_fold(live, again, f"file://{tmp_path}/ck").awaitTermination()
    for _, state in P.prequential(batch.unionByName(more), cfg):
        want = state
    assert rows_of(again.state) == rows_of(want)
    # a batch that comes twice is folded once; one that goes back in time is refused
    again.write(more, again.done["batch"])
    assert rows_of(again.state) == rows_of(want)
    with pytest.raises(ValueError):
        again.write(more, again.done["batch"] + 1)


def test_recent_stream(spark, stream):
    live, batch = stream
    q = S.recent_stream(live, 3).writeStream.outputMode("update").format("memory").queryName("lasts").start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("lasts").collect():
        got.setdefault(r.node, {}).setdefault(r.place, []).append((r.event_t, r.neighbor))
    for s in {r.s for r in batch.select("s").collect()}:
        past = sorted(((r.t, r.eid, r.o) for r in batch.where(F.col("s") == s).collect()), reverse=True)[:3]
        assert all((t, o) in got[s][i + 1] for i, (t, _, o) in enumerate(past))


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    rnd = random.Random(5)
    lines = [f"{rnd.randrange(9)} 0 {rnd.randrange(9)} {i // 50}" for i in range(3000)]
    (tmp_path / "x.txt").write_text("\n".join(lines) + "\n")
    path, before = f"file://{tmp_path}/x.txt", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "1000b", "4096b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = sorted((r.line, r.s, r.o, r.t) for r in readers.read_quads(spark, path).collect())
            assert rows == [(i, int(x.split()[0]), int(x.split()[2]), int(x.split()[3])) for i, x in enumerate(lines)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_small_readers_and_writers(spark, tmp_path):
    from quadrill.functions import entities
    from quadrill.graph import graph_of

    (tmp_path / "p.csv").write_text("business_id,latitude,longitude\n7,1.5,2.5\n5,0.5,0.25\n")
    (tmp_path / "model_input_stats.json").write_text(json.dumps({"relation2id": {"likes": 0, "visits": 1}}))
    (tmp_path / "d.tsv").write_text("alpha\t0\nbeta\t1\n")
    for i in (2, 10):
        (tmp_path / f"runs/data/seed{i}/run").mkdir(parents=True)
    assert [r.business_id for r in readers.read_places(spark, f"file://{tmp_path}/p.csv").collect()] == [5, 7]
    assert readers.read_relations(spark, f"file://{tmp_path}") == {"likes": 0, "visits": 1}
    assert [x.rsplit("/", 2)[1] for x in readers.run_folders(spark, f"file://{tmp_path}/runs")] == ["seed10", "seed2"]
    q = spark.createDataFrame([(0, 0, 0, 1, 0, "train"), (1, 5, 0, 1, 1, "train"), (2, 0, 3, 1, 2, "val"), (3, -1, 0, 1, 3, "val")], "eid long, s long, r int, o long, t long, split string")
    assert [r.eid for r in readers.in_bounds(q, 3, 2).collect()] == [0]
    named = entities.with_names(q, readers.read_dictionary(spark, f"file://{tmp_path}/d.tsv"), "r")
    assert sorted((r.eid, r.name) for r in named.collect()) == [(0, "alpha"), (1, "alpha"), (2, None), (3, "alpha")]
    g = graph_of(q)
    spark.createDataFrame([(0, 0, 0, [0, 1])], "t long, s long, r int, negatives array<long>").write.parquet(f"file://{tmp_path}/neg")
    assert sorted((r.neg_idx, r.cand) for r in readers.read_negatives(spark, f"file://{tmp_path}/neg", g).collect()) == [(1, 0), (2, 1)]
    spark.createDataFrame([(0, 0, 0, [9])], "t long, s long, r int, negatives array<long>").write.parquet(f"file://{tmp_path}/bad")
    with pytest.raises(ValueError):
        readers.read_negatives(spark, f"file://{tmp_path}/bad", g)
    cache, made = stores.ResultCache(spark, f"file://{tmp_path}/neg_cache"), []
    for q_, seed in ((5, 1), (5, 1), (5, 2), (6, 1)):
        stores.cached_negatives(cache, "d", "val", q_, seed, 1.0, lambda: made.append(1) or spark.range(1))
    assert len(made) == 3
    names = spark.createDataFrame([(1, "Police (Chad)"), (2, "Chad")], "id long, name string")
    edges = entities.word_edges(names)
    stores.write_word_graph(entities.word_ids(edges), entities.word_graph(edges), f"file://{tmp_path}/words")
    back = spark.read.csv(f"file://{tmp_path}/words/e-w-graph", sep="\t", schema="e long, role int, w long")
    assert sorted(map(tuple, back.collect())) == [(1, 0, 1), (1, 1, 0), (2, 2, 0)]
    with pytest.raises(ValueError):
        readers.load(spark, "tkg", "x", q=-2)


def test_component_store(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 7, 0.5, 0.25), (1, 1, 8, 0.0, 1.0)], "qid long, cand_idx int, cand long, dsh double, dmh double")
    root, calls = f"file://{tmp_path}/parts", []
    store = stores.ComponentStore(spark, root, {"a": 1})
    make = lambda: calls.append(1) or df
    assert not store.holds("test") and store.get("test", make, ("dsh",)).count() == store.get("test", make, ("dsh",)).count() == 2 and len(calls) == 1
    assert not store.holds("test", ("shared",)) and not stores.ComponentStore(spark, root, {"a": 2}).holds("test")
    with pytest.raises(FileNotFoundError):
        store.read("val")
    with pytest.raises(ValueError):
        store.put("val", df.withColumn("dmh", F.lit(float("inf"))))
    assert not store.holds("val")
    # a second run replaces the first by its document alone; without a whole folder there is no split
    store.put("test", df.withColumn("dsh", F.lit(0.75)))
    assert {r.dsh for r in store.read("test").collect()} == {0.75}
    path = store.path.removeprefix("file://")
    meta = json.loads(open(f"{path}/test.json").read())
    os.remove(f"{path}/{meta['run']}/_SUCCESS")
    assert not store.holds("test")
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a").write_text("x")
    one = stores.fingerprint(spark, f"file://{tmp_path}/f")
    (tmp_path / "f/a").write_text("xyz")
    assert stores.fingerprint(spark, f"file://{tmp_path}/f") != one


@pytest.fixture
def rocksdb(spark):
    from quadrill.streaming import keyed

    keyed.use_rocksdb(spark)
    yield keyed
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_decayed_values_by_target(spark, stream, rocksdb):
    """Only touched targets are given out; with their last rows they make up the whole table's shares."""
    live, batch = stream
    q = rocksdb.decayed_values(live, 0.5).writeStream.outputMode("update").format("memory").queryName("values_by_target").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("values_by_target")
    got = {(r.s, r.r, r.o): r.weight for r in rocksdb.latest_shares(rows, 0.5).collect()}
    want = {(r.s, r.r, r.o): r.weight for r in H.decayed_state(batch, 0.5).collect()}
    assert got == pytest.approx(want)
    touched = {(r.s, r.r, r.o, r.t) for r in batch.select("s", "r", "o", "t").distinct().collect()}
    assert {(r.s, r.r, r.o, r.t) for r in rows.collect() if (r.s, r.r, r.o, r.t) in touched} == touched and rows.count() <= len(touched)


def test_last_events_as_a_list(spark, stream, rocksdb):
    live, batch = stream
    q = rocksdb.recent_events(live, 3).writeStream.outputMode("update").format("memory").queryName("last_as_list").start()
    q.processAllAvailable()
    q.stop()
    got, newest = {}, {r.s: r.t for r in batch.groupBy("s").agg(F.max("t").alias("t")).collect()}
    for r in spark.table("last_as_list").collect():
        got.setdefault(r.node, []).append(r)
    for s, t in newest.items():
        want = [(r.t, r.r, r.o) for r in batch.where(F.col("s") == s).orderBy(F.desc("t"), F.desc("eid")).limit(3).collect()]
        assert all(x in [(r.event_t, r.r, r.neighbor) for r in got[s]] for x in want) and max(r.event_t for r in got[s]) == t
