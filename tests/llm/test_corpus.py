"""Operators on whole tables: nearest neighbours, near duplicates, decontamination, mixtures, archives, the pipeline."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrill.llm import ann, components, decontaminate, jaccard, mixing, pii, shingles, warc
from quadrill.llm.common import new_path, table

SMALL = "/root/testdata/sf0.001"


def sql_rows(df, sql, **tables):
    """How many rows ``df`` has, which must be those of the SQL over the tables (columns, rows)."""
    con = duckdb.connect()
    for name, (cols, rows) in tables.items():
        frame = pd.DataFrame(rows, columns=cols)  # noqa: F841  read by name
        for c in cols:
            if c.endswith("_id"):
                frame[c] = frame[c].astype("Int64")
            else:
                frame[c] = frame[c].astype("string")
        con.register(f"{name}_frame", frame)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_frame")
    cols = sorted(df.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall(), key=key)
    assert got == want
    return len(got)


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# nearest neighbours


def brute_nearest(rows, queries, k):
    x = {i: np.array(v) for i, v in rows}
    out = {}
    for q in queries:
        if q in x:
            s = sorted(((-float(x[q] @ v), i) for i, v in x.items() if i != q and len(v) == len(x[q])))[:k]
            out[q] = [i for _, i in s]
    return out


def test_ann_recall(spark):
    v = table(spark, "/root/testdata/sf0.01", "embeddings")
    got = ann.op1_ann(spark, "/root/testdata/sf0.01").collect()
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in v.collect()]
    want = brute_nearest(rows, [i for i, _ in rows if i % 20 == 0], 20)
    mine = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        mine[r.query_id].append(r.vec_id)
    assert mine.keys() == want.keys() and np.mean([len(set(mine[q]) & set(want[q])) / 20 for q in want]) >= 0.95
    x = dict(rows)
    assert all(abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-12 for r in got)


def test_ann_odd_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, "x") for i in range(40)] + [(40, None, None), (41, [0.0, 0.0, 0.0], ""), (42, [1.0, None, 2.0], ""), (43, [float("nan"), 1.0, 1.0], ""), (44, [float("inf"), 1.0, 1.0], ""), (45, [], ""), (None, same, ""), (60, [5.0, 5.0], ""), (61, [1.0, 1.0], ""), (80, [9.0, 0.0, 0.0], ""), (0, same, "x"), (81, [-1.0, 0.0, 0.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in sorted(ann.search_all(df, df.where("vec_id % 20 = 0"), k=20).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
    assert got[0] == list(range(1, 21)) and got[20] == list(range(20)) and got[80] == list(range(20)) and got[60] == [61]
    assert set(got) == {0, 20, 60, 80}
    assert ann.search_all(df.limit(0), df.limit(0)).count() == 0


def test_ann_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 100)
    monkeypatch.setattr(ann, "BLOCK", 10)
    got = ann.op1_ann(spark, SMALL).collect()
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in table(spark, SMALL, "embeddings").collect()]
    want = brute_nearest(rows, [i for i, _ in rows if i % 20 == 0], 20)
    hit = defaultdict(set)
    for r in got:
        hit[r.query_id].add(r.vec_id)
    assert np.mean([len(hit[q] & set(want[q])) / 20 for q in want]) >= 0.95


def test_ann_lengths_and_real_shards(spark):
    """Several shards of the real size, lengths of several magnitudes, one vector 10,000 times longer, all far beyond what squares in single precision hold."""
    r = np.random.default_rng(3)
    n = 26_000
    x = r.normal(size=(40, 12))[r.integers(0, 40, n)] + 0.4 * r.normal(size=(n, 12))
    x *= np.exp(r.normal(0, 0.3, (n, 1))) * 1e30
    x[7] *= 1e4
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for row in sorted(ann.search_all(df, df.where("vec_id % 100 = 0")).collect(), key=lambda row: row["rank"]):
        got[row.query_id].append(row.vec_id)
    near = x[::100] @ x.T
    near[np.arange(len(near)), np.arange(0, n, 100)] = -np.inf
    want = {100 * i: np.argsort(-s)[:20] for i, s in enumerate(near)}
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.95


def test_ann_rows_of_one_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [2.0, 0.5]), (2, [0.5, 2.0]), (2, [0.5, 2.0]), (3, [1.0, 1.0]), (3, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search_all(df, df.where("vec_id = 20")).collect())
    assert got == sorted([(20, i + 1, v, s) for own in ([(3, 3.0), (1, 2.0), (3, 1.0), (2, 0.5)], [(3, 3.0), (2, 2.0), (3, 1.0), (1, 0.5)]) for i, (v, s) in enumerate(own)])


# near duplicates


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows):
    sets = {i: plain_set(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_shingles_match_plain_python():
    r = random.Random(5)
    texts = [None, "", " \t\n", "One", "one TWO", "ÀÉ à é", "a b c d e", "a b c d e f", "A b C d e F", "a b c d", "x" * 100_000, "w " * 50_000] + [" ".join(r.choice(["a", "B", "cc", "é"]) for _ in range(r.randint(1, 30))) for _ in range(300)]
    got = [len(s) for s in shingles.shingle_sets(texts)]
    assert got == [len(plain_set(t)) for t in texts]
    sets = list(shingles.shingle_sets(texts))
    for i in range(0, 300, 7):
        for j in range(0, 300, 11):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain_set(texts[i]) & plain_set(texts[j]))


def near_copies(seed, groups=12, words=60):
    """Texts in groups of near copies, chains of copies of copies, exact copies and texts that share a passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    rows, i, passage = [], 0, [word() for _ in range(40)]
    for g in range(groups):
        base = [word() for _ in range(r.randint(6, words))]
        current = base
        for _ in range(r.randint(2, 14)):
            text = list(current if r.random() < 0.5 else base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                text[r.randrange(len(text))] = word()
            if r.random() < 0.2:
                text = text + passage
            current = text[:]
            rows.append((i, " ".join(text)))
            i += r.randint(1, 3)
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components(spark, seed, monkeypatch):
    if seed == 3:  # bins that are crowded
        monkeypatch.setattr(jaccard, "crowded", lambda counts: 3)
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "only three words"), (4, "Only THREE words"), (5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (6, "w" * 50_000), (7, "tok " * 30_000)]
    got = jaccard.joined(docs(spark, rows).withColumn("component_id", F.lit("x"))).collect()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert len(got) == len(rows) and by[1, 0] == 1 and by[2, 0] == 2 and by[4, 1] == 3 and by[5, 3] == 5 and by[None, 3] is None and by[7, 1] == 7
    assert jaccard.joined(docs(spark, [])).count() == 0
    kept = jaccard.one_of_each(docs(spark, rows).withColumn("version", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "version"] and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7]


def test_one_of_each_tells_texts_of_an_id_apart(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, text), (2, text), (2, other), (2, other), (3, None), (3, None), (4, text + " more")]
    assert sorted((r.doc_id, (r.text or "")[:2]) for r in jaccard.one_of_each(docs(spark, rows)).collect()) == [(1, "w0"), (2, "v0"), (3, ""), (3, "")]


def test_jaccard_joins_many_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_FILTERED", 3)
    rows = near_copies(9, groups=6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_shared_counts_across_batches(spark):
    r = random.Random(3)
    sets = [(i % 50, sorted(r.sample(range(200), 12))) for i in range(300)]
    df = spark.createDataFrame([(h, t) for h, t in sets], "h1 long, tokens array<long>")
    owners = defaultdict(set)
    for h, tokens in sets:
        for t in tokens:
            owners[t].add(h)
    want = defaultdict(int)
    for own in owners.values():
        for h in own if len(own) > 1 else ():
            want[h] += 1
    before = spark.conf.get(jaccard.BATCH)
    try:
        for size in ("1", "7", "5000"):
            spark.conf.set(jaccard.BATCH, size)
            assert {x.h1: x.shared for x in jaccard.shared_counts(df).collect()} == want
    finally:
        spark.conf.set(jaccard.BATCH, before)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (205, 200), (205, 210)] + [(300, i) for i in range(301, 340)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == 100 and got[210] == 200 and got[339] == 300
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# decontamination


def test_decontamination(spark):
    item = "On Monday Anna Berg bought 12 apples and 7 pears at the small market near the old bridge and paid 30 euros for all of them"
    other = "On Monday Carl Moe bought 95 apples and 3 pears at the small market near the old bridge and paid 41 euros for all of them"
    mixed = "quite another story about a river that runs through the hills and never meets the sea in any year we know"
    rows = [(1, "Intro text. " + item + " The end."), (2, "x y z. " + other), (3, mixed), (4, None), (5, ""), (6, "filler words here " * 3000 + item), (6, "again " + item), (None, item), (7, "the small market near the old bridge")]
    bench = spark.createDataFrame([(10, item), (11, "some plain words only"), (12, ""), (13, None), (None, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs(spark, rows).withColumn("hash", F.lit(1)), bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (6, 10)}
    assert got[1, 10].changed == 0 and got[2, 10].changed == 4 and got[1, 10].matched == got[1, 10].item_windows
    kept = sorted((r.doc_id or 0) for r in decontaminate.keep_clean(docs(spark, rows), bench).collect())
    assert kept == [0, 3, 4, 5, 7]
    assert decontaminate.contaminated(docs(spark, [(1, "some plain words only")]), bench).count() == 1
    assert decontaminate.contaminated(docs(spark, []), bench).count() == decontaminate.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_inconsistent_slots_are_no_leak(spark):
    item = "take 5 red balls and 5 blue balls then add 5 green balls to the same 5 old boxes"
    wrong = "take 1 red balls and 2 blue balls then add 3 green balls to the same 4 old boxes"
    right = "take 8 red balls and 8 blue balls then add 8 green balls to the same 8 old boxes"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(docs(spark, [(1, wrong), (2, right)]), bench).collect()] == [2]


def test_look_alikes_clear_no_copy(spark):
    item = "take 5 red balls and 5 blue balls then add 5 green balls to the same 5 old boxes"
    wrong = "take 1 red balls and 2 blue balls then add 3 green balls to the same 4 old boxes"
    tail = "and then take 7 black stones to the very end of the long dark road"
    bench = spark.createDataFrame([(1, item), (2, f"{item} {tail}")], "item_id long, text string")
    # in 4 a word is put in, so no single shift covers half of item 2
    rows = [(1, f"{item} {wrong}"), (2, f"{wrong} {item} {wrong}"), (3, f"{wrong} and {wrong}"), (4, f"{item} please {tail} " + "x " * 20 + f"{wrong} {tail}")]
    got = {(r.doc_id, r.item_id): (r.slots, r.changed) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert {(1, 1), (2, 1), (4, 1), (4, 2)} <= set(got) and not any(i == 3 for i, _ in got) and got[1, 1] == got[2, 1] == (1, 0) and got[4, 2] == (2, 0)


def test_items_short_of_words_are_found_as_copies(spark):
    items = ["What is 12 plus 34 minus 5?", "Who wrote Hamlet?", "Maria Lopez paid 12 USD to John Smith on 5 May 2020", "Paris", "7 8"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(10 + i, f"some words before, {x} And some after.") for i, x in enumerate(items)]
    rows += [(20, "What is 12 plus 34 minus 6?"), (21, "Who wrote Faust?"), (22, "Maria Lopez paid 12 USD to John Smith on 5 May 2021"), (23, None), (24, "Hamlet"), (10, "other"), (25, "y " * 50 + items[2] + " and " + items[2])]
    got = {(r.doc_id, r.item_id): (r.item_windows, r.matched, r.changed) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(10, 0): (1, 1, 0), (11, 1): (1, 1, 0), (12, 2): (1, 1, 0), (25, 2): (1, 1, 0)}


def test_names_are_compared_whole(spark):
    item = "Anna Berg had six red balls and gave some of the balls to Anna Berg after the long game"
    other = "Anna Moe had six red balls and gave some of the balls to Anna Moe after the long game"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.changed for r in decontaminate.contaminated(docs(spark, [(1, item), (2, other)]), bench).collect()}
    assert got == {1: 0, 2: 1}


def test_keep_clean_keeps_other_texts_of_an_id(spark):
    item = "quite a long benchmark question about rivers and hills that nobody would write by chance"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item), (1, "another text"), (1, "another text"), (None, item), (2, None)]
    kept = decontaminate.keep_clean(docs(spark, rows).withColumn("pos", F.lit(1)), bench)
    assert kept.columns == ["doc_id", "text", "pos"] and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, item), (1, "another text"), (1, "another text"), (2, "")]


def test_decontamination_matches_sql(spark):
    """Short items, items of placeholders, several alignments, repeats and long texts against SQL."""
    item = "take 5 red balls and 5 blue balls then add 5 green balls to the same 5 old boxes"
    wrong = "take 1 red balls and 2 blue balls then add 3 green balls to the same 4 old boxes"
    tail = "and then take 7 black stones to the very end of the long dark road"
    items = [item, f"{item} {tail}", "What is 12 plus 34 minus 5?", "Who wrote Hamlet?", "Maria Lopez paid 12 USD to John Smith on 5 May 2020", "Paris", "7 8", "some plain words only", "Anna Berg paid Carl Moe", "", None, "six small stones fell down"]
    r = random.Random(8)
    pieces = [x for x in items if x] + [wrong, tail, "Anna Berg paid Olaf Moe", "seven small stones fell down", "one two", "Who wrote Faust?", "some plain words"]
    rows = [(i, " ".join(r.choice(pieces) if r.random() < 0.6 else r.choice(["and", "x", "9", "Bob"]) for _ in range(r.randint(0, 9)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "pad " * 20_000 + item), (203, (item + "\n") * 50), (204, (wrong + " ") * 20 + item)]
    assert sql_rows(decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")), decontaminate.OP3_SQL, documents=(["doc_id", "text"], rows), benchmark=(["item_id", "text"], list(enumerate(items)))) > 60


# mixtures


def brute_quota(supply, weights, budget):
    """Pour the budget into the leaves in small equal steps of each family's level: what a node takes is split among its children that aren't full, by weight."""

    def room(node):
        if node in supply:
            return supply[node]
        return sum(room(k) for k in kids[node] if weights.get(k, 1.0) > 0)

    kids = defaultdict(set)
    for leaf in supply:
        for d in range(len(leaf)):
            kids[leaf[:d]].add(leaf[: d + 1])

    def pour(node, amount, out):
        if node in supply:
            out[node] = min(amount, supply[node])
            return
        able = [k for k in kids[node] if weights.get(k, 1.0) > 0]
        low, high = 0.0, 1e12
        for _ in range(200):  # the level up to which all children are filled, by bisection
            level = (low + high) / 2
            if sum(min(room(k), level * weights.get(k, 1.0)) for k in able) < amount:
                low = level
            else:
                high = level
        for k in able:
            pour(k, min(room(k), high * weights.get(k, 1.0)), out)

    out = dict.fromkeys(supply, 0.0)
    if supply:
        pour((), min(budget, room(())), out)
    return out


def brute_mix(rows, path, weights, share, epochs, seed):
    """Take whole epochs, then documents in the order of their hash while the tokens before are fewer than the budget."""
    place = lambda i, e: int(hashlib.md5(f"{seed}|{e}|{'' if i is None else i}".encode()).hexdigest()[:10], 16)
    size = lambda r: len(re.findall(r"[^ \t\n\x0b\f\r]+", r["text"] or ""))
    have = defaultdict(int)
    for r in rows:
        have[path(r)] += size(r)
    have = {k: v for k, v in have.items() if v}
    quota = brute_quota({k: float(v * epochs) for k, v in have.items()}, weights, share * sum(have.values()))
    out = []
    for leaf, total in have.items():
        own = [r for r in rows if path(r) == leaf and size(r)]
        for epoch in range(1, epochs + 1):
            left, so_far = round(quota[leaf], 3) - total * (epoch - 1), 0
            for r in sorted(own, key=lambda r: (place(r["doc_id"], epoch), r["doc_id"])):
                if left >= total or so_far < left - 1e-6:
                    out.append((r["doc_id"], epoch))
                so_far += size(r)
    return sorted(out)


@pytest.mark.parametrize(("share", "few"), [(0.3, True), (0.8, False), (1.7, True)])
def test_mix(spark, share, few, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 3)
    if not few:  # more leaves than are broadcast: joined with salted keys
        monkeypatch.setattr(mixing, "MOST_BROADCAST", 1)
    d = table(spark, SMALL, "documents").select("doc_id", "lang", "source", "text").withColumn("mix_tokens", F.lit("old"))
    rows = [r.asDict() for r in d.collect()]
    weights = {("en",): 5.0, ("fr", "src1"): 0.0, ("de",): 0.0, ("es", "src2"): 3.0}
    got = mixing.mix(d, [F.col("lang"), F.col("source")], weights, share=share, epochs=3, seed=17).collect()
    assert sorted((r.doc_id, r.mix_epoch) for r in got) == brute_mix(rows, lambda r: (r["lang"], r["source"]), weights, share, 3, 17)
    assert all(r.mix_tokens == len(r.text.split()) for r in got)


def quotas(spark, supply, weights, budget):
    df = spark.createDataFrame([(*k, v) for k, v in supply.items()], "a string, b string, supply double")
    return {(r.a, r.b): r.quota for r in mixing.allocate(df, ["a", "b"], weights, budget).collect()}


def test_allocation(spark):
    supply = {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "x"): 5.0, ("b", "y"): 5.0}
    got = quotas(spark, supply, {}, 60)
    assert got == {("a", "x"): 10.0, ("a", "y"): 40.0, ("b", "x"): 5.0, ("b", "y"): 5.0}  # siblings first, then the other family
    assert sum(quotas(spark, supply, {("b",): 0.0}, 1000).values()) == 110.0
    # what a child of weight 0 leaves goes up to the other family
    assert quotas(spark, {("A", "a1"): 90.0, ("A", "a2"): 10.0, ("B", "b"): 100.0}, {("A", "a1"): 0.0}, 100) == {("A", "a1"): 0.0, ("A", "a2"): 10.0, ("B", "b"): 90.0}
    assert quotas(spark, supply, {("a",): 0.0, ("b",): 0.0}, 50) == dict.fromkeys(supply, 0.0)
    r = random.Random(6)
    for _ in range(4):
        supply = {(f"p{r.randrange(4)}", f"c{r.randrange(5)}"): float(r.randrange(1, 60)) for _ in range(14)}
        weights = {k: r.choice([0.0, 0.5, 1.0, 2.0, 7.0]) for leaf in supply for k in (leaf, leaf[:1]) if r.random() < 0.6}
        budget = r.choice([0.0, 20.0, 90.0, 200.0, 5000.0])
        want = brute_quota(supply, weights, budget)
        assert quotas(spark, supply, weights, budget) == {k: pytest.approx(v, abs=2e-3) for k, v in want.items()}


def test_mix_has_no_bound_on_leaves(spark):
    df = spark.range(120_000).selectExpr("id AS doc_id", "concat('l', id % 3) AS lang", "concat('s', id) AS source", "'a b' AS text")
    got = mixing.mix(df, [F.col("lang"), F.col("source")], share=0.5, epochs=1)
    assert got.count() == 120_000  # every leaf has a budget of half its one document, which is taken


def test_mix_odd_rows(spark):
    rows = [(1, None, None, "a b"), (1, None, None, "a b"), (2, "en", "s1", None), (3, "en", "s1", ""), (None, "en", "s1", "c d e"), (4, "en", "s1", "w " * 50_000)]
    df = docs(spark, rows, "doc_id long, lang string, source string, text string").withColumn("rest", F.lit(0))
    got = mixing.mix(df, mixing.document_path(), share=1.0, epochs=1).collect()
    assert sorted(r.mix_tokens for r in got) == [2, 2, 3, 50_000]
    assert mixing.mix(df.limit(0), mixing.document_path()).count() == 0
    assert mixing.mix(df, mixing.document_path(), {("domain?",): 0.0, ("domain1",): 0.0}, share=1.0).count() == 0


# archives


def test_archives(spark):
    rows = [(3, "http://a/é x", "same"), (1, "http://b", "same"), (2, None, None), (5, "u", ""), (4, "http://c", "x" * 500_000), (None, "n", "same"), (1, "http://b", "same"), (6, "p", "a\r\n\r\nWARC/1.1\r\nb")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit(1))
    raw, final, again = (new_path(spark, n) for n in ("raw", "final", "again"))
    files = warc.write_pages(df, raw)
    out = warc.deduplicate(spark, files, raw, final)
    got = warc.resolve(warc.headers(out, final, verify=True)).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == sorted(
        [(3, 4, "revisit", 1), (1, 4, "response", 0), (1, 4, "revisit", 1), (0, 4, "revisit", 1), (2, 0, "response", 0), (5, 0, "revisit", 2), (4, 500_000, "response", 0), (6, 16, "response", 0)]
    )
    assert all(re.fullmatch("[A-Z2-7]{32}", r.payload_digest) for r in got)
    # archives that hold revisits already keep them resolved
    more = warc.resolve(warc.headers(warc.deduplicate(spark, out, final, again), again, verify=True)).collect()
    assert sorted(map(repr, more)) == sorted(map(repr, got))
    for name in {r.file for r in out.collect()}:
        for _, _, data in warc.members(final, name):
            fields, block = warc.parse(data)
            assert len(block) == int(fields["content-length"]) and data.endswith(b"\r\n\r\n")


def test_small_payloads_stay(spark):
    df = spark.createDataFrame([(1, "a", "tiny"), (2, "b", "tiny"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    raw, final = new_path(spark, "raw"), new_path(spark, "final")
    out = warc.deduplicate(spark, warc.write_pages(df, raw), raw, final, least_bytes=5)
    assert {r.page_id: r.record_type for r in warc.resolve(warc.headers(out, final)).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    none = warc.write_pages(df.limit(0), new_path(spark, "none"))
    assert none.count() == 0


def test_archives_odd_tables(spark):
    none = docs(spark, [], "page_id long, url string, html string")
    raw, final = new_path(spark, "raw"), new_path(spark, "final")
    out = warc.deduplicate(spark, warc.write_pages(none, raw), raw, final)
    assert out.count() == 0 and warc.resolve(warc.headers(out, final)).count() == 0
    ids = ["plain", "line\nbreak", " spaces ", "100%", "é/ü?", "a: b"]
    df = spark.createDataFrame([(x, f"http://h/{i}", "same text") for i, x in enumerate(ids)], "page_id string, url string, html string")
    raw, final = new_path(spark, "raw"), new_path(spark, "final")
    out = warc.deduplicate(spark, warc.write_pages(df, raw), raw, final, id_type="string")
    got = {r.page_id: r.refers_to for r in warc.resolve(warc.headers(out, final, verify=True), "string").collect()}
    assert got == {x: None if x == min(ids) else min(ids) for x in ids}


# pipeline


def plain_stage(name, rows, benchmark):
    """The rows of a stage's result, in plain Python or DuckDB; texts are single by id here."""
    import corpus_pipeline as C

    by = {r["doc_id"]: r for r in rows}
    if name == "language":
        learn = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] and r["text"] is not None]
        letters = {i for i, r in by.items() if any(c.isalpha() for c in r["text"] or "")}
        return {i: dict(by[i], lang=by[i]["lang"]) for i in letters} if learn else {}
    if name == "near_duplicates":
        keep = {i for i, (_, c) in brute_components([(i, r["text"]) for i, r in by.items()]).items() if c == i}
        return {i: by[i] for i in keep}
    if name == "benchmark_leaks":
        con = duckdb.connect()
        d = pd.DataFrame([(r["doc_id"], r["text"]) for r in rows], columns=["doc_id", "text"])  # noqa: F841
        b = pd.DataFrame(benchmark, columns=["item_id", "text"])  # noqa: F841
        con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text FROM d; CREATE TABLE benchmark AS SELECT item_id::BIGINT AS item_id, text::VARCHAR AS text FROM b")
        bad = {x for (x,) in con.execute(f"SELECT DISTINCT doc_id FROM ({decontaminate.OP3_SQL})").fetchall()}
        return {i: r for i, r in by.items() if i not in bad}
    if name == "personal_data":
        out = {}
        for i, r in by.items():
            (base, added), = pii.find([r["text"] or ""], *pii.model())
            chars = list(r["text"] or "")
            merged = []
            for a, z, kind in sorted(base + added):
                if merged and a < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z, kind])
            for a, z, kind in reversed(merged):
                chars[a:z] = [f"[{kind.upper()}]"]
            out[i] = dict(r, text="".join(chars), n_chars=len("".join(chars)))
        return out
    number = lambda x: re.search("([0-9]+)$", x or "")
    path = lambda r: (f"domain{int(number(r['source'])[1][-9:]) % 4}" if number(r["source"]) else "domain?", r["lang"], r["source"])
    return sorted(brute_mix(rows, path, mixing.WEIGHTS, C.SHARE, 3, 17))


def test_pipeline_stage_by_stage(spark):
    """Each stage, on what the one before it kept, against the plain version; then the whole run."""
    import corpus_pipeline as C

    odd = [(9001, None, "en", "src1", 0), (9002, "", "en", "src1", 0), (9003, "12 34 !!", "de", "src2", 8), (9004, "la casa " * 9000, "es", "src3", 72_000), (9005, "Who knows what this is about at all, here and there", None, None, 50)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    before = table(spark, SMALL, "documents").select(*C.COLUMNS).unionByName(spark.createDataFrame(odd, schema).select(*C.COLUMNS))
    benchmark = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    for name, stage in C.STAGES:
        rows = [r.asDict() for r in before.collect()]
        want = plain_stage(name, rows, benchmark)
        after = stage(spark, before.withColumns({"score": F.lit(1), "version": F.lit("x"), "hash": F.lit(2)}), SMALL)
        got = [r.asDict() for r in after.collect()]
        if name == "mixture":
            assert sorted((r["doc_id"], r["mix_epoch"]) for r in got) == want and all(r["text"] for r in got)
            break
        assert after.columns == C.COLUMNS and len(got) == len({r["doc_id"] for r in got})
        if name == "language":
            assert {r["doc_id"]: r for r in got if r["doc_id"] != 9005} == {k: v for k, v in want.items() if k != 9005}
            assert all(r["lang"] for r in got)
        else:
            assert {r["doc_id"]: r for r in got} == want
        before = spark.createDataFrame([tuple(r[c] for c in C.COLUMNS) for r in got], ", ".join(f"{c} {dict(after.dtypes)[c]}" for c in C.COLUMNS))
    assert C.run(spark, SMALL).count() > 100


def test_pipeline_odd_tables(spark, tmp_path):
    """Empty tables and repeated rows through every stage."""
    import corpus_pipeline as C

    docs_ = table(spark, SMALL, "documents")
    docs_.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SMALL, "benchmark").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, f"file://{tmp_path}").count() == 0
    twice = docs_.where("doc_id < 12").unionByName(docs_.where("doc_id < 12")).unionByName(docs_.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    sizes = []
    for name, stage in C.STAGES[1:]:
        twice = stage(spark, twice, f"file://{tmp_path}")
        twice = spark.createDataFrame(twice.collect(), twice.schema)
        sizes.append((name, twice.where("doc_id IS NULL").count(), twice.count()))
    assert sizes[:3] == [("near_duplicates", 3, 15), ("benchmark_leaks", 3, 15), ("personal_data", 3, 15)]


def test_folder_must_be_shared(spark, monkeypatch):
    from quadrill.llm import common

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *a: None)}))})

    with pytest.raises(ValueError):
        common.shared_dir(Elsewhere())


def test_op4_matches_sql(spark):
    rows = [(i, "w " * (i % 7) + "é\u00a0x", None if i % 5 == 0 else f"l{i % 3}", None if i % 11 == 0 else f"src{i % 9}") for i in range(120)]
    rows += [(200, None, "l1", "src1"), (201, "", "l1", "src1"), (202, " \t\x0b\n", "l1", "src1"), (None, "a b c", "es", "src4"), (203, "x " * 4000, "es", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, mixing.document_path(), mixing.WEIGHTS, mixing.SHARE, epochs=mixing.EPOCHS, seed=mixing.SEED).select("doc_id", "lang", "source", "mix_epoch", "mix_tokens")
    assert sql_rows(got, mixing.OP4_SQL, documents=(["doc_id", "text", "lang", "source"], rows)) > 60
