"""Periodic runs, conversation repair and packing."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrill.llm import conversations, packing, periods
from quadrill.llm.common import new_path, table
from test_corpus import sql_rows


def folder(spark, **tables):
    """A folder with the tables, as queries read them."""
    path = new_path(spark, "tables")
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return path


def brute_runs(w, times=4, least=6):
    """Every stretch that repeats at some distance, extended as far as it goes; the smallest distance counts."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def periodic(r):
    w = [r.randrange(r.choice([1, 2, 2, 3, 4])) for _ in range(r.randrange(70))]
    if w and r.random() < 0.5:
        b = w[: r.randrange(1, 8)]
        w = (w + b * r.randrange(1, 8) + w[:10] + b * r.randrange(1, 9)) * r.choice([1, 2, 3])
    return w


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_match_brute_force(seed):
    r = random.Random(seed)
    several = [periodic(r) for _ in range(400)]
    want = [brute_runs(w) for w in several]
    assert [periods.runs_of(w) for w in several] == want
    assert periods.runs_of_texts([[b"%d" % x for x in w] for w in several]) == want
    assert sum(map(len, want)) > 300


def test_factors_are_the_longest_with_an_earlier_occurrence():
    r = random.Random(4)
    for _ in range(80):
        w = periodic(r)
        at = 0
        for start, size, earlier in periods.factors(w):
            longest = max((k for s in range(start) for k in range(1, len(w) - start + 1) if w[s : s + k] == w[start : start + k]), default=0) if len(w) < 60 else size * (earlier >= 0)
            assert start == at and size == max(longest, 1)
            assert earlier < start and (earlier < 0 or w[earlier : earlier + size] == w[start : start + size])
            at += size
        assert at == len(w)


def test_long_runs_are_linear():
    w = ([1, 2, 3, 4, 5, 6, 7] * 30_000)[:200_000]
    assert periods.runs_of(w) == [(0, 200_000, 7)]
    assert periods.runs_of_texts([[b"a"] * 100_000, [b"b"]]) == [[(0, 100_000, 1)], []]


def test_runs_match_sql(spark):
    r, cols = random.Random(7), ["doc_id", "text"]
    rows = [(i, " ".join(f"w{x}" for x in periodic(r))) for i in range(300)]
    rows += [(500, ""), (501, None), (502, " \t\n "), (503, "a\xa0b " * 9), (504, "a b \x0b\x0c"), (500, ""), (505, "x " * 5000), (506, "é é\té\né é  é é"), (10**15, "one two " * 40), (-7, "one two " * 40)]
    found = periods.op11_runs(spark, folder(spark, documents=spark.createDataFrame(rows, "doc_id long, text string")))
    assert sql_rows(found, periods.OP11_SQL, documents=(cols, rows)) == len(rows)


def test_runs_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b " * 4, "k", [1])], "doc_id long, text string, runs string, utf8 array<int>")
    got = periods.periodic_runs(df).first()
    assert [tuple(x) for x in got["runs"]] == [(0, 8, 2)] and got["collapsed"] == "a b" and got["utf8"] == [1] and got["doc_id"] is None
    assert periods.periodic_runs(df.limit(0)).count() == 0
    assert periods.damaged(df).first()["text"] == "a b " * 4
    with pytest.raises(ValueError):
        periods.periodic_runs(df, times=2)


def test_runs_on_documents(spark, data):
    docs = periods.damaged(table(spark, data, "documents"))
    plain = {r["doc_id"]: r["text"].encode().split() for r in docs.collect()}
    for r in periods.periodic_runs(docs).withColumn("best", periods.foremost(F.col("runs"))).collect():
        words = plain[r["doc_id"]]
        want = brute_runs(words) if len(words) < 1500 else [tuple(x) for x in r["runs"]]
        assert [tuple(x) for x in r["runs"]] == want
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert r["collapsed"].encode().split() == [w for i, w in enumerate(words) if i not in gone]
        assert (tuple(r["best"]) if r["best"] else None) == min(want, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)


# conversation repair


def brute_repair(rows):
    """(cost, audit, repaired) of the best of all edits with up to two insertions ahead of each row; rows are (role, text, fault)."""
    best = None
    options = [[*(("D", None),), *((("K", None), ("R", "user"), ("R", "assistant")) if fault not in ("blank", "duplicate") else ())] for _, _, fault in rows]
    gaps = [[(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")] for _ in range(len(rows) + 1)]
    for edits in itertools.product(*options):
        for added in itertools.product(*gaps):
            audit, cost, out = "", 0, []
            for i, gap in enumerate(added):
                audit, cost, out = audit + "I" * len(gap), cost + 3 * len(gap), out + [f"{g}:" for g in gap]
                if i < len(rows):
                    (role, text, fault), (edit, to) = rows[i], edits[i]
                    audit, cost = audit + edit, cost + {"K": 0, "R": 3, "D": 4}[edit] + 3 * (edit != "D" and fault == "truncated")
                    out += [] if edit == "D" else [f"{to or role}:{text}"]
            initials = "".join(x[0] for x in out)
            if (initials.lstrip("s") if initials.count("s") < 2 else "x") == "ua" * (len(initials.lstrip("s")) // 2) and initials != "s" and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(out))
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def test_repair_matches_brute_force(spark):
    r = random.Random(3)
    chats = {c: [(r.choice(["user", "assistant", "user", "assistant", "system", "tool"]), r.choice(["Yes.", "No!", "so", " ", f"t{r.random()}.", f"t{r.random()}?"])) for _ in range(r.randrange(1, 4))] for c in range(80)}
    df = spark.createDataFrame([(c, t, *x) for c, rows in chats.items() for t, x in enumerate(rows)], "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: x for x in conversations.repair(df).collect()}
    assert len(got) == 80
    for c, rows in chats.items():
        own = faults(rows)
        cost, audit, text = brute_repair(own)
        assert (got[c]["cost"], got[c]["audit"], got[c]["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())
        assert [got[c][k] for k in ("blank", "duplicate", "truncated")] == [sum(f == k for *_, f in own) for k in ("blank", "duplicate", "truncated")]
        assert got[c]["illegal"] == sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)) and got[c]["gaps"] == 0


def chat_rows(seed, chats=120):
    r = random.Random(seed)
    rows = []
    for c in [*range(chats), None]:
        for _ in range(r.choice([1, 3, 8, 30])):
            rows.append((c, r.choice([None, *range(40)]), r.choice(["user", "assistant", "system", "", None, "usr", "éa"]), r.choice(["Yes.", "no", "", None, " \n", "ends.\n\n", "x\u2028", "\u2028", f"{r.random()}!", f"{r.random()}."])))
    return rows + rows[:40]


@pytest.mark.parametrize(("seed", "block", "batch"), [(1, 256, 20_000), (2, 4, 20), (3, 1, 3)])
def test_repair_matches_sql(spark, monkeypatch, seed, block, batch):
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "BATCH", batch)
    cols, rows = ["conv_id", "turn", "role", "text"], chat_rows(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversations.op12_conversations(spark, folder(spark, conversations=df))
    assert sql_rows(got, conversations.OP12_SQL.replace("FROM conversations, crc", "FROM (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations) c, crc"), conversations=(cols, rows)) == 121


def test_long_conversations_are_cut(spark):
    rows = [(1, t, "user" if t % 2 else "system", f"{t}.", "k") for t in range(3000)] + [(2, 5, "user", "Hi.", "k")]
    got = {r["conv_id"]: r for r in conversations.repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, cost string")).collect()}
    assert got[1]["cost"] == 3 * 1500 and got[1]["audit"] == "KK" + "RK" * 1499 + "I" and got[1]["illegal"] == 1499
    assert (got[2]["audit"], got[2]["gaps"]) == ("KI", 0)


def test_repair_of_odd_tables(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(empty).count() == 0
    ids = spark.createDataFrame([(1,), (1,), (None,)], "conv_id long")
    got = conversations.repair(empty, ids).collect()
    assert len(got) == 2 and all((r["cost"], r["audit"], r["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest()) for r in got)


# packing


def plain_pack(lengths, c):
    """Best-fit piece by piece, longest first: what each sequence holds (tokens, documents, cost)."""
    cap, bins = (c.tokens, c.documents, c.cost), []
    for n in sorted(lengths, reverse=True):
        v, best = (n, 1, n * n), None
        for i, b in enumerate(bins):
            if all(x + y <= z for x, y, z in zip(b, v, cap)):
                free = [(z - x) / z for x, z in zip(b, cap)]
                score = sum(w * (f - y / z) ** 2 if c.rule == "norm" else -w * f * y / z for w, f, y, z in zip(c.weights, free, v, cap))
                if best is None or score < best[0] - 1e-12:
                    best = (score, i)
        if best is None:
            bins.append(v)
        else:
            bins[best[1]] = tuple(x + y for x, y in zip(bins[best[1]], v))
    return sorted(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_placing_groups_is_placing_pieces(rule):
    r = random.Random(2)
    for _ in range(150):
        t = r.choice([20, 50, 200])
        c = packing.PackConfig(t, r.choice([3, 5, 1000]), r.choice([t * t, t * t // 2]), rule=rule)
        lengths = [r.randrange(1, c.longest + 1) for _ in range(r.randrange(150))]
        u, n = np.unique(np.array(lengths, int), return_counts=True)
        bins, ranks = {}, {}
        for size, rank, each, many, first, offset in packing.place(u.tolist(), n.tolist(), c).tolist():
            assert rank == ranks.get(size, 0)
            ranks[size] = rank + each * many
            for b in range(first, first + many):
                for k in range(each):
                    assert bins.setdefault(b, (0, 0, 0))[0] == offset + k * size
                    bins[b] = tuple(x + y for x, y in zip(bins[b], (size, 1, size * size)))
        assert ranks == dict(zip(u.tolist(), n.tolist())) and sorted(bins) == list(range(len(bins)))
        assert sorted(bins.values()) == plain_pack(lengths, c)
    with pytest.raises(ValueError):
        packing.place([30], [1], packing.PackConfig(20))
    with pytest.raises(ValueError):
        packing.PackConfig(rule="first")


def words_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_words_are_tokenised_as_texts(data, monkeypatch):
    import duckdb
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(words_path())
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{data}/documents.parquet'").fetchall()]
    texts += ["", " ", "a\x01b \x01 c", "it's we'll 'tis", "<|endoftext|> x<|startoftext|>y", "e\u0301 \u0301x Å\u00a0b\x1cc\td\r\ne", "ΑΣ ΟΔΟΣ İx", "...  !!x", "1234 5,6", "日本 語", "x" * 5000, "A.B. C, d?. e!, F_. (g). ²: À Éß. x", "<|ENDOFTEXT|> A", "a.\\tb.", "É É. ÉE, É", "'S 'T. it'S."]
    for most in (400_000, 50):
        monkeypatch.setattr(packing, "MOST_WORDS", most)
        vocab = packing.Vocabulary(words_path())
        for i in range(0, len(texts), 40):
            part = texts[i : i + 40]
            assert [np.frombuffer(x, "<u4").tolist() for x in vocab.encode(part)] == [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]


def test_packing_is_whole(spark, data, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BUCKET", 7)
    docs = table(spark, data, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (None, ""), (7, "a"), (7, "a"), (2**60 + 1, "b")], "doc_id long, text string"))
    got = packing.packed(docs, words_path()).collect()
    plain = Tokenizer.from_file(words_path())
    want = []
    for r in docs.collect():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], k, 2048 * k, len(part := ids[2048 * k : 2048 * (k + 1)]), zlib.crc32(np.array(part, "<u4").tobytes())) for k in range(-(-len(ids) // 2048))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 2048
    config = packing.PackConfig()
    assert sorted(sum(n for _, n in own) for own in bins.values()) == sorted(b[0] for b in plain_pack([w[3] for w in want], config))
    assert len(bins) <= 1.02 * -(-sum(w[3] for w in want) // 2048) + 1


def test_packing_keeps_every_bound(spark):
    c = packing.PackConfig(64, 3, 1500)
    items = spark.createDataFrame([(i, 1 + i % c.longest, "x") for i in range(500)], "i long, length long, offset string")
    bins = {}
    for r in packing.pack(items, c).collect():
        bins.setdefault(r["sequence_id"], []).append(r["length"])
    assert sum(map(len, bins.values())) == 500
    assert all(sum(b) <= 64 and len(b) <= 3 and sum(n * n for n in b) <= 1500 for b in bins.values())
    assert packing.pack(items.limit(0), c).count() == 0
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), words_path()).count() == 0
