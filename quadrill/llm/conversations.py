"""Repair of conversation structure at least cost, by a recursive query inside hash-partitioned batches.

A repaired conversation has roles that start with s, u or a and follow the grammar ``(s?(ua)+)?``. A row is kept, gets another role, or is
deleted; rows without text can be inserted anywhere. Costs are those of ``COSTS``; of the cheapest ways the one whose audit (the initials
D, I, K, R of its edits in order) is least in ASCII counts. The audit says all: the grammar leaves one role to each inserted or renamed row.

1. ``rows``: slim rows (no texts) of conversation, turn, role and the text's digest, equal ones counted; whether role and text occur at
   an earlier turn comes from an aggregate, so no conversation has to be in one place for that.
2. ``stretches_of``: slim rows are dealt by the hash of conversation and block of ``BLOCK`` turns. Each task gathers batches of whole blocks and hands
   them to DuckDB, whose recursive query advances one row for all blocks of the batch at once and keeps the least (cost, audit) for each grammar
   state before the block and after it.
3. ``joined_up``: the same recursive query advances block by block for all conversations of a batch.
4. ``digests``: texts are dealt once, by conversation, and stream through the audit into the repaired text's digest.

So a long conversation is cut into blocks, and what one task sees of it is a table of states for each block, the audit and a stream of rows. A batch
holds some ``BATCH`` rows; a block with more (rows of one turn) is handed over in pieces.

Rows stand by turn, nulls first, then role and text's digest. Null roles and texts count as one space; conversations whose id is null are one. A
conversation without rows costs nothing and has the empty audit. Repeated rows are duplicates. Texts of any length are read whole. An empty table gives no rows.
Other columns of the input are left out, so names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.llm.common import lean, table, written

#: Keep, give another role, delete, insert, leave truncated.
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3, "truncated": 3}
#: Turns of a block, rows of a batch.
BLOCK, BATCH = 256, 20_000
#: Grammar states: nothing yet, after s, after u, after a. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: States before and after a role's initial.
GRAMMAR = [(START, "s", SYSTEM), (START, "u", USER), (SYSTEM, "u", USER), (ASSISTANT, "u", USER), (USER, "a", ASSISTANT)]
BLANK = r"\A[\x20\x09-\x0D]*\z"


def inserts() -> list[tuple[int, int, int]]:
    """(state, state, rows inserted): ways that don't pass a state twice."""
    out = [(s, s, 0) for s in range(4)]
    for n in (1, 2):
        out += [(s, after, n) for s, at, k in out if k == n - 1 for before, c, after in GRAMMAR if before == at and c != "s" and after != s]
    return out


def moves() -> list[tuple[int, str, bool, int, int, str]]:
    """(state, initial or x, must go, state after, cost, edits) of all that can be done with a row, with rows inserted ahead of it."""
    out = []
    for s, at, n in inserts():
        ahead, cost = "I" * n, COSTS["I"] * n
        for initial in "suax":
            out += [(s, initial, gone, at, cost + COSTS["D"], ahead + "D") for gone in (False, True)]
            out += [(s, initial, False, after, cost + COSTS["K"], ahead + "K") for before, c, after in GRAMMAR if before == at and c == initial]
            out += [(s, initial, False, after, cost + COSTS["R"], ahead + "R") for before, c, after in GRAMMAR if before == at and c != "s"]
    return out


_MOVES = ", ".join(f"({s}, '{c}', {gone}, {to}, {cost}, '{edits}')" for s, c, gone, to, cost, edits in moves())
_LAST = ", ".join(f"({s}, {COSTS['I'] * n}, '{'I' * n}')" for s, at, n in inserts() if at in ENDS)
#: The least cost and audit of each block of rows for each state before and after; ``steps`` are what one row allows. The keyed recursion
#: keeps the last row of each state only; states that a later row didn't reach are left out by ``ends``.
_WALK = """
WITH RECURSIVE {steps}, walk(k, i, origin, state, cost, audit) USING KEY (k, origin, state) AS (
  SELECT k, 0::BIGINT AS i, origin, origin AS state, 0::BIGINT AS cost, '' AS audit FROM (SELECT DISTINCT k FROM steps), {origins}
  UNION
  SELECT k, i + 1, origin, state, best.cost, best.audit FROM (
    SELECT w.k, w.i, w.origin, s.after AS state, min(struct_pack(cost := w.cost + s.cost, audit := w.audit || s.edits)) AS best
    FROM walk w JOIN steps s ON w.k = s.k AND w.i = s.i AND w.state = s.before GROUP BY w.k, w.i, w.origin, s.after)
), ends AS (SELECT k, max(i) + 1 AS i FROM steps GROUP BY k)
"""
BLOCK_SQL = (
    _WALK.format(origins="(VALUES (0), (1), (2), (3)) o(origin)", steps=f"""moves(before, initial, gone, after, cost, edits) AS (VALUES {_MOVES}),
  steps AS (SELECT r.k, r.i, m.before, m.after, m.cost + CASE WHEN r.cut AND NOT m.edits LIKE '%D' THEN {COSTS['truncated']} ELSE 0 END + {COSTS['D']} * (r.n - 1) AS cost, m.edits || repeat('D', r.n - 1) AS edits
    FROM rows_in r JOIN moves m ON m.initial = r.initial AND m.gone = r.gone)""")
    + "SELECT k, origin AS before, state AS after, cost, audit FROM walk JOIN ends USING (k, i)"
)
JOIN_SQL = (
    _WALK.format(origins="(VALUES (0)) o(origin)", steps="steps AS (SELECT k, i, before, after, cost, audit AS edits FROM rows_in)")
    + f"""SELECT k, best.cost AS cost, best.audit AS audit FROM (SELECT k, min(struct_pack(cost := walk.cost + l.cost, audit := audit || l.edits)) AS best
  FROM walk JOIN ends USING (k, i) JOIN (VALUES {_LAST}) l(state, cost, edits) USING (state) GROUP BY k)"""
)


def recursion(rows: pd.DataFrame, sql: str) -> pd.DataFrame:
    """A recursive query over one batch, in a DuckDB of its own that never writes to disk."""
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""}) as con:
        con.register("rows_in", pa.Table.from_pandas(rows, preserve_index=False))
        return con.execute(sql).df()


def initial_of(role: Column) -> Column:
    return F.when(F.substring(role, 1, 1).isin("s", "u", "a"), F.substring(role, 1, 1)).otherwise("x")


def whole(df: DataFrame) -> DataFrame:
    """(conv, turn, role, text, digest, n) of the input's rows: null roles and texts are one space."""
    rows = df.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.col("n") if "n" in df.columns else F.lit(1)).cast("long").alias("n"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def rows_of(df: DataFrame) -> DataFrame:
    """Slim rows, equal ones counted in ``n``: initial, blank, duplicate (seen at an earlier turn) and cut of the first of them."""
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    slim = whole(df).select("conv", "turn", "role", "digest", "n", F.rlike("text", F.lit(BLANK)).alias("blank"), (~end.isin(".", "!", "?")).alias("open"))
    slim = slim.groupBy("conv", "turn", "role", "digest").agg(F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("open").alias("open"))
    # the earliest turn of each role and text: a null turn is the earliest; most occur once
    seen = slim.groupBy(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("digest").alias("digest_")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("x"), "turn"))["turn"].alias("first_"), F.count("*").alias("many_")).where("many_ > 1")
    again = slim.join(seen, slim["conv"].eqNullSafe(seen["conv_"]) & (slim["role"] == seen["role_"]) & (slim["digest"] == seen["digest_"]), "left")
    duplicate = F.col("many_").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_"))
    return again.select("conv", "turn", "role", "digest", "n", initial_of(F.col("role")).alias("initial"), "blank", duplicate.alias("duplicate"), (F.col("open") & ~F.col("blank") & ~duplicate).alias("cut"))


def batches_of(pieces: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted rows regathered into frames of about ``BATCH`` rows with ``k`` (number of the group in the frame) and ``i`` (place in it); a group of more rows comes in pieces."""

    def numbered(x: pd.DataFrame) -> pd.DataFrame:
        at = x[key].isna() if len(x) else x[key]
        new = ((x[key] != x[key].shift()) & ~(at & at.shift(fill_value=False))).any(axis=1)
        new.iloc[:1] = True
        k = new.cumsum() - 1
        return x.assign(k=k.to_numpy(), i=x.groupby(k.to_numpy()).cumcount().to_numpy())

    held: pd.DataFrame | None = None
    for pdf in pieces:
        held = pdf if held is None or not len(held) else pd.concat([held, pdf], ignore_index=True)
        while len(held) >= BATCH:
            whole_groups = numbered(held)
            last = whole_groups["k"].iloc[BATCH - 1]
            stop = int((whole_groups["k"] < last).sum()) or BATCH  # groups that end in the batch, or a piece of one that doesn't
            yield numbered(held.iloc[:stop].reset_index(drop=True))
            held = held.iloc[stop:].reset_index(drop=True)
    if held is not None and len(held):
        yield numbered(held)


def stretches_of(rows: DataFrame) -> DataFrame:
    """(conv, block, piece, before, after, cost, audit, head, tail, illegal): what each block of each conversation costs from each state to each."""
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(None)).cast("long")
    dealt = rows.withColumn("block", block).repartition("conv", "block").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("block").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest")
    kind = dict(rows.dtypes)["conv"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for x in batches_of(parts, ["conv_", "block"]):
            x["gone"] = x["blank"] | x["duplicate"]
            own = recursion(x[["k", "i", "initial", "gone", "cut", "n"]], BLOCK_SQL)
            legal = (x["initial"].shift() + x["initial"]).isin(["su", "ua", "au"]) | (x["i"] == 0)
            x["illegal"] = (~legal).astype("int64") + x["n"] - 1
            heads = x.groupby("k").agg(conv_=("conv_", "first"), block=("block", "first"), head=("initial", "first"), tail=("initial", "last"), illegal=("illegal", "sum"))
            out = own.join(heads, on="k")
            yield out.assign(piece=at)[["conv_", "block", "piece", "before", "after", "cost", "audit", "head", "tail", "illegal"]]
            at += 1

    slim = dealt.select(F.col("conv").cast("string").alias("conv_"), F.col("block").cast("string").alias("block"), "initial", "blank", "duplicate", "cut", "n")
    out = slim.mapInPandas(lean(run), "conv_ string, block string, piece long, before int, after int, cost long, audit string, head string, tail string, illegal long")
    return out.select(F.col("conv_").cast(kind).alias("conv"), F.col("block").cast("long").alias("block"), *out.columns[2:])


def joined_up(stretches: DataFrame) -> DataFrame:
    """(conv, cost, audit, illegal) of whole conversations."""
    dealt = stretches.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("block").asc_nulls_first(), "piece")
    kind = dict(stretches.dtypes)["conv"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def whole_conversations() -> Iterator[pd.DataFrame]:
            held: pd.DataFrame | None = None
            for pdf in parts:
                held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                if len(held) < BATCH:
                    continue
                last = held["conv_"].iloc[-1]
                inside = held["conv_"].isna() if pd.isna(last) else held["conv_"] == last
                if not inside.all():
                    yield held[~inside].reset_index(drop=True)
                    held = held[inside].reset_index(drop=True)
            if held is not None and len(held):
                yield held

        for x in whole_conversations():
            x["k"] = x["conv_"].factorize(use_na_sentinel=False)[0]
            new = (x[["k", "piece"]].ne(x[["k", "piece"]].shift())).any(axis=1) | x["block"].fillna("").ne(x["block"].shift().fillna(""))
            new.iloc[0] = True
            x["i"] = new.groupby(x["k"]).cumsum().astype("int64") - 1
            own = recursion(x[["k", "i", "before", "after", "cost", "audit"]], JOIN_SQL)
            blocks = x[new].copy()
            across = (blocks["i"] > 0) & ~(blocks["tail"].shift() + blocks["head"]).isin(["su", "ua", "au"])
            blocks["illegal"] += across.astype("int64")
            heads = blocks.groupby("k").agg(conv_=("conv_", "first"), illegal=("illegal", "sum"))
            yield own.join(heads, on="k")[["conv_", "cost", "audit", "illegal"]]

    slim = dealt.select(F.col("conv").cast("string").alias("conv_"), F.col("block").cast("string").alias("block"), *stretches.columns[2:])
    out = slim.mapInPandas(lean(run), "conv_ string, cost long, audit string, illegal long")
    return out.select(F.col("conv_").cast(kind).alias("conv"), "cost", "audit", "illegal")


def repaired(audit: str, rows: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows: ``audit`` applied to rows (role, text, copies) in order."""
    state, edits = START, iter(audit)

    def insert() -> tuple[str, str]:
        nonlocal state
        state = ASSISTANT if state == USER else USER
        return ("assistant" if state == ASSISTANT else "user"), ""

    for role, text, n in rows:
        for _ in range(n):
            for edit in edits:
                if edit != "I":
                    break
                yield insert()
            if edit == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                yield role, text
            elif edit == "R":
                yield insert()[0], text
    for _ in edits:
        yield insert()


def digests(df: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the conversations in ``repairs``; rows stream, so a conversation may be of any length."""
    kind = dict(df.dtypes)["conv_id"]
    texts = whole(df).select("conv", "turn", "role", "digest", "text", "n", F.lit(None).cast("string").alias("audit"))
    heads = repairs.select("conv", F.lit(None).cast(dict(texts.dtypes)["turn"]).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), "audit")
    dealt = heads.unionByName(texts).repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str | None, str]] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_", "audit", "role", "text", "n")), strict=True)

        source = rows()
        head = next(source, None)
        while head is not None:
            after: list[tuple] = []

            def own() -> Iterator[tuple[str, str, int]]:
                for row in source:
                    if row[1] is not None:  # the next conversation's audit
                        after.append(row)
                        return
                    yield row[2:]

            h, first = hashlib.sha256(), True
            for role, text in repaired(head[1], own()):
                h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            done.append((head[0], h.hexdigest()))
            head = after[0] if after else None
            if len(done) >= BATCH or head is None:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string())], ["conv_", "repaired_sha256"])
                done = []

    out = dealt.select(F.col("conv").cast("string").alias("conv_"), "audit", "role", "text", "n").mapInArrow(lean(run), "conv_ string, repaired_sha256 string")
    return out.select(F.col("conv_").cast(kind).alias("conv"), "repaired_sha256")


def repair(df: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Conversations of ``df`` (conv_id, turn, role, text, and n copies of a row if there is such a column) and what repairs them.

    ``ids`` (conv_id) names conversations that are reported even if they have no rows.
    """
    rows = written(rows_of(df), "rows")
    one = F.col("n") == 1  # further copies of a row are blank or duplicates
    stats = rows.groupBy("conv").agg(
        F.min("turn").alias("low_"), F.max("turn").alias("high_"), F.count_distinct("turn").alias("turns_"), F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("duplicate"), F.col("n")).when(one, 0).otherwise(F.col("n") - 1)).alias("duplicate"), F.sum(F.col("cut").cast("long")).alias("truncated"),
    )
    fixed = written(joined_up(stretches_of(rows)), "repairs")
    sums = digests(df, fixed)
    same = lambda a, b: a["conv"].eqNullSafe(b["conv"])
    out = stats.join(fixed, same(stats, fixed)).select(stats["*"], "cost", "audit", "illegal")
    out = out.join(sums, same(out, sums)).select(out["*"], "repaired_sha256")
    if ids is not None:
        every = ids.select(F.col("conv_id").alias("conv")).distinct()
        out = every.join(out, same(every, out), "left").select(every["conv"], *out.columns[1:])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c if isinstance(c, str) else None)
    return out.select(
        F.col("conv").alias("conv_id"), F.coalesce(F.col("high_") - F.col("low_") + 1 - F.col("turns_"), F.lit(0)).cast("long").alias("gaps"),
        *(zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged(df: DataFrame) -> DataFrame:
    """Rows with null fields as one space, damaged as the checksum of conversation and turn says; ``n`` is 2 where a row is repeated."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), what.alias("what")).where("what <> 0")
    text = F.when(F.col("what") == 1, F.lit("")).when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("what") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("what") == 3, 2).otherwise(1).alias("n"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations")
    return repair(damaged(chats), chats.select("conv_id"))


#: One row of a conversation after the other; each of the four grammar states keeps its best way, and rows are inserted one at a time.
OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) AS t),
hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 20 AS what
  FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN what = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE what <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM hurt),
seen AS (SELECT *, regexp_matches(text, '^[\x20\x09-\x0D]*$') AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending,
  CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial FROM ordered),
facts AS (SELECT *, is_blank AS blank, NOT is_blank AND again AS duplicate, NOT is_blank AND NOT again AND ending NOT IN ('.', '!', '?') AS truncated, i > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM seen),
lengths AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::BIGINT) AS blank, sum(duplicate::BIGINT) AS duplicate, sum(truncated::BIGINT) AS truncated, sum(illegal::BIGINT) AS illegal FROM facts GROUP BY conv_id),
grammar(before, initial, after) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
edits AS (SELECT conv_id, i, g AS before, g AS after, 4 AS cost, 'D' AS edit, '' AS line FROM facts, (VALUES (''), ('s'), ('u'), ('a')) x(g)
  UNION ALL SELECT conv_id, i, before, after, 3 * truncated::INT, 'K', role || ':' || text || chr(10) FROM facts JOIN grammar USING (initial) WHERE NOT blank AND NOT duplicate
  UNION ALL SELECT conv_id, i, before, after, 3 + 3 * truncated::INT, 'R', CASE after WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text || chr(10) FROM facts, grammar g WHERE NOT blank AND NOT duplicate AND g.initial <> 's'),
added AS (SELECT x.g AS before, x.g AS after, 0 AS cost, '' AS edit, '' AS line FROM (VALUES (''), ('s'), ('u'), ('a')) x(g)
  UNION ALL SELECT before, after, 3, 'I', CASE after WHEN 'u' THEN 'user:' ELSE 'assistant:' END || chr(10) FROM grammar WHERE initial <> 's'
  UNION ALL SELECT before, 'a', 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10) FROM grammar WHERE initial = 'u'),
way AS (SELECT conv_id, 0::BIGINT AS i, '' AS state, {cost: 0::BIGINT, audit: '', line: ''} AS best FROM lengths
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.after, min({cost: w.best.cost + a.cost + e.cost, audit: w.best.audit || a.edit || e.edit, line: w.best.line || a.line || e.line})
  FROM way w JOIN added a ON a.before = w.state JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.before = a.after GROUP BY w.conv_id, w.i, e.after),
done AS (SELECT w.conv_id, min({cost: w.best.cost + a.cost, audit: w.best.audit || a.edit, line: w.best.line || a.line}) AS best
  FROM way w JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = l.n JOIN added a ON a.before = w.state WHERE a.after IN ('', 'a') GROUP BY w.conv_id)
SELECT c.conv_id, coalesce(l.gaps, 0) AS gaps, coalesce(l.blank, 0) AS blank, coalesce(l.duplicate, 0) AS duplicate, coalesce(l.truncated, 0) AS truncated, coalesce(l.illegal, 0) AS illegal,
  coalesce(d.best.cost, 0) AS cost, coalesce(d.best.audit, '') AS audit, sha256(coalesce(left(d.best.line, length(d.best.line) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""
