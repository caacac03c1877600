"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes a sequence of tokens in which numbers, names and units are typed placeholders (a run of one type
is one placeholder, whose value is the run's words). Windows of ``WINDOW`` tokens with at least ``LITERAL`` plain words are
hashed and joined to the windows of the benchmark items. A document is contaminated by an item if the windows that match cover
at least ``COVER`` of the item's, and if the values in the slots are consistent: along one alignment, a value of the item
always stands for the same value of the document, in ``STEADY`` of the slots. So questions asked again with other numbers or
names are found. An alignment is all shifts between document and item together, a run of near shifts (words put in or left out)
or one shift; any that passes is enough, so a look-alike elsewhere in the document doesn't clear a copy. The result counts the
alignment that matches most windows.

Items of fewer than ``WINDOW`` tokens are matched whole. Items of which no window has enough plain words (short ones,
and ones of many numbers or names) are found as exact copies: all their words and values, in order, in the document.

Texts of any length are read whole, once for all sizes of window (again, for exact copies, only if the benchmark has such items);
texts of candidates are read again for their slots, which travel as rows, never as whole texts beside each match.
Null and empty texts have no window and are never contaminated; empty and null items and items of under ``LITERAL``
tokens that are all placeholders match nothing. Rows of one document id but other texts are looked at apart; the result has one row
for a document id and item, that of the text that matches most (ties: more slots, then more changed values), and ``keep_clean``
drops only the texts that are contaminated. Rows with a null id are not reported, for nothing could be done with them, and stay;
items with a null id are left out. Repeated rows change nothing. Empty tables on either side give no rows. Other columns
are not read, whatever their names; ``keep_clean`` returns all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrill.llm.common import forget, table, written

WINDOW, LITERAL, COVER, STEADY = 8, 4, 0.5, 0.8
#: Words that stand for numbers and for units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
UNIT_WORDS = "kg mg km cm mm ml lb lbs oz ft mph kmh usd eur gbp percent dollars dollar euros euro cents cent pounds pound grams gram kilograms kilogram meters meter metres metre kilometers kilometer miles mile feet foot inches inch liters liter litres litre hours hour minutes minute seconds second days day weeks week months month years year degrees degree".split()
SIGNS = ("#", "%", "@")
#: Rows of benchmark windows (32 bytes each) up to which the benchmark side is broadcast.
MOST_BROADCAST = 2_000_000


def typed(text: Column) -> Column:
    """Lower-cased words, and slots as their type's sign and their value: # number, % unit, @ name."""

    def one(w: Column) -> Column:
        first, low = F.substring(w, 1, 1), F.lower(w)
        return (
            F.when(first.between("0", "9"), F.concat(F.lit("#"), w))
            .when(low.isin(NUMBER_WORDS), F.concat(F.lit("#"), low))
            .when(low.isin(UNIT_WORDS), F.concat(F.lit("%"), low))
            .when((first != F.lower(first)) & ((F.length(w) == 1) | (w != F.upper(w))), F.concat(F.lit("@"), w))
            .otherwise(low)
        )

    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != ""), one)


def kind(x: Column) -> Column:
    """The placeholder of a slot, the word itself of a word."""
    sign = F.substring(x, 1, 1)
    return F.when(sign.isin(*SIGNS), sign).otherwise(x)


def is_slot(x: Column) -> Column:
    return F.substring(x, 1, 1).isin(*SIGNS)


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h): hashes of a text's tokens with their placeholders, runs of one placeholder merged.

    Generators of one row keep the optimiser from pasting one step's expression into the loops of the next.
    """
    rows = docs.select(F.col(id_col), F.explode(F.array(F.transform(typed(F.col(text_col)), lambda x: F.xxhash64(kind(x))))).alias("h0"))
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("h0", 1, F.greatest(F.size("h0") - 1, F.lit(0))))
    merged = F.zip_with("h0", before, lambda x, y: F.when((x != y) | ~x.isin(*(F.xxhash64(F.lit(s)) for s in SIGNS)), x))
    return rows.where(F.size("h0") > 0).select(id_col, F.explode(F.array(F.filter(merged, lambda x: x.isNotNull()))).alias("h"))


def templates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens): words, and slots with their sign and all words of their run; places are those of ``hashed``."""
    rows = docs.select(F.col(id_col), F.explode(F.array(typed(F.col(text_col)))).alias("tokens0"))
    starts = F.filter(F.sequence(F.lit(1), F.size("tokens0")), lambda i: ~is_slot(F.get("tokens0", i - 1)) | (i == 1) | (kind(F.get("tokens0", i - 1)) != kind(F.get("tokens0", i - 2))))
    rows = rows.where(F.size("tokens0") > 0).select(id_col, "tokens0", F.explode(F.array(starts)).alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("tokens0") + 1))
    return rows.select(id_col, F.zip_with("starts", ends, lambda a, b: F.when(b - a == 1, F.get("tokens0", a - 1)).otherwise(F.array_join(F.slice("tokens0", a, b - a), " "))).alias("tokens"))


def windows(rows: DataFrame, id_col: str, sizes: list[int], whole: bool = False) -> DataFrame:
    """(id, size, pos, hash) of the windows of hashes ``h`` of each size; ``whole``: sizes below ``WINDOW`` of texts of just that size."""

    def of(size: int) -> Column:
        n = F.size("h")
        spans = F.when(n == size if whole and size < WINDOW else n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(spans, lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(size)]))

    out = None
    if len(sizes) == 1:
        return rows.select(id_col, F.lit(sizes[0]).alias("size"), F.posexplode(of(sizes[0])).alias("pos", "hash"))
    out = rows.select(id_col, F.explode(F.array(*(F.struct(F.lit(n).alias("size"), of(n).alias("hashes")) for n in sizes))).alias("w"))
    return out.select(id_col, "w.size", F.posexplode("w.hashes").alias("pos", "hash"))


def item_windows(ours: DataFrame, sizes: list[int]) -> DataFrame:
    """(item, size, at, hash) of the benchmark items' windows with enough words among their tokens."""
    rows = ours.select("item_id_", F.transform("tokens", lambda x: F.xxhash64(kind(x))).alias("h"))
    words = F.size(F.filter(F.slice("tokens", F.col("pos") + 1, F.col("size")), lambda x: ~is_slot(x)))
    left = windows(rows, "item_id_", sizes, whole=True).join(ours, "item_id_").where(words >= F.least(F.lit(LITERAL), F.col("size")))
    return left.select("item_id_", "size", F.col("pos").alias("at"), "hash")


def steadiness(values: DataFrame, key: list[str]) -> DataFrame:
    """Slots of each key, how many keep one value, and how many have another value than the item."""
    return values.groupBy(*key).agg(
        F.count("*").alias("slots"),
        F.sum((F.col("low") == F.col("high")).cast("long")).alias("steady"),
        F.sum(((F.col("low") != F.col("ours")) | (F.col("high") != F.col("ours"))).cast("long")).alias("changed"),
    )


def exact_copies(source: DataFrame, benchmark: DataFrame, every: DataFrame) -> DataFrame | None:
    """(document, item, slots) of exact copies of the items that have no window: their first ``WINDOW`` tokens are joined, then all are compared."""
    left = benchmark.join(every.select("item_id_").distinct(), "item_id_", "left_anti").select("item_id_", typed(F.col("text_")).alias("tokens"))
    words = F.filter("tokens", lambda x: ~kind(x).isin("#", "%", "@"))
    left = written(left.where((F.size(words) > 0) | (F.size("tokens") >= LITERAL)).dropDuplicates(), "exact_items")
    sizes = sorted(r[0] for r in left.select(F.least(F.size("tokens"), F.lit(WINDOW)).alias("n")).distinct().collect())
    if not sizes:
        return None
    small = left.count() <= MOST_BROADCAST
    tokens = source.select("doc_id_", typed(F.col("text_")).alias("tokens"))
    values = lambda df, key: df.select(key, F.explode(F.array(F.transform("tokens", lambda x: F.xxhash64(x)))).alias("h"))
    heads = left.select(F.struct("item_id_", "tokens").alias("item"), F.slice("tokens", 1, WINDOW).alias("tokens"))
    heads = windows(values(heads, "item"), "item", sizes, whole=True).select("item.item_id_", F.col("item.tokens").alias("item_tokens"), "size", "hash")
    hits = windows(values(tokens, "doc_id_"), "doc_id_", sizes).join(F.broadcast(heads) if small else heads, ["size", "hash"]).select("doc_id_", "item_id_", "pos", "item_tokens")
    hits = written(hits.dropDuplicates(["doc_id_", "item_id_", "pos", "item_tokens"]), "exact_hits")
    few = hits.where(F.size("item_tokens") > WINDOW)
    # a document's tokens meet its hits in one row for each item, so the longest are not repeated for each place
    asked = few.groupBy("doc_id_", "item_id_", "item_tokens").agg(F.collect_list("pos").alias("at"))
    whole = asked.join(tokens.join(few.select("doc_id_").distinct(), "doc_id_", "left_semi"), "doc_id_").where(
        F.exists("at", lambda p: F.slice("tokens", p + 1, F.size("item_tokens")) == F.col("item_tokens"))
    )
    whole = hits.where(F.size("item_tokens") <= WINDOW).select("doc_id_", "item_id_", "item_tokens").unionByName(whole.select("doc_id_", "item_id_", "item_tokens"))
    slots = F.size(F.array_distinct(F.filter("item_tokens", lambda x: kind(x).isin("#", "%", "@")))).cast("long")
    return whole.groupBy("doc_id_", "item_id_").agg(F.max(slots).alias("slots"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id_ (id, version), item_id_, item_windows, best (matched, slots, changed)): ``contaminated`` for each text of an id."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id_"), F.col(item_text).alias("text_"))
    ours = written(templates(items, "item_id_", "text_"), "items")
    sizes = [WINDOW, *sorted(r[0] for r in ours.select(F.size("tokens").alias("n")).where(f"n < {WINDOW}").distinct().collect())]
    source = docs.where(F.col(id_col).isNotNull()).select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version")).alias("doc_id_"), F.col(text_col).alias("text_"))
    every = written(item_windows(ours, sizes), "item_windows")
    small = every.count() <= MOST_BROADCAST
    hits = windows(hashed(source, "doc_id_", "text_"), "doc_id_", sizes).join(F.broadcast(every) if small else every, ["size", "hash"])
    hits = written(hits.select("doc_id_", "item_id_", "size", "at", (F.col("pos") - F.col("at")).alias("shift")), "hits")
    pair = ["doc_id_", "item_id_"]
    totals = every.groupBy("item_id_").agg(F.countDistinct("at").alias("item_windows"))
    cover = hits.groupBy(*pair).agg(F.countDistinct("at").alias("matched"))
    cover = written(cover.join(totals, "item_id_").where(F.col("matched") >= COVER * F.col("item_windows")), "cover")
    # slots of the few candidates, as rows: those that a window of the item covers, and those of the documents
    few = cover.select("doc_id_").distinct()
    few = F.broadcast(few) if cover.count() <= MOST_BROADCAST else few
    slots = every.join(ours, "item_id_").select("item_id_", "size", "at", F.posexplode(F.slice("tokens", F.col("at") + 1, F.col("size"))).alias("place", "ours"))
    slots = slots.where(is_slot(F.col("ours"))).select("item_id_", "size", "at", (F.col("at") + F.col("place")).alias("place"), "ours")
    asked = written(hits.join(cover.select(*pair), pair, "left_semi").select(*pair, "size", "at", "shift").distinct(), "asked")
    covered = asked.join(slots, ["item_id_", "size", "at"]).select(*pair, "shift", (F.col("place") + F.col("shift")).alias("pos"), "ours").distinct()
    theirs = templates(source.join(few, "doc_id_", "left_semi").distinct(), "doc_id_", "text_").select("doc_id_", F.posexplode("tokens").alias("pos", "theirs"))
    values = covered.join(theirs.where(is_slot(F.col("theirs"))), ["doc_id_", "pos"])
    values = written(values.groupBy(*pair, "shift", "ours").agg(F.min("theirs").alias("low"), F.max("theirs").alias("high")), "slot_values")
    steady = F.coalesce(F.col("steady") >= STEADY * F.col("slots"), F.lit(True))
    pooled = written(cover.join(steadiness(values, pair), pair, "left").withColumn("passes", steady), "pooled")
    doubted = written(pooled.where(~F.col("passes")).select(*pair, "item_windows"), "doubted")
    # the few that fail as a whole, by runs of shifts and by single shifts
    at = written(asked.join(doubted.select(*pair), pair, "left_semi").select(*pair, "at", "shift").distinct(), "doubted_hits")
    order = Window.partitionBy(*pair).orderBy("shift")
    runs = at.select(*pair, "shift").distinct().withColumn("new", (F.col("shift") - F.lag("shift").over(order) > WINDOW).cast("int"))
    runs = runs.select(*pair, "shift", F.concat(F.lit("run "), F.sum(F.coalesce("new", F.lit(0))).over(order)).alias("alignment"))
    runs = written(runs.unionByName(runs.select(*pair, "shift", F.concat(F.lit("shift "), "shift").alias("alignment"))), "alignments")
    key = [*pair, "alignment"]
    one = at.join(runs, [*pair, "shift"]).groupBy(*key).agg(F.countDistinct("at").alias("matched")).join(doubted, pair).where(F.col("matched") >= COVER * F.col("item_windows"))
    one = one.join(steadiness(values.join(runs, [*pair, "shift"]), key), key, "left").where(steady)
    out = pooled.where("passes").drop("passes").unionByName(one.drop("alignment"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = out.select(*pair, "item_windows", F.struct("matched", zero("slots"), zero("changed")).alias("best"))
    copies = exact_copies(source, items, every)
    if copies is not None:
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        out = out.unionByName(copies.select(*pair, one.alias("item_windows"), F.struct(one.alias("matched"), "slots", none.alias("changed")).alias("best")))
    forget(hits, asked)
    return out.groupBy(*pair).agg(F.max("item_windows").alias("item_windows"), F.max("best").alias("best"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item: windows of the item, how many match, slots, and how many have another value."""
    out = leaks(docs, benchmark, id_col, text_col, item_col, item_text).select(F.col("doc_id_.id").alias("doc_id"), F.col("item_id_").alias("item_id"), "item_windows", "best")
    return out.groupBy("doc_id", "item_id").agg(F.max("item_windows").alias("item_windows"), F.max("best").alias("best")).select("doc_id", "item_id", "item_windows", "best.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 2_000_000) -> DataFrame:
    """The documents that no item contaminates. Keys of the others are broadcast up to ``most_broadcast`` of 16 bytes, else joined."""
    bad = written(leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id_.id").alias(id_col), F.col("doc_id_.version").alias("version_")).distinct(), "contaminated")
    own = docs.withColumn("version_", F.xxhash64(text_col))
    return own.join(F.broadcast(bad) if bad.count() <= most_broadcast else bad, [id_col, "version_"], "left_anti").drop("version_")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _tokens_sql(source: str, key: str) -> str:
    words = ", ".join(f"'{w}'" for w in NUMBER_WORDS)
    units = ", ".join(f"'{w}'" for w in UNIT_WORDS)
    split = "string_split_regex(coalesce(text, ''), '[^\\p{L}\\p{M}\\p{N}]+')"
    return f"""SELECT id, i, CASE WHEN substr(w, 1, 1) BETWEEN '0' AND '9' THEN '#' || w WHEN lower(w) IN ({words}) THEN '#' || lower(w) WHEN lower(w) IN ({units}) THEN '%' || lower(w)
    WHEN substr(w, 1, 1) <> lower(substr(w, 1, 1)) AND (length(w) = 1 OR w <> upper(w)) THEN '@' || w ELSE lower(w) END AS x
    FROM (SELECT {key} AS id, unnest({split}) AS w, generate_subscripts({split}, 1) AS i FROM {source}) WHERE w <> ''"""


def _slot_sql(x: str) -> str:
    return f"substr({x}, 1, 1) IN ({', '.join(map(repr, SIGNS))})"


def _canon_sql(tokens: str) -> str:
    return f"""SELECT id, list(x ORDER BY run) AS tokens, list(CASE WHEN {_slot_sql("x")} THEN substr(x, 1, 1) ELSE x END ORDER BY run) AS canon FROM (
      SELECT id, run, string_agg(x, ' ' ORDER BY i) AS x FROM (
        SELECT *, sum(CASE WHEN before IS NULL OR NOT {_slot_sql("x")} OR substr(x, 1, 1) <> substr(before, 1, 1) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS run
        FROM (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY i) AS before FROM {tokens})) GROUP BY id, run) GROUP BY id"""


OP3_SQL = f"""
WITH dt AS MATERIALIZED ({_tokens_sql("documents", "doc_id")}), bt AS MATERIALIZED ({_tokens_sql("benchmark", "item_id")}),
d AS ({_canon_sql("dt")}), b AS MATERIALIZED ({_canon_sql("bt")}),
bw AS MATERIALIZED (SELECT *, array_to_string(canon[p:p + size - 1], ' ') AS h, tokens[p:p + size - 1] AS part FROM (
  SELECT id, tokens, canon, least(len(canon), {WINDOW}) AS size, unnest(range(1, len(canon) - least(len(canon), {WINDOW}) + 2)) AS p FROM b)
  WHERE len([x FOR x IN canon[p:p + size - 1] IF x NOT IN ({", ".join(map(repr, SIGNS))})]) >= least({LITERAL}, size)),
dw AS (SELECT id, size, p, tokens[p:p + size - 1] AS part, array_to_string(canon[p:p + size - 1], ' ') AS h
  FROM d, (SELECT DISTINCT size FROM bw) z, LATERAL unnest(range(1, greatest(len(canon) - size + 1, 0) + 1)) AS u(p)),
m AS MATERIALIZED (SELECT dw.id AS doc_id, bw.id AS item_id, bw.p AS bp, dw.p - bw.p AS shift, dw.part AS dpart, bw.part AS bpart FROM dw JOIN bw USING (size, h)),
n AS (SELECT id AS item_id, count(*) AS item_windows FROM bw GROUP BY 1),
c AS (SELECT doc_id, item_id FROM m JOIN n USING (item_id) GROUP BY ALL HAVING count(DISTINCT bp) >= {COVER} * max(item_windows)),
f AS MATERIALIZED (SELECT m.* FROM m JOIN c USING (doc_id, item_id)),
sh AS (SELECT DISTINCT doc_id, item_id, shift FROM f),
rn AS (SELECT *, sum(CASE WHEN gap > {WINDOW} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item_id ORDER BY shift) AS run
  FROM (SELECT *, shift - lag(shift) OVER (PARTITION BY doc_id, item_id ORDER BY shift) AS gap FROM sh)),
al AS (SELECT doc_id, item_id, shift, 'all' AS a FROM sh UNION ALL SELECT doc_id, item_id, shift, 'run ' || run FROM rn UNION ALL SELECT doc_id, item_id, shift, 'shift ' || shift FROM sh),
s AS (SELECT doc_id, item_id, shift, unnest(dpart) AS dv, unnest(bpart) AS bv FROM f),
v AS (SELECT doc_id, item_id, shift, bv, min(dv) AS low, max(dv) AS high FROM s WHERE {_slot_sql("bv")} GROUP BY ALL),
k AS (SELECT doc_id, item_id, a, count(DISTINCT bp) AS matched FROM f JOIN al USING (doc_id, item_id, shift) GROUP BY ALL),
w AS (SELECT doc_id, item_id, a, count(*) AS slots, count(*) FILTER (low = high) AS steady, count(*) FILTER (low <> bv OR high <> bv) AS changed FROM v JOIN al USING (doc_id, item_id, shift) GROUP BY ALL),
found AS (SELECT k.doc_id, k.item_id, item_windows, matched, coalesce(slots, 0) AS slots, coalesce(changed, 0) AS changed
  FROM k JOIN n USING (item_id) LEFT JOIN w ON w.doc_id = k.doc_id AND w.item_id = k.item_id AND w.a = k.a
  WHERE matched >= {COVER} * item_windows AND coalesce(steady >= {STEADY} * slots, true)),
xi AS (SELECT id AS item_id, ' ' || string_agg(x, ' ' ORDER BY i) || ' ' AS whole, count(DISTINCT CASE WHEN {_slot_sql("x")} THEN x END) AS slots FROM bt
  WHERE id NOT IN (SELECT item_id FROM n) GROUP BY id HAVING count(*) FILTER (NOT ({_slot_sql("x")})) > 0 OR count(*) >= {LITERAL}),
xd AS (SELECT id AS doc_id, ' ' || string_agg(x, ' ' ORDER BY i) || ' ' AS whole FROM dt WHERE EXISTS (SELECT 1 FROM xi) GROUP BY id),
every AS (SELECT * FROM found UNION ALL SELECT doc_id, item_id, 1, 1, slots, 0 FROM xd JOIN xi ON contains(xd.whole, xi.whole))
SELECT doc_id, item_id, item_windows, matched, slots, changed FROM every WHERE doc_id IS NOT NULL AND item_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, slots DESC, changed DESC) = 1
"""
