"""Periodic runs of words by the method of Kolpakov and Kucherov, and texts collapsed to the first period of each.

A run is a stretch of consecutive words with smallest period q, at least ``TIMES`` periods and ``LEAST`` words long, that no neighbouring word
extends. Documents are independent, so all work is narrow: in each task a text's words become numbers; a suffix automaton gives
the Lempel-Ziv factors; Main's algorithm finds the runs that cross or touch the border of two factors, from common
extensions on both sides of it; every other run lies strictly inside a factor and is copied from that factor's earlier occurrence.

Only stretches that can hold a run get there. Every five words in a row inside a run stand in it a second time, so words outside of any
five that recur, first in the text and then within the stretch that is left, are in no run. That loses nothing and leaves plain prose with next to
nothing to factorise. The automaton takes some 600 bytes for each word of such a stretch; all steps are linear in its length.

A null text has no words, no runs and the empty string as collapsed text; so has one without words. Texts of any length are read whole.
Equal rows give equal results. An empty table gives no rows. Columns of the input named ``runs`` or ``collapsed`` are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.llm.common import lean, table

#: Periods and words that a run has at least.
TIMES, LEAST = 4, 6
#: Words in a row that recur inside every run of so many periods and words.
GRAM = 5
#: Words that are searched for candidate stretches at a time.
CHUNK = 500_000
WORD = r"[^\x20\x09-\x0D]+"


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors (start, length, start of an earlier occurrence or -1); occurrences may overlap.

    Each state of the suffix automaton knows where its words end first; a factor is followed as long as that lies before the factor's own end.
    """
    go: list[dict[int, int]] = [{}]
    link, size, first, last = [-1], [0], [-1], 0
    for i, c in enumerate(w):
        new = len(go)
        go.append({})
        size.append(i + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                clone = len(go)
                go.append(go[q].copy())
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    out, i, n = [], 0, len(w)
    while i < n:
        state, j = 0, i
        while j < n:
            to = go[state][w[j]]
            if first[to] >= j:
                break
            state, j = to, j + 1
        out.append((i, j - i, first[state] - (j - i) + 1) if j > i else (i, 1, -1))
        i = max(j, i + 1)
    return out


def prefixes(x: list[int]) -> list[int]:
    """Length of the common prefix of x and each of its suffixes."""
    n, z, left, right = len(x), [0] * len(x), 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(w: list[int], border: int, before: int, after: int, found: dict[tuple[int, int], int], times: int, least: int) -> None:
    """Add the runs that touch ``border`` and end in the factor of ``after`` words there; the factor ahead of it has ``before`` words.

    Such a run starts less than its period ahead of that earlier factor, or the factor would be longer; so its period is below
    (before + after) / (times - 1). One more word on the right shows runs that end in a later factor, which are found there.
    """
    longest = (before + after) // (times - 1)
    if not longest:
        return
    n, reach = len(w), min(border, before + longest)
    left, right = w[border - reach : border], w[border : border + after + 1]
    back, m = left[::-1], len(right)
    ahead = prefixes([*right, -1, *left, *right])
    behind = prefixes([*back, -1, *right[::-1], *back])
    for p in range(1, longest + 1):
        for start, end in (
            (border - p - behind[p] if p < reach else border - p, border + ahead[m + 1 + reach - p]) if p <= reach else (0, 0),
            (border - behind[reach + 1 + m - p], border + p + (ahead[p] if p < m else 0)) if p <= m else (0, 0),
        ):
            if end - start < max(least, times * p) or end > border + after or (start == border - reach and start > 0 and w[start - 1] == w[start - 1 + p]):
                continue
            if end < n and w[end] == w[end - p]:
                continue
            if found.get((start, end), p + 1) > p:
                found[start, end] = p


def runs_of(w: list[int], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of numbers from 0 on, by start and period."""
    cut = factors(w) if w else []
    found: dict[tuple[int, int], int] = {}
    for (_, before, _), (border, after, _) in zip(cut, [*cut[1:], (len(w), 0, -1)]):  # noqa: B905  none without factors
        crossing(w, border, before, after, found, times, least)
    by_start: dict[int, dict[int, int]] = {}
    for (start, end), p in found.items():
        by_start.setdefault(start, {})[end] = p
    for at, size, earlier in cut if by_start else ():
        if earlier < 0:
            continue
        shift, stop = at - earlier, earlier + size
        for start in range(earlier + 1, stop):
            for end, p in list(by_start.get(start, {}).items()):
                if end < stop:
                    by_start.setdefault(start + shift, {}).setdefault(end + shift, p)
    return sorted((start, end - start, p) for start, ends in by_start.items() for end, p in ends.items())


def stretches(words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, after the last) of the stretches of ``words`` that can hold a run; ``doc`` numbers the text of each word."""
    at = np.flatnonzero(doc[GRAM - 1 :] == doc[: len(doc) - GRAM + 1]) if len(doc) >= GRAM else np.zeros(0, np.int64)
    gram = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        gram = (gram ^ words[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    owner = doc[at]
    for _ in range(12):  # what a later round would still take away is only searched in vain
        key = (gram ^ owner.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(key, kind="stable")
        twin = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:][twin]] = again[order[:-1][twin]] = True
        if again.all():
            break
        at, gram, owner = at[again], gram[again], owner[again]
        owner = np.cumsum(np.r_[True, (np.diff(at) != 1) | (np.diff(owner) != 0)][: len(at)])
    if len(at):
        edges = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]]), True])
        yield from ((int(at[a]), int(at[b - 1]) + GRAM) for a, b in zip(edges[:-1], edges[1:], strict=True))


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of all words, text of each word, first word of each text and the total)."""
    number: dict[bytes, int] = {}
    sizes = [len(x) for x in texts]
    words = np.fromiter((number.setdefault(w, len(number)) for x in texts for w in x), np.int64, sum(sizes))
    return words, np.repeat(np.arange(len(texts)), sizes), np.cumsum([0, *sizes])


def runs_of_texts(texts: list[list[bytes]], times: int = TIMES, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each text (a list of words)."""
    words, doc, offsets = numbered(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in stretches(words, doc):
        if b - a >= least:
            _, own = np.unique(words[a:b], return_inverse=True)
            base = a - int(offsets[doc[a]])
            out[doc[a]] += [(base + s, n, p) for s, n, p in runs_of(own.tolist(), times, least)]
    return [sorted(x) for x in out]


def kept(words: list[bytes], runs: Iterable[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that a run has after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, n, p in runs:
        drop[start + p] += 1
        drop[start + n] -= 1
    gone = np.cumsum(drop)
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=False) if not g)


def periodic_runs(docs: DataFrame, text_col: str = "text", times: int = TIMES, least: int = LEAST) -> DataFrame:
    """The input with ``runs`` (start, length, period of each, by start and period; words are numbered from 0) and ``collapsed``.

    ``times`` is 4 at least and ``least`` 6 at least: shorter runs need not repeat five words.
    """
    if times < TIMES or least < LEAST:
        raise ValueError(f"runs have {TIMES} periods and {LEAST} words at least")
    base = docs.drop("runs", "collapsed")

    def chunks(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
        part, size = [], 0
        for text in texts:
            part.append((text or b"").split())  # bytes are cut at the six ASCII spaces only
            size += len(part[-1])
            if size >= CHUNK:
                yield part
                part, size = [], 0
        yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            found, texts = [], []
            for part in chunks(batch.column("utf8_").to_pylist()):
                for words, runs in zip(part, runs_of_texts(part, times, least), strict=True):
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    texts.append((kept(words, runs) if runs else b" ".join(words)).decode())
            columns = [*batch.columns[:-1], pa.array(found, kind), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "runs", "collapsed"])

    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in base.columns), "runs array<struct<start: bigint, length: bigint, period: bigint>>", "collapsed string"])
    carried = [F.col(f"`{c}`") for c in base.columns]
    return base.select(*carried, F.col(f"`{text_col}`").cast("binary").alias("utf8_")).mapInArrow(lean(run), schema)


def damaged(docs: DataFrame) -> DataFrame:
    """Texts whose id's checksum is divisible by 10 become periodic from a word on that the checksum gives; a null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hit = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    n = F.size("words")
    hit = hit.withColumn("n", n.cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    hit = hit.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")).withColumn("a", F.col("a").cast("int"))
    tail = F.transform(F.sequence(F.lit(0), (F.col("n") - F.col("a") - 1).cast("int")), lambda k: F.get("words", F.col("a") + k % F.col("p")))
    return hit.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def foremost(runs: Column) -> Column:
    """The run with the greatest length by period; ties: smallest start, then period."""

    def order(x: Column, y: Column) -> Column:
        more = y["length"] * x["period"] - x["length"] * y["period"]
        return F.when(more != 0, F.signum(more)).otherwise(F.signum(F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]))).cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its runs, the foremost of them and the collapsed text, as digests."""
    found = periodic_runs(damaged(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.col("best")
    return found.withColumn("best", foremost(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Pairs of equal words at distance q, found by five words in a row, stand in a line wherever a run is; of stretches found with several q the smallest is the period.
OP11_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) AS t),
docs AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS h
  FROM documents, crc),
places AS (SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM docs),
periods AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM places),
changed AS (SELECT k, doc_id, CASE WHEN a IS NULL THEN words ELSE list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS words FROM periods),
flat AS (SELECT k, unnest(words) AS w, unnest(range(len(words))) AS i FROM changed),
five AS (SELECT k, i, hash(w, lead(w, 1) OVER x, lead(w, 2) OVER x, lead(w, 3) OVER x, lead(w, 4) OVER x) AS g, lead(i, 4) OVER x AS whole FROM flat WINDOW x AS (PARTITION BY k ORDER BY i)),
pairs AS (SELECT a.k, a.i, b.i - a.i AS q FROM five a JOIN five b ON a.k = b.k AND a.g = b.g AND a.i < b.i WHERE a.whole IS NOT NULL AND b.whole IS NOT NULL),
islands AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM pairs),
lines AS (SELECT k, q, min(i) AS start, count(*) + 4 + q AS length FROM islands GROUP BY k, q, island),
runs AS (SELECT k, start, length, min(q) AS period FROM lines WHERE length >= greatest(6, 4 * q) GROUP BY k, start, length),
summed AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
  min(struct_pack(x := -CAST(length AS DOUBLE) / period, start := start, period := period, length := length)) AS best FROM runs GROUP BY k),
gone AS (SELECT DISTINCT f.k, f.i FROM flat f JOIN runs r ON f.k = r.k AND f.i >= r.start + r.period AND f.i < r.start + r.length),
left_over AS (SELECT k, string_agg(w, ' ' ORDER BY i) AS s FROM flat f WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.k = f.k AND g.i = f.i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(s, '')) AS collapsed_sha256
FROM changed LEFT JOIN summed USING (k) LEFT JOIN left_over USING (k)"""
