"""N-gram Jaccard join with several global orders.

Documents are sets of word shingles; two link when their Jaccard similarity is at least 0.8. The result gives
each document the smallest id that it can reach by links.

1. A sketch counts shingles in bins (a fixed number of counters). A first global order sorts tokens by their bin's
   count. Linked documents share a known least number of tokens of their prefixes under it; documents that
   share fewer with all others together link with nothing and leave the join here. Tokens of crowded bins count as
   shared and aren't dealt out, so no group here is larger than an uncrowded bin.
2. For the rest, equal sets become one node. Tokens that no other node has can't be shared, so only the others are
   ordered: rarest first, and by two hashes. A pair is a candidate if it shares a prefix token under the first order
   and under both others, and if what can be shared suffices for its sizes.
3. Within the nodes of a token all are compared with one centre first, the node with most shared tokens. Pairs
   within a component that this finds need no comparison any more; all others are compared then, so no
   link between components is lost and the copies in a large group are never paired with each other.

Null and empty texts have empty sets and link with nothing; their component is their own id. Texts of any length are hashed whole. Rows with
a null id get a null component and link nothing. Repeated rows and equal texts share a component, ties have no order to break: a component
is its smallest id. Rows of one id but other texts are one document with several sets: it links with whatever one of them links with. An
empty table gives no rows. Other columns are not read, whatever their names; ``one_of_each`` returns all of them (``version_`` is used inside).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrill.llm.common import forget, lean, table, written
from quadrill.llm.components import components
from quadrill.llm.shingles import mix, shingle_sets, signature

#: Similarity as a fraction: 100 * intersection >= 80 * union, so 9 * intersection >= 4 * (size + size).
BINS = 1 << 18
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Documents up to which a filter of their ids finds their texts again; beyond, the ids are joined.
MOST_FILTERED = 4_000_000


def need(n: np.ndarray | int, m: np.ndarray | int):
    """Least intersection of sets of n and m tokens that link."""
    return -(-4 * (n + m) // 9)


def least_partner(n):
    return -(-4 * n // 5)


def pieces(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    for i in range(0, len(pdf), 500):
        part = pdf.iloc[i : i + 500]
        yield part, list(shingle_sets(part["text"].tolist()))


def sketch(source: DataFrame) -> np.ndarray:
    """How many shingles (once for each document) fall into each bin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BINS, np.int64)
        for pdf in batches:
            for _, sets in pieces(pdf):
                counts += np.bincount((np.concatenate(sets) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"bin": at.astype(np.int32), "n": counts[at]})

    # one row for each bin at most
    got = source.select("text").mapInPandas(lean(run), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BINS, np.int64)
    out[got["bin"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def crowded(counts: np.ndarray) -> int:
    """The count from which a bin is crowded: far beyond what uniform hashing gives."""
    mean = float(np.median(counts))
    return int(mean + 8 * np.sqrt(mean) + 64)


def extra(n):
    """Tokens by which prefixes under the first order are longer, and so many more must be shared."""
    return n // 10


def first_prefixes(source: DataFrame, counts, limit: int, bits: int) -> DataFrame:
    """(doc_id, version, n, h1, h2, hot, tokens): set size and signature; of the first order's prefix the number of crowded tokens and the last ``bits`` bits of the others."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = counts.value
        for pdf in batches:
            for part, sets in pieces(pdf):
                hot, prefix, sig = [], [], []
                for own in sets:
                    n = len(own)
                    load = bins[(own % np.uint64(BINS)).astype(np.int64)]
                    order = np.lexsort((own, load))[: n - int(least_partner(n)) + max(1, extra(n))] if n else np.zeros(0, np.int64)
                    cool = load[order] < limit
                    hot.append(int((~cool).sum()))
                    prefix.append((own[order[cool]] & mask).view(np.int64))
                    sig.append(signature(own))
                yield pd.DataFrame({"doc_id": part["doc_id"], "version": part["version"], "n": [len(s) for s in sets], "h1": [a for a, _ in sig], "h2": [b for _, b in sig], "hot": hot, "tokens": prefix})

    return source.mapInPandas(lean(run), "doc_id long, version long, n long, h1 long, h2 long, hot int, tokens array<long>")


def shared_counts(sized: DataFrame) -> DataFrame:
    """(h1, shared): how many prefix tokens of each set another set's prefix has.

    Tokens are dealt by hash and sorted by Spark, which spills; a task reads its sorted rows batch by batch and carries one row along.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, met = np.zeros((0, 2), np.int64), False  # the last distinct row, and whether the one before had its token
        for pdf in batches:
            rows = np.concatenate([last, pdf.to_numpy(np.int64)])
            if not len(rows):
                continue
            rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(1)]]
            same = rows[1:, 0] == rows[:-1, 0]
            before = np.r_[met, same]
            yield pd.DataFrame({"h1": rows[:-1, 1][before[:-1] | same]})
            last, met = rows[-1:], bool(before[-1])
        if met:
            yield pd.DataFrame({"h1": last[:, 1]})

    rows = sized.select(F.explode("tokens").alias("token"), "h1").repartition("token").sortWithinPartitions("token", "h1")
    return rows.mapInPandas(lean(run), "h1 long").groupBy("h1").agg(F.count("*").alias("shared"))


def bit_places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Four bit places of each id [4, ids]."""
    with np.errstate(over="ignore"):
        h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return np.stack([mix(h + np.uint64(k)) % np.uint64(bits) for k in range(4)]).astype(np.int64)


def id_filter(ids: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of at most ``MOST_FILTERED`` ids (2^26 bits): those it lets through in vain only cost time."""
    bits = 1 << min(26, max(16, int(12 * max(n, 1)).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.unique(bit_places(pdf["doc_id"].to_numpy(np.int64), bits))
            yield pd.DataFrame({"word": at >> 5, "mask": np.int64(1) << (at & 31)})

    got = ids.mapInPandas(lean(run), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(bits >> 5, np.uint32)
    out[got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64).astype(np.uint32)
    return out


def tokens_of(source: DataFrame, ids, counts, limit: int) -> DataFrame:
    """(doc_id, n, cool, hot, load) of the documents that the filter (None: any) lets through: all their tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = counts.value
        for pdf in batches:
            pdf = pdf[pdf["doc_id"].notna()]
            if ids is not None:
                known = ids.value
                at = bit_places(pdf["doc_id"].to_numpy(np.int64), len(known) << 5)
                pdf = pdf[((known[at >> 5] >> (at & 31).astype(np.uint32)) & 1).all(0)]
            for part, sets in pieces(pdf):
                cool, hot, loads = [], [], []
                for own in sets:
                    load = bins[(own % np.uint64(BINS)).astype(np.int64)]
                    warm = load >= limit
                    cool.append(own[~warm].view(np.int64))
                    hot.append(own[warm].view(np.int64))
                    loads.append(load[warm])
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("int64"), "n": [len(s) for s in sets], "cool": cool, "hot": hot, "load": loads})

    return source.mapInPandas(lean(run), "doc_id long, n long, cool array<long>, hot array<long>, load array<long>")


def ordered(nodes: DataFrame) -> DataFrame:
    """(doc_id, n, tokens, probe, kept, second, third): shared tokens in the first order, and the prefixes of all orders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, n, shared, hot, load in zip(pdf["doc_id"], pdf["n"], pdf["shared"], pdf["hot"], pdf["load"], strict=True):
                own = [] if shared is None else shared
                token = np.array([*(x["token"] for x in own), *hot], np.int64)
                df = np.array([*(x["df"] for x in own), *load], np.int64)
                s, low, same = len(token), int(least_partner(n)), int(need(n, n))
                if s < low:
                    continue
                bits = token.view(np.uint64)
                with np.errstate(over="ignore"):
                    orders = [np.lexsort((token, df)), np.argsort(mix(bits + np.uint64(77)), kind="stable"), np.argsort(mix(bits ^ np.uint64(0x123456789ABCDEF)), kind="stable")]
                first = token[orders[0]]
                rows.append((doc, n, s, first, first[: s - low + 1], first[: max(0, s - same + 1)], token[orders[1]][: s - low + 1], token[orders[2]][: s - low + 1]))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "s", "tokens", "probe", "kept", "second", "third"])

    return nodes.mapInPandas(lean(run), "doc_id long, n long, s long, tokens array<long>, probe array<long>, kept array<long>, second array<long>, third array<long>")


ENOUGH = "ceil(4 * (n + n_b) / 9.0) <= least(s, s_b)"
#: Two nodes have in common at most what both have in common with the centre, and of the rest the smaller part.
NEAR = "common IS NULL OR common_b IS NULL OR ceil(4 * (n + n_b) / 9.0) <= least(common, common_b) + least(s - common, s_b - common_b)"


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, linked) of pairs that share prefix tokens under the other orders too: their intersection, and whether it suffices.

    Prefixes are short and decide first; whole sets travel only to the pairs that remain.
    """

    def beside(df: DataFrame, cols: list[str]) -> DataFrame:
        for side in "ab":
            df = df.join(sets.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in cols)), side)
        return df

    some = beside(pairs, ["second", "third"]).where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")
    both = beside(some, ["n", "tokens"])
    both = both.select("a", "b", F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long").alias("common"), (F.col("n_a") + F.col("n_b")).alias("sizes"))
    return both.select("a", "b", "common", (9 * F.col("common") >= 4 * F.col("sizes")).alias("linked"))


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return versions(docs, id_col, text_col).drop("version")


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``joined`` with ``version``, a hash of the text."""
    spark = docs.sparkSession
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(int(before), 1000)))  # whole texts go to Python: small batches keep its memory low
    try:
        return _joined(spark, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version")))
    finally:
        spark.conf.set(BATCH, before)


def _joined(spark: SparkSession, source: DataFrame) -> DataFrame:
    bins = sketch(source)
    limit = crowded(bins)
    counts = spark.sparkContext.broadcast(bins)  # BINS counters, whatever the input
    # so many bits that few prefix tokens meet by chance; those that do only cost time
    bits = min(63, int(bins.sum()).bit_length() + 6)

    every = written(first_prefixes(source, counts, limit, bits), "prefixes")
    sized = every.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(sized.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("hot").alias("hot")), "classes")
    shared = shared_counts(sized)
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * 4 / 5) / 10))
    active = classes.join(shared, "h1", "left").where(F.coalesce("shared", F.lit(0)) + F.col("hot") >= least).select(F.col("rep").alias("doc_id"))
    small = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "20000")  # pairs of numbers
    active = written(active, "active")
    spark.conf.set(BATCH, small)
    slim = written(every.select("doc_id", "version", "n", "h1", "h2"), "sizes")
    forget(every)
    n = active.count()
    known = spark.sparkContext.broadcast(id_filter(active, n)) if n <= MOST_FILTERED else None
    texts = source.select("doc_id", "text")
    nodes = written(tokens_of(texts if known is not None else texts.join(active, "doc_id", "left_semi"), known, counts, limit), "nodes")
    # how many documents have a token, beside each of its rows: one sort, which spills, and no list of documents
    df = F.count("*").over(Window.partitionBy("token")).alias("df")
    cool = nodes.select("doc_id", F.explode("cool").alias("token")).select("doc_id", "token", df).where("df > 1")
    shared = cool.groupBy("doc_id").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
    sets = written(ordered(nodes.select("doc_id", "n", "hot", "load").join(shared, "doc_id", "left")), "sets")
    forget(nodes, active)

    probes = sets.select("doc_id", "n", "s", F.explode("probe").alias("token"))
    kept = sets.select("doc_id", "n", "s", F.explode("kept").alias("token"))
    centres = kept.groupBy("token").agg(F.max(F.struct("s", (-F.col("doc_id")).alias("minus"), "n")).alias("c"), F.count("*").alias("members"))
    centres = written(centres.select("token", (-F.col("c.minus")).alias("doc_b"), F.col("c.n").alias("n_b"), F.col("c.s").alias("s_b")), "centres")
    pair = [F.least("doc_id", "doc_b").alias("a"), F.greatest("doc_id", "doc_b").alias("b")]
    stars = probes.join(centres, "token").where("doc_id <> doc_b").where(ENOUGH).select(*pair).distinct()
    met = written(compared(stars, sets), "met")
    links = met.where("linked").select("a", "b")

    roots = components(links)
    label = lambda df: df.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    named = written(label(sets.select("doc_id", "n", "s", "probe", "kept")), "named")
    members = named.select("doc_id", "n", "s", "root", F.explode("kept").alias("token"))
    mixed = members.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("n_low"))
    mixed = written(mixed.join(centres.select("token", F.col("doc_b").alias("centre")), "token"), "mixed")
    # only probes that meet another component, and whose own tokens allow a partner as small as the group's smallest
    asking = named.select("doc_id", "n", "s", "root", F.explode("probe").alias("token")).join(mixed, "token")
    asking = asking.where("(low <> root OR high <> root) AND ceil(4 * (n + n_low) / 9.0) <= s").drop("low", "high", "n_low")
    # what a node has in common with its group's centre bounds what two nodes of the group can have in common
    known_common = met.select(F.col("a").alias("doc_id"), F.col("b").alias("centre"), "common").unionByName(met.select(F.col("b").alias("doc_id"), F.col("a").alias("centre"), "common"))
    known_common = written(known_common, "common")
    withs = lambda df: df.join(known_common, ["doc_id", "centre"], "left").withColumn("common", F.when(F.col("doc_id") == F.col("centre"), F.col("s")).otherwise(F.col("common")))
    asking = written(withs(asking), "asking")
    others = members.join(asking.select("token").distinct(), "token", "left_semi").join(mixed.select("token", "centre"), "token")
    others = withs(others).select("token", F.col("doc_id").alias("doc_b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"), F.col("root").alias("root_b"), F.col("common").alias("common_b"))
    others = written(others, "others")
    rest = asking.join(others, "token").where("root <> root_b AND (n_b < n OR (n_b = n AND doc_b < doc_id)) AND 5 * n_b >= 4 * n").where(ENOUGH).where(NEAR)
    rest = rest.select(*pair).distinct()
    more = written(compared(rest, sets).where("linked").select("a", "b"), "more")
    final = components(links.unionByName(more)) if more.limit(1).count() else roots

    # one join by set: single documents without a link keep their own id
    ends = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("root", "rep").alias("root"), "rep", "copies")
    ends = written(ends.where("copies > 1 OR root <> rep").select("h1", "h2", "n", "root"), "ends")
    out = slim.join(ends, ["h1", "h2", "n"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "version", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.coalesce("root", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, most_broadcast: int = 2_000_000) -> DataFrame:
    """One document of each component: the one with the smallest id, once. Rows without an id, and rows without a word, stay.

    Rows are told apart by id and text, so other texts of an id stay where only one is a copy. Keys of rows to drop are broadcast up
    to ``most_broadcast`` of 16 bytes, else joined.
    """
    found = written(versions(docs).where("doc_id IS NOT NULL AND n_shingles > 0"), "found")
    key = ["doc_id", "version"]
    drop = written(found.where("doc_id <> component_id").select(*key).distinct(), "drop")
    key = ["doc_id", "version_"]
    drop, found = (df.withColumnRenamed("version", "version_") for df in (drop, found))
    kept = docs.withColumn("version_", F.xxhash64("text")).join(F.broadcast(drop) if drop.count() <= most_broadcast else drop, key, "left_anti")
    twice = written(found.where("doc_id = component_id").groupBy(*key).agg(F.count("*").alias("n_")).where("n_ > 1").select(*key), "twice")
    if n := twice.count():
        # only rows that stand several times are brought together
        side = F.broadcast(twice) if n <= most_broadcast else twice
        kept = kept.join(side, key, "left_anti").unionByName(kept.join(side, key, "left_semi").dropDuplicates(key))
    return kept.drop("version_")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sh AS (
  SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(CASE WHEN len(words) >= 5 THEN [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS x FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS id, a AS root FROM edges UNION SELECT e.b, reach.root FROM reach JOIN edges e ON e.a = reach.id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(root) AS root FROM reach GROUP BY id) USING (doc_id)
"""
