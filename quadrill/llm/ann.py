"""Approximate nearest neighbours by inner product with robust-pruned directed graphs.

Distinct vectors are dealt into shards by the magnitude of their norm (powers of two, so that long vectors don't hide all
others) and a hash. Each shard is a directed graph over the vectors' directions: greedy beam searches propose neighbours for a
vector, relaxed distance pruning keeps diverse edges, edges are added both ways and pruned again where a node has too many, and
nodes that no path reaches then are linked from their nearest.
Distances between directions keep graphs connected whatever the lengths; among lengths that differ by less than
a factor of two, directions and inner products have nearly the same neighbours. When a shard is built, nodes of it are asked for
and compared with brute force, and its beam is doubled until ``RECALL`` is reached. A query runs a beam search by inner
product in every shard, all of a shard is compared where a beam ends with fewer nodes than a result holds,
candidates are scored again on the original vectors in double precision and the best of all shards are kept.

Queries are cut into blocks; a task searches one block in one shard, so neither grows with the data. ``SHARD`` is what one task can
build (some 0.4 ms and 600 bytes a vector of 64 components); larger shards mean fewer searches for each query. Copies of a
vector are one node that keeps as many of its smallest ids as a result can hold. Vectors that are null, empty, zero, or hold
null or non-finite components take no part, neither as query nor as candidate. Vectors are compared only with
vectors of the same length. Ties go to the smaller id. Null ids take no part. Rows of one id with other vectors are queries of
their own (each has its ranks) and candidates of their own; equal rows are one. A query never finds rows of its own id. An
empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.llm.common import table, written

DEGREE, BEAM, ALPHA, WIDTH = 32, 64, 1.2, 4
#: Edges a node may have besides, to nodes that no path reaches else.
SPARE = 8
#: Distinct vectors a shard holds on average, and queries of a block.
SHARD, BLOCK = 24_000, 20_000
#: Share of the true neighbours that a shard's beam must find, measured on so many nodes of it.
RECALL, ASKED = 0.96, 128
#: Shards whose results are brought together first, so that no list grows with the number of shards.
FAN = 64


class Points:
    """Directions (unit vectors) and lengths, scaled so that the longest is 1."""

    def __init__(self, vectors: np.ndarray):
        top = np.abs(vectors).max(1)
        self.x = vectors / top[:, None]
        length = np.sqrt(np.einsum("nd,nd->n", self.x, self.x))
        self.x = (self.x / length[:, None]).astype(np.float32)
        self.length = (top / top.max() * length / length[top.argmax()]).astype(np.float32)

    def apart(self, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances [n, k] between the directions of ``at`` [n] and ``ids`` [n, k]; ids of -1 are infinitely far."""
        return np.where(ids < 0, np.inf, 2 - 2 * np.matmul(self.x[ids], self.x[at][:, :, None])[:, :, 0])

    def products(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Inner products with the queries, negated."""
        return np.where(ids < 0, np.inf, -self.length[ids] * np.matmul(self.x[ids], q[:, :, None])[:, :, 0])

    def every(self, q: np.ndarray) -> np.ndarray:
        return -(q @ self.x.T) * self.length


def search(q: np.ndarray, far: Callable[[np.ndarray, np.ndarray], np.ndarray], graph: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries at once: (ids, distances) nearest first, -1 where a beam isn't full; ``far`` gives distances of queries to ids."""
    n = len(q)
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    start = entries[:beam]
    first = far(q, np.broadcast_to(start, (n, len(start)))).astype(np.float32)
    order = np.argsort(first, 1, kind="stable")
    ids[:, : len(start)], dist[:, : len(start)] = start[order], np.take_along_axis(first, order, 1)
    done = ids < 0
    live = np.arange(n)
    while len(live):
        own_ids, own_dist, own_done = ids[live], dist[live], done[live]
        rank = np.where(own_done, np.inf, own_dist)
        pick = np.argpartition(rank, min(WIDTH, beam) - 1, 1)[:, :WIDTH]
        fresh = np.isfinite(np.take_along_axis(rank, pick, 1))
        np.put_along_axis(own_done, pick, True, 1)
        near = graph[np.where(fresh, np.take_along_axis(own_ids, pick, 1), -1)]
        near[~fresh] = -1
        near = near.reshape(len(live), -1)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        d = far(q[live], near).astype(np.float32)
        d[d > own_dist[:, -1:]] = np.inf
        # what is in the beam already has the very same distance; only those few pairs are compared
        both = np.concatenate([own_ids, np.where(np.isinf(d), -1, near)], 1)
        every = np.concatenate([own_dist, d], 1)
        flags = np.concatenate([own_done, np.zeros(d.shape, bool)], 1)
        order = np.argsort(both, 1, kind="stable")
        same = np.take_along_axis(both, order, 1)
        twice = np.zeros(both.shape, bool)
        np.put_along_axis(twice, order[:, 1:], (same[:, 1:] == same[:, :-1]) & (same[:, 1:] >= 0), 1)
        every[twice] = np.inf
        order = np.argsort(every, 1, kind="stable")[:, :beam]
        ids[live], dist[live] = np.take_along_axis(both, order, 1), np.take_along_axis(every, order, 1)
        done[live] = np.take_along_axis(flags, order, 1) | np.isinf(dist[live])
        ids[live] = np.where(np.isinf(dist[live]), -1, ids[live])
        live = live[~done[live].all(1)]
    return ids, dist


def prune(points: np.ndarray, cand: np.ndarray, dist: np.ndarray, own: Points, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of candidate lists [points, c]: keep the nearest, drop what it covers, and so on."""
    dist = np.where((cand < 0) | (cand == points[:, None]), np.inf, dist)
    order = np.argsort(dist, 1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    vec = own.x[cand]
    between = 2 - 2 * np.matmul(vec, vec.transpose(0, 2, 1))
    out = np.full((len(points), degree), -1, np.int64)
    alive = np.isfinite(dist)
    rows = np.arange(len(points))
    for k in range(degree):
        best = alive.argmax(1)
        some = alive[rows, best]
        if not some.any():
            break
        out[some, k] = cand[rows, best][some]
        alive &= ~(alpha * between[rows, best] <= dist) | ~some[:, None]
        alive[rows[some], best[some]] = False
    return out


class Graph:
    """One shard: its points, its edges, its entry points. With ``edges`` it is one built before."""

    def __init__(self, vectors: np.ndarray, seed: int = 0, edges: np.ndarray | None = None, entries: np.ndarray | None = None):
        self.points = Points(vectors)
        n = len(vectors)
        if edges is not None:
            self.graph, self.entries = edges, entries
            return
        self.graph = np.full((n, DEGREE + SPARE), -1, np.int64)
        order = np.random.default_rng(seed).permutation(n)
        self.entries = order[:32]
        done = min(n, 256)
        first = order[:done]
        every = np.broadcast_to(first, (done, done))
        self.graph[first, :DEGREE] = prune(first, every, self.points.apart(first, every), self.points)
        while done < n:
            batch = order[done : done + min(done, 2048)]
            for i in range(0, len(batch), 512):
                part = batch[i : i + 512]
                ids, dist = search(part, self.points.apart, self.graph, self.entries, BEAM)
                self.graph[part, :DEGREE] = prune(part, ids, dist, self.points)
            self.link_back(batch)
            done += len(batch)
        self.reach_all()

    def reached(self) -> np.ndarray:
        """Which nodes paths from the entry points reach."""
        seen = np.zeros(len(self.graph), bool)
        now = np.unique(self.entries)
        while len(now):
            seen[now] = True
            near = np.unique(self.graph[now])
            near = near[near >= 0]
            now = near[~seen[near]]
        return seen

    def reach_all(self) -> None:
        """Pruning can leave a node without an edge that leads to it (one far from all others, most often): link it from its nearest."""
        lost = np.flatnonzero(~self.reached())
        room = np.full(len(self.graph), SPARE)
        below: dict[int, deque[int]] = {}
        for i in range(0, len(lost), 512):
            part = lost[i : i + 512]
            for node, near in zip(part.tolist(), search(part, self.points.apart, self.graph, self.entries, BEAM)[0].tolist(), strict=True):
                near = [x for x in near if x >= 0 and x != node]
                at = next((x for x in near if room[x]), None)
                if at is None:  # all around are full: go on from the nodes linked last
                    queue = below.setdefault(near[0], deque(near[:1]))
                    while not room[queue[0]]:
                        queue.extend(self.graph[queue.popleft(), DEGREE:].tolist())
                    at = queue[0]
                self.graph[at, DEGREE + SPARE - room[at]] = node
                room[at] -= 1

    def link_back(self, batch: np.ndarray) -> None:
        """Add each new edge the other way round; nodes with too many edges are pruned again."""
        source, target = np.repeat(batch, DEGREE), self.graph[batch, :DEGREE].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
        for size in np.unique(np.minimum(-(-counts // DEGREE), 8)):
            # lists of like length together; a longer list is pruned in rounds of eight times the degree
            own = np.flatnonzero(np.minimum(-(-counts // DEGREE), 8) == size)
            step = int(size) * DEGREE
            for lap in range(int(-(-counts[own].max() // step))):
                todo = own[counts[own] > lap * step]
                for i in range(0, len(todo), 512):
                    at = todo[i : i + 512]
                    col = np.arange(lap * step, (lap + 1) * step)
                    new = np.where(col[None] < counts[at][:, None], source[np.minimum(starts[at][:, None] + col[None], len(source) - 1)], -1)
                    node = nodes[at]
                    cand = np.concatenate([self.graph[node, :DEGREE], new], 1)
                    full = (cand >= 0).sum(1) > DEGREE
                    left = ~full
                    if left.any():
                        self.graph[node[left], :DEGREE] = -np.sort(-cand[left], 1)[:, :DEGREE]
                    if full.any():
                        self.graph[node[full], :DEGREE] = prune(node[full], cand[full], self.points.apart(node[full], cand[full]), self.points)

    def beam_for(self, k: int, beam: int, seed: int = 0) -> int:
        """``beam``, doubled until the beams of a few nodes hold ``RECALL`` of their k nearest."""
        n = len(self.points.x)
        at = np.random.default_rng(seed).permutation(n)[:ASKED]
        near = self.points.every(self.points.x[at])
        k = min(k, n)
        last = np.partition(near, k - 1, 1)[:, k - 1] + 1e-6  # whatever is as near as the k-th is right: ties have no order
        while beam < n:
            found = np.concatenate([d for _, d in self.beams(self.points.x[at], beam)])
            if np.minimum((found <= last[:, None]).sum(1), k).mean() / k >= RECALL:
                break
            beam *= 2
        return beam

    def beams(self, q: np.ndarray, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, distances) of a few hundred queries at a time, of fewer where beams are wide."""
        step = max(8, 512 * 192 // max(beam, 192))
        for i in range(0, len(q), step):
            yield search(q[i : i + step], self.points.products, self.graph, self.entries, beam)

    def nearest(self, q: np.ndarray, beam: int, least: int) -> Iterator[np.ndarray]:
        """Node ids of each query's beam; where it holds fewer than ``least`` of the nodes, the nearest of all."""
        top = np.abs(q).max(1, keepdims=True)
        q, n, at = (q / top).astype(np.float32), len(self.points.x), 0
        for found, _ in self.beams(q, beam):
            for own in found:
                own = own[own >= 0]
                if len(own) < min(least, n):
                    own = np.argsort(self.points.every(q[at]), kind="stable")[:beam]
                yield own
                at += 1


def usable(c: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    v = F.transform(c, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(~bad, F.lit(False)) & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False)))


def search_all(vectors: DataFrame, queries: DataFrame, k: int = 20, beam: int = 192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query, itself left out."""
    keep = k + 1

    def first_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[bytes, list[int]] = {}
            for i, v in zip(pdf["id"], pdf["v"], strict=True):
                found.setdefault(np.asarray(v, np.float64).tobytes(), []).append(int(i))
            yield pd.DataFrame({"vec": list(found), "ids": [sorted(set(x))[:keep] for x in found.values()]})

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [np.frombuffer(v, np.float64) for v in pdf["vec"]]
            top = np.array([np.abs(v).max() for v in x])
            norm = np.log2(top) + np.array([np.log2(np.sqrt(((v / m) ** 2).sum())) for v, m in zip(x, top, strict=True)]) if len(x) else top
            yield pd.DataFrame({"dim": [len(v) for v in x], "band": np.floor(norm + 0.5).astype(np.int32), "vec": pdf["vec"], "ids": pdf["ids"]})

    def picked(df: DataFrame) -> DataFrame:
        # + 0.0: the two zeros are one
        return df.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))

    # few ids of each vector whatever the number of its copies: first in each batch, then in each part of the batches
    copies = picked(vectors).mapInPandas(first_ids, "vec binary, ids array<long>").withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(FAN)))
    few = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    nodes = copies.groupBy("vec", "part").agg(few).groupBy("vec").agg(few)
    nodes = nodes.mapInPandas(banded, "dim int, band int, vec binary, ids array<long>")
    nodes, asked = written(nodes, "nodes"), written(picked(queries), "queries")
    # as many rows as there are lengths and magnitudes (powers of two in a double: 2,200 at most)
    sizes = nodes.groupBy("dim", "band").agg(F.count("*").alias("n"))
    sizes = written(sizes.select("dim", "band", F.greatest(F.lit(1), F.ceil(F.col("n") / SHARD)).cast("int").alias("parts")), "sizes")
    shards = sizes.agg(F.sum("parts")).first()[0] or 1
    blocks = max(1, -(-asked.count() // BLOCK))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec")
        x = np.stack([np.frombuffer(v, np.float64) for v in pdf["vec"]])
        g = Graph(x, seed=key[2])
        ids = pdf["ids"].tolist()
        return pd.DataFrame({"dim": [key[0]], "band": [key[1]], "shard": [key[2]], "x": [x.tobytes()], "edges": [g.graph.astype(np.int32).tobytes()], "entries": [g.entries.astype(np.int32).tobytes()], "beam": [g.beam_for(keep, beam, key[2])], "ids": [np.concatenate(ids).astype(np.int64).tobytes()], "counts": [np.array([len(i) for i in ids], np.int32).tobytes()]})

    keys = ["dim", "band", "shard"]
    dealt = nodes.join(F.broadcast(sizes), ["dim", "band"]).select("dim", "band", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int").alias("shard"), "vec", "ids")
    # by number: adaptive execution would join small shards that take long into one task
    dealt = dealt.repartition(min(shards, 20_000), *keys).groupBy(*keys)
    graphs = written(dealt.applyInPandas(build, "dim int, band int, shard int, x binary, edges binary, entries binary, beam int, ids binary, counts binary"), "graphs")

    def ask(key: tuple, shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(block):
            return pd.DataFrame({"query_id": [], "version": [], "vec_id": [], "score": [], "part": []}).astype({"query_id": "int64", "version": "int64", "vec_id": "int64", "score": "float64", "part": "int32"})
        row, dim = shard.iloc[0], key[0]
        x = np.frombuffer(row["x"], np.float64).reshape(-1, dim)
        g = Graph(x, 0, np.frombuffer(row["edges"], np.int32).reshape(len(x), -1), np.frombuffer(row["entries"], np.int32))
        counts, ids = np.frombuffer(row["counts"], np.int32), np.frombuffer(row["ids"], np.int64)
        starts = np.cumsum(np.r_[0, counts[:-1]])
        q = np.stack(block["v"].to_numpy())
        out_q, out_n, out_v, out_s = [], [], [], []
        for i, own in enumerate(g.nearest(q, int(row["beam"]), keep)):
            with np.errstate(over="ignore"):
                score = (x[own] * q[i]).sum(1)
            n = counts[own]
            at = np.repeat(starts[own] - np.r_[0, n.cumsum()[:-1]], n) + np.arange(n.sum())
            members, scores = ids[at], np.repeat(score, n)
            ok = members != block["id"].iat[i]
            members, scores = members[ok], scores[ok]
            top = np.lexsort((members, -scores))[:k]
            out_q.append(block["id"].iat[i])
            out_n.append(len(top))
            out_v.append(members[top])
            out_s.append(scores[top])
        versions = np.repeat(block["version"].to_numpy(np.int64), out_n)
        return pd.DataFrame({"query_id": np.repeat(np.array(out_q, np.int64), out_n), "version": versions, "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s), "part": np.int32((key[1] * 31 + key[2]) % FAN)})

    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.select("id", "v", F.xxhash64("v").alias("version")).dropDuplicates(["id", "version"]).withColumn("dim", F.size("v"))
    every = sizes.select("dim", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("shard"))
    right = asked.withColumn("block", F.pmod(F.xxhash64("id", "version"), F.lit(blocks)).cast("int")).join(F.broadcast(every) if shards <= 1_000_000 else every, "dim")
    tasks = max(1, min(shards * blocks, 20_000))
    keys = [*keys, "block"]
    schema = "query_id long, version long, vec_id long, score double, part int"
    found = left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(ask, schema)
    one = ["query_id", "version"]
    listed = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    found = found.withColumn("best", F.array(F.struct((-F.col("score")).alias("far"), "vec_id")))
    best = found.groupBy(*one, "part").agg(listed).groupBy(*one).agg(listed)
    out = best.select("query_id", F.posexplode("best").alias("rank", "one"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "one.vec_id", (-F.col("one.far")).alias("score"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search_all(vectors, vectors.where("vec_id % 20 = 0"))
