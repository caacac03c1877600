"""Vector best-fit packing of documents into sequences of bounded tokens, documents and attention cost.

A piece of n tokens is the vector (n, 1, n^2): tokens, documents, attention cost. Pieces are placed longest first; each goes to a sequence
that it fits under every constraint, chosen by the smallest weighted norm of what would be left there (``norm``) or by the largest weighted
dot product of the piece with what is left now (``dot``); ties go to the sequence opened first; a new one is opened only where none fits.

The vector depends on the length alone, so the packing does too: Spark counts pieces by length (at most ``capacity`` rows, whatever the
data), and best-fit runs over that table, a group of like sequences at a time. Its placements say, for each length, which ranks go to which
sequences. Pieces get their rank within a length from buckets of some ``BUCKET`` rows, so a length that a third of all pieces have is spread as well.
Texts are tokenised once, in place; only numbers are shuffled.

Null and empty texts are the end token alone. Texts of any length are read whole; only documents of more than the longest piece allowed
are cut. Repeated rows are packed each for itself, also those with a null id. An empty table gives no rows. Columns of the
input besides id and text are left out.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrill.llm.common import lean, table, trim, written

#: Rows that a bucket of one length holds on average.
BUCKET = 4_000
#: Characters that are tokenised together, half the words that a worker remembers, and the longest of them.
CHUNK, MOST_WORDS, LONGEST_WORD = 8_000_000, 250_000, 40
#: Words that are tokenised together, and marks that are tokens of their own at the end of a word.
TOGETHER, MARKS = 500, ".,!?;:"
#: A word of its own that stands between two others while they are tokenised.
BREAK = "\x01"


@dataclass(frozen=True)
class PackConfig:
    """Capacities of a sequence, the weight of each in the choice, and the rule of choice."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    rule: str = "norm"

    def __post_init__(self):
        if self.rule not in ("norm", "dot"):
            raise ValueError(f"unknown rule {self.rule!r}")
        if min(self.tokens, self.documents, self.cost) < 1 or min(self.weights) < 0:
            raise ValueError("capacities are positive, weights are not negative")

    @property
    def longest(self) -> int:
        """The longest piece that an empty sequence can take."""
        return min(self.tokens, math.isqrt(self.cost))


def place(lengths: list[int], counts: list[int], config: PackConfig) -> np.ndarray:
    """Placements (length, rank, each, sequences, first sequence, offset): pieces of that length from that rank on go to so many sequences, ``each`` to one.

    Like sequences are one group: a row of ``used`` and a range of numbers. By ``norm`` a sequence that took a piece is the best one for the next of
    its length, so it takes as many as fit; by ``dot`` it is worse than its like, so the whole group takes one each. New ones are opened one after
    the other, and each is the only one that fits until it is full. All this is what placing piece by piece gives.
    """
    cap = np.array([config.tokens, config.documents, config.cost], np.int64)
    weights = np.array(config.weights)
    used, first, many = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out, opened = [], 0
    types = sorted(((n, c) for n, c in zip(lengths, counts, strict=True) if c), reverse=True)
    if types and not 0 < types[0][0] <= config.longest:
        raise ValueError(f"no sequence can take a piece of {types[0][0]} tokens")
    smallest = types[-1][0] if types else 0
    least = np.array([smallest, 1, smallest * smallest])
    for n, left in types:
        v, rank = np.array([n, 1, n * n], np.int64), 0
        most = int((cap // v).min())
        while left:
            fits = np.flatnonzero((used + v <= cap).all(1))
            if len(fits):
                free = (cap - used[fits]) / cap
                score = ((free - v / cap) ** 2 @ weights) if config.rule == "norm" else -(free * (v / cap)) @ weights
                best = score.min()
                same = fits[score <= best + 1e-12]
                g = int(same[first[same].argmin()])
                each = int(((cap - used[g]) // v).min()) if config.rule == "norm" else 1
                size, at, base = int(many[g]), int(first[g]), used[g]
            else:
                g, base, at = -1, np.zeros(3, np.int64), opened
                each, size = most, -(-left // most)
            each = min(each, left)
            taken = min(size, left // each)
            out.append((n, rank, each, taken, at, int(base[0])))
            rank, left = rank + each * taken, left - each * taken
            if g < 0:
                opened += taken
            else:
                many[g] -= taken
                first[g] += taken
                if not many[g]:
                    used, first, many = (np.delete(x, g, 0) for x in (used, first, many))
            after = base + each * v
            if (after + least <= cap).all():  # a full sequence is never asked again
                used, first, many = np.vstack([used, after]), np.append(first, at), np.append(many, taken)
    return np.array(out, np.int64).reshape(-1, 6)


class Vocabulary:
    """A tokenizer that remembers what words become. A text's white space is dropped and its words are tokenised apart, so words may be taken one by one.

    Texts are cut at blanks and line ends only; what else counts as white space is left to the tokenizer. It lowers case, so texts of Latin-1
    letters are lowered first, unless a special token might be in them. A mark after a word's last letter or digit is learnt apart from the word. Words are
    remembered in two generations: when the younger is full, it becomes the older, from which words that occur again come back.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.border = self.ids([BREAK])
        self.marks = {m: self.plain(m) for m in MARKS}
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(size)])

    def ids(self, words: list[str]) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")

    def plain(self, word: str) -> bytes:
        return self.ids([word]).tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words as little-endian bytes."""
        stems = {w: w[:-1] for w in words if w and w[-1] in self.marks and w[:-1] and w[-2].isalnum()}
        new = set(words).difference(stems).union(stems.values())
        found = {w: self.known[w] for w in new if w in self.known}
        letters, others = [], []
        for w in new:
            if w not in found:
                (letters if w.isalpha() and w.isascii() else others).append(w)
        for i in range(0, len(letters), TOGETHER):
            self.split(found, part := letters[i : i + TOGETHER], ids := self.ids(part), np.flatnonzero(self.ends[ids]) + 1, 0)
        for i in range(0, len(others), TOGETHER):
            part = [w for w in others[i : i + TOGETHER] if BREAK not in w] if len(self.border) == 1 else []
            ids = self.ids([x for w in part for x in (w, BREAK)])
            self.split(found, part, ids, np.flatnonzero(ids == self.border[0]), 4)
        for w in others:
            if w not in found:
                found[w] = self.plain(w)
        return found | {w: found[stem] + self.marks[w[-1]] for w, stem in stems.items()}

    def split(self, found: dict[str, bytes], words: list[str], ids: np.ndarray, ends: np.ndarray, skip: int) -> None:
        """Add the ids of each word, which end where ``ends`` says; ``skip`` bytes follow."""
        if len(ends) != len(words):
            raise ValueError("the tokenizer doesn't keep words apart")
        data, begin = ids.tobytes(), 0
        for w, end in zip(words, (4 * ends).tolist(), strict=True):
            found[w] = data[begin:end]
            begin = end + skip

    def lowered(self, text: str) -> str:
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes: Arrow cuts texts and numbers their words, so only different words are looked up."""
        lists = pc.split_pattern(pa.array([self.lowered(t) for t in texts], pa.large_string()), " ")
        numbered = lists.flatten().dictionary_encode()
        words = numbered.dictionary.to_pylist()
        found = list(map(self.known.get, words))
        new = [w for w, x in zip(words, found, strict=True) if x is None]
        again = {w: self.older[w] for w in new if w in self.older}
        self.known |= again
        learnt = self.learn([w for w in new if w not in again])
        self.known |= learnt
        each = pa.array([self.known[w] if x is None else x for w, x in zip(words, found, strict=True)], pa.large_binary()).take(numbered.indices)
        for w in learnt:
            if len(w) > LONGEST_WORD:
                del self.known[w]
        if len(self.known) > MOST_WORDS:
            self.older, self.known = self.known, {}
        if not len(each):
            return [b""] * len(texts)
        _, ends, data = each.buffers()
        ends = np.frombuffer(ends, np.int64)[each.offset : each.offset + len(each) + 1]
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        cuts, data = ends[first].tolist(), memoryview(data) if data is not None else b""
        return [bytes(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each worker and file."""
    if path not in _vocabularies:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def pieces(docs: DataFrame, path: str, longest: int, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and the end token, cut where they are more than ``longest``."""

    def chunks(texts: list[str]) -> Iterator[list[str]]:
        begin, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK:
                yield texts[begin : i + 1]
                begin, size = i + 1, 0
        yield texts[begin:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, stop = vocabulary(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            rows, at = [], 0
            for part in chunks([t or "" for t in batch.column("text").to_pylist()]):
                for data in vocab.encode(part):
                    data += stop
                    for k, begin in enumerate(range(0, len(data), 4 * longest)):
                        ids = data[begin : begin + 4 * longest]
                        rows.append((at, k, begin // 4, len(ids) // 4, zlib.crc32(ids)))
                    at += 1
            owner, piece, start, length, check = (np.array(rows, np.int64).reshape(-1, 5)[:, i] for i in range(5))
            columns = [batch.column("id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(check)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, piece int, start long, length long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def pack(items: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """``items`` (with ``length``) and the ``sequence_id`` and ``offset`` of each."""
    spark = items.sparkSession
    base = items.drop("sequence_id", "offset")
    rows = written(base.withColumn("row_", F.monotonically_increasing_id()), "pieces")  # once written, a row keeps its number
    counts = sorted((r["length"], r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect())  # at most as many as lengths
    steps = place([n for n, _ in counts], [c for _, c in counts], config)
    if not len(steps):
        return rows.drop("row_").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    buckets = spark.createDataFrame([(n, -(-c // BUCKET)) for n, c in counts], "length long, buckets_ long")
    rows = rows.join(F.broadcast(buckets), "length").withColumn("bucket_", F.pmod(F.xxhash64("row_"), "buckets_")).drop("buckets_")
    totals = rows.groupBy("length", "bucket_").agg(F.count("*").alias("n_"))
    ahead = Window.partitionBy("length").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("length", "bucket_", F.coalesce(F.sum("n_").over(ahead), F.lit(0)).alias("ahead_"))
    place_in = F.row_number().over(Window.partitionBy("length", "bucket_").orderBy("row_"))
    ranked = rows.withColumn("place_", place_in - 1).join(totals, ["length", "bucket_"]).withColumn("rank_", F.col("ahead_") + F.col("place_"))
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    n, rank, each, _, first, offset = steps[order].T
    key = n * (1 << 44) + rank

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _vocabularies.clear()  # this worker's words are not needed any more
        trim()
        for batch in batches:
            size, own = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank_").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, size * (1 << 44) + own, side="right") - 1
            step, among = np.divmod(own - rank[at], each[at])
            columns = [*batch.columns[:-1], pa.array(first[at] + step), pa.array(offset[at] + among * size)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return ranked.select(*(F.col(f"`{c}`") for c in base.columns), "rank_").mapInArrow(assign, f"{schema}, sequence_id long, offset long")


def packed(docs: DataFrame, path: str, config: PackConfig = PackConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(pieces(docs, path, config.longest, 0, id_col, text_col), config)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
