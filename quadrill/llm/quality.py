"""Document quality from a linear-chain conditional random field over lines.

Every non-empty line is labelled good or bad from its own features and those of the lines beside it; the
marginals of forward-backward are averaged with the lines' lengths as weights, and a logistic curve fitted on the
training documents turns that average into a probability. Learning is from document labels: all lines of a document
start with its label, and a second round lets lines of bad documents that look good become good.

Lines are learnt from a sample: about ``rows`` labelled documents outside the held-out fold, chosen by a hash of their ids, and of each at
most ``most_lines`` lines in a row from a place that the hash gives. Executors compute these lines' features, so the bytes that reach
the driver are bounded whatever the texts' lengths; the curve is fitted on averages over the whole texts of the sample.

Null and empty texts have no line; their average is 0. Texts of any length are read whole. Equal rows get equal scores; of several
texts of one labelled id the one with the smallest hash is learnt from, of several labels of an id the largest counts. Labels that are
null, of null ids or of documents in the held-out fold are never read; without labels of both kinds every document scores by its average
alone. An empty table gives no rows. Columns of the input named ``score`` or ``predicted`` are replaced; all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.llm.common import forget, held_out, lean, table, uniform, written

UPPER, LOWER, DIGIT, SPACE, MARK, STOP, OTHER = range(7)


def _classes() -> np.ndarray:
    """Class of each code point below 0x250; all above count as lower-case letters."""
    out = np.full(0x251, LOWER, np.uint8)
    for i in range(0x250):
        c = chr(i)
        out[i] = UPPER if c.isupper() else LOWER if c.isalpha() else DIGIT if c.isdigit() else SPACE if c.isspace() else STOP if c in ".,;:?'\"()-" else MARK if c.isprintable() else OTHER
    return out


CLASSES = _classes()
OWN = 16
WIDTH = 3 * (OWN + 1) + 1


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every non-empty line and those beside it, its length, first line of each text plus the total)."""
    own, length, offsets = own_features(texts)
    return beside(own, offsets), length, offsets


def own_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` without the lines beside."""
    lines, counts, repeats, words, distinct = [], [], [], [], []
    for text in texts:
        own = [x for x in text.split("\n") if x and not x.isspace()]
        counts.append(len(own))
        seen: set[str] = set()
        for x in own:
            repeats.append(x in seen)
            seen.add(x)
            w = x.split()
            words.append(len(w))
            distinct.append(len(set(w)))
        lines += own
    offsets = np.cumsum([0, *counts])
    n = len(lines)
    if not n:
        return np.zeros((0, OWN)), np.zeros(0), offsets
    length = np.fromiter(map(len, lines), np.int64, n)
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = CLASSES[np.minimum(code, 0x250)]
    starts = np.cumsum(np.r_[0, length[:-1]])
    share = np.stack([np.add.reduceat((kind == k).view(np.int8), starts, dtype=np.int64) for k in (UPPER, LOWER, DIGIT, MARK, STOP)], 1) / length[:, None]
    w, d = np.array(words), np.array(distinct)
    upper, lower, digit, mark, stop = share.T
    letters = np.maximum(upper + lower, 1e-9)
    ratio = d / np.maximum(w, 1)
    ends = kind[starts + length - 1] == STOP
    own = np.stack([
        upper / letters, upper / letters > 0.3, lower, digit, mark, mark > 0.02, mark > 0.1, stop,
        ratio, ratio < 0.25, d / np.sqrt(np.maximum(w, 1)) / 5, np.log1p(length) / 5, np.log1p(w) / 4,
        np.minimum((length / np.maximum(w, 1)) / 10, 3), ends, np.array(repeats),
    ], 1).astype(np.float64)
    return own, length.astype(float), offsets


def beside(own: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each line's features with a constant, those of the lines before and after it in its text, and a spare column."""
    own = np.concatenate([own, np.ones((len(own), 1))], 1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    real = np.diff(offsets) > 0
    before[offsets[:-1][real]] = 0
    after[offsets[1:][real] - 1] = 0
    return np.concatenate([own, before, after, np.zeros((len(own), 1))], 1)


@dataclass
class Chain:
    """Weights of a good line against a bad one, transitions between labels, and the curve for documents."""

    theta: np.ndarray
    move: np.ndarray
    curve: tuple[float, float] = (4.0, 0.0)

    def marginals(self, x: np.ndarray, offsets: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of every line, expected transitions, log partition; all sequences advance together."""
        unary = np.stack([np.zeros(len(x)), x @ self.theta], 1)
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        sizes, first = sizes[order], offsets[:-1][order]
        alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
        live = np.searchsorted(-sizes, -np.arange(sizes.max(initial=0)), side="left")
        for t, k in enumerate(live):
            at = first[:k] + t
            if t == 0:
                alpha[at] = unary[at]
            else:
                into = alpha[at - 1][:, :, None] + self.move
                alpha[at] = np.logaddexp(into[:, 0], into[:, 1]) + unary[at]
        for t in range(len(live) - 2, -1, -1):
            at = first[: live[t + 1]] + t
            out = self.move + (unary[at + 1] + beta[at + 1])[:, None, :]
            beta[at] = np.logaddexp(out[:, :, 0], out[:, :, 1])
        both = alpha + beta
        total = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - total)
        expected, logz = np.zeros((2, 2)), 0.0
        if pairs and len(x):
            at = np.concatenate([np.arange(a + 1, a + s) for a, s in zip(first, sizes, strict=True)]) if len(first) else np.zeros(0, int)
            p = alpha[at - 1][:, :, None] + self.move + (unary[at] + beta[at])[:, None, :] - total[at][:, None, None]
            expected = np.exp(p).sum(0)
            logz = float(total[first[sizes > 0]].sum())
        return good, expected, logz

    def average(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of the good marginals of each text's lines."""
        x, length, offsets = line_features(texts)
        good, _, _ = self.marginals(x, offsets)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        return np.bincount(owner, good * length, len(texts)) / np.maximum(np.bincount(owner, length, len(texts)), 1)

    def score(self, texts: list[str]) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * squashed(self.average(texts)) + b)))


def squashed(m: np.ndarray) -> np.ndarray:
    m = np.clip(m, 0.01, 0.99)
    return np.log(m / (1 - m))


def fit_chain(x: np.ndarray, offsets: np.ndarray, y: np.ndarray, rounds: int = 80, penalty: float = 1e-3) -> Chain:
    """Adam on the mean log likelihood of the line labels."""
    chain = Chain(np.zeros(x.shape[1]), np.zeros((2, 2)))
    n = max(len(x), 1)
    inner = np.ones(len(x), bool)
    inner[offsets[:-1][np.diff(offsets) > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in (chain.theta, chain.move)]
    for step in range(1, rounds + 1):
        good, expected, _ = chain.marginals(x, offsets, pairs=True)
        grads = (x.T @ (y - good) / n - penalty * chain.theta, (seen - expected) / n - penalty * chain.move)
        for value, grad, (m, v) in zip((chain.theta, chain.move), grads, state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            value += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return chain


def train(lines: list[np.ndarray], labels: list[int]) -> Chain:
    """Fit the chain on the features of documents' lines."""
    chain = Chain(np.zeros(WIDTH), np.zeros((2, 2)))
    offsets = np.cumsum([0, *map(len, lines)])
    if len(set(labels)) < 2 or not offsets[-1]:
        return chain
    x, doc = beside(np.concatenate(lines), offsets), np.repeat(np.array(labels), np.diff(offsets))
    chain = fit_chain(x, offsets, doc)
    good, _, _ = chain.marginals(x, offsets)
    return fit_chain(x, offsets, np.where((doc == 0) & (good > 0.8), 1, doc))


def curve(averages: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Newton's method for the logistic curve of two parameters from averages to labels."""
    m, y, a, b = squashed(averages), labels.astype(float), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * m + b)))
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [((y - p) * m).sum() - a, (y - p).sum()])
        a, b = a + step[0], b + step[1]
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, most_lines: int = 64, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Train on about ``rows`` labelled documents outside the held-out fold, chosen by a hash of their id, and on at most ``most_lines`` lines of each."""
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("label"))
    n = known.count()
    picked = known.where(uniform("id", seed=5) < min(1.0, rows / max(n, 1)))
    sample = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    sample = sample.groupBy("id").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = written(sample.withColumn("u", uniform("id", seed=6)), "sample")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own, _, offsets = own_features(pdf["text"].tolist())
            starts = offsets[:-1] + (pdf["u"].to_numpy() * (np.maximum(np.diff(offsets) - most_lines, 0) + 1)).astype(np.int64)
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "x": [own[a : min(a + most_lines, b)].astype(np.float32).tobytes() for a, b in zip(starts, offsets[1:], strict=True)]})

    kind = dict(sample.dtypes)
    got = sample.mapInPandas(lean(lines), f"id {kind['id']}, label {kind['label']}, x binary").collect()
    got = sorted(got, key=lambda r: r["id"])
    y = [int(r["label"] > 0) for r in got]
    chain = train([np.frombuffer(r["x"], np.float32).reshape(-1, OWN).astype(float) for r in got], y)
    if len(set(y)) < 2:
        return chain

    def averages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "average": chain.average(pdf["text"].tolist())})

    got = sorted(sample.mapInPandas(lean(averages), f"id {kind['id']}, label {kind['label']}, average double").collect(), key=lambda r: r["id"])
    forget(sample)
    chain.curve = curve(np.array([r["average"] for r in got]), np.array([int(r["label"] > 0) for r in got]))
    return chain


def grade(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The input with ``score`` and ``predicted``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [chain.score([t if isinstance(t, str) else "" for t in pdf[text_col].iloc[i : i + 1000]]) for i in range(0, len(pdf), 1000)]
            score = np.concatenate([*parts, np.zeros(0)])
            yield pdf.assign(score=score, predicted=(score >= threshold).astype(np.int32))

    base = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInPandas(lean(run), f"{schema}, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = fit(docs, table(spark, sf_dir, "labels"))
    out = grade(docs.select("doc_id", held_out().alias("held_out"), "text"), chain)
    return out.select("doc_id", "held_out", "score", "predicted")
