"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. It reads the UTF-8 bytes of a whole text (lower-cased, each run
of white space as one space) in fixed windows that overlap by ``MARGIN`` bytes on either side: a state is carried across
words, and every position whose label counts has at least that many bytes of context on both sides, or the text's end. A text shorter than a window
is padded, but both directions stop at its end, so padding changes nothing.
Each position gets a distribution over languages; a document's probabilities are pooled from the mean log
probabilities of all its positions.

It learns from ``pieces`` pieces of up to ``piece`` bytes of each text of a sample: about ``texts_per_lang`` distinct texts of each
language outside the held-out fold, chosen by a hash of id and text, so the same table always gives the same sample. How sharp probabilities are
is set on a fifth as many further texts that are not learnt. Executors cut the pieces; bytes that reach the driver are bounded by the sample and the number of languages, whatever the texts' lengths. Every language
that is a label is learnt.

A text that is null or has no letter is ``und`` with score 0; so is every text if no labelled row can be learnt
from. Texts of any length are read whole, a few thousand windows at a time. Repeated rows get one result row each; equal pooled
scores go to the language first in sorted order. An empty table gives no rows. Columns of the input named ``lang_pred`` or ``score``
are replaced; all others are kept, null ids too (a null id is not in the held-out fold).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.llm.common import held_out, lean, table, uniform

#: Bytes of a window, and of the context at its ends whose labels don't count; texts that fit are padded to the least of these sizes.
WINDOW, MARGIN = 144, 16
SIZES = (32, 64, 96, WINDOW)
#: Windows that the network reads at once.
TOGETHER = 1024


def sigmoid(x: np.ndarray) -> None:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


@dataclass
class Network:
    """Weights: for each direction a table of input gates by byte and the recurrent matrix, then the output layer."""

    langs: list[str]
    hidden: int = 12
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    heat: float = 1.0

    def start(self, seed: int) -> Network:
        r, h, k = np.random.default_rng(seed), self.hidden, len(self.langs)
        for d in "fb":
            self.weights["in_" + d] = r.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.weights["re_" + d] = r.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
        self.weights["out"] = r.normal(0, 1 / np.sqrt(2 * h), (2 * h, k)).astype(np.float32)
        self.weights["bias"] = np.zeros(k, np.float32)
        return self

    def sweep(self, d: str, x: np.ndarray, kept: list | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """States [time, batch, hidden] of one direction for bytes [batch, time]; ``kept`` gets what training needs. What lies at or beyond ``ends`` is padding."""
        gates, re, h = self.weights["in_" + d], self.weights["re_" + d], self.hidden
        state = np.zeros((len(x), h), gates.dtype)
        out = np.empty((x.shape[1], len(x), h), gates.dtype)
        # parts apart, so that all that is written is contiguous
        gate_in, new_in, gate_re, new_re = (np.ascontiguousarray(m[:, part]) for m in (gates, re) for part in (slice(0, 2 * h), slice(2 * h, None)))
        x = np.ascontiguousarray(x.T)
        first = ends.min() if ends is not None and d == "b" and len(ends) else len(x)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            zr = gate_in[x[t]]
            zr += state @ gate_re
            sigmoid(zr)
            z, r = zr[:, :h], zr[:, h:]
            u = state @ new_re
            n = r * u
            n += new_in[x[t]]
            np.tanh(n, out=n)
            if kept is not None:
                kept.append((t, state, z, r, n, u))
            state = np.subtract(state, n, out=out[t])
            state *= z
            state += n
            if t >= first:
                state *= (t < ends)[:, None]
        return out

    def label(self, x: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities [time, batch, language] of every position."""
        logits = self.sweep("f", x) @ self.weights["out"][: self.hidden] + self.sweep("b", x, None, ends) @ self.weights["out"][self.hidden :] + self.weights["bias"]
        logits -= logits.max(2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(2, keepdims=True))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions and its gradient, by backpropagation through time in both directions."""
        h, w = self.hidden, self.weights
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.sweep(d, x, kept[d]) for d in "fb"], 2)
        logits = both @ w["out"] + w["bias"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        rows = np.arange(len(x))
        loss = -np.log(p[:, rows, y] + 1e-9).mean()
        p[:, rows, y] -= 1
        p /= p.shape[0] * p.shape[1]
        grad = {"out": np.einsum("tbh,tbk->hk", both, p), "bias": p.sum((0, 1))}
        back = p @ w["out"].T
        flat = x.T.ravel()
        for i, d in enumerate("fb"):
            dre, carry = np.zeros_like(w["re_" + d]), np.zeros((len(x), h), both.dtype)
            gates = np.empty((x.shape[1], len(x), 3 * h), both.dtype)
            for t, old, z, r, n, un in reversed(kept[d]):
                dh = back[t][:, i * h : (i + 1) * h] + carry
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (old - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                gates[t] = np.concatenate([dz, dr, dn], 1)
                du = np.concatenate([dz, dr, dn * r], 1)
                dre += old.T @ du
                carry = dh * z + du @ w["re_" + d].T
            gates = gates.reshape(-1, 3 * h)
            grad["in_" + d] = np.stack([np.bincount(flat, gates[:, k], 256) for k in range(3 * h)], 1)
            grad["re_" + d] = dre
        return float(loss), grad


def plain(text: str | None) -> bytes:
    """What the network reads of a text."""
    return " ".join(text.lower().split()).encode("utf-8", "replace") if isinstance(text, str) else b""


def windows(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bytes [n, size], first and last counted place) of a few windows at a time; only a text shorter than the window is padded, after its last counted place."""
    owner, rows, first, last = [], [], [], []
    for i, data in enumerate(texts):
        n, start, done = len(data), 0, 0
        while done < n:
            # the last window ends with the text
            start = max(0, min(done - MARGIN, n - size))
            end = n if start + size >= n else start + size - MARGIN
            owner.append(i)
            rows.append(data[start : start + size].ljust(size))
            first.append(done - start)
            last.append(end - start)
            done = end
            if len(rows) == TOGETHER:
                yield np.array(owner), np.frombuffer(b"".join(rows), np.uint8).reshape(-1, size), np.array(first), np.array(last)
                owner, rows, first, last = [], [], [], []
    if rows:
        yield np.array(owner), np.frombuffer(b"".join(rows), np.uint8).reshape(-1, size), np.array(first), np.array(last)


def pool(net: Network, texts: list[str | None]) -> np.ndarray:
    """Mean log probability over all byte positions of each text [document, language]; 0 of a text without any."""
    data = [plain(t) for t in texts]
    sums = np.zeros((len(texts), len(net.langs)))
    group = np.searchsorted(SIZES, np.minimum([len(x) for x in data], WINDOW))
    for k, size in enumerate(SIZES):
        own = np.flatnonzero(group == k)
        for at, x, first, last in windows([data[i] for i in own], size):
            place = np.arange(size)[:, None]
            ends = np.minimum(np.array([len(data[i]) for i in own[at]]), size)
            part = np.einsum("tbk,tb->bk", net.label(x, ends if (ends < size).any() else None), ((place >= first) & (place < last)).astype(np.float32), optimize=True)
            np.add.at(sums, own[at], part)
    return sums / np.maximum([len(x) for x in data], 1)[:, None]


def train(langs: list[str], pieces: list[tuple[bytes, str]], epochs: int = 4, seed: int = 11, hidden: int = 12) -> Network:
    """Fit on pieces of texts (bytes, language); every position is an example."""
    r = np.random.default_rng(seed)
    net = Network(sorted(langs), hidden).start(seed)
    at = {lang: k for k, lang in enumerate(net.langs)}
    target = np.array([at[lang] for _, lang in pieces])
    lengths = np.array([len(x) for x, _ in pieces])
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    step = 0
    for epoch in range(epochs):
        # fresh minibatches each epoch, of pieces of one length each: no padding is ever read
        order = r.permutation(len(pieces))
        batches = [own[i : i + 128] for n in np.unique(lengths) for own in [order[lengths[order] == n]] for i in range(0, len(own), 128)]
        for b in r.permutation(len(batches)):
            own = batches[b]
            x = np.frombuffer(b"".join(pieces[j][0] for j in own), np.uint8).reshape(len(own), -1)
            _, grad = net.gradient(x, target[own])
            step += 1
            rate = 0.02 / (1 + epoch)
            for k, g in grad.items():
                a, v = moment[k]
                a += 0.1 * (g - a)
                v += 0.01 * (g * g - v)
                net.weights[k] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def calibrated(net: Network, pooled: np.ndarray, target: np.ndarray) -> Network:
    """Choose how sharply pooled log probabilities become document probabilities, by likelihood of texts that were not learnt."""
    best = (np.inf, 1.0)
    for heat in (0.5, 1.0, 2.0, 4.0, 8.0, 16.0):
        p = softmax(pooled * heat)
        best = min(best, (float(-np.log(p[np.arange(len(target)), target] + 1e-9).mean()), heat))
    net.heat = best[1]
    return net


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, texts_per_lang: int = 250, pieces: int = 8, piece: int = 64, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Network:
    """Train on a bounded sample: about ``texts_per_lang`` distinct texts of each language outside the held-out fold, ``pieces`` pieces of ``piece`` bytes of each."""
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), uniform(id_col, text_col, seed=2).alias("u"))
    # one row for each language
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return Network([]).start(0)
    entries = [x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(1.2 * texts_per_lang / n))]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, lang, u in zip(pdf["text"], pdf["lang"], pdf["u"], strict=True):
                data = plain(text)
                starts = np.random.default_rng(int(u * (1 << 30))).integers(0, max(len(data) - piece, 0) + 1, pieces if len(data) > piece else 1)
                rows += [(lang, u, data[a : a + piece]) for a in np.unique(starts) if data]
            yield pd.DataFrame(rows, columns=["lang", "u", "piece"])

    sample = usable.where(F.col("u") < F.element_at(F.create_map(*entries), F.col("lang"))).mapInPandas(lean(cut), "lang string, u double, piece binary").distinct()
    got = sorted((bytes(r["piece"]), r["lang"], r["u"]) for r in sample.collect())
    # every sixth text of a language sets the sharpness; one with fewer is learnt from alone
    texts = {lang: sorted({u for _, own, u in got if own == lang}) for lang in counts}
    apart = {(lang, u) for lang, own in texts.items() for u in own[5::6]}
    net = train(list(counts), [(x, lang) for x, lang, u in got if (lang, u) not in apart])
    held = [g for g in got if (g[1], g[2]) in apart] or got
    # pieces of a text together stand for the text
    keys = sorted({(lang, u) for _, lang, u in held})
    at = {k: i for i, k in enumerate(keys)}
    sums, n = np.zeros((len(keys), len(net.langs))), np.zeros(len(keys))
    for (x, lang, u), logs in zip(held, pool(net, [x.decode("utf-8", "replace") for x, _, _ in held]), strict=True):
        sums[at[lang, u]] += logs * len(x)
        n[at[lang, u]] += len(x)
    return calibrated(net, sums / n[:, None], np.array([net.langs.index(lang) for lang, _ in keys])) if keys else net


def identify(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The input with ``lang_pred`` and ``score``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[text_col]]
            lettered = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
            lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            if net.langs and lettered.any():
                p = np.concatenate([softmax(pool(net, texts[i : i + 2500]) * net.heat) for i in range(0, len(texts), 2500)])
                best = p.argmax(1)
                lang[lettered] = np.array(net.langs, dtype=object)[best][lettered]
                score[lettered] = p[np.arange(len(p)), best][lettered]
            yield pdf.assign(lang_pred=lang, score=score)

    base = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInPandas(lean(run), f"{schema}, lang_pred string, score double")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), fit(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score")
