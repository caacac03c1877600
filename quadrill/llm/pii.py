"""Personal data by candidate boosting.

High-recall generators propose overlapping spans; boosted trees score each span from its format and its
context; calibrated thresholds select what to redact. Spans of the four validated base kinds (e-mail, IP
address, payment card, international phone number) always stay; the model adds spans of looser formats.

No labelled spans exist, so trees learn from sentences written around made-up values and look-alikes. Thresholds come from other
sentences than the trees have seen, none of which is built from the features' own cue words: of each kind, the least at which
``PRECISION`` holds where look-alikes are ``RARITY`` times as frequent as values.

Null and empty texts have no spans; a null text stays null when redacted. Texts of any length are read whole, and no span has a
longest length: names, domains and secrets reach to their end. Work grows with the text and n log n with its spans. Of overlapping
added spans the more probable stays, of equally probable ones the earlier, then the shorter. Repeated rows and null ids get one result
row each. An empty table gives no rows. A column of the input named like an output column of ``scan`` is replaced by it; ``redact``
keeps all columns.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quadrill.llm.boosting import BoostedTrees
from quadrill.llm.common import lean, table

BASE = ("email", "ip", "card", "phone")
#: Order of kinds among spans that start together.
KINDS = (*BASE, "ipv6", "iban", "ssn", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")

#: Generators of looser formats; each match is only a candidate. Numeric ones run around clusters of digits only.
_CLUSTER = re.compile(r"[0-9][0-9\x20()./:_-]{4,}[0-9]")
NUMERIC = (
    ("phone", re.compile(r"(?<![\w.+-])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){2,4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w.-])[0-9]{4}(?:[ ._-]?[0-9]{4}){2}[ ._-]?[0-9]{1,7}(?![\w])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_AT = re.compile(r"\(at\) ?|\[at\] ?|(?<= )at (?=[\w-]++(?: dot | ?\(dot\)| ?\[dot\]))")
_AFTER_AT = re.compile(r"[\w-]++(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[\w-]{2,}+)++")
_NAME_PART = re.compile(r"[\w.+-]")
_IPV6 = re.compile(r":[0-9A-Fa-f]{1,4}:(?::|[0-9A-Fa-f]{1,4})(?:::?[0-9A-Fa-f]{1,4})*(?![\w:])")
_HEX4 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}$")
_VALUE = re.compile(r"[=:]\s*+[\"']?[A-Za-z0-9+/_-]{12,}+[\"']?")
#: A name may stand behind a prefix that ends in _, as in access_token.
_NAME = re.compile(r"(?<![^\W_])(?:token|secret|password|api[_ -]?key|key)$", re.IGNORECASE)
PRECISION, RARITY = 0.95, 3.0
#: Words near a span that speak for or against a kind; fixed values.
CUES = {
    "email": ("mail", "contact", "write to", "reach"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "dial", "whatsapp"),
    "card": ("card", "visa", "credit", "debit", "payment", "mastercard"),
    "ip": ("ip", "server", "host", "address", "network"),
    "bank": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security", "tax"),
    "secret": ("token", "secret", "password", "key"),
    "against": ("order", "invoice", "version", "isbn", "page", "lot", "part", "model", "ratio", "score", "ref", "item", "year", "date", "release", "ticket", "serial"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Anchored at each @: the run of local characters before it is found once, so long runs cost no more than their length."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last = max(last, at)  # a local part can't reach over an @
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The four base kinds, leftmost and non-overlapping within a kind; matches that fail their check are dropped."""
    out = [(a, b, "email") for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return out


def loose_spans(text: str) -> list[tuple[int, int, str]]:
    """High-recall candidates; each generator starts from a rare anchor, so plain prose costs little."""
    out = set()
    for c in _CLUSTER.finditer(text):
        a, b = max(0, c.start() - 8), min(len(text), c.end() + 40)
        out.update((m.start(), m.end(), kind) for kind, pattern in NUMERIC for m in pattern.finditer(text, a, b))
    out.update((m.start(), m.end(), "iban") for m in _IBAN.finditer(text))
    for c in _AT.finditer(text):
        if right := _AFTER_AT.match(text, c.end()):
            end = c.start() - (text[c.start() - 1 : c.start()] == " ")
            start = end
            while start > 0 and _NAME_PART.match(text, start - 1):
                start -= 1
            if start < end:
                out.add((start, right.end(), "email"))
    for c in _IPV6.finditer(text):
        low = max(0, c.start() - 40)
        if left := _HEX4.search(text[low : c.start()]):
            out.add((low + left.start(), c.end(), "ipv6"))
    for c in _VALUE.finditer(text):
        end = c.start()
        while end > 0 and text[end - 1].isspace():
            end -= 1
        low = max(0, end - 12)  # longer than any name
        if left := _NAME.search(text[low:end]):
            out.add((low + left.start(), c.end(), "secret"))
    return sorted(out)


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of one candidate span."""
    s = text[start:end]
    digits = [c for c in s if c.isdigit()]
    counts: dict[str, int] = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(n / len(s) * math.log2(n / len(s)) for n in counts.values())
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 12].lower()
    near = before + " " + after
    alnum = sum(c.isalnum() for c in s)
    return [
        *(float(kind == k) for k in KINDS),
        len(s), len(digits), alnum - len(digits), len(s) - alnum, entropy,
        len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0,
        float(12 <= len(digits) <= 19 and luhn("".join(digits))), len(set(digits)),
        float("(" in s), float("-" in s), float("." in s), float(" " in s), float("/" in s), float(s[:1] == "0"),
        float(bool(re.match(r"(?:19|20)[0-9]{2}\b", s))), float(bool(re.search(r"\b(?:19|20)[0-9]{2}$", s))),
        float(bool(re.search(r"dot|at|\.", s))), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        *(float(any(w in before for w in words)) for words in CUES.values()),
        float(any(w in near for w in CUES["against"])),
    ]


#: Sentences around values (first of each pair) and look-alikes (second): those that trees learn from, and those that set thresholds.
LEARN = {
    "email": ("please write to {} about it|{}|contact: {}|you reach our office under {}|mail your letter to {} today|she signs as {}", "they looked {} once more|we met {} and left|he arrived {} of light|it stood {} for years"),
    "phone": ("ring me under {} after six|tel. {}|her mobile: {}|call {} now|fax {} or come by|dial {} for help|you can text him on {}", "invoice {} is due|order {} was sent|the years {} were dry|part no. {} is missing|tables {} list them|scores of {} in a row|lot {} was sold"),
    "card": ("she paid with visa {}|charge it to {}|credit card: {}|the card {} expires soon|mastercard {} was declined", "serial {} of the engine|item {} left the store|parcel {} arrived|the number {} came up|ref {}|{}"),
    "ipv6": ("the server at {} is down|host {} answered|ping {}|address {}|blocked {} last night", "run times of {} each|at {} sharp|ratio {} in the mix"),
    "iban": ("transfer it to {}|iban {}|our bank account: {}|pay into {} by May", "model {} was built|batch {} failed|code {} on the box"),
    "ssn": ("his ssn is {}|social security no. {}|tax id {}|insured under {}", "ref {} was closed|ticket {} is open|release {} is out|part {} fits|{}"),
    "secret": ("use {} to log in|{}|set {} in the shell|he posted {} by mistake|export {}", "the {} of the table|{} in the map|choose {} first|legend: {}"),
}
CHECK = {
    "email": ("answers go to {} please|questions? {}|for a copy ask {}|from {} with thanks", "she waited {} that day|all of it {} ended|rain fell {} again"),
    "phone": ("my number is {}|reception: {}|speak to us on {}|leave word at {}|his line {} was busy", "chapter {} tells more|between {} and noon|lots {} remain|the case {} was heard|coordinates {}"),
    "card": ("billed to {} in June|my debit number: {}|amex {}|he gave the clerk {}", "tracking code {} found|meter reads {}|sample {} was lost|row {} of the file"),
    "ipv6": ("traffic from {} rose|connect to {} first|a router at {}", "lap {} was his best|log entry {} is odd"),
    "iban": ("wire the rent to {}|my account is {}|deposit: {}", "plate {} was seen|shelf {} is empty"),
    "ssn": ("social: {}|her security number {}|employee no. {} on the form", "flight {} is late|case {} is closed|page {} is torn"),
    "secret": ("log in using {}|here it is: {}|curl with {}|never share {}", "a {} of three words|the {} to it all|with {} as a column"),
}


def _values(r: random.Random) -> dict[str, tuple]:
    """For each kind a maker of values and one of look-alikes that the generators propose too."""
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("aeioustnrlm") for _ in range(r.randint(2, 9)))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + d(14)
        number = body + next(c for c in "0123456789" if luhn(body + c))
        return r.choice(["", " ", "-", "."]).join(number[i : i + 4] for i in range(0, 16, 4))

    def no_card() -> str:
        number = next(x for x in iter(lambda: d(16), None) if not luhn(x))
        return r.choice(["", "", "", " "]).join(number[i : i + 4] for i in range(0, 16, 4))

    phones = [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{d(2)}/{d(3)} {d(4)}"]
    year = lambda: r.randint(1900, 2099)
    others = [lambda: f"{year()}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/{year()}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{d(2)} {d(3)} {d(2)}", lambda: f"{year()}-{year()} {year()}", lambda: f"{d(2)}.{d(2)}.{d(2)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}"]
    names = ["token", "secret", "password", "api_key", "access_token", "client_secret", "SECRET_KEY"]
    tails = ["com", "org", "net", "de", "co dot uk"]
    return {
        "email": (lambda: f"{w()}{r.choice(['', '.' + w(), d(2)])}{r.choice([' at ', ' (at) ', '[at]', ' [at] '])}{w()}{r.choice([' dot ', '.', ' (dot) ', '[dot]'])}{r.choice(tails)}", lambda: f"at {w()} dot {w()} {w()}" if r.random() < 0.6 else f"at {w()} (dot) {w()}"),
        "phone": (lambda: r.choice(phones)(), lambda: r.choice(others)()),
        "card": (card, no_card),
        "ipv6": (lambda: ":".join(hexes(4) for _ in range(8)) if r.random() < 0.7 else f"{hexes(4)}:{hexes(3)}::{hexes(2)}", lambda: ":".join(d(2) for _ in range(r.randint(3, 4)))),
        "iban": (lambda: r.choice(["DE", "FR", "ES", "GB", "NL"]) + d(2) + r.choice(["", " "]).join(["", r.choice([d(4), "WEST", "ABNA"]), *(d(4) for _ in range(r.randint(3, 5)))]), lambda: "".join(r.choice("QXZJK") for _ in range(2)) + d(2) + "".join(r.choice(["ABCD", "MODL", "PART", d(4)]) for _ in range(3))),
        "ssn": (lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}"),
        "secret": (lambda: f"{r.choice(names)}{r.choice([' = ', '=', ': '])}{r.choice(['', chr(34)])}{r.choice([hexes(r.choice([16, 32, 40, 64, 200])), ''.join(r.choice('abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789') for _ in range(r.choice([20, 32, 90])))])}", lambda: f"key: {w()}{w()}{w()}{w()}" if r.random() < 0.5 else f"{r.choice(['key', 'token'])} = {w()}_{w()}_{w()}_{w()}"),
    }


def _examples(seed: int, n: int, sentences: dict[str, tuple[str, str]]) -> list[tuple[str, bool]]:
    """Sentences among made-up prose with a value (true) or a look-alike (false) between marks \x00."""
    r = random.Random(seed)
    make, kinds = _values(r), list(sentences)
    prose = lambda k: " ".join("".join(r.choice("aeioustnrlmdhc") for _ in range(r.randint(2, 9))) for _ in range(k))
    out = []
    for i in range(n):
        good, kind = i % 2 == 0, kinds[i // 2 % len(kinds)]
        sentence = r.choice(sentences[kind][0 if good else 1].split("|"))
        if r.random() < 0.1:  # without a context
            sentence = "{}"
        out.append((f"{prose(r.randint(0, 8))} {sentence.format(chr(0) + make[kind][0 if good else 1]() + chr(0))} {prose(r.randint(1, 6))}.", good))
    return out


def _table(examples: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, target, kinds = [], [], []
    for marked, good in examples:
        at, to = marked.index("\x00"), marked.rindex("\x00") - 1
        text = marked.replace("\x00", "")
        for a, b, kind in loose_spans(text):
            if a < to and b > at:
                rows.append(features(text, a, b, kind))
                target.append(good)
                kinds.append(kind)
    return np.array(rows), np.array(target, dtype=float), np.array(kinds)


@functools.cache
def model(seed: int = 7, examples: int = 4000) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees and thresholds. All is made by rule from the seed, so the model is the same on every executor."""
    x, y, _ = _table(_examples(seed, examples, LEARN))
    trees = BoostedTrees().fit(x, y)
    x, truth, kind = _table(_examples(seed + 1, examples, CHECK))
    p = trees.predict(x)
    weight = np.where(truth > 0, 1.0, RARITY)
    thresholds = {}
    for name in KINDS:
        own = kind == name
        right = [t for t in np.unique(p[own]) if (weight * truth)[own & (p >= t)].sum() >= PRECISION * weight[own & (p >= t)].sum()]
        thresholds[name] = float(right[0]) if right else 1.1
    return trees, thresholds


class Spans:
    """Disjoint spans in order; finds out in logarithmic time whether another one overlaps any."""

    def __init__(self, spans: list[tuple[int, int, str]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlap(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a

    def add(self, a: int, b: int) -> None:
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def find(texts: list[str], trees: BoostedTrees, thresholds: dict[str, float]) -> list[tuple[list, list]]:
    """For each text its base spans and the spans that the model adds, each sorted by start, then kind."""
    base = [base_spans(t) for t in texts]
    owner, spans, rows = [], [], []
    for i, text in enumerate(texts):
        taken = Spans(base[i])
        for a, b, kind in loose_spans(text):
            if not taken.overlap(a, b):
                owner.append(i)
                spans.append((a, b, kind))
                rows.append(features(text, a, b, kind))
    added: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if rows:
        p = np.concatenate([trees.predict(np.array(rows[i : i + 50_000])) for i in range(0, len(rows), 50_000)])
        taken = {}
        for j in sorted(range(len(rows)), key=lambda j: (-p[j], spans[j])):
            a, b, kind = spans[j]
            if p[j] < thresholds[kind]:
                continue
            own = taken.setdefault(owner[j], Spans())
            if not own.overlap(a, b):
                own.add(a, b)
                added[owner[j]].append(spans[j])
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    return [(sorted(x, key=order), sorted(y, key=order)) for x, y in zip(base, added, strict=True)]


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced together."""
    out, last = [], 0
    merged: list[list] = []
    for a, b, kind in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of base kinds, digest of base spans, all spans, number of added spans."""
    trees, thresholds = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = find([t if isinstance(t, str) else "" for t in pdf["text"]], trees, thresholds)
            every = [sorted(b + a, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for b, a in found]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["id"],
                    **{f"n_{k}": [sum(s[2] == k for s in b) for b, _ in found] for k in BASE},
                    "base_sha256": [hashlib.sha256(digest(b).encode()).hexdigest() for b, _ in found],
                    "spans": [digest(s) for s in every],
                    "n_added": [len(a) for _, a in found],
                }
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInPandas(
        lean(run), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with every selected span of the text replaced by its kind in brackets; null texts stay null."""
    trees, thresholds = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[text_col]]
            out = [redacted(t, b + a) for t, (b, a) in zip(texts, find(texts, trees, thresholds), strict=True)]
            pdf[text_col] = [x if isinstance(t, str) else None for x, t in zip(out, pdf[text_col], strict=True)]
            yield pdf

    return docs.mapInPandas(lean(run), docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
