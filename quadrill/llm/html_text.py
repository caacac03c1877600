"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree: nodes are paths of tags and classes. A node's presentation
importance is the entropy of the child sequences seen under it, a leaf's content importance is one minus the
mean normalised entropy of its block texts over the host's pages, and the composite importance of a branch mixes
both from the leaves up. A branch is of low importance if it and all branches below it are, on ``PAGES`` pages at least. Such branches
are removed from each page, inside articles too, and so is what stands in elements (inline ones too) whose tag, whole class or id name,
role or hidden attribute marks navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
reader comments: a name counts only if all its parts do (``comments-list``, not ``comments-on-theory``). On pages with an article (or
main) element only its branches count.

Pages of a host that share most of their content count as one page (the longest blocks that make up half of the article's text, or of all blocks not
named away, are the same), so copied and mirrored pages, also those with another title or date, never make their own content look like a template.

Null and empty pages give an empty text. Null urls, and urls without a host, form a host of their own. Repeated rows get one row each,
null ids too. Whole pages are read, whatever their length or depth; malformed markup is closed as browsers close it. Equal pages of one host
give equal texts. An empty table gives no rows. Columns of the input named ``text`` or ``n_chars`` are replaced, the html is left out, all
others are kept. One task works out one host's tree from its paths that stand on at least two pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.llm.common import forget, lean, table, written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Open elements that a start tag of the key closes, up to the nearest of the barriers.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("ul ol dl table select article section div body td th main".split())
AWAY_TAGS = frozenset("nav footer aside form button select datalist dialog menu input label".split())
#: Words of class and id names that mark what is no main text, and words that may stand beside them in such a name.
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner promo promos promotion promotions sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert alerts "
    "popup modal newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus replies share sharing social related "
    "recommended widget widgets pagination pager login signup search".split()
)
#: The same, but only outside an article, for articles have headers of their own.
HEAD_WORDS = frozenset("header masthead".split())
BESIDE = frozenset(
    "site page main top bottom left right center box boxes list lists section sections block container wrapper wrap inner outer bar area panel link links button buttons btn item items icon icons "
    "global primary secondary sticky fixed mobile desktop post posts entry article articles story stories user users reader form field group content body text google slot unit zone "
    "law info trail next prev previous copyright cta card media network networks news topics more thread reply message messages row col column layer overlay dialog".split()
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TAG = re.compile(r"<(?:!--(?:.*?-->|.*)|(/?)([A-Za-z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([A-Za-z][^\s/>]*)([^<>]*)>|[!?][^>]*>)", re.DOTALL)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"[0-9]+")
GAMMA, LOW, PAGES = 0.9, 0.2, 4
#: Rows of copied contents or payloads (some 40 bytes each) up to which they are broadcast.
MOST_COPIES = 500_000

_keys: dict[tuple[int, str], int] = {}


def key_of(parent: int, style: str) -> int:
    """A path's 64-bit key."""
    found = _keys.get((parent, style))
    if found is None:
        if len(_keys) > 200_000:
            _keys.clear()
        found = _keys[parent, style] = xxhash.xxh64_intdigest(f"{parent}/{style}") - (1 << 63)
    return found


def named_away(names: str, main: bool) -> bool:
    """Whether one of the names (separated by spaces) consists of words that mark what is no main text."""
    for name in names.split():
        parts = [x.lower() for x in _PARTS.findall(name)]
        marks = [x in AWAY_WORDS or (x in HEAD_WORDS and not main) for x in parts]
        if any(marks) and all(m or x in BESIDE or x in HEAD_WORDS for m, x in zip(marks, parts, strict=True)):
            return True
    return False


class Node:
    __slots__ = ("tag", "key", "parent", "away", "main", "low", "kids")

    def __init__(self, tag: str, key: int, parent: int, away: bool, main: bool, low: bool):
        self.tag, self.key, self.parent, self.away, self.main, self.low, self.kids = tag, key, parent, away, main, low, []


def walk(page: str, dropped: frozenset[int] = frozenset()) -> tuple[list[tuple[Node, str]], list[Node]]:
    """Blocks (node, text) in page order without what is named away, and all nodes; ``low`` marks nodes in a dropped branch."""
    root = Node("", key_of(0, "root"), 0, False, False, key_of(0, "root") in dropped)
    stack, nodes, blocks, buffer = [root], [root], [], []
    opened: dict[str, int] = {}
    pos, size, last = 0, len(page), page.rfind(">")

    def say(text: str) -> None:
        if not stack[-1].away:
            buffer.append(text)

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                blocks.append((next(n for n in reversed(stack) if n.tag in BLOCK or n is root), text))

    def pop(to: int) -> None:
        for n in stack[to:]:
            opened[n.tag] -= 1
        del stack[to:]

    while pos < size:
        lt = page.find("<", pos)
        if lt < 0:
            say(page[pos:])
            break
        if lt > pos:
            say(page[pos:lt])
        m = _TAG.match(page, lt)
        if not m:
            # a "<" that opens no tag is text; an unfinished tag at the end of the page is dropped
            if lt + 1 < size and (page[lt + 1].isalpha() or page[lt + 1] in "/!?") and lt > last:
                break
            say("<")
            pos = lt + 1
            continue
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if opened.get(name):
                at = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name)
                if any(n.tag in BLOCK for n in stack[at:]):
                    flush()
                pop(at)
            elif name in BLOCK:
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, pos)
            pos = end.end() if end else size
            if name == "textarea":
                say(" ")
            continue
        if name in BLOCK:
            flush()
            if opened.get("p") and name not in ("li", "td", "th", "tr"):
                at = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p")
                if not any(n.tag in BARRIER for n in stack[at + 1 :]):
                    pop(at)
        elif name == "br":
            say(" ")
        closes = CLOSES.get(name)
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    pop(i)
                    break
                if stack[i].tag in BARRIER:
                    break
        if name in VOID:
            continue
        top, attrs = stack[-1], m[3] if m[2] else m[6]
        away, main, style = top.away, top.main, name
        if attrs and not attrs.isspace():
            found: dict[str, str] = {}
            for a in _ATTR.findall(attrs):
                found.setdefault(a[0].lower(), a[1] or a[2] or a[3])
            style = f"{name}.{_DIGITS.sub('', found['class'])}" if found.get("class") else name
            away = away or found.get("role", "").lower() in AWAY_ROLES or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden", "").lower() == "true"
            away = away or found.get("hidden", "until-found").lower() != "until-found"
            main = main or found.get("role", "").lower() == "main" or found.get("itemprop", "") == "articleBody"
            names = " ".join(filter(None, (found.get("class"), found.get("id"))))
            away = away or bool(names and name not in HEADINGS and name not in ("html", "body", "article", "main") and named_away(names, main))
        away = away or name in AWAY_TAGS or (name == "header" and not main) or name == "head"
        main = main or (name in ("article", "main") and not away)
        key = key_of(top.key, style)
        node = Node(name, key, top.key, away, main, top.low or key in dropped)
        top.kids.append(style)
        nodes.append(node)
        stack.append(node)
        opened[name] = opened.get(name, 0) + 1
    flush()
    return blocks, nodes


def content(blocks: list[tuple[Node, str]]) -> list[tuple[Node, str]]:
    """The blocks of the article, if the page has one with text, else all."""
    return [b for b in blocks if b[0].main] or blocks


def bulk(texts: list[str]) -> str:
    """The longest texts that make up half of all; what pages have in common that differ by a title or a date."""
    ordered, total, out, size = sorted(texts, key=lambda x: (-len(x), x)), sum(map(len, texts)), [], 0
    for text in ordered:
        out.append(text)
        size += len(text)
        if 2 * size >= total:
            break
    return "\n".join(out)


def extract(page: str, dropped: frozenset[int]) -> str:
    """The page's blocks that lie in the article, if it has one, and in no branch of low importance."""
    return "\n\n".join(text for node, text in content(walk(page, dropped)[0]) if not node.low)


def host_column(url_col: str) -> Column:
    """The host of a url in lower case; empty for null and for urls without one."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def page_copies(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, payload, copies) of the payloads whose content stands on several pages of the host."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            contents = []
            for page in pdf["html"]:
                contents.append(xxhash.xxh64_intdigest(bulk([text for _, text in content(walk(page)[0])])) - (1 << 63))
            yield pd.DataFrame({"host": pdf["host"], "payload": pdf["payload"], "content": contents})

    rows = pages.where(F.length(html_col) > 0).select(host_column(url_col).alias("host"), F.xxhash64(html_col).alias("payload"), F.col(html_col).alias("html"))
    payloads = written(rows.mapInPandas(lean(run), "host string, payload long, content long").groupBy("host", "payload", "content").agg(F.count("*").alias("n")), "payloads")
    copies = written(payloads.groupBy("host", "content").agg(F.sum("n").alias("copies")).where("copies > 1"), "copies")
    return payloads.join(F.broadcast(copies) if copies.count() <= MOST_COPIES else copies, ["host", "content"]).select("host", "payload", "copies")


def style_nodes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The merged style trees: for each host and path the pages, and the sums that the entropies need; each of n copies counts 1 / n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: dict[tuple, float] = {}
            for host, page, copies in zip(pdf["host"], pdf["html"], pdf["copies"], strict=True):
                blocks, nodes = walk(page)
                one = 1 / copies
                seen = set()
                for n in nodes:
                    if n.away:
                        continue  # decided by name alone
                    if n.key not in seen:
                        seen.add(n.key)
                        at = (host, n.key, n.parent, 0, 0)
                        rows[at] = rows.get(at, 0) + one
                    at = (host, n.key, n.parent, 1, xxhash.xxh64_intdigest(",".join(dict.fromkeys(n.kids))) - (1 << 63))
                    rows[at] = rows.get(at, 0) + one
                for key, parent, text in {(n.key, n.parent, text) for n, text in blocks}:
                    at = (host, key, parent, 2, xxhash.xxh64_intdigest(text) - (1 << 63))
                    rows[at] = rows.get(at, 0) + one
            yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["host", "key", "parent", "what", "value", "n"])

    copies = written(page_copies(pages, url_col, html_col), "page_copies")
    rows = pages.where(F.length(html_col) > 0).select(host_column(url_col).alias("host"), F.xxhash64(html_col).alias("payload"), F.col(html_col).alias("html"))
    rows = rows.join(F.broadcast(copies) if copies.count() <= MOST_COPIES else copies, ["host", "payload"], "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    rows = rows.mapInPandas(lean(run), "host string, key long, parent long, what int, value long, n double")
    # rounded, for sums of parts come in any order
    values = rows.groupBy("host", "key", "parent", "what", "value").agg(F.round(F.sum("n"), 6).alias("n")).where("n > 0")
    part = lambda what, c: F.sum(F.when(F.col("what") == what, c).otherwise(0.0))
    return values.groupBy("host", "key", "parent").agg(
        part(0, F.col("n")).alias("pages"),
        part(1, F.col("n")).alias("shown"), part(1, F.col("n") * F.log("n")).alias("shown_log"), part(1, F.lit(1.0)).alias("styles"),
        part(2, F.lit(1.0)).alias("texts"), part(2, F.log(F.greatest("n", F.lit(1.0)))).alias("texts_log"),
    )


def low_branches(nodes: DataFrame, low: float = LOW, least_pages: int = PAGES) -> DataFrame:
    """(host, dropped keys) of hosts with branches of low composite importance.

    Only paths on at least two pages of a host take part, so a group is as large as the host's own templates.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key")
        at = {k: i for i, k in enumerate(pdf["key"])}
        kids: dict[int, list[int]] = {}
        for i, p in enumerate(pdf["parent"]):
            if p in at and at[p] != i:
                kids.setdefault(at[p], []).append(i)
        m = np.log(np.maximum(pdf["pages"].to_numpy(), 2))
        shown = np.maximum(pdf["shown"].to_numpy(), 1)
        node = np.clip((np.log(shown) - pdf["shown_log"].to_numpy() / shown) / m, 0, 1)
        texts = pdf["texts"].to_numpy()
        leaf = np.where(texts > 0, 1 - np.clip(pdf["texts_log"].to_numpy() / np.maximum(texts, 1) / m, 0, 1), np.nan)
        styles = pdf["styles"].to_numpy()
        imp = np.full(len(pdf), np.nan)
        most = np.full(len(pdf), np.nan)  # of the branch and all below it
        order, todo = [], [i for i, p in enumerate(pdf["parent"]) if p not in at]
        while todo:
            i = todo.pop()
            order.append(i)
            todo += kids.get(i, [])
        for i in reversed(order):
            below = [imp[j] for j in kids.get(i, []) if not np.isnan(imp[j])] + ([leaf[i]] if not np.isnan(leaf[i]) else [])
            if below:
                w = GAMMA ** styles[i] if kids.get(i) else 1.0
                imp[i] = (1 - w) * node[i] + w * max(below)
                most[i] = max([imp[i], *(most[j] for j in kids.get(i, []) if not np.isnan(most[j]))])
        bad = (most < low) & (pdf["pages"].to_numpy() >= least_pages)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "dropped": [pdf["key"].to_numpy()[bad].tolist()]})

    found = nodes.where("pages >= 2").groupBy("host").applyInPandas(run, "host string, dropped array<long>")
    return found.where("size(dropped) > 0")


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", most_broadcast: int = 500_000) -> DataFrame:
    """The input with ``text`` and ``n_chars``, without the html.

    The drop lists go to every executor if they hold at most ``most_broadcast`` keys (8 bytes each); beyond that they are joined by host.
    """
    lists = written(low_branches(style_nodes(pages, url_col, html_col)), "dropped")
    keys = lists.agg(F.coalesce(F.sum(F.size("dropped")), F.lit(0))).first()[0]
    base = pages.drop("text", "n_chars")
    kept = [f for f in base.schema if f.name != html_col]
    joined = base.withColumn("__host", host_column(url_col))
    if keys <= most_broadcast:
        small = {r["host"]: frozenset(r["dropped"]) for r in lists.collect()}
        forget(lists)
    else:
        joined = joined.join(lists.select(F.col("host").alias("__host"), F.col("dropped").alias("__dropped")), "__host", "left")
        small = None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none: frozenset[int] = frozenset()
        met: tuple[str | None, frozenset[int]] = (None, none)
        for pdf in batches:
            texts = []
            for i, page in enumerate(pdf[html_col]):
                host = pdf["__host"].iat[i]
                if small is not None:
                    dropped = small.get(host, none)
                else:
                    if met[0] != host:  # rows of one host come together after a join
                        d = pdf["__dropped"].iat[i]
                        met = (host, none if d is None else frozenset(d))
                    dropped = met[1]
                texts.append(extract(page, dropped) if isinstance(page, str) else "")
            yield pdf[[f.name for f in kept]].assign(text=texts, n_chars=[len(t) for t in texts])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return joined.mapInPandas(lean(run), f"{schema}, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
