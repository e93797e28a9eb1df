"""Main-text extraction with a suffix array per host.

A page is read into blocks of text. Blocks that say what they are, by their elements or
by class, id and role (menus, headers, footers, sidebars, notices, adverts, forms,
comments), are furniture. What lies in the page's article or main element is its text. All
other blocks are judged by the host: the token streams (tags and words) of its pages,
without their articles, are put one after another, a suffix array over them is built by prefix
doubling, and its intervals of suffixes with a long common prefix that come from different
pages are template text. Blocks mostly covered by it go, unique ones stay.

A host's pages are dealt into groups of bounded size. A group builds its own suffix array;
runs that recur only between groups of a host are found by the hashes of the groups' runs,
which meet by (host, hash). So the result doesn't depend on the groups, and a host that
holds a third of all pages is many tasks.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_PAGES = 256
KNOWN_HOSTS = 50_000  # most hosts of more than one group that are broadcast; more are joined

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)>|(?P<text>[^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SILENT = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "noframes", "xmp", "canvas"}
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.I) for n in ("script", "style", "textarea", "title", "iframe", "noframes", "xmp")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_FURNITURE = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "fieldset", "datalist"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - {"head", "html", "body", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary"}
# Parts of class names and ids, as words. A name tells of furniture if some part does and all others only say where it lies.
_LAYOUT = "side sidebar sidebars header masthead topbar toolbar banner banners notice notices alert alerts overlay modal modals popup popups cookie cookies consent gdpr"
_FOREIGN = (
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion newsletter newsletters subscribe subscription"
    " comment comments reply replies respond disqus navbar nav navigation menu menus breadcrumb breadcrumbs footer foot share sharing social related widget widgets"
    " pagination pager login signup search"
)
_PLACE = (
    "left right top bottom main primary secondary site page post article global wrapper wrap container content box bar area inner outer list section block group items item"
    " slot unit inline bottom fixed sticky mobile desktop small large form links icons buttons message bg"
)
_SOFT_PARTS, _HARD_PARTS, _PLACE_PARTS = set(_LAYOUT.split()), set(_FOREIGN.split()), set(_PLACE.split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[^\W_]+")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
_TEXT, _FURN, _OPEN, _SOFT = 0, 1, 2, 3  # in the article, furniture, neither, furniture by a layout name that an article inside overrules


def _sign(names: str) -> int | None:
    """What class names or an id say: _FURN, _SOFT or nothing."""
    out = None
    for name in names.replace("side-bar", "sidebar").split():
        parts = {p.lower() for p in _PARTS.findall(name) if not p.isdigit()}
        signs = parts - _PLACE_PARTS
        if signs & _HARD_PARTS and signs <= _HARD_PARTS | _SOFT_PARTS:
            return _FURN
        if signs and signs <= _SOFT_PARTS:
            out = _SOFT
    return out


def _kind(name: str, rest: str, inside: bool) -> int | None:
    """What an element makes of its content, if anything."""
    if name in _FURNITURE or (name == "header" and not inside):
        return _FURN
    signs = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest and not rest.isspace() else {}
    if signs:
        if signs.get("role", "").strip().lower() in _ROLES:
            return _FURN
        if name not in ("html", "body", "main"):
            said = [_sign(signs.get("class", "")), _sign(signs.get("id", ""))]
            if inside and (said[1] == _SOFT or re.fullmatch("h[1-6]", name)):
                said[1] = None  # within an article an id may name a heading or a part of the text
            found = _FURN if _FURN in said else _SOFT if _SOFT in said else None
            # an article may be of a class like "header-image"; only one for comments or adverts is no article
            if found is not None and (name != "article" or re.search(r"comment|repl|respon|advert|sponsor|promo|related|teaser", signs.get("class", "") + signs.get("id", ""), re.I)):
                return _FURN if name == "article" else found
        if signs.get("role", "").strip().lower() in ("main", "article"):
            return _TEXT
    return _TEXT if name in ("article", "main") else None


def blocks_of(page: str | None) -> tuple[list[tuple[int, str]], list[tuple[str, int]]]:
    """The blocks (kind, text) of a page in order, and its stream outside the article: (token, block), -1 for tags."""
    blocks: list[tuple[int, str]] = []
    stream: list[tuple[str, int]] = []
    words: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and what holds within them
    kind, skip = _OPEN, None

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            if kind != _TEXT:
                stream.extend((w, len(blocks)) for w in text.split())
            blocks.append((_FURN if kind == _SOFT else kind, text))

    page, at = page or "", 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        text = m["text"]
        if text is not None:
            if skip is None:
                words.append(html.unescape(text))
            continue
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name, end = name.lower(), m["end"] or m["end2"]
        if skip is not None:
            if end and name == skip:
                skip = None
            continue
        if name in _SILENT:
            if not end and not (m["rest"] or "").endswith("/"):
                if name in _RAW:
                    # what looks like markup inside is none: only its own end tag ends it
                    close = _RAW[name].search(page, at)
                    at = close.end() if close else len(page)
                else:
                    skip = name
            continue
        if name == "br":
            words.append(" ")
            continue
        if name in _BLOCK:
            flush()
            if kind != _TEXT:
                stream.append((f"<{end}{name}>", -1))
        if end:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
                kind = stack[-1][1] if stack else _OPEN
        elif name not in _VOID:
            if name in _CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in _BLOCK:
                        break
                kind = stack[-1][1] if stack else _OPEN
            if name == "li" and stack and stack[-1][0] == "li":
                stack.pop()
                kind = stack[-1][1] if stack else _OPEN
            new = _kind(name, m["rest"] or m["rest2"] or "", kind == _TEXT)
            # furniture stays furniture whatever is inside, but a wrapper's name does not outweigh an article
            if new is not None and (kind not in (_FURN, _SOFT) or (kind == _SOFT and new == _TEXT) or (kind == _SOFT and new == _FURN)):
                flush()
                kind = new
            stack.append((name, kind))
    flush()
    return blocks, stream


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the ranks of all prefixes of 1, 2, 4, ... tokens, by prefix doubling."""
    rank = np.unique(tokens, return_inverse=True)[1].astype("int64")
    ranks, step = [rank], 1
    order = np.argsort(rank, kind="stable")
    while len(rank) and step < len(rank) and rank.max() < len(rank) - 1:
        ahead = np.full(len(rank), -1, "int64")
        ahead[:-step] = rank[step:]
        order = np.lexsort((ahead, rank))
        new = np.ones(len(rank), "int64")
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new) - 1
        ranks.append(rank)
        step *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix in order with the one before it; 0 for the first."""
    out = np.zeros(len(order), "int64")
    if len(order) < 2:
        return out
    a, b = order[:-1], order[1:]
    n, lcp = len(order), np.zeros(len(order) - 1, "int64")
    for level in range(len(ranks) - 1, -1, -1):
        i, j = a + lcp, b + lcp
        ok = (np.maximum(i, j) + (1 << level)) <= n
        same = np.zeros(len(lcp), bool)
        same[ok] = ranks[level][i[ok]] == ranks[level][j[ok]]
        lcp += same.astype("int64") << level
    out[1:] = lcp
    return out


class Group:
    """Some pages of one host: their blocks, the joined streams, and which tokens recur."""

    def __init__(self, packed, run: int):
        self.run = run
        self.pages = [json.loads(zlib.decompress(p)) for p in packed]
        number: dict[str, int] = {}
        tokens, page, block = [], [], []
        for n, (_, stream) in enumerate(self.pages):
            for word, b in stream:
                tokens.append(number.setdefault(word, len(number)))
                page.append(n)
                block.append(b)
            tokens.append(-1 - n)  # a mark of its own ends each page
            page.append(n)
            block.append(-1)
        self.tokens, self.page, self.block = np.array(tokens, "int64"), np.array(page, "int64"), np.array(block, "int64")
        self.words = list(number)
        # places where a whole run lies within its page
        ends = np.flatnonzero(self.tokens < 0)
        self.fits = ends[self.page] - np.arange(len(self.tokens)) >= run if len(ends) else np.zeros(0, bool)

    def shared(self) -> np.ndarray:
        """Places whose next `run` tokens are also found on another page of the group."""
        order, ranks = suffix_array(self.tokens)
        lcp = common_prefixes(order, ranks)
        heads = np.flatnonzero(lcp < self.run)  # each begins an interval
        out = np.zeros(len(order), bool)
        if len(heads):
            pages = self.page[order]
            several = np.minimum.reduceat(pages, heads) != np.maximum.reduceat(pages, heads)
            out[order] = np.repeat(several, np.diff(np.append(heads, len(order))))
        return out & self.fits

    def grams(self) -> np.ndarray:
        """A hash of the `run` tokens from each place on that they fit (elsewhere 0)."""
        h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.words] or [0], "uint64")[np.maximum(self.tokens, 0)]
        out = np.zeros(len(h), "uint64")
        n = max(0, len(h) - self.run + 1)
        for i in range(self.run):
            out[:n] = out[:n] * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        return np.where(self.fits, out ^ (out >> np.uint64(29)), 0).view("int64")

    def texts(self, elsewhere: np.ndarray, most: float) -> list[str]:
        starts = self.shared()
        if len(elsewhere):
            starts |= self.fits & np.isin(self.grams(), elsewhere)
        steps = np.zeros(len(starts) + self.run + 1, "int64")
        at = np.flatnonzero(starts)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + self.run, -1)
        covered = np.cumsum(steps)[: len(starts)] > 0
        out = []
        bounds = np.searchsorted(self.page, np.arange(len(self.pages) + 1))
        for n, (blocks, _) in enumerate(self.pages):
            part = slice(bounds[n], bounds[n + 1])
            b, c = self.block[part], covered[part]
            total = np.bincount(b[b >= 0], minlength=len(blocks))
            hit = np.bincount(b[(b >= 0) & c], minlength=len(blocks))
            out.append("\n".join(t for i, (kind, t) in enumerate(blocks) if kind == _TEXT or (kind == _OPEN and hit[i] <= most * total[i])))
        return out


def main_texts(pages: DataFrame, run: int = 8, most: float = 0.5) -> DataFrame:
    """(page_id, url, text): the main text of every page, its blocks joined by newlines; empty if there is none.

    A block outside an article is template text if more than `most` of its words lie in runs
    of at least `run` tokens that occur on another page of the host. NULL html is an empty
    page; pages without a host in their url count as one host. Repeated rows are pages of
    their own, so what only they share is kept if it is in an article. Other columns play
    no part; an empty table gives an empty result.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    slim = pages.select("page_id", "url", "html").withColumn("host", host)
    large = slim.groupBy("host").count().filter(F.col("count") > GROUP_PAGES)
    large = large.select("host", F.ceil(F.col("count") / GROUP_PAGES).alias("groups"))
    if large.count() <= KNOWN_HOSTS:
        large = F.broadcast(large)
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [zlib.compress(json.dumps(blocks_of(h), ensure_ascii=True).encode(), 1) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "host": batch["host"], "packed": packed})

    parsed = slim.mapInPandas(read, f"page_id {kind}, url string, host string, packed binary").join(large, "host", "left")
    groups = F.coalesce("groups", F.lit(1)).cast("long")
    parsed = parsed.select("page_id", "url", "host", "packed", groups.alias("groups"), F.pmod(F.xxhash64("page_id", "url"), groups).alias("part"))
    dealt = parsed.groupBy("host", "part")

    def runs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grams = np.zeros(0, "int64")
        if pdf["groups"].iloc[0] > 1:
            group = Group(pdf["packed"], run)
            grams = np.unique(group.grams()[group.fits])
        return pd.DataFrame({"host": key[0], "part": np.full(len(grams), key[1], "int64"), "gram": grams})

    sent = dealt.applyInPandas(runs, "host string, part long, gram long")
    # min and max tell two groups apart without listing them; the groups themselves are asked for by the join
    across = sent.groupBy("host", "gram").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select(F.struct("host", "gram").alias("k"))
    across = sent.withColumn("k", F.struct("host", "gram")).join(across, "k", "left_semi").select("host", "part", "gram")

    def extract(_: tuple, pdf: pd.DataFrame, elsewhere: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"page_id": [], "url": [], "text": []})
        texts = Group(pdf["packed"], run).texts(elsewhere["gram"].to_numpy("int64"), most)
        return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts})

    return dealt.cogroup(across.groupBy("host", "part")).applyInPandas(extract, f"page_id {kind}, url string, text string")


def page_rows(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    return main_texts(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
