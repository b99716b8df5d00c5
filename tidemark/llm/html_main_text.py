"""Main text of web pages by consensus host paths.

Pass 1 scores the containers of every page and votes for the path of its best one: the
generalised tag-class path, in which digits are one sign. Spark counts the votes by host.
Pass 2 extracts every page again from the element at its host's winning path; a page
without such an element, or without a host, goes by its own best container.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.storage import map_arrow, written

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: The rest of a tag up to the > outside quotes; possessive, so that it never goes back.
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?=[\s=/>]|$)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_MAY_NAME = re.compile(r"class|id\s*=|role|style|hidden", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_DIGITS = re.compile(r"\d+")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: HTML's elements by the part they play here.
RAW = frozenset("script style noscript template textarea iframe object svg math title head select button".split())
#: Of those, the ones that hide no more than themselves if they are never closed.
OPEN_RAW = frozenset("head button select object noscript template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
STRONG_TAGS, SOFT_TAGS = frozenset("nav header footer aside dialog menu".split()), frozenset(["form"])
CONTAINERS = frozenset("body main article section div td center form".split())
#: Parts of class and id names. Those of what is not the article; of reader comments and adverts among them; of what is so only by itself or as the last part.
STRONG_NAMES = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu menus nav navbar navigation newsletter pager pagination recommended related replies sidebar social sponsor sponsored widget widgets".split())
NEVER_NAMES = frozenset("ad ads advert adverts advertisement advertising comment comments disqus replies".split())
SOFT_NAMES = frozenset("banner disclaimer form header login modal modals notice notices notification notifications overlay paywall popup popups promo promoted promotion search share sharing signup subscribe subscription toolbar".split())
#: Parts beside which a soft name still stands by itself; parts that make a name speak of the layout around it.
HELPERS = frozenset("area bar block bottom box btn button buttons col container default desktop fixed global icon icons inner item items js left link links list main message mobile msg outer page panel primary right row secondary section site small sticky top wrap wrapper".split())
WITHOUT, LAYOUT = frozenset("with has no without".split()), frozenset("left right layout".split())
STRONG_ROLES, SOFT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split()), frozenset(["form"])
#: A container is passed over for one inside it that has this share of its text.
DEEPER = 0.9
#: An element marked as no article by a weak sign is one after all if it has more than this share of the page's text.
MOST = 0.5
#: Characters of a path beyond which its upper part is a digest.
PATH_CHARS = 1000
#: Winning paths are sent to every executor up to so many characters; beyond, pages meet them by shuffle, a host's spread over so many keys.
BROADCAST_CHARS, SALTS = 32_000_000, 64
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("table td th ul ol dl article section main div body aside nav header footer form".split())


class _Element:
    __slots__ = ("tag", "path", "sign", "first", "last", "article", "holds", "parent")

    def __init__(self, tag: str, path: str, sign: str, first: int, parent: _Element | None, article: bool):
        # sign: "never", "strong" or "soft" if the element looks like no part of the article; holds: an article begins inside
        self.tag, self.path, self.sign, self.first, self.parent, self.article = tag, path, sign, first, parent, article
        self.last, self.holds = first, False


class _Page:
    """A page in one pass, linear in its length whatever it holds: blocks of text, their characters outside links, and elements over runs of blocks."""

    def __init__(self, page: str):
        self.page = page
        self.blocks: list[str] = []
        self.weights: list[int] = []
        self.elements: list[_Element] = []
        self.stack = [_Element("", "", "", 0, None, False)]
        self.places: dict[str, list[int]] = {}  # where each tag is in the stack
        self.scopes: list[int] = []
        self.run: list[str] = []
        self.links = 0
        self.in_link = False
        self.mute, self.mute_depth = "", 0  # inside an inline element that is no part of the article
        self.quotes = True  # until a tag's quotes do not close
        self.unclosed: set[str] = set()  # raw elements of which no end tag follows
        self._read()
        self._flush()
        self._close(0)

    def _read(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                return self._text(at, n)
            self._text(at, lt)
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            name = _NAME.match(page, lt + 1)
            if name is None:
                if page[lt + 1 : lt + 2] in ("!", "?", "/") and (end := page.find(">", lt)) >= 0:
                    at = end + 1
                else:
                    self._text(lt, lt + 1)
                    at = lt + 1
                continue
            end = self._tag_end(name.end())
            if end < 0:  # no tag ends any more
                return self._text(lt, n)
            at = end
            tag = name[2].lower()
            if name[1]:
                self._end_tag(tag)
            else:
                at = self._start_tag(tag, page[name.end() : end - 1], end)

    def _tag_end(self, at: int) -> int:
        if self.quotes:
            if m := _REST.match(self.page, at):
                return m.end()
            self.quotes = False
        return self.page.find(">", at) + 1 or -1

    def _text(self, at: int, end: int) -> None:
        if end > at and not self.mute:
            self.run.append(self.page[at:end])
            if self.in_link:
                self.links += end - at

    def _flush(self) -> None:
        if self.run:
            text = " ".join(html.unescape("".join(self.run)).split())
            if text:
                self.blocks.append(text)
                self.weights.append(max(0, len(text) - self.links))
        self.run, self.links = [], 0

    def _close(self, n: int) -> None:
        while len(self.stack) > n:
            e = self.stack.pop()
            e.last = len(self.blocks)
            if e.tag:
                self.places[e.tag].pop()
                if e.tag in _SCOPE:
                    self.scopes.pop()

    def _end_tag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag in INLINE:
            if tag == self.mute:
                self.mute_depth -= 1
                if not self.mute_depth:
                    self.mute = ""
            return
        if self.places.get(tag):
            self.mute = ""
            self._flush()
            self._close(self.places[tag][-1])

    def _start_tag(self, tag: str, attributes: str, at: int) -> int:
        """Returns where to read on."""
        if tag in RAW:
            if tag not in ("button", "select"):
                self._flush()
            return at if attributes.endswith("/") else self._raw_end(tag, at)
        if tag == "br":
            self.run += [] if self.mute else [" "]
            return at
        names = _names(attributes) if _MAY_NAME.search(attributes) else {}
        if tag in INLINE:
            if self.mute:
                self.mute_depth += tag == self.mute
            elif names and tag not in VOID and not attributes.endswith("/") and _sign(tag, names, True) in ("never", "strong"):
                self.mute, self.mute_depth = tag, 1
            self.in_link |= tag == "a"
            return at
        self._flush()
        if tag in VOID:
            return at
        self.in_link = False
        self._close_before(tag)
        top = self.stack[-1]
        sign = "never" if self.mute else _sign(tag, names, top.article)
        self.mute = ""
        inside = tag in ("article", "main") and not sign
        for e in reversed(self.stack) if inside else ():
            if e.holds:
                break
            e.holds = True
        above = top.path if len(top.path) < PATH_CHARS else "#" + hashlib.md5(top.path.encode()).hexdigest()
        name = tag + "".join("." + x for x in sorted(set(_DIGITS.sub("#", names.get("class", "")).split())))
        e = _Element(tag, f"{above}/{name}", sign, len(self.blocks), top, top.article or inside)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(e)
        self.elements.append(e)
        return at

    def _raw_end(self, tag: str, at: int) -> int:
        if tag not in self.unclosed:
            if m := re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at):
                return m.end()
            self.unclosed.add(tag)
        # Others run to the end of the page, as in a browser.
        return at if tag in OPEN_RAW else len(self.page)

    def _close_before(self, tag: str) -> None:
        """Close what an opening tag closes: open paragraphs, and items, cells and rows by their own kind."""
        kinds = ("p", *_CLOSED_BY.get(tag, ()))
        while True:
            at = max((self.places[k][-1] for k in kinds if self.places.get(k)), default=0)
            if not at or self.scopes and self.scopes[-1] > at:
                return
            self._close(at)


def _names(attributes: str) -> dict[str, str]:
    return {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(attributes)}


def _sign(tag: str, names: dict[str, str], inside_article: bool) -> str:
    """How an element looks like no part of the article: never (whatever it holds), strong, soft, or not at all."""
    if tag in ("html", "body"):
        return ""
    if names and ("hidden" in names or names.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(names.get("style", ""))):
        return "never"
    found = {"strong"} if tag in STRONG_TAGS and not (tag == "header" and inside_article) else {"soft"} if tag in SOFT_TAGS else set()
    role = names.get("role", "").lower()
    found |= {"strong"} if role in STRONG_ROLES else {"soft"} if role in SOFT_ROLES else set()
    for token in (t for k in ("class", "id") for t in names.get(k, "").split()):
        parts = [x.lower() for x in _NAME_PART.findall(token)]
        others = set(parts) - SOFT_NAMES - STRONG_NAMES
        if not WITHOUT.isdisjoint(parts):
            continue
        if not NEVER_NAMES.isdisjoint(parts):
            found.add("never")
        elif not STRONG_NAMES.isdisjoint(parts):
            found.add("strong" if LAYOUT.isdisjoint(parts) else "soft")
        elif len(others) < len(set(parts)) and (others <= HELPERS or parts[-1] in SOFT_NAMES - {"header"}):
            found.add("soft")
    sign = next((x for x in ("never", "strong", "soft") if x in found), "")
    return "soft" if sign == "strong" and tag in ("article", "main") else sign


def parse(page: str) -> tuple[list[str], list[int], list[_Element]]:
    """The article's blocks of text in page order, the characters of each outside links, and the containers among which it is, each over blocks first..last-1.

    What is never part of an article goes; what looks strongly so goes unless an article
    begins inside and it has most of the text; what weakly, unless it has most of the
    text that is left.
    """
    p = _Page(page)
    n = len(p.blocks)
    gone = np.zeros(n + 1, np.int64)

    def drop(signs: tuple[str, ...], spared) -> None:
        left = np.concatenate([[0], np.cumsum(np.where(np.cumsum(gone[:-1]) > 0, 0, p.weights))]) if n else np.zeros(1)
        for e in p.elements:
            if e.sign in signs and e.last > e.first and not (spared(e) and left[e.last] - left[e.first] > MOST * left[-1]):
                gone[e.first] += 1
                gone[e.last] -= 1

    drop(("never",), lambda e: False)
    drop(("strong",), lambda e: e.holds)
    drop(("soft",), lambda e: True)
    kept = np.cumsum(gone[:-1]) == 0
    place = np.concatenate([[0], np.cumsum(kept)]).tolist()
    containers = []
    for e in p.elements:
        e.first, e.last = place[e.first], place[e.last]
        if e.tag in CONTAINERS and e.last > e.first:
            containers.append(e)
    return [b for b, k in zip(p.blocks, kept, strict=True) if k], [w for w, k in zip(p.weights, kept, strict=True) if k], containers


def best(weights: list[int], containers: list[_Element]) -> tuple[str, int] | None:
    """Path and characters of the container that holds the article: the innermost one that keeps DEEPER of the text of the one around it."""
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    chosen, most = None, 0
    for c in containers:  # in page order: a container comes before those inside it
        n = total[c.last] - total[c.first]
        if n and (chosen is None or n >= DEEPER * most and c.first >= chosen.first and c.last <= chosen.last):
            chosen, most = c, n
    for c in containers:
        if c.tag == "article" and chosen is not None and not chosen.article and total[c.last] - total[c.first] >= 0.5 * most:
            return c.path, total[c.last] - total[c.first]
    return (chosen.path, most) if chosen else None


def extract(page: str, winner: str | None) -> str:
    """The text of the blocks in the elements at the winning path, or else in the page's own best container."""
    blocks, weights, containers = parse(page)
    inside = [c for c in containers if c.path == winner]
    if not any(c.last > c.first for c in inside):
        own = best(weights, containers)
        inside = [c for c in containers if own and c.path == own[0]]
        if not inside:
            return " ".join(blocks)
    out, done = [], 0
    for c in inside:
        out += blocks[max(c.first, done) : c.last]
        done = max(done, c.last)
    return " ".join(out)


def main_text(pages: DataFrame, html_column: str = "html", url: str = "url") -> DataFrame:
    """pages without the html, with text (string: the article's blocks joined by spaces, empty if none) and n_chars (long: its code points).

    Null or empty html: empty text; an empty table gives an empty one. A page whose url is null or has no host goes by its
    own best container. Ties of votes go to the path with more characters, then the
    lesser path. Repeated rows stay; columns of pages named text or n_chars are replaced.
    """
    pages = pages.drop("text", "n_chars")
    host = F.lower(F.regexp_extract(F.coalesce(pages[url], F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, chars = [], [], []
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, weights, containers = parse(page.as_py() or "")
                got = best(weights, containers)
                if got:
                    hosts.append(h)
                    paths.append(got[0])
                    chars.append(got[1])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(chars, pa.int64())], names=["host", "path", "chars"])

    votes = map_arrow(pages.select(host.alias("host"), html_column).where("host != ''"), vote, "host string, path string, chars long")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    winners = written(counted.groupBy("host").agg(F.max_by("path", F.struct("n", "chars", "path")).alias("_tm_path")).withColumnRenamed("host", "_tm_host"), "winners")
    keep = [c for c in pages.columns if c != html_column]
    keyed = pages.withColumn("_tm_key", host)
    size = winners.agg(F.sum(F.length("_tm_host") + F.length("_tm_path"))).first()[0] or 0
    if size <= BROADCAST_CHARS:
        joined = keyed.join(F.broadcast(winners), F.col("_tm_key") == F.col("_tm_host"), "left")
    else:  # a host's pages are spread over SALTS keys, so the largest host takes no task alone
        salted = winners.withColumn("_tm_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn("_tm_own", F.pmod(F.xxhash64(html_column), F.lit(SALTS)).cast("int"))
        joined = keyed.join(salted, (F.col("_tm_key") == F.col("_tm_host")) & (F.col("_tm_own") == F.col("_tm_salt")), "left")
    joined = joined.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html_column}`").alias("_tm_html"), "_tm_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(page.as_py() or "", path) for page, path in zip(batch.column("_tm_html"), batch.column("_tm_path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_arrow(joined, run, schema)
