"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of one host.

A page becomes a stream of tags and texts, its tags nested and its inline tags left out.  A
wrapper is a sequence of items (a tag with a sequence of its own, a text slot, or
a group of items), each of which may be optional or repeated; there are no
alternatives.  Pages of a host are aligned with its wrapper one after the
other: neighbouring equal items become a repeated group, items that one side
lacks become optional, texts that differ become slots.  Each task folds the
pages it reads into one wrapper a host; these are folded again in two rounds
(by host and salt, then by host), so a hot host is neither gathered nor sampled.

The main part is chosen on the wrapper, which knows for each item how much text
its pages hold there, how much of it is linked, and whether it is the same
everywhere: articles (else ``main``) where the host has them, else the innermost
container of most of the text.  Each page is then aligned with its host's wrapper, and the text
of the main items is written out block by block; menus, adverts, comments and the like go by
tag, class, id and role wherever they stand.

Defined results: a null url, or one without a host, belongs to the host ''; a
null, empty or textless html gives an empty text; character references are
decoded once, broken ones stay as they are; white space is Unicode's; tags nested
deeper than DEEP are read as part of what holds them, and an item with over WIDE
different parts in a row is kept as one part without structure (its text is judged as a whole): no text is
lost by either; repeated pages count as often as they stand; other columns are carried
through, those named like a result column give way to it; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.llm.storage import fresh, stash

DEEP, WIDE, PERIOD = 100, 120, 6
#: Wrappers of other hosts that one task keeps before it passes them on, partial wrappers' salts, and the bytes up to which wrappers are broadcast.
HOSTS, SALTS, BROADCAST = 2000, 64, 64 << 20

# HTML's elements by kind, and names that sites give to what isn't the article.
RAW = "script style textarea title noscript iframe template svg math object select option canvas audio video map".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "body": set()}
CONTAINERS = set("html body div section main article table tbody tr td center form".split())
DROPPED = set("head nav menu footer aside form dialog button".split())
ROLES = set("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog".split())
NAMES = set(
    "nav navbar navigation navi menu submenu breadcrumb breadcrumbs header masthead topbar footer sidebar aside ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond replies share sharing social related recommended widget pagination pager toolbar paywall".split()
)
#: Elements that hold the article are dropped by these names only.
STRICT = set("comment comments ad ads advert advertisement promo sponsored related teaser".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r""")(?=[\s/>])(?:[^>"']++|"[^"]{0,4000}+"|'[^']{0,4000}+'|["'])*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]{0,4000}+"|'[^']{0,4000}+'|["'])*+)(?:>|\Z)""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS, DIGITS, CAMEL = re.compile(r"[^a-z]+"), re.compile(r"[0-9]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(50_000)
def _named(tag: str, attrs: str) -> tuple[str, bool]:
    """An element's label (tag, class and id without digits) and whether what it holds is dropped."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAMED.finditer(attrs)}
    name = " ".join(found[k] for k in ("id", "class") if found.get(k))
    parts = [WORDS.split(CAMEL.sub(" ", n).lower()) for n in name.split()]
    words = {w for p in parts if p[0] not in ("has", "with", "no", "without", "is") for w in p}
    role = found.get("role", "").lower()
    if tag in ("html", "body"):
        dropped = False
    elif tag in ("article", "main") or role in ("main", "article"):
        dropped = any(p[0] in STRICT for p in parts)
    else:
        dropped = tag in DROPPED or role in ROLES or bool(words & NAMES) or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    label = {"main": "main", "article": "article"}.get(role, tag)
    label += "." + DIGITS.sub("", ".".join(sorted(name.split()))) if name else ""
    return ("!" if dropped else "") + label, dropped


class Item:
    """Part of a page or wrapper: ``label`` is a tag, '#' for text or '(..)' for a group; sums over what was folded in."""

    __slots__ = ("label", "many", "optional", "kids", "pages", "text", "chars", "linked", "at")

    def __init__(self, label: str, kids: list | None = None, many: bool = False, optional: bool = False, pages: int = 1, text: str | None = None, chars: int = 0, linked: int = 0, at: list | None = None):
        self.label, self.kids, self.many, self.optional, self.pages = label, kids if kids is not None else [], many, optional, pages
        self.text, self.chars, self.linked = text, chars, linked
        self.at = at if at is not None else []  # places of its texts in a page's stream

    def plain(self) -> list:
        return [self.label, int(self.many), int(self.optional), self.pages, self.text, self.chars, self.linked, [k.plain() for k in self.kids]]

    @classmethod
    def read(cls, x: list) -> Item:
        return cls(x[0], [cls.read(k) for k in x[7]], bool(x[1]), bool(x[2]), x[3], x[4], x[5], x[6])

    def all_places(self) -> Iterator[int]:
        yield from self.at
        for k in self.kids:
            yield from k.all_places()


def page_stream(html: str) -> tuple[Item, list[tuple[int, str]]]:
    """The page as nested items, and its texts in order, each with the number of its block."""
    root = Item("page")
    open_: list[tuple[str, Item, int]] = [("", root, 0)]  # tag, item, depth of links
    texts: list[tuple[int, str]] = []
    block = links = last = 0

    def closed(keep: int) -> None:
        nonlocal block, links
        for tag, _, held in open_[keep:]:
            block += tag not in INLINE
            links = held
        del open_[keep:]

    def text(raw: str) -> None:
        if raw and (not raw.isspace() or texts):
            value = unescape(raw) if "&" in raw else raw
            shown = value.strip()
            holder = open_[-1][1]
            if shown:
                if holder.kids and holder.kids[-1].label == "#" and texts and texts[-1][0] == block:
                    slot = holder.kids[-1]
                    slot.text = None if slot.text is None else slot.text + shown[:200]
                else:
                    slot = Item("#", text=shown[:200])
                    holder.kids.append(slot)
                slot.chars += len(shown)
                slot.linked += len(shown) if links else 0
                slot.at.append(len(texts))
            elif holder.kids and holder.kids[-1].label == "#":
                holder.kids[-1].at.append(len(texts))
            texts.append((block, value))

    for m in TOKEN.finditer(html):
        text(html[last : m.start()])
        last = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] == tag:
                    closed(i)
                    break
            if tag == "a":
                links = 0
            elif tag not in INLINE:
                block += 1
            continue
        if tag in VOID:
            if tag == "hr":
                block += 1
            elif tag == "br":
                texts.append((block, " "))
                if open_[-1][1].kids and open_[-1][1].kids[-1].label == "#":
                    open_[-1][1].kids[-1].at.append(len(texts) - 1)
            continue
        if tag == "a":
            links = 1
        label, dropped = _named(tag, m["attrs"])
        if tag == "header" and not dropped and not any(_base(o[1].label) in ("article", "main") for o in open_):
            label = "!" + label
        if tag in INLINE and not dropped:
            continue
        if tag in CLOSES_P:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] == "p":
                    closed(i)
                    break
                if open_[i][0] not in INLINE:
                    break
        if tag in CLOSES:
            first = None
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] in SCOPES[tag]:
                    break
                if open_[i][0] in CLOSES[tag]:
                    first = i
            if first:
                closed(first)
        if tag not in INLINE:
            block += 1
        if len(open_) < DEEP and not m["attrs"].endswith("/"):
            item = Item(label)
            open_[-1][1].kids.append(item)
            open_.append((tag, item, links))
    text(html[last:])
    folded(root)
    return root, texts


def unified(x: Item, y: Item, pages: bool) -> Item:
    """One item for two of the same label.  ``pages``: of different pages, not of one."""
    many = x.many or y.many or not pages
    out = Item(x.label, many=many, optional=x.optional or y.optional, pages=x.pages + y.pages if pages else max(x.pages, y.pages), text=x.text if x.text == y.text else None, chars=x.chars + y.chars, linked=x.linked + y.linked, at=x.at + y.at)
    out.kids = aligned(x.kids, y.kids, pages) if x.label != "*" else []
    return out


def opened(x: Item) -> Item:
    """An item without structure, where there would be too much of it."""
    out = Item("*", many=True, pages=x.pages)
    stack = list(x.kids)
    while stack:
        k = stack.pop()
        out.chars, out.linked, out.at = out.chars + k.chars, out.linked + k.linked, out.at + k.at
        stack.extend(k.kids)
    out.at.sort()
    return out


def squeezed(items: list[Item], pages: bool = False) -> list[Item]:
    """Neighbouring equal items, or runs of up to PERIOD items, as one repeated item or group."""
    for period in range(1, min(PERIOD, len(items) // 2) + 1):
        labels = [i.label for i in items]
        if not any(labels[i] == labels[i + period] for i in range(len(labels) - period)):
            continue
        out: list[Item] = []
        i = 0
        while i < len(items):
            run = labels[i : i + period]
            if labels[i + period : i + 2 * period] != run or "*" in run or (period > 1 and run[:-1] == run[1:]):
                out.append(items[i])
                i += 1
                continue
            parts = items[i : i + period]
            i += period
            while labels[i : i + period] == run:
                parts = [unified(a, b, False) for a, b in zip(parts, items[i : i + period])]
                i += period
            if period == 1:
                parts[0].many = True
                out.append(parts[0])
            else:
                for p in parts:
                    p.many = p.many and p.label == "#"
                out.append(Item("(" + " ".join(run) + ")", parts, many=True, pages=max(p.pages for p in parts), optional=all(p.optional for p in parts)))
        items = out
    return items


def folded(item: Item) -> None:
    """Squeeze a page's items from the inside out (the nesting is bounded by DEEP)."""
    for k in item.kids:
        folded(k)
    item.kids = squeezed(item.kids)
    if len(item.kids) > WIDE:
        item.kids = [opened(item)]


def matched(x: list[Item], y: list[Item]) -> list[tuple[int | None, int | None]]:
    """The longest common subsequence of the labels, with what is left of both sides in between."""
    a, b = [i.label for i in x], [i.label for i in y]
    if a == b:
        return [(i, i) for i in range(len(a))]
    longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = longest[i], longest[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j] and longest[i][j] == longest[i + 1][j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and longest[i + 1][j] >= longest[i][j + 1]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def aligned(x: list[Item], y: list[Item], pages: bool) -> list[Item]:
    """One sequence of items that covers both."""
    if len(x) == 1 and x[0].label == "*" or len(y) == 1 and y[0].label == "*":
        a, b = (opened(Item("", kids=k, pages=max((i.pages for i in k), default=0))) for k in (x, y))
        return [Item("*", many=True, pages=a.pages + b.pages if pages else max(a.pages, b.pages), chars=a.chars + b.chars, linked=a.linked + b.linked, at=a.at + b.at)]
    out = []
    for i, j in matched(x, y):
        if i is None or j is None:
            item = x[i] if j is None else y[j]
            item.optional = True
            out.append(item)
        else:
            out.append(unified(x[i], y[j], pages))
    out = squeezed(out)
    return [opened(Item("", kids=out, pages=max(i.pages for i in out)))] if len(out) > WIDE else out


# The main part


def _base(label: str) -> str:
    return label.lstrip("!").split(".")[0]


def _sums(item: Item, fixed: bool) -> tuple[int, int]:
    """Characters of an item's text, and those in links; dropped parts and (``fixed``) texts that are the same everywhere don't count."""
    if item.label.startswith("!") or (fixed and item.label == "#" and item.text is not None):
        return 0, 0
    chars, linked = item.chars, item.linked
    for k in item.kids:
        c, n = _sums(k, fixed)
        chars, linked = chars + c, linked + n
    return chars, linked


def _holding(item: Item, tag: str, out: list[Item]) -> list[Item]:
    """The outermost items of a tag, outside dropped parts."""
    for k in item.kids:
        if k.label.startswith("!"):
            continue
        if _base(k.label) == tag and _sums(k, False)[0]:
            out.append(k)
        else:
            _holding(k, tag, out)
    return out


def main_items(wrapper: Item) -> tuple[list[Item], bool]:
    """The items that hold the article, and whether the page itself says so."""
    for tag in ("article", "main"):
        found = _holding(wrapper, tag, [])
        if found:
            return found, True
    fixed = wrapper.pages >= 3 and _sums(wrapper, True)[0] > 0
    free = lambda i: (lambda s: s[0] - s[1])(_sums(i, fixed))
    here = wrapper
    while free(here):
        inner = [k for k in here.kids if not k.label.startswith("!") and (k.label.startswith("(") or _base(k.label) in CONTAINERS) and free(k) >= 0.7 * free(here)]
        if not inner or inner[0].label.startswith("("):
            break
        here = inner[0]
    return [here], False


class Extractor:
    """A host's wrapper with its main part chosen."""

    def __init__(self, wrapper: Item | None) -> None:
        self.wrapper = wrapper
        self.main, self.said = main_items(wrapper) if wrapper is not None else ([], False)
        self.fixed = wrapper is not None and wrapper.pages >= 3 and _sums(wrapper, True)[0] > 0
        self.chosen = {id(i) for i in self.main}

    def text(self, html: str) -> str:
        page, texts = page_stream(html)
        places: set[int] = set()
        if self.wrapper is not None:
            self._walk(self.wrapper, page, id(self.wrapper) in self.chosen, places)
        if not places:  # the wrapper's main part holds nothing on this page: the page is its own wrapper
            own = Extractor.__new__(Extractor)
            own.wrapper, own.fixed = page, False
            own.main, own.said = main_items(page)
            own.chosen = {id(i) for i in own.main}
            own._walk(page, page, id(page) in own.chosen, places)
        blocks: dict[int, list[str]] = {}
        for i in sorted(places):
            blocks.setdefault(texts[i][0], []).append(texts[i][1])
        lines = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n".join(line for line in lines if line)

    def _walk(self, wrapper: Item, page: Item, inside: bool, places: set[int]) -> None:
        """Collect the places of the main texts; parts of the page that the wrapper doesn't know are judged like what holds them."""
        for i, j in matched(wrapper.kids, page.kids):
            if j is None:
                continue
            part, known = page.kids[j], wrapper.kids[i] if i is not None else None
            if part.label.startswith("!"):
                continue
            here = inside or (known is not None and id(known) in self.chosen) or (known is None and self.said and _base(part.label) == _base(self.main[0].label))
            if known is None:
                if here:
                    _whole(part, places)
                continue
            if inside and not self.said and self._template(known):
                continue
            if here:
                places.update(part.at)
            self._walk(known, part, here, places)

    def _template(self, item: Item) -> bool:
        """Where no tag says what the article is: texts that all pages share, and lists of links."""
        if item.label == "#":
            return self.fixed and item.text is not None and not item.many and item.pages == self.wrapper.pages
        chars, linked = _sums(item, False)
        return item.label != "#" and bool(chars) and _base(item.label) not in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and linked > 0.8 * chars


def _whole(item: Item, places: set[int]) -> None:
    if not item.label.startswith("!"):
        places.update(item.at)
        for k in item.kids:
            _whole(k, places)


# On Spark


def page_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; '' without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _plain(wrapper: Item) -> str:
    return json.dumps(wrapper.plain(), ensure_ascii=False, separators=(",", ":"))


def _merged(x: Item | None, y: Item) -> Item:
    return y if x is None else unified(x, y, True)


WRAPPERS = "host string, salt int, wrapper string"


def _first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One wrapper for each host that a task reads."""
    held: dict[str, Item] = {}
    salt = TaskContext.get().partitionId() % SALTS

    def out() -> pd.DataFrame:
        return pd.DataFrame([(h, salt, _plain(w)) for h, w in held.items()], columns=["host", "salt", "wrapper"])

    for batch in batches:
        for host, html in zip(batch["host"], batch["html"]):
            if html:
                held[host] = _merged(held.get(host), page_stream(html)[0])
            if len(held) >= HOSTS:
                yield out()
                held.clear()
    yield out()


def _again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Wrappers that follow each other, folded while host and salt stay the same."""
    now, held = None, None
    done = []
    for batch in batches:
        for host, salt, plain in zip(batch["host"], batch["salt"], batch["wrapper"]):
            if (host, salt) != now:
                if held is not None:
                    done.append((*now, _plain(held)))
                now, held = (host, salt), None
            held = _merged(held, Item.read(json.loads(plain)))
        if done:
            yield pd.DataFrame(done, columns=["host", "salt", "wrapper"])
            done = []
    if held is not None:
        yield pd.DataFrame([(*now, _plain(held))], columns=["host", "salt", "wrapper"])


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One wrapper (JSON) for each host, from all its pages."""
    rows = pages.select(page_host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    parts = rows.mapInPandas(_first, WRAPPERS)
    fold = lambda df: df.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInPandas(_again, WRAPPERS)
    return fold(fold(parts).withColumn("salt", F.lit(0))).select("host", "wrapper")


@lru_cache(256)
def _extractor(wrapper: str | None) -> Extractor:
    return Extractor(None if wrapper is None else Item.read(json.loads(wrapper)))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all but the html by default) and ``text``, the main text of each page."""
    carried = [c for c in ([c for c in pages.columns if c != html_col] if columns is None else columns) if c.lower() != "text"]
    host, html, wrapper = fresh(carried, "page_host", "page_html", "page_wrapper")
    known = stash(wrappers(pages, url_col, html_col), "wrappers").select(F.col("host").alias(host), F.col("wrapper").alias(wrapper))
    rows = pages.select(*[F.col(f"`{c}`") for c in carried], page_host(F.col(f"`{url_col}`")).alias(host), F.col(f"`{html_col}`").alias(html))
    size = known.agg(F.sum(F.octet_length(wrapper))).first()[0] or 0
    if size <= BROADCAST:
        joined = rows.join(F.broadcast(known), host, "left")
    else:  # more hosts than can be sent everywhere: each wrapper goes to SALTS partitions, so a hot host's pages spread
        salt = fresh(rows.columns + known.columns, "page_salt")[0]
        spread = known.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn(salt, F.pmod(F.xxhash64(html), F.lit(SALTS)).cast("int")).join(spread, [host, salt], "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in carried], html, wrapper)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_extractor(w.as_py()).text(h.as_py()) if h.as_py() else "" for h, w in zip(batch.column(len(carried)), batch.column(len(carried) + 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(found, pa.string())], names=[*carried, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[: len(carried)])
    return joined.mapInArrow(texts, f"{kinds}{', ' if kinds else ''}text string")
