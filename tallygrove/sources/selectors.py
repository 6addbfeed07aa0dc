"""Items of fetched pages by CSS selectors: prices, products, headlines and events.

`PageItems` is a table function (page -> rows) for lateral joins, in DataFrames
(`page_items`) and, once `register_functions` has run, in SQL:

    SELECT page_id, i.* FROM pages, LATERAL page_items(html, 'products', array('ul.plans > li')) i

Kinds and their rows (place, title, price_text, details, event_date):

* pricing: selected elements whose text has a price; if there are none, every string of the page that has
  one (comments, scripts and styles are strings too), titled `unlabeled`. Any number of up to five digits is a price;
* products: selected elements with text;
* marketing, headlines: selected elements with eight characters or more, in details; no title;
* events, announcements: the same with title and the first date in the text.

Any other kind has no rows. Without selectors, headings h1 to h3, articles, sections and list items are
selected. At most 300 elements and, unless `most` says otherwise (null: all), 500 different items a page count. Selectors know names, `*`, `#id`,
`.class`, `[attr]` with `=`, `^=`, `$=`, `*=`, `~=`, `:first-child`, descendants, `>` and lists with
commas; anything else is an error.

Character references are read as HTML does, which decodes some without their semicolon too (`&amp` before a
tag). With `closed` only those that end in a semicolon are decoded, and the others stay as they are written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a price and a date look like.
PRICE = re.compile(r"(?:USD|US\$|\$|EUR|€|GBP|£)?\s?\d{1,5}(?:[.,]\d{1,2})?(?:\s?/\s?(?:mo|month|yr|year|user))?", re.IGNORECASE)
# Formats by what a text of theirs looks like, with single spaces; no text looks like two.
DATE_FORMATS = (
    (re.compile(r"\d{4}-\d{1,2}-\d{1,2}"), ("%Y-%m-%d",)), (re.compile(r"\D+ \d{1,2}, \d{4}"), ("%B %d, %Y", "%b %d, %Y")),
    (re.compile(r"\d{1,2} \D+ \d{4}"), ("%d %B %Y",)), (re.compile(r"\d{1,2}/\d{1,2}/\d{4}"), ("%m/%d/%Y", "%d/%m/%Y")),
)
DATE_TOKEN = re.compile(r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},\s+\d{4})\b", re.IGNORECASE)
DEFAULT_TAGS = ("h1", "h2", "h3", "article", "section", "li")
TITLE_TAGS = ("h1", "h2", "h3", "h4", "strong", "b")
MOST_ELEMENTS, MOST_ITEMS, MOST_TITLE, LEAST_HEADLINE = 300, 500, 180, 8

# Rows of a configuration that are broadcast.
MOST_CONFIG = 100_000

_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_UNREAD = frozenset(("script", "style", "template"))
_REFERENCE = re.compile(r"&(?:(#(?:[0-9]+|[xX][0-9a-fA-F]+);)|([A-Za-z][A-Za-z0-9]*;))?")


class Element:
    """An element of a page: name, attributes, parent, and children (elements and strings) in order."""

    __slots__ = ("name", "attrs", "parent", "children")

    def __init__(self, name: str, attrs: dict[str, str], parent: Element | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def elements(self) -> Iterator[Element]:
        """All elements below, in document order."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Element):
                yield x
                stack.extend(reversed(x.children))

    def text(self) -> str:
        """The stripped strings below, one space between; what is in scripts, styles and templates is no text."""
        found, stack = [], list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Element):
                if x.name not in _UNREAD:
                    stack.extend(reversed(x.children))
            elif x.strip():
                found.append(x.strip())
        return " ".join(found)


class _Builder(HTMLParser):
    """Builds the elements; `strings` also holds comments, in order. `mark` stands for ampersands that begin no reference."""

    def __init__(self, mark: str | None = None):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.strings: list[str] = []
        self.held: list[str] = []
        self.mark = mark

    def written(self, text: str | None) -> str:
        return (text or "").replace(self.mark, "&") if self.mark else text or ""

    def flush(self):
        if self.held:
            text = self.written("".join(self.held))
            self.held.clear()
            self.at.children.append(text)
            self.strings.append(text)

    def handle_starttag(self, tag, attrs):
        self.flush()
        new = Element(tag, {k: self.written(v) for k, v in reversed(attrs)}, self.at)
        self.at.children.append(new)
        if tag not in _VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.flush()
        self.at.children.append(Element(tag, {k: self.written(v) for k, v in reversed(attrs)}, self.at))

    def handle_endtag(self, tag):
        self.flush()
        x = self.at
        while x is not None and x.name != tag:
            x = x.parent
        if x is not None and x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.held.append(data)

    def handle_comment(self, data):
        self.flush()
        self.strings.append(self.written(data))


def parsed(html: str | None, closed: bool = False) -> tuple[Element, list[str]]:
    """(root, strings) of a page; what cannot be read ends the page."""
    mark = None
    if closed and html:
        mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in html)
        html = _REFERENCE.sub(lambda m: m.group() if m.group(1) or m.group(2) in html5 else mark + m.group()[1:], html)
    b = _Builder(mark)
    try:
        b.feed(html or "")
        b.close()
    except (AssertionError, ValueError):
        pass
    b.flush()
    return b.root, b.strings


# Selectors.
_SIMPLE = re.compile(r"""(?P<name>[a-zA-Z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|:(?P<pseudo>first-child)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[\^$*~]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<s>[^']*)'|(?P<v>[\w-]+))\s*)?\]""")
_TEST = {"=": lambda a, v: a == v, "^=": lambda a, v: v != "" and a.startswith(v), "$=": lambda a, v: v != "" and a.endswith(v), "*=": lambda a, v: v != "" and v in a, "~=": lambda a, v: v in a.split()}


@lru_cache(1_000)
def compiled(selector: str) -> list[list[tuple[str, list[dict]]]]:
    """Alternatives; each a list of (combinator before, tests of one element), from left to right."""
    out = []
    for part in re.split(r",(?![^\[]*\])", selector):
        steps, at, combinator = [], 0, " "
        part = part.strip()
        while at < len(part):
            gap = re.compile(r"\s*(>)?\s*").match(part, at)
            if steps and gap.end() > at:
                combinator, at = (">" if gap.group(1) else " "), gap.end()
            tests = []
            while m := _SIMPLE.match(part, at):
                tests.append({k: v for k, v in m.groupdict().items() if v is not None})
                at = m.end()
            if not tests:
                raise ValueError(f"selector {selector!r} is not understood at {part[at:]!r}")
            steps.append((combinator, tests))
        if not steps:
            raise ValueError(f"empty selector in {selector!r}")
        out.append(steps)
    return out


def _passes(x: Element, tests: list[dict]) -> bool:
    for t in tests:
        if "name" in t:
            ok = t["name"] == "*" or x.name == t["name"].lower()
        elif "id" in t:
            ok = x.attrs.get("id") == t["id"]
        elif "cls" in t:
            ok = t["cls"] in x.attrs.get("class", "").split()
        elif "pseudo" in t:
            ok = next((c for c in x.parent.children if isinstance(c, Element)), None) is x
        else:
            a = x.attrs.get(t["attr"].lower())
            ok = a is not None and ("op" not in t or _TEST[t["op"]](a, t.get("q", t.get("s", t.get("v", "")))))
        if not ok:
            return False
    return True


def _matches(x: Element, steps: list[tuple[str, list[dict]]]) -> bool:
    if not _passes(x, steps[-1][1]):
        return False
    if len(steps) == 1:
        return True
    up = x.parent
    while up is not None and up.parent is not None:
        if _matches(up, steps[:-1]):
            return True
        if steps[-1][0] == ">":
            return False
        up = up.parent
    return False


def selected(root: Element, selectors: list[str] | None) -> list[Element]:
    """The elements of each selector in turn, in document order."""
    if not selectors:
        return [x for x in root.elements() if x.name in DEFAULT_TAGS][:MOST_ELEMENTS]
    out = []
    for s in selectors:
        any_of = compiled(s)
        out += [x for x in root.elements() if any(_matches(x, steps) for steps in any_of)]
    return out[:MOST_ELEMENTS]


# Items.
def _clean(text: str) -> str:
    return " ".join(text.split())


def title_of(x: Element) -> str:
    heading = next((h for h in x.elements() if h.name in TITLE_TAGS), None)
    text = heading.text() if heading is not None else ""
    return (text or x.text() or "untitled")[:MOST_TITLE]


def _read_date(text: str) -> str | None:
    formats = next((f for shape, f in DATE_FORMATS if shape.fullmatch(text)), None)
    return _read_as(text, formats) if formats else None


@lru_cache(10_000)
def _read_as(text: str, formats: tuple[str, ...]) -> str | None:
    for f in formats:
        try:
            return datetime.strptime(text, f).date().isoformat()
        except ValueError:
            continue
    return None


def date_of(text: str) -> str | None:
    """ISO date if the text is one, else of the first date in it."""
    return _read_date(_clean(text)) or next((d for d in map(_read_date, DATE_TOKEN.findall(_clean(text))) if d), None)


def items(html: str | None, kind: str | None, selectors: list[str] | None, closed: bool = False, most: int | None = MOST_ITEMS) -> list[tuple]:
    """(title, price_text, details, event_date) of a page."""
    kind = (kind or "").strip().lower()
    if kind not in ("pricing", "products", "marketing", "headlines", "events", "announcements"):
        return []
    for s in selectors or ():
        compiled(s)  # an error needs no reading of the page
    root, strings = parsed(html, closed)
    found = []
    for x in selected(root, selectors):
        text = _clean(x.text())
        if kind == "pricing":
            price = PRICE.search(text)
            if price:
                found.append((title_of(x), price.group(0), text, None))
        elif kind == "products":
            if text:
                found.append((title_of(x), None, text, None))
        elif len(text) >= LEAST_HEADLINE:
            found.append((None, None, text, None) if kind in ("marketing", "headlines") else (title_of(x), None, text, date_of(text)))
    if kind == "pricing" and not found:
        texts = (_clean(s) for s in strings if PRICE.search(s))
        found = [("unlabeled", m.group(0), t, None) for t in texts if (m := PRICE.search(t))]
    return list(dict.fromkeys(found))[:most]


class _PageItems:
    def eval(self, html: str, kind: str, selectors: list, closed: bool = False, most: int = MOST_ITEMS):
        for place, row in enumerate(items(html, kind, selectors, closed, most), 1):
            yield (place, *row)


_ROW = "place int, title string, price_text string, details string, event_date string"


def page_items_function():
    """The table function (html, kind, selectors, closed = false, most = 500)."""
    return F.udtf(_PageItems, returnType=_ROW, useArrow=False)  # an Arrow function makes a frame a page


def register_functions(spark: SparkSession) -> None:
    """Makes page_items available in SQL."""
    spark.udtf.register("page_items", page_items_function())


def page_items(pages: DataFrame, kind: Column, selectors: Column | None = None, closed: bool = False, most: int | None = MOST_ITEMS) -> DataFrame:
    """page_id, url, place, title, price_text, details, event_date (date) of the items of pages (page_id, url, html)."""
    none = F.array().cast("array<string>")
    read = pages.select("page_id", "url", "html", kind.cast("string").alias("__kind"), (none if selectors is None else F.coalesce(selectors, none)).alias("__selectors"))
    found = page_items_function()(F.col("html").outer(), F.col("__kind").outer(), F.col("__selectors").outer(), F.lit(closed), F.lit(most).cast("int"))
    return read.lateralJoin(found).select("page_id", "url", "place", "title", "price_text", "details", F.to_date("event_date").alias("event_date"))


def scrape(pages: DataFrame, config: DataFrame) -> DataFrame:
    """Items of all pages by the configuration (site, kind, selectors) of their site, a host name.

    Pages whose selectors are not understood give a row with an error and no item; the others are not touched by it.
    A configuration of up to MOST_CONFIG rows goes to the pages, so that a site's pages do not gather in one task.
    """
    site = F.regexp_extract("url", r"^[a-z]+://(?:www\.)?([^/:]+)", 1)
    config = config.select("site", "kind", "selectors")
    few = config.limit(MOST_CONFIG + 1).count() <= MOST_CONFIG
    due = pages.withColumn("site", site).join(F.broadcast(config) if few else config, "site")
    found = guarded_items_function()(F.col("html").outer(), F.col("kind").outer(), F.col("selectors").outer())
    return due.lateralJoin(found).select("page_id", "site", "kind", "place", "title", "price_text", "details", F.to_date("event_date").alias("event_date"), "error")


class _GuardedItems:
    def eval(self, html: str, kind: str, selectors: list):
        try:
            rows = items(html, kind, selectors)
        except ValueError as e:
            yield (None, None, None, None, None, str(e))
            return
        for place, row in enumerate(rows, 1):
            yield (place, *row, None)


def guarded_items_function():
    return F.udtf(_GuardedItems, returnType=_ROW + ", error string", useArrow=False)
