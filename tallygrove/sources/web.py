"""Fetched pages and documents: text, headlines, prices, signals, canonical rows.

Pages are a table (page_id, url, html) that something else has fetched. Regular
expressions in the JVM do what they can; nested markup goes through the
standard library's HTML parser, a hundred pages at a time.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.functions.columns import domain
from tallygrove.sources.ingest import parse_timestamp

#: Elements whose text is no content.
SKIPPED = frozenset(("script", "style", "nav", "footer", "header", "aside", "noscript", "form", "svg", "template"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_AD = re.compile(r"(^|[-_ ])(ad|ads|advert|banner|cookie|sidebar|promo|popup)([-_ ]|$)", re.I)


class _Reader(HTMLParser):
    """Collects content text, and headings and links apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden: list[str] = []
        self.open: list[str] = []
        self.text: list[str] = []
        self.headings: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            if not self.hidden:
                self.text.append(" ")
            return
        if self.hidden or tag in SKIPPED or any(k in ("class", "id") and _AD.search(v or "") for k, v in attrs):
            self.hidden.append(tag)
            return
        self.open.append(tag)
        if tag in ("h1", "h2", "h3"):
            self.headings.append([])
        self.text.append(" ")

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        self.text.append(" ")

    def handle_data(self, data):
        if self.hidden:
            return
        self.text.append(data)
        if self.headings and any(t in ("h1", "h2", "h3") for t in self.open):
            self.headings[-1].append(data)


def read_html(html: str | None) -> tuple[str, list[str]]:
    """(content text with single spaces, headings of eight characters or more)."""
    reader = _Reader()
    try:
        reader.feed(html or "")
        reader.close()
    except (AssertionError, ValueError):
        pass
    squeeze = lambda parts: " ".join("".join(parts).split())
    return squeeze(reader.text), [h for h in map(squeeze, reader.headings) if len(h) >= 8]


_READ = T.StructType().add("text", T.StringType()).add("headlines", T.ArrayType(T.StringType()))


# Not an Arrow function: a batch of those has up to 10,000 pages or 64 MB, which Python would hold several times over; this one gets 100 pages at a time.
_read = F.udf(read_html, _READ, useArrow=False)


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, headlines."""
    return pages.select("page_id", "url", _read("html").alias("__r")).select("page_id", "url", "__r.text", "__r.headlines")


def page_titles(pages: DataFrame) -> DataFrame:
    """page_id, url, domain, title: by regular expressions only."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return pages.select("page_id", "url", domain(F.col("url")).alias("domain"), title.alias("title"))


def prices(text: Column) -> Column:
    """Dollar amounts in a text, as doubles."""
    found = F.regexp_extract_all(text, F.lit(r"\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())


def percents(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)\s?%"), F.lit(1)), lambda x: x.try_cast("double"))


def document_signals(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean price, first percentage if churn is spoken of, largest if growth is."""
    p, q = F.col("__p"), F.col("__q")
    x = docs.select(key, prices(F.col("text")).alias("__p"), percents(F.col("text")).alias("__q"), F.lower("text").alias("__t"))
    mean = F.when(F.size(p) > 0, F.aggregate(p, F.lit(0.0), lambda a, v: a + v) / F.size(p))
    return x.select(
        key, F.size(p).alias("prices"), mean.alias("mean_price"), F.when(F.col("__t").contains("churn"), F.try_element_at(q, F.lit(1))).alias("churn_pct"),
        F.when(F.col("__t").contains("growth"), F.array_max(q)).alias("growth_pct"),
    )


def html_prices(pages: DataFrame) -> DataFrame:
    """page_id, price: any one- to five-digit amount in a page's visible text, with or without a sign."""
    read = page_text(pages)
    found = F.regexp_extract_all("text", F.lit(r"(?<![0-9.])[$€£]?\s?([0-9]{1,5}(?:\.[0-9]{1,2})?)(?![0-9])"), F.lit(1))
    return read.select("page_id", F.explode(found).alias("price")).select("page_id", F.col("price").cast("double").alias("price"))


def date_in_text(text: Column) -> Column:
    """A timestamp if the whole text is one, else the first date-like token."""
    token = F.regexp_extract(text, r"(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{4}/\d{1,2}/\d{1,2})", 1)
    return F.coalesce(parse_timestamp(text), parse_timestamp(token))


def articles(rows: DataFrame) -> DataFrame:
    """JSON articles (raw) to canonical event rows; rows without a title are left out."""
    a = rows.select(F.from_json("raw", "title string, url string, publishedAt string, source struct<name:string>").alias("a")).where("length(trim(a.title)) > 0")
    return a.select(
        F.lit("api").alias("source_type"), F.coalesce("a.source.name", F.lit("unknown")).alias("entity"), F.lit("news").alias("category"), F.lit("news_event").alias("metric"),
        F.to_json(F.struct(F.col("a.title").alias("title"), F.col("a.url").alias("url"))).alias("raw_value"), date_in_text(F.col("a.publishedAt")).alias("ts"),
    )


def search_results(rows: DataFrame, most: int = 10) -> DataFrame:
    """Search payloads (query, raw) to their first `most` results with distinct URLs, in order."""
    items = rows.select("query", F.posexplode(F.from_json(F.get_json_object("raw", "$.web.results"), "array<struct<title:string,url:string,description:string>>")).alias("pos", "r"))
    once = Window.partitionBy("query", "r.url").orderBy("pos")
    x = items.where("r.url is not null").withColumn("__o", F.row_number().over(once)).where("__o = 1")
    w = Window.partitionBy("query").orderBy("pos")
    return x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query", "place", "r.title", "r.url", "r.description")


def scraped_rows(pages: DataFrame, scraped_at: Column) -> DataFrame:
    """Canonical rows of a scrape: a headline row each and a price row each, all with one timestamp."""
    read = page_text(pages).withColumn("entity", domain(F.col("url")))
    heads = read.select("entity", F.lit("headline").alias("metric"), F.explode("headlines").alias("raw_value"))
    cost = html_prices(pages).join(pages.select("page_id", "url"), "page_id").select(domain(F.col("url")).alias("entity"), F.lit("pricing").alias("metric"), F.col("price").cast("string").alias("raw_value"))
    return heads.union(cost).select(F.lit("scrape").alias("source_type"), "entity", F.lit("competitor").alias("category"), "metric", "raw_value", scraped_at.alias("ts"))
