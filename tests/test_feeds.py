"""Trend feeds from written RSS files."""

from __future__ import annotations

from email.utils import parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from tallygrove.sources import feeds

HEAD = '<?xml version="1.0" encoding="UTF-8"?><rss xmlns:ht="https://trends.test/" version="2.0"><channel><title>Daily</title>'


def item(title, date, traffic=None, link="http://t/"):
    extra = f"<ht:approx_traffic>{traffic}</ht:approx_traffic><ht:news_item><ht:news_item_title>other</ht:news_item_title></ht:news_item>" if traffic is not None else ""
    return f"<item><title>{title}</title>{extra}<link>{link}</link><pubDate>{date}</pubDate></item>"


@pytest.fixture
def landed(tmp_path):
    good = "Wed, 02 Oct 2024 08:00:00 -0700"
    (tmp_path / "a.xml").write_text(HEAD + item("Ünïon &amp; co", good, "200K+") + item("", good) + item("no date", "") + item("odd date", "yesterday") + item("m", good, "1.5M+", "") + item("text", good, "lots") + "</channel></rss>", encoding="utf-8")
    (tmp_path / "b.xml").write_text(HEAD + "".join(item(f"w{k}", good, k) for k in range(30)) + "</channel></rss>")
    (tmp_path / "c.xml").write_text(HEAD + item("fine", good) + "<item><title>x</titel></item></channel></rss>")
    (tmp_path / "d.xml").write_text(HEAD + "</channel></rss>")
    return str(tmp_path)


def test_rows_and_faults(spark, landed):
    items = feeds.feed_items(spark, landed).withColumn("feed", F.regexp_extract("feed", r"(\w)\.xml", 1))
    rows, faults = feeds.trend_rows(items, most=20, region="US")
    got = {(r["feed"], r["seq"]): r for r in rows.collect()}
    assert [(k, got["a", k]["entity"], got["a", k]["value"], got["a", k]["raw_value"]) for k in (0, 4, 5)] == [(0, "Ünïon & co", 200_000, "200K+"), (4, "m", 1_500_000, "1.5M+"), (5, "text", None, "lots")]
    assert got["a", 0]["ts"].isoformat() == "2024-10-02T15:00:00" and got["a", 0]["region"] == "US" and got["a", 4]["link"] is None
    assert sorted(k for f, k in got if f == "b") == list(range(20)) and not any(f in "cd" for f, _ in got)
    assert sorted(map(tuple, faults.collect()), key=str) == [("a", 1, "title_missing"), ("a", 2, "date_missing"), ("a", 3, "date_invalid"), ("c", None, "feed_invalid")]


@pytest.mark.parametrize("text", ["Wed, 02 Oct 2024 08:00:00 -0700", "2 Oct 2024 08:00:09 GMT", "Wed, 2 Oct 2024 8:00 EST", "02 Oct 99 23:59:59 PDT", "2 OCT 2024 08:00:00 +0530 (IST)", "2 Oct 2024 08:00:00"])
def test_mail_dates(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(feeds.mail_date(F.col("t"))).first()[0]
    want = parsedate_to_datetime(text)
    want = want.replace(tzinfo=None) - (want.utcoffset() or want - want)
    assert got == want


@pytest.mark.parametrize("text", [None, "", "yesterday", "2024-10-02", "Wed, 42 Oct 2024 08:00:00 GMT", "2 Okt 2024 08:00:00 GMT"])
def test_what_is_no_mail_date(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(feeds.mail_date(F.col("t"))).first()[0] is None


def test_items_of_split_and_packed_feeds_keep_their_places(spark, tmp_path, capsys):
    good = "Wed, 02 Oct 2024 08:00:00 -0700"
    for name, n in (("a", 700), ("b", 3), ("c", 900), ("d", 1)):
        (tmp_path / f"{name}.xml").write_text(HEAD + "\n" + "\n".join(item(f"{name}{k}", good) for k in range(n)) + "\n</channel></rss>")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, 20_000)
    try:
        items = feeds.feed_items(spark, str(tmp_path))
        got = items.select("title", "seq").collect()
        items.explain()
        first = feeds.trend_rows(items)[0].groupBy().count().first()[0]
    finally:
        spark.conf.set(key, before)
    assert sorted(map(tuple, got)) == sorted((f"{name}{k}", k) for name, n in (("a", 700), ("b", 3), ("c", 900), ("d", 1)) for k in range(n))
    assert first == 20 + 3 + 20 + 1
    plan = capsys.readouterr().out
    assert not any("Sort [feed" in line and "__block" not in line for line in plan.splitlines())  # only the row a block is sorted
