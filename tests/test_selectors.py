"""Items of written pages by CSS selectors."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tallygrove.sources import selectors as P

PAGE = """<!DOCTYPE html><html><head><style>p{margin:1px}</style><script>var x = "<li>no</li> 7";</script></head><body>
<!-- build 12 --><ul class="plans big" id="top"><li data-tier="pro plus"><h3>Pro</h3> <b>$1,200.50</b>/year<br>all in</li><li class="free"><strong>Free</strong> no cost</li><li>US$ 9 / user</li></ul>
<div class="plans"><p>Call&nbsp;us</p><article><h2></h2>An article of some length<section>Short</section></article></div>
<div class="news">On March 5, 2024 and 2020-01-01 we met</div><div class="news"><h4>Fair</h4>12/31/2023</div><div class="news">soon, not on 99/99/2024</div></body></html>"""


def texts(*selectors):
    return [x.text() for x in P.selected(P.parsed(PAGE)[0], list(selectors))]


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("ul.plans > li.free", ["Free no cost"]), (".plans.big li[data-tier]", ["Pro $1,200.50 /year all in"]), ("#top > li:first-child", ["Pro $1,200.50 /year all in"]),
        ("[data-tier~=plus] b", ["$1,200.50"]), ("[data-tier^='pro']", ["Pro $1,200.50 /year all in"]), ("[data-tier$=\"x\"]", []), ("[data-tier*=o]>h3", ["Pro"]),
        ("body section, h4", ["Short", "Fair"]), ("div p", ["Call\xa0us"]), ("ul > b", []), ("UL B", ["$1,200.50"]), ("script li", []), ("*.news h4", ["Fair"]),
    ],
)
def test_selectors(selector, want):
    assert texts(selector) == want


def test_order_and_defaults():
    assert texts("h4", "h3") == ["Fair", "Pro"]
    assert [x.name for x in P.selected(P.parsed(PAGE)[0], [])] == ["li", "h3", "li", "li", "article", "h2", "section"]
    assert len(P.selected(P.parsed("<li>a" * 400)[0], None)) == 300


@pytest.mark.parametrize("bad", ["div::before", "", "a,", "li:hover", "a + b", "[x"])
def test_unknown_selectors_are_errors(bad):
    with pytest.raises(ValueError):
        P.compiled(bad)


def test_prices():
    got = P.items(PAGE, " Pricing ", ["ul.plans li"])
    assert got == [("Pro", "$1,20", "Pro $1,200.50 /year all in", None), ("US$ 9 / user", "US$ 9 / user", "US$ 9 / user", None)]
    strings = [x[2] for x in P.items(PAGE, "pricing", ["div.none"])]
    assert strings[:3] == ["p{margin:1px}", 'var x = "<li>no</li> 7";', "build 12"] and {x[0] for x in P.items(PAGE, "pricing", ["div.none"])} == {"unlabeled"}


def test_products_headlines_events():
    assert P.items(PAGE, "products", ["article", "article", "h2"]) == [("An article of some length Short", None, "An article of some length Short", None)]
    assert [x[2] for x in P.items(PAGE, "headlines", ["section", "article"])] == ["An article of some length Short"]
    assert [(x[0], x[3]) for x in P.items(PAGE, "events", [".news"])] == [("On March 5, 2024 and 2020-01-01 we met", "2024-03-05"), ("Fair", "2023-12-31"), ("soon, not on 99/99/2024", None)]
    assert P.items(PAGE, "other", None) == [] == P.items(None, "products", None) and P.items(PAGE, None, None) == []
    assert len(P.title_of(P.parsed("<p>" + "x" * 500)[0])) == 180 and P.title_of(P.parsed("<p></p>")[0]) == "untitled"


@pytest.mark.parametrize(("text", "want"), [("5 March 2024", "2024-03-05"), ("Mar 5, 2024", "2024-03-05"), (" 2024-02-30 then 2024-02-28", "2024-02-28"), ("31/12/2023", "2023-12-31"), ("in 2024", None)])
def test_dates(text, want):
    assert P.date_of(text) == want


def test_in_frames_and_sql(spark):
    pages = spark.createDataFrame([(1, "http://a.test/x", PAGE), (2, "http://b.test/", None), (3, "http://a.test/y", "<div class=news>Meet on 2024-05-06 <b>there")], "page_id long, url string, html string")
    got = P.page_items(pages, F.lit("events"), F.array(F.lit(".news"))).orderBy("page_id", "place").collect()
    assert [(r["page_id"], r["place"], r["event_date"]) for r in got] == [(1, 1, datetime.date(2024, 3, 5)), (1, 2, datetime.date(2023, 12, 31)), (1, 3, None), (3, 1, datetime.date(2024, 5, 6))]
    assert got[3]["title"] == "there"
    P.register_functions(spark)
    pages.createOrReplaceTempView("pages_written")
    rows = spark.sql("SELECT page_id, i.title FROM pages_written, LATERAL page_items(html, 'products', array('ul.plans > li')) i").collect()
    assert [r["title"] for r in rows] == ["Pro", "Free", "US$ 9 / user"]
    with pytest.raises(Exception, match="not understood"):
        P.page_items(pages, F.lit("events"), F.array(F.lit("a::b"))).collect()


def test_a_faulty_site_leaves_the_others_alone(spark):
    pages = spark.createDataFrame([(1, "http://a.test/x", PAGE), (2, "http://www.b.test/", PAGE), (3, "http://c.test/", PAGE)], "page_id long, url string, html string")
    config = spark.createDataFrame([("a.test", "products", ["h3"]), ("b.test", "products", ["h3:hover"]), ("b.test", "headlines", ["article"])], "site string, kind string, selectors array<string>")
    got = {(r["site"], r["kind"], r["title"], r["details"], r["error"] is None) for r in P.scrape(pages, config).collect()}
    assert got == {("a.test", "products", "Pro", "Pro", True), ("b.test", "products", None, None, False), ("b.test", "headlines", None, "An article of some length Short", True)}


CUT = """<html><head><title>x</title><script>if (a && b1 &amp c) {}</script></head><body><!-- 4 & 5 &lt --><article><h1 class="a&amp;b&lt">Head of 7 &amp;&quot;&#36;&ampx; &no; &#x; R&D &amp</h1></article></body></html>"""


def test_references_without_semicolon():
    assert P.items(CUT, "headlines", ["h1"])[0][2] == 'Head of 7 &"$&x; &no; &#x; R&D &'
    assert P.items(CUT, "headlines", ["h1"], closed=True)[0][2] == 'Head of 7 &"$&ampx; &no; &#x; R&D &amp'
    assert P.parsed(CUT, closed=True)[1] == ["x", "if (a && b1 &amp c) {}", " 4 & 5 &lt ", 'Head of 7 &"$&ampx; &no; &#x; R&D &amp']
    assert P.selected(P.parsed(CUT, closed=True)[0], ["h1"])[0].attrs == {"class": "a&b&lt"}


def test_queries_of_cut_titles_match_their_sql(spark, tmp_path):
    import duckdb

    from tallygrove.plans.all_queries import QUERIES, SQL

    cut = "<html><head><title>{0}</title><script>var t=1;</script></head><body><!-- ad 0 --><article><h1>{0}</h1></article></body></html>"
    rows = [(1, "http://a.test/", cut.format("the&amp;&amp;&amp; and 57&amp;&amp;&amp")), (2, "http://b.test/", cut.format("token = &quot;8078de7b&quot")), (3, "http://c.test/", cut.format("Thing of 12 &am"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("page_headline_items", "page_price_strings"):
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.execute(SQL[name]).fetchall()), name


def test_price_strings_of_a_long_page_fetched_twice_match_the_sql(spark, tmp_path):
    import duckdb

    from tallygrove.plans.all_queries import QUERIES, SQL

    lines = "".join(f"<p>Item {i} at ${i}.50 / month</p>" for i in range(700))
    long = f"<html><head><title>x</title><script>var t=1;</script></head><body><!-- ad 0 --><article><h1>x</h1>{lines}</article></body></html>"
    spark.createDataFrame([(1, "http://a.test/", long), (1, "http://a.test/", long.replace("Item 9 ", "Item X9 ")), (2, "http://a.test/", None)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(map(tuple, QUERIES["page_price_strings"](spark, str(tmp_path)).collect()))
    assert len(got) == 703 and got == sorted(con.execute(SQL["page_price_strings"]).fetchall())
    assert len(P.items(long, "pricing", ["div.none"])) == 500 and len(P.items(long, "pricing", ["div.none"], most=None)) == 702


def test_pages_of_a_site_do_not_gather_in_one_task(spark, capsys):
    pages = spark.range(10).select(F.col("id").alias("page_id"), F.lit("http://a.test/x").alias("url"), F.lit(PAGE).alias("html"))
    config = spark.createDataFrame([("a.test", "products", ["h3"])], "site string, kind string, selectors array<string>").repartition(2)
    with_few = P.scrape(pages, config)
    assert with_few.count() == 10
    with_few.explain()
    assert "hashpartitioning(site" not in capsys.readouterr().out


def test_selectors_are_checked_before_the_page_is_read(monkeypatch):
    monkeypatch.setattr(P, "parsed", lambda *a: pytest.fail("the page was read"))
    with pytest.raises(ValueError):
        P.items(PAGE, "events", ["div", "div::before"])


@pytest.mark.parametrize(("text", "want"), [("5  March  2024", "2024-03-05"), ("March 05,2024", None), ("5 March, 2024", None), ("13/1/2024", "2024-01-13"), ("2024-3-5", "2024-03-05"), ("sept 5, 2024", None), ("x 5, 2024", None), ("٢٠٢٤-01-02", "2024-01-02")])
def test_dates_by_shape(text, want):
    assert P.date_of(text) == want
