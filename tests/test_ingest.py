"""Ingestion, page reading and streams on small inputs."""

from __future__ import annotations

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallygrove.sources import ingest as I
from tallygrove.sources import mapping as M
from tallygrove.sources import web
from tallygrove.streaming import events as E


def test_mapping_priorities():
    assert M.resolve_mapping(["Company", "KPI", "Amount", "Category", "Date", "Source"]) == {
        "source_type": "Source", "entity_name": "Company", "category": "Category", "metric_name": "KPI", "metric_value": "Amount", "timestamp": "Date"}
    over = M.resolve_mapping(["zzz", "entity"], {"metric_name": "entity"})
    assert over["metric_name"] == "entity" and over.get("entity_name") is None
    fuzzy = M.resolve_mapping(["entity names", "metric nam", "metric valu", "categori"])
    assert fuzzy["entity_name"] == "entity names" and fuzzy["category"] == "categori"


def test_strict_mapping_errors():
    got = M.strict_mapping(["entity_name", "category", "metric", "metric_value"])
    assert got["entity_name"] == ("entity_name", 1.0) and got["metric_name"] == ("metric", 0.99)
    with pytest.raises(I.IngestError, match="missing_required"):
        M.strict_mapping(["a", "b"])
    with pytest.raises(I.IngestError):
        M.check_mapping({"entity_name": "x", "nonsense": "y"}, ["z"])


def test_upload_checks():
    I.validate_upload("a.csv", 10)
    for bad in (("", 1), ("a.exe", 1), ("a.csv", 0), ("a.csv", 1 << 40)):
        with pytest.raises(I.IngestError):
            I.validate_upload(*bad)


@pytest.fixture
def upload(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text(
        "﻿Company,Category,Metric,Value,Date,Source\n"
        "Acme,SaaS,MRR,100,2024-01-01,internal_system\n"
        "Acme,SaaS,MRR,abc,2024-02-01,api\n"
        ",SaaS,MRR,1,2024-02-01,api\n"
        "Acme,SaaS,MRR,1,,api\n"
        "Acme,Retail,MRR,1e5,,api\n"
        'Acme,Retail,MRR,"{""value"": 7}",01/31/2024,api\n'
        "Acme,Retail,MRR,nan,never,api\n",
        encoding="utf-8",
    )
    df = I.scan_csv(spark, str(p))
    return I.apply_mapping(df, M.resolve_mapping(df.columns))


def test_csv_to_canonical(upload):
    good, bad = I.validate(upload)
    rows = good.orderBy("_row").collect()
    assert [r["value"] for r in rows] == [100.0, None, 100000.0, 7.0]
    assert rows[0]["source_type"] == "csv" and rows[0]["category"] == "saas" and rows[0]["role"] == "organization"
    assert rows[3]["ts"].date() == datetime.date(2024, 1, 31)
    assert [r["error_code"] for r in bad.orderBy("_row").collect()] == ["required_missing", "timestamp_required", "timestamp_invalid"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("March 5, 2024", "2024-03-05T00:00:00"), ("5 March 2024 10:30", "2024-03-05T10:30:00"), ("2024-03-05T10:30:00.25+02:00", "2024-03-05T08:30:00.250000"), ("20240305", "2024-03-05T00:00:00"),
        ("Tue, 05 Mar 2024 10:00:00 -0500", "2024-03-05T15:00:00"), ("03-05-2024", "2024-03-05T00:00:00"), ("25/12/2024", "2024-12-25T00:00:00"), ("2024-03-05 4pm", "2024-03-05T16:00:00"),
        ("Sept 2024", "2024-09-01T00:00:00"), ("05.03.2024", "2024-03-05T00:00:00"), ("2024-3-5 10:30", "2024-03-05T10:30:00"), ("1/2/2024", "2024-01-02T00:00:00"),
        ("2024-02-30", None), ("never", None), ("March 5", None), ("10:30", None), ("99999999999999999999", None), ("", None), (None, None),
    ],
)
def test_lenient_dates(spark, text, want):
    row = dict.fromkeys(M.FIELDS, "x") | {"metadata_json": None, "timestamp": text}
    got = I.checked(spark.createDataFrame([row], ", ".join(f"{f} string" for f in M.FIELDS))).first()
    assert (got["_ts"].isoformat() if got["_ts"] else None) == want
    assert got["error_code"] == ("timestamp_invalid" if want is None and text else None)


def test_payloads(spark):
    cells = {"1": "1", " 1.50 ": "1.5", "1e5": "100000", "TRUE": "true", "[1, {\"a\": null}]": '[1,{"a":null}]', "abc": '"abc"', "nan": '"nan"', "{bad": None}
    df = spark.createDataFrame([(k,) for k in cells], "c string").select("c", F.to_json(I.payload(F.col("c"))).alias("p"))
    got = {r["c"]: r["p"] for r in df.collect()}
    assert {k: None if v is None else v for k, v in got.items()} == cells | {"1e5": got["1e5"]} and float(got["1e5"]) == 1e5


def test_rows_are_parsed_once(spark):
    df = spark.createDataFrame([dict.fromkeys(M.FIELDS, "x")], ", ".join(f"{f} string" for f in M.FIELDS)).withColumn("_row", F.lit(1))
    plan = I.validate(df)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("try_to_timestamp") == len(I.FORMATS) and plan.count("parse_json") + plan.count("parseJson") <= 4


def test_interpret(spark):
    rows = [(f"Co {i % 3}", "saas", "mrr", str(i), "2024-01-01") for i in range(12)]
    df = spark.createDataFrame(rows, "entity_name string, category string, metric_name string, metric_value string, timestamp string")
    got = {x.field: x.header for x in M.interpret(df)}
    assert {f: got[f] for f in M.REQUIRED} == {f: f for f in M.REQUIRED}
    with pytest.raises(I.IngestError):
        M.interpret(spark.createDataFrame([("x",)], "zzz string"))


@pytest.mark.parametrize(
    ("header", "want"),
    [("revenue_2024_Q2", ("revenue", 2024, 4, "quarterly")), ("Q4 2023 cost", ("cost", 2023, 10, "quarterly")), ("sales Jan 2022", ("sales", 2022, 1, "monthly")),
     ("2021-March-units", ("units", 2021, 3, "monthly")), ("revenue_2020", ("revenue", 2020, 1, "yearly")), ("2020", None), ("revenue", None), ("q1", None)],
)
def test_wide_headers(header, want):
    got = I.parse_header(header)
    assert (got and (got.metric, got.year, got.month, got.kind)) == want


def test_unpivot(spark):
    df = spark.createDataFrame([("a", "1", "", None), ("b", "nan", "2", "3")], "entity string, revenue_2024_Q1 string, revenue_2024_Q2 string, cost_2024_Q1 string")
    got = sorted((r["entity"], r["metric_name"], r["metric_value"], r["timestamp"].month) for r in I.unpivot(df).collect())
    assert got == [("a", "revenue", "1", 1), ("b", "cost", "3", 1), ("b", "revenue", "2", 4)]
    narrow = spark.createDataFrame([("a", "1")], "entity string, value string")
    assert I.unpivot(narrow).columns == ["entity", "value"]
    assert I.periodicity(I.wide_columns(df.columns)) == "quarterly"


def test_keep_first_and_upsert(spark):
    rows = spark.createDataFrame([("k", 1, 10), ("k", 0, 20), ("j", 5, 30)], "key string, _row long, v int")
    assert {(r["key"], r["v"]) for r in I.keep_first(rows, ("key",)).collect()} == {("k", 20), ("j", 30)}
    old = spark.createDataFrame([("k", 1), ("x", 2)], "key string, v int")
    new = spark.createDataFrame([("k", 7, 1), ("k", 8, 2)], "key string, v int, _row long")
    assert {(r["key"], r["v"]) for r in I.upsert(old, new, ("key",)).collect()} == {("k", 8), ("x", 2)}
    fresh = I.insert_new(old, new, ("key",))
    assert fresh.count() == 0


def test_numeric_series(spark):
    df = spark.createDataFrame([(["1", "x", "nan", "inf", "2.5"],)], "v array<string>")
    assert df.select(I.numeric_series(F.col("v"))).first()[0] == [1.0, 2.5]


def test_value_kinds(spark):
    df = spark.createDataFrame([(x,) for x in ("true", "1", "1e5", "1.5", "nan", "[1]", "{bad", "text")], "v string")
    assert [r[0] for r in df.select(I.value_kind(F.col("v"))).collect()] == ["bool", "int", "int", "float", "float", "json", "string", "string"]


def test_html_reading():
    text, heads = web.read_html("<html><nav>menu</nav><h1>A long headline</h1><div class='ad-box'>buy</div><p>Body &amp; more<br>text</p><script>x()</script><h2>short</h2></html>")
    assert text == "A long headline Body & more text short" and heads == ["A long headline"]
    assert web.read_html(None) == ("", [])


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="<>/abp \"'=&;!-", max_size=80))
def test_html_reading_never_fails(html):
    text, heads = web.read_html(html)
    assert isinstance(text, str) and isinstance(heads, list)


def test_text_signals(spark):
    df = spark.createDataFrame([(1, "Churn of 4% and $1,000 or $500.50, growth 3% then 9%"), (2, None), (3, "")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in web.document_signals(df).collect()}
    assert got[1]["mean_price"] == pytest.approx(750.25) and got[1]["churn_pct"] == 4.0 and got[1]["growth_pct"] == 9.0
    assert got[3]["mean_price"] is None


def test_search_and_articles(spark):
    raw = '{"web": {"results": [{"title": "a", "url": "u1"}, {"title": "b", "url": "u1"}, {"title": "c", "url": "u2"}]}}'
    got = web.search_results(spark.createDataFrame([("q", raw)], "query string, raw string"), 2).orderBy("place").collect()
    assert [(r["place"], r["url"]) for r in got] == [(1, "u1"), (2, "u2")]
    art = web.articles(spark.createDataFrame([('{"title": "T", "publishedAt": "2024-03-01"}',), ('{"title": ""}',)], "raw string")).collect()
    assert len(art) == 1 and art[0]["ts"].date() == datetime.date(2024, 3, 1)


def test_sessions_and_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, 1, t + datetime.timedelta(minutes=m), 1.0, "x") for i, m in enumerate((0, 10, 50, 55))] + [(9, 1, t, 1.0, "x")]
    df = spark.createDataFrame(rows, "event_id int, user_id int, ts timestamp, value double, event_type string")
    assert sorted(r["n"] for r in E.sessions(df).collect()) == [2, 3]
    src = str(tmp_path / "in")
    df.union(df).write.parquet(src)
    spark.sql("drop table if exists stream_facts")
    stream = E.deduplicated(E.read_stream(spark, src, df.schema))
    for _ in range(2):  # a second run finds nothing new
        E.append_facts(stream, "stream_facts", str(tmp_path / "cp"), ("event_id",)).awaitTermination()
    assert spark.table("stream_facts").count() == 5
    spark.sql("drop table stream_facts")


@pytest.mark.parametrize("name", ["page_text", "page_headlines", "page_prices", "scraped_canonical_rows"])
def test_pages_go_to_python_in_small_batches(spark, sf_dir, capsys, name):
    from tallygrove.plans.all_queries import QUERIES

    QUERIES[name](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
