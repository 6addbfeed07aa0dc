"""The data source of macro observations on written answers."""

from __future__ import annotations

import datetime
import json

import pytest

from tallygrove.sources import macro_source as S

DATED = {"count": 4, "observations": [{"date": "2024-02-01", "value": "2.5"}, {"date": "2024-01-01", "value": "1.5"}, {"date": "2024-03-01", "value": "."}, {"date": "2024-04-01", "value": ""}, {"date": None, "value": "1"}, "x"]}
YEARLY = [{"page": 1}, [{"date": "2021", "value": 3.5}, {"date": "2022", "value": None}, {"date": "2020", "value": 0}, {"date": "n/a", "value": 1}, {"date": "2023M01", "value": 7}]]


@pytest.fixture
def landed(spark, tmp_path):
    for country, metric, text in (
        ("us", "gdp", json.dumps(DATED)), ("us", "cpi", "\n".join(json.dumps(x) for x in DATED["observations"][:2])), ("de", "gdp", json.dumps(YEARLY)), ("fr", "gdp rate%2F1", ""),
    ):
        folder = tmp_path / f"country={country}" / f"metric={metric}"
        folder.mkdir(parents=True)
        (folder / "a.json").write_text(text)
    S.register(spark)
    return str(tmp_path)


def read(spark, path, provider, **options):
    return spark.read.format("macro").option("provider", provider).options(**options).load(path)


def test_dated(spark, landed):
    day = datetime.date
    got = sorted(map(tuple, read(spark, landed, " Dated ").where("country = 'us'").collect()))
    assert got == [("us", m, day(2024, k, 1), day(2024, k, 1), v) for m in ("cpi", "gdp") for k, v in ((1, "1.5"), (2, "2.5"))]
    assert [r["value"] for r in read(spark, landed, "dated", period_start="2024-01-15").where("country = 'us' and metric = 'gdp'").collect()] == ["2.5"]
    assert read(spark, landed, "dated", limit=1).where("country = 'us'").count() == 2


def test_yearly(spark, landed):
    df = read(spark, landed, "yearly").where("country = 'de'")
    assert [(r["period_start"].year, r["period_end"].isoformat(), r["value"]) for r in df.collect()] == [(2020, "2020-12-31", "0"), (2021, "2021-12-31", "3.5"), (2023, "2023-12-31", "7")]
    assert [r["value"] for r in read(spark, landed, "yearly", limit=2).where("country = 'de'").collect()] == ["3.5", "7"]


def test_filters_choose_folders(spark, landed):
    df = read(spark, landed, "dated")
    assert df.rdd.getNumPartitions() == 4
    assert df.where("country = 'us'").rdd.getNumPartitions() == 2
    assert df.where("metric in ('cpi', 'none') and country = 'us'").rdd.getNumPartitions() == 1
    assert df.where("metric = 'gdp rate/1'").rdd.getNumPartitions() == 1 and df.where("metric = 'gdp rate/1'").count() == 0
    assert df.where("country = 'xx'").count() == 0
    assert df.where("country = 'us' and value > '2'").count() == 2  # what is not pushed is still applied


def test_faults(spark, landed, tmp_path):
    for provider, message in (("imf", "not supported"), ("nobody", "unknown macro provider")):
        with pytest.raises(Exception, match=message):
            read(spark, landed, provider).collect()
    (tmp_path / "country=us" / "metric=gdp" / "b.json").write_text("<html>")
    with pytest.raises(Exception, match="unexpected content of .*b.json"):
        read(spark, landed, "dated").where("country = 'us'").collect()
