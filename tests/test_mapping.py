"""Header mapping: order of decision, categories, many files at once, folders of files."""

from __future__ import annotations

import random

import pytest

from tallygrove.sources import ingest as I
from tallygrove.sources import mapping as M


def test_names_come_before_headers():
    """The first name that is as alike as any wins, whatever the order of the headers."""
    headers = ["value metric", "name entity", "category", "metric name x"]
    for some in (headers, headers[::-1]):
        got = M.resolve_mapping(some)
        assert got["metric_name"] == "metric name x" and got["metric_value"] == "value metric" and got["entity_name"] == "name entity"


def test_field_by_field():
    """A field's likeness comes before an equal name of a later field."""
    assert M.resolve_mapping(["Date"]) == {"source_type": "Date"}  # "data source" begins like it
    assert M.resolve_mapping(["Date", "Origin"])["timestamp"] == "Date"
    assert M.resolve_mapping(["sourc", "origin"])["source_type"] == "origin"
    assert M.resolve_mapping(["categories", "domain"])["category"] == "domain"
    assert M.resolve_mapping(["entity names", "Tenant"])["entity_name"] == "Tenant"
    assert M.resolve_mapping(["Total", "TOTAL "])["metric_value"] == "TOTAL "  # of equal names the last counts


@pytest.mark.parametrize(("category", "value"), [("saas", "mrr"), (" SaaS ", "mrr"), ("ecommerce", "gmv"), ("finance", "aum"), ("healthcare", "claim_amount"), ("logistics", "freight_cost"), ("retail", "footfall"), ("agency", "retainer")])
def test_categories(category, value):
    headers = ["company", "domain", "kpi", value]
    assert M.resolve_mapping(headers, category=category)["metric_value"] == value
    assert M.strict_mapping(headers, category=category)["metric_value"] == (value, 0.99)
    assert M.resolve_mapping(["mrr", "amount"], category="saas")["metric_value"] == "mrr" and M.resolve_mapping(["mrr", "amount"])["metric_value"] == "amount"


def test_overrides():
    assert M.resolve_mapping(["X 2", "amount"], {"metric_value": "x2"})["metric_value"] == "X 2"
    for bad in ({"nonsense": "amount"}, {"metric_value": "gone"}):
        with pytest.raises(M.IngestError, match="override"):
            M.resolve_mapping(["amount"], bad)


def test_strict_faults():
    with pytest.raises(M.IngestError, match="ambiguous: metric_name"):
        M.strict_mapping(["entity_name", "category", "metric_value", "metric_namex", "metric_namey"])
    with pytest.raises(M.IngestError, match="missing_required: metric_value"):
        M.strict_mapping(["entity_name", "category", "metric_name"])
    assert M.strict_mapping(["Entity_Name", "category", "metric_nam", "metric_value"])["metric_name"][1] == pytest.approx(2 * 9 / 19, abs=1e-4)


def test_interpretation_by_kind_and_pattern(spark):
    rows = [(f"Co {i}", f"c{i % 2}", "Net Sales", f"{i},000.5", "2024-01-01", '{"a": 1}') for i in range(10)]
    df = spark.createDataFrame(rows, "company string, category string, kpi string, amount string, date string, metadata string")
    fits = M.value_fits(df, df.columns)
    assert M._fit("metric_value", fits["amount"]) == (1.0, 1.0) and M._fit("entity_name", fits["amount"]) == (0.0, 0.7)
    assert M._fit("category", fits["category"]) == (1.0, 1.0) and M._fit("category", fits["company"]) == (1.0, 0.3)
    assert M._fit("timestamp", fits["date"]) == (1.0, 1.0) and M._fit("role", fits["date"])[0] == 0.0
    assert M._fit("metadata_json", fits["metadata"]) == (1.0, 0.5) and M._fit("metric_name", fits["kpi"]) == (1.0, 1.0)
    got = {x.field: (x.header, x.decision) for x in M.interpret(df)}
    assert got["metric_value"] == ("amount", "auto") and got["entity_name"] == ("company", "auto") and got["timestamp"] == ("date", "auto")
    none = M.value_fits(df.limit(0), df.columns)
    assert M._fit("category", none["category"]) == (0.5, 0.5) == M._fit("metric_value", none["amount"])


def test_many_files_as_one_by_one(spark):
    rng = random.Random(7)
    pool = [n for f in M.FIELDS for n in (f, *M.ALIASES[f])] + [n for c in M.CATEGORY_ALIASES.values() for names in c.values() for n in names] + ["", "éa", "x", "value metric", "name entity", "Betrag"]
    headers, files, overrides, want = [], [], [], {}
    for k in range(60):
        some = []
        for _ in range(rng.randrange(0, 14)):
            n = rng.choice(pool)
            i = rng.randrange(len(n) + 1)
            some.append(rng.choice((n, n.upper(), n.replace("_", " "), n[:i] + n[i + 1 :], n[:i] + "q" + n[i:])))
        category, config = rng.choice((None, "saas", "Retail ", "none such")), rng.choice((None, "c"))
        over = {"role": rng.choice(some)} if some and rng.random() < 0.3 else {}
        over = {f: h for f, h in over.items() if M.normalized(h)}
        headers += [(f"f{k}", i, h) for i, h in enumerate(some)]
        files.append((f"f{k}", category, config))
        overrides += [(f"f{k}", f, h) for f, h in over.items()]
        want[f"f{k}"] = M.resolve_mapping(some, over, {"metric_value": ("Betrag",)} if config else None, category=category)
    frame = spark.createDataFrame
    got = M.resolve_files(
        frame(headers, "file string, pos int, header string"), frame(files, "file string, category string, config string"),
        frame([("c", "metric_value", 0, "Betrag")], "config string, field string, pos int, name string"), frame(overrides, "file string, field string, source string")).collect()
    assert {r["file"]: r["mapping"] for r in got} == want
    for r in got:
        assert [e["field"] for e in r["errors"]] == [f for f in M.REQUIRED if f not in want[r["file"]]] and set(r["strategies"]) == set(r["mapping"])


def test_faults_of_files(spark):
    headers = spark.createDataFrame([("a", 0, "company"), ("a", 1, "amount")], "file string, pos int, header string")
    files = spark.createDataFrame([("a", None, None), ("none", None, None)], "file string, category string, config string")
    overrides = spark.createDataFrame([("a", "nonsense", "amount"), ("a", "role", "gone"), ("a", "metric_name", "AMOUNT"), ("a", "entity_name", None)], "file string, field string, source string")
    got = {r["file"]: r for r in M.resolve_files(headers, files, overrides=overrides).collect()}
    assert got["a"]["mapping"] == {"metric_name": "amount", "entity_name": "company"}
    assert [tuple(e) for e in got["a"]["errors"]] == [("invalid_override_field", "nonsense"), ("override_source_not_found", "entity_name"), ("override_source_not_found", "role"), ("required_field_unmapped", "category"), ("required_field_unmapped", "metric_value")]
    assert got["none"]["mapping"] == {} and len(got["none"]["errors"]) == 4


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Company,Domain,KPI,Amount,Origin,Date\nAcme,Retail,sales,1,api,2024-01-01\n\"B, Co\",Retail,sales,2,api,2024-01-02\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('extra col,"metric, value",metric name,CATEGORY,entity,region,more\nx,5,churn,SaaS,Corp,EU,y\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text("qqq,zzz,jjj\n1,2,3\n", encoding="utf-8")
    rows, plans = M.read_folder(spark, str(tmp_path))
    got = sorted((r["entity_name"], r["category"], r["metric_name"], r["metric_value"], r["timestamp"], r["region"]) for r in rows.collect())
    assert got == [("Acme", "Retail", "sales", "1", "2024-01-01", None), ("B, Co", "Retail", "sales", "2", "2024-01-02", None), ("Corp", "SaaS", "churn", "5", None, "EU")]
    assert {r["file"].rsplit("/", 1)[1]: len(r["errors"]) for r in plans.collect()} == {"a.csv": 0, "b.csv": 0, "c.csv": 4}
    good, bad = I.validate(rows)
    assert good.count() == 2 and [r["error_code"] for r in bad.collect()] == ["timestamp_required"]
