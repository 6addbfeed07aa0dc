"""Which header of a file stands for which canonical field.

`resolve_files` maps the headers of all files of a folder in one job: the names
of the fields (own name, names of the business category, general names, saved
names, in this order) are a table, joined to the distinct headers; what is not
equal is compared by likeness, each distinct pair of names once. A file's
preferences are then followed field by field. `resolve_mapping` gives the same
for one list of headers on the driver, `strict_mapping` wants more certainty,
`interpret` also looks at values.

Order of decision: overrides first; then, field by field, the first name that
equals a header; else the most alike header, ties going to the earlier name,
then to the whole name before its part, then to the earlier header. A header is
used once. Names are compared by their letters and digits, lower-cased; of two
headers that are then equal the last one counts.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.functions.likeness import partial_ratio, ratio

# The canonical fields, in mapping order, and other names for them, general and by business category.
FIELDS = ("source_type", "entity_name", "category", "role", "metric_name", "metric_value", "timestamp", "region", "metadata_json")
REQUIRED = ("entity_name", "category", "metric_name", "metric_value")
ALIASES: dict[str, tuple[str, ...]] = {
    "source_type": ("source", "source_kind", "source kind", "input_source", "data_source", "origin"),
    "entity_name": ("entity", "company", "client", "competitor", "account_name", "business_name", "brand", "organization", "organisation", "firm", "vendor", "tenant", "customer_name"),
    "category": ("insight_category", "metric_category", "domain", "topic", "business_area", "department", "vertical"),
    "role": ("org_role", "organization_role", "job_role", "function", "persona", "team_role", "position", "owner_role"),
    "metric_name": ("metric", "kpi", "measure_name", "metric_key", "indicator", "measure", "signal", "kpi_name"),
    "metric_value": ("value", "metric_amount", "measure_value", "kpi_value", "amount", "total", "count", "quantity", "score", "number", "figure", "result"),
    "timestamp": ("date", "datetime", "event_time", "measured_at", "recorded_at", "month", "period", "report_date", "created_date", "time", "observation_date", "data_date", "as_of_date", "effective_date"),
    "region": ("geo", "geography", "country", "market_region", "location", "territory", "market", "area", "state", "city", "zone"),
    "metadata_json": ("metadata", "meta", "context_json", "attributes", "extra", "tags", "properties", "details"),
}
CATEGORY_ALIASES: dict[str, dict[str, tuple[str, ...]]] = {
    "saas": {
        "metric_value": ("mrr", "arr", "monthly_recurring_revenue", "annual_recurring_revenue", "acv", "tcv"),
        "metric_name": ("saas_metric", "subscription_metric"),
        "entity_name": ("account", "workspace", "subscription"),
        "timestamp": ("billing_date", "renewal_date", "subscription_start"),
    },
    "ecommerce": {
        "metric_value": ("revenue", "gmv", "gross_merchandise_value", "order_value", "transaction_amount", "sales", "net_revenue", "gross_revenue"),
        "metric_name": ("product_metric", "sku_metric", "order_metric"),
        "entity_name": ("store", "shop", "merchant", "seller"),
        "timestamp": ("order_date", "transaction_date", "purchase_date"),
    },
    "agency": {
        "metric_value": ("total_revenue", "billable_amount", "retainer", "project_value", "contract_value"),
        "metric_name": ("engagement_metric", "campaign_metric"),
        "entity_name": ("agency", "account_name", "client_name"),
        "timestamp": ("campaign_date", "report_period", "invoice_date"),
    },
    "finance": {
        "metric_value": ("aum", "nav", "portfolio_value", "loan_amount", "premium", "interest_income"),
        "entity_name": ("fund", "portfolio", "borrower", "policyholder"),
    },
    "healthcare": {
        "metric_value": ("patient_count", "claim_amount", "reimbursement", "bed_occupancy", "readmission_rate"),
        "entity_name": ("hospital", "clinic", "provider", "facility"),
    },
    "retail": {
        "metric_value": ("sales", "revenue", "footfall", "basket_size", "same_store_sales", "units_sold"),
        "entity_name": ("store", "outlet", "branch", "location_name"),
        "timestamp": ("sale_date", "transaction_date"),
    },
    "logistics": {
        "metric_value": ("shipment_volume", "delivery_count", "freight_cost", "on_time_rate", "utilization"),
        "entity_name": ("carrier", "warehouse", "hub", "depot"),
    },
}
#: Places of a field's names: its own 0, then by category, in general, saved.
_CATEGORY, _GENERAL, _SAVED = 1_000, 2_000, 3_000
FUZZY = 80.0


class IngestError(ValueError):
    """What an ingestion reports instead of rows: code and details."""

    def __init__(self, code: str, details: str = ""):
        super().__init__(f"{code}: {details}" if details else code)
        self.code, self.details = code, details


def normalized(header: str) -> str:
    return "".join(c for c in header.strip().lower() if c.isalnum())


def candidates(fld: str, config: dict[str, tuple[str, ...]] | None = None, category: str | None = None) -> list[str]:
    """The names of a field, in order."""
    by_category = CATEGORY_ALIASES.get((category or "").strip().lower(), {})
    return [fld, *by_category.get(fld, ()), *ALIASES.get(fld, ()), *(config or {}).get(fld, ())]


def _lookup(headers: list[str]) -> dict[str, str]:
    return {normalized(h): h for h in headers if normalized(h)}


def name_score(header: str, names: list[str]) -> float:
    """0..100: the best likeness of a header, whole or in part, to a field's names; letters and digits count."""
    h = normalized(header)
    return max((max(ratio(normalized(n), h), partial_ratio(normalized(n), h)) for n in names if normalized(n)), default=0.0)


def resolve_mapping(headers: list[str], overrides: dict[str, str] | None = None, config: dict[str, tuple[str, ...]] | None = None, fuzzy: float = FUZZY, category: str | None = None) -> dict[str, str]:
    """field -> header for one list of headers; an override of an unknown field or header is an error."""
    by_norm = _lookup(headers)
    out: dict[str, str] = {}
    for fld, header in (overrides or {}).items():
        if fld.strip() not in FIELDS or normalized(header) not in by_norm:
            raise IngestError("override", f"{fld} -> {header}")
        out[fld.strip()] = by_norm[normalized(header)]
    used = set(out.values())
    for fld in FIELDS:
        if fld in out:
            continue
        names = [normalized(c) for c in candidates(fld, config, category) if normalized(c)]
        hit = next((by_norm[n] for n in names if n in by_norm and by_norm[n] not in used), None)
        best = 0.0
        if hit is None:
            for n in names:
                for score in (ratio, partial_ratio):
                    for norm, header in by_norm.items():
                        s = 0.0 if header in used else score(n, norm)
                        if s >= fuzzy and s > best:
                            hit, best = header, s
        if hit is not None:
            out[fld] = hit
            used.add(hit)
    return out


def strict_mapping(headers: list[str], required: tuple[str, ...] = REQUIRED, least: float = 92.0, band: float = 5.0, category: str | None = None, config: dict[str, tuple[str, ...]] | None = None) -> dict[str, tuple[str, float]]:
    """field -> (header, confidence): the field's name, else another name (case aside), else likeness of the whole name
    from `least` on. Other headers within `band` of the best make the field ambiguous; that, or a required field
    without a header, is an error.
    """
    by_case: dict[str, str] = {}
    by_norm: dict[str, str] = {}
    for h in (h.strip() for h in headers if h.strip()):
        by_case.setdefault(h.lower(), h)
        if normalized(h):
            by_norm.setdefault(normalized(h), h)
    out: dict[str, tuple[str, float]] = {}
    used: set[str] = set()
    ambiguous = []
    for fld in FIELDS:
        names = candidates(fld, config, category)
        exact = [by_case[n.strip().lower()] for n in names if by_case.get(n.strip().lower()) not in (None, *used)]
        if exact:
            out[fld] = (exact[0], 1.0 if exact[0].lower() == fld else 0.99)
        else:
            scores = {h: max(ratio(normalized(n), norm) for n in names) for norm, h in by_norm.items() if h not in used}
            best = max(scores, key=scores.__getitem__, default=None)
            if best is None or scores[best] < least:
                continue
            if sum(s >= scores[best] - band for s in scores.values()) > 1:
                ambiguous.append(fld)
                continue
            out[fld] = (best, round(scores[best] / 100, 4))
        used.add(out[fld][0])
    if ambiguous:
        raise IngestError("ambiguous", ",".join(sorted(ambiguous)))
    missing = [f for f in required if f not in out]
    if missing:
        raise IngestError("missing_required", ",".join(missing))
    return out


# By values.
@dataclass(frozen=True)
class Interpretation:
    field: str
    header: str
    score: float
    decision: str


_NUMBER, _DATE, _JSON, _SLUG = r"^-?\d[\d,]*\.?\d*$", r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}", r"^\s*[\[{]", r"^[a-z][a-z0-9_]*$"


def value_fits(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """Per column, over its non-blank values: shares of numbers, dates, JSON, plain texts and slugs, the distinct share and number; one pass."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.trim(F.col(f"`{c}`").cast("string"))
        v = F.when(v != "", v)
        number, date, js = F.replace(v, F.lit(","), F.lit("")).rlike(_NUMBER), v.rlike(_DATE), v.rlike(_JSON)
        share = lambda test, v=v: F.coalesce(F.avg(F.when(v.isNotNull(), test.cast("int"))), F.lit(0.5))
        aggs += [
            share(number).alias(f"number{i}"), share(date).alias(f"date{i}"), share(js).alias(f"json{i}"), share(~number & ~date & ~js).alias(f"text{i}"),
            share(F.replace(F.lower(v), F.lit(" "), F.lit("_")).rlike(_SLUG)).alias(f"slug{i}"),
            F.try_divide(F.count_distinct(F.lower(v)), F.count(v)).alias(f"unique{i}"), F.count_distinct(v).alias(f"distinct{i}"),
        ]
    row = df.agg(*aggs).first()
    return {c: {k: row[f"{k}{i}"] for k in ("number", "date", "json", "text", "slug", "unique", "distinct")} for i, c in enumerate(columns)}


def _fit(fld: str, x: dict[str, float]) -> tuple[float, float]:
    """How well values fit a field: by kind and by pattern; 0.5 without values."""
    kind = x[{"metric_value": "number", "timestamp": "date", "metadata_json": "json"}.get(fld, "text")]
    if x["unique"] is None:
        return kind, 0.5
    if fld in ("source_type", "category", "role"):
        return kind, 1.0 if x["unique"] <= 0.3 else 0.6 if x["unique"] <= 0.6 else 0.3
    if fld == "entity_name":
        return kind, 0.7 if x["distinct"] >= 2 else 0.5
    return kind, x[{"metric_name": "slug", "metric_value": "number", "timestamp": "date"}[fld]] if fld in ("metric_name", "metric_value", "timestamp") else 0.5


def interpret(df: DataFrame, sample: int = 200, category: str | None = None, required: tuple[str, ...] = REQUIRED) -> list[Interpretation]:
    """Greedy assignment of headers by 0.45 equal name + 0.25 likeness + 0.20 kind + 0.10 pattern, from a small sample of rows.

    0.90 maps, 0.75 maps with a warning, less does not map. Equal scores go by the order of headers, then of fields.
    """
    columns = [c for c in df.columns if normalized(c)]
    fits = value_fits(df.limit(sample), columns) if columns else {}
    scored = []
    for i, h in enumerate(columns):
        for j, fld in enumerate(FIELDS):
            names = candidates(fld, None, category)
            kind, pattern = _fit(fld, fits[h])
            equal = normalized(h) in {normalized(n) for n in names}
            scored.append((-round(0.45 * equal + 0.25 * name_score(h, names) / 100 + 0.20 * kind + 0.10 * pattern, 4), i, j, fld, h))
    out, fields, headers = [], set(), set()
    for s, _, _, fld, h in sorted(scored):
        if fld not in fields and h not in headers and -s >= 0.75:
            fields.add(fld)
            headers.add(h)
            out.append(Interpretation(fld, h, -s, "auto" if -s >= 0.9 else "warning"))
    missing = [f for f in required if f not in fields]
    if missing:
        raise IngestError("unmapped_required", ",".join(missing))
    return out


def check_mapping(mapping: dict[str, str], headers: list[str]) -> None:
    """All faults of a mapping in one error."""
    faults = [f"unknown field {f}" for f in mapping if f not in FIELDS] + [f"no column {h}" for h in mapping.values() if h not in headers] + [f"unmapped {f}" for f in REQUIRED if f not in mapping]
    if faults:
        raise IngestError("mapping", "; ".join(faults))


# Many files.
def normalized_column(header: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(header)), r"[^\p{L}\p{N}]", "")


def names_table(spark: SparkSession) -> DataFrame:
    """scope ('' or category:<name>), field_no, place, name of every fixed name; some 130 rows."""
    rows = [("", i, p, n) for i, f in enumerate(FIELDS) for p, n in [(0, f), *enumerate(ALIASES[f], _GENERAL)]]
    rows += [(f"category:{c}", FIELDS.index(f), p, n) for c, fields in CATEGORY_ALIASES.items() for f, names in fields.items() for p, n in enumerate(names, _CATEGORY)]
    return spark.createDataFrame(rows, "scope string, field_no int, place int, name string")


@F.pandas_udf(T.StructType().add("whole", T.DoubleType()).add("part", T.DoubleType()))
def _likeness(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"whole": [ratio(x, y) for x, y in zip(a, b, strict=True)], "part": [partial_ratio(x, y) for x, y in zip(a, b, strict=True)]}, dtype="float64")


def _field_no(name: Column) -> Column:
    """Number of the field of this name; null for none."""
    place = F.array_position(F.array(*map(F.lit, FIELDS)), F.trim(name))
    return F.when(place > 0, (place - 1).cast("int"))


def _preferences(lookup: DataFrame, names: DataFrame, fuzzy: float) -> DataFrame:
    """file and prefs: what each field of a file would take, best first."""
    distinct = lookup.select("norm", F.explode("scopes").alias("scope")).distinct()
    near = distinct.join(names.withColumn("name", normalized_column(F.col("name"))).where("name <> ''"), "scope")
    alike = near.select("norm", "name").distinct().withColumn("s", _likeness("name", "norm"))
    # Per header, scope and field: the first equal name, and the most alike one (whole before part, then by place).
    tried = near.join(alike, ["norm", "name"]).withColumn("t", F.explode(F.array(F.struct(F.col("s.whole").alias("score"), F.lit(0).alias("part")), F.struct(F.col("s.part").alias("score"), F.lit(1).alias("part")))))
    key = F.struct((-F.col("t.score")).alias("score"), "place", F.col("t.part").alias("part"))
    ranks = tried.groupBy("norm", "scope", "field_no").agg(
        F.min(F.when(F.col("norm") == F.col("name"), F.col("place"))).alias("equal"), F.min(F.when(F.col("t.score") >= fuzzy, key)).alias("alike"))
    found = lookup.withColumn("scope", F.explode("scopes")).join(ranks, ["norm", "scope"])
    per_field = found.groupBy("file", "header", "pos", "field_no").agg(F.min("equal").alias("equal"), F.min("alike").alias("alike"))
    entry = lambda kind, score, place, part: F.struct("field_no", F.lit(kind).alias("kind"), score.alias("score"), place.alias("place"), part.alias("part"), "pos", "header")
    equal = F.when(F.col("equal").isNotNull(), entry("exact_or_alias", F.lit(0.0), F.col("equal"), F.lit(0)))
    alike = F.when(F.col("alike").isNotNull(), entry("fuzzy", F.col("alike.score"), F.col("alike.place"), F.col("alike.part")))
    entries = per_field.select("file", F.explode(F.array_compact(F.array(equal, alike))).alias("e"))
    return entries.groupBy("file").agg(F.array_sort(F.collect_list("e")).alias("prefs"))  # at most two entries a column and field


def resolve_files(headers: DataFrame, files: DataFrame | None = None, saved_names: DataFrame | None = None, overrides: DataFrame | None = None, fuzzy: float = FUZZY) -> DataFrame:
    """file, mapping (field -> header), strategies (field -> override, exact_or_alias or fuzzy), errors (code, field) of every file.

    headers (file, pos, header); files (file, category, config) adds names by category and by saved configuration;
    saved_names (config, field, pos, name); overrides (file, field, source), which come before everything.
    """
    spark = headers.sparkSession
    if files is None:
        files = headers.select("file").distinct().withColumns({"category": F.lit(None).cast("string"), "config": F.lit(None).cast("string")})
    names = names_table(spark)
    if saved_names is not None:
        saved = saved_names.select(F.concat(F.lit("config:"), F.col("config").cast("string")).alias("scope"), _field_no(F.col("field")).alias("field_no"), (_SAVED + F.col("pos")).cast("int").alias("place"), "name")
        names = names.unionByName(saved.where("field_no is not null and name is not null"))
    scope = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.lower(F.trim(F.col(c).cast("string"))) if kind == "category" else F.col(c).cast("string"))
    scoped = files.select("file", F.array_compact(F.array(F.lit(""), scope("category", "category"), scope("config", "config"))).alias("scopes"))
    lookup = headers.withColumn("norm", normalized_column(F.col("header"))).where("norm <> ''")
    lookup = lookup.groupBy("file", "norm").agg(F.min("pos").alias("pos"), F.max_by("header", "pos").alias("header")).join(scoped, "file")

    base = files.select("file").join(_preferences(lookup, names, fuzzy), "file", "left")
    if overrides is None:
        overridden = base.withColumns({"taken": F.array().cast("array<struct<field_no:int,header:string>>"), "faults": F.array().cast("array<struct<code:string,field:string>>")})
    else:
        wanted = overrides.select("file", F.trim("field").alias("field"), normalized_column(F.col("source")).alias("norm"), _field_no(F.col("field")).alias("field_no"))
        hit = wanted.join(lookup.select("file", "norm", "header"), ["file", "norm"], "left")
        fault = F.when(F.col("field_no").isNull(), "invalid_override_field").when(F.col("header").isNull(), "override_source_not_found")
        per_file = hit.groupBy("file").agg(
            F.array_sort(F.collect_list(F.when(fault.isNull(), F.struct("field_no", "header")))).alias("taken"),
            F.array_sort(F.collect_list(F.when(fault.isNotNull(), F.struct(fault.alias("code"), "field")))).alias("faults"))
        overridden = base.join(per_file, "file", "left").withColumns({
            "taken": F.coalesce("taken", F.array().cast("array<struct<field_no:int,header:string>>")),
            "faults": F.coalesce("faults", F.array().cast("array<struct<code:string,field:string>>"))})

    start = F.transform("taken", lambda o: F.struct(o["field_no"].alias("field_no"), F.lit("override").alias("kind"), o["header"].alias("header")))

    def follow(state: Column, e: Column) -> Column:
        free = ~F.exists(state, lambda s: (s["field_no"] == e["field_no"]) | (s["header"] == e["header"]))
        return F.when(free, F.concat(state, F.array(F.struct(e["field_no"].alias("field_no"), e["kind"].alias("kind"), e["header"].alias("header"))))).otherwise(state)

    prefs = F.coalesce("prefs", F.array().cast("array<struct<field_no:int,kind:string,score:double,place:int,part:int,pos:int,header:string>>"))
    chosen = overridden.select("file", "faults", F.aggregate(prefs, start, follow).alias("chosen"))
    name = lambda s: F.element_at(F.array(*map(F.lit, FIELDS)), s["field_no"] + 1)
    entries = lambda value: F.map_from_entries(F.transform("chosen", lambda s: F.struct(name(s), s[value])))
    mapped = chosen.select("file", "faults", entries("header").alias("mapping"), entries("kind").alias("strategies"))
    missing = F.filter(F.array(*map(F.lit, REQUIRED)), lambda f: ~F.map_contains_key("mapping", f))
    errors = F.concat("faults", F.transform(missing, lambda f: F.struct(F.lit("required_field_unmapped").alias("code"), f.alias("field"))))
    return mapped.select("file", "mapping", "strategies", errors.alias("errors"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cells(lines: pd.Series) -> pd.Series:
    return pd.Series([[c.strip() for c in next(csv.reader([x]), [])] for x in lines], dtype=object)


def folder_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, header of the first line of every CSV file below path."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    first = lines.where("at = 0").withColumn("n", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "n").alias("line"))
    return first.select("file", F.posexplode(_cells(F.ltrim("line", F.lit("﻿")))).alias("pos", "header"))


def read_folder(spark: SparkSession, path: str, **known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, plans) of all CSV files below path, whatever their headers.

    rows has file, _row and the canonical columns as strings, for files without errors;
    plans is what `resolve_files` gives, `known` goes to it. One scan reads the rows of all files.
    """
    headers = folder_headers(spark, path)
    plans = resolve_files(headers, **known)
    last = headers.groupBy("file", "header").agg(F.max("pos").alias("pos"))
    places = last.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("header", "pos"))).alias("places"))
    width = headers.agg(F.max("pos")).first()[0]
    if width is None:
        raise IngestError("empty_header", path)
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width + 1)])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_row"), F.array(*schema.names).alias("cells"))
    ready = plans.where("size(errors) = 0").join(places, "file").select("file", *(F.col("places")[F.col("mapping")[f]].alias(f"__{f}") for f in FIELDS))
    return rows.join(ready, "file").select("file", "_row", *(F.get("cells", F.col(f"__{f}")).alias(f) for f in FIELDS)), plans
