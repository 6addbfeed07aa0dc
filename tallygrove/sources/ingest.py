"""CSV ingestion: scan, row validation with quarantine, unpivot; headers are mapped in `mapping`.

Rows never leave the executors. Cells are read as strings and typed by
expressions, so bad values become error codes.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass

import pandas as pd
from dateutil import parser as date_parser
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.sources.mapping import FIELDS, REQUIRED, IngestError

SOURCES = ("csv", "api", "scrape")
#: Categories whose rows must carry a timestamp; the singular form is what data of that kind uses.
TIMED_CATEGORIES = ("saas", "financial_market", "generic_timeseries", "general_timeseries")


def validate_upload(name: str, size: int, most: int = 50 * 1024 * 1024, extensions: tuple[str, ...] = (".csv", ".xls", ".xlsx")) -> None:
    """Name, extension and size of a file before anything is read."""
    if not name.strip():
        raise IngestError("missing_name")
    if not name.lower().endswith(extensions):
        raise IngestError("extension", name)
    if not 0 < size <= most:
        raise IngestError("size", str(size))


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, blanks kept as blanks, the byte-order mark off the first header; no columns is an error."""
    df = spark.read.option("header", True).option("inferSchema", False).option("quote", "\"").option("escape", "\"").option("emptyValue", "").option("nullValue", "\u0000").option("mode", "PERMISSIVE").csv(path)
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    if not df.columns or df.columns == [""]:
        raise IngestError("empty_header", path)
    return df


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct stripped non-empty values."""
    return df.select(F.trim(column).alias(column)).where(F.col(column) != "").distinct()


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of the files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The canonical columns as strings (null where unmapped) and _row, the order of arrival."""
    cols = [F.col(f"`{mapping[f]}`").cast("string").alias(f) if f in mapping else F.lit(None).cast("string").alias(f) for f in FIELDS]
    return df.withColumn("_row", F.monotonically_increasing_id()).select("_row", *cols)


# Rows.
#: What a date looks like, and the format of such a date; only that one is tried.
FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}T", "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]"), (r"^\d{4}-\d{2}-\d{2} ", "yyyy-MM-dd HH:mm:ss"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/", "yyyy/M/d"),
    (r"^\d{1,2}/", "M/d/yyyy"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{4}-\d{2}$", "yyyy-MM"), (r"^[A-Za-z]{3} \d{4}$", "MMM yyyy"),
)


def parse_timestamp(text: Column) -> Column:
    """A timestamp in one of the formats; no time zone means UTC."""
    t = F.trim(text)
    out = F
    for shape, fmt in FORMATS:
        out = out.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(fmt)))
    return out


def read_date(text: str | None) -> int | None:
    """Microseconds since 1970 of a date in any common notation; UTC if it names no zone; months before days.

    A missing month or day is the first; what names no year is no date.
    """
    if text is None:
        return None
    try:
        one, other = (date_parser.parse(text, default=datetime.datetime(y, 1, 1)) for y in (2000, 2004))
        if one.year != other.year:
            return None
        at = one.replace(tzinfo=datetime.timezone.utc) if one.tzinfo is None else one.astimezone(datetime.timezone.utc)
        return (at - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) // datetime.timedelta(microseconds=1)
    except (ValueError, OverflowError, TypeError):
        return None


@F.pandas_udf(T.LongType())
def _read_dates(texts: pd.Series) -> pd.Series:
    return pd.Series([read_date(t) for t in texts], dtype="Int64")


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def payload(raw: Column) -> Column:
    """A cell as VARIANT: JSON, numbers and truth values as such, anything else as a string; null if it begins like JSON and is none."""
    t = F.trim(raw)
    parsed = F.try_parse_json(F.when(F.lower(t).isin("true", "false"), F.lower(t)).otherwise(t))
    return F.when(t.rlike(r"^[\[{]"), parsed).otherwise(F.coalesce(parsed, F.when(t != "", t).cast("variant")))


def checked(mapped: DataFrame) -> DataFrame:
    """mapped with _ts, _payload, _metadata_ok and error_code, the first rule that a row breaks (null for a good row).

    Dates and JSON are parsed once a row: they come out of a generator, so that no filter on them parses again.
    Dates in none of the formats go to a lenient reader in Python; other rows send it nulls.
    """
    c = F.col
    once = F.struct(
        parse_timestamp(c("timestamp")).alias("_strict"), payload(c("metric_value")).alias("_payload"),
        (F.trim("metadata_json").rlike(r"^\{") & F.try_parse_json("metadata_json").isNotNull()).alias("_metadata_ok"))
    x = mapped.select("*", F.inline(F.array(once)))
    late = F.when(c("_strict").isNull() & ~blank(c("timestamp")), F.trim("timestamp"))
    x = x.withColumn("_ts", F.coalesce("_strict", F.timestamp_micros(_read_dates(late)))).drop("_strict")
    every_blank = F.lit(True)
    for f in FIELDS:
        every_blank = every_blank & blank(c(f))
    missing = F.lit(False)
    for f in REQUIRED:
        missing = missing | blank(c(f))
    code = (
        F.when(every_blank, "empty_row")
        .when(missing, "required_missing")
        .when(blank(c("timestamp")) & F.lower(F.trim("category")).isin(*TIMED_CATEGORIES), "timestamp_required")
        .when(~blank(c("timestamp")) & c("_ts").isNull(), "timestamp_invalid")
        .when(c("_payload").isNull(), "metric_json_invalid")
        .when(~blank(c("metadata_json")) & ~F.coalesce(c("_metadata_ok"), F.lit(False)), "metadata_json_invalid")
    )
    return x.withColumn("error_code", code)


_PARSED = ("_ts", "_payload", "_metadata_ok", "error_code")


def validate(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical rows, quarantined rows with error_code). One pass tags every row; the two results filter it."""
    tagged = checked(mapped)
    return canonical(tagged.where("error_code is null")), tagged.where("error_code is not null").drop(*_PARSED[:-1])


def canonical(good: DataFrame) -> DataFrame:
    """Typed canonical rows of rows that `checked` found good: lower-cased names, unknown sources as csv, role
    `organization`, no timestamp as now; payload is the cell as VARIANT.
    """
    low = lambda c: F.lower(F.trim(c))
    source = F.when(low("source_type").isin(*SOURCES), low("source_type")).otherwise("csv")
    return good.select(
        "_row", source.alias("source_type"), F.trim("entity_name").alias("entity"), low("category").alias("category"),
        F.when(blank(F.col("role")), "organization").otherwise(low("role")).alias("role"), low("metric_name").alias("metric"),
        F.trim("metric_value").alias("raw_value"), numeric_payload(F.col("metric_value"), F.col("_payload")).alias("value"), F.col("_payload").alias("payload"),
        F.coalesce("_ts", F.current_timestamp()).alias("ts"), F.when(~blank(F.col("region")), F.trim("region")).alias("region"),
        F.when(~blank(F.col("metadata_json")), F.col("metadata_json")).alias("metadata"),
    )


def numeric_payload(raw: Column, value: Column) -> Column:
    """The number in a cell, or under `value` in its payload; what is not finite is null."""
    x = F.coalesce(F.trim(raw).try_cast("double"), F.try_variant_get(value, "$.value", "double"))
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def value_kind(raw: Column) -> Column:
    """bool, int (a finite number without a point), float, json or string."""
    t = F.trim(raw)
    number = t.try_cast("double")
    return (
        F.when(F.lower(t).isin("true", "false"), "bool").when(number.isNotNull() & ~t.contains(".") & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), "int")
        .when(number.isNotNull(), "float").when(t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull(), "json").otherwise("string")
    )


def numeric_series(values: Column) -> Column:
    """An array of texts as its finite numbers, order kept."""
    return F.filter(F.transform(values, lambda v: v.try_cast("double")), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def split_entities(df: DataFrame, behaviour: str = "error") -> DataFrame:
    """Several entities in one file are an error unless the behaviour is `split`."""
    if behaviour != "split" and df.select("entity").distinct().limit(2).count() > 1:
        raise IngestError("multiple_entities")
    return df


# Wide to long.
_MONTHS = {m: i + 1 for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}


@dataclass(frozen=True)
class WideColumn:
    header: str
    metric: str
    year: int
    month: int
    kind: str


def parse_header(header: str) -> WideColumn | None:
    """metric and first month of a header such as revenue_2024_Q1, revenue Jan 2024, 2024-March cost, revenue_2024."""
    parts = [p for p in re.split(r"[^A-Za-z0-9]+", header.strip()) if p]
    low = [p.lower() for p in parts]
    year = next((i for i, p in enumerate(low) if re.fullmatch(r"(19|20)\d\d", p)), None)
    if year is None:
        return None
    quarter = next((i for i, p in enumerate(low) if re.fullmatch(r"q[1-4]", p) and abs(i - year) == 1), None)
    month = next((i for i, p in enumerate(low) if len(p) >= 3 and p[:3] in _MONTHS and abs(i - year) == 1 and (len(p) == 3 or p in _LONG)), None)
    marks = {year} | ({quarter} if quarter is not None else {month} if month is not None else set())
    metric = "_".join(p for i, p in enumerate(low) if i not in marks)
    if not metric:
        return None
    if quarter is not None:
        return WideColumn(header, metric, int(low[year]), 3 * int(low[quarter][1]) - 2, "quarterly")
    if month is not None:
        return WideColumn(header, metric, int(low[year]), _MONTHS[low[month][:3]], "monthly")
    return WideColumn(header, metric, int(low[year]), 1, "yearly")


_LONG = frozenset(("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"))


def wide_columns(headers: list[str]) -> list[WideColumn]:
    """The headers that name a metric and a period; fewer than two means the file is not wide."""
    found = [w for w in map(parse_header, headers) if w]
    return found if len(found) >= 2 else []


def periodicity(found: list[WideColumn]) -> str:
    kinds = {w.kind for w in found}
    return "none" if not kinds else "mixed" if len(kinds) > 1 else kinds.pop()


def unpivot(df: DataFrame) -> DataFrame:
    """A row per id and wide column: metric_name, metric_value, timestamp (first day). Blank cells are left out.

    A file that is not wide is returned as it is.
    """
    found = wide_columns(df.columns)
    if not found:
        return df
    ids = [c for c in df.columns if c not in {w.header for w in found}]
    cells = F.array(*(F.struct(F.lit(w.metric).alias("metric_name"), F.col(f"`{w.header}`").cast("string").alias("metric_value"), F.make_date(F.lit(w.year), F.lit(w.month), F.lit(1)).alias("timestamp")) for w in found))
    long = df.select(*(F.col(f"`{c}`") for c in ids), F.inline(cells))
    return long.where(F.col("metric_value").isNotNull() & ~F.lower(F.trim("metric_value")).isin("", "nan", "none"))


# Writing with the keys of the fact table.
FACT_KEY = ("source_type", "entity", "category", "metric", "ts")
KPI_KEY = ("tenant", "entity", "period_start", "period_end")


def keep_first(df: DataFrame, key=FACT_KEY, order: str = "_row") -> DataFrame:
    """First row of each key by arrival. Role and region are no part of the key."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def insert_new(existing: DataFrame, incoming: DataFrame, key=FACT_KEY, order: str = "_row") -> DataFrame:
    """Rows of `incoming` to append: first per key, and no key that exists."""
    return keep_first(incoming, key, order).join(existing.select(*key), list(key), "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key=KPI_KEY, order: str = "_row") -> DataFrame:
    """existing with incoming rows put over it: the last per key wins."""
    old = existing.withColumns({"__new": F.lit(0), **({} if order in existing.columns else {order: F.lit(0).cast("long")})})
    both = old.unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc("__new"), F.desc(order))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__new", *([] if order in existing.columns else [order]))


def next_run_version(runs: DataFrame, source: str, country: str) -> DataFrame:
    return runs.where((F.col("source") == source) & (F.col("country") == country)).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))


def only_current(runs: DataFrame) -> DataFrame:
    """is_current is true for the greatest version of each source and country."""
    return runs.withColumn("is_current", F.col("version") == F.max("version").over(Window.partitionBy("source", "country")))


def flatten_json(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """column__name for each name; nested values as JSON text, a null adds nulls."""
    return df.select(*(c for c in df.columns if c != column), *(F.get_json_object(column, f"$.{n}").alias(f"{column}__{n}") for n in names))


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """Names on the first level of a JSON column, distinct."""
    return df.select(F.explode(F.json_object_keys(column)).alias("name")).distinct()


def export(df: DataFrame, path: str, fmt: str = "csv", limit: int = 100_000, order: tuple[str, ...] = ("ts", "id")) -> None:
    """The newest `limit` rows (1..100000) as one CSV or JSON file set."""
    rows = df.orderBy(*(F.desc(c) for c in order)).limit(max(1, min(100_000, limit)))
    if fmt == "csv":
        rows.write.option("header", True).csv(path)
    elif fmt == "json":
        rows.write.json(path)
    else:
        raise IngestError("format", fmt)


EMPTY_FACTS = T.StructType([T.StructField(c, T.StringType()) for c in ("source_type", "entity", "category", "metric")] + [T.StructField("ts", T.TimestampType())])
