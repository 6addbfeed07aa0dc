"""Macro observations as a data source: spark.read.format("macro").

Something else lands the providers' answers below a folder, one folder a country
and metric (`country=us/metric=gdp/...json`). A file holds an answer as the
provider gives it, or a line {date, value} for each observation.

    register(spark)
    spark.read.format("macro").option("provider", "yearly").option("limit", 20).load("/landed")

Options: provider (dated, yearly or imf), path, period_start and period_end
(dates, both included), limit (yearly: the last so many of each country and
metric, 20 at first; dated: the first so many, 240 at first).

Each folder is one partition. Equality and IN on country and metric are pushed
down, so other folders are not opened. Columns: country, metric, period_start,
period_end, value (text).

* dated: one-day periods; observations without a value or with "." are left out;
* yearly: whole years; dates that do not begin with a year are left out;
* imf: a known provider that is not supported.

A file that holds neither form is an error that names it.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "country string, metric string, period_start date, period_end date, value string"
LIMITS = {"dated": 240, "yearly": 20}
_FOLDER = re.compile(r"country=([^/]+)/metric=([^/]+)/[^/]+\.json$")


class Folder(InputPartition):
    """The files of one country and metric."""

    def __init__(self, country: str, metric: str, files: list[str]):
        self.country, self.metric, self.files = country, metric, files


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def observations(text: str, name: str = "") -> list[dict]:
    """The observations of an answer {observations: [...]} or [head, [...]], or of lines {date, value}."""
    lines = [x for x in text.splitlines() if x.strip()]
    try:
        whole = json.loads(text) if lines else []
    except ValueError:
        whole = None
    if isinstance(whole, dict) and isinstance(whole.get("observations"), list):
        found = whole["observations"]
    elif isinstance(whole, list) and len(whole) > 1 and isinstance(whole[1], list):
        found = whole[1]
    elif not lines:
        found = []
    else:
        try:
            found = [json.loads(x) for x in lines]
        except ValueError:
            found = [None]
        if not all(isinstance(x, dict) and "date" in x for x in found):
            raise ValueError(f"unexpected content of {name}")
    return [x for x in found if isinstance(x, dict)]


def _day(text) -> datetime.date | None:
    try:
        return datetime.date.fromisoformat(str(text)[:10])
    except ValueError:
        return None


def _year(text) -> int | None:
    year = str(text).strip()[:4] if text is not None else ""
    return int(year) if len(year) == 4 and year.isdecimal() and int(year) > 0 else None


def periods(provider: str, found: list[dict]) -> list[tuple]:
    """(period_start, period_end, value) of observations, in order of time."""
    out = []
    for x in found:
        value = x.get("value")
        if value is None or str(value).strip() in ("", "."):
            continue
        if provider == "dated":
            day = _day(x.get("date"))
            if day is not None:
                out.append((day, day, str(value)))
        else:
            year = _year(x.get("date"))
            if year is not None:
                out.append((datetime.date(year, 1, 1), datetime.date(year, 12, 31), str(value)))
    return sorted(out, key=lambda r: r[1])


class MacroReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path", "")
        self.provider = options.get("provider", "").strip().lower()
        if self.provider == "imf":
            raise NotImplementedError("this provider is not supported")
        if self.provider not in LIMITS:
            raise ValueError(f"unknown macro provider {self.provider!r}")
        if not self.path:
            raise ValueError("option path is missing")
        self.limit = max(1, int(options.get("limit", LIMITS[self.provider])))
        self.since, self.until = (_day(options[k]) if k in options else None for k in ("period_start", "period_end"))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) else None
            if column in ("country", "metric"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _filesystem(self.path)
        folders: dict[tuple[str, str], list[str]] = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            m = _FOLDER.search(info.path)
            if m and info.type == fs.FileType.File:
                key = (unquote(m[1]), unquote(m[2]))
                if key[0] in self.wanted.get("country", {key[0]}) and key[1] in self.wanted.get("metric", {key[1]}):
                    folders.setdefault(key, []).append(info.path)
        return [Folder(*key, sorted(files)) for key, files in sorted(folders.items())] or [Folder("", "", [])]

    def read(self, partition: Folder) -> Iterator[tuple]:
        system, _ = _filesystem(self.path)
        rows = []
        for name in partition.files:
            with system.open_input_stream(name) as f:
                rows += periods(self.provider, observations(f.read().decode("utf-8"), name))
        rows = sorted((r for r in rows if (self.since is None or r[0] >= self.since) and (self.until is None or r[1] <= self.until)), key=lambda r: r[1])
        for row in rows[-self.limit :] if self.provider == "yearly" else rows[: self.limit]:
            yield (partition.country, partition.metric, *row)


class MacroSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "macro"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MacroReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with pushed filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MacroSource)
