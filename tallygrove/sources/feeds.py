"""RSS feeds of search trends, read from landed XML files.

Spark's XML source gives an item a row; where it stands comes from the file,
the block and the order within. The first `most` items of each feed count. An
item needs a title and a publication date (RFC 2822; no zone means UTC), or it
is a fault; a feed with an item that is not XML is one fault and has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrove.functions.columns import traffic_number

_ITEM = "title string, pubDate string, approx_traffic string, link string, _corrupt_record string"
# The named zones of RFC 2822.
ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
_DATE = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3})[a-z]*[\s-]+(\d{4}|\d{2})\s+(\d{1,2}:\d{2})(:\d{2})?\s*([+-]\d{4}|[A-Za-z]{1,4})?(?:\s+\(.*\))?$"


def mail_date(text: Column) -> Column:
    """A timestamp of an RFC 2822 date; null for anything else. Unknown zones are UTC."""
    part = lambda k: F.regexp_extract(F.trim(text), _DATE, k)
    named = F.create_map(*(F.lit(x) for kv in ZONES.items() for x in kv))
    zone = F.when(part(6).rlike("^[+-]"), part(6)).otherwise(F.coalesce(named[F.upper(part(6))], F.lit("+0000")))
    short = F.length(part(3)) == 2
    year = F.when(short & (part(3).try_cast("int") < 69), F.concat(F.lit("20"), part(3))).when(short, F.concat(F.lit("19"), part(3))).otherwise(part(3))
    seconds = F.when(part(5) == "", ":00").otherwise(part(5))
    return F.try_to_timestamp(F.concat(part(1), F.lit(" "), F.initcap(part(2)), F.lit(" "), year, F.lit(" "), F.lpad(part(4), 5, "0"), seconds, F.lit(" "), zone), F.lit("d MMM yyyy HH:mm:ss xx"))


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """feed (file), seq (from 0), title, pub_date, traffic, link, corrupt, broken (an item of the feed is corrupt) of every item of the feeds below path.

    A block of a file is read in one go, so ids count its items; a row a block says where it begins.
    Items are not shuffled, and no task holds a feed.
    """
    read = spark.read.format("xml").schema(_ITEM).option("rowTag", "item").option("ignoreNamespace", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").load(path)
    # Spark wants another column read beside the corrupt record.
    corrupt = F.col("_corrupt_record").isNotNull() & (F.length(F.concat_ws("", "title", "link")) >= 0)
    at = read.select(
        F.col("_metadata.file_path").alias("feed"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"),
        "title", F.col("pubDate").alias("pub_date"), F.col("approx_traffic").alias("traffic"), "link", corrupt.alias("corrupt"))
    blocks = at.groupBy("feed", "__block").agg(F.min("__id").alias("__low"), F.count(F.lit(1)).alias("__n"), F.max("corrupt").alias("broken"))
    feed = Window.partitionBy("feed")
    before = F.coalesce(F.sum("__n").over(feed.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("feed", "__block", (before - F.col("__low")).alias("__shift"), F.max("broken").over(feed).alias("broken"))
    placed = at.join(F.broadcast(blocks), ["feed", "__block"]).withColumn("seq", (F.col("__id") + F.col("__shift")).cast("int"))
    return placed.select("feed", "seq", "title", "pub_date", "traffic", "link", "corrupt", "broken")


def trend_rows(items: DataFrame, most: int = 20, region: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(canonical rows, faults) of feed_items' rows: the first `most` of each feed.

    rows: feed, seq, entity, category, metric, value, raw_value, ts, region, link; value is whole, and
    raw_value is the text where it is no number. faults: feed, seq (null for a whole feed), error.
    """
    first = items.where(~F.col("broken") & (F.col("seq") < most))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    known = first.withColumn("ts", mail_date(F.col("pub_date")))
    error = F.when(blank("title"), "title_missing").when(blank("pub_date"), "date_missing").when(F.col("ts").isNull(), "date_invalid")
    tagged = known.withColumn("error", error)
    raw = F.trim("traffic")
    rows = tagged.where("error is null").select(
        "feed", "seq", F.trim("title").alias("entity"), F.lit("marketing").alias("category"), F.lit("trend_keyword_traffic").alias("metric"), traffic_number(raw).cast("long").alias("value"),
        F.coalesce(raw, F.lit("")).alias("raw_value"), "ts", F.lit(region).cast("string").alias("region"), F.when(~blank("link"), F.trim("link")).alias("link"))
    whole = items.where("broken").select("feed", F.lit(None).cast("int").alias("seq"), F.lit("feed_invalid").alias("error")).distinct()
    return rows, tagged.where("error is not null").select("feed", "seq", "error").unionByName(whole)
