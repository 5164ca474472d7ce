"""Row counts and date ranges from the files' own statistics.

The v2 Parquet reader answers count, min and max from the footers (aggregate push-down), so a profile of a table
reads no data column, whatever its size.  Push-down is set in a session of its own next to the caller's, whose settings stay
as they are.

Footers hold no usable range for timestamp types, but a timestamp is a number of units there, and as such it has one: such columns
are declared as numbers, and the unit is found by reading one row both ways.

Cases: a column whose files have no statistics, or a timestamp of 96 bits, is read in the usual way; an empty table
counts 0 rows with null ends; null values are outside of the range and inside of the count.
"""

from __future__ import annotations

import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMES = (T.TimestampType, T.TimestampNTZType)
EPOCH = datetime.date(1970, 1, 1)
# what Spark says of footers without a range, and of timestamps that aren't numbers
LACKING = ("No min/max found", "FAILED_READ_FILE.PARQUET_COLUMN_DATA_TYPE_MISMATCH", "SchemaColumnConvertNotSupportedException")


def stats_session(spark: SparkSession) -> SparkSession:
    s = spark.newSession()
    s.conf.set("spark.sql.sources.useV1SourceList", "")
    s.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    s.conf.set("spark.sql.session.timeZone", "UTC")
    return s


def footer_ends(session: SparkSession, path: str, column: str) -> tuple[DataFrame, int] | None:
    """((rows, lo, hi) off the footers, units a day of lo and hi), or None where the column has no such numbers."""
    plain = session.read.parquet(path)
    kind = plain.schema[column].dataType
    ends = [F.count(F.lit(1)).alias("rows"), F.min(column).alias("lo"), F.max(column).alias("hi")]
    if isinstance(kind, T.DateType):
        return plain.agg(*ends).select("rows", F.unix_date("lo").cast("long").alias("lo"), F.unix_date("hi").cast("long").alias("hi")), 1
    if not isinstance(kind, TIMES):
        raise ValueError(f"{column} is neither a date nor a timestamp")
    # the whole schema in file order: footers are read by place
    numbers = T.StructType([T.StructField(f.name, T.LongType() if f.name == column else f.dataType) for f in plain.schema.fields])
    raw = session.read.schema(numbers).parquet(path)
    unit = _units_a_second(plain, raw, column)
    return None if unit is None else (raw.agg(*ends), 86_400 * unit)


def date_profile(session: SparkSession, path: str, column: str) -> DataFrame:
    """(rows, min_date, max_date) of a date or timestamp column; ``session`` comes from ``stats_session``.  Footers may
    turn out to lack a range (a file of nulls) only when they are read, so they are read here; the column itself is, if they do."""
    try:
        got = footer_ends(session, path, column)
        row = None if got is None else got[0].first()
    except (PySparkException, Py4JJavaError) as e:
        if not any(x in str(e) for x in LACKING):
            raise
        row = None
    if row is None:
        usual = session.newSession()                        # without push-down
        usual.conf.set("spark.sql.session.timeZone", "UTC")
        plain = usual.read.parquet(path)
        return plain.agg(F.count(F.lit(1)).alias("rows"), F.min(column).cast("date").alias("min_date"), F.max(column).cast("date").alias("max_date"))
    ends = [None if x is None else EPOCH + datetime.timedelta(x // got[1]) for x in (row.lo, row.hi)]
    return session.createDataFrame([(row.rows, *ends)], "rows long, min_date date, max_date date")


def _units_a_second(plain: DataFrame, raw: DataFrame, column: str) -> int | None:
    """1,000, 1,000,000 or 1,000,000,000, from one value; None for a table without any (or with the epoch alone)."""
    a = plain.select(F.unix_micros(F.col(column).cast("timestamp")).alias("us")).filter("us <> 0").first()
    b = raw.select(column).filter(F.col(column) != 0).first()
    if a is None or b is None:
        return None
    # rows come from the same place of the same file, so the two are one value in two units
    for unit in (1_000, 1_000_000, 1_000_000_000):
        if b[0] * 1_000_000 // unit == a[0] or b[0] == a[0] * unit // 1_000_000:
            return unit
    return None


def profile(session: SparkSession, tables: dict) -> DataFrame:
    """(table, rows, min_date, max_date) for ``tables``: name -> (path, column)."""
    rows = []
    for name, (path, column) in tables.items():
        rows.append((name, *date_profile(session, path, column).first()))
    return session.createDataFrame(rows, "table string, rows long, min_date date, max_date date")
