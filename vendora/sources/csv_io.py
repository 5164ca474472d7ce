"""CSV sources and sinks of the shop's files.

Loaders read every column as text, normalise the header (trim + lower case),
then type the columns with the ANSI-safe ``try_*`` casts: a bad number becomes
null (then 0 for money, as the reference does), a bad date becomes null.
Nothing is sorted on read; order is applied only where a sink needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER_ITEMS_SCHEMA = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("promo_id", T.StringType(), nullable=True),
    T.StructField("promo_id_2", T.StringType(), nullable=True),
])


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, header trimmed and lower-cased."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.toDF(*[c.strip().lower() for c in df.columns])


def to_money(c: str):
    """Text -> number as it stands in the file; invalid or missing -> 0."""
    return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))


def to_date(c: str):
    return F.try_to_date(F.trim(F.col(c)))


def load_sales(spark: SparkSession, path: str) -> DataFrame:
    df = read_raw(spark, path)
    return df.select(to_date("date").alias("date"), to_money("revenue").alias("revenue"),
                     to_money("cogs").alias("cogs"))


def load_promotions(spark: SparkSession, path: str) -> DataFrame:
    df = read_raw(spark, path)
    return df.select(F.col("promo_id"), to_date("start_date").alias("start_date"),
                     to_date("end_date").alias("end_date"),
                     F.col("discount_value").try_cast("double").alias("discount_value"),
                     F.col("stackable_flag").try_cast("int").alias("stackable_flag"))


def load_web_traffic(spark: SparkSession, path: str) -> DataFrame:
    df = read_raw(spark, path)
    return df.select(to_date("date").alias("date"), F.col("traffic_source"),
                     F.col("bounce_rate").try_cast("double").alias("bounce_rate"))


def load_catalog(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    loaders = {"sales": load_sales, "promotions": load_promotions, "web_traffic": load_web_traffic}
    return {name: loaders[name](spark, p) for name, p in paths.items()}


def read_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed scan with an explicit schema; empty fields of code columns stay NULL."""
    return (spark.read.option("header", True).option("mode", "PERMISSIVE")
                 .option("nullValue", "").option("emptyValue", None).schema(schema).csv(path))


def write_csv(df: DataFrame, path: str, header_names: list[str] | None = None) -> str:
    """Write with a header (optionally renamed columns), no index column."""
    out = df.toDF(*header_names) if header_names else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_forecast(forecast: DataFrame, path: str | None = None, date_col: str = "date",
                    revenue: str = "revenue", cogs: str = "cogs", horizon: int | None = None) -> DataFrame:
    """Submission rows: Date as yyyy-MM-dd text, Revenue and COGS to the cent.
    Written to ``path`` when given (one sorted file per partition range), which needs
    ``horizon``: rows that break the contract raise and nothing is written."""
    sub = forecast.select(F.date_format(date_col, "yyyy-MM-dd").alias("Date"),
                          F.round(F.col(revenue), 2).alias("Revenue"), F.round(F.col(cogs), 2).alias("COGS"))
    if path:
        if horizon is None:
            raise ValueError("writing needs the horizon to check")
        assert_contract(export_contract(sub, horizon))
        sub.orderBy("Date").write.mode("overwrite").option("header", True).csv(path)
    return sub


def export_contract(sub: DataFrame, horizon: int) -> DataFrame:
    """The five output checks as a table (check, failures) - one aggregate pass."""
    a = sub.agg(F.count(F.lit(1)).alias("n"),
                F.count_if(F.col("Revenue").isNull() | F.isnan("Revenue")).alias("rev_nan"),
                F.count_if(F.col("COGS").isNull() | F.isnan("COGS")).alias("cogs_nan"),
                F.count_if(F.col("Revenue") < 0).alias("rev_neg"),
                F.count_if(F.col("COGS") < 0).alias("cogs_neg"))
    rows = F.array(
        F.struct(F.lit("row_count").alias("check"), F.abs(F.col("n") - horizon).alias("failures")),
        F.struct(F.lit("revenue_not_null").alias("check"), F.col("rev_nan").alias("failures")),
        F.struct(F.lit("cogs_not_null").alias("check"), F.col("cogs_nan").alias("failures")),
        F.struct(F.lit("revenue_non_negative").alias("check"), F.col("rev_neg").alias("failures")),
        F.struct(F.lit("cogs_non_negative").alias("check"), F.col("cogs_neg").alias("failures")),
    )
    return a.select(F.inline(rows))


def assert_contract(checks: DataFrame) -> None:
    """Raise when any check fails (the reference's asserts)."""
    bad = checks.filter(F.col("failures") > 0).collect()   # at most five rows
    if bad:
        raise AssertionError("export contract failed: " + ", ".join(f"{r.check}={r.failures}" for r in bad))
