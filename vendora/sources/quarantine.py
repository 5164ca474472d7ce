"""CSV loading that keeps account of what it can't take.

The plain loaders turn a bad number into 0 or null and a short line into nulls, as the reference does, without a
trace.  Here each line is either loaded whole or written beside the good rows with the reasons, so that
loaded + rejected = lines.

A line is read as text fields with the parser's own corrupt-record column (too few or too many fields, unclosed quotes), then every field
is typed with a ``try_`` cast and held against its rule.  One scan, no shuffle; rejects are a filter of the same frame.

Cases: a line may have several reasons; blank lines aren't lines; an empty required field is ``missing_<column>``, one that
doesn't parse ``bad_<column>``, one outside of its range ``range_<column>``; a file without lines gives no rows; columns that the
spec doesn't name are ignored; a column that the file lacks fails at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    type: str                       # date, double, int, long, string or decimal(p,s)
    required: bool = True
    least: float | None = None


SALES = [Field("date", "date"), Field("revenue", "double", least=0.0), Field("cogs", "double", least=0.0)]
PROMOTIONS = [Field("promo_id", "string"), Field("start_date", "date"), Field("end_date", "date"), Field("discount_value", "double", least=0.0),
              Field("stackable_flag", "int", required=False)]


def _typed(f: Field) -> Column:
    text = F.trim(F.col(f"_t_{f.name}"))
    if f.type == "date":
        return F.try_to_date(text, "yyyy-MM-dd")
    value = text.try_cast(f.type)
    return F.when(F.isnan(value), None).otherwise(value) if f.type == "double" else value


def read_checked(spark: SparkSession, path: str, fields: list[Field]) -> DataFrame:
    """All lines: the typed fields, ``line`` (its text where the parser refused it, else its fields) and ``reasons`` (empty for a
    good line)."""
    header = spark.read.option("header", True).csv(path).columns          # the first line
    names = [c.strip().lower() for c in header]
    lacking = [f.name for f in fields if f.name not in names]
    if lacking:
        raise ValueError(f"{path} has no column {', '.join(lacking)}")
    schema = T.StructType([T.StructField(f"_t_{c}", T.StringType()) for c in names] + [T.StructField("_corrupt", T.StringType())])
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
           # all fields are parsed whatever is read of them, else a line with a field too many goes unnoticed
           .option("enforceSchema", True).option("columnPruning", False).schema(schema).csv(path))
    empty = lambda f: F.col(f"_t_{f.name}").isNull() | (F.trim(F.col(f"_t_{f.name}")) == "")
    reasons = [F.when(F.col("_corrupt").isNotNull(), F.lit("malformed"))]
    for f in fields:
        # a malformed line's fields aren't judged: they may be another's
        whole = F.col("_corrupt").isNull()
        if f.required:
            reasons.append(F.when(whole & empty(f), F.lit(f"missing_{f.name}")))
        reasons.append(F.when(whole & ~empty(f) & _typed(f).isNull(), F.lit(f"bad_{f.name}")))
        if f.least is not None:
            reasons.append(F.when(whole & (_typed(f) < f.least), F.lit(f"range_{f.name}")))
    line = F.coalesce(F.col("_corrupt"), F.concat_ws(",", *[F.coalesce(F.col(f"_t_{c}"), F.lit("")) for c in names]))
    return raw.select(*[_typed(f).alias(f.name) for f in fields], line.alias("line"), F.array_compact(F.array(*reasons)).alias("reasons"))


def split(checked: DataFrame, fields: list[Field]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects as (line, reasons))."""
    good = checked.filter(F.size("reasons") == 0).select(*[f.name for f in fields])
    return good, checked.filter(F.size("reasons") > 0).select("line", "reasons")


def load_with_quarantine(spark: SparkSession, path: str, fields: list[Field], rejects_path: str) -> DataFrame:
    """The good rows of ``path``; the rejects are written to ``rejects_path``, a folder for each first reason."""
    good, bad = split(read_checked(spark, path, fields), fields)
    bad.withColumn("reason", F.col("reasons")[0]).write.partitionBy("reason").mode("overwrite").parquet(rejects_path)
    return good


def account(checked: DataFrame) -> DataFrame:
    """(reason, n): lines loaded and rejected, and how many lines have each reason."""
    marks = F.when(F.size("reasons") == 0, F.array(F.lit("loaded"))).otherwise(F.concat(F.array(F.lit("rejected")), F.col("reasons")))
    return checked.select(F.explode(marks).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
