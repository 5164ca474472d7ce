"""Queries of this subpackage: name -> (builder, oracle SQL or None)."""

from __future__ import annotations

from vendora.session import ensure_checkpoint_dir, scratch_path, ship_package

# Rows of an Arrow batch: texts are wide, and the default of 10,000 rows would put tens of
# megabytes in each of several buffers of every task.
ARROW_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000")

QUERIES: dict = {}
ORACLES: dict = {}


def prepare(spark) -> None:
    """Let the session's workers import this package, and keep its Arrow batches small
    unless the session has a size of its own."""
    ship_package(spark)
    key, default, rows = ARROW_ROWS
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, rows)


def query(name: str, sql: str | None = None):
    def deco(fn):
        def build(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df):
    """The rows written to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df, name: str):
    """The same as a Parquet table under the shared checkpoint folder (smaller than
    ``cut``, and read by columns)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
