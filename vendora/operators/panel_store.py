"""A sales panel kept up to date by signed changes instead of rescans.

A store is a folder:

* ``data/<attempt>``: rows (key, day, sums...) of one batch, or of the base of one period;
* ``ledger/batches/<attempt>``: one row that names a batch and the attempt that holds it;
* ``ledger/folds/upto=<n>``: after a fold, the attempt that holds each period's base.  It names all batches up to n as
  part of the base.

Batches are numbered by their sender.  A batch is written to a place of its own and named in the ledger after; a batch
that is sent again, or was sent twice at once, counts once (the least attempt name of a batch is read), and one that a fold
has taken in is ignored.  So loads may be replayed after any failure.

A correction is a signed row: the old amounts negated and the new ones.  Sums are exact decimals, so the order of batches
doesn't matter.

A fold adds the open batches up to a number to the base and rewrites only the periods (months) that they touch; the ledger it leaves has
a row for each period and forgets the batches, so it stays as long as the calendar is, not as the store is old.  It needs every batch up to
that number to be there.  Old attempts are left for the reader that still has them; ``dead_attempts`` names them.

Scale: a batch is summed by key and day before it is written; a reader adds base and open batches by key and day, and prunes periods.

Cases: null amounts add nothing; keys or days that are null are rows of their own; an empty batch counts as
committed; a key and day whose amounts and count came to zero goes from the panel; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch long, attempt string"
FOLD = "period string, attempt string"


@dataclass
class PanelStore:
    spark: SparkSession
    path: str
    keys: list
    values: list
    day: str = "date"
    amount: str = "decimal(28,4)"

    # --- files

    def _at(self, *parts: str) -> str:
        return "/".join([self.path.rstrip("/"), *parts])

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _write(self, df: DataFrame, name: str) -> str:
        attempt = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(self._at("data", attempt))
        return attempt

    def _read(self, attempts: list) -> DataFrame:
        return self.spark.read.schema(self._schema()).parquet(*[self._at("data", a) for a in attempts])

    def _schema(self) -> str:
        return self._kinds + f", `{self.day}` date, n long, " + ", ".join(f"`{v}` {self.amount}" for v in self.values)

    @property
    def _kinds(self) -> str:
        return ", ".join(f"`{k}` string" for k in self.keys)

    # --- ledger

    def folded(self) -> tuple[int, dict]:
        """(number up to which batches are folded, period -> attempt of its base)."""
        root = self._at("ledger", "folds")
        if not self._exists(root):
            return 0, {}
        folds = self.spark.read.option("basePath", root).schema(FOLD + ", upto long").parquet(root)
        last = folds.agg(F.max("upto")).first()[0]
        rows = folds.filter(F.col("upto") == last).collect()         # one row for each period
        return last, {r.period: r.attempt for r in rows if r.attempt}

    def open_batches(self) -> dict:
        """Batch -> attempt, of those that no fold has taken in."""
        upto, _ = self.folded()
        root = self._at("ledger", "batches")
        if not self._exists(root):
            return {}
        rows = self.spark.read.schema(BATCH).parquet(root).filter(F.col("batch") > upto).groupBy("batch").agg(F.min("attempt").alias("attempt"))
        return {r.batch: r.attempt for r in rows.collect()}          # bounded by the batches between two folds

    # --- writing

    def summed(self, rows: DataFrame, sign: int = 1) -> DataFrame:
        """Rows as signed sums by key and day (``n`` counts them, unless they have an ``n`` already)."""
        count = F.col("n").cast("long") if "n" in rows.columns else F.lit(1).cast("long")
        src = rows.select(*[F.col(k).cast("string").alias(k) for k in self.keys], F.col(self.day).cast("date").alias(self.day), (count * sign).alias("n"),
                          *[(F.coalesce(F.col(v).cast(self.amount), F.lit(0).cast(self.amount)) * sign).cast(self.amount).alias(v) for v in self.values])
        return src.groupBy(*self.keys, self.day).agg(F.sum("n").alias("n"), *[F.sum(v).cast(self.amount).alias(v) for v in self.values])

    def commit(self, batch: int, added: DataFrame | None = None, removed: DataFrame | None = None) -> bool:
        """Commit rows that came and rows that went under the number ``batch`` (from 1); False where it was there."""
        if batch <= self.folded()[0] or batch in self.open_batches():
            return False
        parts = [self.summed(d, s) for d, s in ((added, 1), (removed, -1)) if d is not None]
        if not parts:
            raise ValueError("a batch has rows that came or rows that went")
        delta = parts[0] if len(parts) == 1 else self.summed(parts[0].unionByName(parts[1]))
        attempt = self._write(delta, f"batch-{batch}")
        self.spark.createDataFrame([(batch, attempt)], BATCH).coalesce(1).write.mode("append").parquet(self._at("ledger", "batches"))
        return True

    def fold(self, upto: int) -> None:
        """Take the batches up to ``upto`` into the base; touched periods are rewritten."""
        done, base = self.folded()
        if upto <= done:
            return
        batches = self.open_batches()
        lacking = [b for b in range(done + 1, upto + 1) if b not in batches]
        if lacking:
            raise ValueError(f"batches {lacking[:5]} aren't committed")
        period = F.coalesce(F.date_format(self.day, "yyyy-MM"), F.lit("none")).alias("period")
        delta = self._read([batches[b] for b in range(done + 1, upto + 1)])
        touched = sorted(r.period for r in delta.select(period).distinct().collect())      # a calendar's months
        old = [base[p] for p in touched if p in base]
        rows = delta.unionByName(self._read(old)) if old else delta
        rows = self._kept(self.summed(rows))
        attempt = f"base-{upto}-{uuid.uuid4().hex}"
        rows.withColumn("period", period).repartition("period").write.partitionBy("period").parquet(self._at("data", attempt))
        left = {r.period for r in rows.select(period).distinct().collect()}
        now = {**{p: a for p, a in base.items() if p not in touched}, **{p: f"{attempt}/period={p}" for p in touched if p in left}}
        rows = list(now.items()) or [(None, None)]
        self.spark.createDataFrame(rows, FOLD).coalesce(1).write.mode("overwrite").parquet(self._at("ledger", "folds", f"upto={upto}"))

    # --- reading

    def _kept(self, rows: DataFrame) -> DataFrame:
        zero = F.col("n") == 0
        for v in self.values:
            zero = zero & (F.col(v) == 0)
        return rows.filter(~zero)

    def panel(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """(keys, day, n, values) as a rescan would give them; ``first`` and ``last`` (yyyy-MM) prune the base's periods."""
        _, base = self.folded()
        inside = [a for p, a in base.items() if p == "none" or ((first is None or p >= first) and (last is None or p <= last))]
        parts = inside + list(self.open_batches().values())
        if not parts:
            return self.spark.createDataFrame([], self._schema())
        rows = self._kept(self.summed(self._read(parts)))
        if first is not None:
            rows = rows.filter(F.date_format(self.day, "yyyy-MM") >= first)
        if last is not None:
            rows = rows.filter(F.date_format(self.day, "yyyy-MM") <= last)
        return rows

    def dead_attempts(self) -> list:
        """Places under ``data`` that neither the base nor an open batch names."""
        _, base = self.folded()
        live = {a.split("/")[0] for a in base.values()} | set(self.open_batches().values())
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at("data"))
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
        return sorted(n for n in names if n not in live)
