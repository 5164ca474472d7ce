"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are kept as the sum of committed
batches.  A batch is a set of signed rows: an insert adds a document's counts, a
delete takes the recorded counts away, a revision takes the old counts away and
adds the new ones.  Since totals are sums, batches may come in any order.

A store is a folder with two tables:

* ``totals/attempt=<name>``: the signed totals that one attempt at a batch wrote;
* ``ledger``: one row for each commit or fold of a batch, with the attempt that holds it.

A batch is written first and entered in the ledger after.  A batch in the ledger is
not applied again; one that broke off before is written anew, to a place of its
own, so no reader loses files.  Folding writes the sum of all batches as one batch and enters it, and
that it replaces them, with one file.  Readers take the batches that the
ledger names and that no fold replaced.

Scale: a batch is added up in each task before its totals are shuffled (by at
most sources x languages x versions keys); reading sums the batches' totals, never
documents.

Cases: null texts have no tokens; null source or language is a group; repeated rows
count as documents; an empty batch commits and adds nothing; groups whose
document count came to zero are left out of the totals; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendora.llm.registry import query, table, written
from vendora.session import scratch_path

GROUP = ["source", "lang", "version"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
TOTALS = "source string, lang string, version string, n_docs long, n_tokens long, n_chars long"
LEDGER = "batch string, state string, attempt string"

_ENCODINGS: dict = {}


def encoding_of(path: str):
    """One byte-level BPE encoding in each Python worker."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def counter(path: str | None):
    def run(batches):
        enc = encoding_of(path or default_path())
        for batch in batches:
            col = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
            texts = col.pop("text").to_pylist()
            col["n_tokens"] = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(col.values()), names=list(col))
    return run


def count_documents(docs: DataFrame, version: str, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Recorded counts: key, digest, source, lang, version, n_tokens, n_chars of every row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    src = docs.select(F.col(key).alias("key"), F.md5(body).alias("digest"), F.col("source").cast("string").alias("source"),
                      F.col("lang").cast("string").alias("lang"), F.lit(version).alias("version"),
                      F.length(body).cast("long").alias("n_chars"), body.alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return src.mapInArrow(counter(path), f"key {kind}, digest string, source string, lang string, version string, n_chars long, n_tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(1).alias("sign"), "n_tokens", "n_chars")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(-1).alias("sign"), "n_tokens", "n_chars")


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._entries(self.spark.createDataFrame([], LEDGER))       # the ledger exists from the start

    def _entries(self, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")    # one file: all entries or none

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger").distinct()

    def live(self) -> dict[str, str]:
        """Batch -> attempt of the batches that make up the totals; folding keeps them few.  Of a batch that
        two senders wrote at once, one attempt counts."""
        open_ = self.ledger().groupBy("batch").agg(F.bool_or(F.col("state") == "folded").alias("folded"),
                                                   F.min(F.when(F.col("state") == "committed", F.col("attempt"))).alias("attempt"))
        return {r.batch: r.attempt for r in open_.filter("NOT folded").orderBy("batch").collect()}

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Apply signed rows (source, lang, version, sign, n_tokens, n_chars) once; False if
        the batch was applied before."""
        if self.ledger().filter(F.col("batch") == batch).limit(1).count():
            return False
        sums = delta.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"),
                                         F.sum(F.col("sign") * F.col("n_chars")).cast("long").alias("n_chars"))
        self._entries(self.spark.createDataFrame([(batch, "committed", self._attempt(sums))], LEDGER))
        return True

    def _attempt(self, sums: DataFrame) -> str:
        """Write totals to a place of their own, which the ledger then names."""
        name = uuid.uuid4().hex
        sums.write.parquet(f"{self.path}/totals/attempt={name}")
        return name

    def _sums(self, batches: dict[str, str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], TOTALS)
        rows = self.spark.read.schema(TOTALS).parquet(*[f"{self.path}/totals/attempt={a}" for a in batches.values()])
        return rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])

    def totals(self) -> DataFrame:
        return self._sums(self.live()).filter("n_docs <> 0 OR n_tokens <> 0 OR n_chars <> 0")

    def fold(self) -> None:
        """Replace all live batches by one with their sum."""
        live = self.live()
        if len(live) < 2:
            return
        name = "fold-" + hashlib.md5("\n".join(live).encode()).hexdigest()      # the same after a restart
        attempt = self._attempt(self._sums(live))
        self._entries(self.spark.createDataFrame([(name, "committed", attempt), *[(b, "folded", None) for b in live]], LEDGER))


@query("op8_token_rollup")
def op8(spark, sf_dir: str) -> DataFrame:
    """Insert all documents; delete later copies of equal texts; revise the rest to a
    version that counts an end token; each batch is sent twice, as after a lost answer."""
    docs = table(spark, sf_dir, "documents")
    counts = written(count_documents(docs, "byte_bpe_50k"), "token-counts")
    first = counts.groupBy("digest").agg(F.min("key").alias("first"))
    marked = counts.join(first, "digest")
    later, kept = marked.filter(~F.col("key").eqNullSafe(F.col("first"))), marked.filter(F.col("key").eqNullSafe(F.col("first")))
    ended = kept.withColumn("version", F.lit("byte_bpe_50k+end")).withColumn("n_tokens", F.col("n_tokens") + 1)
    store = Store(spark, scratch_path(spark, "token-rollup"))
    for _ in range(2):
        store.commit("load", inserts(counts))
        store.commit("copies", deletes(later))
    store.fold()
    for _ in range(2):
        store.commit("end-token", revisions(kept, ended))
    return store.totals().select(*GROUP, *SUMS)
