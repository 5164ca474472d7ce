"""Benchmark decontamination: containment search with MinHash by item size.

Which documents hold a test item?  Words are runs of letters and digits (A-Z
lower-cased); an item's set is its distinct 5-word shingles (an item of fewer words
is one shingle, found only in documents of just these words).  A document holds an
item if it has at least 80 in 100 of the item's shingles.

MinHash estimates the likeness of two sets of like size, and a long document is
unlike any short item.  So items go into size classes (powers of two), and for each
class a document is read in windows twice the class's size that overlap by half:
an item that fits the class lies within one of them, and at containment 0.8 the
two are alike to at least 0.19.  Each class takes as many hashes as find that with
probability 1 - ``MISS``.  Items of up to ``SHORT`` shingles, which may be far smaller than
their class, are looked up by each of their shingles instead and can't be missed.  A window's minima come from the minima of the windows of
the class below, so all classes cost little more than one.

Documents with a window that shares a hash with an item are candidates; exact
containment is then counted from shingles of the whole document.

Scale: one pass over the texts; documents move no text.  A task knows the items
only by two bitmaps of fixed size; what passes them (hash values, and shingles of
candidate documents that items have) is joined with the items' own tables.

Cases: null and empty texts and items hold nothing; equal items each match; rows
with the same id and text are one document; null ids match like others; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm import textgrid as tg
from vendora.llm.bits import bitmap, hits
from vendora.llm.registry import query, table, written

K = 5
PER_100 = 80
UNIT = 8                   # shingles of the smallest class
MISS = 1e-4
SHORT = 3                  # items of so few shingles are looked up by the shingles themselves
SHORT_TAG = np.uint64(0xA0761D6478BD642F)
TOP = (1 << 32) - 1


def n_hashes(per_100: int = PER_100, miss: float = MISS) -> int:
    """Hashes that find the least likeness of an item and its window: an item of more
    than u/2 shingles, contained to c, in a window of 2u."""
    c = per_100 / 100
    least = c * 0.5 / (2 + (1 - c) * 0.5)
    return math.ceil(math.log(miss) / math.log(1 - least))


def _rounds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def class_of(n):
    """Size class of a set of n shingles: 0 for up to UNIT, 1 for up to 2 UNIT, ..."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / UNIT))).astype(np.int64)


def band_key(level, i, value):
    """One 64-bit key for a class, a hash function and a minimum."""
    return tg.mix(np.asarray(value).astype(np.uint64) | (np.uint64(i) << np.uint64(32)) | (np.uint64(level) << np.uint64(48)))


def item_rows(k: int, n: int):
    """Of each item: its band keys (kind 0) and shingles (kind 1), with its set size."""

    def run(batches):
        a, b = _rounds(n)
        for batch in batches:
            for part in tg.slices(batch):
                s, ptr = tg.shingles(tg.words_of(part.column(1), gaps=tg.NOT_ALNUM), k)
                for i in range(part.num_rows):
                    x = np.unique(s[ptr[i]:ptr[i + 1]])
                    if not len(x):
                        continue
                    level = int(class_of(len(x)))
                    low = (x >> np.uint64(32)).astype(np.uint32)
                    keys = [band_key(level, j, (low * a[j] + b[j]).min(keepdims=True)) for j in range(n)]
                    if len(x) <= SHORT:
                        keys.append(tg.mix(x ^ SHORT_TAG))
                    keys = np.concatenate(keys)
                    both = np.concatenate([keys, x])
                    m = len(both)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.full(m, i))), pa.array(np.full(m, level, np.int32)),
                                                      pa.array(np.repeat([0, 1], [len(keys), len(x)]).astype(np.int32)), pa.array(tg.signed(both)),
                                                      pa.array(np.full(m, len(x), np.int64))], names=["item", "level", "kind", "key", "size"])
    return run


def window_minima(low: np.ndarray, ptr: np.ndarray, levels: list, a, b):
    """For each class in ``levels``: (class, row of each window, minima by hash function)."""
    if not levels:
        return
    count = np.diff(ptr)
    blocks = -(-count // UNIT)
    total = int(blocks.sum())
    if not total:
        return
    row_of = np.repeat(np.arange(len(count)), blocks)
    # the first shingle of each block
    at = ptr[row_of] + (np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * UNIT
    minima = np.empty((len(a), len(at)), np.uint32)
    for j in range(len(a)):
        minima[j] = np.minimum.reduceat(low * a[j] + b[j], at)
    for level in range(max(levels) + 1):
        same = row_of[1:] == row_of[:-1]
        if level in levels:
            window = minima.copy()
            window[:, :-1] = np.where(same, np.minimum(minima[:, :-1], minima[:, 1:]), minima[:, :-1])
            yield level, row_of, window
        if level < max(levels):
            # pairs of blocks within a row make the blocks of the next class
            start = np.flatnonzero(np.append(True, ~same))
            place = np.arange(len(row_of)) - np.repeat(start, np.diff(np.append(start, len(row_of))))
            even = np.flatnonzero(place % 2 == 0)
            minima = np.minimum.reduceat(minima, even, axis=1)
            row_of = row_of[even]


def document_rows(k: int, n: int, levels: list, band_bits, shingle_bits, short_bits=None):
    """Rows (doc, digest, kind, key): band keys that an item may have, and shingles that a short
    item may have; of the documents with such a key, the shingles that an item may have."""

    def run(batches):
        a, b = _rounds(n)
        bands, own = band_bits.value, shingle_bits.value
        for batch in batches:
            for part in tg.slices(batch):
                s, ptr = tg.shingles(tg.words_of(part.column(2), gaps=tg.NOT_ALNUM), k)
                rows, keys = [], []
                for level, row_of, minima in window_minima((s >> np.uint64(32)).astype(np.uint32), ptr, levels, a, b):
                    for j in range(n):
                        key = band_key(level, j, minima[j])
                        hit = hits(bands, key)
                        if hit.any():
                            rows.append(row_of[hit])
                            keys.append(key[hit])
                if short_bits is not None and len(s):
                    hit = hits(short_bits.value, s)
                    if hit.any():
                        rows.append(np.repeat(np.arange(part.num_rows), np.diff(ptr))[hit])
                        keys.append(tg.mix(s[hit] ^ SHORT_TAG))
                if not rows:
                    continue
                rows, keys = np.concatenate(rows), np.concatenate(keys)
                order = np.argsort(rows, kind="stable")
                rows, keys = rows[order], keys[order]
                start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                all_rows, all_keys, kinds = [], [], []
                for lo, hi in zip(start, np.append(start[1:], len(rows))):
                    r = rows[lo]
                    x, y = np.unique(keys[lo:hi]), np.unique(s[ptr[r]:ptr[r + 1]])
                    y = y[hits(own, y)]
                    all_rows.append(np.full(len(x) + len(y), r))
                    all_keys += [x, y]
                    kinds.append(np.repeat([0, 1], [len(x), len(y)]))
                at = pa.array(np.concatenate(all_rows))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(np.concatenate(kinds).astype(np.int32)),
                                                  pa.array(tg.signed(np.concatenate(all_keys)))], names=["doc", "digest", "kind", "key"])
    return run


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
           item_text: str = "text", k: int = K, per_100: int = PER_100) -> DataFrame:
    """(doc, digest, item, n_shingles, n_found) of the pairs that hold."""
    sc = docs.sparkSession.sparkContext
    n = n_hashes(per_100)
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    own = written(items.select(F.col(item_key).alias("item"), F.col(item_text).cast("string").alias("text"))
                  .mapInArrow(item_rows(k, n), f"item {item_kind}, level int, kind int, key long, size long"), "decon-items")
    levels = sorted(r[0] for r in own.select("level").distinct().collect())        # one for each power of two
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    src = docs.select(F.col(key).alias("doc"), F.xxhash64(body).alias("digest"), body.alias("text"))
    bands, marks = sc.broadcast(bitmap(own.filter("kind = 0"), "key")), sc.broadcast(bitmap(own.filter("kind = 1"), "key"))
    short = own.filter((F.col("kind") == 1) & (F.col("size") <= SHORT))
    shorts = None if short.isEmpty() else sc.broadcast(bitmap(short, "key"))
    found = written(src.mapInArrow(document_rows(k, n, levels, bands, marks, shorts), f"doc {kind}, digest long, kind int, key long"), "decon-found")
    candidate = (found.filter("kind = 0").join(own.filter("kind = 0").select("item", "key", "size"), "key")
                 .select("doc", "digest", "item", "size").distinct())
    shingle = found.filter("kind = 1").select("doc", "digest", "key").distinct()
    exact = (shingle.join(own.filter("kind = 1").select("item", "key", "size").distinct(), "key")
             .groupBy("doc", "digest", "item", "size").agg(F.count("*").alias("n_found")))
    exact = exact.filter(100 * F.col("n_found") >= per_100 * F.col("size"))
    c = candidate.select(*[F.col(x).alias(f"c_{x}") for x in ("doc", "digest", "item")])
    same = F.col("doc").eqNullSafe(F.col("c_doc")) & (F.col("digest") == F.col("c_digest")) & F.col("item").eqNullSafe(F.col("c_item"))
    return exact.join(c, same, "left_semi").select("doc", "digest", "item", F.col("size").alias("n_shingles"), "n_found")


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no item, all their columns kept."""
    hit = search(docs, items, key, text, **how).select(F.col("doc").alias("__doc"), F.col("digest").alias("__digest")).distinct()
    digest = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.join(hit, docs[key].eqNullSafe(hit["__doc"]) & (digest == hit["__digest"]), "left_anti")


ORACLE = f"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-/:-`{{-\\x7F]+'), lambda x: x <> '') AS words FROM documents
           UNION ALL
           SELECT 'i', item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-/:-`{{-\\x7F]+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT DISTINCT side, id, array_to_string(words[i:i + {K - 1}], ' ') AS shingle
      FROM (SELECT side, id, words, unnest(generate_series(1, greatest(len(words) - {K - 1}, 1))) AS i FROM w WHERE len(words) > 0)),
z AS (SELECT id AS item_id, count(*) AS n_shingles FROM s WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, CAST(any_value(n_shingles) AS BIGINT) AS n_shingles, CAST(count(*) AS BIGINT) AS n_found
FROM s d JOIN s i ON d.side = 'd' AND i.side = 'i' AND d.shingle = i.shingle JOIN z ON z.item_id = i.id
GROUP BY d.id, i.id HAVING 100 * count(*) >= {PER_100} * any_value(n_shingles)
"""


@query("op3_decontaminate", ORACLE)
def op3(spark, sf_dir: str) -> DataFrame:
    pairs = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_found")
