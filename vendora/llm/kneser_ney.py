"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is learned from trusted text (documents labelled good).  Its units are the
bytes of the text, each a symbol of its own, and the text's edge; its order is
``ORDER``.  Each document gets the perplexity of its whole text; it is kept
if that is at most its language's threshold, the ``QUANTILE`` of the trusted
documents of the language (of all trusted documents where a language has none).

Counts are sharded by n-gram and grow with the corpus: no task and no driver holds
them all.  Each task adds up the trusted texts it reads; two bitmaps tell it which they
are, and only texts they leave in doubt are shuffled to be joined.  Then n-grams meet in buckets by the two
symbols before their last, where all longer contexts of an n-gram are whole: a bucket
has the continuation counts, totals and interpolation weights of orders 3 and up.
Only orders 1 and 2 (at most 257 * 257 numbers) and the discounts are sent to every
task.  Documents go in blocks that ask the buckets for the n-grams lm_blocks) and get a log probability for each; texts travel to their blocks compressed.

Quantiles are exact on a grid of 1/1000 of log10 perplexity, from counts by
language and grid cell.

Cases: null and empty texts are the edge symbol alone and never kept; a null
language has its own threshold; rows of a document labelled both good and bad are
trusted; without trusted text every symbol is equally likely; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendora.llm import textgrid as tg
from vendora.llm.bits import MOST, bitmap, hits
from vendora.llm.lm_blocks import BLOCK, Slots, count_distinct, n_buckets
from vendora.llm.registry import query, table, written

ORDER = 6
SIZE = 257
EDGE = 256
WIDTH = 9                  # bits of a symbol
LOW = 2                    # orders known to every task
QUANTILE = 0.995
GRID = 1000
SPREAD = 2654435761        # multiplier that spreads neighbouring contexts over the buckets
HELD = 1 << 22             # n-grams a task adds up before it sends them on
READ = 4                   # blocks' worth of text that a task reads to add up the trusted part
FOLD = np.arange(256)      # symbol of each byte


def _mask(order: int) -> int:
    return (1 << (WIDTH * order)) - 1


def codes(col) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram code of each symbol, row pointer); each row ends with the edge symbol
    and starts after edges."""
    data, offs = tg.text_bytes(col)
    n = len(offs) - 1
    ptr = offs + np.arange(n + 1)
    sym = np.full(int(ptr[-1]), EDGE, np.int64)
    inside = np.ones(len(sym), bool)
    inside[ptr[1:] - 1] = False
    sym[inside] = FOLD[data]
    place = np.arange(len(sym)) - np.repeat(ptr[:-1], np.diff(ptr))
    code = sym.copy()
    for k in range(1, ORDER):
        prev = np.full(len(sym), EDGE, np.int64)
        prev[k:] = sym[:len(sym) - k]
        prev[place < k] = EDGE
        code |= prev << (WIDTH * k)
    return code, ptr


def count_grams(batches):
    """(gram, n) of a task's texts, each gram a few times at most."""
    keys, counts, size = [], [], 0
    for batch in batches:
        for part in tg.slices(batch):
            k, c = np.unique(codes(part.column(0))[0], return_counts=True)
            keys.append(k)
            counts.append(c)
            size += len(k)
            if size > HELD:
                k, c = count_distinct(keys, counts)
                keys, counts, size = [k], [c], len(k)
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["gram", "n"])
                    keys, counts, size = [], [], 0
    k, c = count_distinct(keys, counts)
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["gram", "n"])


def shifted(ident):
    """Other bits of an id's hash for the second bitmap; of a NumPy array or a column."""
    return ident >> 32 if isinstance(ident, np.ndarray) else F.shiftright(ident, 32)


def of_trusted(src: DataFrame, trusted: DataFrame, step, out: str, tasks: int, most: int = MOST) -> list[DataFrame]:
    """``step`` (batches of text in, rows of ``out`` out; in ``tasks`` tasks) over the texts of ``src``
    (key, text) whose key is in ``trusted``: over those that two bitmaps are sure of, in the tasks that read
    them, and over the rest, found by a join, if there are any.

    The first bitmap holds the trusted keys, the second the other keys that the first one lets
    pass (only keys are shuffled for it).  A key in the first and not in the second is trusted."""
    spark = src.sparkSession
    ident = F.xxhash64(F.col("key").cast("string"))
    trusted = trusted.filter("key IS NOT NULL")
    known = bitmap(trusted.select(ident.alias("ident")), "ident", most)
    first = spark.sparkContext.broadcast(known)

    def passing(batches):
        for batch in batches:
            keep = hits(first.value, np.asarray(batch.column(0)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns], names=batch.schema.names)

    kind = src.schema["key"].dataType.simpleString()
    let_in = src.select(ident.alias("ident"), "key").mapInArrow(passing, f"ident long, key {kind}")
    others = let_in.join(trusted.hint("merge"), "key", "left_anti").select(shifted(F.col("ident")).alias("ident"))
    doubt = bitmap(others, "ident", most)
    second = spark.sparkContext.broadcast(doubt)

    def rows(sure: bool):
        def run(batches):
            for batch in batches:
                at = np.asarray(batch.column(0))
                keep = hits(first.value, at) & (hits(second.value, shifted(at)) != sure)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[1:]], names=batch.schema.names[1:])
        return run

    sure = rows(True)
    certain = src.select(ident.alias("ident"), "text").coalesce(tasks).mapInArrow(lambda batches: step(sure(batches)), out)
    if not doubt.any():
        return [certain]
    rest = src.select(ident.alias("ident"), "key", "text").mapInArrow(rows(False), f"key {kind}, text string")
    return [certain, rest.join(trusted.hint("merge"), "key", "left_semi").select("text").coalesce(tasks).mapInArrow(step, out)]


def _bucket(gram, n: int):
    """Bucket of grams by the two symbols before the last; of a NumPy array or a column."""
    if isinstance(gram, np.ndarray):
        return ((gram >> WIDTH & _mask(2)) * SPREAD >> 13) % n
    return F.shiftright(F.shiftright(gram, WIDTH).bitwiseAND(_mask(2)) * SPREAD, 13) % n


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """The three discounts of an order from how many n-grams occur 1 to 4 times."""
    if not (n1 and n2):
        return [0.5, 0.75, 0.9]                         # too few n-grams to estimate from
    y = n1 / (n1 + 2 * n2)
    return [max(0.0, 1 - 2 * y * n2 / n1), max(0.0, 2 - 3 * y * n3 / n2), max(0.0, 3 - 4 * y * (n4 / n3 if n3 else 0))]


def _orders(gram: np.ndarray, n: np.ndarray) -> dict:
    """order -> (codes, counts) of a bucket: occurrences at the top, below in how many different longer n-grams."""
    out = {ORDER: count_distinct([gram], [n])}
    for k in range(ORDER - 1, LOW, -1):
        longer = out[k + 1][0] & _mask(k)
        out[k] = count_distinct([longer], [np.ones(len(longer), np.int64)])
    return out


def _numpy(column) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False) if isinstance(column, pa.ChunkedArray) else column.to_numpy()


def bucket_stats(tab):
    """How many n-grams of each order from 3 occur 1 to 4 times (``gram`` is that number), and in
    how many different longer ones each of order 2 occurs."""
    levels = _orders(_numpy(tab.column("gram")), _numpy(tab.column("n")))
    order, gram, n = [], [], []
    for k, (_, c) in levels.items():
        order.append(np.full(4, k))
        gram.append(np.arange(1, 5))
        n.append(np.bincount(np.minimum(c, 5), minlength=6)[1:5])
    two, c = count_distinct([levels[LOW + 1][0] & _mask(LOW)], [np.ones(len(levels[LOW + 1][0]), np.int64)])
    order.append(np.full(len(two), LOW))
    return pa.table({"gram_order": pa.array(np.concatenate([*order]).astype(np.int32)), "gram": pa.array(np.concatenate([*gram, two]).astype(np.int64)),
                     "n": pa.array(np.concatenate([*n, c]).astype(np.int64))})


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Value of each wanted key, 0 where it is missing; ``keys`` sorted."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _refine(p: np.ndarray, code: np.ndarray, gram: np.ndarray, n: np.ndarray, cuts: list[float]) -> np.ndarray:
    """Probabilities of an order from those of the order below, for the n-grams ``code`` of this order."""
    cut = np.asarray(cuts)[np.minimum(n, 3) - 1]
    context, total = count_distinct([gram >> WIDTH], [n])
    mass = np.bincount(np.searchsorted(context, gram >> WIDTH), cut, len(context))
    all_n = _look(context, total, code >> WIDTH)
    own = _look(gram, n - cut, code)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(all_n > 0, (own + _look(context, mass, code >> WIDTH) * p) / all_n, p)


def low_orders(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Probability of order 2 by code, from the counts of order 2."""
    code = np.arange(1 << (WIDTH * LOW))
    by_order = {2: count_distinct([gram], [n])}
    by_order[1] = count_distinct([gram & _mask(1)], [np.ones(len(gram), np.int64)])
    p = np.full(len(code), 1.0 / SIZE)
    for k in (1, 2):
        g, c = by_order[k]
        if len(g):
            p = _refine(p, code & _mask(k), g, c, discounts(*(float((c == j).sum()) for j in (1, 2, 3, 4))))
    return p


def train(grams: DataFrame, n: int) -> tuple[DataFrame, np.ndarray, dict]:
    """Counts of the top order by bucket, order 2's probabilities, and the discounts of the orders above,
    from the tasks' counts (gram, n)."""
    top = grams.groupBy("gram").agg(F.sum("n").alias("n"))
    top = written(top.select(_bucket(F.col("gram"), n).cast("int").alias("bucket"), "gram", "n"), "kn-counts")
    # at most 257 * 257 rows and four for each order
    got = (top.groupBy("bucket").applyInArrow(bucket_stats, "gram_order int, gram long, n long")
           .groupBy("gram_order", "gram").agg(F.sum("n").alias("n")).toArrow())
    order, gram, count = (got.column(c).to_numpy() for c in ("gram_order", "gram", "n"))
    cuts = {}
    for k in range(LOW + 1, ORDER + 1):
        seen = {int(g): float(c) for g, c in zip(gram[order == k], count[order == k])}
        cuts[k] = discounts(*(seen.get(j, 0.0) for j in (1, 2, 3, 4)))
    return top, low_orders(gram[order == LOW], count[order == LOW]), cuts


def packed(batches):
    """(block, key, lang, size, text): texts compressed one by one, with their bytes before."""
    codec = pa.Codec("zstd")
    for batch in batches:
        texts = [t.as_buffer() for t in batch.column("text").cast(pa.binary())]
        size, small = [t.size for t in texts], [codec.compress(t, asbytes=True) for t in texts]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "key", "lang")), pa.array(size, pa.int64()), pa.array(small, pa.binary())],
                                         names=["block", "key", "lang", "size", "text"])


def unpacked(tab):
    """Row slices of ``packed`` rows with their texts, near textgrid's SLICE bytes each (one row at least)."""
    codec = pa.Codec("zstd")
    ends = np.cumsum(_numpy(tab.column("size")))
    lo, base = 0, 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, base + tg.SLICE, "right")))
        part = tab.slice(lo, hi - lo)
        texts = [codec.decompress(t.as_buffer(), n, asbytes=True) if n else b""
                 for t, n in zip(part.column("text"), part.column("size").to_pylist())]
        yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()).cast(pa.large_string()))
        lo, base = hi, int(ends[hi - 1])


def block_grams(tab, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's different n-grams and their buckets, by bucket and n-gram."""
    pieces = [np.unique(codes(part.column("text"))[0]) for part in unpacked(tab.select(["size", "text"]))]
    k, _ = count_distinct(pieces, [np.zeros(len(x), np.int64) for x in pieces])
    bucket = _bucket(k, n)
    at = np.lexsort((k, bucket))
    return k[at], bucket[at]


def _lists(arrays: list, kind):
    ptr = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ptr), pa.array(np.concatenate(arrays).astype(kind) if arrays else np.zeros(0, kind)))


def ask(n: int):
    """A block's n-grams, one row for each bucket."""

    def run(key, tab):
        k, bucket = block_grams(tab, n)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        return pa.table({"bucket": pa.array(bucket[cut].astype(np.int32)), "block": pa.array(np.full(len(cut), key[0].as_py(), np.int32)),
                         "grams": _lists(np.split(k, cut[1:]), np.int64)})
    return run


def answer(model):
    """All blocks' rows of a bucket and the bucket's counts in; for each block the log10 probabilities
    of its n-grams' last symbols out, in the order it asked."""

    def run(key, asked, counts):
        low, cuts = model.value
        grams = asked.column("grams").combine_chunks()
        grams = grams.chunk(0) if isinstance(grams, pa.ChunkedArray) else grams
        ptr = np.asarray(grams.offsets) - grams.offsets[0].as_py() if len(grams) else np.zeros(1, int)
        code, back = np.unique(np.asarray(grams.flatten()), return_inverse=True)
        levels = _orders(_numpy(counts.column("gram")), _numpy(counts.column("n")))
        p = low[code & _mask(LOW)]
        for k in range(LOW + 1, ORDER + 1):
            if len(levels[k][0]):
                p = _refine(p, code & _mask(k), *levels[k], cuts[k])
        logs = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(np.log10(p)[back].astype(np.float32)))
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "logs": logs})
    return run


def score_block(n: int):
    """A block's documents and the answers to it in, their log probabilities out."""

    def run(key, docs, answers):
        k, _ = block_grams(docs, n)
        logs = _numpy(answers.sort_by("bucket").column("logs").combine_chunks().flatten())
        at = np.argsort(k)
        slots, logs = Slots(k[at]), logs[at].astype(np.float64)
        out = []
        for part in unpacked(docs):
            code, ptr = codes(part.column("text"))
            out.append(pa.table({"key": part.column("key"), "lang": part.column("lang"), "n_symbols": pa.array(np.diff(ptr)),
                                 "log_prob": pa.array(np.add.reduceat(logs[slots.find(code)], ptr[:-1]))}))
        return pa.concat_tables(out)
    return run


def score(src: DataFrame, trusted: DataFrame) -> DataFrame:
    """(key, lang, n_symbols, log_prob) of every row of (key, lang, text); ``trusted``: the keys to learn from."""
    total, rows = src.agg(F.sum(F.octet_length("text").cast("long")), F.count("*")).first()
    n_blocks = max(1, -(-((total or 0) + 64 * rows) // BLOCK))
    n = n_buckets(n_blocks)
    # a task adds up about a block of trusted text, the more the fewer n-grams leave it, and reads READ blocks at most
    tasks = max(1, -(-n_blocks * min(trusted.count(), rows) // max(rows, 1)), -(-n_blocks // READ))
    top, low, cuts = train(reduce(DataFrame.union, of_trusted(src, trusted, count_grams, "gram long, n long", tasks)), n)
    model = src.sparkSession.sparkContext.broadcast((low, cuts))
    block = F.pmod(F.xxhash64(F.col("key").cast("string"), "text"), F.lit(n_blocks)).cast("int")
    kind = src.schema["key"].dataType.simpleString()
    docs = src.select(block.alias("block"), "key", "lang", "text").mapInArrow(packed, f"block int, key {kind}, lang string, size long, text binary")
    asked = docs.groupBy("block").applyInArrow(ask(n), "bucket int, block int, grams array<long>")
    answers = (asked.groupBy("bucket").cogroup(top.groupBy("bucket"))
               .applyInArrow(answer(model), "block int, bucket int, logs array<float>"))
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score_block(n), f"key {kind}, lang string, n_symbols long, log_prob double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             quantile: float = QUANTILE) -> DataFrame:
    """(key, lang, n_symbols, log_prob, perplexity, threshold, kept) of every row."""
    trusted = labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("key")).distinct()
    src = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    scored = written(score(src, trusted), "kn-scores")
    scored = scored.withColumn("log_perplexity", -F.col("log_prob") / F.col("n_symbols"))
    cell = F.ceil(F.col("log_perplexity") * GRID)
    cells = scored.filter("n_symbols > 1").join(trusted, "key", "left_semi").groupBy("lang", cell.alias("cell")).agg(F.count("*").alias("n"))
    # a language has at most a few thousand cells
    up = F.sum("n").over(Window.partitionBy("lang").orderBy("cell")) / F.sum("n").over(Window.partitionBy("lang"))
    by_lang = cells.withColumn("up", up).filter(F.col("up") >= quantile).groupBy("lang").agg(F.min("cell").alias("cell"))
    every = cells.groupBy("cell").agg(F.sum("n").alias("n")).withColumn("lang", F.lit("all"))
    overall = every.withColumn("up", up).filter(F.col("up") >= quantile).agg(F.min("cell").alias("cell")).first()[0]
    limit = by_lang.select(F.col("lang").alias("limit_lang"), "cell")
    out = scored.join(limit, F.col("lang").eqNullSafe(F.col("limit_lang")), "left")
    out = out.withColumn("cell", F.coalesce("cell", F.lit(overall).cast("long"))).withColumn("threshold", F.col("cell") / GRID)
    kept = F.coalesce((F.col("n_symbols") > 1) & (cell <= F.col("cell")), F.lit(False))
    return out.select(F.col("key").alias(key), "lang", "n_symbols", "log_prob", F.pow(F.lit(10.0), "log_perplexity").alias("perplexity"),
                      F.pow(F.lit(10.0), "threshold").alias("threshold"), kept.alias("kept"))


@query("op5_kneser_ney")
def op5(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
