"""Document log probabilities by prediction by partial matching.

The model is a byte-context trie of order ``ORDER``: for each context the bytes
that followed it in the training texts.  A byte is coded in the longest known
context; if it was not seen there the model escapes to the context one byte
shorter, where the bytes already ruled out no longer count (symbol exclusion).
Escapes follow method D: a context with T symbols seen, D of them different,
gives (2n - 1) / 2T to a symbol seen n times and D / 2T to the escape.  Below
order 0 the bytes not yet ruled out share the rest evenly.

Counts are fixed by the training texts (pretrained code length).  Since every
byte seen after a context is also seen after its shorter forms, what an escape
rules out is what was seen in the longer context, so each trie node's totals
after exclusion can be computed once, with joins over the counts.

A text is read as its words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) with one
space between and one end symbol, so that the score is comparable with the
word-based base score.

Scale: the trie grows with the corpus and is never held whole.  Documents go in
blocks that ask for the grams and words they hold (see lm_blocks).  Grams meet in
buckets by the two symbols before their last, where all longer contexts of a gram
are whole; only the order 0 and 1 counts (at most 258 * 257 rows) are sent to
every task.  Disk: the texts are dealt to blocks twice, the keys move once.

Cases: null and empty texts are one end symbol; repeated rows score alike; an
empty table gives an empty result; without training texts every symbol has
probability 1/257.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm import textgrid as tg
from vendora.llm.lm_blocks import Slots, count_distinct, in_blocks, n_buckets
from vendora.llm.registry import query, table, written

ORDER = 5                  # bytes of context
WIDTH = 9                  # bits of a symbol: 256 bytes, the end, the start
END, START = 256, 257
MASK = (1 << WIDTH) - 1
GRAM, WORD = 0, 1
END_WORD = 0               # no word has this key


def held_out(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 10 == 0


def symbols(words: tg.Words) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, row pointer): the words of each row with one space between, then the end."""
    n_rows = len(words.ptr) - 1
    n_words = np.diff(words.ptr)
    size = words.end - words.start
    row_of = np.repeat(np.arange(n_rows), n_words)
    empty = n_words == 0
    before = np.cumsum(empty) - empty                       # rows without words so far, each one symbol
    at = np.cumsum(size + 1) - (size + 1) + before[row_of]  # place of each word
    total = int((size + 1).sum() + empty.sum())
    out = np.full(total, 32, np.int64)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + within] = words.data[np.repeat(words.start, size) + within]
    length = np.bincount(row_of, size + 1, n_rows).astype(np.int64) + empty
    ptr = np.concatenate([[0], np.cumsum(length)])
    out[ptr[1:] - 1] = END
    return out, ptr


def grams(sym: np.ndarray, ptr: np.ndarray, order: int) -> np.ndarray:
    """For each symbol a code of it (lowest bits) and the ``order`` symbols before it in its row."""
    place = np.arange(len(sym)) - np.repeat(ptr[:-1], np.diff(ptr))
    code = sym.copy()
    for k in range(1, order + 1):
        prev = np.full(len(sym), START, np.int64)
        prev[k:] = sym[:len(sym) - k]
        prev[place < k] = START
        code |= prev << (WIDTH * k)
    return code


def _slices(tab):
    return tg.slices(tab.select(["key", "text", "train"]))


def _flags(col) -> np.ndarray:
    return np.asarray(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).astype(bool)


def _word_keys(words: tg.Words) -> np.ndarray:
    k = tg.signed(words.hash)
    return np.where(k == END_WORD, 1, k)


def _bucket(kind: int, keys: np.ndarray, n: int) -> np.ndarray:
    """Grams with the same two symbols before the last go together; words by themselves."""
    near = keys >> WIDTH & ((1 << (2 * WIDTH)) - 1) if kind == GRAM else keys
    return (tg.mix(near.astype(np.uint64)) % np.uint64(n)).astype(np.int64) + kind * n


def _dealt(keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Order of a block's keys: by bucket, by key within it."""
    return np.lexsort((keys, bucket))


def block_keys(tab, order: int, n: int) -> dict:
    """kind -> (keys, buckets, counts in training texts), in the order they are asked."""
    found: dict = {GRAM: ([], []), WORD: ([], [])}
    for part in _slices(tab):
        train = _flags(part.column("train"))
        words = tg.words_of(part.column("text"))
        sym, ptr = symbols(words)
        for kind, keys, rows in ((GRAM, grams(sym, ptr, order), np.diff(ptr)), (WORD, _word_keys(words), np.diff(words.ptr))):
            used = np.repeat(train, rows)
            for chosen, one in ((keys[used], 1), (keys[~used], 0)):
                if len(chosen):
                    k, c = np.unique(chosen, return_counts=True)
                    found[kind][0].append(k)
                    found[kind][1].append(c * one)
    out = {}
    for kind, pieces in found.items():
        k, c = count_distinct(*pieces)
        bucket = _bucket(kind, k, n)
        at = _dealt(k, bucket)
        out[kind] = (k[at], bucket[at], c[at])
    return out


def ask(order: int, n: int):
    """A block's keys and training counts, one row for each bucket."""

    def run(key, tab):
        rows: dict = {"bucket": [], "block": [], "keys": [], "counts": []}
        for k, bucket, c in block_keys(tab, order, n).values():
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(k) else np.zeros(0, int)
            for lo, hi in zip(first, np.append(first[1:], len(k))):
                rows["bucket"].append(int(bucket[lo]))
                rows["block"].append(key[0].as_py())
                rows["keys"].append(k[lo:hi])
                rows["counts"].append(c[lo:hi])
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "block": pa.array(rows["block"], pa.int32()),
                         "keys": _lists(rows["keys"], np.int64), "counts": _lists(rows["counts"], np.int64)})
    return run


def _lists(arrays: list, kind):
    ptr = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ptr), pa.array(np.concatenate(arrays).astype(kind) if arrays else np.zeros(0, kind)))


ASK = "bucket int, block int, keys array<long>, counts array<long>"
ANSWER = "bucket int, block int, logs array<float>, counts array<long>, n_known long"


def low_counts(batches):
    """Counts of (symbol before, symbol) pairs and of tokens in the training texts, one
    row for each pair of a task; the tokens under -1."""
    total = np.zeros(1 << (2 * WIDTH), np.int64)
    tokens = 0
    for batch in batches:
        for part in _slices(pa.table(batch)):
            part = part.filter(part.column("train"))
            if part.num_rows:
                words = tg.words_of(part.column("text"))
                sym, ptr = symbols(words)
                total += np.bincount(grams(sym, ptr, 1), minlength=len(total))
                tokens += len(words.hash) + part.num_rows
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1).astype(np.int64)), pa.array(np.append(total[seen], tokens))], names=["gram", "n"])


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return count_distinct([keys], [values])


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Value of each wanted key, 0 where it is missing; ``keys`` sorted."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class Level:
    """Trie nodes of one order: counts of (context, symbol), and each context's totals."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.code, self.n = code, n
        self.context, self.total = _grouped(code >> WIDTH, n)
        _, self.different = _grouped(code >> WIDTH, np.ones(len(n), np.int64))


def log_probability(code: np.ndarray, order: int, levels: list) -> np.ndarray:
    """log10 probability of each gram's last symbol; ``levels[k]`` is order k."""
    out = np.zeros(len(code))
    todo = np.ones(len(code), bool)
    ruled_t = np.zeros(len(code), np.int64)     # occurrences, here, of symbols seen in the longer context
    ruled_d = np.zeros(len(code), np.int64)
    for k in range(order, -1, -1):
        lv = levels[k]
        here = code & ((1 << (WIDTH * (k + 1))) - 1)
        t_all, d_all = _look(lv.context, lv.total, here >> WIDTH), _look(lv.context, lv.different, here >> WIDTH)
        n = _look(lv.code, lv.n, here)
        t, d = t_all - ruled_t, d_all - ruled_d
        found = todo & (n > 0)
        out[found] += np.log10((2 * n[found] - 1) / (2 * t[found]))
        escape = todo & (n == 0) & (t > 0)
        out[escape] += np.log10(d[escape] / (2 * t[escape]))
        todo &= n == 0
        if k:
            # in the next shorter context, how often do the symbols seen here occur?
            shorter = _look(levels[k - 1].code, levels[k - 1].n, lv.code & ((1 << (WIDTH * k)) - 1))
            context, ruled = _grouped(lv.code >> WIDTH, shorter)
            ruled_t = _look(context, ruled, here >> WIDTH)
            ruled_d = d_all
        else:
            out[todo] -= np.log10(257 - d_all[todo])
    return out


def answer(order: int, n: int, low):
    """All blocks' rows of a bucket in; one row for each block out, its values in the
    order it asked.  ``low``: codes and counts of orders 0 and 1."""

    def run(key, tab):
        tab = tab.combine_chunks()
        keys, counts = (tab.column(c).chunk(0) for c in ("keys", "counts"))
        ptr = np.asarray(keys.offsets) - keys.offsets[0].as_py()
        distinct, back = np.unique(np.asarray(keys.flatten()), return_inverse=True)
        total = np.bincount(back, np.asarray(counts.flatten()), len(distinct)).astype(np.int64)
        rows = tab.num_rows
        if key[0].as_py() < n:
            levels: list = [Level(*low.value[k]) for k in range(2)]
            for k in range(2, order + 1):
                c, m = _grouped(distinct & ((1 << (WIDTH * (k + 1))) - 1), total)
                levels.append(Level(c[m > 0], m[m > 0]))
            value = log_probability(distinct, order, levels)
            logs = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(value[back].astype(np.float32)))
            sums, known = pa.nulls(rows, pa.list_(pa.int64())), 0
        else:
            logs = pa.nulls(rows, pa.list_(pa.float32()))
            sums, known = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(total[back])), int((total > 0).sum())
        # the number of distinct training words of the bucket stands in one of its rows
        return pa.table({"bucket": tab.column("bucket"), "block": tab.column("block"), "logs": logs, "counts": sums,
                         "n_known": pa.array(np.append(known, np.zeros(rows - 1, np.int64)))})
    return run


def score_block(order: int, n: int, base):
    """A block's documents and the answers to it in, scores out."""

    def run(key, docs, answers):
        n_all, v_all, n_ends = base.value
        answers = answers.sort_by("bucket").combine_chunks() if answers.num_rows else answers
        mine = block_keys(docs, order, n)
        value = {kind: np.asarray(answers.column(c).combine_chunks().flatten()) if answers.num_rows else np.zeros(0)
                 for kind, c in ((GRAM, "logs"), (WORD, "counts"))}
        got = {}
        for kind, (k, _, _) in mine.items():
            at = np.argsort(k)
            got[kind] = (Slots(k[at]), value[kind][at].astype(np.float64))
        rate = lambda c: np.log10((c + 0.1) / (n_all + 0.1 * (v_all + 1)))
        out = []
        for part in _slices(docs):
            rows = part.num_rows
            words = tg.words_of(part.column("text"))
            sym, ptr = symbols(words)
            slots, logs = got[GRAM]
            score = np.add.reduceat(logs[slots.find(grams(sym, ptr, order))], ptr[:-1])
            slots, counts = got[WORD]
            c = counts[slots.find(_word_keys(words))]
            row = np.repeat(np.arange(rows), np.diff(words.ptr))
            out.append(pa.table({
                "key": part.column("key"), "held_out": pa.array(~_flags(part.column("train"))),
                "n_tokens": pa.array(np.diff(words.ptr).astype(np.int64) + 1),
                "n_known": pa.array((np.bincount(row, c > 0, rows) + (n_ends > 0)).astype(np.int64)),
                "train_tokens": pa.array(np.full(rows, n_all, np.int64)),
                "base_score": pa.array(np.bincount(row, rate(c), rows) + rate(n_ends)),
                "score": pa.array(score)}))
        return pa.concat_tables(out)
    return run


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", train=None, order: int = ORDER) -> DataFrame:
    """Score every row; ``train``: a boolean column expression over ``key`` for the rows learned from."""
    if not 2 <= order <= 6:
        raise ValueError("order must be 2 to 6")
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = docs.schema[key].dataType.simpleString()
    train = F.coalesce(~held_out("key") if train is None else train, F.lit(True))
    n_blocks, src = in_blocks(docs, key, text)
    src = src.withColumn("train", train)
    n = n_buckets(n_blocks)
    # at most 258 * 257 rows
    rows = (src.select("key", "text", "train").mapInArrow(low_counts, "gram long, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")).toArrow().sort_by("gram"))
    code, count = rows.column("gram").to_numpy(), rows.column("n").to_numpy()
    n_all = int(count[code == -1].sum())
    code, count = code[code >= 0], count[code >= 0]
    one = _grouped(code & MASK, count)
    n_ends = int(_look(one[0], one[1], np.array([END]))[0])
    low = sc.broadcast([one, (code, count)])
    asked = src.groupBy("block").applyInArrow(ask(order, n), ASK)
    answers = written(asked.groupBy("bucket").applyInArrow(answer(order, n, low), ANSWER), "ppm-answers")
    v_all = (answers.agg(F.coalesce(F.sum("n_known"), F.lit(0))).first()[0]) + (n_ends > 0)
    base = sc.broadcast((n_all, int(v_all), n_ends))
    out = src.groupBy("block").cogroup(answers.select("block", "bucket", "logs", "counts").groupBy("block")).applyInArrow(
        score_block(order, n, base),
        f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)


@query("op9_ppm_score")
def op9(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
