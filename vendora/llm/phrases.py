r"""Phrase collocations by prefix-free parsing.

Texts are read as words (A-Z lower-cased) in pieces: pieces end at ``[.,;:!?\x0A-\x0D]``, words at spaces and
tabs.  Everything is counted per language (null: ``und``).  A phrase has 1 to ``LONGEST`` words of one piece; phrases
of two words or more that occur ``MIN_COUNT`` times are candidates.  A candidate is scored at its weakest cut by
SCALE * a / (l + r): a, l and r are the counts of the phrase, of its first and of its last part.  Candidates that mostly
occur inside a longer one are dropped.

Parsing: a text is cut where a hash of three words in a row says so (one place in ``EVERY``), so equal
passages are cut alike wherever they stand.  A chunk goes from one such place to the next and keeps the three words of
the next place, its overlap; the last chunk of a text has none and ends in a line break.  Distinct chunks with their number of
occurrences are the dictionary; phrases are counted in each distinct chunk once, times that number.  A
phrase belongs to the chunk in which it starts outside the overlap, so each occurrence is counted once.  (``\n`` between
words of a chunk is the end of a piece.)

Counting: a phrase can't occur more often than its parts.  Words come first, then pairs of frequent words, then
phrases of three and four words whose pairs are all frequent.  The frequent ones of one step reach the next as a bitmap of
hashes, which lets through all that count and a few others; it is sized by their number, up to 64 MB.  When it is full it
spares less work and the results stay the same: counts are made on the phrases' own text.

Scale: chunks are pre-aggregated in the tasks, copies of a text (or of a passage) collapse in the dictionary,
phrases are summed in each batch and again before their shuffle.  Lookups of parts deal hot parts (a very
common word) into pieces; the ranking takes the best of 256 parts of a language before it orders the language.

Cases: null and empty texts have no words; repeated rows count as often as they occur; very long words and texts are
read whole; a language without candidates gives no rows; equal scores are ordered by count and then by phrase; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendora.llm import hot
from vendora.llm import textgrid as tg
from vendora.llm.bits import bitmap, hits
from vendora.llm.registry import query, table, written

LONGEST = 4
OVERLAP = LONGEST - 1
EVERY = 32                 # words of a chunk, on average
MIN_COUNT = 30
SCALE = 2_000_000
COVERED = 80               # per 100: a phrase that a longer one accounts for to this part goes
TOP = 2000
UNKNOWN = "und"
BITS = (16, 29)            # log2 of a bitmap's bits, least and most (64 MB)

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
CHUNK_GAP = np.zeros(256, bool)
CHUNK_GAP[[0x20, 0x0A]] = True


def _texts(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the runs (start, size) one after another, and their offsets."""
    offs = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offs[-1]) + np.repeat(start - offs[:-1], size)
    return data[at], offs


def _strings(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def _summed(lang, phrase, n) -> pa.Table:
    """Distinct (lang, phrase) with their summed weights, by their text."""
    rows = pa.table({"lang": lang, "phrase": phrase, "n": n})
    return rows.group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])


# --- parsing ----------------------------------------------------------------------------------------

def chunks(every: int):
    """(lang, chunk, n) of the texts (lang, text) of each batch, equal chunks summed."""

    def run(batches):
        for batch in batches:
            for part in tg.slices(batch):
                data, offs = tg.text_bytes(part.column(1))
                w = tg.Words(data, offs, gaps=GAP)
                m = len(w.start)
                if not m:
                    continue
                row = np.repeat(np.arange(len(offs) - 1), np.diff(w.ptr))
                last = np.append(row[1:] != row[:-1], True)
                breaks = np.concatenate([[0], np.cumsum(BREAK[data])])
                # the byte after each word of a chunk: is there a break before the next word?
                after = np.append(breaks[w.start[1:]] > breaks[w.end[:-1]], True) | last
                h = np.append(w.hash, np.zeros(2, np.uint64))
                place = tg.mix((h[:-2] * np.uint64(5) + h[1:-1]) * np.uint64(9) + h[2:])
                begins = (place % np.uint64(every) == 0) & (np.arange(m) + OVERLAP <= w.ptr[row + 1])
                begins |= np.append(True, last[:-1])
                first = np.flatnonzero(begins)
                end = np.append(first[1:], m)
                whole = last[end - 1]                              # chunks at the end of a text
                count = end - first + np.where(whole, 0, OVERLAP)
                base = np.concatenate([[0], np.cumsum(count)])
                word = np.arange(base[-1]) + np.repeat(first - base[:-1], count)
                out, at = _texts(np.append(w.data, np.uint8(0)), w.start[word], w.end[word] - w.start[word] + 1)
                out[at[1:] - 1] = np.where(after[word], 10, 32)
                # a chunk without an end of its text has no byte after its last word
                keep = np.ones(len(out), bool)
                keep[at[base[1:]] - 1] = whole
                ends = np.concatenate([[0], np.cumsum(keep)])[at[base]]
                lang = pc.cast(part.column(0), pa.large_string()).take(pa.array(row[first]))
                got = _summed(lang, _strings(out[keep], ends), pa.array(np.ones(len(first), np.int64)))
                yield from got.rename_columns(["lang", "chunk", "n"]).cast(CHUNKS).combine_chunks().to_batches()
    return run


CHUNKS = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("n", pa.int64())])
PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("n", pa.int64())])


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", every: int = EVERY) -> DataFrame:
    """(lang, chunk, n): distinct chunks with their number of occurrences."""
    src = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    rows = src.mapInArrow(chunks(every), "lang string, chunk string, n long")
    return rows.groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


# --- counting ---------------------------------------------------------------------------------------

def _lang_hashes(lang) -> np.ndarray:
    codes = pc.dictionary_encode(lang)
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    each = np.array([zlib.crc32(x.encode()) for x in codes.dictionary.to_pylist()], np.uint64)
    return each[np.asarray(codes.indices)]


def _keys(h: np.ndarray, lang: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each word on (those that go past the end mean nothing)."""
    out = lang * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
    for j in range(k):
        out = tg.mix(out * np.uint64(3) + np.append(h[j:], np.zeros(min(j, len(h)), np.uint64)))
    return out


def phrases(lengths: list[int], known: int = 0, bits=None):
    """(lang, phrase, k, n) of the chunks' phrases of the given lengths, summed in each batch; with ``bits`` those whose
    parts of ``known`` words may all be in the bitmap."""

    def run(batches):
        for batch in batches:
            for part in tg.slices(batch, "chunk"):
                data, offs = tg.text_bytes(part.column(1))
                w = tg.Words(data, offs, lower=False, gaps=CHUNK_GAP)
                m = len(w.start)
                row = np.repeat(np.arange(len(offs) - 1), np.diff(w.ptr))
                ended = data[offs[1:] - 1] == 10
                own = np.arange(m) < (w.ptr[1:] - np.where(ended, 0, OVERLAP))[row]
                # does the word end its piece or its chunk?
                stop = np.append(data, np.uint8(10))[w.end] == 10
                stop[w.ptr[1:] - 1] = True
                weight = np.asarray(part.column(2))
                may = hits(bits.value, _keys(w.hash, _lang_hashes(part.column(0))[row], known)) if bits is not None else np.ones(m, bool)
                for k in lengths:
                    at = np.flatnonzero(own)
                    at = at[at + k <= m]
                    for j in range(k - 1):
                        at = at[~stop[at + j]]
                    if bits is not None:
                        for j in range(k - known + 1):
                            at = at[may[at + j]]
                    if not len(at):
                        continue
                    text = _strings(*_texts(data, w.start[at], w.end[at + k - 1] - w.start[at]))
                    lang = part.column(0).take(pa.array(row[at]))
                    got = _summed(lang, text, pa.array(weight[row[at]]))
                    got = pa.table([got.column(0), got.column(1), pa.array(np.full(len(got), k, np.int32)), got.column(2)], names=PHRASES.names)
                    yield from got.cast(PHRASES).combine_chunks().to_batches()
    return run


def _key_rows(k: int):
    def run(batches):
        for batch in batches:
            w = tg.words_of(batch.column(1), lower=False, gaps=CHUNK_GAP)
            row = np.repeat(np.arange(batch.num_rows), np.diff(w.ptr))
            key = _keys(w.hash, _lang_hashes(batch.column(0))[row], k)[w.ptr[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(tg.signed(key))], names=["key"])
    return run


def _bits(often: DataFrame, k: int):
    """Bitmap of the phrases of k words in ``often``, about 16 bits for each."""
    keys = written(often.filter(F.col("k") == k).select("lang", "phrase").mapInArrow(_key_rows(k), "key long"), "phrase-keys")
    size = min(max(BITS[0], (16 * keys.count()).bit_length()), BITS[1])
    return often.sparkSession.sparkContext.broadcast(bitmap(keys, "key", size))


def counts(chunk_rows: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of the phrases with f >= min_count, and (lang, n) with all word occurrences."""
    kind = "lang string, phrase string, k int, n long"

    def often(lengths, known=0, bits=None):
        rows = chunk_rows.mapInArrow(phrases(lengths, known, bits), kind)
        return rows.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("f"))

    words = written(often([1]), "phrase-words")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    one = words.filter(F.col("f") >= min_count)
    bits = _bits(one, 1)
    two = written(often([2], 1, bits).filter(F.col("f") >= min_count), "phrase-pairs")
    bits.unpersist()
    bits = _bits(two, 2)
    more = written(often([3, 4], 2, bits).filter(F.col("f") >= min_count), "phrase-longer")
    bits.unpersist()
    return one.unionByName(two).unionByName(more), total


# --- scores -----------------------------------------------------------------------------------------

def scored(often: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of each phrase of two words or more at its weakest cut."""
    cand = often.filter("k > 1").withColumnRenamed("f", "a")
    cuts = cand.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = cuts.select("*", F.explode(F.array(
        F.struct(F.lit(True).alias("head"), F.expr("substring_index(phrase, ' ', cut)").alias("part")),
        F.struct(F.lit(False).alias("head"), F.expr("substring_index(phrase, ' ', cut - k)").alias("part")))).alias("s"))
    # a language may hold any characters, so its length goes before it
    name = lambda part: F.concat(F.length("lang").cast("string"), F.lit(":"), F.col("lang"), part)
    sides = written(sides.select("lang", "phrase", "k", "a", "cut", "s.head", name(F.col("s.part")).alias("part")), "phrase-parts")
    asked = sides.groupBy("part").agg(F.count("*").alias("asked"))
    answers = often.select(name(F.col("phrase")).alias("part"), "f").join(asked, "part")
    both = hot.left_join(sides, answers, "part", "asked", sides.count(), ["phrase", "cut"])
    both = both.groupBy("lang", "phrase", "k", "a", "cut").agg(F.max(F.when(F.col("head"), F.col("f"))).alias("l"),
                                                               F.max(F.when(~F.col("head"), F.col("f"))).alias("r"))
    score = F.expr(f"CAST(a AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(10, 0)) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    weakest = both.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("w"))
    return weakest.select("lang", "phrase", "k", "a", "w.l", "w.r", F.col("w.score").cast("long").alias("score"))


def not_covered(cand: DataFrame, often: DataFrame, covered: int = COVERED) -> DataFrame:
    """The candidates that no longer phrase accounts for."""
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), "
                   "s -> array_join(slice(split(phrase, ' '), s, m), ' '))))")
    longer = often.filter("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    out = cand.join(longer, ["lang", "phrase"], "left")
    return out.filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, covered: int = COVERED,
                 top: int = TOP, every: int = EVERY) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    chunk_rows = written(dictionary(docs, text, lang, every), "phrase-chunks")
    often, total = counts(chunk_rows, min_count)
    best = not_covered(scored(often), often, covered)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each part hold the first of all
    part = F.pmod(F.xxhash64("phrase"), F.lit(256))
    best = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = best.filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""
WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS body FROM documents),
p AS (SELECT lang, unnest(string_split_regex(body, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
      FROM w, range(1, {LONGEST + 1}) AS r(k)),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM g GROUP BY lang, phrase),
t AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {MIN_COUNT}),
s AS (SELECT c.lang, c.phrase, k_, a, ws, l.f AS l, r.f AS r, (a::HUGEINT * {SCALE}) // (l.f + r.f) AS score
      FROM (SELECT *, unnest(range(1, k)) AS k_ FROM c) c
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k_], ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k_ + 1:], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k_) = 1),
o AS (SELECT * FROM m WHERE NOT EXISTS (
        SELECT 1 FROM c WHERE c.lang = m.lang AND c.k > len(m.ws) AND contains(' ' || c.phrase || ' ', ' ' || m.phrase || ' ') AND 100 * c.a >= {COVERED} * m.a))
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) JOIN t USING (lang) WHERE rank <= {TOP}
"""


@query("op13_phrases", ORACLE)
def op13(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))
