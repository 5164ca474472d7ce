r"""Line dedup by a deletion-neighbourhood join.

A line (split at ``\n``) is the sequence of its words (runs of letters and digits,
A-Z lower-cased; in scripts without spaces each character is a word).  A line goes
if an earlier line (smaller document id, then smaller place) has the same words,
however few, or if both are long and one edit turns its words into the other's: one
word changed, put in or left out.  A long line has ``MIN_WORDS`` words or more, two
characters of a script without spaces counted as one.  Lines without a word stay.

Neighbourhood: every sequence that leaves out one word is hashed as a key.  Two
lines with one word changed share the key of that place and remainder; a line
with one word more shares its remainder with the whole of the other line.  Lines
join by equal keys, the earliest in a key is the witness of the others (all of
a key are one edit apart, so no pairs are listed), and each line is held against
its witness by its words before it goes.

Two lossless cuts come first: equal lines count once, and since one edit leaves
the first or the last half of the shorter line as it is, only long lines that
share a half with another line emit their variants.

Scale: shuffles carry hashes; equal lines are pre-aggregated; texts move once,
when the lines of a document are taken out.  The bitmap of lines that emit
variants has a fixed size; when it fills up more lines emit, none is lost.

Cases: null and empty texts stay as they are; rows with the same id and text are
one document (their lines are kept or removed alike); null ids come first; ties
are broken by id and place; an empty table gives an empty result.  A document
whose lines all went keeps an empty text (``all_removed``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm import textgrid as tg
from vendora.llm.bits import bitmap, hits, runs_of_many
from vendora.llm.registry import query, table, written

MIN_WORDS = 5              # of lines compared up to one edit; equal lines go at any length
STEP = 0xC2B2AE3D27D4EB4F  # odd: base of the hashes of word sequences
INVERSE = pow(STEP, -1, 1 << 64)


class Lines:
    """Lines of a slice with words: row, place in the row, first word, word count,
    which are long, and hashes of any run of their words."""

    def __init__(self, col, min_words: int):
        data, offs = tg.text_bytes(col)
        lone, end = tg.unspaced(data)
        self.words = tg.Words(data, offs, gaps=tg.NOT_ALNUM, cuts=np.concatenate([lone, end]))
        self.data, self.offs = data, offs
        breaks = np.flatnonzero(data == 10)
        before = np.searchsorted(breaks, offs[:-1])               # line breaks before each row
        of_word = np.searchsorted(breaks, self.words.start)
        row_of_word = np.repeat(np.arange(len(offs) - 1), np.diff(self.words.ptr))
        # lines of different rows differ: the row counts as a break too
        ident = of_word + row_of_word
        first = np.flatnonzero(np.append(True, ident[1:] != ident[:-1])) if len(ident) else np.zeros(0, int)
        self.first = first
        self.n = np.diff(np.append(first, len(ident)))
        halves = np.full(len(ident), 2)
        halves[np.searchsorted(self.words.start, lone)] = 1       # a character counts as half a word
        self.long = np.add.reduceat(halves, first) >= 2 * min_words if len(first) else np.zeros(0, bool)
        self.row = row_of_word[first]
        self.place = of_word[first] - before[self.row]
        h = self.words.hash
        self.power = np.cumprod(np.append(np.uint64(1), np.full(len(h), STEP & tg.M64, np.uint64)), dtype=np.uint64)
        self.inverse = np.cumprod(np.append(np.uint64(1), np.full(len(h), INVERSE, np.uint64)), dtype=np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum(h * self.power[:-1], dtype=np.uint64))
        # a line's own hash also adds each word mixed with its place: sums of powers alone are blind to some patterns
        place = np.arange(len(h)) - np.repeat(first, self.n)
        mixed = tg.mix(h ^ tg.mix(place.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
        self.ident = _key(self.run(first, first + self.n), self.n) ^ (np.add.reduceat(mixed, first) if len(first) else mixed)

    def run(self, a, b):
        """Hash of the words a..b (exclusive), free of where they stand."""
        return (self.sums[b] - self.sums[a]) * self.inverse[a]


def _key(h, *parts):
    for p in parts:
        h = tg.mix(h ^ (np.asarray(p).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return h


def line_rows(min_words: int):
    """One row for each line with a word: hash, document, place, and if it is long the
    hashes of its halves (two sizes, since the other line may be one word shorter)."""

    def run(batches):
        for batch in batches:
            for part in tg.slices(batch):
                L = Lines(part.column(part.schema.get_field_index("text")), min_words)
                a, n = L.first, L.n
                whole = L.ident
                m1, m2 = n // 2, (n - 1) // 2
                halves = [_key(L.run(a, a + m1), m1, 1), _key(L.run(a + n - m1, a + n), m1, 2),
                          _key(L.run(a, a + m2), m2, 1), _key(L.run(a + n - m2, a + n), m2, 2)]
                ids = pa.array(L.row)
                cols = [pa.array(tg.signed(whole)), part.column(0).take(ids), part.column(1).take(ids), pa.array(L.place.astype(np.int32)),
                        *[pa.array(tg.signed(x), mask=~L.long) for x in halves]]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols],
                                                 names=["line", "doc", "digest", "place", "h1", "h2", "h3", "h4"])
    return run


def variants(min_words: int, chosen):
    """Keys of the lines that may have a neighbour.

    role 0: the whole line; 1: the line with one word left out, to meet a whole line;
    2: the same with the place, to meet a line with another word there."""

    def run(batches):
        bits = chosen.value
        seen: set = set()
        names = ["key", "line", "role"]
        for batch in batches:
            for part in tg.slices(batch):
                L = Lines(part.column(part.schema.get_field_index("text")), min_words)
                a, n = L.first[L.long], L.n[L.long]
                whole = tg.signed(L.ident[L.long])
                new = []
                for i in np.flatnonzero(hits(bits, whole)).tolist():
                    if (x := int(whole[i])) not in seen:
                        seen.add(x)
                        new.append(i)
                if not new:
                    continue
                a, n, whole = a[new], n[new], whole[new]
                line = np.repeat(np.arange(len(new)), n)
                p = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                lo, hi = a[line], (a + n)[line]
                # the words before place p, and those after it moved one place forward
                rest = L.run(lo, lo + p) + (L.run(lo + p + 1, hi) * L.power[p])
                keys = [_key(L.run(a, a + n), n, 3), _key(rest, n[line] - 1, 3), _key(rest, n[line], p, 4)]
                # two places that leave the same words give one key
                keys[1], at = np.unique(keys[1] ^ tg.mix(whole.view(np.uint64))[line], return_index=True)
                keys[1] = keys[1] ^ tg.mix(whole.view(np.uint64))[line[at]]
                lines = [whole, whole[line[at]], whole[line]]
                k = np.concatenate(keys)
                yield pa.RecordBatch.from_arrays([pa.array(tg.signed(k)), pa.array(np.concatenate(lines)),
                                                  pa.array(np.repeat([0, 1, 2], [len(x) for x in keys]).astype(np.int32))], names=names)
    return run


def line_words(min_words: int, chosen):
    """(line, words) of the lines that the bitmap may hold, once for a task."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            for part in tg.slices(batch):
                L = Lines(part.column(part.schema.get_field_index("text")), min_words)
                a, n = L.first[L.long], L.n[L.long]
                whole = tg.signed(L.ident[L.long])
                new, text = [], []
                for i in np.flatnonzero(hits(chosen.value, whole)).tolist():
                    if (x := int(whole[i])) not in seen:
                        seen.add(x)
                        new.append(x)
                        text.append(" ".join(bytes(L.words.data[s:e]).decode("utf-8", "replace") for s, e in
                                             zip(L.words.start[a[i]:a[i] + n[i]], L.words.end[a[i]:a[i] + n[i]])))
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array(text, pa.string())], names=["line", "words"])
    return run


def one_edit(a: list, b: list) -> bool:
    """Does at most one word changed, put in or left out turn a into b?"""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    i = 0
    while i < short and a[i] == b[i]:
        i += 1
    j = 0
    while j < short - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return i + j >= max(len(a), len(b)) - 1


def verified(batches):
    for batch in batches:
        x, y = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        ok = pa.array([one_edit(p.split(" "), q.split(" ")) for p, q in zip(x, y)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok)], names=["line"])


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(F.col(key).alias("doc"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("digest"), body.alias("text"))


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, digest, places, n_near): the places of the lines that go, for each document
    that loses any."""
    spark = docs.sparkSession
    src = _source(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    rows = written(src.mapInArrow(line_rows(min_words), f"line long, doc {kind}, digest long, place int, h1 long, h2 long, h3 long, h4 long"), "line-rows")
    first = written(rows.groupBy("line").agg(F.min(F.struct("doc", "digest", "place")).alias("at"), F.count("*").alias("n"),
                                             *[F.first(h).alias(h) for h in ("h1", "h2", "h3", "h4")]), "line-first")
    halves = first.filter("h1 IS NOT NULL").select("line", F.explode(F.array_distinct(F.array("h1", "h2", "h3", "h4"))).alias("half"))
    near = written(halves.repartition("half").sortWithinPartitions("half")
                   .mapInArrow(runs_of_many("half", "line", ["half", "line"]), "half long, line long").select("line"), "line-halves")
    chosen = spark.sparkContext.broadcast(bitmap(near, "line"))
    met = (src.select("text").mapInArrow(variants(min_words, chosen), "key long, line long, role int").repartition("key").sortWithinPartitions("key")
           .mapInArrow(runs_of_many("key", "line", ["key", "line", "role"]), "key long, line long, role int").distinct())
    met = written(met.join(first.select("line", "at"), "line").select("key", "line", "role", F.struct("at", "line").alias("me")), "line-met")
    # of each key: the whole line, the earliest that left a word out, the earliest of one place
    by_key = met.groupBy("key").agg(F.min(F.when(F.col("role") == 0, F.col("me"))).alias("base"),
                                    F.min(F.when(F.col("role") == 1, F.col("me"))).alias("longer"),
                                    F.min(F.when(F.col("role") == 2, F.col("me"))).alias("same"))
    witness = F.when(F.col("role") == 0, F.col("longer")).when(F.col("role") == 1, F.col("base")).otherwise(F.col("same"))
    claims = (met.join(by_key, "key").withColumn("by", witness).filter("by < me")
              .select("line", F.col("by.line").alias("by")).distinct())
    claims = written(claims, "line-claims")
    told = spark.sparkContext.broadcast(bitmap(claims.select("line").union(claims.select("by")), "line"))
    words = written(src.select("text").mapInArrow(line_words(min_words, told), "line long, words string").dropDuplicates(["line"]), "line-words")
    gone = (claims.join(words, "line").withColumnRenamed("words", "mine")
            .join(words.select(F.col("line").alias("by"), F.col("words").alias("theirs")), "by")
            .select("line", "mine", "theirs").mapInArrow(verified, "line long").distinct())
    # all places of a near line go; of equal lines all but the first
    verdict = (first.select("line", "at", "n").join(gone.withColumn("near", F.lit(True)), "line", "left")
               .filter("near OR n > 1").select("line", "at", F.coalesce("near", F.lit(False)).alias("near")))
    at = rows.select("line", "doc", "digest", "place").join(verdict, "line")
    at = at.filter(F.col("near") | ~F.struct("doc", "digest", "place").eqNullSafe(F.col("at")))
    return at.groupBy("doc", "digest").agg(F.sort_array(F.collect_set("place")).alias("places"),
                                           F.size(F.collect_set(F.when(F.col("near"), F.col("place")))).alias("n_near"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with ``text`` without the lines that went, and n_lines,
    n_removed, n_near, all_removed (with ``prefix`` before their names).  New columns
    replace old ones of the same name."""
    gone = removals(docs, key, text, min_words).select(F.col("doc").alias("__doc"), F.col("digest").alias("__digest"), F.col("places").alias("__places"), F.col("n_near").alias("__near"))
    body = F.col(text).cast("string")
    new = [prefix + c for c in ("n_lines", "n_removed", "n_near", "all_removed")]
    out = docs.drop(*[c for c in new if c not in (text, key)])
    digest = F.xxhash64(F.coalesce(body, F.lit("")))
    out = out.join(gone, out[key].eqNullSafe(gone["__doc"]) & (digest == gone["__digest"]), "left")
    lines = F.split(body, "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("__places"), i))
    out = out.withColumns({
        new[0]: F.when(body.isNull() | (body == ""), 0).otherwise(F.size(lines)).cast("long"),
        new[1]: F.coalesce(F.size("__places"), F.lit(0)).cast("long"),
        new[2]: F.coalesce("__near", F.lit(0)).cast("long"),
        "__text": F.when(F.col("__places").isNull(), body).otherwise(F.array_join(kept, "\n"))})
    out = out.withColumn(new[3], (F.col(new[1]) > 0) & (F.regexp_replace(F.col("__text"), r"\s+", "") == ""))
    return out.withColumn(text, F.col("__text")).drop("__text", "__doc", "__digest", "__places", "__near")


@query("op1_line_dedup")
def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", "n_near", "all_removed", "text")
