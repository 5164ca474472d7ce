r"""Quality rules from cross-document line frequency, in native column expressions.

Lines (split at ``\n``) are normalised (A-Z lower-cased, white space collapsed,
digits as 0) and hashed.  For every host (``source``) and line the documents
that hold it are counted, each once however often it repeats the line; a line
in more than ``max_docs`` documents of its host is boilerplate and goes.  A
document that loses more than ``max_removed`` of its words is depleted and
rejected.  A few single-document rules (``base_*``) go with it.

Shuffles carry hashes and counts, never texts; counts are summed in each task
before they are shuffled, so a host or line that holds a third of the rows
arrives as one row for each task.  Lines are split once, into a table; places are counted first,
documents only for the lines that stand in enough of them.

Cases: null and empty texts have no words and fail the base rule; a null source
is a host of its own; a document is an id (a text where the id is null), so repeated
rows count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm.registry import query, table, written

WS = "[\\x20\\x09-\\x0D]+"
WS_LITERAL = WS.replace("\\", "\\\\")          # as a Spark SQL literal
UPPER, FOLDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"
MAX_DOCS = 10
MAX_REMOVED = 0.5
_SPACES = "concat(' ', char(9), char(10), char(11), char(12), char(13))"

# ``transform(array(x), v -> ...)[0]`` names a value that is used more than once.
WORD_COUNTS = f"""
transform(array(array_remove(split(body, '{WS_LITERAL}'), '')), w -> named_struct(
  'n_words', CAST(size(w) AS BIGINT),
  'n_repeat_words', CASE WHEN size(w) < 4 THEN 0L ELSE
    transform(array(sort_array(transform(sequence(0, size(w) - 3),
        i -> named_struct('h', xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), 'p', i)))), s ->
      aggregate(
        sort_array(filter(transform(s, (x, k) ->
            CASE WHEN x.h = get(s, k - 1).h OR x.h = get(s, k + 1).h THEN x.p END), q -> q IS NOT NULL)),
        named_struct('c', 0L, 'e', 0),
        (a, p) -> named_struct('c', a.c + (p + 3 - greatest(p, a.e)), 'e', p + 3),
        a -> a.c))[0] END))[0]
"""
LINE_COUNTS = f"""
transform(array(filter(split(body, '\\n'), x -> translate(x, {_SPACES}, '') <> '')),
  l -> CAST(size(l) - size(array_distinct(transform(l, x -> xxhash64(x)))) AS BIGINT))[0]
"""


def normal_line(column: str) -> str:
    return f"trim(BOTH ' ' FROM regexp_replace(translate({column}, '{UPPER}', '{FOLDED}'), '{WS_LITERAL}', ' '))"


LINES = f"""
filter(transform(split(body, '\\n'), x -> transform(array({normal_line('x')}), y ->
  named_struct('line', xxhash64(y), 'words', length(y) - length(translate(y, ' ', '')) + 1, 'blank', y = ''))[0]),
  z -> NOT z.blank)
"""


def _body(docs: DataFrame, key: str, text: str, host: str | None = None) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body")
    cols = [F.col(key).alias("key"), body] + ([F.col(host).cast("string").alias("host")] if host else [])
    return docs.select(*cols).withColumn("digest", F.xxhash64("body"))


def base_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The single-document figures, in one pass without a shuffle."""
    src = _body(docs, key, text)
    out = src.select(
        "key", "digest",
        F.expr(WORD_COUNTS).alias("w"),
        F.expr(f"CAST(length(translate(body, {_SPACES}, '')) AS BIGINT)").alias("word_chars"),
        F.expr("CAST(length(body) - length(translate(body, '#*$%&|<>', '')) AS BIGINT)").alias("n_symbols"),
        F.expr(LINE_COUNTS).alias("n_dup_lines"))
    out = out.select("key", "digest", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def line_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, digest, host, at, line, words) of every line with a word, written: lines are split and normalised once."""
    at = _body(docs, key, text, host).select("key", "digest", "host", F.posexplode(F.expr(LINES)).alias("at", "z"))
    return written(at.select("key", "digest", "host", "at", F.col("z.line").alias("line"), F.col("z.words").cast("int").alias("words")), "quality-lines")


def _over(counted: DataFrame, max_docs: int) -> DataFrame:
    many = counted.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs)
    return many.select(F.col("host").alias("host_"), F.col("line").alias("line_"))


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                  max_docs: int = MAX_DOCS) -> DataFrame:
    """For each document (key, digest of its text) that loses lines: their hashes
    and the words that go with them."""
    at = line_rows(docs, key, text, host)
    same = (F.col("line") == F.col("line_")) & F.col("host").eqNullSafe(F.col("host_"))
    # only a line that stands in more places than the limit can be in more documents
    at = written(at.join(_over(at, max_docs), same).drop("line_", "host_"), "quality-frequent")
    # rows repeat, documents count: each id once for a line, or each text where ids are null
    docs_of = at.select("host", "line", "key", F.when(F.col("key").isNull(), F.col("digest")).alias("unnamed")).distinct()
    # the place tells repeats of a line apart and makes repeated rows count once
    gone = (at.join(_over(docs_of, max_docs), same)
            .groupBy("key", "digest").agg(F.collect_set(F.struct("at", "line", "words")).alias("gone")))
    return gone.select("key", "digest", F.array_distinct(F.transform("gone", lambda g: g["line"])).alias("lines"),
                       F.aggregate("gone", F.lit(0).cast("long"), lambda a, g: a + g["words"]).alias("n_removed_words"))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
            max_docs: int = MAX_DOCS, max_removed: float = MAX_REMOVED, with_text: bool = True) -> DataFrame:
    """Figures and verdict of every row; with ``with_text`` also its text without
    the frequent lines."""
    base = base_counts(docs, key, text)
    gone = removed_lines(docs, key, text, host, max_docs).select(
        F.col("key").alias("key_"), F.col("digest").alias("digest_"), "lines", "n_removed_words")
    if with_text:
        base = base.join(_body(docs, key, text).select(F.col("key").alias("k2"), F.col("digest").alias("d2"), "body").distinct(),
                         F.col("key").eqNullSafe(F.col("k2")) & (F.col("digest") == F.col("d2"))).drop("k2", "d2")
    out = base.join(gone, F.col("key").eqNullSafe(F.col("key_")) & (F.col("digest") == F.col("digest_")), "left")
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= max_removed * F.col("n_words")))
    if with_text:
        out = out.withColumn("clean_text", F.expr(
            f"CASE WHEN lines IS NULL THEN body ELSE array_join(filter(split(body, '\\n'), x -> NOT array_contains(lines, xxhash64({normal_line('x')}))), '\\n') END")).drop("body")
    return out.drop("key_", "digest_", "digest", "lines").withColumnRenamed("key", key)


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, source, body, list_filter(string_split_regex(body, '{WS}'), lambda x: x <> '') AS words,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS tri
      FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g
            WHERE (doc_id, tri) IN (SELECT (doc_id, tri) FROM g GROUP BY doc_id, tri HAVING count(*) > 1)) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(body, '{WS}', '', 'g')) AS word_chars,
             length(body) - length(translate(body, '#*$%&|<>', '')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
l AS (SELECT doc_id, source, trim(regexp_replace(translate(x, '{UPPER}', '{FOLDED}'), '{WS}', ' ', 'g'), ' ') AS line
      FROM (SELECT doc_id, source, unnest(lines) AS x FROM w)),
f AS (SELECT source, line FROM l GROUP BY source, line HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
m AS (SELECT doc_id, sum(len(string_split(l.line, ' '))) AS gone FROM l
      JOIN f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY doc_id)
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       CAST(coalesce(gone, 0) AS BIGINT) AS n_removed_words,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND coalesce(gone, 0) <= {MAX_REMOVED} * n_words AS kept
FROM b LEFT JOIN m USING (doc_id)
"""


@query("op2_quality_lines", ORACLE)
def op2(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), with_text=False)
