"""Merkle manifest of a dataset, with a proof for every document.

A document's leaf is the hash of its fields, each ``-`` if null and else its UTF-8
byte count, ``:`` and its value.  The leaves of a group (a source) ascend by id; every three
consecutive nodes become the hash of their digests until one is left, the group's
subroot.  The subroots in order of their group (null first) become the root in the same way.
Hashes are SHA-256, digests are joined as lower-case hex text.

Proofs come by pointer jumping.  A node starts with a segment of one step: the digests to its
left and to its right in the run that it shares with its siblings.  A table of nodes joined with
itself doubles the distance that segments span (1, 2, 4, ... levels), and each leaf
takes the segment of the ancestor that its own segment ends at, until it reaches the root: 25 levels
(10**11 leaves) take five joins.  Only levels that the next jump can start from are kept, so
the jumping tables shrink to a ninth and less.

Scale: texts are read once, where the leaves are hashed.  Leaves get their places from a range
partitioning over all order columns with a row count for each range, not from one window for each
group, so a group that holds a third of all rows is spread over many tasks.  Trees are built in
blocks of 729 leaves (six levels for one shuffle).  Ancestors of one leaf in 3**d are joined on (tree, place), and
no such key has more than 3**d leaves; tables of few rows are left to the planner to broadcast.

Cases: null ids come first and count as ``-``; rows of one id are ordered by their leaf, and equal
rows are leaves of their own; null and empty texts differ (``-`` and ``0:``); a lone leaf is its
group's subroot, a lone subroot is the root, and a document with neither siblings nor levels has an
empty proof; a run of one node is hashed alone and gives no siblings; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendora.llm import hot
from vendora.llm.registry import query, table, written

RUN = 3                    # nodes hashed together
LEVELS = 6                 # levels built in one block
BLOCK = RUN ** LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
MAX_HEIGHT = 39            # 3**39 leaves are more than a long can count


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def encoded(value: Column) -> Column:
    """A field as it goes into the leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return digest(F.concat(*[encoded(f) for f in fields]))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with a string column ``tree``, with ``at`` (from zero, in the order of ``order`` within the
    tree) and ``height`` (levels above the leaves of the tree)."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal rows are told apart by their place in the written table, so ranges can cut them too
    ranges = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, "tree", *order, "__tie")
    ranges = ranges.sortWithinPartitions("tree", *order, "__tie").drop("__tie")
    ranges = written(ranges.withColumn("__m", F.monotonically_increasing_id())
                     .withColumn("__range", F.shiftright("__m", 33)), "merkle-ranges")
    # one row for each tree and range that holds some of it
    parts = ranges.groupBy("tree", "__range").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    parts = written(parts, "merkle-parts")
    trees = written(parts.groupBy("tree").agg(F.sum("__n").alias("__size")), "merkle-trees")
    # what earlier ranges hold of the tree; a range has at most one tree that began before it
    begun = parts.alias("a").join(trees, "tree").filter("__n < __size").drop("__size")
    before = _before(begun)
    starts = parts.join(trees, "tree").join(before, ["tree", "__range"], "left")
    powers = F.array(*[F.lit(RUN ** h).cast("long") for h in range(MAX_HEIGHT)])
    height = F.size(F.filter(powers, lambda x: x < F.col("__size")))
    starts = starts.select("tree", "__range", (F.coalesce("__before", F.lit(0)) - F.col("__first")).alias("__shift"),
                           height.alias("height"))
    return ranges.join(starts, ["tree", "__range"]).withColumn("at", F.col("__m") + F.col("__shift")).drop("__m", "__range", "__shift")


def _before(parts: DataFrame) -> DataFrame:
    """Rows of the tree in earlier ranges, for the parts of trees that lie in several: fewer than two
    rows for each range, so a window over a tree's parts is bounded by the number of ranges."""
    from pyspark.sql import Window
    w = Window.partitionBy("tree").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("tree", "__range", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))


# siblings of the node at place i of an array of digests: those of its run to its left and right
LEFT = "concat(IF(i % 3 > 0, {a}[cast(i - i % 3 as int)], ''), IF(i % 3 > 1, {a}[cast(i - 1 as int)], ''))"
RIGHT = "concat(IF(i % 3 < 2, coalesce(get({a}, cast(i + 1 as int)), ''), ''), IF(i % 3 < 1, coalesce(get({a}, cast(i + 2 as int)), ''), ''))"
STEP = f"named_struct('left', {LEFT}, 'right', {RIGHT})"
PARENTS = ("transform(sequence(0, (size({a}) - 1) div 3), i -> sha2(concat({a}[3 * i], coalesce(get({a}, 3 * i + 1), ''), "
           "coalesce(get({a}, 3 * i + 2), '')), 256))")


def _blocks(nodes: DataFrame, base: int) -> DataFrame:
    """Nodes of level ``base`` (tree, height, at, hash, ...) in blocks, with the digests of the levels above:
    a0 are the nodes' own, a1 to a6 those of the levels base + 1 to base + 6."""
    rest = [c for c in nodes.columns if c not in ("tree", "height", "at")]
    out = nodes.groupBy("tree", "height", F.expr(f"at div {BLOCK}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("at", *rest))).alias("nodes"))
    out = out.withColumn("a0", F.expr("transform(nodes, x -> x.hash)"))
    for k in range(LEVELS):
        out = out.withColumn(f"a{k + 1}", F.expr(PARENTS.format(a=f"a{k}")))
    return written(out, f"merkle-blocks-{base}")


def _inner(blocks: DataFrame, base: int) -> DataFrame:
    """(tree, height, level, at, seg) of the blocks' nodes above their first level, roots left out; the last
    level belongs to the next blocks."""
    out = None
    for k in range(1, LEVELS):
        size = RUN ** (LEVELS - k)
        level = blocks.filter(F.col("height") > base + k).select(
            "tree", "height", F.lit(base + k).alias("level"), "block",
            F.explode(F.expr(f"transform(sequence(0, size(a{k}) - 1), i -> named_struct('at', block * {size} + i, 'seg', array({STEP.format(a=f'a{k}')})))")).alias("x"))
        level = level.select("tree", "height", "level", "x.at", "x.seg")
        out = level if out is None else out.unionByName(level)
    return out


def proofs(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``leaves`` (tree, hash, ...) with ``seg``, the steps from leaf to subroot (an array of left and right
    digests), and (tree, n, subroot) of each tree."""
    own = [c for c in leaves.columns if c != "tree"]
    nodes = placed(leaves, order)
    highest, inner, tops, base, first = None, None, None, 0, None
    while True:
        blocks = _blocks(nodes, base)
        if first is None:
            first, highest = blocks, blocks.agg(F.max("height")).first()[0] or 0
        else:
            # nodes of the level the blocks before ended with
            step = blocks.filter(F.col("height") > base).select("tree", "height", F.lit(base).alias("level"), F.explode(F.expr(
                f"transform(nodes, (x, i) -> named_struct('at', x.at, 'seg', array({STEP.format(a='a0')})))")).alias("x"))
            inner = inner.unionByName(step.select("tree", "height", "level", "x.at", "x.seg"))
        above = _inner(blocks, base)
        inner = above if inner is None else inner.unionByName(above)
        for k in range(LEVELS + 1):
            if k < LEVELS or base + k == highest:
                top = blocks.filter(F.col("height") == base + k).select("tree", F.col(f"a{k}")[0].alias("subroot"))
                tops = top if tops is None else tops.unionByName(top)
        base += LEVELS
        if base >= highest:
            break
        nodes = blocks.filter(F.col("height") >= base).select("tree", "height", F.col("block").alias("at"), F.col(f"a{LEVELS}")[0].alias("hash"))
    rows = first.select("tree", "height", F.explode(F.expr(
        f"transform(nodes, (x, i) -> named_struct('node', x, 'seg', IF(height > 0, array({STEP.format(a='a0')}), array())))")).alias("x"))
    rows = rows.select("tree", "height", "x.node.at", *[F.col(f"x.node.{c}").alias(c) for c in own], "x.seg")
    jumps, d = inner, 1
    while d < highest:
        jumps = written(jumps, f"merkle-jumps-{d}")
        # a leaf that reached its subroot looks for a place that no node has, so such leaves don't meet in one task
        up = F.when(F.col("height") > d, F.expr(f"at div {RUN ** d}L")).otherwise(-1 - F.col("at"))
        ends = jumps.filter(F.col("level") == d).select("tree", F.col("at").alias("__up"), F.col("seg").alias("__seg"))
        rows = _jump(rows.withColumn("__up", up), ends)
        start = jumps.filter(F.col("level") % (2 * d) == 0)
        start = start.withColumn("__level", F.col("level") + d).withColumn("__up", F.expr(f"at div {RUN ** d}L"))
        ends = jumps.filter(F.col("level") % (2 * d) == d).select("tree", F.col("level").alias("__level"), F.col("at").alias("__up"), F.col("seg").alias("__seg"))
        jumps = _jump(start, ends, "__level")
        d *= 2
    sizes = first.groupBy("tree").agg(F.sum(F.size("nodes")).alias("n"))
    return rows.drop("height", "at"), sizes.join(tops, "tree")


def _jump(rows: DataFrame, ends: DataFrame, *more: str) -> DataFrame:
    out = rows.join(ends, ["tree", "__up", *more], "left")
    return out.withColumn("seg", F.when(F.col("__seg").isNull(), F.col("seg")).otherwise(F.concat("seg", "__seg"))).drop("__up", "__seg", *more)


def folded(leaf: Column, seg: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""
    return F.aggregate(seg, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def siblings(seg: Column) -> Column:
    """The digests of a proof as one text, level by level."""
    return F.array_join(F.transform(seg, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", leaf: Column | None = None, extra: dict | None = None) -> DataFrame:
    """One row for each document: ``key``, leaf, subroot, root and ``proof`` (steps of left and right
    digests from the leaf to the root), and the columns ``extra`` (name -> column of ``docs``)."""
    extra = extra or {}
    leaf = leaf_of([F.col(c) for c in FIELDS]) if leaf is None else leaf
    # the order of these texts is that of the groups, null first
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    rows = written(docs.select(tree.alias("tree"), leaf.alias("hash"), F.col(key).alias("__key"),
                               *[c.alias(f"__x_{name}") for name, c in extra.items()]), "merkle-leaves")
    rows, tops = proofs(rows, ["__key", "hash"])
    tops = written(tops, "merkle-subroots")
    top, root = proofs(tops.select(F.lit("").alias("tree"), F.col("subroot").alias("hash"), F.col("tree").alias("group"), "n"), ["group"])
    root = root.select("subroot").first()                     # one digest, or none for an empty table
    root = F.lit(root[0] if root else None).cast("string")
    top = written(top.select(F.col("group").alias("tree"), "n", F.col("hash").alias("subroot"), root.alias("root"), F.col("seg").alias("top")), "merkle-tops")
    total = top.agg(F.sum("n")).first()[0] or 0
    out = hot.left_join(rows, top, "tree", "n", total, ["__key", "hash"])
    return out.select(F.col("__key").alias(key), F.col("hash").alias("leaf"), "subroot", "root",
                      F.concat("seg", "top").alias("proof"), *[F.col(f"__x_{name}").alias(name) for name in extra])


# crc32 of the decimal id, bit by bit; DuckDB has no function for it
CRC = ("xor(list_reduce(list_transform(range(8 * length(CAST(doc_id AS VARCHAR))), "
       "lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1)) ELSE 0 END), "
       "lambda c, b: CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT)")
_LEAF_SQL = "sha256(" + " || ".join(
    f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS) + ")"
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, {_LEAF_SQL} AS leaf,
         {_LEAF_SQL.replace('CAST(text AS VARCHAR)', "replace(text, chr(10), '')")} AS bad, {CRC} % 2 = 0 AS tampered
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
t AS (SELECT tree, n, 0 AS level, pos, leaf AS hash FROM l
      UNION ALL
      SELECT tree, any_value(n), level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM t WHERE n > 3 ** level GROUP BY tree, level, pos // 3),
s AS (SELECT tree, max_by(hash, level) AS subroot FROM t GROUP BY tree),
g AS (SELECT tree, subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM s),
u AS (SELECT n, 0 AS level, pos, subroot AS hash FROM g
      UNION ALL
      SELECT any_value(n), level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM u WHERE n > 3 ** level GROUP BY level, pos // 3),
a AS (SELECT tree, level, pos, hash, string_agg(hash, '') OVER (p ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lhs,
             string_agg(hash, '') OVER (p ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rhs
      FROM (SELECT tree, level, pos, hash FROM t WHERE n > 3 ** level UNION ALL SELECT NULL, level, pos, hash FROM u WHERE n > 3 ** level)
      WINDOW p AS (PARTITION BY tree, level, pos // 3)),
f AS (SELECT doc_id, l.pos AS id, l.tree, l.n, 0 AS level, l.pos, CASE WHEN tampered THEN bad ELSE leaf END AS hash, '' AS proof FROM l
      UNION ALL
      SELECT doc_id, id, f.tree, n, f.level + 1, f.pos // 3, sha256(coalesce(lhs, '') || f.hash || coalesce(rhs, '')), proof || coalesce(lhs, '') || coalesce(rhs, '')
      FROM f JOIN a ON a.tree = f.tree AND a.level = f.level AND a.pos = f.pos),
h AS (SELECT doc_id, id, f.tree, g.n, 0 AS level, g.pos, f.hash, f.proof FROM f JOIN g USING (tree) WHERE 3 ** f.level >= f.n
      UNION ALL
      SELECT doc_id, id, h.tree, n, h.level + 1, h.pos // 3, sha256(coalesce(lhs, '') || h.hash || coalesce(rhs, '')), proof || coalesce(lhs, '') || coalesce(rhs, '')
      FROM h JOIN a ON a.tree IS NULL AND a.level = h.level AND a.pos = h.pos),
r AS (SELECT max_by(hash, level) AS root FROM u)
SELECT l.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h.hash AS folded_root, h.hash = root AS verified
FROM h JOIN l ON l.tree = h.tree AND l.pos = h.id JOIN s ON s.tree = l.tree CROSS JOIN r WHERE 3 ** h.level >= h.n
"""


@query("op12_merkle_manifest", ORACLE)
def op12(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in FIELDS}
    bad = leaf_of(list((fields | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}).values()))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = manifest(docs, extra={"used": F.when(tampered, bad)})
    out = out.withColumn("folded_root", folded(F.coalesce("used", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("proof"))).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
