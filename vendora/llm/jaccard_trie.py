"""N-gram Jaccard join with prefix trees.

A document's set holds its distinct 3-word shingles (hashed); two documents link
when 100 * intersection >= 90 * union.  Sets are written in one global order and

1. equal sets become one node (copies are never expanded into pairs);
2. a linking pair must share ``SHARED`` (or all it can) of the first
   n - ceil(0.9 n) + ``SHARED`` shingles of either set, so nodes meet by these.  The order
   starts with the longest shingles, which are the rarest in any corpus, and ends
   with those that many texts hold, so that chance and shared passages seldom
   decide where nodes meet;
3. where nodes meet, each is first held against one of them, the hub (the one
   with the fewest rare shingles, so the original of a family of near copies).
   Nodes left in different components are then held against each other.  Shingles
   that met no other node bound what a node can have in common with any, which spares
   the copies that are too far from all others;
4. a comparison task stores the probed sets of a hub in a prefix tree (sets in
   order, with the length each shares with the one before) and walks it with the
   hub's set: the overlap of a shared beginning is counted once, and a branch
   is left as soon as its missing shingles exceed what any set size allows.

The result does not depend on the order or the hubs: every pair that the prefix
bound allows is compared or already in one component.

Scale: texts are read four times and shuffled only for nodes in a pair; a hub's probes are salted into chunks; a shingle that many nodes hold is
spread by node and aggregated before it is shuffled.  The list of common shingles
has at most ``HEAVY`` entries and decides only the order.

Cases: null and empty texts have an empty set and link with nothing; fewer than
three words count as one shingle; repeated rows are copies; a null id joins its
component but never names it unless all its ids are null (then null); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm import textgrid as tg
from vendora.llm.bits import bitmap, hits, runs_of_many
from vendora.llm.graph import components
from vendora.llm.registry import query, table, written

K = 3
PER_100 = 90
HEAVY = 1 << 18            # common shingles that the order knows
BLOCK = 2 << 20            # shingles counted together when looking for common ones
SHARED = 4                 # shingles of the two beginnings that a linking pair shares
COMMON = 6                 # texts of a block that hold a common shingle
CHUNK = 256                # probes of a hub in one tree
PROBES = 1500              # probes in a comparison task's group


def row_sets(col, k: int) -> list:
    """Distinct shingles of each row, ascending: 12 bits that put long shingles first
    (the longer, the rarer, in any corpus), 52 bits of the shingle's hash."""
    words = tg.words_of(col)
    s, ptr = tg.shingles(words, k)
    length = np.minimum(tg.shingle_bytes(words, ptr, k), 4095).astype(np.uint64)
    s = ((np.uint64(4095) - length) << np.uint64(52)) | (s >> np.uint64(12))
    return [np.unique(s[ptr[i]:ptr[i + 1]]) for i in range(len(ptr) - 1)]


def set_keys(sets: list, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set, and its size."""
    size = np.array([len(s) for s in sets], np.int64)
    full = size > 0
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    start = (np.cumsum(size) - size)[full]
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        h = tg.mix(flat ^ np.uint64((salt * (2 * seed + 1)) & tg.M64))
        d = np.zeros(len(sets), np.uint64)
        if full.any():
            d[full] = tg.mix(np.add.reduceat(h, start) + size[full].astype(np.uint64))
        out.append(tg.signed(d))
    return out[0], out[1], size


def scan(k: int, seed: int):
    """Rows of kind 0: a document's key, digests and set size; of kind 1: a shingle
    common in a block of texts and how many hold it (equal sets of a task once)."""

    def run(batches):
        seen: set = set()
        held: list = []
        n_held = 0

        def common():
            t, c = np.unique(np.concatenate(held), return_counts=True)
            t, c = tg.signed(t[c >= COMMON]), c[c >= COMMON]
            return len(t), t, c

        def rows(doc, kind, a, b, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), doc, pa.array(a), pa.array(b.astype(np.int64)), pa.array(n.astype(np.int64))],
                                              names=["kind", "doc", "a", "b", "n"])
        kind_of = None
        for batch in batches:
            kind_of = batch.schema.field("doc").type
            for part in tg.slices(batch):
                sets = row_sets(part.column(1), k)
                a, b, n = set_keys(sets, seed)
                for i, x in enumerate(a.tolist()):
                    if n[i] and x not in seen:
                        seen.add(x)
                        held.append(sets[i])
                        n_held += len(sets[i])
                yield rows(part.column(0), 0, a, b, n)
                if n_held >= BLOCK:
                    m, t, c = common()
                    yield rows(pa.nulls(m, kind_of), 1, t, c, c)
                    held.clear()
                    n_held = 0
        if held:
            m, t, c = common()
            yield rows(pa.nulls(m, kind_of), 1, t, c, c)
    return run


def order_of(tokens: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """0 for a rare shingle, else its place among the common ones (the commonest last)."""
    if not len(heavy):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
    return np.where(heavy[at] == tokens, rank[at], 0)


def prefixes(k: int, per_100: int, seed: int, heavy):
    """The first shingles of each node (once for a task)."""

    def run(batches):
        known, rank = heavy.value
        seen: set = set()
        for batch in batches:
            for part in tg.slices(batch):
                sets = row_sets(part.column(part.schema.get_field_index("text")), k)
                a, _, n = set_keys(sets, seed)
                cols: list = [[] for _ in range(6)]
                for i, node in enumerate(a.tolist()):
                    if not n[i] or node in seen:
                        continue
                    seen.add(node)
                    s = sets[i]
                    place = order_of(s, known, rank)
                    first = np.lexsort((s, place))[:len(s) - -(-per_100 * len(s) // 100) + SHARED]
                    t, p = s[first], place[first]
                    spread = np.where(p > 0, tg.mix(t ^ np.uint64(node & tg.M64)), t)
                    m = len(t)
                    rare2 = (p > 0) + 2 * int((place == 0).sum())      # is it common; how many of the set are rare
                    for c, v in zip(cols, (tg.signed(spread), tg.signed(t), np.full(m, node), rare2, np.full(m, len(s)), np.arange(m))):
                        c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols],
                                                     names=["part", "token", "node", "rare2", "n", "pos"])
    return run


PREFIX = "part long, token long, node long, rare2 long, n long, pos long"


MET = "token long, node long, rare2 long, n long, pos long"


def _need(per_100: int, n1, n2):
    """Least overlap of linking sets of sizes n1 and n2."""
    return F.ceil(F.lit(per_100) * (n1 + n2) / F.lit(100 + per_100))


def roomy(per_100: int, n1, room1, n2, room2):
    """Can sets of these sizes link, if so many of their shingles may be common?"""
    return (100 * F.least(n1, n2) >= per_100 * F.greatest(n1, n2)) & (F.least(room1, room2) >= _need(per_100, n1, n2))


def promising(rows: DataFrame, per_100: int) -> DataFrame:
    """(u, v) of ``rows`` (u, v and, for each shingle that their beginnings share, its
    place in both) that can link: enough shared shingles, and enough left after the first."""
    pairs = rows.groupBy("u", "v").agg(F.count("*").alias("shared"), F.min("pos_u").alias("p1"), F.min("pos_v").alias("p2"),
                                       F.first("n_u").alias("n1"), F.first("n_v").alias("n2"))
    need = _need(per_100, F.col("n1"), F.col("n2"))
    return pairs.filter((F.col("shared") >= F.least(F.lit(SHARED), need)) & (F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) >= need)).select("u", "v")


def walk(query, n_q: int, sets: list, shared: np.ndarray, known: np.ndarray, per_100: int) -> list:
    """Positions of the sets that link with the query.  ``sets`` are in prefix-tree
    order; ``shared[i]`` is the length set i has in common with set i - 1;
    ``known`` marks the query's shingles."""
    known[query] = True
    most_missing = n_q * 100 // per_100 - n_q          # a set of any size may miss so many
    found, overlap, dead = [], np.zeros(1, np.int64), None
    for i, s in enumerate(sets):
        at = shared[i]
        if dead is not None and at >= dead:
            continue                                   # in the branch that was left
        dead = None
        below = np.cumsum(known[s[at:]]) + overlap[at]
        overlap = np.concatenate([overlap[:at + 1], below])
        missing = np.arange(at + 1, len(s) + 1) - below
        if len(missing) and missing[-1] > most_missing:
            dead = at + 1 + int(np.searchsorted(missing, most_missing, "right"))
            continue
        both = int(overlap[len(s)])
        if 100 * both >= per_100 * (len(s) + n_q - both):
            found.append(i)
    known[query] = False
    return found


def compare(k: int, per_100: int, heavy):
    """Rows (hub, chunk, probe or null, text) of some hubs in; linking (probe, hub) out."""

    def run(key, tab):
        common, rank = heavy.value
        tab = tab.combine_chunks()
        sets = [s for part in tg.slices(tab) for s in row_sets(part.column("text"), k)]
        hub, chunk = (np.asarray(tab.column(c).combine_chunks()) for c in ("hub", "chunk"))
        role = np.asarray(tab.column("role").combine_chunks())
        node = np.asarray(tab.column("node").combine_chunks())
        order = np.lexsort((role, chunk, hub))
        cuts = np.flatnonzero(np.append(True, (hub[order][1:] != hub[order][:-1]) | (chunk[order][1:] != chunk[order][:-1])))
        us, vs = [], []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
            rows = order[lo:hi]
            if role[rows[0]] != 0 or len(rows) < 2:
                continue
            members = [sets[r] for r in rows]
            vocabulary, back = np.unique(np.concatenate(members), return_inverse=True)
            # the trees hold the commonest shingles first, which near copies share
            place = np.empty(len(vocabulary), np.int64)
            place[np.lexsort((vocabulary, -order_of(vocabulary, common, rank)))] = np.arange(len(vocabulary))
            cut_at = np.cumsum([0] + [len(m) for m in members])
            ids = [np.sort(place[back[cut_at[i]:cut_at[i + 1]]]) for i in range(len(members))]
            tree = sorted(range(1, len(ids)), key=lambda i: ids[i].astype(">i8").tobytes())
            shared = np.zeros(len(tree), np.int64)
            for i in range(1, len(tree)):
                x, y = ids[tree[i - 1]], ids[tree[i]]
                m = min(len(x), len(y))
                differ = x[:m] != y[:m]
                shared[i] = int(np.argmax(differ)) if differ.any() else m
            for i in walk(ids[0], len(ids[0]), [ids[t] for t in tree], shared, np.zeros(len(vocabulary), bool), per_100):
                us.append(int(node[rows[tree[i]]]))
                vs.append(int(hub[rows[0]]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})
    return run


def linked(pairs: DataFrame, texts: DataFrame, k: int, per_100: int, heavy) -> DataFrame:
    """The (u, v) of ``pairs`` (u probe, v hub) that link."""
    per_hub = pairs.groupBy("v").agg(F.count("*").alias("probes"))
    total = per_hub.agg(F.coalesce(F.sum("probes"), F.lit(0))).first()[0]
    bins = max(1, total // PROBES)
    at = (pairs.join(per_hub, "v")
          .select("u", F.col("v").alias("hub"), F.pmod(F.xxhash64("u"), F.ceil(F.col("probes") / CHUNK)).alias("chunk")))
    probe = at.join(texts.withColumnRenamed("node", "u"), "u").select("hub", "chunk", F.lit(1).alias("role"), F.col("u").alias("node"), "text")
    hubs = at.select("hub", "chunk").distinct().join(texts.withColumnRenamed("node", "hub"), "hub").select(
        "hub", "chunk", F.lit(0).alias("role"), F.col("hub").alias("node"), "text")
    both = probe.unionByName(hubs).withColumn("bin", F.pmod(F.xxhash64("hub", "chunk"), F.lit(bins)))
    return both.groupBy("bin").applyInArrow(compare(k, per_100, heavy), "u long, v long")


def picked(k: int, seed: int, bits):
    """Rows (hash of the id, doc, text) that the bitmap may hold, as (node, doc, text)."""

    def run(batches):
        for batch in batches:
            few = batch.filter(pa.array(hits(bits.value, np.asarray(batch.column(0)))))
            for part in tg.slices(few):
                a, _, _ = set_keys(row_sets(part.column(2), k), seed)
                yield pa.RecordBatch.from_arrays([pa.array(a), part.column(1), part.column(2)], names=["node", "doc", "text"])
    return run


def node_texts(src: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, seed: int) -> DataFrame:
    """(node, text) of the nodes in ``pairs``.  Other documents leave before the shuffle
    (a few pass the bitmap, more once it fills up; the join drops them)."""
    ident = F.xxhash64(F.col("doc").cast("string"))
    asked = written(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes, "node").withColumn("ident", F.xxhash64(F.col("rep").cast("string"))), "jaccard-asked")
    bits = src.sparkSession.sparkContext.broadcast(bitmap(asked, "ident"))
    kind = src.schema["doc"].dataType.simpleString()
    few = src.select(ident.alias("ident"), "doc", "text").mapInArrow(picked(k, seed, bits), f"node long, doc {kind}, text string")
    own = asked.select(F.col("node").alias("own"), "rep")
    return written(few.join(own, (F.col("node") == F.col("own")) & F.col("doc").eqNullSafe(F.col("rep"))).select("node", "text")
                   .dropDuplicates(["node"]), "jaccard-texts")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, per_100: int = PER_100) -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    src = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    seed = 0
    while True:
        scanned = written(src.mapInArrow(scan(k, seed), f"kind int, doc {kind}, a long, b long, n long"), "jaccard-scan")
        rows = scanned.filter("kind = 0")
        nodes = rows.filter("n > 0").groupBy("a").agg(F.min("doc").alias("rep"), F.min("b").alias("b1"), F.max("b").alias("b2"),
                                                      F.min("n").alias("n1"), F.max("n").alias("n2"))
        if not nodes.filter("b1 <> b2 OR n1 <> n2").limit(1).count():
            break
        seed += 1                   # two sets with one digest: other digests
    nodes = nodes.select(F.col("a").alias("node"), "rep")
    # at most HEAVY rows; only the order depends on them
    top = (scanned.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(HEAVY).toArrow())
    token, count = top.column("a").to_numpy().view(np.uint64), top.column("n").to_numpy()
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, count))] = np.arange(1, len(token) + 1)
    at = np.argsort(token)
    heavy = spark.sparkContext.broadcast((token[at], rank[at]))

    met = written(src.mapInArrow(prefixes(k, per_100, seed, heavy), PREFIX)
                  .repartition("part").sortWithinPartitions("token").mapInArrow(runs_of_many("token", "node", ["token", "node", "rare2", "n", "pos"], "rare2"), MET), "jaccard-met")
    once = met.dropDuplicates(["token", "node"])        # a node may come from several tasks
    # A rare shingle of a beginning that met no other node may still stand in another set
    # behind its beginning, but then that set has too many shingles of its own before it,
    # unless SHARED met ones come first: up to there, unmet shingles are in no linking set.
    rare, size = F.shiftright("rare2", 1), F.col("n")
    begun = F.least(rare, size, size - F.ceil(F.lit(per_100) * size / 100) + SHARED)
    places = F.sort_array(F.collect_list(F.when(F.col("rare2") % 2 == 0, F.col("pos"))))      # at most a beginning's
    met_rare = once.groupBy("node").agg(places.alias("places"))
    alone = F.coalesce(F.get("places", F.lit(SHARED - 1)) - (SHARED - 1), begun - F.size("places"))
    once = written(once.join(met_rare, "node").select("token", "node", rare.alias("rare"), "n", "pos", (size - alone).alias("room")), "jaccard-once")
    hub = once.groupBy("token").agg(F.min(F.struct("rare", "node", "n", "pos", "room")).alias("h"))
    first = promising(once.join(hub, "token").filter((F.col("node") != F.col("h.node")) & roomy(per_100, size, F.col("room"), F.col("h.n"), F.col("h.room")))
                      .select(F.col("node").alias("u"), F.col("h.node").alias("v"), F.col("n").alias("n_u"), F.col("h.n").alias("n_v"),
                              F.col("pos").alias("pos_u"), F.col("h.pos").alias("pos_v")), per_100)
    first = written(first, "jaccard-pairs")
    texts = node_texts(src, nodes, first, k, seed)
    links = written(linked(first, texts, k, per_100, heavy), "jaccard-links")

    label = components(links)
    there = once.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = there.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2").select("token")
    left = written(there.join(apart, "token").select("token", "node", "n", "pos", "room", "component"), "jaccard-left")
    x, y = left.alias("x"), left.alias("y")
    second = promising(x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") < F.col("y.component"))
                              & roomy(per_100, F.col("x.n"), F.col("x.room"), F.col("y.n"), F.col("y.room")))
                       .select(F.col("x.node").alias("u"), F.col("y.node").alias("v"), F.col("x.n").alias("n_u"), F.col("y.n").alias("n_v"),
                               F.col("x.pos").alias("pos_u"), F.col("y.pos").alias("pos_v")), per_100)
    tested = first.select("u", "v").union(first.select(F.col("v").alias("u"), F.col("u").alias("v")))
    second = written(second.join(tested, ["u", "v"], "left_anti"), "jaccard-rest")
    if second.limit(1).count():
        texts = node_texts(src, nodes, second, k, seed)
        links = links.union(written(linked(second, texts, k, per_100, heavy), "jaccard-links"))
        label = components(links)

    named = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "component").select(F.col("node").alias("a"), "component_id")
    full = rows.filter("n > 0").join(named, "a").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id")
    none = rows.filter("n = 0").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))
    return full.unionByName(none)


@query("op10_jaccard_trie")
def op10(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` less all but the smallest id of each component, all their
    columns kept.  A document is an id with its text: of rows with both alike one stays, rows of one
    id with unlike texts are documents of their own."""
    digest = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    named = docs.select(F.struct(F.col(key).alias("k"), digest.alias("d")).alias("__id"), F.col(text).alias("__text"))
    found = written(join(named, "__id", "__text", **how), "jaccard-components")
    stay = found.filter(F.col("__id") == F.col("component_id")).select(F.col("__id.k").alias("__key"), F.col("__id.d").alias("__digest"))
    repeated = stay.groupBy("__key", "__digest").agg(F.count("*").alias("n")).filter("n > 1").select("__key", "__digest")
    same = lambda: docs[key].eqNullSafe(F.col("__key")) & (digest == F.col("__digest"))
    out = docs.join(stay.distinct(), same(), "left_semi")
    if repeated.limit(1).count():
        again = out.join(repeated, same(), "left_semi").withColumn("__digest", digest).dropDuplicates([key, "__digest"]).drop("__digest")
        out = out.join(repeated, same(), "left_anti").unionByName(again)
    return out
