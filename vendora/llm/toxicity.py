"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier in numpy learns from confirmed toxic texts (P) and a sample
of texts whose labels are not looked at (U).  The risk is

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

with the logistic loss: toxic texts hidden in U are paid for by the class prior,
and where the second part turns negative the step goes the other way (the
non-negative correction).  Inputs are hashed presences of words and of
word beginnings alone.

Scale: the fit sees a bounded sample of labelled rows (``max_positive``,
``max_unlabelled``: documented bounds, ordered by a hash of the id, equal texts
once).  Every document is scored in one pass over its whole text; the broadcast
weights have a fixed size.

Cases: null and empty texts have no words and score the bias alone; repeated
rows score alike; an empty document table gives an empty result; without any
confirmed toxic row the score is the prior (0 when nothing is labelled).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm import textgrid as tg
from vendora.llm.registry import query, table

BITS = 18
FEATURES = 1024            # most telling features kept for the fit
STEMS = (4, 5, 6)          # bytes of the word beginnings that count as features
THRESHOLD = 0.7


def held_out(key="doc_id"):
    """Rows of the fold that no label is learned from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def _buckets(col) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of words and word beginnings, row of each) with repeats."""
    words = tg.words_of(col, gaps=tg.NOT_ALNUM)
    row = np.repeat(np.arange(len(words.ptr) - 1), np.diff(words.ptr))
    hashes = [words.hash, *words.prefixes(STEMS).values()]
    bucket = np.concatenate([(h >> np.uint64(64 - BITS)).astype(np.int64) for h in hashes])
    return bucket, np.tile(row, len(hashes))


def _sample_features(batches):
    for batch in batches:
        for part in tg.slices(batch):
            bucket, row = _buckets(part.column(part.schema.get_field_index("text")))
            pairs = np.unique(row << BITS | bucket)
            ptr = np.searchsorted(pairs >> BITS, np.arange(part.num_rows + 1))
            sets = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("positive")), sets], names=["positive", "features"])


def sample_ids(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int) -> DataFrame:
    """Ids of the fit: confirmed toxic rows, and rows of any label state, both
    outside the held-out fold and bounded in number."""
    order = F.xxhash64("doc_id")
    toxic = (labels.filter(F.col("toxic") == 1).select("doc_id").filter(~held_out() & F.col("doc_id").isNotNull())
             .distinct().orderBy(order, "doc_id").limit(max_positive))
    any_ = docs.select("doc_id").filter(~held_out() & F.col("doc_id").isNotNull()).distinct().orderBy(order, "doc_id").limit(max_unlabelled)
    return toxic.withColumn("positive", F.lit(True)).unionByName(any_.withColumn("positive", F.lit(False)))


def fit_nnpu(positive: list, unlabelled: list, prior: float, steps: int = 400, rate: float = 0.05,
             decay: float = 2e-4, keep: int = FEATURES,
             least: float = 6.0) -> tuple[np.ndarray, float]:
    """Weights over all buckets and a bias.  ``positive`` and ``unlabelled`` are
    lists of distinct bucket arrays, one for each text."""
    size = 1 << BITS
    df = [sum((np.bincount(np.concatenate(x[i:i + 1000]), minlength=size) for i in range(0, len(x), 1000)), np.zeros(size, np.int64))
          for x in (positive, unlabelled)]
    n_p, n_u = max(len(positive), 1), max(len(unlabelled), 1)
    p, u = (df[0] + 0.5) / (n_p + 1), (df[1] + 0.5) / (n_u + 1)
    gain = (p - u) / np.sqrt(u * (1 - u) * (1 / n_p + 1 / n_u))        # how far P's rate is from U's, in deviations
    gain[df[0] < 3] = 0
    chosen = np.argsort(-gain, kind="stable")[:keep]
    chosen = chosen[gain[chosen] >= least]
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))

    def dense(sets):
        x = np.zeros((len(sets), len(chosen)), np.float32)
        for i, s in enumerate(sets):
            k = place[s]
            x[i, k[k >= 0]] = 1
        return x

    xp, xu = dense(positive), dense(unlabelled)
    w, b = np.zeros(len(chosen), np.float32), np.float32(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = xp @ w + b, xu @ w + b
        # slopes of log(1+exp(-z)) and log(1+exp(z))
        up, down_p, down_u = -sig(-zp) / n_p, sig(zp) / n_p, sig(zu) / n_u
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if rest >= 0:
            gp, gu = prior * (up - down_p), down_u
        else:
            gp, gu = prior * down_p, -down_u
        g = np.append(xp.T @ gp + xu.T @ gu + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        # no weight below zero: ordinary words of a long text don't outweigh what was found in it
        w, b = np.maximum(w - step[:-1], 0).astype(np.float32), np.float32(b - step[-1])
    out = np.zeros(size, np.float32)
    out[chosen] = w
    return out, float(b)


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 10000):
    """(weights, bias) learned from the folds that are not held out."""
    ids = sample_ids(docs, labels, max_positive, max_unlabelled)
    known = labels.filter(~held_out()).select("doc_id", "toxic").distinct().agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    # bounded by the two limits above, so its size is known; an id that stands in many rows gives one text
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    text = text.groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    rows = text.select("text", "positive").mapInArrow(_sample_features, "positive boolean, features array<int>")
    prior = float(np.clip(known or 0.0, 1e-3, 0.5))
    # the sample is bounded, so one task fits it; the driver gets the weights alone
    got = rows.repartition(1).mapInArrow(_fitted(prior), "weights binary, bias double").first()
    if got is None:
        return np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior))) if known else -30.0
    return np.frombuffer(bytes(got.weights), np.float32), got.bias


def _fitted(prior: float):
    """The sample's rows (positive, features) in; one row with weights and bias out, none without positives."""

    def run(batches):
        sets: dict = {True: {}, False: {}}
        for batch in batches:
            for pos, feats in zip(batch.column(0).to_pylist(), batch.column(1)):
                a = np.array(feats.values)
                sets[pos].setdefault(a.tobytes(), a)
        ordered = {k: [d[x] for x in sorted(d)] for k, d in sets.items()}       # the same fit whatever the row order
        if ordered[True]:
            w, b = fit_nnpu(ordered[True], ordered[False], prior)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], names=["weights", "bias"])
    return run


def scorer(weights, bias: float):
    """Arrow batches with a text column in, the other columns and a score out."""

    def run(batches):
        w = weights.value
        telling = w != 0
        for batch in batches:
            for part in tg.slices(batch):
                bucket, row = _buckets(part.column(part.schema.get_field_index("text")))
                hit = telling[bucket]
                pairs = np.unique(row[hit] << BITS | bucket[hit])
                z = np.bincount(pairs >> BITS, w[pairs & ((1 << BITS) - 1)], part.num_rows) + bias
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                keep = [k for k, f in enumerate(part.schema) if f.name != "text"]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [pa.array(score)],
                                                 names=[part.schema[k].name for k in keep] + ["score"])
    return run


def score_documents(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    w, b = fit(docs, labels, **bounds)
    weights = docs.sparkSession.sparkContext.broadcast(w)
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = src.mapInArrow(scorer(weights, b), f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The documents that are not predicted toxic, all their columns kept."""
    w, b = fit(docs, labels, **bounds)
    weights = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for batch in batches:
            for part in tg.slices(batch):
                score = next(iter(scorer(weights, b)([part.select(["text"])])))
                keep = np.asarray(score.column(0)) < THRESHOLD
                yield part.filter(pa.array(keep))
    return docs.mapInArrow(run, docs.schema)


@query("op4_toxicity")
def op4(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
